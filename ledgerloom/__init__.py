"""Statement-ledger analytics as DataFrame -> DataFrame operators on Spark."""
