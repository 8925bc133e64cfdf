"""Ordered narration rules, caller rulesets and keyword scoring, as Column expressions."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Ordered patterns of payment rails, of cash, and of flows.
RAILS = [("upi", "^UPI"), ("neft", "NEFT"), ("imps", "IMPS"), ("rtgs", "RTGS"), ("atm", "ATM"), ("card", "POS|CARD"), ("cheque", "CHQ|CHEQUE"), ("bill", "BBPS"), ("cash", "CASH")]
CASH = [("withdrawal", "ATM|CASH WITHDRAWAL|CASH WDL"), ("deposit", "CASH DEP|BY CASH")]
FLOWS = [("REVERSAL", "REVERSAL|RETURN"), ("TRANSFER", "SELF|OWN ACCOUNT"), ("SALARY", "SALARY"), ("LOAN", "EMI|LOAN"), ("CHARGES", "CHARGES|PENAL"), ("UTILITY", "ELECTRICITY|BBPS"), ("RENT", "RENT")]


def first_of(text: Column, patterns: list[tuple[str, str]], default: Column | None = None) -> Column:
    out = F.lit(None) if default is None else default
    for name, p in reversed(patterns):
        out = F.when(text.rlike(p), name).otherwise(out)
    return out


def described(txn: DataFrame) -> DataFrame:
    """txn with rail, cash (kind) and flow (type) of every row."""
    t = F.upper("narration")
    side = F.when(F.col("direction") == "credit", "INCOME").otherwise("EXPENSE")
    return txn.withColumns({"rail": first_of(t, RAILS), "cash": first_of(t, CASH), "flow": first_of(t, FLOWS, side)})


def describe(txn: DataFrame) -> DataFrame:
    """txn_id, rail, cash kind and flow type of every row."""
    return described(txn).select("txn_id", "rail", "cash", "flow")


class Ruleset:
    """A caller's ruleset, checked against the allowed keys; evaluate() gives each row's winner.

    A rule: id, category, priority, stop, match{any_of, all_of, none_of, regex, direction, min_amount, max_amount}.
    """

    MATCH = {"any_of", "all_of", "none_of", "regex", "direction", "min_amount", "max_amount"}

    def __init__(self, raw: str | dict):
        data = json.loads(raw) if isinstance(raw, str) else raw
        self.default, self.rules = data.get("default_category"), data["rules"]
        for r in self.rules:
            if bad := set(r.get("match", {})) - self.MATCH:
                raise ValueError(f"rule {r.get('id')}: unknown match keys {sorted(bad)}")
            if not r.get("id") or not r.get("category"):
                raise ValueError("a rule needs id and category")

    @staticmethod
    def condition(m: dict) -> Column:
        t = F.upper(F.coalesce("narration", F.lit("")))
        parts = [F.lit(True)]
        if "direction" in m:
            parts.append(F.col("direction") == m["direction"])
        if "min_amount" in m:
            parts.append(F.col("amount_paise") >= m["min_amount"])
        if "max_amount" in m:
            parts.append(F.col("amount_paise") <= m["max_amount"])
        parts += [~t.contains(w.upper()) for w in m.get("none_of", [])] + [t.contains(w.upper()) for w in m.get("all_of", [])]
        if m.get("any_of"):
            parts.append(reduce(Column.__or__, [t.contains(w.upper()) for w in m["any_of"]]))
        if "regex" in m:
            parts.append(F.substring(t, 1, 2000).rlike(m["regex"]))
        return reduce(Column.__and__, parts)

    def evaluate(self, txn: DataFrame) -> DataFrame:
        """txn_id, rule_id, category: the matching rule of highest priority (of equals the first) before a stop rule's end."""
        hits = F.array_compact(F.array(*[F.when(self.condition(r.get("match", {})), F.struct(F.lit(i).alias("i"), F.lit(int(r.get("priority", 0))).alias("p"), F.lit(bool(r.get("stop"))).alias("stop"), F.lit(r["id"]).alias("id"), F.lit(r["category"]).alias("category"))) for i, r in enumerate(self.rules)]))
        x = txn.select("txn_id", hits.alias("h")).withColumn("end", F.coalesce(F.array_min(F.transform(F.filter("h", lambda s: s["stop"]), lambda s: s["i"])), F.lit(10**6)))
        best = F.array_max(F.transform(F.filter("h", lambda s: s["i"] <= F.col("end")), lambda s: F.struct(s["p"].alias("p"), (-s["i"]).alias("i"), s["id"].alias("id"), s["category"].alias("category"))))
        return x.select("txn_id", best.alias("b")).select("txn_id", F.col("b.id").alias("rule_id"), F.coalesce("b.category", F.lit(self.default)).alias("category"))

    def usage(self, txn: DataFrame) -> DataFrame:
        """Hits of every rule, none included."""
        ids = txn.sparkSession.createDataFrame([(r["id"],) for r in self.rules], "rule_id string")
        return ids.join(self.evaluate(txn).where("rule_id is not null").groupBy("rule_id").agg(F.count(F.lit(1)).alias("hits")), "rule_id", "left").select("rule_id", F.coalesce("hits", F.lit(0)).cast("long").alias("hits"))


def keyword_scores(txn: DataFrame, rules: DataFrame) -> DataFrame:
    """txn_id, category, score, ambiguous: best category by the highest score of its words; ties marked.

    rules(word, category, score) is small and checked by the caller; words meet by an equi-join.
    """
    words = txn.select("txn_id", F.explode(F.array_distinct(F.split(F.regexp_replace(F.upper("narration"), "[^A-Z]+", " "), " "))).alias("word"))
    per = words.join(rules, "word").groupBy("txn_id", "category").agg(F.max("score").alias("score"))
    top = per.groupBy("txn_id").agg(F.max("score").alias("score"))
    return per.join(top, ["txn_id", "score"]).groupBy("txn_id", "score").agg(F.max("category").alias("category"), (F.count(F.lit(1)) > 1).alias("ambiguous"))


def propagate(rows: DataFrame, decisions: DataFrame, key: str = "party_key") -> DataFrame:
    """rows with the category, method and confidence of their party's decision where a decision is still needed
    (category null or needs_review); settled rows and rows without a decision stay. decisions(key, category): one a key.
    """
    d = decisions.select(key, F.col("category").alias("_decided"))
    x = rows.join(d, key, "left")
    take = (F.col("category").isNull() | F.coalesce(F.col("needs_review"), F.lit(False))) & F.col("_decided").isNotNull()
    new = {"category": F.col("_decided"), "method": F.lit("counterparty_memory"), "confidence": F.lit(0.95), "needs_review": F.lit(False)}
    return x.withColumn("_take", take).withColumns({c: F.when(F.col("_take"), v).otherwise(F.col(c)) for c, v in new.items()}).drop("_decided", "_take")
