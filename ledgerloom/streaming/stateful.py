"""Streams that remember: better rows replace earlier ones, and requests that come again are answered as before."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

PAYMENT = ["account_id", "direction", "amount_paise", "reference_no", "day"]
_KEPT = ", ".join(["account_id long", "direction string", "amount_paise long", "reference_no string", "day string"])


def _rank(source: str, row_index: int, txn_id: int) -> tuple[int, int, int]:
    return (0 if source == "statement" else 1, row_index, txn_id)


def survivors(rows: DataFrame, forget_after: str = "30 days") -> DataFrame:
    """For rows(account_id, direction, amount_paise, reference_no, ts, source_type, row_index, txn_id): account_id, direction, amount_paise,
    reference_no, day, txn_id, replaced and version each time a better row of a payment comes.

    A statement's row is better than an alert's, then the lower row index, then the lower id. The highest version of a payment is the
    row that a whole table would keep, whatever order rows came in. A null reference is one of its own. State goes
    when the watermark has passed a payment's last row by `forget_after`; rows later than that start anew.
    """
    keyed = rows.withColumn("day", F.to_date("ts").cast("string")).withColumns({"reference_no": F.coalesce("reference_no", F.lit(""))}).withWatermark("ts", forget_after)

    def better(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        best, txn_id, version = None, None, 0
        if state.exists:
            kind, index, txn_id, version = state.get
            best = (kind, index, txn_id)
        came, last = best, 0
        for b in batches:
            for source, index, i, ts in zip(b["source_type"], b["row_index"], b["txn_id"], b["ts"]):
                now = _rank(source, int(index), int(i))
                best, last = now if best is None else min(best, now), max(last, int(ts.timestamp() * 1000))
        if best != came:
            version += 1
            yield pd.DataFrame([[*key, best[2], txn_id, version]], columns=[*PAYMENT, "txn_id", "replaced", "version"]).astype({"replaced": "Int64"})
        state.update((*best, version))
        state.setTimeoutTimestamp(max(last, state.getCurrentWatermarkMs()) + 1)

    return keyed.groupBy(*PAYMENT).applyInPandasWithState(better, f"{_KEPT}, txn_id long, replaced long, version int", "kind int, row_index long, txn_id long, version int", "append", GroupStateTimeout.EventTimeTimeout)


def answered_once(requests: DataFrame, keep_for: str = "1 day") -> DataFrame:
    """For requests(client, key, fingerprint, ts, request_id): client, key, request_id, outcome and first_id, the request whose answer holds.

    The first request of a client's key is `new`, later ones with its fingerprint are a `replay` of it, others a
    `conflict`. Those of one batch go by time, then id. A key is forgotten when the watermark has passed it by `keep_for`.
    """
    def answer(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = state.get if state.exists else None
        out, last = [], 0
        rows = pd.concat(list(batches)).sort_values(["ts", "request_id"])
        for mark, i, ts in zip(rows["fingerprint"], rows["request_id"], rows["ts"]):
            last = max(last, int(ts.timestamp() * 1000))
            if held is None:
                held = (mark, int(i))
                out.append([*key, int(i), "new", held[1]])
            else:
                out.append([*key, int(i), "replay" if mark == held[0] else "conflict", held[1]])
        state.update(held)
        state.setTimeoutTimestamp(max(last, state.getCurrentWatermarkMs()) + 1)
        yield pd.DataFrame(out, columns=["client", "key", "request_id", "outcome", "first_id"])

    return requests.withWatermark("ts", keep_for).groupBy("client", "key").applyInPandasWithState(answer, "client string, key string, request_id long, outcome string, first_id long", "fingerprint string, first_id long", "append", GroupStateTimeout.EventTimeTimeout)
