"""Forward-only operators on a stream: per-series state, one update for each row, results as rows arrive.

The exclusive-evidence mixture is a running sum for each member, so it needs only that as its state: a late or repeated batch is a
replay of rows in order, and the state is as large as the number of members.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "key string, rn long, mixed double"
STATE = "rn long, score array<double>"


def prequential_stream(rows: DataFrame, members: int, temperature: float = 8.0, decay: float = 1.0) -> DataFrame:
    """``rows``: a stream of ``key, rn, member, value, evidence`` with all members of a row in one batch. Gives ``(key, rn, mixed)``:
    values weighted by the softmax of evidence strictly before the row. Rows at or before the last one seen are dropped."""

    def update(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, score = state.get if state.exists else (-1, [0.0] * members)
        score, out = np.array(score), []
        table = pd.concat(list(parts), ignore_index=True).drop_duplicates(["rn", "member"]).sort_values(["rn", "member"])
        for rn, row in table[table["rn"] > last].groupby("rn"):
            v, e = np.zeros(members), np.zeros(members)
            v[row["member"]], e[row["member"]] = row["value"], row["evidence"]
            w = np.exp((score - score.max()) / temperature)
            out.append((key[0], int(rn), float(w @ v / w.sum())))
            score, last = decay * score + e, int(rn)
        state.update((last, score.tolist()))
        yield pd.DataFrame(out, columns=["key", "rn", "mixed"])

    cols = [F.col("key").cast("string").alias("key"), "rn", "member", "value", "evidence"]
    return rows.select(*cols).groupBy("key").applyInPandasWithState(update, OUT, STATE, "append", GroupStateTimeout.NoTimeout)


def windowed_metrics(rows: DataFrame, time: str, late: str, width: str, group: str, truth: str, arm: str) -> DataFrame:
    """Root error by group and tumbling window of event time, final once the watermark has passed."""
    return rows.withWatermark(time, late).groupBy(F.window(time, width), group).agg(F.count("*").alias("n"), F.sqrt(F.avg(F.pow(F.col(truth) - F.col(arm), 2))).alias("rmse"))
