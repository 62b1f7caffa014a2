"""Streaming twins of batch operators: message numbers, thresholds, metric windows.

The compared engine has no streams; these are extensions, with the results of
their batch operators.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tessera.operators.ops import above_thresholds


def numbered_messages(messages: DataFrame) -> DataFrame:
    """message_seq, gap-free from 1 in each session, in the order of arrival, then of ``seq``.

    The state of a session is one number.
    """

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        (last,) = state.get if state.exists else (0,)
        rows = pd.concat(list(parts)).sort_values("seq", kind="stable")
        rows["message_seq"] = range(last + 1, last + 1 + len(rows))
        state.update((last + len(rows),))
        yield rows[["session", "seq", "message_seq"]]

    return messages.groupBy("session").applyInPandasWithState(run, "session long, seq long, message_seq long", "last long", "append", GroupStateTimeout.NoTimeout)


def threshold_alerts(samples: DataFrame) -> DataFrame:
    """A stream of samples with their alert; stateless."""
    return above_thresholds(samples).filter("alert")


def metric_windows(samples: DataFrame, minutes: int = 10, late: str = "10 minutes") -> DataFrame:
    """A8 by time: count, least, greatest and mean a series and window; rows later than the watermark are dropped."""
    each = samples.withWatermark("ts", late).groupBy(F.window("ts", f"{minutes} minutes"), "series")
    return each.agg(F.count("*").alias("samples"), F.min("value").alias("min"), F.max("value").alias("max"), F.round(F.avg("value"), 4).alias("mean")).select("window.start", "series", "samples", "min", "max", "mean")
