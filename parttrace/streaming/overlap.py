"""Records that arrive over time: each micro-batch is checked against the identifiers of all before it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.detect import IDENTIFIER_FINDINGS, accepted_identifiers


def sides_seen(stream: DataFrame, fields=tuple(IDENTIFIER_FINDINGS)) -> DataFrame:
    """Per identifier value of a stream of records, the records seen on each side so far.

    State is one row per value, kept by Structured Streaming; run it in update or complete mode.
    """
    long = accepted_identifiers(stream, None, fields)
    side = F.col("partition")
    return long.groupBy("semantic_field", "value").agg(F.count_if(side == "train").alias("n_train"), F.count_if(side == "test").alias("n_test"))


def overlaps(stream: DataFrame, fields=tuple(IDENTIFIER_FINDINGS)) -> DataFrame:
    """The values that both sides have by now."""
    return sides_seen(stream, fields).where("n_train > 0 AND n_test > 0")
