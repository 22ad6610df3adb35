"""Column profiles: exact counts and signals over all rows, from which meanings are inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

# File endings of images, and words for a split.
IMAGE_SUFFIXES = (".svs", ".tif", ".tiff", ".png", ".jpg", ".jpeg", ".dcm", ".ndpi", ".mrxs")
SPLIT_VALUES = ("train", "training", "test", "testing", "val", "valid", "validation")
# The forms of values that a column's flags name.
PATTERNS = {
    "image_path_like": r"(?i)\.(svs|tiff?|png|jpe?g|dcm|ndpi|mrxs)\z",
    "uuid_like": r"(?i)\A[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\z",
    "barcode_like": r"(?i)\ATCGA-[A-Z0-9]{2}-[A-Z0-9]{4}",
    "integer_like": r"\A[+-]?\d+\z",
    "decimal_like": r"\A[+-]?\d+\.\d+\z",
    "path_like": r"[/\\]",
}


def _long(df: DataFrame, columns: list[str], unicode: bool) -> DataFrame:
    """(column, value): all columns in one pass; missing values null."""
    cells = F.array(*(F.struct(F.lit(c).alias("column"), T.value(F.col(f"`{c}`").cast("string"), unicode).alias("value")) for c in columns))
    return df.select(F.explode(cells).alias("c")).select("c.*")


def profile(df: DataFrame, columns: list[str] | None = None, unicode: bool = True) -> DataFrame:
    """Per column: n_rows, n_present, n_missing, n_distinct, distinct_ratio and whether all values fit each pattern.

    Values are counted before they are compared, so a column's repeated values cross the shuffle once per task.
    """
    columns = columns or df.columns
    values = _long(df, columns, unicode).groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    there = F.col("value").isNotNull()
    low = F.lower("value")
    # first per column and hashed value, then per column: a column of distinct values isn't one task's
    parts = values.groupBy("column", F.pmod(F.xxhash64("value"), F.lit(64)).alias("part")).agg(
        F.sum("n").alias("n_rows"), F.sum(F.when(there, F.col("n")).otherwise(0)).alias("n_present"), F.count("value").alias("n_distinct"),
        F.bool_or(F.coalesce(low.rlike(PATTERNS["image_path_like"]) | F.col("value").contains("/"), F.lit(False))).alias("image_signal"),
        F.bool_and(F.when(there, low.isin(*SPLIT_VALUES))).alias("all_split"), *[F.bool_and(F.when(there, F.col("value").rlike(p))).alias(n) for n, p in PATTERNS.items()],
    )
    out = parts.groupBy("column").agg(
        F.sum("n_rows").alias("n_rows"), F.sum("n_present").alias("n_present"), F.sum("n_distinct").alias("n_distinct"), F.bool_or("image_signal").alias("image_signal"),
        F.coalesce(F.bool_and("all_split"), F.lit(False)).alias("all_split"), *[F.coalesce(F.bool_and(n), F.lit(False)).alias(n) for n in PATTERNS],
    )
    ratio = F.when(F.col("n_present") > 0, F.round(F.col("n_distinct") / F.col("n_present"), 4)).otherwise(0.0)
    return out.withColumns({"n_missing": F.col("n_rows") - F.col("n_present"), "distinct_ratio": ratio})


def signals(profiled: DataFrame) -> DataFrame:
    """Which meanings a column's values alone speak for."""
    n, d = F.col("n_present"), F.col("n_distinct")
    return profiled.select(
        "column",
        F.col("image_signal").alias("image_path"),
        (F.col("all_split") & (d <= 3)).alias("partition"),
        ((d > 1) & (d <= F.greatest(F.lit(2), F.floor(n / 2)))).alias("class_label"),
        ((n > 0) & (d == n)).alias("source_record_id"),
        ((d >= 1) & (d <= F.greatest(F.lit(1), F.floor(n / 3)))).alias("institution_id"),
    )


def flags(profiled: DataFrame) -> DataFrame:
    """Abstract descriptions of columns that give no value away."""
    n, d = F.col("n_present"), F.col("n_distinct")
    return profiled.select(
        "column",
        ((n > 0) & (d / F.greatest(n, F.lit(1)) >= 0.9)).alias("mostly_unique"),
        ((n > 0) & (d <= F.greatest(F.lit(2), F.floor(n / 5)))).alias("low_cardinality"),
        (d < n).alias("repeated_categorical"),
        *PATTERNS,
        (F.col("integer_like") | F.col("decimal_like")).alias("numeric_like"),
    )
