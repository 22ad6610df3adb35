"""The relationship graph: records as nodes, findings expanded to edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import GraphError
from .components import connected

EDGE_TYPES = ("confirmed_patient_overlap", "confirmed_specimen_overlap", "confirmed_slide_overlap", "institution_overlap", "confirmed_byte_content_duplicate", "confirmed_pixel_content_duplicate", "image_similarity_candidate")


def nodes(records: DataFrame) -> DataFrame:
    return records.select("record_id", "partition", "label")


def _typed(findings: DataFrame, members: DataFrame) -> DataFrame:
    kinds = findings.where(F.col("finding_type").isin(*EDGE_TYPES)).select("finding_id", "finding_type", "confirmation_level", "first_record_id")
    return members.select("finding_id", "record_id").distinct().join(kinds, "finding_id")


def _level():
    return F.when(F.col("finding_type") == "image_similarity_candidate", "probable").when(F.col("finding_type") == "institution_overlap", "warning").otherwise(F.col("confirmation_level"))


def edges(findings: DataFrame, members: DataFrame) -> DataFrame:
    """All pairs of each finding's records: what a report shows. For components use ``star_edges``, which grow linearly."""
    m = _typed(findings, members)
    pairs = m.toDF(*(["finding_id", "src", "finding_type", "confirmation_level", "first_record_id"])).join(m.select("finding_id", F.col("record_id").alias("dst")), "finding_id").where("src < dst")
    return pairs.select("src", "dst", "finding_id", F.col("finding_type").alias("relationship_type"), _level().alias("confirmation_level")).dropDuplicates(["src", "dst", "finding_id", "relationship_type"])


def star_edges(findings: DataFrame, members: DataFrame) -> DataFrame:
    """From each finding's first record to its others."""
    m = _typed(findings, members).where("record_id != first_record_id")
    return m.select(F.col("first_record_id").alias("src"), F.col("record_id").alias("dst"), "finding_id", F.col("finding_type").alias("relationship_type"), _level().alias("confirmation_level"))


def edge_counts(findings: DataFrame) -> DataFrame:
    """Edges by type, from the groups' sizes alone."""
    n = F.col("n_records")
    return findings.where(F.col("finding_type").isin(*EDGE_TYPES)).groupBy(F.col("finding_type").alias("relationship_type")).agg(F.sum((n * (n - 1) / 2).cast("long")).alias("n_edges"))


def lost(members: DataFrame, records: DataFrame) -> DataFrame:
    """Members that are no record."""
    return members.join(records.select("record_id"), "record_id", "left_anti")


def check(findings: DataFrame, members: DataFrame, records: DataFrame) -> None:
    """Finding ids are unique and every member is a record."""
    twice = findings.groupBy("finding_id").count().where("count > 1").limit(1).collect()
    if twice:
        raise GraphError(f"finding id is not unique: {twice[0][0]}")
    absent = lost(members, records).limit(1).collect()
    if absent:
        raise GraphError(f"a finding names a record that isn't there: {absent[0]['record_id']}")


def largest(findings: DataFrame, members: DataFrame) -> DataFrame:
    """One row: the records of the largest component over all edges, 1 when there are none; and how many components have edges."""
    sizes = connected(star_edges(findings, members)).groupBy("component").count()
    return sizes.agg(F.coalesce(F.max("count"), F.lit(1)).alias("largest"), F.count(F.lit(1)).alias("n_components"))


def largest_component(findings: DataFrame, members: DataFrame) -> int:
    return largest(findings, members).first()["largest"]
