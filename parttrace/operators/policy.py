"""Policies: which findings break the split, which are allowed, which need a look."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import ConfigError


@dataclass(frozen=True)
class SplitPolicy:
    name: str = "default"
    patient_disjoint: bool = True
    specimen_disjoint: bool = True
    slide_disjoint: bool = True
    byte_content_disjoint: bool = True
    pixel_content_disjoint: bool = True
    institution_disjoint: bool = False
    similarity_candidates_fail_audit: bool = False


PROFILES = {"default": SplitPolicy()}
#: Finding types and the rule that decides on each.
RULES = {
    "confirmed_patient_overlap": "patient_disjoint",
    "confirmed_specimen_overlap": "specimen_disjoint",
    "confirmed_slide_overlap": "slide_disjoint",
    "confirmed_byte_content_duplicate": "byte_content_disjoint",
    "confirmed_pixel_content_duplicate": "pixel_content_disjoint",
    "institution_overlap": "institution_disjoint",
    "image_similarity_candidate": "similarity_candidates_fail_audit",
}
INPUT_QUALITY = ("image_read_error", "resource_limit_exceeded")
CONFIRMED = tuple(RULES)[:5]
OUTCOMES = ("violation", "allowed_overlap", "review_item", "not_applicable")


def profile(name: str = "default") -> SplitPolicy:
    if name not in PROFILES:
        raise ConfigError(f"unknown policy profile {name!r}; known: {sorted(PROFILES)}")
    return PROFILES[name]


def rules(spark, policy: SplitPolicy) -> DataFrame:
    """The policy as a table: finding_type, outcome, rule, reason. A dozen rows at most."""
    on = {f.name: getattr(policy, f.name) for f in fields(policy)}
    rows = []
    for kind, rule in RULES.items():
        if on[rule]:
            outcome, reason = "violation", f"{rule} is required"
        elif kind == "image_similarity_candidate":
            outcome, reason = "review_item", "similar images need a person's judgement"
        else:
            outcome, reason = "allowed_overlap", f"{rule} is not required"
        rows.append((kind, outcome, rule, reason))
    rows += [(kind, "review_item", "input_quality_review", "the input could not be examined whole") for kind in INPUT_QUALITY]
    return spark.createDataFrame(rows, "finding_type string, policy_outcome string, policy_rule string, policy_reason string")


def evaluate(findings: DataFrame, policy: SplitPolicy) -> DataFrame:
    """Findings with outcome, rule, reason and whether a repair may use them; unknown types are review items."""
    table = rules(findings.sparkSession, policy)
    judged = findings.join(F.broadcast(table), "finding_type", "left").withColumns({
        "policy_outcome": F.coalesce("policy_outcome", F.lit("review_item")),
        "policy_rule": F.coalesce("policy_rule", F.lit("unsupported_or_ambiguous_review")),
        "policy_reason": F.coalesce("policy_reason", F.lit("no rule decides on this type")),
        "policy_profile": F.lit(policy.name),
    })
    eligible = F.col("finding_type").isin(*CONFIRMED) & (F.col("policy_outcome") == "violation") & (F.col("confirmation_level") == "confirmed")
    return judged.withColumn("repair_eligible", eligible)


def summary(evaluated: DataFrame) -> DataFrame:
    """One row: findings by outcome, and the exit code (2 with violations, else 0)."""
    counts = [F.count_if(F.col("policy_outcome") == o).alias(f"n_{o}") for o in OUTCOMES]
    out = evaluated.agg(F.count(F.lit(1)).alias("n_findings"), *counts)
    return out.withColumn("exit_code", F.when(F.col("n_violation") > 0, 2).otherwise(0))
