"""Repair proposals: indivisible components dealt to the sides in a fixed greedy order.

The greedy rule puts each component where the train count comes nearest its target; labels, moved records and
train-before-test decide ties only. So over components of one size s, in order, train is chosen while the count so far
plus s / 2 is below the target, and once it isn't, nothing of that size changes the count any more, but for a tie at
exactly the target. The fold needs one step per distinct size, not per component: components stay distributed.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import RepairError
from ..functions.text import digest
from ..session import numbered, settled
from .components import connected
from .policy import CONFIRMED, SplitPolicy

MISSING_LABEL = "__missing__"
#: What every row of a proposal says.
STATEMENT = "A proposal for review; no data were moved."


@dataclass(frozen=True)
class Repair:
    """components: one row each with its proposed side; records: one row each; ties: the findings of each component."""

    policy_profile: str
    components: DataFrame
    records: DataFrame
    included: list[str]
    excluded: list[str]
    metrics: dict
    tradeoffs: list[str]
    ties: DataFrame


def included(evaluated: DataFrame, by_institution: bool = False):
    """Condition on findings that tie records together."""
    own = F.col("repair_eligible") & F.col("finding_type").isin(*CONFIRMED)
    return own | ((F.col("finding_type") == "institution_overlap") & F.col("policy_outcome").isin("violation", "allowed_overlap")) if by_institution else own


def components(records: DataFrame, evaluated: DataFrame, members: DataFrame, by_institution: bool = False) -> tuple[DataFrame, DataFrame]:
    """(record to component, one row per component). Records without a tie are components of their own."""
    ties = evaluated.where(included(evaluated, by_institution)).select("finding_id", "first_record_id", "n_train", "n_test")
    edges = members.select("finding_id", "record_id").distinct().join(ties, "finding_id").select(F.col("first_record_id").alias("src"), F.col("record_id").alias("dst"))
    label = connected(edges).toDF("record_id", "root")
    of = records.select("record_id", "partition", F.coalesce("label", F.lit(MISSING_LABEL)).alias("label")).join(label, "record_id", "left").withColumn("root", F.coalesce("root", "record_id"))
    crossing = ties.join(label, ties.first_record_id == label.record_id).groupBy("root").agg(F.count_if((F.col("n_train") > 0) & (F.col("n_test") > 0)).alias("cross_findings"), F.count(F.lit(1)).alias("n_findings"))
    h = F.xxhash64("record_id")
    sums = of.groupBy("root").agg(F.count(F.lit(1)).alias("size"), F.count_if(F.col("partition") == "train").alias("n_train"), F.count_if(F.col("partition") == "test").alias("n_test"), F.bit_xor(h).alias("x"))
    out = sums.join(crossing, "root", "left").withColumns({"cross_findings": F.coalesce("cross_findings", F.lit(0)), "n_findings": F.coalesce("n_findings", F.lit(0))})
    out = out.withColumns({"component_id": F.concat(F.lit("component_"), F.substring(digest(F.concat_ws("\x1f", "root", F.col("size").cast("string"), F.hex("x"))), 1, 16)), "cross_partition": (F.col("n_train") > 0) & (F.col("n_test") > 0)}).drop("x")
    return settled(of), settled(out)


def label_counts(of: DataFrame) -> DataFrame:
    """Records per component and label."""
    return of.groupBy("root", "label").agg(F.count(F.lit(1)).alias("n"))


def propose(records: DataFrame, evaluated: DataFrame, members: DataFrame, policy: SplitPolicy, target: float | None = None, by_institution: bool = False) -> Repair:
    of, comps = components(records, evaluated, members, by_institution)
    total, train = of.agg(F.count(F.lit(1)), F.count_if(F.col("partition") == "train")).first()
    if not total:
        raise RepairError("repair requires at least one record")
    fraction = train / total if target is None else target
    if not 0 < fraction < 1:
        raise RepairError("target_train_fraction must be strictly between 0 and 1")
    goal = fraction * total
    overall = {r["label"]: r["n"] for r in of.groupBy("label").agg(F.count(F.lit(1)).alias("n")).orderBy("label").collect()}
    weigh = MISSING_LABEL not in overall
    ordered = numbered(comps.withColumns({"_size": -F.col("size"), "_cross": -F.col("cross_findings")}), "_size", "_cross", "root").drop("_size", "_cross")
    ordered = settled(ordered)
    sizes = ordered.groupBy("size").agg(F.min("ordinal").alias("first"), F.count(F.lit(1)).alias("n")).orderBy(F.desc("size")).collect()
    count, spans = 0, []  # spans: (size, first and last ordinal that go to train)
    for row in sizes:
        s, first, n = row["size"], row["first"], row["n"]
        k = max(0, min(n, math.ceil((goal - count) / s - 0.5)))
        while k < n and count + k * s + s / 2 < goal:
            k += 1
        while k and not count + (k - 1) * s + s / 2 < goal:
            k -= 1
        count += k * s
        if k:
            spans.append((s, first, first + k - 1))
        if k < n and abs(count + s - goal) == abs(count - goal):
            at = _tie(ordered.where((F.col("size") == s) & (F.col("ordinal") >= first + k)), of, spans, ordered, overall if weigh else {}, fraction)
            if at is not None:
                count += s
                spans.append((s, at, at))
    side = F.lit(False)
    for _, a, b in spans:
        side = side | F.col("ordinal").between(a, b)
    dealt = ordered.withColumn("proposed_partition", F.when(side, "train").otherwise("test"))
    dealt = settled(dealt.withColumn("n_moved", F.when(side, F.col("n_test")).otherwise(F.col("n_train"))))
    out = of.join(dealt.select("root", "component_id", "proposed_partition", "cross_partition"), "root")
    _complete(out, records)
    out = out.select("record_id", "component_id", F.col("partition").alias("original_partition"), "proposed_partition", (F.col("partition") != F.col("proposed_partition")).alias("moved"), "label", "cross_partition")
    totals = dealt.agg(F.sum("n_moved").alias("moved"), F.count(F.lit(1)).alias("components"), F.max("size").alias("largest"), F.count_if("cross_partition").alias("crossing")).first()
    after: dict[str, dict[str, int]] = {"train": {}, "test": {}}
    for r in out.groupBy("proposed_partition", "label").count().orderBy("proposed_partition", "label").collect():
        after[r[0]][r[1]] = r[2]
    kinds = evaluated.groupBy("finding_type").agg(F.bool_or(included(evaluated, by_institution)).alias("yes"), F.bool_or(~included(evaluated, by_institution)).alias("no")).collect()
    metrics = {
        "original_train_fraction": train / total, "proposed_train_fraction": count / total, "target_train_fraction": fraction, "records_moved": totals["moved"], "component_count": totals["components"],
        "largest_component_size": totals["largest"], "label_distribution_before": json.dumps(overall, sort_keys=True), "label_distribution_after": json.dumps(after, sort_keys=True),
    }
    return Repair(policy.name, dealt, out, sorted(r[0] for r in kinds if r["yes"]), sorted(r[0] for r in kinds if r["no"]), metrics, tradeoffs(metrics, overall, totals, goal, count, {r[0] for r in kinds}, by_institution), confirming(of, evaluated, by_institution).join(dealt.select("root", "component_id"), "root").select("component_id", "finding_id"))


def _complete(dealt: DataFrame, records: DataFrame) -> None:
    """Every record is dealt to a side once."""
    counts = records.select("record_id", F.lit(1).alias("there"), F.lit(0).alias("dealt")).unionByName(dealt.select("record_id", F.lit(0).alias("there"), F.col("proposed_partition").isNotNull().cast("int").alias("dealt")))
    wrong = counts.groupBy("record_id").agg(F.sum("there").alias("there"), F.sum("dealt").alias("dealt")).where("there != 1 or dealt != 1").limit(1).collect()
    if wrong:
        raise RepairError(f"record {wrong[0]['record_id']} is not dealt to a side exactly once")


def confirming(of: DataFrame, evaluated: DataFrame, by_institution: bool = False) -> DataFrame:
    """(root, finding_id) of the findings that tie each component's records together."""
    ties = evaluated.where(included(evaluated, by_institution)).select("finding_id", F.col("first_record_id").alias("record_id"))
    return ties.join(of.select("record_id", "root"), "record_id").select("root", "finding_id")


def rows(fixed: Repair, records: DataFrame) -> DataFrame:
    """A proposal as its CSV file has it: one row per record, with the findings that tie its component, joined by ;."""
    ids = fixed.ties.groupBy("component_id").agg(F.concat_ws(";", F.array_sort(F.collect_set("finding_id"))).alias("confirming_finding_ids"))
    about = records.select("record_id", F.col("manifest_id").alias("source_manifest_id"), "source_row_number", F.col("label").alias("own_label"))
    out = fixed.records.join(about, "record_id").join(ids, "component_id", "left")
    return out.withColumns({"label": F.col("own_label"), "confirming_finding_ids": F.coalesce("confirming_finding_ids", F.lit("")), "proposal_statement": F.lit(STATEMENT)})


def _tie(open_ones: DataFrame, of: DataFrame, spans: list, ordered: DataFrame, overall: dict[str, int], fraction: float) -> int | None:
    """The first component of a tied size that train wins: by label deviation, then moved records, then train itself."""
    side = F.lit(False)
    for _, a, b in spans:
        side = side | F.col("ordinal").between(a, b)
    state = {r["label"]: r["n"] for r in of.join(ordered.where(side).select("root"), "root", "left_semi").groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()} if overall else {}
    counted = open_ones
    change = F.lit(0.0)
    if overall:
        per = label_counts(of).join(open_ones.select("root"), "root", "left_semi")
        table = F.create_map(*[F.lit(x) for label in overall for x in (label, float(state.get(label, 0)) - overall[label] * fraction)])
        d = F.try_element_at(table, F.col("label"))
        counted = open_ones.join(per.groupBy("root").agg(F.sum(F.abs(d + F.col("n")) - F.abs(d)).alias("change")), "root")
        change = F.round("change", 9)
    wins = (change < 0) | ((change == 0) & (F.col("n_test") <= F.col("n_train")))
    return counted.where(wins).agg(F.min("ordinal")).first()[0]


def tradeoffs(metrics: dict, overall: dict, totals, goal: float, count: int, kinds: set[str], by_institution: bool) -> list[str]:
    """What the proposal gives up, in words."""
    said = []
    if abs(count - goal) > 1e-9:
        said.append("indivisible components keep the proposed train count from its target")
    if MISSING_LABEL in overall:
        said.append("missing labels disable label balancing")
    if totals["crossing"]:
        said.append("components that crossed the split are moved to one side whole")
    if totals["largest"] > goal:
        said.append("the largest component exceeds the target train count")
    if "institution_overlap" in kinds and not by_institution:
        said.append("institution overlaps remain; they were not asked to be grouped")
    if "image_similarity_candidate" in kinds:
        said.append("similar images remain for review and tie no records together")
    return sorted(said)
