"""The audit: manifests, mapping, records, fingerprints, findings, policy, graph, repair, artifacts."""

from __future__ import annotations

import hashlib
import json
import os
from dataclasses import asdict, dataclass, field
from pathlib import Path

import pyspark
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import ConfigError
from ..operators import detect, graph, mapping, policy, records, repair
from ..session import settled
from ..sources import images as pictures
from ..sources import manifest
from . import report as R

COLUMN_OPTIONS = {"patient_column": "patient_id", "specimen_column": "specimen_id", "slide_column": "slide_id", "image_column": "image_path", "institution_column": "institution_id", "label_column": "class_label", "record_id_column": "source_record_id"}


def _same(a: str, b: str) -> bool:
    """One file under two names, links included."""
    try:
        return os.path.samefile(a, b)
    except OSError:  # one isn't there, or isn't a local file
        return Path(a).resolve() == Path(b).resolve()


@dataclass(frozen=True)
class Config:
    train: str
    test: str
    output: str
    images: str | None = None
    force: bool = False
    repair: bool = False
    group_by_institution: bool = False
    target_train_fraction: float | None = None
    policy_profile: str = "default"
    max_image_pairs: int = detect.MAX_PAIRS
    phash_threshold: int = detect.PHASH_LIMIT
    dhash_threshold: int = detect.DHASH_LIMIT
    image_max_pixels: int = pictures.MAX_PIXELS
    schema_map: str | None = None
    columns: dict[str, str] = field(default_factory=dict)

    def __post_init__(self):
        if _same(self.train, self.test):
            raise ConfigError("train and test are the same file")
        if any(_same(self.output, p) for p in (self.train, self.test)):
            raise ConfigError("the output is an input")
        if self.target_train_fraction is not None and not 0 < self.target_train_fraction < 1:
            raise ConfigError("target_train_fraction must be strictly between 0 and 1")
        if not (0 <= self.phash_threshold <= 64 and 0 <= self.dhash_threshold <= 64):
            raise ConfigError("hash thresholds lie between 0 and 64")
        if self.max_image_pairs <= 0 or self.image_max_pixels <= 0:
            raise ConfigError("limits must be positive")
        unknown = set(self.columns) - set(COLUMN_OPTIONS.values())
        if unknown or any(not c.strip() for c in self.columns.values()):
            raise ConfigError(f"column overrides are of known fields and not blank: {sorted(unknown)}")

    def digest(self) -> str:
        portable = lambda v: v.replace("\\", "/").rstrip("/") or "/"
        plain = {k: portable(v) if k in ("train", "test", "output", "images", "schema_map") and v else v for k, v in asdict(self).items()}
        return hashlib.sha256(json.dumps(plain, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


@dataclass(frozen=True)
class Result:
    exit_code: int
    report: dict
    paths: dict[str, str]
    findings: DataFrame
    records: DataFrame
    evidence: DataFrame


def run(spark: SparkSession, config: Config, client=None) -> Result:
    """The whole audit. Exit code 0: clean; 2: violations, with all artifacts written. Failures raise."""
    folder = R.prepare(config.output, config.force)
    sides = [manifest.read_csv(spark, p, s) for p, s in ((config.train, "train"), (config.test, "test"))]
    given = mapping.load_schema_map(config.schema_map) if config.schema_map else {}
    maps = [mapping.infer(m.rows, m.headers, config.columns, given, require_coverage=client is None) for m in sides]
    if client is not None:
        from .assist import assist

        maps = assist(sides, maps, client)
    built = [records.build(m.rows, k.columns, m.partition, m.manifest_id, m.columns) for m, k in zip(sides, maps, strict=True)]
    both = built[0].union(built[1])
    rec = settled(both.records)
    prints = pictures.fingerprints(rec, config.images, config.image_max_pixels)
    prints = settled(prints) if prints is not None else None
    found = detect.all_findings(rec, both.conflicts, prints, config.max_image_pairs, config.phash_threshold, config.dhash_threshold)
    found = detect.Findings(settled(found.findings), settled(found.members))
    graph.check(found.findings, found.members, rec)
    rules = policy.profile(config.policy_profile)
    judged = settled(policy.evaluate(found.findings, rules))
    totals = policy.summary(judged).first().asDict()
    fixed = repair.propose(rec, judged, found.members, rules, config.target_train_fraction, config.group_by_institution) if config.repair else None
    proof = settled(detect.evidence(found.members, rec, prints))
    rows = settled(R.findings_rows(judged, proof))
    warned = sorted({w for m in sides for w in m.warnings} | {r["warning"] for r in both.warnings.select("warning").distinct().collect()} | set(mapping.pair_messages(*maps)) | ({"no image root: images were not examined"} if prints is None else set()))
    by_type = {r[0]: r[1] for r in judged.groupBy("finding_type").count().collect()}
    report = {
        "schema_version": "1.0.0",
        "status": "violations" if totals["exit_code"] else "clean",
        "exit_code": totals["exit_code"],
        "inputs": [{"manifest_id": m.manifest_id, "partition": m.partition, "path": m.path, "sha256": m.sha256, "row_count": m.row_count, "encoding": m.encoding, "newline": m.newline, "headers": m.headers} for m in sides],
        "mapping": {m.partition: {f: asdict(c) for f, c in k.choices.items()} for m, k in zip(sides, maps, strict=True)},
        "summary": {k: v for k, v in totals.items() if k != "exit_code"} | metrics(rec, both.conflicts, maps, by_type, totals, fixed) | {"findings_by_type": by_type, "edges_by_type": {r[0]: r[1] for r in graph.edge_counts(found.findings).collect()}, "largest_component": graph.largest_component(found.findings, found.members)} | (pictures.collection(prints).first().asDict() if prints is not None else {}),
        "repair": None if fixed is None else {"included": fixed.included, "excluded": fixed.excluded, "metrics": fixed.metrics, "tradeoffs": fixed.tradeoffs},
        "warnings": warned,
        "assistance": "disabled" if client is None else "applied" if any(c.source == "assisted" for m in maps for c in m.choices.values()) else "enabled; nothing applied",
        "reproducibility": {"config_sha256": config.digest(), "detector_version": detect.DETECTOR_VERSION, "spark": pyspark.__version__, "thresholds": {"phash": config.phash_threshold, "dhash": config.dhash_threshold, "max_image_pairs": config.max_image_pairs}},
    }
    paths = R.artifacts(folder, report, rows, repair.rows(fixed, rec) if fixed else None)
    return Result(totals["exit_code"], report, paths, judged, rec, proof)


#: Metrics that count the findings of one type.
COUNTED = {
    "patient_overlap_findings": "confirmed_patient_overlap",
    "specimen_overlap_findings": "confirmed_specimen_overlap",
    "slide_overlap_findings": "confirmed_slide_overlap",
    "institution_warnings": "institution_overlap",
    "byte_duplicate_findings": "confirmed_byte_content_duplicate",
    "pixel_duplicate_findings": "confirmed_pixel_content_duplicate",
    "image_similarity_candidates": "image_similarity_candidate",
    "image_input_quality_findings": "image_read_error",
    "resource_limit_findings": "resource_limit_exceeded",
}


def metrics(rec: DataFrame, conflicts: DataFrame, maps: list[mapping.Mapping], by_type: dict[str, int], totals: dict, fixed: repair.Repair | None) -> dict[str, int]:
    """The counts of an audit's summary."""
    sides = {r[0]: r[1] for r in rec.groupBy("partition").count().collect()}
    return {
        "train_records": sides.get("train", 0),
        "test_records": sides.get("test", 0),
        **{name: by_type.get(kind, 0) for name, kind in COUNTED.items()},
        "policy_violations": totals["n_violation"],
        "allowed_overlaps": totals["n_allowed_overlap"],
        "review_items": totals["n_review_item"],
        "unresolved_schema_fields": sum(len(m.unresolved) for m in maps),
        "lineage_conflicts": conflicts.count(),
        "moved_records": fixed.metrics["records_moved"] if fixed else 0,
    }


def overlaps(train: DataFrame, test: DataFrame, columns: dict[str, str], rules: policy.SplitPolicy | None = None) -> DataFrame:
    """The short way over tables: judged identifier findings of two DataFrames under one column mapping."""
    sides = [manifest.from_table(df, s) for df, s in ((train, "train"), (test, "test"))]
    built = [records.build(m.rows, columns, m.partition, m.manifest_id, m.columns) for m in sides]
    both = built[0].union(built[1])
    found = detect.identifier_overlaps(both.records, both.conflicts)
    return policy.evaluate(found.findings, rules or policy.profile()).orderBy(F.col("finding_id"))


def summary_lines(result: Result) -> list[str]:
    """What the terminal shows."""
    s, report = result.report["summary"], result.report
    shown = {
        "Train records": s["train_records"],
        "Test records": s["test_records"],
        "Patient overlaps": s["patient_overlap_findings"],
        "Specimen overlaps": s["specimen_overlap_findings"],
        "Slide overlaps": s["slide_overlap_findings"],
        "Byte duplicates": s["byte_duplicate_findings"],
        "Pixel duplicates": s["pixel_duplicate_findings"],
        "Similarity candidates": s["image_similarity_candidates"],
        "Institution warnings": s["institution_warnings"],
        "Image input issues": s["image_input_quality_findings"],
        "Policy violations": s["policy_violations"],
        "Review items": s["review_items"],
        "Repair proposal": "generated" if report["repair"] else "not requested",
        "Schema assistance": report["assistance"],
        "Output": Path(result.paths["report_json"]).parent,
        "Artifacts": ", ".join(Path(p).name for p in result.paths.values()),
        "Status": "POLICY VIOLATIONS" if result.exit_code else "PASSED",
    }
    return ["Split audit complete", *(f"{k}: {v}" for k, v in shown.items())]
