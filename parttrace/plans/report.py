"""Artifacts of an audit: report.json, report.html, findings.csv and repair_proposal.csv."""

from __future__ import annotations

import csv
import html
import json
import os
import tempfile
from collections.abc import Iterable, Iterator
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import ReportError
from ..operators.detect import DETECTORS

# The artifacts and the columns of the CSV files.
NAMES = ("report.json", "report.html", "findings.csv", "repair_proposal.csv")
FINDING_COLUMNS = ("finding_id", "finding_type", "confirmation_level", "policy_outcome", "policy_rule", "policy_reason", "policy_profile", "repair_eligible", "partitions", "record_ids", "detector_name", "detector_version", "parser_version", "matched_field", "matched_value", "evidence_count", "metrics_json", "created_at")
REPAIR_COLUMNS = ("record_id", "source_manifest_id", "source_row_number", "original_partition", "proposed_partition", "component_id", "moved", "label", "confirming_finding_ids", "proposal_statement")


def prepare(folder: str, force: bool = False) -> Path:
    """The output folder; what an earlier audit wrote goes only with ``force``, anything else stays."""
    path = Path(folder)
    if path.exists() and not path.is_dir():
        raise ReportError(f"output path is a file: {folder}")
    if path.exists() and any(path.iterdir()):
        if not force:
            raise ReportError(f"output folder isn't empty: {folder}")
        for name in NAMES:
            (path / name).unlink(missing_ok=True)
    path.mkdir(parents=True, exist_ok=True)
    return path


def write(path: Path, text: Iterable[str]) -> Path:
    """Whole or not at all: a file beside it takes its place at once. The text's pieces are written as they come."""
    handle, name = tempfile.mkstemp(dir=path.parent, prefix=f".{path.name}.")
    try:
        with os.fdopen(handle, "w", encoding="utf-8", newline="") as f:
            f.writelines([text] if isinstance(text, str) else text)
        os.replace(name, path)
    except OSError as e:
        Path(name).unlink(missing_ok=True)
        raise ReportError(f"can't write {path}") from e
    return path


def findings_rows(evaluated: DataFrame, evidence: DataFrame) -> DataFrame:
    """One row per finding with its records joined by ;. For reports: a group's ids meet in one row here.

    ``evidence``: rows of a finding and a record. Where its rows name several fields or values, that cell is empty.
    """
    cell = lambda c: F.coalesce(F.when(F.min(c).eqNullSafe(F.max(c)), F.min(c)), F.lit(""))
    parser = F.max("parser_version") if "parser_version" in evidence.columns else F.lit(None).cast("string")
    about = evidence.groupBy("finding_id").agg(
        F.concat_ws(";", F.array_sort(F.collect_set("record_id"))).alias("record_ids"), F.count(F.lit(1)).alias("evidence_count"), F.coalesce(parser, F.lit("")).alias("parser_version"),
        cell(F.coalesce("matched_field", F.lit(""))).alias("matched_field"), cell(F.coalesce("matched_value", F.lit(""))).alias("matched_value"),
    )
    sides = F.concat_ws(";", F.when(F.col("n_test") > 0, "test"), F.when(F.col("n_train") > 0, "train"))
    names = F.create_map(*(F.lit(x) for kv in DETECTORS.items() for x in kv))
    metrics = F.to_json(F.map_from_entries(F.array_sort(F.map_entries("metrics"))))
    made = {"partitions": sides, "metrics_json": metrics, "detector_name": F.coalesce(F.try_element_at(names, F.col("finding_type")), F.lit("")), "created_at": F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ssXXX")}
    return evaluated.drop("matched_field", "matched_value").join(about, "finding_id").withColumns(made).select(*FINDING_COLUMNS)


def _cell(v) -> str:
    return "" if v is None else str(v).lower() if isinstance(v, bool) else str(v)


def _csv(rows: DataFrame, order: str) -> Iterator[str]:
    """A CSV file's lines; the driver holds one partition at a time."""

    class Line:
        def write(self, text: str) -> str:
            return text

    line = csv.writer(Line(), lineterminator="\n")  # type: ignore[arg-type]
    yield line.writerow(rows.columns)  # type: ignore[misc]
    for r in rows.orderBy(order).toLocalIterator():
        yield line.writerow([_cell(v) for v in r])  # type: ignore[misc]


def _json(report: dict, findings: Iterable[dict]) -> Iterator[str]:
    """The report as one object with sorted keys, whose findings are written as they come."""
    mark = "\0findings\0"
    head, tail = json.dumps(report | {"findings": mark}, indent=2, sort_keys=True, ensure_ascii=False).split(json.dumps(mark))
    yield f"{head}["
    between = "\n"
    for f in findings:
        yield between + "    " + json.dumps(f, indent=2, sort_keys=True, ensure_ascii=False).replace("\n", "\n    ")
        between = ",\n"
    yield ("\n  ]" if between != "\n" else "]") + tail + "\n"


_PAGE = """<!DOCTYPE html><html lang="en"><head><meta charset="utf-8"><title>Split audit</title><style>body{{font-family:sans-serif;margin:2em}}table{{border-collapse:collapse}}td,th{{border:1px solid #bbb;padding:.3em .6em;text-align:left}}</style></head>
<body><h1>Split audit</h1><p>Status: {status}. Exit code {code}.</p><h2>Summary</h2><table>{summary}</table><h2>Findings</h2><input id="q" placeholder="filter" oninput="for(const r of document.querySelectorAll('#f tr.r'))r.hidden=!r.textContent.toLowerCase().includes(this.value.toLowerCase())">
<table id="f"><tr>{heads}</tr>{rows}</table></body></html>
"""


def page(report: dict, findings: Iterable[dict] = ()) -> Iterator[str]:
    """A self-contained page; every value is escaped."""
    e = lambda v: html.escape(_cell(v))
    shown = ("finding_type", "confirmation_level", "policy_outcome", "matched_field", "matched_value", "evidence_count", "record_ids")
    summary = "".join(f"<tr><td>{e(k)}</td><td>{e(v)}</td></tr>" for k, v in report["summary"].items())
    head, tail = _PAGE.format(status=e(report["status"]), code=e(report["exit_code"]), summary=summary, heads="".join(f"<th>{e(c)}</th>" for c in shown), rows="\0").split("\0")
    yield head
    for f in findings:
        yield "<tr class=r>" + "".join(f"<td>{e(f[c])}</td>" for c in shown) + "</tr>"
    yield tail


def artifacts(folder: Path, report: dict, findings: DataFrame, repair: DataFrame | None) -> dict[str, str]:
    """The files of an audit. Findings are read anew for each, a partition at a time: the driver never holds them all."""
    ordered = lambda: (r.asDict() for r in findings.orderBy("finding_id").toLocalIterator())
    out = {
        "report_json": write(folder / "report.json", _json(report, ordered())),
        "report_html": write(folder / "report.html", page(report, ordered())),
        "findings_csv": write(folder / "findings.csv", _csv(findings, "finding_id")),
    }
    if repair is not None:
        out["repair_csv"] = write(folder / "repair_proposal.csv", _csv(repair.select(*REPAIR_COLUMNS), "record_id"))
    return {k: str(v) for k, v in out.items()}
