"""Command line: ``python -m parttrace audit --train A.csv --test B.csv --output DIR``. Exit codes 0, 2 and 1 (failure)."""

from __future__ import annotations

import argparse
import html
import json
import os
import sys
from pathlib import Path

from pyspark.errors import PySparkException

from .errors import AuditError
from .plans.audit import COLUMN_OPTIONS, Config, run, summary_lines
from .session import session

TRUE, FALSE = ("true", "1", "yes", "on"), ("false", "0", "no", "off", "")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="parttrace")
    p.add_argument("--version", action="version", version="parttrace 0.1")
    sub = p.add_subparsers(dest="command", required=True)
    a = sub.add_parser("audit", help="audit a train and a test manifest")
    for name in ("train", "test", "output"):
        a.add_argument(f"--{name}", required=True)
    a.add_argument("--images")
    a.add_argument("--schema-map")
    a.add_argument("--policy-profile", default="default")
    for name in ("force", "repair", "group-by-institution"):
        a.add_argument(f"--{name}", action="store_true")
    a.add_argument("--target-train-fraction", type=float)
    for name, default in (("max-image-pairs", Config.max_image_pairs), ("phash-threshold", Config.phash_threshold), ("dhash-threshold", Config.dhash_threshold), ("image-max-pixels", Config.image_max_pixels)):
        a.add_argument(f"--{name}", type=int, default=default)
    for name in COLUMN_OPTIONS:
        a.add_argument(f"--{name.replace('_', '-')}")
    c = sub.add_parser("ci", help="audit with options from INPUT_* variables; writes outputs for the step")
    c.add_argument("--input-json", help="a JSON object of inputs in place of the variables")
    return p


def config_of(options: dict) -> Config:
    columns = {f: options.pop(o).strip() for o, f in COLUMN_OPTIONS.items() if options.get(o)}
    known = {k: v for k, v in options.items() if k in Config.__dataclass_fields__ and v is not None}
    return Config(**known, columns=columns)


def ci_options(env: dict[str, str]) -> tuple[dict, bool]:
    """(options, whether violations fail the step) from INPUT_* variables."""
    given = {k[6:].lower().replace("-", "_"): v.strip() for k, v in env.items() if k.startswith("INPUT_") and v.strip()}

    def flag(name: str, default: bool = False) -> bool:
        v = given.pop(name, str(default)).lower()
        if v not in TRUE + FALSE:
            raise AuditError(f"{name} must be true or false")
        return v in TRUE

    fail = flag("fail_on_violations", True)
    options: dict = {name: flag(name) for name in ("force", "repair", "group_by_institution")}
    for name in ("max_image_pairs", "phash_threshold", "dhash_threshold", "image_max_pixels"):
        if name in given:
            if not given[name].isdigit():
                raise AuditError(f"{name} must be a whole number")
            options[name] = int(given.pop(name))
    if "target_train_fraction" in given:
        options["target_train_fraction"] = float(given.pop("target_train_fraction"))
    options |= {k: v for k, v in given.items() if k in Config.__dataclass_fields__ or k in COLUMN_OPTIONS}
    missing = [k for k in ("train", "test", "output") if k not in options]
    if missing:
        raise AuditError(f"inputs are missing: {missing}")
    return options, fail


def ci_inputs(path: str) -> dict[str, str]:
    """The inputs of a JSON file, as the variables would give them."""
    try:
        with open(path, encoding="utf-8") as f:
            given = json.load(f)
    except (OSError, ValueError) as e:
        raise AuditError(f"inputs can't be read: {path}") from e
    if not isinstance(given, dict) or not all(isinstance(v, str) for v in given.values()):
        raise AuditError("inputs are an object of texts")
    return {f"INPUT_{k.upper()}": v for k, v in given.items()}


def _escaped(value) -> str:
    """A table cell that holds no markup of its own."""
    text = html.escape(str(value), quote=True)
    for sign in "`|\\[]*_":
        text = text.replace(sign, f"&#{ord(sign)};")
    return " ".join(text.split())


def step_output(name: str, value) -> str:
    if "\n" in str(value) or "\r" in str(value):
        raise AuditError(f"output {name} has more than one line")
    return f"{name}={value}\n"


def ci(env: dict[str, str], input_json: str | None = None) -> int:
    options, fail = ci_options(ci_inputs(input_json) if input_json else env)
    result = run(session(), config_of(options))
    paths = {"repair-proposal-csv": ""} | {{"repair_csv": "repair-proposal-csv"}.get(k, k.replace("_", "-")): str(Path(v).resolve()) for k, v in result.paths.items()}
    if not all(Path(p).is_file() for p in paths.values() if p):
        raise AuditError("an artifact is missing")
    said = {"status": "violations" if result.exit_code else "passed", "exit-code": result.exit_code, "violation-count": result.report["summary"]["policy_violations"], "review-count": result.report["summary"]["review_items"]} | paths
    if env.get("GITHUB_OUTPUT"):
        with open(env["GITHUB_OUTPUT"], "a", encoding="utf-8") as f:
            f.writelines(step_output(k, v) for k, v in said.items())
    if env.get("GITHUB_STEP_SUMMARY"):
        shown = {"train": options["train"], "test": options["test"]} | said
        with open(env["GITHUB_STEP_SUMMARY"], "a", encoding="utf-8") as f:
            f.write("## Split audit\n\n| | |\n|-|-|\n" + "".join(f"| {_escaped(k)} | {_escaped(v)} |\n" for k, v in shown.items()) + "\nSimilar images need a person's judgement. A repair is a proposal and is never applied.\n")
    return 0 if result.exit_code == 2 and not fail else result.exit_code


def main(argv: list[str] | None = None) -> int:
    options = vars(parser().parse_args(argv))
    try:
        if options.pop("command") == "ci":
            return ci(dict(os.environ), options["input_json"])
        result = run(session(), config_of(options))
    except (AuditError, ValueError, PySparkException) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    print("\n".join(summary_lines(result)))
    return result.exit_code
