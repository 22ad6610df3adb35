"""Manifests: strictly read CSV files, or any table that Spark reads."""

from __future__ import annotations

import csv
import hashlib
import io
import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ..errors import ManifestError
from ..functions.text import plain_header


@dataclass(frozen=True)
class Manifest:
    """Rows (source_row_number, raw: a struct of one text per header), and what is known of the file."""

    manifest_id: str
    partition: str
    path: str
    rows: DataFrame
    headers: list[str]
    sha256: str | None = None
    row_count: int | None = None
    encoding: str | None = None
    newline: str | None = None
    warnings: tuple[str, ...] = ()

    @property
    def columns(self) -> dict[str, str]:
        return {h: plain_header(h) for h in self.headers}


def newline_style(text: str) -> str:
    kinds = {m for m in re.findall(r"\r\n|\r|\n", text)}
    names = {"\r\n": "crlf", "\n": "lf", "\r": "cr"}
    return names[kinds.pop()] if len(kinds) == 1 else "mixed" if kinds else "none"


def check_headers(headers: list[str]) -> dict[str, str]:
    """Headers and their normal forms; blank, repeated or colliding ones are refused."""
    if not headers:
        raise ManifestError("manifest has no headers")
    if any(not h.strip() for h in headers):
        raise ManifestError("a header is blank")
    if len(set(headers)) != len(headers):
        raise ManifestError("a header is repeated")
    normal: dict[str, str] = {}
    for h in headers:
        first = normal.setdefault(plain_header(h), h)
        if first != h:
            raise ManifestError(f"headers {first!r} and {h!r} have one normal form")
    return {h: plain_header(h) for h in headers}


def parse(content: bytes) -> tuple[list[str], list[list[str | None]], list[str], str, str]:
    """(headers, rows, warnings, encoding, newline style) of a CSV file's bytes. Blank lines are rows without values."""
    try:
        encoding = "utf-8-sig" if content.startswith(b"\xef\xbb\xbf") else "utf-8"
        text = content.decode(encoding)
    except UnicodeDecodeError as e:
        raise ManifestError("manifest isn't UTF-8") from e
    try:
        lines = list(csv.reader(io.StringIO(text, newline=""), strict=True))
    except csv.Error as e:
        raise ManifestError(f"malformed CSV: {e}") from e
    headers = lines[0] if lines else []
    check_headers(headers)
    rows, warnings = [], []
    for k, cells in enumerate(lines[1:]):
        if len(cells) > len(headers):
            raise ManifestError(f"row {k} has more cells than headers")
        if len(cells) < len(headers):
            warnings.append(f"row {k} has fewer cells than headers")
        rows.append([*cells, *[None] * (len(headers) - len(cells))])
    if not rows:
        raise ManifestError("manifest has no rows")
    return headers, rows, warnings, encoding, newline_style(text)


def read_csv(spark: SparkSession, path: str, partition: str, manifest_id: str | None = None) -> Manifest:
    """One manifest file. It is parsed whole in one task, as quoted cells may hold line breaks; only its head reaches the driver."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    store = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not store.exists(at):
        raise ManifestError(f"manifest doesn't exist: {path}")
    if not store.getFileStatus(at).isFile():
        raise ManifestError(f"manifest isn't a file: {path}")
    files = spark.read.format("binaryFile").load(path)

    def head(batches):
        import pyarrow as pa

        for batch in batches:
            for content in batch.column(0).to_pylist():
                try:
                    headers, rows, warnings, encoding, newline = parse(content)
                    row = {"headers": [headers], "n": [len(rows)], "warnings": [warnings], "encoding": [encoding], "newline": [newline], "sha256": [hashlib.sha256(content).hexdigest()], "error": [None]}
                except ManifestError as e:
                    row = {"headers": [[]], "n": [0], "warnings": [[]], "encoding": [""], "newline": [""], "sha256": [""], "error": [str(e)]}
                yield pa.RecordBatch.from_pydict(row, pa.schema([("headers", pa.list_(pa.string())), ("n", pa.int64()), ("warnings", pa.list_(pa.string())), ("encoding", pa.string()), ("newline", pa.string()), ("sha256", pa.string()), ("error", pa.string())]))

    about = files.select("content").mapInArrow(head, "headers array<string>, n long, warnings array<string>, encoding string, newline string, sha256 string, error string").first()
    if about["error"]:
        raise ManifestError(f"{path}: {about['error']}")
    headers = list(about["headers"])

    def cells(batches):
        import pyarrow as pa

        for batch in batches:
            for content in batch.column(0).to_pylist():
                rows = parse(content)[1]
                for k in range(0, len(rows), 10_000):
                    part = rows[k : k + 10_000]
                    raw = pa.StructArray.from_arrays([pa.array([r[c] for r in part], pa.string()) for c in range(len(headers))], headers)
                    yield pa.RecordBatch.from_arrays([pa.array(range(k, k + len(part)), pa.int64()), raw], ["source_row_number", "raw"])

    raw = StructType([StructField(h, StringType()) for h in headers])
    schema = StructType([StructField("source_row_number", LongType()), StructField("raw", raw)])
    rows = files.select("content").mapInArrow(cells, schema)
    return Manifest(manifest_id or f"manifest_{partition}", partition, path, rows, headers, about["sha256"], about["n"], about["encoding"], about["newline"], tuple(about["warnings"]))


def from_table(df: DataFrame, partition: str, manifest_id: str | None = None, row_number: str | None = None) -> Manifest:
    """A table as manifest: all columns as text; rows numbered by a column of theirs, or by their digest's order."""
    headers = [c for c in df.columns if c != row_number]
    check_headers(headers)
    number = F.col(f"`{row_number}`").cast("long") if row_number else F.pmod(F.xxhash64(*(f"`{h}`" for h in headers)), F.lit(1 << 62))
    rows = df.select(number.alias("source_row_number"), F.struct(*(F.col(f"`{h}`").cast("string").alias(h) for h in headers)).alias("raw"))
    return Manifest(manifest_id or f"manifest_{partition}", partition, "", rows, headers)
