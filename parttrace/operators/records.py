"""Canonical records: meanings projected from columns, ids, barcode lineage and its reconciliation."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..errors import RecordError
from ..functions import barcode
from ..functions import text as T
from ..session import numbered

ID_FIELDS = ("patient_id", "specimen_id", "slide_id", "institution_id", "source_record_id")
FIELDS = ("image_path", "patient_id", "specimen_id", "slide_id", "institution_id", "class_label", "partition", "source_record_id")
BARCODE_FIELDS = ("patient_id", "specimen_id", "slide_id", "source_record_id")


@dataclass(frozen=True)
class Records:
    """records, provenance (one row per record, field and source), conflicts and warnings of one side."""

    records: DataFrame
    provenance: DataFrame
    conflicts: DataFrame
    warnings: DataFrame

    def union(self, other: Records) -> Records:
        return Records(*(getattr(self, f).unionByName(getattr(other, f)) for f in ("records", "provenance", "conflicts", "warnings")))


def _refuse(df: DataFrame, condition: Column, message: Column) -> DataFrame:
    """Rows pass unless the condition holds for one: then the run fails with the message."""
    return df.where(F.when(condition, F.raise_error(message).cast("boolean")).otherwise(F.lit(True)))


def packed(rows: DataFrame) -> DataFrame:
    """Rows (source_row_number, raw), the raw columns in one struct, so that no header clashes with a column of ours."""
    if "raw" in rows.columns and isinstance(rows.schema["raw"].dataType, StructType):
        return rows
    return rows.select("source_row_number", F.struct(*(F.col(f"`{c}`") for c in rows.columns if c != "source_row_number")).alias("raw"))


def flat(rows: DataFrame) -> DataFrame:
    """The raw columns alone."""
    return packed(rows).select("raw.*") if "source_row_number" in rows.columns else rows


def cell(column: str) -> Column:
    return F.col("raw").getField(column).cast("string")


def semantic(rows: DataFrame, mapping: dict[str, str], unicode: bool = True) -> DataFrame:
    """Columns of meanings beside the raw ones; those without a column are null."""
    missing = sorted({c for c in mapping.values() if c not in rows.schema["raw"].dataType.names})
    if missing:
        raise RecordError(f"mapped columns are not there: {missing}")
    made = {}
    for f in FIELDS:
        raw = cell(mapping[f]) if mapping.get(f) else F.lit(None).cast("string")
        made[f"s_{f}"] = (T.identifier if f in ID_FIELDS else T.value)(raw, unicode) if mapping.get(f) else raw
    return rows.withColumns(made)


def row_fingerprint(columns: dict[str, str], unicode: bool = True) -> Column:
    """Digest of a row's values under their normal headers."""
    return T.digest(T.json_object({"normalized_header_values": T.json_object({h: T.json_text(cell(c), unicode) for c, h in columns.items()})}))


def with_record_ids(rows: DataFrame, manifest_id: str, by_source: bool, columns: dict[str, str], unicode: bool = True) -> DataFrame:
    """record_id and its method; repeated rows without a source id are numbered in row order.

    Ids carry the manifest's name, so equal rows of both sides stay apart.
    """
    if by_source:
        bad = rows.where("s_source_record_id is null").limit(1).count()
        if bad:
            raise RecordError(f"source_record_id is missing in manifest {manifest_id}")
        twice = rows.groupBy("s_source_record_id").count().where("count > 1").limit(1).collect()
        if twice:
            raise RecordError(f"duplicate source_record_id in manifest {manifest_id}: {twice[0][0]}")
        rid = F.concat(F.lit(f"rec_src_{manifest_id}_"), F.substring(T.digest(T.json_text(F.col("s_source_record_id"), unicode)), 1, 16))
        return rows.withColumns({"record_id": rid, "record_id_method": F.lit("source_column")})
    based = rows.withColumn("_base", row_fingerprint(columns, unicode))
    based = numbered(based, "_base", "source_row_number", name="_n")
    groups = based.groupBy("_base").agg(F.min("_n").alias("_first"), F.count(F.lit(1)).alias("_copies"))
    based = based.join(groups, "_base")
    stem = F.concat(F.lit(f"rec_{manifest_id}_"), F.substring("_base", 1, 24))
    many = F.col("_copies") > 1
    rid = F.when(many, F.concat(stem, F.lit("_dup"), F.lpad((F.col("_n") - F.col("_first") + 1).cast("string"), 4, "0"))).otherwise(stem)
    method = F.when(many, F.lit("row_fingerprint_with_ordinal")).otherwise(F.lit("row_fingerprint"))
    return based.withColumns({"record_id": rid, "record_id_method": method}).drop("_base", "_n", "_first", "_copies")


def lineage(rows: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """The first barcode among the mapped id columns; a malformed one fails the run."""
    used = [f for f in BARCODE_FIELDS if mapping.get(f)]
    if not used:
        return rows.withColumn("lineage", barcode.parsed(F.lit(None).cast("string")))
    raw = [cell(mapping[f]) for f in used]
    # only what stands before the first good one is looked at
    bad, found = F.lit(False), F.lit(False)
    for c in raw:
        bad = bad | (~found & barcode.malformed(c))
        found = found | barcode.parsed(c).isNotNull()
    checked = _refuse(rows, bad, F.concat(F.lit("malformed barcode in source row "), F.col("source_row_number").cast("string")))
    return checked.withColumn("lineage", F.coalesce(*map(barcode.parsed, raw)))


def build(rows: DataFrame, mapping: dict[str, str], partition: str, manifest_id: str, columns: dict[str, str] | None = None, unicode: bool = True) -> Records:
    """Records of one side from a table with source_row_number and raw columns, or with those in a struct ``raw``.

    ``columns``: the manifest's headers and their normal forms. A value that disagrees with the one its barcode gives
    stays on the record, and both are marked conflicted.
    """
    rows = packed(rows)
    columns = columns or {c: T.plain_header(c) for c in rows.schema["raw"].dataType.names}
    rows = lineage(semantic(rows, mapping, unicode), mapping)
    rows = with_record_ids(rows, manifest_id, bool(mapping.get("source_record_id")), columns, unicode)
    derived = {"patient_id": T.identifier(F.col("lineage.derived_patient_id"), False), "specimen_id": T.identifier(F.col("lineage.derived_specimen_id"), False)}
    own = rows.withColumns({f"d_{f}": derived.get(f, F.lit(None).cast("string")) for f in ID_FIELDS})
    values = {f: F.coalesce(f"s_{f}", f"d_{f}") for f in ID_FIELDS}
    raw_digest = T.digest(T.json_object({"raw_values": T.json_object({c: T.json_text(cell(c), unicode) for c in columns})}))
    normal = T.digest(T.json_object({"semantic_values": T.json_object({f: T.json_text(F.col(f"s_{f}"), unicode) for f in FIELDS}), "lineage": T.json_text(F.col("lineage.raw_identifier"), unicode)}))
    records = own.select(
        "record_id", "record_id_method", F.lit(manifest_id).alias("manifest_id"), "source_row_number", F.lit(partition).alias("partition"),
        *(v.alias(f) for f, v in values.items()), F.col("s_image_path").alias("image_path"), F.col("s_class_label").alias("label"), "lineage",
        raw_digest.alias("raw_values_digest"), normal.alias("normalized_values_digest"),
    )
    claims = F.array(*(F.struct(F.lit(f).alias("semantic_field"), F.col(f"s_{f}").alias("direct"), F.col(f"d_{f}").alias("derived"), F.lit(mapping.get(f)).cast("string").alias("source_column")) for f in ID_FIELDS))
    claim = own.select("record_id", F.explode(claims).alias("c")).select("record_id", "c.*")
    differ = F.col("direct").isNotNull() & F.col("derived").isNotNull() & (F.col("direct") != F.col("derived"))
    entry = lambda v, column, method, status, confidence: F.struct(v.alias("value"), column.alias("source_column"), F.lit(method).alias("derivation_method"), status.alias("status"), F.lit(confidence).alias("confidence"))
    status = F.when(differ, F.lit("conflicted")).otherwise(F.lit("accepted"))
    none = F.lit(None).cast("string")
    direct, from_code = entry(F.col("direct"), F.col("source_column"), "direct_manifest_value", status, 1.0), entry(F.col("derived"), none, "barcode_derived", status, 1.0)
    nothing = entry(none, F.col("source_column"), "unavailable", F.lit("unresolved"), 0.0)
    entries = F.when(F.coalesce("direct", "derived").isNull(), F.array(nothing)).otherwise(F.filter(F.array(direct, from_code), lambda e: e["value"].isNotNull()))
    provenance = claim.select("record_id", "semantic_field", F.explode(entries).alias("e")).select("record_id", "semantic_field", "e.*")
    payload = T.json_object({"record_id": T.json_text(F.col("record_id"), False), "semantic_field": T.json_text(F.col("semantic_field"), False), "direct_value": T.json_text(F.col("direct"), unicode), "derived_value": T.json_text(F.col("derived"), False), "parser_version": F.lit(f'"{barcode.PARSER_VERSION}"')})
    conflicts = claim.where(differ).select(F.concat(F.lit("linconf_"), F.substring(T.digest(payload), 1, 24)).alias("conflict_id"), "record_id", "semantic_field", F.col("direct").alias("direct_value"), F.col("derived").alias("derived_value"), "source_column")
    return Records(records, provenance, conflicts, partition_warnings(own, mapping, partition, manifest_id, unicode))


def partition_warnings(rows: DataFrame, mapping: dict[str, str], partition: str, manifest_id: str, unicode: bool = True) -> DataFrame:
    """Rows whose partition column disagrees with their side; the side never changes."""
    if not mapping.get("partition"):
        return rows.select("source_row_number", F.lit("").alias("warning")).limit(0)
    raw = cell(mapping["partition"])
    side = T.split_side(raw, unicode)
    detail = F.when(side.isNull(), F.lit("unsupported two-partition value")).otherwise(F.concat(F.lit("value indicates "), side))
    said = F.concat(F.lit(f"manifest {manifest_id} row "), F.col("source_row_number").cast("string"), F.lit(f" partition column conflicts with assigned {partition}: "), detail)
    return rows.where(T.identifier(raw, unicode).isNotNull() & ~side.eqNullSafe(F.lit(partition))).select("source_row_number", said.alias("warning"))
