"""Study barcodes: participant, sample, portion and plate forms, parsed strictly."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import WHITE

PARSER_VERSION = "barcode-columns-1"
# The barcode's form and its parts in order.
PATTERN = r"\ATCGA-([A-Z0-9]{2})-([A-Z0-9]{4})(?:-([0-9]{2})([A-Z]))?(?:-([0-9]{2})([A-Z]))?(?:-([A-Z0-9]{4})-([A-Z0-9]{2}))?\z"
PARTS = ("tissue_source_site", "participant", "sample", "vial", "portion", "analyte", "plate", "center")


def cleaned(c: Column) -> Column:
    return F.upper(F.btrim(c, F.lit(WHITE)))


def malformed(c: Column) -> Column:
    """True where a value contains the project's name but is no whole barcode, or has a plate without a portion."""
    u = cleaned(c)
    part = lambda k: F.regexp_extract(u, PATTERN, k)
    return F.coalesce(u.contains("TCGA") & (~u.rlike(PATTERN) | ((part(7) != "") & (part(5) == ""))), F.lit(False))


def parsed(c: Column) -> Column:
    """A struct of the barcode's parts and what derives from them; null for other values."""
    u = cleaned(c)
    parts = {name: F.nullif(F.regexp_extract(u, PATTERN, k), F.lit("")) for k, name in enumerate(PARTS, 1)}
    patient = F.concat_ws("-", F.lit("TCGA"), parts["tissue_source_site"], parts["participant"])
    specimen = F.when(parts["sample"].isNotNull(), F.concat(patient, F.lit("-"), parts["sample"], parts["vial"]))
    made = F.struct(u.alias("raw_identifier"), *(v.alias(k) for k, v in parts.items()), patient.alias("derived_patient_id"), specimen.alias("derived_specimen_id"))
    return F.when(u.rlike(PATTERN), made)
