"""Factual findings that cross the split.

A finding is a group of records: identifier overlaps, byte and pixel duplicates, similar pairs, unreadable images and
the pair limit. Groups are kept as one row each (``findings``) beside their members (``members``), so that a group as
large as an institution never sits in one row. Ids are digests that partial aggregation can merge.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import ConfigError
from ..functions import text as T
from ..functions.barcode import PARSER_VERSION

DETECTOR_VERSION = "parttrace-detectors-1"
#: Which detector finds each type.
DETECTORS = {
    "confirmed_patient_overlap": "identifier_overlap",
    "confirmed_specimen_overlap": "identifier_overlap",
    "confirmed_slide_overlap": "identifier_overlap",
    "institution_overlap": "identifier_overlap",
    "confirmed_byte_content_duplicate": "byte_duplicate",
    "confirmed_pixel_content_duplicate": "pixel_duplicate",
    "image_similarity_candidate": "image_similarity",
    "image_read_error": "input_quality",
    "resource_limit_exceeded": "resource_limit",
}
IDENTIFIER_FINDINGS = {
    "patient_id": ("confirmed_patient_overlap", "confirmed"),
    "specimen_id": ("confirmed_specimen_overlap", "confirmed"),
    "slide_id": ("confirmed_slide_overlap", "confirmed"),
    "institution_id": ("institution_overlap", "warning"),
}
MAX_PAIRS, PHASH_LIMIT, DHASH_LIMIT = 100_000, 8, 12
#: Beyond this threshold bands are so short that all images share some.
LONGEST_BANDED = 16


@dataclass(frozen=True)
class Findings:
    findings: DataFrame
    members: DataFrame

    def union(self, *others: Findings) -> Findings:
        return Findings(*(reduce(DataFrame.unionByName, [getattr(x, f) for x in (self, *others)]) for f in ("findings", "members")))


def finding_id(kind: Column, key: Column) -> Column:
    """From type, what the members share, how many they are and two commutative sums over them."""
    sums = F.concat_ws(",", F.col("n_records").cast("string"), F.hex("x"), F.col("s").cast("string"))
    return F.concat(F.lit("finding_"), kind, F.lit("_"), F.substring(T.digest(F.concat_ws("\x1f", kind, key, sums, F.lit(DETECTOR_VERSION))), 1, 16))


def _grouped(member: DataFrame, *keys: str, having: Column | None = None, extra: dict[str, Column] | None = None) -> DataFrame:
    h = F.xxhash64("record_id")
    aggregates = {
        "n_records": F.count(F.lit(1)),
        "n_train": F.count_if(F.col("partition") == "train"),
        "n_test": F.count_if(F.col("partition") == "test"),
        "first_record_id": F.min("record_id"),
        "x": F.bit_xor(h),
        "s": F.sum(h.cast("decimal(38,0)")),
        **(extra or {}),
    }
    out = member.groupBy(*keys).agg(*(c.alias(n) for n, c in aggregates.items())).where("n_train > 0 AND n_test > 0")
    return out if having is None else out.where(having)


def accepted_identifiers(records: DataFrame, conflicts: DataFrame | None = None, fields=tuple(IDENTIFIER_FINDINGS)) -> DataFrame:
    """(semantic_field, value, record_id, partition): values that aren't null and that no conflict marks for that field."""
    entries = F.array(*(F.struct(F.lit(f).alias("semantic_field"), F.col(f).alias("value")) for f in fields))
    long = records.select("record_id", "partition", F.explode(entries).alias("e")).select("record_id", "partition", "e.*").where("value is not null")
    return long if conflicts is None else long.join(conflicts.select("record_id", "semantic_field"), ["record_id", "semantic_field"], "left_anti")


def identifier_overlaps(records: DataFrame, conflicts: DataFrame | None = None, fields=tuple(IDENTIFIER_FINDINGS)) -> Findings:
    """One finding per identifier value with records on both sides."""
    long = accepted_identifiers(records, conflicts, fields)
    groups = _grouped(long, "semantic_field", "value")
    kind = reduce(lambda c, f: c.when(F.col("semantic_field") == f, IDENTIFIER_FINDINGS[f][0]), IDENTIFIER_FINDINGS, F)
    level = F.when(F.col("semantic_field") == "institution_id", "warning").otherwise("confirmed")
    found = groups.withColumns({"finding_type": kind, "confirmation_level": level})
    found = found.withColumn("finding_id", finding_id(F.col("finding_type"), F.col("value")))
    members = long.join(found.select("semantic_field", "value", "finding_id"), ["semantic_field", "value"])
    members = members.select("finding_id", "record_id", F.col("semantic_field").alias("matched_field"), F.col("value").alias("matched_value"))
    return Findings(_shape(found, F.col("semantic_field"), F.col("value")), members)


def _shape(found: DataFrame, field: Column, value: Column, metrics: Column | None = None) -> DataFrame:
    return found.select(
        "finding_id", "finding_type", "confirmation_level", field.alias("matched_field"), value.alias("matched_value"), "n_records", "n_train", "n_test", "first_record_id",
        (F.create_map(F.lit("matched_value"), value) if metrics is None else metrics).alias("metrics"), F.lit(DETECTOR_VERSION).alias("detector_version"), F.current_timestamp().alias("created_at"),
    )


def _content(resolved: DataFrame, column: str, kind: str, having: Column | None = None, extra: dict[str, Column] | None = None) -> Findings:
    groups = _grouped(resolved.where(F.col(column).isNotNull()), column, having=having, extra=extra)
    found = groups.withColumns({"finding_type": F.lit(kind), "confirmation_level": F.lit("confirmed")})
    found = found.withColumn("finding_id", finding_id(F.col("finding_type"), F.col(column)))
    members = resolved.join(found.select(column, "finding_id"), column).select("finding_id", "record_id", F.lit(column).alias("matched_field"), F.col(column).alias("matched_value"))
    return Findings(_shape(found, F.lit(column), F.col(column)), members)


def byte_duplicates(resolved: DataFrame) -> Findings:
    """Equal bytes on both sides."""
    return _content(resolved, "byte_sha256", "confirmed_byte_content_duplicate")


def pixel_duplicates(resolved: DataFrame) -> Findings:
    """Equal decoded content on both sides from more than one form of bytes.

    Exact without a distinct: a group's least and greatest byte digest differ.
    """
    return _content(resolved, "pixel_sha256", "confirmed_pixel_content_duplicate", F.col("lo") != F.col("hi"), {"lo": F.min("byte_sha256"), "hi": F.max("byte_sha256")})


def pair_counts(fingerprints: DataFrame, max_pairs: int = MAX_PAIRS) -> DataFrame:
    """One row: resolved images of each side, the pairs that comparing needs, and whether that is over the limit."""
    ok = F.col("status") == "resolved"
    sides = fingerprints.agg(F.count_if(ok & (F.col("partition") == "train")).alias("n_train"), F.count_if(ok & (F.col("partition") == "test")).alias("n_test"))
    return sides.withColumn("pairs", F.col("n_train") * F.col("n_test")).withColumn("limit_exceeded", F.col("pairs") > max_pairs)


def similar(resolved: DataFrame, phash_limit: int = PHASH_LIMIT, dhash_limit: int = DHASH_LIMIT, max_pairs: int = MAX_PAIRS) -> DataFrame:
    """(left_id, right_id, phash_distance, dhash_distance) of train and test images within both limits, both inclusive.

    Below ``max_pairs`` all pairs are compared, with one side broadcast, whose size that bounds. Beyond, images meet in
    one of limit + 1 bands of the hash with the narrower limit, of which near hashes share one; a limit of more than
    LONGEST_BANDED for both hashes is refused there.
    """
    cols = ["record_id", "phash", "dhash", "byte_sha256", "pixel_sha256"]
    left, right = (resolved.where(F.col("partition") == p).select(*cols).toDF(*(f"{s}_{c}" for c in cols)) for p, s in (("train", "l"), ("test", "r")))
    pairs = pair_counts(resolved.withColumn("status", F.lit("resolved")), max_pairs).first()
    near = (T.hamming(F.col("l_phash"), F.col("r_phash")) <= phash_limit) & (T.hamming(F.col("l_dhash"), F.col("r_dhash")) <= dhash_limit)
    differ = ~F.coalesce(F.col("l_byte_sha256") == F.col("r_byte_sha256"), F.lit(False)) & ~F.coalesce(F.col("l_pixel_sha256") == F.col("r_pixel_sha256"), F.lit(False))
    if not pairs["limit_exceeded"]:
        small_right = pairs["n_test"] <= pairs["n_train"]
        joined = left.join(F.broadcast(right), near & differ) if small_right else F.broadcast(left).join(right, near & differ)
    elif min(phash_limit, dhash_limit) > LONGEST_BANDED:
        raise ConfigError(f"above {max_pairs} pairs, images are compared by bands: a threshold of {LONGEST_BANDED} or less is needed")
    elif dhash_limit < phash_limit:  # the narrower limit has the longer bands
        band = lambda df, s: df.withColumn("band", F.explode(_bands(F.col(f"{s}_dhash"), dhash_limit + 1)))
        joined = band(left, "l").join(band(right, "r"), "band").where(near & differ).dropDuplicates(["l_record_id", "r_record_id"])
    else:
        band = lambda df, s: df.withColumn("band", F.explode(_bands(F.col(f"{s}_phash"), phash_limit + 1)))
        joined = band(left, "l").join(band(right, "r"), "band").where(near & differ).dropDuplicates(["l_record_id", "r_record_id"])
    return joined.select(F.col("l_record_id").alias("left_id"), F.col("r_record_id").alias("right_id"), T.hamming(F.col("l_phash"), F.col("r_phash")).alias("phash_distance"), T.hamming(F.col("l_dhash"), F.col("r_dhash")).alias("dhash_distance"))


def _bands(h: Column, n: int) -> Column:
    """(number, bits) of n disjoint parts of a 64-bit number."""
    cuts = [64 * k // n for k in range(n + 1)]
    return F.array(*(F.struct(F.lit(k).alias("k"), F.shiftrightunsigned(h, a).bitwiseAND(F.lit((1 << (b - a)) - 1 if b - a < 63 else -1)).alias("bits")) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))))


def similarity_findings(pairs: DataFrame, phash_limit: int = PHASH_LIMIT, dhash_limit: int = DHASH_LIMIT) -> Findings:
    """Each similar pair as a probable finding."""
    kind = F.lit("image_similarity_candidate")
    key = F.concat_ws("\x1f", "left_id", "right_id", F.col("phash_distance").cast("string"), F.col("dhash_distance").cast("string"))
    found = pairs.withColumns({"n_records": F.lit(2).cast("long"), "n_train": F.lit(1).cast("long"), "n_test": F.lit(1).cast("long"), "x": F.lit(0).cast("long"), "s": F.lit(0), "finding_type": kind, "confirmation_level": F.lit("probable"), "first_record_id": F.least("left_id", "right_id")})
    found = found.withColumn("finding_id", finding_id(kind, key))
    metrics = F.create_map(F.lit("phash_distance"), F.col("phash_distance").cast("string"), F.lit("dhash_distance"), F.col("dhash_distance").cast("string"), F.lit("phash_distance_threshold"), F.lit(str(phash_limit)), F.lit("dhash_distance_threshold"), F.lit(str(dhash_limit)))
    none = F.lit(None).cast("string")
    members = found.select("finding_id", F.explode(F.array("left_id", "right_id")).alias("record_id"), F.lit("image_path").alias("matched_field"), none.alias("matched_value"))
    return Findings(_shape(found, F.lit("image_path"), none, metrics), members)


def _single(found: DataFrame, kind: str, level: str, key: Column, field: str, value: Column, metrics: Column) -> Findings:
    found = found.withColumns({"n_records": F.lit(1).cast("long"), "n_train": (F.col("partition") == "train").cast("long"), "n_test": (F.col("partition") == "test").cast("long"), "x": F.lit(0).cast("long"), "s": F.lit(0), "finding_type": F.lit(kind), "confirmation_level": F.lit(level), "first_record_id": F.col("record_id")})
    found = found.withColumn("finding_id", finding_id(F.lit(kind), key))
    return Findings(_shape(found, F.lit(field), value, metrics), found.select("finding_id", "record_id", F.lit(field).alias("matched_field"), value.alias("matched_value")))


def input_quality(fingerprints: DataFrame) -> Findings:
    """One finding per image that couldn't be read."""
    bad = fingerprints.where("status != 'resolved'")
    metrics = F.create_map(F.lit("status"), F.col("status"), F.lit("error_code"), F.col("error_code"))
    return _single(bad, "image_read_error", "warning", F.concat_ws("\x1f", "record_id", "status"), "image_path", F.col("source_image_path"), metrics)


def limit_finding(records: DataFrame, fingerprints: DataFrame, max_pairs: int = MAX_PAIRS) -> Findings:
    """Over the pair limit: one finding on the record with the least id."""
    over = pair_counts(fingerprints, max_pairs).where("limit_exceeded").select("pairs")
    first = records.agg(F.min(F.struct("record_id", "partition")).alias("r")).select("r.*")
    metrics = F.create_map(F.lit("requested_pair_count"), F.col("pairs").cast("string"), F.lit("max_image_pairs"), F.lit(str(max_pairs)))
    return _single(first.join(over), "resource_limit_exceeded", "warning", F.concat_ws("\x1f", "record_id", F.col("pairs").cast("string")), "image_pair_limit", F.lit(str(max_pairs)), metrics)


def evidence(members: DataFrame, records: DataFrame, fingerprints: DataFrame | None = None) -> DataFrame:
    """One row per finding and record: where the record comes from, what matched, and its image's digests.

    A table beside the findings, not an array in each: a finding may have a third of all records.
    """
    about = records.select("record_id", F.col("manifest_id").alias("source_manifest_id"), "source_row_number", F.col("partition").alias("assigned_partition"), "image_path", F.when(F.col("lineage").isNotNull(), F.lit(PARSER_VERSION)).alias("parser_version"))
    out = members.join(about, "record_id")
    prints = ["byte_sha256", "pixel_sha256", "phash", "dhash"]
    if fingerprints is None:
        out = out.withColumns({"byte_sha256": F.lit(None).cast("string"), "pixel_sha256": F.lit(None).cast("string"), "phash": F.lit(None).cast("long"), "dhash": F.lit(None).cast("long")})
    else:
        out = out.join(fingerprints.select("record_id", *prints), "record_id", "left")
    image = F.col("matched_field").isin("image_path", "byte_sha256", "pixel_sha256")
    # an identifier's evidence is its value; an image's is its path and digests
    digests = {c: F.when(image, F.col(c)) for c in prints}
    path = F.when(image, F.col("image_path")).otherwise(F.col("matched_value"))
    return out.select("finding_id", "record_id", "source_manifest_id", "source_row_number", "assigned_partition", F.when(image, F.lit("image_path")).otherwise(F.col("matched_field")).alias("matched_field"), path.alias("matched_value"), "image_path", "parser_version", *(v.alias(k) for k, v in digests.items()))


def all_findings(records: DataFrame, conflicts: DataFrame | None, fingerprints: DataFrame | None, max_pairs: int = MAX_PAIRS, phash_limit: int = PHASH_LIMIT, dhash_limit: int = DHASH_LIMIT) -> Findings:
    """Identifiers, then images, then the quality of the input; over the limit no pair is compared."""
    out = identifier_overlaps(records, conflicts)
    if fingerprints is None:
        return out
    resolved = fingerprints.where("status = 'resolved'")
    parts = [byte_duplicates(resolved), pixel_duplicates(resolved), input_quality(fingerprints), limit_finding(records, fingerprints, max_pairs)]
    if not pair_counts(fingerprints, max_pairs).first()["limit_exceeded"]:
        parts.append(similarity_findings(similar(resolved, phash_limit, dhash_limit, max_pairs), phash_limit, dhash_limit))
    return out.union(*parts)
