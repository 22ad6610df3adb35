import pytest
from pyspark.errors import PySparkException

from parttrace.errors import RecordError
from parttrace.operators import records as R


def rows(spark, data, columns):
    return spark.createDataFrame([(k, *r) for k, r in enumerate(data)], "source_row_number long, " + ", ".join(f"{c} string" for c in columns))


def test_source_ids(spark):
    df = rows(spark, [("RID", "p1"), ("x", None)], ["rid", "pat"])
    b = R.build(df, {"source_record_id": "rid", "patient_id": "pat"}, "train", "m")
    got = {r["source_record_id"]: r for r in b.records.collect()}
    assert got["rid"]["record_id"].startswith("rec_src_m_") and got["x"]["patient_id"] is None
    for bad in ([("RID",), (" rid ",)], [("a",), (None,)]):
        with pytest.raises(RecordError):
            R.build(rows(spark, bad, ["rid"]), {"source_record_id": "rid"}, "train", "m")


def test_ordinals_follow_rows(spark):
    b = R.build(rows(spark, [("a",), ("b",), ("a",), ("a",)], ["v"]), {}, "train", "m")
    ids = [r["record_id"] for r in b.records.orderBy("source_row_number").collect()]
    assert [i.rpartition("_")[2] for i in ids if "_dup" in i] == ["dup0001", "dup0002", "dup0003"] and len(set(ids)) == 4


def test_conflicts_and_derived(spark):
    df = rows(spark, [("other", "TCGA-02-0001-01A"), (None, "TCGA-02-0002"), ("tcga-02-0003", "TCGA-02-0003"), (None, "s")], ["pat", "slide"])
    b = R.build(df.withColumn("pat", df.pat), {"patient_id": "pat", "slide_id": "slide"}, "train", "m")
    got = [r["patient_id"] for r in b.records.orderBy("source_row_number").collect()]
    assert got == ["other", "tcga-02-0002", "tcga-02-0003", None]
    assert [(r["direct_value"], r["derived_value"]) for r in b.conflicts.collect()] == [("other", "tcga-02-0001")]
    assert {r["status"] for r in b.provenance.where("semantic_field = 'patient_id'").collect()} == {"accepted", "conflicted", "unresolved"}


def test_malformed_barcode_fails(spark):
    with pytest.raises(PySparkException):
        R.build(rows(spark, [("TCGA-junk",)], ["pat"]), {"patient_id": "pat"}, "train", "m").records.collect()
    assert R.build(rows(spark, [("TCGA-junk",)], ["pat"]), {}, "train", "m").records.count() == 1


def test_partition_warnings(spark):
    df = rows(spark, [("train",), ("TEST",), ("valid",), ("",)], ["split"])
    said = [r["warning"] for r in R.build(df, {"partition": "split"}, "train", "m").warnings.orderBy("source_row_number").collect()]
    assert len(said) == 2 and "value indicates test" in said[0] and "unsupported" in said[1]


def test_headers_of_our_own_columns(spark):
    """Headers that our columns have too change no digest and no id."""
    import hashlib
    import json

    raw = {"record_id": "a", "lineage": "b", "source_row_number": "c", "raw": "d", "partition": "e"}
    df = spark.sql(f"SELECT 7L AS source_row_number, named_struct({', '.join(f'{chr(39)}{k}{chr(39)}, {chr(39)}{v}{chr(39)}' for k, v in raw.items())}) AS raw")
    got = R.build(df, {"source_record_id": "record_id", "patient_id": "lineage"}, "train", "m").records.first()
    assert got["raw_values_digest"] == hashlib.sha256(json.dumps({"raw_values": raw}, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
    assert (got["source_record_id"], got["patient_id"], got["source_row_number"]) == ("a", "b", 7)
