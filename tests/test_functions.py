import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from parttrace.errors import ManifestError
from parttrace.functions import barcode
from parttrace.functions import text as T


def test_headers():
    assert T.plain_header("  Patient ID ") == "patient_id"
    assert T.plain_header("Slide-/Name (old)") == "slide_name_old"
    with pytest.raises(ManifestError):
        T.plain_header(" -- ")


@pytest.mark.parametrize("value,expected", [("", None), (" N/A ", None), ("None", None), ("nan", "nan"), ("unknown", "unknown"), ("0", "0"), ("\x1cA  B\t", "a b"), ("Straße", "strasse"), ("ＡＢ", "ab"), (None, None)])
def test_identifier(spark, value, expected):
    df = spark.createDataFrame([(value,)], "v string")
    assert df.select(T.identifier(F.col("v"))).first()[0] == expected == T.plain_identifier(value)


def test_native_path_equals_python(spark):
    values = []

    @settings(max_examples=300, database=None)
    @given(st.text(st.characters(max_codepoint=127), max_size=12))
    def collect(v):
        values.append(v)

    collect()
    got = spark.createDataFrame([(v,) for v in values], "v string").select("v", T.identifier(F.col("v"), False), T.value(F.col("v"), False), T.text(F.col("v"), False)).collect()
    for v, i, x, t in got:
        assert (i, x, t) == (T.plain_identifier(v), T.plain_value(v), T.plain_text(v)), repr(v)


def test_json_and_digest(spark):
    df = spark.createDataFrame([("a", 'q"\\'), ("é", None)], "x string, y string")
    got = [r[0] for r in df.select(T.digest(T.json_object({"y": T.json_text(F.col("y")), "x": T.json_text(F.col("x"))}))).collect()]
    assert got == [T.plain_digest({"x": "a", "y": 'q"\\'}), T.plain_digest({"x": "é", "y": None})]


def test_hamming(spark):
    df = spark.createDataFrame([("ffffffffffffffff", "0000000000000000"), ("8000000000000001", "0000000000000001")], "a string, b string")
    assert [r[0] for r in df.select(T.hamming(T.hash_bits(F.col("a")), T.hash_bits(F.col("b")))).collect()] == [64, 1]


@pytest.mark.parametrize("value,patient,specimen", [("TCGA-02-0001", "TCGA-02-0001", None), (" tcga-02-0001-01a ", "TCGA-02-0001", "TCGA-02-0001-01A"), ("TCGA-02-0001-01A-01D-0001-01", "TCGA-02-0001", "TCGA-02-0001-01A"), ("plain", None, None)])
def test_barcodes(spark, value, patient, specimen):
    r = spark.createDataFrame([(value,)], "v string").select(barcode.parsed(F.col("v")).alias("b"), barcode.malformed(F.col("v")).alias("bad")).first()
    assert not r["bad"] and (r["b"] and r["b"]["derived_patient_id"]) == patient and (r["b"] and r["b"]["derived_specimen_id"]) == specimen


@pytest.mark.parametrize("value", ["TCGA-02", "xTCGA-02-0001", "TCGA-02-0001-01", "TCGA-02-0001-01A-0001-01", "TCGA-02-0001-junk"])
def test_malformed_barcodes(spark, value):
    assert spark.createDataFrame([(value,)], "v string").select(barcode.malformed(F.col("v"))).first()[0]
