"""The pipeline's stages against brute force on the smallest table, and the queries that have SQL."""

import re
from pathlib import Path

import duckdb
import pytest

import corpus_pipeline as P
from parttrace.llm import queries as Q

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="sample tables are not here")


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns = docs.columns
    toxic = {r[0] for r in spark.read.parquet(f"{DATA}/labels.parquet").where("toxic = 1").select("doc_id").collect()}
    kept = P.common.stored(P.remove_toxic(spark, docs, DATA), "t")
    rows = {r["doc_id"]: r for r in kept.collect()}
    assert kept.columns == columns and len(toxic & set(rows)) < len(toxic) and len(rows) > 0.7 * docs.count()
    once = P.common.stored(P.remove_copies(spark, kept, DATA), "e")
    first = {}
    for i in sorted(rows):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", rows[i]["text"] or ""), i)
    assert once.columns == columns and {r["doc_id"] for r in once.collect()} == set(first.values())
    apart = P.common.stored(P.remove_near_copies(spark, once, DATA), "n")
    sets = {}
    for r in once.collect():
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), r["text"] or ""))
        sets[r["doc_id"]] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} - {()}
    root = {i: i for i in sets}

    def find(a):
        return a if root[a] == a else find(root[a])

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    assert apart.columns == columns and {r["doc_id"] for r in apart.collect()} == {i for i in ids if find(i) == i}
    mixed = P.common.stored(P.mix_sources(spark, apart, DATA), "m")
    taken = {r["doc_id"]: r for r in P.mix(apart)[0].collect()}
    times = {}
    for r in mixed.collect():
        times[r["doc_id"]] = times.get(r["doc_id"], 0) + 1
    assert mixed.columns == columns and all(abs(times.get(i, 0) - r["taken"] / max(1, r["size"])) < 1 for i, r in taken.items())
    encoded = P.encode(spark, mixed, DATA).collect()
    assert len(encoded) == sum(times.values()) and all(len(r["ids"]) == r["n_tokens"] for r in encoded)


def test_rows_without_or_with_repeated_ids(spark, tmp_path):
    """Rows are judged by themselves: null ids like others, repeated rows as copies."""
    clean = [" ".join(f"word{(7 * k + j * j) % 97}x{k}" for j in range(40)) for k in range(40)]
    bad = [t + " grumbo snarfle grumbix" for t in clean]
    rows = [(k, bad[k] if k % 2 else clean[k], "s") for k in range(40)]
    rows += [(None, bad[3] + " more", "s"), (None, "a text of its own without id " * 3, "s"), (None, "a text of its own without id " * 3, "s"), (90, "the same row twice " * 3, "t"), (90, "the same row twice " * 3, "t"), (91, "first with this id " * 3, "t"), (91, "second with that number " * 3, "t")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    spark.createDataFrame([(k, k % 2) for k in range(40)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    kept = P.common.stored(P.remove_toxic(spark, docs, str(tmp_path)), "t")
    assert not kept.where("doc_id is null and text like '%grumbo%'").count()
    late = spark.createDataFrame(rows[41:], docs.schema)
    expected = sorted({(str(i), t) for i, t, _ in rows[41:]})
    for stage in (P.remove_copies, P.remove_near_copies):
        assert sorted((str(r["doc_id"]), r["text"]) for r in stage(spark, late, "").collect()) == expected
    once = P.common.stored(late.distinct(), "once")
    mixed = {(str(r["doc_id"]), r["text"]) for r in P.mix_sources(spark, once, "").collect()}
    taken = sum(r["taken"] for r in P.mix(once)[0].collect())
    assert mixed <= set(expected) and taken and ("None", rows[41][1]) in mixed


def test_toxic_stage_against_the_network(spark):
    """What goes is what the trained network itself scores at 1 / 2 or more, text by text."""
    import pyarrow as pa

    from parttrace.llm import toxicity as X

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    net = X.fitted(docs, spark.read.parquet(f"{DATA}/labels.parquet").select("doc_id", "toxic"))
    rows = docs.select("doc_id", "text").collect()
    stay = {r["doc_id"] for r in rows if net.scores(pa.array([r["text"]], pa.string()))[0] < 0.5}
    assert {r["doc_id"] for r in P.remove_toxic(spark, docs, DATA).collect()} == stay and len(stay) < len(rows)


@pytest.mark.parametrize("stage", [f for _, f in P.STAGES[:-1]])
def test_empty_and_odd_columns(spark, tmp_path, stage):
    """Empty tables stay empty; columns called like the operators' own come through; null texts and sources are kept or mixed."""
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    schema = "doc_id long, text string, lang string, source string, n_chars long, id string, n int, kept boolean, component_id long, size int, rep string"
    empty = spark.createDataFrame([], schema)
    assert stage(spark, empty, str(tmp_path)).count() == 0
    rows = [(k, t, None, s, None, f"i{k}", 1, False, 5, 2, "r") for k, (t, s) in enumerate([("some words of a text " * 4, "a"), ("other words of one " * 4, None), (None, "a"), ("", None), ("b " * 3000, "b")])]
    got = stage(spark, spark.createDataFrame(rows, schema), str(tmp_path))
    assert got.columns == empty.columns
    found = {r["doc_id"]: r for r in got.collect()}
    # the mix takes what targets ask for, and no empty text; equal texts (here null and empty) are copies
    whole = {"mix_sources": {0, 1, 4}, "remove_copies": {0, 1, 2, 4}}.get(stage.__name__, {0, 1, 2, 3, 4})
    assert set(found) <= whole if stage is P.mix_sources else set(found) == whole
    assert all(tuple(r) == rows[i] for i, r in found.items())


def test_last_stage_on_odd_rows(spark):
    import hashlib

    docs = spark.createDataFrame([(1, None, "a", 1), (2, "", "b", 2), (None, "some words", "c", 3), (2, "some words", None, 4)], "doc_id long, text string, ids string, n_tokens int")
    got = P.encode(spark, docs, "").collect()
    assert sorted(r["n_tokens"] for r in got) == [0, 0, 2, 2] and {r["decoded_sha256"] for r in got} == {hashlib.sha256(b).hexdigest() for b in (b"", b"some words")}
    assert P.encode(spark, docs.limit(0), "").count() == 0


@pytest.mark.parametrize("name", sorted(Q.SQL))
def test_sql(spark, name):
    db = duckdb.connect()
    for t in ("documents", "pages", "embeddings", "labels"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    plain = lambda df: sorted(map(str, df[sorted(df.columns)].itertuples(index=False, name=None)))
    assert plain(Q.QUERIES[name](spark, DATA).toPandas()) == plain(db.sql(Q.SQL[name]).df())


def test_contract_columns(spark):
    got = {r["doc_id"]: r for r in Q.op3_toxicity(spark, DATA).collect()}
    import zlib

    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    assert Q.op2_quality(spark, DATA).dtypes == [("doc_id", "bigint"), ("held_out", "boolean"), ("score", "double"), ("predicted", "int")]
    assert dict(Q.op10_mix_sources(spark, DATA).dtypes) == {"doc_id": "bigint", "size": "bigint", "source_size": "bigint", "target": "double", "taken": "bigint"}
