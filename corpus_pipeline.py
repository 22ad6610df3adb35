"""The corpus pipeline: toxic documents go, then exact and near copies; the rest is mixed to target weights and encoded.

Each stage works on all that the one before it kept. All but the last return the columns of ``documents``. Stages decide
by a key of each row, so rows without an id are judged like others, and repeated rows are copies.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parttrace.llm import common
from parttrace.llm.bpe import bpe
from parttrace.llm.exact_dedup import DigestIndex
from parttrace.llm.mixing import mix
from parttrace.llm.ngram_join import ngram_jaccard
from parttrace.llm.toxicity import toxicity


def _keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with a number of each row, ``_key``, in the order of ids (null last).

    Ids that are all there and different are the numbers. Otherwise rows are numbered, which orders and writes them all.
    """
    if docs.groupBy("doc_id").count().where("count > 1 or doc_id is null").isEmpty():
        return docs.withColumn("_key", F.col("doc_id").cast("long"))
    docs = docs.withColumn("_place", F.monotonically_increasing_id()).orderBy(F.col("doc_id").asc_nulls_last(), "_place").drop("_place")
    return common.stored(docs.withColumn("_key", F.monotonically_increasing_id()), "keyed")


def _without(keyed: DataFrame, found: DataFrame, dropped: str) -> DataFrame:
    """Rows whose key isn't among the dropped ones. Only rows that a filter of the dropped keys doesn't clear are shuffled."""
    keys = common.stored(found.where(dropped).select("_key"), "dropped")
    marked = common.in_filter(keyed, "_key", common.id_filter(keys))
    return marked.where("not _in").union(marked.where("_in").join(keys.hint("merge"), "_key", "left_anti").select(marked.columns)).drop("_in", "_key")


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the network, trained on all labels of the corpus, doesn't take for toxic."""
    keyed = _keyed(docs)
    found = toxicity(keyed, common.table(spark, sf_dir, "labels").select("doc_id", "toxic"), named_by="_key")
    return _without(keyed, found, "predicted = 1")


def remove_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the least id; one without id only if none has one."""
    keyed = _keyed(docs)
    index = DigestIndex(spark, f"digest_index_{common.uuid.uuid4().hex}")
    found = index.add(keyed, "_key")
    index.drop()
    return _without(keyed, found, "not kept")


def remove_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts linked by five-word n-grams at a similarity of 0.8 or more the document with the least id (null last)."""
    keyed = _keyed(docs)
    return _without(keyed, ngram_jaccard(keyed, "_key"), "_key <> component_id")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes their words: whole times, and once more with the chance of what is left.

    That chance is drawn from the id, and from the text too where the id is null or repeated, so reruns agree. Texts
    without words take no part in the mix and go.
    """
    repeated = common.stored(docs.where("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("_rows")).where("_rows > 1"), "repeated")
    keyed = docs.join(F.broadcast(repeated) if repeated.limit(100_001).count() <= 100_000 else repeated, "doc_id", "left")
    own = F.col("doc_id").isNotNull() & F.col("_rows").isNull()
    keyed = keyed.withColumn("_key", F.when(own, F.col("doc_id")).otherwise(F.xxhash64("doc_id", "text")))
    taken, _ = mix(keyed, "_key")
    times = F.col("taken") / F.greatest(F.col("size"), F.lit(1))
    draw = F.pmod(F.xxhash64("_key", F.lit(23)), F.lit(1_000_000)) / 1_000_000
    times = (F.floor(times) + (draw < times - F.floor(times)).cast("long")).cast("int")
    copies = taken.select("_key", times.alias("_times")).where("_times > 0").dropDuplicates(["_key"])
    return keyed.join(copies, "_key").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_times")))).select(docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document of the mix, and the digests of ids and decoded bytes."""
    return bpe(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [("toxicity", remove_toxic), ("exact_dedup", remove_copies), ("ngram_jaccard_join", remove_near_copies), ("mixing", mix_sources), ("byte_bpe", encode)]
#: The first stage has no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again before the next."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
