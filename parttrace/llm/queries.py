"""The queries of this subpackage, each applying one operator to its whole table, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import license_scan
from .common import table


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ngram_join import ngram_jaccard

    return ngram_jaccard(table(spark, sf_dir, "documents"), n=3, percent=90)


def _held_out(df: DataFrame, parts: int, part: int) -> DataFrame:
    """Rows whose labels are never learned from: a fixed share by the checksum of doc_id."""
    return df.withColumn("held_out", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % parts == part, F.lit(False)))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import quality

    known = _held_out(table(spark, sf_dir, "labels").select("doc_id", "quality"), 3, 1).where("not held_out").drop("held_out")
    return _held_out(quality(table(spark, sf_dir, "documents"), known), 3, 1).select("doc_id", "held_out", "score", "predicted")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import toxicity

    known = _held_out(table(spark, sf_dir, "labels").select("doc_id", "toxic"), 5, 0).where("not held_out").drop("held_out")
    return _held_out(toxicity(table(spark, sf_dir, "documents"), known), 5, 0).select("doc_id", "held_out", "score", "predicted")


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .bpe import bpe

    return bpe(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=False)


def op5_extract_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_extract import extract

    return extract(table(spark, sf_dir, "pages"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .token_counts import token_counts

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .embed_dedup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "embeddings"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In two batches, the second against the first one's digests. The index of these files stays: a rerun finds all in it."""
    from .exact_dedup import DigestIndex, fingerprint

    docs = table(spark, sf_dir, "documents")
    return DigestIndex(spark, f"digest_index_{fingerprint(docs)}").add(docs, batches=2)


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    return mix(table(spark, sf_dir, "documents"))[0]


_OP9 = """
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, coalesce(doc_id = min(doc_id) OVER w, false) AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""

_OP1 = """
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) > 2 THEN list_distinct(list_transform(range(1, len(w) - 1), lambda k: w[k] || ' ' || w[k + 1] || ' ' || w[k + 2])) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM w),
g AS (SELECT doc_id, len(s) AS n, unnest(s) AS gram FROM s),
links AS (SELECT a.doc_id AS a, b.doc_id AS b FROM g a JOIN g b ON a.gram = b.gram AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
r(id, root) AS (SELECT doc_id, doc_id FROM s UNION SELECT r.id, l.b FROM r JOIN links l ON l.a = r.root)
SELECT doc_id, len(s) AS n_shingles, component_id FROM s JOIN (SELECT id AS doc_id, min(root) AS component_id FROM r GROUP BY id) USING (doc_id)
"""

_OP7 = """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings),
fine AS (SELECT * FROM v WHERE vec_id IS NOT NULL AND label IS NOT NULL AND x IS NOT NULL AND len(list_filter(x, lambda e: e IS NULL OR NOT isfinite(e))) = 0 AND len(list_filter(x, lambda e: e <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM fine a JOIN fine b ON a.label = b.label AND len(a.x) = len(b.x) AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.x, b.x) >= 0.93),
r(id, root) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.id, l.b FROM r JOIN links l ON l.a = r.root),
c AS (SELECT id AS vec_id, min(root) AS component_id FROM r GROUP BY id),
n AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept FROM v JOIN c USING (vec_id) LEFT JOIN n USING (vec_id)
"""

QUERIES = {
    f.__name__: f
    for f in (op1_ngram_jaccard_join, op2_quality, op3_toxicity, op4_byte_bpe, op5_extract_html, op6_token_counts, op7_embedding_dedup, op8_license_scan, op9_exact_dedup, op10_mix_sources)
}
SQL: dict[str, str] = {"op1_ngram_jaccard_join": _OP1, "op7_embedding_dedup": _OP7, "op8_license_scan": license_scan.sql(), "op9_exact_dedup": _OP9}
