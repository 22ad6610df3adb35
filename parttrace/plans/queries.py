"""Queries over the sample tables, each exercising one operator, and the SQL that must give the same rows.

The sample tables stand in for manifests: orders and their customers (patients, institutions), line items (specimens,
slides), documents (content) and embeddings (perceptual hashes), split by dates and ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import barcode
from ..functions import text as T
from ..operators import detect, graph, mapping, policy, profile, records, repair
from ..operators.components import connected
from .report import findings_rows

CUT = "1998-01-01"


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _side(condition):
    return F.when(condition, "train").otherwise("test").alias("partition")


def _shape(df: DataFrame) -> DataFrame:
    for f in ("patient_id", "specimen_id", "slide_id", "institution_id", "label"):
        if f not in df.columns:
            df = df.withColumn(f, F.lit(None).cast("string"))
    return df


def order_records(spark: SparkSession, d: str, institutions: bool = True) -> DataFrame:
    """Orders as records: patient o_custkey, label o_orderpriority and, if asked for, institution n_name by two joins."""
    o, c, n = _table(spark, d, "orders"), _table(spark, d, "customer"), _table(spark, d, "nation")
    if not institutions:
        own = [F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("record_id"), _side(F.col("o_orderdate") < CUT), F.col("o_custkey").cast("string").alias("patient_id"), F.col("o_orderpriority").alias("label")]
        return _shape(o.select(*own))
    df = o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    return _shape(df.select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("record_id"), _side(F.col("o_orderdate") < CUT), F.col("o_custkey").cast("string").alias("patient_id"), T.identifier(F.col("n_name"), False).alias("institution_id"), F.col("o_orderpriority").alias("label")))


def line_records(spark: SparkSession, d: str) -> DataFrame:
    """Line items as records: specimen l_partkey, slide (l_partkey, l_suppkey), label l_returnflag."""
    df = _table(spark, d, "lineitem")
    key = F.concat_ws("-", F.lit("l"), F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"))
    return _shape(df.select(key.alias("record_id"), _side(F.col("l_shipdate") < CUT), F.col("l_partkey").cast("string").alias("specimen_id"), F.concat_ws("-", F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string")).alias("slide_id"), F.col("l_returnflag").alias("label")))


def document_prints(spark: SparkSession, d: str) -> DataFrame:
    """Documents as images: bytes are the text, and texts of one language and length stand for equal pixels."""
    df = _table(spark, d, "documents")
    pixel = F.sha2(F.concat_ws("-", "lang", F.col("n_chars").cast("string")), 256)
    return df.select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("record_id"), _side(F.col("doc_id") % 5 != 0), F.lit("resolved").alias("status"), F.sha2("text", 256).alias("byte_sha256"), pixel.alias("pixel_sha256"))


def embedding_prints(spark: SparkSession, d: str) -> DataFrame:
    """Embeddings as images: bit i of the hash is the sign of component i."""
    df = _table(spark, d, "embeddings")
    bits = F.aggregate(F.transform("embedding", lambda e: (e > 0).cast("long")), F.lit(0).cast("long"), lambda h, b: F.shiftleft(h, 1).bitwiseOR(b))
    none = F.lit(None).cast("string")
    return df.select(F.concat(F.lit("v"), F.col("vec_id").cast("string")).alias("record_id"), _side(F.col("vec_id") % 5 != 0), F.lit("resolved").alias("status"), none.alias("byte_sha256"), none.alias("pixel_sha256"), bits.alias("phash"), F.lit(0).cast("long").alias("dhash"))


_ORDERS = f"SELECT 'o' || o_orderkey AS record_id, CASE WHEN o_orderdate < TIMESTAMP '{CUT}' THEN 'train' ELSE 'test' END AS partition, o_custkey::VARCHAR AS patient_id, lower(n_name) AS institution_id, o_orderpriority AS label FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey"
_LINES = f"SELECT 'l-' || l_orderkey || '-' || l_linenumber AS record_id, CASE WHEN l_shipdate < TIMESTAMP '{CUT}' THEN 'train' ELSE 'test' END AS partition, l_partkey::VARCHAR AS specimen_id, l_partkey || '-' || l_suppkey AS slide_id, l_returnflag AS label FROM lineitem"
_DOCS = "SELECT 'd' || doc_id AS record_id, CASE WHEN doc_id % 5 <> 0 THEN 'train' ELSE 'test' END AS partition, sha256(text) AS byte, sha256(lang || '-' || n_chars) AS pixel FROM documents"
_BITS = "list_sum(list_transform(embedding, lambda e, i: CASE WHEN e > 0 THEN (1::HUGEINT << (64 - i)::INT) ELSE 0::HUGEINT END))"
_GROUP = "count(*) AS n_records, count(*) FILTER (partition = 'train') AS n_train, count(*) FILTER (partition = 'test') AS n_test, min(record_id) AS first_record_id"
_BOTH = "HAVING count(DISTINCT partition) = 2"

QUERIES: dict = {}
SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _overlap(df: DataFrame, field: str) -> DataFrame:
    return policy.evaluate(detect.identifier_overlaps(df, fields=(field,)).findings, policy.profile()).select("finding_type", "matched_value", "n_records", "n_train", "n_test", "first_record_id", "policy_outcome", "policy_rule")


def _overlap_sql(source: str, field: str, kind: str, outcome: str, rule: str) -> str:
    return f"SELECT '{kind}' AS finding_type, {field} AS matched_value, {_GROUP}, '{outcome}' AS policy_outcome, '{rule}' AS policy_rule FROM ({source}) GROUP BY {field} {_BOTH}"


@_query(_overlap_sql(_ORDERS, "patient_id", "confirmed_patient_overlap", "violation", "patient_disjoint"))
def q_patient_overlap(spark: SparkSession, d: str) -> DataFrame:
    return _overlap(order_records(spark, d, False), "patient_id")


@_query(_overlap_sql(_ORDERS, "institution_id", "institution_overlap", "allowed_overlap", "institution_disjoint"))
def q_institution_overlap(spark: SparkSession, d: str) -> DataFrame:
    return _overlap(order_records(spark, d), "institution_id")


@_query(_overlap_sql(_LINES, "specimen_id", "confirmed_specimen_overlap", "violation", "specimen_disjoint"))
def q_specimen_overlap(spark: SparkSession, d: str) -> DataFrame:
    return _overlap(line_records(spark, d), "specimen_id")


@_query(_overlap_sql(_LINES, "slide_id", "confirmed_slide_overlap", "violation", "slide_disjoint"))
def q_slide_overlap(spark: SparkSession, d: str) -> DataFrame:
    return _overlap(line_records(spark, d), "slide_id")


_CONTENT = ["finding_type", "matched_value", "n_records", "n_train", "n_test", "first_record_id"]


@_query(f"SELECT 'confirmed_byte_content_duplicate' AS finding_type, byte AS matched_value, {_GROUP} FROM ({_DOCS}) GROUP BY byte {_BOTH}")
def q_byte_duplicates(spark: SparkSession, d: str) -> DataFrame:
    return detect.byte_duplicates(document_prints(spark, d)).findings.select(_CONTENT)


@_query(f"SELECT 'confirmed_pixel_content_duplicate' AS finding_type, pixel AS matched_value, {_GROUP} FROM ({_DOCS}) GROUP BY pixel {_BOTH} AND count(DISTINCT byte) > 1")
def q_canonical_duplicates(spark: SparkSession, d: str) -> DataFrame:
    return detect.pixel_duplicates(document_prints(spark, d)).findings.select(_CONTENT)


_NEAR = f"WITH v AS (SELECT vec_id, vec_id % 5 <> 0 AS train, {_BITS} AS h FROM embeddings) SELECT 'v' || a.vec_id AS left_id, 'v' || b.vec_id AS right_id, bit_count(xor(a.h, b.h))::INT AS phash_distance FROM v a JOIN v b ON a.train AND NOT b.train WHERE bit_count(xor(a.h, b.h)) <= "


@_query(_NEAR + "20")
def q_similar_pairs(spark: SparkSession, d: str) -> DataFrame:
    return detect.similar(embedding_prints(spark, d), 20, 12, max_pairs=2_000_000).select("left_id", "right_id", "phash_distance")


@_query(_NEAR + "16")
def q_similar_pairs_banded(spark: SparkSession, d: str) -> DataFrame:
    return detect.similar(embedding_prints(spark, d), 16, 64, max_pairs=0).select("left_id", "right_id", "phash_distance")


@_query("SELECT count(*) FILTER (vec_id % 5 <> 0) AS n_train, count(*) FILTER (vec_id % 5 = 0) AS n_test, n_train * n_test AS pairs, n_train * n_test > 100000 AS limit_exceeded FROM embeddings")
def q_pair_budget(spark: SparkSession, d: str) -> DataFrame:
    return detect.pair_counts(embedding_prints(spark, d))


@_query("SELECT 'resource_limit_exceeded' AS finding_type, 'v0' AS first_record_id, (pairs)::VARCHAR AS requested FROM (SELECT count(*) FILTER (vec_id % 5 <> 0) * count(*) FILTER (vec_id % 5 = 0) AS pairs FROM embeddings) WHERE pairs > 1000")
def q_limit_finding(spark: SparkSession, d: str) -> DataFrame:
    prints = embedding_prints(spark, d)
    return detect.limit_finding(prints, prints, 1000).findings.select("finding_type", "first_record_id", F.col("metrics")["requested_pair_count"].alias("requested"))


@_query("SELECT c_custkey, regexp_replace(lower(trim('  ' || upper(c_name) || chr(9) || ' x  y ', ' ' || chr(9))), '[\\x09-\\x0d\\x1c-\\x20]+', ' ', 'g') AS normal FROM customer")
def q_normalize_identifier(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d, "customer").select("c_custkey", T.identifier(F.concat(F.lit("  "), F.upper("c_name"), F.lit("\t x  y ")), False).alias("normal"))


@_query("SELECT event_id, CASE WHEN event_id % 7 = 0 THEN NULL WHEN event_id % 7 = 1 THEN NULL WHEN event_id % 7 = 2 THEN 'nan' ELSE event_type END AS present FROM events")
def q_missing_tokens(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id") % 7
    return _table(spark, d, "events").select("event_id", T.value(F.when(k == 0, F.lit(" N/A ")).when(k == 1, F.lit("None")).when(k == 2, F.lit("nan")).otherwise(F.col("event_type")), False).alias("present"))


def _profile_sql(table: str, columns: list[str], select: str) -> str:
    one = " UNION ALL ".join(f"SELECT '{c}' AS \"column\", nullif(trim({c}::VARCHAR), '') AS v FROM {table}" for c in columns)
    return f"WITH x AS ({one}), p AS (SELECT \"column\", count(*) AS n_rows, count(v) AS n_present, count(*) - count(v) AS n_missing, count(DISTINCT v) AS n_distinct, coalesce(bool_or(regexp_matches(lower(v), '\\.(svs|tiff?|png|jpe?g|dcm|ndpi|mrxs)$') OR contains(v, '/')), false) AS image_signal, coalesce(bool_and(lower(v) IN ('train','training','test','testing','val','valid','validation')), false) AS all_split, coalesce(bool_and(regexp_matches(v, '^[+-]?[0-9]+$')), false) AS integer_like, coalesce(bool_and(regexp_matches(v, '^[+-]?[0-9]+\\.[0-9]+$')), false) AS decimal_like, coalesce(bool_and(contains(v, '/') OR contains(v, chr(92))), false) AS path_like FROM x GROUP BY 1) {select}"


_PART = ["p_partkey", "p_name", "p_brand", "p_type", "p_size"]


@_query(_profile_sql("part", _PART, 'SELECT "column", n_rows, n_present, n_missing, n_distinct, round(n_distinct / n_present, 4) AS distinct_ratio FROM p'))
def q_column_profile(spark: SparkSession, d: str) -> DataFrame:
    return profile.profile(_table(spark, d, "part"), _PART, False).select("column", "n_rows", "n_present", "n_missing", "n_distinct", "distinct_ratio")


_EVENTS = ["event_id", "user_id", "event_type", "props"]


@_query(_profile_sql("events", _EVENTS, 'SELECT "column", image_signal AS image_path, all_split AND n_distinct <= 3 AS partition, n_distinct > 1 AND n_distinct <= greatest(2, n_present // 2) AS class_label, n_present > 0 AND n_distinct = n_present AS source_record_id, n_distinct >= 1 AND n_distinct <= greatest(1, n_present // 3) AS institution_id FROM p'))
def q_value_signals(spark: SparkSession, d: str) -> DataFrame:
    return profile.signals(profile.profile(_table(spark, d, "events"), _EVENTS, False))


@_query(_profile_sql("events", _EVENTS, 'SELECT "column", n_present > 0 AND n_distinct / n_present >= 0.9 AS mostly_unique, n_distinct <= greatest(2, n_present // 5) AS low_cardinality, n_distinct < n_present AS repeated_categorical, integer_like, decimal_like, path_like, integer_like OR decimal_like AS numeric_like FROM p'))
def q_pattern_flags(spark: SparkSession, d: str) -> DataFrame:
    return profile.flags(profile.profile(_table(spark, d, "events"), _EVENTS, False)).select("column", "mostly_unique", "low_cardinality", "repeated_categorical", "integer_like", "decimal_like", "path_like", "numeric_like")


_SCORES = "SELECT p_brand AS field, p_type AS \"column\", round((max(p_size) % 10) / 10, 3) AS score FROM part GROUP BY 1, 2"


@_query(f"WITH s AS ({_SCORES}), r AS (SELECT *, row_number() OVER w AS rank, round(score - coalesce(lead(score) OVER w, 0), 3) AS margin FROM s WINDOW w AS (PARTITION BY field ORDER BY score DESC, \"column\")) SELECT field, \"column\", score, rank::INT AS rank, margin, rank = 1 AND score >= 0.58 AND margin >= 0.12 AS chosen FROM r WHERE rank <= 3")
def q_mapping_rank(spark: SparkSession, d: str) -> DataFrame:
    s = _table(spark, d, "part").groupBy(F.col("p_brand").alias("field"), F.col("p_type").alias("column")).agg(F.round((F.max("p_size") % 10) / 10, 3).alias("score"))
    return mapping.rank(s)


@_query("SELECT c_custkey, 'rec_src_m_' || substr(sha256('\"' || lower(c_name) || '\"'), 1, 16) AS record_id FROM customer")
def q_record_ids(spark: SparkSession, d: str) -> DataFrame:
    rows = _table(spark, d, "customer").withColumn("source_row_number", F.col("c_custkey"))
    built = records.build(rows, {"source_record_id": "c_name"}, "train", "m", {"c_name": "c_name"}, unicode=False)
    return built.records.select(F.col("source_row_number").alias("c_custkey"), "record_id")


@_query("WITH b AS (SELECT event_id, sha256('{\"normalized_header_values\":{\"event_type\":\"' || event_type || '\",\"user_id\":\"' || user_id || '\"}}') AS h FROM events) SELECT event_id, 'rec_m_' || substr(h, 1, 24) || CASE WHEN count(*) OVER (PARTITION BY h) > 1 THEN '_dup' || lpad((row_number() OVER (PARTITION BY h ORDER BY event_id))::VARCHAR, 4, '0') ELSE '' END AS record_id FROM b")
def q_dup_ordinals(spark: SparkSession, d: str) -> DataFrame:
    rows = _table(spark, d, "events").select(F.col("event_id").alias("source_row_number"), "user_id", "event_type")
    return records.build(rows, {}, "train", "m", unicode=False).records.select(F.col("source_row_number").alias("event_id"), "record_id")


def _coded(spark: SparkSession, d: str) -> DataFrame:
    """Customers with barcodes made from their keys, a patient that agrees with most, and a partition word."""
    df = _table(spark, d, "customer")
    four = F.lpad((F.col("c_custkey") % 10000).cast("string"), 4, "0")
    code = F.when(F.col("c_custkey") % 4 == 0, F.concat(F.lit("TCGA-02-"), four)).when(F.col("c_custkey") % 4 == 1, F.concat(F.lit(" tcga-02-"), four, F.lit("-01a "))).when(F.col("c_custkey") % 4 == 2, F.concat(F.lit("TCGA-02-"), four, F.lit("-01A-01D-0001-01"))).otherwise(F.concat(F.lit("s"), four))
    patient = F.when(F.col("c_custkey") % 5 == 0, None).when(F.col("c_custkey") % 5 == 1, F.lit("other")).otherwise(F.concat(F.lit("TCGA-02-"), four))
    side = F.element_at(F.array(F.lit("train"), F.lit("Test"), F.lit("valid"), F.lit(" ")), (F.col("c_custkey") % 4 + 1).cast("int"))
    return df.select(F.col("c_custkey").alias("source_row_number"), code.alias("slide"), patient.alias("patient"), side.alias("split"))


_CODED = "SELECT c_custkey, lpad((c_custkey % 10000)::VARCHAR, 4, '0') AS four, CASE c_custkey % 4 WHEN 0 THEN 'TCGA-02-' || four WHEN 1 THEN 'TCGA-02-' || four || '-01A' WHEN 2 THEN 'TCGA-02-' || four || '-01A-01D-0001-01' END AS code, CASE c_custkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 'other' ELSE 'tcga-02-' || four END AS direct, CASE WHEN code IS NOT NULL THEN 'tcga-02-' || four END AS derived FROM customer"


@_query(f"SELECT c_custkey, code AS raw_identifier, CASE WHEN code IS NOT NULL THEN '02' END AS site, CASE WHEN code IS NOT NULL THEN four END AS participant, nullif(regexp_extract(code, '-([0-9]{{2}})([A-Z])(-|$)', 1), '') AS sample, CASE WHEN c_custkey % 4 = 2 THEN '0001' END AS plate, CASE WHEN code IS NOT NULL THEN 'TCGA-02-' || four END AS patient, CASE WHEN c_custkey % 4 IN (1, 2) THEN 'TCGA-02-' || four || '-01A' END AS specimen FROM ({_CODED})")
def q_barcode_parse(spark: SparkSession, d: str) -> DataFrame:
    p = _coded(spark, d).select("source_row_number", barcode.parsed(F.col("slide")).alias("b"))
    return p.select(F.col("source_row_number").alias("c_custkey"), "b.raw_identifier", F.col("b.tissue_source_site").alias("site"), "b.participant", "b.sample", "b.plate", F.col("b.derived_patient_id").alias("patient"), F.col("b.derived_specimen_id").alias("specimen"))


def _built(spark: SparkSession, d: str) -> records.Records:
    # a patient that looks like a barcode is parsed first, so the barcode column must lead where they differ
    rows = _coded(spark, d).withColumn("patient", F.when(F.col("patient") == "other", "other").when(F.col("patient").isNotNull(), F.lower("patient")))
    return records.build(rows, {"patient_id": "patient", "slide_id": "slide", "partition": "split"}, "train", "m", unicode=False)


_RECONCILED = f"SELECT c_custkey, direct, CASE WHEN direct LIKE 'tcga%' THEN direct ELSE derived END AS derived FROM ({_CODED})"


@_query(f"SELECT c_custkey, coalesce(direct, derived) AS patient_id, direct IS NOT NULL AND derived IS NOT NULL AND direct <> derived AS conflicted FROM ({_RECONCILED})")
def q_reconcile(spark: SparkSession, d: str) -> DataFrame:
    b = _built(spark, d)
    bad = b.conflicts.where("semantic_field = 'patient_id'").select("record_id", F.lit(True).alias("conflicted"))
    return b.records.join(bad, "record_id", "left").select(F.col("source_row_number").alias("c_custkey"), "patient_id", F.coalesce("conflicted", F.lit(False)).alias("conflicted"))


@_query(f"SELECT status, derivation_method, count(*) AS n FROM (SELECT unnest(CASE WHEN direct IS NULL AND derived IS NULL THEN ['unresolved unavailable'] WHEN direct IS NULL THEN ['accepted barcode_derived'] WHEN derived IS NULL THEN ['accepted direct_manifest_value'] WHEN direct <> derived THEN ['conflicted direct_manifest_value', 'conflicted barcode_derived'] ELSE ['accepted direct_manifest_value', 'accepted barcode_derived'] END) AS s, split_part(s, ' ', 1) AS status, split_part(s, ' ', 2) AS derivation_method FROM ({_RECONCILED})) GROUP BY ALL")
def q_provenance(spark: SparkSession, d: str) -> DataFrame:
    return _built(spark, d).provenance.where("semantic_field = 'patient_id'").groupBy("status", "derivation_method").agg(F.count(F.lit(1)).alias("n"))


@_query("SELECT c_custkey, 'manifest m row ' || c_custkey || ' partition column conflicts with assigned train: ' || CASE c_custkey % 4 WHEN 1 THEN 'value indicates test' ELSE 'unsupported two-partition value' END AS warning FROM customer WHERE c_custkey % 4 IN (1, 2)")
def q_partition_warnings(spark: SparkSession, d: str) -> DataFrame:
    return _built(spark, d).warnings.withColumnRenamed("source_row_number", "c_custkey")


@_query(f"SELECT institution_id AS matched_value, {_GROUP} FROM ({_ORDERS}) WHERE substr(record_id, 2)::BIGINT % 3 <> 0 GROUP BY institution_id {_BOTH}")
def q_conflict_excluded(spark: SparkSession, d: str) -> DataFrame:
    df = order_records(spark, d)
    bad = df.where(F.substring("record_id", 2, 20).cast("long") % 3 == 0).select("record_id", F.lit("institution_id").alias("semantic_field"))
    return detect.identifier_overlaps(df, bad, ("institution_id",)).findings.select("matched_value", "n_records", "n_train", "n_test", "first_record_id")


def _all_orders(spark: SparkSession, d: str) -> tuple[DataFrame, detect.Findings, DataFrame]:
    df = order_records(spark, d)
    found = detect.identifier_overlaps(df)
    return df, found, policy.evaluate(found.findings, policy.profile())


_P = f"SELECT patient_id AS v, {_GROUP} FROM ({_ORDERS}) GROUP BY patient_id {_BOTH}"
_I = f"SELECT institution_id AS v, {_GROUP} FROM ({_ORDERS}) GROUP BY institution_id {_BOTH}"


@_query(f"SELECT 'confirmed_patient_overlap' AS finding_type, v AS matched_value, 'violation' AS policy_outcome, 'patient_disjoint' AS policy_rule, 'default' AS policy_profile FROM ({_P}) UNION ALL SELECT 'institution_overlap', v, 'allowed_overlap', 'institution_disjoint', 'default' FROM ({_I})")
def q_policy_outcomes(spark: SparkSession, d: str) -> DataFrame:
    return _all_orders(spark, d)[2].select("finding_type", "matched_value", "policy_outcome", "policy_rule", "policy_profile")


@_query(f"SELECT p + i AS n_findings, p AS n_violation, i AS n_allowed_overlap, 0::BIGINT AS n_review_item, 0::BIGINT AS n_not_applicable, CASE WHEN p > 0 THEN 2 ELSE 0 END AS exit_code FROM (SELECT count(*) AS p FROM ({_P})), (SELECT count(*) AS i FROM ({_I}))")
def q_policy_summary(spark: SparkSession, d: str) -> DataFrame:
    return policy.summary(_all_orders(spark, d)[2])


@_query(f"SELECT 'confirmed_patient_overlap' AS finding_type, count(*) AS n FROM ({_P})")
def q_repair_eligible(spark: SparkSession, d: str) -> DataFrame:
    return _all_orders(spark, d)[2].where("repair_eligible").groupBy("finding_type").agg(F.count(F.lit(1)).alias("n"))


@_query(f"WITH o AS ({_ORDERS}), g AS (SELECT patient_id FROM o GROUP BY patient_id {_BOTH}) SELECT a.record_id AS src, b.record_id AS dst, 'confirmed_patient_overlap' AS relationship_type, 'confirmed' AS confirmation_level FROM o a JOIN o b USING (patient_id) JOIN g USING (patient_id) WHERE a.record_id < b.record_id")
def q_edges(spark: SparkSession, d: str) -> DataFrame:
    found = detect.identifier_overlaps(order_records(spark, d, False), fields=("patient_id",))
    return graph.edges(found.findings, found.members).select("src", "dst", "relationship_type", "confirmation_level")


@_query(f"SELECT relationship_type, sum(n_records * (n_records - 1) // 2)::BIGINT AS n_edges FROM (SELECT 'confirmed_patient_overlap' AS relationship_type, n_records FROM ({_P}) UNION ALL SELECT 'institution_overlap', n_records FROM ({_I})) GROUP BY 1")
def q_edge_counts(spark: SparkSession, d: str) -> DataFrame:
    return graph.edge_counts(_all_orders(spark, d)[1].findings)


@_query(f"SELECT record_id, partition, label FROM ({_ORDERS})")
def q_nodes(spark: SparkSession, d: str) -> DataFrame:
    return graph.nodes(order_records(spark, d, False))


def _linked(spark: SparkSession, d: str):
    """Orders tied by their patients."""
    df = order_records(spark, d, False)
    found = detect.identifier_overlaps(df, fields=("patient_id",))
    return df, found, policy.evaluate(found.findings, policy.profile())


_COMPONENTS = f"WITH l AS ({_ORDERS}), g AS (SELECT patient_id, min(record_id) AS root FROM l GROUP BY patient_id {_BOTH}), c AS (SELECT record_id, partition, label, coalesce(root, record_id) AS root, root IS NOT NULL AS tied FROM l LEFT JOIN g USING (patient_id))"


@_query(f"{_COMPONENTS} SELECT record_id, root FROM c")
def q_components(spark: SparkSession, d: str) -> DataFrame:
    df, found, judged = _linked(spark, d)
    return repair.components(df, judged, found.members)[0].select("record_id", "root")


@_query("WITH RECURSIVE e AS (SELECT c_custkey AS a, c_custkey // 3 AS b FROM customer WHERE c_custkey % 7 <> 0), e2 AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e), r(id, to_id) AS (SELECT a, a FROM e2 UNION SELECT b, b FROM e2 UNION SELECT r.id, e2.b FROM r JOIN e2 ON e2.a = r.to_id) SELECT id, min(to_id) AS component FROM r GROUP BY id")
def q_connected(spark: SparkSession, d: str) -> DataFrame:
    e = _table(spark, d, "customer").where("c_custkey % 7 != 0").select(F.col("c_custkey").alias("src"), F.floor(F.col("c_custkey") / 3).alias("dst"))
    loops = e.select("src").union(e.select("dst")).distinct()
    return loops.join(connected(e).toDF("src", "component"), "src", "left").select(F.col("src").alias("id"), F.coalesce("component", "src").alias("component"))


@_query(f"{_COMPONENTS} SELECT root, count(*) AS size, count(*) FILTER (partition = 'train') AS n_train, count(*) FILTER (partition = 'test') AS n_test, bool_or(tied)::INT::BIGINT AS cross_findings FROM c GROUP BY root")
def q_component_stats(spark: SparkSession, d: str) -> DataFrame:
    df, found, judged = _linked(spark, d)
    return repair.components(df, judged, found.members)[1].select("root", "size", "n_train", "n_test", "cross_findings")


@_query(f"{_COMPONENTS} SELECT root, label, count(*) AS n FROM c GROUP BY root, label")
def q_label_hist(spark: SparkSession, d: str) -> DataFrame:
    df, found, judged = _linked(spark, d)
    return repair.label_counts(repair.components(df, judged, found.members)[0])


@_query(f"{_COMPONENTS} SELECT count(*) AS n_components, max(k) AS largest, count(*) FILTER (t) AS n_crossing FROM (SELECT root, count(*) AS k, bool_or(tied) AS t FROM c GROUP BY root)")
def q_cross_counts(spark: SparkSession, d: str) -> DataFrame:
    df, found, judged = _linked(spark, d)
    return repair.components(df, judged, found.members)[1].agg(F.count(F.lit(1)).alias("n_components"), F.max("size").alias("largest"), F.count_if("cross_partition").alias("n_crossing"))


#: The greedy fold, component by component: train where that brings the train count nearer its goal; a tie goes by label
#: deviation, then moved records, then to train. ``st`` counts labels in train so far.
_FOLD = f"""{_COMPONENTS.replace("WITH l AS", "WITH RECURSIVE l AS", 1)},
lab AS (SELECT list(label ORDER BY label) AS names, list(n::DOUBLE ORDER BY label) AS overall FROM (SELECT label, count(*) AS n FROM c GROUP BY label)),
tot AS (SELECT count(*) FILTER (partition = 'train') / count(*) AS fraction, (count(*) FILTER (partition = 'train'))::DOUBLE AS goal, count(*) AS n FROM c),
own AS (SELECT root, map(list(label), list(n::DOUBLE)) AS by_label FROM (SELECT root, label, count(*) AS n FROM c GROUP BY root, label) GROUP BY root),
o AS (SELECT root, size, n_train, n_test, crossing, list_transform(names, lambda x: coalesce(by_label[x], 0)) AS ns, row_number() OVER (ORDER BY size DESC, crossing DESC, root) AS k
  FROM (SELECT root, count(*) AS size, count(*) FILTER (partition = 'train') AS n_train, count(*) FILTER (partition = 'test') AS n_test, bool_or(tied)::INT AS crossing FROM c GROUP BY root) JOIN own USING (root), lab),
f AS (SELECT 0::BIGINT AS k, 0::BIGINT AS cnt, list_transform(overall, lambda x: 0::DOUBLE) AS st, NULL::VARCHAR AS root, false AS train FROM lab
  UNION ALL
  SELECT k, cnt + CASE WHEN go THEN size ELSE 0 END, CASE WHEN go THEN list_transform(st, lambda x, i: x + ns[i]) ELSE st END, root, go FROM (
    SELECT o.k, f.cnt, f.st, o.root, o.size, o.ns, CASE
      WHEN abs(f.cnt + o.size - goal) < abs(f.cnt - goal) THEN true
      WHEN abs(f.cnt + o.size - goal) > abs(f.cnt - goal) THEN false
      ELSE (round(list_sum(list_transform(f.st, lambda x, i: abs(x + o.ns[i] - overall[i] * fraction) - abs(x - overall[i] * fraction))), 9) < 0)
        OR (round(list_sum(list_transform(f.st, lambda x, i: abs(x + o.ns[i] - overall[i] * fraction) - abs(x - overall[i] * fraction))), 9) = 0 AND o.n_test <= o.n_train) END AS go
    FROM f JOIN o ON o.k = f.k + 1, lab, tot)),
dealt AS (SELECT c.record_id, c.root, c.partition, CASE WHEN f.train THEN 'train' ELSE 'test' END AS proposed, c.label, c.tied FROM c JOIN f ON f.root = c.root)
"""


def _proposed(spark: SparkSession, d: str) -> repair.Repair:
    df, found, judged = _linked(spark, d)
    return repair.propose(df, judged, found.members, policy.profile())


@_query(f"{_FOLD} SELECT record_id, partition AS original_partition, proposed AS proposed_partition, partition <> proposed AS moved, label, bool_or(tied) OVER (PARTITION BY root) AS cross_partition FROM dealt")
def q_repair_assignment(spark: SparkSession, d: str) -> DataFrame:
    return _proposed(spark, d).records.drop("component_id")


@_query(f"{_FOLD} SELECT proposed AS proposed_partition, label, count(*) AS n FROM dealt GROUP BY ALL")
def q_labels_after(spark: SparkSession, d: str) -> DataFrame:
    return _proposed(spark, d).records.groupBy("proposed_partition", "label").agg(F.count(F.lit(1)).alias("n"))


@_query(f"{_FOLD} SELECT (SELECT fraction FROM tot) AS original_train_fraction, avg((proposed = 'train')::INT) AS proposed_train_fraction, (SELECT fraction FROM tot) AS target_train_fraction, count(*) FILTER (partition <> proposed) AS records_moved, count(DISTINCT root) AS component_count, (SELECT max(size) FROM o) AS largest_component_size FROM dealt")
def q_repair_metrics(spark: SparkSession, d: str) -> DataFrame:
    m = _proposed(spark, d).metrics
    kinds = {"original_train_fraction": "double", "proposed_train_fraction": "double", "target_train_fraction": "double", "records_moved": "long", "component_count": "long", "largest_component_size": "long"}
    return spark.createDataFrame([tuple(m[k] for k in kinds)], ", ".join(f"{k} {v}" for k, v in kinds.items()))


@_query(f"{_COMPONENTS}, t AS (SELECT root, count(*) FILTER (tied) AS n FROM c GROUP BY root) SELECT count(*) AS n_components, count(*) FILTER (n > 0) AS n_confirmed FROM t")
def q_confirming(spark: SparkSession, d: str) -> DataFrame:
    fixed = _proposed(spark, d)
    return fixed.components.select("component_id").join(fixed.ties.groupBy("component_id").agg(F.count(F.lit(1)).alias("n")), "component_id", "left").agg(F.count(F.lit(1)).alias("n_components"), F.count_if(F.col("n") > 0).alias("n_confirmed"))


@_query(f"SELECT 'confirmed_patient_overlap' AS finding_type, count(*) AS n, count(*) AS n_ids, count(*) AS n_formed FROM ({_P}) UNION ALL SELECT 'institution_overlap', count(*), count(*), count(*) FROM ({_I})")
def q_finding_ids(spark: SparkSession, d: str) -> DataFrame:
    """Ids are one per finding and have their form."""
    found = _all_orders(spark, d)[1].findings
    formed = F.col("finding_id").rlike("^finding_") & F.col("finding_id").rlike("_[0-9a-f]{16}$") & F.col("finding_id").contains(F.col("finding_type"))
    return found.groupBy("finding_type").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("finding_id").alias("n_ids"), F.count_if(formed).alias("n_formed"))


@_query("SELECT 'image_read_error' AS finding_type, 'warning' AS confirmation_level, 'd' || doc_id AS first_record_id, lang AS matched_value, CASE WHEN doc_id % 2 = 0 THEN 'unreadable' ELSE 'missing' END AS status FROM documents WHERE doc_id % 10 IN (2, 7)")
def q_input_quality(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("doc_id") % 10
    prints = _table(spark, d, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("record_id"), _side(F.col("doc_id") % 5 != 0), F.when(k == 2, "unreadable").when(k == 7, "missing").otherwise("resolved").alias("status"), F.lit("e").alias("error_code"), F.col("lang").alias("source_image_path"))
    return detect.input_quality(prints).findings.select("finding_type", "confirmation_level", "first_record_id", "matched_value", F.col("metrics")["status"].alias("status"))


@_query(f"SELECT record_id FROM ({_ORDERS}) JOIN ({_P}) ON patient_id = v WHERE substr(record_id, 2)::BIGINT % 5 = 0")
def q_lost_members(spark: SparkSession, d: str) -> DataFrame:
    """Members that a table of records without every fifth order doesn't have."""
    df, found, _ = _linked(spark, d)
    return graph.lost(found.members, df.where(F.substring("record_id", 2, 20).cast("long") % 5 != 0)).select("record_id")


@_query(f"SELECT max(n_records) AS largest, count(*) AS n_components FROM ({_P})")
def q_largest_component(spark: SparkSession, d: str) -> DataFrame:
    _, found, _ = _linked(spark, d)
    return graph.largest(found.findings, found.members)


@_query(f"SELECT g.first_record_id AS src, l.record_id AS dst, 'confirmed_patient_overlap' AS relationship_type, 'confirmed' AS confirmation_level FROM ({_ORDERS}) l JOIN ({_P}) g ON l.patient_id = g.v WHERE l.record_id <> g.first_record_id")
def q_star_edges(spark: SparkSession, d: str) -> DataFrame:
    _, found, _ = _linked(spark, d)
    return graph.star_edges(found.findings, found.members).select("src", "dst", "relationship_type", "confirmation_level")


@_query(f"SELECT v AS matched_value, o.record_id, 'm' AS source_manifest_id, substr(o.record_id, 2)::BIGINT AS source_row_number, partition AS assigned_partition, 'patient_id' AS matched_field FROM ({_ORDERS}) o JOIN ({_P}) ON patient_id = v")
def q_evidence(spark: SparkSession, d: str) -> DataFrame:
    df, found, _ = _linked(spark, d)
    none = F.lit(None).cast("string")
    df = df.withColumns({"manifest_id": F.lit("m"), "source_row_number": F.substring("record_id", 2, 20).cast("long"), "image_path": none, "lineage": none})
    return detect.evidence(found.members, df).select("matched_value", "record_id", "source_manifest_id", "source_row_number", "assigned_partition", "matched_field")


_CONFLICT = "'{\"derived_value\":\"' || derived || '\",\"direct_value\":\"' || direct || '\",\"parser_version\":\"' || version || '\",\"record_id\":\"' || record_id || '\",\"semantic_field\":\"patient_id\"}'"


def _manifest(spark: SparkSession, d: str) -> records.Records:
    """Customers under ids of their own, with headers that our own columns have too."""
    rows = _coded(spark, d).select("source_row_number", F.struct(F.concat(F.lit("c"), F.col("source_row_number").cast("string")).alias("record_id"), F.col("patient").alias("lineage"), F.col("slide").alias("source_row_number")).alias("raw"))
    return records.build(rows, {"source_record_id": "record_id", "slide_id": "source_row_number"}, "train", "m", unicode=False)


_RAW = _CODED.replace("CASE WHEN code IS NOT NULL THEN 'tcga-02-'", "CASE c_custkey % 4 WHEN 0 THEN 'TCGA-02-' || four WHEN 1 THEN ' tcga-02-' || four || '-01a ' WHEN 2 THEN 'TCGA-02-' || four || '-01A-01D-0001-01' ELSE 's' || four END AS slide, CASE c_custkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 'other' ELSE 'TCGA-02-' || four END AS patient, CASE WHEN code IS NOT NULL THEN 'tcga-02-'")


@_query(f"""SELECT c_custkey, sha256('{{"raw_values":{{"lineage":' || coalesce('"' || patient || '"', 'null') || ',"record_id":"c' || c_custkey || '","source_row_number":"' || slide || '"}}}}') AS raw_values_digest FROM ({_RAW})""")
def q_raw_digests(spark: SparkSession, d: str) -> DataFrame:
    return _manifest(spark, d).records.select(F.col("source_row_number").alias("c_custkey"), "raw_values_digest")


@_query(f"""WITH x AS (SELECT *, 'rec_src_m_' || substr(sha256('"' || lower(c_name) || '"'), 1, 16) AS record_id, '{barcode.PARSER_VERSION}' AS version FROM ({_CODED}) JOIN (SELECT c_custkey, c_name FROM customer) USING (c_custkey) WHERE direct <> derived AND direct NOT LIKE 'tcga%')
SELECT c_custkey, 'linconf_' || substr(sha256({_CONFLICT}), 1, 24) AS conflict_id, direct AS direct_value, derived AS derived_value FROM x""")
def q_conflict_ids(spark: SparkSession, d: str) -> DataFrame:
    names = _table(spark, d, "customer").select(F.col("c_custkey").alias("source_row_number"), "c_name")
    rows = _coded(spark, d).withColumn("patient", F.when(F.col("patient") == "other", "other").when(F.col("patient").isNotNull(), F.lower("patient"))).join(names, "source_row_number")
    b = records.build(rows, {"source_record_id": "c_name", "patient_id": "patient", "slide_id": "slide"}, "train", "m", unicode=False)
    return b.conflicts.where("semantic_field = 'patient_id'").join(b.records.select("record_id", "source_row_number"), "record_id").select(F.col("source_row_number").alias("c_custkey"), "conflict_id", "direct_value", "derived_value")


@_query(f"SELECT 'confirmed_patient_overlap' AS finding_type, 'confirmed' AS confirmation_level, 'violation' AS policy_outcome, 'test;train' AS partitions, (SELECT string_agg(record_id, ';' ORDER BY record_id) FROM ({_ORDERS}) o WHERE o.patient_id = p.v) AS record_ids, v AS matched_value FROM ({_P}) p")
def q_findings_csv(spark: SparkSession, d: str) -> DataFrame:
    found = detect.identifier_overlaps(order_records(spark, d, False), fields=("patient_id",))
    return findings_rows(policy.evaluate(found.findings, policy.profile()), found.members).select("finding_type", "confirmation_level", "policy_outcome", "partitions", "record_ids", "matched_value")
