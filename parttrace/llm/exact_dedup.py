"""Exact dedup against a persistent digest index, bucketed and sorted by hash.

The index is a table with one row per distinct normalised text: digest, keep_id and the batch that brought it. New data
is grouped by digest, sort-merge anti-joined with the index, and what is new is appended to the same buckets, so no
shuffle of the index is ever needed. A digest's first batch decides which row stays: its smallest id. The index outlives
its session: its files lie in a folder under the warehouse, in versions; compaction writes the next version with one
sorted file a bucket, and a version counts once it is whole.

Texts are equal when identical after each run of white space [\\x20\\x09-\\x0D] became one space (leading and trailing
runs too); null counts as empty. Digests are SHA-256 of the UTF-8 bytes. Rows with a null id have keep_id of their group
(null if no row of it has an id) and are not kept; repeated rows with one id share one decision. Empty input gives an
empty result and leaves the index as it was. Extra columns are ignored; a column called like one of ours does no harm.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

#: Files a bucket has on average, beyond which a call compacts the index.
FILES = 8


def normalised(text) -> F.Column:
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), f"{C.SPACE}+", " ")


def fingerprint(df: DataFrame) -> str:
    """Of the files that ``df`` reads: their paths, sizes and times. Other or changed files give another one."""
    spark = df.sparkSession
    path, conf = spark.sparkContext._jvm.org.apache.hadoop.fs.Path, spark.sparkContext._jsc.hadoopConfiguration()
    seen = hashlib.sha256()
    for name in sorted(df.inputFiles()):
        status = path(name).getFileSystem(conf).getFileStatus(path(name))
        seen.update(f"{name}\0{status.getLen()}\0{status.getModificationTime()}\n".encode())
    return seen.hexdigest()[:24]


class DigestIndex:
    """The persistent index ``name``; made when there is none. ``folder``: where its files lie, the warehouse if not given."""

    def __init__(self, spark: SparkSession, name: str, buckets: int = 64, folder: str | None = None):
        self.spark, self.name, self.buckets = spark, name, buckets
        self.root = f"{folder or spark.conf.get('spark.sql.warehouse.dir')}/{name}.index"
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._files = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._use(self._version())

    def _version(self) -> int:
        """The last version that is whole; 0 before any is."""
        if not self._files.exists(self._path(self.root)):
            return 0
        found = (s.getPath() for s in self._files.listStatus(self._path(self.root)))
        return max((int(p.getName()[1:]) for p in found if self._files.exists(self._path(p, "_SUCCESS"))), default=0)

    def _use(self, version: int) -> None:
        self.version = version
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")  # an external table: its files stay
        self.spark.sql(f"CREATE TABLE {self.name} (digest BINARY, keep_id BIGINT, batch STRING) USING parquet CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{self.root}/v{version}'")

    def _write(self, rows: DataFrame, name: str, **options: str) -> None:
        # by the bucket itself: each is written by one task, into one file
        rows.repartition(self.buckets, F.pmod(F.hash("digest"), F.lit(self.buckets))).write.format("parquet").bucketBy(self.buckets, "digest").sortBy("digest").mode("append").options(**options).saveAsTable(name)

    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        self._files.delete(self._path(self.root), True)

    def compact(self) -> None:
        """One sorted file a bucket. Until the new version is whole, the old one is the index."""
        old, version = self.version, self.version + 1
        self._files.delete(self._path(f"{self.root}/v{version}"), True)  # what a call that failed has left
        self._write(self.table(), f"{self.name}_next", path=f"{self.root}/v{version}")
        self.spark.sql(f"DROP TABLE {self.name}_next")
        self._use(version)
        self._files.delete(self._path(f"{self.root}/v{old}"), True)

    def add(self, docs: DataFrame, id_column: str = "doc_id", batch: str = "", batches: int = 1) -> DataFrame:
        """Deduplicate ``docs`` against the index and within themselves, append what is new.

        One row per document: id, keep_id, group_size (rows of this call with that text), kept, text_sha256. With
        ``batches`` the rows are added in so many batches in the order of ids, each against those before it; the result
        is the same.
        """
        own = docs.select(F.col(id_column).cast("long").alias("id"), F.unhex(F.sha2(normalised(F.col("text")), 256)).alias("digest"))
        own = C.stored(own, "digests")
        n = own.count()
        shares = [k / batches for k in range(1, batches)]
        cuts = [c for c in (own.agg(F.percentile_approx("id", shares)).first()[0] if shares else None) or [] if c is not None]
        groups = []
        for k in range(len(cuts) + 1):
            part = own
            if k < len(cuts):
                part = part.where(F.col("id") <= cuts[k])
            if k:  # the last batch has the rows without id
                part = part.where((F.col("id") > cuts[k - 1]) | F.col("id").isNull() if k == len(cuts) else F.col("id") > cuts[k - 1])
            groups.append(C.stored(part.groupBy("digest").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("group_size")), "groups", n))
            fresh = groups[-1].where("least is not null").hint("merge").join(self.table(), "digest", "left_anti")
            self._write(C.stored(fresh.select("digest", F.col("least").alias("keep_id"), F.lit(batch).alias("batch")), "fresh", n), self.name)
        if len(self.table().inputFiles()) > FILES * self.buckets:
            self.compact()
        sizes = groups[0].select("digest", "group_size")
        for more in groups[1:]:
            sizes = sizes.union(more.select("digest", "group_size"))
        if groups[1:]:
            sizes = sizes.groupBy("digest").agg(F.sum("group_size").alias("group_size"))
        found = sizes.hint("merge").join(self.table().select("digest", "keep_id"), "digest", "left")
        found = C.stored(found.select("digest", "keep_id", "group_size"), "found", n)
        # both sides are shuffled here, so a digest that a third of all rows have is split over tasks
        return own.join(found, "digest").select(
            F.col("id").alias(id_column), "keep_id", "group_size", F.coalesce(F.col("id") == F.col("keep_id"), F.lit(False)).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256")
        )
