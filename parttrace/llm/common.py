"""What the operators share: scratch tables in the shared folder, vectorised word hashing, fixed-size id filters and connected components."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: White space of the word and normalisation contracts, as a Java regex class.
SPACE = r"[\x20\x09-\x0D]"
#: Bytes of text that one Arrow batch holds at most; Python workers' memory follows it.
BATCH_BYTES = 4 << 20
#: Bits of an id filter: its size is fixed at 2 MB whatever the input.
FILTER_BITS = 1 << 24
#: Most bits of a bitmap over hashes: 32 MB.
HASH_BITS = 1 << 28


#: Tables that are written between two rounds of the driver's garbage collection.
RELEASE = 6
_written = [0]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes as well as rows, so that very long texts don't add up in a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; one is set only where the session names none."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        folder = "/tmp/checkpoints/parttrace"
        spark.sparkContext.setCheckpointDir(folder)
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def stored(df: DataFrame, name: str, rows: int | None = None, each: int = 100_000) -> DataFrame:
    """``df`` written to the shared folder and read again: its lineage ends there and it outlives lost executors.

    ``rows``, about how many it has, if known: few rows are written by few tasks, one for ``each``, not by as many as a
    shuffle has partitions. The files go when the application ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    (df if rows is None else df.coalesce(1 + rows // each)).write.parquet(path)
    _written[0] += 1
    if _written[0] % RELEASE == 0:
        release(spark)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete what ``stored`` wrote for ``df``."""
    spark = df.sparkSession
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def release(spark: SparkSession) -> None:
    """Let the driver drop shuffle files, broadcasts and generated classes that no plan refers to any more.

    It does so only when its JVM collects garbage, which it may not for long: its own memory hardly shows what executors hold.
    """
    spark.sparkContext._jvm.System.gc()


def relax(spark: SparkSession) -> None:
    """Let executors collect garbage, as many tasks as they have cores: what their heaps took for shuffles before goes back to
    the machine before Python workers need it."""
    cores = spark.sparkContext.defaultParallelism
    spark.range(0, cores, 1, cores).select(F.java_method(F.lit("java.lang.System"), F.lit("gc"))).collect()


def id_filter(ids: DataFrame) -> DataFrame:
    """Of a one-column frame of ids, a table of bitmaps (512 rows, 2 MB at most) over the hashed ids."""
    h = F.pmod(F.xxhash64(ids[ids.columns[0]]), F.lit(FILTER_BITS)) + 1
    return stored(ids.groupBy(F.bitmap_bucket_number(h).alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(h)).alias("_bits")), "filter", 512)


def in_filter(df: DataFrame, column: str, bitmaps: DataFrame) -> DataFrame:
    """``df`` with a column ``_in``: whether the row's id may be in the filter. Broadcasts the bitmaps, whose size is fixed."""
    h = F.pmod(F.xxhash64(F.col(column)), F.lit(FILTER_BITS)) + 1
    at = F.bitmap_bit_position(h)
    byte = F.conv(F.hex(F.substring(F.col("_bits"), (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    hit = F.call_function("shiftright", byte, (at % 8).cast("int")).bitwiseAND(F.lit(1)) == 1
    return df.join(F.broadcast(bitmaps), F.bitmap_bucket_number(h) == F.col("_bucket"), "left").withColumn("_in", F.coalesce(hit, F.lit(False))).drop("_bucket", "_bits")


def maybe_in(df: DataFrame, column: str, bitmaps: DataFrame) -> DataFrame:
    """Rows whose id may be in the filter."""
    return in_filter(df, column, bitmaps).where("_in").drop("_in")


def hash_bits(hashes: DataFrame) -> np.ndarray:
    """Of a one-column frame of 64-bit hashes, a bitmap over their lowest bits, as bytes on the driver.

    It has 16 bits a hash, a power of two, ``HASH_BITS`` (32 MB) at most; beyond, it lets more other hashes through.
    """
    column = hashes.columns[0]
    bits = min(HASH_BITS, max(1 << 15, 1 << (16 * hashes.count()).bit_length()))
    at = F.col(column).bitwiseAND(F.lit(bits - 1)) + 1
    out = np.zeros((bits >> 15, 4096), np.uint8)
    for bucket, part in hashes.groupBy(F.bitmap_bucket_number(at).alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("b")).toLocalIterator():
        out[bucket - 1] = np.frombuffer(part, np.uint8)
    return out.ravel()


def among(hashes: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Which of the 64-bit hashes may be in the bitmap."""
    at = hashes.view(np.uint64) & np.uint64(8 * len(bits) - 1)
    return (bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def components(edges: DataFrame, rows: int | None = None) -> DataFrame:
    """Connected components of edges (a, b): rows (id, component) of every id that has an edge, component being its smallest id.

    Contracts the graph: each id points to its smallest neighbour, pointers are followed once more, edges are
    rewritten to what their ends point to, until none is left. Few rounds: each at least halves what has edges.
    Empty edges give an empty result; loops and repeated edges do no harm. ``rows``: about how many edges there are.
    """
    edges, labels = stored(edges.where("a != b").distinct(), "edges", rows), None
    while left := edges.count():
        both = edges.union(edges.select("b", "a")).toDF("id", "other")
        near = stored(both.groupBy("id").agg(F.min("other").alias("m")).select("id", F.least("id", "m").alias("p")), "near", 2 * left)
        up = near.toDF("p", "pp")
        step = stored(near.join(up.hint("merge"), "p", "left").select("id", F.coalesce("pp", "p").alias("p")), "step", 2 * left)
        if labels is None:
            labels, first = step.toDF("id", "component"), 2 * left
        else:
            moved = step.toDF("component", "p")
            labels = stored(labels.join(moved.hint("merge"), "component", "left").select("id", F.coalesce("p", "component").alias("component")), "labels", first)
        a, b = step.toDF("a", "pa"), step.toDF("b", "pb")
        merged = edges.join(a.hint("merge"), "a").join(b.hint("merge"), "b").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).where("a != b").distinct()
        edges = stored(merged, "edges", left)
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component")) if labels is None else labels


def numbered(df: DataFrame, name: str, *order: Column) -> DataFrame:
    """Rows numbered from 0 in the order of columns, by ranges: no task orders more than its own. One row per range is broadcast."""
    df = stored(df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()), "ranges")
    ranges = df.groupBy(F.shiftright("_at", 33).alias("_range")).agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # as many rows as shuffles have partitions
    ranges = ranges.select("_range", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"))
    df = df.withColumn("_range", F.shiftright("_at", 33)).join(F.broadcast(ranges), "_range")
    return df.withColumn(name, F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + F.col("_before")).drop("_at", "_range", "_before")


def running(df: DataFrame, keys: list[str], place: str, value: str, width: int = 1000) -> DataFrame:
    """``df`` with ``base``, the sum of ``value`` over the rows of equal keys whose number ``place`` is smaller.

    Sums of ``width`` places first, then those within, so that no window has all rows of a key. (keys, place) are distinct.
    """
    df = df.withColumn("_part", F.floor(F.col(place) / width))
    before = lambda *by: Window.partitionBy(*by).orderBy(place).rowsBetween(Window.unboundedPreceding, -1)
    parts = df.groupBy(*keys, "_part").agg(F.sum(value).alias("_sum"))
    whole = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(*keys, "_part", F.coalesce(F.sum("_sum").over(whole), F.lit(0)).alias("_base"))
    df = df.withColumn("_inside", F.coalesce(F.sum(value).over(before(*keys, "_part")), F.lit(0)))
    return df.join(parts.hint("merge"), [*keys, "_part"]).withColumn("base", F.col("_base") + F.col("_inside")).drop("_part", "_base", "_inside")


def words(column: str | Column) -> Column:
    """Number of words ``[^\\x20\\x09-\\x0D]+`` of a text; 0 for null. Counts positions where a word starts."""
    c = F.col(column) if isinstance(column, str) else column
    return F.coalesce(F.size(F.split(F.btrim(c, F.lit(" \t\n\x0b\x0c\r")), f"{SPACE}+")).cast("long") * (F.length(F.btrim(c, F.lit(" \t\n\x0b\x0c\r"))) > 0).cast("long"), F.lit(0).cast("long"))


# ---- vectorised hashing of words -------------------------------------------------------------------------------

_SEP = np.zeros(256, bool)
_SEP[[0x20, *range(0x09, 0x0E)]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
#: Of a lane of eight bytes, the bits that the first k bytes have.
_LANE = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
#: Longer spans are hashed one by one.
_LONG_SPAN = 64


def mixed(h: np.ndarray) -> np.ndarray:
    """The finishing steps of splitmix64: spreads each bit over all bits."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def text_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of an Arrow string column; null rows are empty."""
    import pyarrow as pa

    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def _lanes(raw: np.ndarray) -> np.ndarray:
    """The eight bytes from each byte on as one number; zeros follow the last byte."""
    return np.ndarray((len(raw) + 1,), "<u8", np.concatenate([raw, np.zeros(8, np.uint8)]).tobytes(), strides=(1,))


def span_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of spans of bytes, each eight bytes mixed in after the others; long spans' are BLAKE2 digests.

    No arithmetic of the bytes carries over to the hashes. Spans of the same length up to eight bytes never share one;
    of others two different ones do with a chance of about 2^-64. ``differing`` tells whether any do.
    """
    import hashlib

    n = end - start
    lanes = _lanes(raw)
    h = mixed((n.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ (lanes[start] & _LANE[np.minimum(n, 8)]))
    some, k = np.flatnonzero(n > 8), 8
    while len(some) and k < _LONG_SPAN:
        part = lanes[start[some] + k] & _LANE[np.minimum(n[some] - k, 8)]
        h[some] = mixed(h[some] * np.uint64(0xD6E8FEB86659FD93) ^ part)
        k += 8
        some = some[n[some] > k]
    for i in some.tolist():
        h[i] = int.from_bytes(hashlib.blake2b(raw[start[i] : end[i]].tobytes(), digest_size=8).digest(), "little")
    return h


def differing(raw: np.ndarray, start: np.ndarray, end: np.ndarray, like: np.ndarray) -> np.ndarray:
    """Numbers of the spans whose bytes aren't those of span ``like`` of them."""
    n = end - start
    lanes = _lanes(raw)
    wrong = n != n[like]
    some, k = np.flatnonzero(~wrong & (like != np.arange(len(n)))), 0
    while len(some) and k < _LONG_SPAN:
        keep = _LANE[np.minimum(n[some] - k, 8)]
        wrong[some] |= ((lanes[start[some] + k] ^ lanes[start[like[some]] + k]) & keep) != 0
        k += 8
        some = some[(n[some] > k) & ~wrong[some]]
    for i in some.tolist():
        wrong[i] = raw[start[i] : end[i]].tobytes() != raw[start[like[i]] : end[like[i]]].tobytes()
    return np.flatnonzero(wrong)


def distinct_spans(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """The distinct spans, and the number of each span's; told apart by their bytes, hashes only sort them."""
    _, one, inverse = np.unique(span_hashes(raw, start, end), return_index=True, return_inverse=True)
    whole = raw.tobytes()
    spans = [whole[a:b] for a, b in zip(start[one].tolist(), end[one].tolist(), strict=True)]
    for i in differing(raw, start, end, one[inverse]).tolist():  # spans that only share a hash
        inverse[i] = len(spans)
        spans.append(whole[start[i] : end[i]])
    return spans, inverse


def word_hashes(column, spans: bool = False):
    """64-bit hashes of all words of all rows, A-Z folded, and each row's first word: (hashes, firsts[rows + 1]).

    With ``spans`` also the words' first byte positions and those after their last.
    """
    raw, at = text_bytes(column)
    first = np.zeros(len(raw) + 1, bool)
    first[at] = True
    sep = _SEP[raw]
    begins, ends = ~sep, ~sep
    begins[1:] &= sep[:-1] | first[1:-1]
    ends[:-1] &= sep[1:] | first[1:-1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    h = span_hashes(_FOLD[raw], start, end) if len(start) else np.zeros(0, np.uint64)
    firsts = np.searchsorted(start, at)
    return (h, firsts, start, end) if spans else (h, firsts)


def trim_memory() -> None:
    """Give memory that a Python worker no longer uses back to the system; workers outlive their tasks."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        return
