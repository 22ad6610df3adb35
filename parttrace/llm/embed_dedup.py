"""Embedding near-dedup by a pivot-permutation index.

Reference points order the space: vectors of a bounded sample (those with the least hashed digests), chosen one after the
other, each farthest from those before it, and moved to the middle of their near copies. There is one for ``PER`` vectors
of the largest label, ``PIVOTS`` at most. Each distinct vector is described by its nearest reference points, nearest first.
Inverted lists hold, for each label and length, the vectors that have certain ``depth`` reference points among their
first ``prefix`` ones; the depth grows with the largest label so that lists stay short (``DEPTHS``: one of four points,
two of six, three of eight). Two vectors that share ``depth`` points or more are candidates and are verified once, by
cosine in double precision, in the list of the first points they share. Vectors of different lengths don't compare; where
no label has more than ``BLOCK`` vectors of a length, all of a label are one list.

Large groups of near copies: vectors within half the threshold's angle of one reference point all link with each other
(the angle is a metric), so this core's links are counted without any pair. Lists longer than ``BLOCK`` are dealt into
blocks and pairs of blocks, each a task of bounded size; blocks of one core don't meet. A block gives each vector's
number of links and one edge to its block component, never the pairs.

Equal vectors of a label are one class; its members link with each other. Labels must be equal and not null. Vectors
that are null, empty, zero, or hold null or non-finite components link with nothing. Recall against all pairs is
measured in the tests (0.9 or more is asked for). Rows with a null id stay alone with null component. Repeated rows are
vectors of their own with equal ids, and so are different vectors with one id. Empty input gives an empty result; extra
columns are ignored.
"""

from __future__ import annotations

from itertools import combinations
from math import acos, ceil, comb, cos

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

BLOCK, PER, PIVOTS = 1024, 16, 1024
#: Shared reference points that make a candidate, out of how many nearest ones; and how long lists may be on average.
DEPTHS, LIST = ((1, 4), (2, 6), (3, 8)), 512
#: Vectors, and components of them, that reference points are chosen from at most.
SAMPLE, SAMPLE_SIZE = 4096, 1 << 19
#: Rows of a table about lists or cores that are broadcast at most; beyond, it is merged.
SMALL = 10_000


def _spread(sample: np.ndarray, n: int, threshold: float) -> np.ndarray:
    """Reference points from unit vectors of ``sample``: each farthest from those before it, moved amid its near copies."""
    x = sample / np.linalg.norm(sample, axis=1, keepdims=True)
    chosen, near = [0], x @ x[0]
    while len(chosen) < min(n, len(x)):
        chosen.append(int(near.argmin()))
        near = np.maximum(near, x @ x[chosen[-1]])
    like = (x[chosen] @ x.T >= threshold) | (np.arange(len(x)) == np.array(chosen)[:, None])
    middle = like.astype(float) @ x
    return middle / np.linalg.norm(middle, axis=1, keepdims=True)


class Index:
    """Reference points by vector length, and how vectors of that length are described."""

    def __init__(self, threshold: float):
        self.core = cos(acos(threshold) / 2) + 1e-9
        self.points: dict[int, np.ndarray] = {}
        self.depth: dict[int, tuple[int, int]] = {}

    def add(self, d: int, points: np.ndarray, largest: int) -> None:
        fits = [(t, m) for t, m in DEPTHS if largest * comb(m, t) <= LIST * comb(len(points), t)]
        self.points[d], self.depth[d] = points, (fits or DEPTHS[-1:])[0]

    def describe(self, d: int, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each vector its nearest points in order, the keys of its lists and the point whose core it is in (or -1)."""
        if d not in self.points:
            return np.zeros((len(x), 1), np.int32), np.zeros((len(x), 1), np.int64), np.full(len(x), -1, np.int32)
        t, m = self.depth[d]
        near = x / np.linalg.norm(x, axis=1, keepdims=True) @ self.points[d].T
        order = np.argsort(-near, axis=1, kind="stable")[:, :m].astype(np.int32)
        core = np.where(near[np.arange(len(x)), order[:, 0]] >= self.core, order[:, 0], -1).astype(np.int32)
        some = np.sort(order, axis=1).astype(np.int64)
        keys = np.stack([sum(some[:, c] * PIVOTS ** (t - 1 - i) for i, c in enumerate(chosen)) for chosen in combinations(range(some.shape[1]), t)], 1)
        return order, keys, core


def _described(vectors: DataFrame, index: Index) -> DataFrame:
    names = ["k", "label", "d", "v", "weight"]

    def rows(batches):
        import pyarrow as pa

        for batch in batches:
            size = batch.column("d").to_numpy()
            flat = batch.column("v").to_numpy(zero_copy_only=False)
            near, keys, core = [None] * len(batch), [None] * len(batch), np.zeros(len(batch), np.int32)
            for d in np.unique(size):
                at = np.flatnonzero(size == d)
                o, k, core[at] = index.describe(int(d), np.stack(flat[at]).astype(float))
                for i, p, q in zip(at, o, k, strict=True):
                    near[i], keys[i] = p, q
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(near, pa.list_(pa.int32())), pa.array(keys, pa.list_(pa.int64())), pa.array(core)], [*names, "near", "keys", "core"])

    kinds = {f.name: f.dataType.simpleString() for f in vectors.schema}
    schema = ", ".join(f"{c} {kinds[c]}" for c in names) + ", near array<int>, keys array<bigint>, core int"
    return vectors.select(*names).mapInArrow(rows, schema)


def _dealt(described: DataFrame, shared: np.ndarray) -> DataFrame:
    """A row for each vector and list, for lists that may have two members."""
    bits = described.sparkSession.sparkContext.broadcast(shared)
    lists = described.withColumn("names", F.transform("keys", lambda k: F.xxhash64("label", "d", k)))

    def rows(batches):
        import pyarrow as pa

        for batch in batches:
            m = np.diff(batch.column("keys").offsets.to_numpy())
            key, name = batch.column("keys").flatten(), batch.column("names").flatten().to_numpy()
            keep = np.flatnonzero(C.among(name, bits.value))
            owner = pa.array(np.repeat(np.arange(len(batch)), m)[keep])
            own = [batch.column(c).take(owner) for c in ("k", "label", "d", "v", "weight", "near", "core")]
            yield pa.RecordBatch.from_arrays([*own, key.take(pa.array(keep))], ["k", "label", "d", "v", "weight", "near", "core", "key"])

    kinds = {f.name: f.dataType.simpleString() for f in described.schema}
    schema = ", ".join(f"{c} {kinds[c]}" for c in ("k", "label", "d", "v", "weight", "near", "core")) + ", key bigint"
    return lists.select("k", "label", "d", "v", "weight", "near", "core", "keys", "names").mapInArrow(rows, schema)


def _block_links(pdf, threshold: float, depths: dict[int, tuple[int, int]]):
    """Of a list, or of a pair of its blocks: per vector the weight of its links and its component in there.

    side: 0 for the first block, 1 for the second, 2 where all rows meet each other.
    """
    import pandas as pd

    x = np.stack(pdf["v"].to_numpy()).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    ids, weight, core, side = (pdf[c].to_numpy(np.int64) for c in ("k", "weight", "core", "side"))
    d, key = int(pdf["d"].iloc[0]), int(pdf["key"].iloc[0])
    whole = side[0] == 2
    a = side != 1
    b = a if whole else ~a
    # points up to the key's last one: pairs that share others among them have met, or will, in an earlier list
    need, _ = depths.get(d, (1, 1))
    near = np.stack(pdf["near"].to_numpy()).astype(np.int64)
    known, at = np.unique(np.where(near <= key % PIVOTS, near, PIVOTS), return_inverse=True)
    has = np.zeros((len(x), len(known)), np.float32)
    has[np.arange(len(x))[:, None], at.reshape(near.shape)] = 1
    has = has[:, known < PIVOTS]
    link = (has[a] @ has[b].T == need) & (x[a] @ x[b].T >= threshold)
    link &= (core[a][:, None] != core[b]) | (core[a] < 0)[:, None]
    if whole:
        np.fill_diagonal(link, False)
    count = np.zeros(len(x), np.int64)
    count[a] += link @ weight[b]
    if not whole:
        count[b] += weight[a] @ link
    label = ids.copy()
    big = np.iinfo(np.int64).max
    while True:  # smallest id over links, until nothing changes
        old = label.copy()
        label[a] = np.minimum(label[a], np.where(link, label[b], big).min(1, initial=big))
        label[b] = np.minimum(label[b], np.where(link, label[a][:, None], big).min(0, initial=big))
        if (label == old).all():
            break
    keep = count > 0
    return pd.DataFrame({"k": ids[keep], "links": count[keep], "to": label[keep]})


def _small(df: DataFrame) -> DataFrame:
    """``df``, to be broadcast if it has ``SMALL`` rows at most, else merged."""
    return F.broadcast(df) if df.limit(SMALL + 1).count() <= SMALL else df.hint("merge")


def _met(dealt: DataFrame, lists: DataFrame) -> DataFrame:
    """Rows of all lists with ``task``, the pair of blocks they meet in, and ``side``."""
    name = ["label", "d", "key"]
    long = C.stored(lists.where(F.col("n") > BLOCK).select(name), "long")
    if long.isEmpty():
        return dealt.withColumns({"task": F.lit(0).cast("long"), "side": F.lit(2)})
    short = dealt.join(_small(long), name, "left_anti").withColumns({"task": F.lit(0).cast("long"), "side": F.lit(2)})
    rows = C.stored(dealt.join(_small(long), name, "left_semi"), "rows")
    # a core with more than a block of members in a list has blocks of its own, all others are dealt together
    cores = C.stored(rows.where("core >= 0").groupBy(*name, "core").count().where(F.col("count") > BLOCK).select(*name, F.col("core").alias("own")), "cores")
    rows = rows.withColumn("own", F.col("core")).join(_small(cores.withColumn("large", F.lit(True))), [*name, "own"], "left").withColumn("own", F.when(F.col("large"), F.col("own")).otherwise(F.lit(-1))).drop("large")
    parts = rows.groupBy(*name, "own").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    parts = C.stored(parts, "parts")
    rows = rows.join(_small(parts), [*name, "own"]).withColumn("i", F.pmod(F.xxhash64("k"), F.col("blocks")).cast("int")).drop("blocks")
    blocks = parts.select(*name, "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("i"))
    x, y = blocks.toDF(*name, "p", "i"), blocks.toDF(*name, "q", "j")
    tasks = x.join(y, name).where("p < q or p = q and (i < j or p < 0 and i = j)").where("p < 0 or p != q")
    tasks = C.stored(tasks.withColumn("task", F.monotonically_increasing_id() + 1), "tasks")
    left = tasks.select(*name, F.col("p").alias("own"), "i", "task", F.when((F.col("p") == F.col("q")) & (F.col("i") == F.col("j")), F.lit(2)).otherwise(F.lit(0)).alias("side"))
    right = tasks.where("p != q or i != j").select(*name, F.col("q").alias("own"), F.col("j").alias("i"), "task", F.lit(1).alias("side"))
    met = rows.join(left.union(right).hint("merge"), [*name, "own", "i"]).drop("own", "i")
    return short.unionByName(met)


def near_duplicates(vectors: DataFrame, id_column: str = "vec_id", vector: str = "embedding", label: str = "label", threshold: float = 0.93) -> DataFrame:
    """Per vector: id, n_links, component_id (smallest id that links reach), kept (id = component_id)."""
    spark = vectors.sparkSession
    C.bounded_batches(spark)
    v = F.transform(F.col(vector), lambda e: e.cast("double"))
    own = vectors.select(F.col(id_column).cast("long").alias("id"), F.col(label).alias("label"), v.alias("v"))
    fine = F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & F.forall("v", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))) & F.exists("v", lambda e: e != 0)
    own = C.stored(own.withColumn("fine", F.coalesce(fine, F.lit(False))).withColumn("h", F.when(F.col("fine"), F.sha2(F.concat_ws(",", F.col("label").cast("string"), F.to_json("v")), 256))), "vectors")
    n = own.count()
    classes = own.where("fine").groupBy("h").agg(F.min("id").alias("cid"), F.count(F.lit(1)).alias("weight"))
    # ids may repeat over different vectors, so classes have numbers of their own, fixed when they are written
    classes = C.stored(classes.withColumn("k", F.monotonically_increasing_id()), "classes", n)
    heads = own.where("fine").join(classes, "h").where("id = cid").dropDuplicates(["k"]).select("k", "h", "label", "v", "weight", F.size("v").alias("d"))
    heads = C.stored(heads, "heads", n, 10_000)
    index = Index(threshold)
    for d, largest in heads.groupBy("d", "label").count().groupBy("d").agg(F.max("count").alias("n")).where(F.col("n") > BLOCK).orderBy("d").collect():
        some = heads.where(F.col("d") == d).orderBy(F.xxhash64("h"), "h").limit(min(SAMPLE, max(1, SAMPLE_SIZE // d)))
        index.add(d, _spread(np.array([r["v"] for r in some.select("v").collect()], float), max(4, min(PIVOTS, ceil(largest / PER))), threshold), largest)
    described = C.stored(_described(heads, index), "described")
    lists = described.select("label", "d", F.explode("keys").alias("key")).groupBy("label", "d", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    lists = C.stored(lists, "lists", n)
    dealt = _dealt(described, C.hash_bits(lists.select(F.xxhash64("label", "d", "key").alias("name"))))
    depths = index.depth
    met = _met(dealt, lists).groupBy("label", "d", "key", "task")
    links = met.applyInPandas(lambda pdf: _block_links(pdf, threshold, depths), "k long, links long, to long")
    cores = described.where("core >= 0").groupBy("label", "d", "core").agg(F.sum("weight").alias("all"), F.min("k").alias("to"), F.count(F.lit(1)).alias("n")).where("n > 1")
    within = described.where("core >= 0").select("k", "label", "d", "core", "weight").join(_small(C.stored(cores, "cores")), ["label", "d", "core"])
    links = C.stored(links.union(within.select("k", F.col("all") - F.col("weight"), "to")), "links", n, 5_000)
    component = C.components(links.select(F.col("k").alias("a"), F.col("to").alias("b")), n).toDF("k", "root")
    per_class = classes.join(links.groupBy("k").agg(F.sum("links").alias("links")), "k", "left").join(component, "k", "left")
    per_class = C.stored(per_class.select("h", "cid", F.coalesce("root", "k").alias("root"), (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links")), "named", n)
    least = per_class.groupBy("root").agg(F.min("cid").alias("component_id"))
    per_class = per_class.join(least, "root").select("h", "n_links", "component_id")
    out = own.select("id", "h").join(per_class, "h", "left")
    out = out.select(F.col("id").alias(id_column), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col(id_column) == F.col("component_id"), F.lit(False)))
