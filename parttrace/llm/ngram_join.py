"""N-gram Jaccard join: which documents share so many word n-grams that they count as near copies.

Prefix filtering, rarest n-grams first: of a set of n hashed n-grams, ordered by (corpus frequency, hash), two sets of
Jaccard similarity t or more share one of their first n - ceil(t n) + 1. Candidates meet on these prefix n-grams in the
list of each, pass a length filter, a positional filter and a suffix filter, and are verified once per pair on whole
texts. The suffix filter bounds from below how many elements only one of the two suffixes after the meeting place has,
by their parities over 128 parts of the hash range; pairs that pass are bounded once more by the parities of their whole
sets, over as many parts as a set has elements.

Large groups: equal sets are one class from the start. In each n-gram's list all members first meet one leader (rows:
one per posting), which links groups of near copies, for a few turns with other leaders; then only members that are
still outside their list's main component meet the rest of their list. Every pair that could link and is not yet
connected is verified, so components are exact, though no group's pairs are all made.

N-grams that occur in one prefix only are most of all; they are counted by their hashes alone and don't become postings,
but for some that a filter lets through (its bits follow their number up to 32 MB; beyond, it lets more through). Joins
of what grows with the corpus carry a merge hint, so that the plan is the same at every size.

Null or empty texts, or texts without words, have an empty set (size 0) and link with nothing. A text with fewer words
than n is one n-gram. A row without id links with copies of its text only. Repeated rows are returned as often as they
occur. Extra columns are ignored.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

#: Buckets of hashed n-grams over which corpus frequencies are counted: 2 MB, whatever the corpus.
BUCKETS = 1 << 18
#: Parts of the hash range whose parities a posting carries, in two numbers.
PARTS = 128
#: Turns in which list members meet one leader only; whoever is still apart then meets the whole list, so no link is lost.
TURNS = 4
#: Turns end early once the whole lists have fewer than so many open pairs per posting.
FEW = 1000
#: Texts that are described or compared at a time.
ROWS = 128


def shingles(column, n: int) -> list[np.ndarray]:
    """Of each row, the sorted distinct 64-bit hashes of its word n-grams."""
    h, first = C.word_hashes(column)
    out = []
    grams = None
    if len(h) >= n:
        grams = np.zeros(len(h) - n + 1, np.uint64)
        for k in range(n):
            grams += h[k : len(h) - n + 1 + k] * np.uint64(pow(0xD6E8FEB86659FD93, k + 1, 1 << 64))
        grams = C.mixed(grams)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= n:
            g = np.sort(grams[a : b - n + 1])
            out.append(g if len(g) < 2 else g[np.concatenate([[True], g[1:] != g[:-1]])])
        elif b > a:
            short = np.array([b - a], np.uint64)
            for k in range(a, b):
                short = C.mixed(short * np.uint64(0xA0761D6478BD642F) + h[k : k + 1])
            out.append(short)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _bucket(g: np.ndarray) -> np.ndarray:
    return (g >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64)


def _slices(batch):
    for k in range(0, len(batch), ROWS):
        yield batch.slice(k, ROWS)


def frequencies(texts: DataFrame, n: int) -> np.ndarray:
    """In how many texts n-grams of each hash bucket occur, over all texts; ``BUCKETS`` numbers reach the driver."""

    def count(batches):
        import pyarrow as pa

        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for part in _slices(batch):
                total += np.bincount(_bucket(np.concatenate([np.zeros(0, np.uint64), *shingles(part.column(0), n)])), minlength=BUCKETS)
        C.trim_memory()
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], ["bucket", "k"])

    got = texts.select("text").mapInArrow(count, "bucket int, k long").groupBy("bucket").agg(F.sum("k").alias("k")).toPandas()
    out = np.zeros(BUCKETS, np.int64)
    out[got["bucket"].to_numpy(np.int64)] = got["k"].to_numpy(np.int64)
    return out


def _parities(g: np.ndarray) -> np.ndarray:
    """Parities of a set over a power of two of parts, ``PARTS`` at least: bits of 64-bit numbers."""
    parts = max(PARTS, 1 << (len(g) - 1).bit_length() if len(g) else 0)
    odd = (np.bincount((g & np.uint64(parts - 1)).astype(np.int64), minlength=parts) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little").view(np.int64)


def describe(texts: DataFrame, id_column: str, n: int, percent: int) -> DataFrame:
    """Per document: size and digest of its set, its prefix n-grams rarest first and its parities."""
    spark = texts.sparkSession
    often = spark.sparkContext.broadcast(frequencies(texts, n))

    def rows(batches):
        import hashlib

        import pyarrow as pa

        lists = lambda xs: pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, xs)]).astype(np.int32)), pa.array(np.concatenate([np.zeros(0, np.int64), *xs])))
        for batch in batches:
            for part in _slices(batch):
                prefix, size, digest, odd = [], [], [], []
                for g in shingles(part.column(1), n):
                    m = len(g)
                    size.append(m)
                    digest.append(hashlib.blake2b(g.tobytes(), digest_size=16).digest())
                    keep = m - (percent * m + 99) // 100 + 1 if m else 0
                    prefix.append(g[np.lexsort((g, often.value[_bucket(g)]))[:keep]].view(np.int64))
                    odd.append(_parities(g))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(size, pa.int64()), pa.array(digest, pa.binary()), lists(prefix), lists(odd)], ["id", "n", "digest", "prefix", "odd"])
        C.trim_memory()

    return texts.select(F.col(id_column).cast("long").alias("id"), F.col("text")).mapInArrow(rows, "id long, n long, digest binary, prefix array<long>, odd array<long>")


def _postings(heads: DataFrame, shared: np.ndarray) -> DataFrame:
    """Rows (gram, id, n, place, s0, s1): prefix n-grams that may be in the bitmap, and the parities of the elements after.

    s0 and s1 are those of the whole set, folded to ``PARTS``, without those of the n-grams up to the place.
    """
    bits = heads.sparkSession.sparkContext.broadcast(shared)

    def rows(batches):
        import pyarrow as pa

        for batch in batches:
            m = np.diff(batch.column(2).offsets.to_numpy()).astype(np.int64)
            gram = batch.column(2).flatten().to_numpy()
            at = np.cumsum(m) - m
            whole = np.zeros((len(batch), 2), np.uint64)
            cuts = batch.column(3).offsets.to_numpy() - batch.column(3).offsets[0].as_py()
            odd = batch.column(3).flatten().to_numpy().view(np.uint64)
            for k in range(2):  # every other number folds onto one of two
                own = np.where(np.arange(len(odd)) % 2 == k, odd, np.uint64(0))
                whole[:, k] = np.bitwise_xor.reduceat(own, cuts[:-1]) if len(odd) else 0
            owner = np.repeat(np.arange(len(batch)), m)
            part = (gram.view(np.uint64) & np.uint64(PARTS - 1)).astype(np.uint64)
            after = []
            for k in range(2):
                bit = np.where(part >> np.uint64(6) == k, np.uint64(1) << (part & np.uint64(63)), np.uint64(0))
                so_far = np.bitwise_xor.accumulate(bit) if len(bit) else bit
                before = np.where(at > 0, so_far[np.maximum(at, 1) - 1], np.uint64(0)) if len(bit) else np.zeros(len(m), np.uint64)
                after.append((so_far ^ before[owner] ^ whole[owner, k]).view(np.int64))
            ids, n = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            place = np.arange(len(gram)) - at[owner]
            keep = np.flatnonzero(C.among(gram, bits.value))
            owner = owner[keep]
            columns = (gram[keep], ids[owner], n[owner].astype(np.int32), place[keep].astype(np.int32), *(x[keep] for x in after))
            yield pa.RecordBatch.from_arrays(list(map(pa.array, columns)), ["gram", "id", "n", "place", "s0", "s1"])
        C.trim_memory()

    return heads.select("id", "n", "prefix", "odd").mapInArrow(rows, "gram long, id long, n int, place int, s0 long, s1 long")


def verified(pairs: DataFrame, texts: DataFrame, id_column: str, n: int, percent: int) -> DataFrame:
    """Of distinct pairs (a, b), those whose whole texts are similar. Only texts that occur in a pair are shuffled."""
    wanted = C.id_filter(pairs.select("a").union(pairs.select("b")))
    source = C.maybe_in(texts.select(F.col(id_column).cast("long").alias("id"), "text"), "id", wanted)
    both = pairs.join(source.toDF("b", "tb").hint("merge"), "b").join(source.toDF("a", "ta").hint("merge"), "a").select("a", "b", "ta", "tb")

    def check(batches):
        import pyarrow as pa

        for batch in batches:
            for part in _slices(batch):
                keep = []
                for x, y in zip(shingles(part.column(2), n), shingles(part.column(3), n), strict=True):
                    common = len(np.intersect1d(x, y, assume_unique=True))
                    keep.append(bool(common) and 100 * common >= percent * (len(x) + len(y) - common))
                got = part.filter(pa.array(keep, pa.bool_()))
                yield pa.RecordBatch.from_arrays([got.column(0), got.column(1)], ["a", "b"])
        C.trim_memory()

    return both.mapInArrow(check, "a long, b long")


def _most_apart(nx: Column, ny: Column, percent: int) -> tuple[Column, Column]:
    """How many elements two sets that link share at least, and how many only one of them has at most."""
    least = F.ceil((nx + ny) * percent / F.lit(100 + percent) - F.lit(1e-6))
    return least, nx + ny - 2 * least


def _possible(percent: int, x: str = "x", y: str = "y") -> Column:
    """Length, positional and suffix filter of two postings x and y of one n-gram, taken as the first that they share.

    A pair that links isn't dropped in the list of the first n-gram they share; in later lists it may be.
    """
    of = lambda s, c: F.col(f"{s}.{c}")
    nx, ny = of(x, "n"), of(y, "n")
    least, _ = _most_apart(nx, ny, percent)
    after_x, after_y = nx - of(x, "place") - 1, ny - of(y, "place") - 1
    length = (100 * F.least(nx, ny)) >= percent * F.greatest(nx, ny)
    place = F.least(after_x, after_y) + 1 >= least
    apart = F.bit_count(of(x, "s0").bitwiseXOR(of(y, "s0"))) + F.bit_count(of(x, "s1").bitwiseXOR(of(y, "s1")))
    return length & place & (apart <= after_x + after_y - 2 * (least - 1))


def _near_enough(pairs: DataFrame, heads: DataFrame, percent: int) -> DataFrame:
    """Of pairs (a, b), those whose whole sets' parities differ in no more parts than they may have elements apart."""
    side = heads.select("id", "n", "odd")
    both = pairs.join(side.toDF("b", "nb", "ob").hint("merge"), "b").join(side.toDF("a", "na", "oa").hint("merge"), "a")
    # the longer array folds onto the shorter one: both are powers of two
    fold = lambda long, short: f"transform(sequence(0, size({short}) - 1), k -> aggregate(sequence(0, size({long}) div size({short}) - 1), 0L, (s, j) -> s ^ element_at({long}, int(k + 1 + j * size({short})))))"
    oa = F.expr(f"if(size(oa) > size(ob), {fold('oa', 'ob')}, oa)")
    ob = F.expr(f"if(size(ob) > size(oa), {fold('ob', 'oa')}, ob)")
    apart = F.aggregate(F.zip_with(oa, ob, lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda s, d: s + d)
    return both.where(apart <= _most_apart(F.col("na"), F.col("nb"), percent)[1]).select("a", "b")


def ngram_jaccard(docs: DataFrame, id_column: str = "doc_id", n: int = 5, percent: int = 80) -> DataFrame:
    """Rows (id_column, n_shingles, component_id) of all documents; links hold from ``percent`` hundredths of Jaccard on.

    component_id is the smallest id that links reach, the document's own included. Without rows the result is empty.
    """
    spark = docs.sparkSession
    C.bounded_batches(spark)
    C.relax(spark)
    texts = docs.select(id_column, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    described = C.stored(describe(texts, id_column, n, percent), "sets")
    documents = described.count()
    some = described.where("n > 0")
    classes = C.stored(some.groupBy("n", "digest").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies")), "classes", documents)
    # only rows of classes with copies cross a shuffle for their class's head
    marked = C.in_filter(some, "digest", C.id_filter(classes.where("copies > 1").select("digest")))
    alone = marked.where("not _in and id is not null").select("id", "n", "prefix", "odd")
    own = ["id", "n", "digest"]
    copies = marked.where("_in").join(classes.select(F.col("rep").alias("id"), "n", "digest").hint("merge"), own, "left_semi").dropDuplicates(own).select("id", "n", "prefix", "odd")
    heads = C.stored(alone.union(copies), "heads", documents, 10_000)
    grams = heads.agg(F.sum(F.size("prefix"))).first()[0] or 0
    C.release(spark)
    lists = C.stored(heads.select(F.explode("prefix").alias("gram")).groupBy("gram").count().where("count > 1").select("gram"), "lists", grams, 500_000)
    # most n-grams have no list; a filter drops nearly all of them before the shuffle
    postings = C.stored(_postings(heads, C.hash_bits(lists)).join(lists.hint("merge"), "gram"), "postings", grams // 4)
    C.release(spark)
    total = postings.count()
    member = F.struct("id", "n", "place", "s0", "s1")
    # a list's leader is the member with the least id: near copies agree on it in nearly all their lists
    known = postings.withColumn("component", F.col("id"))
    lead = postings.groupBy("gram").agg(F.min(member).alias("to"))
    tried, links, final, used = [], [], None, []
    turn, last = 1, total == 0
    while not last:
        if turn > 1:
            known = postings.join(final.hint("merge"), "id", "left").withColumn("component", F.coalesce("component", "id")) if final is not None else known
            known = C.stored(known, "known", total)
            used.append(known)
            # lists of two have met; lists in one component are done; a list's main component is its leader's
            state = known.groupBy("gram").agg(F.count(F.lit(1)).alias("m"), F.min_by("component", "id").alias("main"), F.min("component").alias("lo"), F.max("component").alias("hi")).where("m > 2 and lo != hi")
            known = C.stored(known.join(state.select("gram", "main").hint("merge"), "gram").withColumn("outside", F.col("component") != F.col("main")), "open", total)
            used.append(known)
            sizes = known.groupBy("gram").agg(F.count(F.lit(1)).alias("m"), F.count_if("outside").alias("o"))
            last = turn > TURNS or (sizes.agg(F.sum(F.col("m") * F.col("o"))).first()[0] or 0) <= FEW * total
        # each turn links list members to one that isn't in its list's main component yet; the last meets them all
        if not last:
            if turn > 1:
                near = F.struct(F.xxhash64("id", "gram", F.lit(turn)).alias("h"), member.alias("to"), F.col("component").alias("tc"))
                lead = known.where("outside").groupBy("gram").agg(F.min(near).alias("lead")).select("gram", "lead.to", "lead.tc")
            x = known.join(lead.hint("merge"), "gram").where("id != to.id" if turn == 1 else "component != tc")
            met = x.select(F.struct("id", "n", "place", "s0", "s1").alias("x"), F.col("to").alias("y"))
        else:
            x, y = known.where("outside").select("gram", "component", member.alias("x")), known.select("gram", F.col("component").alias("other"), member.alias("y"))
            met = x.join(y.hint("merge"), "gram").where("component != other").select("x", "y")
        pairs = met.where(_possible(percent)).select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")).distinct()
        for old in tried:
            pairs = pairs.join(old.hint("merge"), ["a", "b"], "left_anti")
        pairs = C.stored(pairs, "met", total)
        tried.append(pairs)
        candidates = pairs.count()
        pairs = C.stored(_near_enough(pairs, heads, percent), "pairs", candidates)
        C.release(spark)
        if not pairs.isEmpty():
            found = C.stored(verified(pairs, texts, id_column, n, percent), "links", candidates, 5_000)
            if not found.isEmpty():
                links.append(found)
                final = C.components(reduce(DataFrame.union, links), documents)
            C.release(spark)
        turn += 1
    # class by class, then document by document
    if final is not None:
        classes = C.stored(classes.join(final.toDF("rep", "component").hint("merge"), "rep", "left").select("n", "digest", F.coalesce("component", "rep").alias("component")), "named", documents)
    else:
        classes = classes.select("n", "digest", F.col("rep").alias("component"))
    for old in (heads, lists, postings, *used, *tried):
        C.discard(old)
    return (
        described.select("id", "n", "digest")
        .join(classes.hint("merge"), ["n", "digest"], "left")
        .select(F.col("id").alias(id_column), F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"))
    )
