"""Mixing sources to target weights, with DataFrame functions only.

Each source's texts, in a pseudorandom order, are one stream of words, packed into blocks of ``block`` words; the words
left over are a short last block. A source has as many slots as its target needs. Output shards of equal size draw their
source counts: each of a shard's slots falls to a source with the chance of its share of all slots, so a shard's counts
are multinomial. Draws beyond a source's slots are settled, in the order of shards, to sources that fewer were drawn of,
so that targets are met. A shard's draws of a source take the source's next indices; index i of a pass goes through that
source's and pass's own pseudorandom permutation, a Feistel network of four rounds that walks until it is back in range,
and slots join blocks by the index it gives. The short block comes last in each pass.

Targets: sources in code point order, null last, weigh 3, 1, 2, repeating, and share ``percent`` hundredths of all words;
a target stops at ``most`` times its source's words and the excess is shared again by weight until none is above.
The last slot of a source takes only the words that its target still lacks, so its words are its target rounded down.

Everything is a function of ids, so reruns agree. Null and empty texts have size 0 and are never taken. Rows with equal or
null ids are told apart by their text only; repeated rows share what their words are taken. Empty input gives an empty result.
Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

BLOCK = 256
#: Rows of a source that one window orders.
PACK_ROWS = 1000
#: Slots that one row makes when slots are spread out.
SPREAD = 4096
#: Slots of the line on which a draw finds its source, that are looked up together.
STRETCH = 256
#: Steps of a permutation's walk: fewer than half of the numbers it walks over are out of range.
WALK = 64


def targets(sizes: DataFrame, weights=(3, 1, 2), percent: int = 150, most: int = 2) -> DataFrame:
    """Per source: its rank sid, source_size and target. Only two sums per turn reach the driver."""
    totals = C.stored(sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("docs")), "totals")
    ranked = C.numbered(totals, "sid", F.col("source").asc_nulls_last())
    ranked = C.stored(ranked.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("sid") % len(weights) + 1).cast("int")).cast("double")), "sources")
    cap = (most * F.col("source_size")).cast("double")
    budget = (totals.agg(F.sum("source_size")).first()[0] or 0) * percent / 100
    share, capped = 0.0, -1
    while True:  # each turn caps at least one source more
        full = F.col("weight") * share >= cap
        row = ranked.agg(F.count_if(full), F.sum(F.when(full, cap).otherwise(0.0)), F.sum(F.when(full, 0.0).otherwise(F.col("weight")))).first()
        if row[0] == capped or not row[2]:
            break
        capped, share = row[0], (budget - row[1]) / row[2]
    return ranked.select("sid", "source", "source_size", "docs", F.least(F.col("weight") * share, cap).alias("target"))


def mix(docs: DataFrame, id_column: str = "doc_id", block: int = BLOCK, shards: int = 64, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """(per document: id, size, source_size, target, taken; per slot: shard, sid, source, block, words of it that are taken)."""
    sizes = docs.select(F.col(id_column).alias("id"), F.col("source").cast("string").alias("source"), C.words(F.col("text").cast("string")).alias("size"), F.xxhash64("text", F.col(id_column)).alias("h"))
    sizes = C.stored(sizes, "sizes")
    sources = C.stored(targets(sizes), "targets")
    key = F.expr("sources.source <=> sizes.source")
    # pack: word offsets are sums within a pack plus those of the packs before it, so no source is ordered in one task
    n_packs = F.ceil(F.col("docs") / PACK_ROWS)
    placed = sizes.alias("sizes").join(F.broadcast(sources.alias("sources")) if sources.count() <= 10_000 else sources.alias("sources"), key)
    placed = placed.select("id", "size", "h", "sid", "source_size", "target", F.pmod(F.xxhash64("h", F.lit(seed)), n_packs).alias("pack"))
    packs = C.running(placed.groupBy("sid", "pack").agg(F.sum("size").alias("words")), ["sid"], "pack", "words")
    packs = C.stored(packs.select("sid", "pack", "base"), "packs")
    inside = F.coalesce(F.sum("size").over(Window.partitionBy("sid", "pack").orderBy("h", "id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = placed.withColumn("inside", inside).join(packs, ["sid", "pack"]).withColumn("start", F.col("inside") + F.col("base"))
    placed = C.stored(placed.select(F.monotonically_increasing_id().alias("row"), "id", "size", "sid", "source_size", "target", "start"), "placed")
    slots = C.stored(_slots(sources, block, shards, seed), "slots")
    # join blocks by index
    pieces = placed.where("size > 0").select("row", "sid", "size", "start", F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block))).alias("block"))
    drawn = slots.groupBy("sid", "block", "words").agg(F.count(F.lit(1)).alias("times"))
    least = F.greatest(F.col("start"), F.col("block") * block)
    words = F.greatest(F.lit(0), F.least(F.col("start") + F.col("size"), F.col("block") * block + F.col("words")) - least) * F.col("times")
    taken = pieces.join(drawn, ["sid", "block"]).groupBy("row").agg(F.sum(words).alias("taken"))
    out = placed.join(taken, "row", "left").select(F.col("id").alias(id_column), "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
    return out, slots.join(sources.select("sid", "source"), "sid").select("shard", "sid", "source", "block", "words")


def _draws(per: DataFrame, shards: int, seed: int) -> DataFrame:
    """Per shard and source: how many of its slots fall to it, and the first of the source's indices that they take."""
    spark = per.sparkSession
    line = C.stored(C.running(per.where("n > 0").select("sid", "n", F.lit(0).alias("all")), ["all"], "sid", "n").drop("all"), "line")
    total = line.agg(F.sum("n")).first()[0] or 0
    spans = line.withColumn("stretch", F.explode(F.expr(f"sequence(base div {STRETCH}, (base + n - 1) div {STRETCH})")))
    slots = spark.range(total).select(F.expr(f"id * {shards}L div {max(1, total)}L").alias("shard"), F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(max(1, total))).alias("at"))
    fallen = slots.withColumn("stretch", F.expr(f"at div {STRETCH}")).join(spans.hint("merge"), "stretch").where("at >= base and at < base + n")
    drawn = C.stored(fallen.groupBy("sid", "shard").agg(F.count(F.lit(1)).alias("drawn")), "drawn")
    before = Window.partitionBy("sid").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # a row for each shard
    drawn = drawn.join(line.select("sid", "n").hint("merge"), "sid").withColumn("first", F.coalesce(F.sum("drawn").over(before), F.lit(0)))
    drawn = C.stored(drawn.withColumn("count", F.greatest(F.lit(0), F.least("drawn", F.col("n") - F.col("first")))), "counts")
    # slots that were drawn beyond a source's, by shard, settle what other sources lack
    free = {r["shard"]: r["free"] for r in drawn.groupBy("shard").agg(F.sum(F.col("drawn") - F.col("count")).alias("free")).collect()}
    ends, end = [], 0
    for shard in range(shards - 1):
        end += free.get(shard, 0)
        ends.append(end)
    lacks = line.select("sid", "n").join(drawn.groupBy("sid").agg(F.sum("count").alias("have")).hint("merge"), "sid", "left")
    lacks = lacks.select("sid", F.coalesce("have", F.lit(0)).alias("first"), (F.col("n") - F.coalesce("have", F.lit(0))).alias("lack"), F.lit(0).alias("all")).where("lack > 0")
    lacks = C.running(lacks, ["all"], "sid", "lack").withColumn("k", F.explode(F.expr("sequence(0L, lack - 1)")))
    settled = F.size(F.filter(F.array(*map(F.lit, ends)), lambda e: e <= F.col("base") + F.col("k"))) if ends else F.lit(0)
    more = lacks.select("sid", settled.cast("long").alias("shard"), (F.col("first") + F.col("k")).alias("first"), F.lit(1).cast("long").alias("count"))
    return drawn.where("count > 0").select("sid", "shard", "first", "count").union(more)


def _permuted(place: str, n: str, seed: int) -> Column:
    """The place, below ``n``, that the permutation of (sid, turn) gives: rounds change a number's high or low bits by the others."""
    low = f"greatest(0, length(bin({n} - 1))) div 2"
    high = f"length(bin({n} - 1)) - bits"
    rounds = f"""x -> aggregate(sequence(1, 4), x, (y, r) -> if(r % 2 = 1,
        y ^ shiftleft(xxhash64(y & (shiftleft(1L, bits) - 1), sid, turn, r, {seed}) & (shiftleft(1L, {high}) - 1), bits),
        y ^ (xxhash64(shiftright(y, bits), sid, turn, r, {seed}) & (shiftleft(1L, bits) - 1))))"""
    once = lambda x: f"transform(array({x}), {rounds})[0]"
    return F.expr(f"if({n} < 2, 0L, transform(array(int({low})), bits -> aggregate(sequence(1, {WALK}), {once(place)}, (z, s) -> if(z < {n}, z, {once('z')})))[0])")


def _slots(sources: DataFrame, block: int, shards: int, seed: int) -> DataFrame:
    """Per slot: sid, shard, the block that the source's permutation gives it, and how many of the block's words it takes."""
    per = sources.where("source_size > 0").select("sid", "source_size", F.floor("target").alias("goal"))
    per = per.withColumns({"whole": F.floor(F.col("source_size") / block), "passes": F.floor(F.col("goal") / F.col("source_size"))})
    per = per.withColumns({"blocks": F.ceil(F.col("source_size") / block), "rest": F.col("goal") - F.col("passes") * F.col("source_size")})
    per = C.stored(per.withColumn("n", F.col("passes") * F.col("blocks") + F.ceil(F.col("rest") / block)), "per")
    spread = _draws(per, shards, seed).join(per.hint("merge"), "sid")
    spread = spread.withColumn("from", F.explode(F.expr(f"sequence(first, first + count - 1, {SPREAD}L)"))).repartition("sid", "from")
    slot = spread.withColumn("i", F.explode(F.expr(f"sequence(from, least(first + count, from + {SPREAD}) - 1)")))
    slot = slot.withColumns({"turn": F.floor(F.col("i") / F.col("blocks")), "place": F.col("i") % F.col("blocks")})
    slot = slot.withColumn("block", F.when(F.col("place") < F.col("whole"), _permuted("place", "whole", seed)).otherwise(F.col("whole")))
    full = F.least(F.lit(block), F.col("source_size") - F.col("block") * block)
    left = F.col("rest") - F.col("place") * block  # of the last pass
    words = F.when(F.col("turn") < F.col("passes"), full).otherwise(F.least(full, left))
    return slot.select("sid", "shard", "block", words.cast("long").alias("words"))
