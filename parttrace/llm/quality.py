"""Quality classifier: Bradley-Terry pairwise ranking.

Every pair of a good and a poor labelled text is a preference; the mean logistic loss on their scores' differences gives
the weights of a document score, and the score's quantile at the share of poor texts is the threshold. Features are
shares of kinds of characters, shapes and repetition of words and lines, each as a step function over its quantiles, so
that a score is a sum of one curve per feature.

All labelled rows count in the quantiles, the loss, its gradient and the threshold. Each text's features are computed
once and stored; executors keep the labelled ones and send sums whose size doesn't depend on the rows. Pairs needn't be
listed: a text meets the other label's scores as a histogram of ``NODES`` nodes, each score shared between its two
neighbours. Shares and gradients are rounded to multiples of a power of two, so sums don't depend on the rows' order.

Null and empty texts have features of zeros (and so a score). Very long texts are read whole, their bytes a piece at a
time. Empty input gives an empty result. Without
labelled rows of both kinds all scores are 0.5. Repeated rows get equal scores. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

#: Cuts of each feature's curve, weight of its ridge, nodes of a histogram of scores.
CUTS, RIDGE, NODES = 24, 1e-4, 2048
#: The fit (L-BFGS) ends where a step gains less of the loss, after so many steps at most; steps it remembers.
GAIN, STEPS, MEMORY = 1e-5, 200, 10
#: Labelled rows of one file at least, and files at most: about as many tasks send sums to the driver (1.2 MB each at most).
EACH, FILES = 200_000, 64

#: Bytes of text whose kinds are counted at a time.
PIECE = 1 << 20

_GROUPS = [b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b".", b",", b"!?", b"|", b"#$%&*@^~", b"<>{}[]()=+\\/_", b"-:;'\"", b"\n", b" \t\r\x0b\x0c", bytes(range(128, 256))]
_KIND = np.full(256, len(_GROUPS), np.int64)
for _k, _g in enumerate(_GROUPS):
    _KIND[list(_g)] = _k
FEATURES = len(_GROUPS) + 1 + 11


def _spread(counts: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(rows, counts, n)


def features(column) -> np.ndarray:
    """One row of ``FEATURES`` numbers per text."""
    raw, at = C.text_bytes(column)
    n = len(at) - 1
    out = np.zeros((n, FEATURES))
    if not len(raw):
        return out
    size = np.diff(at)
    kinds = len(_GROUPS) + 1
    for a in range(0, len(raw), PIECE):  # numbers of every byte are made for a piece at a time
        part = raw[a : a + PIECE]
        row = np.searchsorted(at, np.arange(a, a + len(part)), "right") - 1
        first = int(row[0])
        counts = np.bincount((row - first) * kinds + _KIND[part])
        last = first + -(-len(counts) // kinds)
        out[first:last, :kinds] += np.append(counts, np.zeros((last - first) * kinds - len(counts))).reshape(-1, kinds)
    out[:, :kinds] /= np.maximum(1, size)[:, None]
    h, first, start, end = C.word_hashes(column, spans=True)
    words = np.diff(first)
    per = np.maximum(1, words)
    owner = np.repeat(np.arange(n), words)
    last, begin = raw[end - 1], raw[start]
    marks = np.isin(_KIND, (5, 7, 8))
    upper = (_KIND[begin] == 0) & (_KIND[raw[np.minimum(start + 1, end - 1)]] == 0) & (end - start > 1)
    k = kinds
    out[:, k] = np.log1p(words)
    out[:, k + 1] = _spread(end - start, owner, n) / per
    out[:, k + 2] = _spread(upper.astype(float), owner, n) / per
    out[:, k + 3] = _spread(marks[last].astype(float), owner, n) / per
    out[:, k + 4] = _spread((_KIND[begin] == 0).astype(float), owner, n) / per
    own = _distinct(owner, h)
    out[:, k + 5] = np.bincount(own, minlength=n) / per
    # lines, told apart by the hash of their words
    breaks = np.concatenate([[0], np.cumsum(raw == 10)])
    line = breaks[start] + owner  # a text's end ends its line
    cut = np.flatnonzero(np.concatenate([[True], line[1:] != line[:-1]])) if len(line) else np.zeros(0, np.int64)
    if len(cut):
        lh = C.mixed(np.add.reduceat(h * (np.arange(len(h)) - np.repeat(cut, np.diff(np.append(cut, len(h)))) + 1).astype(np.uint64), cut))
        lines = np.bincount(owner[cut], minlength=n)
        out[:, k + 6] = np.bincount(_distinct(owner[cut], lh), minlength=n) / np.maximum(1, lines)
        out[:, k + 7] = words / np.maximum(1, lines)
        out[:, k + 8] = np.log1p(lines)
    pairs = C.mixed(h[:-1] * np.uint64(3) + h[1:]) if len(h) > 1 else np.zeros(0, np.uint64)
    same = owner[:-1] == owner[1:]
    out[:, k + 9] = np.bincount(_distinct(owner[:-1][same], pairs[same]), minlength=n) / per
    out[:, k + 10] = _spread(((_KIND[last] == 3)).astype(float), owner, n) / per
    return out


def _distinct(owner: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The owner of each distinct (owner, h)."""
    order = np.lexsort((h, owner))
    o, x = owner[order], h[order]
    return o[np.concatenate([[True], (o[1:] != o[:-1]) | (x[1:] != x[:-1])])] if len(o) else o


class _Held:
    """Labelled rows in memory: one column of ``x`` for each."""

    def __init__(self, x: np.ndarray, good: np.ndarray):
        self.x, self.good = x, good

    def total(self, f) -> np.ndarray:
        return f(self.x, self.good)

    def mapped(self, f) -> _Held:
        return _Held(f(self.x), self.good)


class _Stored:
    """Labelled rows in a stored table: blocks of rows, ``x`` with one line per feature, and their labels."""

    def __init__(self, df: DataFrame, kind):
        self.df, self.kind = df, np.dtype(kind)

    def total(self, f) -> np.ndarray:
        """The sum of ``f`` over all blocks; each task sends the sum of its own."""
        kind = self.kind

        def rows(batches):
            import pyarrow as pa

            out = None
            for x, good in _blocks(batches, kind):
                got = f(x, good)
                out = got if out is None else out + got
            if out is not None:
                yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()], pa.binary()), pa.array([list(out.shape)], pa.list_(pa.int32()))], ["sum", "shape"])

        return sum(np.frombuffer(r["sum"]).reshape(r["shape"]) for r in self.df.mapInArrow(rows, "sum binary, shape array<int>").collect())

    def mapped(self, f) -> _Stored:
        kind = self.kind

        def rows(batches):
            for x, good in _blocks(batches, kind):
                yield _block(f(x), good)

        return _Stored(C.stored(self.df.mapInArrow(rows, _BLOCK), "steps"), np.uint8)


_BLOCK = "x binary, good binary"


def _block(x: np.ndarray, good: np.ndarray):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()), pa.array([good.astype(np.uint8).tobytes()], pa.binary())], ["x", "good"])


def _blocks(batches, kind: np.dtype):
    for batch in batches:
        for x, good in zip(batch.column(0), batch.column(1), strict=True):
            yield np.frombuffer(x.as_buffer(), kind).reshape(FEATURES, -1), np.frombuffer(good.as_buffer(), np.uint8)


def _ordered(v: np.ndarray) -> np.ndarray:
    """Numbers without sign in the order of ``v``."""
    key = (v.astype(np.float64) + 0.0).view(np.uint64)
    return np.where(key >> np.uint64(63), ~key, key | np.uint64(1 << 63))


def _at_ranks(rows, values, columns: int, ranks: np.ndarray) -> np.ndarray:
    """Of each column that ``values`` makes of rows, its values at ``ranks`` (from 0) in ascending order; exact, eight bits a turn."""
    found, left = np.zeros((columns, len(ranks)), np.uint64), np.tile(ranks.astype(np.float64), (columns, 1))
    for shift in range(56, -8, -8):
        own, rest = np.uint64(shift), np.uint64(8)
        known = [np.unique(k >> own >> rest) for k in found]
        base = np.cumsum([0] + [256 * len(k) for k in known])

        def counts(x, good, own=own, rest=rest, known=known, base=base):
            out = np.zeros(base[-1])
            for c, v in enumerate(values(x)):
                key = _ordered(v) >> own
                place = np.minimum(np.searchsorted(known[c], key >> rest), len(known[c]) - 1)
                hit = known[c][place] == key >> rest
                out[base[c] : base[c + 1]] += np.bincount(place[hit] * 256 + (key[hit] & np.uint64(255)).astype(np.int64), minlength=base[c + 1] - base[c])
            return out

        n = rows.total(counts)
        for c in range(columns):
            below = n[base[c] : base[c + 1]].reshape(-1, 256).cumsum(1)[np.searchsorted(known[c], found[c] >> own >> rest)]
            byte = (below <= left[c][:, None]).sum(1)
            left[c] -= np.where(byte > 0, below[np.arange(len(ranks)), byte - 1], 0)
            found[c] |= byte.astype(np.uint64) << own
    return np.where(found >> np.uint64(63), found & np.uint64((1 << 63) - 1), ~found).view(np.float64)


def _raw(steps: np.ndarray, weights: np.ndarray) -> np.ndarray:
    out = np.zeros(steps.shape[1])
    for w, k in zip(weights, steps, strict=True):
        out += w[k]
    return out


def _place(raw: np.ndarray, low: float, width: float) -> tuple[np.ndarray, np.ndarray]:
    """The node below each score, and the share of the node above."""
    at = (raw - low) / width
    k = np.clip(at.astype(np.int64), 0, NODES - 2)
    return k, np.round(np.clip(at - k, 0, 1) * (1 << 20)) / (1 << 20)


class _Loss:
    """Mean logistic loss over all pairs of a good and a poor row at ``weights``, and its gradient."""

    def __init__(self, rows, weights: np.ndarray):
        self.rows, self.weights = rows, weights
        low, high = weights.min(1).sum(), weights.max(1).sum()
        self.low, self.width = low, width = low, (high - low) / (NODES - 1) or 1.0

        def spread(x, good):
            k, part = _place(_raw(x, weights), low, width)
            return np.stack([np.bincount(k[good == y], 1 - part[good == y], NODES) + np.bincount(k[good == y] + 1, part[good == y], NODES) for y in (0, 1)])

        self.poor, self.good = self.counts = rows.total(spread)
        self.pairs = self.poor.sum() * self.good.sum()
        away = np.arange(1 - NODES, NODES) * self.width
        self.away = 1 / (1 + np.exp(-np.clip(away, -500, 500)))  # chance that the poor one of a pair wins, by its lead
        self.value = self.good @ self._over(np.logaddexp(0, away), self.poor) / self.pairs + RIDGE / 2 * (weights**2).sum()

    @staticmethod
    def _over(kernel: np.ndarray, poor: np.ndarray) -> np.ndarray:
        """At each node, the kernel of the lead of every poor row, summed."""
        return np.convolve(poor[::-1], kernel)[NODES - 1 : 2 * NODES - 1][::-1]

    def gradient(self) -> np.ndarray:
        lost = self._over(self.away, self.poor) / self.poor.sum()
        won = np.convolve(self.good, self.away)[NODES - 1 : 2 * NODES - 1] / self.good.sum()
        weights, low, width = self.weights, self.low, self.width

        def pulls(x, good):
            k, part = _place(_raw(x, weights), low, width)
            pull = np.stack([won, -lost])
            pull = pull[good, k] * (1 - part) + pull[good, k + 1] * part
            pull = np.round(pull * (1 << 24)) / (1 << 24)
            return np.stack([np.stack([np.bincount(step[good == y], pull[good == y], weights.shape[1]) for step in x]) for y in (0, 1)])

        poor, good = self.rows.total(pulls)
        return poor / self.poor.sum() + good / self.good.sum() + RIDGE * self.weights


def _least(rows, shape: tuple[int, int]) -> _Loss:
    """The least loss, by L-BFGS."""
    at = _Loss(rows, np.zeros(shape))
    g, past = at.gradient(), []
    for _ in range(STEPS):
        d, kept = -g, []
        for s, y in reversed(past):
            kept.append((s * d).sum() / (s * y).sum())
            d = d - kept[-1] * y
        d = d * ((past[-1][0] * past[-1][1]).sum() / (past[-1][1] ** 2).sum() if past else 1 / max(1e-12, np.abs(g).max()))
        for s, y in past:
            d = d + (kept.pop() - (y * d).sum() / (s * y).sum()) * s
        slope, step = (g * d).sum(), 1.0
        while slope < 0 and (then := _Loss(rows, at.weights + step * d)).value > at.value + 1e-4 * step * slope and step > 1e-6:
            step /= 2
        if slope >= 0 or then.value >= at.value:
            break
        gain, before = at.value - then.value, (at.weights, g)
        at = then
        if gain < GAIN * at.value:
            break
        g = at.gradient()
        s, y = at.weights - before[0], g - before[1]
        if (s * y).sum() > 0:
            past = [*past[1 - MEMORY :], (s, y)]
    return at


class Ranking:
    """Weights of the steps, the threshold and the scale of a score."""

    def __init__(self, x: np.ndarray, good: np.ndarray):
        self._fit(_Held(x.T, good))

    @classmethod
    def over(cls, rows: _Stored) -> Ranking | None:
        """Fitted to rows that stay on the executors; none without rows of both labels."""
        out = cls.__new__(cls)
        return out if out._fit(rows) else None

    def _fit(self, rows) -> bool:
        counts = rows.total(lambda x, good: np.bincount(good, minlength=2).astype(np.float64))
        if not np.all(counts):
            return False
        n, poor = int(counts.sum()), int(counts[0])
        cuts = _at_ranks(rows, lambda x: x, FEATURES, np.arange(CUTS) * (n - 1) // CUTS)
        self.cuts = [np.unique(c) for c in cuts]
        self.at = np.cumsum([0] + [len(c) + 1 for c in self.cuts])
        own = self.cuts
        steps = rows.mapped(lambda x: np.stack([np.searchsorted(c, v, "right") for c, v in zip(own, x, strict=True)]).astype(np.uint8))
        best = _least(steps, (FEATURES, CUTS + 1))
        weights = best.weights
        self.weights = np.concatenate([w[: len(c) + 1] for w, c in zip(weights, self.cuts, strict=True)])
        low, high = _at_ranks(steps, lambda x: [_raw(x, weights)], 1, np.array([poor - 1, poor]))[0]
        self.threshold = float(low + (high - low) * (1 - poor / n))
        nodes, share = best.low + best.width * np.arange(NODES), best.counts.sum(0) / n
        self.scale = float(np.sqrt(share @ (nodes - share @ nodes) ** 2) / 2 or 1)
        return True

    def _steps(self, x: np.ndarray) -> np.ndarray:
        return np.stack([a + np.searchsorted(c, v, "right") for a, c, v in zip(self.at, self.cuts, x.T, strict=False)], 1)

    def scores(self, x: np.ndarray) -> np.ndarray:
        """1 / 2 at the threshold; the likelier a text is good, the nearer to 1."""
        return 1 / (1 + np.exp(-np.clip((self.weights[self._steps(x)].sum(1) - self.threshold) / self.scale, -500, 500)))


def _featured(docs: DataFrame, id_column: str) -> DataFrame:
    def rows(batches):
        import pyarrow as pa

        for batch in batches:
            for k in range(0, len(batch), 256):
                x = features(batch.column(1).slice(k, 256)).astype(np.float32)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, 256), pa.array([v.tobytes() for v in x], pa.binary())], ["id", "x"])
        C.trim_memory()

    return docs.select(F.col(id_column).alias("id"), F.col("text").cast("string")).mapInArrow(rows, f"id {docs.schema[id_column].dataType.simpleString()}, x binary")


def _matrix(column) -> np.ndarray:
    return C.text_bytes(column)[0].view(np.float32).reshape(-1, FEATURES)


def fitted(featured: DataFrame, labelled: DataFrame, id_column: str = "doc_id") -> Ranking | None:
    """The ranking fitted to all labelled rows; ``featured``: ids and features, ``labelled``: ids and their label ``quality``."""
    labels = labelled.select(F.col(id_column).alias("lid"), F.col("quality").cast("int").alias("good")).where("good in (0, 1)")

    def rows(batches):
        for batch in batches:
            if len(batch):
                yield _block(np.ascontiguousarray(_matrix(batch.column(0)).T), np.asarray(batch.column(1)))

    own = featured.join(labels, F.col("id") == F.col("lid")).select("x", "good").mapInArrow(rows, _BLOCK)
    n = labels.count()
    return Ranking.over(_Stored(C.stored(own, "labelled", n, max(EACH, n // (FILES - 1))), np.float32))


def quality(docs: DataFrame, labelled: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """Per document: id, score (0 to 1), predicted (1 if score >= 0.5, else 0)."""
    spark = docs.sparkSession
    C.bounded_batches(spark)
    featured = C.stored(_featured(docs, id_column), "features")
    model = spark.sparkContext.broadcast(fitted(featured, labelled, id_column))

    def rows(batches):
        import pyarrow as pa

        for batch in batches:
            score = np.full(len(batch), 0.5) if model.value is None else model.value.scores(_matrix(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], [id_column, "score", "predicted"])

    kind = docs.schema[id_column].dataType.simpleString()
    return featured.mapInArrow(rows, f"`{id_column}` {kind}, score double, predicted int")
