"""Toxicity: a bidirectional gated recurrent network with attention pooling over word and character inputs.

Trained in numpy on the driver on a bounded sample of whole labelled texts (``SAMPLE`` of each label at most, those with
the least hashed ids, and of these the first whose texts hold ``SAMPLE_BYTES`` in all), it scores overlapping windows of
every whole text, one each ``STRIDE`` words; a text's score is its highest window's. A word's input, without the signs at
its ends, is its own vector, if training met it in ``MET`` texts or more, and the mean of the vectors of its character
trigrams and beginnings. Training is by the window that scores highest in each text, found anew in each round.

Null texts and texts without words score 0. Long texts just have more windows. Repeated rows get equal scores. Extra
columns are ignored. Without labelled rows of both kinds every score is 0. Empty input gives an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

#: Labelled texts of each label that training uses at most, and the bytes of each label's texts; texts are never cut.
SAMPLE, SAMPLE_BYTES = 2500, 5 << 20
WINDOW, STRIDE = 32, 16
HIDDEN, WORD_DIM, CHAR_DIM, GRAMS, MET = 8, 8, 8, 1 << 14, 6
#: Where in the gap between clean and toxic texts of the sample the threshold lies.
EDGE = 0.25
#: Lengths in bytes of the beginnings of words that are inputs beside their trigrams.
PREFIXES = (4, 5, 6, 7)
ROUNDS, EPOCHS = 4, 3
#: Steps of each round at least, so that small samples are learned too.
LEAST_STEPS = 40


#: ASCII signs, which a word's input goes without at its ends.
_SIGN = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


def _trimmed(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans without the signs at their ends; a span of signs alone stays as it is."""
    own = np.flatnonzero(~_SIGN[raw])
    if not len(own) or not len(start):
        return start, end
    low, high = np.searchsorted(own, start), np.searchsorted(own, end) - 1
    some = low <= high
    return np.where(some, own[np.minimum(low, len(own) - 1)], start), np.where(some, own[np.maximum(high, 0)] + 1, end)


class Words:
    """The distinct words of some texts: index of each occurrence, and each distinct word's trigrams."""

    def __init__(self, column):
        _, self.first, start, end = C.word_hashes(column, spans=True)
        raw, _ = C.text_bytes(column)
        folded = C._FOLD[raw]
        start, end = _trimmed(folded, start, end)
        self.hashes, one, index = np.unique(C.span_hashes(folded, start, end) if len(start) else np.zeros(0, np.uint64), return_index=True, return_inverse=True)
        self.index = index.astype(np.int32)
        # each distinct word between boundary bytes
        n = end[one] - start[one] + 2
        stop = np.cumsum(n)
        body = np.repeat((start[one] - (stop - n) - 1).astype(np.int32), n)
        body += np.arange(len(body), dtype=np.int32)
        edge = np.zeros(len(body), bool)
        edge[stop - n] = edge[stop - 1] = True
        body[edge] = 0
        letters = folded[body] if len(raw) else np.zeros(0, np.uint8)
        letters[edge] = 1
        letters = letters.astype(np.uint32)
        del body, edge
        code, owner = [], []
        word = np.repeat(np.arange(len(n), dtype=np.int32), n)
        if len(letters):
            three = letters[:-2] * np.uint32(0x9E3779B1)
            three ^= letters[1:-1] * np.uint32(0x85EBCA6B)
            three ^= letters[2:] * np.uint32(0xC2B2AE35)
            keep = word[:-2] == word[2:]
            code.append(three[keep])
            owner.append(word[:-2][keep])
            del three, keep
            # beginnings of words: the first PREFIXES bytes, hashed as they grow
            h = np.zeros(len(n), np.uint32)
            for k in range(1, max(PREFIXES) + 1):
                some = np.flatnonzero(n - 2 >= k).astype(np.int32)
                h[some] = (h[some] ^ letters[stop[some] - n[some] + k]) * np.uint32(0x01000193) + np.uint32(k)
                if k in PREFIXES:
                    code.append(h[some] * np.uint32(0x85EBCA6B) + np.uint32(k))
                    owner.append(some)
        del word, letters
        code, owner = np.concatenate([np.zeros(0, np.uint32), *code]), np.concatenate([np.zeros(0, np.int32), *owner])
        code ^= code >> np.uint32(15)
        order = np.argsort(owner, kind="stable")
        self.grams = (code[order] * np.uint32(0x27D4EB2F) >> np.uint32(18)).astype(np.int32)
        self.size = np.bincount(owner, minlength=len(n))
        self.gram_at = np.cumsum(self.size) - self.size

    def only(self, some: np.ndarray) -> "Words":
        """The distinct words ``some``, without their occurrences."""
        out = object.__new__(Words)
        n = self.size[some]
        out.hashes, out.size, out.gram_at = self.hashes[some], n, np.cumsum(n) - n
        out.grams = self.grams[np.repeat(self.gram_at[some] - out.gram_at, n) + np.arange(n.sum())]
        return out


def windows(first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and text of all windows; the last of a text ends with it, a short text has one."""
    n = np.diff(first)
    count = np.where(n > 0, np.maximum(0, -(-(n - WINDOW) // STRIDE)) + 1, 0)
    text = np.repeat(np.arange(len(n)), count)
    k = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    return first[:-1][text] + np.minimum(k * STRIDE, np.maximum(0, n[text] - WINDOW)), text


def _sigmoid(x):
    return np.float32(0.5) * np.tanh(np.float32(0.5) * x) + np.float32(0.5)


class Network:
    def __init__(self, vocabulary: np.ndarray, seed: int = 5):
        rng = np.random.default_rng(seed)
        d, h = WORD_DIM + CHAR_DIM, HIDDEN
        draw = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        self.vocabulary = vocabulary
        self.p = {"word": (rng.standard_normal((len(vocabulary) + 1, WORD_DIM)) * 0.1).astype(np.float32), "char": (rng.standard_normal((GRAMS, CHAR_DIM)) * 0.1).astype(np.float32)}
        self.p["word"][-1] = 0
        for side in "fb":
            self.p |= {f"W{side}": draw(d, 3 * h), f"U{side}": draw(h, 3 * h), f"c{side}": np.zeros(3 * h, np.float32)}
        self.p |= {"A": draw(2 * h, h), "a0": np.zeros(h, np.float32), "a": draw(h), "o": draw(2 * h), "o0": np.zeros(1, np.float32)}
        self.shift = 0.0

    def inputs(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """Rows of the word table, and the input vector of each distinct word; at the end one of zeros, for padding."""
        at = np.searchsorted(self.vocabulary, words.hashes)
        row = np.where((at < len(self.vocabulary)) & (self.vocabulary[np.minimum(at, len(self.vocabulary) - 1)] == words.hashes), at, len(self.vocabulary)) if len(self.vocabulary) else np.zeros(len(words.hashes), np.int64)
        x = np.zeros((len(words.hashes) + 1, WORD_DIM + CHAR_DIM), np.float32)
        if len(words.hashes):
            x[:-1, :WORD_DIM] = self.p["word"][row]
            for a in range(0, len(words.hashes), 20_000):
                b = min(len(words.hashes), a + 20_000)
                t = words.grams[words.gram_at[a] : words.gram_at[b - 1] + words.size[b - 1]]
                x[a:b, WORD_DIM:] = np.add.reduceat(self.p["char"][t], words.gram_at[a:b] - words.gram_at[a]) / words.size[a:b, None].astype(np.float32)
        return row, x

    def forward(self, which: np.ndarray, x: np.ndarray, keep: bool = False):
        """Logits of windows given as indices of distinct words (windows x WINDOW; -1: padding)."""
        p, h, n = self.p, HIDDEN, len(which)
        out = np.empty((WINDOW, n, 2 * h), np.float32)
        trace = {}
        for side, order in (("f", range(WINDOW)), ("b", range(WINDOW - 1, -1, -1))):
            given, u = x @ p[f"W{side}"] + p[f"c{side}"], p[f"U{side}"]
            state = np.zeros((n, h), np.float32)
            for t in order:
                g = given[which[:, t]]
                zr = _sigmoid(g[:, : 2 * h] + state @ u[:, : 2 * h])
                z, r = zr[:, :h], zr[:, h:]
                new = np.tanh(g[:, 2 * h :] + (r * state) @ u[:, 2 * h :])
                if keep:
                    trace[side, t] = (state, z, r, new)
                state = new + z * (state - new)
                out[t, :, :h] if side == "f" else None
                out[t, :, slice(0, h) if side == "f" else slice(h, None)] = state
        mid = np.tanh(out @ p["A"] + p["a0"])
        score = mid @ p["a"]
        score[(which < 0).T] = -1e9
        weight = np.exp(score - score.max(0))
        weight /= weight.sum(0)
        pooled = np.einsum("tn,tnd->nd", weight, out)
        logit = pooled @ p["o"] + p["o0"]
        return (logit, (out, mid, weight, pooled, trace)) if keep else logit

    def gradients(self, which, words, row, x, target, importance):
        p, h = self.p, HIDDEN
        logit, (out, mid, weight, pooled, trace) = self.forward(which, x, True)
        g = {k: np.zeros_like(v) for k, v in p.items()}
        dl = ((_sigmoid(logit) - target) * importance / importance.sum()).astype(np.float32)
        g["o"], g["o0"] = pooled.T @ dl, dl.sum(keepdims=True)
        dpooled = dl[:, None] * p["o"]
        dout = weight[:, :, None] * dpooled
        dweight = np.einsum("tnd,nd->tn", out, dpooled)
        dscore = weight * (dweight - (weight * dweight).sum(0))
        g["a"] = np.einsum("tn,tnh->h", dscore, mid)
        dmid = dscore[:, :, None] * p["a"] * (1 - mid * mid)
        g["A"], g["a0"] = np.einsum("tnd,tnh->dh", out, dmid), dmid.sum((0, 1))
        dout += dmid @ p["A"].T
        dx = np.zeros_like(x)
        for side, order in (("f", range(WINDOW - 1, -1, -1)), ("b", range(WINDOW))):
            u, w = p[f"U{side}"], p[f"W{side}"]
            dgiven, steps = np.zeros((len(x), 3 * h), np.float32), {}
            ds = np.zeros((len(which), h), np.float32)
            for t in order:
                s, z, r, new = trace[side, t]
                ds = ds + dout[t, :, slice(0, h) if side == "f" else slice(h, None)]
                dnew = ds * (1 - z) * (1 - new * new)
                dz = ds * (s - new) * z * (1 - z)
                drs = dnew @ u[:, 2 * h :].T
                dr = drs * s * r * (1 - r)
                dzr = np.concatenate([dz, dr], 1)
                g[f"U{side}"][:, : 2 * h] += s.T @ dzr
                g[f"U{side}"][:, 2 * h :] += (r * s).T @ dnew
                ds = ds * z + drs * r + dzr @ u[:, : 2 * h].T
                steps[t] = np.concatenate([dzr, dnew], 1)
            dall = np.concatenate([steps[t] for t in range(WINDOW)])
            for k in range(3 * h):
                dgiven[:, k] = np.bincount(which.T.ravel() % len(x), dall[:, k], len(x))
            g[f"W{side}"], g[f"c{side}"] = x.T @ dgiven, dgiven.sum(0)
            dx += dgiven @ w.T
        for k in range(WORD_DIM):
            g["word"][:, k] = np.bincount(row, dx[:-1, k], len(p["word"]))
        g["word"][-1] = 0
        for k in range(CHAR_DIM):
            g["char"][:, k] = np.bincount(words.grams, np.repeat(dx[:-1, WORD_DIM + k] / words.size, words.size), GRAMS)
        return g

    def best(self, words: Words, chunk: int = 4096, blank: bool = False):
        """(logits of all windows, their word indices, their texts)."""
        start, text = windows(words.first)
        stop = words.first[1:][text]
        which = np.full((len(start), WINDOW), -1, np.int32)
        for k in range(WINDOW):
            inside = start + k < stop
            which[inside, k] = words.index[start[inside] + k]
        if blank:
            return np.zeros(len(which), np.float32), which, text
        _, x = self.inputs(words)
        logits = [self.forward(which[k : k + chunk], x) for k in range(0, len(which), chunk)]
        return np.concatenate([np.zeros(0, np.float32), *logits]), which, text

    def scores(self, column) -> np.ndarray:
        """Of each text the probability of its most toxic window."""
        words = Words(column)
        logit, _, text = self.best(words)
        top = np.full(len(words.first) - 1, -np.inf)
        np.maximum.at(top, text, logit)
        return 1 / (1 + np.exp(-np.clip(top - self.shift, -500, 500))) * np.isfinite(top)


def _odds(p: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Log odds of counts against the share of all, nearer 0 the fewer they are."""
    odds = np.log((p + 0.5) / (p.sum() + 1)) - np.log((n + 0.5) / (n.sum() + 1))
    return (odds * (1 - np.exp(-(p + n) / 4))).astype(np.float32)


def _leaning(owner: np.ndarray, item: np.ndarray, size: int, toxic: np.ndarray) -> np.ndarray:
    """Of each item, how much more often toxic texts have it than clean ones (log odds), nearer 0 the fewer texts have it."""
    pair = np.unique(owner.astype(np.int64) * size + item)
    has, which = toxic[pair // size], pair % size
    p, n = np.bincount(which, has, size), np.bincount(which, 1 - has, size)
    odds = np.log((p + 0.5) / (toxic.sum() + 1)) - np.log((n + 0.5) / ((1 - toxic).sum() + 1))
    return (odds * (1 - np.exp(-(p + n) / 4))).astype(np.float32)


def train(texts: list[str], toxic: np.ndarray, rounds: int = ROUNDS, seed: int = 5) -> Network:
    """Rounds of choosing the windows that stand for each text, then some epochs of Adam steps on them.

    Vectors start from how words and trigrams lean to either label; so does the first choice of windows.
    """
    import pyarrow as pa

    rng = np.random.default_rng(seed)
    n = len(texts)
    words = Words(pa.array(texts, pa.string()))
    texts = []  # not needed any more
    size = max(1, len(words.hashes))
    owner = np.repeat(np.arange(n), np.diff(words.first))
    met = np.bincount(np.unique(owner * size + words.index) % size, minlength=size)
    net = Network(words.hashes[met[: len(words.hashes)] >= MET], seed)
    lean = _leaning(owner, words.index, size, toxic)
    # of a gram: in how many texts of each label its words are, added up
    pair = np.unique(owner * size + words.index)
    bad = np.bincount(pair % size, toxic[pair // size], size)
    of = np.repeat(np.arange(size), words.size) if len(words.hashes) else np.zeros(0, np.int64)
    gram = _odds(np.bincount(words.grams, bad[of], GRAMS), np.bincount(words.grams, (met - bad)[of], GRAMS))
    net.p["word"][:-1, 0] = lean[met >= MET] / 2
    net.p["char"][:, 0] = gram / 2
    mean = {k: np.zeros_like(v) for k, v in net.p.items()}
    square = {k: np.zeros_like(v) for k, v in net.p.items()}
    turn = 0
    for turn_of in range(rounds):
        logit, which, text = net.best(words) if turn_of else net.best(words, blank=True)
        if not turn_of:
            value = np.append(np.where(met >= MET, lean, 0), -9)
            logit = np.concatenate([np.zeros(0), *(np.sort(value[which[k : k + 4096]], 1)[:, -3:].sum(1) for k in range(0, len(which), 4096))])
        order = np.lexsort((-logit, text))
        rank = np.arange(len(text)) - np.searchsorted(text[order], text[order])
        # a clean text's windows are all clean; a toxic one's best is taken to be toxic
        pick = order[rank < np.where(toxic[text[order]] == 1, 1 if turn_of else 2, 3)]
        clean = np.flatnonzero(toxic[text] == 0)
        pick = np.union1d(pick, rng.choice(clean, min(len(clean), 2 * n), replace=False))
        for _ in range(max(EPOCHS, -(-LEAST_STEPS // -(-len(pick) // 512)))):
            rng.shuffle(pick)
            for k in range(0, len(pick), 512):
                some = pick[k : k + 512]
                met_here, own = np.unique(which[some], return_inverse=True)
                pad = int(met_here[0] < 0)
                here = words.only(met_here[pad:])
                row, x = net.inputs(here)
                target = toxic[text[some]].astype(np.float32)
                importance = np.where(target > 0, 2.0, 1.0).astype(np.float32)
                g = net.gradients(own.reshape(-1, WINDOW) - pad, here, row, x, target, importance)
                turn += 1
                rate = np.float32(0.015 if turn_of < rounds - 1 else 0.005)
                for name, v in g.items():
                    mean[name] += 0.1 * (v - mean[name])
                    square[name] += 0.01 * (v * v - square[name])
                    net.p[name] -= rate * (mean[name] / (1 - 0.9**turn)) / (np.sqrt(square[name] / (1 - 0.99**turn)) + 1e-8)
    # the threshold: between the sample's clean and toxic texts where fewest are wrong
    logit, _, text = net.best(words)
    top = np.full(n, -np.inf)
    np.maximum.at(top, text, logit)
    known = np.isfinite(top)
    order = np.argsort(top[known])
    label = toxic[known][order]
    wrong = np.concatenate([[0], np.cumsum(label)]) + 4 * np.concatenate([[(label == 0).sum()], (label == 0).sum() - np.cumsum(label == 0)])
    cut = np.flatnonzero(wrong == wrong.min())
    padded = np.concatenate([[top[known].min() - 1], top[known][order], [top[known].max() + 1]])
    low, high = float(padded[cut].min()), float(padded[cut + 1].max())
    # toxic texts that training hasn't met score lower than those it has, clean ones hardly higher
    net.shift = low + EDGE * (high - low)
    return net


def fitted(docs: DataFrame, labelled: DataFrame, id_column: str = "doc_id") -> Network | None:
    """The network trained on the bounded sample; ``labelled``: ids and their label ``toxic``."""
    labels = labelled.where("toxic is not null").select(F.col(id_column).alias("lid"), (F.col("toxic") > 0).cast("int").alias("toxic"))
    chosen = [labels.where(F.col("toxic") == y).orderBy(F.xxhash64("lid"), "lid").limit(SAMPLE) for y in (0, 1)]
    # at most 2 * SAMPLE ids are broadcast, and only their texts leave the scan
    rows = docs.select(F.col(id_column).alias("lid"), F.col("text").cast("string").alias("text")).where("text is not null").join(F.broadcast(chosen[0].union(chosen[1])), "lid")
    rows = C.stored(rows.select("toxic", "lid", "text", F.xxhash64("lid").alias("h"), F.octet_length("text").cast("long").alias("bytes")), "labelled")
    # a budget of bytes leaves out whole texts, the last by hash; each label keeps one at least
    so_far = F.sum("bytes").over(Window.partitionBy("toxic").orderBy("h", "lid", "text").rowsBetween(Window.unboundedPreceding, -1))
    fits = rows.select("toxic", "lid", "h", "text", (F.coalesce(so_far, F.lit(0)) + F.col("bytes")).alias("total"), F.coalesce(so_far, F.lit(0)).alias("before"))
    got = fits.where((F.col("total") <= SAMPLE_BYTES) | (F.col("before") == 0)).select("toxic", "lid", "text").collect()
    got.sort(key=lambda r: (r["toxic"], str(r["lid"]), r["text"]))
    toxic = np.array([r["toxic"] for r in got])
    if len(set(toxic.tolist())) < 2:
        return None
    texts = [r["text"] for r in got]
    got.clear()
    C.release(docs.sparkSession)  # the driver's JVM shrinks before training grows
    net = train(texts, toxic)
    del texts
    C.trim_memory()
    return net


def toxicity(docs: DataFrame, labelled: DataFrame, id_column: str = "doc_id", named_by: str | None = None) -> DataFrame:
    """Per document: id (or the column ``named_by``), score (0 to 1), predicted (1 if score >= 0.5, else 0)."""
    spark = docs.sparkSession
    C.bounded_batches(spark)
    C.relax(spark)
    net = spark.sparkContext.broadcast(fitted(docs, labelled, id_column))
    id_column = named_by or id_column

    def rows(batches):
        import pyarrow as pa

        for batch in batches:
            score = np.zeros(len(batch)) if net.value is None else np.concatenate([net.value.scores(batch.column(1).slice(k, 256)) for k in range(0, max(1, len(batch)), 256)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score, pa.float64()), pa.array((score >= 0.5).astype(np.int32))], [id_column, "score", "predicted"])
        C.trim_memory()

    kind = docs.schema[id_column].dataType.simpleString()
    return docs.select(id_column, F.col("text").cast("string")).mapInArrow(rows, f"`{id_column}` {kind}, score double, predicted int")
