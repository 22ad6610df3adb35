"""Byte-level BPE encoding and decoding: DuckDB recursive queries, one database per partition.

Encoding: a text is cut by the pattern; every distinct piece that is no token itself is a set of rows (piece, position,
token), at first its bytes. Each turn of a recursive query joins neighbouring rows with the merge table and contracts
each piece's leftmost pair of least rank, until no pair merges. Where no pair with the merged token ranks before it, the
next turns would contract the pair's other occurrences, so those are contracted in the same turn, from the left.
Decoding: rows (text, position, token) join the vocabulary, which has each token's bytes in hexadecimal, and an ordered
aggregation joins them to each text's bytes. Pieces are told apart by their bytes.

A null text counts as empty: no ids, no bytes. Unknown ids fail the decoding. Repeated rows are returned as often as they
occur; extra columns are ignored. A partition's pieces are kept for its next batches up to ``KEPT`` of them.
"""

from __future__ import annotations

import base64
import os
import tempfile

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

#: Encoded pieces that a worker remembers; beyond, it begins anew.
KEPT = 400_000
#: What one worker's database holds in memory at most; what a very long piece needs beyond goes to Spark's own scratch folder.
MEMORY = "100MB"
#: Pieces of more bytes contract all occurrences of a pair in a turn, where that is the same.
LONG = 256
#: Bytes of pieces that one recursive query takes at most, unless one piece has more; and its turns, after which the next one goes on.
STEP_BYTES, TURNS = 1 << 17, 16
#: Tokens that one decoding query takes at most, unless one text has more; bytes of text that are cut at a time.
DECODE_TOKENS, CHUNK = 200_000, 1 << 20
#: Fixed value: the pattern whose matches ``Pieces`` finds.
KNOWN_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def load_ranks(path: str) -> dict[bytes, int]:
    """The rank file, of fixed size, read on the driver."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def merges(ranks: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All pairs of tokens that make a token: (left, right, token, whether a pair with that token ranks before it)."""
    found = [(ranks[t[:k]], ranks[t[k:]], r) for t, r in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks]
    left, right, token = (np.array(x, np.int64) for x in zip(*found, strict=True))
    early = {*left[token < left].tolist(), *right[token < right].tolist()}
    return left, right, token, np.array([t in early for t in token.tolist()])


class Vocabulary:
    """What the driver derives from ranks and pattern once, for all workers: merges, spellings and the characters' classes."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.merges = merges(ranks)
        self.ids = np.fromiter(ranks.values(), np.int32)
        self.tokens = list(ranks)
        self.pieces = Pieces(pattern)


def _scratch() -> str:
    """Where this worker's Spark spills too; only this process reads what lies there, and it goes with the process."""
    return os.path.join(os.environ.get("SPARK_LOCAL_DIRS", tempfile.gettempdir()).split(",")[0], f"duckdb-{os.getpid()}")


class Codec:
    """Encodes and decodes in an own DuckDB database of bounded memory."""

    def __init__(self, vocabulary: Vocabulary):
        import duckdb
        import pyarrow as pa

        self.pieces = vocabulary.pieces
        ranks = dict(zip(vocabulary.tokens, vocabulary.ids.tolist(), strict=True))
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": MEMORY, "temp_directory": _scratch()})
        left, right, token, early = vocabulary.merges
        self.db.register("m", pa.table({"l": left, "r": right, "rank": 2 * token + early}))
        self.db.register("v", pa.table({"id": vocabulary.ids, "hex": [t.hex() for t in vocabulary.tokens]}))
        self.db.execute("CREATE TABLE merge_table AS SELECT l * 1048576 + r AS pair, rank::BIGINT AS rank FROM m; CREATE TABLE vocabulary AS SELECT id, hex FROM v; DROP VIEW m; DROP VIEW v")
        self.ranks = ranks
        self.single = np.array([ranks[bytes([b])] for b in range(256)])
        self._forget()

    def _forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.flat, self.count = np.zeros(0, np.int32), np.zeros(0, np.int64)

    def encode(self, column) -> list[np.ndarray]:
        """Token ids of each text of an Arrow column."""
        raw, at = C.text_bytes(column)
        out: list[np.ndarray] = []
        k = 0
        while k < len(at) - 1:  # some texts at a time: what is made of them is many times their size
            j = max(k + 1, int(np.searchsorted(at, at[k] + CHUNK, "right")) - 1)
            out += self._encode_some(raw[at[k] : at[j]], at[k : j + 1] - at[k])
            k = j
        return out

    def _encode_some(self, raw: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
        if len(self.known) > KEPT:
            self._forget()
        starts = self.pieces.starts(raw, at)
        if not len(starts):
            return [np.zeros(0, np.int32)] * (len(at) - 1)
        keys, inverse = C.distinct_spans(raw, starts, np.append(starts[1:], len(raw)))
        known = self.known
        new = [x for x in keys if x not in known]
        if new:
            ids = self._encode_pieces(new)
            for x in new:
                known[x] = len(known)
            self.flat = np.concatenate([self.flat, *ids]).astype(np.int32)
            self.count = np.concatenate([self.count, [len(x) for x in ids]])
        begin = np.cumsum(self.count) - self.count
        k = np.fromiter(map(known.__getitem__, keys), np.int64, len(keys))[inverse]
        n = self.count[k]
        last = np.cumsum(n)
        ids = self.flat[np.repeat(begin[k] - (last - n), n) + np.arange(last[-1])]
        cut = np.concatenate([[0], last])[np.searchsorted(starts, at)]
        return np.split(ids, cut[1:-1])

    def _encode_pieces(self, pieces: list[bytes]) -> list[np.ndarray]:
        import pyarrow as pa
        import pyarrow.compute as pc

        ids: list = [None] * len(pieces)
        hard = []
        for k, p in enumerate(pieces):
            r = self.ranks.get(p)
            if r is None:
                hard.append(k)
            else:
                ids[k] = np.array([r])
        step, size = [], 0
        hard.sort(key=lambda k: len(pieces[k]) > LONG)
        for k in [*hard, None]:  # pieces are taken in groups of bounded size
            if step and (k is None or size + len(pieces[k]) > STEP_BYTES or (len(pieces[k]) > LONG) > (len(pieces[step[0]]) > LONG)):
                query = _ENCODE_LONG if len(pieces[step[0]]) > LONG else _ENCODE
                raw = np.frombuffer(b"".join(pieces[j] for j in step), np.uint8)
                n = np.array([len(pieces[j]) for j in step])
                rows = pa.table({"piece": np.repeat(np.arange(len(step)), n), "pos": np.arange(len(raw)) - np.repeat(np.cumsum(n) - n, n), "token": self.single[raw]})
                done = []
                while len(rows):
                    self.db.register("t", rows)
                    got = self.db.sql(query).to_arrow_table()
                    self.db.unregister("t")
                    done.append(got.filter(pc.invert(got["open"])).select(["piece", "pos", "token"]))
                    rows = got.filter(got["open"]).select(["piece", "pos", "token"])
                got = pa.concat_tables(done)
                piece, pos = got["piece"].to_numpy(), got["pos"].to_numpy()
                ends = np.cumsum(np.bincount(piece, minlength=len(step)))
                for j, x in zip(step, np.split(got["token"].to_numpy()[np.lexsort((pos, piece))], ends[:-1]), strict=True):
                    ids[j] = x
                step, size = [], 0
            if k is not None:
                step.append(k)
                size += len(pieces[k])
        return ids

    def decode(self, ids: list[np.ndarray]) -> list[bytes]:
        """The bytes that each sequence of ids stands for."""
        import pyarrow as pa

        out = [b""] * len(ids)
        k = 0
        while k < len(ids):
            j, size = k, 0
            while j < len(ids) and (j == k or size + len(ids[j]) <= DECODE_TOKENS):
                size += len(ids[j])
                j += 1
            if size:
                n = np.array([len(x) for x in ids[k:j]])
                self.db.register("t", pa.table({"doc": np.repeat(np.arange(j - k, dtype=np.int32), n), "pos": np.arange(size, dtype=np.int32), "id": np.concatenate(ids[k:j]).astype(np.int32)}))
                got = self.db.sql(_DECODE).to_arrow_table()
                self.db.unregister("t")
                if sum(got["known"].to_pylist()) < size:
                    raise ValueError("an id isn't in the vocabulary")
                for doc, data in zip(got["doc"].to_pylist(), got["bytes"].to_pylist(), strict=True):
                    out[k + doc] = data
            k = j
        return out


class Pieces:
    """Where the pattern's matches start, for texts in UTF-8. The matches of this pattern follow from characters' classes:

    contractions; runs of letters, of numbers, of other signs, each with a space before it; white space up to the last
    before something else. Any other pattern is refused.
    """

    def __init__(self, pattern: str):
        import regex

        if pattern != KNOWN_PATTERN:
            raise ValueError("only the byte-level pattern is known")
        every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
        self.kind = np.full(0x110000, 3, np.uint8)  # 0 white space, 1 letter, 2 number, 3 other
        for k, name in enumerate((r"\s", r"\p{L}", r"\p{N}")):
            self.kind[[ord(c) for c in regex.findall(name, every)]] = k

    def starts(self, raw: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Byte positions at which pieces start; ``at``: where the texts start, and the end."""
        if not len(raw):
            return np.zeros(0, np.int64)
        lead = np.flatnonzero((raw & 0xC0) != 0x80)  # characters' first bytes
        code = np.frombuffer(raw.tobytes().decode().encode("utf-32-le"), np.uint32)
        kind = self.kind[code]
        n = len(kind)
        first = np.zeros(n + 1, bool)  # of texts
        first[np.searchsorted(lead, at)] = True
        start = np.ones(n, bool)
        start[1:] = (kind[1:] != kind[:-1]) | first[1:n]
        white = kind == 0
        # the last white space before something else is a piece of its own, or the beginning of the next if it is a space
        before = np.zeros(n, bool)
        before[:-1] = white[:-1] & ~white[1:] & ~first[1:n]
        start |= before
        joins = np.flatnonzero(before & (code == 32))
        start[joins + 1] = False
        # contractions: an apostrophe alone, not after a joined space, and the letters after it
        quote = np.flatnonzero((code[:-1] == 39) & start[:-1] & (kind[1:] == 1) & ~first[1:n]) if n > 1 else np.zeros(0, np.int64)
        for tail in ("s", "t", "re", "ve", "m", "ll", "d"):
            k, size = quote, len(tail)
            for d, c in enumerate(tail, 1):
                k = k[k + d < n]
                k = k[(code[k + d] == ord(c)) & ~first[k + d]]
            start[k + 1] = False
            k = k[k + size + 1 < n]
            start[k + size + 1] = True
        return lead[start]


_codecs: dict[tuple[str, str], Codec] = {}


def codec(vocabulary: Vocabulary, path: str, pattern: str) -> Codec:
    """The worker's codec: tasks that run in one worker share what it remembers."""
    if (path, pattern) not in _codecs:
        _codecs.clear()
        C.trim_memory()
        _codecs[path, pattern] = Codec(vocabulary)
    return _codecs[path, pattern]


_ENCODE = f"""
WITH RECURSIVE step(turn, id, token, open) AS (
    SELECT 0, (piece << 32) | pos, token, true FROM t
  UNION ALL
    SELECT s.turn + 1, CASE WHEN s.id > b.at THEN s.id - 1 ELSE s.id END, CASE WHEN s.id = b.at THEN b.made ELSE s.token END, b.at IS NOT NULL
    FROM step s LEFT JOIN (
        SELECT x.id >> 32 AS piece, min((m.rank // 2 << 32) | (x.id & 4294967295)) AS best, (piece << 32) | (best & 4294967295) AS at, best >> 32 AS made
        FROM step x JOIN step y ON y.id = x.id + 1 JOIN merge_table m ON m.pair = x.token * 1048576 + y.token WHERE x.open GROUP BY x.id >> 32
    ) b ON s.id >> 32 = b.piece
    WHERE s.open AND s.turn < {TURNS} AND (b.at IS NULL OR s.id <> b.at + 1)
)
SELECT id >> 32 AS piece, id & 4294967295 AS pos, token, open FROM step WHERE NOT open OR turn = {TURNS}
"""

#: Rows whose pair has the least rank form runs ("stretch"); of overlapping pairs in a run every other one contracts. An odd
#: rank marks a token with an earlier pair: only its leftmost pair contracts. A piece is open until no pair merges.
_ENCODE_LONG = f"""
WITH RECURSIVE step(turn, piece, pos, token, open) AS (
    SELECT 0, piece, pos, token, true FROM t
  UNION ALL
    SELECT turn + 1, piece, pos, coalesce(made, token), best IS NOT NULL FROM (
        SELECT *, lag(made) OVER (PARTITION BY piece ORDER BY pos) IS NOT NULL AS gone FROM (
            SELECT *, CASE WHEN rank = best AND CASE WHEN best % 2 = 0
                THEN (row_number() OVER (PARTITION BY piece, stretch ORDER BY pos)) % 2 = 1
                ELSE pos = min(pos) FILTER (rank = best) OVER (PARTITION BY piece) END THEN rank // 2 END AS made FROM (
                SELECT *, sum((rank IS DISTINCT FROM best)::INT) OVER (PARTITION BY piece ORDER BY pos ROWS UNBOUNDED PRECEDING) * 2 + (rank IS NOT DISTINCT FROM best)::INT AS stretch FROM (
                    SELECT p.turn, p.piece, p.pos, p.token, m.rank, min(m.rank) OVER (PARTITION BY p.piece) AS best FROM (
                        SELECT *, token * 1048576 + lead(token) OVER (PARTITION BY piece ORDER BY pos) AS pair FROM step WHERE open AND turn < {TURNS}
                    ) p LEFT JOIN merge_table m ON m.pair = p.pair
                )
            )
        )
    ) WHERE NOT gone
)
SELECT piece, pos, token, open FROM (SELECT *, max(turn) OVER (PARTITION BY piece) AS last FROM step) WHERE turn = last
"""

_DECODE = "SELECT doc, count(hex) AS known, unhex(coalesce(string_agg(hex, '' ORDER BY pos), '')) AS bytes FROM t LEFT JOIN vocabulary USING (id) GROUP BY doc"


def bpe(docs: DataFrame, path: str, pattern: str, id_column: str = "doc_id", with_ids: bool = True) -> DataFrame:
    """Per document: id, n_tokens, ids, their digest, and the digest of the bytes that decoding the ids gives."""
    spark = docs.sparkSession
    C.bounded_batches(spark)
    C.relax(spark)
    vocabulary = spark.sparkContext.broadcast(Vocabulary(load_ranks(path), pattern))
    C.trim_memory()

    def rows(batches):
        import hashlib

        import pyarrow as pa

        own = codec(vocabulary.value, path, pattern)
        for batch in batches:
            ids = own.encode(batch.column(1))
            back = own.decode(ids)
            small = [x.astype("<u4") for x in ids]
            columns = [
                batch.column(0),
                pa.array([len(x) for x in ids], pa.int64()),
                pa.array([hashlib.sha256(x.tobytes()).hexdigest() for x in small], pa.string()),
                pa.array([hashlib.sha256(b).hexdigest() for b in back], pa.string()),
            ]
            names = [id_column, "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                columns.append(pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)
        C.trim_memory()

    kind = docs.schema[id_column].dataType.simpleString()
    schema = f"`{id_column}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return docs.select(id_column, F.col("text").cast("string")).mapInArrow(rows, schema)
