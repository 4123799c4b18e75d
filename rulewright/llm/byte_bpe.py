"""Byte-level BPE encoding and decoding by DuckDB recursive queries inside each partition.

Texts are split by the tokenizer's pattern.  The distinct words that a worker hasn't met yet
become token-position rows; a recursive query joins neighbouring positions to the
merge table and contracts each word's leftmost pair of least rank until no pair is
left.  Ordered aggregation over the ids decodes.  Batches bound the rows of a query and
the remembered words; words beyond LONG bytes, for which one contraction a round would be
quadratic, take the same contractions from a heap.

Defined results: a null text counts as empty (no ids); rows are encoded one by one, so
ties, repeated rows and null ids need no rule; an empty table gives an empty result.
Lone surrogates can't occur in Spark strings.  Extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, spread, trimmed

#: Longest word, in bytes, that goes through the recursive query; a power of two.
LONG = 64
#: Words per recursive query, and words a worker remembers.
QUERY_WORDS, REMEMBERED = 8_000, 300_000

ENCODE = f"""
WITH RECURSIVE step(round, w, pos, tok) AS (
    SELECT 0, w, pos, tok FROM start
  UNION ALL
    SELECT s.round + 1, s.w, s.pos - CASE WHEN s.pos > b.best % {LONG} THEN 1 ELSE 0 END,
           CASE WHEN s.pos = b.best % {LONG} THEN b.best // {LONG} ELSE s.tok END
    FROM step s JOIN (
        SELECT x.w, min(m.merged * {LONG} + x.pos) AS best
        FROM step x JOIN step y ON y.w = x.w AND y.pos = x.pos + 1 JOIN merges m ON m.l = x.tok AND m.r = y.tok
        GROUP BY x.w
    ) b ON b.w = s.w
    WHERE s.pos <> b.best % {LONG} + 1
)
SELECT w, tok FROM step JOIN (SELECT w, max(round) AS round FROM step GROUP BY w) USING (w, round) ORDER BY w, pos
"""
DECODE = "SELECT doc, string_agg(surface, '' ORDER BY pos) AS text FROM tokens JOIN vocabulary USING (id) GROUP BY doc"


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Codec:
    """Merge table and vocabulary in an in-memory DuckDB that never spills; one per worker process."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import duckdb
        import regex

        self.ranks, self.split = ranks, regex.compile(pattern).findall
        self.db = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "300MB", "preserve_insertion_order": False, "temp_directory": ""})
        parts = [(ranks[t[:i]], ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        l, r, m = np.array(parts, np.int64).T if parts else np.empty((3, 0), np.int64)
        self.byte = np.array([ranks[bytes([i])] for i in range(256)], np.int64)
        self.table("merges", {"l": l, "r": r, "merged": m})
        self.table("vocabulary", {"id": list(ranks.values()), "surface": [t.decode("latin-1") for t in ranks]})
        self.known: dict[str, bytes] = {}

    def table(self, name: str, columns: dict) -> None:
        self.db.register("_arrow", pa.table(columns))
        self.db.execute(f"CREATE OR REPLACE TABLE {name} AS SELECT * FROM _arrow")
        self.db.unregister("_arrow")

    def heap_word(self, word: bytes) -> list[int]:
        """The same contractions for a long word: a heap of (rank, position) over a linked list."""
        tok, n = [bytes([b]) for b in word], len(word)
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = [(r, i, 2) for i in range(n - 1) if (r := self.ranks.get(word[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, size = heapq.heappop(heap)
            j = after[i] if alive[i] else n
            if j >= n or len(tok[i]) + len(tok[j]) != size:
                continue
            tok[i] += tok[j]
            alive[j], after[i] = False, after[j]
            if after[j] < n:
                before[after[j]] = i
            for a in (before[i], i):
                if a >= 0 and after[a] < n and (r := self.ranks.get(tok[a] + tok[after[a]])) is not None:
                    heapq.heappush(heap, (r, a, len(tok[a]) + len(tok[after[a]])))
        return [self.ranks[t] for t, a in zip(tok, alive, strict=True) if a]

    def learn(self, words: list[str]) -> None:
        """Encodes words that aren't known yet: whole tokens at once, the rest by the recursive query."""
        pack, rest = (lambda ids: np.asarray(ids, "<u4").tobytes()), []
        for w in words:
            b = w.encode()
            if (r := self.ranks.get(b)) is not None:
                self.known[w] = pack([r])
            elif len(b) > LONG:
                self.known[w] = pack(self.heap_word(b))
            else:
                rest.append((w, b))
        for k in range(0, len(rest), QUERY_WORDS):
            part = rest[k : k + QUERY_WORDS]
            size = np.array([len(b) for _, b in part])
            first = np.repeat(np.cumsum(size) - size, size)
            self.table("start", {"w": np.repeat(np.arange(len(part)), size), "pos": np.arange(size.sum()) - first, "tok": self.byte[np.frombuffer(b"".join(b for _, b in part), np.uint8)]})
            got = self.db.execute(ENCODE).fetchnumpy()
            cut = np.searchsorted(got["w"], np.arange(len(part) + 1))
            flat = np.asarray(got["tok"], "<u4").tobytes()
            for (w, _), a, z in zip(part, cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                self.known[w] = flat[4 * a : 4 * z]

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        split = [self.split(t) for t in texts]
        if len(self.known) > REMEMBERED:
            self.known.clear()
        self.learn(list({w for words in split for w in words if w not in self.known}))
        known = self.known.__getitem__
        return [b"".join(map(known, words)) for words in split]

    def decode_batch(self, ids: list[bytes]) -> list[bytes]:
        size = np.array([len(x) // 4 for x in ids], np.int64)
        if not size.sum():
            return [b""] * len(ids)
        first = np.repeat(np.cumsum(size) - size, size)
        self.db.register("tokens", pa.table({"doc": np.repeat(np.arange(len(ids)), size), "pos": np.arange(size.sum()) - first, "id": np.frombuffer(b"".join(ids), "<u4").astype(np.int64)}))
        out = [b""] * len(ids)
        for doc, text in self.db.execute(DECODE).fetchall():
            out[doc] = text.encode("latin-1")
        self.db.unregister("tokens")
        return out


_CODECS: dict[int, Codec] = {}


def codec(ranks: dict[bytes, int], pattern: str) -> Codec:
    key = hash((len(ranks), pattern, hash(frozenset(ranks.items()))))
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = Codec(ranks, pattern)
    return _CODECS[key]


_COLUMNS = {"n_tokens": "long", "ids_sha256": "string", "decoded_sha256": "string", "ids": "array<int>", "decoded": "string"}


def _runner(shared, pattern: str, names: tuple[str, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = None
        sha = lambda xs: pa.array([hashlib.sha256(x).hexdigest() for x in xs], pa.string())
        for batch in batches:
            own = own or codec(shared.value, pattern)
            texts = [t or "" for t in batch.column("text").to_pylist()]
            for k in range(0, len(texts), 250):
                ids = own.encode_batch(texts[k : k + 250])
                back = own.decode_batch(ids)
                made = {
                    "n_tokens": lambda: pa.array([len(x) // 4 for x in ids], pa.int64()),
                    "ids_sha256": lambda: sha(ids),
                    "decoded_sha256": lambda: sha(back),
                    "ids": lambda: pa.array([np.frombuffer(x, "<u4").astype(np.int32) for x in ids], pa.list_(pa.int32())),
                    "decoded": lambda: pa.array([x.decode() for x in back], pa.string()),
                }
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(k, 250), *(made[n]() for n in names)], ["doc_id", *names])

    return run


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, names: tuple[str, ...] = ("n_tokens", "ids", "decoded")) -> DataFrame:
    """doc_id and the columns ``names`` of n_tokens, ids, decoded, ids_sha256 (of the ids as
    little-endian unsigned 32-bit integers) and decoded_sha256: a row per row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(ranks)  # a vocabulary: its size doesn't follow the data
    out = ", ".join(f"{n} {_COLUMNS[n]}" for n in names)
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(trimmed(_runner(shared, pattern, names)), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {out}")


def op2_byte_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    bound_batches(spark, 500, 4 << 20)
    ranks = read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return encode(spread(spark.read.parquet(f"{sf_dir}/documents.parquet")), ranks, public_tokenizers.PATTERN, ("n_tokens", "ids_sha256", "decoded_sha256"))
