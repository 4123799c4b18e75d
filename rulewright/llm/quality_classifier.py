"""Quality classifier from weak labels.

Overlapping heuristic labellers vote good or bad or abstain on every document.
Expectation-maximisation over the counted vote patterns of all documents estimates the share of
bad documents, each labeller's accuracy on bad and on good ones, and a posterior label per pattern;
the number of patterns is bounded by 3 to the number of labellers.  Posterior labels of a bounded
sample train a hashed linear scorer, which then scores every whole text.  One pass over the texts
gives votes and features; the scorer reads the stored features.

Defined results: null and blank texts, and those of fewer than LEAST_WORDS words, get no votes, the
prior as posterior and the score of their features, but are never rejected for it (``kept`` is true:
there is nothing to judge); rows are scored one by one, so ties, repeated rows and null ids change
nothing; an empty table gives an empty result.  Extra columns, whatever their names, are ignored by
``score`` and carried by ``keep_good``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, BooleanType, DoubleType, LongType, StructField, StructType

from .common import Scratch, bound_batches, spread, trimmed

#: At most about so many documents train the scorer (a hash-drawn sample).
SAMPLE = 6000
#: Hashed feature space.
DIM = 2048
#: A document whose scored probability of being good is below this is rejected.
THRESHOLD = 0.5
SYMBOLS = frozenset(b"#$%&*|<>")
#: Votes of a labeller.
ABSTAINS, BAD, GOOD = 0, 1, 2
#: Labellers: (name, share from which it votes bad, share up to which it votes good).  In between it abstains.
LABELLERS = [("symbols", 0.2, 0.02), ("capitals", 0.35, 0.1), ("repeated neighbours", 0.05, 0.02), ("one word dominates", 0.15, 0.08), ("bars", 0.15, 0.01), ("exclamations", 0.25, 0.05), ("odd word lengths", 0.03, 0.01), ("few plain words", 0.3, 0.05), ("long runs", 0.15, 0.02), ("little varied prose", 0.5, 0.1)]
#: Expectation-maximisation starts from this share of bad documents, and these shares of bad votes on bad and on good ones.
START = (0.1, 0.5, 0.05)
#: Fewer words than this and every labeller abstains.
LEAST_WORDS = 4
SHAPES = 6 * 4 * 8
READ = StructType([StructField("pattern", LongType()), StructField("n", LongType()), StructField("at", BinaryType()), StructField("count", BinaryType())])


def word_shape(word: bytes) -> int:
    """Kind of letters, kind of ending and length class of a word, as a number below SHAPES."""
    w = word.decode()
    letters = sum(map(str.isalpha, w))
    if not any(map(str.isalnum, w)):
        kind = 4
    elif any(map(str.isdigit, w)):
        kind = 3
    elif w.islower():
        kind = 0
    elif letters > 1 and w.isupper():
        kind = 2
    else:
        kind = 1 if w[:1].isupper() and w[1:] == w[1:].lower() else 5
    end = 3 if word[-1] in SYMBOLS else 2 if word[-1:] in b"!?" and word[-2:-1] in b"!?" and len(word) > 1 else 1 if word[-1] in b".,;:!?" else 0
    return kind * 32 + end * 8 + min(7, (max(letters, 1) - 1) // 2)


class _Shapes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= 150_000:
            self.clear()
        v = self[word] = word_shape(word)
        return v


def _hashed(x: np.ndarray, salt: int) -> np.ndarray:
    x = (x.astype(np.uint64) + np.uint64(salt << 40)) * np.uint64(0x9E3779B97F4A7C15)
    return ((x >> np.uint64(33)) % np.uint64(DIM)).astype(np.int64)


def read_words(text: str | None, shapes: _Shapes) -> tuple[np.ndarray, np.ndarray]:
    words = (text or "").encode().split()
    n = len(words)
    return np.fromiter(map(shapes.__getitem__, words), np.int64, n), np.fromiter(map(hash, words), np.int64, n)


def votes(shape: np.ndarray, ident: np.ndarray) -> int:
    """The labellers' votes as the digits of a number to the base 3, the first labeller highest."""
    n = len(shape)
    if n < LEAST_WORDS:
        return 0
    kind, end, size = shape // 32, shape // 8 % 4, shape % 8
    bare, same, top = kind == 4, ident[1:] == ident[:-1], np.unique(ident, return_counts=True)[1].max() / n
    plain = (kind < 2) & (end < 2)
    shares = [
        ((end == 3) & ~bare).mean(), (kind == 2).mean(), same.mean(), top, (bare & (end == 3)).mean(), (end == 2).mean(), ((size == 7) & ~bare).mean(), 1 - plain.mean(),
        5 * (same[4:] & same[3:-1] & same[2:-2] & same[1:-3] & same[:-4]).sum() / n if n > 5 else 0.0, 1 - (plain[1:] & ~same).mean(),
    ]
    out = 0
    for share, (_, bad, good) in zip(shares, LABELLERS, strict=True):
        out = out * 3 + (BAD if share >= bad else GOOD if share <= good else ABSTAINS)
    return out


def unpack_votes(patterns: list[int]) -> np.ndarray:
    """(patterns, labellers) of votes."""
    k = len(LABELLERS)
    return np.array(patterns, np.int64)[:, None] // 3 ** np.arange(k - 1, -1, -1) % 3


def features(shape: np.ndarray, ident: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed counts of shapes, neighbouring shapes and repetitions at distances 1 to 3, as (places, counts) of those that occur."""
    lags = [_hashed(shape[lag:][ident[lag:] == ident[:-lag]] // 32, 2 + lag) for lag in (1, 2, 3)]
    x = np.bincount(np.concatenate([_hashed(shape, 1), _hashed(shape[:-1] * SHAPES + shape[1:], 2), *lags]), minlength=DIM)
    at = np.flatnonzero(x)
    return at.astype(np.uint16), x[at].astype(np.uint32)


@dataclass(frozen=True)
class Labelling:
    """What expectation-maximisation estimates: P(good) per pattern, the share of bad documents, and each labeller's
    accuracy on bad and on good documents, of its votes that aren't abstentions."""

    good: np.ndarray
    bad_share: float
    on_bad: np.ndarray
    on_good: np.ndarray


def expectation_maximisation(vote: np.ndarray, counts: np.ndarray, rounds: int = 1000) -> Labelling:
    """vote: (patterns, labellers); counts: documents per pattern.  Labellers err independently, at rates of
    their own on bad and on good documents; an abstention says nothing.  Each rate and the share of bad
    documents start from START, which says which class is which, and one smoothing vote keeps them off 0 and 1."""
    bad, good = (vote == BAD).astype(float), (vote == GOOD).astype(float)
    share, (on_bad, on_good) = START[0], (np.full(vote.shape[1], x) for x in START[1:])  # rates of bad votes
    q = None
    for _ in range(rounds):
        log = np.log((1 - share) / share) + bad @ np.log(on_good / on_bad) + good @ np.log((1 - on_good) / (1 - on_bad))
        new = 1 / (1 + np.exp(-np.clip(log, -700, 700)))
        if q is not None and np.abs(new - q).max() < 1e-10:
            break
        q = new
        n1, n0 = counts * (1 - q), counts * q
        on_bad = (n1 @ bad + START[1]) / (n1 @ (bad + good) + 1)
        on_good = (n0 @ bad + START[2]) / (n0 @ (bad + good) + 1)
        share = (n1.sum() + START[0]) / (counts.sum() + 1)
    return Labelling(q, float(share), on_bad, 1 - on_good)


def fit_linear(x: np.ndarray, y: np.ndarray, rounds: int = 200, l2: float = 1e-4) -> np.ndarray:
    """Logistic regression on soft labels, both classes weighted alike; the last weight is the bias."""
    used = np.flatnonzero(x.any(axis=0))
    x = np.hstack([x[:, used], np.ones((len(x), 1), np.float32)])
    w, m, v = (np.zeros(x.shape[1], np.float32) for _ in range(3))
    weight = (y / max(y.sum(), 1e-9) + (1 - y) / max((1 - y).sum(), 1e-9)).astype(np.float32)
    y = y.astype(np.float32)
    for t in range(1, rounds + 1):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -50, 50)))
        g = x.T @ (weight * (p - y)) + l2 * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= np.float32(0.1) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    out = np.zeros(DIM + 1)
    out[used], out[-1] = w[:-1], w[-1]
    return out


def _read_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    shapes = _Shapes()
    for batch in batches:
        pattern, n, at, count = [], [], [], []
        for text in batch.column("text").to_pylist():
            shape, ident = read_words(text, shapes)
            pattern.append(votes(shape, ident))
            n.append(len(shape))
            x, c = features(shape, ident)
            at.append(x.tobytes())
            count.append(c.tobytes())
        yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(pattern, pa.int64()), pa.array(n, pa.int64()), pa.array(at, pa.binary()), pa.array(count, pa.binary())], ["row", "pattern", "n", "at", "count"])


def _values(at: list[bytes], count: list[bytes], n: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, place, root of the share of the words) of the stored features."""
    size = np.array([len(x) // 2 for x in at], np.int64)
    row = np.repeat(np.arange(len(at)), size)
    return row, np.frombuffer(b"".join(at), np.uint16).astype(np.int64), np.sqrt(np.frombuffer(b"".join(count), np.uint32) / np.maximum(np.array(n, float)[row], 1))


def _score_rows(w: np.ndarray, posterior: dict[int, float], whole: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pattern, n, at, count = (batch.column(c).to_pylist() for c in ("pattern", "n", "at", "count"))
            row, place, value = _values(at, count, n)
            z = np.bincount(row, value * w[place], len(n)) + w[-1]
            score = 1 / (1 + np.exp(-np.clip(z, -50, 50)))
            kept = (score >= THRESHOLD) | (np.array(n) < LEAST_WORDS)
            if whole:
                yield batch.select(["row"]).filter(pa.array(kept, pa.bool_()))
            else:
                yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array([posterior[p] for p in pattern], pa.float64()), pa.array(score, pa.float64()), pa.array(kept, pa.bool_())], ["row", "posterior", "score", "kept"])

    return run


def read(docs: DataFrame, columns: list[str], scratch: Scratch) -> DataFrame:
    """row (a struct of ``columns``), pattern, n (words), at and count (features): a row per row of ``docs``, written."""
    bound_batches(docs.sparkSession, 500, 4 << 20)
    rows = docs.select(F.struct(*(docs[c] for c in columns)).alias("row"), docs["text"].cast("string").alias("text"))
    return scratch.stash(rows.mapInArrow(trimmed(_read_rows), StructType([rows.schema["row"], *READ.fields])), "read")


def fit(rows: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, dict[int, float], Labelling | None]:
    """(weights, posterior by pattern, labelling) from the votes in all ``rows`` of ``read`` and a sample of the different feature vectors."""
    counted = {r["pattern"]: r["n"] for r in rows.groupBy("pattern").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most 3 to the number of labellers
    keys = sorted(counted)
    if not keys:
        return np.zeros(DIM + 1), {}, None
    found = expectation_maximisation(unpack_votes(keys), np.array([counted[p] for p in keys], float))
    posterior = dict(zip(keys, found.good.tolist(), strict=True))
    voted, key = rows.where("pattern <> 0"), F.xxhash64("n", "at", "count")
    share = sample / max(1, voted.agg(F.approx_count_distinct(key)).first()[0])
    drawn = voted.where((key + F.lit(2.0**63)) / F.lit(2.0**64) < min(1.0, share)).select("pattern", "n", "at", "count").distinct().toArrow()
    pattern, n, at, count = (drawn.column(c).to_pylist() for c in ("pattern", "n", "at", "count"))
    row, place, value = _values(at, count, n)
    x, y = np.zeros((len(n), DIM), np.float32), np.array([posterior[p] for p in pattern], float)
    x[row, place] = value
    x, y = x[np.abs(y - 0.5) > 0.2], y[np.abs(y - 0.5) > 0.2]
    order = np.lexsort((y, x @ np.arange(DIM, dtype=np.float32)))  # the rows' order can't move the weights
    return fit_linear(x[order], y[order]) if len(y) else np.zeros(DIM + 1), posterior, found


def score(docs: DataFrame, scratch: Scratch, sample: int = SAMPLE) -> DataFrame:
    """doc_id, posterior (of its votes alone), score (of the trained scorer), kept: a row per row of ``docs``."""
    rows = read(docs, ["doc_id"], scratch)
    w, posterior, _ = fit(rows, sample)
    kind = StructType([rows.schema["row"], *(StructField(c, DoubleType()) for c in ("posterior", "score")), StructField("kept", BooleanType())])
    return rows.mapInArrow(trimmed(_score_rows(w, posterior, False)), kind).select("row.doc_id", "posterior", "score", "kept")


def keep_good(docs: DataFrame, scratch: Scratch, sample: int = SAMPLE) -> DataFrame:
    """The rows of ``docs`` that the scorer keeps, with all their columns."""
    rows = read(docs, docs.columns, scratch)
    w, posterior, _ = fit(rows, sample)
    return rows.mapInArrow(trimmed(_score_rows(w, posterior, True)), StructType([rows.schema["row"]])).select("row.*")


def op1_quality_classifier(spark, sf_dir: str) -> DataFrame:
    return score(spread(spark.read.parquet(f"{sf_dir}/documents.parquet")), Scratch(spark))
