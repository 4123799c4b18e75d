"""Toxicity by a counterfactual-regularised classifier.

A logistic scorer over hashed words and word beginnings, fitted on a bounded sample of
labelled documents.  A labelled text that mentions a group is paired with itself after its identity
terms are swapped for others; to one that mentions none a neutral mention is added, drawn by a hash of
the text, and that labelled sentence and its swap are a pair, so every corpus has pairs.  Squared score
changes over pairs are penalised, so which group is mentioned, and that one is, can't make a text toxic.

Defined results: a null or empty text gets the score of no evidence (the bias); labels that
are null are left out, and of several labels of a document the most toxic counts; rows are
scored one by one, so ties, repeated rows and null ids change nothing (a null id is not held out);
an empty documents table gives an empty result; without labels of both classes every
score is the smoothed share of toxic labels.  Extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, spread

#: About so many labelled documents fit the model (a hash-drawn sample, bounded).
SAMPLE = 12_000
#: Hashed feature space, which bounds the model, and the z score a feature needs to be kept.
SPACE, LEAST_Z = 1 << 20, 3.5
#: Word beginnings that are features beside the whole word, in letters.
BEGINNINGS = (4, 5, 6)
#: Weight of the squared score change under a swap, of that under an added mention, and of the squared weights.
SWAP_PENALTY, MENTION_PENALTY, L2 = 10.0, 1.0, 3e-5
#: Groups whose mention is neutral, in the corpus's languages; each term is swapped for the next of its row.
IDENTITIES = (
    ("women", "men", "girls", "boys"),
    ("woman", "man", "girl", "boy"),
    ("christians", "muslims", "jews", "hindus", "buddhists", "atheists"),
    ("christian", "muslim", "jewish", "hindu", "buddhist", "atheist"),
    ("black", "white", "asian", "latino", "african", "european", "arab"),
    ("gay", "lesbian", "straight", "bisexual", "transgender"),
    ("immigrants", "refugees", "foreigners", "natives"),
    ("old", "young", "elderly"),
    ("deaf", "blind", "disabled"),
    ("frauen", "männer", "mädchen", "jungen"),
    ("christen", "muslime", "juden", "hindus", "buddhisten", "atheisten"),
    ("schwarze", "weiße", "asiaten", "afrikaner", "europäer", "araber"),
    ("schwule", "lesben", "bisexuelle", "transgeschlechtliche"),
    ("einwanderer", "flüchtlinge", "ausländer", "einheimische"),
    ("gehörlose", "blinde", "behinderte"),
    ("femmes", "hommes", "filles", "garçons"),
    ("chrétiens", "musulmans", "juifs", "hindous", "bouddhistes", "athées"),
    ("noirs", "blancs", "asiatiques", "africains", "européens", "arabes"),
    ("homosexuels", "lesbiennes", "bisexuels", "transgenres"),
    ("immigrés", "réfugiés", "étrangers", "autochtones"),
    ("sourds", "aveugles", "handicapés"),
    ("mujeres", "hombres", "niñas", "niños"),
    ("cristianos", "musulmanes", "judíos", "hindúes", "budistas", "ateos"),
    ("negros", "blancos", "asiáticos", "africanos", "europeos", "árabes"),
    ("homosexuales", "lesbianas", "bisexuales", "transgénero"),
    ("inmigrantes", "refugiados", "extranjeros", "nativos"),
    ("sordos", "ciegos", "discapacitados"),
)
#: A term of several rows is swapped by the first of them.
_SWAP = {t: row[(i + 1) % len(row)] for row in reversed(IDENTITIES) for i, t in enumerate(row)}
_TERMS = sorted(_SWAP)
_LETTERS = re.compile(r"[^\W\d_]+")


def feature(name: str) -> int:
    return int.from_bytes(hashlib.blake2b(name.encode(), digest_size=4).digest(), "little") % SPACE


def word_features(word: str) -> tuple[int, ...]:
    """The word's letter runs, whole and by their beginnings."""
    out = set()
    for run in _LETTERS.findall(word.lower()):
        out.add(feature(f"w:{run}"))
        out.update(feature(f"b{n}:{run[:n]}") for n in BEGINNINGS if len(run) >= n)
    return tuple(out)


class _Features(dict):
    """Features by word, of those in ``only`` if that is given; bounded."""

    def __init__(self, only: dict[int, int] | None = None):
        super().__init__()
        self.only = only

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) >= 200_000:
            self.clear()
        f = word_features(word)
        v = self[word] = f if self.only is None else tuple(self.only[x] for x in f if x in self.only)
        return v


def text_features(text: str, known: _Features) -> set[int]:
    out: set[int] = set()
    for w in set(text.split()):
        out.update(known[w])
    return out


def swapped(text: str) -> str | None:
    """The text with every identity term replaced by another of its row; None without any."""
    if _SWAP.keys().isdisjoint(_LETTERS.findall(text.lower())):
        return None
    return _LETTERS.sub(lambda m: _SWAP.get(m[0].lower(), m[0]), text)


def mention(text: str) -> str:
    """The group of which a neutral mention is added to the text, drawn by a hash of the text."""
    return _TERMS[zlib.crc32(text.encode()) % len(_TERMS)]


def _sample_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """toxic; x, features of the text; plus, of the text with its mention; swap, of that after the swap.  plus is null if the text itself mentions a group."""
    known, t = _Features(), pa.list_(pa.int32())
    for batch in batches:
        x, plus, swap = [], [], []
        for text in batch.column("text").to_pylist():
            text = text or ""
            own, other, term = text_features(text, known), swapped(text), mention(text)
            x.append(sorted(own))
            plus.append(sorted(own.union(known[term])) if other is None else None)
            swap.append(sorted(own.union(known[_SWAP[term]]) if other is None else text_features(other, known)))
        yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(x, t), pa.array(plus, t), pa.array(swap, t)], ["toxic", "x", "plus", "swap"])


def _only(kept: frozenset[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.list_(pa.int32())
        cut = lambda xs: pa.array([None if x is None else [f for f in x if f in kept] for x in xs], t)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), *(cut(batch.column(c).to_pylist()) for c in ("x", "plus", "swap"))], ["toxic", "x", "plus", "swap"])

    return run


def _score_rows(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, w, bias = shared.value
        known = _Features(index)
        for batch in batches:
            z = np.array([bias + sum(w[i] for i in text_features(t or "", known)) for t in batch.column("text").to_pylist()], float)
            score = 1 / (1 + np.exp(-np.clip(z, -50, 50)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return run


def _csr(lists: list[list[int]], index: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    row = [i for i, fs in enumerate(lists) for f in fs if f in index]
    col = [index[f] for fs in lists for f in fs if f in index]
    return np.array(row, np.int64), np.array(col, np.int64)


def _differences(pairs: list[tuple[list[int], list[int]]], index: dict[int, int]):
    """For each pair of feature lists, what the first has beyond the second and the other way round."""
    return len(pairs), _csr([sorted(set(p) - set(q)) for p, q in pairs], index), _csr([sorted(set(q) - set(p)) for p, q in pairs], index)


def fit_swaps(x: list[list[int]], y: np.ndarray, plus: list[list[int] | None], swaps: list[list[int]], index: dict[int, int], penalty: float = SWAP_PENALTY, mentions: float = MENTION_PENALTY, rounds: int = 400) -> tuple[np.ndarray, float]:
    """Logistic regression with the counterfactual penalties, by Adam on all rows.  A text with an added
    mention is a row beside the text, with its label; ``penalty`` weighs the score changes under swaps, ``mentions`` those that the added mention makes."""
    added = [i for i, p in enumerate(plus) if p is not None]
    swap_pairs = _differences([(x[i] if p is None else p, swaps[i]) for i, p in enumerate(plus)], index)
    mention_pairs = _differences([(x[i], plus[i]) for i in added], index)
    x, y = x + [plus[i] for i in added], np.concatenate([y, y[added]])
    n, d = len(x), len(index)
    w, b, m, v = np.zeros(d), float(np.log((y.sum() + 1) / (n - y.sum() + 1))), np.zeros(d + 1), np.zeros(d + 1)
    row, col = _csr(x, index)
    for t in range(1, rounds + 1):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(row, w[col], n) + b, -50, 50)))
        r = (p - y) / max(n, 1)
        g = np.bincount(col, r[row], d) + 2 * L2 * w
        for (k, first, second), weight in ((swap_pairs, penalty), (mention_pairs, mentions)):
            if k and weight:
                change = np.bincount(first[0], w[first[1]], k) - np.bincount(second[0], w[second[1]], k)
                change *= 2 * weight / k
                g += np.bincount(first[1], change[first[0]], d) - np.bincount(second[1], change[second[0]], d)
        g = np.append(g, r.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return w, b


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, scratch: Scratch, sample: int = SAMPLE, penalty: float = SWAP_PENALTY, mentions: float = MENTION_PENALTY) -> tuple[dict[int, int], np.ndarray, float]:
    """(index of kept features, weights, bias) from labelled documents that aren't held out."""
    known = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").where(~held_out(F.col("doc_id"))).groupBy(F.col("doc_id").alias("_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    known = scratch.stash(known, "labels")
    share = min(1.0, sample / max(1, known.count()))
    drawn = known.where((F.xxhash64("_id", F.lit(3)) + F.lit(2.0**63)) / F.lit(2.0**64) < share)
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(drawn), F.col("doc_id") == F.col("_id"))  # at most the sample's bound
    rows = scratch.stash(texts.select("toxic", "text").mapInArrow(_sample_rows, "toxic int, x array<int>, plus array<int>, swap array<int>"), "sample")
    n = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    n0, n1 = n.get(0, 0), sum(v for k, v in n.items() if k)
    if not n0 or not n1:
        return {}, np.zeros(0), float(np.log((n1 + 1) / (n0 + 1)))
    # A feature's z score: difference of its shares in the two classes.
    seen = rows.select((F.col("toxic") > 0).cast("int").alias("y"), F.explode("x").alias("f")).groupBy("f").agg(F.sum("y").alias("a"), F.sum(1 - F.col("y")).alias("b"))
    mean = (F.col("a") + F.col("b") + 1) / F.lit(n0 + n1 + 2)
    z = F.abs(F.col("a") / F.lit(n1) - F.col("b") / F.lit(n0)) / F.sqrt(mean * (1 - mean) * F.lit(1 / n0 + 1 / n1))
    best = [r["f"] for r in seen.select("f", z.alias("z")).where(f"z >= {LEAST_Z}").select("f").collect()]  # of SPACE features, those of the sample that tell the classes apart
    always = {f for t in _SWAP for f in word_features(t)}
    index = {f: i for i, f in enumerate(sorted({*best, *always}))}
    held = rows.mapInArrow(_only(frozenset(index)), rows.schema).toArrow()  # of the sample, kept features alone
    scratch.drop(rows, known)
    x, y, plus, swap = (held.column(c).to_pylist() for c in ("x", "toxic", "plus", "swap"))
    order = sorted(range(len(y)), key=lambda i: (y[i], len(x[i]), x[i], swap[i], plus[i] or []))
    pick = lambda xs: [xs[i] for i in order]
    return index, *fit_swaps(pick(x), np.array([float(v > 0) for v in pick(y)]), pick(plus), pick(swap), index, penalty, mentions)


def score(docs: DataFrame, model: tuple[dict[int, int], np.ndarray, float]) -> DataFrame:
    """doc_id, held_out, score, predicted: a row per row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most SPACE features
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_score_rows(shared), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double, predicted int")


def op10_toxicity(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spread(spark.read.parquet(f"{sf_dir}/{t}.parquet")) for t in ("documents", "labels"))
    return score(docs, fit(docs, labels, Scratch(spark)))
