"""MinHash near-duplicate detection.

Many universal hash minima per document, banded into buckets; bucket members are
linked to a few representatives, links are checked on signatures and confirmed on
full shingle sets; components come from alternating large-star and small-star.
What stays in different components inside a bucket is compared in full, in block
pairs of that bucket: a pair belongs to the first band it shares, signatures show which rows
need their sets, and only those rows travel with them.  So no link between different texts is
lost to the choice of representatives, and no pairs are given out but links that join components.

Defined results: a null or blank text has an empty set, is linked with nothing and is
its own component; rows of one normalised text form one class, whose node is its smallest doc_id; rows that
share a doc_id but not a text are nodes of their own texts that count as one document; a row without doc_id
joins its text's class, and if no row of that text has an id its component is null and it is kept.
Extra columns, whatever their names, are ignored by ``near_duplicates`` and carried by ``deduplicate``,
which keeps one row of each class, repeated rows and rows without doc_id included.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType, StructField, StructType

from .common import Scratch, components, groups, hot_join, spread, trimmed

BANDS, ROWS = 32, 5
#: Signature agreement below this rules a pair out: five standard deviations under the threshold.
SLACK = 5.0
#: Bucket representatives: the smallest id and this many hash-drawn others.
DRAWN = 3
#: Representatives of a node that are confirmed first, the best of so many hash classes.
PICKED = 4
#: Rows of one side of a block pair.
BLOCK = 512
#: Most words whose hashes a Python worker remembers.
WORDS_KEPT = 200_000
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


class _WordIds(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORDS_KEPT:
            self.clear()
        v = self[word] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        return v


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _M1
    return x ^ (x >> np.uint64(29))


def shingle_set(words: list[bytes], k: int, ids: _WordIds) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles; fewer words: the whole sequence as one."""
    if not words:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(ids.__getitem__, words), np.uint64, len(words))
    n = max(1, len(w) - k + 1)
    h = np.full(n, min(len(w), k), np.uint64)
    for i in range(min(k, len(w))):
        h = _mix(h * _M2 + w[i : i + n])
    return np.unique(h)


def hash_family(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Multiply-shift universal hashes: odd multipliers and offsets, fixed by the seed."""
    rng = np.random.default_rng(20240917)
    return rng.integers(0, 1 << 64, n, np.uint64) | np.uint64(1), rng.integers(0, 1 << 64, n, np.uint64)


def minima(s: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    best = np.full(len(a), np.uint64(0xFFFFFFFFFFFFFFFF))
    for i in range(0, len(s), 256):
        np.minimum(best, (s[i : i + 256, None] * a + b).min(axis=0), out=best)
    return (best >> np.uint64(32)).astype(np.uint32)


def normal_words(text: str | None) -> list[bytes]:
    """ASCII lower case, split at ASCII white space."""
    return (text or "").encode().lower().split()


def text_key(words: list[bytes]) -> bytes:
    """128 bits of the normalised text."""
    return hashlib.blake2b(b" ".join(words), digest_size=16).digest()


def _signatures(k: int, bands: int, rows: int):
    a, b = hash_family(bands * rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, seen = _WordIds(), {}
        for batch in batches:
            key, n, sig = [], [], []
            for text in batch.column("text").to_pylist():
                words = normal_words(text)
                h = text_key(words)
                if h not in seen:
                    if len(seen) > 5_000:
                        seen.clear()
                    s = shingle_set(words, k, ids)
                    seen[h] = (len(s), minima(s, a, b).tobytes() if len(s) else None)
                key.append(h)
                n.append(seen[h][0])
                sig.append(seen[h][1])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(key, pa.binary()), pa.array(n, pa.int64()), pa.array(sig, pa.binary())], ["doc_id", "key", "n", "sig"])

    return run


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """(signatures, bands) of bucket keys, no two bands with the same ones."""
    s = sig.reshape(len(sig), bands, rows).astype(np.uint64)
    h = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * _M1, s.shape[:2]).copy()
    for i in range(rows):
        h = _mix(h * _M2 + s[:, :, i])
    return h.view(np.int64)


def _band_rows(bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sigs = batch.column("sig").to_pylist()
            h = band_keys(np.frombuffer(b"".join(sigs), np.uint32).reshape(len(sigs), bands * rows), bands, rows)
            ids = np.repeat(batch.column("node").to_numpy(), bands)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(h.ravel())], ["node", "bucket"])

    return run


def agreement(x: bytes, y: bytes) -> float:
    return float((np.frombuffer(x, np.uint32) == np.frombuffer(y, np.uint32)).mean())


def _agree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        est = [agreement(x, y) for x, y in zip(batch.column("sa").to_pylist(), batch.column("sb").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(est, pa.float64())], ["a", "b", "est"])


def _shared_first(bands: np.ndarray, a: np.ndarray, b: np.ndarray, bucket: int) -> np.ndarray:
    """Of pairs of rows, those whose first shared band is ``bucket``."""
    same = bands[a] == bands[b]
    return bands[a, same.argmax(axis=1)] == bucket


def _candidates(cols: dict, s: int, e: int, bands: int, rows: int, least: float) -> Iterator[tuple[int, np.ndarray]]:
    """(row, rows) of a block pair that lie in different components, agree on enough minima and share no earlier band."""
    comp, left = cols["comp"][s:e], cols["left"][s:e].astype(bool)
    if (comp == comp[0]).all():
        return
    own = cols["bi"][s] == cols["bj"][s]
    sig = np.frombuffer(b"".join(cols["sig"][s:e]), np.uint32).reshape(e - s, -1)
    keys, right = band_keys(sig, bands, rows), np.flatnonzero(left if own else ~left)
    for i in np.flatnonzero(left):
        near = right[right < i] if own else right
        near = near[comp[near] != comp[i]]
        near = near[(sig[near] == sig[i]).mean(axis=1) >= least]
        near = near[_shared_first(keys, near, np.full(len(near), i), cols["bucket"][s])]
        if len(near):
            yield i, near


def _flag(least: float, bands: int, rows: int):
    """(node, bucket) of the rows that have a candidate in a block pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cols, bounds in groups(batches, ["bucket", "bi", "bj"]):
            out = []
            for s, e in bounds:
                hit = np.zeros(e - s, bool)
                for i, near in _candidates(cols, s, e, bands, rows, least):
                    hit[i] = True
                    hit[near] = True
                out.append(s + np.flatnonzero(hit))
            at = np.concatenate(out)
            yield pa.RecordBatch.from_arrays([pa.array(cols["node"][at]), pa.array(cols["bucket"][at])], ["node", "bucket"])

    return run


def _cross(least: float, percent: int, bands: int, rows: int):
    """Links between different components inside a block pair of a bucket: full sets decide on the
    candidates, and a pair whose components a link found here has joined already needs no test."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cols, bounds in groups(batches, ["bucket", "bi", "bj"]):
            out_a, out_b = [], []
            for s, e in bounds:
                comp, node = cols["comp"][s:e].copy(), cols["node"][s:e]
                sets = [np.frombuffer(x, np.uint64) for x in cols["shingles"][s:e]]
                size = np.array([len(x) for x in sets])
                for i, near in _candidates(cols, s, e, bands, rows, least):
                    near = near[comp[near] != comp[i]]
                    if not len(near):
                        continue
                    others = np.concatenate([sets[j] for j in near])
                    hit = sets[i][np.minimum(np.searchsorted(sets[i], others), size[i] - 1)] == others
                    both = np.add.reduceat(hit.astype(np.int64), np.concatenate([[0], np.cumsum(size[near])[:-1]]))
                    for j in near[100 * both >= percent * (size[i] + size[near] - both)]:
                        if comp[i] != comp[j]:
                            out_a.append(max(node[i], node[j]))
                            out_b.append(min(node[i], node[j]))
                            comp[comp == comp[j]] = comp[i]
            yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], ["a", "b"])

    return run


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = _WordIds()
        for batch in batches:
            words = [normal_words(t) for t in batch.column("text").to_pylist()]
            key = [text_key(w) for w in words]
            sets = [shingle_set(w, k, ids).tobytes() for w in words]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(key, pa.binary()), pa.array(sets, pa.binary())], ["doc_id", "key", "shingles"])

    return run


def _confirm(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(batch.column("xa").to_pylist(), batch.column("xb").to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return run


def deal_open(rows: DataFrame, scratch: Scratch, block: int = BLOCK) -> DataFrame:
    """Block pairs for rows (node, bucket, comp) of buckets that hold several components.  Rows of a bucket's commonest component need
    not meet each other: the others, split into blocks, meet each other and the blocks of the commonest.  Adds bi, bj and left as ``split_blocks`` does."""
    sizes = rows.groupBy("bucket", "comp").agg(F.count(F.lit(1)).alias("k")).groupBy("bucket").agg(F.sum("k").alias("_n"), F.max("k").alias("_k"), F.max_by("comp", F.struct("k", "comp")).alias("_mode"))
    blocks = lambda n: F.ceil(n / block).cast("long")
    sizes = scratch.stash(sizes.where("_n > _k").select("bucket", "_n", "_mode", blocks(F.col("_n") - F.col("_k")).alias("_mb"), blocks(F.col("_k")).alias("_ob")), "sizes")
    h, common = F.xxhash64("node", F.lit(7)), F.col("comp") == F.col("_mode")
    own = F.when(common, F.col("_mb") + F.pmod(h, F.col("_ob"))).otherwise(F.pmod(h, F.col("_mb")))
    others = F.sequence(F.lit(0).cast("long"), F.when(common, F.col("_mb") - 1).otherwise(F.col("_mb") + F.col("_ob") - 1))
    dealt = hot_join(rows, sizes, "bucket").withColumn("_own", own).withColumn("_other", F.explode(others))
    return dealt.select(*rows.columns, F.least("_own", "_other").alias("bi"), F.greatest("_own", "_other").alias("bj"), (F.col("_own") <= F.col("_other")).alias("left"))


def near_duplicates(docs: DataFrame, scratch: Scratch, k: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, key (of the normalised text), n_shingles, component_id, kept: a row per row of ``docs``."""
    least = percent / 100 - SLACK * (percent / 100 * (1 - percent / 100) / (bands * rows)) ** 0.5
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows_of = scratch.stash(base.mapInArrow(trimmed(_signatures(k, bands, rows)), "doc_id long, key binary, n long, sig binary"), "signatures")
    classes = scratch.stash(rows_of.where("n > 0").groupBy("key").agg(F.min("doc_id").alias("node"), F.count(F.lit(1)).alias("_n")), "classes")
    # A class's signature is that of its smallest doc_id's row; texts that share a doc_id are nodes of one name.
    nodes = scratch.stash(rows_of.where("n > 0 AND doc_id IS NOT NULL").select("doc_id", "key", "sig").join(classes.where("node IS NOT NULL").select("node", "key"), "key").where("doc_id = node").dropDuplicates(["key"]).select("node", "key", "sig"), "nodes")

    buckets = scratch.stash(nodes.mapInArrow(trimmed(_band_rows(bands, rows)), "node long, bucket long").distinct(), "buckets")
    drawn = [F.min_by("node", F.xxhash64("node", "bucket", F.lit(i))).alias(f"r{i}") for i in range(DRAWN)]
    reps = scratch.stash(buckets.groupBy("bucket").agg(F.count(F.lit(1)).alias("_n"), F.min("node").alias("r"), *drawn).where("_n > 1"), "representatives")
    picked = F.explode(F.array_distinct(F.array("r", *(f"r{i}" for i in range(DRAWN)))))
    star = hot_join(buckets, reps, "bucket").select("node", picked.alias("rep")).where("node <> rep").select(F.greatest("node", "rep").alias("a"), F.least("node", "rep").alias("b")).distinct()
    side = lambda s: nodes.select(F.col("node").alias(s), F.col("sig").alias(f"s{s}"))
    star = scratch.stash(scratch.stash(star, "star").join(side("a"), "a").join(side("b"), "b").select("a", "b", "sa", "sb").mapInArrow(trimmed(_agree), "a long, b long, est double").where(F.col("est") >= least), "candidates")

    def sets_of(need: DataFrame, name: str) -> DataFrame:
        """The full sets of the given nodes, by node and text, read from their texts again."""
        texts = base.join(need.select(F.col("node").alias("_need")), F.col("doc_id") == F.col("_need"), "left_semi")
        sets = texts.mapInArrow(trimmed(_sets(k)), "doc_id long, key binary, shingles binary").where(F.length("shingles") > 0)
        return scratch.stash(sets.join(nodes.select("key", "node"), "key").where("doc_id = node").select("node", "key", "shingles").dropDuplicates(["key"]), name)

    # First the most promising representatives of each node; they connect nearly all that is connected.
    mine = lambda i: F.pmod(F.xxhash64("b"), F.lit(PICKED)) == i
    best = star.groupBy("a").agg(*(F.max_by(F.when(mine(i), F.col("b")), F.when(mine(i), F.col("est"))).alias(f"b{i}") for i in range(PICKED)))
    first = scratch.stash(best.select("a", F.explode(F.array_compact(F.array(*(f"b{i}" for i in range(PICKED))))).alias("b")), "first")
    sets = sets_of(scratch.stash(first.select(F.col("a").alias("node")).union(first.select("b")).distinct(), "first-nodes"), "first-sets")
    x = lambda s: sets.select(F.col("node").alias(s), F.col("shingles").alias(f"x{s}"))
    links = scratch.stash(first.join(x("a"), "a").join(x("b"), "b").select("a", "b", "xa", "xb").mapInArrow(trimmed(_confirm(percent)), "a long, b long").distinct(), "links")
    comp = scratch.stash(components(links, scratch), "components")
    scratch.drop(sets, star)

    # Then, in every bucket that holds several components, what lies in different ones: signatures say which rows need their sets.
    labelled = buckets.join(reps.select("bucket"), "bucket", "left_semi").join(comp, "node", "left").select("node", "bucket", F.coalesce("component", "node").alias("comp"))
    labelled = scratch.stash(labelled, "labelled")
    open_ = scratch.stash(labelled.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("_n")).where("lo <> hi").select("bucket", "_n"), "open-buckets")
    inside = scratch.stash(hot_join(labelled, open_, "bucket"), "open-rows")
    scratch.drop(labelled, reps)
    wide = 4 * max(1, docs.sparkSession.sparkContext.defaultParallelism)
    deal = lambda d: d.repartition(wide, "bucket", "bi", "bj").sortWithinPartitions("bucket", "bi", "bj")
    flagged = deal(deal_open(inside, scratch).join(nodes.select("node", "sig"), "node")).mapInArrow(trimmed(_flag(least, bands, rows)), "node long, bucket long").distinct()
    flagged = scratch.stash(flagged.join(inside, ["node", "bucket"]), "flagged")
    held = scratch.stash(sets_of(flagged.select("node").distinct(), "flagged-sets").join(nodes.select("key", "sig"), "key").select("node", "sig", "shingles"), "held")
    more = deal(deal_open(flagged, scratch).join(held, "node")).mapInArrow(trimmed(_cross(least, percent, bands, rows)), "a long, b long").distinct()
    more = scratch.stash(more, "more-links")
    scratch.drop(inside, flagged, held)
    full = scratch.stash(components(links.unionByName(more), scratch), "all-components")
    per = scratch.stash(classes.join(full, "node", "left").select("key", F.coalesce("component", "node").alias("component_id"), "_n"), "classes-of-components")
    some = hot_join(rows_of.where("n > 0").select("doc_id", "key", "n"), per, "key")
    blank = rows_of.where("n = 0").select("doc_id", "key", "n", F.col("doc_id").alias("component_id"))  # these share a key, but meet nobody
    out = some.select("doc_id", "key", "n", "component_id").unionByName(blank)
    return out.select("doc_id", "key", F.col("n").alias("n_shingles"), "component_id").withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        key = [text_key(normal_words(t)) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("text"), pa.array(key, pa.binary())], ["row", "text", "key"])


def deduplicate(docs: DataFrame, scratch: Scratch, k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` with one row of each class: that with the smallest doc_id.  Of the rows of one doc_id
    one stays, and of a text that no row with an id has, one; blank texts without doc_id all stay."""
    found = scratch.stash(near_duplicates(docs, scratch, k, percent), "found")
    many = scratch.stash(found.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("doc_id").alias("_many")), "repeated-ids")
    gone = found.where("NOT kept").select(F.col("doc_id").alias("_gone")).union(many).distinct()
    gone = scratch.stash(gone, "gone")
    out = docs.where(docs["doc_id"].isNotNull()).join(gone, docs["doc_id"] == gone["_gone"], "left_anti")
    held = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), docs["doc_id"].alias("id"), docs["text"].cast("string").alias("text"))
    if many.limit(1).count():
        stay = found.where("kept").join(many, F.col("doc_id") == F.col("_many"), "left_semi").select(F.col("doc_id").alias("id")).distinct()
        out = out.union(held.join(stay, "id", "left_semi").groupBy("id").agg(F.min_by("row", F.xxhash64("text")).alias("row")).select("row.*"))
    if found.where("doc_id IS NULL").limit(1).count():
        keyed = held.where("id IS NULL").select("row", "text")
        keyed = keyed.mapInArrow(trimmed(_keyed), StructType([keyed.schema["row"], StructField("text", StringType()), StructField("key", BinaryType())]))
        blank = F.col("key") == F.lit(bytearray(text_key([])))
        own = found.where("doc_id IS NULL AND n_shingles > 0 AND component_id IS NULL").select("key").distinct()
        out = out.union(keyed.where(~blank).join(own, "key", "left_semi").groupBy("key").agg(F.min_by("row", F.xxhash64("text")).alias("row")).select("row.*"))
        out = out.union(keyed.where(blank).select("row.*"))
    return out


def op9_minhash_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return near_duplicates(docs, Scratch(spark), k=2).drop("key")
