"""Embedding near-duplicates by collision-counting projections.

Identical vectors are collapsed first.  A routing key, the sides of several random lines at
once, deals vectors into cells, several independent times, so that only vectors alike on
many lines meet; a cell that holds one vector goes at once, and large cells are dealt in block pairs.  Inside a
block pair the vectors are sorted along each of many counting lines, windows centred on each query
give collisions, and collisions are counted per pair; a pair whose count passes a threshold calibrated for
the wanted recall is verified by its cosine in double precision.  A pair that shares several cells counts in the first
of them alone, so a block pair gives out no pairs, only each vector's number of links and a root of those it
connects: rows grow with the vectors, not with their pairs.  Components of the roots come from alternating
large-star and small-star.

Defined results: vectors that are null, empty, zero or hold a null or non-finite component
link with nothing and are their own component; vectors of unlike length never meet; identical vectors
are linked with each other; rows that share a vec_id are one node, whose links add up; a row without
vec_id is linked and counted by its vector, and if no row of that vector has an id it links with its copies
alone, its component is null and it is kept; an empty table gives an empty result.  Extra columns,
whatever their names, are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, components, groups, hot_join, split_blocks, spread

SEED = 20240611
#: Counting lines, half width of a query's window in standard deviations of the difference at the least cosine, wanted recall of the count.
LINES, WINDOW, COUNT_RECALL = 24, 1.5, 0.999
#: Wanted recall of the routing at the least cosine.
ROUTE_RECALL = 0.97
#: Vectors that a cell holds by chance, about.
CHANCE = 0.25
#: Rows of one side of a block pair, and pairs that are counted at once.
BLOCK, PAIRS = 512, 1 << 20


def lines_of(dim: int, n: int, salt: int) -> np.ndarray:
    """n random unit lines, the same wherever they are asked for."""
    x = np.random.default_rng([SEED, dim, salt]).standard_normal((n, dim))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def calibration(least: float, dim: int) -> tuple[float, int]:
    """(window half width, least count): a pair at cosine ``least`` differs on a unit line by about a normal
    of deviation sqrt(2 - 2 cos) / sqrt(dim); the count is binomial, and its low quantile is the threshold."""
    width = WINDOW * math.sqrt((2 - 2 * least) / dim)
    p = math.erf(WINDOW / math.sqrt(2))
    below, c = 0.0, 0
    while c < LINES:
        below += math.comb(LINES, c) * p**c * (1 - p) ** (LINES - c)
        if below > 1 - COUNT_RECALL:
            break
        c += 1
    return width, c


def routing(least: float, n: int) -> tuple[int, int]:
    """(lines per routing key, keys): so many lines that chance fills a cell with few vectors, and as
    many keys as the recall asks for.  A line separates a pair with probability angle / pi."""
    k = max(4, math.ceil(math.log2(max(2, n) / CHANCE)))
    alike = (1 - math.acos(least) / math.pi) ** k
    return k, max(1, math.ceil(math.log(1 - ROUTE_RECALL) / math.log(1 - alike)))


def _usable(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The vector as bytes, floats if they hold it exactly and else doubles, after their size; null where it can't be compared."""
    for batch in batches:
        out = []
        for v in batch.column("embedding").to_pylist():
            x = None if not v or any(c is None for c in v) else np.array(v, np.float64)
            if x is None or not np.isfinite(x).all() or not x.any():
                out.append(None)
                continue
            with np.errstate(all="ignore"):
                short = x.astype(np.float32)
            out.append(b"4" + short.tobytes() if np.array_equal(short.astype(np.float64), x) else b"8" + x.tobytes())
        yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(out, pa.binary())], ["vec_id", "raw"])


def dims(raw: list[bytes]) -> list[int]:
    return [(len(r) - 1) // (4 if r[:1] == b"4" else 8) for r in raw]


def units(raw: list[bytes]) -> np.ndarray:
    """Unit vectors, in doubles, of vectors of one length."""
    x = np.array([np.frombuffer(r, np.float32 if r[:1] == b"4" else np.float64, offset=1) for r in raw], np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def cells_of(x: np.ndarray, k: int, keys: int) -> np.ndarray:
    """(vectors, keys): the cells of unit vectors, no two keys or lengths with the same cells."""
    n, dim = x.shape
    side = (x @ lines_of(dim, k * keys, 1).T >= 0).reshape(n, keys, k)
    cell = (side * (np.uint64(1) << np.arange(k, dtype=np.uint64))).sum(axis=2, dtype=np.uint64)
    salt = (np.arange(1, keys + 1, dtype=np.uint64) + np.uint64(dim << 20)) * np.uint64(0x9E3779B97F4A7C15)
    return ((cell + np.uint64(1)) * np.uint64(0xC2B2AE3D27D4EB4F) ^ salt).view(np.int64)


def _cells(k: int, keys: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, node = batch.column("raw").to_pylist(), batch.column("node").to_numpy()
            dim = np.array(dims(raw))
            for d in np.unique(dim):
                at = np.flatnonzero(dim == d)
                cell = cells_of(units([raw[i] for i in at]), k, keys)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(node[at], keys)), pa.array(cell.ravel())], ["node", "cell"])

    return run


def _expand(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(query, place) for every place in each query's [lo, hi)."""
    n = hi - lo
    return np.repeat(np.arange(len(n)), n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n - lo, n)


def collisions(x: np.ndarray, group: np.ndarray, left: np.ndarray, right: np.ndarray, width: float, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (row of ``left``, row of ``right``) of one group whose places collide on ``least`` counting lines or more.
    ``group`` numbers the rows of x from 0 and never falls; ``left`` and ``right`` are rows in order."""
    size = np.bincount(group[right], minlength=group[-1] + 1)
    start = np.cumsum(size) - size
    first = np.cumsum(size[group[left]]) - size[group[left]]  # of a left row's pairs
    count = np.zeros(int(size[group[left]].sum()), np.uint8)
    for line in lines_of(x.shape[1], LINES, 2):
        place = x @ line + 8.0 * group  # groups lie apart by more than any window
        order = np.argsort(place[right], kind="stable")
        along = place[right][order]
        q, at = _expand(np.searchsorted(along, place[left] - width), np.searchsorted(along, place[left] + width, side="right"))
        r = order[at]
        count[first[q] + r - start[group[right[r]]]] += 1
    hit = np.flatnonzero(count >= least)
    q = np.searchsorted(first + size[group[left]], hit, side="right")
    return left[q], right[start[group[left[q]]] + hit - first[q]]


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest row connected to each of n rows by the links a-b."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        for side in (a, b):
            np.minimum.at(new, side, low)
            np.minimum.at(new, root[side], low)
        new = new[new]
        if np.array_equal(new, root):
            return root
        root = new


def _links(width: float, least_count: int, least: float, k: int, keys: int):
    """For each vector of some block pairs: a vector it is connected to there, and the weight of the vectors it is linked with there."""

    def linked(cols: dict, rows: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        node, left, own = cols["node"][rows], cols["left"][rows].astype(bool), cols["bi"][rows] == cols["bj"][rows]
        x = units([cols["raw"][i] for i in rows])
        q, r = collisions(x, group, np.flatnonzero(left), np.flatnonzero(own | ~left), width, least_count)
        keep = (node[q] != node[r]) & (~own[q] | (node[r] < node[q]))
        q, r = q[keep], r[keep]
        keep = np.concatenate([np.einsum("ij,ij->i", x[q[i : i + 65536]], x[r[i : i + 65536]]) >= least for i in range(0, len(q), 65536)]) if len(q) else np.empty(0, bool)
        q, r = q[keep], r[keep]
        if not len(q):
            return np.empty((3, 0), np.int64)
        used, back = np.unique(np.concatenate([q, r]), return_inverse=True)
        cells, here = cells_of(x[used], k, keys), cols["cell"][rows][q]
        keep = np.zeros(len(q), bool)
        for i in range(0, len(q), 16384):
            same = cells[back[: len(q)][i : i + 16384]] == cells[back[len(q) :][i : i + 16384]]
            keep[i : i + 16384] = cells[back[: len(q)][i : i + 16384], same.argmax(axis=1)] == here[i : i + 16384]
        q, r = q[keep], r[keep]
        copies = cols["copies"][rows].astype(float)
        weight = np.bincount(q, copies[r], len(rows)) + np.bincount(r, copies[q], len(rows))
        at = np.flatnonzero(weight)
        return np.stack([node[at], node[roots(len(rows), q, r)[at]], np.rint(weight[at]).astype(np.int64)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cols, bounds in groups(batches, ["cell", "bi", "bj"]):
            dim = dims([cols["raw"][s] for s, _ in bounds])
            out, part, cost = [], [], 0
            todo = sorted(range(len(bounds)), key=dim.__getitem__)
            for j, g in enumerate(todo):
                s, e = bounds[g]
                if e - s > 1:
                    part.append((s, e))
                    cost += (e - s) ** 2
                if part and (j + 1 == len(todo) or dim[todo[j + 1]] != dim[g] or cost >= PAIRS):
                    rows = np.concatenate([np.arange(s, e) for s, e in part])
                    out.append(linked(cols, rows, np.repeat(np.arange(len(part)), [e - s for s, e in part])))
                    part, cost = [], 0
            found = np.concatenate(out, axis=1) if out else np.empty((3, 0), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in found], ["node", "root", "others"])

    return run


def near_vectors(vectors: DataFrame, scratch: Scratch, least: float = 0.9) -> DataFrame:
    """vec_id, n_links, component_id, kept: a row per row of ``vectors``."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    rows = scratch.stash(rows.mapInArrow(_usable, "vec_id long, raw binary"), "vectors")
    nodes = rows.where("raw IS NOT NULL").groupBy("raw").agg(F.min("vec_id").alias("node"), F.count(F.lit(1)).alias("copies"))
    nodes = scratch.stash(nodes, "nodes")
    known = nodes.where("node IS NOT NULL").select("node", "raw", "copies")
    size = (F.length("raw") - 1) / F.when(F.substring(F.hex("raw"), 1, 2) == "34", 4).otherwise(8)
    sized = known.agg(F.count(F.lit(1)), F.min(size)).first()
    k, keys = routing(least, sized[0])
    width, count = calibration(least, int(sized[1] or 1))  # the shortest vectors need the widest window
    cells = scratch.stash(known.mapInArrow(_cells(k, keys), "node long, cell long"), "cells")
    dealt = scratch.stash(split_blocks(cells, "cell", "node", scratch, BLOCK), "blocks").join(known, "node")
    dealt = dealt.repartition(4 * max(1, dealt.sparkSession.sparkContext.defaultParallelism), "cell", "bi", "bj").sortWithinPartitions("cell", "bi", "bj")
    found = scratch.stash(dealt.mapInArrow(_links(width, count, least, k, keys), "node long, root long, others long"), "links")
    scratch.drop(cells)
    comp = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")), scratch)
    others = found.groupBy("node").agg(F.sum("others").alias("others"))
    per = nodes.join(others, "node", "left").join(comp, "node", "left")
    per = scratch.stash(per.select("raw", F.coalesce("component", "node").alias("component_id"), (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_links"), F.col("copies").alias("_n")), "per-vector")
    out = hot_join(rows.where("raw IS NOT NULL"), per, "raw").select("vec_id", "n_links", "component_id")
    alone = rows.where("raw IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))  # these meet nobody and aren't joined
    return out.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def op7_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    return near_vectors(spread(spark.read.parquet(f"{sf_dir}/embeddings.parquet")), Scratch(spark))
