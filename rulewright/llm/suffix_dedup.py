"""Exact substring deduplication by a hash-compared suffix sort.

Every window of ``length`` bytes has an anchor: the leftmost k-gram of least hash inside it.
Equal windows have equal anchors at equal offsets, so only k-grams that occur
twice or more are followed up.  The windows of one anchor form a chunk of bytes.  Equal
chunks are settled by the first of them.  Different chunks around one anchor are suffix sorted:
suffixes that start at the anchor, and reversed prefixes that end there, are merge-sorted with
comparisons that find the common extension by binary search over prefix polynomial hashes; the
bytes of neighbours are then compared, which proves order and extensions or has the chunks sorted by their bytes.
Ranks then say, for each offset, which windows agree and which of them is first.  Anchors with very many
different chunks send their windows, hashed twice, through a pre-aggregated minimum instead, so no task holds them together.

What was found equal by hashes alone, whole chunks and windows of crowded anchors, is joined to runs of bytes with one
source, and the SHA-256 of a run is held against that of its source.  If one differs, hashes collided: all are
drawn anew and the work is repeated, so chance decides on time alone, never on results.

Texts are hashed in strips and rows leave a worker in small batches, so what a worker holds follows neither the texts' lengths nor the number of their anchors.

A byte is removed if it is covered by a window that also starts earlier (smaller doc_id, or same
document and earlier start), judged on the input.  Texts are read in overlapping pieces, so memory
doesn't follow their length.

Defined results: a null text is empty; rows of equal doc_id and text are one document and get equal
results; rows of one doc_id with different texts are told apart by a 64-bit hash of the text and ordered by
position; a row without doc_id is left whole and is no source for others; an empty table gives an empty
result.  Extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, groups, spread

LENGTH, K = 100, 24
#: Anchors with more different chunks than this go through window hashes.
MANY = 96
#: Bytes of text hashed at once; longer texts are cut into pieces that share LENGTH - 1 bytes.
PIECE = 1 << 20
#: Windows hashed at once; more than there are k-grams in a window.
STRIP = 1 << 15
#: Rows of chunks that leave a worker together.
ROWS = 4096
#: So often hashes are drawn anew before giving up.
DRAWS = 5
#: Windows of a crowded anchor's chunk that are settled together if they are all alike.
BLOCK = 16
_POS = np.uint64((1 << 26) - 1)


class Hashes:
    """Prefix sums of a polynomial over random byte values modulo 2^64; the hash of
    [i, i + n) is (sum[i + n] - sum[i]) * base^i, whatever i is."""

    def __init__(self, seed: int, size: int):
        rng = np.random.default_rng(seed)
        self.value = rng.integers(0, 1 << 64, 256, np.uint64)
        base = int(rng.integers(0, 1 << 64, dtype=np.uint64)) | 1
        back = pow(base, -1, 1 << 64)
        self.up, self.down = self._powers(base, size), self._powers(back, size)

    @staticmethod
    def _powers(base: int, n: int) -> np.ndarray:
        out = np.ones(n + 1, np.uint64)
        filled = 1
        while filled <= n:
            take = min(filled, n + 1 - filled)
            out[filled : filled + take] = out[:take] * np.uint64(pow(base, filled, 1 << 64))
            filled += take
        return out

    def sums(self, data: np.ndarray) -> np.ndarray:
        out = np.zeros(len(data) + 1, np.uint64)
        terms = np.take(self.value, data)
        terms *= self.down[: len(data)]
        np.cumsum(terms, out=out[1:])
        return out

    def each(self, sums: np.ndarray, n: int) -> np.ndarray:
        """The hash of the n bytes from every position on."""
        out = sums[n:] - sums[:-n]
        out *= self.up[: len(out)]
        return out

    def of(self, sums: np.ndarray, at: np.ndarray, n) -> np.ndarray:
        return (sums[at + n] - sums[at]) * self.up[at]


_HASHES: dict[int, Hashes] = {}


def hashes(seed: int, size: int) -> Hashes:
    """The seed's hashes with powers for ``size`` bytes at least; how many are held changes no hash."""
    if seed not in _HASHES or len(_HASHES[seed].up) <= size:
        _HASHES[seed] = Hashes(seed, 1 << int(size).bit_length())
    return _HASHES[seed]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


def _least(key: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each window of w values."""
    have, m = 1, key
    while have * 2 <= w:
        m = np.minimum(m[:-have], m[have:])
        have *= 2
    return m if have == w else np.minimum(m[: len(m) - (w - have)], m[w - have :])


def anchors(texts: list[bytes], length: int = LENGTH, k: int = K, draw: int = 0, bits: int = 64):
    """For texts joined end to end: (text index, anchor position in the text, first window, last window, anchor
    hash, chunk hash), arrays with a row per anchor and unbroken run of windows inside a text."""
    start = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    data = np.frombuffer(b"".join(texts), np.uint8)
    total, w = len(data) - length + 1, length - k + 1
    # Positions are packed relative to a strip, which they can't outgrow.
    strip = min(STRIP, int(_POS) + 2 - w)
    one, two = hashes(1 + 10 * draw, strip + length), hashes(2 + 10 * draw, strip + length)
    found: list[tuple[np.ndarray, ...]] = []
    s = 0
    while s < total:
        e = min(s + strip, total)
        d = data[s : e + length - 1]
        gram = _mix(one.each(one.sums(d), k))
        key = gram & ~_POS
        key |= np.arange(len(key), dtype=np.uint64)
        at = (_least(key, w) & _POS).astype(np.int64)  # the anchor of the window at each position
        t0, t1 = np.searchsorted(start, [s, e - 1], "right") - 1
        edge = np.clip(start[t0 : t1 + 2] - s, 0, e - s)
        text = np.repeat(np.arange(t0, t1 + 1), np.diff(edge))
        p = np.flatnonzero(np.arange(s + length, e + length) <= start[text + 1])  # windows inside a text
        new = np.ones(len(p), bool)
        new[1:] = (at[p[1:]] != at[p[:-1]]) | (text[p[1:]] != text[p[:-1]])
        first, last = p[new], p[np.append(new[1:], True)] if len(p) else p
        s_next = e
        if len(p) and p[-1] == e - s - 1 and e < total:  # the next strip has all of the run that this one cuts
            s_next = s + int(first[-1])
            first, last = first[:-1], last[:-1]
        a, t = at[first], text[first]
        chunk = _mix(two.of(two.sums(d), first, last - first + length) ^ ((a - first).astype(np.uint64) * np.uint64(0x94D049BB133111EB)))
        base = start[t] - s
        found.append((t, a - base, first - base, last - base, gram[a], chunk & np.uint64((1 << bits) - 1)))
        s = s_next
    if not sum(len(x[0]) for x in found):
        return None
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _tag(text: bytes, tagged: bool) -> int:
    """Tells texts under one doc_id apart, where there are any."""
    return int.from_bytes(hashlib.blake2b(text, digest_size=8).digest(), "little", signed=True) if tagged else 0


def _bytes(column: pa.Array) -> Iterator[bytes]:
    """UTF-8 of the texts, one at a time; null is empty."""
    return (v.as_py() or b"" for v in column.cast(pa.binary()))


def _values(column: pa.Array) -> Iterator:
    """Values made one at a time: those of lists would take many times a batch's memory together."""
    return (v.as_py() for v in column)


def _pieces(batches: Iterator[pa.RecordBatch], tagged: bool) -> Iterator[tuple[list[bytes], list[int], list[int], list[int]]]:
    """(texts, or pieces of a long one; their ids, tags and offsets), about PIECE bytes at a time."""
    held: tuple[list, ...] = ([], [], [], [])
    size = 0
    for batch in batches:
        for i, b in zip(batch.column("doc_id").to_pylist(), _bytes(batch.column("text")), strict=True):
            if i is None or len(b) < LENGTH:
                continue
            tag = _tag(b, tagged)
            for s in range(0, len(b) - LENGTH + 1, PIECE):
                piece = b[s : s + PIECE + LENGTH - 1]
                for x, v in zip(held, (piece, i, tag, s), strict=True):
                    x.append(v)
                size += len(piece)
                if size >= PIECE:
                    yield held
                    held, size = ([], [], [], []), 0
    if held[0]:
        yield held


def _anchor_hashes(draw: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts, *_ in _pieces(batches, False):
            yield pa.RecordBatch.from_arrays([pa.array(anchors(texts, draw=draw)[4].view(np.int64))], ["anchor"])

    return run


def _anchor_rows(draw: int, bits: int, tagged: bool):
    """``at`` packs position, offset of the first window before it, and windows after the first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts, ids, tags, offsets in _pieces(batches, tagged):
            t, a, first, last, gram, chunk = anchors(texts, draw=draw, bits=bits)
            at = ((a + np.array(offsets, np.int64)[t]) << 14) | ((a - first) << 7) | (last - first)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (gram.view(np.int64), chunk.view(np.int64), np.array(ids, np.int64)[t], at, np.array(tags, np.int64)[t])], ["anchor", "chunk", "doc", "at", "tag"])

    return run


def _unpack(at):
    return at >> 14, at >> 7 & 127, at & 127


_CUT = "anchor long, doc long, at long, tag long, bytes binary, b1 long, b2 long, window long, w1 array<long>, w2 array<long>"


def _cut_chunks(draw: int, bits: int, tagged: bool):
    """Bytes of the asked chunks; of those around crowded anchors, blocks of at most BLOCK windows that
    start at like offsets from the anchor: a double hash of the block, and of each of its windows."""
    names = ["anchor", "doc", "at", "tag", "bytes", "b1", "b2", "window", "w1", "w2"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())]
    mask = np.uint64((1 << bits) - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, two = hashes(3 + 10 * draw, 128 + LENGTH), hashes(4 + 10 * draw, 128 + LENGTH)
        fold = lambda x: (_mix(x) & mask).view(np.int64)
        out = lambda: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)
        for batch in batches:
            cols: list[list] = [[] for _ in names]
            for doc, b, wanted in zip(batch.column("doc_id").to_pylist(), _bytes(batch.column("text")), _values(batch.column("wanted")), strict=True):
                tag = _tag(b, tagged)
                for w in wanted:
                    if w["tag"] != tag:
                        continue
                    if len(cols[0]) >= ROWS:
                        yield out()
                        cols = [[] for _ in names]
                    p, l, r = _unpack(w["at"])
                    c = b[p - l : p - l + r + LENGTH]
                    if not w["crowded"]:
                        for x, v in zip(cols, (w["anchor"], doc, w["at"], tag, c, None, None, None, None, None), strict=True):
                            x.append(v)
                        continue
                    d = np.frombuffer(c, np.uint8)
                    i, s1, s2 = np.arange(r + 1), one.sums(d), two.sums(d)
                    w1, w2 = (fold(h.of(s, i, LENGTH)) for h, s in ((one, s1), (two, s2)))
                    offset = i - l  # from the anchor
                    cut = np.append(np.flatnonzero(np.append(True, offset[1:] // BLOCK != offset[:-1] // BLOCK)), r + 1)
                    for s, e in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                        salt = np.uint64(((s - l) & 0xFF) << 8 | (e - s))
                        at, n = np.array([s]), e - s - 1 + LENGTH
                        h1, h2 = (int(fold(h.of(x, at, n) ^ salt)[0]) for h, x in ((one, s1), (two, s2)))
                        for x, v in zip(cols, (w["anchor"], doc, w["at"], tag, None, h1, h2, p - l + s, w1[s:e], w2[s:e]), strict=True):
                            x.append(v)
            yield out()

    return run


class SuffixSort:
    """Merge sort of suffixes of ``data`` that start at ``at`` and have ``room`` bytes, inside each
    group, with comparisons by binary search for the common extension over prefix hashes."""

    def __init__(self, data: np.ndarray, at: np.ndarray, room: np.ndarray, seed: int):
        self.data, self.at, self.room = data, at, room
        self.hash = hashes(seed, len(data))
        self.sums = self.hash.sums(data)

    def extension(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Length of the common extension of suffixes x and y."""
        lo, hi = np.zeros(len(x), np.int64), np.minimum(self.room[x], self.room[y])
        ax, ay = self.at[x], self.at[y]
        while (go := lo < hi).any():
            mid = (lo + hi + 1) >> 1
            same = self.hash.of(self.sums, ax, mid) == self.hash.of(self.sums, ay, mid)
            lo, hi = np.where(go & same, mid, lo), np.where(go & ~same, mid - 1, hi)
        return lo

    def less(self, x: np.ndarray, y: np.ndarray, ties: bool) -> np.ndarray:
        n = self.extension(x, y)
        end = (n >= self.room[x]) | (n >= self.room[y])
        i, j = np.minimum(self.at[x] + n, len(self.data) - 1), np.minimum(self.at[y] + n, len(self.data) - 1)
        short = self.room[x] <= self.room[y] if ties else self.room[x] < self.room[y]
        return np.where(end, short, self.data[i] < self.data[j])

    def order(self, group_start: np.ndarray, group_size: np.ndarray) -> np.ndarray:
        """Suffix numbers in sorted order, groups in place.  Runs of doubling width merge by
        ranking each element in its partner run with a binary search."""
        n = len(self.at)
        order, local = np.arange(n), np.arange(n) - group_start
        width = 1
        while width < (group_size.max() if n else 0):
            run = local // width
            other = (run ^ 1) * width
            lo = np.minimum(other, group_size)
            hi = np.minimum(other + width, group_size)
            base = lo.copy()
            left = run % 2 == 0
            while (go := np.flatnonzero(lo < hi)).size:
                mid = (lo[go] + hi[go]) >> 1
                mine, theirs = order[go], order[group_start[go] + mid]
                lead = left[go]
                # A left element goes after the right run's smaller ones, a right element after the left run's not larger ones.
                after = np.empty(len(go), bool)
                if lead.any():
                    after[lead] = self.less(theirs[lead], mine[lead], False)
                if (~lead).any():
                    after[~lead] = self.less(theirs[~lead], mine[~lead], True)
                lo[go] = np.where(after, mid + 1, lo[go])
                hi[go] = np.where(after, hi[go], mid)
            place = group_start + (run // 2) * 2 * width + (local - run * width) + (lo - base)
            new = np.empty(n, np.int64)
            new[place] = order
            order = new
            width *= 2
        return order

    def extensions(self, order: np.ndarray, first: np.ndarray) -> np.ndarray | None:
        """Common extension, by bytes, of each suffix with the one before it in ``order`` (-1 where ``first``); None if the order isn't that of the bytes."""
        ext = np.full(len(order), -1, np.int64)
        x, y = order[1:], order[:-1]
        room = np.minimum(self.room[x], self.room[y])
        i, top = np.arange(int(room.max()) + 1 if len(room) else 1), max(len(self.data) - 1, 0)
        same = (self.data[np.minimum(self.at[x][:, None] + i, top)] == self.data[np.minimum(self.at[y][:, None] + i, top)]) & (i < room[:, None])
        ext[1:] = np.argmin(same, axis=1)
        n = ext[1:]
        after = np.where(n < room, self.data[np.minimum(self.at[x] + n, top)] > self.data[np.minimum(self.at[y] + n, top)], self.room[x] >= self.room[y])
        if not (after | first[1:]).all():
            return None
        ext[first] = -1  # groups stay apart
        return ext

    def sorted(self, group_start: np.ndarray, group_size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(order, extensions), both proved by bytes.  If colliding hashes misled the merge sort, the bytes themselves are sorted."""
        first = np.arange(len(self.at)) == group_start
        order = self.order(group_start, group_size)
        ext = self.extensions(order, first)
        if ext is None:
            order = np.array(sorted(range(len(self.at)), key=lambda j: (group_start[j], self.data[self.at[j] : self.at[j] + self.room[j]].tobytes())), np.int64)
            ext = self.extensions(order, first)
        return order, ext


def repeated_windows(chunks: list[bytes], left: np.ndarray, group: np.ndarray, seed: int = 3) -> Iterator[tuple[np.ndarray, int]]:
    """Rows are sorted by group (anchor) and, inside, by occurrence.  Yields (rows, offset): rows whose
    window that starts ``offset`` bytes before the anchor is also a window of an earlier row."""
    size = np.array([len(c) for c in chunks])
    base = np.concatenate([[0], np.cumsum(size)[:-1]])
    data = np.frombuffer(b"".join(chunks), np.uint8)
    change = np.append(True, group[1:] != group[:-1])
    start = np.flatnonzero(change)
    number = np.cumsum(change) - 1
    count = np.diff(np.append(start, len(group)))
    gs, gn = start[number], count[number]
    right = SuffixSort(data, base + left, np.minimum(size - left, LENGTH), seed)
    back = SuffixSort(data[::-1].copy(), len(data) - (base + left), left, seed)
    ranks = [sort.sorted(gs, gn) for sort in (right, back)]
    last = size - left - LENGTH  # windows after the anchor's own start, may be negative
    for o in range(int(left.max()) + 1 if len(left) else 0):
        has = np.flatnonzero((o <= left) & (-o <= last))
        if len(has) < 2:
            continue
        key = np.zeros(len(group), np.int64)
        for (order, ext), depth in zip(ranks, (LENGTH - o, o), strict=True):
            rank = np.empty(len(order), np.int64)
            rank[order] = np.cumsum((ext < depth) | (ext < 0))
            key = key * (len(order) + 1) + rank
        _, first = np.unique(key[has], return_index=True)
        again = np.ones(len(has), bool)
        again[first] = False
        if again.any():
            yield has[again], o


def _sorted_windows(draw: int):
    """Bytes covered by the repeated windows of whole anchor groups, as (doc, tag, start, end)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cols, bounds in groups(batches, ["anchor"]):
            found: list[np.ndarray] = []
            for k in range(0, len(bounds), 4096):
                part = bounds[k : k + 4096]
                s, e = part[0][0], part[-1][1]
                new = np.append(True, np.any([cols[c][s + 1 : e] != cols[c][s : e - 1] for c in ("anchor", "doc", "at", "tag")], axis=0))
                one = s + np.flatnonzero(new)  # a document's rows may repeat
                p, l, _ = _unpack(cols["at"][one])
                doc, tag = cols["doc"][one], cols["tag"][one]
                for rows, o in repeated_windows([cols["bytes"][i] for i in one], l, cols["anchor"][one], 3 + 10 * draw):
                    found.append(np.stack([doc[rows], tag[rows], p[rows] - o]))
            doc, tag, at = np.concatenate(found, axis=1) if found else np.empty((3, 0), np.int64)
            order = np.lexsort((at, tag, doc))
            doc, tag, at = doc[order], tag[order], at[order]
            new = np.ones(len(at), bool)
            new[1:] = (doc[1:] != doc[:-1]) | (tag[1:] != tag[:-1]) | (at[1:] - at[:-1] > LENGTH)
            first = np.flatnonzero(new)
            last = np.append(first[1:], len(at)) - 1 if len(first) else first
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (doc[first], tag[first], at[first], at[last] + LENGTH)], ["doc", "tag", "start", "end"])

    return run


def union_of(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The maximal runs that [start, end) spans cover."""
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], e))
        else:
            out.append((s, e))
    return out


def _removed(digest: bool, tagged: bool):
    """What stays of each text, and the digests of the runs that it took from others or gave to them."""
    sha = lambda b: hashlib.sha256(b).digest()
    took_t = pa.list_(pa.struct([("fdoc", pa.int64()), ("ftag", pa.int64()), ("fstart", pa.int64()), ("n", pa.int64()), ("digest", pa.binary())]))
    gave_t = pa.list_(pa.struct([("tag", pa.int64()), ("start", pa.int64()), ("n", pa.int64()), ("digest", pa.binary())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, gone, runs, kept, took, gave = [], [], [], [], [], []
            for doc, b, spans, asked in zip(batch.column("doc_id").to_pylist(), _bytes(batch.column("text")), _values(batch.column("spans")), _values(batch.column("asked")), strict=True):
                tag = _tag(b, tagged) if spans or asked else 0
                own = [x for x in spans or () if x["tag"] == tag]
                cut = union_of([(x["start"], x["end"]) for x in own])
                n.append(len(b))
                gone.append(sum(e - s for s, e in cut))
                runs.append(len(cut))
                edge = [0, *(x for span in cut for x in span), len(b)]
                rest = b"".join(b[s:e] for s, e in zip(edge[::2], edge[1::2], strict=True)) if cut else b
                kept.append(hashlib.sha256(rest).hexdigest() if digest else rest)
                # A source that doesn't lie before its copy is a collision too.
                took.append([{"fdoc": x["fdoc"], "ftag": x["ftag"], "fstart": x["fstart"], "n": x["end"] - x["start"], "digest": sha(b[x["start"] : x["end"]]) if (x["fdoc"], x["fstart"]) < (doc, x["start"]) or x["ftag"] != tag else b""} for x in own if x["fdoc"] is not None])
                gave.append([{"tag": tag, "start": x["start"], "n": x["n"], "digest": sha(b[x["start"] : x["start"] + x["n"]])} for x in asked or () if x["tag"] == tag])
            arrays = [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(runs, pa.int64()), pa.array(kept, pa.string() if digest else pa.binary()), pa.array(took, took_t), pa.array(gave, gave_t)]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256" if digest else "kept", "took", "gave"])

    return run


_VERIFIED = "took array<struct<fdoc:long,ftag:long,fstart:long,n:long,digest:binary>>, gave array<struct<tag:long,start:long,n:long,digest:binary>>"


def _attempt(base: DataFrame, scratch: Scratch, digest: bool, tagged: bool, draw: int, bits: int) -> tuple[DataFrame, bool]:
    """The result, written, and whether the bytes bear out what hashes said."""
    # 1. Which k-grams are anchors twice or more?  Only their hashes travel.
    again = base.mapInArrow(_anchor_hashes(draw), "anchor long").groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("anchor")
    again = scratch.stash(again, "repeated-anchors")
    # 2. Their occurrences, with a hash of the chunk around each.
    here = scratch.stash(base.mapInArrow(_anchor_rows(draw, bits, tagged), "anchor long, chunk long, doc long, at long, tag long").join(again, "anchor"), "occurrences")
    scratch.drop(again)
    # 3. Of equal chunks all but the first are repeats.
    chunks = scratch.stash(here.groupBy("anchor", "chunk").agg(F.min(F.struct("doc", "at", "tag")).alias("f"), F.count(F.lit(1)).alias("copies")).select("anchor", "chunk", "f.doc", "f.at", "f.tag", "copies"), "chunks")
    firsts = chunks.where("copies > 1").select("anchor", "chunk", F.col("doc").alias("fdoc"), F.col("at").alias("fat"), F.col("tag").alias("ftag"))
    first = lambda at: F.shiftright(at, 14) - F.shiftright(at, 7) % 128
    end = (first("at") + F.col("at") % 128 + LENGTH).alias("end")
    copies = here.join(firsts, ["anchor", "chunk"]).where("doc <> fdoc OR at <> fat OR tag <> ftag").select("doc", "tag", first("at").alias("start"), end, "fdoc", "ftag", (first("at") - first("fat")).alias("shift"))
    copies = scratch.stash(copies, "copies")
    scratch.drop(here)
    # 4. Different chunks around one anchor: their bytes, or window hashes where they are very many.
    shared = scratch.stash(chunks.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("anchor", (F.col("n") > MANY).alias("crowded")), "shared-anchors")
    wanted = scratch.stash(chunks.join(shared, "anchor").groupBy("doc").agg(F.collect_list(F.struct("anchor", "at", "tag", "crowded")).alias("wanted")), "wanted")
    cut = base.join(wanted, base["doc_id"] == wanted["doc"]).select("doc_id", "text", "wanted").mapInArrow(_cut_chunks(draw, bits, tagged), _CUT)
    cut = scratch.stash(cut, "cut")
    scratch.drop(chunks, wanted, shared)
    few = cut.where("bytes IS NOT NULL").select("anchor", "doc", "at", "tag", "bytes")
    few = few.repartition(4 * max(1, base.sparkSession.sparkContext.defaultParallelism), "anchor").sortWithinPartitions("anchor", "doc", "at", "tag")
    sorted_ = scratch.stash(few.mapInArrow(_sorted_windows(draw), "doc long, tag long, start long, end long"), "sorted")
    # Crowded anchors: of equal blocks all but the first are repeats; the windows of the first ones are compared singly.
    crowd = cut.where("bytes IS NULL").select("b1", "b2", "doc", "window", "tag", "w1", "w2")
    blocks = scratch.stash(crowd.groupBy("b1", "b2").agg(F.min(F.struct("doc", "window", "tag", "w1", "w2")).alias("f"), F.count(F.lit(1)).alias("n")), "blocks")
    claim = lambda end: ("doc", "tag", F.col("window").alias("start"), end.alias("end"), "fdoc", "ftag", (F.col("window") - F.col("fwindow")).alias("shift"))
    other = "doc <> fdoc OR window <> fwindow OR tag <> ftag"
    seen = blocks.where("n > 1").select("b1", "b2", F.col("f.doc").alias("fdoc"), F.col("f.window").alias("fwindow"), F.col("f.tag").alias("ftag"))
    crowded = crowd.join(seen, ["b1", "b2"]).where(other).select(*claim(F.col("window") + F.size("w1") - 1 + LENGTH))
    single = blocks.select("f.doc", "f.window", "f.tag", F.posexplode(F.arrays_zip("f.w1", "f.w2")).alias("i", "w")).select("doc", (F.col("window") + F.col("i")).alias("window"), "tag", F.col("w.w1").alias("h1"), F.col("w.w2").alias("h2"))
    least = single.groupBy("h1", "h2").agg(F.min(F.struct("doc", "window", "tag")).alias("f"), F.count(F.lit(1)).alias("n")).where("n > 1")
    least = scratch.stash(least.select("h1", "h2", F.col("f.doc").alias("fdoc"), F.col("f.window").alias("fwindow"), F.col("f.tag").alias("ftag")), "first-windows")
    claims = copies.unionByName(crowded).unionByName(single.join(least, ["h1", "h2"]).where(other).select(*claim(F.col("window") + LENGTH)))
    # 5. Claims with one source at one distance join to runs of bytes.
    side = ["doc", "tag", "fdoc", "ftag", "shift"]
    run = Window.partitionBy(*side).orderBy("start")
    claims = claims.withColumn("before", F.max("end").over(run.rowsBetween(Window.unboundedPreceding, -1)))
    claims = claims.withColumn("run", F.sum((F.col("before").isNull() | (F.col("start") > F.col("before"))).cast("long")).over(run))
    runs = claims.groupBy(*side, "run").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    runs = scratch.stash(runs.select("doc", "tag", "start", "end", "fdoc", "ftag", (F.col("start") - F.col("shift")).alias("fstart")), "runs")
    scratch.drop(cut, copies)
    # 6. Coverage, document by document, with the digests of the runs on both sides.
    none = F.lit(None).cast("long")
    every = runs.unionByName(sorted_.select("*", none.alias("fdoc"), none.alias("ftag"), none.alias("fstart")))
    spans = every.groupBy("doc").agg(F.collect_list(F.struct("tag", "start", "end", "fdoc", "ftag", "fstart")).alias("spans"))
    asked = runs.select(F.col("fdoc").alias("doc"), F.struct(F.col("ftag").alias("tag"), F.col("fstart").alias("start"), (F.col("end") - F.col("start")).alias("n")).alias("a")).groupBy("doc").agg(F.collect_set("a").alias("asked"))
    per = scratch.stash(spans.join(asked, "doc", "full_outer"), "spans")
    out = base.join(per, base["doc_id"] == per["doc"], "left").select("doc_id", "text", "spans", "asked")
    out = scratch.stash(out.mapInArrow(_removed(digest, tagged), f"doc_id long, n_bytes long, n_removed long, n_spans long, {'kept_sha256 string' if digest else 'kept binary'}, {_VERIFIED}"), "result")
    scratch.drop(runs, sorted_, per)
    took = out.select(F.explode("took").alias("t")).select("t.*").distinct()
    gave = out.select(F.col("doc_id").alias("fdoc"), F.explode("gave").alias("g")).select("fdoc", F.col("g.tag").alias("ftag"), F.col("g.start").alias("fstart"), F.col("g.n").alias("n"), F.col("g.digest").alias("source")).distinct()
    wrong = took.join(gave, ["fdoc", "ftag", "fstart", "n"], "left").where("NOT (digest <=> source)").limit(1).count()
    return out.drop("took", "gave"), not wrong


def remove_repeats(docs: DataFrame, scratch: Scratch, digest: bool = False, bits: int = 64) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (the remaining bytes; their SHA-256 as kept_sha256 with ``digest``): a row per row.
    ``bits`` is how much the first draw keeps of its hashes of chunks and windows; later draws keep all."""
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    texts = base.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min(F.xxhash64("text")).alias("lo"), F.max(F.xxhash64("text")).alias("hi"))
    tagged = texts.where("lo <> hi").limit(1).count() > 0
    for draw in range(DRAWS):
        out, sound = _attempt(base, scratch, digest, tagged, draw, 64 if draw else bits)
        if sound:
            return out
    raise RuntimeError(f"hashes collided in each of {DRAWS} draws")


def op6_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(spread(spark.read.parquet(f"{sf_dir}/documents.parquet")), Scratch(spark), digest=True)
