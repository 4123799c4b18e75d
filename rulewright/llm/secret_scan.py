r"""Secret scans over an incremental blob ledger.

A version of a path is content-addressed by the SHA-256 of its text.  The ledger holds a
row per (blob, rule version) ever scanned, with its findings.  A scan groups the versions by
address, keeps the blobs for which some rule version is unseen, runs those rules
once per blob, appends to the ledger, and joins findings back to all paths.

Defined results: a null text counts as the empty blob; rows are (path, version) pairs and each gets its
blob's findings, repeated rows and null paths included; an empty table gives an empty
result.  Positions count code points, ends are exclusive.  Extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, spread

FOUND = "array<struct<start:int,order:int,kind:string,end:int>>"


@dataclass(frozen=True)
class Rule:
    """A finding is a match whose ``group`` has ``least`` characters or more."""

    kind: str
    version: int
    pattern: str
    least: int = 1
    group: int = 0


#: Matches as long as these rules want are the leftmost ones of the shorter patterns too, since the runs are greedy.
RULES = (
    Rule("assign", 1, r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2),
    Rule("access", 1, r"AKIA[A-Z0-9]+", 20),
    Rule("hex", 1, r"[0-9a-f]{24,}", 24),
)


def scan_text(text: str, rules: tuple[tuple[int, Rule, re.Pattern], ...]) -> list[dict]:
    return [{"start": m.start(), "order": i, "kind": r.kind, "end": m.end()} for i, r, p in rules for m in p.finditer(text) if m.end(r.group) - m.start(r.group) >= r.least]


def _scanner(rules: tuple[Rule, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = [(i, r, re.compile(r.pattern, re.ASCII)) for i, r in enumerate(rules)]
        for batch in batches:
            blob, kind, version, found = [], [], [], []
            for b, text, seen in zip(batch.column("blob").to_pylist(), batch.column("text").to_pylist(), batch.column("seen").to_pylist(), strict=True):
                for one in compiled:
                    if f"{one[1].kind}:{one[1].version}" not in seen:
                        blob.append(b)
                        kind.append(one[1].kind)
                        version.append(one[1].version)
                        found.append(scan_text(text, (one,)))
            t = pa.list_(pa.struct([("start", pa.int32()), ("order", pa.int32()), ("kind", pa.string()), ("end", pa.int32())]))
            yield pa.RecordBatch.from_arrays([pa.array(blob, pa.binary()), pa.array(kind, pa.string()), pa.array(version, pa.int32()), pa.array(found, t)], ["blob", "kind", "version", "found"])

    return run


LEDGER = f"blob binary, kind string, version int, found {FOUND}"


def scan(versions: DataFrame, ledger: DataFrame | None, scratch: Scratch, rules: tuple[Rule, ...] = RULES) -> tuple[DataFrame, DataFrame]:
    """``versions`` has doc_id (the path) and text.  Returns (findings, new ledger rows):
    findings are doc_id, blob, found; ledger rows are blob, kind, version, found, to be appended to the ledger."""
    v = versions.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    v = v.select("doc_id", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("blob"), "text")
    want = F.array(*(F.lit(f"{r.kind}:{r.version}") for r in rules))
    # Copies within a partition meet before the shuffle; after it each address has one text.
    blobs = v.groupBy("blob").agg(F.any_value("text").alias("text"))
    if ledger is None:
        blobs = blobs.withColumn("seen", F.array().cast("array<string>"))
    else:
        done = ledger.groupBy("blob").agg(F.collect_set(F.concat_ws(":", "kind", "version")).alias("seen"))
        blobs = blobs.join(done, "blob", "left").withColumn("seen", F.coalesce("seen", F.array().cast("array<string>"))).where(F.size(F.array_except(want, F.col("seen"))) > 0)
    fresh = scratch.stash(blobs.mapInArrow(_scanner(rules), LEDGER), "ledger")
    asked = F.array_contains(want, F.concat_ws(":", "kind", "version"))
    every = fresh if ledger is None else ledger.select("blob", "kind", "version", "found").unionByName(fresh)
    hits = every.where((F.size("found") > 0) & asked).groupBy("blob").agg(F.flatten(F.collect_set("found")).alias("found"))
    hits = scratch.stash(hits, "hits")
    paths = v.select("doc_id", "blob")
    out = paths.join(hits, "blob", "left").select("doc_id", "blob", F.array_sort(F.coalesce("found", F.array().cast(FOUND))).alias("found"))
    return out, fresh


def scan_pushes(pushes: list[DataFrame], ledger: DataFrame | None, scratch: Scratch, rules: tuple[Rule, ...] = RULES) -> tuple[DataFrame, DataFrame]:
    """A history that arrives in pushes: each scans only the (blob, rule version) pairs that no push before it and
    no row of ``ledger`` has.  Returns (findings of all pushes, ledger)."""
    every: DataFrame | None = None
    for push in pushes:
        found, fresh = scan(push, ledger, scratch, rules)
        ledger = fresh if ledger is None else ledger.select("blob", "kind", "version", "found").unionByName(fresh)
        every = found if every is None else every.unionByName(found)
    return every, ledger


def text_of(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op5_secret_scan(spark, sf_dir: str) -> DataFrame:
    """All documents, as a history of two pushes told apart by a hash: the second finds the blobs of the first in the ledger."""
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    late = F.xxhash64("doc_id") < 0
    found, _ = scan_pushes([docs.where(~late), docs.where(late)], None, Scratch(spark))
    of = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    spans = text_of(F.col("found"))
    return found.select("doc_id", *(of(r.kind) for r in RULES), F.sha2(spans.cast("binary"), 256).alias("base_sha256"), spans.alias("spans"))
