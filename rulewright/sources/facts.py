"""Sources and sinks: variable files, catalogs as Parquet, mesh text files, exporters."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import Catalog, CatalogError, Frame, Kind, Relation, param
from ..functions.options import parse_vars


def read_text(spark: SparkSession, path: str) -> str:
    """A small driver-side file (settings), through Spark's file systems."""
    return spark.read.text(path, wholetext=True).first()[0]


def read_vars(spark: SparkSession, path: str, catalog: Catalog) -> list[str]:
    """Adds a variable file's facts as params and returns their names."""
    values = parse_vars(read_text(spark, path))
    for name, v in values.items():
        catalog.replace(name, param(v))
    return list(values)


def write_catalog(catalog: Catalog, path: str, names: list[str] | None = None) -> list[str]:
    """A Parquet folder per fact, its kind and key space in the folder's name; ids stay beside values.  Blackboxes and symbolic params are skipped."""
    done = []
    for v, r in catalog.facts.items():
        if (names is not None and str(v) not in names) or r.kind is Kind.BLACKBOX or (r.kind is Kind.PARAM and r.frame is None and not isinstance(r.literal, (int, float, str, bool))):
            continue
        space = r.frame.key_space if r.frame else "main"
        r.df().write.mode("overwrite").parquet(f"{path}/{v}~{r.kind.value}~{space}")
        done.append(str(v))
    return done


def read_catalog(spark: SparkSession, path: str, names: list[str] | None = None) -> Catalog:
    out = Catalog()
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    for s in hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(hadoop):
        name, _, rest = s.getPath().getName().partition("~")
        kind, _, space = rest.partition("~")
        if not rest or (names is not None and name not in names):
            continue
        kind = Kind(kind)
        df = spark.read.parquet(str(s.getPath().toString()))
        value = None if kind is Kind.CONSTRAINT else F.col("dst" if kind in (Kind.MAP, Kind.MULTIMAP) else "value")
        out.create(name, Relation(kind, Frame(df, space), value))
    return out


def dump_text(catalog: Catalog) -> Iterator[str]:
    """One JSON line per param and per container's head, for people."""
    for v, r in sorted(catalog.facts.items(), key=lambda x: str(x[0])):
        yield json.dumps({"fact": str(v), "kind": r.kind.value, **({"value": str(r.literal)} if r.frame is None else {"columns": r.df().columns})})


def read_triangle_mesh(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """A text mesh: numbers of triangles and nodes, positions, triangles' nodes, then named boundaries; ``#`` starts a comment.
    Returns pos (id, x, y), triangle_nodes (id, pos, dst), boundaries (name, id)."""
    words = [w for line in read_text(spark, path).splitlines() for w in line.split("#")[0].split()]
    it = iter(words)
    try:
        n_tri, n_node = int(next(it)), int(next(it))
        pos = [(i, float(next(it)), float(next(it))) for i in range(n_node)]
        tri = [(i, k, int(next(it))) for i in range(n_tri) for k in range(3)]
        boundary = []
        for _ in range(int(next(it, 0))):
            name, n = next(it), int(next(it))
            boundary += [(name, int(next(it))) for _ in range(n)]
    except (StopIteration, RuntimeError) as e:
        raise CatalogError(f"{path}: the mesh file ends early") from e
    return {"pos": spark.createDataFrame(pos, "id long, x double, y double"), "triangle_nodes": spark.createDataFrame(tri, "id long, pos int, dst long"), "boundaries": spark.createDataFrame(boundary, "name string, id long")}


def read_numbered(df: DataFrame, numbering: DataFrame) -> DataFrame:
    """Rows in file order to entity order: ``numbering`` is (file_id, id)."""
    return df.join(numbering, "file_id").drop("file_id")


def write_numbered(df: DataFrame, numbering: DataFrame, path: str) -> None:
    """Entity order to file order, sorted over the whole output."""
    df.join(numbering, "id").drop("id").orderBy("file_id").write.mode("overwrite").parquet(path)


def write_ascii(df: DataFrame, path: str, *columns: str) -> None:
    """A space-separated table without a header, in id order."""
    df.orderBy("id").select(*columns).write.mode("overwrite").option("sep", " ").csv(path)


def vtk_lines(pos: DataFrame, cells: DataFrame, fields: dict[str, DataFrame]) -> Iterator[str]:
    """Legacy ASCII unstructured grid, streamed part by part: pos (id, x, y, z) with ids 0..n-1; cells (id, nodes, type)."""
    n, m = pos.count(), cells.count()
    yield from ("# vtk DataFile Version 3.0", "rulewright", "ASCII", "DATASET UNSTRUCTURED_GRID", f"POINTS {n} double")
    for r in pos.orderBy("id").toLocalIterator():
        yield f"{r.x:.12g} {r.y:.12g} {r.z:.12g}"
    total = cells.agg(F.sum(F.size("nodes") + 1)).first()[0] or 0
    yield f"CELLS {m} {total}"
    for r in cells.orderBy("id").toLocalIterator():
        yield f"{len(r.nodes)} {' '.join(map(str, r.nodes))}"
    yield f"CELL_TYPES {m}"
    for r in cells.orderBy("id").toLocalIterator():
        yield str(r.type)
    if fields:
        yield f"POINT_DATA {n}"
    for name, f in fields.items():
        yield from (f"SCALARS {name} double 1", "LOOKUP_TABLE default")
        for r in f.orderBy("id").toLocalIterator():
            yield f"{r.value:.12g}"


def tecplot_lines(pos: DataFrame, cells: DataFrame, fields: dict[str, DataFrame]) -> Iterator[str]:
    """ASCII finite-element zone of bricks (cells: id, nodes of 8)."""
    rows = pos
    for name, f in fields.items():
        rows = rows.join(f.select("id", F.col("value").alias(name)), "id")
    names = ["x", "y", "z", *fields]
    yield "VARIABLES = " + ", ".join(f'"{x}"' for x in names)
    yield f"ZONE N={pos.count()}, E={cells.count()}, F=FEPOINT, ET=BRICK"
    for r in rows.orderBy("id").toLocalIterator():
        yield " ".join(f"{r[x]:.12g}" for x in names)
    for r in cells.orderBy("id").toLocalIterator():
        yield " ".join(str(i + 1) for i in r.nodes)


def cutting_plane(edges: DataFrame, pos: DataFrame, field: DataFrame, normal: tuple[float, float, float], offset: float) -> DataFrame:
    """(id, x, y, z, value): where mesh edges (id, a, b) cross the plane normal . p = offset, linearly interpolated."""
    end = lambda k: pos.select(F.col("id").alias(k), *(F.col(c).alias(f"{c}{k}") for c in "xyz")).join(field.select(F.col("id").alias(k), F.col("value").alias(f"v{k}")), k)
    e = edges.join(end("a"), "a").join(end("b"), "b")
    side = lambda k: sum((F.col(f"{c}{k}") * n for c, n in zip("xyz", normal, strict=True)), F.lit(0.0)) - offset
    e = e.withColumn("_sa", side("a")).withColumn("_sb", side("b")).where((F.col("_sa") < 0) != (F.col("_sb") < 0))
    t = F.col("_sa") / (F.col("_sa") - F.col("_sb"))
    mid = lambda c: (F.col(f"{c}a") + t * (F.col(f"{c}b") - F.col(f"{c}a"))).alias("value" if c == "v" else c)
    return e.select("id", *(mid(c) for c in "xyzv"))


def merge_meshes(a: DataFrame, b: DataFrame, tolerance: float) -> DataFrame:
    """(id, dst): nodes of b glued to the nearest node of a within a tolerance, by grid cells of that size."""
    from ..operators.spatial import _around, _cells

    p = _cells(a, tolerance).withColumnsRenamed({c: f"p{c}" for c in "xyz"}).withColumnRenamed("id", "dst")
    j = _around(_cells(b.select("id", "x", "y", "z"), tolerance), 1).join(p, ["_cx", "_cy", "_cz"])
    d2 = sum(((F.col(c) - F.col(f"p{c}")) ** 2 for c in "xyz"), F.lit(0.0))
    return j.where(d2 <= tolerance * tolerance).groupBy("id").agg(F.min_by("dst", F.struct(d2, F.col("dst"))).alias("dst"))


def transform(pos: DataFrame, translate=(0.0, 0.0, 0.0), scale=(1.0, 1.0, 1.0), mirror: str | None = None, rotate: tuple[str, float] | None = None) -> DataFrame:
    """Affine change of positions: scale, mirror, rotate (axis, degrees), then translate."""
    import math

    from ..functions import vectors as V

    v = V.vec(*(F.col(c) * s * (-1.0 if mirror == c else 1.0) for c, s in zip("xyz", scale, strict=True)))
    if rotate:
        angle = math.radians(rotate[1])
        v = V.rotate(v, rotate[0], math.cos(angle), math.sin(angle))
    out = pos.withColumn("_v", v)
    return out.select(*(c for c in pos.columns if c not in "xyz"), *((F.col(f"_v.{c}") + d).alias(c) for c, d in zip("xyz", translate, strict=True)))


def read_ugrid_ascii(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """An ASCII element mesh (seven counts, node positions, boundary triangles and quadrilaterals, their surface ids, then
    tetrahedra, pyramids, prisms and hexahedra, nodes numbered from 1): pos (id, x, y, z), boundary (id, nodes, surface),
    cells (id, type, nodes).  The text is read by the driver: for meshes of its size."""
    it = iter(read_text(spark, path).split())
    try:
        nodes, tri, quad, tet, pyr, prism, hexa = (int(next(it)) for _ in range(7))
        pos = [(i, float(next(it)), float(next(it)), float(next(it))) for i in range(nodes)]
        ring = [[int(next(it)) - 1 for _ in range(k)] for n, k in ((tri, 3), (quad, 4)) for _ in range(n)]
        surface = [int(next(it)) for _ in ring]
        cells = [(name, [int(next(it)) - 1 for _ in range(k)]) for n, k, name in ((tet, 4, "tet"), (pyr, 5, "pyramid"), (prism, 6, "prism"), (hexa, 8, "hex")) for _ in range(n)]
    except (StopIteration, RuntimeError, ValueError) as e:
        raise CatalogError(f"{path}: not a whole mesh file") from e
    return {"pos": spark.createDataFrame(pos, "id long, x double, y double, z double"), "boundary": spark.createDataFrame([(i, r, s) for i, (r, s) in enumerate(zip(ring, surface, strict=True))], "id long, nodes array<long>, surface int"), "cells": spark.createDataFrame([(i, n, c) for i, (n, c) in enumerate(cells)], "id long, type string, nodes array<long>")}


def read_parameter(spark: SparkSession, path: str, name: str):
    """The value of one param of a fact store."""
    return read_catalog(spark, path, [name]).get(name).df().first()[0]


def write_text(catalog: Catalog, path: str) -> None:
    """Params and containers as text, a JSON line per row, written by the executors; blackboxes are skipped."""
    for v, r in catalog.facts.items():
        if r.kind is Kind.BLACKBOX:
            continue
        df = r.df()
        head = {"fact": str(v), "kind": r.kind.value, "space": r.frame.key_space if r.frame else "main", "columns": df._jdf.schema().toDDL()}
        line = F.to_json(F.struct(*(F.lit(x).alias(k) for k, x in head.items()), F.to_json(F.struct(*df.columns)).alias("row")))
        df.select(line.alias("value")).write.mode("append").text(path)


def read_text_facts(spark: SparkSession, path: str) -> Catalog:
    """The catalog that ``write_text`` wrote."""
    rows = spark.read.text(path).select(F.from_json("value", "fact string, kind string, space string, columns string, row string").alias("r")).select("r.*")
    out = Catalog()
    for h in rows.select("fact", "kind", "space", "columns").distinct().orderBy("fact").collect():  # a row per fact
        kind = Kind(h["kind"])
        df = rows.where(F.col("fact") == h["fact"]).select(F.from_json("row", h["columns"]).alias("r")).select("r.*")
        value = None if kind is Kind.CONSTRAINT else F.col("dst" if kind in (Kind.MAP, Kind.MULTIMAP) else "value")
        out.create(h["fact"], Relation(kind, Frame(df, h["space"]), value))
    return out


def write_vectors(df: DataFrame, path: str) -> None:
    """Arrays of numbers by entity (id, value), their length beside them."""
    df.select("id", F.size("value").alias("size"), "value").write.mode("overwrite").parquet(path)


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    """(id, value) of a vector file; an array of another length than noted is an error."""
    df = spark.read.parquet(path)
    wrong = F.raise_error(F.concat(F.lit("array of the wrong length for entity "), F.col("id").cast("string")))
    return df.select("id", F.when(F.size("value") == F.col("size"), F.col("value")).otherwise(F.when(F.col("id").isNotNull(), wrong.cast(df.schema["value"].dataType))).alias("value"))


def concatenate(spark: SparkSession, folders: list[str], path: str) -> None:
    """The part files of text folders, in order, as one file: bytes are copied from stream to stream, no rows are collected."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(conf).create(target, True)
    for folder in folders:
        at = jvm.org.apache.hadoop.fs.Path(folder)
        fs = at.getFileSystem(conf)
        parts = sorted(str(s.getPath().toString()) for s in fs.listStatus(at) if s.getPath().getName().startswith("part-"))
        for p in parts:
            stream = fs.open(jvm.org.apache.hadoop.fs.Path(p))
            jvm.org.apache.hadoop.io.IOUtils.copyBytes(stream, out, conf, False)
            stream.close()
    out.close()


def write_vtk(pos: DataFrame, cells: DataFrame, fields: dict[str, DataFrame], path: str) -> None:
    """A legacy ASCII unstructured grid: pos (id, x, y, z) with ids 0..n-1, cells (id, nodes, type), node fields (id, value).
    The executors write each section sorted by id; the sections are concatenated."""
    from ..session import checkpoint_dir

    spark = pos.sparkSession
    n, m, total = pos.count(), cells.count(), cells.agg(F.sum(F.size("nodes") + 1)).first()[0] or 0
    folders = []

    def section(head: list[str], rows: DataFrame | None, line=None) -> None:
        for df in (spark.createDataFrame([(i, h) for i, h in enumerate(head)], "id long, value string").coalesce(1).orderBy("id").select("value") if head else None, rows.orderBy("id").select(line.alias("value")) if rows is not None else None):
            if df is not None:
                folders.append(checkpoint_dir(spark, "section"))
                df.write.text(folders[-1])

    text = lambda c: F.col(c).cast("string")
    section(["# vtk DataFile Version 3.0", "rulewright", "ASCII", "DATASET UNSTRUCTURED_GRID", f"POINTS {n} double"], pos, F.concat_ws(" ", *map(text, "xyz")))
    section([f"CELLS {m} {total}"], cells, F.concat_ws(" ", F.size("nodes").cast("string"), F.array_join(F.col("nodes").cast("array<string>"), " ")))
    section([f"CELL_TYPES {m}"], cells, text("type"))
    for i, (name, f) in enumerate(fields.items()):
        section([*([f"POINT_DATA {n}"] if i == 0 else []), f"SCALARS {name} double 1", "LOOKUP_TABLE default"], f, text("value"))
    concatenate(spark, folders, path)
