"""Orders and partitions: sample sort, space-filling curve, recursive bisection, top-k."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sample_sort(df: DataFrame, *keys, partitions: int | None = None) -> DataFrame:
    """Globally sorted by range partitions from sampled splitters."""
    return (df.repartitionByRange(partitions, *keys) if partitions else df.repartitionByRange(*keys)).sortWithinPartitions(*keys)


def balance(df: DataFrame, partitions: int) -> DataFrame:
    return df.repartition(partitions)


def hilbert(coords: list[Column], bits: int = 16) -> Column:
    """Hilbert index of non-negative integer coordinates below 2^bits, as one built-in expression
    (2 or 3 axes; at most 62 bits in all)."""
    n = len(coords)
    if n * bits > 62:
        raise ValueError("too many bits for a long")
    x = [c.cast("long") for c in coords]
    # Transposed form: undo the excess work axis by axis, from the highest bit; each step is bound by a lambda, so it is computed once.
    state = F.struct(*(c.alias(f"x{i}") for i, c in enumerate(x)))

    def step(s: Column, q: Column) -> Column:
        v = [s[f"x{i}"] for i in range(n)]
        out = F.struct(*(v[i].alias(f"x{i}") for i in range(n)))
        def turner(i: int):
            def turn(a: Column) -> Column:
                p = q - 1
                hit = a[f"x{i}"].bitwiseAND(q) != 0
                t = a["x0"].bitwiseXOR(a[f"x{i}"]).bitwiseAND(p)
                new = [a[f"x{k}"] for k in range(n)]
                first = F.when(hit, a["x0"].bitwiseXOR(p)).otherwise(a["x0"].bitwiseXOR(t))
                ith = F.when(hit, a[f"x{i}"]).otherwise(a[f"x{i}"].bitwiseXOR(t))
                if i == 0:
                    new[0] = F.when(hit, a["x0"].bitwiseXOR(p)).otherwise(a["x0"])
                else:
                    new[0], new[i] = first, ith
                return F.struct(*(new[k].alias(f"x{k}") for k in range(n)))

            return turn

        for i in range(n):
            out = F.get(F.transform(F.array(out), turner(i)), F.lit(0))
        return out

    s = F.aggregate(F.transform(F.sequence(F.lit(bits - 1), F.lit(1), F.lit(-1)), lambda b: F.call_function("shiftleft", F.lit(1).cast("long"), b)), state, step)

    def gray(a: Column) -> Column:
        v = [a["x0"]]
        for i in range(1, n):
            v.append(a[f"x{i}"].bitwiseXOR(v[-1]))
        qs = F.transform(F.sequence(F.lit(bits - 1), F.lit(1), F.lit(-1)), lambda b: F.call_function("shiftleft", F.lit(1).cast("long"), b))
        t = F.aggregate(qs, F.lit(0).cast("long"), lambda t, q: F.when(v[-1].bitwiseAND(q) != 0, t.bitwiseXOR(q - 1)).otherwise(t))
        v = [c.bitwiseXOR(t) for c in v]
        return F.aggregate(F.sequence(F.lit(bits - 1), F.lit(0), F.lit(-1)), F.lit(0).cast("long"), lambda h, b: F.shiftleft(h, n).bitwiseOR(sum((F.call_function("shiftleft", F.call_function("shiftright", c, b).bitwiseAND(F.lit(1).cast("long")), F.lit(n - 1 - i)) for i, c in enumerate(v)), F.lit(0).cast("long"))))

    return F.get(F.transform(F.array(s), gray), F.lit(0))


def curve_partition(df: DataFrame, axes: list[str], partitions: int, bits: int = 16) -> DataFrame:
    """Range partitions along the Hilbert curve of the bounding box; adds the column ``curve``."""
    low = df.agg(*(F.min(a).alias(f"lo_{a}") for a in axes), *(F.max(a).alias(f"hi_{a}") for a in axes)).first()
    cells = [F.least(F.floor((F.col(a) - low[f"lo_{a}"]) / max(low[f"hi_{a}"] - low[f"lo_{a}"], 1e-300) * (1 << bits)), F.lit((1 << bits) - 1)) for a in axes]
    return df.withColumn("curve", hilbert(cells, bits)).repartitionByRange(partitions, "curve")


def bisect(df: DataFrame, axes: list[str], depth: int, accuracy: int = 10_000) -> DataFrame:
    """Recursive bisection: halves at the median of the longest axis, ``depth`` times.  Adds ``part``.
    Medians are sketches over each part, pre-aggregated; the parts number 2^depth."""
    df = df.withColumn("part", F.lit(0))
    for _ in range(depth):
        s = df.groupBy("part").agg(*(F.struct((F.max(a) - F.min(a)).alias("span"), F.lit(i).alias("axis"), F.percentile_approx(a, 0.5, accuracy).cast("double").alias("mid")).alias(f"s{i}") for i, a in enumerate(axes)))
        s = s.select("part", F.greatest(*(F.col(f"s{i}") for i in range(len(axes)))).alias("s") if len(axes) > 1 else F.col("s0").alias("s"))
        along = F.element_at(F.array(*(F.col(a).cast("double") for a in axes)), F.col("s.axis") + 1)
        df = df.join(s, "part").withColumn("part", F.col("part") * 2 + (along > F.col("s.mid")).cast("int")).drop("s")
    return df


def top_k(df: DataFrame, k: int, *keys) -> DataFrame:
    return df.orderBy(*keys).limit(k)


def top_k_by(df: DataFrame, group: str, k: int, *keys, place: str | None = None) -> DataFrame:
    """The first k rows of each group, with their places if a name for them is given; Spark limits ranks before the shuffle."""
    out = df.withColumn("_r", F.row_number().over(Window.partitionBy(group).orderBy(*keys))).where(F.col("_r") <= k)
    return out.withColumnRenamed("_r", place) if place else out.drop("_r")


def ranks(df: DataFrame, *keys: str) -> DataFrame:
    """Adds ``rank``, from 1, in the order of ``keys`` over the whole table: range partitions are counted, and a row's
    place in its partition is added to the counts of those before.  Ties of all keys are in any order."""
    from ..session import checkpoint

    fixed = checkpoint(df.repartitionByRange(*keys).withColumn("_part", F.spark_partition_id()))
    counts = sorted((r["_part"], r["count"]) for r in fixed.groupBy("_part").count().collect())  # a row per partition
    before = [(p, sum(n for _, n in counts[:i])) for i, (p, _) in enumerate(counts)]
    start = df.sparkSession.createDataFrame(before or [(0, 0)], "_part int, _before long")
    place = F.row_number().over(Window.partitionBy("_part").orderBy(*keys))
    return fixed.withColumn("_place", place).join(F.broadcast(start), "_part").withColumn("rank", F.col("_before") + F.col("_place")).drop("_part", "_place", "_before")


def waves(entities: DataFrame, needs: DataFrame, most: int = 1000) -> DataFrame:
    """(id, wave): a topological order by waves; an entity is in the wave after the last of those it needs, pairs (id, dst).
    A cycle is an error."""
    from ..session import checkpoint

    needs = needs.join(entities.select(F.col("id").alias("dst")), "dst", "left_semi").select("id", "dst")
    left, done = checkpoint(entities.select("id").distinct()), None
    for wave in range(most):
        blocked = needs.join(left.select(F.col("id").alias("dst")), "dst", "left_semi").select("id")
        front = checkpoint(left.join(blocked, "id", "left_anti").withColumn("wave", F.lit(wave)))
        if front.isEmpty():
            if not left.isEmpty():
                raise ValueError("the needs hold a cycle")
            break
        done = front if done is None else done.unionByName(front)
        left = checkpoint(left.join(front, "id", "left_anti"))
    return done if done is not None else left.withColumn("wave", F.lit(0))
