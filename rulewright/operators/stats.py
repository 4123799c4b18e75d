"""Post-processing: derived flow variables, means, variances and covariances over iterations, combination of running averages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def mean_variance(df: DataFrame, key: str, values: list[str], expected: int | None = None) -> DataFrame:
    """key, mean_<v>, var_<v> (population).  With ``expected``, missing rows count in the denominator of the
    variance and of the running mean's step, as if they had brought no change."""
    if expected is None:
        return df.groupBy(key).agg(*(f(v).alias(f"{n}_{v}") for v in values for n, f in (("mean", F.avg), ("var", F.var_pop))))
    return df.groupBy(key).agg(*(x for v in values for x in (F.avg(v).alias(f"mean_{v}"), (F.var_pop(v) * F.count(v) / F.lit(expected)).alias(f"var_{v}"))))


def covariance(df: DataFrame, key: str, u: str, v: str, w: str) -> DataFrame:
    """Means, variances and the three covariances of a vector, population."""
    return df.groupBy(key).agg(*(F.avg(c).alias(f"mean_{c}") for c in (u, v, w)), *(F.var_pop(c).alias(f"var_{c}") for c in (u, v, w)), F.covar_pop(u, v).alias("cov_uv"), F.covar_pop(u, w).alias("cov_uw"), F.covar_pop(v, w).alias("cov_vw"))


def combine(parts: DataFrame, key: str, n: str, mean: str, var: str) -> DataFrame:
    """Running averages of several spans into one: key, n, mean, var.  The spans' variances and the squares of their means'
    deviations from the common mean are summed, so nothing cancels."""
    total = parts.groupBy(key).agg(F.sum(n).alias("_n"), (F.sum(F.col(n) * F.col(mean)) / F.sum(n)).alias("_m"))
    j = parts.join(total, key)
    d = F.col(mean) - F.col("_m")
    return j.groupBy(key).agg(F.first("_n").alias("n"), F.first("_m").alias("mean"), (F.sum(F.col(n) * (F.col(var) + d * d)) / F.first("_n")).alias("var"))


def favre_combine(parts: DataFrame, key: str, mass: str, mean: str, var: str) -> DataFrame:
    """Density-weighted averages of several spans into one: key, mass, favre, favre_var; ``mass`` is a span's sum of densities."""
    return combine(parts, key, mass, mean, var).withColumnsRenamed({"n": "mass", "mean": "favre", "var": "favre_var"})


def favre(df: DataFrame, key: str, density: str, values: list[str]) -> DataFrame:
    """Density-weighted means and variances: key, favre_<v>, favre_var_<v>; variances from deviations, in a second pass."""
    rho = F.col(density)
    means = df.groupBy(key).agg(*((F.sum(rho * F.col(v)) / F.sum(rho)).alias(f"favre_{v}") for v in values))
    j = df.join(means, key)
    return j.groupBy(key).agg(*(x for v in values for x in (F.first(f"favre_{v}").alias(f"favre_{v}"), (F.sum(rho * (F.col(v) - F.col(f"favre_{v}")) ** 2) / F.sum(rho)).alias(f"favre_var_{v}"))))


def norms(x: Column, volume: Column) -> list[Column]:
    """Aggregates L1, L2, Linf of a field over cells."""
    total = F.sum(volume)
    return [(F.sum(F.abs(x) * volume) / total).alias("L1"), F.sqrt(F.sum(x * x * volume) / total).alias("L2"), F.max(F.abs(x)).alias("Linf")]


def derived(name: str, ambient: float = 0.0) -> Column:
    """Derived variables over columns u, v, w, a (speed of sound), pg (gauge pressure), x, y, z."""
    speed = F.sqrt(F.col("u") ** 2 + F.col("v") ** 2 + F.col("w") ** 2)
    table = {"m": lambda: speed / F.col("a"), "u": lambda: speed, "p": lambda: F.log10(F.col("pg") + ambient), "P": lambda: F.col("pg") + ambient, "0": lambda: F.col("u"), "1": lambda: F.col("v"), "2": lambda: F.col("w"), **{c: (lambda c=c: F.col(c)) for c in "xyz"}}
    if name not in table:
        raise ValueError(f"no derived variable {name!r}")
    return table[name]()


def compare_columns(a: DataFrame, b: DataFrame, key: str, columns: list[str], least: float, tolerance: float) -> DataFrame:
    """Per column: rms difference, relative difference and whether they agree; unequal lengths disagree."""
    j = a.select(key, *(F.col(c).alias(f"a_{c}") for c in columns)).join(b.select(key, *(F.col(c).alias(f"b_{c}") for c in columns)), key, "full_outer")
    rows = j.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"a_{c}").cast("double").alias("a"), F.col(f"b_{c}").cast("double").alias("b")) for c in columns))).alias("r")).select("r.*")
    x, y = F.col("a"), F.col("b")
    g = rows.groupBy("column").agg(F.sqrt(F.sum((x - y) ** 2)).alias("diff"), F.sqrt(F.sum(F.greatest(x * x, y * y))).alias("size"), F.max((x.isNull() | y.isNull()).cast("int")).alias("missing"))
    rel = F.col("diff") / (F.col("size") + least)
    return g.select("column", "diff", rel.alias("relative"), ((F.col("missing") == 0) & ~((F.col("diff") > least) & (rel > tolerance))).alias("agree"))
