import glob
import os

import duckdb
import numpy as np
import pytest

from rulewright.operators import spatial
from rulewright.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def rows(df):
    c = sorted(df.columns)
    clean = lambda v: round(float(v), 6) + 0.0 if isinstance(v, float) or hasattr(v, "as_tuple") else v
    return c, sorted(tuple(clean(v) for v in r) for r in df[c].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    assert rows(QUERIES[name](spark, SF).toPandas()) == rows(con.execute(ORACLES[name]).df())


def test_nearest_of_all_vectors(spark):
    """Every vector asks, every other one is searched; repeated places are each other's neighbours."""
    e = spark.read.parquet(f"{SF}/embeddings.parquet").toPandas().sort_values("vec_id")
    ids, x = e.vec_id.to_numpy(), np.stack(e.embedding.to_numpy())[:, :3].astype(float)
    d = ((x[:, None] - x[None]) ** 2).sum(-1)
    np.fill_diagonal(d, np.inf)
    got = {r.id: r.d2 for r in QUERIES["nearest_neighbour"](spark, SF).collect()}
    assert set(got) == set(ids.tolist()) and all(abs(got[i] - m) < 1e-8 for i, m in zip(ids.tolist(), d.min(1), strict=True))
    p = spark.createDataFrame([(1, 0.0, 0.0, 0.0), (3, 0.0, 0.0, 0.0), (5, 9.0, 0.0, 0.0)], "id long, x double, y double, z double")
    assert {r.id: (r.near, r.d2) for r in spatial.nearest(p, p, 0.05, others=True).collect()} == {1: (3, 0.0), 3: (1, 0.0), 5: (1, 81.0)}
    assert spatial.nearest(p.where("id = 1"), p.where("id = 1"), 0.05, others=True).count() == 0


def test_elementwise_maximum_has_every_component(spark):
    e = spark.read.parquet(f"{SF}/embeddings.parquet").toPandas()
    want = {(k, i): round(float(v), 5) for k, g in e.groupby("label") for i, v in enumerate(np.stack(g.embedding.to_numpy()).max(0))}
    assert {(r.label, r.pos): r.value for r in QUERIES["elementwise_maximum"](spark, SF).collect()} == pytest.approx(want, abs=2e-5)
