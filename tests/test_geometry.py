from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortwave.operators import geometry

XYZ = "name string, x double, y double, z double"


def brute(m, t):
    unit = lambda rows: [(n, np.array(v) / np.linalg.norm(v)) for n, *v in rows if np.linalg.norm(v) > 0]
    return {n: min((float(np.linalg.norm(a - b)), k) for k, b in unit(t)) for n, a in unit(m)}


@pytest.mark.parametrize("template", ["even", "crowded", "one"])
def test_nearest_position_against_all_pairs(spark, template):
    """Also where the template is crowded in one corner, so that searches widen round by round."""
    rng = np.random.default_rng(1)
    m = [(f"m{i}", *rng.normal(size=3).tolist()) for i in range(60)] + [("zero", 0.0, 0.0, 0.0)]
    t = {"even": [(f"t{i}", *rng.normal(size=3).tolist()) for i in range(400)], "crowded": [(f"t{i}", *(np.array([0, 0, 5.0]) + 0.2 * rng.normal(size=3)).tolist()) for i in range(400)], "one": [("t", 1.0, 0.0, 0.0)]}[template]
    got = {r["name"]: (r.distance, r.nearest) for r in geometry.nearest_on_sphere(spark.createDataFrame(m, XYZ), spark.createDataFrame(t, XYZ)).collect()}
    want = brute(m, t)
    assert got.keys() == want.keys()
    assert all(got[k][1] == want[k][1] and got[k][0] == pytest.approx(want[k][0]) for k in want)


def test_nearest_position_of_empty_tables(spark):
    rows = spark.createDataFrame([("a", 1.0, 0.0, 0.0)], XYZ)
    assert geometry.nearest_on_sphere(rows.limit(0), rows).count() == 0
    assert [tuple(r) for r in geometry.nearest_on_sphere(rows, rows.limit(0)).collect()] == [("a", None, None)]


def test_triangles_fill_the_hull_and_their_circles_are_empty():
    rng = np.random.default_rng(2)
    for n in (3, 4, 10, 60):
        p = rng.random((n, 2))
        t = geometry.triangles(p)
        assert len({tuple(sorted(x)) for x in t.tolist()}) == len(t)
        for a, b, c in p[t]:
            d = 2 * (a[0] * (b[1] - c[1]) + b[0] * (c[1] - a[1]) + c[0] * (a[1] - b[1]))
            o = np.array([(a @ a) * (b[1] - c[1]) + (b @ b) * (c[1] - a[1]) + (c @ c) * (a[1] - b[1]), (a @ a) * (c[0] - b[0]) + (b @ b) * (a[0] - c[0]) + (c @ c) * (b[0] - a[0])]) / d
            assert (np.linalg.norm(p - o, axis=1) >= np.linalg.norm(a - o) - 1e-9).all()
        # a point lies in a triangle exactly when it lies in the hull: no direction separates it from all points
        cells = rng.random((200, 2)) * 1.4 - 0.2
        at, _, _ = geometry.barycentric(p, cells)
        ways = np.stack([np.cos(np.linspace(0, 2 * np.pi, 7200)), np.sin(np.linspace(0, 2 * np.pi, 7200))])
        gap = ((p @ ways).max(0) - cells @ ways).min(1)
        assert {i for i in range(200) if gap[i] > 1e-3} <= set(at.tolist()) <= {i for i in range(200) if gap[i] > -1e-3}


def test_weights_reproduce_a_plane_and_are_zero_outside(spark):
    rng = np.random.default_rng(3)
    rows = [(s, c, float(x), float(y)) for s in ("a", "b") for c, (x, y) in enumerate(rng.random((30, 2)))]
    pos = spark.createDataFrame([*rows, ("a", 99, None, 1.0), ("line", 0, 0.0, 0.0), ("line", 1, 1.0, 1.0)], "s string, channel long, x double, y double")
    w = geometry.hull_weights(pos, ["s"], "channel", 9).toPandas()
    place = {(s, c): (x, y) for s, c, x, y in rows}
    for s in ("a", "b"):
        own = w[w.s == s]
        assert sorted(set(own.cell)) == list(range(81))
        inside = own.dropna(subset=["channel"])
        assert np.allclose(inside.groupby("cell").w.sum(), 1) and (inside.groupby("cell").size() == 3).all()
        low, high = (f([place[s, c] for c in range(30)], axis=0) for f in (np.min, np.max))
        for cell, part in inside.groupby("cell"):
            at = low + np.array([cell % 9, cell // 9]) / 8 * (high - low)
            assert np.allclose(sum(np.array(place[s, int(c)]) * v for c, v in zip(part.channel, part.w, strict=True)), at)
    assert w[w.s == "line"].channel.isna().all()
    values = pos.where("s = 'a' and x is not null").select("s", "channel", F.lit(1).alias("epoch"), (F.col("x") + 1).alias("v"))
    grid = geometry.project_inside_hull(values, geometry.hull_weights(pos, ["s"], "channel", 9), ["s"], ["epoch"], "channel", "v").toPandas()
    assert len(grid) == 81 and (grid.value == 0).sum() == w[(w.s == "a") & w.channel.isna()].shape[0]
