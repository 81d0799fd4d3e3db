"""Queries without SQL use every row of their tables."""

import math
from pathlib import Path

import pytest

from geotally.plans import bindings, catalogue, rasters

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables")


def test_boosted_model_sees_all_classes(spark):
    got = {r["id"]: r for r in catalogue.QUERIES["ml6_boosted"](spark, DATA).collect()}
    want = {r["id"]: r["label"] for r in bindings.points(spark, DATA).where("city = 'target'").collect()}
    assert {i: r["y_true"] for i, r in got.items()} == want and len(set(want.values())) > 3
    assert max(r["y_pred"] for r in got.values()) >= 3


def test_snap_to_peak_on_every_point(spark):
    height = {(r["city"], r["col"], r["row"]): r["value"] for r in bindings.cells(spark, DATA).collect()}
    got = {r["id"]: r for r in catalogue.QUERIES["ra10_snap_to_peak_every_point"](spark, DATA).collect()}
    points = rasters.tree_points(spark, DATA).collect()
    assert len(got) == len(points) > 1000
    for p in points:
        c, r = math.floor(p["x"]), math.floor(p["y"])
        seen = {(i, j): v for i in range(-3, 4) for j in range(-3, 4) if (v := height.get((p["city"], c + i, r + j))) is not None}
        peaks = [(math.hypot(i, j) / (v + 1), r + j, c + i, math.hypot(i, j)) for (i, j), v in seen.items() if v >= 3 and math.hypot(i, j) <= 3 and v >= max(seen.get((i + a, j + b), -1) for a in (-1, 0, 1) for b in (-1, 0, 1))]
        _, row, col, d = min(peaks, default=(0, p["y"] - 0.5, p["x"] - 0.5, 0.0))
        g = got[p["id"]]
        assert (g["x"], g["y"], g["position_corrected"], g["correction_distance"]) == (col + 0.5, row + 0.5, bool(peaks), round(d, 6)), p["id"]
