import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from skyobs.operators import grid as g


def test_round_trip(spark):
    pts = spark.createDataFrame([(float(a), float(b)) for a in (-179, -90, 0, 45, 179) for b in (-89, -45, 0, 30, 82, 90, -90)], "lon0 double, lat0 double")
    x, y = g.project(F.col("lon0"), F.col("lat0"))
    back = g.unproject(pts.withColumn("x", x).withColumn("y", y), "x", "y").collect()
    assert max(abs(r.lon - r.lon0) for r in back) < 1e-9
    assert max(abs(r.lat - r.lat0) for r in back) < 1e-9


def test_globe_area():
    assert 4 * g.X_MAX * g.Y_MAX == pytest.approx(5.100656217e14, rel=1e-9)
    assert g.K0 == pytest.approx(0.8667510025721972, abs=1e-12)


def test_global_sizes():
    assert [(x.ncol, x.nrow) for x in (g.Grid.over(100_000), g.Grid.over(25_000), g.Grid.over(5_000))] == [(348, 148), (1390, 588), (6948, 2938)]
    with pytest.raises(ValueError):
        g.Grid.over(25_000, crs=4326)


def test_known_cells(spark):
    grid = g.Grid.over(25_000)
    pts = spark.createDataFrame([(128.6, 35.87), (0.0, 0.0), (10.0, 50.0), (200.0, 0.0)], "lon double, lat double")
    assert [r[0] for r in pts.select(g.lookup(grid, F.col("lon"), F.col("lat"))).collect()] == [170772, 409356, 96644, None]


def test_latitude_table(spark):
    """Cells of 2 degree boxes at 0, 5, ... 75 degrees."""
    want = [80, 88, 80, 80, 80, 72, 72, 64, 64, 56, 48, 48, 40, 32, 24, 16]
    feet = spark.createDataFrame([(k, 0.0, 5.0 * k) for k in range(16)], "id int, lon0 double, lat0 double").select("id", g.box_ring(F.col("lon0"), F.col("lat0"), 2.0, 2.0).alias("ring"))
    got = {r["id"]: r["count"] for r in g.index(feet, g.Grid.over(25_000)).groupBy("id").count().collect()}
    assert [got[k] for k in range(16)] == want


def test_area_weights_add_up(spark):
    grid = g.Grid.over(100_000)
    ring = [(0.3, 10.1), (3.9, 11.7), (2.2, 14.5)]
    feet = spark.createDataFrame([(1, [{"lon": a, "lat": b} for a, b in ring])], "id int, ring array<struct<lon: double, lat: double>>")
    total = g.index_area(feet, grid).agg(F.sum("weight")).first()[0] * grid.res**2
    p = [g.xy(a, b) for a, b in ring]
    assert total == pytest.approx(g.clip_area(p, -1e9, -1e9, 1e9, 1e9), rel=1e-9)


@settings(max_examples=50, deadline=None)
@given(st.floats(-180, 180), st.floats(-90, 90))
def test_points_are_in_the_globe(lon, lat):
    x, y = g.xy(lon, lat)
    assert abs(x) <= g.X_MAX * (1 + 1e-12) and abs(y) <= g.Y_MAX * (1 + 1e-12)
