import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from skyobs.functions import special
from skyobs.operators import detect, evaluate, phenology, raster, simulate
from skyobs.sources import harvest, sinks, stac
from skyobs.operators import grid as g


def pixels(spark, value, name="cloud"):
    r, c = value.shape
    return spark.createDataFrame([(0, i + 1, j + 1, float(value[i, j])) for i in range(r) for j in range(c)], f"scene int, row int, col int, {name} double")


def matrix(df, name, shape):
    out = np.zeros(shape)
    for r in df.collect():
        out[r["row"] - 1, r["col"] - 1] = r[name]
    return out


def test_offset_identity():
    for h in (500, 3000, 12000):
        for z in (20, 45, 70):
            dx, dy = raster.shadow_offset(h, z, 137.0)
            assert np.hypot(dx, dy) == pytest.approx(h * np.tan(np.radians(z)), abs=1e-8)
    with pytest.raises(ValueError):
        raster.shadow_offset(-1, 40, 0)


def test_half_even():
    assert raster.pixel_shift(250, 100, 45, 270)[0] == 2  # 2.5 pixels


def test_dilate_is_a_diamond(spark):
    m = np.zeros((7, 7))
    m[3, 3] = m[0, 6] = 1
    want = m.copy()
    for _ in range(2):
        want = np.maximum.reduce([want, *(simulate.moved(want, a, b) for a, b in ((1, 0), (-1, 0), (0, 1), (0, -1)))])
    px = pixels(spark, m)
    assert (matrix(raster.dilate(px, "cloud", 2), "cloud", m.shape) == want).all()
    full = pixels(spark, np.ones((4, 4)))
    assert matrix(raster.erode(full, "cloud", 1), "cloud", (4, 4)).all()  # the border doesn't erode


def test_height_is_recovered(spark):
    cloud, dark = np.zeros((40, 40)), np.zeros((40, 40))
    cloud[17:22, 17:22] = 1
    dark[7:12, 17:22] = 1  # 10 pixels north
    px = pixels(spark, cloud).join(pixels(spark, dark, "darkness"), ["scene", "row", "col"])
    found = raster.shadow_search(px, res=100, zenith=45, azimuth=180, heights=range(200, 2001, 200))
    best = found.best.first()
    assert (best.height, best.score, best.truncated) == (1000.0, 1.0, False)
    assert found.shadow.count() == 25
    with_none = raster.shadow_search(px.withColumn("cloud", F.lit(0.0)), res=100)
    assert with_none.best.count() == 0 and with_none.shadow.count() == 0


def test_lapse(spark):
    bt = np.full((50, 50), 300.0)
    bt[19:30, 19:30] = 280
    px = pixels(spark, bt, "tir1").withColumn("cloud", (F.col("tir1") < 290).cast("int"))
    assert raster.cloud_height(px).first().height == pytest.approx(20 / 0.0065, abs=1)


def test_terrain(spark):
    z = np.zeros((40, 40))
    z[:, 29:] = 600
    dem = pixels(spark, z, "z")
    east = matrix(raster.terrain_shadow(dem, 75, 90, 40, 40), "shadow", z.shape)
    assert east.sum() > 0 and not east[:, 29:].any()
    assert not matrix(raster.terrain_shadow(dem, 75, 270, 40, 40), "shadow", z.shape)[:, :29].any()
    assert raster.terrain_shadow(dem, 0, 90, 40, 40).filter("shadow > 0").count() == 0


def test_simulator_and_detector_agree(spark):
    made = simulate.scene(special.rng(1, 7), 96, 96, 0.2, 0.2, (1.0, 1.0), height=2000, res=30, zenith=40, azimuth=150, noise=0.001)
    assert abs((made["opacity"] > 0).mean() - 0.2) < 0.05
    r, c = np.mgrid[1:97, 1:97]
    import pandas as pd

    px = spark.createDataFrame(pd.DataFrame({"scene": 0, "row": r.ravel(), "col": c.ravel(), **{k: made[k].ravel() for k in ("cloud", "nir", "swir16", "blue", "green", "red", "swir22", "shadow")}}))
    dark = raster.darkness(px, "nir", "swir16", cloud="cloud")
    best = raster.shadow_search(dark, res=30, zenith=40, azimuth=150, heights=range(500, 4001, 100)).best.first()
    assert abs(best.height - 2000) <= 200
    p = detect.probability(px, "fmask", thermal=False)
    iou = p.agg(F.try_divide(F.sum(F.col("is_cloud") * F.col("cloud")), F.sum(F.greatest("is_cloud", "cloud")))).first()[0]
    assert iou > 0.5


def test_qa_classes(spark):
    df = spark.createDataFrame([(8,), (16,), (0,), (1,), (None,), (0b11 << 8,)], "qa int")
    assert [r["class"] for r in detect.qa_decode(df, "qa", "landsat8").collect()] == [4, 5, 1, 0, None, 4]


def test_registry(spark):
    with pytest.raises(ValueError):
        detect.register(detect.Method("fmask", lambda b, d: F.lit(0.0)))
    detect.register(detect.Method("half", lambda b, d, **_: F.lit(0.5), ("blue",)), overwrite=True)
    assert detect.probability(spark.createDataFrame([(0, 1, 1, 0.1)], "scene int, row int, col int, blue double"), "half").first().is_cloud == 1
    with pytest.raises(ValueError, match="needs the bands"):
        detect.probability(spark.createDataFrame([(0, 1)], "scene int, row int"), "fmask")
    with pytest.raises(ValueError, match="model"):
        detect.probability(spark.createDataFrame([(0.1, 0.1, 0.1)], "blue double, red double, nir double"), "unet")


def test_confusion_metrics(spark):
    rows = [(1, 1)] * 60 + [(0, 1)] * 10 + [(1, 0)] * 5 + [(0, 0)] * 25 + [(None, 1)]
    t = evaluate.confusion(spark.createDataFrame(rows, "pred int, truth int"))
    one = evaluate.per_class(t).filter("class = 1").first()
    assert (one.precision, one.recall, one.iou) == pytest.approx((60 / 65, 60 / 70, 60 / 75))
    assert evaluate.overall(t).first().overall_accuracy == pytest.approx(0.85)


def test_extremes(spark):
    df = spark.createDataFrame([(float(k % 2), k % 2) for k in range(100)], "prob double, truth int")
    assert evaluate.auc(evaluate.roc(df)).first()[0] == pytest.approx(1, abs=0.02)
    assert evaluate.calibration_summary(df).first().brier == 0
    assert evaluate.calibration_summary(df.withColumn("prob", F.lit(0.5))).first().brier > 0.2


def test_comparison(spark):
    g = np.random.default_rng(0)
    truth = (g.random(2000) < 0.35).astype(int)
    good, poor = truth.copy(), (g.random(2000) < 0.35).astype(int)
    good[:50] = 1 - good[:50]
    df = spark.createDataFrame([(int(a), int(b), int(c), k % 40) for k, (a, b, c) in enumerate(zip(good, poor, truth))], "good int, poor int, truth int, block int")
    for how in ("distinct", "multinomial"):
        found = evaluate.compare(df, ["poor", "good"], block="block", resample=how)
        assert found.summary[0]["method"] == "good" and found.pairwise[0]["p_value"] < 0.001
        assert all(r["lower"] <= r["accuracy"] <= r["upper"] for r in found.summary)


def test_compared_with_the_best(spark):
    g = np.random.default_rng(4)
    truth = g.integers(0, 2, 3000)
    off = lambda share: np.where(g.random(3000) < share, 1 - truth, truth)
    a, b, c = off(0.1), off(0.12), off(0.4)
    df = spark.createDataFrame([(int(k % 60), *map(int, v)) for k, v in enumerate(zip(truth, a, b, c))], "block int, truth int, a int, b int, c int")
    got = {r.method: r for r in evaluate.compared(df, ["a", "b", "c"], block="block").collect()}
    assert {r.best for r in got.values()} == {"a"} and got["a"].p_value is None and got["b"].p_value > 1e-4 > got["c"].p_value
    assert all(abs(got[m].accuracy - (v == truth).mean()) < 1e-12 and got[m].lower < got[m].accuracy < got[m].upper for m, v in zip("abc", (a, b, c)))
    width = lambda how: (lambda r: r.upper - r.lower)(evaluate.bootstrap(df, ["c"], block="block", resample=how).first())
    assert abs(width("multinomial") - 3.92 * np.sqrt(0.24 / 3000)) < 0.012 and width("distinct") < width("multinomial")


def test_fits_of_many_series_at_once():
    g = np.random.default_rng(3)
    doy, seen = np.sort(g.uniform(1, 365, (40, 60)), axis=1), g.random((40, 60)) < 0.5
    seen[0] = False
    value = np.array([phenology.curve(d, (0.1, 0.5, g.uniform(80, 150), g.uniform(230, 300), 0.1, 0.1)) for d in doy]) + g.normal(0, 0.03, doy.shape)
    many = phenology.fit_many(doy, value, seen)
    alone = [phenology.fit(d[k], v[k]) for d, v, k in zip(doy, value, seen)]
    assert [f.converged for f in many] == [f.converged for f in alone] and not many[0].converged
    assert sum(a.sos == b.sos and a.eos == b.eos for a, b in zip(many, alone)) >= 38


def test_fits_of_observed_series(spark):
    rows = [(k, float(d), float(phenology.curve(np.array([d]), (0.1, 0.5, 90 + 10 * k, 260, 0.1, 0.1))[0])) for k in range(5) for d in range(5, 360, 9)]
    rows += [(9, 5.0, 1.0), (9, None, 1.0), (2, 100.0, None)]
    df = spark.createDataFrame(rows, "cell int, doy double, value double")
    for model, near in (("dbl_logistic", 1.5), ("spline", 12)):
        got = {r.cell: r for r in phenology.fit_series(df, ["cell"], model=model).collect()}
        assert not got[9].converged and all(abs(got[k].sos - (90 + 10 * k)) <= near and got[k].converged for k in range(5))


def test_power_of_a_curve_of_ones_own(spark):
    obs = spark.sql("SELECT 1 AS cell, date_add(DATE'2020-01-01', CAST(id * 5 AS INT)) AS date, 0.0 AS cloud_fraction FROM range(73)")
    got = phenology.power(phenology.replicates(obs, n_sim=10, noise=0.001, true_curve=lambda d: 0.2 + 0.4 * np.exp(-(((d - 180) / 50) ** 2)))).first()
    assert got.failure_rate == 0 and got.sos_mae < 4 and 110 < got.reference_sos < 160


def test_phenology():
    for model in ("dbl_logistic", "spline"):
        f = phenology.fit(phenology.GRID, phenology.curve(phenology.GRID), model)
        assert f.converged and abs(f.sos - 120) <= (5 if model == "dbl_logistic" else 25) and abs(f.eos - 280) <= (5 if model == "dbl_logistic" else 25)
    assert not phenology.fit(np.arange(5.0), np.ones(5)).converged


def test_cloud_harms_retrieval(spark):
    import datetime as dt

    rows = [(c, dt.date(2023, 1, 1) + dt.timedelta(5 * k), cf) for c, cf in ((1, 0.2), (2, 0.6), (3, 0.9)) for k in range(73)]
    p = {r.cell: r for r in phenology.power(phenology.replicates(spark.createDataFrame(rows, "cell int, date date, cloud_fraction double"), n_sim=40, rho=0.7)).collect()}
    assert p[1].n_usable_median == 73 and p[1].failure_rate <= p[2].failure_rate <= p[3].failure_rate
    assert p[1].sos_mae <= 3


@settings(max_examples=30, deadline=None)
@given(st.floats(0.01, 0.99), st.floats(0, 0.99))
def test_markov_is_stationary(p, rho):
    p11, p01 = p + (1 - p) * rho, p * (1 - rho)
    assert p01 / (p01 + 1 - p11) == pytest.approx(p)


S2 = '{"type":"Feature","id":"S2A_52SDG_20240615_0_L2A","collection":"sentinel-2-l2a","geometry":{"type":"Polygon","coordinates":[[[128.0,35.5],[129.0,35.5],[129.0,36.4],[128.0,36.4],[128.0,35.5]]]},"properties":{"datetime":"2024-06-15T02:31:29.024000Z","platform":"sentinel-2a","eo:cloud_cover":37.42,"view:sun_elevation":68.31,"mgrs:utm_zone":52,"mgrs:latitude_band":"S","mgrs:grid_square":"DG"},"assets":{"blue":{"href":"https://example.invalid/B02.tif","type":"image/tiff"}}}'
L9 = '{"type":"Feature","id":"LC09","geometry":{"type":"Polygon","coordinates":[[[127.6,35.1],[129.9,35.4],[129.5,37.2],[127.2,36.9],[127.6,35.1]]]},"properties":{"datetime":"2024-06-12T02:07:41.123456Z","eo:cloud_cover":12.0,"landsat:wrs_path":"115","landsat:wrs_row":"035"}}'
MULTI = '{"type":"Feature","id":"M","geometry":{"type":"MultiPolygon","coordinates":[[[[178.5,60.1],[180,60.1],[180,61],[178.5,61],[178.5,60.1]]],[[[-180,60.1],[-178.5,60.1],[-178.5,61],[-180,61],[-180,60.1]]]]},"properties":{"start_datetime":"2024-07-01T00:00:00Z","eo:cloud_cover":4.1}}'
SPARSE = '{"type":"Feature","id":"SPARSE","geometry":{"type":"Point","coordinates":[1,2]},"properties":{"datetime":"2024-07-02T00:00:00Z"}}'


def test_catalogue(spark):
    items = stac.items(spark.createDataFrame([(x,) for x in (S2, L9, MULTI, SPARSE)], "feature string"), "s2")
    got = {r.id: r for r in items.collect()}
    s2 = got["S2A_52SDG_20240615_0_L2A"]
    assert (s2.tile, s2.path, round(s2.sun_zenith, 2), s2.platform, s2.datetime.microsecond) == ("52SDG", None, 21.69, "sentinel-2a", 24000)
    assert (got["LC09"].tile, got["LC09"].path, got["LC09"].row) == (None, 115, 35)
    assert got["SPARSE"].rings is None and got["M"].datetime is not None
    grid = g.Grid.over(25_000)
    with pytest.warns(UserWarning):
        obs = stac.to_observations(items, grid)
    assert obs.select("date").distinct().count() == 3
    assert obs.filter("platform = 'sentinel-2a'").select("cloud_fraction").distinct().first()[0] == pytest.approx(0.3742)
    at = g.cells(spark, grid, obs.filter("date = DATE'2024-07-01'").select("cell")).agg(F.min("lon"), F.max("lon")).first()
    assert at[0] < -178 and at[1] > 178


def test_search_pages(spark):
    calls = []

    def post(url, body):
        calls.append(url)
        return {"features": [__import__("json").loads(S2)] * 3, "links": [{"rel": "next", "href": url + "?p"}]}

    assert stac.search(spark, post, (127, 35, 130, 37), "s2", "2024-06-01", "2024-06-30", 80, limit=5).count() == 5
    assert len(calls) == 2


def test_sinks(spark, tmp_path):
    from skyobs.operators.statistics import stats

    t = stats(spark.createDataFrame([(170772, "2020", "s2", "cloud_fraction", 0.4, 3)], "cell int, period string, sensor string, metric string, value double, n int"), "cell")
    for kind in ("csv", "json", "parquet", "orc"):
        path = sinks.export(t, str(tmp_path / f"out.{kind}"))
        assert spark.read.option("header", True).format(kind).load(path).count() == 1
        assert "columns" in spark.read.text(f"{path}.manifest").orderBy("value").first()[0] or spark.read.text(f"{path}.manifest").count() > 1
    page = sinks.explore(t, "cloud_fraction", str(tmp_path / "map.html"), g.Grid.over(25_000))
    assert '"cell":170772' in open(page).read()
    with pytest.raises(ValueError):
        sinks.explore(t, "n_scenes", str(tmp_path / "map.html"), g.Grid.over(25_000))


def test_harvest_resumes(spark, tmp_path):
    from skyobs.operators.statistics import stats

    t = stats(spark.createDataFrame([(1, "2020", "s2", "n_scenes", 4.0, 4)], "cell int, period string, sensor string, metric string, value double, n int"), "cell")
    for _ in range(2):  # a tile that is harvested again replaces its rows
        harvest.write_parts(t.withColumn("tile_id", F.lit("a")), str(tmp_path / "parts"))
    harvest.write_parts(t.withColumn("tile_id", F.lit("b")), str(tmp_path / "parts"))
    assert harvest.consolidate(spark.read.parquet(str(tmp_path / "parts"))).first().value == 8
    waits = []
    tries = iter([ValueError(), ValueError(), 7])

    def call():
        x = next(tries)
        if isinstance(x, Exception):
            raise x
        return x

    assert harvest.retry(call, sleep=waits.append) == 7 and len(waits) == 2


def test_streams(spark, tmp_path):
    import datetime as dt

    from skyobs.operators.statistics import merge
    from skyobs.streaming import availability as sa

    rows = [(1, dt.date(2024, 1, d), "s2", cf, dt.datetime(2024, 1, d)) for d, cf in ((1, 0.1), (4, 0.9), (9, 0.0))]
    schema = "cell long, date date, sensor string, cloud_fraction double, time timestamp"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "in"))
    read = lambda: spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    sa.gap_stream(read()).writeStream.format("memory").queryName("gap_out").outputMode("append").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start().awaitTermination()
    assert [tuple(r) for r in spark.table("gap_out").collect()] == [(1, dt.date(2024, 1, 9), 8)]
    read().writeStream.foreachBatch(sa.merge_batches(str(tmp_path / "parts"))).option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start().awaitTermination()
    got = {r.metric: r.value for r in merge(spark.read.parquet(str(tmp_path / "parts")).drop("batch")).collect()}
    assert got == {"n_scenes": 3.0, "n_clear_obs": 2.0}
    sa.clear_obs_stream(read()).writeStream.format("memory").queryName("clear_out").outputMode("complete").option("checkpointLocation", str(tmp_path / "c3")).trigger(availableNow=True).start().awaitTermination()
    assert spark.table("clear_out").count() >= 1
