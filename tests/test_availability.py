import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyobs.config import SkyobsWarning
from skyobs.functions import special
from skyobs.operators import availability as av
from skyobs.operators import simulate
from skyobs.operators import statistics as st

OBS = "cell int, date date, sensor string, cloud_fraction double"


def year(spark, p=((1, 0.25), (2, 0.55), (3, 0.995))):
    rows = []
    for cell, share in p:
        g = special.rng(5, cell)
        for k, cloudy in enumerate(simulate.markov_states(g, 73, share, 0.35)):
            rows.append((cell, dt.date(2023, 1, 1) + dt.timedelta(5 * k), "s2", 0.9 if cloudy or cell == 3 else 0.1))
    return spark.createDataFrame(rows, OBS)


def test_cell_without_clear_date_stays(spark):
    got = {r.cell: r for r in av.gap_table(year(spark)).collect()}
    assert got[3].n_clear_obs == 0 and got[3].max_gap_days == 365
    assert got[1].mean_gap_days < got[2].mean_gap_days < got[3].mean_gap_days


def test_gaps_add_up(spark):
    for r in av.gap_table(year(spark)).filter("n_clear_obs > 0").collect():
        assert r.mean_gap_days == pytest.approx(364 / (r.n_clear_obs + 1))


def test_null_cloud_counts_as_scene_only(spark):
    o = spark.createDataFrame([(1, dt.date(2023, 1, 1), "s2", None), (1, dt.date(2023, 3, 1), None, 0.1)], OBS)
    r = av.gap_table(o).first()
    assert (r.n, r.n_clear_obs, r.sensor) == (2, 1, "s2")
    assert {x.metric: x.value for x in av.clear_obs(o).filter("sensor is null").collect()}["n_clear_obs"] == 1


def test_empty(spark):
    o = spark.createDataFrame([], OBS)
    assert av.gap_table(o).count() == av.clear_obs(o).count() == av.persistence(o).count() == 0


def test_duplicates_leave_persistence(spark):
    table = spark.createDataFrame([(k, "2015-01-01", 730, 5, 0.5, rho) for k, rho in enumerate([0.0, 0.3, 0.6])], "series long, start string, n int, step int, p_cloud double, rho double")
    s = simulate.series(table, seed=3).select(F.col("series").alias("cell"), "date", F.lit("s2").alias("sensor"), F.when(F.col("cloudy"), 1.0).otherwise(0.0).alias("cloud_fraction"))
    once = {r.cell: r for r in av.persistence(s, threshold=0.5).collect()}
    twice = {r.cell: r for r in av.persistence(s.unionByName(s), threshold=0.5).collect()}
    for k, rho in enumerate([0.0, 0.3, 0.6]):
        assert once[k].rho == pytest.approx(rho, abs=0.12)
        assert once[k].rho == pytest.approx(twice[k].rho, abs=1e-9)


def test_percent_is_found(spark):
    rows = spark.createDataFrame([(1, dt.date(2023, 1, k), "s2", float(v)) for k, v in ((1, 20), (2, 50), (3, 80))], OBS)
    with pytest.warns(SkyobsWarning):
        got = av.observations(rows)
    assert [r.cloud_fraction for r in got.orderBy("date").collect()] == [0.2, 0.5, 0.8]


def test_clustered_probability():
    got = special.beta_tail(np.array([0.1, 0.2, 0.5, 0.8, 0.9]), 0.5)
    assert got == pytest.approx([0.826733666, 0.670978899, 0.308086042, 0.085872738, 0.037612288], abs=1e-8)


def test_empirical_needs_evidence():
    with pytest.raises(ValueError):
        av.clear_probability(F.lit(0.1), "empirical", tier="metadata")


def test_synergy_table(spark):
    got = {r.period: r for r in av.synergy(spark, ["l8", "s2"], dt.date(2013, 1, 1), dt.date(2026, 12, 31)).filter("sensor = 'COMBINED'").collect()}
    for y, n, obs, revisit in (("2013", 0.7260, 16.5625, 22.0528), ("2017", 2.8219, 89.3125, 4.0896), ("2021", 3.1671, 99.6250, 3.6662), ("2025", 5.0, 155.1250, 2.3546)):
        assert (got[y].n_platforms, got[y].combined_obs, got[y].effective_revisit_days) == pytest.approx((n, obs, revisit), abs=1e-4)


def test_feasibility(spark):
    t = spark.createDataFrame([(1, 0.5, 10, 3), (2, 0.0, 10, 1), (3, 1.0, 10, 10)], "id int, p_clear double, n_acquisitions int, n_required int")
    got = {r.id: r for r in av.feasibility(t, 60, 365).collect()}
    assert got[1].p_enough == pytest.approx(1 - (1 + 10 + 45) / 1024)
    assert (got[2].p_enough, got[2].p_gap_ok, got[3].p_enough, got[3].p_gap_ok) == (0, 0, 1, 1)


def test_seasonality(spark):
    rows = []
    for k in range(0, 3650, 5):
        day = dt.date(2010, 1, 1) + dt.timedelta(k)
        clear = 1 / (1 + np.exp(-2 * np.cos(2 * np.pi * (day.timetuple().tm_yday - 200) / 365.25)))
        rows.append((1, day, "s2", 0.0 if special.rng(1, k).random() < clear else 1.0))
    rows += [(2, dt.date(2010, 1, 1) + dt.timedelta(k), "s2", 0.0) for k in range(30)]
    got = {r.cell: r for r in av.seasonality(spark.createDataFrame(rows, OBS)).collect()}
    assert got[1].converged and abs(got[1].peak_doy - 200) < 15 and not got[2].converged


@pytest.mark.parametrize("metric,value,denominator,reason", [("cloud_fraction", 1.4, "cell", "above"), ("images", 1.0, "cell", "unknown metric"), ("n_scenes", 1.0, "path", "unknown denominator")])
def test_contract(spark, metric, value, denominator, reason):
    t = st.stats(spark.createDataFrame([(1, "2020", "s2", metric, value, 3)], "cell int, period string, sensor string, metric string, value double, n int"), denominator)
    with pytest.raises(st.StatisticsError, match=reason):
        st.validate(t)


@pytest.mark.parametrize("metric,rows,want,n", [("n_scenes", [(10, 1), (5, 1)], 15, 2), ("max_gap_days", [(40, 1), (90, 1)], 90, 2), ("cloud_fraction", [(0.2, 90), (0.8, 10)], 0.26, 100), ("cloud_fraction", [(0.2, None), (0.4, None)], 0.3, 0)])
def test_merge(spark, metric, rows, want, n):
    t = st.stats(spark.createDataFrame([(1, "2020", "s2", metric, float(v), k) for v, k in rows], "cell int, period string, sensor string, metric string, value double, n int"), "cell")
    got = st.merge(t).first()
    assert got.value == pytest.approx(want) and got.n == n
