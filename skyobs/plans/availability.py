"""Queries on observations, each with its SQL twin."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyobs.operators import availability as av
from skyobs.operators import statistics as st
from skyobs.operators.simulate import rounded
from skyobs.plans.registry import registry
from skyobs.sources import driver_tables as dt

QUERIES, SQL, query = registry()
_OBS = f"obs AS (SELECT {dt.OBS} FROM lineitem)"
_PERIOD = {
    "year": "CAST(year(date) AS VARCHAR)", "month": "strftime(date, '%Y-%m')",
    "season": "CAST(year(date) AS VARCHAR)||'-S'||CAST(quarter(date) AS VARCHAR)", "all": "'all'",
}
_UNIT = {"year": ("year", "12 MONTH"), "season": ("quarter", "3 MONTH"), "month": ("month", "1 MONTH")}


def _gaps_sql(by: str, edges: bool = True, tail: str | None = None) -> str:
    if by == "all":
        bounds = "(SELECT min(date) FROM obs) AS p0, (SELECT max(date) FROM obs) AS p1"
    else:
        unit, step = _UNIT[by]
        bounds = f"CAST(date_trunc('{unit}', date) AS DATE) AS p0, CAST(date_trunc('{unit}', date) + INTERVAL {step} - INTERVAL 1 DAY AS DATE) AS p1"
    whole = "date_diff('day',p0,p1)+1"
    longest = "greatest(coalesce(mg,0), date_diff('day',p0,f), date_diff('day',l,p1))" if edges else f"CASE WHEN k = 1 THEN {whole} ELSE mg END"
    mean = "CAST(date_diff('day',p0,p1) AS DOUBLE)/(k+1)" if edges else f"CASE WHEN k = 1 THEN CAST({whole} AS DOUBLE) ELSE CAST(date_diff('day',f,l) AS DOUBLE)/(k-1) END"
    base = f"""WITH {_OBS}, o AS (SELECT *, {_PERIOD[by]} AS period, {bounds} FROM obs),
grp AS (SELECT cell, period, min(p0) p0, max(p1) p1, count(*) n_acq, CASE WHEN count(DISTINCT sensor)=1 THEN min(sensor) ELSE 'MULTI' END AS sensor FROM o GROUP BY 1,2),
clr AS (SELECT DISTINCT cell, period, date FROM o WHERE cloud_fraction <= 0.2),
d AS (SELECT *, date_diff('day', lag(date) OVER (PARTITION BY cell,period ORDER BY date), date) g FROM clr),
a AS (SELECT cell, period, min(date) f, max(date) l, count(*) k, max(g) mg FROM d GROUP BY 1,2),
gaps AS (SELECT grp.cell, grp.period, grp.sensor, CAST(CASE WHEN k IS NULL THEN {whole} ELSE {longest} END AS BIGINT) AS max_gap_days,
 round(CASE WHEN k IS NULL THEN CAST({whole} AS DOUBLE) ELSE {mean} END, 6) AS mean_gap_days, coalesce(k,0) AS n_clear_obs, n_acq AS n
 FROM grp LEFT JOIN a ON grp.cell=a.cell AND grp.period=a.period)
"""
    return base + (tail or "SELECT * FROM gaps")


for _by in ("season", "year", "month", "all"):
    query(f"gaps_{_by}", _gaps_sql(_by))(lambda spark, d, by=_by: av.gap_table(dt.obs(spark, d), by))
query("gaps_noedge", _gaps_sql("year", False))(lambda spark, d: av.gap_table(dt.obs(spark, d), "year", include_edges=False))
query("gap_exceedance", _gaps_sql("season", True, "SELECT cell, round(avg(CASE WHEN max_gap_days > 30 THEN 1.0 ELSE 0.0 END), 6) AS exceedance, count(*) AS n_periods FROM gaps GROUP BY cell"))(
    lambda spark, d: av.gap_exceedance(dt.obs(spark, d), "season")
)

_LONG = "SELECT cell, period, sensor, metric, round(value, 6) AS value, n, round(se, 6) AS se, '{den}' AS denominator, unit FROM long"


def _clear_sql(by: str) -> str:
    return (
        f"""WITH {_OBS}, w AS (SELECT cell, {_PERIOD[by]} AS period, sensor, count(*) AS n, count(*) FILTER (WHERE cloud_fraction <= 0.2) AS k, avg(cloud_fraction) AS cf,
 stddev_samp(cloud_fraction)/sqrt(count(*)) AS s, avg(1 - cloud_fraction) AS p FROM obs GROUP BY 1,2,3),
long AS (SELECT cell, period, sensor, n, 'n_scenes' AS metric, CAST(n AS DOUBLE) AS value, CAST(NULL AS DOUBLE) AS se, 'count' AS unit FROM w
 UNION ALL SELECT cell, period, sensor, n, 'n_clear_obs', CAST(k AS DOUBLE), NULL, 'count' FROM w
 UNION ALL SELECT cell, period, sensor, n, 'cloud_fraction', cf, s, 'fraction' FROM w
 UNION ALL SELECT cell, period, sensor, n, 'p_clear', p, NULL, 'probability' FROM w) """
        + _LONG.format(den=st.OF_PERIOD[by])
    )


for _by in ("year", "month", "season", "all"):
    query(f"clear_obs_{_by}", _clear_sql(_by))(lambda spark, d, by=_by: av.clear_obs(dt.obs(spark, d), by))


@query("gaps_stats_wide", _gaps_sql("season", True, "SELECT cell, period, sensor, CAST(max_gap_days AS DOUBLE) AS max_gap_days, mean_gap_days, CAST(n_clear_obs AS DOUBLE) AS n_clear_obs FROM gaps"))
def gaps_stats_wide(spark: SparkSession, d: str) -> DataFrame:
    return st.wide(av.gaps(dt.obs(spark, d), "season"), ["max_gap_days", "mean_gap_days", "n_clear_obs"])


@query("clear_prob_independent", f"WITH {_OBS} SELECT cell, date, round(cloud_fraction, 6) AS cloud_fraction, round(1 - cloud_fraction, 6) AS p_clear, count(*) AS n FROM obs GROUP BY 1,2,3,4")
def clear_prob_independent(spark: SparkSession, d: str) -> DataFrame:
    p = av.clear_probability(F.col("cloud_fraction"))
    return dt.obs(spark, d).groupBy("cell", "date", F.round("cloud_fraction", 6).alias("cloud_fraction"), F.round(p, 6).alias("p_clear")).agg(F.count(F.lit(1)).alias("n"))


@query("clear_prob_clustered")
def clear_prob_clustered(spark: SparkSession, d: str) -> DataFrame:
    distinct = dt.obs(spark, d).groupBy("cloud_fraction").agg(F.count(F.lit(1)).alias("n"))
    return distinct.withColumn("p_clear", av.clear_probability(F.col("cloud_fraction"), "clustered"))


def _persistence_sql(by: str) -> str:
    return f"""WITH {_OBS}, st AS (SELECT cell, sensor, {_PERIOD[by]} AS period, date, 2*count(*) FILTER (WHERE cloud_fraction > 0.2) > count(*) AS c FROM obs GROUP BY 1,2,3,4),
l AS (SELECT *, lag(c) OVER w AS pc, date_diff('day', lag(date) OVER w, date) AS gap FROM st WINDOW w AS (PARTITION BY cell,sensor,period ORDER BY date)),
isl AS (SELECT *, sum(CASE WHEN pc IS NULL OR pc <> c THEN 1 ELSE 0 END) OVER (PARTITION BY cell,sensor,period ORDER BY date) AS rid FROM l),
rr AS (SELECT cell, sensor, period, avg(len) AS mr FROM (SELECT cell, sensor, period, rid, count(*) AS len FROM isl WHERE c GROUP BY 1,2,3,4) z GROUP BY 1,2,3),
a AS (SELECT cell, sensor, period, count(*) AS n_acq, count(*) FILTER (WHERE c) AS nc, count(*) FILTER (WHERE gap <= 20) AS n_pairs,
 count(*) FILTER (WHERE gap <= 20 AND pc) AS n1, count(*) FILTER (WHERE gap <= 20 AND NOT pc) AS n0, count(*) FILTER (WHERE gap <= 20 AND pc AND c) AS n11,
 count(*) FILTER (WHERE gap <= 20 AND NOT pc AND c) AS n01, median(gap) FILTER (WHERE gap <= 20) AS mi FROM l GROUP BY 1,2,3)
SELECT a.cell, a.sensor, a.period, round(CAST(nc AS DOUBLE)/n_acq,6) AS p_cloud, round(CAST(n11 AS DOUBLE)/n1,6) AS p11, round(CAST(n01 AS DOUBLE)/n0,6) AS p01,
 round(CAST(n11 AS DOUBLE)/n1 - CAST(n01 AS DOUBLE)/n0,6) AS rho, CAST(mi AS DOUBLE) AS median_interval_days, n_pairs, n_acq, round(coalesce(mr,0),6) AS mean_cloudy_run
FROM a LEFT JOIN rr ON a.cell=rr.cell AND a.sensor=rr.sensor AND a.period=rr.period WHERE n_acq >= 3 AND n_pairs >= 10 AND n1 >= 3 AND n0 >= 3"""


for _by in ("all", "year"):
    query(f"persistence_{_by}", _persistence_sql(_by))(lambda spark, d, by=_by: av.persistence(dt.obs(spark, d), by))


@query("persistence_runs", f"""WITH {_OBS}, st AS (SELECT cell, sensor, date, 2*count(*) FILTER (WHERE cloud_fraction > 0.2) > count(*) AS c FROM obs GROUP BY 1,2,3),
l AS (SELECT *, lag(c) OVER (PARTITION BY cell,sensor ORDER BY date) AS pc FROM st),
isl AS (SELECT *, sum(CASE WHEN pc IS NULL OR pc <> c THEN 1 ELSE 0 END) OVER (PARTITION BY cell,sensor ORDER BY date) AS rid FROM l)
SELECT cell, sensor, min(date) AS first_date, max(date) AS last_date, count(*) AS length FROM isl WHERE c GROUP BY cell, sensor, rid""")  # fmt: skip
def persistence_runs(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    days = dt.obs(spark, d).groupBy("cell", "sensor", "date").agg((F.count_if(F.col("cloud_fraction") > 0.2) * 2 > F.count(F.lit(1))).alias("c"))
    w = Window.partitionBy("cell", "sensor").orderBy("date")
    fresh = F.coalesce(F.lag("c").over(w) != F.col("c"), F.lit(True)).cast("int")
    runs = days.withColumn("f", fresh).withColumn("rid", F.sum("f").over(w)).filter("c")
    return runs.groupBy("cell", "sensor", "rid").agg(F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.count(F.lit(1)).alias("length")).drop("rid")


def _merge_sql(metric: str, value: str) -> str:
    clear, unit = {"n_scenes": "count", "cloud_fraction": "fraction", "max_gap_days": "days"}, None
    unit = clear[metric]
    return f"""WITH {_OBS}, m AS (SELECT cell, {_PERIOD['month']} AS period, sensor, count(*) AS n, avg(cloud_fraction) AS cf FROM obs GROUP BY 1,2,3),
s AS (SELECT cell, substr(period, 1, 4) AS period, sensor, {value} AS value, sum(n) AS n FROM m GROUP BY 1,2,3)
SELECT cell, period, sensor, '{metric}' AS metric, round(value, 6) AS value, CAST(n AS BIGINT) AS n, 'cell-month' AS denominator, '{unit}' AS unit FROM s"""


def _monthly(spark: SparkSession, d: str, metric: str) -> DataFrame:
    monthly = av.clear_obs(dt.obs(spark, d), "month").filter(F.col("metric") == metric).withColumn("period", F.substring("period", 1, 4))
    return st.merge(monthly).drop("se")


query("stats_merge_sum", _merge_sql("n_scenes", "CAST(sum(n) AS DOUBLE)"))(lambda spark, d: _monthly(spark, d, "n_scenes"))
query("stats_merge_wmean", _merge_sql("cloud_fraction", "sum(cf*n)/sum(n)"))(lambda spark, d: _monthly(spark, d, "cloud_fraction"))
query("stats_merge_max", _gaps_sql("season", True, """SELECT cell, substr(period, 1, 4) AS period, 'max_gap_days' AS metric, CAST(max(max_gap_days) AS DOUBLE) AS value, CAST(sum(n) AS BIGINT) AS n, 'cell-season' AS denominator, 'days' AS unit FROM gaps GROUP BY 1, 2"""))(
    lambda spark, d: st.merge(av.gaps(dt.obs(spark, d), "season").filter("metric = 'max_gap_days'").withColumn("period", F.substring("period", 1, 4)).withColumn("sensor", F.lit(None).cast("string"))).drop("se", "sensor")
)


@query("stats_wide", f"""WITH {_OBS} SELECT cell, {_PERIOD['year']} AS period, sensor, CAST(count(*) AS DOUBLE) AS n_scenes, CAST(count(*) FILTER (WHERE cloud_fraction <= 0.2) AS DOUBLE) AS n_clear_obs,
 round(avg(1 - cloud_fraction), 6) AS p_clear FROM obs GROUP BY 1,2,3""")  # fmt: skip
def stats_wide(spark: SparkSession, d: str) -> DataFrame:
    return st.wide(av.clear_obs(dt.obs(spark, d), "year"), ["n_scenes", "n_clear_obs", "p_clear"])


@query("stats_summary", _clear_sql("year").rsplit("SELECT cell", 1)[0] + "SELECT metric, unit, count(*) AS n_rows, round(min(value), 6) AS min, round(median(value), 6) AS median, round(avg(value), 6) AS mean, round(max(value), 6) AS max FROM long GROUP BY metric, unit")
def stats_summary(spark: SparkSession, d: str) -> DataFrame:
    return st.summary(av.clear_obs(dt.obs(spark, d), "year"))


@query("stats_violations", f"""WITH {_OBS}, m AS (SELECT cell, {_PERIOD['year']} AS period, sensor, count(*) AS n, CAST(sum(cloud_fraction) AS DOUBLE) AS value FROM obs GROUP BY 1,2,3)
SELECT cell, period, sensor, round(value, 6) AS value, n, 'above the permitted range' AS reason FROM m WHERE value > 1""")  # fmt: skip
def stats_violations(spark: SparkSession, d: str) -> DataFrame:
    from skyobs.functions.exprs import period

    bad = dt.obs(spark, d).groupBy("cell", period(F.col("date"), "year").alias("period"), "sensor").agg(F.count(F.lit(1)).alias("n"), F.sum("cloud_fraction").alias("value")).withColumn("metric", F.lit("cloud_fraction"))
    return st.violations(st.stats(bad, "cell-year")).select("cell", "period", "sensor", "value", "n", "reason")


def _platforms_sql(names: list[str]) -> str:
    from skyobs import sensors

    rows = [f"('{s.id}', DATE '{p.start}', DATE '{p.end or date(2999, 12, 31)}', CAST({s.revisit} AS DOUBLE))" for s in map(sensors.sensor, names) for p in s.platforms]
    return f"pl(sensor, s, e, revisit) AS (VALUES {', '.join(rows)})"


_CONSTELLATION = ["landsat-8-9-oli", "sentinel-2-msi"]


def _synergy_sql(by: str, start: str, end: str) -> str:
    step, label, days = ("1 YEAR", "%Y", 365.25) if by == "year" else ("1 MONTH", "%Y-%m", 30.44)
    return f"""WITH {_platforms_sql(_CONSTELLATION)}, b AS (SELECT CAST(unnest(generate_series(DATE '{start}', DATE '{end}', INTERVAL {step})) AS DATE) AS p0),
p AS (SELECT p0, least(CAST(p0 + INTERVAL {step} - INTERVAL 1 DAY AS DATE), DATE '{end}') AS p1, strftime(p0, '{label}') AS period FROM b),
x AS (SELECT period, sensor, revisit, date_diff('day', p0, p1) + 1 AS nd, CAST(greatest(0, date_diff('day', greatest(p0, s), least(p1, e)) + 1) AS DOUBLE) AS d FROM p, pl),
y AS (SELECT period, sensor, sum(d / nd) AS n_platforms, max(nd / revisit) AS nominal_obs FROM x GROUP BY 1, 2),
z AS (SELECT *, nominal_obs * n_platforms AS combined_obs FROM y UNION ALL SELECT period, 'COMBINED', sum(n_platforms), sum(nominal_obs), sum(nominal_obs * n_platforms) FROM y GROUP BY period)
SELECT period, sensor, round(n_platforms, 6) AS n_platforms, round(nominal_obs, 6) AS nominal_obs, round(combined_obs, 6) AS combined_obs,
 round(CASE WHEN combined_obs > 0 THEN CAST({days} AS DOUBLE) / combined_obs END, 6) AS effective_revisit_days FROM z"""


query("synergy_year", _synergy_sql("year", "2013-01-01", "2026-12-31"))(lambda spark, d: av.synergy(spark, _CONSTELLATION, date(2013, 1, 1), date(2026, 12, 31)))
query("synergy_month", _synergy_sql("month", "2015-01-01", "2018-12-31"))(lambda spark, d: av.synergy(spark, _CONSTELLATION, date(2015, 1, 1), date(2018, 12, 31), "month"))


def _plans(spark: SparkSession, d: str) -> DataFrame:
    return dt.obs(spark, d).groupBy("cell").agg(F.count_if(F.col("cloud_fraction") <= 0.2).alias("k"), F.count(F.lit(1)).alias("n")).select(F.col("cell").alias("id"), (F.col("k").cast("double") / F.col("n")).alias("p_clear"), F.lit(36).alias("n_acquisitions"), F.lit(8).alias("n_required"))


@query("feasibility_binomial", f"""WITH {_OBS}, a AS (SELECT cell AS id, CAST(count(*) FILTER (WHERE cloud_fraction <= 0.2) AS DOUBLE)/count(*) AS p FROM obs GROUP BY 1),
t AS (SELECT id, p, i, exp(lgamma(CAST(37 AS DOUBLE)) - lgamma(CAST(i + 1 AS DOUBLE)) - lgamma(CAST(37 - i AS DOUBLE)) + i*ln(p) + (36 - i)*ln(1 - p)) AS q FROM a, (SELECT unnest(generate_series(8, 36)) AS i) g)
SELECT id, round(p, 6) AS p_clear, round(36*p, 6) AS expected, round(sum(q), 6) AS p_enough FROM t GROUP BY id, p""")  # fmt: skip
def feasibility_binomial(spark: SparkSession, d: str) -> DataFrame:
    t = _plans(spark, d)
    p = av.binomial_tail(F.col("p_clear"), F.col("n_acquisitions"), F.col("n_required"))
    return t.select("id", "p_clear", (F.col("n_acquisitions") * F.col("p_clear")).alias("expected"), p.alias("p_enough"))


@query("feasibility_gaps")
def feasibility_gaps(spark: SparkSession, d: str) -> DataFrame:
    return av.feasibility(_plans(spark, d), max_gap=60, window_days=365)


@query("seasonality_window")
def seasonality_window(spark: SparkSession, d: str) -> DataFrame:
    return av.seasonality(dt.obs(spark, d))


@query("observations_tier", f"WITH {_OBS} SELECT sensor, 'metadata' AS tier, count(*) AS n, round(avg(cloud_fraction), 6) AS mean_cloud FROM obs GROUP BY 1")
def observations_tier(spark: SparkSession, d: str) -> DataFrame:
    return av.observations(dt.obs(spark, d), units="fraction").groupBy("sensor", "tier").agg(F.count(F.lit(1)).alias("n"), F.avg("cloud_fraction").alias("mean_cloud"))


_LAT = "((CAST(cell AS BIGINT)*13) % 120) - 60 + CAST(0.5 AS DOUBLE)"


@query("r1_latitude", f"""WITH {_OBS}, s AS (SELECT cell, sensor, {_PERIOD['year']} AS period, avg(1 - cloud_fraction) AS p FROM obs GROUP BY 1,2,3)
SELECT CAST(ceil(({_LAT} + 60)/10) AS BIGINT) AS band, sensor, round(avg(p), 6) AS p_clear, count(*) AS n FROM s GROUP BY 1,2""")  # fmt: skip
def r1_latitude(spark: SparkSession, d: str) -> DataFrame:
    s = av.clear_obs(dt.obs(spark, d), "year").filter("metric = 'p_clear'")
    cells = s.select("cell").distinct().select("cell", F.expr(_LAT).alias("lat"))
    return s.join(cells, "cell", "left").groupBy(F.ceil((F.col("lat") + 60) / 10).alias("band"), "sensor").agg(F.avg("value").alias("p_clear"), F.count(F.lit(1)).alias("n"))


@query("r3_regime", _persistence_sql("all").replace("SELECT a.cell, a.sensor, a.period,", "SELECT CASE a.cell % 3 WHEN 0 THEN 'humid' WHEN 1 THEN 'arid' ELSE 'temperate' END AS regime, round(avg(rho), 6) AS mean_rho, round(stddev_samp(rho), 6) AS sd_rho, round(median(rho), 6) AS median_rho, count(*) AS n FROM (SELECT a.cell,") + ") a GROUP BY 1")
def r3_regime(spark: SparkSession, d: str) -> DataFrame:
    p = rounded(av.persistence(dt.obs(spark, d), "all"))
    regime = F.when(F.col("cell") % 3 == 0, "humid").when(F.col("cell") % 3 == 1, "arid").otherwise("temperate")
    return p.groupBy(regime.alias("regime")).agg(F.avg("rho").alias("mean_rho"), F.stddev_samp("rho").alias("sd_rho"), F.median("rho").alias("median_rho"), F.count(F.lit(1)).alias("n"))


@query("r4_cross_sensor", f"""WITH {_OBS}, c AS (SELECT cell, {_PERIOD['year']} AS period, avg(CASE WHEN sensor LIKE 'landsat%' THEN cloud_fraction END) AS a, avg(CASE WHEN sensor LIKE 'sentinel%' THEN cloud_fraction END) AS b FROM obs GROUP BY 1,2)
SELECT count(*) AS n, round(corr(a, b), 6) AS r, round(avg(a - b), 6) AS mean_diff, round(stddev_samp(a - b), 6) AS sd_diff FROM c WHERE a IS NOT NULL AND b IS NOT NULL""")  # fmt: skip
def r4_cross_sensor(spark: SparkSession, d: str) -> DataFrame:
    from skyobs.functions.exprs import period

    mean = lambda name: F.avg(F.when(F.col("sensor").startswith(name), F.col("cloud_fraction")))
    c = dt.obs(spark, d).groupBy("cell", period(F.col("date"), "year").alias("period")).agg(mean("landsat").alias("a"), mean("sentinel").alias("b")).dropna(subset=["a", "b"])
    diff = F.col("a") - F.col("b")
    return c.agg(F.count(F.lit(1)).alias("n"), F.corr("a", "b").alias("r"), F.avg(diff).alias("mean_diff"), F.stddev_samp(diff).alias("sd_diff"))


@query("r7_measured_vs_nominal", _synergy_sql("year", "1995-01-01", "2001-12-31").replace("WITH ", f"WITH {_OBS}, m AS (SELECT period, avg(n) AS measured FROM (SELECT cell, {_PERIOD['year']} AS period, count(*) AS n FROM obs GROUP BY 1,2) q GROUP BY 1), nom AS (WITH ", 1).replace("nom AS (WITH ", "nom AS (WITH ") + " WHERE sensor = 'COMBINED') SELECT m.period, round(measured, 6) AS measured, nominal_obs FROM m LEFT JOIN nom ON m.period = nom.period")
def r7_measured_vs_nominal(spark: SparkSession, d: str) -> DataFrame:
    from skyobs.functions.exprs import period

    per_cell = dt.obs(spark, d).groupBy("cell", period(F.col("date"), "year").alias("period")).agg(F.count(F.lit(1)).alias("n"))
    measured = per_cell.groupBy("period").agg(F.avg("n").alias("measured"))
    nominal = av.synergy(spark, _CONSTELLATION, date(1995, 1, 1), date(2001, 12, 31)).filter("sensor = 'COMBINED'").select("period", "nominal_obs")
    return measured.join(nominal, "period", "left")
