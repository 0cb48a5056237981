"""Queries on the grid and on tiles of a harvest, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyobs.operators import grid as g
from skyobs.plans.registry import registry
from skyobs.sources import driver_tables as dt
from skyobs.sources import harvest

QUERIES, SQL, query = registry(4)
GRID = g.Grid.over(25_000)


_PTS = f"pts AS (SELECT {dt.PTS} FROM customer)"


def q_sql(lat: str) -> str:
    s = f"sin(radians({lat}))"
    return f"(CAST({1 - g.E2!r} AS DOUBLE) * ({s} / (1 - CAST({g.E2!r} AS DOUBLE) * {s} * {s}) - ln((1 - CAST({g.E1!r} AS DOUBLE) * {s}) / (1 + CAST({g.E1!r} AS DOUBLE) * {s})) / CAST({2 * g.E1!r} AS DOUBLE)))"


_X, _Y = f"radians(lon) * CAST({g.A * g.K0!r} AS DOUBLE)", f"{q_sql('lat')} * CAST({g.A / (2 * g.K0)!r} AS DOUBLE)"


@query("grid_project", f"WITH {_PTS} SELECT id, round({_X}, 4) AS x, round({_Y}, 4) AS y FROM pts")
def grid_project(spark: SparkSession, d: str) -> DataFrame:
    x, y = g.project(F.col("lon"), F.col("lat"))
    return dt.points(spark, d).select("id", x.alias("x"), y.alias("y"))


@query("grid_unproject", f"WITH {_PTS} SELECT id, round(lon, 4) AS lon, round(lat, 4) AS lat FROM pts")
def grid_unproject(spark: SparkSession, d: str) -> DataFrame:
    x, y = g.project(F.col("lon"), F.col("lat"))
    return g.unproject(dt.points(spark, d).select("id", x.alias("x"), y.alias("y")), "x", "y").select("id", "lon", "lat")


_CELL = f"CAST((floor((CAST({GRID.ymax!r} AS DOUBLE) - y)/{GRID.res}) ) * {GRID.ncol} + floor((x - CAST({GRID.xmin!r} AS DOUBLE))/{GRID.res}) + 1 AS BIGINT)"


@query("grid_lookup", f"WITH {_PTS}, p AS (SELECT id, {_X} AS x, {_Y} AS y FROM pts) SELECT id, {_CELL} AS cell FROM p")
def grid_lookup(spark: SparkSession, d: str) -> DataFrame:
    return dt.points(spark, d).select("id", g.lookup(GRID, F.col("lon"), F.col("lat")).cast("long").alias("cell"))


_COARSE = g.Grid.over(100_000)


@query("grid_cells", f"""WITH c AS (SELECT CAST(unnest(generate_series(1, {_COARSE.ncol * _COARSE.nrow})) AS BIGINT) AS cell), p AS (SELECT cell, CAST(floor((cell - 1)/{_COARSE.ncol}) AS INT) + 1 AS row, CAST((cell - 1) % {_COARSE.ncol} AS INT) + 1 AS col FROM c)
SELECT cell, row, col, round(CAST({_COARSE.xmin!r} AS DOUBLE) + (col - CAST(0.5 AS DOUBLE))*{_COARSE.res}, 4) AS x, round(CAST({_COARSE.ymax!r} AS DOUBLE) - (row - CAST(0.5 AS DOUBLE))*{_COARSE.res}, 4) AS y, CAST(10000 AS DOUBLE) AS area_km2 FROM p""")  # fmt: skip
def grid_cells(spark: SparkSession, d: str) -> DataFrame:
    return g.cells(spark, _COARSE).select("cell", "row", "col", "x", "y", "area_km2")


def _feet(spark: SparkSession, d: str) -> DataFrame:
    return dt.footprints(spark, d).select("id", g.box_ring(F.col("lon0"), F.col("lat0"), 2.0, 2.0).alias("ring"))


_BOX = f"""f AS (SELECT {dt.FOOT} FROM supplier), b AS (SELECT id, radians(lon0)*CAST({g.A * g.K0!r} AS DOUBLE) AS x0, radians(lon0 + 2)*CAST({g.A * g.K0!r} AS DOUBLE) AS x1,
 {q_sql('lat0')}*CAST({g.A / (2 * g.K0)!r} AS DOUBLE) AS y0, {q_sql('(lat0 + 2)')}*CAST({g.A / (2 * g.K0)!r} AS DOUBLE) AS y1 FROM f),
r AS (SELECT *, unnest(generate_series(CAST(floor(({GRID.ymax!r} - y1)/{GRID.res}) AS BIGINT), CAST(floor(({GRID.ymax!r} - y0)/{GRID.res}) AS BIGINT) + 1)) AS row FROM b),
c AS (SELECT *, unnest(generate_series(CAST(floor((x0 - CAST({GRID.xmin!r} AS DOUBLE))/{GRID.res}) AS BIGINT), CAST(floor((x1 - CAST({GRID.xmin!r} AS DOUBLE))/{GRID.res}) AS BIGINT) + 1)) AS col FROM r),
k AS (SELECT id, row, col, CAST({GRID.xmin!r} AS DOUBLE) + (col - CAST(0.5 AS DOUBLE))*{GRID.res} AS cx, CAST({GRID.ymax!r} AS DOUBLE) - (row - CAST(0.5 AS DOUBLE))*{GRID.res} AS cy, x0, x1, y0, y1 FROM c)"""


@query("grid_index_box", f"WITH {_BOX} SELECT DISTINCT id, CAST((row - 1)*{GRID.ncol} + col AS BIGINT) AS cell, CAST(1 AS DOUBLE) AS weight FROM k WHERE cx > x0 AND cx < x1 AND cy > y0 AND cy < y1")
def grid_index_box(spark: SparkSession, d: str) -> DataFrame:
    return g.index(_feet(spark, d), GRID).select("id", "cell", "weight")


@query("grid_index_area", f"""WITH {_BOX}, o AS (SELECT DISTINCT id, CAST((row - 1)*{GRID.ncol} + col AS BIGINT) AS cell, greatest(0, least(x1, cx + {GRID.res / 2}) - greatest(x0, cx - {GRID.res / 2})) * greatest(0, least(y1, cy + {GRID.res / 2}) - greatest(y0, cy - {GRID.res / 2})) / {GRID.res**2} AS w FROM k)
SELECT id, cell, round(w, 4) AS weight FROM o WHERE w > 1e-9""")  # fmt: skip
def grid_index_area(spark: SparkSession, d: str) -> DataFrame:
    return g.index_area(_feet(spark, d), GRID)


_TILES = harvest.tiles_sql()


@query("harvest_tiles", f"WITH {_TILES} SELECT tile_id, west, south, sensor, CAST(year AS INT) AS year FROM tiles")
def harvest_tiles(spark: SparkSession, d: str) -> DataFrame:
    return harvest.tiles(spark, ["landsat-8-9-oli", "sentinel-2-msi"], 2020, 2021)


@query("harvest_ownership", f"WITH {_PTS} SELECT id, CAST(floor((lon + 180)/10) AS BIGINT) AS tile_col, CAST(floor((lat + 60)/10) AS BIGINT) AS tile_row FROM pts WHERE lat >= -60 AND lat < 80")
def harvest_ownership(spark: SparkSession, d: str) -> DataFrame:
    return harvest.owned(dt.points(spark, d)).select("id", "tile_col", "tile_row")


@query("harvest_resume_anti", f"WITH {_TILES}, done AS (SELECT CAST(floor((lon + 180)/10) AS BIGINT)*100 + CAST(floor((lat + 60)/10) AS BIGINT) AS band FROM (SELECT {dt.PTS} FROM customer) p WHERE lat >= -60 AND lat < 80 GROUP BY 1 HAVING count(*) % 2 = 1) SELECT tile_id FROM tiles WHERE CAST((west + 180)/10 AS BIGINT)*100 + CAST((south + 60)/10 AS BIGINT) NOT IN (SELECT band FROM done)")
def harvest_resume_anti(spark: SparkSession, d: str) -> DataFrame:
    """Tiles that are left when those with an odd number of points are done."""
    tiles = harvest_tiles(spark, d)
    seen = harvest.owned(dt.points(spark, d)).groupBy("tile_col", "tile_row").agg(F.count(F.lit(1)).alias("n")).filter("n % 2 = 1")
    keyed = tiles.withColumn("tile_col", ((F.col("west") + 180) / 10).cast("long")).withColumn("tile_row", ((F.col("south") + 60) / 10).cast("long"))
    return harvest.remaining(keyed, seen, ["tile_col", "tile_row"]).select("tile_id")


_DAYS = "date_diff('second', TIMESTAMP '2000-01-01 12:00:00', CAST(ts AS TIMESTAMP))/CAST(86400 AS DOUBLE)"


@query("solar_position", f"""WITH p AS (SELECT CAST(o_orderkey AS BIGINT) AS id, CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) + INTERVAL 10 HOUR AS ts, CAST((o_custkey*37) % 360 - 180 AS DOUBLE) AS lon, CAST((o_custkey*13) % 120 - 60 AS DOUBLE) AS lat FROM orders),
a AS (SELECT *, {_DAYS} AS d FROM p), fm AS (SELECT *, 357.528 + CAST(0.9856003 AS DOUBLE)*d AS g0, CAST(280.460 AS DOUBLE) + CAST(0.9856474 AS DOUBLE)*d AS l0, CAST(18.697374558 AS DOUBLE) + CAST(24.06570982441908 AS DOUBLE)*d AS s0 FROM a),
b AS (SELECT *, radians(g0 - 360*floor(g0/360)) AS g, l0 - 360*floor(l0/360) AS l, s0 - 24*floor(s0/24) AS s FROM fm),
e AS (SELECT *, radians(l + CAST(1.915 AS DOUBLE)*sin(g) + CAST(0.020 AS DOUBLE)*sin(2*g)) AS lam, radians(CAST(23.439 AS DOUBLE) - CAST(0.0000004 AS DOUBLE)*d) AS eps FROM b),
h AS (SELECT *, asin(sin(eps)*sin(lam)) AS dec, radians(s*15 + lon - 360*floor((s*15 + lon)/360)) - atan2(cos(eps)*sin(lam), cos(lam)) AS h, radians(lat) AS phi FROM e),
z AS (SELECT id, 90 - degrees(asin(sin(phi)*sin(dec) + cos(phi)*cos(dec)*cos(h))) AS zen, degrees(atan2(-sin(h), tan(dec)*cos(phi) - sin(phi)*cos(h))) + 360 AS az FROM h)
SELECT id, round(zen, 4) AS zenith, round(az - 360*floor(az/360), 4) AS azimuth FROM z""")  # fmt: skip
def solar_position(spark: SparkSession, d: str) -> DataFrame:
    from skyobs.functions.exprs import solar_position as position

    o = spark.read.parquet(f"{d}/orders.parquet").selectExpr("CAST(o_orderkey AS BIGINT) AS id", "CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) + INTERVAL 10 HOURS AS ts", "CAST((o_custkey*37) % 360 - 180 AS DOUBLE) AS lon", "CAST((o_custkey*13) % 120 - 60 AS DOUBLE) AS lat")
    zenith, azimuth = position(F.col("ts"), F.col("lon"), F.col("lat"))
    return o.select("id", zenith.alias("zenith"), azimuth.alias("azimuth"))
