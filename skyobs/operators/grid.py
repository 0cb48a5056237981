"""An equal-area grid (EPSG:6933) and footprints on it, as column expressions."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skyobs.config import number, options

# The WGS84 ellipsoid and the standard parallel of the projection.
A, INV_F, LAT_TS = 6378137.0, 298.257223563, 30.0
E2 = (2 - 1 / INV_F) / INV_F
E1 = math.sqrt(E2)


def q_of(phi: float) -> float:
    """Authalic function of a latitude in radians."""
    s = math.sin(phi)
    return (1 - E2) * (s / (1 - E2 * s * s) - math.log((1 - E1 * s) / (1 + E1 * s)) / (2 * E1))


def k0(lat_ts: float = LAT_TS) -> float:
    t = math.radians(lat_ts)
    return math.cos(t) / math.sqrt(1 - E2 * math.sin(t) ** 2)


K0, QP = k0(), q_of(math.pi / 2)
X_MAX, Y_MAX = A * K0 * math.pi, A * QP / (2 * K0)


def _q(phi: Column) -> Column:
    s = F.sin(phi)
    return F.lit(1 - E2) * (s / (F.lit(1.0) - F.lit(E2) * s * s) - F.ln((F.lit(1.0) - F.lit(E1) * s) / (F.lit(1.0) + F.lit(E1) * s)) / F.lit(2 * E1))


def project(lon: Column, lat: Column, lat_ts: float = LAT_TS) -> tuple[Column, Column]:
    """x and y in metres of degrees; null outside [-180, 180] and [-90, 90]."""
    k = k0(lat_ts)
    inside = lon.between(-180, 180) & lat.between(-90, 90)
    return F.when(inside, F.radians(lon) * F.lit(A * k)), F.when(inside, _q(F.radians(lat)) * F.lit(A / (2 * k)))


def unproject(df: DataFrame, x: str, y: str, steps: int = 3) -> DataFrame:
    """df with lon and lat of x and y: the authalic latitude, then Newton steps, one projection each so that plans stay small."""
    clipped = F.greatest(F.lit(-QP), F.least(F.lit(QP), F.col(y) * F.lit(2 * K0 / A)))
    out = df.withColumn("_q", clipped).withColumn("_phi", F.asin(F.col("_q") / F.lit(QP)))
    for _ in range(steps):
        phi = F.col("_phi")
        s = F.sin(phi)
        w = F.lit(1.0) - F.lit(E2) * s * s
        step = F.try_divide(w * w, F.cos(phi) * F.lit(2 * (1 - E2))) * (F.col("_q") - _q(phi))
        out = out.withColumn("_phi", F.when(F.abs(F.col("_q")) >= QP * (1 - 1e-15), F.signum("_q") * F.lit(math.pi / 2)).otherwise(phi + F.coalesce(step, F.lit(0.0))))
    return out.withColumn("lon", F.degrees(F.col(x) / F.lit(A * K0))).withColumn("lat", F.degrees("_phi")).drop("_q", "_phi")


def xy(lon: float, lat: float) -> tuple[float, float]:
    return A * K0 * math.radians(lon), A * q_of(math.radians(lat)) / (2 * K0)


@dataclass(frozen=True)
class Grid:
    """Square cells of res metres, numbered by rows from the top left, from 1. (0, 0) is a corner of cells."""

    res: float
    xmin: float
    ymin: float
    xmax: float
    ymax: float
    crs: int = 6933

    @classmethod
    def over(cls, res: float | None = None, extent: tuple[float, float, float, float] = (-180, -90, 180, 90), crs: int = 6933) -> Grid:
        """The grid that covers lon/lat bounds (west, south, east, north), snapped outwards to multiples of res."""
        res = number(res or options().grid_res, "res", lower=1)
        if int(crs) != 6933:
            raise ValueError("only EPSG:6933 is built in")
        (x0, y0), (x1, y1) = xy(extent[0], extent[1]), xy(extent[2], extent[3])
        down, up = (lambda v: math.floor(v / res) * res), (lambda v: math.ceil(v / res) * res)
        return cls(res, down(x0), down(y0), up(x1), up(y1), int(crs))

    @property
    def ncol(self) -> int:
        return round((self.xmax - self.xmin) / self.res)

    @property
    def nrow(self) -> int:
        return round((self.ymax - self.ymin) / self.res)

    @property
    def fingerprint(self) -> str:
        """Tells grids apart: cell numbers of different grids don't mix."""
        return f"{self.crs}:{self.res:g}:{self.xmin:g}:{self.ymin:g}:{self.xmax:g}:{self.ymax:g}"

    def __str__(self) -> str:
        return f"grid of {self.ncol} x {self.nrow} cells of {self.res:g} m, x {self.xmin:g} to {self.xmax:g}, y {self.ymin:g} to {self.ymax:g}"

    def cell(self, col: Column, row: Column) -> Column:
        return (row - 1) * self.ncol + col

    def centre_x(self, col: Column) -> Column:
        return F.lit(self.xmin) + (col.cast("double") - 0.5) * F.lit(float(self.res))

    def centre_y(self, row: Column) -> Column:
        return F.lit(self.ymax) - (row.cast("double") - 0.5) * F.lit(float(self.res))


def lookup(grid: Grid, lon: Column, lat: Column) -> Column:
    """The cell of a point; null outside."""
    x, y = project(lon, lat)
    col = F.floor((x - F.lit(grid.xmin)) / F.lit(float(grid.res))) + 1
    row = F.floor((F.lit(grid.ymax) - y) / F.lit(float(grid.res))) + 1
    return F.when(col.between(1, grid.ncol) & row.between(1, grid.nrow), grid.cell(col, row))


def cells(spark: SparkSession, grid: Grid, only: DataFrame | None = None) -> DataFrame:
    """cell, row, col, x, y, lon, lat, area_km2 of all cells, or of those in only(cell); lazy at any resolution."""
    base = spark.range(1, grid.ncol * grid.nrow + 1).withColumnRenamed("id", "cell") if only is None else only.select(F.col("cell").cast("long").alias("cell")).filter(F.col("cell").between(1, grid.ncol * grid.nrow))
    row = F.floor((F.col("cell") - 1) / grid.ncol).cast("int") + 1
    placed = base.withColumn("row", row).withColumn("col", ((F.col("cell") - 1) % grid.ncol + 1).cast("int"))
    placed = placed.withColumn("x", grid.centre_x(F.col("col"))).withColumn("y", grid.centre_y(F.col("row")))
    return unproject(placed, "x", "y").withColumn("area_km2", F.lit(grid.res**2 / 1e6))


def edges(ring: Column) -> Column:
    """The edges (a, b) of a ring of x, y structs, open or closed."""
    closed = F.when(F.element_at(ring, 1) != F.element_at(ring, -1), F.concat(ring, F.slice(ring, 1, 1))).otherwise(ring)
    return F.arrays_zip(F.slice(closed, F.lit(1), F.size(closed) - 1).alias("a"), F.slice(closed, F.lit(2), F.size(closed) - 1).alias("b"))


def inside_edges(px: Column, py: Column, ring_edges: Column) -> Column:
    """Whether a point is inside edges, by the even-odd rule."""

    def crosses(e: Column) -> Column:
        a, b = e["a"], e["b"]
        straddles = (a["y"] > py) != (b["y"] > py)
        at = (b["x"] - a["x"]) * F.try_divide(py - a["y"], b["y"] - a["y"]) + a["x"]
        return straddles & F.coalesce(px < at, F.lit(False))

    return F.aggregate(ring_edges, F.lit(False), lambda odd, e: odd != crosses(e))


def inside(px: Column, py: Column, ring: Column) -> Column:
    """Whether a point is in a ring (array of x, y structs, open or closed), by the even-odd rule."""
    return inside_edges(px, py, edges(ring))


def index(footprints: DataFrame, grid: Grid, ring: str = "ring") -> DataFrame:
    """footprints' columns with cell and weight 1: the cells whose centre lies in the ring of lon, lat structs.

    The ring's projected bounds give a window of candidate cells, so no join with the grid is needed.
    Edges are straight in the projected plane; a ring across the antimeridian isn't split.
    """
    kept = footprints.columns
    return _index(footprints.withColumn("_rings", F.array(F.col(ring))), grid, "_rings", kept)


def index_any(footprints: DataFrame, grid: Grid, rings: str = "rings") -> DataFrame:
    """footprints' columns but the rings, with cell and weight 1: the cells whose centre lies in any of the rings, each once.

    A cell is given for the first ring that it is in, so nothing has to be shuffled to find repeats.
    """
    return _index(footprints, grid, rings, [c for c in footprints.columns if c != rings])


def _index(footprints: DataFrame, grid: Grid, rings: str, kept: list[str]) -> DataFrame:
    res = F.lit(float(grid.res))
    bound = lambda v, low, high: F.greatest(F.lit(low), F.least(F.lit(high), v.cast("int")))

    def planar(ring: Column) -> Column:
        return F.transform(ring, lambda v: F.struct(project(v["lon"], v["lat"])[0].alias("x"), project(v["lon"], v["lat"])[1].alias("y")))

    def with_bounds(ring: Column) -> Column:
        xs, ys = F.transform(ring, lambda v: v["x"]), F.transform(ring, lambda v: v["y"])
        return F.struct(edges(ring).alias("edges"), F.array_min(xs).alias("x0"), F.array_max(xs).alias("x1"), F.array_min(ys).alias("y0"), F.array_max(ys).alias("y1"))

    # generators keep what stands before them from being worked out again for each candidate cell
    named = [F.col(f"`{c}`") for c in kept]
    flat = footprints.select(*named, F.explode(F.array(F.transform(F.col(rings), planar))).alias("_planar"))
    every = flat.select(*named, F.explode(F.array(F.transform("_planar", with_bounds))).alias("_all"))
    one = every.select(*named, "_all", F.posexplode("_all").alias("_k", "_ring"))
    b = F.col("_ring")
    c0, c1 = F.floor((b["x0"] - grid.xmin) / res) + 1, F.floor((b["x1"] - grid.xmin) / res) + 1
    r0, r1 = F.floor((F.lit(grid.ymax) - b["y1"]) / res) + 1, F.floor((F.lit(grid.ymax) - b["y0"]) / res) + 1
    rows = one.withColumn("_row", F.explode(F.sequence(bound(r0, 1, grid.nrow), bound(r1, 1, grid.nrow))))
    both = rows.withColumn("_col", F.explode(F.sequence(bound(c0, 1, grid.ncol), bound(c1, 1, grid.ncol))))
    x, y = grid.centre_x(F.col("_col")), grid.centre_y(F.col("_row"))
    earlier = (F.col("_k") > 0) & F.exists(F.slice("_all", F.lit(1), F.col("_k")), lambda r: inside_edges(x, y, r["edges"]))
    hit = both.filter(x.between(b["x0"], b["x1"]) & y.between(b["y0"], b["y1"]) & inside_edges(x, y, b["edges"]) & ~earlier)
    return hit.select(*named, grid.cell(F.col("_col"), F.col("_row")).cast("long").alias("cell"), F.lit(1.0).alias("weight"))


def box_ring(lon0: Column, lat0: Column, width: float, height: float) -> Column:
    """A closed ring of a lon/lat box from its south-west corner."""
    corner = lambda dx, dy: F.struct((lon0 + dx).alias("lon"), (lat0 + dy).alias("lat"))
    return F.array(corner(0.0, 0.0), corner(width, 0.0), corner(width, height), corner(0.0, height), corner(0.0, 0.0))


def clip_area(ring: list[tuple[float, float]], x0: float, y0: float, x1: float, y1: float) -> float:
    """Area of a simple polygon inside a box, by clipping at each side in turn."""
    sides = [(0, x0, 1), (0, x1, -1), (1, y0, 1), (1, y1, -1)]
    for axis, bound, sign in sides:
        out: list[tuple[float, float]] = []
        for k, b in enumerate(ring):
            a = ring[k - 1]
            ina, inb = sign * (a[axis] - bound) >= 0, sign * (b[axis] - bound) >= 0
            if ina != inb:
                t = (bound - a[axis]) / (b[axis] - a[axis])
                out.append((a[0] + t * (b[0] - a[0]), a[1] + t * (b[1] - a[1])))
            if inb:
                out.append(b)
        ring = out
        if not ring:
            return 0.0
    return abs(sum(ring[k - 1][0] * b[1] - b[0] * ring[k - 1][1] for k, b in enumerate(ring))) / 2


def index_area(footprints: DataFrame, grid: Grid, id_col: str = "id", ring: str = "ring") -> DataFrame:
    """id, cell, weight: the share of each cell that the ring covers, in the projected plane; shares up to 1e-9 are dropped.

    The clipping of a ring with its candidate cells has no relational form; it runs on batches of rings.
    """
    slim = footprints.select(F.col(id_col).alias("id"), F.transform(F.col(ring), lambda v: F.array(v["lon"], v["lat"])).alias("ring"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for key, lonlat in zip(pdf["id"], pdf["ring"], strict=True):
                p = [xy(float(a[0]), float(a[1])) for a in lonlat]
                p = p[:-1] if len(p) > 1 and p[0] == p[-1] else p
                cols = [min(max(math.floor((v - grid.xmin) / grid.res) + 1, 1), grid.ncol) for v in (min(a for a, _ in p), max(a for a, _ in p))]
                lines = [min(max(math.floor((grid.ymax - v) / grid.res) + 1, 1), grid.nrow) for v in (max(b for _, b in p), min(b for _, b in p))]
                for row in range(lines[0], lines[1] + 1):
                    for col in range(cols[0], cols[1] + 1):
                        x, y = grid.xmin + (col - 1) * grid.res, grid.ymax - row * grid.res
                        share = min(1.0, clip_area(p, x, y, x + grid.res, y + grid.res) / grid.res**2)
                        if share > 1e-9:
                            rows.append((key, (row - 1) * grid.ncol + col, share))
            yield pd.DataFrame(rows, columns=["id", "cell", "weight"])

    return slim.mapInPandas(run, f"id {slim.schema['id'].dataType.simpleString()}, cell long, weight double")
