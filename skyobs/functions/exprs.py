"""Column functions that the operators share. All stay inside whole-stage codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Floor of denominators.
EPS = 1e-6


def clamp(x: Column, lower: float = 0.0, upper: float = 1.0) -> Column:
    """x within the bounds; null stays null, which bare greatest and least would not keep."""
    return F.when(x.isNotNull(), F.greatest(F.lit(lower), F.least(F.lit(upper), x)))


def logistic(x: Column, middle: float | Column, scale: float | Column) -> Column:
    """1 / (1 + exp(-(x - middle) / scale)), with the scale floored at 1e-9."""
    s = F.lit(max(scale, 1e-9)) if isinstance(scale, (int, float)) else F.greatest(scale, F.lit(1e-9))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-(x - middle) / s))


def normalized_difference(a: Column, b: Column) -> Column:
    return (a - b) / F.greatest(a + b, F.lit(EPS))


def period(date: Column, by: str) -> Column:
    """Label of the period of a date: yyyy, yyyy-MM, yyyy-S1 to yyyy-S4 (calendar quarters) or all."""
    year = F.year(date).cast("string")
    labels = {
        "year": lambda: year,
        "month": lambda: F.date_format(date, "yyyy-MM"),
        "season": lambda: F.concat(year, F.lit("-S"), F.quarter(date).cast("string")),
        "all": lambda: F.lit("all"),
    }
    if by not in labels:
        raise ValueError(f"by must be one of {', '.join(labels)}, not {by!r}")
    return labels[by]()


def period_bounds(date: Column, by: str) -> tuple[Column, Column]:
    """First and last day of the year, month or season of a date."""
    unit, months = {"year": ("year", 12), "month": ("month", 1), "season": ("quarter", 3)}[by]
    first = F.trunc(date, unit)
    return first, F.date_sub(F.add_months(first, months), 1)


def doy_phase(date: Column) -> Column:
    """The day of the year as an angle."""
    return F.dayofyear(date) * F.lit(2 * 3.141592653589793 / 365.25)


def binary_entropy(p: Column) -> Column:
    """Entropy in bits, with p kept 1e-9 away from 0 and 1."""
    q = clamp(p, 1e-9, 1 - 1e-9)
    return -(q * F.log2(q) + (F.lit(1.0) - q) * F.log2(F.lit(1.0) - q))


def half_even(x: Column) -> Column:
    """Nearest whole number, halves to the even one, as pixel shifts need."""
    return F.rint(x).cast("int")


def markov(p: Column | float, rho: Column | float) -> tuple[Column, Column]:
    """Chances of cloud after cloud and after clear, for a cloud share p and a persistence rho within [0, 0.999]."""
    p = p if isinstance(p, Column) else F.lit(float(p))
    r = clamp(rho if isinstance(rho, Column) else F.lit(float(rho)), 0.0, 0.999)
    return p + (F.lit(1.0) - p) * r, p * (F.lit(1.0) - r)


def pheno_curve(doy: Column, base: float = 0.15, amp: float = 0.6, sos: float = 120, eos: float = 280, up: float = 0.12, down: float = 0.10) -> Column:
    """Double logistic greenness over the day of the year."""
    rise = F.lit(1.0) / (F.lit(1.0) + F.exp(-(doy - sos) * F.lit(up)))
    fall = F.lit(1.0) / (F.lit(1.0) + F.exp(-(doy - eos) * F.lit(down)))
    return F.lit(base) + F.lit(amp) * (rise - fall)


def solar_position(time: Column, lon: Column, lat: Column) -> tuple[Column, Column]:
    """Solar zenith and azimuth in degrees, from the mean longitude and anomaly of the sun."""
    days = (F.unix_micros(time).cast("double") / 1e6 - F.lit(946728000.0)) / 86400.0  # since 2000-01-01 12:00 UTC
    g = F.radians(F.pmod(F.lit(357.528) + F.lit(0.9856003) * days, F.lit(360.0)))
    mean = F.pmod(F.lit(280.460) + F.lit(0.9856474) * days, F.lit(360.0))
    ecliptic = F.radians(mean + F.lit(1.915) * F.sin(g) + F.lit(0.020) * F.sin(g * 2))
    tilt = F.radians(F.lit(23.439) - F.lit(0.0000004) * days)
    ascension = F.atan2(F.cos(tilt) * F.sin(ecliptic), F.cos(ecliptic))
    declination = F.asin(F.sin(tilt) * F.sin(ecliptic))
    sidereal = F.pmod(F.lit(18.697374558) + F.lit(24.06570982441908) * days, F.lit(24.0))
    hour = F.radians(F.pmod(sidereal * 15 + lon, F.lit(360.0))) - ascension
    phi = F.radians(lat)
    altitude = F.asin(F.sin(phi) * F.sin(declination) + F.cos(phi) * F.cos(declination) * F.cos(hour))
    azimuth = F.atan2(-F.sin(hour), F.tan(declination) * F.cos(phi) - F.sin(phi) * F.cos(hour))
    return F.lit(90.0) - F.degrees(altitude), F.pmod(F.degrees(azimuth) + 360, F.lit(360.0))


def scaled(x: Column, scale: float, offset: float, lower: float = 0.0, upper: float = 1.6) -> Column:
    """Reflectance from digital numbers."""
    return clamp(x * F.lit(scale) + F.lit(offset), lower, upper)


def indices(bands: set[str]) -> dict[str, Column]:
    """Spectral indices, by name, that the bands at hand allow."""
    c = F.col
    out: dict[str, Column] = {}
    for name, (a, b) in {"ndvi": ("nir", "red"), "ndsi": ("green", "swir16"), "ndwi": ("green", "nir")}.items():
        if {a, b} <= bands:
            out[name] = normalized_difference(c(a), c(b))
    if {"blue", "green", "red"} <= bands:
        vis = (c("blue") + c("green") + c("red")) / 3
        out["whiteness"] = (F.abs(c("blue") - vis) + F.abs(c("green") - vis) + F.abs(c("red") - vis)) / F.greatest(vis, F.lit(EPS))
    if {"blue", "red"} <= bands:
        out["hot"] = c("blue") - c("red") * 0.5 - 0.08
    return out
