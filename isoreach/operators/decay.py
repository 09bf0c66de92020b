"""Impedance, decay, redundancy-weighted union of modes, and saturation over places."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Speeds (km/h), minutes to reach a car, value of time (h/€), fuel (€/l) and consumption (km/l).
WALK_KMH, BIKE_KMH, DRIVE_KMH = 5.0, 15.0, 30.0
DRIVE_ACCESS_MIN, VALUE_OF_TIME = 10.0, 0.2
FUEL_EUR_L, KM_PER_L = 1.8, 15.0
MODES = ("walk", "bike", "drive", "bus", "subway")
# Tickets by transit kind (€).
TICKETS = {"bus": 1.3, "tram": 1.3, "rail": 2.5}


def impedance(mode: str, km: Column, gap_o: Column, gap_p: Column, walkability: Column | None = None) -> Column:
    """Minutes by mode for a network distance and the last-mile gaps, all in km.

    Driving has a constant money term: the cost of one km weighed by the value of time.
    """
    if mode == "walk":
        w = F.lit(5.0) if walkability is None else walkability
        return (1 + 0.15 * (5 - w) / 4) * (km + gap_o + gap_p) / WALK_KMH * 60
    if mode == "bike":
        return (km + gap_o + gap_p) / BIKE_KMH * 60
    if mode == "drive":
        return F.lit(DRIVE_ACCESS_MIN) + km / DRIVE_KMH * 60 + (gap_o + gap_p) / WALK_KMH * 60 + VALUE_OF_TIME * FUEL_EUR_L / KM_PER_L
    raise ValueError(f"unknown mode {mode!r}")


def transit_impedance(access: Column, wait: Column, ride: Column, transfer: Column, egress: Column, routes: Column, ticket: float = TICKETS["bus"]) -> Column:
    """Generalised minutes of an itinerary, at least 0; 0 stands for no service (walk-only, blank or no routes)."""
    gamma = (60 - VALUE_OF_TIME * ticket) / 60
    z = lambda c: F.coalesce(c, F.lit(0.0))
    cost = F.greatest(F.lit(0.0), z(access) + z(wait) + gamma * z(ride) + z(transfer) + z(egress) + VALUE_OF_TIME * ticket)
    return F.when(routes.isNull() | routes.isin("", "[WALK]"), F.lit(0.0)).otherwise(cost)


def decay(minutes: Column, half_life: Column | float, transit: bool = False) -> Column:
    """2 to the power of -minutes / half_life; 0 where the place is not reached (null, NaN, infinite, or transit without service)."""
    half = F.lit(half_life) if isinstance(half_life, (int, float)) else half_life
    missing = minutes.isNull() | F.isnan(minutes) | (F.abs(minutes) == float("inf"))
    if transit:
        missing = missing | (minutes <= 0)
    return F.when(missing, F.lit(0.0)).otherwise(F.exp(-math.log(2) / half * minutes))


def reach_m(half_life: Column | float, least: float, kmh: float) -> Column:
    """Metres within which the decay is at least ``least`` at a speed."""
    half = F.lit(half_life) if isinstance(half_life, (int, float)) else half_life
    return -math.log(least) / (math.log(2) / half) * kmh * 1000 / 60


def weights(m: int, mode: str = "rank_desc") -> list[float]:
    """Redundancy weights of the m modes from the best to the worst."""
    falling = [1 / (i + 1) for i in range(m)]
    known = {"rank_desc": falling, "uniform": [1.0] * m, "rank_asc": falling[::-1]}
    if mode not in known:
        raise ValueError(f"unknown weights {mode!r}; one of {sorted(known)}")
    return known[mode]


def _falling(a: Column, b: Column) -> tuple[Column, Column]:
    return F.greatest(a, b), F.least(a, b)


def modal_union(decays: list[Column], mode: str = "rank_desc") -> Column:
    """1 - product of (1 - weight * decay) over the decays from the largest: further modes add less. A plain product, since ln(0) would lose a decay of 1."""
    if len(decays) == 4:  # the usual case in compiled code: five comparisons sort four values
        (a, b), (c, d) = (_falling(*decays[:2]), _falling(*decays[2:]))
        (first, m), (n, last) = _falling(a, c), _falling(b, d)
        out = F.lit(1.0)
        for x, w in zip((first, *_falling(m, n), last), weights(4, mode)):
            out = out * (1 - x * w)
        known = decays[0].isNotNull() & decays[1].isNotNull() & decays[2].isNotNull() & decays[3].isNotNull()
        return F.when(known, 1 - out)
    ranked = F.sort_array(F.array(*decays), asc=False)
    left = F.zip_with(ranked, F.array(*map(F.lit, weights(len(decays), mode))), lambda d, w: 1 - d * w)
    return 1 - F.aggregate(left, F.lit(1.0), lambda a, x: a * x)


def modal_ranks(decays: list[Column]) -> list[Column]:
    """The rank of each decay from the largest; equal ones in the order given."""
    return [F.lit(1) + sum((F.when((o > d) | ((o == d) & F.lit(j < i)), 1).otherwise(0) for j, o in enumerate(decays) if j != i), F.lit(0)) for i, d in enumerate(decays)]


def saturation_rate(k: float) -> float:
    """The exponent at which k places reach 90 %, to two places (5: -0.46, 10: -0.23, 30: -0.08, 50: -0.05, 80: -0.03)."""
    return round(math.log(0.1) / k, 2)


def saturated(df: DataFrame, keys: list[str], value: str, rate: Column, out: str = "access", count: str | None = None) -> DataFrame:
    """keys and the sum of the values by rank, each worth less than the one before: weight e^(c(r-1)) - e^(c r) at rank r.

    ``count`` names a column that says how many places a row stands for.
    """
    before = Window.partitionBy(*keys).orderBy(F.desc("_x")).rowsBetween(Window.unboundedPreceding, -1)
    own = df.select(*keys, F.col(value).alias("_x"), rate.alias("_c"), (F.lit(1) if count is None else F.col(count)).alias("_n"))
    ranked = own.withColumn("_p", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    # the weights of ranks p + 1 to p + n add up to e^(c p) (1 - e^(c n))
    total = F.sum(F.col("_x") * F.exp(F.col("_c") * F.col("_p")) * -F.expm1(F.col("_c") * F.col("_n")))
    return ranked.groupBy(*keys).agg(F.coalesce(total, F.lit(0.0)).alias(out))
