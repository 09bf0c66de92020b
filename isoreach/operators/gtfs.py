"""Timetables as tables of text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def headways(departures: DataFrame, most: int = 180 * 60) -> DataFrame:
    """stop_id, gap: seconds between successive departures of a stop, above 0 and up to ``most``."""
    gap = F.col("dep_sec") - F.lag("dep_sec").over(Window.partitionBy("stop_id").orderBy("dep_sec", "trip_id"))
    return departures.select("stop_id", gap.alias("gap")).where((F.col("gap") > 0) & (F.col("gap") <= most))


def accessible(flag: Column, keep_unknown: bool = True) -> Column:
    """Wheelchair boarding: 1 is, 2 is not, 0, blank and null are unknown."""
    return (flag == "1") | (F.lit(keep_unknown) & (flag.isNull() | flag.isin("0", "")))


def restricted(feed: dict[str, DataFrame], routes: Column, keep_unknown: bool = True) -> dict[str, DataFrame]:
    """A feed cut to some routes and to accessible stops: trips with two such stops at least, and only the rows that they use."""
    r = feed["routes"].where(routes)
    stops = feed["stops"].where(accessible(F.col("wheelchair_boarding"), keep_unknown))
    trips = feed["trips"].join(r, "route_id", "left_semi")
    times = feed["stop_times"].join(trips, "trip_id", "left_semi").join(stops, "stop_id", "left_semi")
    enough = times.groupBy("trip_id").agg(F.count("*").alias("n")).where("n >= 2").select("trip_id")
    times = times.join(enough, "trip_id", "left_semi")
    trips = trips.join(enough, "trip_id", "left_semi")
    used = feed["stops"].join(times.select("stop_id").distinct(), "stop_id", "left_semi")
    parents = used.where("parent_station is not null and parent_station <> ''").select(F.col("parent_station").alias("stop_id")).distinct()
    out = dict(feed)
    out |= {"routes": r.join(trips, "route_id", "left_semi"), "trips": trips, "stop_times": times, "stops": used.unionByName(feed["stops"].join(parents, "stop_id", "left_semi")).distinct()}
    for name, key in (("calendar", "service_id"), ("calendar_dates", "service_id"), ("shapes", "shape_id")):
        if name in feed:
            out[name] = feed[name].join(trips, key, "left_semi")
    if "agency" in feed:
        out["agency"] = feed["agency"].join(out["routes"], "agency_id", "left_semi")
    if "transfers" in feed:
        ids = out["stops"].select("stop_id")
        out["transfers"] = feed["transfers"].join(ids.withColumnRenamed("stop_id", "from_stop_id"), "from_stop_id", "left_semi").join(ids.withColumnRenamed("stop_id", "to_stop_id"), "to_stop_id", "left_semi")
    return out


def active_services(calendar: DataFrame, exceptions: DataFrame, date: str, weekday: str) -> DataFrame:
    """service_id on a date (yyyymmdd): by weekday and range, with the days added and without those removed."""
    by_day = calendar.where((F.col(weekday) == "1") & (F.col("start_date") <= date) & (F.col("end_date") >= date)).select("service_id")
    on = exceptions.where(F.col("date") == date)
    return by_day.union(on.where("exception_type = '1'").select("service_id")).distinct().join(on.where("exception_type = '2'"), "service_id", "left_anti")


def hop_minutes(stops: DataFrame, order: str, lat: str, lon: str, kmh: float, key: str | None = None) -> DataFrame:
    """The stops with ``hop_min`` from the one before (whole minutes, 1 at least) and ``cum_min``, along an order."""
    from isoreach.functions.geo import haversine_km

    w = (Window.partitionBy(key) if key else Window.partitionBy(F.lit(0))).orderBy(order)
    km = haversine_km(F.lag(lat).over(w), F.lag(lon).over(w), F.col(lat), F.col(lon))
    hop = F.greatest(F.lit(1), F.bround(km / kmh * 60, 0).cast("int"))
    out = stops.withColumn("hop_min", F.when(F.lag(lat).over(w).isNull(), F.lit(0)).otherwise(hop))
    return out.withColumn("cum_min", F.sum("hop_min").over(w.rowsBetween(Window.unboundedPreceding, 0)))


def extended_trips(times: DataFrame, new_stops: DataFrame, at_start: bool) -> DataFrame:
    """Trips (trip_id, stop_id, arrival_time, departure_time, stop_sequence) with new stops (stop_id, cum_min) before their first or after their last stop, numbered from 1."""
    from isoreach.functions.text import hms_of, seconds_of

    pick = F.min_by if at_start else F.max_by
    col = "departure_time" if at_start else "arrival_time"
    ends = times.groupBy("trip_id").agg(pick(F.col(col), F.col("stop_sequence")).alias("t"), pick(F.col("stop_sequence"), F.col("stop_sequence")).alias("s"))
    sign = -1 if at_start else 1
    t = hms_of(seconds_of(F.col("t")) + sign * F.col("cum_min") * 60)
    added = ends.join(F.broadcast(new_stops), F.lit(True)).select("trip_id", "stop_id", t.alias("arrival_time"), t.alias("departure_time"), (F.col("s") + sign * F.col("cum_min") / 10000.0).alias("o"))
    both = times.select("trip_id", "stop_id", "arrival_time", "departure_time", F.col("stop_sequence").cast("double").alias("o")).unionByName(added)
    return both.withColumn("stop_sequence", F.row_number().over(Window.partitionBy("trip_id").orderBy("o", "stop_id"))).drop("o")
