"""Selection, ownership and identity of tagged places. Tags are one map column, so any key can occur."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from isoreach.functions.text import multi_match

Clause = dict[str, list[str] | bool]


def clause(tags: Column, wanted: Clause) -> Column:
    """Whether all keys match; an absent key does not."""
    out = F.lit(True)
    for key, values in wanted.items():
        out = out & multi_match(tags[key], values)
    return F.coalesce(out, F.lit(False))


def any_clause(tags: Column, clauses: list[Clause]) -> Column:
    """Whether one of the clauses matches; none matches nothing."""
    out = F.lit(False)
    for c in clauses:
        out = out | clause(tags, c)
    return out


def first_clause(tags: Column, clauses: list[Clause]) -> Column:
    """The position of the first clause that matches, from 0; null if none does."""
    out = F.lit(None).cast("int")
    for i in reversed(range(len(clauses))):
        out = F.when(clause(tags, clauses[i]), F.lit(i)).otherwise(out)
    return out


def specificity(tags: Column, clauses: list[Clause]) -> Column:
    """The most keys of a clause that matches; null if none does."""
    return F.array_max(F.array(*(F.when(clause(tags, c), F.lit(len(c))) for c in clauses)))


def raw_tags(tags: Column, wanted: Clause) -> Column:
    """key=value texts of a place for a clause, keys in order and joined by &; one text for each combination of matched parts."""
    out = F.array(F.lit(""))
    for n, key in enumerate(sorted(wanted)):
        value = F.coalesce(tags[key], F.lit(""))
        parts = F.filter(F.transform(F.split(value, ";"), lambda p: F.trim(p)), lambda p: p != "")
        if wanted[key] is not True:
            parts = F.filter(parts, _among(wanted[key]))
        parts = F.when(F.size(parts) == 0, F.array(value)).otherwise(parts)
        out = F.flatten(F.transform(out, _appended(parts, key, "&" if n else "")))
    return out


def _among(values):
    return lambda p: p.isin(list(values))


def _appended(parts: Column, key: str, sign: str):
    return lambda head: F.transform(parts, lambda p: F.concat(head, F.lit(f"{sign}{key}="), p))


def candidates(places: DataFrame, types: dict[str, list[Clause]], key: str = "place_id", tags: str = "tags") -> DataFrame:
    """key, poi_type, idx (order of the types), specificity for every type that a place matches."""
    rows = F.array(*(F.struct(F.lit(t).alias("poi_type"), F.lit(i).alias("idx"), specificity(F.col(tags), cs).alias("specificity")) for i, (t, cs) in enumerate(types.items())))
    return places.select(key, F.inline(rows)).where("specificity is not null")


def owners(cands: DataFrame, keys: list[str]) -> DataFrame:
    """Of the candidates of each key the owner (most specific, then first in order), whether it was contested, and whether the order decided."""
    best = cands.groupBy(*keys).agg(
        F.min_by("poi_type", F.struct(-F.col("specificity"), "idx")).alias("owner"),
        F.max("specificity").alias("top"), F.count("*").alias("n"), F.sort_array(F.collect_list("specificity"), asc=False).alias("all"),
    )
    return best.select(*keys, "owner", (F.col("n") > 1).alias("is_conflict"), ((F.col("n") > 1) & (F.get("all", F.lit(1)) == F.col("top"))).alias("by_order"))


def drops(cands: DataFrame, keys: list[str]) -> DataFrame:
    """The candidates that another type owns."""
    return cands.join(owners(cands, keys).select(*keys, "owner"), keys).where(F.col("poi_type") != F.col("owner")).select(*keys, "poi_type").distinct()


def source_key(columns: list[str]) -> Column:
    """Compact JSON of the columns that are not null, by name."""
    return F.to_json(F.struct(*(F.col(c) for c in sorted(columns))))


def best_candidate(lat: Column, lon: Column, options: Column, fallback: Column) -> Column:
    """Of snap options (lat, lon, dist_m) the one nearest to a point, then with the least snap distance; the fallback if there is none."""
    from isoreach.functions.geo import haversine_m

    ranked = F.transform(options, lambda o: F.struct(haversine_m(lat, lon, o["lat"], o["lon"]).alias("to_m"), o["dist_m"].alias("dist_m"), o["lat"].alias("lat"), o["lon"].alias("lon")))
    best = F.array_min(ranked)
    return F.when(F.size(options) > 0, F.struct(best["lat"].alias("lat"), best["lon"].alias("lon"))).otherwise(fallback)


def relabelled(rows: DataFrame, labels: DataFrame, key: str = "place_id") -> DataFrame:
    """Rows with their types replaced by ``labels`` (key, new_type); an empty new type removes a row."""
    out = rows.join(labels, key, "left").withColumn("poi_type", F.coalesce("new_type", "poi_type"))
    return out.where("poi_type <> ''").drop("new_type")


def combined_request(clauses: DataFrame) -> DataFrame:
    """Of (tag, value; null takes any) the values asked for each tag: one wildcard absorbs them."""
    return clauses.groupBy("tag").agg(F.bool_or(F.col("value").isNull()).alias("any_value"), F.sort_array(F.collect_set("value")).alias("vals")).select("tag", "any_value", F.when(F.col("any_value"), F.lit("*")).otherwise(F.array_join("vals", ",")).alias("request"))


def shortest(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_r = 1").drop("_r")
