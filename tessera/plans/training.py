"""The queries of the general training-data operators over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.keys import shuffled
from tessera.operators.packed import known_keys, one_per_key, split_values
from tessera.operators.spatial import circles_around, points_near
from tessera.plans import sql


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Every value of the packed listing and filter texts, with its position."""
    keys = known_keys(table(spark, folder, "param_keys"))
    items = one_per_key(table(spark, folder, "benchmark_items"), "item_id", ["item_infm_params_text"])
    queries = one_per_key(table(spark, folder, "benchmark_queries"), "query_id", ["search_infm_params_text"])
    texts = items.select(F.lit("item").alias("origin"), F.col("item_id").alias("record_id"), F.col("item_infm_params_text").alias("text")).unionAll(
        queries.select(F.lit("query"), "query_id", "search_infm_params_text")
    )
    return split_values(texts, "text", keys, ["origin", "record_id"])


def p1_value_counts(spark: SparkSession, folder: str) -> DataFrame:
    """How often each value of each key occurs, by origin."""
    return p1_found(spark, folder).groupBy("origin", "param_key", "val").agg(F.count(F.lit(1)).alias("n"))


def _searched_circles(spark: SparkSession, folder: str) -> DataFrame:
    used = table(spark, folder, "benchmark_queries").select(F.col("search_location_id").alias("location_id")).where("location_id is not null").distinct()
    circles = one_per_key(table(spark, folder, "search_locations"), "location_id", ["centre_latitude", "centre_longitude", "radius_km"])
    return circles.join(used, "location_id", "left_semi")


def _listed_points(spark: SparkSession, folder: str) -> DataFrame:
    return one_per_key(table(spark, folder, "benchmark_items"), "item_id", ["item_latitude", "item_longitude"])


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """The items inside the circle of each location that a benchmark query searches in."""
    near = circles_around(
        _listed_points(spark, folder),
        _searched_circles(spark, folder),
        ("item_id", "item_latitude", "item_longitude"),
        ("location_id", "centre_latitude", "centre_longitude", "radius_km"),
    )
    return near.select("item_id", "location_id")


def p3_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    """For each item whose id's hash is divisible by 50, the number of other items within 2 km; 0 if it has no coordinates."""
    chosen = F.pmod(F.conv(F.substring(shuffled(F.col("item_id"), 50), 1, 12), 16, 10).cast("bigint"), F.lit(50)) == 0
    items = _listed_points(spark, folder)
    asked = items.where(chosen).select(F.col("item_id").alias("centre_id"), "item_latitude", "item_longitude")
    near = points_near(items, asked, ("item_id", "item_latitude", "item_longitude"), ("centre_id", "item_latitude", "item_longitude"), 2.0)
    counted = near.where("item_id <> centre_id").groupBy(F.col("centre_id").alias("item_id")).agg(F.count(F.lit(1)).alias("neighbours"), F.round(F.min("km"), 6).alias("nearest_km"))
    every = table(spark, folder, "benchmark_items").where("item_id is not null").where(chosen).select("item_id").distinct()
    return every.join(counted, "item_id", "left").select("item_id", F.coalesce("neighbours", F.lit(0)).alias("neighbours"), "nearest_km")


def queries() -> dict:
    return {"p1_found": p1_found, "p1_value_counts": p1_value_counts, "p3_found": p3_found, "p3_neighbours": p3_neighbours}


def oracle_sql() -> dict[str, str]:
    distance = """2 * 6371.0::double * asin(sqrt(least(1.0::double, greatest(0.0::double,
        pow(sin(radians({b}.lat - {a}.lat) / 2), 2) + cos(radians({a}.lat)) * cos(radians({b}.lat)) * pow(sin(radians({b}.lon - {a}.lon) / 2), 2)))))"""
    points = """points as (select item_id, (min(struct_pack(lat := item_latitude, lon := item_longitude))).lat lat, (min(struct_pack(lat := item_latitude, lon := item_longitude))).lon lon
        from benchmark_items where item_id is not null and item_latitude is not null and item_longitude is not null and not ((item_latitude)::varchar = 'nan') and not ((item_longitude)::varchar = 'nan')
        and item_latitude between -90 and 90 and item_longitude between -180 and 180 group by item_id)"""
    packed = sql.packed("""select 'item|' || item_id id, min(item_infm_params_text) t from benchmark_items where item_id is not null group by 1
        union all select 'query|' || query_id, min(search_infm_params_text) from benchmark_queries where query_id is not null group by 1""")
    split = "split_part(id, '|', 1) origin, substr(id, instr(id, '|') + 1) record_id"
    return {
        "p1_found": f"with {packed} select {split}, pos, param_key, val from vals",
        "p1_value_counts": f"with {packed} select split_part(id, '|', 1) origin, param_key, val, count(*) n from vals group by all",
        "p3_neighbours": f"""with {points}, asked as (select distinct item_id from benchmark_items where item_id is not null and ('0x' || substr({sql.shuffled("item_id", 50)}, 1, 12))::bigint % 50 = 0),
            near as (select b.item_id, {distance.format(a="a", b="b")} km from asked join points b using (item_id) join points a on a.item_id <> b.item_id and abs(a.lat - b.lat) < 0.1)
            select item_id, count(km) neighbours, round(min(km), 6) nearest_km from asked left join (select * from near where km <= 2) using (item_id) group by item_id""",
        "p3_found": f"""with {points}, c as (select location_id, centre_latitude lat, centre_longitude lon, radius_km from search_locations
            where centre_latitude is not null and centre_longitude is not null and location_id in (select search_location_id from benchmark_queries))
            select item_id, location_id from points p, c where {distance.format(a="p", b="c")} <= c.radius_km""",
    }
