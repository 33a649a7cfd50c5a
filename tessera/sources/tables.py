"""Readers with checked schemas, and the parquet artifacts of an index."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_LONG, _TEXT, _REAL, _FLAG = T.LongType(), T.StringType(), T.DoubleType(), T.BooleanType()
QUERY_FIELDS = {"search_query": _TEXT, "search_location_id": _LONG, "search_is_delivery_search": T.IntegerType(), "search_infm_params_text": _TEXT, "search_category": T.IntegerType()}
ITEM_FIELDS = {
    "item_id": _TEXT, "item_title_raw": _TEXT, "item_description_raw": _TEXT, "item_infm_params_text": _TEXT, "item_category_id": T.IntegerType(),
    "item_microcat_id": _LONG, "item_price": _REAL, "item_rating": _REAL, "item_rating_reviews_count": _REAL, "item_location_id": _LONG,
    "item_latitude": _REAL, "item_longitude": _REAL, "item_is_phone_hidden": _FLAG, "item_is_message_forbidden": _FLAG,
}
HEAVY = "item_description_raw"


def available_columns(spark: SparkSession, path: str) -> list[str]:
    """Column names from the footer; no data is read."""
    return spark.read.parquet(path).columns


def require_columns(df: DataFrame, wanted: Sequence[str]) -> DataFrame:
    """``df`` with just these columns; KeyError names those that are missing."""
    missing = [c for c in wanted if c not in df.columns]
    if missing:
        raise KeyError(f"missing columns: {', '.join(missing)}")
    return df.select(*wanted)


def decimals_to_double(df: DataFrame) -> DataFrame:
    """Decimal columns as double, the others untouched."""
    return df.select(*[F.col(f"`{f.name}`").cast("double").alias(f.name) if isinstance(f.dataType, T.DecimalType) else F.col(f"`{f.name}`") for f in df.schema])


def read_table(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    """A parquet table; a projection reaches the scan."""
    df = spark.read.parquet(path)
    return decimals_to_double(df if columns is None else require_columns(df, columns))


def read_pairs(spark: SparkSession, folder: str, columns: Sequence[str] | None = None, description: bool = False) -> DataFrame:
    """The log of (query, chosen item); the long description only on demand."""
    default = ["pair_id", *QUERY_FIELDS, *[c for c in ITEM_FIELDS if description or c != HEAVY]]
    return read_table(spark, f"{folder}/train.parquet", columns or default)


def read_items(spark: SparkSession, folder: str, columns: Sequence[str] | None = None, description: bool = True) -> DataFrame:
    default = [c for c in ITEM_FIELDS if description or c != HEAVY]
    return read_table(spark, f"{folder}/benchmark_items.parquet", columns or default)


def read_queries(spark: SparkSession, folder: str, columns: Sequence[str] | None = None) -> DataFrame:
    return read_table(spark, f"{folder}/benchmark_queries.parquet", columns or ["query_id", *QUERY_FIELDS])


def corpus(spark: SparkSession, folder: str, columns: Sequence[str] | None = None) -> DataFrame:
    """The items, exact repeats counted once."""
    return read_items(spark, folder, columns).where("item_id is not null").distinct()


def qrels(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, f"{folder}/qrels.parquet", ["query_id", "item_id"]).where("query_id is not null and item_id is not null").distinct()


def _path(spark: SparkSession, path: str):
    """A path and its file system, local or not."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def check_data(spark: SparkSession, paths: Sequence[str]) -> list[dict]:
    """For each path whether it is there, its size in MB and how many columns it has."""
    out = []
    for path in paths:
        try:
            where, system = _path(spark, path)
            out.append({"path": path, "there": True, "mb": round(system.getContentSummary(where).getLength() / 1e6, 3), "columns": len(available_columns(spark, path))})
        except Exception:  # noqa: BLE001 - an absent or unreadable table is the answer
            out.append({"path": path, "there": False, "mb": 0.0, "columns": 0})
    return out


def write_file(df: DataFrame, path: str, format: str, **options) -> None:
    """``df``, small by its meaning, as a single file at ``path``: written beside it and moved there when whole."""
    spark = df.sparkSession
    aside = f"{path}.{uuid.uuid4().hex}"
    try:
        # A table without a partition would give no file at all.
        one = df.repartition(1) if df.isEmpty() else df.coalesce(1)
        one.write.format(format).options(**options).save(aside)
        folder, system = _path(spark, aside)
        part = next(f.getPath() for f in system.listStatus(folder) if f.getPath().getName().startswith("part-"))
        target, _ = _path(spark, path)
        system.mkdirs(target.getParent())
        system.delete(target, True)
        if not system.rename(part, target):
            raise OSError(f"could not write {path}")
    finally:
        system = _path(spark, aside)[1]
        system.delete(_path(spark, aside)[0], True)


def write_text(spark: SparkSession, text: str, path: str) -> None:
    write_file(spark.createDataFrame([(text,)], "value string"), path, "text")


def read_text(spark: SparkSession, path: str) -> str:
    return spark.read.option("wholetext", True).text(path).first()[0]


def write_report(spark: SparkSession, reports: dict[str, DataFrame], path: str) -> dict:
    """Small reports by name as one JSON file; each is a list of its rows."""
    found = {name: [r.asDict(True) for r in df.collect()] for name, df in reports.items()}
    write_text(spark, json.dumps(found, ensure_ascii=False, indent=1, default=str), path)
    return found


def write_table_csv(df: DataFrame, path: str, places: int = 4) -> None:
    """One CSV file with a header, numbers rounded."""
    write_file(df.select(*[F.round(c, places).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes]), path, "csv", header=True, lineSep="\n")


def read_vectors(spark: SparkSession, path: str, key: str, vector: str, expected: DataFrame | None = None) -> DataFrame:
    """(key, vector) rows; with ``expected`` ids, ValueError tells how many of these have no vector and how many vectors are of none.

    A vector stands beside its id, so there is no order that could be wrong.
    """
    got = require_columns(spark.read.parquet(path), [key, vector])
    if expected is not None:
        ids, have = expected.select(key).distinct(), got.select(key).distinct()
        without, strange = ids.join(have, key, "left_anti").count(), have.join(ids, key, "left_anti").count()
        if without or strange:
            raise ValueError(f"{path}: {without} ids without a vector, {strange} vectors of unknown ids")
    return got


def fingerprint(**settings) -> str:
    """A short id of settings, independent of their order."""
    return hashlib.blake2b(json.dumps(settings, sort_keys=True, ensure_ascii=False, default=str).encode(), digest_size=8).hexdigest()


def save_tables(tables: dict[str, DataFrame], folder: str, settings: dict) -> None:
    """Tables as parquet under ``folder`` and a manifest, written last, with their fingerprint."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
    spark = next(iter(tables.values())).sparkSession
    write_text(spark, json.dumps({"settings": settings, "fingerprint": fingerprint(**settings), "tables": sorted(tables)}, ensure_ascii=False, default=str), f"{folder}/manifest.json")


def read_manifest(spark: SparkSession, folder: str) -> dict | None:
    try:
        return json.loads(read_text(spark, f"{folder}/manifest.json"))
    except Exception:  # noqa: BLE001 - no manifest, no artifact
        return None


def load_tables(spark: SparkSession, folder: str, settings: dict | None = None) -> dict[str, DataFrame] | tuple[dict[str, DataFrame], dict] | None:
    """Saved tables, or None if they aren't there or were made with other settings; without ``settings`` the tables and theirs."""
    manifest = read_manifest(spark, folder)
    if manifest is None or (settings is not None and manifest["fingerprint"] != fingerprint(**settings)):
        return None
    tables = {name: spark.read.parquet(f"{folder}/{name}.parquet") for name in manifest["tables"]}
    return tables if settings is not None else (tables, manifest["settings"])


def cached_table(spark: SparkSession, folder: str, settings: dict, make: Callable[[], DataFrame]) -> DataFrame:
    """The table made with just these settings: read if it was saved, else made and saved."""
    found = load_tables(spark, folder, settings)
    if found is None:
        save_tables({"table": make()}, folder, settings)
        found = load_tables(spark, folder, settings)
    return found["table"]


def load_keys(spark: SparkSession, path: str) -> list[str]:
    return json.loads(read_text(spark, path))


def save_keys(spark: SparkSession, keys: Sequence[str], path: str) -> None:
    write_text(spark, json.dumps(list(keys), ensure_ascii=False), path)
