"""Slices of tables replaced, upserted, renamed or deleted: new DataFrames from old ones, and an atomic way to write them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.operators.history import publish_history, read_history


def replace_slices(old: DataFrame, new: DataFrame, key: str, removed: DataFrame | None = None) -> DataFrame:
    """Rows of new in place of all old rows with their keys; keys in removed go too."""
    gone = new.select(key).distinct()
    if removed is not None:
        gone = gone.union(removed.select(key)).distinct()
    return old.join(gone, key, "left_anti").unionByName(new)


def delete_slices(old: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return old.join(keys.select(key).distinct(), key, "left_anti")


def rename_paths(rows: DataFrame, renames: DataFrame, column: str) -> DataFrame:
    """renames: old_path, new_path, one row per old path."""
    names = rows.columns
    return rows.join(renames.withColumnRenamed("old_path", column), column, "left").withColumn(column, F.coalesce("new_path", column)).select(*names)


def upsert(old: DataFrame, new: DataFrame, keys: list[str], version: str) -> DataFrame:
    """The row with the greatest version of each key; at equal versions the new one."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    w = Window.partitionBy(*keys).orderBy(F.col(version).desc_nulls_last(), F.col("_new").desc())
    return both.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n", "_new")


def route(size: Column) -> Column:
    """Where an output of so many bytes goes: raw up to 512, preview up to 4096, pointer beyond."""
    return F.when(size <= 512, "raw").when(size <= 4096, "preview").otherwise("pointer")


def publish(df: DataFrame, folder: str) -> str:
    """Writes a new version whole and switches the table to it in one rename."""
    return publish_history(df, folder)


def current(spark: SparkSession, folder: str) -> DataFrame:
    return read_history(spark, folder)


def overwrite_partitions(df: DataFrame, folder: str, by: str) -> None:
    """Only the partitions that df has rows for are replaced."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(folder)
