"""Benchmark sets on disk: <dir>/<set>/ground_truth.json, <dir>/<set>/mapping.json and <dir>/<set>/drawings/*.pdf."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _listed(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """The paths of files by name; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern)
    return files.load(folder).select("path")


def _named(path: str, tail: str) -> F.Column:
    return F.regexp_extract(path, rf"([^/]+)/{tail}$", 1)


def discover_sets(spark: SparkSession, folder: str, only: list[str] | None = None) -> DataFrame:
    """set and its drawings (sorted paths, perhaps none) of every folder with a ground truth. A folder that is missing or empty gives no rows."""
    try:
        found = _listed(spark, folder, "ground_truth.json").select(_named("path", "ground_truth\\.json").alias("set"))
        drawings = _listed(spark, folder, "*.[pP][dD][fF]").select(_named("path", "drawings/[^/]+").alias("set"), "path").where("set <> ''")
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], "set string, drawings array<string>")
    out = found.join(drawings.groupBy("set").agg(F.array_sort(F.collect_list("path")).alias("drawings")), "set", "left")
    out = out.select("set", F.coalesce("drawings", F.array().cast("array<string>")).alias("drawings"))
    return out.where(F.col("set").isin(only)) if only else out


def _documents(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """set and text of each file of that name directly in a set's folder."""
    files = spark.read.format("text").option("wholetext", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", name)
    return files.load(folder).select(_named("_metadata.file_path", name.replace(".", "\\.")).alias("set"), "value")


def read_truth(spark: SparkSession, folder: str, only: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """The lines of all truths (set, key_seq, key, truth, description, mapping), and the sets that cannot be scored (set, error).

    `items` has to be an object of numbers. A mapping.json beside the truth overrides the truth's own mapping line by line; one that cannot be
    read is passed over.
    """
    shape = "struct<items: map<string, double>, descriptions: map<string, string>, mapping: map<string, array<string>>>"
    docs = _documents(spark, folder, "ground_truth.json")
    docs = docs.where(F.col("set").isin(only)) if only else docs
    t = docs.select("set", F.from_json("value", shape).alias("t"), F.get_json_object("value", "$").isNotNull().alias("json"))
    good = F.col("t.items").isNotNull() & (F.size(F.map_filter("t.items", lambda _, v: v.isNull())) == 0)
    errors = t.where(~F.coalesce(good, F.lit(False))).select("set", F.when(F.col("json"), "ground truth must be { items: { \"<tag>\": <count> } }").otherwise("ground truth unreadable").alias("error"))
    try:
        extra = _documents(spark, folder, "mapping.json").select("set", F.from_json("value", "map<string, array<string>>").alias("extra")).where("extra is not null")
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER" not in str(e):
            raise
        extra = spark.createDataFrame([], "set string, extra map<string, array<string>>")
    own = F.coalesce("t.mapping", F.create_map().cast("map<string, array<string>>"))
    added = F.coalesce("extra", F.create_map().cast("map<string, array<string>>"))
    x = t.where(good).join(extra, "set", "left").withColumn("mapping", F.map_concat(F.map_filter(own, lambda k, _: ~F.map_contains_key(added, k)), added))
    rows = x.select("set", F.posexplode(F.map_entries("t.items")).alias("key_seq", "i"), "t.descriptions", "mapping")
    key = F.col("i.key")
    return rows.select("set", "key_seq", key.alias("key"), F.col("i.value").cast("long").alias("truth"), F.try_element_at("descriptions", key).alias("description"), F.try_element_at("mapping", key).alias("mapping")), errors
