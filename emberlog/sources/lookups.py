"""Lists that detections look things up in, as tables; files are read by Spark, so they may lie in any store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _items(spark: SparkSession, path: str) -> DataFrame:
    """(at, text) of the lines of one small file, in order, without comments and blank lines."""
    df = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", r"\r?\n")).alias("at", "text"))
    return df.withColumn("text", F.rtrim(F.regexp_replace("text", r"(^|\s)#.*$", ""))).where("text <> ''")


def tor_list(spark: SparkSession, path: str) -> DataFrame:
    """(ip) of a list of exit nodes, one a line."""
    return _items(spark, path).select(F.trim("text").alias("ip")).distinct()


def driver_hashes(spark: SparkSession, path: str) -> DataFrame:
    """(sha1, driver, category) of a JSON object ``{"hashes": {sha1: {"n": name, "c": category}}}``."""
    entry = "map<string,struct<n:string,c:string>>"
    df = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", f"hashes {entry}")["hashes"]).alias("sha1", "x"))
    return df.select(F.lower(F.trim("sha1")).alias("sha1"), F.col("x.n").alias("driver"), F.col("x.c").alias("category"))


def _listed(text: str) -> F.Column:
    """The values of a ``[a, b]`` list, lower-cased and without quotes."""
    inner = F.regexp_extract(text, r"\[(.*)\]", 1)
    return F.filter(F.transform(F.split(inner, ","), lambda x: F.lower(F.regexp_replace(F.trim(x), "^[\"']|[\"']$", ""))), lambda x: x != "")


def tool_list(spark: SparkSession, path: str) -> DataFrame:
    """(rank, tool, files, parts) of a YAML list of remote-management tools: ``- name: x`` with ``files: [..]`` and
    ``paths: [..]`` on lines of their own. Tools without either are left out; rank is their order."""
    from pyspark.sql.window import Window

    one = F.regexp_replace(F.trim("text"), r"^-\s*", "")
    rows = _items(spark, path).withColumns({"t": one, "new": F.trim("text").startswith("-").cast("int")})
    rows = rows.withColumn("rank", F.sum("new").over(Window.orderBy("at"))).where("rank > 0")  # one small file
    value = lambda key: F.max(F.when(F.col("t").startswith(f"{key}:"), F.regexp_replace("t", rf"^{key}:\s*", "")))
    got = rows.groupBy("rank").agg(value("name").alias("name"), value("files").alias("files"), value("paths").alias("paths"))
    none = F.array().cast("array<string>")
    got = got.select("rank", F.regexp_replace(F.coalesce("name", F.lit("?")), "^[\"']|[\"']$", "").alias("tool"), F.coalesce(_listed("files"), none).alias("files"), F.coalesce(F.transform(_listed("paths"), lambda x: F.replace(x, F.lit("\\\\"), F.lit("\\"))), none).alias("parts"))
    return got.where((F.size("files") > 0) | (F.size("parts") > 0))


def name_list(spark: SparkSession, path: str) -> DataFrame:
    """(name) of a YAML list ``- name.exe``, lower-cased."""
    return _items(spark, path).where(F.trim("text").startswith("-")).select(F.lower(F.regexp_replace(F.trim("text"), "^-\\s*[\"']?|[\"']$", "")).alias("name")).where("name <> ''").distinct()
