"""A table that is rebuilt unit by unit: only what changed is worked out again.

A unit is a (folder, host) with a digest of its inputs, of the code and of the settings. ``rebuild`` compares digests with
those of the last run, builds units that are new or changed, and writes them as a run of their own. Which run holds a unit
is said by a list of units, written last: it is what readers go by, so a reader sees the last run that was finished or the
new one, never a mixture, and a run that fails leaves the table as it was. Old runs stay until ``vacuum``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.plan import delete, exists, folders

UNIT = ["folder", "host"]


def unit_digests(files: DataFrame, code: str = "", settings: str = "") -> DataFrame:
    """(folder, host, digest) of units from their files (folder, host, rel_path, sha256); ``code`` and ``settings`` are
    digests or versions of what else a result depends on. The order of files doesn't count, nulls do."""
    # files of one unit are few; a digest of each keeps what is gathered small
    each = F.sha2(F.to_json(F.struct("rel_path", "sha256"), {"ignoreNullFields": "false"}), 256)
    gathered = F.array_join(F.array_sort(F.collect_list(each)), "\n")
    return files.groupBy(*UNIT).agg(F.sha2(F.concat_ws("\n", gathered, F.lit(code), F.lit(settings)), 256).alias("digest"))


def _last(spark: SparkSession, path: str) -> int:
    """Number of the last finished run; 0 if there is none."""
    runs = [int(x.removeprefix("run=")) for x in folders(spark, f"{path}/units") if x.startswith("run=")]
    return max((r for r in runs if exists(spark, f"{path}/units/run={r}/_SUCCESS")), default=0)


def units(spark: SparkSession, path: str) -> DataFrame:
    """(folder, host, digest, held_by): the units of the table and the run that holds each."""
    last = _last(spark, path)
    schema = "folder string, host string, digest string, held_by int"
    return spark.read.schema(schema).parquet(f"{path}/units/run={last}") if last else spark.createDataFrame([], schema)


def read(spark: SparkSession, path: str) -> DataFrame | None:
    """The table, with (folder, host) of each row; null before the first run."""
    known = units(spark, path)
    runs = sorted(r["held_by"] for r in known.select("held_by").distinct().collect())
    there = [r for r in runs if exists(spark, f"{path}/rows/run={r}")]
    if not there:
        return None
    rows = spark.read.option("basePath", f"{path}/rows").option("mergeSchema", "true").parquet(*(f"{path}/rows/run={r}" for r in there))
    same = [rows[c].eqNullSafe(known[c]) for c in UNIT]
    return rows.join(known, [*same, rows["run"] == known["held_by"]], "left_semi").drop("run", "unit")


def rebuild(spark: SparkSession, path: str, wanted: DataFrame, build: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Bring the table at ``path`` up to date with ``wanted`` (folder, host, digest; one row a unit). Gives (folder, host,
    change) of the units that were added, changed or removed; without any, nothing is written.

    ``build`` gets the units to build (folder, host) and gives their rows, with these columns. One run at a time: the list
    of units of a run is written once, so of two that begin together the second fails at its end, and changes nothing.
    """
    from ..functions.plan import held

    last = _last(spark, path)
    old, new = units(spark, path), held(wanted.select(*UNIT, "digest"))
    a, b = old.select(*(F.col(c).alias(f"o_{c}") for c in [*UNIT, "digest"]), "held_by"), new
    both: Column = a["o_folder"].eqNullSafe(b["folder"]) & a["o_host"].eqNullSafe(b["host"])
    state = held(a.withColumn("o", F.lit(1)).join(b.withColumn("n", F.lit(1)), both, "full"))
    change = F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "removed").when(~F.col("o_digest").eqNullSafe(F.col("digest")), "changed")
    pick = [F.when(F.col("n").isNull(), F.col(f"o_{c}")).otherwise(F.col(c)).alias(c) for c in UNIT]
    told = state.select(*pick, change.alias("change")).where("change is not null")
    if not told.limit(1).count():
        return told
    todo = told.where("change <> 'removed'").select(*UNIT)
    now = last + 1
    if todo.limit(1).count():
        delete(spark, f"{path}/rows/run={now}")  # what a run that failed has left
        folder = F.concat(F.lit("u"), F.md5(F.to_json(F.struct(*UNIT), {"ignoreNullFields": "false"})))  # a unit's names may be null or no names of folders
        build(todo).withColumn("unit", folder).write.partitionBy("unit").parquet(f"{path}/rows/run={now}")
    listed = state.where("n is not null").select(*UNIT, "digest", F.when(change.isNull(), F.col("held_by")).otherwise(now).cast("int").alias("held_by"))
    if exists(spark, f"{path}/units/run={now}") and not exists(spark, f"{path}/units/run={now}/_SUCCESS"):
        delete(spark, f"{path}/units/run={now}")
    listed.write.mode("errorifexists").parquet(f"{path}/units/run={now}")
    return told


def vacuum(spark: SparkSession, path: str) -> list[int]:
    """Delete runs that hold no unit of the last one, and older lists of units; gives the numbers of the runs deleted."""
    last = _last(spark, path)
    used = {r["held_by"] for r in units(spark, path).select("held_by").distinct().collect()}
    gone = [int(x.removeprefix("run=")) for x in folders(spark, f"{path}/rows") if int(x.removeprefix("run=")) not in used]
    for r in gone:
        delete(spark, f"{path}/rows/run={r}")
    for x in folders(spark, f"{path}/units"):
        if int(x.removeprefix("run=")) < last:
            delete(spark, f"{path}/units/{x}")
    return gone
