"""Snapshots of one host merged without losing where rows came from; manifests and change tables."""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.plan import held


def volume_order(volume: Column) -> Column:
    """Live volumes first, then snapshots by number."""
    number = F.regexp_extract(volume, r"(?i)^VSS(\d+)$", 1).try_cast("int")
    return F.coalesce(number, F.lit(-1))


def fold_columns(df: DataFrame) -> DataFrame:
    """Column names lower-cased; of names that fold into one, the first not null value."""
    names: dict[str, list[str]] = {}
    for c in df.columns:
        names.setdefault(c.lower(), []).append(c)
    return df.select(*(F.coalesce(*(F.col(f"`{c}`") for c in several)).alias(name) for name, several in names.items()))


def provenance_columns(df: DataFrame, root: str, label: str) -> list[str]:
    """Text columns whose first value names the volume: its root or its label between backslashes. One row comes back."""
    texts = [c for c, t in df.dtypes if t == "string"]
    if not texts:
        return []
    first = df.agg(*(F.first(F.nullif(F.col(f"`{c}`"), F.lit("")), ignorenulls=True).alias(c) for c in texts)).first()
    return [c for c in texts if first[c] and (root and root.lower() in first[c].lower() or f"\\{label}\\".lower() in first[c].lower())]


def merge_snapshots(volumes: dict[str, DataFrame], provenance: list[str] | None = None, into: str = "volumes") -> DataFrame:
    """Rows of the same table in several volumes, once for each distinct row, with the volumes that hold it in order.

    Columns meet by name, whatever the case; a column that a volume lacks is null there, and nulls are alike. Columns of
    ``provenance`` don't tell rows apart; the greatest value stays. A single volume goes through as it is, repeats and
    all; over several volumes repeats within one fall together too. If the table has a column ``into``, another name is
    taken.
    """
    provenance = [c.lower() for c in provenance or []]
    folded = {v: fold_columns(df) for v, df in volumes.items()}
    every = list(dict.fromkeys(c for df in folded.values() for c in df.columns))
    while into in every:
        into += "_"
    if len(folded) == 1:
        (volume, df), = folded.items()
        return df.withColumn(into, F.lit(volume))
    tagged = [df.withColumn("__v", F.struct(volume_order(F.lit(v)).alias("o"), F.lit(v).alias("v"))) for v, df in folded.items()]
    whole = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
    keys = [F.col(f"`{c}`") for c in every if c not in provenance]
    held = F.array_join(F.transform(F.array_sort(F.collect_set("__v")), lambda x: x["v"]), ",")
    return whole.groupBy(*keys).agg(*(F.max(f"`{c}`").alias(c) for c in every if c in provenance), held.alias(into))


def plan_units(volumes: DataFrame) -> DataFrame:
    """(folder, host, volumes, merge): what is merged together: a live volume with its snapshots, never two acquisitions."""
    snapshot = volume_order(F.col("volume")) >= 0
    got = volumes.groupBy("folder", "host").agg(F.array_sort(F.collect_set(F.struct(volume_order(F.col("volume")).alias("o"), F.col("volume").alias("v")))).alias("x"), F.max(snapshot).alias("any_snapshot"), F.max(~snapshot).alias("live"))
    return got.select("folder", "host", F.array_join(F.transform("x", lambda x: x["v"]), ",").alias("volumes"), (F.col("any_snapshot") & F.col("live")).alias("merge"))


def volume_contribution(merged: DataFrame, artifact: str = "artifact", into: str = "volumes") -> DataFrame:
    """Of each volume: rows, artifacts, rows that it alone holds, and the share that others hold too."""
    one = merged.select(artifact, F.size(F.split(into, ",")).alias("n"), F.explode(F.split(into, ",")).alias("volume"))
    got = one.groupBy("volume", artifact).agg(F.count("*").alias("rows"), F.count_if(F.col("n") == 1).alias("only_here")).groupBy("volume").agg(F.sum("rows").alias("rows"), F.count("*").alias("artifacts"), F.sum("only_here").alias("only_here"))
    return got.withColumn("shared_pct", F.round((F.col("rows") - F.col("only_here")) * 100.0 / F.col("rows"), 1))


def contribution_rollup(merged: DataFrame, artifact: str = "artifact") -> DataFrame:
    """Rows by host and artifact with subtotals."""
    return merged.rollup("host", artifact).agg(F.count("*").alias("rows"))


def run_summary(log: DataFrame) -> DataFrame:
    """Of each host: jobs by outcome, seconds, the slowest one and the failed ones."""
    state = lambda s: F.count_if(F.col("status") == s).alias(s)
    return log.groupBy("host").agg(state("ok"), state("skipped"), state("error"), F.sum("seconds").alias("seconds"), F.max_by("job", F.struct("seconds", "job")).alias("slowest"), F.array_join(F.array_sort(F.collect_set(F.when(F.col("status") == "error", F.col("job")))), ",").alias("failed"))


def file_manifest(files: DataFrame, root: str) -> DataFrame:
    """(rel_path, size, sha256, mtime_utc) of binary files (path, length, modificationTime, content)."""
    rel = F.regexp_replace("path", "^" + "".join("\\" + c if not c.isalnum() else c for c in root.rstrip("/")) + "/?", "")
    return files.select(rel.alias("rel_path"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"), F.col("modificationTime").alias("mtime_utc"))


def new_entries(manifest: DataFrame, listing: DataFrame) -> DataFrame:
    """Entries of ``listing`` whose path the manifest lacks; those there stay as they were recorded."""
    return listing.join(manifest.select("rel_path"), "rel_path", "left_anti")


def record_new(path: str, listing: DataFrame, leave_out: tuple[str, ...] = ()) -> DataFrame:
    """Append the entries of ``listing`` that the manifest at ``path`` lacks, but those whose path matches one of the
    patterns ``leave_out`` (what tools wrote themselves). What is recorded stays as it was. Gives the entries added."""
    spark = listing.sparkSession
    wanted = listing.where(~F.coalesce(F.col("rel_path").rlike("|".join(f"(?:{rx})" for rx in leave_out)), F.lit(False))) if leave_out else listing
    try:
        wanted = new_entries(spark.read.schema(listing.schema).parquet(path), wanted)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":  # else the first recording
            raise
    added = held(wanted.dropDuplicates(["rel_path"]))
    added.write.mode("append").parquet(path)
    return added


def flagged_first(rows: DataFrame, *then: str) -> DataFrame:
    """Rows in order: flagged ones first, then by the given columns."""
    return rows.orderBy(F.desc("suspicious"), *then)


def changes(old: DataFrame, new: DataFrame, key: str = "rel_path", digest: str = "sha256") -> DataFrame:
    """(key, change): added, changed, removed; unchanged entries are left out."""
    a, b = old.select(key, F.col(digest).alias("__a"), F.lit(1).alias("__o")), new.select(key, F.col(digest).alias("__b"), F.lit(1).alias("__n"))
    change = F.when(F.col("__o").isNull(), "added").when(F.col("__n").isNull(), "removed").when(~F.col("__a").eqNullSafe(F.col("__b")), "changed")
    return a.join(b, key, "full").select(key, change.alias("change")).where("change is not null")


def set_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows gone and rows new between two sets, with ``change``."""
    gone, new = before.subtract(after), after.subtract(before)
    return gone.withColumn("change", F.lit("removed")).union(new.withColumn("change", F.lit("added")))
