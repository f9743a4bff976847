"""Help for plans of long expressions."""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def computed_once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """``df`` with ``columns`` added or replaced, each worked out once for a row.

    Filters move below projections and take the expressions of their columns along, so a parsed field that ten tests name
    would be parsed ten times. Generated columns stay where they are.
    """
    made = F.inline(F.array(F.struct(*(c.alias(f"__once_{n}") for n, c in columns.items()))))
    out = df.select("*", made)
    kept = [F.col(f"`__once_{c}`").alias(c) if c in columns else F.col(f"`{c}`") for c in df.columns]
    return out.select(*kept, *(F.col(f"`__once_{n}`").alias(n) for n in columns if n not in df.columns))


def dealt(df: DataFrame, *by: str, rows: int = 1 << 19, ranges: bool = False) -> DataFrame:
    """``df`` dealt out by ``by`` into partitions of about so many rows, one for each core at least: their number grows with
    the rows, and what a task sorts doesn't. The rows are counted first. ``ranges``: a partition is a range of ``by``."""
    n = max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // rows))
    return df.repartitionByRange(n, *by) if ranges else df.repartition(n, *by)


def held(df: DataFrame) -> DataFrame:
    """``df`` worked out once for what reads it several times: a table in the folder for intermediate files (``scratch``),
    or, on a cluster that names none, ``df`` itself."""
    spark = df.sparkSession
    try:
        path = f"{scratch(spark)}/held-{uuid.uuid4().hex}"
    except ValueError:
        return df
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def scratch(spark: SparkSession) -> str:
    """The folder for intermediate files that ``spark.checkpoint.dir`` names; on local masters a temporary one if it is
    unset. On a cluster it has to be set: machines don't see each other's folders."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not str(spark.sparkContext.master).startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="emberlog-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders in a folder, in whatever store it lies; none if it isn't there."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(x.getPath().getName() for x in store.listStatus(at) if x.isDirectory()) if store.exists(at) else []


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def with_rank(ordered: DataFrame, name: str = "rank") -> DataFrame:
    """The rows of a sorted table with their place, from 1. Places are counted within the parts of the sort, and a table of
    one row per part says how many rows lie before it, so no task gets them all."""
    rows = held(ordered.select("*", F.monotonically_increasing_id().alias("__at")))
    part = F.shiftright("__at", 33)
    before = F.coalesce(F.sum("n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = rows.groupBy(part.alias("__part")).agg(F.count("*").alias("n")).select("__part", before.alias("__before"))
    got = rows.withColumn("__part", part).join(parts, "__part")
    return got.select(*ordered.columns, (F.col("__before") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)) + 1).alias(name))


def running_count(df: DataFrame, test: Column, by: list[str], order: str, name: str, stretch: int = 1 << 16) -> DataFrame:
    """``df`` with the number of rows of the same ``by``, up to and with a row in order of the number ``order``, of which
    ``test`` holds. Numbers are cut into stretches, and a table of one row per stretch says how many lie before it, so no
    task sorts all rows of one ``by``."""
    keys = [*by, "__s"]
    rows = df.withColumns({"__s": F.floor(F.col(order) / stretch), "__t": F.coalesce(test.cast("long"), F.lit(0))})
    before = F.coalesce(F.sum("__n").over(Window.partitionBy(*by).orderBy("__s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = rows.groupBy(*keys).agg(F.sum("__t").alias("__n")).withColumn("__before", before).select(*(F.col(k).alias(f"__of{k}") for k in keys), "__before")
    own = rows.withColumn("__t", F.sum("__t").over(Window.partitionBy(*keys).orderBy(order)))
    same = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"__of{k}")) for k in keys])
    return own.join(sums, same).select(*df.columns, (F.col("__before") + F.col("__t")).alias(name))
