"""Where intermediate tables go, and how a partition sorted by key is read group by group."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession


#: Of Arrow batches, Spark's defaults and what long texts and blocks of keys call for.
_BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": (("10000",), "2000"), "spark.sql.execution.arrow.maxBytesPerBatch": (("67108864b", "64MB"), "4194304b")}


def shared_dir(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; a temporary one where it is unset, as in tests."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not str(spark.sparkContext.master).startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="emberlog-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once per application, so that it need not be installed there, and have Arrow batches
    of at most 2000 rows and 4 MB, unless the session names other numbers than Spark's defaults."""
    for key, (usual, smaller) in _BATCHES.items():
        if spark.conf.get(key, None) in usual:
            spark.conf.set(key, smaller)
    context = spark.sparkContext
    if getattr(context, "_emberlog_shipped", False):
        return
    root = Path(__file__).resolve().parents[1]
    target = Path(tempfile.mkdtemp(prefix="emberlog-")) / f"{root.name}.zip"
    with zipfile.ZipFile(target, "w") as out:
        for path in sorted(root.rglob("*.py")):
            out.write(path, path.relative_to(root.parent))
    context.addPyFile(str(target))
    context._emberlog_shipped = True


def materialize(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: its lineage ends there, and a lost executor costs
    only the tasks that were running. ``by``: a column of few values that gets a folder for each."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, partitionBy=by)
    return spark.read.schema(df.schema).parquet(path)


def fresh(name: str, df: DataFrame) -> str:
    """``name``, or with underscores behind it if ``df`` has a column of that name."""
    while name.lower() in {c.lower() for c in df.columns}:
        name += "_"
    return name


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of intermediate data, in whatever store it lies."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def sorted_groups(batches: Iterable[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables with the rows of one key each, from batches in which equal keys follow each other."""
    held: list[pa.RecordBatch] = []
    held_key = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(batch.schema.get_field_index(key)).to_numpy(zero_copy_only=False)
        cuts = [0, *(1 + (keys[1:] != keys[:-1]).nonzero()[0]).tolist(), len(keys)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if held and keys[a] != held_key:
                yield pa.Table.from_batches(held)
                held = []
            held_key = keys[a]
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def packed_groups(batches: Iterable[pa.RecordBatch], key: str, rows: int = 4096, size: int = 1 << 62, sized: str = "") -> Iterator[pa.Table]:
    """Like ``sorted_groups``, but whole groups are packed into tables of about ``rows`` rows, or ``size`` bytes of column
    ``sized``, so that vectorised code has long arrays to work on."""
    held: list[pa.Table] = []
    n = weight = 0
    for group in sorted_groups(batches, key):
        more = sum(pc.sum(pc.binary_length(c)).as_py() or 0 for c in group[sized].chunks) if sized else 0
        if held and (n + group.num_rows > rows or weight + more > size):
            yield pa.concat_tables(held)
            held, n, weight = [], 0, 0
        held.append(group)
        n, weight = n + group.num_rows, weight + more
    if held:
        yield pa.concat_tables(held)


def summed(parts: DataFrame, tasks: int, fan: int = 64) -> np.ndarray:
    """Sum of the arrays of doubles that are the rows of ``parts``, one binary column ``v``, of which each task makes one.
    Beyond ``fan`` tasks, groups of them are added up on executors first, so that the driver gets about the square root."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                total = np.frombuffer(raw) + (0.0 if total is None else total)
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()])], ["v"])

    if tasks > fan:
        parts = parts.repartition(max(fan, int(tasks**0.5))).mapInArrow(add, "v binary")
    rows = parts.collect()
    return np.sum([np.frombuffer(r["v"]) for r in rows], axis=0) if rows else np.zeros(0)
