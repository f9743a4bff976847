"""Reading collected files as tables, and writing tables out. No driver-side file access: paths may be in any store."""

from __future__ import annotations

import lzma
import re
from collections.abc import Iterable, Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType
from pyspark.sql.window import Window

#: Live-response artifacts by the last part of their file's name.
ARTIFACTS = (
    "Windows.System.Pslist", "Windows.System.Services", "Windows.System.TaskScheduler", "Windows.Sys.StartupItems", "Windows.Network.Netstat", "Windows.Network.ListeningPorts",
    "Windows.System.Drivers", "Windows.Persistence.PermanentWMIEvents", "Windows.System.DNSCache", "Windows.Network.ArpCache", "Windows.Sys.AllUsers", "Windows.System.LocalAdmins",
    "Windows.System.LoggedInUsers", "Windows.System.HostsFile", "Windows.System.Shares", "Generic.Client.Info",
)
#: Columns of decoded event logs.
EVENT_COLUMNS = (
    "RecordNumber", "EventRecordId", "TimeCreated", "EventId", "Level", "Provider", "Channel", "ProcessId", "ThreadId", "Computer", "ChunkNumber", "UserId", "MapDescription", "UserName",
    "RemoteHost", "PayloadData1", "PayloadData2", "PayloadData3", "PayloadData4", "PayloadData5", "PayloadData6", "ExecutableInfo", "HiddenRecord", "SourceFile", "Keywords", "ExtraDataOffset", "Payload",
)
#: Of what events tell, a part of their channel's name in lower case and their ids.
CHANNELS = {
    "bits": ("bits-client", ("3", "4", "59", "60")), "powershell": ("windows powershell", ("800", "400")), "powershell_scripts": ("powershell/operational", ("4104", "4103")),
    "rdp_auth": ("remoteconnectionmanager", ("1149", "1148")), "rdp_in": ("rdpcorets", ("131", "98")), "rdp_out": ("rdpclient", ("1024", "1102")),
    "rdp_session": ("localsessionmanager", ("21", "22", "23", "24", "25", "39", "40")), "tasks": ("taskscheduler", ("106", "140", "141", "200", "201")), "wmi": ("wmi-activity", ("5857", "5858", "5859", "5860", "5861")),
}


def read_lines(spark: SparkSession, paths: str | list[str], host: Column | None = None) -> DataFrame:
    """(host, path, command, line) of text logs and command outputs; gzip and bzip2 by their suffix, ``.xz`` through
    ``read_xz_lines``. ``command`` is the file's name without its ending. Bytes that are no UTF-8 become the replacement
    character. Lines of one file keep their order within a partition but carry no number: use ``numbered`` where the order
    matters. Empty files give no rows."""
    df = spark.read.text(paths)
    path = F.col("_metadata.file_path")
    return df.select((host if host is not None else F.lit("")).alias("host"), path.alias("path"), F.regexp_replace(F.substring_index(path, "/", -1), r"\.[^.]*$", "").alias("command"), F.regexp_replace(F.make_valid_utf8("value"), "\\r$", "").alias("line"))


def read_xz_lines(spark: SparkSession, path: str, glob: str = "*.xz") -> DataFrame:
    """(host, path, line_no, line) of xz-compressed logs, for which Hadoop has no codec. The compressed file is one row and
    must fit into a task; its text is unpacked and passed on a piece at a time. Damaged files give the lines up to the
    damage."""

    def unpack(batches: Iterable) -> Iterator:
        import pandas as pd

        for batch in batches:
            for name, content in zip(batch["path"], batch["content"], strict=True):
                rest, number, reader = b"", 0, lzma.LZMADecompressor()
                for a in range(0, len(content), 1 << 16):
                    try:
                        pieces = (rest + reader.decompress(content[a : a + (1 << 16)])).split(b"\n")
                    except (lzma.LZMAError, EOFError):
                        break
                    rest = pieces.pop()
                    yield pd.DataFrame([("", name, number + i, x.decode("utf-8", "replace").removesuffix("\r")) for i, x in enumerate(pieces, 1)], columns=["host", "path", "line_no", "line"])
                    number += len(pieces)
                if rest:
                    yield pd.DataFrame([("", name, number + 1, rest.decode("utf-8", "replace"))], columns=["host", "path", "line_no", "line"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInPandas(unpack, "host string, path string, line_no long, line string")


def numbered(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(host, path, line_no, line) of text files of any size. Spark reads a file in splits; lines are counted within each,
    and a table of one row per split says how many lines lie before it. Empty files give no rows."""
    df = spark.read.text(paths).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), F.regexp_replace(F.make_valid_utf8("value"), "\\r$", "").alias("line"))
    # rows of one split are read in order by one task, so their ids follow each other
    blocks = df.groupBy("path", "block").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = blocks.select("path", "block", "first", before.alias("before"))
    return df.join(starts, ["path", "block"]).select(F.lit("").alias("host"), "path", (F.col("at") - F.col("first") + F.col("before") + 1).alias("line_no"), "line")


def decoded_lines(spark: SparkSession, paths: str | list[str], glob: str = "*") -> DataFrame:
    """(host, path, line_no, line) of small text files that carry a byte order mark or are UTF-16, as reports of Windows
    are; without a mark they are UTF-8."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(paths)
    mark = F.hex(F.substring("content", 1, 3))
    text = F.when(mark.startswith("FFFE") | mark.startswith("FEFF"), F.decode("content", "UTF-16")).otherwise(F.regexp_replace(F.decode("content", "UTF-8"), "^\ufeff", ""))
    return files.select(F.lit("").alias("host"), "path", F.posexplode(F.split(F.regexp_replace(text, "\\r?\\n$", ""), "\\r?\\n")).alias("at", "line")).select("host", "path", (F.col("at") + 1).cast("long").alias("line_no"), "line")


def in_rotation_order(lines: DataFrame) -> DataFrame:
    """Lines of rotated logs with ``seq``, their number in the whole log: oldest file first, by line within it. Lines are
    counted file by file, so no task sorts a whole log; needs (host, path, line_no) with numbers from 1."""
    base = F.regexp_replace("path", r"(\.\d+)?(\.(?:gz|xz|bz2))?$", "")
    got = lines.withColumn("log", base)
    sizes = got.groupBy("host", "log", "path").agg(F.max("line_no").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("host", "log").orderBy(F.desc(rotation(F.col("path"))), "path").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return got.join(sizes.withColumn("before", before).drop("n"), ["host", "log", "path"]).withColumn("seq", F.col("before") + F.col("line_no")).drop("before")


def rotation(path: Column) -> Column:
    """Number of a rotated log; 0 for the current one. Greater is older."""
    return F.coalesce(F.regexp_extract(path, r"\.(\d+)(?:\.(?:gz|xz|bz2))?$", 1).try_cast("int"), F.lit(0))


def is_archive(path: Column) -> Column:
    """A dated archive of a log."""
    return F.substring_index(path, "/", -1).rlike(r"-\d{8}")


def newest_lines(lines: DataFrame, most: int) -> DataFrame:
    """At most ``most`` lines of each host, newest first; archives are left out. Optional: nothing here needs a limit."""
    rank = F.row_number().over(Window.partitionBy("host").orderBy(rotation(F.col("path")), F.desc("path"), F.desc("line_no")))
    return lines.where(~is_archive(F.col("path"))).withColumn("__r", rank).where(F.col("__r") <= most).drop("__r")


def within_budget(lines: DataFrame, most: int) -> DataFrame:
    """The newest lines of each file of a host under one budget of ``most`` lines: small files whole, smallest first, and of
    the first that doesn't fit the last lines that do; archives are left out. Optional, like ``newest_lines``."""
    kept = lines.where(~is_archive(F.col("path")))
    sizes = kept.groupBy("host", "path").agg(F.max("line_no").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("host").orderBy("n", "path").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    room = sizes.withColumn("room", F.lit(most) - before).where("room > 0")
    return kept.join(room, ["host", "path"]).where("line_no > n - room").drop("n", "room")


def delimiter_of(lines: DataFrame) -> DataFrame:
    """(path, delimiter) by the first four lines (path, line_no, line): the most frequent of ``, | ; tab`` in the header
    that each further line has as often; null where there is none."""
    marks = {",": ",", "|": r"\|", "\t": "\t", ";": ";"}
    counts = lines.where("line_no <= 4").select("path", "line_no", F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(m).alias("mark"), (F.size(F.split("line", rx)) - 1).alias("n")) for i, (m, rx) in enumerate(marks.items())))).alias("c")).select("path", "line_no", "c.*")
    got = counts.groupBy("path", "i", "mark").agg(F.max(F.when(F.col("line_no") == 1, F.col("n"))).alias("head"), F.min("n").alias("least"))
    good = F.when((F.col("head") > 0) & (F.col("least") >= F.col("head")), F.struct("head", -F.col("i")))
    return got.groupBy("path").agg(F.max_by("mark", good).alias("delimiter"))


def read_delimited(spark: SparkSession, paths: str | list[str], delimiter: str, columns: tuple[str, ...] | None = None, encoding: str = "UTF-8") -> DataFrame:
    """A decoder's table as text columns; bad lines are dropped. With ``columns`` nothing is inferred."""
    reader = spark.read.option("header", "true").option("sep", delimiter).option("mode", "DROPMALFORMED").option("encoding", encoding).option("multiLine", "true").option("escape", '"')
    if columns:
        reader = reader.option("enforceSchema", "false").schema(StructType([StructField(c, StringType()) for c in columns]))
    return reader.csv(paths)


def encoding_of(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, encoding) of text files: UTF-8 if all of their lines can be read as such, else Latin-1."""
    lines = spark.read.text(paths).select(F.col("_metadata.file_path").alias("path"), (~F.is_valid_utf8("value")).alias("bad"))
    return lines.groupBy("path").agg(F.when(F.max("bad"), "ISO-8859-1").otherwise("UTF-8").alias("encoding"))


def read_any_delimited(spark: SparkSession, paths: str | list[str]) -> tuple[DataFrame, DataFrame]:
    """Tables of unknown delimiter and encoding as one, columns met by name, and (path, reason) of files that can't be read.
    Files are grouped by what ``delimiter_of`` and ``encoding_of`` say; there are at most eight groups."""
    kinds = delimiter_of(numbered(spark, paths)).join(encoding_of(spark, paths), "path")
    parts, known = [], kinds.where("delimiter is not null")
    for row in known.groupBy("delimiter", "encoding").agg(F.collect_list("path").alias("paths")).collect():  # names of files, not their rows
        df = read_delimited(spark, sorted(row.paths), row.delimiter, encoding=row.encoding)
        parts.append(df.withColumn("source_path", F.col("_metadata.file_path")))
    whole = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts) if parts else spark.createDataFrame([], "source_path string")
    return whole, kinds.where("delimiter is null").select("path", F.lit("no delimiter").alias("reason"))


def read_json_table(spark: SparkSession, path: str, inner: tuple[str, ...] = ("findings", "entities")) -> DataFrame:
    """A JSON report: an array of rows, or an object one of whose members is the table, or one row. Nested values stay as
    JSON text."""
    df = spark.read.option("multiLine", "true").json(path)
    for name in inner:
        if name in df.columns and df.schema[name].dataType.simpleString().startswith("array<struct"):
            df = df.select(F.inline(name))
            break
    flat = [F.to_json(c).alias(c) if t.startswith(("struct", "array", "map")) else F.col(f"`{c}`") for c, t in df.dtypes]
    return df.select(*flat)


def read_artifact(spark: SparkSession, paths: str | list[str], schema: str) -> DataFrame:
    """Rows of live-response files, one JSON object a line, with their artifact; lines that can't be read are dropped."""
    df = spark.read.schema(f"{schema}, _bad STRING").option("columnNameOfCorruptRecord", "_bad").json(paths)
    name = F.regexp_replace(F.element_at(F.split(F.col("_metadata.file_path"), r"%2F|/"), -1), r"\.jsonl?$", "")
    return df.withColumn("artifact", name).where("_bad is null").drop("_bad")


def events_of(events: DataFrame, kind: str) -> DataFrame:
    """Decoded events of one kind: by channel and event id. An id says nothing without its channel."""
    channel, ids = CHANNELS[kind]
    return events.where(F.lower("Channel").contains(channel) & F.col("EventId").cast("string").isin(*ids))


def table_names(names: list[str], longest: int = 31) -> dict[str, str]:
    """Names of tables for artifacts: letters, digits and underscores, at most ``longest``, told apart by a number where
    they would be the same whatever their case."""
    out, taken = {}, set()
    for name in names:
        base = re.sub(r"\W+", "_", name)[:longest] or "table"
        chosen, k = base, 0
        while chosen.lower() in taken:
            k += 1
            chosen = f"{base[: longest - len(str(k)) - 1]}_{k}"
        taken.add(chosen.lower())
        out[name] = chosen
    return out


def write_table(df: DataFrame, path: str, by: str = "host") -> None:
    """A table as Parquet, a folder for each host."""
    df.write.mode("overwrite").partitionBy(by).parquet(path)


def write_csv(df: DataFrame, path: str) -> bool:
    """A table as CSV with a header; an empty one isn't written. Flags are ``yes`` or empty, arrays joined by plus signs."""
    if df.isEmpty():
        return False
    shown = [F.when(F.col(f"`{c}`"), "yes").otherwise("").alias(c) if t == "boolean" else F.array_join(f"`{c}`", "+").alias(c) if t == "array<string>" else F.col(f"`{c}`") for c, t in df.dtypes]
    df.select(*shown).write.mode("overwrite").option("header", "true").csv(path)
    return True
