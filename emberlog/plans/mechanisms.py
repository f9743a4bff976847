"""Queries of the operators that need a mechanism of their own: overlapping chunks, incremental tables, ordered state,
rules reread by streams, variants and record files."""

from __future__ import annotations

import json
import lzma
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import payloads
from ..functions.plan import dealt
from ..operators import contents, incremental, rules
from ..sources import records
from .catalog import TIME, query
from .derive import table
from .hosts import s
from .more import folder

# ---- contents of any size ----------------------------------------------------------------------------------------------

_A, _B, _C, _D = r"\nth[a-z]{0,6}\n[a-z]{2,9}\nan", r"^[A-Z][a-z]{0,20}\n", r"[.!?]\z", r"(?i:license)\n[a-z]{1,10}\n[a-z]{1,10}"


@query(f"""WITH d AS (SELECT doc_id, replace(text, ' ', chr(10)) AS t FROM documents WHERE text IS NOT NULL), h AS (SELECT doc_id, regexp_matches(t, '{_A}') AS a, regexp_matches(t, '{_B}') AS b, regexp_matches(t, '{_C}') AS c, regexp_matches(t, '{_D}') AS d FROM d)
SELECT doc_id, 'some' AS rule, 'x' AS tags, concat_ws('+', CASE WHEN a THEN 'a' END, CASE WHEN d THEN 'd' END) AS matched FROM h WHERE a OR d
UNION ALL SELECT doc_id, 'both', '', 'b+c' FROM h WHERE b AND c UNION ALL SELECT doc_id, 'but', '', 'a' FROM h WHERE a AND NOT c""")
def content_chunk_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files of a word a line, which strings of rules cross; a chunk is 64 lines."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", " ")).alias("at", "line")).select("doc_id", (F.col("at") + 1).cast("long").alias("line_no"), "line")
    known = [contents.ContentRule("some", {"a": _A, "d": _D}, tags="x"), contents.ContentRule("both", {"b": _B, "c": _C}, least=2), contents.ContentRule("but", {"a": _A, "c": _C}, test=lambda ids: F.array_contains(ids, "a") & ~F.array_contains(ids, "c"))]
    return contents.content_scan_lines(lines, known, ("doc_id",), unbounded=48, block=64)


# ---- incremental tables ------------------------------------------------------------------------------------------------


@query("""WITH u AS (SELECT o_orderstatus AS folder, o_orderpriority AS host, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS keys FROM orders GROUP BY ALL)
SELECT folder, host, n + CASE WHEN folder = 'F' AND host = '1-URGENT' THEN 1 ELSE 0 END AS n, keys, CASE WHEN folder = 'F' AND host = '1-URGENT' OR host = '2-HIGH' THEN 2 ELSE 1 END AS built_by FROM u WHERE NOT (folder = 'P' AND host = '5-LOW')""")
def rebuilt_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table by (status, priority), built twice: the second time one unit has another input, those of one priority are new,
    and one is gone. ``built_by`` tells the run that worked a unit out."""
    at = folder(spark, "incremental")
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("folder"), F.col("o_orderpriority").alias("host"), "o_orderkey")
    files = orders.select("folder", "host", s("o_orderkey").alias("rel_path"), F.md5(s("o_orderkey")).alias("sha256"))

    def build(run: int, more: int):
        def work(todo: DataFrame) -> DataFrame:
            got = orders.join(todo, ["folder", "host"], "left_semi").groupBy("folder", "host").agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("keys"))
            return got.select("folder", "host", F.when((F.col("folder") == "F") & (F.col("host") == "1-URGENT"), F.col("n") + more).otherwise(F.col("n")).alias("n"), "keys", F.lit(run).alias("built_by"))

        return work

    incremental.rebuild(spark, at, incremental.unit_digests(files.where("host <> '2-HIGH'"), code="1"), build(1, 0))
    changed = files.where("not (folder = 'P' and host = '5-LOW')").withColumn("sha256", F.when((F.col("folder") == "F") & (F.col("host") == "1-URGENT"), F.md5("sha256")).otherwise(F.col("sha256")))
    incremental.rebuild(spark, at, incremental.unit_digests(changed, code="1"), build(2, 1))
    return incremental.read(spark, at)


# ---- streams -----------------------------------------------------------------------------------------------------------


@query("""WITH x AS (SELECT user_id, ts, event_type = 'click' AS ok FROM events WHERE event_type IN ('click', 'error')), g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w > INTERVAL 1 DAY THEN 1 ELSE 0 END AS new FROM x WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
i AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS island FROM g), f AS (SELECT *, count(*) FILTER (NOT ok) OVER (PARTITION BY user_id, island ORDER BY ts) AS failures FROM i)
SELECT CAST(user_id AS VARCHAR) AS "user", strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, failures FROM f WHERE ok AND failures >= 2 AND ts < (SELECT max(ts) FROM x) - INTERVAL 2 HOUR""")
def stream_ordered_guesses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Successes after failures, from events that come up to an hour out of order, in four batches."""
    from ..streaming import streams

    e = table(spark, sf_dir, "events").where("event_type in ('click', 'error')").withColumn("came", F.unix_seconds(F.col("ts").cast("timestamp")) + F.col("event_id") % 4 * 1200)
    ends = e.agg(F.min("came").alias("a"), F.max("came").alias("b")).first()
    step = F.least(F.lit(3), ((F.col("came") - ends["a"]) * 4 / F.lit(ends["b"] - ends["a"] + 1)).cast("int"))
    rows = e.select(F.lit("s").alias("src"), F.lit("d").alias("dst"), F.col("user_id").cast("string").alias("user"), F.col("ts").cast("timestamp").alias("ts"), (F.col("event_type") == "click").alias("ok"), step.alias("step"))
    with streams.using(spark, *streams.ROCKSDB):
        got = streams.drain(streams.ordered_brute_force(streams.stream_in_steps(rows, "step", 4).drop("step"), least=2, forget="1 day", late="2 hours"))
    return got.select("user", F.date_format("ts", TIME).alias("ts"), "failures")


@query("""SELECT event_id, 'one' AS rule_id FROM events WHERE event_type = 'error' UNION ALL SELECT event_id, 'two' FROM events WHERE event_id % 3 > 0 AND props LIKE '%7}'""")
def stream_reread_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alerts of a stream that is stopped after a batch and goes on with one rule more."""
    from ..streaming import streams

    e = table(spark, sf_dir, "events").select("event_id", "event_type", "props")
    at = folder(spark, "reread")
    one = {"id": "one", "title": "Errors", "logsource": {}, "detection": {"a": {"event_type": "error"}, "condition": "a"}}
    two = {"id": "two", "title": "Sevens", "logsource": {}, "detection": {"a": {"props|endswith": "7}"}, "condition": "a"}}
    for part, rule in ((0, one), (1, two), (2, None)):
        e.where(F.col("event_id") % 3 == part).write.mode("append").parquet(f"{at}/in")
        stream = spark.readStream.schema(e.schema).parquet(f"{at}/in")
        if rule:
            spark.createDataFrame([(json.dumps(rule),)], "value string").write.mode("append").text(f"{at}/rules")
        streams.reread_rule_alerts(stream, f"{at}/rules", f"{at}/out", f"{at}/state").trigger(availableNow=True).start().awaitTermination()
    return streams.alerts(spark, f"{at}/out").select("event_id", "rule_id")


# ---- payloads of any shape ---------------------------------------------------------------------------------------------


def _payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with a payload whose shape goes by their type: an object, an array, large numbers, half a document, text."""
    text = F.expr("""CASE event_type WHEN 'click' THEN concat('{"app": {"name": "a', user_id, '", "id": ', event_id, '}, "n": 9223372036854775807}')
      WHEN 'view' THEN concat('[{"application": "w', user_id, '", "platform": "x"}, ', event_id, ']') WHEN 'purchase' THEN concat('{"n": 1844674407370955', lpad(event_id % 10000, 4, '0'), ', "value": ', event_id, '.5}')
      WHEN 'signup' THEN concat('{"broken": ', event_id) WHEN 'error' THEN if(event_id % 5 = 0, NULL, concat('"text ', event_id, '"')) END""")
    return table(spark, sf_dir, "events").select("event_id", "event_type", payloads.payload(text).alias("v"))


@query("""SELECT event_id, CASE event_type WHEN 'click' THEN 'a' || CAST(user_id AS VARCHAR) WHEN 'view' THEN 'w' || CAST(user_id AS VARCHAR) END AS app,
  CASE event_type WHEN 'click' THEN '9223372036854775807' WHEN 'purchase' THEN '1844674407370955' || printf('%04d', event_id % 10000) END AS n,
  CASE event_type WHEN 'click' THEN CAST(event_id AS VARCHAR) WHEN 'view' THEN CAST(event_id AS VARCHAR) END AS number, event_type = 'signup' OR event_type = 'error' AND event_id % 5 = 0 AS bad FROM events""")
def payload_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What payloads of different shapes have in common, numbers beyond 2 ** 63 and half documents among them."""
    v = F.col("v")
    return _payloads(spark, sf_dir).select("event_id", payloads.member(v, "$.app.name", "$[0].application").alias("app"), payloads.member(v, "$.n", kind="decimal(38,0)").cast("string").alias("n"), payloads.member(v, "$.app.id", "$[1]", kind="long").cast("string").alias("number"), v.isNull().alias("bad"))


@query("""SELECT event_type, count(*) AS rows, count(*) FILTER (event_type = 'signup' OR event_type = 'error' AND event_id % 5 = 0) AS empty, CASE event_type WHEN 'click' THEN 'OBJECT<app: OBJECT<id: BIGINT, name: STRING>, n: BIGINT>' WHEN 'view' THEN 'ARRAY<VARIANT>'
  WHEN 'purchase' THEN 'OBJECT<n: DECIMAL(20,0), value: DECIMAL(' || CAST(length(CAST(max(event_id) AS VARCHAR)) + 1 AS VARCHAR) || ',1)>' WHEN 'signup' THEN 'VOID' ELSE 'STRING' END AS shape FROM events GROUP BY event_type""")
def payload_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The schema that the payloads of each type have together."""
    return payloads.shapes(_payloads(spark, sf_dir), "v", "event_type")


@query("""SELECT event_id, 0 AS pos, 'app' AS key, '{"id":' || CAST(event_id AS VARCHAR) || ',"name":"a' || CAST(user_id AS VARCHAR) || '"}' AS item FROM events WHERE event_type = 'click'
UNION ALL SELECT event_id, 1, 'n', '9223372036854775807' FROM events WHERE event_type = 'click'
UNION ALL SELECT event_id, 0, NULL, '{"application":"w' || CAST(user_id AS VARCHAR) || '","platform":"x"}' FROM events WHERE event_type = 'view' UNION ALL SELECT event_id, 1, NULL, CAST(event_id AS VARCHAR) FROM events WHERE event_type = 'view'
UNION ALL SELECT event_id, 0, 'n', '1844674407370955' || printf('%04d', event_id % 10000) FROM events WHERE event_type = 'purchase' UNION ALL SELECT event_id, 1, 'value', CAST(event_id AS VARCHAR) || '.5' FROM events WHERE event_type = 'purchase'""")
def payload_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members of objects and elements of arrays, a row each."""
    return payloads.members(_payloads(spark, sf_dir), "v").select("event_id", "pos", "key", F.to_json("item").alias("item"))


# ---- record files ------------------------------------------------------------------------------------------------------


@query("""SELECT event_id, row_number() OVER (PARTITION BY user_id % 3 ORDER BY event_id) - 1 AS n, 'user' || CAST(user_id AS VARCHAR) AS "user", strftime(ts, '%Y-%m-%d %H:%M:%S') AS time_utc, CASE WHEN event_type = 'error' THEN 'DEAD_PROCESS' ELSE 'USER_PROCESS' END AS type, '10.0.0.' || CAST(user_id % 250 AS VARCHAR) AS host FROM events""")
def utmp_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three login databases of many records in several files each, a torn one at the end, read 200 records a task."""
    hexed = lambda text, n: F.rpad(F.hex(F.encode(text, "utf-8")), n * 2, "0")
    little = lambda x, n: F.concat(*(F.lpad(F.hex(F.pmod(F.shiftright(x, 8 * i), F.lit(256))), 2, "0") for i in range(n)))
    e = table(spark, sf_dir, "events")
    kind = F.when(F.col("event_type") == "error", 8).otherwise(7).cast("long")
    record = F.concat(little(kind, 4), F.lit("00" * 4), hexed(F.concat(F.lit("pts/"), s("event_id")), 32), F.lit("00" * 4), hexed(F.concat(F.lit("user"), s("user_id")), 32), hexed(F.concat(F.lit("10.0.0."), s("user_id", 250)), 256), F.lit("00" * 8), little(F.unix_seconds(F.col("ts").cast("timestamp")), 4), F.lit("00" * 39))
    rows = e.select((F.col("user_id") % 3).alias("k"), "event_id", "user_id", "ts", "event_type", F.lit(False).alias("torn"))
    torn = rows.groupBy("k").agg((F.max("event_id") + 1).alias("event_id")).select("k", "event_id", F.lit(None).alias("user_id"), F.lit(None).alias("ts"), F.lit(None).alias("event_type"), F.lit(True))
    at = folder(spark, "utmp")
    # records are written out once their few fields are in order, a file for each stretch of them, so no task holds a database;
    # bytes as text: the writer puts them down as they are, and the last byte of a record, a nought, is what ends a line
    ordered = dealt(rows.union(torn), "k", "event_id", ranges=True).sortWithinPartitions("k", "event_id")
    ordered.select("k", F.unhex(F.when(F.col("torn"), F.lit("07" * 90)).otherwise(record)).cast("string").alias("value")).write.partitionBy("k").option("lineSep", "\0").text(at)
    got = records.read_utmp(spark, at, records=200, rotated=True)
    return got.select(F.regexp_extract("line", r"pts/(\d+)", 1).cast("long").alias("event_id"), "n", "user", F.date_format("time_utc", TIME).alias("time_utc"), "type", "host")


@query("""SELECT user_id % 3 AS k, row_number() OVER (PARTITION BY user_id % 3 ORDER BY event_id) AS line_no, 'event ' || CAST(event_id AS VARCHAR) || ' über' AS line FROM events""")
def xz_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three xz files of many streams each, whose borders cut lines in two; a task reads a stream."""
    e = table(spark, sf_dir, "events").select((F.col("user_id") % 3).alias("k"), "event_id", F.concat(F.lit("event "), s("event_id"), F.lit(" über\n")).alias("line"))
    place = F.row_number().over(Window.partitionBy("k").orderBy("event_id"))
    # of each hundredth line the first bytes are in one stream, the others in the next
    raw = F.encode("line", "utf-8")
    cut = F.when(F.col("at") % 100 == 0, F.lit(13)).otherwise(F.octet_length("line"))
    parts = e.withColumn("at", place).select("k", "at", F.posexplode(F.array(F.substring(raw, F.lit(1), cut), F.substring(raw, cut + 1, F.octet_length("line")))).alias("half", "part")).where("octet_length(part) > 0")
    block = F.expr("(at - 1) div 100 + half").cast("int")
    streams = parts.groupBy("k", block.alias("b")).agg(F.array_sort(F.collect_list(F.struct("at", "half", "part"))).alias("p")).select("k", "b", F.expr("transform(p, x -> x.part)").alias("p"))

    def pack(batches: Iterator) -> Iterator:
        for batch in batches:
            batch["z"] = [lzma.compress(b"".join(p)) for p in batch["p"]]
            yield batch[["k", "b", "z"]]

    packed = streams.mapInPandas(pack, "k long, b int, z binary")
    at = folder(spark, "xz")
    # four noughts are padding between streams
    packed.repartition("k").sortWithinPartitions("k", "b").select("k", F.col("z").cast("string").alias("value")).write.partitionBy("k").option("lineSep", "\0\0\0\0").text(at)
    got = records.read_xz(spark, at, suffix=".txt")
    return got.select(F.regexp_extract("path", r"/k=(\d+)/", 1).cast("long").alias("k"), "line_no", "line")
