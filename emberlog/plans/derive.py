"""Log-shaped tables from the tables at hand, by expressions that any SQL engine can repeat. The Spark side renders real
lines, which the operators then parse; the SQL twins work on the columns behind them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Request targets by event_id % 12; every other engine uses the same list.
URIS = (
    "/index.html", "/login", "/wp-login.php", "/.env", "/a?id=1%27%20union%20select%201", "/static/app.js?v=2", "/x?f=..%2f..%2fetc%2fpasswd", "/api/items?page=3",
    "/q?s=%3Cscript%3Ealert(1)", "/about", "/phpmyadmin/", "/img/logo.png",
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Rows over all cores where the files at hand are so small that they make one split; larger input stays as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def pick(values: tuple[str, ...], index: str) -> F.Column:
    return F.element_at(F.array(*(F.lit(v) for v in values)), (F.expr(index) + 1).cast("int"))


def sql_pick(values: tuple[str, ...], index: str) -> str:
    quoted = ", ".join("'" + v.replace("'", "''") + "'" for v in values)
    return f"([{quoted}])[CAST({index} AS BIGINT) + 1]"


#: Of each event, the fields of a request; Spark and DuckDB read both.
IP = "concat(CASE WHEN user_id % 7 = 0 THEN '93.184.' ELSE '10.0.' END, CAST(user_id % 5 AS STRING), '.', CAST(user_id % 250 AS STRING))"
METHOD = "CASE event_type WHEN 'signup' THEN 'POST' WHEN 'purchase' THEN 'POST' WHEN 'error' THEN CASE WHEN event_id % 9 = 0 THEN 'PROPFIND' ELSE 'GET' END ELSE 'GET' END"
STATUS = "CASE WHEN event_type = 'error' THEN CASE event_id % 4 WHEN 0 THEN '401' WHEN 1 THEN '403' WHEN 2 THEN '404' ELSE '500' END WHEN event_id % 10 = 3 THEN '404' WHEN event_id % 17 = 0 THEN '302' ELSE '200' END"


def access_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Access-log lines, one for each event."""
    e = spread(table(spark, sf_dir, "events"))
    stamp = F.date_format("ts", "dd/MMM/yyyy:HH:mm:ss")
    line = F.concat(
        F.expr(IP), F.lit(" - - ["), stamp, F.lit(' +0000] "'), F.expr(METHOD), F.lit(" "), pick(URIS, "event_id % 12"), F.lit(' HTTP/1.1" '), F.expr(STATUS), F.lit(" "),
        (F.col("event_id") % 5000).cast("string"), F.lit(' "-" "agent/'), (F.col("user_id") % 3).cast("string"), F.lit('"'),
    )
    return e.select(F.lit("web").alias("host"), F.lit("/var/log/nginx/access.log").alias("path"), F.col("event_id").alias("line_no"), line.alias("line"))


def sql_requests() -> str:
    """The requests behind ``access_lines``, for DuckDB."""
    uri = sql_pick(URIS, "event_id % 12")
    return f"""(SELECT event_id, user_id, {IP} AS ip, {METHOD} AS method, {STATUS} AS status, event_id % 5000 AS size, split_part({uri}, '?', 1) AS path,
      CASE WHEN position('?' IN {uri}) > 0 THEN substr({uri}, position('?' IN {uri}) + 1) ELSE '' END AS query,
      strftime(ts, '%Y-%m-%d %H:%M:%S') || ' +0000' AS time, ts, 'agent/' || CAST(user_id % 3 AS VARCHAR) AS ua FROM events)"""


#: URI numbers that attack, with the families by rank, and those of sensitive paths: facts about ``URIS``.
ATTACKS = {4: "sqli", 6: "lfi+traversal", 8: "xss"}
SENSITIVE = (2, 3, 10)


def security_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logon events of twenty hosts: errors fail, clicks and views succeed, purchases use explicit credentials."""
    e = spread(table(spark, sf_dir, "events"))
    kind = "CASE event_type WHEN 'error' THEN '4625' WHEN 'purchase' THEN '4648' ELSE '4624' END"
    payload = F.concat(F.lit("Target: CORP.LOCAL\\User"), (F.col("user_id") % 9).cast("string"), F.lit(" | LogonType "), F.expr("CASE WHEN event_id % 5 = 0 THEN '10' WHEN event_id % 5 = 1 THEN '2' ELSE '3' END"), F.lit(" | TargetServerName: srv"), (F.col("event_id") % 6).cast("string"))
    return e.select(
        F.concat(F.lit("HOST"), (F.col("user_id") % 20).cast("string")).alias("host"), F.expr(kind).alias("event_id"), F.col("ts").cast("timestamp").alias("ts"),
        F.concat(F.lit("corp\\USER"), (F.col("user_id") % 9).cast("string")).alias("user_name"),
        F.concat(F.lit("ws ("), F.lit("10.1.0."), (F.col("event_id") % 25).cast("string"), F.lit(")")).alias("remote_host"), payload.alias("payload"),
    )


def host_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty hosts; the first fifteen have the addresses 10.1.0.0 to 10.1.0.14."""
    ids = table(spark, sf_dir, "events").select((F.col("user_id") % 20).alias("i")).distinct()
    name = F.concat(F.lit("HOST"), F.col("i").cast("string"))
    return ids.select(name.alias("host"), F.concat(F.lower(name), F.lit(".corp.local")).alias("fqdn"), F.when(F.col("i") < 15, F.array(F.concat(F.lit("10.1.0."), F.col("i").cast("string")))).alias("ips"), F.when(F.col("i") % 5 == 0, "linux").otherwise("windows").alias("os"))


SQL_EDGES = """(WITH x AS (SELECT *, 'HOST' || CAST(user_id % 20 AS VARCHAR) AS host, 'CORP\\user' || CAST(user_id % 9 AS VARCHAR) AS u,
    CASE WHEN event_id % 25 < 15 THEN 'HOST' || CAST(event_id % 25 AS VARCHAR) ELSE '10.1.0.' || CAST(event_id % 25 AS VARCHAR) END AS peer,
    CASE WHEN event_id % 5 = 0 THEN 10 WHEN event_id % 5 = 1 THEN 2 ELSE 3 END AS lt FROM events),
  r AS (SELECT peer AS src, host AS dst, u, lt, CASE event_type WHEN 'error' THEN '4625' ELSE '4624' END AS eid, CASE event_type WHEN 'error' THEN 'failed' ELSE 'ok' END AS status, ts,
      event_id % 25 < 15 AS src_case, true AS dst_case FROM x WHERE event_type <> 'purchase' AND lt <> 2
    UNION ALL SELECT host, 'srv' || CAST(event_id % 6 AS VARCHAR), u, lt, '4648', 'ok', ts, true, false FROM x WHERE event_type = 'purchase')
  SELECT src, dst, u AS "user", lt AS logon_type, eid AS event_id, max(status) AS status, count(*) AS n, min(ts) AS first_seen, max(ts) AS last_seen, bool_or(src_case) AS src_case, bool_or(dst_case) AS dst_case
  FROM r WHERE src <> dst GROUP BY src, dst, u, lt, eid)"""
