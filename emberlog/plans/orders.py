"""Queries whose order is the result, as a column ``rank``, and those of loaders and routing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.plan import with_rank
from ..operators import logons, merge, rules, web
from ..sources import files, lookups
from . import derive
from .catalog import _E, _FAMILY, _RAW_PAIRS, _REASONS, _WEB_RULES, R, TIME, _edges, _requests, _times, query
from .derive import table
from .hosts import s
from .more import _K, folder, text_files

# ---- orders ------------------------------------------------------------------------------------------------------------


@query(f"""WITH r AS {R}, h AS (SELECT 'w1' AS rule_id, 'high' AS level, 2 AS o, * FROM r WHERE event_id % 12 IN (4, 6) UNION ALL SELECT 'w2', 'medium', 3, * FROM r WHERE event_id % 12 = 10 OR (event_id % 12 = 2 AND status = '200')
  UNION ALL SELECT 'w0', 'informational', 5, * FROM r WHERE method = 'POST' UNION ALL SELECT 'w9', 'odd', 6, * FROM r WHERE status = '302' UNION ALL SELECT 'w8', 'critical', 1, * FROM r WHERE method = 'PROPFIND')
SELECT rule_id, level, ip, count(*) AS hits, row_number() OVER (ORDER BY o, count(*) DESC, rule_id, ip) AS rank FROM h GROUP BY rule_id, level, o, ip""")
def rule_hit_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of rules by level, those of unknown level last, then by number."""
    more = [("w0", "informational", {"cs-method": "POST"}), ("w9", "odd", {"sc-status": 302}), ("w8", "Critical", {"cs-method": "propfind"})]
    known = [*_WEB_RULES, *({"id": i, "title": i, "level": level, "logsource": {"category": "web"}, "detection": {"a": test, "condition": "a"}} for i, level, test in more)]
    return with_rank(rules.web_rule_hits(_requests(spark, sf_dir), [rules.load_rule(x) for x in known], ["line_no"]).select("rule_id", "level", "ip", "hits"))


@query(f"""WITH e AS (SELECT *, {_REASONS} AS r FROM {_E}) SELECT src, dst, "user", event_id, logon_type, row_number() OVER (ORDER BY CASE WHEN r = '' THEN 0 ELSE len(string_split(r, '+')) END DESC, src, dst, "user", event_id, logon_type) AS rank FROM e""")
def edge_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges with most reasons first."""
    return with_rank(logons.by_reasons(_edges(spark, sf_dir))).select("src", "dst", "user", "event_id", "logon_type", "rank")


@query(_RAW_PAIRS.replace("{w}", "7200") + """, c AS (SELECT u, x, b, y, min(t_out) AS t_out, arg_max(t_in, (-epoch_us(t_out), epoch_us(t_in))) AS t_in FROM p GROUP BY u, x, b, y)
SELECT u, x, b, y, strftime(t_in, '%Y-%m-%d %H:%M:%S') AS t_in, row_number() OVER (ORDER BY c.t_in, t_out, u, x, b, y) AS rank FROM c ORDER BY rank LIMIT 150""")
def chain_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first chains."""
    got = logons.earliest_chains(logons.pivot_chains(_times(spark, sf_dir), window_s=7200), most=150)
    return with_rank(got).select("u", "x", "b", "y", F.date_format("t_in", TIME).alias("t_in"), "rank")


@query(f"""WITH r AS (SELECT *, CASE WHEN status = '200' THEN {_FAMILY} END AS f FROM {R}) SELECT event_id AS line_no, f AS all_flags, row_number() OVER (ORDER BY time DESC, ip, path, query, event_id) AS rank FROM r WHERE f IS NOT NULL""")
def hunt_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attacks, newest first."""
    return with_rank(web.newest_first(web.hunt(_requests(spark, sf_dir)), "line_no")).select("line_no", "all_flags", "rank")


@query("""SELECT o_orderkey, row_number() OVER (ORDER BY o_orderpriority = '1-URGENT' DESC, o_custkey, o_orderkey) AS rank FROM orders""")
def flagged_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagged rows before others."""
    o = table(spark, sf_dir, "orders").withColumn("suspicious", F.col("o_orderpriority") == "1-URGENT")
    return with_rank(merge.flagged_first(o, "o_custkey", "o_orderkey")).select("o_orderkey", "rank")


# ---- access lines behind proxies ---------------------------------------------------------------------------------------

_HOPS = "CASE event_id % 4 WHEN 0 THEN '' WHEN 1 THEN concat(' \"dead, 203.0.113.', CAST(user_id % 250 AS STRING), ', 10.0.0.1\"') WHEN 2 THEN concat(' 2001:db8::', CAST(user_id % 10 AS STRING)) ELSE ' \"-\"' END"


@query(f"""WITH r AS {R} SELECT event_id AS line_no, CASE event_id % 4 WHEN 1 THEN '203.0.113.' || CAST(user_id % 250 AS VARCHAR) WHEN 2 THEN '2001:db8::' || CAST(user_id % 10 AS VARCHAR) ELSE ip END AS ip, CASE WHEN event_id % 4 IN (1, 2) THEN ip ELSE '' END AS edge_ip, path, ua FROM r""")
def forwarded_clients(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clients that a proxy tells of: the leftmost valid address of a field behind the matched ones."""
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("line_no"), F.expr(_HOPS).alias("hops"))
    found = derive.access_lines(spark, sf_dir).join(e, "line_no").withColumn("line", F.concat("line", F.when(F.col("hops") != "", F.concat(F.lit(" rt=0.1 x-forwarded-for="), F.ltrim("hops"))).otherwise("")))
    return web.parse_access(found).select("line_no", "ip", "edge_ip", "path", "ua")


# ---- rules: where they go ----------------------------------------------------------------------------------------------


@query("""SELECT s_suppkey, CASE s_suppkey % 6 WHEN 0 THEN 'web' WHEN 1 THEN 'auditd' WHEN 2 THEN 'auditd' WHEN 3 THEN 'syslog' WHEN 4 THEN 'syslog' ELSE 'none' END AS target, CASE WHEN s_suppkey % 6 = 3 THEN 's' || CAST(s_suppkey AS VARCHAR) END AS service, CASE WHEN s_suppkey % 6 < 5 THEN CASE WHEN s_suppkey % 2 = 0 THEN 'high' ELSE 'medium' END END AS level FROM supplier""")
def rule_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules by the logs that they are for: web, audit or system logs; those of proxies are for none."""
    out = []
    for row in table(spark, sf_dir, "supplier").select("s_suppkey").toLocalIterator():
        k = row["s_suppkey"]
        source = ({"category": "webserver"}, {"service": "Auditd"}, {"category": "process_creation", "product": "linux"}, {"service": f"S{k}"}, {"service": "no such; service"}, {"category": "proxy"})[k % 6]
        rule = rules.load_rule({"id": f"r{k}", "title": "t", **({"level": "High"} if k % 2 == 0 else {}), "logsource": source, "detection": {"a": {"x": "1"}, "condition": "a"}})
        out.append((k, rule.table if rule else "none", rule.service if rule else None, rule.level if rule else None))
    return spark.createDataFrame(out, "s_suppkey long, target string, service string, level string")


@query("""SELECT event_id, 'ssh' AS rule_id FROM events WHERE event_type IN ('click', 'view') AND user_id % 2 = 0 UNION ALL SELECT event_id, 'any' FROM events WHERE user_id % 2 = 0""")
def rule_services(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules that hold for one service, for any as its name isn't one, and one without a condition, which is skipped."""
    proc = F.when(F.col("event_type") == "click", "sshd").when(F.col("event_type") == "view", "SSHD-session").when(F.col("event_type") == "error", "cron")
    rows = table(spark, sf_dir, "events").select("event_id", proc.alias("proc"), F.when(F.col("user_id") % 2 == 0, "login failed").otherwise("fine").alias("message"))
    made = [rules.load_rule({"id": i, "title": i, "logsource": {"service": service}, "detection": {"k": ["failed"], **({"condition": "k"} if ok else {})}}) for i, service, ok in (("ssh", "sshd", True), ("any", "a b", True), ("skip", "sshd", False))]
    return rules.scan(rows, [r for r in made if r]).select("event_id", "rule_id")


# ---- loaders -----------------------------------------------------------------------------------------------------------


@query("""SELECT 'cmd_' || CAST(user_id % 5 AS VARCHAR) AS command, event_id FROM events""")
def command_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outputs of commands, a file each, whose name says which command it was."""
    at = text_files(table(spark, sf_dir, "events"), s("event_id"), "event_id", F.concat(F.lit("cmd_"), s("user_id", 5)), "commands")
    got = files.read_lines(spark, at)
    # the folder stands for the file's name, which Spark's writer gives
    return got.select(F.when(F.col("command").startswith("part-"), _K()).alias("command"), F.col("line").cast("long").alias("event_id"))


@query("""SELECT 'tor' AS list, '10.0.0.' || CAST(p_partkey AS VARCHAR) AS name, '' AS value FROM part WHERE p_partkey < 200 UNION ALL SELECT 'hash', lower(md5(p_name || CAST(p_partkey AS VARCHAR))), 'drv' || CAST(p_partkey AS VARCHAR) || '.sys/' || CAST(p_size AS VARCHAR) FROM part
UNION ALL SELECT 'tool', 'tool ' || CAST(s_suppkey AS VARCHAR), 'a' || CAST(s_suppkey AS VARCHAR) || '.exe,b.exe/' || CASE WHEN s_suppkey % 3 = 0 THEN '\\x\\' || CAST(s_suppkey AS VARCHAR) ELSE '' END FROM supplier UNION ALL SELECT 'bin', 'n' || CAST(s_suppkey AS VARCHAR) || '.exe', '' FROM supplier""".replace("\\\\", "\\"))
def lookup_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists of exit nodes, drivers, remote tools and programs, written as their files are and read back."""
    part, supplier = table(spark, sf_dir, "part"), table(spark, sf_dir, "supplier")

    def one(df: DataFrame, line, order: str, sep: str = "\n", head: str = "", tail: str = "") -> str:
        """One small file: a list is a file of the analyst's."""
        at = folder(spark, "list")
        text = df.agg(F.concat(F.lit(head), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("l")))), lambda x: x["l"]), sep), F.lit(tail)).alias("value"))
        text.coalesce(1).write.text(at)
        return f"{at}/part-*"

    tor = lookups.tor_list(spark, one(part.where("p_partkey < 200"), F.concat(F.lit("10.0.0."), s("p_partkey"), F.when(F.col("p_partkey") % 2 == 0, "  # note").otherwise("")), "p_partkey", head="# exit nodes\n\n"))
    digest = F.upper(F.md5(F.concat("p_name", s("p_partkey"))))
    hashes = lookups.driver_hashes(spark, one(part, F.concat(F.lit('"'), digest, F.lit('": {"n": "drv'), s("p_partkey"), F.lit('.sys", "c": "'), F.col("p_size").cast("string"), F.lit('"}')), "p_partkey", ", ", '{"hashes": {', "}}"))
    paths = F.when(F.col("s_suppkey") % 3 == 0, F.concat(F.lit("\n  paths: ['\\\\x\\\\"), s("s_suppkey"), F.lit("']"))).otherwise("")
    tools = lookups.tool_list(spark, one(supplier, F.concat(F.lit("- name: tool "), s("s_suppkey"), F.lit("\n  files: [A"), s("s_suppkey"), F.lit('.exe, "b.exe"]'), paths), "s_suppkey"))
    names = lookups.name_list(spark, one(supplier, F.concat(F.lit("- N"), s("s_suppkey"), F.lit(".EXE")), "s_suppkey"))
    return (
        tor.select(F.lit("tor").alias("list"), F.col("ip").alias("name"), F.lit("").alias("value"))
        .union(hashes.select(F.lit("hash"), "sha1", F.concat_ws("/", "driver", "category")))
        .union(tools.select(F.lit("tool"), "tool", F.concat(F.array_join("files", ","), F.lit("/"), F.array_join("parts", ","))))
        .union(names.select(F.lit("bin"), "name", F.lit("")))
    )


@query("""WITH n AS (SELECT s_suppkey, unnest([0, 1, 2]) AS i, s_name FROM supplier) SELECT CASE i WHEN 0 THEN s_name WHEN 1 THEN upper(s_name) ELSE s_name || ' of a very long name indeed' END AS name,
  CASE i WHEN 0 THEN replace(s_name, '#', '_') WHEN 1 THEN upper(replace(s_name, '#', '_')) || '_1' ELSE substr(replace(s_name, '#', '_') || '_of_a_very_long_name_indeed', 1, 31) END AS "table" FROM n""")
def sink_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of tables for artifacts, unlike each other whatever their case."""
    names = [n for r in table(spark, sf_dir, "supplier").select("s_name").orderBy("s_name").toLocalIterator() for n in (r["s_name"], r["s_name"].upper(), f"{r['s_name']} of a very long name indeed")]
    return spark.createDataFrame(list(files.table_names(names).items()), "name string, table string")


# ---- further histories -------------------------------------------------------------------------------------------------

_DNF = (("Installed", "install"), ("Erased", "remove"), ("Upgraded", "upgrade"), ("Downgraded", "downgrade"), ("Obsoleted", "obsolete"), ("Reinstalled", "reinstall"))


@query(f"""WITH p AS (SELECT p_partkey AS k, replace(p_name, ' ', '-') AS n, p_size AS z FROM part)
SELECT 'zypp' AS source, '2024-01-01 10:00:0' || CAST(k % 10 AS VARCHAR) AS time_local, CASE WHEN k % 2 = 0 THEN 'install' ELSE 'remove' END AS action, n AS package, CAST(z AS VARCHAR) || '.' || CAST(k AS VARCHAR) AS version, CASE WHEN k % 2 = 0 THEN 'root@h' || CAST(k AS VARCHAR) ELSE '' END AS actor FROM p
UNION ALL SELECT 'dnf_rpm', '2024-01-01T10:00:0' || CAST(k % 10 AS VARCHAR) || 'Z', {derive.sql_pick(tuple(a for _, a in _DNF), 'k % 6')}, n || '-' || CAST(k AS VARCHAR) || '.x86_64', '', '' FROM p
UNION ALL SELECT 'yum', 'Jan  ' || CAST(k % 9 + 1 AS VARCHAR) || ' 10:00:00', CASE k % 3 WHEN 0 THEN 'install' WHEN 1 THEN 'remove' ELSE 'upgrade' END, n || '-' || CAST(k AS VARCHAR), '', '' FROM p""")
def package_histories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What zypper, dnf and yum have done, among lines that tell of nothing."""
    from ..operators import logs

    p = table(spark, sf_dir, "part").withColumns({"k": F.col("p_partkey"), "n": F.replace("p_name", F.lit(" "), F.lit("-"))})
    digit = s("k", 10)
    zypp = F.concat(F.lit("2024-01-01 10:00:0"), digit, F.when(F.col("k") % 2 == 0, "|install|").otherwise("|remove |"), F.col("n"), F.lit("|"), s("p_size"), F.lit("."), s("k"), F.lit("|x86_64|"), F.when(F.col("k") % 2 == 0, F.concat(F.lit("root@h"), s("k"), F.lit("|repo|"))).otherwise("|"))
    dnf = F.concat(F.lit("2024-01-01T10:00:0"), digit, F.lit("Z SUBDEBUG "), derive.pick(tuple(a for a, _ in _DNF), "k % 6"), F.lit(": "), F.col("n"), F.lit("-"), s("k"), F.lit(".x86_64"))
    yum = F.concat(F.lit("Jan  "), (F.col("k") % 9 + 1).cast("string"), F.lit(" 10:00:00 "), derive.pick(("Installed", "Erased", "Updated"), "k % 3"), F.lit(": "), F.col("n"), F.lit("-"), s("k"))
    logs_of = [("/var/log/zypp/history", (zypp, F.lit("# 2024-01-01 a comment"), F.lit("2024|command|root|x"))), ("/var/log/dnf.rpm.log", (dnf, F.lit("2024-01-01T10:00:00Z INFO --- logging initialized ---"), F.lit("2024-01-01T10:00:00Z SUBDEBUG Verified: x"))), ("/var/log/yum.log", (yum, F.lit("Jan  1 10:00:00 Cleaned: x"), F.lit("")))]
    found = [p.select(F.lit("h").alias("host"), F.lit(path).alias("path"), F.posexplode(F.array(*made)).alias("i", "line"), "k").select("host", "path", (F.col("k") * 3 + F.col("i") + 1).alias("line_no"), "line") for path, made in logs_of]
    return logs.package_history(found[0].union(found[1]).union(found[2])).select("source", "time_local", "action", "package", "version", "actor")


@query("""SELECT CASE WHEN event_id % 2 = 0 THEN 'Chrome' ELSE 'Firefox' END AS browser, 'u' || CAST(user_id AS VARCHAR) AS "user", 'http://h/' || CAST(event_id AS VARCHAR) AS url, 'title ' || event_type AS title, event_id % 7 AS visits, CASE WHEN event_id % 11 > 0 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') END AS last_visit_utc FROM events""")
def browser_visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visits of both kinds of browsers, whose epochs and tables differ; titles end in noughts, some times are nought."""
    from ..operators import host_state

    e = table(spark, sf_dir, "events")
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    base = [F.lit("h").alias("host"), F.concat(F.lit("u"), s("user_id")).alias("user"), F.when(F.col("event_id") % 2 == 0, "Chrome").otherwise("Firefox").alias("browser"), F.concat(F.lit("http://h/"), s("event_id")).alias("url"), F.concat(F.lit("title "), F.col("event_type"), F.lit("\0")).alias("title"), (F.col("event_id") % 7).alias("visit_count")]
    never = F.col("event_id") % 11 == 0
    chromium = e.where("event_id % 2 = 0").select(*base, F.when(never, 0).otherwise(micros + 11644473600000000).alias("last_visit_time"))
    firefox = e.where("event_id % 2 = 1").select(*base, F.when(never, None).otherwise(micros).alias("last_visit_date"))
    got = host_state.browser_history(chromium, firefox)
    return got.select("browser", "user", "url", "title", "visits", F.date_format("last_visit_utc", TIME).alias("last_visit_utc"))
