"""All registered queries of the library proper, with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import net, strings
from ..operators import logons, logs, merge, rules, web
from . import derive
from .derive import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
TIME = "yyyy-MM-dd HH:mm:ss"


def query(sql: str | None = None) -> Callable:
    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return web.parse_access(derive.access_lines(spark, sf_dir))


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logons.edges(logons.security_edges(derive.security_events(spark, sf_dir)), derive.host_table(spark, sf_dir))


def _times(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logons.edge_times(logons.security_edges(derive.security_events(spark, sf_dir)), derive.host_table(spark, sf_dir))


R = derive.sql_requests()
_HITS = " OR ".join(f"event_id % 12 = {k}" for k in derive.ATTACKS)
_SENS = "event_id % 12 IN (" + ", ".join(map(str, derive.SENSITIVE)) + ")"


@query(f"SELECT event_id AS line_no, ip, '' AS edge_ip, time, method, path, query, status, CAST(size AS VARCHAR) AS size, '-' AS referer, ua FROM {R}")
def web_access(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _requests(spark, sf_dir).select("line_no", "ip", "edge_ip", "time", "method", "path", "query", "status", "size", "referer", "ua")


@query(f"""WITH r AS {R}, s AS (SELECT ip, count(*) AS requests, count(*) FILTER (status LIKE '2%') AS s2xx, count(*) FILTER (status LIKE '3%') AS s3xx, count(*) FILTER (status = '401') AS s401,
  count(*) FILTER (status = '403') AS s403, count(*) FILTER (status = '404') AS s404, count(*) FILTER (status LIKE '4%' AND status NOT IN ('401', '403', '404')) AS s4xx, count(*) FILTER (status LIKE '5%') AS s5xx,
  CAST(sum(size) AS BIGINT) AS bytes, count(DISTINCT path) AS paths, count(*) FILTER (method = 'PROPFIND') AS odd, count(*) FILTER ({_HITS}) AS attack_hits, min(time) AS first_seen, max(time) AS last_seen FROM r GROUP BY ip)
SELECT ip, requests, s2xx, s3xx, s401, s403, s404, s4xx, s5xx, bytes, paths, CASE WHEN odd > 0 THEN 'PROPFIND:' || CAST(odd AS VARCHAR) ELSE '' END AS odd_methods, attack_hits, first_seen, last_seen,
  array_to_string(list_filter([CASE WHEN attack_hits > 0 THEN 'attack' END, CASE WHEN s401 + s403 >= 20 AND s401 + s403 >= requests * 0.10 THEN 'auth-fail' END,
    CASE WHEN (s404 >= 50 AND s404 >= requests * 0.25) OR (requests >= 30 AND s404 > requests * 0.5) THEN 'scan' END, CASE WHEN odd > 0 THEN 'odd-method' END], lambda x: x IS NOT NULL), '+') AS flags FROM s""")
def web_ip_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = web.ip_stats(_requests(spark, sf_dir))
    return got.select("ip", "requests", "s2xx", "s3xx", "s401", "s403", "s404", "s4xx", "s5xx", "bytes", "paths", "odd_methods", "attack_hits", "first_seen", "last_seen", F.array_join("flags", "+").alias("flags"))


@query(f"SELECT path, count(*) AS count, count(DISTINCT ip) AS distinct_ips, bool_or({_SENS}) AS sensitive FROM {R} WHERE status = '404' GROUP BY path HAVING count(*) >= 3 OR bool_or({_SENS})")
def web_404_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return web.missing_paths(_requests(spark, sf_dir))


@query(f"""SELECT ip, path, count(*) FILTER (status = '401') AS s401, count(*) FILTER (status = '403') AS s403, count(*) AS total, min(time) AS first_seen, max(time) AS last_seen,
  CASE WHEN count(*) >= 10 THEN CASE WHEN bool_or({_SENS}) THEN 'cluster+sensitive' ELSE 'cluster' END WHEN bool_or({_SENS}) THEN 'sensitive' ELSE '' END AS flags
  FROM {R} WHERE status IN ('401', '403') GROUP BY ip, path""")
def web_auth_fail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return web.auth_failures(_requests(spark, sf_dir)).withColumn("flags", F.array_join("flags", "+"))


@query(f"SELECT ip, substr(time, 1, 10) AS day, count(*) AS n FROM {R} GROUP BY ALL")
def web_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return web.daily_series(_requests(spark, sf_dir))


@query(f"SELECT path, count(*) AS n, count(DISTINCT ip) AS ips FROM {R} GROUP BY path ORDER BY n DESC, path LIMIT 5")
def web_top_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return web.top_values(_requests(spark, sf_dir), "path", 5)


@query(f"""SELECT ip, path, n, ips, rank FROM (SELECT ip, path, count(*) AS n, count(DISTINCT ip) AS ips, CAST(row_number() OVER (PARTITION BY ip ORDER BY count(*) DESC, path) AS INT) AS rank FROM {R} GROUP BY ip, path) WHERE rank <= 4""")
def web_top_paths_by_ip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return web.top_values(_requests(spark, sf_dir), "path", 4, ["ip"])


@query(f"SELECT path AS item, count(*) AS count FROM {R} GROUP BY path ORDER BY count DESC, path LIMIT 5")
def web_approx_top_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return web.approx_top_values(_requests(spark, sf_dir), "path", 5)


_FAMILY = "CASE event_id % 12 " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in derive.ATTACKS.items()) + " END"


@query(f"""WITH r AS (SELECT *, CASE WHEN status = '200' THEN {_FAMILY} END AS f, CASE WHEN ua = 'agent/2' AND event_id % 12 = 3 THEN 'probe' END AS o FROM {R})
SELECT event_id AS line_no, ip, CASE WHEN f IS NOT NULL THEN split_part(f, '+', 1) ELSE o END AS flag, concat_ws('+', f, o) AS all_flags FROM r WHERE f IS NOT NULL OR o IS NOT NULL""")
def web_hunt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return web.hunt(_requests(spark, sf_dir), [("probe", r"/\.env.*agent/2"), ("never", r"zzzz")]).select("line_no", "ip", "flag", "all_flags")


def _ranges(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Address ranges from the nations: nation k owns 93.184.k.0/24; every third is rented out."""
    n = table(spark, sf_dir, "nation")
    first = (F.lit(93 * 256 + 184).cast("long") * 256 + F.col("n_nationkey")) * 256
    countries = n.where("n_nationkey < 4").select(first.alias("first"), (first + 255).alias("last"), F.upper(F.substring("n_name", 1, 2)).alias("country"))
    networks = n.where("n_nationkey < 3").select(first.alias("first"), (first + 255).alias("last"), (F.col("n_nationkey") + 64500).cast("long").alias("number"), F.when(F.col("n_nationkey") == 1, "Example Hosting").otherwise(F.col("n_name")).alias("org"))
    tor = table(spark, sf_dir, "events").where("user_id % 250 = 21").select(F.expr(derive.IP).alias("ip"))
    return countries, networks, tor


@query(f"""WITH i AS (SELECT DISTINCT {derive.IP} AS ip FROM events), p AS (SELECT *, ip LIKE '10.%' AS private, CAST(split_part(ip, '.', 3) AS INT) AS k FROM i),
t AS (SELECT DISTINCT {derive.IP} AS ip FROM events WHERE user_id % 250 = 21), c AS (SELECT n_nationkey AS k, upper(substr(n_name, 1, 2)) AS country, n_name FROM nation WHERE n_nationkey < 4)
SELECT ip, CASE WHEN private THEN 'LAN' ELSE coalesce(country, '?') END AS country, CASE WHEN private OR p.k >= 3 THEN '' ELSE 'AS' || CAST(64500 + p.k AS VARCHAR) || ' ' || CASE WHEN p.k = 1 THEN 'Example Hosting' ELSE n_name END END AS asn,
  CASE WHEN private THEN 'private' WHEN ip IN (SELECT ip FROM t) THEN 'tor' WHEN p.k = 1 THEN 'hosting' WHEN country = (SELECT upper(substr(n_name, 1, 2)) FROM nation WHERE n_nationkey = 2) THEN 'local' WHEN country IS NULL THEN 'unknown' ELSE 'foreign' END AS origin
FROM p LEFT JOIN c ON c.k = p.k""")
def web_geo_origin(spark: SparkSession, sf_dir: str) -> DataFrame:
    home = table(spark, sf_dir, "nation").where("n_nationkey = 2").select(F.upper(F.substring("n_name", 1, 2))).first()[0]
    return web.geo_origin(_requests(spark, sf_dir), *_ranges(spark, sf_dir), home=home)


_WEB_RULES = [
    {"id": "w1", "title": "Injection", "level": "high", "logsource": {"category": "webserver"}, "tags": ["attack.t1190"], "detection": {"sel": {"cs-uri-query|contains": ["union%20select", "etc%2fpasswd"]}, "condition": "sel"}},
    {"id": "w2", "title": "Admin pages", "level": "medium", "logsource": {"category": "webserver"}, "detection": {"a": {"cs-uri-stem|startswith": "/phpmyadmin"}, "b": {"cs-uri-stem|endswith": ".php", "sc-status": 200}, "condition": "1 of them"}},
]


@query(f"""WITH r AS {R}, h AS (SELECT 'w1' AS rule_id, 'Injection' AS rule, 'high' AS level, * FROM r WHERE event_id % 12 IN (4, 6) UNION ALL
  SELECT 'w2', 'Admin pages', 'medium', * FROM r WHERE event_id % 12 = 10 OR (event_id % 12 = 2 AND status = '200'))
SELECT rule_id, rule, level, ip, count(*) AS hits, min(time) AS first_seen, max(time) AS last_seen, arg_min(path || CASE WHEN query <> '' THEN '?' || query ELSE '' END, event_id) AS uri, arg_min(ua, event_id) AS ua,
  arg_min(method, event_id) AS method, arg_min(status, event_id) AS status FROM h GROUP BY rule_id, rule, level, ip""")
def web_rule_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.web_rule_hits(_requests(spark, sf_dir), [rules.load_rule(x) for x in _WEB_RULES], ["line_no"])


_TEXT_RULES = [
    {"id": "t1", "title": "Words", "level": "low", "logsource": {}, "detection": {"keywords": ["license", "disgusting"], "condition": "keywords"}},
    {"id": "t2", "title": "Start and end", "level": "critical", "logsource": {}, "detection": {"a": {"message|startswith": "th"}, "b": {"message|endswith": "."}, "c": {"lang": "en"}, "condition": "a and b and not c"}},
    {"id": "t3", "title": "Pattern", "level": "medium", "logsource": {}, "detection": {"a": {"message|re": "[0-9]{3}-[0-9]{4}"}, "b": {"message|contains|all": ["and", "the"]}, "condition": "(a or b) and not missing", "missing": {"absent": "x"}}},
    {"id": "t4", "title": "Wildcard", "level": "high", "logsource": {}, "detection": {"a": {"source": "src1*"}, "b": {"message": None}, "condition": "a or b"}},
]


@query(r"""SELECT doc_id, rule_id, level FROM (SELECT doc_id, 't1' AS rule_id, 'low' AS level FROM documents WHERE text ILIKE '%license%' OR text ILIKE '%disgusting%'
UNION ALL SELECT doc_id, 't2', 'critical' FROM documents WHERE lower(text) LIKE 'th%' AND text LIKE '%.' AND NOT lang = 'en'
UNION ALL SELECT doc_id, 't4', 'high' FROM documents WHERE lower(source) LIKE 'src1%' OR text IS NULL)""")
def rule_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("message", F.col("text"))
    return rules.scan(docs, [rules.load_rule(x) for x in _TEXT_RULES]).select("doc_id", "rule_id", "level")


@query(r"""SELECT page_id, 'script' AS rule, array_to_string(list_filter([CASE WHEN regexp_matches(html, '<script') THEN 'a' END, CASE WHEN regexp_matches(html, 'track\(') THEN 'b' END], lambda x: x IS NOT NULL), '+') AS matched FROM pages
WHERE regexp_matches(html, '<script') OR regexp_matches(html, 'track\(')
UNION ALL SELECT page_id, 'both', 'x+y' FROM pages WHERE regexp_matches(html, '<table') AND regexp_matches(html, '<img')""")
def content_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rules.content_scan(table(spark, sf_dir, "pages"), [rules.ContentRule("script", {"a": "<script", "b": r"track\("}), rules.ContentRule("both", {"x": "<table", "y": "<img"}, least=2)], "html")
    return found.select("page_id", "rule", "matched")


@query(rf"""SELECT page_id, regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://([^/:?#]*)', 1) AS host, CASE WHEN regexp_matches(split_part(split_part(url, '?', 1), '#', 1), '\.([A-Za-z0-9]{{1,10}})$') AND NOT regexp_matches(split_part(split_part(url, '?', 1), '#', 1), '^[a-z]+://[^/]*$')
  THEN lower(regexp_extract(split_part(split_part(url, '?', 1), '#', 1), '\.([A-Za-z0-9]{{1,10}})$', 1)) ELSE '' END AS ext FROM pages""")
def page_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.regexp_extract("url", r"^[A-Za-z]+://[^/?#]*([^?#]*)", 1)
    return table(spark, sf_dir, "pages").select("page_id", strings.url_host(F.col("url")).alias("host"), strings.file_ext(path).alias("ext"))


_E = derive.SQL_EDGES
_REASONS = """array_to_string(list_sort(list_filter([CASE WHEN status = 'failed' THEN 'failed_logon' END, CASE WHEN event_id = '4648' THEN 'explicit_creds' END, CASE WHEN event_id <> '4648' AND src_case THEN 'case_to_case' END], lambda x: x IS NOT NULL)), '+')"""


def _shown(e: DataFrame) -> DataFrame:
    return e.select("src", "dst", "user", "logon_type", "event_id", "status", F.col("count").alias("n"), F.date_format("first_seen", TIME).alias("first_seen"), F.date_format("last_seen", TIME).alias("last_seen"), F.array_join(F.array_sort("reasons"), "+").alias("reasons"))


@query(f"""SELECT src, dst, "user", logon_type, event_id, status, n, strftime(first_seen, '%Y-%m-%d %H:%M:%S') AS first_seen, strftime(last_seen, '%Y-%m-%d %H:%M:%S') AS last_seen, {_REASONS} AS reasons FROM {_E}""")
def logon_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(_edges(spark, sf_dir))


_RAW_PAIRS = """WITH x AS (SELECT *, 'HOST' || CAST(user_id % 20 AS VARCHAR) AS host, 'user' || CAST(user_id % 9 AS VARCHAR) AS u,
    CASE WHEN event_id % 25 < 15 THEN 'HOST' || CAST(event_id % 25 AS VARCHAR) ELSE '10.1.0.' || CAST(event_id % 25 AS VARCHAR) END AS peer FROM events),
  ok AS (SELECT peer AS src, host AS dst, u, ts, event_id % 25 < 15 AS src_case, true AS dst_case, '4624' AS eid FROM x WHERE event_type NOT IN ('purchase', 'error') AND event_id % 5 <> 1 AND peer <> host
    UNION ALL SELECT host, 'srv' || CAST(event_id % 6 AS VARCHAR), u, ts, true, false, '4648' FROM x WHERE event_type = 'purchase'),
  p AS (SELECT i.src AS x, i.dst AS b, o.dst AS y, i.u AS u, i.ts AS t_in, o.ts AS t_out, o.eid AS oe FROM ok i JOIN ok o ON i.dst = o.src AND i.u = o.u
    AND epoch(date_trunc('second', o.ts)) - epoch(date_trunc('second', i.ts)) BETWEEN 0 AND {w} WHERE i.eid = '4624' AND i.src <> o.dst AND i.dst_case AND o.src_case)"""


@query(_RAW_PAIRS.replace("{w}", "7200") + """ SELECT u, x, b, y, strftime(min(t_out), '%Y-%m-%d %H:%M:%S') AS t_out, strftime(arg_max(t_in, (-epoch_us(t_out), epoch_us(t_in))), '%Y-%m-%d %H:%M:%S') AS t_in FROM p GROUP BY u, x, b, y""")
def pivot_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = logons.pivot_chains(_times(spark, sf_dir), window_s=7200)
    return got.select("u", "x", "b", "y", F.date_format("t_out", TIME).alias("t_out"), F.date_format("t_in", TIME).alias("t_in"))


@query("""WITH i AS (SELECT user_id, ts, event_id FROM events WHERE event_type = 'view'), o AS (SELECT user_id, ts, event_id FROM events WHERE event_type = 'purchase')
SELECT o.event_id, o.user_id, arg_max(i.event_id, (i.ts, i.event_id)) AS before_id FROM o JOIN i ON i.user_id = o.user_id AND i.ts <= o.ts GROUP BY o.event_id, o.user_id""")
def asof_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type")
    got = logons.latest_before(e.where("event_type = 'view'"), e.where("event_type = 'purchase'"), ["user_id"], "ts", "ts", ["event_id"])
    return got.select("event_id", "user_id", F.col("before_event_id").alias("before_id"))


@query("""WITH f AS (SELECT concat('10.9.', CAST(event_id % 11 AS VARCHAR), '.1') AS src, 'HOST' || CAST(user_id % 20 AS VARCHAR) AS dst, 'user' || CAST(user_id % 9 AS VARCHAR) AS u, event_type = 'error' AS bad FROM events WHERE event_type IN ('error', 'click'))
SELECT src, dst, u AS "user", count(*) FILTER (NOT bad) AS n FROM f GROUP BY ALL HAVING count(*) FILTER (bad) >= 5 AND count(*) FILTER (NOT bad) > 0""")
def brute_success(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").where("event_type in ('error', 'click')")
    auth = e.select(F.concat(F.lit("HOST"), (F.col("user_id") % 20).cast("string")).alias("host"), F.when(F.col("event_type") == "error", "ssh_failed").otherwise("ssh_accepted").alias("event"), F.concat(F.lit("user"), (F.col("user_id") % 9).cast("string")).alias("user"), F.concat(F.lit("10.9."), (F.col("event_id") % 11).cast("string"), F.lit(".1")).alias("source"), "ts")
    marked = logons.mark_brute_success(logons.edges(logons.ssh_edges(auth), derive.host_table(spark, sf_dir)))
    return marked.where(F.array_contains("reasons", "brute_success")).select("src", "dst", "user", F.col("count").alias("n"))


_CAT = "CASE WHEN event_id = '4648' THEN 'explicit' WHEN logon_type = 10 THEN 'rdp' WHEN logon_type = 3 THEN 'network' ELSE 'other' END"


@query(f"""SELECT {_CAT} AS category, status, count(*) AS edges, CAST(sum(n) AS BIGINT) AS n FROM {_E} GROUP BY ALL""")
def edge_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _edges(spark, sf_dir).withColumn("category", logons.category(F.col("event_id"), F.col("logon_type")))
    return e.groupBy("category", "status").agg(F.count("*").alias("edges"), F.sum("count").alias("n"))


@query(f"""WITH e AS (SELECT *, status = 'failed' OR event_id = '4648' OR src_case AS signal FROM {_E}), s AS (SELECT * FROM e WHERE signal),
w AS (SELECT n, sum(c) AS weight, bool_or(st <> 'failed') AS ok, bool_or(st <> 'failed' AND eid = '4648') AS must FROM (SELECT src AS n, n AS c, status AS st, event_id AS eid FROM s WHERE NOT src_case UNION ALL SELECT dst, n, status, event_id FROM s WHERE NOT dst_case) GROUP BY n),
k AS (SELECT n FROM w WHERE must UNION (SELECT n FROM w ORDER BY weight DESC, n LIMIT 2) UNION (SELECT n FROM w WHERE NOT ok ORDER BY weight DESC, n LIMIT 3)),
kept AS (SELECT * FROM s WHERE (src_case OR src IN (SELECT n FROM k)) AND (dst_case OR dst IN (SELECT n FROM k))),
nodes AS (SELECT DISTINCT 'HOST' || CAST(user_id % 20 AS VARCHAR) AS id FROM events UNION SELECT src FROM kept UNION SELECT dst FROM kept)
SELECT id, CASE WHEN id LIKE 'HOST%' THEN CASE WHEN CAST(substr(id, 5) AS INT) % 5 = 0 THEN 'linux' ELSE 'case' END WHEN id LIKE '10.%' THEN 'external' ELSE 'server' END AS role FROM nodes""")
def graph_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logons.curate(_edges(spark, sf_dir), derive.host_table(spark, sf_dir), 2, 3)[0]


@query(f"""SELECT strftime(first_seen, '%Y-%m-%d %H:%M:%S') AS when_utc, src AS source, dst AS destination, "user", 'CORP' AS domain,
  CASE WHEN status = 'failed' THEN 'credential access' ELSE 'lateral movement' END AS tactic, 'event' AS kind FROM {_E} WHERE status = 'failed' OR event_id = '4648' OR src_case""")
def incident_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logons.incident_log(_edges(spark, sf_dir)).select("when_utc", "source", "destination", "user", "domain", "tactic", "kind")


@query(f"""WITH l AS (SELECT DISTINCT strftime(first_seen, '%Y-%m-%d %H:%M:%S') AS when_utc, src AS source, dst AS destination, "user" FROM {_E} WHERE status = 'failed' OR event_id = '4648' OR src_case) SELECT * FROM l WHERE source NOT LIKE 'HOST1%'""")
def incident_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = logons.incident_log(_edges(spark, sf_dir))
    return logons.merge_incidents(found.where(F.col("source").startswith("HOST1")), found).select("when_utc", "source", "destination", "user")


@query(f"""SELECT (SELECT count(*) FROM (SELECT src FROM {_E} UNION SELECT dst FROM {_E})) AS hosts, (SELECT count(*) FROM {_E}) AS edges, (SELECT count(*) FROM {_E} WHERE status = 'failed' OR event_id = '4648' OR src_case) AS suspicious,
  (SELECT count(*) FROM ({_RAW_PAIRS.replace('{w}', '3600')} SELECT DISTINCT u, x, b, y FROM p)) AS chains""")
def case_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logons.case_summary(_edges(spark, sf_dir), logons.pivot_chains(_times(spark, sf_dir), window_s=3600))


@query(r"""SELECT 'HOST' || CAST(user_id % 20 AS VARCHAR) AS host, 'CORP\user' || CAST(user_id % 9 AS VARCHAR) AS "user", '10.1.0.' || CAST(event_id % 25 AS VARCHAR) AS src, CASE WHEN event_id % 5 = 0 THEN 10 WHEN event_id % 5 = 1 THEN 2 ELSE 3 END AS logon_type,
  count(*) FILTER (event_type <> 'error') AS ok, count(*) FILTER (event_type = 'error') AS failed, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first_seen, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_seen FROM events WHERE event_type <> 'purchase' GROUP BY ALL""")
def logon_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = logons.logon_summary(derive.security_events(spark, sf_dir))
    return got.withColumns({c: F.date_format(c, TIME) for c in ("first_seen", "last_seen")})


def _auth_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Syslog lines of events, in two files that overlap."""
    e = table(spark, sf_dir, "events")
    user, peer = F.concat(F.lit("u"), (F.col("user_id") % 9).cast("string")), F.concat(F.lit("10.9.0."), (F.col("user_id") % 30).cast("string"))
    said = {
        "error": F.concat(F.lit("sshd[1]: Failed password for "), user, F.lit(" from "), peer, F.lit(" port 22 ssh2")), "click": F.concat(F.lit("sshd[1]: Accepted publickey for "), user, F.lit(" from "), peer, F.lit(" port 22 ssh2")),
        "view": F.concat(F.lit("cron[2]: session opened for user "), user), "signup": F.concat(F.lit("useradd[3]: new user: name="), user, F.lit(", UID=1")), "purchase": F.concat(F.lit("sudo: "), user, F.lit(" : TTY=pts/0 ; PWD=/ ; USER=root ; COMMAND=/bin/x")),
    }
    msg = F.coalesce(*(F.when(F.col("event_type") == k, v) for k, v in said.items()))
    line = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit(" box "), msg)
    one = e.select(F.lit("box").alias("host"), F.lit("/var/log/auth.log").alias("path"), F.col("event_id").alias("line_no"), line.alias("line"))
    return one.union(one.where("line_no % 3 = 0").withColumn("path", F.lit("/var/log/auth.log.1"))).union(one.where("line_no % 5 = 0").withColumn("path", F.lit("/var/log/messages")))


@query("""SELECT DISTINCT strftime(ts, '%Y-%m-%dT%H:%M:%S') AS timestamp, 'box' AS host, CASE event_type WHEN 'error' THEN 'ssh_failed' WHEN 'click' THEN 'ssh_accepted' WHEN 'signup' THEN 'user_add' ELSE 'sudo' END AS event, 'u' || CAST(user_id % 9 AS VARCHAR) AS "user",
  CASE WHEN event_type IN ('error', 'click') THEN '10.9.0.' || CAST(user_id % 30 AS VARCHAR) ELSE '' END AS source, CASE event_type WHEN 'error' THEN 'port 22' WHEN 'click' THEN 'publickey port 22' WHEN 'purchase' THEN '/bin/x' ELSE '' END AS detail FROM events WHERE event_type <> 'view'""")
def auth_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.auth_events(logs.first_family(_auth_lines(spark, sf_dir)))


@query("""SELECT strftime(ts, '%Y-%m-%dT%H:%M:%S') AS timestamp, 'box' AS host, CASE event_type WHEN 'view' THEN 'cron' WHEN 'signup' THEN 'useradd' WHEN 'purchase' THEN 'sudo' ELSE 'sshd' END AS proc FROM events""")
def syslog_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logs.syslog(_auth_lines(spark, sf_dir).where("path = '/var/log/auth.log'")).select("timestamp", "host", "proc")


@query("""WITH x AS (SELECT *, 'serial' || CAST(event_id AS VARCHAR) AS s FROM events)
SELECT event_id, t AS type, '/bin/p' || CAST(event_id % 7 AS VARCHAR) AS image, 'nc -e x' || CAST(event_id % 5 AS VARCHAR) AS command, CAST(user_id AS VARCHAR) AS uid FROM x, (SELECT unnest(['SYSCALL', 'EXECVE']) AS t)""")
def auditd_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    head = lambda kind: F.concat(F.lit(f"type={kind} msg=audit(1700000000.1:"), F.col("event_id").cast("string"), F.lit("): "))
    one = F.concat(head("SYSCALL"), F.lit('syscall=59 uid='), F.col("user_id").cast("string"), F.lit(' exe="/bin/p'), (F.col("event_id") % 7).cast("string"), F.lit('"'))
    two = F.concat(head("EXECVE"), F.lit('argc=3 a0="nc" a1=2D65 a2="x'), (F.col("event_id") % 5).cast("string"), F.lit('"'))
    lines = e.select(F.lit("h").alias("host"), F.lit("/var/log/audit/audit.log").alias("path"), F.col("event_id").alias("line_no"), F.explode(F.array(one, two)).alias("line"))
    got = logs.auditd(lines)
    return got.select(F.col("serial").cast("long").alias("event_id"), "type", F.col("Image").alias("image"), F.col("CommandLine").alias("command"), F.col("User").alias("uid"))


@query("""WITH v AS (SELECT o_orderkey, o_custkey, o_orderstatus, 'C' AS v, 0 AS o FROM orders WHERE o_orderkey % 3 <> 0 UNION ALL SELECT o_orderkey, o_custkey, o_orderstatus, 'VSS1', 1 FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT o_orderkey, o_custkey, o_orderstatus, 'VSS10', 10 FROM orders WHERE o_orderkey % 5 = 0)
SELECT o_orderkey, o_custkey, o_orderstatus, string_agg(DISTINCT v, ',' ORDER BY v) AS volumes FROM v GROUP BY ALL""")
def snapshot_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    return merge.merge_snapshots({"C": o.where("o_orderkey % 3 <> 0"), "VSS1": o.where("o_orderkey % 2 = 0").withColumnRenamed("o_orderstatus", "O_OrderStatus"), "VSS10": o.where("o_orderkey % 5 = 0")})


@query("""WITH m AS (SELECT o_orderpriority AS artifact, list_filter([CASE WHEN o_orderkey % 3 <> 0 THEN 'C' END, CASE WHEN o_orderkey % 2 = 0 THEN 'VSS1' END], lambda x: x IS NOT NULL) AS v FROM orders WHERE o_orderkey % 3 <> 0 OR o_orderkey % 2 = 0),
u AS (SELECT artifact, len(v) AS k, unnest(v) AS volume FROM m)
SELECT volume, count(*) AS rows, count(DISTINCT artifact) AS artifacts, count(*) FILTER (k = 1) AS only_here FROM u GROUP BY volume""")
def volume_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderpriority").alias("artifact"))
    merged = merge.merge_snapshots({"C": o.where("o_orderkey % 3 <> 0"), "VSS1": o.where("o_orderkey % 2 = 0")})
    return merge.volume_contribution(merged).drop("shared_pct")


@query("""WITH a AS (SELECT p_partkey AS rel_path, md5(p_name) AS d FROM part WHERE p_partkey % 4 <> 0), b AS (SELECT p_partkey AS rel_path, md5(p_name || CASE WHEN p_partkey % 10 = 1 THEN 'x' ELSE '' END) AS d FROM part WHERE p_partkey % 6 <> 0)
SELECT coalesce(a.rel_path, b.rel_path) AS rel_path, CASE WHEN a.rel_path IS NULL THEN 'added' WHEN b.rel_path IS NULL THEN 'removed' ELSE 'changed' END AS change FROM a FULL JOIN b ON a.rel_path = b.rel_path WHERE a.d IS DISTINCT FROM b.d""")
def manifest_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    a = p.where("p_partkey % 4 <> 0").select(F.col("p_partkey").alias("rel_path"), F.md5("p_name").alias("sha256"))
    b = p.where("p_partkey % 6 <> 0").select(F.col("p_partkey").alias("rel_path"), F.md5(F.concat("p_name", F.when(F.col("p_partkey") % 10 == 1, "x").otherwise(""))).alias("sha256"))
    return merge.changes(a, b)


@query("""SELECT c_mktsegment AS host, count(*) FILTER (k = 0) AS ok, count(*) FILTER (k = 1) AS skipped, count(*) FILTER (k = 2) AS error, CAST(sum(c_custkey) AS BIGINT) AS seconds, arg_max(c_name, c_custkey) AS slowest FROM (SELECT *, c_custkey % 3 AS k FROM customer) GROUP BY 1""")
def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("host"), F.col("c_name").alias("job"), F.expr("CASE c_custkey % 3 WHEN 0 THEN 'ok' WHEN 1 THEN 'skipped' ELSE 'error' END").alias("status"), F.col("c_custkey").alias("seconds"))
    return merge.run_summary(c).drop("failed")


@query(f"""WITH i AS (SELECT DISTINCT {derive.IP} AS ip FROM events) SELECT ip, CASE WHEN ip LIKE '10.%' THEN 'private' ELSE 'public' END AS scope, ip NOT LIKE '10.%' AS routable FROM i""")
def address_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = table(spark, sf_dir, "events").select(F.expr(derive.IP).alias("ip")).distinct()
    return i.select("ip", net.ip_scope(F.col("ip")).alias("scope"), net.is_public_ip(F.col("ip")).alias("routable"))


@query("""SELECT conv_id, turn, CAST(row_number() OVER (PARTITION BY role, conv_id % 5 ORDER BY conv_id, turn) AS INT) AS seq FROM conversations WHERE text IS NOT NULL AND trim(text) <> '' AND NOT text LIKE '#%'""")
def shell_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    seq = logs.shell_history(c.select(F.col("role").alias("host"), (F.col("conv_id") % 5).cast("string").alias("user"), F.lit("bash").alias("shell"), F.col("conv_id").alias("file_rank"), F.col("turn").alias("line_no"), F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("t"), F.col("turn").cast("string")).alias("line")))
    return seq.select(F.regexp_extract("command", r"c(\d+)t", 1).cast("long").alias("conv_id"), F.regexp_extract("command", r"t(\d+)$", 1).cast("long").alias("turn"), "seq")


@query(f"""WITH r AS (SELECT {derive.IP} AS ip, {derive.STATUS} AS status, ts FROM events), w AS (SELECT date_trunc('hour', ts) AS s, ip, count(*) AS requests, count(*) FILTER (status IN ('401', '403')) AS failed, count(*) FILTER (status = '404') AS missing FROM r GROUP BY ALL)
SELECT strftime(s, '%Y-%m-%d %H:%M:%S') AS start, ip, requests, failed, missing FROM w WHERE s + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE""")
def stream_web_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..streaming import streams

    e = streams.table_stream(spark, sf_dir, "events").select(F.expr(derive.IP).alias("ip"), F.expr(derive.STATUS).alias("status"), F.col("ts").cast("timestamp").alias("ts"))
    return streams.drain(streams.web_windows(e)).select(F.date_format("start", TIME).alias("start"), "ip", "requests", "failed", "missing")


_STEPS = 10
_STEP = f"CAST(floor((epoch(ts) - (SELECT epoch(min(ts)) FROM events)) * {_STEPS} / ((SELECT epoch(max(ts)) - epoch(min(ts)) FROM events) + 1)) AS INT)"


def _in_steps(spark: SparkSession, sf_dir: str, kinds: list[str] | None = None) -> DataFrame:
    """Events as a stream of ten batches in order of time."""
    from ..streaming import streams

    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    ends = e.agg(F.unix_micros(F.min("ts")).alias("a"), F.unix_micros(F.max("ts")).alias("b")).first()
    step = F.floor((F.unix_micros("ts") - ends.a) / 1e6 * _STEPS / ((ends.b - ends.a) / 1e6 + 1)).cast("int")
    e = e.withColumn("step", step)
    return streams.stream_in_steps(e.where(F.col("event_type").isin(kinds)) if kinds else e, "step", _STEPS)


# what is known of a key goes at the end of the first batch whose watermark, the latest time of the batches before it less a
# day, is a day behind it
@query(f"""WITH RECURSIVE e AS (SELECT user_id, event_type, ts, {_STEP} AS step FROM events), m AS (SELECT s.step, (SELECT max(ts) FROM e WHERE e.step < s.step) AS seen FROM (SELECT DISTINCT step FROM e) s),
k AS (SELECT user_id, event_type, min(ts) AS ts FROM e GROUP BY ALL
  UNION ALL SELECT k.user_id, k.event_type, (SELECT min(e.ts) FROM e WHERE e.user_id = k.user_id AND e.event_type = k.event_type AND e.ts > k.ts
    AND e.step > (SELECT min(m.step) FROM m WHERE m.seen - INTERVAL 1 DAY >= k.ts + INTERVAL 1 DAY)) FROM k WHERE k.ts IS NOT NULL)
SELECT user_id, event_type, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts FROM k WHERE ts IS NOT NULL""")
def stream_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each user the first event of a kind, and again once that is forgotten."""
    from ..streaming import streams

    got = streams.dedupe(_in_steps(spark, sf_dir).select("user_id", "event_type", "ts"), ["user_id", "event_type"], within="1 day")
    return streams.drain(got).select("user_id", "event_type", F.date_format("ts", TIME).alias("ts"))


@query("""WITH a AS (SELECT 'x' || CAST(event_id % 25 AS VARCHAR) AS x, user_id % 20 AS b, user_id AS "user", ts FROM events WHERE event_type = 'view'), d AS (SELECT user_id % 20 AS b, 'x' || CAST(event_id % 6 AS VARCHAR) AS y, user_id AS "user", ts FROM events WHERE event_type = 'purchase')
SELECT a."user", a.x, a.b, d.y, strftime(a.ts, '%Y-%m-%d %H:%M:%S') AS t_in, strftime(d.ts, '%Y-%m-%d %H:%M:%S') AS t_out FROM a JOIN d ON a.b = d.b AND a."user" = d."user" AND a.x <> d.y AND d.ts >= a.ts AND d.ts <= a.ts + INTERVAL 12 HOUR""")
def stream_pivot_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..streaming import streams

    e = lambda kind: streams.table_stream(spark, sf_dir, "events").where(F.col("event_type") == kind)
    name = lambda k: F.concat(F.lit("x"), (F.col("event_id") % k).cast("string"))
    a = e("view").select(name(25).alias("x"), (F.col("user_id") % 20).alias("b"), F.col("user_id").alias("user"), F.col("ts").cast("timestamp").alias("t_in"))
    d = e("purchase").select((F.col("user_id") % 20).alias("b"), name(6).alias("y"), F.col("user_id").alias("user"), F.col("ts").cast("timestamp").alias("t_out"))
    got = streams.drain(streams.pivot_alerts(a, d))
    return got.select("user", "x", "b", "y", F.date_format("t_in", TIME).alias("t_in"), F.date_format("t_out", TIME).alias("t_out"))


# a key's failures are forgotten in a batch without rows of it whose watermark, the latest time of the batches before it less
# ten minutes, is over a day past its last row
@query(f"""WITH x AS (SELECT CAST(user_id AS VARCHAR) AS "user", ts, event_type = 'click' AS ok, {_STEP} AS step FROM events WHERE event_type IN ('click', 'error')), m AS (SELECT step, max(ts) AS seen FROM x GROUP BY step),
b AS (SELECT "user", step, max(ts) AS last, lag(step) OVER w AS before, lag(max(ts)) OVER w AS seen FROM x GROUP BY "user", step WINDOW w AS (PARTITION BY "user" ORDER BY step)),
i AS (SELECT b."user", b.step, sum(CASE WHEN b.step - b.before >= 2 AND m.seen - INTERVAL 10 MINUTE > b.seen + INTERVAL 1 DAY THEN 1 ELSE 0 END) OVER (PARTITION BY b."user" ORDER BY b.step) AS island FROM b LEFT JOIN m ON m.step = b.step - 2),
y AS (SELECT x.*, i.island FROM x JOIN i ON i."user" = x."user" AND i.step = x.step),
f AS (SELECT y."user", y.ok, (SELECT count(*) FROM y z WHERE z."user" = y."user" AND z.island = y.island AND NOT z.ok AND z.ts <= y.ts) AS failures FROM y)
SELECT "user", count(*) AS n, CAST(sum(failures) AS BIGINT) AS failures FROM f WHERE ok AND failures >= 2 GROUP BY "user" """)
def stream_brute_force(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..streaming import streams

    e = _in_steps(spark, sf_dir, ["click", "error"]).select(F.lit("s").alias("src"), F.lit("d").alias("dst"), F.col("user_id").cast("string").alias("user"), "ts", (F.col("event_type") == "click").alias("ok"))
    got = streams.drain(streams.brute_force_alerts(e, least=2, forget="1 day"))
    return got.groupBy("user").agg(F.count("*").alias("n"), F.sum("failures").alias("failures"))


def _processes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Process snapshots: a process for each event, its parent the event of half its number."""
    e = table(spark, sf_dir, "events")
    names = ("winword.exe", "cmd.exe", "svchost.exe", "tool.exe", "powershell.exe", "notepad.exe", "chrome.exe")
    exe = F.expr(r"CASE WHEN event_id % 5 = 0 THEN 'C:\\Users\\Public\\a.exe' WHEN event_id % 5 = 1 THEN 'C:\\Windows\\System32\\b.exe' ELSE 'C:\\Tools\\c.exe' END")
    return e.select(F.lit("pc").alias("host"), F.col("event_id").alias("Pid"), F.expr("event_id div 2").alias("Ppid"), derive.pick(names, "event_id % 7").alias("Name"), exe.alias("Exe"), F.when(F.col("event_id") % 11 == 0, "powershell -enc AAAA").otherwise("run").alias("CommandLine"))


_NAMES = "(['winword.exe', 'cmd.exe', 'svchost.exe', 'tool.exe', 'powershell.exe', 'notepad.exe', 'chrome.exe'])"


@query("""SELECT event_id AS "Pid", concat_ws('+', CASE WHEN event_id % 5 = 0 THEN 'exec_from_staging' END, CASE WHEN event_id % 11 = 0 THEN 'lolbin' END, CASE WHEN event_id % 7 = 2 AND event_id % 5 <> 1 THEN 'masquerade' END) AS flags FROM events""")
def process_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import live

    return live.annotate("Windows.System.Pslist", _processes(spark, sf_dir)).select("Pid", F.array_join("flags", "+").alias("flags"))


@query(f"""WITH RECURSIVE p AS (SELECT event_id AS pid, event_id // 2 AS up, {_NAMES}[CAST(event_id % 7 AS BIGINT) + 1] || '(' || CAST(event_id AS VARCHAR) || ')' AS l FROM events),
a AS (SELECT pid, up, l AS path, 1 AS d, [pid] AS seen FROM p UNION ALL SELECT a.pid, p.up, p.l || '>' || a.path, d + 1, list_append(seen, p.pid) FROM a JOIN p ON p.pid = a.up WHERE d < 8 AND NOT list_contains(seen, p.pid))
SELECT pid AS "Pid", arg_max(path, d) AS ancestry FROM a GROUP BY pid""")
def process_ancestry(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import live

    return live.ancestry(_processes(spark, sf_dir)).select("Pid", F.array_join("ancestry", ">").alias("ancestry"))


@query(f"""WITH p AS (SELECT event_id AS pid, event_id // 2 AS up, {_NAMES}[CAST(event_id % 7 AS BIGINT) + 1] AS name, event_id % 5 = 0 AS staged, event_id % 11 = 0 AS lol FROM events),
x AS (SELECT c.pid, c.staged, c.lol, c.name = 'svchost.exe' AND c.pid % 5 <> 1 AS masq, coalesce(u.name IN ('winword.exe', 'chrome.exe') AND c.name IN ('cmd.exe', 'powershell.exe'), false) AS kin, c.pid % 3 = 0 AS beacons, c.pid % 4 = 0 AS listens FROM p c LEFT JOIN p u ON u.pid = c.up)
SELECT pid AS "Pid", concat_ws('+', CASE WHEN staged THEN 'exec_from_staging' END, CASE WHEN lol THEN 'lolbin' END, CASE WHEN masq THEN 'masquerade' END, CASE WHEN (staged OR lol) AND beacons THEN 'staged_beacon' END, CASE WHEN staged AND listens THEN 'staged_listener' END, CASE WHEN kin THEN 'suspicious_ancestry' END) AS flags
FROM x WHERE staged OR lol OR masq OR kin""")
def process_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import live

    p = live.annotate("Windows.System.Pslist", _processes(spark, sf_dir))
    none = F.array().cast("array<string>")
    net_ = p.where("Pid % 3 = 0").select("host", "Pid", "Name", F.lit("ESTAB").alias("Status"), F.lit("93.184.216.34").alias("Raddr.IP"), F.lit(443).alias("Raddr.Port"), none.alias("flags"))
    ears = p.where("Pid % 4 = 0").select("host", "Pid", "Name", F.lit(80).alias("Port"), none.alias("flags"))
    services = p.where("Pid % 50 = 0").select("host", "Pid", "Name", F.col("Name").alias("DisplayName"), F.lit(None).cast("string").alias("AbsoluteExePath"), F.lit("").alias("PathName"))
    tasks = p.where("Pid % 60 = 0").select("host", F.col("Exe").alias("Command"), F.col("Name").alias("TaskName"), "Name")
    return live.correlate(p, net_, ears, services, tasks).select("Pid", F.array_join("flags", "+").alias("flags"))


@query("""SELECT p_partkey, 'd' || CAST(p_partkey % 3 AS VARCHAR) AS driver FROM part WHERE p_partkey % 50 = 0""")
def driver_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import live

    p = table(spark, sf_dir, "part")
    files = p.select("p_partkey", F.concat(F.lit("0000"), F.sha1(F.col("p_partkey").cast("string"))).alias("SHA1"))
    known = p.where("p_partkey % 50 = 0").select(F.upper(F.sha1(F.col("p_partkey").cast("string"))).alias("sha1"), F.concat(F.lit("d"), (F.col("p_partkey") % 3).cast("string")).alias("driver"))
    return live.vulnerable_drivers(files, known).select("p_partkey", "driver")


from . import hosts, large, mechanisms, more, orders  # noqa: E402, F401  register their queries
