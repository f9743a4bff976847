"""Normalisers: tables of log lines to typed rows. Each takes (host, path, line_no, line), as the line source gives it,
and keeps the identifying columns; lines that aren't of the kind are left out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.plan import computed_once, running_count
from ..functions.strings import MONTHS, epoch_time, hex_or_same, let

SYSLOG = r"^(\d{4}-\d\d-\d\dT[\d:.+\-]+|[A-Z][a-z]{2}\s+\d+\s+\d\d:\d\d:\d\d)\s+(\S+)\s+([\w\-/.]+?)(?:\[(\d+)\])?:\s+(.*)$"
STAGING = ("/tmp/", "/var/tmp/", "/dev/shm/")
#: Names of packages made for attacking.
OFFENSIVE = (
    r"(?i)(?<![a-z0-9])(nmap|masscan|zmap|rustscan|netcat|ncat|socat|hydra|medusa|john|hashcat|hping3?|ettercap|bettercap|responder|proxychains(?:-ng)?|torsocks|tor|"
    r"chisel|frpc?|frps|sshuttle|sliver|nikto|sqlmap|gobuster|dirbuster|ffuf|wfuzz|crackmapexec|impacket|metasploit|nuclei|enum4linux|smbmap|"
    r"evil-winrm|kerbrute|mimipenguin|linpeas|pspy|aircrack-?ng)(?![a-z])"
)
#: x86-64 system calls that rules name.
SYSCALLS = {
    "0": "read", "1": "write", "2": "open", "41": "socket", "42": "connect", "43": "accept", "49": "bind", "56": "clone", "57": "fork", "58": "vfork",
    "59": "execve", "62": "kill", "82": "rename", "84": "rmdir", "86": "link", "87": "unlink", "90": "chmod", "92": "chown", "101": "ptrace", "105": "setuid",
    "106": "setgid", "155": "pivot_root", "165": "mount", "166": "umount2", "175": "init_module", "176": "delete_module", "200": "tkill",
    "279": "memfd_create", "319": "memfd_create", "322": "execveat",
}
#: Ways to a shell, in the order in which the first that fits names a command (binary, function, pattern).
_SH = r"(?:/(?:usr/)?bin/)?(?:ba|z|k|a|da)?sh"
TECHNIQUES = (
    ("bash", "reverse-shell", r"/dev/(?:tcp|udp)/"),
    ("nc", "reverse-shell", r"\b(?:nc|ncat|netcat)\b.*(?:\s-(?:e|c)\s|--exec\b|--sh-exec\b)"),
    ("socat", "reverse-shell", r"\bsocat\b.*\b(?:exec|system)\s*:"),
    ("mkfifo", "reverse-shell", r"\bmkfifo\b.*\b(?:nc|ncat|" + _SH + r"\s+-i)\b"),
    ("find", "shell", r"\bfind\b.*\s-exec(?:dir)?\s+" + _SH + r"\b"),
    ("vim", "shell", r"\b(?:r?vim|vi|view|nvim|vimdiff)\b.*\s(?:-c|--cmd)\s+['\"]?:?(?:!|py\b|python|lua\b|luado|shell\b|call\s+system|perl\b|rubydo)"),
    ("awk", "shell", r"\b[gmn]?awk\b.*BEGIN\s*\{\s*system\s*\("),
    ("python", "shell", r"\bpython[0-9.]*\b.*\bpty\.spawn\s*\("),
    ("python", "shell", r"\bpython[0-9.]*\b\s+-c\b.*(?:os\.system|subprocess\.\w+)\s*\(.*(?:" + _SH + r")\b"),
    ("perl", "shell", r"\bperl[0-9.]*\b.*-e\b.*\b(?:exec|system)\b.*['\"][^'\"]*" + _SH + r"\b"),
    ("ruby", "shell", r"\bruby\b.*-e\b.*\b(?:exec|system|spawn)\b.*['\"][^'\"]*" + _SH + r"\b"),
    ("php", "shell", r"\bphp\b.*-r\b.*\b(?:system|exec|passthru|shell_exec|popen|proc_open)\s*\(.*" + _SH + r"\b"),
    ("lua", "shell", r"\blua[0-9.]*\b.*-e\b.*os\.execute\s*\("),
    ("node", "shell", r"\bnode\b.*-e\b.*child_process.*\b(?:exec|spawn)\b"),
    ("env", "shell", r"\benv\b(?:\s+-\S+)*\s+" + _SH + r"\b(?:\s|$)"),
    ("nmap", "shell", r"\bnmap\b.*--interactive\b"),
    ("tar", "shell", r"\btar\b.*(?:--checkpoint-action\s*=?\s*exec|--to-command)"),
    ("zip", "shell", r"\bzip\b.*(?:--(?:unzip|test)-command|\s-TT\b)"),
    ("gdb", "shell", r"\bgdb\b.*-ex\b.*\b(?:call\s+.*system|python|shell)\b"),
    ("expect", "shell", r"\bexpect\b.*-c\b.*spawn\s+.*" + _SH + r"\b"),
    ("docker", "privesc", r"\bdocker\b\s+run\b.*(?:--privileged\b|-v\s*/:(?:/|\s))"),
    ("pkexec", "privesc", r"\bpkexec\b\s+" + _SH + r"\b"),
    ("chmod", "suid", r"\bchmod\b\s+(?:u?\+s\b|[0-7]*[46][0-7]{3}\b).*(?:/bin/|/usr/bin/|/tmp/|/dev/shm/|/var/tmp/|\bbash\b|\bsh\b|\bdash\b|\bpython|\bperl\b|\bfind\b)"),
)
#: What PowerShell commands give away, the first that fits counting.
POWERSHELL = (
    ("download_cradle", r"downloadstring\s*\(|downloadfile\s*\(|\|\s*iex\b|iex\s*\(\s*(?:irm|iwr|invoke-restmethod|invoke-webrequest)\b"),
    ("encoded_command", r"-enc(?:odedcommand)?\s+[A-Za-z0-9+/=]{16,}"),
    ("base64_decode", r"frombase64string\s*\("),
    ("defender_tamper", r"\b(?:set|add)-mppreference\b"),
    ("lolbin_download", r"\bcertutil\b.*-urlcache|\bbitsadmin\b.*[/-]transfer"),
    ("credential_access", r"mimikatz|\brubeus\b|\bsharphound\b|\bseatbelt\b|\blazagne\b|comsvcs(?:\.dll)?\W+(?:#\s*)?24|procdump.{0,40}lsass|rundll32.{0,40}comsvcs"),
)


def _part(pattern: str, i: int, of: str | Column = "line") -> Column:
    return F.regexp_extract(of, pattern, i)


def _first_match(text: Column, rules: tuple[tuple, ...], make: object) -> Column:
    """The value that ``make`` gives for the first of the rules whose last element matches."""
    return F.coalesce(*(F.when(text.rlike("(?i)" + r[-1]), make(r)) for r in rules))


def _keep(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in ("line", "line_no")]


def syslog(lines: DataFrame) -> DataFrame:
    """timestamp, host, proc and message; what isn't a syslog line has its message only. The host is the line's."""
    keep = [c for c in _keep(lines) if c != "host"]
    return lines.select(*keep, F.col("line").alias("message"), _part(SYSLOG, 1).alias("timestamp"), _part(SYSLOG, 2).alias("host"), _part(SYSLOG, 3).alias("proc"))


def first_family(lines: DataFrame, families: tuple[str, ...] = ("auth.log", "secure", "messages")) -> DataFrame:
    """Of each host, lines of the first family of log files that it has; dated archives are dropped."""
    name = F.substring_index("path", "/", -1)
    rank = F.coalesce(*(F.when(name.startswith(f), i) for i, f in enumerate(families)))
    ranked = lines.withColumn("__rank", rank).where(F.col("__rank").isNotNull() & ~name.rlike(r"-\d{8}"))
    best = ranked.groupBy("host").agg(F.min("__rank").alias("__best"))
    # a row for each host: sent to all tasks, as lines of one host would else come together in one
    return ranked.join(F.broadcast(best), "host").where("__rank = __best").drop("__rank", "__best")


def auth_events(lines: DataFrame) -> DataFrame:
    """Logons, sudo, su and new accounts: timestamp, host, event, user, source, detail. Repeats that overlapping rotations
    leave are dropped, exactly and however far apart."""
    fields = {n: _part(SYSLOG, i) for n, i in (("timestamp", 1), ("host", 2), ("proc", 3), ("msg", 5))}
    p = computed_once(lines.where(F.col("line").rlike(SYSLOG)).select("line"), fields)
    ok = r"Accepted (\S+) for (?:invalid user )?(\S+) from (\S+) port (\d+)"
    bad = r"Failed (?:password|publickey) for (?:invalid user )?(\S+) from (\S+) port (\d+)"
    invalid, sudo = r"Invalid user (\S+) from (\S+)", r"^(\S+)\s+:.*COMMAND=(.*)$"
    su, useradd, groupadd = r"(?:session opened for user|FAILED su for|to) (\S+)", r"new user: name=(\S+?),", r"new group: name=(\S+?),"
    m = F.col("msg")
    row = lambda e, u, s, d: F.struct(F.lit(e).alias("event") if isinstance(e, str) else e.alias("event"), u.alias("user"), s.alias("source"), d.alias("detail"))
    g = lambda rx, i: F.regexp_extract(m, rx, i)
    none = F.lit("")
    found = F.coalesce(
        F.when((F.col("proc") == "sshd") & m.rlike(ok), row("ssh_accepted", g(ok, 2), g(ok, 3), F.concat(g(ok, 1), F.lit(" port "), g(ok, 4)))),
        F.when((F.col("proc") == "sshd") & m.rlike(bad), row("ssh_failed", g(bad, 1), g(bad, 2), F.concat(F.lit("port "), g(bad, 3)))),
        F.when((F.col("proc") == "sshd") & m.rlike(invalid), row("ssh_invalid_user", g(invalid, 1), g(invalid, 2), none)),
        F.when((F.col("proc") == "sudo") & m.rlike(sudo), row("sudo", g(sudo, 1), none, F.trim(g(sudo, 2)))),
        F.when((F.col("proc") == "su") & m.rlike(su), row(F.when(m.contains("FAILED"), "su_failed").otherwise("su"), F.substring_index(g(su, 1), "(", 1), none, none)),
        F.when((F.col("proc") == "useradd") & m.rlike(useradd), row("user_add", g(useradd, 1), none, none)),
        F.when((F.col("proc") == "groupadd") & m.rlike(groupadd), row("group_add", g(groupadd, 1), none, none)),
    )
    return computed_once(p, {"f": found}).where("f is not null").select("timestamp", "host", "f.*").dropDuplicates()


def _pairs(text: Column, pattern: str) -> Column:
    """Map of ``key=value`` pairs, the last of equal keys winning; quotes are taken off."""
    entry = lambda x: F.struct(F.substring_index(x, "=", 1).alias("k"), F.regexp_replace(F.regexp_replace(x, r"(?s)^\w+=", ""), r"(?s)^([\"'])(.*)\1$", "$2").alias("v"))
    entries = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), entry)
    last = lambda e: F.filter(e, lambda x, i: ~F.exists(F.slice(e, i + 2, F.size(e)), lambda y: y["k"] == x["k"]))
    return F.map_from_entries(let(entries, last))


def auditd(lines: DataFrame) -> DataFrame:
    """A row for each audit record, with what the records of its serial in the same file tell: Image, CommandLine,
    CurrentDirectory, User. Other fields are in the map ``kv``; system call numbers are names there, under SYSCALL."""
    pattern = r"^type=(\S+)\s+msg=audit\(([\d.]+):(\d+)\):\s*(.*)$"
    kv = _pairs(_part(pattern, 4), r"""\w+=(?:"[^"]*"|'[^']*'|\S+)""")
    rec = lines.where(F.col("line").rlike(pattern)).select(*_keep(lines), "line")
    rec = computed_once(rec, {"type": _part(pattern, 1), "timestamp": _part(pattern, 2), "serial": _part(pattern, 3), "kv": kv}).withColumnRenamed("line", "message")
    get = lambda k: F.try_element_at("kv", F.lit(k))
    argc = F.coalesce(get("argc").try_cast("int"), F.lit(0))
    args = F.array_compact(F.transform(F.sequence(F.lit(0), F.greatest(argc, F.lit(1)) - 1), lambda i: F.try_element_at("kv", F.concat(F.lit("a"), i.cast("string")))))
    command = F.when(argc > 0, F.array_join(F.transform(args, hex_or_same), " ")).otherwise("")
    by = Window.partitionBy("path", "serial")
    of = lambda kind, value: F.coalesce(F.max(F.when(F.col("type") == kind, value)).over(by), F.lit(""))
    names = F.create_map(*(F.lit(x) for pair in SYSCALLS.items() for x in pair))
    rows = rec.withColumns(
        {
            "Image": F.coalesce(get("Image"), of("SYSCALL", get("exe"))),
            "CommandLine": of("EXECVE", command),
            "CurrentDirectory": of("CWD", get("cwd")),
            "User": F.coalesce(get("User"), of("SYSCALL", F.coalesce(get("uid"), get("auid")))),
            "SYSCALL": F.when(F.col("type") == "SYSCALL", F.coalesce(F.try_element_at(names, get("syscall")), get("syscall"))),
        }
    )
    return rows.withColumn("message", F.when(F.col("CommandLine") != "", F.concat_ws(" ", "message", "CommandLine")).otherwise(F.col("message")))


def bodyfile(lines: DataFrame) -> DataFrame:
    """File timeline: name, inode, mode, uid, gid, size and four times. The name may hold pipes."""
    field = r"\|([^|]*)"
    pattern = r"^(?:[^|]*\|)?(.*?)" + field * 9 + "$"
    at = lambda i: F.when(_part(pattern, i).try_cast("long") > 0, F.timestamp_seconds(_part(pattern, i).try_cast("long")))
    whole = r"^(.*)" + field * 9 + "$"
    head = _part(whole, 1)
    name = F.when(head.contains("|"), F.regexp_extract(head, r"^[^|]*\|(.*)$", 1)).otherwise(head)
    names = ("inode", "mode", "uid", "gid", "size")
    return lines.where(F.col("line").rlike(whole)).select(*_keep(lines), name.alias("name"), *(_part(whole, i + 2).alias(n) for i, n in enumerate(names)), *(at(i + 7).alias(n) for i, n in enumerate(("atime_utc", "mtime_utc", "ctime_utc", "crtime_utc"))))


def cron_log(lines: DataFrame) -> DataFrame:
    """What cron ran and how crontabs changed: timestamp, kind, user, command, suspicious (run from a staging folder)."""
    line = r"^([A-Z][a-z]{2}\s+\d+\s+\d{2}:\d{2}:\d{2}|\S+T\S+)\s+\S+\s+([\w./-]+)(?:\[\d+\])?:\s+(.*)$"
    p = lines.where(F.col("line").rlike(line)).select(*_keep(lines), _part(line, 1).alias("timestamp"), F.lower(_part(line, 2)).alias("tag"), _part(line, 3).alias("msg"))
    cmd, tab, reload = r"^\((\S+)\) CMD \((.*)\)\s*$", r"^\((\S+)\) (?:BEGIN )?(EDIT|REPLACE|DELETE|LIST) \((\S+)\)\s*$", r"^\((\S+)\) RELOAD \((.*)\)\s*$"
    m, is_tab = F.col("msg"), F.col("tag").contains("crontab")
    g = lambda rx, i: F.regexp_extract(m, rx, i)
    row = lambda kind, user, what: F.struct(kind.alias("kind"), user.alias("user"), what.alias("command"))
    is_cron = ~is_tab & F.col("tag").contains("cron")
    found = F.coalesce(
        F.when(is_tab & m.rlike(tab), row(F.concat(F.lit("crontab_"), F.lower(g(tab, 2))), g(tab, 1), g(tab, 3))),
        F.when(is_cron & m.rlike(cmd), row(F.lit("exec"), g(cmd, 1), F.trim(g(cmd, 2)))),
        F.when(is_cron & m.rlike(reload), row(F.lit("reload"), g(reload, 1), g(reload, 2))),
    )
    staged = F.col("command").rlike(r"^\s*(/tmp/|/var/tmp/|/dev/shm/)")
    return p.withColumn("f", found).where("f is not null").select(*_keep(lines), "timestamp", "f.*").withColumn("suspicious", (F.col("kind") == "exec") & staged)


def sudo_log(lines: DataFrame) -> DataFrame:
    """sudo's own log: time_local, user, runas, tty, pwd, status, command, suspicious."""
    line = r"^([A-Z][a-z]{2})\s+(\d+)\s+(\d{2}:\d{2}:\d{2})\s+(\d{4}) : (\S+) : (.*)$"
    month = F.coalesce(F.try_element_at(F.create_map(*(x for i, n in enumerate(MONTHS) for x in (F.lit(n), F.lit(f"{i + 1:02d}")))), _part(line, 1)), F.lit("00"))
    time = F.concat(_part(line, 4), F.lit("-"), month, F.lit("-"), F.lpad(_part(line, 2), 2, "0"), F.lit(" "), _part(line, 3))
    rest = _part(line, 6)
    has = rest.contains("COMMAND=")
    head = F.when(has, F.substring_index(rest, "COMMAND=", 1)).otherwise(rest)
    parts = F.filter(F.transform(F.split(head, " ; "), lambda x: F.trim(F.regexp_replace(F.trim(x), r";+$", ""))), lambda x: x != "")
    named = lambda x: x.rlike(r"^[^=a-z]*[A-Z][^=a-z]*=")
    got = lines.where(F.col("line").rlike(line)).select(*_keep(lines), time.alias("time_local"), _part(line, 5).alias("user"), F.when(has, F.trim(F.regexp_extract(rest, r"^.*?COMMAND=(.*)$", 1))).otherwise("").alias("command"), parts.alias("p"))
    value = lambda k: F.coalesce(F.regexp_replace(F.try_element_at(F.filter("p", lambda x: x.startswith(f"{k}=")), F.lit(-1)), "^[^=]*=", ""), F.lit(""))
    status = F.array_join(F.filter("p", lambda x: ~named(x)), "; ")
    got = got.withColumns({"runas": value("USER"), "tty": value("TTY"), "pwd": value("PWD"), "status": status})
    return got.withColumn("suspicious", F.col("status").rlike(r"(?i)incorrect password|not in sudoers") | F.col("command").rlike(r"^\s*(/tmp/|/var/tmp/|/dev/shm/)")).drop("p")


def package_history(lines: DataFrame) -> DataFrame:
    """Package managers' logs: time_local, action, package, version, actor, source, suspicious. Needs line_no for apt's
    blocks, which end at blank lines."""
    keep = _keep(lines)
    line, name = F.col("line"), F.substring_index("path", "/", -1)
    words = F.split(line, r"\s+")
    out = lambda time, action, package, version, actor, source: [*keep, time.alias("time_local"), action.alias("action"), package.alias("package"), version.alias("version"), actor.alias("actor"), F.lit(source).alias("source")]
    none = F.lit("")
    dpkg = lines.where(name.startswith("dpkg") & (F.size(words) >= 5) & F.get(words, F.lit(2)).isin("install", "remove", "purge", "upgrade", "downgrade"))
    new = F.get(words, F.lit(5))
    version = F.when(new.isNotNull() & ~new.isin("", "<none>"), new).otherwise(F.get(words, F.lit(4)))
    dpkg = dpkg.select(out(F.concat_ws(" ", F.get(words, F.lit(0)), F.get(words, F.lit(1))), F.get(words, F.lit(2)), F.substring_index(F.get(words, F.lit(3)), ":", 1), F.when(version == "<none>", "").otherwise(version), none, "dpkg"))
    cell = F.transform(F.split(line, r"\|"), lambda x: F.trim(x))
    zypp = lines.where(name.startswith("history") & F.col("path").contains("zypp") & (F.size(cell) >= 4) & F.get(cell, F.lit(1)).isin("install", "remove"))
    zypp = zypp.select(out(*(F.get(cell, F.lit(i)) for i in range(4)), F.coalesce(F.get(cell, F.lit(5)), none), "zypp"))
    rx = r"^(\S+)\s+SUBDEBUG\s+(\w+):\s+(.+)$"
    dnf_map = F.create_map(*(F.lit(x) for x in ("Installed", "install", "Erased", "remove", "Upgraded", "upgrade", "Downgraded", "downgrade", "Obsoleted", "obsolete", "Reinstalled", "reinstall")))
    dnf = lines.where(name.startswith("dnf.rpm") & line.rlike(rx)).select(out(_part(rx, 1), F.try_element_at(dnf_map, _part(rx, 2)), F.trim(_part(rx, 3)), none, none, "dnf_rpm")).where("action is not null")
    ry = r"^(\w{3}\s+\d+\s+\d{2}:\d{2}:\d{2})\s+(Installed|Erased|Updated):\s+(.+)$"
    yum_map = F.create_map(*(F.lit(x) for x in ("Installed", "install", "Erased", "remove", "Updated", "upgrade")))
    yum = lines.where(name.startswith("yum") & line.rlike(ry)).select(out(_part(ry, 1), F.try_element_at(yum_map, _part(ry, 2)), F.trim(_part(ry, 3)), none, none, "yum"))
    apt = running_count(lines.where(name.startswith("history.log")), F.trim("line") == "", ["host", "path"], "line_no", "block").where(line.contains(":"))
    apt = apt.withColumns({"k": F.trim(F.substring_index("line", ":", 1)), "v": F.trim(F.regexp_extract("line", r"^[^:]*:(.*)$", 1))})
    blocks = apt.groupBy(*keep, "block").agg(F.max_by("v", F.when(F.col("k") == "Start-Date", F.col("line_no"))).alias("start"), F.max(F.when(F.col("k") == "Requested-By", F.col("v"))).alias("by"), F.max(F.when(F.col("k") == "Commandline", F.col("v"))).alias("cl"), F.collect_list(F.when(F.col("k").isin("Install", "Reinstall", "Upgrade", "Downgrade", "Remove", "Purge"), F.struct("k", "v"))).alias("acts"))
    acts = blocks.withColumn("act", F.explode("acts")).withColumn("item", F.explode(F.regexp_extract_all("act.v", F.lit(r"[^\s,]+ \([^)]*\)"), F.lit(0))))
    item = r"^(\S+) \((.*)\)$"
    apt = acts.select(out(F.replace(F.coalesce("start", none), F.lit("  "), F.lit(" ")), F.lower("act.k"), F.substring_index(F.regexp_extract("item", item, 1), ":", 1), F.regexp_extract("item", item, 2), F.coalesce(F.nullif("by", none), "cl", none), "apt_history"))
    every = apt.unionByName(dpkg).unionByName(zypp).unionByName(dnf).unionByName(yum)
    return every.withColumn("suspicious", F.col("package").rlike(OFFENSIVE))


def fortigate(lines: DataFrame) -> DataFrame:
    """Firewall records, raw or exported as CSV cells, several on a line too: times, flag, addresses, user, detail."""
    line = F.col("line")
    csv = F.ltrim(line).startswith('"')
    cells = F.transform(F.split(F.regexp_replace(F.trim(line), r'^"|"$', ""), '","'), lambda x: F.replace(x, F.lit('""'), F.lit('"')))
    pieces = F.when(csv, F.array(F.array_join(cells, " "))).otherwise(F.split(line, r"(?=\bdate=\d{4}-\d{2}-\d{2}\b)"))
    rec = lines.select(*_keep(lines), F.explode(pieces).alias("piece")).withColumn("kv", _pairs(F.col("piece"), r'\w+=(?:"[^"]*"|\S+)')).where(F.map_contains_key("kv", "date") & F.map_contains_key("kv", "logid"))
    get = lambda k: F.coalesce(F.try_element_at("kv", F.lit(k)), F.lit(""))
    utm = get("action").isin("blocked", "dropped", "clear_session", "reset") | get("crlevel").isin("high", "critical") | (get("level") == "alert")
    ok = get("status") == "success"
    flag = (
        F.when((get("type") == "utm") & utm, F.concat(F.lit("utm_"), F.coalesce(F.nullif(get("subtype"), F.lit("")), F.lit("other"))))
        .when(get("type") != "event", "")
        .when(get("logdesc").startswith("Admin login"), F.when(ok, "admin_login").otherwise("admin_login_failed"))
        .when((get("subtype") == "user") & (get("action") == "authentication") & ~ok, "auth_failed")
        .when((get("subtype") == "endpoint") & (get("connection_type") == "sslvpn"), "sslvpn_session")
        .otherwise("")
    )
    told = F.array_distinct(F.filter(F.array(*(get(k) for k in ("attack", "virus", "filename", "hostname", "url", "app", "qname", "ui", "vpntunnel", "logdesc", "msg"))), lambda x: x != ""))
    names = {"type": "type", "subtype": "subtype", "level": "level", "action": "action", "srcip": "srcip", "srcport": "srcport", "dstip": "dstip", "dstport": "dstport", "service": "service"}
    return rec.select(*_keep(lines), epoch_time(get("eventtime")).alias("time_utc"), F.trim(F.concat_ws(" ", get("date"), get("time"))).alias("time_local"), flag.alias("flag"), *(get(k).alias(n) for n, k in names.items()), F.coalesce(F.nullif(get("user"), F.lit("")), get("xauthuser")).alias("user"), get("dstcountry").alias("country"), F.array_join(told, " | ").alias("detail"))


def shell_history(lines: DataFrame) -> DataFrame:
    """Commands of shell history files in order: user, shell, seq, command. zsh prefixes and ``#`` lines go. Needs user,
    shell and a rank of the file."""
    command = F.trim(F.regexp_replace("line", r"^: \d+:\d+;", ""))
    got = lines.withColumn("command", command).where((F.col("command") != "") & ~F.col("command").startswith("#"))
    seq = F.row_number().over(Window.partitionBy("host", "user").orderBy("file_rank", "line_no"))
    return got.select("host", "user", "shell", seq.alias("seq"), "command")


def powershell_history(lines: DataFrame) -> DataFrame:
    """Commands of PowerShell history, lines that end in a backtick joined with the next: user, seq, command."""
    order = Window.partitionBy("host", "user").orderBy("line_no")
    more = F.rtrim("line").endswith("`")
    island = F.sum((~F.coalesce(F.lag(more).over(order), F.lit(False))).cast("int")).over(order)
    part = F.when(more, F.concat(F.regexp_replace(F.trim("line"), "`$", ""), F.lit(" "))).otherwise(F.trim("line"))
    joined = lines.withColumns({"island": island, "part": part}).groupBy("host", "user", "island").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "part"))), lambda x: x["part"]), "").alias("command"))
    joined = joined.withColumn("command", F.trim("command")).where("command <> ''")
    return joined.select("host", "user", F.row_number().over(Window.partitionBy("host", "user").orderBy("island")).alias("seq"), "command")


def shell_escapes(history: DataFrame) -> DataFrame:
    """Commands that gain a shell or rights: binary, function, sudo. The first technique that fits counts."""
    technique = _first_match(F.col("command"), TECHNIQUES, lambda r: F.struct(F.lit(r[0]).alias("binary"), F.lit(r[1]).alias("function")))
    return history.withColumn("t", technique).where("t is not null").select(*history.columns, "t.*", F.col("command").rlike(r"(?i)^\s*(sudo|doas)\b").alias("sudo"))


def powershell_flag(command: Column) -> Column:
    """What a PowerShell command gives away, else null."""
    return _first_match(command, POWERSHELL, lambda r: F.lit(r[0]))


def utmp_records(files: DataFrame) -> DataFrame:
    """Records of login databases (384 bytes each) of binary files (path, content): time_utc, user, type, line, host."""
    hexed = F.hex("content")
    count = F.floor(F.length("content") / 384).cast("int")
    rec = files.where(count > 0).select("path", F.posexplode(F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.substring(hexed, i * 768 + 1, F.lit(768)))).alias("n", "h"))
    text = lambda at, n: F.regexp_replace(F.decode(F.unhex(F.substring("h", at * 2 + 1, n * 2)), "utf-8"), r"\x00[\s\S]*$", "")
    number = lambda at, n: F.conv(F.concat(*(F.substring("h", (at + i) * 2 + 1, 2) for i in reversed(range(n)))), 16, 10).cast("long")
    kinds = F.create_map(*(F.lit(x) for pair in enumerate(("EMPTY", "RUN_LVL", "BOOT_TIME", "NEW_TIME", "OLD_TIME", "INIT_PROCESS", "LOGIN_PROCESS", "USER_PROCESS", "DEAD_PROCESS")) for x in pair))
    return rec.select("path", "n", F.timestamp_seconds(number(340, 4)).alias("time_utc"), text(44, 32).alias("user"), F.coalesce(F.try_element_at(kinds, number(0, 2).cast("int")), number(0, 2).cast("string")).alias("type"), text(8, 32).alias("line"), text(76, 256).alias("host")).where("user <> ''")


def accounts(passwd: DataFrame, group: DataFrame, shadow: DataFrame) -> DataFrame:
    """Accounts of each host with groups, password status, rights and suspicion, from lines of the three files."""
    real = lambda x, n: x.withColumn("p", F.split("line", ":")).where((F.trim("line") != "") & ~F.col("line").startswith("#") & (F.size("p") >= n))
    at = lambda i: F.get("p", F.lit(i))
    g = real(group, 4).select("host", at(0).alias("name"), at(2).alias("gid"), F.split(at(3), ",").alias("members"))
    primary = g.groupBy("host", "gid").agg(F.max("name").alias("group"))
    extra = g.select("host", "name", F.explode("members").alias("user")).withColumn("user", F.trim("user")).where("user <> ''").groupBy("host", "user").agg(F.array_sort(F.collect_set("name")).alias("extra"))
    word = at(1)
    status = F.when(word == "", "no_password").when(word.rlike("^[!*]"), "locked").otherwise("password_set")
    s = real(shadow, 2).select("host", at(0).alias("user"), status.alias("pw_status")).groupBy("host", "user").agg(F.max("pw_status").alias("pw_status"))
    u = real(passwd, 7).select("host", *(at(i).alias(n) for i, n in ((0, "user"), (2, "uid"), (3, "gid"), (4, "gecos"), (5, "home"), (6, "shell"))))
    out = u.join(primary, ["host", "gid"], "left").join(extra, ["host", "user"], "left").join(s, ["host", "user"], "left")
    groups = F.concat(F.coalesce("extra", F.array().cast("array<string>")), F.array(F.coalesce("group", F.lit(""))))
    privileged = F.arrays_overlap(groups, F.array(*(F.lit(x) for x in ("root", "sudo", "wheel", "adm", "admin", "sudoers", "docker", "lxd", "disk", "shadow"))))
    suspicious = ((F.col("uid") == "0") & (F.col("user") != "root")) | (F.coalesce("pw_status", F.lit("")) == "no_password")
    return out.select("host", "user", "uid", "gid", F.coalesce("group", F.lit("")).alias("group"), F.coalesce(F.array_join("extra", ";"), F.lit("")).alias("extra_groups"), "shell", F.coalesce("pw_status", F.lit("")).alias("pw_status"), privileged.alias("privileged"), "gecos", "home", suspicious.alias("suspicious"))


def ssh_keys(lines: DataFrame) -> DataFrame:
    """Keys that may log in (host, account, line of authorized_keys): type, comment, the key's line; comments and blank
    lines are left out."""
    text = F.trim("line")
    words = F.split(text, r"\s+")
    return lines.where((text != "") & ~text.startswith("#")).select("host", "account", F.get(words, F.lit(0)).alias("key_type"), F.coalesce(F.get(words, F.lit(2)), F.lit("")).alias("comment"), text.alias("key"))


def known_hosts(lines: DataFrame) -> DataFrame:
    """Targets that accounts have accepted keys of, with key types; hashed entries are counted. Needs account."""
    real = lines.withColumn("p", F.split(F.trim(F.regexp_replace("line", r"^\s*@\S+\s+", "")), r"\s+")).where((F.trim("line") != "") & ~F.trim("line").startswith("#") & (F.size("p") >= 2))
    target = F.when(F.get("p", F.lit(0)).startswith("|"), "(hashed)").otherwise(F.get("p", F.lit(0)))
    got = real.select("host", "account", target.alias("target"), F.get("p", F.lit(1)).alias("key_type"))
    return got.groupBy("host", "account", "target").agg(F.array_join(F.array_sort(F.collect_set("key_type")), "+").alias("key_types"), F.count("*").alias("entries"))


def socket_lines(lines: DataFrame) -> DataFrame:
    """``ss`` and ``netstat`` output: proto, state, local and peer address and port, process, pids; IPv6 with its colons."""
    w = F.split(F.trim("line"), r"\s+")
    got = lines.withColumn("w", w).where(F.get("w", F.lit(0)).rlike("^(tcp|udp)6?$") & (F.size("w") >= 5))
    ss = F.get("w", F.lit(1)).rlike("^[A-Z]")
    addr = lambda i, j: F.when(ss, F.get("w", F.lit(i))).otherwise(F.get("w", F.lit(j)))
    state = F.when(ss, F.get("w", F.lit(1))).otherwise(F.when(F.get("w", F.lit(5)).rlike("^[A-Z_]+$"), F.get("w", F.lit(5))).otherwise(""))
    host = lambda x: F.regexp_replace(F.regexp_replace(F.regexp_replace(x, r":[^:]*$", ""), r"^\[|\]$", ""), r"%\w+", "")
    rest = F.array_join(F.slice("w", 6, F.size("w")), " ")
    pids = F.array_join(F.array_distinct(F.concat(F.regexp_extract_all(rest, F.lit(r"pid=(\d+)"), F.lit(1)), F.regexp_extract_all(rest, F.lit(r"(\d+)/\S"), F.lit(1)))), ";")
    local, peer = addr(4, 3), addr(5, 4)
    return got.select(*_keep(lines), F.get("w", F.lit(0)).alias("proto"), state.alias("state"), host(local).alias("local_ip"), F.substring_index(local, ":", -1).alias("local_port"), host(peer).alias("peer_ip"), F.substring_index(peer, ":", -1).alias("peer_port"), F.coalesce(F.nullif(F.regexp_extract(rest, r'\(\("([^"]+)"', 1), F.lit("")), F.regexp_extract(rest, r"\d+/(\S+)", 1)).alias("process"), pids.alias("pids"))
