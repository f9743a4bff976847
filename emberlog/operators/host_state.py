"""Normalisers of what hosts report of themselves: logins, processes, services, kernel, network settings, persistence.

Each takes lines (host, path, line_no, line) of one command's output or of one kind of file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.plan import computed_once, dealt
from ..functions.strings import basename, filetime, url_host, webkit_time
from .live import in_staging, is_lolbin

STAGING = r"^(/tmp/|/var/tmp/|/dev/shm/)"
#: Kernel taint bits (name, whether it tells of tampering).
TAINT = (
    ("proprietary_module", False), ("forced_module_load", True), ("smp_unsafe", False), ("forced_module_unload", True), ("machine_check", False), ("bad_page", False), ("user_tainted", False),
    ("oops_or_warning", False), ("acpi_override", False), ("warning", False), ("staging_driver", False), ("firmware_workaround", False), ("out_of_tree_module", False), ("unsigned_module", True),
    ("soft_lockup", False), ("live_patch", False), ("aux_tainted", False), ("struct_randomization", False), ("in_kernel_test", False),
)
#: Lines that make a host fetch, listen or hide.
PERSISTENT = (
    r"(?i)/dev/tcp/|/dev/shm|/tmp/|/var/tmp/|bash\s+-i|\bnc\b|\bncat\b|\bsocat\b|mkfifo|\bcurl\b|\bwget\b|LD_PRELOAD|base64\s+(-d|--decode)|python[0-9.]*\s+-c|perl\s+-e|ruby\s+-e|"
    r"chmod\s+\+[xs]|\.onion\b"
)
#: Hosts that updates and protection come from.
SENSITIVE_HOSTS = r"(?i)\b(update|security|repo|mirror|archive)\.|\.(ubuntu|debian|centos|redhat|microsoft|windowsupdate|clamav|sophos)\.|defender|crowdstrike|mcafee|kaspersky|sentinelone|virustotal"
#: What starts something in a unit, and what says when.
UNIT_KEYS = ("ExecStart", "ExecStartPre", "ExecStartPost", "ExecReload", "ExecStop")
TIMER_KEYS = ("OnCalendar", "OnBootSec", "OnUnitActiveSec", "OnActiveSec", "Unit")
#: Packages that Windows itself registers for logons.
LSA_KNOWN = ("", "msv1_0", "kerberos", "schannel", "wdigest", "tspkg", "pku2u", "cloudap", "negoexts", "livessp", "rassfm", "scecli", "kdcsvc", "ctxsmartcardpsw", "wsauth", "wdigest.dll")
#: Where persistence lives: (vector, path pattern, whether all lines are listed or only suspicious ones).
VECTORS = (
    ("init.d", r"/etc/init\.d/", False), ("rc.local", r"/etc/rc\.local$", True),
    ("profile", r"/etc/profile(\.d/.*)?$", False), ("shell_rc", r"/\.(bashrc|bash_profile|bash_login|profile|bash_aliases|zshrc|zprofile|bash_logout|kshrc)$", False), ("autostart", r"/autostart/.*\.desktop$", False),
    ("sudoers", r"/etc/sudoers(\.d/.*)?$", True), ("motd", r"/etc/update-motd\.d/", False), ("pam", r"/etc/pam\.d/", False), ("kernel_module", r"/etc/modules(-load\.d/.*)?$", True),
    ("modprobe", r"/etc/modprobe\.d/", False), ("pkg_hook", r"/etc/(apt/apt\.conf\.d|yum/pluginconf\.d|dnf/plugins)/", False), ("environment", r"/etc/environment$", False), ("ld_preload", r"/etc/ld\.so\.preload$", True),
)


def _p(pattern: str, i: int, of: str | Column = "line") -> Column:
    return F.regexp_extract(of, pattern, i)


def _words(least: int, lines: DataFrame) -> DataFrame:
    return lines.withColumn("w", F.split(F.trim("line"), r"\s+")).where(F.size("w") >= least)


def _w(i: int) -> Column:
    return F.get("w", F.lit(i))


def _rest(i: int) -> Column:
    return F.array_join(F.slice("w", i + 1, F.greatest(F.size("w") - i, F.lit(0))), " ")


def logins(lines: DataFrame, result: Column | None = None) -> DataFrame:
    """``last`` and ``lastb``: result, user, tty, source, start_local, end_local."""
    rx = r"^(\S+)\s+(\S+)\s+(.*?)\s+((?:Mon|Tue|Wed|Thu|Fri|Sat|Sun)\s+\w{3}\s+\d+\s+\d{2}:\d{2}(?::\d{2})?)\s*(.*)$"
    outcome = result if result is not None else F.when(F.col("path").endswith("lastb.txt"), "failed").otherwise("ok")
    end = F.trim(F.regexp_replace(F.trim(_p(rx, 5)), r"^- ", ""))
    return lines.where(F.col("line").rlike(rx) & ~F.trim("line").rlike("^[wb]tmp begins")).select("host", outcome.alias("result"), _p(rx, 1).alias("user"), _p(rx, 2).alias("tty"), F.trim(_p(rx, 3)).alias("source"), _p(rx, 4).alias("start_local"), end.alias("end_local"))


def last_logins(lines: DataFrame) -> DataFrame:
    """``lastlog``: user, port, source, latest_local; accounts that never logged in are left out."""
    got = _words(2, lines.where((F.col("line_no") > 1) & ~F.contains("line", F.lit("**Never logged in**"))))
    four = F.size("w") >= 4
    return got.select("host", _w(0).alias("user"), F.when(four, _w(1)).otherwise("").alias("port"), F.when(four, _w(2)).otherwise("").alias("source"), F.when(four, _rest(3)).otherwise(_rest(1)).alias("latest_local"))


def processes(lines: DataFrame) -> DataFrame:
    """``ps`` with start times: pid, user, started_local, command."""
    got = _words(8, lines).where(_w(0).rlike(r"^\d+$"))
    return got.select("host", _w(0).alias("pid"), _w(1).alias("user"), F.array_join(F.slice("w", 3, 5), " ").alias("started_local"), _rest(7).alias("command"))


def hidden_pids(lines: DataFrame) -> DataFrame:
    """Process numbers that ``ps`` doesn't show, one a line."""
    return lines.where(F.trim("line").rlike(r"^\d+$")).select("host", F.trim("line").alias("pid"))


def services(lines: DataFrame) -> DataFrame:
    """``systemctl``: units and timers, those whose file is missing flagged; flagged and failed ones first."""
    unit = _words(4, lines.withColumn("line", F.regexp_replace(F.trim("line"), r"^[*●]\s*", ""))).where(_w(0).endswith(".service"))
    unit = unit.select("host", F.lit("service").alias("kind"), _w(0).alias("name"), F.concat_ws("/", _w(2), _w(3)).alias("state"), _rest(4).alias("detail"), (_w(1) == "not-found").alias("suspicious"))
    timer = _words(1, lines.where("line_no > 1")).withColumn("t", F.array_position(F.transform("w", lambda x: x.endswith(".timer")), True)).where("t > 0")
    at = F.col("t").cast("int")
    does = F.array_join(F.slice("w", at + 1, F.greatest(F.size("w") - at, F.lit(0))), " ")
    timer = timer.select("host", F.lit("timer").alias("kind"), F.element_at("w", at).alias("name"), F.when(F.lower(_w(0)) == "n/a", "n/a").otherwise(F.array_join(F.slice("w", 1, 4), " ")).alias("state"), F.when(does != "", F.concat(F.lit("activates="), does)).otherwise("").alias("detail"), F.lit(False).alias("suspicious"))
    return unit.unionByName(timer).orderBy(F.desc("suspicious"), ~F.contains("state", F.lit("failed")), "kind", "name")


def sockets(lines: DataFrame) -> DataFrame:
    """Socket files in staging folders, but those of displays."""
    path = F.trim("line")
    return lines.where(path.rlike(STAGING) & ~path.rlike(r"^/tmp/\.(X11|ICE|XIM|font)-unix/")).select("host", path.alias("name"), F.lit(True).alias("suspicious"))


def sessions(lines: DataFrame) -> DataFrame:
    """``who``, with or without the column of message states: user, tty, at_local, source; lines of fewer than five words
    are left out."""
    got = _words(5, lines)
    at = F.when(_w(1).isin("+", "-", "?"), 2).otherwise(1)
    word = lambda i: F.get("w", at + i)
    return got.select("host", _w(0).alias("user"), word(0).alias("tty"), F.array_join(F.slice("w", at + 2, 3), " ").alias("at_local"), F.coalesce(F.nullif(F.regexp_replace(F.coalesce(word(4), F.lit("")), r"^\(+|\)+$", ""), F.lit("")), F.lit("local")).alias("source"))


def packages(lines: DataFrame) -> DataFrame:
    """``dpkg -l`` or, where a host has none, ``rpm -qa``: name, version, arch, source, install_time_utc."""
    dpkg = _words(4, lines.where(F.col("path").contains("dpkg"))).where(_w(0).rlike("^i.{1,2}$")).select("host", _w(1).alias("name"), _w(2).alias("version"), _w(3).alias("arch"), F.lit("dpkg").alias("source"), F.lit(None).cast("timestamp").alias("install_time_utc"))
    cell = F.split("line", "~", 3)
    rpm = lines.where(F.col("path").contains("rpm") & (F.size(cell) >= 3)).select("host", F.get(cell, F.lit(1)).alias("name"), F.get(cell, F.lit(2)).alias("version"), F.lit("").alias("arch"), F.lit("rpm").alias("source"), F.timestamp_seconds(F.get(cell, F.lit(0)).try_cast("long")).alias("install_time_utc"))
    return dpkg.unionByName(rpm.join(dpkg.select("host").distinct(), "host", "left_anti"))


def package_verify(lines: DataFrame) -> DataFrame:
    """``dpkg -V`` and ``rpm -V``: flags, attr, path."""
    got = _words(2, lines)
    attr = (_w(0) != "missing") & (F.size("w") >= 3) & (F.length(_w(1)) == 1)
    return got.select("host", _w(0).alias("flags"), F.when(attr, _w(1)).otherwise("").alias("attr"), F.when(_w(0) == "missing", _w(1)).when(attr, _rest(2)).otherwise(F.element_at("w", -1)).alias("path"))


def executable_hashes(md5: DataFrame, sha1: DataFrame) -> DataFrame:
    """Hash lists of executables met by path; a hash that is missing is empty."""
    rx = r"^(\S+)  (.*)$"
    one = lambda x, name: x.where(F.col("line").rlike(rx)).groupBy("host", F.trim(_p(rx, 2)).alias("file")).agg(F.max(_p(rx, 1)).alias(name))
    return one(md5, "md5").join(one(sha1, "sha1"), ["host", "file"], "full").fillna("", ["md5", "sha1"])


def kernel(lines: DataFrame) -> DataFrame:
    """Loaded modules, set taint bits and the core dump program: kind, name, detail, suspicious. ``path`` names the
    source: lsmod, tainted or core_pattern."""
    mod = _words(3, lines.where(F.col("path").contains("lsmod") & ~F.col("line").startswith("Module")))
    mod = mod.select("host", F.lit("module").alias("kind"), _w(0).alias("name"), F.concat(F.lit("size="), _w(1), F.lit(" used_by_count="), _w(2), F.when(F.size("w") > 3, F.concat(F.lit(" used_by="), _rest(3))).otherwise("")).alias("detail"), F.lit(False).alias("suspicious"))
    value = lines.where(F.col("path").contains("tainted") & F.trim("line").rlike(r"^-?\d+$")).select("host", F.trim("line").cast("long").alias("v"))
    whole = value.select("host", F.lit("taint").alias("kind"), F.lit("taint_value").alias("name"), F.col("v").cast("string").alias("detail"), (F.col("v") != 0).alias("suspicious"))
    bits = F.array(*(F.struct(F.lit(i).alias("bit"), F.lit(n).alias("name"), F.lit(s).alias("s")) for i, (n, s) in enumerate(TAINT)))
    bit = value.withColumn("b", F.explode(bits)).where(F.expr("v & shiftleft(1L, b.bit)") != 0).select("host", F.lit("taint").alias("kind"), "b.name", F.concat(F.lit("bit "), F.col("b.bit").cast("string")).alias("detail"), F.col("b.s").alias("suspicious"))
    core = lines.where(F.col("path").contains("core_pattern") & (F.trim("line") != ""))
    program = basename(F.regexp_extract(F.trim("line"), r"^\|\s*(\S*)", 1))
    core = core.select("host", F.lit("core_pattern").alias("kind"), F.lit("core_pattern").alias("name"), F.trim("line").alias("detail"), (F.trim("line").startswith("|") & ~program.isin("systemd-coredump", "apport", "abrt-hook-ccpp", "abrt")).alias("suspicious"))
    return whole.unionByName(bit).unionByName(core).unionByName(mod)


def network_config(lines: DataFrame) -> DataFrame:
    """hosts, resolv.conf, hosts.allow and hosts.deny: file, entry, suspicious (real names sent to the host itself, names
    of update servers set by hand, access for all)."""
    name, entry = basename(F.col("path")), F.trim("line")
    got = _words(1, lines.where((entry != "") & ~entry.startswith("#") & name.isin("hosts", "resolv.conf", "hosts.allow", "hosts.deny")))
    local = lambda x: F.lower(x).rlike(r"^(localhost|ip6-)|localdomain")
    real = F.filter(F.slice("w", 2, F.size("w")), lambda x: x.contains(".") & x.rlike("[a-zA-Z]") & ~local(x))
    sinkhole = (F.size(real) > 0) & _w(0).rlike(r"^(127\.|::1$|0\.0\.0\.0$|::$)")
    odd = F.when(name == "hosts", sinkhole | F.exists(real, lambda x: x.rlike(SENSITIVE_HOSTS))).when(name == "hosts.allow", entry.rlike(r"(?i)^ALL\s*:\s*ALL\b")).otherwise(F.lit(False))
    return got.select("host", name.alias("file"), entry.alias("entry"), odd.alias("suspicious"))


def ebpf(lines: DataFrame) -> DataFrame:
    """Loaded programs, counted by type, user and loader, and pinned objects, which are flagged. ``path`` tells listings of
    /sys/fs/bpf from program lists."""
    head = r"^(\d+):\s+(\S+)"
    prog = lines.where(F.col("path").contains("prog")).withColumn("n", F.sum(F.col("line").rlike(head).cast("int")).over(Window.partitionBy("host", "path").orderBy("line_no"))).where("n > 0")
    one = prog.groupBy("host", "path", "n").agg(F.max(F.when(F.col("line").rlike(head), _p(head, 2))).alias("name"), F.max(_p(r"\buid\s+(\d+)", 1)).alias("uid"), F.max(_p(r"\bpids\s+(\S+?)\(\d+\)", 1)).alias("loader"))
    detail = F.concat(F.lit("count="), F.col("count").cast("string"), F.when(F.col("uid") != "", F.concat(F.lit(" uid="), F.col("uid"))).otherwise(""), F.when(F.col("loader") != "", F.concat(F.lit(" loaded_by="), F.col("loader"))).otherwise(""))
    programs = one.groupBy("host", "name", "uid", "loader").count().select("host", F.lit("prog").alias("kind"), "name", detail.alias("detail"), F.lit(False).alias("suspicious"))
    pin = _words(9, lines.where(~F.col("path").contains("prog") & ~F.col("line").startswith("total"))).withColumn("name", _rest(8)).where("name not in ('.', '..')")
    return programs.unionByName(pin.select("host", F.lit("pin").alias("kind"), "name", F.lit("pinned").alias("detail"), F.lit(True).alias("suspicious")))


def setuid_files(lines: DataFrame, escapes: list[str]) -> DataFrame:
    """Files that run with their owner's rights: path, reason (unusual_path, gtfobins, hidden_name). ``escapes`` names
    programs that can be turned into a shell."""
    path = F.trim("line")
    name = basename(path)
    usual = path.rlike(r"^(/bin/|/sbin/|/usr/bin/|/usr/sbin/|/usr/local/bin/|/usr/local/sbin/|/usr/local/lib|/usr/lib|/lib|/opt/|/snap/)")
    reason = F.when(~usual, "unusual_path").when(name.isin(*escapes), "gtfobins").when(name.startswith("."), "hidden_name").otherwise("")
    return lines.where((path != "") & ~path.rlike(r"/\.snapshots/\d+/snapshot/|/\.zfs/snapshot/")).select("host", path.alias("file"), name.alias("name"), reason.alias("reason"), (reason != "").alias("suspicious"))


def process_links(lines: DataFrame, hidden: DataFrame) -> DataFrame:
    """Processes whose program is in memory or a staging folder, or whose folder is one: kind, pid, user, detail. The
    collector's own folders are left out; pids that ps hides are noted. ``path`` tells program links from folder links."""
    rx = r"/proc/(\d+)/(exe|cwd)"
    got = lines.where(F.col("line").contains(" -> ") & F.col("line").rlike(rx))
    left, target = F.substring_index("line", " -> ", 1), F.trim(F.regexp_extract("line", r"^.*? -> (.*)$", 1))
    got = computed_once(got, {"pid": _p(rx, 1), "what": _p(rx, 2), "user": F.coalesce(F.get(F.split(F.trim(left), r"\s+"), F.lit(2)), F.lit("")), "target": target, "clean": F.trim(F.regexp_replace(target, r" \(deleted\)$", "")), "root": F.regexp_extract("line", r"((?:/tmp|/var/tmp|/dev/shm)/[^/\s]+)/uac-\d", 1)})
    roots = got.where("root <> ''").groupBy("host").agg(F.collect_set("root").alias("roots"))
    got = got.join(roots, "host", "left")
    staged = F.col("clean").rlike(STAGING) & ~F.exists(F.coalesce("roots", F.array().cast("array<string>")), lambda r: F.col("clean").startswith(r))
    memory = F.col("clean").contains("memfd:") & ~F.lower(F.concat_ws(" ", "user", "target")).contains("sophos")
    kind = F.when((F.col("what") == "exe") & memory, "exe_memfd").when((F.col("what") == "exe") & staged, "exe_tmp").when((F.col("what") == "cwd") & staged, "cwd_tmp")
    note = hidden.select("host", "pid").distinct().withColumn("hidden", F.lit(" [hidden from ps]"))
    out = got.withColumn("kind", kind).where("kind is not null").join(note, ["host", "pid"], "left")
    return out.select("host", "kind", "pid", "user", F.concat("target", F.when(F.col("kind") != "cwd_tmp", F.coalesce("hidden", F.lit(""))).otherwise("")).alias("detail"))


def log_integrity(files: DataFrame, hosts: DataFrame) -> DataFrame:
    """Of each host and expected log (host, name, size): missing, empty, truncated or present."""
    spark = files.sparkSession
    text = ("auth.log", "secure", "messages", "syslog", "kern.log", "cron", "audit/audit.log")
    expected = spark.createDataFrame([(n, None) for n in text] + [("wtmp", 384), ("btmp", 384), ("utmp", 384), ("lastlog", 292)], "name string, record int")
    got = hosts.select("host").distinct().join(F.broadcast(expected)).join(files.groupBy("host", "name").agg(F.max("size").alias("size")), ["host", "name"], "left")  # eleven expected logs
    torn = F.col("record").isNotNull() & (F.col("size") % F.col("record") != 0)
    status = F.when(F.col("size").isNull(), "missing").when(F.col("size") == 0, "empty").when(torn, "truncated").otherwise("present")
    return got.select("host", "name", status.alias("status"), "size", ((status == "truncated") | ((status == "empty") & F.col("name").isin("auth.log", "secure", "messages", "syslog", "wtmp"))).alias("suspicious"))


def audit_rules(lines: DataFrame) -> DataFrame:
    """Rules of an audit configuration that watch something."""
    rule = F.trim(F.regexp_replace("line", r"\s+", " "))
    low = F.lower(rule)
    covers = low.startswith("-w ") | (low.startswith("-a ") & (low.contains("always") | low.contains("exit")) & ~low.contains("never"))
    return lines.select("host", rule.alias("rule")).where(covers & ~F.col("rule").startswith("#")).distinct()


def audit_daemon(lines: DataFrame) -> DataFrame:
    """Of each host's audit daemon settings (key = value): write_logs, max_log_file_action, log_file, and ``weakened``, the
    settings that keep records from the disk or put them elsewhere. Of repeated keys the last counts."""
    text = F.trim("line")
    kv = lines.where((text != "") & ~text.startswith("#") & text.contains("=")).select("host", "line_no", F.lower(F.trim(F.substring_index(text, "=", 1))).alias("k"), F.trim(F.regexp_extract(text, r"^[^=]*=(.*)$", 1)).alias("v"))
    last = lambda key: F.max_by(F.when(F.col("k") == key, F.col("v")), F.when(F.col("k") == key, F.col("line_no")))
    names = ("write_logs", "flush", "max_log_file_action", "log_format", "log_file")
    got = kv.groupBy("host").agg(*(last(n).alias(n) for n in names))
    is_ = lambda n, v: F.lower(n) == v
    weak = ((is_("write_logs", "no"), F.lit("write_logs=no")), (is_("flush", "none"), F.lit("flush=none")), (is_("max_log_file_action", "ignore"), F.lit("max_log_file_action=ignore")), (is_("log_format", "nolog"), F.lit("log_format=nolog")), (F.col("log_file") != "/var/log/audit/audit.log", F.concat(F.lit("log_file="), F.col("log_file"))))
    got = got.withColumn("weakened", F.array_compact(F.array(*(F.when(t, x) for t, x in weak))))
    return got.select("host", "write_logs", "max_log_file_action", F.coalesce("log_file", F.lit("/var/log/audit/audit.log")).alias("log_file"), "weakened", (F.size("weakened") > 0).alias("suspicious"))


def audit_rule_changes(before: DataFrame, now: DataFrame) -> DataFrame:
    """(host, kind, rule): watching rules that the loaded set has lost (flagged) or gained against the one before, of hosts
    that have one before."""
    old, new = audit_rules(before), audit_rules(now)
    lost = old.exceptAll(new).select("host", F.lit("rule_removed").alias("kind"), "rule", F.lit(True).alias("suspicious"))
    gained = new.exceptAll(old).join(before.select("host").distinct(), "host", "left_semi").select("host", F.lit("rule_added").alias("kind"), "rule", F.lit(False).alias("suspicious"))
    return lost.unionByName(gained)


def audit_coverage(lines: DataFrame) -> DataFrame:
    """Of each host: watches, system call rules, whether tasks are never audited, the last switch, and disabled."""
    rule = F.trim(F.regexp_replace("line", r"\s+", " "))
    low = F.lower(rule)
    state = F.when(rule.rlike(r"^-e \S+"), F.regexp_extract(rule, r"^-e (\S+)", 1))
    counts = audit_rules(lines).groupBy("host").agg(F.count_if(F.lower("rule").startswith("-w ")).alias("watches"), F.count_if(~F.lower("rule").startswith("-w ")).alias("syscalls"))
    all_ = lines.where(~rule.startswith("#")).groupBy("host").agg(F.max(low.contains("task,never") | low.contains("never,task")).alias("never"), F.max_by(state, F.when(state.isNotNull(), F.col("line_no"))).alias("enabled"))
    return all_.join(counts, "host", "left").fillna(0, ["watches", "syscalls"]).withColumn("disabled", F.coalesce(F.col("enabled") == "0", F.lit(False)))


def persistence(lines: DataFrame) -> DataFrame:
    """Lines of start-up files by vector; of most vectors only those that fetch, listen or hide. Of systemd units (services,
    timers, drop-ins) the lines that start something or say when: all of those that administrators and users wrote, of a
    vendor's only suspicious ones. Comments and blank lines are left out; null lines too."""
    text = F.trim("line")
    unit = F.col("path").rlike(r"/systemd/.*\.(service|timer|conf)$")
    key = F.trim(F.substring_index(text, "=", 1))
    does = text.contains("=") & key.isin(*UNIT_KEYS, *TIMER_KEYS)
    own = F.col("path").rlike(r"(^|/)etc/systemd/system/|/\.config/systemd/user/")
    kind = F.when(F.col("path").endswith(".timer") | key.isin(*TIMER_KEYS), "systemd_timer").otherwise("systemd_service")
    row = lambda n, every: F.struct(n.alias("vector"), every.alias("every"))
    vector = F.when(unit, F.when(does, row(kind, own))).otherwise(F.coalesce(*(F.when(F.col("path").rlike(rx), row(F.lit(n), F.lit(every))) for n, rx, every in VECTORS)))
    got = computed_once(lines.where((text != "") & ~text.startswith("#")), {"v": vector, "suspicious": text.rlike(PERSISTENT)}).where("v is not null")
    return got.where("suspicious or v.every").select("host", "path", "v.vector", text.alias("entry"), "suspicious")


def cron_tables(lines: DataFrame) -> DataFrame:
    """Entries of crontabs and lists of who may use them; scripts that run periodically are named."""
    table = F.col("path").rlike(r"/etc/(crontab|anacrontab|cron\.d/.*|cron\.(allow|deny))$|/var/spool/cron/")
    script = F.col("path").rlike(r"/etc/cron\.(hourly|daily|weekly|monthly)/")
    entries = lines.where(table & (F.trim("line") != "") & ~F.trim("line").startswith("#")).select("host", "path", F.trim("line").alias("entry"))
    return entries.union(lines.where(script).select("host", "path", F.lit("(periodic script)")).distinct())


def error_reports(lines: DataFrame) -> DataFrame:
    """Crash reports: event_type, event_time_utc, app_name, app_path, fault_module, exception_code of each report file."""
    kv = lines.where(F.col("line").contains("=")).select("host", "path", F.trim(F.substring_index("line", "=", 1)).alias("k"), F.trim(F.regexp_extract("line", r"^[^=]*=(.*)$", 1)).alias("v"))
    sig = r"^Sig\[(\d+)\]\.(Name|Value)$"
    sigs = kv.where(F.col("k").rlike(sig)).groupBy("host", "path", F.regexp_extract("k", sig, 1).alias("n")).agg(F.max(F.when(F.col("k").endswith("Name"), F.col("v"))).alias("k"), F.max(F.when(F.col("k").endswith("Value"), F.col("v"))).alias("v"))
    every = kv.where(~F.col("k").rlike(sig)).unionByName(sigs.drop("n").where("k is not null"))
    of = lambda *names: F.coalesce(*(F.max(F.when((F.col("k") == n) & (F.col("v") != ""), F.col("v"))) for n in names), F.lit(""))
    got = every.groupBy("host", "path").agg(of("EventType").alias("event_type"), of("EventTime").alias("t"), of("Application Name", "AppName").alias("app_name"), of("AppPath", "TargetAppId").alias("app_path"), of("Fault Module Name", "Faulting Module Name").alias("fault_module"), of("Exception Code").alias("exception_code"))
    return got.withColumn("event_time_utc", F.when(F.col("t").try_cast("long") > 0, filetime(F.col("t").try_cast("long")))).drop("t")


def launch_dictionary(lines: DataFrame) -> DataFrame:
    """Programs and when they last ran; the path is cut at the last pipe."""
    rx = r"^(.*)\|([^|]*)$"
    return lines.where(F.trim("line").rlike(rx)).select("host", F.trim(_p(rx, 1, F.trim("line"))).alias("executable_path"), F.trim(_p(rx, 2, F.trim("line"))).alias("last_executed_local"))


def task_files(files: DataFrame) -> DataFrame:
    """Scheduled tasks of their XML files (host, path, xml): author, created, account, flags, triggers, command."""
    # each path parses the file anew, which takes nearly all of the time: only those whose last element is in it are tried
    files = dealt(files.where(F.col("xml").contains("<Task")), rows=1 << 16)
    text = F.regexp_replace("xml", r'\sxmlns="[^"]*"', "")
    has = lambda element: F.contains("xml", F.lit(element))
    get = lambda *path: F.coalesce(F.when(has(path[-1]), F.xpath_string(text, F.lit("/Task/" + "/".join(path)))), F.lit(""))
    every = lambda *path: F.coalesce(F.when(has(path[-1]), F.xpath(text, F.lit("/Task/" + "/".join(path) + "/text()"))), F.array().cast("array<string>"))
    commands, arguments = every("Actions", "Exec", "Command"), every("Actions", "Exec", "Arguments")
    joined = F.zip_with(commands, arguments, lambda c, a: F.trim(F.concat_ws(" ", c, a)))
    com = F.transform(every("Actions", "ComHandler", "ClassId"), lambda x: F.concat(F.lit("COM:"), x))
    got = files.select("host", "path", get("RegistrationInfo", "Author").alias("author"), get("RegistrationInfo", "Date").alias("created_local"), get("Principals", "Principal", "UserId").alias("runas"), get("Principals", "Principal", "RunLevel").alias("runlevel"), (F.lower(get("Settings", "Hidden")) == "true").alias("hidden"), (F.lower(get("Settings", "Enabled")) == "false").alias("disabled"), F.array_join(F.concat(joined, com), " | ").alias("command"))
    return got.withColumn("suspicious", (F.col("hidden") & ~F.lower("path").rlike(r"\\microsoft\\|/microsoft/")) | in_staging(F.col("command")) | is_lolbin(F.col("command")))


def transfer_jobs(rows: DataFrame) -> DataFrame:
    """Download jobs (host, url, dest), counted: owner, source host, suspicious (an address for a host, ftp, or a program
    outside of temporary folders)."""
    low = F.lower("dest")
    runnable = low.rlike(r"\.(exe|dll|ps1|bat|cmd|vbs|vbe|js|jse|hta|scr|msi)$") & ~low.contains("\\temp\\") & ~low.contains("\\windowsapps\\")
    source = url_host(F.col("url"))
    odd = source.rlike(r"^\d{1,3}(\.\d{1,3}){3}$") | F.lower("url").startswith("ftp://") | runnable
    return rows.groupBy("host", "url", "dest").agg(F.count("*").alias("count")).select("host", F.regexp_extract("dest", r"(?i)\\Users\\([^\\]+)\\", 1).alias("user"), source.alias("source"), "url", "dest", "count", odd.alias("suspicious"))


def browser_history(chromium: DataFrame, firefox: DataFrame) -> DataFrame:
    """Visits of decoded history tables: Chromium's (host, user, browser, url, title, visit_count, last_visit_time) and
    Firefox's (…, last_visit_date)."""
    clean = lambda c: F.replace(F.coalesce(c, F.lit("")), F.lit("\u0000"), F.lit(""))
    base = lambda df, t: df.select("host", "user", "browser", clean("url").alias("url"), clean("title").alias("title"), F.col("visit_count").cast("long").alias("visits"), t.alias("last_visit_utc"))
    when = F.col("last_visit_time").cast("long")
    return base(chromium, F.when(when > 0, webkit_time(when))).unionByName(base(firefox, F.when(F.col("last_visit_date") > 0, F.timestamp_micros("last_visit_date"))))


def browser_downloads(chromium: DataFrame) -> DataFrame:
    """Downloads of decoded Chromium tables (host, user, browser, target_path, tab_url, total_bytes, start_time, end_time)."""
    clean = lambda c: F.replace(F.coalesce(c, F.lit("")), F.lit("\u0000"), F.lit(""))
    at = lambda c: F.when(F.col(c).cast("long") > 0, webkit_time(F.col(c).cast("long")))
    return chromium.select("host", "user", "browser", clean("target_path").alias("target"), clean("tab_url").alias("source"), F.col("total_bytes").cast("long").alias("bytes"), at("start_time").alias("start_utc"), at("end_time").alias("end_utc"))


def rdp_targets(default: DataFrame, servers: DataFrame) -> DataFrame:
    """Remote desktops that users dialled: most recent position, account hint, accepted certificate, key time."""
    one = default.groupBy("host", "user", F.lower("target").alias("t")).agg(F.min("target").alias("target"), F.min("position").alias("mru"))
    two = servers.groupBy("host", "user", F.lower("target").alias("t")).agg(F.min("target").alias("target2"), F.max("hint").alias("username_hint"), F.max(F.coalesce("cert", F.lit(False))).alias("cert_accepted"), F.max("last_write").alias("key_last_write_utc"))
    return one.join(two, ["host", "user", "t"], "full").select("host", "user", F.coalesce("target", "target2").alias("target"), "mru", F.coalesce("username_hint", F.lit("")).alias("username_hint"), F.coalesce("cert_accepted", F.lit(False)).alias("cert_accepted"), "key_last_write_utc")


def registry_autostarts(values: DataFrame) -> DataFrame:
    """Start-up entries of registry values (host, key, name, data): what is listed and what is flagged."""
    key = F.lower(F.replace("key", F.lit("/"), F.lit("\\")))
    name, data = F.lower("name"), F.coalesce("data", F.lit(""))
    run = key.rlike(r"\\currentversion\\(run|runonce|runonceex|runservices|policies\\explorer\\run)$")
    odd = in_staging(data) | is_lolbin(data)
    rows = [
        ("run_key", run, odd),
        ("userinit", key.endswith("\\winlogon") & (name == "userinit"), ~F.lower(data).rlike(r"^([a-z]:\\windows\\system32\\)?userinit\.exe,?\s*$")),
        ("shell", key.endswith("\\winlogon") & (name == "shell"), ~F.lower(F.trim(data)).isin("explorer.exe")),
        ("appinit", (name == "appinit_dlls") & (F.trim(data) != ""), F.lit(True)),
        ("appcert", key.endswith("\\appcertdlls"), F.lit(True)),
        ("image_options", key.contains("\\image file execution options\\") & name.isin("debugger", "globalflag"), name == "debugger"),
        ("boot_execute", name == "bootexecute", ~F.lower(F.trim(data)).rlike(r"^autocheck autochk \*$")),
        ("lsa_package", key.endswith("\\control\\lsa") & name.isin("authentication packages", "security packages", "notification packages") & F.exists(F.split(F.trim(data), r"[\s,]+"), lambda x: ~F.lower(F.regexp_replace(x, '"', "")).isin(*LSA_KNOWN)), F.lit(True)),
        ("cmd_autorun", key.endswith("\\command processor") & (name == "autorun") & (F.trim(data) != ""), F.lit(True)),
        ("time_provider", key.rlike(r"\\w32time\\timeproviders\\[^\\]+$") & (name == "dllname") & (in_staging(data) | (data.contains("\\") & ~F.lower(data).contains("system32"))), in_staging(data)),
        ("netsh", key.endswith("\\microsoft\\netsh"), in_staging(data)),
        ("logon_script", key.endswith("\\environment") & (name == "userinitmprlogonscript"), F.lit(True)),
        ("com_hijack", key.rlike(r"\\software\\classes\\clsid\\.*\\inprocserver32$"), in_staging(data)),
        ("active_setup", key.contains("\\active setup\\installed components\\") & (name == "stubpath"), odd),
    ]
    kind = F.coalesce(*(F.when(test, F.struct(F.lit(n).alias("vector"), F.coalesce(flag, F.lit(False)).alias("suspicious"))) for n, test, flag in rows))
    return computed_once(values, {"v": kind}).where("v is not null").select("host", "key", "name", "data", "v.*")


def linux_machine_info(lines: DataFrame) -> DataFrame:
    """A row for each host, from the outputs that ``path`` names: hostnamectl, os-release, hostname, timezone, date, free,
    lscpu, last, ip_addr_show, ifconfig, passwd. Addresses are those of ``ip`` or else ``ifconfig``, without loopback and
    link-local ones; users are those with a login shell. What no output tells is empty; the name falls back to the host's."""
    lines = dealt(lines.select("host", "path", "line_no", "line"), "host")  # texts by number are sorted to be aggregated
    name = basename(F.col("path"))
    kv = lambda sep: (F.trim(F.substring_index("line", sep, 1)), F.trim(F.regexp_replace(F.regexp_extract("line", rf"^[^{sep}]*{sep}(.*)$", 1), '^\\s*"|"\\s*$', "")))
    colon, equal = kv(":"), kv("=")
    first = lambda test, value: F.min_by(F.when(test, value), F.when(test & (value != ""), F.col("line_no")))
    last = lambda test, value: F.max_by(F.when(test, value), F.when(test & (value != ""), F.col("line_no")))
    ctl = lambda key: last(name.startswith("hostnamectl") & (colon[0] == key), colon[1])
    cpu = lambda key: last(name.startswith("lscpu") & (colon[0] == key), colon[1])
    text = F.trim("line")
    kb = F.regexp_extract("line", r"^Mem:\s+(\d+)", 1).try_cast("long")
    found = lines.groupBy("host").agg(
        ctl("Static hostname").alias("n1"), first(name == "hostname", text).alias("n2"), ctl("Operating System").alias("p1"), last((name == "os-release") & (equal[0] == "PRETTY_NAME"), equal[1]).alias("p2"),
        ctl("Kernel").alias("build"), ctl("Machine ID").alias("machine_id"), first(name == "timezone", text).alias("z1"), first(name.startswith("date"), F.get(F.reverse(F.split(text, r"\s+")), F.lit(1))).alias("z2"),
        first(name.startswith("last.") & F.col("line").startswith("reboot"), F.regexp_extract("line", r"([A-Z][a-z]{2}\s+[A-Z][a-z]{2}\s+\d+\s+\d{2}:\d{2})", 1)).alias("boot_time"),
        ctl("Virtualization").alias("virtualization"), ctl("Architecture").alias("architecture"), cpu("Model name").alias("cpu"), cpu("CPU(s)").alias("cpu_count"),
        F.max(F.when(name.startswith("free"), kb)).alias("kb"), ctl("Hardware Vendor").alias("h1"), ctl("Hardware Model").alias("h2"),
    )
    address = F.explode(F.transform(F.regexp_extract_all("line", F.lit(r"inet6?\s+(?:addr:\s*)?([0-9A-Fa-f.:]+)"), F.lit(1)), F.lower))
    seen = lines.where(name.startswith("ip_addr_show") | name.startswith("ifconfig")).select("host", name.startswith("ifconfig").alias("second"), address.alias("ip")).where(~F.col("ip").isin("127.0.0.1", "::1") & ~F.col("ip").startswith("fe80")).distinct()
    source = seen.groupBy("host").agg(F.min("second").alias("second"))
    ips = seen.join(source, ["host", "second"]).groupBy("host").agg(F.array_sort(F.collect_set("ip")).alias("ips"))
    shell = F.split("line", ":", -1)
    users = lines.where((name == "passwd") & (F.size(shell) >= 7) & F.col("line").rlike("^[^:+-]") & ~F.get(shell, F.lit(6)).rlike("nologin|/false|/sync|/shutdown|/halt")).groupBy("host").agg(F.array_sort(F.collect_set(F.get(shell, F.lit(0)))).alias("users"))
    none, or_empty = F.array().cast("array<string>"), lambda *c: F.coalesce(*c, F.lit(""))
    got = found.join(ips, "host", "left").join(users, "host", "left")
    return got.select(
        "host", F.coalesce("n1", "n2", "host").alias("machine_name"), or_empty("p1", "p2").alias("product_name"), or_empty("build").alias("build"), or_empty("machine_id").alias("machine_id"), or_empty("z1", "z2").alias("timezone"), or_empty("boot_time").alias("boot_time"),
        or_empty("virtualization").alias("virtualization"), or_empty("architecture").alias("architecture"), or_empty("cpu").alias("cpu"), or_empty("cpu_count").alias("cpu_count"),
        F.coalesce(F.format_string("%.1f GiB", F.col("kb") / 1048576.0), F.lit("")).alias("memory"), F.trim(F.concat_ws(" ", "h1", "h2")).alias("hardware"), F.coalesce("ips", none).alias("ips"), F.coalesce("users", none).alias("users"),
    )


def windows_machine_info(values: DataFrame) -> DataFrame:
    """A row for each host, from registry values (host, key, name, data): product, release, build, owner, name, domain, fqdn,
    addresses, and users with their SIDs as a map. What no value tells is empty; the current control set is the one given,
    or the first."""
    key, name = F.lower(F.replace("key", F.lit("/"), F.lit("\\"))), F.lower("name")
    pick = lambda end, *names: F.coalesce(*(F.min(F.when(key.endswith(end) & (name == n.lower()) & (F.trim("data") != ""), F.col("data"))) for n in names), F.lit(""))
    version, tcp = "\\windows nt\\currentversion", "\\services\\tcpip\\parameters"
    card = key.contains("\\tcpip\\parameters\\interfaces\\") & name.isin("dhcpipaddress", "ipaddress")
    address = F.when(card, F.filter(F.split("data", r"[\s,;]+"), lambda x: ~x.isin("", "0.0.0.0")))
    folder = F.when(key.contains("\\profilelist\\") & (name == "profileimagepath"), F.replace("data", F.lit("/"), F.lit("\\")))
    profiles = values.select("host", F.substring_index(folder, "\\", -1).alias("user"), F.substring_index(F.replace("key", F.lit("/"), F.lit("\\")), "\\", -1).alias("sid")).where("user is not null")
    users = profiles.groupBy("host", "user").agg(F.min("sid").alias("sid")).groupBy("host").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("user", "sid")))).alias("users"))
    got = values.groupBy("host").agg(
        pick(version, "ProductName").alias("product_name"), pick(version, "DisplayVersion", "ReleaseId").alias("release"), pick(version, "CurrentBuild").alias("build"), pick(version, "RegisteredOwner").alias("registered_owner"),
        pick("\\computername\\computername", "ComputerName").alias("machine_name"), pick(tcp, "Domain", "NV Domain").alias("domain"), pick(tcp, "Hostname").alias("h"), F.array_sort(F.array_distinct(F.flatten(F.collect_set(address)))).alias("ips"),
    )
    fqdn = F.when((F.col("h") != "") & (F.col("domain") != ""), F.concat_ws(".", "h", "domain")).otherwise("")
    return got.join(users, "host", "left").select("host", "machine_name", fqdn.alias("fqdn"), "domain", "product_name", "release", "build", "registered_owner", "ips", "users")


def event_hosts(events: DataFrame) -> DataFrame:
    """(drop, host): of each unnamed collection of events the computer that most of them name, by its first label; ties by
    name. All events count."""
    short = F.substring_index(F.trim("Computer"), ".", 1)
    counts = events.where(F.coalesce(short, F.lit("")) != "").groupBy("drop", short.alias("name")).agg(F.count("*").alias("n"))
    return counts.groupBy("drop").agg(F.min_by("name", F.struct(-F.col("n"), "name")).alias("host"))
