"""Live-response snapshots: flags on each artifact, findings, and what processes, connections and services tell together."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.net import ip_scope
from ..functions.strings import basename

#: Folders that programs are staged in, and what gives away that a tool of the system is misused.
STAGING = ("\\temp\\", "\\tmp\\", "\\appdata\\local\\temp\\", "\\downloads\\", "\\users\\public\\", "\\$recycle.bin\\", "\\windows\\temp\\", "\\perflogs\\")
LOLBIN = (
    "-enc", "-encodedcommand", "frombase64string", "downloadstring", "downloadfile", "-w hidden", "-windowstyle hidden", "iex(", "iex ", "invoke-expression", "mshta http", "mshta vbscript",
    "mshta javascript", "regsvr32 /i:http", "scrobj.dll", "certutil -urlcache", "certutil -decode", "bitsadmin /transfer", "/transfer ", "-nop -", "-noprofile -enc",
)
#: Ports of back doors, drivers that let others in, services that name or reveal a host, the folders of
#: system processes, networks that ask nothing, shares that Windows makes itself, flags that weigh most, and which
#: programs shouldn't start which.
BACKDOOR_PORTS = (1337, 4444, 4445, 5554, 5555, 6666, 9001, 12345, 31337)
VULNERABLE_DRIVERS = (
    "rtcore64", "rtkio64", "gdrv", "dbutil_2_3", "dbutil_2_5", "dbutildrv2", "capcom", "winring0", "winring0x64", "msio64", "ene", "eneio64", "wineio64", "atillk64", "gpcidrv64", "asrdrv",
    "asrdrv101", "asrdrv102", "asrdrv103", "asrdrv104", "asusio2", "asio2", "asio3", "iqvw64e", "naldrv", "phlashnt", "viragt64", "mhyprot2", "mhyprot3", "procexp152", "speedfan", "kprocesshacker",
)
DYNAMIC_DNS = (
    "no-ip.", "noip.", "ddns.", "duckdns.", "ngrok.", "hopto.", "zapto.", "serveo.", "myexternalip", "ipify", "ip-api", "icanhazip", "ifconfig.me", "checkip", "wtfismyip", ".onion", "dyndns", "portmap.io",
)
SYSTEM_PROCESSES = {
    "svchost.exe": ("\\windows\\system32\\", "\\windows\\syswow64\\"), "lsass.exe": ("\\windows\\system32\\",), "services.exe": ("\\windows\\system32\\",), "csrss.exe": ("\\windows\\system32\\",),
    "wininit.exe": ("\\windows\\system32\\",), "winlogon.exe": ("\\windows\\system32\\",), "smss.exe": ("\\windows\\system32\\",), "lsaiso.exe": ("\\windows\\system32\\",),
    "spoolsv.exe": ("\\windows\\system32\\",), "taskhostw.exe": ("\\windows\\system32\\",), "dllhost.exe": ("\\windows\\system32\\", "\\windows\\syswow64\\"), "conhost.exe": ("\\windows\\system32\\",),
    "explorer.exe": ("\\windows\\explorer.exe", "\\windows\\syswow64\\explorer.exe"), "rundll32.exe": ("\\windows\\system32\\", "\\windows\\syswow64\\"),
}
BULLETPROOF = ("aeza", "stark industries", "chang way", "flokinet", "njalla", "pq hosting", "mivocloud", "bucklog", "spectre operations", "railnet", "green floid")
DEFAULT_SHARES = ("admin$", "ipc$", "print$", "fax$", "netlogon", "sysvol")
HIGH = (
    "exec_from_staging", "lolbin", "masquerade", "servicedll_in_staging", "owner_in_staging", "suspicious_port", "vulnerable_driver", "code_consumer", "duplicate_mac", "estab_tor", "estab_bulletproof",
    "suspicious_ancestry", "staged_beacon", "staged_listener",
)
SPAWNERS = ("winword.exe", "excel.exe", "powerpnt.exe", "outlook.exe", "onenote.exe", "mspub.exe", "msaccess.exe", "visio.exe", "wordpad.exe", "acrord32.exe", "acrobat.exe", "chrome.exe", "firefox.exe", "msedge.exe", "iexplore.exe")
SPAWNED = ("cmd.exe", "powershell.exe", "pwsh.exe", "wscript.exe", "cscript.exe", "mshta.exe", "rundll32.exe", "regsvr32.exe", "bitsadmin.exe", "certutil.exe", "wmic.exe", "msbuild.exe", "installutil.exe", "curl.exe", "hh.exe")


def _any_of(text: Column, tokens: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, (F.contains(text, F.lit(t)) for t in tokens))


def norm_path(path: Column) -> Column:
    """A Windows path without quotes, lower-cased, with backslashes."""
    return F.replace(F.lower(F.regexp_replace(F.trim(F.coalesce(path, F.lit(""))), '^"+|"+$', "")), F.lit("/"), F.lit("\\"))


def in_staging(*paths: Column) -> Column:
    """Whether one of the paths lies in a folder that programs are staged in."""
    return reduce(lambda a, b: a | b, ((norm_path(p) != "") & _any_of(F.concat(F.lit("\\"), norm_path(p), F.lit("\\")), STAGING) for p in paths))


def is_lolbin(*commands: Column) -> Column:
    """Whether a command misuses a tool of the system."""
    return reduce(lambda a, b: a | b, (_any_of(F.lower(F.coalesce(c, F.lit(""))), LOLBIN) for c in commands))


def masquerades(name: Column, exe: Column) -> Column:
    """A system process's name outside of its folders."""
    path, low = norm_path(exe), F.lower(F.coalesce(name, F.lit("")))
    wrong = reduce(lambda a, b: a | b, ((low == n) & ~_any_of(path, dirs) for n, dirs in SYSTEM_PROCESSES.items()))
    return (path != "") & wrong


def _flags(*tests: tuple[Column, str]) -> Column:
    return F.array_compact(F.array(*(F.when(F.coalesce(t, F.lit(False)), F.lit(name)) for t, name in tests)))


def severity(flags: Column) -> Column:
    return F.when(F.arrays_overlap(flags, F.array(*(F.lit(x) for x in HIGH))), "high").otherwise("medium")


def owner_exe(rows: DataFrame, processes: DataFrame) -> DataFrame:
    """Connections or listeners with the program of their process."""
    p = processes.groupBy("host", F.col("Pid").alias("Pid")).agg(F.max("Exe").alias("owner_exe"))
    return rows.join(p, ["host", "Pid"], "left")


def duplicate_macs(arp: DataFrame) -> DataFrame:
    """(host, mac) that answers for several unicast IPv4 addresses."""
    mac = F.lower("RemoteMACAddress")
    real = arp.where((F.col("AddressFamily") == "IPv4") & ~F.coalesce(mac, F.lit("")).isin("", "ff-ff-ff-ff-ff-ff", "00-00-00-00-00-00") & ip_scope(F.col("RemoteAddress")).isin("private", "public"))
    return real.groupBy("host", mac.alias("mac")).agg(F.count_distinct("RemoteAddress").alias("n")).where("n >= 2").select("host", "mac")


def annotate(artifact: str, rows: DataFrame) -> DataFrame:
    """``rows`` of an artifact with ``flags``. Connections and listeners need ``owner_exe``; connections may carry
    ``origin`` and ``asn``; address tables need ``duplicate``."""
    has = set(rows.columns)
    c = lambda name: F.col(f"`{name}`") if name in has else F.lit(None).cast("string")
    tests = {
        "Windows.System.Pslist": lambda: _flags((in_staging(c("Exe")), "exec_from_staging"), (is_lolbin(c("CommandLine")), "lolbin"), (masquerades(c("Name"), c("Exe")), "masquerade")),
        "Windows.System.Services": lambda: _flags(
            (in_staging(F.coalesce(c("AbsoluteExePath"), c("PathName"))), "exec_from_staging"), (in_staging(c("ServiceDll")), "servicedll_in_staging"),
            (is_lolbin(F.coalesce(c("AbsoluteExePath"), c("PathName")), c("ServiceDll")), "lolbin"), (in_staging(c("FailureCommand")) | is_lolbin(c("FailureCommand")), "failure_command"),
        ),
        "Windows.System.TaskScheduler": lambda: _flags((in_staging(c("Command"), c("Arguments")), "exec_from_staging"), (is_lolbin(F.concat_ws(" ", c("Command"), c("Arguments"))), "lolbin")),
        "Windows.Sys.StartupItems": lambda: _flags((in_staging(c("Details")), "exec_from_staging"), (is_lolbin(c("Details")), "lolbin")),
        "Windows.Network.Netstat": lambda: _flags(
            ((c("Status") == "ESTAB") & in_staging(c("owner_exe")), "owner_in_staging"), ((c("Status") == "ESTAB") & (c("origin") == "tor"), "estab_tor"),
            ((c("Status") == "ESTAB") & _any_of(F.lower(F.coalesce(c("asn"), F.lit(""))), BULLETPROOF), "estab_bulletproof"),
        ),
        "Windows.Network.ListeningPorts": lambda: _flags((c("Port").isin(*BACKDOOR_PORTS), "suspicious_port"), (in_staging(c("owner_exe")), "owner_in_staging")),
        "Windows.System.Drivers": lambda: _flags((~c("IsSigned").cast("boolean"), "unsigned_driver"), (F.regexp_replace(basename(norm_path(F.coalesce(c("DriverName"), c("Name")))), r"\.sys$", "").isin(*VULNERABLE_DRIVERS), "vulnerable_driver")),
        "Windows.Persistence.PermanentWMIEvents": lambda: _flags((F.coalesce(c("CommandLineTemplate"), c("ScriptText"), c("ScriptFileName"), F.lit("")) != "", "code_consumer")),
        "Windows.System.DNSCache": lambda: _flags((_any_of(F.regexp_replace(F.lower(c("Name")), r"\.+$", ""), DYNAMIC_DNS), "recon_or_dyndns")),
        "Windows.Network.ArpCache": lambda: _flags(((c("AddressFamily") == "IPv4") & c("duplicate").cast("boolean"), "duplicate_mac")),
        "Windows.Sys.AllUsers": lambda: _flags((in_staging(c("Directory")), "nonstandard_profile_path")),
        "Windows.System.LocalAdmins": lambda: _flags(((F.lower(c("PrincipalSource")) == "local") & ~F.coalesce(c("SID"), F.lit("")).endswith("-500"), "local_account_admin")),
        "Windows.System.LoggedInUsers": lambda: _flags((c("LogonType") == 10, "rdp_session")),
        "Windows.System.HostsFile": lambda: _flags((F.trim(F.concat_ws("", c("Hostname"), c("Resolution"))) != "", "hosts_entry")),
        "Windows.System.Shares": lambda: _flags((~F.lower(c("Name")).isin(*DEFAULT_SHARES) & ~F.lower(c("Name")).rlike(r"^[a-z]\$$"), "non_default_share")),
    }
    return rows.withColumn("flags", tests[artifact]() if artifact in tests else F.array().cast("array<string>"))


def findings(artifacts: dict[str, DataFrame]) -> DataFrame:
    """All flagged rows: host, artifact, severity, flag, and the row as JSON; high ones first."""
    parts = [df.where(F.size("flags") > 0).select("host", F.lit(name).alias("artifact"), severity(F.col("flags")).alias("severity"), F.array_join("flags", "+").alias("flag"), F.to_json(F.struct(*(c for c in df.columns if c not in ("host", "flags")))).alias("fields")) for name, df in artifacts.items()]
    return reduce(DataFrame.unionByName, parts).orderBy(F.col("severity") != "high", "artifact", "flag")


def ancestry(processes: DataFrame, depth: int = 8, of: DataFrame | None = None) -> DataFrame:
    """(host, Pid, ancestry) with the names of a process and the parents above it, at most ``depth``, topmost first; loops
    end where they close. ``of`` (host, Pid): the processes that are asked for, else all.

    Paths double with each join, so eight generations take three; the last joins see only what is asked for.
    """
    label = F.concat(F.coalesce("Name", F.lit("?")), F.lit("("), F.col("Pid").cast("string"), F.lit(")"))
    step = F.struct(F.col("Pid").alias("p"), F.max(label).alias("l"))
    whole = processes.groupBy("host", "Pid").agg(F.max_by("Ppid", label).alias("up"), F.array(step).alias("path"))

    def above(low: DataFrame, high: DataFrame) -> DataFrame:
        more = high.select("host", F.col("Pid").alias("up"), F.col("up").alias("next"), F.col("path").alias("upper"))
        return low.join(more, ["host", "up"], "left").select("host", "Pid", F.col("next").alias("up"), F.concat("path", F.coalesce("upper", F.expr("slice(path, 1, 0)"))).alias("path"))

    step_length = 1
    while step_length * 2 <= depth // (1 if of is None else 2):
        whole, step_length = above(whole, whole), step_length * 2
    got, length = whole if of is None else whole.join(of.select("host", "Pid").distinct(), ["host", "Pid"], "left_semi"), step_length
    while length < depth:
        got, length = above(got, whole), length + step_length
    # up to where a process comes up again
    cut = F.expr("filter(sequence(2, greatest(size(path), 2)), i -> i <= size(path) and array_contains(transform(slice(path, 1, i - 1), x -> x.p), path[i - 1].p))")
    upward = F.slice("path", F.lit(1), F.least(F.lit(depth), F.coalesce(F.get(cut, F.lit(0)) - 1, F.size("path"))))
    return got.select("host", "Pid", F.reverse(F.transform(upward, lambda x: x["l"])).alias("ancestry"))


def launchers(processes: DataFrame, services: DataFrame, tasks: DataFrame, most: int | None = None) -> DataFrame:
    """(host, Pid, launched_by): the services of the process, else a service, else a task with its program. ``most`` limits
    how many services are named; the others are then counted."""
    keep = (1 << 31) - 1 if most is None else most
    name = F.coalesce("Name", "DisplayName", F.lit("?"))
    by_pid = services.where("Pid > 0").groupBy("host", "Pid").agg(F.array_sort(F.collect_set(name)).alias("s"))
    more = F.when(F.size("s") > keep, F.concat(F.lit(" (+"), (F.size("s") - keep).cast("string"), F.lit(")"))).otherwise("")
    by_pid = by_pid.select("host", "Pid", F.concat(F.lit("service: "), F.array_join(F.slice("s", 1, keep), ", "), more).alias("l1"))
    path = norm_path(F.coalesce("AbsoluteExePath", "PathName"))
    by_path = services.withColumn("exe", path).where("exe <> ''").groupBy("host", "exe").agg(F.concat(F.lit("service: "), F.min(name)).alias("l2"))
    task = tasks.withColumn("exe", norm_path(F.col("Command"))).where("exe <> ''").groupBy("host", "exe").agg(F.concat(F.lit("task: "), F.min(F.coalesce("TaskName", "Name"))).alias("l3"))
    p = processes.select("host", "Pid", norm_path(F.col("Exe")).alias("exe")).distinct()
    return p.join(by_pid, ["host", "Pid"], "left").join(by_path, ["host", "exe"], "left").join(task, ["host", "exe"], "left").select("host", "Pid", F.coalesce("l1", "l2", "l3").alias("launched_by")).where("launched_by is not null")


def correlate(processes: DataFrame, connections: DataFrame, listeners: DataFrame, services: DataFrame, tasks: DataFrame, most: int | None = None, cmdline: int | None = None) -> DataFrame:
    """An entity for each suspicious process of a host: its own flags, what it shows with its parent, connections and
    listeners, and ancestry, children, peers, ports and launcher. Inputs are annotated (``flags``). ``most`` limits each of
    these lists and ``cmdline`` the characters of the command line; they are whole by default. Rows without a Pid are left
    out of the lists; an empty table of any kind adds nothing."""
    keep = lambda c: F.array_sort(c) if most is None else F.slice(F.array_sort(c), 1, most)
    p = processes.withColumns({"staged": in_staging(F.col("Exe")), "lol": is_lolbin(F.col("CommandLine"))})
    parent = processes.groupBy("host", F.col("Pid").alias("Ppid")).agg(F.max(F.lower(F.trim("Name"))).alias("parent"))
    public = (F.col("Status") == "ESTAB") & (ip_scope(F.col("`Raddr.IP`")) == "public")
    peer = F.struct(F.col("`Raddr.IP`").alias("ip"), F.col("`Raddr.Port`").alias("port"), F.array_join("flags", "+").alias("flag"))
    net = connections.where("Pid is not null").groupBy("host", "Pid").agg(F.max(public).alias("beacons"), F.max(F.size("flags") > 0).alias("net_flagged"), keep(F.collect_set(F.when(public | (F.size("flags") > 0), peer))).alias("connections"))
    ears = listeners.where("Pid is not null").groupBy("host", "Pid").agg(F.lit(True).alias("listens"), F.max(F.size("flags") > 0).alias("ear_flagged"), keep(F.collect_set("Port")).alias("listening"))
    label = F.concat(F.coalesce("Name", F.lit("?")), F.lit("("), F.col("Pid").cast("string"), F.lit(")"))
    kids = processes.groupBy("host", F.col("Ppid").alias("Pid")).agg(keep(F.collect_set(label)).alias("children"))
    got = p.join(parent, ["host", "Ppid"], "left").join(net, ["host", "Pid"], "left").join(ears, ["host", "Pid"], "left")
    together = _flags(
        (F.col("parent").isin(*SPAWNERS) & F.lower(F.trim("Name")).isin(*SPAWNED), "suspicious_ancestry"),
        ((F.col("staged") | F.col("lol")) & F.col("beacons"), "staged_beacon"),
        (F.col("staged") & F.col("listens"), "staged_listener"),
    )
    got = got.withColumn("flags", F.array_sort(F.array_union("flags", together)))
    got = got.where((F.size("flags") > 0) | F.coalesce("net_flagged", F.lit(False)) | F.coalesce("ear_flagged", F.lit(False)))
    out = got.join(ancestry(processes, of=got), ["host", "Pid"], "left").join(kids, ["host", "Pid"], "left").join(launchers(processes, services, tasks, most), ["host", "Pid"], "left")
    return out.select("host", severity(F.col("flags")).alias("severity"), "Pid", "Ppid", "Name", "Exe", (F.col("CommandLine") if cmdline is None else F.left("CommandLine", F.lit(cmdline))).alias("cmdline"), "flags", "ancestry", "children", "connections", "listening", "launched_by")


def vulnerable_drivers(files: DataFrame, hashes: DataFrame) -> DataFrame:
    """Program inventory rows (SHA1 with four leading zeros, Name, FullPath) whose hash is of a known driver (sha1, driver,
    category), once for each hash."""
    sha = F.lower(F.when((F.length("SHA1") == 44) & F.col("SHA1").startswith("0000"), F.substring("SHA1", 5, 40)).otherwise(F.col("SHA1")))
    return files.withColumn("sha1", sha).join(hashes.withColumn("sha1", F.lower("sha1")), "sha1").dropDuplicates(["sha1"])


def remote_tools(files: DataFrame, tools: DataFrame) -> DataFrame:
    """Inventory rows of remote-management tools (rank, tool, files array, parts array): by file name or part of the path;
    the first tool counts."""
    rows = files.withColumns({"__base": F.lower(basename(F.col("FullPath"))), "__low": F.lower("FullPath")})
    names = tools.select("rank", "tool", F.explode("files").alias("__base")).withColumn("__base", F.lower("__base"))
    parts = tools.select("rank", "tool", F.explode("parts").alias("part"))
    by_name = rows.join(names, "__base").select("FullPath", "rank", "tool")
    by_part = rows.join(parts, F.contains(F.col("__low"), F.lower("part"))).select("FullPath", "rank", "tool")  # a list of parts is a few rows
    best = by_name.union(by_part).groupBy("FullPath").agg(F.min_by("tool", F.struct("rank", "tool")).alias("tool"))
    return files.join(best, "FullPath")


def staged_system_tools(files: DataFrame, names: DataFrame) -> DataFrame:
    """Inventory rows in a staging folder that bear the name of a tool of the system (name)."""
    rows = files.where(in_staging(F.col("FullPath"))).withColumn("name", F.lower(basename(F.col("FullPath"))))
    return rows.join(names.select(F.lower("name").alias("name")), "name", "left_semi")


def encoded_strings(events: DataFrame, text: str = "payload", least: int = 24) -> DataFrame:
    """Base64 runs in event payloads that decode to printable text."""
    found = events.withColumn("encoded", F.explode(F.regexp_extract_all(F.col(text), F.lit(rf"[A-Za-z0-9+/]{{{least},}}={{0,2}}"), F.lit(0))))
    plain = F.decode(F.try_to_binary("encoded", F.lit("base64")), "utf-8")
    return found.withColumn("decoded", F.replace(plain, F.lit("\u0000"), F.lit(""))).where(F.col("decoded").rlike(r"^[\x20-\x7e\s]{8,}$"))
