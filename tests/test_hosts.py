"""Host descriptions, sources, loaders and the smaller normalisers, on rows with known outcomes."""

from __future__ import annotations

import bz2
import gzip
import lzma

import pytest
from pyspark.sql import functions as F

from emberlog.functions import strings
from emberlog.operators import host_state, logons, logs, merge, rules, web
from emberlog.sources import files, lookups


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_time_stamps_as_instants(spark):
    given = {"2026-05-19T10:15:03+02:00": "2026-05-19 08:15:03", "2026-05-19 10:15:03": "2026-05-19 10:15:03", "2026-05-19 23:15:03.123 -0330": "2026-05-20 02:45:03", "May 19 10:15:03": None, "": None, None: None}
    df = spark.createDataFrame([(k,) for k in given], "t string").select("t", F.date_format(strings.as_utc(F.col("t")), "yyyy-MM-dd HH:mm:ss").alias("u"))
    assert {r.t: r.u for r in df.collect()} == given


def test_linux_machine_info(spark, lines):
    df = lines(
        ("network/hostnamectl.txt", " Static hostname: box"), ("network/hostnamectl.txt", "Operating System: Debian 12"), ("network/hostnamectl.txt", "  Kernel: Linux 6.1"), ("hardware/lscpu.txt", "CPU(s):  8"),
        ("hardware/lscpu.txt", "Model name: X"), ("system/free.txt", "Mem:   16777216  1 2"), ("system/last.txt", "reboot   system boot  6.1 Mon May 18 09:00"), ("network/ip_addr_show.txt", "    inet 10.0.0.5/24 scope global"),
        ("network/ip_addr_show.txt", "inet 127.0.0.1/8"), ("network/ip_addr_show.txt", "inet6 fe80::1/64"), ("network/ifconfig_-a.txt", "inet 192.0.2.9"), ("etc/passwd", "ann:x:1:1::/home/ann:/bin/bash"),
        ("etc/passwd", "bin:x:2:2::/bin:/usr/sbin/nologin"), ("etc/passwd", "+::::::"), ("system/date.txt", "Tue May 26 16:12:19 CEST 2026"),
    )
    (got,) = host_state.linux_machine_info(df).collect()
    assert (got.machine_name, got.product_name, got.build, got.cpu, got.cpu_count, got.memory, got.boot_time, got.ips, got.users, got.timezone) == ("box", "Debian 12", "Linux 6.1", "X", "8", "16.0 GiB", "Mon May 18 09:00", ["10.0.0.5"], ["ann"], "CEST")
    assert host_state.linux_machine_info(df.limit(0)).count() == 0
    bare = host_state.linux_machine_info(lines(("etc/os-release", 'PRETTY_NAME="Alpine 3"'), host="h9")).first()
    assert (bare.machine_name, bare.product_name, bare.ips) == ("h9", "Alpine 3", [])


def test_windows_machine_info(spark):
    cs = "HKLM\\SYSTEM\\ControlSet001"
    df = spark.createDataFrame(
        [("h", "HKLM\\SOFTWARE\\Microsoft\\Windows NT\\CurrentVersion", "ProductName", "Windows 10"), ("h", "HKLM\\SOFTWARE\\Microsoft\\Windows NT\\CurrentVersion", "ReleaseId", "2009"), ("h", f"{cs}\\Control\\ComputerName\\ComputerName", "ComputerName", "PC1"),
         ("h", f"{cs}\\Services\\Tcpip\\Parameters", "Hostname", "pc1"), ("h", f"{cs}\\Services\\Tcpip\\Parameters", "NV Domain", "corp.local"), ("h", f"{cs}\\Services\\Tcpip\\Parameters\\Interfaces\\{{1}}", "IPAddress", "10.0.0.7 0.0.0.0"),
         ("h", "HKLM\\SOFTWARE\\Microsoft\\Windows NT\\CurrentVersion\\ProfileList\\S-1-5-21-7", "ProfileImagePath", "C:\\Users\\ann"), ("i", "HKLM\\x", "y", None)], "host string, key string, name string, data string")
    got = {r.host: r for r in host_state.windows_machine_info(df).collect()}
    assert (got["h"].product_name, got["h"].release, got["h"].machine_name, got["h"].fqdn, got["h"].ips, got["h"].users) == ("Windows 10", "2009", "PC1", "pc1.corp.local", ["10.0.0.7"], {"ann": "S-1-5-21-7"})
    assert got["i"].machine_name == "" and got["i"].users is None


def test_sessions_keys_and_downloads(spark, lines):
    got = rows(host_state.sessions(lines(("who", "ann + pts/0 May 19 10:00 (10.0.0.9)"), ("who", "bob tty1 May 19 11:00"), ("who", "short line"))), "user", "tty", "at_local", "source")
    assert got == [("ann", "pts/0", "May 19 10:00", "10.0.0.9"), ("bob", "tty1", "May 19 11:00", "local")]
    keys = spark.createDataFrame([("h", "ann", "ssh-rsa AAAA me@x"), ("h", "ann", "# no"), ("h", "ann", "ssh-ed25519 BBBB"), ("h", "ann", None)], "host string, account string, line string")
    assert rows(logs.ssh_keys(keys), "key_type", "comment") == [("ssh-ed25519", ""), ("ssh-rsa", "me@x")]
    df = spark.createDataFrame([("h", "u", "Chrome", "C:\\a\u0000.exe", "http://x", 5, 13300000000000000, 0)], "host string, user string, browser string, target_path string, tab_url string, total_bytes long, start_time long, end_time long")
    (r,) = host_state.browser_downloads(df).collect()
    assert r.target == "C:\\a.exe" and r.start_utc.year == 2022 and r.end_utc is None


def test_registry_and_unit_vectors(spark, lines):
    df = spark.createDataFrame(
        [("HKLM\\SYSTEM\\ControlSet001\\Control\\Lsa", "Security Packages", "kerberos msv1_0 evil"), ("HKLM\\SYSTEM\\ControlSet001\\Control\\Lsa", "Authentication Packages", 'msv1_0 ""'), ("HKLM\\SOFTWARE\\Microsoft\\Command Processor", "AutoRun", "calc"),
         ("HKLM\\SYSTEM\\ControlSet001\\Services\\W32Time\\TimeProviders\\X", "DllName", "C:\\Windows\\Temp\\t.dll"), ("HKLM\\SYSTEM\\ControlSet001\\Services\\W32Time\\TimeProviders\\Y", "DllName", "%systemroot%\\system32\\w32time.dll")], "key string, name string, data string").withColumn("host", F.lit("h"))
    assert rows(host_state.registry_autostarts(df), "vector", "suspicious") == [("cmd_autorun", True), ("lsa_package", True), ("time_provider", True)]
    got = host_state.persistence(lines(
        ("/etc/systemd/system/a.service", "ExecStart=/opt/a"), ("/etc/systemd/system/a.service", "Description=curl x"), ("/usr/lib/systemd/system/b.service", "ExecStart=/usr/bin/b"), ("/usr/lib/systemd/system/b.service", "ExecStart=/tmp/b"),
        ("/home/u/.config/systemd/user/c.timer", "OnCalendar=daily"), ("/home/u/.config/systemd/user/c.timer", "[Unit]"), ("/etc/systemd/system/d.service.d/x.conf", "ExecStartPre=/opt/d"), ("/etc/systemd/system/e.service", "Unit=x.service"),
    ))
    assert rows(got, "vector", "entry", "suspicious") == [("systemd_service", "ExecStart=/opt/a", False), ("systemd_service", "ExecStart=/tmp/b", True), ("systemd_service", "ExecStartPre=/opt/d", False), ("systemd_timer", "OnCalendar=daily", False), ("systemd_timer", "Unit=x.service", False)]


def test_audit_daemon_and_rules(spark, lines):
    (r,) = host_state.audit_daemon(lines(("auditd.conf", "# c"), ("auditd.conf", "write_logs = yes"), ("auditd.conf", "write_logs = no"), ("auditd.conf", "log_file = /x"))).collect()
    assert (r.weakened, r.suspicious, r.log_file) == (["write_logs=no", "log_file=/x"], True, "/x")
    before, now = lines(("p", "-w /etc/passwd -p wa"), ("p", "-w /etc/group")), lines(("p", "-w /etc/group"), ("p", "-w  /etc/new"))
    assert rows(host_state.audit_rule_changes(before, now), "kind", "rule") == [("rule_added", "-w /etc/new"), ("rule_removed", "-w /etc/passwd -p wa")]


def test_host_of_an_event_collection(spark):
    df = spark.createDataFrame([("d", "PC2.corp"), ("d", "PC1.corp.local"), ("d", "PC1"), ("d", "PC2"), ("d", None), ("e", "")], "drop string, Computer string")
    assert rows(host_state.event_hosts(df), "drop", "host") == [("d", "PC1")]


def test_orders_of_edges_chains_and_hunts(spark):
    e = spark.createDataFrame([("b", "y", ["r"]), ("a", "y", ["r"]), ("c", "y", ["r", "s"]), ("d", "y", [])], "src string, dst string, reasons array<string>").withColumns({"user": F.lit("u"), "event_id": F.lit("1"), "logon_type": F.lit(3)})
    assert [r.src for r in logons.by_reasons(e).collect()] == ["c", "a", "b", "d"]
    c = spark.createDataFrame([("2024-01-02", "x2"), ("2024-01-01", "x1"), ("2024-01-03", "x3")], "t string, x string").select(F.to_timestamp("t").alias("t_in"), F.to_timestamp("t").alias("t_out"), F.lit("u").alias("u"), "x", F.lit("b").alias("b"), F.lit("y").alias("y"))
    assert [r.x for r in logons.earliest_chains(c, 2).collect()] == ["x1", "x2"]
    h = spark.createDataFrame([("2024-01-01", "1"), ("2024-01-03", "3"), ("2024-01-02", "2")], "time string, ip string").withColumns({"path": F.lit(""), "query": F.lit("")})
    assert [r.ip for r in web.newest_first(h).collect()] == ["3", "2", "1"]


def test_chains_like_all_pairs(spark):
    import itertools
    import random
    from datetime import datetime, timedelta

    rng = random.Random(3)
    t0 = datetime(2024, 1, 1)
    data = [(rng.choice("ABC"), rng.choice("BCD"), rng.choice(["C\\u1", "u2", "", "m$"]), 3, rng.choice(["4624", "4648"]), "ok", t0 + timedelta(seconds=rng.randrange(40_000), microseconds=rng.randrange(10**6)), True, True) for _ in range(700)]
    data = [d for d in data if d[0] != d[1]]
    times = spark.createDataFrame(data, "src string, dst string, user string, logon_type int, event_id string, status string, ts timestamp, src_case boolean, dst_case boolean")
    short = lambda u: u.rpartition("\\")[2].lower()
    sec = lambda t: int((t - t0).total_seconds())
    best = {}
    for i, o in itertools.product(data, data):
        ui, uo = short(i[2]), short(o[2])
        gap = sec(o[6]) - sec(i[6])
        if i[4] == "4624" and ui and not ui.endswith("$") and not uo.endswith("$") and i[1] == o[0] and i[0] != o[1] and ((uo == ui and 0 <= gap <= 3000) or (not uo and 0 <= gap <= 700)):
            k, v = (ui, i[0], i[1], o[1]), (o[6], t0 - i[6], i[6])
            best[k] = min(best.get(k, v), v)
    got = {(r.u, r.x, r.b, r.y): (r.t_out, r.t_in) for r in logons.pivot_chains(times, 3000, 700).collect()}
    assert got == {k: (v[0], v[2]) for k, v in best.items()} and len(got) > 10


def test_latest_before_over_stretches(spark):
    import random

    rng = random.Random(4)
    left = [(rng.choice("ab"), rng.randrange(1000), i) for i in range(60)] + [("a", None, 99), (None, 5, 98)]
    right = [(rng.choice("abc"), rng.randrange(1000), i) for i in range(60)]
    at = lambda d, c: spark.createDataFrame(d, f"k string, s int, {c} int").withColumn("ts", F.timestamp_seconds("s"))
    for stretch in (50, 86400):
        got = {r.r: r.before_l for r in logons.latest_before(at(left, "l"), at(right, "r"), ["k"], "ts", "ts", ["l"], stretch).collect()}
        want = {i: max(c)[1] for k, s, i in right if (c := [(t, n) for j, t, n in left if j == k and t is not None and t <= s])}
        assert got == want


def test_lines_of_files(spark, tmp_path):
    body = "".join(f"line {i}\r\n" for i in range(5000))
    (tmp_path / "a").mkdir()
    (tmp_path / "a/x.log").write_text(body)
    with gzip.open(tmp_path / "a/x.log.1.gz", "wt") as f:
        f.write("old 1\nold 2\n")
    with bz2.open(tmp_path / "a/x.log.2.bz2", "wt") as f:
        f.write("older\n")
    (tmp_path / "a/bad.txt").write_bytes(b"caf\xe9\n")
    (tmp_path / "a/empty.log").write_text("")
    got = files.read_lines(spark, str(tmp_path / "a"))
    assert {r.command for r in got.where("line like 'caf%'").collect()} == {"bad"} and got.count() == 5004
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8192")  # several splits a file
    try:
        n = files.numbered(spark, str(tmp_path / "a")).where("path like '%/x.log'")
        assert n.count() == 5000 and n.where("line <> concat('line ', line_no - 1)").count() == 0
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    order = files.in_rotation_order(files.numbered(spark, str(tmp_path / "a")).where("path like '%/x.log%'"))
    assert [r.line for r in order.orderBy("seq").limit(4).collect()] == ["older", "old 1", "old 2", "line 0"]
    assert files.within_budget(files.numbered(spark, str(tmp_path / "a")), 10).groupBy().agg(F.count("*"), F.max("line")).first()[0] == 10
    assert files.newest_lines(files.numbered(spark, str(tmp_path / "a")), 3).count() == 3


def test_xz_and_marked_files(spark, tmp_path):
    text = "".join(f"row {i}\n" for i in range(30_000)) + "tail"
    (tmp_path / "b.log.xz").write_bytes(lzma.compress(text.encode()))
    (tmp_path / "c.log.xz").write_bytes(lzma.compress(text.encode())[:3000])
    got = files.read_xz_lines(spark, str(tmp_path))
    whole = got.where("path like '%b.log.xz'")
    assert whole.count() == 30_001 and whole.where("line_no <= 30000 and line <> concat('row ', line_no - 1)").count() == 0
    assert got.where("path like '%c.log.xz'").count() < 30_001
    (tmp_path / "r.wer").write_bytes("EventType=APPCRASH\r\nSig[0].Name=Application Name\r\nSig[0].Value=a.exe\r\nEventTime=133000000000000000\r\n".encode("utf-16"))
    (r,) = host_state.error_reports(files.decoded_lines(spark, str(tmp_path), "*.wer")).collect()
    assert (r.event_type, r.app_name, r.event_time_utc.year) == ("APPCRASH", "a.exe", 2022)


def test_delimited_and_json_files(spark, tmp_path):
    (tmp_path / "t").mkdir()
    (tmp_path / "t/a.csv").write_text("x,y\n1,2\n3,4\n")
    (tmp_path / "t/b.txt").write_bytes(b"x|z\n5|\xe9\n")
    (tmp_path / "t/c.txt").write_text("nothing here\n")
    got, bad = files.read_any_delimited(spark, str(tmp_path / "t"))
    assert sorted((r.x, r.y, r.z) for r in got.collect()) == [("1", "2", None), ("3", "4", None), ("5", None, "é")] and [r.path[-5:] for r in bad.collect()] == ["c.txt"]
    (tmp_path / "f.json").write_text('{"findings": [{"a": 1, "b": {"c": 2}}, {"a": 3, "b": null}], "n": 5}')
    assert rows(files.read_json_table(spark, str(tmp_path / "f.json")).fillna("", ["b"]), "a", "b") == [(1, '{"c":2}'), (3, "")]
    (tmp_path / "Windows.System.Pslist.json").write_text('{"Pid": 4, "Name": "x"}\nbroken\n{"Pid": 5}\n')
    assert rows(files.read_artifact(spark, str(tmp_path / "Windows.System.Pslist.json"), "Pid INT, Name STRING").fillna(""), "Pid", "Name", "artifact") == [(4, "x", "Windows.System.Pslist"), (5, "", "Windows.System.Pslist")]
    files.write_table(got.withColumn("host", F.lit("h")), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).where("host = 'h'").count() == 3
    assert files.write_csv(got.limit(0), str(tmp_path / "none")) is False and not (tmp_path / "none").exists()
    assert files.write_csv(spark.createDataFrame([(True, ["a", "b"])], "f boolean, g array<string>"), str(tmp_path / "csv"))
    assert rows(spark.read.option("header", "true").csv(str(tmp_path / "csv")), "f", "g") == [("yes", "a+b")]
    assert files.table_names(["a b", "a-b", "A_B", "x" * 40, "x" * 41]) == {"a b": "a_b", "a-b": "a_b_1", "A_B": "A_B_2", "x" * 40: "x" * 31, "x" * 41: "x" * 29 + "_1"}


def test_events_by_channel(spark):
    df = spark.createDataFrame([("Microsoft-Windows-TerminalServices-LocalSessionManager/Operational", 21), ("System", 21), ("Microsoft-Windows-PowerShell/Operational", 4104), ("Windows PowerShell", 4104), (None, 21)], "Channel string, EventId int")
    assert files.events_of(df, "rdp_session").count() == 1 and files.events_of(df, "powershell_scripts").count() == 1 and files.events_of(df, "powershell").count() == 0


def test_lookup_lists(spark, tmp_path):
    (tmp_path / "tor").write_text("# list\n1.2.3.4\n\n1.2.3.4\n5.6.7.8\n")
    assert rows(lookups.tor_list(spark, str(tmp_path / "tor")), "ip") == [("1.2.3.4",), ("5.6.7.8",)]
    (tmp_path / "d.json").write_text('{"hashes": {"AB": {"n": "x.sys", "c": "vulnerable"}}}')
    assert rows(lookups.driver_hashes(spark, str(tmp_path / "d.json")), "sha1", "driver", "category") == [("ab", "x.sys", "vulnerable")]
    (tmp_path / "rmm.yaml").write_text('tools:\n  - name: "One"\n    files: [One.exe, two.exe]  # c\n    paths: ["\\\\one\\\\"]\n  - name: Empty\n  - name: Two\n    paths: [\'\\two\']\n')
    assert [(r.tool, r.files, r.parts) for r in lookups.tool_list(spark, str(tmp_path / "rmm.yaml")).orderBy("rank").collect()] == [("One", ["one.exe", "two.exe"], ["\\one\\"]), ("Two", [], ["\\two"])]
    (tmp_path / "l.yaml").write_text("binaries:\n  - Certutil.exe\n  - 'mshta.exe'\n")
    assert rows(lookups.name_list(spark, str(tmp_path / "l.yaml")), "name") == [("certutil.exe",), ("mshta.exe",)]


@pytest.mark.parametrize("size", [70_000, 1_000_000])
def test_long_request_lines_keep_what_lies_behind(spark, lines, size):
    line = f'9.9.9.1 - - [19/May/2026:09:11:17 +0000] "GET /a?x={"y" * size} HTTP/1.1" 200 5 "-" "ua" X-Forwarded-For="9.9.9.9, 10.0.0.1"'
    (r,) = web.parse_access(lines(("access.log", line))).collect()
    assert (r.ip, r.edge_ip, len(r.query), r.time, r.ua) == ("9.9.9.9", "9.9.9.1", size + 2, "2026-05-19 09:11:17 +0000", "ua")


def test_an_encoded_indicator_must_pass_raw(spark, lines):
    line = '1.1.1.1 - - [19/May/2026:09:11:17 +0000] "GET /%61dmin HTTP/1.1" 404 5 "-" "ua"'
    requests = web.parse_access(lines(("a", line), ("a", line.replace("%61", "a"))))
    assert rows(web.hunt(requests, [("adm", "/admin")]), "path", "flag") == [("/admin", "adm")]


def test_manifest_is_append_only(spark, tmp_path):
    listing = lambda *r: spark.createDataFrame([(p, d) for p, d in r], "rel_path string, sha256 string")
    at = str(tmp_path / "manifest")
    assert rows(merge.record_new(at, listing(("a", "1"), ("out/x", "2"), ("b", "3")), ("^out/",)), "rel_path") == [("a",), ("b",)]
    assert rows(merge.record_new(at, listing(("a", "changed"), ("c", "4"))), "rel_path") == [("c",)]
    assert rows(spark.read.parquet(at), "rel_path", "sha256") == [("a", "1"), ("b", "3"), ("c", "4")]


def test_orders_and_public_sessions(spark):
    df = spark.createDataFrame([("a", False), ("c", True), ("b", True)], "n string, suspicious boolean")
    assert [r.n for r in merge.flagged_first(df, "n").collect()] == ["b", "c", "a"]
    levels = spark.createDataFrame([("low",), ("odd",), ("critical",), ("HIGH",), (None,)], "level string")
    assert [r.level for r in levels.orderBy(rules.level_rank(F.col("level")), "level").collect()][:3] == ["critical", "HIGH", "low"]
    raw = spark.createDataFrame([("8.8.8.8", "h1", "u", 10, "4624", "ok", None, [])], "src string, dst string, user string, logon_type int, event_id string, status string, ts timestamp, reasons array<string>")
    hosts = spark.createDataFrame([("h1", "h1.corp", ["10.0.0.1"], "windows")], "host string, fqdn string, ips array<string>, os string")
    (e,) = logons.edges(raw, hosts).collect()
    assert e.reasons == ["rdp_public"] and e.first_seen is None and logons.edge_times(raw, hosts).count() == 0
