from __future__ import annotations

from pyspark.sql import functions as F

from emberlog.operators import artifacts as a


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_activities(spark):
    app = '[{"application":"x","platform":"web"},{"application":"{1AC14E77-02E7-4E5D-B744-2EB1AE5198B7}\\\\cmd.exe","platform":"windows_win32"}]'
    df = spark.createDataFrame([("h", "u", 5, app, '{"displayText":"T","contentUri":"file:///C:/a%20b.txt?x=1"}', 1700000000), ("h", "u", 99, "junk", "junk", 0)], "host string, user string, type int, app_id string, payload string, start_time long")
    assert rows(a.activities(df).withColumn("t", F.col("start_utc").cast("string")), "kind", "app", "content", "t") == [("99", "", "", None), ("Open", "%System32%\\cmd.exe", "T | C:\\a b.txt", "2023-11-14 22:13:20")]


def test_policies(spark, lines):
    g = "{6D809377-6AF0-444B-8957-A3773F02200E}"
    df = spark.createDataFrame([("h", f"/sysvol/a/{g}/Machine/Preferences/Groups/Groups.xml", "n", "U", "r", "", "xyz"), ("h", f"/sysvol/b/{g}/Machine/Preferences/Groups/Groups.xml", "n", "2", "r", "", "xyz"), ("h", "/other.xml", "n", "U", "", "", "")], "host string, path string, name string, action string, run_as string, command string, cpassword string")
    assert rows(a.policy_items(df), "gpo", "file", "action", "has_password") == [(g, "groups/groups.xml", "Update", True)]
    got = a.policy_scripts(lines(("s", "[Startup]"), ("s", "0CmdLine=a.bat"), ("s", "0Parameters=-x"), ("s", "[Logon]"), ("s", "0CmdLine=b.bat"), ("s", "1Parameters=-z")))
    assert rows(got, "section", "number", "command") == [("Logon", 0, "b.bat"), ("Startup", 0, "a.bat -x")]


def test_usage_and_input(spark):
    df = spark.createDataFrame([("h", "C:\\a\x01", "x.exe", "20240101100000.000000+060")] * 2, "host string, folder_path string, explorer_file_name string, last_used_time string")
    assert rows(a.recently_used(df).withColumn("t", F.col("last_used_utc").cast("string")), "folder", "file", "t") == [("C:\\a", "x.exe", "2024-01-01 09:00:00")]
    k = "Software\\Explorer\\"
    v = spark.createDataFrame([("h", "u", k + "WordWheelQuery", "1", "secret", [1, 0], "t1"), ("h", "u", k + "WordWheelQuery", "0", "old", [1, 0], "t1"), ("h", "u", k + "TypedPaths", "url2", "\\\\srv\\x", None, "t2")], "host string, user string, key string, name string, data string, order array<int>, key_time string")
    assert rows(a.explorer_input(v), "kind", "order", "value", "key_last_write_utc") == [("search", 0, "secret", "t1"), ("search", 1, "old", None), ("typed_path", 1, "\\\\srv\\x", None)]
    b = spark.createDataFrame([("h", "C", "F"), ("h", "C", "F"), ("h", "BVTConsumer", "BVTFilter")], "host string, consumer string, filter string")
    c = spark.createDataFrame([("h", "C", "CommandLine", "evil.exe")], "host string, name string, type string, detail string")
    f = spark.createDataFrame([("h", "F", "SELECT *")], "host string, name string, query string")
    assert rows(a.consumer_bindings(b, c, f), "binding", "detail", "query", "note") == [("BVTConsumer-BVTFilter", None, None, "common (likely legitimate)"), ("C-F", "evil.exe", "SELECT *", "")]


def test_host_lists_and_webshells(spark, lines):
    got = a.defender_state(lines(("mdatp_health.txt", 'healthy : false'), ("mdatp_health.txt", 'app_version : "1.2"'), ("mdatp_threat_list.txt", "===="), ("mdatp_threat_list.txt", "EICAR"), ("mdatp_exclusion_list.txt", "No exclusions")))
    assert rows(got, "category", "item", "detail", "suspicious") == [("health", "app_version", "1.2", False), ("health", "healthy", "false", True), ("threat", "", "EICAR", True)]
    got = a.file_anomalies(lines(("hidden_files.txt", "/tmp/.x"), ("getcap_-r.txt", "/usr/bin/ping cap_net_raw=ep"), ("world_writable_files.txt", "/srv/a.jpg"), ("world_writable_files.txt", "/srv/a.sh"), ("world_writable_directories.txt", "/home/x"), ("world_writable_directories.txt", "/etc/x")))
    assert rows(got, "indicator", "file", "suspicious") == [("file_capability", "/usr/bin/ping", False), ("hidden_file", "/tmp/.x", True), ("world_writable_dir", "/etc/x", True), ("world_writable_file", "/srv/a.sh", True)]
    files = spark.createDataFrame([("h", "/var/www/a.php", "<?php\n  eval(base64_decode($x)); ?>"), ("h", "/var/www/b.php", "fine"), ("h", "/home/a.php", "eval($_GET[1])"), ("h", "/var/www/.htaccess", "# c\nAddType application/x-httpd-php .jpg")], "host string, path string, content string")
    assert rows(a.webshells(files), "path", "indicators", "snippet") == [("/var/www/.htaccess", "htaccess_handler", "AddType application/x-httpd-php .jpg"), ("/var/www/a.php", "input_to_exec", "eval(base64_decode($x)); ?>")]
