"""Decoded artifacts of Windows hosts and of web folders: activities, policies, usage, typed input, consumers, webshells."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.plan import computed_once
from ..functions.strings import cim_time, percent_decode

#: Activity types, and folders by their identifiers.
ACTIVITY_TYPES = {2: "Notification", 3: "Backup", 5: "Open", 6: "InFocus", 10: "Clipboard", 11: "CopyPaste", 16: "Copy"}
KNOWN_FOLDERS = {
    "{6D809377-6AF0-444B-8957-A3773F02200E}": "%ProgramFiles%", "{7C5A40EF-A0FB-4BFC-874A-C0F2E0B9FA8E}": "%ProgramFiles(x86)%", "{1AC14E77-02E7-4E5D-B744-2EB1AE5198B7}": "%System32%",
    "{F38BF404-1D43-42F2-9305-67DE0B28FC23}": "%Windir%", "{B4BFCC3A-DB2C-424C-B029-7FE99A87C641}": "%Desktop%", "{FDD39AD0-238F-46AF-ADB4-6C85480369C7}": "%Documents%",
    "{374DE290-123F-4565-9164-39C4925E467B}": "%Downloads%",
}
#: What the code of web shells holds, in order, and what hands requests to scripts.
WEBSHELLS = (
    ("input_to_exec", r"(?i)(?:eval|assert|system|exec|shell_exec|passthru|popen|proc_open|pcntl_exec)\s*\(\s*(?:@?\$_(?:GET|POST|REQUEST|COOKIE|SERVER)|base64_decode|gzinflate|gzuncompress|gzdecode|str_rot13)"),
    ("dynamic_call_on_input", r"(?i)@?\$_(?:GET|POST|REQUEST|COOKIE)\s*\[[^\]]*\]\s*\("),
    ("preg_replace_e", r"(?i)\bpreg_replace\s*\([^)]*?/[a-z]*e[a-z]*['\"]"),
    ("jsp_exec", r"\b(?:Runtime\.getRuntime\(\)\.exec|new\s+ProcessBuilder)\s*\("),
    ("asp_request_eval", r"(?i)\b(?:eval|execute)\s*\(\s*request"),
    ("wscript_shell", r"(?i)\bWScript\.Shell\b"),
    ("long_base64_blob", r"['\"][A-Za-z0-9+/]{256,}={0,2}['\"]"),
)
HANDLERS = r"(?i)auto_(?:pre|ap)pend_file|SetHandler[^\n]*php|AddType[^\n]*php|AddHandler[^\n]*php|php_value\s+auto_"
#: Names of scripts, and folders that web servers serve.
SCRIPTS = r"\.(php|php3|php4|php5|php7|phtml|phar|inc|jsp|jspx|jspf|asp|aspx|ashx|asmx|cfm|pl|cgi)$"
WEB_ROOTS = r"(^|/)(var/www|srv/www|usr/share/nginx|srv/http|usr/local/apache2/htdocs|opt/lampp/htdocs|home/[^/]+/public_html|root/public_html)/"
#: Endings of files that aren't run.
INERT = (
    "jpg", "jpeg", "png", "gif", "bmp", "svg", "ico", "webp", "tiff", "tif", "heic", "mp4", "mp3", "wav", "avi", "mov", "mkv", "flac", "ogg", "m4a", "webm", "pdf", "doc", "docx", "xls", "xlsx", "ppt",
    "pptx", "ppsx", "pps", "odt", "ods", "odp", "rtf", "csv", "tsv", "txt", "log", "md", "css", "js", "map", "less", "scss", "woff", "woff2", "ttf", "eot", "otf", "zip", "gz", "tar", "bz2", "xz", "7z",
    "rar", "json", "xml", "yaml", "yml", "po", "mo", "sql", "dat", "html", "htm",
)


def activities(rows: DataFrame) -> DataFrame:
    """Activity records (host, user, type, app_id JSON, payload JSON, start_time): kind, app (desktop programs first, folder
    identifiers named), content (title and file)."""
    apps = F.from_json("app_id", "array<struct<application:string,platform:string>>")
    real = F.filter(apps, lambda x: ~F.coalesce(F.trim(x["application"]), F.lit("")).isin("", "data_boundary"))
    desktop = F.filter(real, lambda x: x["platform"] == "windows_win32")
    first = lambda a: F.trim(F.try_element_at(a, F.lit(1))["application"])
    got = computed_once(rows, {"app": F.coalesce(first(desktop), first(real), F.lit("")), "title": F.trim(F.coalesce(F.nullif(F.get_json_object("payload", "$.displayText"), F.lit("")), F.get_json_object("payload", "$.appDisplayName"), F.lit(""))), "uri": F.trim(F.coalesce(F.get_json_object("payload", "$.contentUri"), F.lit("")))})
    app = F.col("app")
    for guid, folder in reversed(KNOWN_FOLDERS.items()):
        app = F.when(F.contains(F.upper("app"), F.lit(guid)), F.regexp_replace("app", r"\{[0-9A-Fa-f\-]{36}\}", folder.replace("$", r"\$"))).otherwise(app)
    path = F.replace(percent_decode(F.regexp_replace(F.substring_index("uri", "?", 1), r"(?i)^file:/*", "")), F.lit("/"), F.lit("\\"))
    file = F.when(F.lower("uri").startswith("file:"), path).otherwise("")
    kind = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for pair in ACTIVITY_TYPES.items() for x in pair)), F.col("type").cast("int")), F.col("type").cast("string"))
    content = F.array_join(F.filter(F.array("title", file), lambda x: x != ""), " | ")
    return got.select("host", "user", kind.alias("kind"), app.alias("app"), content.alias("content"), F.when(F.col("start_time") > 0, F.timestamp_seconds("start_time")).alias("start_utc"))


def policy_items(items: DataFrame) -> DataFrame:
    """Preference items of group policies (path, name, action, run_as, command, cpassword), one for each policy and file
    however often the tree is mirrored. A stored password is told of, not decrypted."""
    gpo = F.regexp_extract("path", r"(\{[0-9A-Fa-f\-]{36}\})", 1)
    low = F.replace(F.lower("path"), F.lit("\\"), F.lit("/"))
    rel = F.regexp_extract(low, r"/preferences/(.*)$", 1)
    actions = F.create_map(*(F.lit(x) for x in ("C", "Create", "R", "Replace", "U", "Update", "D", "Delete", "0", "Create", "1", "Replace", "2", "Update", "3", "Delete")))
    got = items.where(low.contains("/preferences/")).select("host", gpo.alias("gpo"), rel.alias("file"), "name", F.coalesce(F.try_element_at(actions, F.col("action")), F.col("action")).alias("action"), "run_as", "command", (F.coalesce(F.trim("cpassword"), F.lit("")) != "").alias("has_password"))
    return got.dropDuplicates()


def policy_scripts(lines: DataFrame) -> DataFrame:
    """Start-up and logon scripts of scripts.ini: section, number, command with its parameters."""
    from pyspark.sql.window import Window

    section = F.last(F.when(F.col("line").rlike(r"^\s*\["), F.regexp_extract("line", r"\[([^\]]*)\]", 1)), ignorenulls=True).over(Window.partitionBy("host", "path").orderBy("line_no"))
    rx = r"(?i)^\s*(\d+)(CmdLine|Parameters)\s*=\s*(.*)$"
    got = lines.withColumn("section", section).where(F.col("line").rlike(rx))
    value = lambda which: F.max(F.when(F.lower(F.regexp_extract("line", rx, 2)) == which, F.trim(F.regexp_extract("line", rx, 3))))
    out = got.groupBy("host", "path", "section", F.regexp_extract("line", rx, 1).cast("int").alias("number")).agg(value("cmdline").alias("c"), value("parameters").alias("p"))
    return out.where("c is not null").select("host", "path", "section", "number", F.trim(F.concat_ws(" ", "c", "p")).alias("command"))


def recently_used(records: DataFrame) -> DataFrame:
    """Usage records (host, folder_path, explorer_file_name, last_used_time): times with their offset applied, once each."""
    clean = lambda c: F.trim(F.regexp_replace(c, r"[^\x20-\x7e]", ""))
    return records.select("host", clean("folder_path").alias("folder"), clean("explorer_file_name").alias("file"), cim_time(F.col("last_used_time")).alias("last_used_utc")).dropDuplicates()


def explorer_input(values: DataFrame) -> DataFrame:
    """What users typed, of registry values (host, user, key, name, data, order array, key_time): searches in their order
    and typed paths. A key's time belongs to its newest entry."""
    search = values.where(F.lower("key").endswith("\\wordwheelquery") & F.col("name").rlike(r"^\d+$"))
    at = F.array_position("order", F.col("name").cast("int")) - 1
    one = search.select("host", "user", F.lit("search").alias("kind"), F.when(at >= 0, at.cast("int")).alias("order"), F.col("data").alias("value"), "key_time")
    typed = values.where(F.lower("key").endswith("\\typedpaths") & F.col("name").rlike(r"(?i)^url\d+$") & (F.trim("data") != ""))
    two = typed.select("host", "user", F.lit("typed_path").alias("kind"), (F.regexp_extract("name", r"(\d+)$", 1).cast("int") - 1).alias("order"), F.trim("data").alias("value"), "key_time")
    return one.unionByName(two).withColumn("key_last_write_utc", F.when(F.col("order") == 0, F.col("key_time"))).drop("key_time")


def consumer_bindings(bindings: DataFrame, consumers: DataFrame, filters: DataFrame, common: list[str] | None = None) -> DataFrame:
    """Event consumers and the filters that they are bound to, with their details; bindings that are known are noted."""
    c = consumers.groupBy("host", F.col("name").alias("consumer")).agg(F.max("type").alias("type"), F.max("detail").alias("detail"))
    f = filters.groupBy("host", F.col("name").alias("filter")).agg(F.max("query").alias("query"))
    binding = F.concat_ws("-", "consumer", "filter")
    note = F.when(binding.isin(*(common or ["BVTConsumer-BVTFilter", "SCM Event Log Consumer-SCM Event Log Filter"])), "common (likely legitimate)").otherwise("")
    return bindings.distinct().join(c, ["host", "consumer"], "left").join(f, ["host", "filter"], "left").select("host", binding.alias("binding"), "consumer", "type", "detail", "filter", "query", note.alias("note"))


def defender_state(lines: DataFrame) -> DataFrame:
    """Health, threats, quarantine and exclusions of the antivirus: category, item, detail, suspicious."""
    health = r"^\s*([^:]*?)\s*:\s*\"?(.*?)\"?\s*$"
    key, value = F.regexp_extract("line", health, 1), F.regexp_extract("line", health, 2)
    wanted = ("healthy", "real_time_protection_enabled", "passive_mode_enabled", "definitions_status", "licensed", "release_ring", "app_version", "engine_version")
    off = ((key == "healthy") & (F.lower(value) != "true")) | ((key == "real_time_protection_enabled") & (F.lower(value) == "false")) | ((key == "passive_mode_enabled") & (F.lower(value) == "true"))
    one = lines.where(F.col("path").contains("health") & key.isin(*wanted)).select("host", F.lit("health").alias("category"), key.alias("item"), value.alias("detail"), off.alias("suspicious"))
    text = F.trim("line")
    kind = F.when(F.col("path").contains("quarantine"), "quarantine").when(F.col("path").contains("threat"), "threat").when(F.col("path").contains("exclusion"), "exclusion")
    two = lines.where(kind.isNotNull() & (text != "") & ~F.lower(text).rlike("^no (threat|exclusion|quarantine)") & ~text.rlike("^=+$")).select("host", kind.alias("category"), F.lit("").alias("item"), text.alias("detail"), F.lit(True).alias("suspicious"))
    return one.unionByName(two)


def file_anomalies(lines: DataFrame) -> DataFrame:
    """Files that stand out, from lists named by ``path``: hidden, without owner, with capabilities, writable for all."""
    text = F.trim("line")
    label = (
        F.when(F.col("path").endswith("hidden_files.txt"), "hidden_file").when(F.col("path").endswith("hidden_directories.txt"), "hidden_dir").when(F.col("path").endswith("group_name_unknown_files.txt"), "unknown_group_owner")
        .when(F.col("path").endswith("user_name_unknown_files.txt"), "unknown_user_owner").when(F.col("path").contains("getcap"), "file_capability").when(F.col("path").endswith("world_writable_files.txt"), "world_writable_file")
        .when(F.col("path").endswith("world_writable_directories.txt"), "world_writable_dir")
    )
    capability = F.col("indicator") == "file_capability"
    got = lines.select("host", label.alias("indicator"), text.alias("t")).where("indicator is not null and t <> ''")
    got = computed_once(got, {"file": F.when(capability, F.substring_index("t", " ", 1)).otherwise(F.col("t")), "detail": F.when(capability, F.trim(F.regexp_extract("t", r"^\S+ (.*)$", 1))).otherwise("")})
    snapshot = F.col("file").rlike(r"/\.snapshots/\d+/snapshot/|/\.zfs/snapshot/")
    ending = F.lower(F.regexp_extract("file", r"\.([^./]*)$", 1))
    writable = (F.col("indicator") == "world_writable_file") & ~snapshot & ~F.col("file").rlike(r"^(/tmp/|/var/tmp/|/dev/shm/|/run/|/var/run/|/var/lock/|/var/spool/|/dev/mqueue/)") & ~ending.isin(*INERT)
    system = (F.col("indicator") == "world_writable_dir") & ~snapshot & F.col("file").rlike(r"^(/etc/|/usr/|/bin/|/sbin/|/lib|/boot/|/opt/|/root/|/var/log/)")
    odd = F.col("file").rlike(r"^(/tmp/|/var/tmp/|/dev/shm/|/run/|/var/run/|/var/www/|/srv/www/|/usr/share/nginx/|/var/spool/)")
    other = ~F.col("indicator").startswith("world_writable")
    return got.where(writable | system | other).select("host", "indicator", "file", "detail", (writable | system | odd).alias("suspicious"))


def webshells(files: DataFrame, snippet: int | None = None) -> DataFrame:
    """Scripts in web folders (host, path, content) that read like web shells: labels in order, and the first line that a
    pattern hits; of .htaccess files, each directive that hands requests to scripts. Scripts count whatever their length;
    ``snippet`` shortens what is shown of the line. Null contents match nothing; repeated files each get their row."""
    shown = lambda c: F.trim(c) if snippet is None else F.left(F.trim(c), F.lit(snippet))
    labels = F.array_compact(F.array(*(F.when(F.col("content").rlike(rx), F.lit(n)) for n, rx in WEBSHELLS)))
    web = files.where(F.col("path").rlike(WEB_ROOTS))
    scripts = computed_once(web.where(F.lower("path").rlike(SCRIPTS)), {"labels": labels}).where(F.size("labels") > 0)
    first = F.coalesce(*(F.when(F.array_contains("labels", n), F.regexp_extract("content", rf"(?m)^.*?(?:{rx}).*$", 0)) for n, rx in WEBSHELLS))
    one = scripts.select("host", "path", F.array_join("labels", ",").alias("indicators"), shown(first).alias("snippet"))
    directive = web.where(F.col("path").endswith("/.htaccess")).select("host", "path", F.explode(F.split("content", "\n")).alias("l")).where(~F.trim("l").startswith("#") & F.col("l").rlike(HANDLERS))
    return one.unionByName(directive.select("host", "path", F.lit("htaccess_handler").alias("indicators"), shown(F.col("l")).alias("snippet")))


