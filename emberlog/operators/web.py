"""Web access logs: parsing, per-source statistics, attack hunting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.net import ip_hex, is_hosting, is_ip, is_private_hex
from ..functions.plan import computed_once
from ..functions.strings import clf_time, iso_instant, web_decode
from ..functions.web_rules import PREFILTER, families_of, is_sensitive, with_attack_families
from .indicators import any_of
from .networks import prefixes, with_network

_QUOTED = r'((?:[^"\\]++|\\.)*+)'  # possessive: a hostile line can't exhaust the stack
ACCESS_LINE = r'^(\S+)\s+\S+\s+(\S+)\s+\[([^\]]+)\]\s+"' + _QUOTED + r'"\s+(\d{3}|-)\s+(\S+)(?:\s++[^"\r\n]*+"' + _QUOTED + r'"\s+"' + _QUOTED + r'")?'
_SEP = "\u0001"
NORMAL_METHODS = ("GET", "HEAD", "POST", "OPTIONS", "", "?")


def parse_access(lines: DataFrame, line_col: str = "line") -> DataFrame:
    """Rows of access logs in Common or Combined Log Format; other lines are left out, null ones too. Equal lines give equal
    rows; an empty table gives an empty one; columns named like those added are replaced.

    Adds ip, edge_ip, time, ts, method, path, query, status, size, referer, ua. Lines quoted as a whole are unwrapped.
    The client is the leftmost valid address of an X-Forwarded-For field behind the matched ones, the connecting host then
    being ``edge_ip``. Lines are matched as a whole, however long, by one match that takes no stack and no square of the
    length; the fields of the request are cut, not matched again.
    """
    raw = F.translate(F.col(line_col), _SEP, "")
    line = F.when(raw.startswith('"'), F.regexp_replace(F.substring(raw, F.lit(2), F.length(raw)), '"$', "")).otherwise(raw)
    # one match gives all fields and what follows them
    fields = F.split(F.regexp_replace(line, ACCESS_LINE, _SEP.join(f"${i}" for i in (1, 3, 4, 5, 6, 7, 8)) + _SEP), _SEP)
    got = computed_once(lines, {"__m": fields}).where(F.size("__m") == 8)
    part = lambda i: F.get("__m", F.lit(i))
    rest = lambda x, n: x.substr(n, F.length(x))
    request = part(2)
    spaces = request.contains(" ")
    head = F.when(spaces, request.substr(F.lit(1), F.length(request) - F.length(F.substring_index(request, " ", -1)) - 1)).otherwise(request)
    hops = F.split(F.regexp_extract(part(7), r'(?i)x-forwarded-for\s*+[=:]\s*+(?:"\s*+)?+([0-9a-fA-F.:, ]+)', 1), ",")
    client = F.when(F.length(part(7)) > 16, F.try_element_at(F.filter(F.transform(hops, lambda x: F.trim(x)), is_ip), F.lit(1)))
    # what several columns name or filters may ask for is worked out once; the others are cuts of it
    got = computed_once(got, {"__head": head, "__client": client, "__time": clf_time(part(1))})
    head, client = F.col("__head"), F.col("__client")
    uri = F.when(head.contains(" "), rest(head, F.instr(head, " ") + 1)).otherwise(head)
    added = {
        "ip": F.coalesce(client, part(0)),
        "edge_ip": F.when(client.isNotNull(), part(0)).otherwise(""),
        "time": F.col("__time"),
        "ts": iso_instant(F.col("__time")),
        "method": F.when(head.contains(" "), F.substring_index(head, " ", 1)).otherwise(""),
        "path": F.substring_index(uri, "?", 1),
        "query": F.when(uri.contains("?"), rest(uri, F.instr(uri, "?") + 1)).otherwise(""),
        "status": part(3),
        "size": part(4),
        "referer": part(5),
        "ua": part(6),
    }
    return got.withColumns(added).drop("__m", "__head", "__client", "__time")


def is_access_log(lines: DataFrame, first: int = 20, probe: int = 65_536) -> DataFrame:
    """Paths of which one of the first lines reads as an access-log line, and the first ``probe`` bytes hold no NUL, as
    those of binary files do; needs (path, line_no, line)."""
    # a line has a byte at least, so the probe ends within as many lines
    head = lines.where(F.col("line_no") <= probe).select("path", "line_no", F.when(F.col("line_no") <= first, F.col("line").rlike(ACCESS_LINE)).alias("log"), (F.octet_length("line") + 1).alias("n"), F.octet_length(F.substring_index("line", "\u0000", 1)).alias("at"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("path").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    nul = (F.col("at") + 1 < F.col("n")) & (before + F.col("at") < probe)
    seen = head.withColumn("nul", nul).groupBy("path").agg(F.max("log").alias("log"), F.max("nul").alias("binary"))
    return seen.where("log and not binary").select("path")


def discover_access(lines: DataFrame) -> DataFrame:
    """Lines of access logs: by directory and file name, or, elsewhere, by what the first lines hold."""
    name = F.lower(F.substring_index("path", "/", -1))
    named = F.lower("path").rlike(r"/(apache2|httpd|nginx|lighttpd)/") & name.contains("access") & ~name.contains("error")
    known = lines.where(named)
    return known.unionByName(lines.where(~named & ~name.contains("error")).join(is_access_log(lines), "path", "left_semi").select(known.columns))


def _count_if(condition: Column) -> Column:
    return F.count_if(condition)


def ip_stats(requests: DataFrame, fail_least: int = 20, fail_share: float = 0.10, missing_least: int = 50, missing_share: float = 0.25) -> DataFrame:
    """A row per source: requests by status, bytes, paths, odd methods, attack hits, first and last time, and flags.

    Requests are read once. The shuffle carries partial sums by (ip, method, path), so a source with most of the requests
    costs no more than others. Null sources are a row of their own; an empty table gives an empty one.
    """
    s = F.col("status")
    # one pass: requests are summed by source, method and path, these by source and method, these by source
    by_path = with_attack_families(requests).withColumn("hit", F.size("families") > 0).groupBy("ip", "method", "path").agg(
        F.count("*").alias("n"),
        _count_if(s.startswith("2")).alias("s2xx"),
        _count_if(s.startswith("3")).alias("s3xx"),
        *(_count_if(s == code).alias(f"s{code}") for code in ("401", "403", "404")),
        _count_if(s.startswith("4") & ~s.isin("401", "403", "404")).alias("s4xx"),
        _count_if(s.startswith("5")).alias("s5xx"),
        F.sum(F.when(F.col("size").rlike(r"^\d+$"), F.col("size").try_cast("long"))).alias("bytes"),
        _count_if(F.col("hit")).alias("attack_hits"),
        F.min(F.when(F.col("time") != "", F.col("time"))).alias("first_seen"),
        F.max(F.when(F.col("time") != "", F.col("time"))).alias("last_seen"),
        F.min("ts").alias("first_ts"),
        F.max("ts").alias("last_ts"),
    )
    sums = ["s2xx", "s3xx", "s401", "s403", "s404", "s4xx", "s5xx", "attack_hits"]
    ends = [f(c).alias(c) for f, c in ((F.min, "first_seen"), (F.max, "last_seen"), (F.min, "first_ts"), (F.max, "last_ts"))]
    # a path counts for its source once, under the least of its methods
    owner = F.min("method").over(Window.partitionBy("ip", "path"))
    parts = by_path.withColumn("own", F.col("method").eqNullSafe(owner).cast("long")).groupBy("ip", "method").agg(F.sum("n").alias("n"), *(F.sum(c).alias(c) for c in sums), F.sum("bytes").alias("bytes"), F.sum("own").alias("paths"), *ends)
    odd = F.when(~F.upper("method").isin(*NORMAL_METHODS), F.struct((-F.col("n")).alias("k"), "method", "n"))
    whole = parts.groupBy("ip").agg(
        F.sum("n").alias("requests"), *(F.sum(c).alias(c) for c in sums), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"),
        F.sum("paths").alias("paths"), *ends, F.array_sort(F.collect_list(odd)).alias("odd"),
    )
    fails = F.col("s401") + F.col("s403")
    scan = ((F.col("s404") >= missing_least) & (F.col("s404") >= F.col("requests") * missing_share)) | ((F.col("requests") >= 30) & (F.col("s404") > F.col("requests") * 0.5))
    flags = F.array_compact(
        F.array(
            F.when(F.col("attack_hits") > 0, "attack"),
            F.when((fails >= fail_least) & (fails >= F.col("requests") * fail_share), "auth-fail"),
            F.when(scan, "scan"),
            F.when(F.size("odd") > 0, "odd-method"),
        )
    )
    return whole.withColumns(
        {
            "odd_methods": F.array_join(F.transform("odd", lambda x: F.concat(x["method"], F.lit(":"), x["n"])), " "),
            "mb_sent": F.round(F.col("bytes") / 1048576.0, 2),
            "flags": flags,
        }
    ).drop("odd")


def missing_paths(requests: DataFrame, least: int = 3) -> DataFrame:
    """Paths answered with 404: how often, for how many sources; rare ones only if sensitive."""
    got = requests.where("status = '404'").groupBy("path", "ip").agg(F.count("*").alias("n")).groupBy("path").agg(F.sum("n").alias("count"), F.count("*").alias("distinct_ips"))
    return got.withColumn("sensitive", is_sensitive(F.col("path"))).where((F.col("count") >= least) | F.col("sensitive"))


def auth_failures(requests: DataFrame, cluster: int = 10) -> DataFrame:
    """401 and 403 by source and path."""
    got = requests.where("status in ('401', '403')").groupBy("ip", "path").agg(_count_if(F.col("status") == "401").alias("s401"), _count_if(F.col("status") == "403").alias("s403"), F.min("time").alias("first_seen"), F.max("time").alias("last_seen"))
    total = F.col("s401") + F.col("s403")
    return got.withColumns({"total": total, "flags": F.array_compact(F.array(F.when(total >= cluster, "cluster"), F.when(is_sensitive(F.col("path")), "sensitive")))})


def daily_series(requests: DataFrame) -> DataFrame:
    """Requests by source and day."""
    return requests.withColumn("day", F.substring("time", 1, 10)).where(F.col("day").rlike(r"^\d{4}-\d\d-\d\d$")).groupBy("ip", "day").agg(F.count("*").alias("n"))


def top_values(requests: DataFrame, column: str, k: int, by: list[str] | None = None) -> DataFrame:
    """The k most frequent values, ties by value, overall or for each group; with the number of sources."""
    by = by or []
    value = F.col(column)
    got = requests.where(value.isNotNull() & ~value.isin("", "-")).groupBy(*by, column, "ip").agg(F.count("*").alias("n")).groupBy(*by, column).agg(F.sum("n").alias("n"), F.count("*").alias("ips"))
    if not by:
        return got.orderBy(F.desc("n"), column).limit(k)
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("n"), column))
    return got.withColumn("rank", rank).where(F.col("rank") <= k)


def approx_top_values(requests: DataFrame, column: str, k: int, tracked: int = 10_000) -> DataFrame:
    """The k most frequent values of columns of very many values, ties by value: (item, count). A bounded sketch names
    ``tracked`` candidates, which are then counted, so numbers and their order are exact; only values too rare for the
    sketch, which it can lose if there are more than it tracks, aren't considered."""
    values = requests.select(F.col(column).alias("item"))
    some = values.agg(F.expr(f"approx_top_k(item, {tracked}, {tracked})").alias("top")).select(F.inline("top")).select(F.col("item").alias("__item"))
    counted = values.join(F.broadcast(some), F.col("item").eqNullSafe(F.col("__item")), "left_semi").groupBy("item").agg(F.count("*").alias("count"))
    return counted.orderBy(F.desc("count"), "item").limit(k)


def geo_origin(ips: DataFrame, countries: DataFrame, networks: DataFrame, tor: DataFrame, home: str, ip_col: str = "ip") -> DataFrame:
    """country, asn and origin of each distinct address: private, tor, hosting, local, unknown or foreign, in that order.

    ``countries`` (country) and ``networks`` (number, org) say where a range is by ``network`` (``a.b.c.d/n`` or IPv6) or by
    ``first`` and ``last``, IPv4 addresses as numbers. Ranges may lie in each other: the narrowest counts, and of equal ones
    the least values. Addresses are looked up by their 128 bits, so mapped ones are their IPv4 addresses.
    """
    keyed = computed_once(ips.select(ip_col).distinct(), {"__digits": ip_hex(F.col(ip_col))})
    keyed = computed_once(keyed, {"__private": F.coalesce(is_private_hex(F.col("__digits")), F.lit(False))})
    got = with_network(keyed, prefixes(countries, ["country"]), ip_col, ["country"], "__digits")
    got = with_network(got, prefixes(networks, ["number", "org"]), ip_col, ["number", "org"], "__digits")
    tors = tor.select(ip_hex(F.col("ip")).alias("t")).where("t is not null").distinct()
    got = got.join(tors, got["__digits"] == tors["t"], "left")
    private = F.col("__private")
    origin = F.when(F.col("__digits").isNull(), "unknown").when(private, "private").when(F.col("t").isNotNull(), "tor").when(is_hosting(F.col("org")), "hosting").when(F.col("country") == home, "local").when(F.col("country").isNull(), "unknown").otherwise("foreign")
    asn = F.when(private | F.col("number").isNull(), "").otherwise(F.trim(F.concat(F.lit("AS"), F.col("number"), F.lit(" "), F.coalesce("org", F.lit("")))))
    return got.select(ip_col, F.when(private, "LAN").otherwise(F.coalesce("country", F.lit("?"))).alias("country"), asn.alias("asn"), origin.alias("origin"))


def match_indicators(text: Column, indicators: list[tuple[str, str]], raw: Column | None = None) -> Column:
    """Labels of the indicators (label, regular expression) that match, in their order; one alternation is tried first, on
    ``raw`` if it is given. Null text matches nothing. For very many indicators see ``indicators.match_many``."""
    none = F.array().cast("array<string>")
    if not indicators:
        return none
    each = F.array_distinct(F.array_compact(F.array(*(F.when(text.rlike(f"(?i){rx}"), F.lit(label)) for label, rx in indicators))))
    return F.when(F.coalesce(any_of(text if raw is None else raw, [rx for _, rx in indicators]), F.lit(False)), each).otherwise(none)


def hunt(requests: DataFrame, indicators: list[tuple[str, str]] | None = None) -> DataFrame:
    """Requests that attack: built-in families where the server answered 200, analyst indicators whatever it answered.

    Indicators see decoded path, query and user agent, if the raw text of these passes them all as one alternation; what
    hides an indicator by encoding it is not found, as with the families. Only requests that pass one of the two are
    decoded. Null fields count as empty; repeated requests each get their row.
    """
    raw = F.concat_ws(" ", F.coalesce("path", F.lit("")), F.coalesce("query", F.lit("")))
    some = F.lit(False)
    if indicators:
        some = any_of(F.concat_ws(" ", raw, F.coalesce("ua", F.lit(""))), [rx for _, rx in indicators])
    got = computed_once(requests, {"__builtin": (F.col("status") == "200") & F.lower(raw).rlike(PREFILTER), "__some": some}).where("__builtin or __some")
    got = computed_once(got, {"__plain": F.concat_ws(" ", web_decode(F.col("path")), web_decode(F.col("query")))})
    none = F.array().cast("array<string>")
    labels = match_indicators(F.concat_ws(" ", "__plain", F.lower("ua")), indicators or [], F.lit("") if not indicators else None)
    got = computed_once(got, {"families": F.when(F.col("__builtin"), families_of(F.col("__plain"))).otherwise(none), "indicators": F.when(F.col("__some"), labels).otherwise(none)})
    got = got.drop("__plain", "__builtin", "__some").where((F.size("families") > 0) | (F.size("indicators") > 0))
    return got.withColumns({"flag": F.coalesce(F.try_element_at("families", F.lit(1)), F.try_element_at("indicators", F.lit(1))), "all_flags": F.array_join(F.array_union("families", "indicators"), "+")})


def newest_first(found: DataFrame, *then: str) -> DataFrame:
    """The hunt view's order: by time as text, newest first; ties by source, path and query, then as given."""
    return found.orderBy(F.desc("time"), "ip", "path", "query", *then)
