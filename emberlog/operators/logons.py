"""Logons across machines: edges from ten kinds of evidence, their reasons, pivot chains, a curated graph, an incident log."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.net import IPV4, LOCAL, clean_user, extract_src, is_public_ip, kh_target, norm_ip, rdp_session_src, remote_src, short_user, spn_host
from ..functions.plan import computed_once, held

#: Events that show a session on a host, and events that show one leaving it.
CHAIN_IN = ("4624", "LSM-21", "LSM-25", "RCM-1149", "ssh", "wtmp")
CHAIN_OUT = ("4624", "4648", "4769", "1024", "1102", "TSC-MRU", "TypedPath", "LSM-21", "LSM-25", "RCM-1149", "ssh", "wtmp")
HIGH_SIGNAL = ("anonymous_logon", "chain", "chainsaw", "explicit_creds", "untrusted_cert", "rdp_public", "brute_success")
#: The tactic of the first reason that an edge has.
TACTICS = (
    ("rdp_public", "initial access"), ("brute_success", "credential access"), ("failed_logon", "credential access"), ("invalid_user", "credential access"),
    ("anonymous_logon", "discovery"), ("explicit_creds", "lateral movement"), ("rdp_outbound", "lateral movement"), ("typed_unc", "lateral movement"),
    ("untrusted_cert", "lateral movement"), ("kerberos_service", "lateral movement"), ("case_to_case", "lateral movement"), ("chain", "lateral movement"),
)
#: Verdicts that tell of ordinary sessions.
ORDINARY = (
    "", "network logon", "user authentication succeeded", "unlock logon", "rdp logon", "rdp session connected", "rdp session disconnected",
    "rds - session logon succeeded", "rds - session logoff succeeded", "rds - file explorer shell start notification received",
)
RAW = ("src", "dst", "user", "logon_type", "event_id", "status", "ts", "reasons")


def payload(row_columns: list[str]) -> Column:
    """The payload fields of an event as one text."""
    return F.concat_ws(" | ", *(F.coalesce(F.col(c), F.lit("")) for c in row_columns))


def _field(name: str, text: Column, value: str = r"([^\s|,]+)") -> Column:
    return F.trim(F.regexp_extract(text, rf"{name}:\s*{value}", 1))


def _reasons(*tests: tuple[Column, str]) -> Column:
    return F.array_compact(F.array(*(F.when(c, F.lit(r)) for c, r in tests)))


def _raw(df: DataFrame, src: Column, dst: Column, user: Column, logon_type: Column, event_id: Column, status: Column, ts: Column, reasons: Column) -> DataFrame:
    columns = (src, dst, user, logon_type.cast("int"), event_id, status, ts, reasons)
    out = computed_once(df, dict(zip(RAW, columns, strict=True))).select(*RAW)
    return out.where((F.coalesce("src", F.lit("")) != "") & (F.coalesce("dst", F.lit("")) != ""))


def _no_type() -> Column:
    return F.lit(None).cast("int")


def security_edges(events: DataFrame) -> DataFrame:
    """Raw edges of logon events (host, event_id, ts, user_name, remote_host, payload)."""
    p, eid, remote = F.col("payload"), F.col("event_id"), F.col("remote_host")
    lt = F.regexp_extract(p, r"LogonType\s+(\d+)", 1).try_cast("int")
    target = _field("Target", p, r"([^|,]+)")
    user = clean_user(F.coalesce(F.nullif(clean_user(F.col("user_name")), F.lit("")), target))
    src = extract_src(remote)
    logon = events.where(eid.isin("4624", "4625") & (lt.isNull() | lt.isin(3, 9, 10)))
    failed = eid == "4625"
    one = _raw(logon, src, F.col("host"), user, lt, eid, F.when(failed, "failed").otherwise("ok"), F.col("ts"), _reasons((failed, "failed_logon"), (short_user(user) == "anonymous logon", "anonymous_logon")))
    server = _field("TargetServerName", p)
    two = _raw(events.where((eid == "4648") & ~F.lower(server).isin(*LOCAL)), F.col("host"), server, user, lt, eid, F.lit("ok"), F.col("ts"), F.array(F.lit("explicit_creds")))
    kerberos = events.where(eid.isin("4768", "4769"))
    # a service ticket leads on to the service's host; whether the source is a host of ours is known after resolving
    service = F.when(eid == "4769", F.nullif(spn_host(_field("ServiceName", p)), F.lit("")))
    three = _raw(kerberos, src, F.col("host"), clean_user(target), _no_type(), eid, F.lit("ok"), F.col("ts"), F.array().cast("array<string>"))
    four = _raw(kerberos.where(service.isNotNull()), src, service, clean_user(target), _no_type(), eid, F.lit("ok"), F.col("ts"), F.array(F.lit("kerberos_service")))
    return reduce(DataFrame.unionByName, [one, two, three, four])


def rdp_out_edges(events: DataFrame, profiles: DataFrame) -> DataFrame:
    """Raw edges of dialled remote desktops (host, event_id, ts, user_sid, remote_host, payload); accounts by ``profiles``
    (host, sid, user)."""
    p = F.col("payload")
    dialled = F.coalesce(F.nullif(_field("Dest", p), F.lit("")), F.nullif(_field("Address", p), F.lit("")))
    target = F.coalesce(norm_ip(dialled), extract_src(F.col("remote_host")))
    named = profiles.groupBy("host", F.col("sid").alias("user_sid")).agg(F.max("user").alias("sid_user"))
    got = events.where(F.col("event_id").isin("1024", "1102") & (F.length(target) >= 3) & ~F.lower(target).isin(*LOCAL)).join(named, ["host", "user_sid"], "left")
    return _raw(got, F.col("host"), target, clean_user(F.col("sid_user")), F.lit(10), F.col("event_id"), F.lit("ok"), F.col("ts"), F.array(F.lit("rdp_outbound")))


def rdp_mru_edges(entries: DataFrame) -> DataFrame:
    """Raw edges of remembered remote desktops (host, target, username_hint, user, cert_accepted, ts)."""
    user = F.coalesce(F.nullif(clean_user(F.col("username_hint")), F.lit("")), clean_user(F.col("user")))
    return _raw(entries, F.col("host"), F.trim("target"), user, F.lit(10), F.lit("TSC-MRU"), F.lit("ok"), F.col("ts"), _reasons((F.lit(True), "rdp_outbound"), (F.col("cert_accepted"), "untrusted_cert")))


def typed_unc_edges(entries: DataFrame) -> DataFrame:
    """Raw edges of typed network paths (host, value, user, ts)."""
    got = entries.where(F.col("value").startswith("\\\\"))
    return _raw(got, F.col("host"), F.regexp_extract("value", r"^\\+([^\\]+)", 1), clean_user(F.col("user")), _no_type(), F.lit("TypedPath"), F.lit("ok"), F.col("ts"), F.array(F.lit("typed_unc")))


def rdp_in_edges(events: DataFrame) -> DataFrame:
    """Raw edges of sessions that arrive (host, channel LSM or RCM, event_id, ts, user_name, remote_host)."""
    ok = ((F.col("channel") == "LSM") & F.col("event_id").isin("21", "25")) | ((F.col("channel") == "RCM") & (F.col("event_id") == "1149"))
    return _raw(events.where(ok), rdp_session_src(F.col("remote_host")), F.col("host"), clean_user(F.col("user_name")), F.lit(10), F.concat_ws("-", "channel", "event_id"), F.lit("ok"), F.col("ts"), F.array().cast("array<string>"))


def login_record_edges(records: DataFrame, failed: bool = False) -> DataFrame:
    """Raw edges of login databases (host, remote, user, type, ts): sessions, or, with ``failed``, failures."""
    got = records if failed else records.where("type = 'USER_PROCESS'")
    reasons = F.array(F.lit("failed_logon")) if failed else F.array().cast("array<string>")
    return _raw(got, remote_src(F.col("remote")), F.col("host"), clean_user(F.col("user")), _no_type(), F.lit("btmp" if failed else "wtmp"), F.lit("failed" if failed else "ok"), F.col("ts"), reasons)


def ssh_edges(auth: DataFrame) -> DataFrame:
    """Raw edges of ssh events (host, event, user, source, ts)."""
    names = {"ssh_accepted": "ssh", "ssh_failed": "ssh_fail", "ssh_invalid_user": "ssh_invalid"}
    event = F.col("event")
    eid = F.coalesce(*(F.when(event == k, F.lit(v)) for k, v in names.items()))
    ok = event == "ssh_accepted"
    return _raw(auth.where(event.isin(*names)), remote_src(F.col("source")), F.col("host"), clean_user(F.col("user")), _no_type(), eid, F.when(ok, "ok").otherwise("failed"), F.col("ts"), _reasons((~ok, "failed_logon"), (event == "ssh_invalid_user", "invalid_user")))


def known_host_edges(entries: DataFrame) -> DataFrame:
    """Raw edges of known ssh hosts (host, account, target)."""
    return _raw(entries, F.col("host"), kh_target(F.col("target")), clean_user(F.col("account")), _no_type(), F.lit("known_host"), F.lit("ok"), F.lit(None).cast("timestamp"), F.array().cast("array<string>"))


def host_index(hosts: DataFrame) -> DataFrame:
    """(key, name) of hosts (host, fqdn, ips): full names and addresses, and first labels where no full key claims them."""
    keys = hosts.select(F.col("host").alias("name"), F.explode(F.filter(F.concat(F.array("host", "fqdn"), F.coalesce("ips", F.array().cast("array<string>"))), lambda x: F.coalesce(x, F.lit("")) != "")).alias("k")).withColumn("k", F.lower("k"))
    short = F.substring_index("k", ".", 1)
    weak = keys.where((short != F.col("k")) & (short != "") & ~F.col("k").rlike(IPV4)).select("name", short.alias("k"))
    ranked = keys.withColumn("rank", F.lit(0)).union(weak.withColumn("rank", F.lit(1)))
    return ranked.groupBy(F.col("k").alias("key")).agg(F.min_by("name", F.struct("rank", "name")).alias("name"))


def resolve(rows: DataFrame, index: DataFrame, column: str) -> DataFrame:
    """``column`` as a host's name where the index knows it, else an address as it is or a lower-case first label; adds
    ``<column>_case``, whether it is one of ours. The index has a row per key of a collected host, so Spark may broadcast
    it when it is small."""
    token = F.col(column)
    key = F.regexp_replace(F.lower(token), r"\$+$", "")
    short = F.substring_index(key, ".", 1)
    full = index.select(F.col("key").alias("__k1"), F.col("name").alias("__n1"))
    label = index.select(F.col("key").alias("__k2"), F.col("name").alias("__n2"))
    got = rows.withColumns({"__key": key, "__short": short}).join(full, F.col("__key") == F.col("__k1"), "left").join(label, F.col("__short") == F.col("__k2"), "left")
    name = F.coalesce("__n1", "__n2")
    other = F.when(token.contains(":") | token.rlike(IPV4), token).otherwise(F.col("__short"))
    return computed_once(got, {f"{column}_case": name.isNotNull(), column: F.coalesce(name, other)}).drop("__key", "__short", "__k1", "__n1", "__k2", "__n2")


_KEYS = ["src", "dst", "user", "logon_type", "event_id"]


def _resolved(rows: DataFrame, hosts: DataFrame) -> DataFrame:
    """Raw rows with both names resolved, without those from a host to itself."""
    index = host_index(hosts)
    named = resolve(resolve(rows, index, "src"), index, "dst").where("src <> dst")
    # a ticket tells of a step on only from hosts of ours
    return named.where(~F.array_contains("reasons", "kerberos_service") | F.col("src_case"))


def edges(raw: DataFrame, hosts: DataFrame) -> DataFrame:
    """Edges by (src, dst, user, logon_type, event_id): count, first and last time, reasons; the times are ``edge_times``.

    Raw rows are counted by their key before names are resolved, so joins see one row per pair of names and not per event,
    and no row holds more than a few numbers. Reasons are the union over a key's rows. Null times and types are kept.
    """
    # reasons are a key first, so that a task has a row of each and hashes numbers only
    first = raw.groupBy(*_KEYS, "status", "reasons").agg(F.count("*").alias("count"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"))
    first = first.groupBy(*_KEYS, "status").agg(F.sum("count").alias("count"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.array_distinct(F.flatten(F.collect_set("reasons"))).alias("reasons"))
    named = _resolved(first, hosts)
    service = F.array_contains("reasons", "kerberos_service")
    ok, rdp = F.col("status") == "ok", (F.col("logon_type") == 10) & (F.col("event_id") == "4624") | F.col("event_id").rlike("^(LSM|RCM)-")
    arriving = F.col("event_id").isin("4624", "4625", "4768", "4769", "wtmp", "btmp", "ssh", "ssh_fail", "ssh_invalid") | F.col("event_id").rlike("^(LSM|RCM)-")
    public = rdp & is_public_ip(F.col("src"))
    both = F.when(arriving & ~service, F.col("src_case")).otherwise(F.col("dst_case"))
    reasons = F.array_union("reasons", _reasons((public & ok, "rdp_public"), (both, "case_to_case")))
    named = computed_once(named, {"reasons": reasons})
    return named.groupBy(*_KEYS).agg(
        F.max("status").alias("status"), F.sum("count").alias("count"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("reasons")))).alias("reasons"),
        F.max("src_case").alias("src_case"), F.max("dst_case").alias("dst_case"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"),
    )


def edge_times(raw: DataFrame, hosts: DataFrame) -> DataFrame:
    """A row for each time of each edge, with resolved names: (src, dst, user, logon_type, event_id, status, ts, src_case,
    dst_case). Raw rows without a time are left out."""
    return _resolved(raw.where("ts is not null"), hosts).drop("reasons")


def by_reasons(edge_rows: DataFrame) -> DataFrame:
    """Edges in order: most reasons first, then by name."""
    return edge_rows.orderBy(F.desc(F.size("reasons")), "src", "dst", "user", "event_id", "logon_type")


def add_verdicts(edge_rows: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Edges with the rule verdicts (dst, user, event_id, verdict) on their host, account and event; adds ``chainsaw``."""
    got = verdicts.where(~F.lower(F.trim("verdict")).isin(*ORDINARY)).groupBy("dst", short_user(F.col("user")).alias("__u"), "event_id").agg(F.array_sort(F.collect_set("verdict")).alias("chainsaw"))
    joined = edge_rows.withColumn("__u", short_user(F.col("user"))).join(got, ["dst", "__u", "event_id"], "left").drop("__u")
    return joined.withColumns({"reasons": F.when(F.col("chainsaw").isNotNull(), F.array_union("reasons", F.array(F.lit("chainsaw")))).otherwise(F.col("reasons")), "chainsaw": F.coalesce("chainsaw", F.array().cast("array<string>"))})


def mark_brute_success(edge_rows: DataFrame, least: int = 5) -> DataFrame:
    """Marks logons of an account from a source that failed at least ``least`` times on the same host."""
    key = ["src", "dst", "__u"]
    rows = edge_rows.withColumn("__u", short_user(F.col("user")))
    fails = rows.where("status = 'failed' and event_id in ('btmp', 'ssh_fail', 'ssh_invalid')").groupBy(*key).agg(F.sum("count").alias("__fails")).where(F.col("__fails") >= least)
    hit = (F.col("status") == "ok") & F.col("event_id").isin("ssh", "wtmp") & F.col("__fails").isNotNull()
    return rows.join(fails, key, "left").withColumn("reasons", F.when(hit, F.array_union("reasons", F.array(F.lit("brute_success")))).otherwise(F.col("reasons"))).drop("__u", "__fails")


def latest_before(left: DataFrame, right: DataFrame, by: list[str], left_time: str, right_time: str, carry: list[str], stretch_s: int = 86400) -> DataFrame:
    """Of each ``right`` row the latest ``left`` row of the same ``by`` that isn't later: its time and ``carry`` columns; rows
    without one are left out, as are those with a null in ``by`` or the time. Of equal times the greatest ``carry`` counts.

    Time is cut into stretches. Within one, a union and a window find the row; where there is none, the last row of an
    earlier stretch is carried over from a table of one row per key and stretch. So a task sorts one stretch of one key
    and not a whole history, and no pairs are made.
    """
    at = lambda c: F.floor(F.unix_seconds(F.col(c).cast("timestamp")) / stretch_s)
    known = lambda df, t: reduce(lambda x, y: x & y, [F.col(c).isNotNull() for c in [*by, t]])
    left, right = left.where(known(left, left_time)), right.where(known(right, right_time))
    mine = F.struct(F.col(left_time).alias("__lt"), *carry)
    a = left.select(*by, at(left_time).alias("__s"), F.col(left_time).alias("__t"), F.lit(0).alias("__k"), mine.alias("__l"))
    b = right.select(*by, at(right_time).alias("__s"), F.col(right_time).alias("__t"), F.lit(1).alias("__k"), F.struct("*").alias("__r"))
    both = a.unionByName(b, allowMissingColumns=True)
    upto = Window.partitionBy(*by, "__s").orderBy("__t", "__k", "__l").rowsBetween(Window.unboundedPreceding, 0)
    near = both.withColumn("__l", F.last("__l", ignorenulls=True).over(upto)).where("__k = 1")
    ends = both.groupBy(*by, "__s").agg(F.max("__l").alias("__m"))
    carried = ends.withColumn("__m", F.last("__m", ignorenulls=True).over(Window.partitionBy(*by).orderBy("__s").rowsBetween(Window.unboundedPreceding, -1)))
    got = near.join(carried, [*by, "__s"]).withColumn("__l", F.coalesce("__l", "__m")).where("__l is not null")
    return got.select("__r.*", F.col("__l.__lt").alias(f"{left_time}_before"), *(F.col(f"__l.{c}").alias(f"before_{c}") for c in carry))


def _stamped(events: tuple[str, ...], falling: bool = False) -> Column:
    """A time and the place of its event among ``events`` as one number, so that hashed aggregates find the earliest of both;
    ``falling``: the greatest number is the latest time with the least event."""
    place = F.array_position(F.array(*(F.lit(x) for x in sorted(events))), F.col("event_id"))
    return F.unix_micros("ts") * 16 + (15 - place if falling else place)


def _time_of(stamped: str) -> Column:
    return F.timestamp_micros(F.shiftright(stamped, 4))


def _event_of(stamped: str, events: tuple[str, ...], falling: bool = False) -> Column:
    place = F.col(stamped).bitwiseAND(F.lit(15))
    return F.element_at(F.array(*(F.lit(x) for x in sorted(events))), (15 - place if falling else place).cast("int"))


def _nearest(known: DataFrame, asked: DataFrame, by: list[str], value: str, later: bool) -> DataFrame:
    """``asked`` with the ``value`` of the last ``known`` row of the same ``by`` whose second ``s`` isn't later than its own,
    or, with ``later``, of the first that isn't earlier; null if there is none. ``known`` has a row a second at most."""
    rows = known.select(*by, "s", value, F.lit(0).alias("__q")).unionByName(asked.select("*", F.lit(1).alias("__q")), allowMissingColumns=True)
    order = F.desc("s") if later else F.asc("s")
    upto = Window.partitionBy(*by).orderBy(order, "__q").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(value, F.last(value, ignorenulls=True).over(upto)).where("__q = 1").drop("__q")


def _legs(came: DataFrame, left: DataFrame, on: list[str], window_s: int) -> DataFrame:
    """Of each (u, x, b, y) the earliest departure with an arrival in the window before it, and the latest such arrival.

    Time is cut into buckets of the window's length. Whether x and y meet in a bucket is told by its first arrival, the last
    arrival of the one before, and its first and last departure: numbers, so pairs are one row a bucket whatever its events.
    The departure is then looked up in the first bucket where they meet, and its arrival there or at the end of the one before.
    """
    bucket = F.floor(F.col("s") / window_s)
    came, left = came.withColumn("k", bucket), left.withColumn("k", bucket)
    own = came.groupBy("u", "x", "b", "k").agg(F.min("s").alias("low"), F.max("s").alias("high"), F.max("t_in").alias("last_in"))
    none = F.lit(None).cast("long")
    before = own.select("u", "x", "b", (F.col("k") + 1).alias("k"), none.alias("low"), "high", "last_in")
    near = own.select("u", "x", "b", "k", "low", none.alias("high"), none.alias("last_in")).unionByName(before).groupBy("u", "x", "b", "k").agg(F.max("low").alias("low"), F.max("high").alias("high"), F.max("last_in").alias("last_in"))
    gone = left.groupBy(*on, "y", "k").agg(F.min("s").alias("first_out"), F.max("s").alias("last_out"))
    meets = (F.col("low") <= F.col("last_out")) | (F.col("first_out") - F.col("high") <= window_s)
    first = near.select("u", "x", "b", "k", "low", "high").join(gone, [*on, "k"]).where((F.col("x") != F.col("y")) & meets).groupBy("u", "x", "b", "y").agg(F.min("k").alias("k"))
    first = first.join(near, ["u", "x", "b", "k"]).join(gone, [*on, "y", "k"])
    since = F.when(F.col("first_out") - F.col("high") <= window_s, F.col("first_out")).otherwise(F.col("low"))
    asked = first.select("u", "x", "b", "y", "k", since.alias("s"), "last_in")
    seconds = left.join(first.select(*on, "y", "k").distinct(), [*on, "y", "k"], "left_semi").groupBy(*on, "y", "k", "s").agg(F.min("t_out").alias("t_out"))
    out = _nearest(seconds, asked, [*on, "y", "k"], "t_out", later=True)
    # arrivals in the same second count as earlier
    asked = out.select("u", "x", "b", "y", "k", F.unix_seconds(_time_of("t_out")).alias("s"), "last_in", "t_out")
    seconds = came.join(asked.select("u", "x", "b", "k").distinct(), ["u", "x", "b", "k"], "left_semi").groupBy("u", "x", "b", "k", "s").agg(F.max("t_in").alias("t_in"))
    got = _nearest(seconds, asked, ["u", "x", "b", "k"], "t_in", later=False)
    return got.select("u", "x", "b", "y", F.coalesce("t_in", "last_in").alias("t_in"), "t_out")


def pivot_chains(times: DataFrame, window_s: int = 12 * 3600, loose_window_s: int = 3600) -> DataFrame:
    """X -> B -> Y: a session onto a host of ours, then something leaving it for elsewhere within the window, by the same
    account, or without an account within the shorter one; of ``edge_times``. The earliest departure of each (user, X, B,
    Y), with the latest arrival before it. Machine accounts are left out; all times of an edge count.
    """
    u = short_user(F.col("user"))
    rows = times.where((F.col("status") == "ok") & F.col("ts").isNotNull() & F.col("event_id").isin(*CHAIN_IN, *CHAIN_OUT)).withColumn("u", u).where(~F.col("u").endswith("$"))
    rows = held(rows.select("src", "dst", "u", "event_id", "ts", "src_case", "dst_case"))  # read several times
    came = rows.where(F.col("event_id").isin(*CHAIN_IN) & F.col("dst_case") & (F.col("u") != "")).select(F.col("src").alias("x"), F.col("dst").alias("b"), "u", F.unix_seconds("ts").alias("s"), _stamped(CHAIN_IN, falling=True).alias("t_in"))
    left = rows.where(F.col("event_id").isin(*CHAIN_OUT) & F.col("src_case")).select(F.col("src").alias("b"), F.col("dst").alias("y"), "u", F.unix_seconds("ts").alias("s"), _stamped(CHAIN_OUT).alias("t_out"))
    named = _legs(came, left.where("u <> ''"), ["b", "u"], window_s)
    loose = _legs(came, left.where("u = ''").drop("u"), ["b"], loose_window_s)
    # of equal departures the one with the latest arrival counts
    both = named.unionByName(loose)
    keys = ["u", "x", "b", "y"]
    best = F.struct(F.shiftright("t_out", 4).alias("at"), (-F.shiftright("t_in", 4)).alias("k"), "t_in", "t_out")
    got = both.groupBy(*keys).agg(F.min(best).alias("p")).select(*keys, "p.t_in", "p.t_out")
    return got.select(*keys, _time_of("t_in").alias("t_in"), _time_of("t_out").alias("t_out"), _event_of("t_in", CHAIN_IN, falling=True).alias("in_event"), _event_of("t_out", CHAIN_OUT).alias("out_event"))


def earliest_chains(chains: DataFrame, most: int = 200) -> DataFrame:
    """The first chains by the time of their arrival; ties by name."""
    return chains.orderBy("t_in", "t_out", "u", "x", "b", "y").limit(most)


def mark_chains(edge_rows: DataFrame, chains: DataFrame) -> DataFrame:
    """Marks the edges that the chains go over."""
    legs = chains.select("u", F.col("x").alias("src"), F.col("b").alias("dst"), F.col("in_event").alias("event_id")).union(chains.select("u", F.col("b").alias("src"), F.col("y").alias("dst"), F.col("out_event").alias("event_id"))).distinct()
    legs = legs.select("src", "dst", "event_id", F.col("u").alias("__u")).withColumn("__hit", F.lit(True))
    rows = edge_rows.withColumn("__u", short_user(F.col("user")))
    cond = (rows["src"] == legs["src"]) & (rows["dst"] == legs["dst"]) & (rows["event_id"] == legs["event_id"]) & ((rows["__u"] == legs["__u"]) | (rows["__u"] == ""))
    hit = rows.join(legs.select(legs["src"], legs["dst"], legs["event_id"], legs["__u"]), cond, "left_semi").select("src", "dst", "user", "logon_type", "event_id").distinct().withColumn("__hit", F.lit(True))
    keys = ["src", "dst", "user", "event_id"]
    got = rows.alias("r").join(hit.alias("h"), reduce(lambda a, b: a & b, [F.col(f"r.{k}") == F.col(f"h.{k}") for k in keys]) & F.col("r.logon_type").eqNullSafe(F.col("h.logon_type")), "left")
    marked = F.when(F.col("h.__hit"), F.array_union("r.reasons", F.array(F.lit("chain")))).otherwise(F.col("r.reasons"))
    return got.select(*(F.col(f"r.{c}") for c in edge_rows.columns if c != "reasons"), marked.alias("reasons"))


def category(event_id: Column, logon_type: Column) -> Column:
    """How an access was attempted, whatever became of it."""
    return (
        F.when(event_id == "4648", "explicit").when(event_id.isin("4768", "4769"), "kerberos").when(event_id == "TSC-MRU", "rdp_mru").when(event_id == "TypedPath", "typed_unc")
        .when(event_id.isin("ssh", "wtmp", "ssh_fail", "ssh_invalid", "btmp"), "ssh").when(event_id == "known_host", "ssh_known_host")
        .when(event_id.isin("1024", "1102") | (logon_type == 10), "rdp").when(logon_type == 9, "runas").when(logon_type == 3, "network").otherwise("other")
    )


def curate(edge_rows: DataFrame, hosts: DataFrame, most_external: int = 40, most_failing: int = 40) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes with roles, kept links, counts of what is hidden): edges with a reason, hosts of ours, and other hosts that
    succeeded with a strong reason, weigh most, or only ever failed and are few or loudest. Ties go by name."""
    ours = hosts.select(F.col("host").alias("n")).distinct()
    edge_rows = held(edge_rows)  # read several times; edges are counts, not events
    signal = edge_rows.where(F.size("reasons") > 0)
    hot = F.arrays_overlap("reasons", F.array(*(F.lit(x) for x in HIGH_SIGNAL)))
    ends = signal.select(F.col("src").alias("n"), F.col("src_case").alias("case"), "count", "status", hot.alias("hot")).union(signal.select("dst", "dst_case", "count", "status", hot))
    other = ends.where("not `case`").join(ours, "n", "left_anti").groupBy("n").agg(F.sum("count").alias("weight"), F.max(F.col("status") != "failed").alias("ok"), F.max(F.col("hot") & (F.col("status") != "failed")).alias("must"))
    top = lambda df, k: df.orderBy(F.desc("weight"), "n").limit(k).select("n")
    keep = other.where("must").select("n").union(top(other, most_external)).union(top(other.where("not ok"), most_failing)).distinct()
    shown = keep.union(ours).distinct()
    cased = lambda df, end: df.where(F.col(f"{end}_case")).unionByName(df.where(~F.col(f"{end}_case")).join(shown.withColumnRenamed("n", end), end, "left_semi").select(df.columns))
    links = cased(cased(signal, "src"), "dst").withColumn("category", category(F.col("event_id"), F.col("logon_type")))
    hidden = other.join(keep, "n", "left_anti").agg(F.count("*").alias("hidden"), F.count_if(~F.col("ok")).alias("hidden_failing"))
    nodes = ours.withColumn("case", F.lit(True)).union(links.select("src", "src_case")).union(links.select("dst", "dst_case")).groupBy("n").agg(F.max("case").alias("case"))
    dcs = edge_rows.where("event_id in ('4768', '4769')").where(~F.array_contains("reasons", "kerberos_service")).select(F.col("dst").alias("n")).distinct().withColumn("dc", F.lit(True))
    linux = hosts.where("os = 'linux'").select(F.col("host").alias("n")).distinct().withColumn("linux", F.lit(True))
    address = F.col("n").rlike(IPV4) | F.col("n").contains(":")
    role = F.when(F.col("dc"), "dc").when(F.col("linux"), "linux").when(F.col("case"), "case").when(address & is_public_ip(F.col("n")), "public").when(address, "external").otherwise("server")
    return nodes.join(dcs, "n", "left").join(linux, "n", "left").select(F.col("n").alias("id"), role.alias("role")), links, hidden


def incident_log(edge_rows: DataFrame, evidence: str = "lateral_movement") -> DataFrame:
    """A row for each edge with a reason: when, where, who, tactic, a description of its fields, alert or event."""
    has = lambda r: F.array_contains("reasons", r)
    tactic = F.coalesce(*(F.when(has(r), F.lit(t)) for r, t in TACTICS), F.lit(""))
    mechanism = F.coalesce(F.col("logon_type").cast("string"), F.nullif("event_id", F.lit("")), F.lit("logon"))
    verdict = F.col("chainsaw") if "chainsaw" in edge_rows.columns else F.array().cast("array<string>")
    text = F.concat(
        mechanism, F.when(F.col("status") == "failed", " failed from ").otherwise(" succeeded from "), F.col("src"), F.lit(" to "), F.col("dst"), F.lit(" as "), F.when(F.col("user") == "", "an unknown account").otherwise(F.col("user")),
        F.when(F.col("count") > 1, F.concat(F.lit(", "), F.col("count").cast("string"), F.lit(" times"))).otherwise(""), F.lit(" ("), F.array_join("reasons", ", "), F.lit(")"),
        F.when(F.size(verdict) > 0, F.concat(F.lit(" ["), F.array_join(verdict, "+"), F.lit("]"))).otherwise(""),
    )
    domain = F.when(F.col("user").contains("\\"), F.substring_index("user", "\\", 1)).otherwise("")
    return edge_rows.where(F.size("reasons") > 0).select(
        F.date_format("first_seen", "yyyy-MM-dd HH:mm:ss").alias("when_utc"), F.col("dst").alias("host"), F.col("src").alias("source"), F.col("dst").alias("destination"), "user", domain.alias("domain"),
        tactic.alias("tactic"), text.alias("description"), F.lit(evidence).alias("evidence"), F.when(F.size(verdict) > 0, "alert").otherwise("event").alias("kind"), F.lit("unconfirmed").alias("relevance"),
    )


INCIDENT_KEY = ["when_utc", "source", "destination", "user", "evidence"]


def merge_incidents(log: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of ``found`` that ``log`` lacks, by key; rows already there are never changed. Append the result."""
    keys = [F.col(f"f.{k}").eqNullSafe(F.col(f"l.{k}")) for k in INCIDENT_KEY]
    return found.dropDuplicates(INCIDENT_KEY).alias("f").join(log.select(INCIDENT_KEY).alias("l"), reduce(lambda a, b: a & b, keys), "left_anti")


def unknown_terms(log: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Values of tactic, kind and relevance that the vocabulary (term, value) lacks; empty when all is well."""
    used = log.select(F.explode(F.create_map(*(x for c in ("tactic", "kind", "relevance") for x in (F.lit(c), F.col(c))))).alias("term", "value")).where("value <> ''").distinct()
    return used.join(vocabulary, ["term", "value"], "left_anti")


def case_summary(edge_rows: DataFrame, chains: DataFrame) -> DataFrame:
    """Hosts, edges, edges with reasons, chains."""
    hosts = edge_rows.select("src").union(edge_rows.select("dst")).distinct().agg(F.count("*").alias("hosts"))
    counts = edge_rows.agg(F.count("*").alias("edges"), F.count_if(F.size("reasons") > 0).alias("suspicious"))
    return hosts.crossJoin(counts).crossJoin(chains.agg(F.count("*").alias("chains")))  # three single rows


def logon_summary(events: DataFrame) -> DataFrame:
    """Successes and failures by host, account, source and logon type, with first and last time."""
    lt = F.regexp_extract("payload", r"LogonType\s+(\d+)", 1).try_cast("int")
    got = events.where("event_id in ('4624', '4625')").groupBy("host", clean_user(F.col("user_name")).alias("user"), F.coalesce(extract_src(F.col("remote_host")), F.lit("")).alias("src"), lt.alias("logon_type"))
    return got.agg(F.count_if(F.col("event_id") == "4624").alias("ok"), F.count_if(F.col("event_id") == "4625").alias("failed"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"))
