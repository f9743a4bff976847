"""Of each finding of the third round, a small case that failed before."""

from __future__ import annotations

from pyspark.sql import functions as F


def test_sizes_beyond_a_gigabyte_stay_in_the_units_asked_for(spark, tmp_path):
    from emberlog.plans import catalog

    spark.createDataFrame([(3,), (1000,), (20000,)], "p_partkey long").write.parquet(str(tmp_path / "part.parquet"))
    got = {r.p_partkey: r.size for r in catalog.QUERIES["readable_sizes"](spark, str(tmp_path)).collect()}
    assert got == {3: "34 B", 1000: "2.9 MB", 20000: "1144.4 MB"}


def test_frequent_values_of_equal_counts_come_by_value(spark):
    from emberlog.operators import web

    rows = spark.createDataFrame([(f"/{c}",) for c in "zyxwvutsab" for _ in range(3)] + [("/z",), (None,)], "path string").repartition(4)
    assert [(r.item, r["count"]) for r in web.approx_top_values(rows, "path", 4).collect()] == [("/z", 4), ("/a", 3), ("/b", 3), ("/s", 3)]


def test_running_count_over_stretches(spark):
    from emberlog.functions.plan import running_count

    rows = [(b, i, i % 7 == b) for b in (1, 2) for i in range(1, 200)] + [(None, i, i > 3) for i in range(1, 9)]
    df = spark.createDataFrame(rows, "b int, i int, t boolean").repartition(3)
    got = {(r.b, r.i): r.n for r in running_count(df, F.col("t"), ["b"], "i", "n", stretch=16).collect()}
    assert got == {(b, i): sum(t for c, j, t in rows if c == b and j <= i) for b, i, _ in rows}


def test_blocks_of_a_package_log_are_no_single_group(spark, lines):
    from emberlog.operators import logs

    text = logs.package_history(lines(("/var/log/apt/history.log", "Start-Date: x"))).select("action")._jdf.queryExecution().optimizedPlan().toString()
    windows = [x for x in text.splitlines() if " Window " in f" {x}" and "line_no" in x]
    assert windows and all("__s" in x for x in windows)


def test_lines_of_one_host_meet_its_family_without_a_shuffle(spark, lines):
    from emberlog.operators import logs

    df = logs.first_family(lines(("/var/log/auth.log", "a"), ("/var/log/messages", "b")))
    assert [r.line for r in df.collect()] == ["a"]
    assert "strategy=broadcast" in df._jdf.queryExecution().analyzed().toString()


def test_partitions_grow_with_rows(spark):
    from emberlog.functions.plan import dealt

    assert dealt(spark.range(1000), "id", rows=50).rdd.getNumPartitions() == 20
    assert dealt(spark.range(10), "id", rows=50).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_outputs_of_machines_are_dealt_out_before_they_are_sorted(spark, lines):
    from emberlog.operators import host_state

    df = host_state.linux_machine_info(lines(("hostname", "box")))
    assert "RepartitionByExpression [host" in df._jdf.queryExecution().analyzed().toString() and df.first().machine_name == "box"


def test_a_class_of_one_character_is_part_of_the_required_text():
    from emberlog.operators import indicators

    got = [indicators.required_texts(rx) for rx in ("abcde[f]gh{1}ij", "abcd[^e]f", "abcd[ef]", "abcd[e]?f", "abcd[.]exe")]
    assert got == [["abcdefghij"], ["abcd"], ["abcd"], ["abcd"], ["abcd.exe"]]


def test_grams_of_texts_are_not_shuffled(spark):
    from emberlog.operators import indicators

    rows = spark.createDataFrame([(1, "some words here")], "id int, text string")
    df = indicators.match_many(rows, indicators.indicator_index(spark, [("a", "words"), ("b", "here[s]")]), "id", "text")
    assert [r.label for r in df.collect()] == ["a"]
    assert df._jdf.queryExecution().analyzed().toString().count("strategy=broadcast") == 2


def test_streams_that_follow_each_other_are_one_task(spark, tmp_path):
    import lzma

    from emberlog.sources import records

    parts = [b"one\ntw", b"o\nthree\n", b"", b"four", b"\nfive\n"]
    raw = [lzma.compress(p) for p in parts]
    damaged = raw[1][:14] + bytes(x ^ 255 for x in raw[1][14:20]) + raw[1][20:]
    (tmp_path / "a.xz").write_bytes((b"\0" * 4).join(raw))
    (tmp_path / "b.xz").write_bytes(b"".join([raw[0], damaged, raw[4]]))
    reader = records.XzReader(str(tmp_path), ".xz", 1 << 20)
    assert [len(p.streams) for p in reader.partitions()] == [5, 3]
    assert [len(p.streams) for p in records.XzReader(str(tmp_path), ".xz", 1).partitions()] == [1] * 8
    got = {(r.path[-4:], r.line_no): r.line for r in records.read_xz(spark, str(tmp_path)).collect()}
    assert [got["a.xz", i] for i in range(1, 6)] == ["one", "two", "three", "four", "five"]
    assert got["b.xz", 1] == "one" and "five" in got.values()


def test_numbers_of_records_go_on_in_rotated_files(spark, tmp_path):
    import struct

    from emberlog.sources import records

    record = lambda user: struct.pack("<h", 7) + b"\0" * 42 + user.ljust(32, b"\0") + b"\0" * 308
    for k in "ab":
        (tmp_path / k).mkdir()
        (tmp_path / k / "w.0").write_bytes(record(b"u0") + record(b"u1"))
        (tmp_path / k / "w.1").write_bytes(record(b"u2") + b"\7" * 90)
    for rotated, numbers in ((True, [0, 1, 2]), (False, [0, 1, 0])):
        got = sorted((r.path, r.n, r.user) for r in records.read_utmp(spark, str(tmp_path), 1, rotated).collect())
        assert [n for _, n, _ in got] == numbers * 2 and [u for *_, u in got] == ["u0", "u1", "u2"] * 2


def test_times_of_a_key_are_counted_over_its_batches():
    import pandas as pd

    from emberlog.streaming import streams

    frame = lambda *rows: pd.DataFrame({"ts": pd.to_datetime([t for t, _ in rows], unit="us"), "ok": [x for _, x in rows]})
    got = streams._counted(iter([frame((5, True), (3, False), (5, False)), frame((5, True), (1, False))]))
    assert [x.tolist() for x in got] == [[1, 3, 5], [1, 1, 1], [0, 0, 2]]
    assert [x.tolist() for x in streams._counted(iter([frame((2, True), (2, True))]))] == [[2], [0], [2]]


def test_task_files_are_parsed_for_what_they_have_by_all_cores(spark):
    from emberlog.operators import host_state

    xml = "<Task><Actions><ComHandler><ClassId>{1}</ClassId></ComHandler></Actions><Settings><Hidden>TRUE</Hidden></Settings></Task>"
    df = host_state.task_files(spark.createDataFrame([("h", "/t", xml), ("h", "/u", "<Task></Task>"), ("h", "/v", None)], "host string, path string, xml string").coalesce(1))
    assert sorted((r.path, r.command, r.hidden, r.author) for r in df.collect()) == [("/t", "COM:{1}", True, ""), ("/u", "", False, "")]
    assert df.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_chains_meet_as_numbers_and_not_as_sorted_rows(spark):
    from emberlog.operators import logons

    times = spark.createDataFrame([], "src string, dst string, user string, logon_type int, event_id string, status string, ts timestamp, src_case boolean, dst_case boolean")
    plan = logons.pivot_chains(times)._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("SortAggregate(") <= 2  # of one row a chain; pairs of arrivals and departures are hashed


def test_edges_are_counted_without_lists_of_reasons(spark):
    from emberlog.operators import logons

    raw = spark.createDataFrame([("a", "b", "u", 3, "4624", "ok", None, r) for r in (["x"], ["x", "y"], [])], "src string, dst string, user string, logon_type int, event_id string, status string, ts timestamp, reasons array<string>")
    edges = logons.edges(raw, spark.createDataFrame([], "host string, fqdn string, ips array<string>"))
    assert [(r["count"], r.reasons) for r in edges.collect()] == [(3, ["x", "y"])]
    assert any("Aggregate [src" in x and ", reasons" in x.split("]")[0] for x in edges._jdf.queryExecution().analyzed().toString().splitlines())


def test_scans_for_phrases_read_numbers_and_not_texts(spark):
    import numpy as np

    from emberlog.llm import phrases

    rows = spark.createDataFrame([("en", "A b, a b", 0), ("en", "c", 1), ("x\ny", "a. B", 0), ("en", " ,", 2)], "lang string, text string, shard int").coalesce(1)
    got = {r.shard: r for r in phrases._numbered(rows, 3).collect()}
    assert sorted(got) == [0, 1] and got[0].names == ["en", "x\ny"] and got[0].n == [4, 2]
    # words begin pieces where all bits of their number are flipped: a b | a b | a | b
    assert [x < 0 for x in np.frombuffer(got[0].ids, np.int32)] == [True, False, True, False, True, True]
    assert bytes(got[0].spelt).decode() == "abab" and np.frombuffer(got[0].code, np.int32).tolist() == [0, 0, 1, 1]
