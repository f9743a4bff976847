"""Chunks of contents, incremental tables, ordered streams, rules reread, variants and record files."""

from __future__ import annotations

import lzma
import random
import re
import struct
from datetime import datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from emberlog.functions import payloads
from emberlog.functions.plan import folders
from emberlog.operators import artifacts, contents, incremental, rules
from emberlog.sources import records
from emberlog.streaming import streams

# Contents


def as_lines(spark, texts: dict[str, str]):
    return spark.createDataFrame([(p, i, line) for p, t in texts.items() for i, line in enumerate(t.split("\n"), 1)], "path string, line_no long, line string").repartition(3)


STRINGS = {"cross": r"ab\ncd", "start": r"^x", "end": r"z\z", "dollar": r"q$", "look": r"(?<=b\n)c", "no": r"a(?!b)", "word": r"\bcd\b", "flag": r"(?i)QQ\nX", "long": r"ab[\s\S]{0,6}zz", "multi": r"(?m)^cd$", "pair": r"([ab])\n\1"}


def test_chunks_match_what_the_whole_matches(spark):
    rng = random.Random(4)
    texts = {f"f{i}": "\n".join(rng.choice(["ab", "cd", "a", "b", "c", "x", "QQ", "Xb", "zz", "z", "q", "", "abcd"]) for _ in range(rng.randint(1, 60))) for i in range(40)} | {"empty": "", "one": "x", "breaks": "\n" * 30}
    known = [contents.ContentRule(k, {k: rx}) for k, rx in STRINGS.items()]
    for block in (1, 13):
        got = {(r["path"], r["rule"]) for r in contents.content_scan_lines(as_lines(spark, texts), known, unbounded=12, block=block).collect()}
        want = {(p, k) for p, t in texts.items() for k, rx in STRINGS.items() if re.search(rx.replace(r"\z", r"\Z").replace("q$", r"q\Z"), t)}
        assert got == want, sorted(got ^ want)[:5]
    assert {k for _, k in want} == set(STRINGS)


def test_conditions_are_judged_over_all_chunks_of_a_file(spark):
    texts = {"far": "needle\n" + "hay\n" * 5000 + "pin", "near": "needle", "none": "hay"}
    rule = contents.ContentRule("both", {"n": "needle", "p": r"hay\npin"}, least=2, tags="t")
    got = contents.content_scan_lines(as_lines(spark, texts), [rule], block=100)
    assert [tuple(r) for r in got.collect()] == [("far", "both", "t", "n+p")]


def test_no_cell_holds_more_than_a_chunk(spark):
    lines = spark.range(300_000).select(F.lit("big").alias("path"), (F.col("id") + 1).alias("line_no"), F.lit("x" * 40).alias("line"))
    cells = contents.content_chunks(lines, 1000, 2000)
    assert cells.agg(F.max(F.length("text") + F.length("before") + F.length("after"))).first()[0] < 2000 * 41 + 2 * 1001
    assert cells.count() == 150
    assert contents.content_scan_lines(lines, [contents.ContentRule("r", {"a": r"x\nx"})], block=2000).count() == 1


@pytest.mark.parametrize(("rx", "n"), [("abc", 3), ("a{2,5}b?", 6), ("a*", None), ("(a|bcd)", 3), (r"(?<n>ab)\d", 3), (r"x\z", None)])
def test_greatest_length(rx, n):
    assert contents.greatest_length(rx) == n


def test_web_shells_by_lines_are_those_by_whole_files(spark):
    bad = {0: "<?php\n" + "// padding\n" * 400 + "eval(base64_decode($_POST['x']));\n", 1: "<?php system($_GET['c']); ?>", 2: "<?php echo 1; ?>", 3: "\n" * 900 + "<?php @eval($_REQUEST['a']);"}
    rows = [("h", f"/var/www/html/a{i}.php", t) for i, t in bad.items()] + [("h", "/var/www/html/.htaccess", "# AddHandler x .jpg\nAddHandler application/x-httpd-php .jpg\n"), ("h", "/home/u/a.php", bad[1])]
    files = spark.createDataFrame(rows, "host string, path string, content string")
    lines = spark.createDataFrame([(h, p, i, x) for h, p, t in rows for i, x in enumerate(t.split("\n"), 1)], "host string, path string, line_no long, line string")
    want = sorted(map(tuple, artifacts.webshells(files).collect()))
    assert sorted(map(tuple, contents.webshell_lines(lines, block=50, unbounded=40).collect())) == want
    assert len(want) >= 3


# Incremental


def digests(spark, rows):
    return spark.createDataFrame(rows, "folder string, host string, digest string")


def test_only_changed_units_are_built_and_the_table_is_that_of_a_full_run(spark, tmp_path):
    at, built = str(tmp_path / "t"), []

    def build(version):
        def work(todo):
            built.append(sorted(map(tuple, todo.collect()), key=str))
            return todo.withColumn("v", F.lit(version)).withColumn("n", F.explode(F.array(F.lit(1), F.lit(2))))

        return work

    rows = lambda: sorted(((r["folder"], r["host"], r["v"], r["n"]) for r in incremental.read(spark, at).collect()), key=str)
    assert incremental.read(spark, at) is None
    first = [("c1", "a", "1"), ("c1", "b", "1"), ("c2", "01", "1"), ("c2", None, "1"), ("c 3/x", "", "1")]
    assert {r["change"] for r in incremental.rebuild(spark, at, digests(spark, first), build(1)).collect()} == {"added"}
    assert [r[:2] for r in rows() if r[1]] == sorted([(f, h) for f, h, _ in first if h] * 2)
    assert incremental.rebuild(spark, at, digests(spark, first), build(9)).count() == 0
    second = [("c1", "a", "2"), ("c1", "b", "1"), ("c2", None, "1"), ("c 3/x", "", "1"), ("c4", "n", "1")]
    told = incremental.rebuild(spark, at, digests(spark, second), build(2))
    assert sorted(map(tuple, told.collect())) == [("c1", "a", "changed"), ("c2", "01", "removed"), ("c4", "n", "added")]
    assert built == [sorted([r[:2] for r in first], key=str), [("c1", "a"), ("c4", "n")]] or built[1] == [("c1", "a"), ("c4", "n")]
    assert len(folders(spark, f"{at}/rows/run=2")) == 2
    assert {(f, h, v) for f, h, v, _ in rows()} == {("c1", "a", 2), ("c1", "b", 1), ("c2", None, 1), ("c 3/x", "", 1), ("c4", "n", 2)}
    assert incremental.vacuum(spark, at) == []
    incremental.rebuild(spark, at, digests(spark, [(f, h, "3") for f, h, _ in second]), build(3))
    assert sorted(incremental.vacuum(spark, at)) == [1, 2]
    assert {v for _, _, v, _ in rows()} == {3}


def test_a_run_that_fails_leaves_the_table_as_it_was(spark, tmp_path):
    at = str(tmp_path / "t")
    incremental.rebuild(spark, at, digests(spark, [("f", "h", "1")]), lambda todo: todo.withColumn("v", F.lit(1)))

    def broken(todo):
        return todo.withColumn("v", F.raise_error(F.lit("stop")).cast("int"))

    with pytest.raises(Exception, match="stop"):
        incremental.rebuild(spark, at, digests(spark, [("f", "h", "2")]), broken).collect()
    assert [r["v"] for r in incremental.read(spark, at).collect()] == [1]
    incremental.rebuild(spark, at, digests(spark, [("f", "h", "2")]), lambda todo: todo.withColumn("v", F.lit(2)))
    assert [r["v"] for r in incremental.read(spark, at).collect()] == [2]


def test_digests_tell_inputs_code_and_settings_apart(spark):
    files = lambda rows: spark.createDataFrame(rows, "folder string, host string, rel_path string, sha256 string")
    one = lambda rows, **k: incremental.unit_digests(files(rows), **k).first()["digest"]
    base = [("f", "h", "a", "1"), ("f", "h", "b", "2")]
    same = one(base, code="c", settings="s")
    assert same == one(base[::-1], code="c", settings="s")
    others = [one(base), one(base[:1], code="c", settings="s"), one([("f", "h", "a", "2"), base[1]], code="c", settings="s"), one([("f", "h", "a", None), base[1]], code="c", settings="s"), one(base, code="d", settings="s"), one(base, code="c", settings="t")]
    assert len({same, *others}) == 7


# Streams

START = datetime(2026, 1, 1)


def run_guesses(spark, at: str, batches: list[list[tuple]], **options) -> list[tuple]:
    """(user, minute, failures) of alerts; each batch runs the stream anew from its checkpoint. Events: (user, minute, ok)."""
    schema = "src string, dst string, user string, ts timestamp, ok boolean"
    Path(at, "in").mkdir(parents=True, exist_ok=True)
    stream = spark.readStream.schema(schema).parquet(f"{at}/in")
    got = None
    for rows in batches:
        spark.createDataFrame([("s", "d", u, START + timedelta(minutes=m), ok) for u, m, ok in rows], schema).coalesce(1).write.mode("append").parquet(f"{at}/in")
        with streams.using(spark, *streams.ROCKSDB):
            got = streams.drain(streams.ordered_brute_force(stream, **options), at=f"{at}/run")
    return sorted((r["user"], round((r["ts"] - START).total_seconds() / 60), r["failures"]) for r in got.collect())


def test_alerts_don_t_depend_on_the_order_of_arrival(spark, tmp_path):
    rng = random.Random(7)
    events = [(rng.choice("abc"), m, rng.random() < 0.3) for m in range(0, 600, 3)]
    end = [("z", 5000, False)]
    want, failed = [], {}
    for u, m, ok in events:
        failed[u] = failed.get(u, 0) + (not ok)
        if ok and failed[u] >= 3:
            want.append((u, m, failed[u]))
    mixed = sorted(events, key=lambda e: e[1] + rng.random() * 50)
    several = [mixed[:70], mixed[70:140], mixed[140:], end]
    assert run_guesses(spark, str(tmp_path / "a"), several, least=3, late="1 hour") == sorted(want)
    assert run_guesses(spark, str(tmp_path / "b"), [events, end], least=3, late="1 hour") == sorted(want)
    kept = spark.read.format("statestore").option("stateVarName", "known").load(str(tmp_path / "a/run/state"))
    assert {r["key"]["user"]: r["value"]["failed"] for r in kept.collect()} == {u: n for u, n in failed.items() if n} or kept.count() <= 3


def test_silent_pairs_are_forgotten_late_events_are_left_out_and_repeats_count(spark, tmp_path):
    batches = [[("a", 0, False)] * 4 + [("a", 1, True), ("a", 1, True)], [("a", 3000, True), ("a", 3001, False)], [("a", 5, True), ("b", 9000, False)], [("c", 20000, False)]]
    got = run_guesses(spark, str(tmp_path), batches, least=3, forget="1 day", late="10 minutes")
    assert got == [("a", 1, 4), ("a", 1, 4)]
    kept = spark.read.format("statestore").option("stateVarName", "known").load(f"{tmp_path}/run/state")
    assert [r["key"]["user"] for r in kept.collect()] == []  # timers have cleared what is silent
    waiting = spark.read.format("statestore").option("stateVarName", "waiting").load(f"{tmp_path}/run/state")
    assert [r["key"]["user"] for r in waiting.collect()] == ["c"]


def test_rules_are_reread_for_every_batch_and_a_batch_run_again_adds_nothing(spark, tmp_path):
    at = str(tmp_path)
    put = lambda *found: spark.createDataFrame([(x,) for x in found], "value string").write.mode("append").text(f"{at}/rules")
    rule = lambda i, word: rules.json.dumps({"id": i, "title": i, "logsource": {}, "detection": {"k": [word], "condition": "k"}})
    feed = lambda *texts: spark.createDataFrame([(t,) for t in texts], "message string").coalesce(1).write.mode("append").parquet(f"{at}/in")
    Path(at, "in").mkdir()
    stream = spark.readStream.schema("message string").parquet(f"{at}/in")
    step = lambda: streams.reread_rule_alerts(stream, f"{at}/rules", f"{at}/out", f"{at}/state").trigger(availableNow=True).start().awaitTermination()
    told = lambda: sorted((r["batch"], r["message"], r["rule_id"]) for r in streams.alerts(spark, f"{at}/out").collect())
    put(rule("one", "alpha"), "no rule", "")
    feed("alpha 1", "beta 1")
    step()
    put(rule("two", "beta"))
    feed("alpha 2", "beta 2")
    step()
    want = [(0, "alpha 1", "one"), (1, "alpha 2", "one"), (1, "beta 2", "two")]
    assert told() == want
    # the commit of the last batch is lost, so it runs again
    (tmp_path / "state/commits/1").unlink()
    (tmp_path / "state/commits/.1.crc").unlink(missing_ok=True)
    step()
    assert told() == want


# Variants


def test_payloads_of_any_shape(spark):
    texts = ['{"a": {"b": 1}}', '[{"b": "x"}]', "18446744073709551616", '{"a": 1', None, "null", '{"a": {"b": null}}', '"s"', '{"odd name": 1.50}']
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", payloads.payload(F.col("t")).alias("v"))
    got = df.orderBy("i").select(payloads.member(F.col("v"), "$.a.b", "$[0].b").alias("b"), payloads.member(F.col("v"), "$", kind="decimal(38,0)").cast("string").alias("n"), payloads.member(F.col("v"), "$['odd name']", kind="double").alias("o")).collect()
    assert [r["b"] for r in got] == ["1", "x", None, None, None, None, None, None, None]
    assert got[2]["n"] == "18446744073709551616"
    assert [r["o"] for r in got][-1] == 1.5
    parts = payloads.members(df, "v").select("i", "pos", "key", F.to_json("item").alias("item")).orderBy("i", "pos").collect()
    assert [tuple(r) for r in parts] == [(0, 0, "a", '{"b":1}'), (1, 0, None, '{"b":"x"}'), (6, 0, "a", '{"b":null}'), (8, 0, "odd name", "1.5")]
    assert payloads.members(df, "v", outer=True).count() == len(texts)
    assert [r["empty"] for r in payloads.shapes(df.withColumn("g", F.lit(1)), "v", "g").collect()] == [2]


# Record files


def record(kind: int, line: str, user: bytes, host: str, sec: int) -> bytes:
    return struct.pack("<hxxi32s4s32s256sii", kind, 1, line.encode(), b"", user, host.encode(), 0, 0) + struct.pack("<I", sec) + b"\0" * 40


def test_one_login_database_is_read_by_several_tasks(spark, tmp_path):
    made = [record(i % 11, f"pts/{i}", b"" if i % 7 == 0 else f"u{i}".encode() if i % 5 else b"\xff\xfe", "10.0.0.1", 1_700_000_000 + i) for i in range(1000)]
    (tmp_path / "wtmp").write_bytes(b"".join(made) + made[0][:100])
    (tmp_path / "tiny").write_bytes(b"x" * 100)
    (tmp_path / "none").write_bytes(b"")
    df = records.read_utmp(spark, str(tmp_path), records=90)
    assert df.rdd.getNumPartitions() == 12
    rows = df.orderBy("n").collect()
    assert [r["n"] for r in rows] == [i for i in range(1000) if i % 7]
    assert rows[0].asDict() | {"path": ""} == {"path": "", "n": 1, "time_utc": rows[0]["time_utc"], "user": "u1", "type": "RUN_LVL", "line": "pts/1", "host": "10.0.0.1"}
    assert {r["type"] for r in rows} >= {"9", "10", "DEAD_PROCESS"}
    assert df.select(F.unix_seconds("time_utc").alias("s"), "n").where("s - n <> 1700000000").count() == 0
    assert df.where("user = '��'").count() == len([i for i in range(1000) if i % 7 and i % 5 == 0])


def test_xz_files_are_read_by_stream(spark, tmp_path):
    text = "".join(f"line {i} äöü\r\n" if i % 3 else f"line {i}\n" for i in range(2000)) + "no end"
    raw = text.encode()
    cuts = [0, 5, 6, 7, 1000, 1001, 9999, 9999, len(raw)]
    streams_ = [lzma.compress(raw[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]
    (tmp_path / "many.xz").write_bytes(streams_[0] + b"\0" * 8 + b"".join(streams_[1:]) + b"\0" * 4)
    (tmp_path / "one.xz").write_bytes(lzma.compress(raw))
    (tmp_path / "cut.xz").write_bytes(b"".join(streams_)[:-30])
    (tmp_path / "empty.xz").write_bytes(lzma.compress(b""))
    (tmp_path / "other.txt").write_bytes(b"x")
    df = records.read_xz(spark, str(tmp_path))
    want = [x.removesuffix("\r") for x in text.split("\n")]
    for name in ("many", "one"):
        got = df.where(F.col("path").endswith(f"{name}.xz")).orderBy("line_no").collect()
        assert [r["line"] for r in got] == want
        assert [r["line_no"] for r in got] == list(range(1, len(want) + 1))
    damaged = [r["line"] for r in df.where(F.col("path").endswith("cut.xz")).orderBy("line_no").collect()]
    assert damaged[:-1] == want[: len(damaged) - 1]
    assert len(damaged) > 400
    assert df.where(F.col("path").rlike("empty|other")).count() == 0
    with (tmp_path / "many.xz").open("rb") as file:
        assert len(records.xz_streams(file, (tmp_path / "many.xz").stat().st_size)) == 8
