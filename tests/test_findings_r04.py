"""Of each finding of the fourth round, a small case that failed before."""

from __future__ import annotations

import random

from pyspark.sql import functions as F


def test_a_long_list_of_indicators_is_a_table_and_no_broadcast(spark):
    from emberlog.operators import indicators

    rng = random.Random(4)
    vocabulary = sorted({"".join(rng.choice("abcdeé.") for _ in range(rng.randint(2, 11))) for _ in range(300)})
    texts = [None, "", "ABCD abcd", "éabcd😀", "é" * 70 + "eabc" + "é" * 70, "d" * 70 + "eabc eabcd", "eabc eabca" * 9, "12345", "xx yy", *(" ".join(rng.choice(vocabulary).upper() if rng.random() < 0.1 else rng.choice(vocabulary) for _ in range(60)) for _ in range(80))]
    listed = [(w, w.replace(".", "[.]")) for w in vocabulary] + [("digits", r"\d{5}"), ("twice", r"([xy])\1 "), ("or", "abcd|bcde|zzzzz"), ("same", "dddd"), ("same", "dddd"), ("none", "abcdefghij"), ("wide", "abcd.*?e"), ("begins", "^ABCD"), ("looks", "(?<![a-e])eabc(?![a-e])"), ("looks", "(?<=é)abcd[^a]|(?<! )abce")]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string").repartition(3)
    table = spark.createDataFrame([(i, *x) for i, x in enumerate(listed)], "at int, label string, rx string")
    key = lambda df: sorted((r["id"], r["at"], r["label"]) for r in df.collect())
    want = key(indicators.match_many(rows, indicators.indicator_index(spark, listed), "id", "text"))
    got = indicators.match_many(rows, indicators.indicator_index(spark, table), "id", "text", most=10)
    assert key(got) == want and len(want) > 300
    kinds = {x["reach"] is None for x in indicators.indicator_index(spark, table).where("gram is not null").select("reach").distinct().collect()}
    assert kinds == {True, False} and "strategy=broadcast" not in got._jdf.queryExecution().analyzed().toString()


def test_the_list_of_the_indicator_query_is_not_read_by_the_driver(spark, monkeypatch):
    from emberlog.operators import indicators
    from emberlog.plans import catalog

    given = []
    monkeypatch.setattr(indicators, "match_many", lambda rows, index, *a: rows.select("doc_id", F.lit("").alias("label")))
    monkeypatch.setattr(indicators, "indicator_index", lambda spark, listed: given.append(listed))
    catalog.QUERIES["indicator_index"](spark, "/root/testdata/sf0.001")
    assert given[0].columns == ["at", "label", "rx"]
    labels = {r.label: r.rx for r in given[0].collect()}
    assert labels["five digits"] == "(?<![0-9])[0-9]{5}(?![0-9])" and labels["twice"] == r"(?<![a-z])([abcd])\1(?![a-z])" and len(labels) > 1000
    assert all(indicators.required_texts(rx)[0] == w for w, rx in labels.items() if w not in ("five digits", "twice"))


def test_the_reach_of_an_expression():
    from emberlog.operators import indicators

    known = {"abcd": 8, "ab[cd]{2}|x": 14, r"(?<![a-z])a\.b(?!é)": None, r"(?<![a-z])a\.b(?![^é])": 7, "a" * 61: None, "": 4}
    known |= dict.fromkeys(["ab+", "ab?", "a{2,}", "(ab)", "^a", "a$", r"\bab", r"a\d", "a.b", "é", "[a&&b]", "[[a]b]", r"[\d]", "(?=ab)c", "(?i)a", "a]", "(?![a]){2}"], None)
    assert {rx: indicators.reach(rx) for rx in known} == known


def test_tasks_of_a_large_login_database_are_not_as_many_as_its_records(spark, tmp_path):
    import struct

    from emberlog.sources import records

    record = lambda i: struct.pack("<h", 7) + b"\0" * 42 + b"u%d".ljust(32, b"\0") % i + b"\0" * 400
    for name, at in (("w.0", range(2500)), ("w.1", range(2500, 4000))):
        (tmp_path / name).write_bytes(b"".join(record(i)[: records.UTMP] for i in at) + b"\7" * 90)
    parts = records.UtmpReader(str(tmp_path), 1, True).partitions()
    assert len(parts) == 1000 and [(p.stop - p.start) // records.UTMP for p in parts] == [4] * 1000
    assert [p.first for p in parts] == list(range(0, 4000, 4))
    assert len(records.UtmpReader(str(tmp_path), 200, True).partitions()) == 13 + 8
    parts = records.UtmpReader(str(tmp_path), 3000, True).partitions()
    assert [(p.first, r.num_rows) for p in parts for r in records.UtmpReader(str(tmp_path), 1, True).read(p)] == [(0, 2500), (2500, 1500)]


def test_counts_of_phrases_travel_as_numbers(spark, monkeypatch):
    from emberlog.llm import phrases

    made = []
    keep = phrases.materialize
    monkeypatch.setattr(phrases, "materialize", lambda df, name, by=None: made.append((name, df.dtypes)) or keep(df, name, by))
    rows = spark.createDataFrame([(t, lang) for t in ("a b c d", "a b c d. b c", "x, a b") for lang in ("en", "x\ny") for _ in range(6)], "text string, lang string").repartition(3)
    got = {(r.lang, r.phrase): r.n for r in phrases.frequent_phrases(rows, 3, 6).collect()}
    one = {"a": 18, "b": 24, "c": 18, "d": 12, "x": 6, "a b": 18, "b c": 18, "c d": 12, "a b c": 12, "b c d": 12, "": 78}
    assert got == {(lang, p): n for lang in ("en", "x\ny") for p, n in one.items()}
    assert {dict(kinds)["key"] for name, kinds in made if name == "counts"} == {"bigint"}


def test_numbers_are_sent_as_steps():
    import numpy as np

    from emberlog.llm import phrases

    for numbers in ([], [0], [1 << 59], [0, 1, 1 << 33, (1 << 33) + 5, 1 << 59, (1 << 60) - 1], [(1 << 32) - 1, 1 << 33]):
        sent = phrases._steps(np.array(numbers, np.int64))
        assert phrases._climbed(sent).tolist() == numbers and sent[0].dtype == np.uint32
