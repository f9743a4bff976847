"""Nested address ranges, long lists of indicators and of rules, against plain versions."""

from __future__ import annotations

import ipaddress
import random
import re

import pytest
from pyspark.sql import functions as F

from emberlog.functions import net
from emberlog.operators import indicators, networks, rules, web

ADDRESSES = [
    "1.2.3.4", "::1", "::", "::ffff:8.8.8.8", "::FFFF:808:808", "2a00:1450:4001::1", "2A00:1450:4001:0:0:0:0:1", "fe80::1", "fc00::", "64:ff9b::1.2.3.4", "64:ff9b:1::", "1:2:3:4:5:6:7:8",
    "1:2:3:4:5:6:1.2.3.4", "1::", "::8", "1:2:3:4:5:6:7::", "::2:3:4:5:6:7:8", "2001:db8::a", "2001:0DB8:0::A", "100::5", "ff02::1", "::ffff:10.0.0.1", "::ffff:127.0.0.1", "100.64.0.1", "255.255.255.255",
]
NOT = ["", "x", "1.2.3", "1.2.3.4.5", "01.2.3.4", "256.1.1.1", ":::", "1:2", "1:2:3:4:5:6:7:8:9", "1::2::3", "12345::", "::1.2.3", "::ffff:1.2.3.400", "g::", "1:2:3:4:5:6:7:1.2.3.4", "1:2:3:4:5:6:7:8::", None]


def test_addresses_are_read_as_the_standard_library_reads_them(spark):
    rows = spark.createDataFrame([(a,) for a in ADDRESSES + NOT], "ip string").select("ip", net.ip_hex(F.col("ip")).alias("h"), net.is_ip(F.col("ip")).alias("ok"), net.is_private_ip(F.col("ip")).alias("private"), net.is_public_ip(F.col("ip")).alias("public")).collect()
    for r in rows:
        if r["ip"] in ADDRESSES:
            a = ipaddress.ip_address(r["ip"])
            number = int(a) + (0xFFFF << 32) if a.version == 4 else int(a)
            plain = (a.ipv4_mapped or a) if a.version == 6 else a
            assert (r["h"], r["ok"]) == (f"{number:032x}", True), r["ip"]
            if plain not in (ipaddress.ip_address("::"), ipaddress.ip_address("100.64.0.1"), ipaddress.ip_address("64:ff9b:1::")):
                assert r["private"] == plain.is_private, r["ip"]
        else:
            assert (r["h"], r["ok"], r["private"], r["public"]) == (None, False, False, False), r["ip"]


def test_the_longest_prefix_counts(spark):
    rng = random.Random(1)
    listed = []
    for i in range(300):
        if i % 2:
            bits = rng.choice([0, 8, 13, 16, 22, 24, 31, 32])
            network = ipaddress.ip_network((rng.choice([0x5DB80000, 0x0A000000]) + rng.getrandbits(12), bits), strict=False)
        else:
            bits = rng.choice([0, 11, 32, 33, 47, 48, 64, 121, 127, 128])
            network = ipaddress.ip_network(((0x2A001450 << 96) + (rng.getrandbits(3) << 80) + rng.getrandbits(7), bits), strict=False)
        listed.append((str(network), f"v{i:03d}"))
    addresses = [str(ipaddress.ip_address(rng.choice([0x5DB80000, 0x0A000000]) + rng.getrandbits(12))) for _ in range(150)] + [str(ipaddress.ip_address((0x2A001450 << 96) + (rng.getrandbits(3) << 80) + rng.getrandbits(7))) for _ in range(150)]
    addresses += ["::ffff:" + a for a in addresses[:20]] + ["9.9.9.9", "abc", None, addresses[0]]
    want = []
    for a in addresses:
        best = None
        try:
            ip = ipaddress.ip_address(a)
        except ValueError:
            ip = None
        if ip is not None:
            ip = (ip.ipv4_mapped or ip) if ip.version == 6 else ip
            own = [((n.prefixlen + (96 if n.version == 4 else 0)), v) for text, v in listed for n in [ipaddress.ip_network(text)] if n.version == ip.version and ip in n or (ip.version == 4 and str(n) == "::/0")]
            longest = max((b for b, _ in own), default=None)
            best = min((v for b, v in own if b == longest), default=None)
        want.append((a, best))
    nets = networks.prefixes(spark.createDataFrame([*listed, ("rubbish", "x"), ("1.2.3.4/33", "x"), (None, "x")], "network string, v string"), ["v"])
    got = networks.with_network(spark.createDataFrame([(a,) for a in addresses], "ip string"), nets, "ip", ["v"])
    assert sorted(map(str, ((r["ip"], r["v"]) for r in got.collect()))) == sorted(map(str, want))


def test_ranges_are_cut_into_aligned_blocks(spark):
    spans = [(0, 2**32 - 1), (5, 5), (1, 6), (10, 200), (2**24 - 3, 2**24 + 5), (7, 3), (2**32 - 1, 2**32 - 1)]
    got = networks.prefixes(spark.createDataFrame([(a, b, f"{a}-{b}") for a, b in spans], "first long, last long, v string"), ["v"]).collect()
    for a, b in spans:
        want = set() if a > b else {(n.prefixlen + 96, int(n.network_address)) for n in ipaddress.summarize_address_range(ipaddress.ip_address(a), ipaddress.ip_address(b))}
        assert {(r["bits"], int(bytes(r["net"])[12:].hex(), 16)) for r in got if r["v"] == f"{a}-{b}"} == want


def test_no_range_is_cut_at_every_sixteenth_bit(spark):
    nets = networks.prefixes(spark.createDataFrame([(0, 2**32 - 1, "all")], "first long, last long, v string"), ["v"])
    assert nets.count() == 1


def test_mapped_and_plain_addresses_have_one_origin(spark):
    ips = spark.createDataFrame([(x,) for x in ("::ffff:8.8.8.8", "8.8.8.8", "2a00:1450:4001::1", "::ffff:10.1.1.1", "2001:4860::1", "x")], "ip string")
    countries = spark.createDataFrame([("8.0.0.0/9", "US"), ("2a00:1450::/32", "IE")], "network string, country string")
    asn = spark.createDataFrame([("8.8.8.0/24", 15169, "Some Cloud")], "network string, number long, org string")
    tor = spark.createDataFrame([("2001:4860:0:0::1",)], "ip string")
    got = {r["ip"]: (r["country"], r["origin"]) for r in web.geo_origin(ips, countries, asn, tor, "IE").collect()}
    assert got == {"::ffff:8.8.8.8": ("US", "hosting"), "8.8.8.8": ("US", "hosting"), "2a00:1450:4001::1": ("IE", "local"), "::ffff:10.1.1.1": ("LAN", "private"), "2001:4860::1": ("?", "tor"), "x": ("?", "unknown")}


# Indicators


def test_what_only_the_running_engine_refuses_is_a_warning(spark):
    text = "a = x(?P<n>a)(?P=n)\nb = (?(1)a|b)()\nc = q{,3}\nd = (?<=a|bcd*)x\ne = ok\nf = (?P<n>b)"
    got, warnings = indicators.load_indicators(text)
    assert [label for label, _ in got] == ["a", "e", "f"] or [label for label, _ in got] == ["a", "d", "e", "f"]
    assert [w.split(":")[0] for w in warnings if "line 4" not in w] == ["line 2", "line 3"]
    df = spark.createDataFrame([("xaa",), ("OK",), ("bb",), (None,)], "t string")
    assert [r["l"] for r in df.select(web.match_indicators(F.col("t"), got).alias("l")).collect()] == [["a"], ["e"], ["f"], []]


@pytest.mark.parametrize(
    ("rx", "texts"),
    [
        ("abcdef", ["abcdef"]), (r"ab\.cd/ef", ["ab.cd/ef"]), ("abc(def)ghijk", ["ghijk"]), ("abcd?efgh", ["efgh"]), ("abcd+efgh", ["defgh"]), ("abcde*", ["abcd"]), ("a{3}bcde", ["abcde"]), ("xyzzy{0,2}q", ["xyzz"]),
        ("abcd|efgh", ["abcd", "efgh"]), ("abcd|ef", []), ("(abcd|efgh)", []), (r"\d{5}", []), (r"\bword\b", ["word"]), ("[abc]defg[h(]ijkl", ["defg"]), (r"\Qabcd\E", []), ("(?x)ab cd", []), ("ab.cdef", ["cdef"]), ("WORDs", ["words"]),
        (r"[\]x]abcd", ["abcd"]), ("[]x]abcd", ["abcd"]), ("[a&&[^b]]cdef", ["cdef"]), (r"\x41bcd", ["abcd"]), (r"\Abcd", []), (r"\p{L}abcd", []), ("abcdé", ["abcd"]), (r"(?<![a-z])word(?!x|y)", ["word"]), (r"(a\)b)cdef", ["cdef"]),
    ],
)
def test_required_texts(rx, texts):
    assert indicators.required_texts(rx) == texts


def test_many_indicators_match_what_each_does_alone(spark):
    rng = random.Random(2)
    vocabulary = ["".join(rng.choice("abcdeé.") for _ in range(rng.randint(2, 9))) for _ in range(300)]
    texts = [None, "", "ABCD abcd", "12345", "xx yy", *(" ".join(rng.choice(vocabulary).upper() if rng.random() < 0.1 else rng.choice(vocabulary) for _ in range(60)) for _ in range(80))]
    listed = [(f"w{i}", re.escape(w)) for i, w in enumerate(vocabulary)] + [("digits", r"\d{5}"), ("twice", r"([xy])\1 "), ("named", r"(?<n>[ab])\k<n>\k<n>"), ("or", "abcd|bcde|zzzzz"), ("opt", "abcd?e"), ("same", "dddd"), ("same", "dddd")]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string").repartition(3)
    got = sorted((r["id"], r["at"]) for r in indicators.match_many(rows, indicators.indicator_index(spark, listed), "id", "text").collect())
    python = [re.compile(rx.replace("(?<n>", "(?P<n>").replace("\\k<n>", "(?P=n)"), re.IGNORECASE | re.ASCII) for _, rx in listed]
    assert got == sorted((i, k) for i, t in enumerate(texts) if t is not None for k, rx in enumerate(python) if rx.search(t))
    assert indicators.match_many(rows, indicators.indicator_index(spark, [("none", "qqqqq")]), "id", "text").collect() == []


def test_the_plan_of_many_indicators_is_as_small_as_that_of_few(spark):
    rows = spark.createDataFrame([(1, "abcd")], "id int, text string")
    sizes = []
    for n in (3, 3000):
        plan = indicators.match_many(rows, indicators.indicator_index(spark, [(f"l{i}", f"word{i:05d}") for i in range(n)]), "id", "text")._jdf.queryExecution().optimizedPlan().toString()
        assert "Join Cross" not in plan
        assert "Join Inner\n" not in plan
        sizes.append(len(re.sub(r"#\d+L?", "", plan)))
    assert abs(sizes[0] - sizes[1]) < 300


# Rules


def document(i: int, rng: random.Random) -> dict:
    words = [f"w{rng.randrange(40):02d}xy" for _ in range(3)]
    kinds = [
        {"a": {"message|contains": words[0]}, "condition": "a"},
        {"a": {"message|contains|all": words[:2]}, "condition": "a"},
        {"a": {"message|endswith": words[0], "kind": ["x", "longer kind"]}, "b": {"message|contains": words[2]}, "condition": "a or b"},
        {"a": {"message|re": f"{words[0]}.*{words[1]}|{words[2]}$"}, "condition": "a"},
        {"a": {"message": f"*{words[0]}*{words[1]}*"}, "b": {"kind": "x"}, "condition": "a and not b"},
        {"keywords": [words[0], words[1].upper()], "condition": "keywords"},
        {"s_a": {"message|startswith": words[0]}, "s_b": {"message|contains": words[1]}, "condition": "1 of s_*"},
        {"a": {"kind": "x"}, "condition": "not a"},
        {"a": {"kind": None}, "condition": "a"},
        {"a": {"absent": "words"}, "condition": "a"},
        {"a": [{"message|contains": words[0]}, {"kind": "longer kind"}], "condition": "all of them"},
        {"a": {"message|contains": "xy"}, "b": {"message|contains": words[1]}, "condition": "not (a and not b)"},
    ]
    return {"id": f"r{i}", "title": f"R{i}", "level": "low", "tags": ["attack.t1"], "logsource": {}, "detection": kinds[i % len(kinds)]}


def test_rules_by_index_match_what_each_does_alone(spark):
    rng = random.Random(5)
    wanted = [rules.load_rule(document(i, rng)) for i in range(96)]
    rows = [(i, " ".join(f"w{rng.randrange(40):02d}xy" for _ in range(rng.randint(0, 12))), rng.choice(["x", "longer kind", None])) for i in range(150)] + [(500, None, None), (501, "", "x"), (500, None, None)]
    df = spark.createDataFrame(rows, "id int, message string, kind string").repartition(3)
    pick = lambda got: sorted((r["id"], r["rule_id"], r["mitre"]) for r in got.collect())
    want = pick(rules.scan(df, wanted, index_from=10_000))
    assert pick(rules.scan(df, wanted, index_from=1)) == want
    assert len(want) > 300


def test_required_texts_of_rules_are_few(spark):
    rng = random.Random(5)
    known = [rules.required_by(rules.load_rule(document(i, rng))) for i in range(12)]
    assert known[1] is not None and len(known[1]) == 1  # all of several: one is enough
    assert len(known[2]) == 2
    assert known[7] is None and known[8] is None and known[11] is None
    assert len(known[5]) == 2


def test_a_null_byte_far_into_the_file_but_within_the_probe_is_seen(spark):
    good = '1.2.3.4 - - [19/May/2026:09:11:17 +0000] "GET / HTTP/1.1" 200 1'
    rows = [(p, i, good) for p in ("late", "far", "clean") for i in range(1, 1200)]
    rows[100] = ("late", 101, good + "\0")
    rows[1199 + 1150] = ("far", 1151, "\0")
    got = web.is_access_log(spark.createDataFrame(rows, "path string, line_no long, line string"))
    assert sorted(r["path"] for r in got.collect()) == ["clean", "far"]
