from __future__ import annotations

import ipaddress
import random
from urllib.parse import unquote

import pytest
from pyspark.sql import functions as F

from emberlog.functions import net, strings


def values(spark, rows, f):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(rows)], "i int, x string")
    return [r.y for r in df.select("i", f(F.col("x")).alias("y")).orderBy("i").collect()]


def test_web_decode_like_two_rounds_of_unquote(spark):
    rng = random.Random(1)
    rows = ["".join(rng.choice(["a", "Z", "%2e", "%252e", "+", "%", "%zz", "\\x3c", "/", "%e2%82%ac", "é"]) for _ in range(12)) for _ in range(200)]

    def want(s):
        import re

        s = re.sub(r"\\x([0-9a-fA-F]{2})", lambda m: chr(int(m[1], 16)), s)
        return unquote(unquote(s.replace("+", " "))).lower()

    assert values(spark, rows, strings.web_decode) == [want(s) for s in rows]


@pytest.mark.parametrize(
    ("raw", "want"),
    [("19/May/2026:09:11:17 +0000", "2026-05-19 09:11:17 +0000"), ("19/May/2026:09:11:17", "2026-05-19 09:11:17"), ("junk", "junk")],
)
def test_clf_time(spark, raw, want):
    assert values(spark, [raw], strings.clf_time) == [want]


def test_addresses(spark):
    rows = ["10.0.0.1", "8.8.8.8", "127.0.0.1", "169.254.1.1", "224.0.0.1", "256.1.1.1", "::1", "fe80::1", "2a00:1450::1", "host", "", "1.2.3", "100.64.0.1"]
    got = values(spark, rows, net.is_public_ip)

    def public(x):
        try:
            a = ipaddress.ip_address(x)
        except ValueError:
            return False
        return a.is_global

    assert got == [public(x) for x in rows]
    assert values(spark, rows[:5], net.ip_scope) == ["private", "public", "loopback", "private", "multicast"]
    assert values(spark, ["1.2.3.4"], net.ipv4_long) == [0x01020304]


@pytest.mark.parametrize(
    ("raw", "want"),
    [("CORP.LOCAL\\Administrator", "CORP\\administrator"), ("-\\svc", "svc"), ("-", ""), ("Bob", "bob"), ("CORP\\", ""), ("\\\\x", "x"), (None, "")],
)
def test_clean_user(spark, raw, want):
    assert values(spark, [raw], net.clean_user) == [want]


@pytest.mark.parametrize(
    ("raw", "want"),
    [("ws (10.1.1.1)", "10.1.1.1"), ("ws (-)", "ws"), ("- (::1)", None), ("::ffff:10.0.0.5:3389", "10.0.0.5"), ("-:-", None), ("", None)],
)
def test_extract_src(spark, raw, want):
    assert values(spark, [raw], net.extract_src) == [want]


def test_small_ones(spark):
    assert values(spark, ["MSSQLSvc/db.corp:1433", "HOST$", "krbtgt", "host$@REALM"], net.spn_host) == ["db.corp", "HOST$", "", "host$"]
    assert values(spark, ["[10.0.0.1]:22", "web,10.0.0.2", "(hashed)", "127.0.0.1"], net.kh_target) == ["10.0.0.1", "web", "", ""]
    assert values(spark, ["6c73202d6c", "abc", "zz"], strings.hex_or_same) == ["ls -l", "abc", "zz"]
    assert [str(x) for x in values(spark, ["1700000000", "1700000000000", "1700000000000000", "1700000000000000000"], strings.epoch_time)] == ["2023-11-14 22:13:20"] * 4
