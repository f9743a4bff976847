"""Queries of the operators for long lists: nested address ranges, thousands of indicators, hundreds of rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.plan import with_rank
from ..operators import indicators, rules, web
from .catalog import query
from .derive import spread, table

# Addresses of events: a quarter each IPv4, mapped, short IPv6 and IPv6 written out in capitals.
_A, _B = "CAST(user_id % 30 AS STRING)", "CAST(event_id % 250 AS STRING)"
_ADDRESS = f"""CASE event_id % 4 WHEN 0 THEN concat('93.184.', {_A}, '.', {_B}) WHEN 1 THEN concat('::ffff:93.184.', {_A}, '.', {_B})
  WHEN 2 THEN concat('2a00:1450:', lower(hex(user_id % 30)), '::', lower(hex(event_id % 250))) ELSE concat('2A00:1450:00', lpad(upper(hex(user_id % 30)), 2, '0'), ':0000:0000:0000:0000:00', lpad(upper(hex(event_id % 250)), 2, '0')) END"""
_SQL_ADDRESS = _ADDRESS.replace("lower(hex(user_id % 30))", "printf('%x', user_id % 30)").replace("lower(hex(event_id % 250))", "printf('%x', event_id % 250)").replace("upper(hex(user_id % 30))", "printf('%X', user_id % 30)").replace("upper(hex(event_id % 250))", "printf('%X', event_id % 250)")


@query(f"""WITH e AS (SELECT {_SQL_ADDRESS} AS ip, event_id % 4 < 2 AS four, user_id % 30 AS a, event_id % 250 AS b FROM events),
x AS (SELECT DISTINCT * FROM e),
c AS (SELECT *, CASE WHEN NOT four AND a = 3 AND b >= 128 THEN 'ZZ' WHEN four AND a = 4 AND b BETWEEN 10 AND 200 THEN 'R4' WHEN a < 25 AND a % 2 = 0 THEN 'N' || CAST(a AS VARCHAR) WHEN four THEN 'W4' ELSE 'W6' END AS country,
  CASE WHEN four THEN CASE WHEN a < 8 THEN 64501 END WHEN b < 64 THEN 64600 + a ELSE 64599 END AS number FROM x)
SELECT ip, country, coalesce('AS' || CAST(number AS VARCHAR) || CASE WHEN number = 64599 THEN ' Example Hosting' ELSE ' Net' END, '') AS asn,
  CASE WHEN a = 7 AND b % 10 = 0 THEN 'tor' WHEN number = 64599 THEN 'hosting' WHEN country = 'W4' THEN 'local' ELSE 'foreign' END AS origin FROM c""")
def web_geo_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Origins of addresses half of which are IPv6, from ranges that lie in each other."""
    ips = table(spark, sf_dir, "events").select(F.expr(_ADDRESS).alias("ip"))
    nation = table(spark, sf_dir, "nation").where("n_nationkey % 2 = 0").select(F.col("n_nationkey").alias("k"))
    own = F.concat(F.lit("N"), F.col("k").cast("string"))
    four = nation.select(F.concat(F.lit("93.184."), F.col("k").cast("string"), F.lit(".0/24")).alias("network"), own.alias("country"))
    six = nation.select(F.concat(F.lit("2a00:1450:"), F.lower(F.hex("k")), F.lit("::/48")).alias("network"), own.alias("country"))
    few = [("93.184.0.0/16", "W4"), ("2a00::/11", "W6"), ("2a00:1450:3::80/121", "ZZ"), ("not an address", "??"), ("1.2.3.4/40", "??")]
    # one range that isn't a block: 93.184.4.10 to 93.184.4.200
    cut = [(f"93.184.4.{x}/{n}", "R4") for x, n in ((10, 31), (12, 30), (16, 28), (32, 27), (64, 26), (128, 26), (192, 29), (200, 32))]
    countries = four.union(six).union(spark.createDataFrame(few + cut, "network string, country string"))
    k = table(spark, sf_dir, "events").select((F.col("user_id") % 30).alias("k")).distinct()
    narrow = k.select(F.concat(F.lit("2a00:1450:"), F.lower(F.hex("k")), F.lit("::/122")).alias("network"), (F.lit(64600) + F.col("k")).cast("long").alias("number"), F.lit("Net").alias("org"))
    wide = spark.createDataFrame([("93.184.0.0/21", 64501, "Net"), ("2a00:1450::/32", 64599, "Example Hosting")], "network string, number long, org string")
    tor = table(spark, sf_dir, "events").where("user_id % 30 = 7 and event_id % 250 % 10 = 0").select(F.expr(_ADDRESS).alias("ip"))
    # both spellings of an address are one address
    return web.geo_origin(ips, countries, narrow.union(wide), tor, home="W4")


@query(f"""WITH d AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9]+')) AS w FROM documents)
SELECT doc_id, w AS label FROM d WHERE length(w) >= 8 UNION ALL SELECT doc_id, 'five digits' FROM documents WHERE regexp_matches(text, '(^|[^0-9])[0-9]{{5}}($|[^0-9])')
UNION ALL SELECT doc_id, 'twice' FROM documents WHERE regexp_matches(text, '(?i)([^a-z]|^)(aa|bb|cc|dd)([^a-z]|$)')""")
def indicator_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hundreds of thousands of indicators, every longer word of the documents, tried on whole documents."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    words = docs.select(F.explode(F.regexp_extract_all(F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit("[a-z0-9]+"), F.lit(0))).alias("w")).where(F.length("w") >= 8).distinct()
    # the list is a table of its own, as long as there are words; four ways of writing an expression go by a word's place
    w, i = F.col("w"), F.col("rank") - 1
    begins, ends = F.lit("(?<![a-z0-9])"), F.lit("(?![a-z0-9])")
    sixth = F.when(i % 3 == 0, F.substring(w, 6, 1)).otherwise(F.concat(F.lit("["), F.substring(w, 6, 1), F.lit("]")))
    rx = F.concat(begins, F.substring(w, 1, 5), sixth, F.expr("substring(w, 7)"), F.when(i % 5 == 0, "{1}").otherwise(""), ends, F.when(i % 7 == 0, F.concat(F.lit("|"), begins, w, ends)).otherwise(""))
    listed = with_rank(words.orderBy("w")).select(i.alias("at"), w.alias("label"), rx.alias("rx"))
    few = [(-2, "five digits", r"(?<![0-9])[0-9]{5}(?![0-9])"), (-1, "twice", r"(?<![a-z])([abcd])\1(?![a-z])")]
    listed = listed.union(spark.createDataFrame(few, "at long, label string, rx string"))
    return indicators.match_many(docs, indicators.indicator_index(spark, listed), "doc_id", "text").select("doc_id", "label")


def _index_rule(i: int) -> dict:
    """One of five kinds of rules about user i."""
    user = f"user-{i:05d}"
    return {
        "id": f"r{i:03d}", "title": f"User {i}", "level": rules.LEVELS[i % 5], "logsource": {},
        "detection": (
            {"a": {"message|contains": f"{user} "}, "condition": "a"},
            {"a": {"message|contains|all": [f"of {user}", "Purchase"]}, "condition": "a"},
            {"a": {"message|contains": user}, "b": {"kind": "CLICK"}, "condition": "a and not b"},
            {"a": {"message|re": f"user-[0]*{i}[ ]from|{user} FROM"}, "b": {"message": f"*{user}*"}, "condition": "all of them"},
            {"sel_a": {"message|startswith": f"Session of {user}", "kind": ["view", "signup"]}, "sel_b": {"props": f'{{"k": {i}}}'}, "condition": "1 of sel_*"},
        )[i % 5],
    }


@query("""WITH r AS (SELECT unnest(range(225)) AS i)
SELECT event_id, 'r' || printf('%03d', i) AS rule_id FROM events JOIN r ON (user_id = i AND (i % 5 = 0 OR i % 5 = 1 AND event_type = 'purchase' OR i % 5 = 2 AND event_type <> 'click' OR i % 5 = 3 OR i % 5 = 4 AND event_type IN ('view', 'signup')))
  OR (i % 5 = 4 AND props = '{"k": ' || CAST(i AS VARCHAR) || '}')""")
def rule_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """225 rules over all events in one scan."""
    e = table(spark, sf_dir, "events")
    rows = e.select("event_id", F.col("event_type").alias("kind"), "props", F.concat(F.lit("session of user-"), F.lpad(F.col("user_id").cast("string"), 5, "0"), F.lit(" from "), F.col("event_type")).alias("message"))
    return rules.scan(rows, [rules.load_rule(_index_rule(i)) for i in range(225)]).select("event_id", "rule_id")
