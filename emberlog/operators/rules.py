"""Detection rules as data: a compiler from rule documents to Columns, and a scan that tries all rules in one pass."""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.plan import computed_once
from .contents import ContentRule
from .indicators import GRAM, grams_of, load_indicators, required_texts  # noqa: F401  load_indicators: its place before

LEVELS = ("critical", "high", "medium", "low", "informational")
AUDIT_CATEGORIES = ("process_creation", "network_connection", "file_event", "file_change", "file_access", "file_delete", "create_remote_thread")
_SERVICE = re.compile(r"^[a-z0-9_.\-]{1,64}$")
_CHUNK = 50  # rules per array, below the size at which generated code falls back


@dataclass
class Rule:
    """One rule: what it is called, where it looks, and its named selections with a condition over them."""

    id: str
    title: str
    level: str
    table: str
    detection: dict
    tags: list[str] = field(default_factory=list)
    service: str | None = None


def load_rule(doc: dict) -> Rule | None:
    """A rule of a parsed rule document; null if it is malformed or is for logs that we don't have."""
    source = doc.get("logsource") or {}
    service, category = (source.get("service") or "").lower() or None, (source.get("category") or "").lower()
    if not isinstance(doc.get("detection"), dict) or "condition" not in doc["detection"] or category == "proxy":
        return None
    if category in ("webserver", "web"):
        table = "web"
    elif service == "auditd" or category in AUDIT_CATEGORIES:
        table, service = "auditd", None
    else:
        table = "syslog"
    if service and not _SERVICE.match(service):
        service = None
    level = (doc.get("level") or "medium").lower()
    return Rule(str(doc.get("id") or doc.get("title")), str(doc.get("title")), level, table, doc["detection"], [str(t) for t in doc.get("tags") or []], service if table == "syslog" else None)


Fields = Callable[[str], Column]


def fields_of(df: DataFrame, lowered: dict[str, str] | None = None, extra: str | None = None) -> Fields:
    """Resolver of rule fields: a column whatever its case, else an entry of the map column ``extra``, else null."""
    names = {c.lower(): c for c in df.columns}

    def field_of(name: str) -> Column:
        if name.lower() in names:
            return F.col(f"`{names[name.lower()]}`").cast("string")
        return F.try_element_at(F.col(extra), F.lit(name)) if extra else F.lit(None).cast("string")

    return field_of


def _like(text: str) -> str:
    """A rule value with ``*`` and ``?`` as a LIKE pattern."""
    out = re.sub(r"([%_\\])", r"\\\1", text)
    return out.replace("*", "%").replace("?", "_")


def value_test(column: Column, modifiers: list[str], value: object) -> Column:
    """One value against a column. Plain values ignore case, ``re`` doesn't."""
    if value is None:
        return column.isNull()
    text = str(value)
    if "re" in modifiers:
        return column.rlike(text)
    if "cidr" in modifiers:
        net, _, bits = text.partition("/")
        low = reduce(lambda a, b: a * 256 + int(b), net.split("."), 0)
        from ..functions.net import ipv4_long

        return ipv4_long(column).between(low, low + (1 << (32 - int(bits))) - 1)
    low, want = F.lower(column), text.lower()
    if "*" in want or "?" in want:
        pattern = _like(want)
        if "contains" in modifiers:
            pattern = f"%{pattern}%"
        elif "startswith" in modifiers:
            pattern = f"{pattern}%"
        elif "endswith" in modifiers:
            pattern = f"%{pattern}"
        return low.like(pattern)
    if "contains" in modifiers:
        return F.contains(low, F.lit(want))
    if "startswith" in modifiers:
        return F.startswith(low, F.lit(want))
    if "endswith" in modifiers:
        return F.endswith(low, F.lit(want))
    return low == want


def _any(tests: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def _all(tests: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def selection(item: object, fields: Fields) -> Column:
    """A selection: a map is all of its fields, a list any of its entries, a bare value a keyword in the message."""
    if isinstance(item, dict):
        tests = []
        for key, values in item.items():
            name, *modifiers = key.split("|")
            several = values if isinstance(values, list) else [values]
            tests.append((_all if "all" in modifiers else _any)(value_test(fields(name), modifiers, v) for v in several))
        return _all(tests)
    if isinstance(item, list):
        return _any(selection(x, fields) for x in item)
    return value_test(fields("message"), [] if "*" in str(item) else ["contains"], item)


_WORD = re.compile(r"\(|\)|[^\s()]+")


@dataclass
class Logic:
    """What and, or and not make of the selections of a condition; ``every`` and ``some`` of lists of them."""

    every: Callable[[list], object]
    some: Callable[[list], object]
    no: Callable[[object], object]


def condition(text: str, selections: dict, logic: Logic | None = None) -> Column:
    """The Column of a condition: names, ``1 of x*``, ``all of them``, and, or, not, parentheses; or what another ``logic``
    makes of it."""
    logic = logic or _COLUMNS
    words = _WORD.findall(text)
    at = 0

    def peek() -> str:
        return words[at].lower() if at < len(words) else ""

    def take() -> str:
        nonlocal at
        at += 1
        return words[at - 1]

    def either() -> Column:
        out = both()
        while peek() == "or":
            take()
            out = logic.some([out, both()])
        return out

    def both() -> Column:
        out = unit()
        while peek() == "and":
            take()
            out = logic.every([out, unit()])
        return out

    def unit() -> Column:
        word = take()
        if word.lower() == "not":
            return logic.no(unit())
        if word == "(":
            out = either()
            if take() != ")":
                raise ValueError(f"unbalanced condition: {text}")
            return out
        if word.lower() in ("1", "any", "all") and peek() == "of":
            take()
            pattern = take()
            chosen = [c for n, c in selections.items() if pattern == "them" or n == pattern or (pattern.endswith("*") and n.startswith(pattern[:-1]))]
            return (logic.every if word.lower() == "all" else logic.some)(chosen)
        if word not in selections:
            raise ValueError(f"unknown selection {word}")
        return selections[word]

    out = either()
    if at < len(words):
        raise ValueError(f"can't read {words[at]} in: {text}")
    return out


_COLUMNS = Logic(_all, _any, lambda c: ~c)


def compile_rule(rule: Rule, fields: Fields) -> Column:
    """The predicate of a rule. Absent fields are null and nulls stay unknown, so ``not`` over them selects nothing."""
    parts = {n: selection(x, fields) for n, x in rule.detection.items() if n not in ("condition", "timeframe")}
    texts = rule.detection["condition"]
    test = _any(condition(t, parts) for t in (texts if isinstance(texts, list) else [texts]))
    if rule.service:
        test = test & F.contains(F.lower(fields("proc")), F.lit(rule.service))
    return test


def _texts_of(key: str, value: object) -> list[str]:
    """Text that a field must hold for a test of a value to pass, of each alternative of the value; empty if none is fixed."""
    _, *modifiers = key.split("|")
    if value is None or "cidr" in modifiers:
        return []
    if "re" in modifiers:
        return required_texts(str(value))
    best = max(re.split(r"[*?]+", str(value).lower()), key=len)
    return [best] if len(best) >= GRAM and best.isascii() else []


Needs = list[tuple[str, str]] | None  # (field, text), one of which must be there; null: nothing is known


def _lesser(a: Needs, b: Needs) -> Needs:
    """Of two lists that both hold, the one that tells more: fewer texts, then longer ones."""
    if a is None or b is None:
        return b if a is None else a
    return min(a, b, key=lambda n: (len(n), -min((len(t) for _, t in n), default=0)))


def _either(parts: Iterable[Needs]) -> Needs:
    out: list[tuple[str, str]] = []
    for p in parts:
        if p is None:
            return None
        out += p
    return out


def _selection_needs(item: object) -> Needs:
    if isinstance(item, dict):
        needs: Needs = None
        for key, values in item.items():
            each = [[(key.partition("|")[0], t) for t in _texts_of(key, v)] or None for v in (values if isinstance(values, list) else [values])]
            needs = _lesser(needs, reduce(_lesser, each, None) if "all" in key.split("|")[1:] else _either(each))
        return needs
    if isinstance(item, list):
        return _either(_selection_needs(x) for x in item)
    return [("message", t) for t in _texts_of("message", item)] or None


_NEEDS = Logic(lambda parts: reduce(_lesser, parts, None), _either, lambda _: None)


def required_by(rule: Rule) -> Needs:
    """(field, text) pairs of which a row that the rule matches holds one at least; null if the rule tells of none, such as
    a rule that is all ``not``."""
    known = {n: _selection_needs(x) for n, x in rule.detection.items() if n not in ("condition", "timeframe")}
    texts = rule.detection["condition"]
    return _either(condition(t, known, _NEEDS) for t in (texts if isinstance(texts, list) else [texts]))


def _looked_up(grams: Column, by_gram: dict[str, list[int]]) -> Column:
    table = F.from_json(F.lit(json.dumps(by_gram)), "map<string,array<int>>")  # constant, folded when planned
    return F.flatten(F.transform(F.array_intersect(grams, F.map_keys(table)), lambda g: F.element_at(table, g)))


def candidates(rules: list[Rule], fields: Fields) -> tuple[Column, list[int]]:
    """The numbers of the rules that a row may match, by the texts that they require, and the rules of which nothing is
    known. Every required text is known by the gram of it that is rarest among the rules; a field's grams are found in one
    pass and meet those of all rules in one lookup, however many these are."""
    needs = [required_by(r) for r in rules]
    grams = lambda text: {text[i : i + GRAM] for i in range(len(text) - GRAM + 1)}
    often = Counter(g for n in needs for _, text in n or [] for g in grams(text))
    index: dict[str, dict[str, list[int]]] = {}
    for i, n in enumerate(needs):
        for name, text in n or []:
            rare = min(grams(text), key=lambda g: (often[g], g))
            own = index.setdefault(name.lower(), {}).setdefault(rare, [])
            if i not in own:
                own.append(i)
    found = []
    for name, by_gram in index.items():
        found.append(_looked_up(grams_of(fields(name)), by_gram))
    none = F.array().cast("array<int>")
    return F.array_distinct(F.concat(none, *(F.coalesce(f, none) for f in found))), [i for i, n in enumerate(needs) if n is None]


def _named(rules: list[Rule]) -> Column:
    return F.array(*(F.struct(F.lit(r.id).alias("rule_id"), F.lit(r.title).alias("rule"), F.lit(r.level).alias("level"), F.lit(" ".join(t for t in r.tags if t.startswith("attack."))).alias("mitre")) for r in rules))


def scan(rows: DataFrame, rules: list[Rule], fields: Fields | None = None, index_from: int = 50) -> DataFrame:
    """``rows`` once for each rule that matches, with rule_id, rule, level and mitre. All rules are tried in one pass; from
    ``index_from`` rules on, a row is tried by those alone of which it holds a required text (``candidates``), to the same
    result. Repeated rows each get theirs."""
    fields = fields or fields_of(rows)
    if not rules:
        return rows.limit(0).select("*", *(F.lit("").alias(c) for c in ("rule_id", "rule", "level", "mitre")))
    if len(rules) >= index_from:
        some, unknown = candidates(rules, fields)
        every = F.array(*(F.lit(i) for i in unknown)).cast("array<int>")
        met = computed_once(rows, {"__some": F.concat(some, every)}).where(F.size("__some") > 0)

        def matches(i: Column) -> Column:
            # a lambda is interpreted, so the code that is generated stays as small as for one rule
            return reduce(lambda c, k: c.when(i == k, compile_rule(rules[k], fields)), range(1, len(rules)), F.when(i == 0, compile_rule(rules[0], fields)))

        hit = computed_once(met, {"__hits": F.filter("__some", matches)}).drop("__some")
    else:
        tests = [F.when(compile_rule(r, fields), F.lit(i)) for i, r in enumerate(rules)]
        chunks = [F.array_compact(F.array(*tests[a : a + _CHUNK])) for a in range(0, len(tests), _CHUNK)]
        hit = computed_once(rows, {"__hits": F.concat(*chunks)}).where(F.size("__hits") > 0)
    return hit.withColumn("__i", F.explode("__hits")).withColumn("__r", F.get(_named(rules), F.col("__i"))).select(*rows.columns, "__r.*")


def level_rank(level: Column) -> Column:
    """critical first, unknown last."""
    at = F.array_position(F.array(*(F.lit(x) for x in LEVELS)), F.lower(level))
    return F.when(at > 0, at).otherwise(len(LEVELS) + 1)


def web_fields(requests: DataFrame) -> DataFrame:
    """Requests under the names that web rules use; ``-`` is null."""
    uri = F.concat(F.col("path"), F.when(F.col("query") != "", F.concat(F.lit("?"), F.col("query"))).otherwise(""))
    dash = lambda c: F.when(F.col(c) != "-", F.col(c))
    return requests.select(
        "*", F.col("method").alias("cs-method"), uri.alias("cs-uri"), F.col("path").alias("cs-uri-stem"), F.col("query").alias("cs-uri-query"), uri.alias("c-uri"),
        F.col("query").alias("c-uri-query"), dash("ua").alias("c-useragent"), dash("ua").alias("cs-user-agent"), dash("referer").alias("cs-referer"),
        F.lit(None).cast("string").alias("cs-host"), F.lit(None).cast("string").alias("cs-cookie"), F.col("status").try_cast("int").alias("sc-status"), uri.alias("message"),
    )


def web_rule_hits(requests: DataFrame, rules: list[Rule], order: list[str]) -> DataFrame:
    """Of each rule and source: hits, first and last time, and a sample of the first match by ``order``."""
    hits = scan(web_fields(requests), [r for r in rules if r.table == "web"])
    sample = F.struct(*(F.col(f"`{c}`").alias(n) for c, n in (("cs-uri", "uri"), ("ua", "ua"), ("method", "method"), ("status", "status"))))
    got = hits.groupBy("rule_id", "rule", "level", "ip").agg(F.count("*").alias("hits"), F.min("time").alias("first_seen"), F.max("time").alias("last_seen"), F.min_by(sample, F.struct(*order)).alias("s"))
    return got.select("rule_id", "rule", "level", "ip", "hits", "first_seen", "last_seen", "s.*").orderBy(level_rank(F.col("level")), F.desc("hits"), "rule_id", "ip")


def content_scan(files: DataFrame, rules: list[ContentRule], content: str = "content", longest: int | None = None) -> DataFrame:
    """``files`` without content, once for each rule that matches: rule, tags and the ids of its strings found. All
    contents count, but those over ``longest`` characters if it is given. Null contents match nothing."""
    found = []
    for r in rules:
        ids = F.array_compact(F.array(*(F.when(F.col(content).rlike(rx), F.lit(i)) for i, rx in r.strings.items())))
        ok = r.test(ids) if r.test else F.size(ids) >= r.least
        found.append(F.when(ok, F.struct(F.lit(r.name).alias("rule"), F.lit(r.tags).alias("tags"), F.array_join(ids, "+").alias("matched"))))
    rest = [c for c in files.columns if c != content]
    got = (files if longest is None else files.where(F.length(content) <= longest)).withColumn("__f", F.explode(F.array_compact(F.array(*found))))
    return got.select(*rest, "__f.*")


def read_rules(spark: SparkSession, path: str) -> list[Rule]:
    """Rules of text files with one JSON document a line, in the order of their ids; what can't be read or is for other logs
    is left out. A list of rules is small: the driver compiles it."""
    found = {}
    for row in spark.read.text(path).where(F.trim("value") != "").collect():
        try:
            rule = load_rule(json.loads(row["value"]))
        except (ValueError, AttributeError):
            continue
        if rule:
            found[rule.id] = rule
    return [found[k] for k in sorted(found)]
