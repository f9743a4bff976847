"""Analyst indicators: labelled regular expressions, a few as Columns or very many by an inverted index.

The index has, of each expression, fixed text that any match must hold (of each of its alternatives), cut into grams of
as many characters as the greatest of ``SIZES`` that it holds, of which one stands for all. Grams of the texts meet those grams in an equi-join, and only what meets is
tried by the expression itself. A list of up to ``SENT`` rows is sent to all tasks: of the texts' grams none is
shuffled, only the numbers of what they met. A longer one, which may be a table, is never in one place: of it tasks get a
bit for each gram, in at most 16 MB, and only grams of texts whose bits are set are shuffled to it, with the text around
them: an expression that sees no further (``reach``) is tried there, others on the whole text. Expressions without such text
are tried on every text, as one alternation first.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark import cloudpickle
from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType, StructField, StructType

from ..functions.plan import computed_once, held

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers need no copy of this module
SIZES = (4, 6, 8)
GRAM = SIZES[0]
SENT = 50_000  # rows of an index that is sent to all tasks
_FACTORS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93)
_BLOCK = 1 << 20  # places of a text whose grams are looked at together
_ROWS = 1 << 14  # grams with the text around them that are written together
_NEAR = 64  # bytes that an expression may reach which is tried around a gram
_PART = re.compile(r"(\||\Z)|(\(\?<?[=!])?(?:(\[\^?[^\[\]\\&^]+\])|\\[!-/:-@\[-`{-~]|[^\\\[\](){}|^$.*+?\x80-\U0010ffff])(?(2)\)|(?:\{(\d{1,2})\})?)")
_WIDTHS = (15, 27)  # bits of a place among the bits of grams, at least and at most
_ALONE = re.compile(r"\\[1-9]|\\k<|\(\?<\w|\(\?[a-zA-Z]|\\Q")


def alone(rx: str) -> bool:
    """Whether an expression changes its meaning, or that of others, as a part of an alternation: it counts or names its
    groups, or sets flags."""
    return bool(_ALONE.search(rx.replace("\\\\", "")))


def any_of(text: Column, expressions: list[str]) -> Column:
    """Whether some expression matches, whatever the case; those that can be are tried as one."""
    together = [rx for rx in expressions if not alone(rx)]
    tests = [text.rlike("(?i)" + "|".join(f"(?:{rx})" for rx in together))] if together else []
    tests += [text.rlike(f"(?i){rx}") for rx in expressions if alone(rx)]
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def java_error(rx: str) -> str | None:
    """What the engine that will run an expression has against it."""
    try:
        SparkSession.builder.getOrCreate()._jvm.java.util.regex.Pattern.compile(f"(?i){rx}")
    except (IllegalArgumentException, Py4JJavaError) as e:  # a PatternSyntaxException, or a stack that is too small for it
        return str(e).splitlines()[0]
    return None


def load_indicators(text: str) -> tuple[list[tuple[str, str]], list[str]]:
    """(label, regular expression) of ``label = regex`` lines and warnings; a bare line is both, ``#`` starts a comment.
    Named groups may be written ``(?P<n>..)`` and ``(?P=n)``. Expressions that Java's engine can't compile are left out
    with a warning."""
    out, warnings = [], []
    for number, line in enumerate(text.splitlines(), 1):
        line = re.sub(r"\s{2,}#.*$", "", line).strip()
        if not line or line.startswith("#"):
            continue
        label, sep, rx = line.partition(" = ")
        label, rx = (label.strip(), rx.strip()) if sep else (line, line)
        rx = re.sub(r"\(\?P=(\w+)\)", r"\\k<\1>", re.sub(r"^%\{", r"%\\{", rx).replace("(?P<", "(?<"))
        wrong = java_error(rx)
        if wrong:
            warnings.append(f"line {number}: {wrong}")
        else:
            out.append((label, rx))
    return out, warnings


def _class_end(rx: str, i: int) -> int:
    """Behind the character class that begins at ``i``; classes nest."""
    depth = 0
    while i < len(rx):
        if rx[i] == "\\":
            i += 1
        elif rx[i] == "[":
            depth += 1
        elif rx[i] == "]" and rx[i - 1] != "[" and rx[i - 2 : i] != "[^":
            depth -= 1
            if not depth:
                return i + 1
        i += 1
    return i


def _group_end(rx: str, i: int) -> int:
    depth = 0
    while i < len(rx):
        if rx[i] == "\\":
            i += 1
        elif rx[i] == "[":
            i = _class_end(rx, i) - 1
        elif rx[i] == "(":
            depth += 1
        elif rx[i] == ")":
            depth -= 1
            if not depth:
                return i + 1
        i += 1
    return i


_REPEAT = re.compile(r"([?*+]|\{(\d+)(?:,\d*)?\})[?+]?")
_CONTROLS = {"t": "\t", "n": "\n", "r": "\r", "f": "\f", "a": "\a", "e": "\x1b"}


def required_texts(rx: str, shortest: int = GRAM) -> list[str]:
    """Of each alternative at the top level, the longest lower-cased text that every match of it holds; an empty list if
    some alternative has none of ``shortest`` characters. It is cautious: groups, classes of more than one character and what
    isn't ASCII hold none."""
    if re.search(r"\\Q|\(\?[a-zA-Z]*[xd-]", rx.replace("\\\\", "")):
        return []
    found: list[list[str]] = [[]]
    run = ""

    def end() -> None:
        nonlocal run
        found[-1].append(run)
        run = ""

    i = 0
    while i < len(rx):
        c, after, letter = rx[i], i + 1, None
        if c == "|":
            end()
            found.append([])
            i += 1
            continue
        if c == "\\":
            e = rx[i + 1 : i + 2]
            after = i + 2
            if e == "x" and re.match(r"[0-9a-fA-F]{2}", rx[i + 2 :]):
                letter, after = chr(int(rx[i + 2 : i + 4], 16)), i + 4
            elif e in _CONTROLS:
                letter = _CONTROLS[e]
            elif e and not e.isalnum():
                letter = e
            elif e == "x" or e in "upPck0N" or e == "":
                return []  # forms that are longer than two characters
        elif c == "(":
            after = _group_end(rx, i)
        elif c == "[":
            after = _class_end(rx, i)
            if after - i == 3 and rx[i + 1] not in "^\\[]&":
                letter = rx[i + 1]  # a class of one character
        elif c not in ".^$":
            letter = c
        repeat = _REPEAT.match(rx, after)
        if letter is None or not letter.isascii():
            end()
        elif not repeat or repeat[1] == "{1}":
            run += letter
        else:
            least = {"?": 0, "*": 0, "+": 1}.get(repeat[1], int(repeat[2] or 0))
            run += letter if least else ""
            end()
            run = letter if least else ""  # what is repeated also begins what follows
        i = repeat.end() if repeat else after
    end()
    best = [max(runs, key=len, default="").lower() for runs in found]
    return best if all(len(b) >= shortest for b in best) else []


def reach(rx: str) -> int | None:
    """How many bytes a match may have, with the characters next to it; null if these are more than ``_NEAR``, or if the
    expression has other parts than characters and classes, with counted repeats, and looks at one of these."""
    at = widest = width = 0
    while at <= len(rx):
        part = _PART.match(rx, at)
        if not part:
            return None
        if part[1] is not None:
            widest, width = max(widest, width), 0
        elif not part[2]:
            width += (4 if part[3] else 1) * int(part[4] or 1)
        at = part.end() + (part[1] == "")
    return widest + 4 if widest + 4 <= _NEAR else None


def _required_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(at, label, f"(?i){rx}", text, alone(rx), reach(rx)) for at, label, rx in zip(*(c.to_pylist() for c in batch.columns), strict=True) for text in required_texts(rx) or [None]]
        kinds = (pa.int32(), pa.string(), pa.string(), pa.string(), pa.bool_(), pa.int32())
        columns = list(zip(*rows, strict=True)) or [[]] * 6
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["at", "label", "rx", "text", "alone", "reach"])


def indicator_index(spark: SparkSession, indicators: list[tuple[str, str]] | DataFrame) -> DataFrame:
    """(at, label, rx, text, gram, alone, reach): an indicator's place, and a row for each text that one of its alternatives
    requires with the gram that stands for it; a null gram if it is to be tried on every text. Of the grams of a text that which is rarest in the list stands for it.
    A list of any length is a table (at, label, rx), whose places are its own."""
    schema = "at int, label string, rx string, text string, alone boolean, reach int"
    if isinstance(indicators, DataFrame):
        table = indicators.select(F.col("at").cast("int"), "label", "rx").mapInArrow(_required_rows, schema)
    else:
        table = spark.createDataFrame([(i, label, f"(?i){rx}", text, alone(rx), reach(rx)) for i, (label, rx) in enumerate(indicators) for text in required_texts(rx) or [None]], schema)
    table = held(table)
    size = "CASE " + " ".join(f"WHEN length(text) >= {n} THEN {n}" for n in reversed(SIZES)) + f" ELSE {GRAM} END"
    grams = table.where("text is not null").select("at", "text", F.explode(F.expr(f"transform(sequence(1, length(text) - {size} + 1), i -> substring(text, i, {size}))")).alias("gram"))
    often = grams.groupBy("gram").agg(F.count("*").alias("n"))
    rarest = grams.join(often, "gram").groupBy("at", "text").agg(F.min(F.struct("n", "gram"))["gram"].alias("gram"))
    return held(table.join(rarest, ["at", "text"], "left").select("at", "label", "rx", "text", "gram", "alone", "reach").distinct())


def grams_of(text: Column, size: int = GRAM) -> Column:
    """The distinct grams of a text, A-Z and others lower-cased; one pass, whatever its length."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(f"(?s)(?=(.{{{size}}}))"), F.lit(1)))


def _places(grams: np.ndarray, width: int, factor: int) -> np.ndarray:
    """Of grams as numbers, one of their places among ``2 ** width`` bits."""
    return (grams * np.uint64(factor)) >> np.uint64(64 - width)


def _gram_bits(grams: DataFrame) -> tuple[np.ndarray, int]:
    """A bitmap of 32 bits for each gram of a table, of which three are set, and the width of a place in it; of 16 MB at most."""
    width = min(max(_WIDTHS[0], (32 * grams.count()).bit_length()), _WIDTHS[1])

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers = np.array([g.encode() for g in batch.column(0).to_pylist()], "S8").view("<u8")
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([_places(numbers, width, f) for f in _FACTORS]).astype(np.int64) + 1)], ["bit"])  # Spark counts bits from 1

    bits = grams.mapInArrow(places, "bit long").groupBy(F.bitmap_bucket_number("bit").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("set"))
    out = np.zeros((1 << width) // 8, np.uint8)
    for row in bits.collect():
        part = np.frombuffer(row["set"], np.uint8)
        out[(row["bucket"] - 1) * len(part) : row["bucket"] * len(part)] = part
    return out, width


def _cut_out(data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> pa.Array:
    """Texts from and to places of bytes."""
    ends = np.append(0, np.cumsum(stop - start))
    return pa.StringArray.from_buffers(len(start), pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data[np.repeat(start - ends[:-1], stop - start) + np.arange(ends[-1])]))


def _grams_that_may_be(texts: DataFrame, grams: DataFrame, margin: int = 0) -> DataFrame:
    """(__id, gram) of texts (__id, __text) whose grams are among those of a table, or share all their bits with some; A-Z
    are lower-cased. A gram has ASCII characters alone, so it is one of a text just where its bytes are. With a ``margin``,
    a row for each place: also ``before`` and ``rest``, the text from so many bytes before the place to it and from there to
    so many behind the gram, and ``cut``: whether there is more before."""
    sizes = [r[0] for r in grams.select(F.length("gram")).distinct().collect()]
    bits, width = _gram_bits(grams)
    sent = texts.sparkSession.sparkContext.broadcast(bits)
    lower = np.array([i + 32 if 65 <= i <= 90 else i for i in range(256)], np.uint8)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value

        def holds(numbers: np.ndarray, factor: int) -> np.ndarray:
            place = _places(numbers, width, factor).view(np.int64)
            return (known[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1

        for batch in batches:
            ids, text = batch.columns
            ends = np.frombuffer(text.buffers()[1], np.int32)[text.offset : text.offset + len(text) + 1].astype(np.int64) if len(text) else np.zeros(1, np.int64)
            if ends[-1] == ends[0]:
                continue
            raw = np.frombuffer(text.buffers()[2], np.uint8)[ends[0] : ends[-1]]
            data = np.append(lower[raw], np.zeros(7, np.uint8))
            begins, ends = ends[:-1] - ends[0], ends[1:] - ends[0]
            numbers = np.ndarray(len(raw), "<u8", data, strides=(1,))  # the eight bytes from each place on
            inside = np.append((raw & 0xC0) == 0x80, False)  # a character
            for size in sizes:
                for a in range(0, len(numbers), _BLOCK):
                    some = numbers[a : a + _BLOCK] & np.uint64((1 << 8 * size) - 1)
                    at = np.flatnonzero(holds(some, _FACTORS[0]))
                    for factor in _FACTORS[1:]:
                        at = at[holds(some[at], factor)]
                    some, at = some[at], at + a
                    owner = np.searchsorted(ends, at, "right")
                    fit = (at + size <= ends[owner]) & (some & np.uint64(0x8080808080808080) == 0)
                    some, at, owner = some[fit], at[fit], owner[fit]
                    if not margin:
                        order = np.lexsort((some, owner))
                        some, owner = some[order], owner[order]
                        new = np.ones(len(some), bool)
                        new[1:] = (some[1:] != some[:-1]) | (owner[1:] != owner[:-1])
                        some, at, owner = some[new], at[order][new], owner[new]
                    for i in range(0, len(at), _ROWS):
                        p, k = at[i : i + _ROWS], owner[i : i + _ROWS]
                        columns = [ids.take(pa.array(k)), _cut_out(data, p, p + size)]
                        if margin:
                            start, stop = np.maximum(begins[k], p - margin), np.minimum(ends[k], p + size + margin)
                            for _ in range(3):
                                start, stop = start - inside[start], stop + inside[stop]
                            columns += [_cut_out(raw, start, p), _cut_out(raw, p, stop), pa.array(start > begins[k])]
                        yield pa.RecordBatch.from_arrays(columns, ["__id", "gram", "before", "rest", "cut"][: len(columns)])

    around = [StructField("before", StringType()), StructField("rest", StringType()), StructField("cut", BooleanType())] if margin else []
    return texts.mapInArrow(run, StructType([texts.schema["__id"], StructField("gram", StringType()), *around]))


def _entries(index: DataFrame) -> DataFrame:
    """(at, label, rx, texts, gram): an indicator with all texts that it requires, for each gram of theirs."""
    entry = ["at", "label", "rx"]
    return index.groupBy(*entry).agg(F.sort_array(F.collect_set("text")).alias("texts"), F.collect_set("gram").alias("grams")).select(*entry, "texts", F.explode("grams").alias("gram"))


def _match_around(texts: DataFrame, index: DataFrame, margin: int) -> DataFrame:
    """(__id, at, label) of indicators that reach ``margin`` bytes at most. A match holds a gram: it begins there or before
    it, and behind the first character of what is cut out, so it has all it looks at."""
    seen = _grams_that_may_be(texts, index.select("gram").distinct(), margin)
    text = F.concat("before", "rest")
    first = F.concat(F.lit("(?i)\\A(?s:.{"), F.when(F.col("cut"), 1).otherwise(0), F.lit(","), F.length("before"), F.lit("})(?:"), F.expr("substring(rx, 5)"), F.lit(")"))
    met = seen.join(_entries(index), "gram").where(F.exists("texts", lambda x: F.contains(F.lower(text), x)) & F.rlike(text, first))
    return met.select("__id", "at", "label").distinct()


def match_many(rows: DataFrame, index: DataFrame, id_col: str, text_col: str, most: int = SENT) -> DataFrame:
    """(``id_col``, at, label) of all indicators of ``index`` that match a text of ``rows``, whose ids should be unique.

    The plan's size doesn't depend on the list, nothing is joined crosswise, and a text comes up for an indicator at most
    once. Grams that no text or no indicator has fall out in the join before texts are looked at again. An index of more
    than ``most`` rows stays a table.
    """
    texts = rows.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")).where("__text is not null")
    keyed = index.where("gram is not null")
    # trying takes time and not space, so texts are dealt out and not put together by their bytes
    dealt = texts.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "__id")
    ends: list[DataFrame] = []
    if index.count() > most:
        wide, near = keyed.where("reach is null"), keyed.where("reach is not null")
        if margin := near.agg(F.max("reach")).first()[0]:
            ends.append(_match_around(texts, near, margin))
        # what may match a text comes to it, so that texts aren't copied
        candidates = None
        if wide.take(1):
            seen = _grams_that_may_be(texts, wide.select("gram").distinct())
            met = seen.join(_entries(wide), "gram").groupBy("__id").agg(F.collect_set(F.struct("at", "label", "rx", "texts")).alias("c"))
            candidates = computed_once(dealt.join(met, "__id"), {"__low": F.lower("__text")}).select("__id", "__text", "__low", F.inline("c"))
    else:
        entries = keyed.groupBy("at", "label", "rx").agg(F.collect_set("text").alias("texts"))
        wanted = keyed.select("gram", "at").distinct()
        # grams of a length that no indicator has aren't cut
        some = lambda n: keyed.agg(F.coalesce(F.max(F.length("gram") == n), F.lit(False)).alias("x")).scalar()
        none = F.array().cast("array<string>")
        cut = F.concat(*(F.when(some(n), grams_of(F.col("__text"), n)).otherwise(none) for n in SIZES))
        # worked out before they are taken apart: else a filter that Spark infers would work them out again
        seen = computed_once(texts.select("__id", "__text"), {"__grams": cut}).select("__id", F.explode("__grams").alias("gram"))
        # a text meets its candidates once, as numbers; the whole required text is looked for before the expression is
        met = seen.join(F.broadcast(wanted), "gram").groupBy("__id").agg(F.collect_set("at").alias("c"))
        candidates = computed_once(dealt.join(met, "__id"), {"__low": F.lower("__text")}).select("__id", "__text", "__low", F.explode("c").alias("at")).join(F.broadcast(entries), "at")
    if candidates is not None:
        ends.append(candidates.where(F.exists("texts", lambda x: F.contains(F.col("__low"), x)) & F.rlike(F.col("__text"), F.col("rx"))).select("__id", "at", "label"))
    rest = index.where("gram is null")
    single = F.struct("at", "label", "rx")
    together = rest.where("not alone").agg(F.coalesce(F.concat(F.lit("(?i)"), F.array_join(F.collect_list(F.concat(F.lit("(?:"), F.substring("rx", F.lit(5), F.length("rx")), F.lit(")"))), "|")), F.lit("(?!)")).alias("x")).scalar()
    each = rest.agg(F.coalesce(F.sort_array(F.collect_list(single)), F.array().cast("array<struct<at:int,label:string,rx:string>>")).alias("x")).scalar()
    odd = rest.agg(F.coalesce(F.max("alone"), F.lit(False)).alias("x")).scalar()
    left = texts.withColumns({"__any": together, "__odd": odd, "__each": each}).where(F.expr("__odd or __text rlike if(__any = '(?i)', '(?!)', __any)"))
    hit = computed_once(left, {"__hits": F.filter("__each", lambda x: F.rlike(F.col("__text"), x["rx"]))}).select("__id", F.explode("__hits").alias("x")).select("__id", "x.at", "x.label")
    return reduce(DataFrame.union, [*ends, hit]).select(F.col("__id").alias(id_col), "at", "label")
