"""Rules over contents of any length: files as lines, put together in chunks that overlap.

A chunk is so many lines of a file, with the end of the chunk before it and the beginning of the one after, so that what
begins in a chunk is in it as a whole if it is no longer than the overlap. What the strings of a rule hit is gathered over
the chunks of a file before conditions are judged. No cell holds more than a chunk, and one file is many tasks.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.plan import held

_AFTER = "\u0001"  # behind a chunk that isn't the last, so that its end is no end of line


@dataclass
class ContentRule:
    """Strings (id, regular expression) and how many must be found: a number, or a Column over the found ids."""

    name: str
    strings: dict[str, str]
    least: int = 1
    tags: str = ""
    test: Callable[[Column], Column] | None = None


def greatest_length(rx: str) -> int | None:
    """How many characters a match can have at most; null if that is unbounded or can't be told."""
    try:
        most = re._parser.parse(re.sub(r"\(\?<(?=\w)", "(?P<", rx)).getwidth()[1]
    except (re.error, AttributeError, OverflowError):
        return None
    return int(most) if most < 1 << 16 else None


def content_chunks(lines: DataFrame, overlap: int, block: int = 4096, by: tuple[str, ...] = ("path",)) -> DataFrame:
    """(*by, chunk, before, text, after, first, last): the text of ``block`` lines each, joined by line breaks, with at most
    ``overlap`` characters of what is before and after it. Needs ``line_no`` from 1 without gaps and ``line``; a null line is
    empty. A block has as many lines as the overlap has characters at least, so one neighbour is enough."""
    block = max(block, overlap)
    key = [*by, "chunk"]
    # a line goes behind its place in the block, of so many digits: half the bytes of a row of both, and in the same order
    wide = len(str(block))
    place = F.lpad(F.expr(f"(line_no - 1) % {block}").cast("string"), wide, "0")
    rows = lines.select(*by, F.expr(f"(line_no - 1) div {block}").alias("chunk"), F.concat(place, F.coalesce("line", F.lit(""))).alias("l"))
    own = held(rows.groupBy(*key).agg(F.array_join(F.transform(F.array_sort(F.collect_list("l")), lambda x: F.substr(x, F.lit(wide + 1))), "\n").alias("text")))
    ends = lambda step, name, cut: own.select(*by, (F.col("chunk") + step).alias("chunk"), cut.alias(name))
    before = ends(1, "before", F.concat(F.right("text", F.lit(overlap - 1)), F.lit("\n")) if overlap > 1 else F.lit("\n"))
    after = ends(-1, "after", F.concat(F.lit("\n"), F.left("text", F.lit(overlap))))
    got = own.join(before, key, "left").join(after, key, "left")
    return got.select(*key, F.coalesce("before", F.lit("")).alias("before"), "text", F.coalesce("after", F.lit("")).alias("after"), F.col("before").isNull().alias("first"), F.col("after").isNull().alias("last"))


def _hits(rx: str) -> Column:
    """Whether an expression matches a chunk as it matches the whole: ``^`` holds in the first chunk alone, ``$`` in the
    last, because elsewhere a character is asked for before the match or behind it."""
    whole = F.concat("before", "text", "after", F.when(F.col("last"), "").otherwise(_AFTER))
    lead, tail = r"(?<=[\s\S])", r"(?=[\s\S])"
    one = F.when(F.col("first") & F.col("last"), whole.rlike(rx)).when(F.col("first"), whole.rlike(f"(?:{rx}){tail}"))
    return one.when(F.col("last"), whole.rlike(f"{lead}(?:{rx})")).otherwise(whole.rlike(f"{lead}(?:{rx}){tail}"))


def _overlap(expressions: list[str], unbounded: int) -> int:
    return max((greatest_length(rx) or unbounded for rx in expressions), default=1) + 1


def content_scan_lines(lines: DataFrame, rules: list[ContentRule], by: tuple[str, ...] = ("path",), unbounded: int = 4096, block: int = 4096) -> DataFrame:
    """(*by, rule, tags, matched) of files given as lines, of any size: a row for each rule that a file meets.

    Chunks overlap by the greatest length of a match. Of an expression without one, matches of up to ``unbounded``
    characters are found wherever they lie, and longer ones if they lie within a chunk. Files without lines aren't there.
    """
    strings = {(i, s): rx for i, r in enumerate(rules) for s, rx in r.strings.items()}
    names = {key: f"__s{n}" for n, key in enumerate(strings)}
    chunks = content_chunks(lines, _overlap(list(strings.values()), unbounded), block, by)
    found = chunks.groupBy(*by).agg(*(F.max(_hits(rx)).alias(names[key]) for key, rx in strings.items()))
    verdicts = []
    for i, r in enumerate(rules):
        ids = F.array_compact(F.array(*(F.when(F.col(names[i, s]), F.lit(s)) for s in r.strings)))
        ok = r.test(ids) if r.test else F.size(ids) >= r.least
        verdicts.append(F.when(ok, F.struct(F.lit(r.name).alias("rule"), F.lit(r.tags).alias("tags"), F.array_join(ids, "+").alias("matched"))))
    return found.withColumn("__f", F.explode(F.array_compact(F.array(*verdicts)))).select(*by, "__f.*")


def webshell_lines(lines: DataFrame, snippet: int | None = None, unbounded: int = 4096, block: int = 4096) -> DataFrame:
    """What ``artifacts.webshells`` finds, of scripts given as lines (host, path, line_no, line): (host, path, indicators,
    snippet) without a limit on their size."""
    from .artifacts import HANDLERS, SCRIPTS, WEB_ROOTS, WEBSHELLS

    shown = lambda c: F.trim(c) if snippet is None else F.left(F.trim(c), F.lit(snippet))
    web = lines.where(F.col("path").rlike(WEB_ROOTS))
    chunks = content_chunks(web.where(F.lower("path").rlike(SCRIPTS)), _overlap([rx for _, rx in WEBSHELLS], unbounded), block, ("host", "path"))
    hits = [_hits(rx) for _, rx in WEBSHELLS]
    own, whole = F.concat("text", "after"), F.concat("before", "text", "after")

    def sample(rx: str) -> Column:
        """The lines of a match that begins in the chunk itself; whole ones, as a chunk ends with a line."""
        at = F.regexp_instr(own, F.lit(rx))
        return F.when((at > 0) & (at <= F.length("text")), F.regexp_extract(own, rf"(?m)^.*?(?:{rx}).*$", 0))

    per = chunks.select("host", "path", "chunk", *(h.alias(f"h{i}") for i, h in enumerate(hits)), *(F.when(h, sample(rx)).alias(f"s{i}") for i, (h, (_, rx)) in enumerate(zip(hits, WEBSHELLS, strict=True))), *(F.when(h, F.regexp_extract(whole, rf"(?m)^.*?(?:{rx}).*$", 0)).alias(f"w{i}") for i, (h, (_, rx)) in enumerate(zip(hits, WEBSHELLS, strict=True))))
    first_of = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("chunk")))
    files = per.groupBy("host", "path").agg(*(F.max(f"h{i}").alias(f"h{i}") for i in range(len(hits))), *(F.coalesce(first_of(f"s{i}"), first_of(f"w{i}")).alias(f"s{i}") for i in range(len(hits))))
    labels = F.array_join(F.array_compact(F.array(*(F.when(F.col(f"h{i}"), F.lit(n)) for i, (n, _) in enumerate(WEBSHELLS)))), ",")
    first = F.coalesce(*(F.when(F.col(f"h{i}"), F.col(f"s{i}")) for i in range(len(hits))))
    one = files.select("host", "path", labels.alias("indicators"), shown(first).alias("snippet")).where("indicators <> ''")
    directive = web.where(F.col("path").endswith("/.htaccess") & ~F.trim("line").startswith("#") & F.col("line").rlike(HANDLERS))
    return one.unionByName(directive.select("host", "path", F.lit("htaccess_handler").alias("indicators"), shown(F.col("line")).alias("snippet")))
