"""Benchmark decontamination with spaced seeds.

A seed is a fixed mask over consecutive tokens that ignores some of them, so a hit survives substitutions there. Hashes
of the masked tokens of texts and benchmark items are joined; around each hit the two are compared token by token.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textvec import Chunk, Words, chunks, mix, ranges, words

#: Some placement of one of these masks avoids any two of twelve consecutive tokens.
MASKS = ("101111", "1110011")
#: Also for items of fewer than _SHORT tokens: avoid any fifth of 5 to 11 tokens.
SHORT_MASKS = ("1101", "1011")
_SHORT = 12
_MANY = 4096  # pairs of equal seeds that are written out; more of one document, item and seed are met as bit strings
_APART = np.ones(256, bool)  # separators: ASCII but letters and digits
_APART[128:] = False
_APART[[*range(48, 58), *range(65, 91), *range(97, 123)]] = False
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_TABLE = 22  # bits of the first lookup


def tokens(chunk: Chunk) -> Words:
    """Runs of letters and digits; A-Z and accented Latin-1 capitals are lower-cased."""
    data = _FOLD[chunk.data]
    latin = np.append(False, chunk.data[:-1] == 0xC3) & (chunk.data >= 0x80) & (chunk.data <= 0x9E) & (chunk.data != 0x97)
    return words(chunk, np.where(latin, data + np.uint8(32), data), _APART)


def seed_hashes(token: np.ndarray, mask: str) -> np.ndarray:
    """Hash of the masked tokens from each place on."""
    n = max(0, len(token) - len(mask) + 1)
    total = np.full(n, len(mask) * 1000003 + int(mask, 2), np.uint64)
    for o, c in enumerate(mask):
        if c == "1":
            total = total * np.uint64(0x9E3779B97F4A7C15) + token[o : o + n]
    return mix(total)


@dataclass
class Items:
    """Benchmark items of one block: their tokens, and the sorted seed hashes with item and place."""

    ids: list
    token: list[np.ndarray]
    hash: np.ndarray
    item: np.ndarray
    place: np.ndarray
    table: np.ndarray
    masks: tuple[str, ...]


def items_of(rows: list[tuple[object, str | None]], window: int = 12) -> Items:
    ids = [r[0] for r in rows]
    token: list[np.ndarray] = []
    for c in chunks(pa.array([r[1] or "" for r in rows], pa.string())):
        w = tokens(c)
        token += [w.hash[a:b] for a, b in zip(w.first[:-1], w.first[1:], strict=True)]
    short = [4 < len(t) and min(window, len(t)) < _SHORT for t in token]
    parts = [(h, i, p) for i, t in enumerate(token) if len(t) > 4 for m in MASKS + SHORT_MASKS * short[i] for p, h in enumerate(seed_hashes(t, m).tolist())]
    value = np.array([p[0] for p in parts], np.uint64)
    order = np.argsort(value, kind="stable")
    value = value[order]
    table = np.zeros(1 << _TABLE, bool)
    table[(value >> np.uint64(64 - _TABLE)).astype(np.int64)] = True
    return Items(ids, token, value, np.array([p[1] for p in parts], np.int64)[order], np.array([p[2] for p in parts], np.int64)[order], table, MASKS + SHORT_MASKS * any(short))


def _shifts(at: np.ndarray, place: np.ndarray) -> np.ndarray:
    """The distinct differences of two lists of places, by bit strings: a shift and an OR for each of the shorter list."""
    flip = len(at) < len(place)
    long_, few = (place, at) if flip else (at, place)
    base, top = int(long_.min()), int(few.max())
    held = 0
    for p in (long_ - base).tolist():
        held |= 1 << p
    met = 0
    for p in few.tolist():
        met |= held << (top - p)
    bits = np.unpackbits(np.frombuffer(met.to_bytes(-(-met.bit_length() // 8), "little"), np.uint8), bitorder="little")
    found = np.flatnonzero(bits) + base - top  # long minus few
    return -found if flip else found


def _alignments(w: Words, items: Items) -> np.ndarray:
    """Distinct (document, item, shift) of all equal seeds, in order."""
    out = [np.zeros((0, 3), np.int64)]
    for m in items.masks:
        value = seed_hashes(w.hash, m)
        at = np.flatnonzero(items.table[(value >> np.uint64(64 - _TABLE)).astype(np.int64)])
        at = at[w.doc[at] == w.doc[at + len(m) - 1]]
        low, high = (np.searchsorted(items.hash, value[at], side) for side in ("left", "right"))
        at, low, high = at[low < high], low[low < high], high[low < high]
        order = np.lexsort((low, w.doc[at]))  # one seed of one document, one after the other
        at, low, high = at[order], low[order], high[order]
        cuts = np.flatnonzero(np.append(True, (low[1:] != low[:-1]) | (w.doc[at[1:]] != w.doc[at[:-1]]))) if len(at) else np.zeros(0, np.int64)
        n = np.diff(np.append(cuts, len(at)))
        many = n * (high - low)[cuts] > _MANY
        plain = np.repeat(~many, n)
        p, k = np.repeat(at[plain], (high - low)[plain]), ranges(low[plain], (high - low)[plain])
        out.append(np.stack([w.doc[p], items.item[k], p - items.place[k]], axis=1))
        for a, b in zip(cuts[many].tolist(), (cuts + n)[many].tolist(), strict=True):
            span = slice(int(low[a]), int(high[a]))
            for item in np.unique(items.item[span]).tolist():
                shift = _shifts(at[a:b], items.place[span][items.item[span] == item])
                out.append(np.stack([np.full(len(shift), w.doc[at[a]]), np.full(len(shift), item), shift], axis=1))
    return np.unique(np.concatenate(out), axis=0)


def overlaps_in(text: pa.Array, items: Items, window: int, percent: int) -> Iterator[tuple[int, int, int, int, int]]:
    """(row, item, first token, token after the last, equal tokens) of each text and item with a verified overlap: from
    the first overlapping token to the last, and the equal tokens of the best alignment."""
    for c in chunks(text):
        w = tokens(c)
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        for doc, item, shift in _alignments(w, items).tolist():
            mine = items.token[item]
            start = int(w.first[doc])
            first, last = max(start, shift), min(int(w.first[doc + 1]), shift + len(mine))
            size = min(window, len(mine))
            if last - first < size:
                continue
            total = np.append(0, np.cumsum(w.hash[first:last] == mine[first - shift : last - shift]))
            good = np.flatnonzero((total[size:] - total[:-size]) * 100 >= percent * size)
            if len(good):
                a, b = int(good[0]), int(good[-1]) + size
                held = best.get((doc, item), (first + a, first + b, 0))
                best[doc, item] = (min(held[0], first + a), max(held[1], first + b), max(held[2], int(total[b] - total[a])))
        for (doc, item), (a, b, n) in best.items():
            yield c.first + doc, item, a - int(w.first[doc]), b - int(w.first[doc]), n


def _blocks(benchmark: DataFrame, most_chars: int, window: int) -> Iterator[Items]:
    """The benchmark in blocks of bounded size, so that what is sent to the executors at once has a bound."""
    held: list[tuple[object, str | None]] = []
    size = 0
    for r in benchmark.select("item_id", "text").where("text is not null").toLocalIterator():
        if held and size + len(r.text) > most_chars:
            yield items_of(held, window)
            held, size = [], 0
        held.append((r.item_id, r.text))
        size += len(r.text)
    if held:
        yield items_of(held, window)


def overlaps(docs: DataFrame, benchmark: DataFrame, window: int = 12, percent: int = 80, most_chars: int = 4_000_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, item_id, first, stop, n_equal): texts that overlap benchmark items, a row for each row and item; from the first
    overlapping token to behind the last one, and the equal tokens of the best alignment.

    Two stretches overlap when ``percent`` of ``window`` consecutive tokens (of the whole item, if it is shorter) are the
    same at the same places; so up to a fifth of the tokens may be replaced, and
    with these defaults every such overlap is found wherever the replaced tokens lie. Items of fewer than five tokens are too short
    to tell and match nothing, as do null and empty texts and items. Repeated rows match each for itself. Rows with a null
    id are reported with it. An empty table on either side gives an empty result; other columns are ignored. The benchmark
    is the query set: it goes to the executors in blocks of at most ``most_chars`` characters, with one pass for each; a
    longer item is a block of its own. Very long and repetitive texts cost what their distinct alignments cost.
    """
    spark = docs.sparkSession
    base = docs.select(F.col(id_col).cast("long").alias("did"), F.col(text_col).alias("text"))
    schema = "did long, item_id long, first long, stop long, n_equal long"
    out = spark.createDataFrame([], schema)
    for items in _blocks(benchmark, most_chars, window):
        sent = spark.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = list(overlaps_in(batch.column(1), sent.value, window, percent))
                if found:
                    row, item, *rest = zip(*found, strict=True)
                    columns = [batch.column(0).take(pa.array(row)), pa.array([sent.value.ids[i] for i in item], pa.int64()), *(pa.array(x, pa.int64()) for x in rest)]
                    yield pa.RecordBatch.from_arrays(columns, ["did", "item_id", "first", "stop", "n_equal"])

        out = out.union(base.mapInArrow(run, schema))
    return out.withColumnRenamed("did", id_col)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = 12, percent: int = 80, most_chars: int = 4_000_000, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without an overlap (see ``overlaps``), with all their columns."""
    spark = docs.sparkSession
    at = docs.columns.index(text_col)
    for items in _blocks(benchmark, most_chars, window):
        sent = spark.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                for row, *_ in overlaps_in(batch.column(at), sent.value, window, percent):
                    keep[row] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
