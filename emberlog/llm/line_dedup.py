"""Fuzzy line deduplication: MinHash over character shingles, banding, exact Jaccard, union-find; one line stays.

Signatures are one-permutation MinHashes. A line with few shingles hashes them several times, so that its bins are filled;
lines near the border of two such classes carry the bands of both.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .linking import group_links
from .repeats import entries, plain_stars
from .shared import materialize, shuffle_partitions
from .textvec import LOWER, SPACE, Chunk, Words, byte_prefix, chunks, distinct_sets, gram_hash, joined_sets, mix, ranges, stretch_hash
from .windows import keyed

BANDS, ROWS = 10, 5
_BINS = BANDS * ROWS
_FILL = 2 * _BINS  # shingle hashes that a line should have at least
_MARKS = 256
_NONE = np.iinfo(np.uint32).max
_BREAK = np.zeros(256, bool)
_BREAK[10] = True


def lines_of(chunk: Chunk) -> tuple[Words, np.ndarray]:
    """Lines that hold more than white space, and the prefix hashes of the chunk's bytes with A-Z lower-cased. ``hash`` tells
    different lines apart; lines that differ in the case of A-Z alone have the same shingles and count as one."""
    prefix = byte_prefix(LOWER[chunk.data])
    breaks = np.flatnonzero(chunk.data == 10)
    cuts = np.unique(np.concatenate([chunk.start, chunk.end, breaks, breaks + 1]))
    start, end = cuts[:-1], cuts[1:]
    if not len(start):
        none = np.zeros(0, np.int64)
        return Words(none, none, none, none.astype(np.uint64), np.zeros(len(chunk.end) + 1, np.int64)), prefix
    solid = np.logical_or.reduceat(~SPACE[chunk.data], start)  # a break alone is white space
    start, end = start[solid], end[solid]
    doc = np.searchsorted(chunk.end, start, side="right")
    return Words(start, end, doc, mix(stretch_hash(prefix, start, end)), np.searchsorted(doc, np.arange(len(chunk.end) + 1))), prefix


def shingle_hashes(prefix: np.ndarray, start: np.ndarray, end: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-byte shingles of stretches, and the stretch of each; shorter ones are one. ``prefix``: prefix hashes
    of the bytes."""
    grams = gram_hash(prefix, k)
    count = np.maximum(end - start - k + 1, 0)
    short = np.flatnonzero(count == 0)
    line = np.concatenate([np.repeat(np.arange(len(start)), count), short])
    value = np.concatenate([grams[ranges(start, count)] if count.any() else np.zeros(0, np.uint64), stretch_hash(prefix, start[short], end[short]) + (end - start)[short].astype(np.uint64)])
    return mix(value), line


def band_keys(value: np.ndarray, line: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(line, key) of all bands of all lines. A class tells how often a line's shingles are hashed; it comes from the number
    of marks that they leave among 256, which repeated shingles don't change, as they don't change the least hashes. One
    more round of hashing serves the next class as well, so a line that carries the bands of two classes costs one."""
    marked = np.zeros(n * _MARKS, bool)
    marked[line * _MARKS + (value >> np.uint64(56)).astype(np.int64)] = True
    size = -_MARKS * np.log1p(-np.minimum(marked.reshape(n, _MARKS).sum(axis=1), _MARKS - 0.5) / _MARKS)
    own, other = (np.clip(np.ceil(np.log2(_FILL / np.maximum(size * x, 1))), 0, 6).astype(np.int64) for x in (1, 0.75))
    least = np.full(n * _BINS, _NONE, np.uint32)
    at, tried = line * _BINS, 0
    out_line, out_key = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for c in range(int(other.max(initial=-1)) + 1):
        if c:
            more = (other >= c)[line]
            value, line, at = value[more], line[more], at[more]
        for _ in range(tried, 1 << c):
            h = value * np.uint64((0x9E3779B97F4A7C15 + tried * 0xA3B2A465A7E65E26) % (1 << 64) | 1)
            h ^= h >> np.uint64(32)
            bin_ = ((h >> np.uint64(32)) * np.uint64(_BINS) >> np.uint64(32)).astype(np.int64)
            bin_ += at
            np.minimum.at(least, bin_, (h * np.uint64(0xA0761D6478BD642F) >> np.uint64(32)).astype(np.uint32))
            tried += 1
        chosen = np.flatnonzero((own == c) | (other == c))
        if not len(chosen):
            continue
        bins = least.reshape(n, _BINS)[chosen].astype(np.uint64)
        empty = bins == np.uint64(_NONE)
        rows = np.flatnonzero(empty.any(axis=1))
        if len(rows):  # an empty bin borrows from the next one that isn't, and tells how far that is
            place = np.where(empty[rows], 4 * _BINS, np.arange(_BINS))
            place = np.minimum.accumulate(np.concatenate([place, place + _BINS], axis=1)[:, ::-1], axis=1)[:, ::-1][:, :_BINS]
            place = np.minimum(place, 2 * _BINS - 1)
            bins[rows] = np.take_along_axis(bins[rows], place % _BINS, 1) + ((place - np.arange(_BINS)).astype(np.uint64) << np.uint64(32))
        bands = bins.reshape(len(chosen), BANDS, ROWS)
        key = np.full((len(chosen), BANDS), c, np.uint64) * np.uint64(BANDS) + np.arange(BANDS, dtype=np.uint64)
        for r in range(ROWS):
            key = mix(key * np.uint64(0xA0761D6478BD642F) + bands[:, :, r])
        out_line.append(np.repeat(chosen, BANDS))
        out_key.append(key.ravel())
    return np.concatenate(out_line), np.concatenate(out_key)


def _bits(ids: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    h = mix(ids.astype(np.uint64))
    return (h % np.uint64(size)).astype(np.int64), (h >> np.uint64(32)).astype(np.int64) % size


def _known(ids: np.ndarray, bits: np.ndarray) -> np.ndarray:
    out = np.ones(len(ids), bool)
    for at in _bits(ids, len(bits) * 8):
        out &= bits[at >> 3] >> (at & 7).astype(np.uint8) & 1 > 0
    return out


def _bloom(members: DataFrame) -> np.ndarray:
    """A bitmap that holds all members: sixteen bits for each, at least 8 kB and at most 8 MB, which is what the executors
    get; a full one only filters less. From at most sixteen tasks, one after the other."""
    size = int(np.clip(1 << (16 * members.count()).bit_length(), 1 << 16, 1 << 26))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(size // 8, np.uint8)
        for batch in batches:
            for at in _bits(batch.column(0).to_numpy(zero_copy_only=False), size):
                np.bitwise_or.at(held, at >> 3, np.uint8(1) << (at & 7).astype(np.uint8))
        yield pa.RecordBatch.from_arrays([pa.array([held.tobytes()], pa.binary())], ["bits"])

    total = np.zeros(size // 8, np.uint8)
    for row in members.select("did").coalesce(16).mapInArrow(run, "bits binary").toLocalIterator():
        total |= np.frombuffer(row.bits, np.uint8)
    return total


def duplicate_lines(docs: DataFrame, percent: int = 80, shingle: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(did, sig, gone): for each document that loses lines, the numbers of those, blank lines counting too."""
    spark = docs.sparkSession
    partitions = shuffle_partitions(spark)
    rows = keyed(docs, id_col, text_col).select("did", "sig", "text")

    def keys(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        for c in chunks(batch.column(2)):
            w, prefix = lines_of(c)
            lid, first = np.unique(w.hash.view(np.int64), return_index=True)
            value, line = shingle_hashes(prefix, w.start[first], w.end[first], shingle)
            at, key = band_keys(value, line, len(lid))
            yield entries(key, lid[at])

    # written first: two Python steps in one stage would take two workers a core
    candidates = connected_components(materialize(plain_stars(rows, keys, partitions), "stars"))
    members = materialize(candidates.withColumnRenamed("node", "did"), "members")
    sieve = spark.sparkContext.broadcast(_bloom(members))

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in chunks(batch.column(2)):
                w, _ = lines_of(c)
                lid, first = np.unique(w.hash.view(np.int64), return_index=True)
                likely = _known(lid, sieve.value)
                lid, first = lid[likely], first[likely]
                data = c.data.tobytes()
                yield pa.RecordBatch.from_arrays([pa.array(lid), pa.array([data[a:b] for a, b in zip(w.start[first].tolist(), w.end[first].tolist(), strict=True)], pa.binary())], ["did", "text"])

    def sets_of(texts: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
        return joined_sets(distinct_sets(*shingle_hashes(byte_prefix(LOWER[c.data]), c.start, c.end, shingle), len(c.end)) for c in chunks(texts))

    likely = rows.mapInArrow(texts, "did long, text binary").dropDuplicates(["did"])
    links = group_links(likely, members, sets_of, percent, partitions)
    found = connected_components(links)

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            did, sig = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
            for c in chunks(batch.column(2)):
                w, _ = lines_of(c)
                breaks = np.append(0, np.cumsum(_BREAK[c.data]))
                number = breaks[w.start] - breaks[c.start[w.doc]]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (w.hash.view(np.int64), did[c.first + w.doc], sig[c.first + w.doc], number)], ["lid", "did", "sig", "number"])

    # both joins are of plain exchanges, so that adaptive execution splits a line that very many documents share
    lines = rows.mapInArrow(places, "lid long, did long, sig long, number long")
    roots = materialize(found.withColumnRenamed("node", "lid"), "roots")
    grouped = lines.join(roots, "lid", "left").select(F.coalesce("root", "lid").alias("line"), "did", "sig", "number")
    grouped = materialize(grouped, "lines")
    first = F.min(F.struct("did", "sig", "number")).alias("first")
    kept = materialize(grouped.groupBy("line").agg(first, F.count("*").alias("n")).where("n > 1").select("line", "first"), "kept")
    gone = grouped.join(kept, "line").where(F.struct("did", "sig", "number") != F.col("first"))
    return gone.groupBy("did", "sig").agg(F.collect_set("number").alias("gone"))


def dedup_lines(docs: DataFrame, percent: int = 80, shingle: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with every near-duplicate line but one removed, and ``n_lines``, ``n_removed`` (not blank lines).

    Lines are near duplicates when the sets of their ``shingle``-byte shingles, A-Z lower-cased, have a Jaccard similarity
    of ``percent`` or more, and through chains of such lines; a shorter line is one shingle. Of each component the line
    with the least (id, hash of the text, line number) stays. White-space lines always stay. Rows with the same id and
    text count as one document; ids that are null count as the least. Null texts stay null; an empty table gives an empty
    one; all columns are kept (own ones named n_lines or n_removed are replaced).
    """
    docs = docs.drop("n_lines", "n_removed")
    gone = duplicate_lines(docs, percent, shingle, id_col, text_col)
    keys = docs.select(F.struct("*").alias("row"), F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("did"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("sig"))
    joined = keys.join(gone, ["did", "sig"], "left")
    text, cut = F.col("row")[text_col], F.col("gone")
    parts = F.split(text, "\n", -1)
    solid = lambda x: F.btrim(x, F.lit(" \t\n\x0b\x0c\r")) != ""
    kept = F.when(cut.isNull(), text).otherwise(F.array_join(F.filter(parts, lambda x, i: ~F.array_contains(cut, i.cast("long"))), "\n"))
    columns = [kept.alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns]
    return joined.select(*columns, F.coalesce(F.size(F.filter(parts, solid)), F.lit(0)).cast("long").alias("n_lines"), F.coalesce(F.size(cut), F.lit(0)).cast("long").alias("n_removed"))
