"""Jaccard self-join over word-shingle sets with signature trees, down to connected components.

Pairs meet by the pigeonhole principle: sets that are similar enough agree wholly in some of ``k + 1`` or more hashed
parts, k being the most shingles in which they can differ. Sets that share a part form candidate groups; parts that very
many sets share (a common passage) count only for sets that might agree in no others. In each group
a signature tree (nodes with OR-combined bitmaps and size ranges) is traversed against itself, node pairs that cannot
reach the needed overlap are pruned, and what is left is compared exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .linking import group_links
from .repeats import entries, stars
from .shared import materialize, shuffle_partitions
from .textvec import LOWER, Chunk, byte_prefix, chunks, distinct_sets, gram_hash, joined_sets, mix, prefix_hash, stretch_hash, words

def shingle_sets(chunk: Chunk, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of a chunk's documents, sorted within each, and the bounds of each document's set."""
    w = words(chunk, LOWER[chunk.data])
    prefix = prefix_hash(w.hash)
    count = np.diff(w.first)
    docs = len(count)
    grams = gram_hash(prefix, n)
    place = np.flatnonzero(w.first[w.doc[: len(grams)] + 1] - np.arange(len(grams)) >= n) if len(grams) else np.zeros(0, np.int64)
    short = np.flatnonzero((count > 0) & (count < n))
    whole = stretch_hash(prefix, w.first[short], w.first[short + 1]) + count[short].astype(np.uint64) * np.uint64(0xA0761D6478BD642F)
    doc = np.concatenate([w.doc[place], short])
    value = mix(np.concatenate([grams[place], whole]))
    return distinct_sets(value, doc, docs)


def size_classes(percent: int, top: int) -> np.ndarray:
    """Lower bounds of size classes; similar sets lie in the same or in neighbouring classes."""
    bounds = [1]
    while bounds[-1] <= top:
        bounds.append(max(bounds[-1] + 1, -(-bounds[-1] * 100 // percent)))
    return np.array([*bounds, bounds[-1] * 2], np.int64)


def part_keys(value: np.ndarray, first: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, key, spare) of the hashed parts of all sets: each set counts in its own size class and the one below.

    There are a quarter more parts than similar sets can differ in, so these agree in several. Empty parts are left out,
    unless so many are empty that no other need agree. ``spare`` is twice the number of parts that a set shares with any
    similar one at least, plus one in the class below.
    """
    size = np.diff(first)
    doc_of = np.repeat(np.arange(len(size)), size)
    bounds = size_classes(percent, int(size.max(initial=1)))
    level = np.searchsorted(bounds, size, side="right") - 1
    out_doc, out_key, out_spare = [], [], []
    for down in (0, 1):
        at = level - down
        ok = (size > 0) & (at >= 0)
        at = np.maximum(at, 0)
        most = (bounds[at + 1] - 1) * (100 - percent) // percent
        parts = np.where(ok, -(-(most + 1) * 5 // 4), 0)
        base = np.append(0, np.cumsum(parts))
        n = parts[doc_of]
        keep = n > 0
        part = ((value[keep] >> np.uint64(32)) * n[keep].astype(np.uint64) >> np.uint64(32)).astype(np.int64)
        total, full = np.zeros(base[-1], np.uint64), np.zeros(base[-1], bool)
        place = base[doc_of[keep]] + part
        np.add.at(total, place, mix(value[keep] + np.uint64(0x8EBC6AF09C88C6E3)))
        full[place] = True
        doc = np.repeat(np.arange(len(size)), parts)
        spare = np.bincount(doc[full], minlength=len(size)) - most
        which = np.arange(base[-1]) - base[doc] + at[doc] * (1 << 32)
        sent = full | (spare[doc] <= 0)
        out_doc.append(doc[sent])
        out_key.append(mix(total + mix(which.astype(np.uint64) + np.uint64(1)))[sent])
        out_spare.append(np.maximum(spare, 0)[doc[sent]] * 2 + down)
    return np.concatenate(out_doc), np.concatenate(out_key), np.concatenate(out_spare)


def ngram_components(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", shortcut: bool = True) -> DataFrame:
    """(id, n_shingles, component_id) for every row: two documents link when their sets of distinct ``n``-word shingles
    have a Jaccard similarity of ``percent`` or more; component_id is the least id that links reach.

    Words are runs of non-space bytes with A-Z lower-cased; a text of fewer than ``n`` words is one shingle. Null, empty
    and blank texts have no shingles and link with nothing. Rows that share an id count as one document; rows with a null
    id link with nothing and get a null component. Copies of a text are linked through its digest and compared once. An
    empty table gives an empty one; other columns are ignored.
    """
    spark = docs.sparkSession
    partitions = shuffle_partitions(spark)
    all_rows = docs.select(F.col(id_col).cast("long").alias("did"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = all_rows.where("did is not null")

    def keys(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        did = batch.column(0).to_numpy(zero_copy_only=False)
        for c in chunks(batch.column(1)):
            value, first = shingle_sets(c, n)
            doc, key, spare = part_keys(value, first, percent)
            # of copies of a text that lie together the least id sends its parts; ``copies`` links them
            same = stretch_hash(byte_prefix(c.data), c.start, c.end)
            order = np.lexsort((did[c.first : c.first + len(same)], same))
            once = np.zeros(len(same), bool)
            once[order[np.append(True, same[order][1:] != same[order][:-1])]] = True
            sent = once[doc]
            yield entries(key[sent], did[c.first + doc[sent]], 0, spare[sent])

    def sets_of(texts: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
        return joined_sets(shingle_sets(c, n) for c in chunks(texts))

    digests = rows.where("length(text) > 0").select("did", F.unhex(F.md5("text")).alias("digest"))
    # written, so that the join below is one of plain exchanges and adaptive execution splits a text of very many copies
    least = materialize(digests.groupBy("digest").agg(F.min("did").alias("a"), F.count("*").alias("n")).where("n > 1"), "digests")
    # blank texts have no shingles
    blank = rows.where(~F.col("text").rlike(r"[^\x20\x09-\x0D]")).select("did")
    copies = materialize(digests.join(least, "digest").select("a", F.col("did").alias("b")).where("a <> b").join(blank.select(F.col("did").alias("b")), "b", "left_anti").distinct(), "copies")
    candidates = connected_components(stars(rows, keys, partitions))
    members = materialize(candidates.withColumnRenamed("node", "did").join(copies.select(F.col("b").alias("did")), "did", "left_anti"), "members")
    links = group_links(rows, members, sets_of, percent, partitions, shortcut)
    found = connected_components(links.union(copies))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = [np.diff(shingle_sets(c, n)[1]) for c in chunks(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(sizes) if sizes else np.zeros(0, np.int64))], ["did", "n_shingles"])

    counted = all_rows.mapInArrow(count, "did long, n_shingles long")
    return counted.join(found.withColumnRenamed("node", "did"), "did", "left").select(F.col("did").alias(id_col), "n_shingles", F.coalesce("root", "did").alias("component_id"))
