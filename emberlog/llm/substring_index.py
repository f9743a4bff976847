"""Substring deduplication over a log-structured index of window fingerprints.

Each batch becomes an immutable run: a table of (fingerprint, document, place) hashed into buckets by fingerprint and
sorted within them. A new batch is merge-joined with every live run, bucket by bucket and without a shuffle of the
history; runs of one level are merged into one of the next. Fingerprints that occur at another place are candidates;
the words around them are then compared.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import windows
from .shared import materialize, remove, shared_dir, shuffle_partitions
from .textvec import SPACE, Chunk, chunks, gram_hash, mix, prefix_hash, stretch_hash, winnow, words

_RUN = "spot long, id long, sig long, at long, kind int"
_HELD = 400_000  # fingerprints that a task looks at together


class FingerprintIndex:
    """Runs of sorted fingerprints; ``add`` joins a batch with the history and takes it in, ``compact`` merges runs.

    A run is a bucketed table in the shared folder. Its rows are entries (key, id, sig, at) with ``kind``: 0, or 1 for a
    key that is known to be repeated, or 2 for another entry of such a key. Those of kind 2 need no meeting; they lie under
    a number of their own (``spot``), so that a key of very many entries doesn't fill a bucket.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int | None = None, fan: int = 2) -> None:
        self.spark, self.fan = spark, fan
        self.path = path or f"{shared_dir(spark)}/fingerprints-{uuid.uuid4().hex}"
        self.buckets = buckets or shuffle_partitions(spark)
        self.runs: list[tuple[int, str]] = []

    def _write(self, entries: DataFrame, level: int) -> str:
        name = f"run_{uuid.uuid4().hex}"
        entries.write.bucketBy(self.buckets, "spot").sortBy("spot").option("path", f"{self.path}/{name}").saveAsTable(name)
        self.runs.append((level, name))
        return name

    def _drop(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE {name}")
        remove(self.spark, f"{self.path}/{name}")

    def _also_in(self, run: str, other: str) -> DataFrame:
        """Entries of ``run`` whose fingerprint ``other`` has at another place; copies of one text don't count."""
        place = F.struct("sig", "at")
        places = self.spark.table(other).where("kind < 2").groupBy("spot").agg(F.min(place).alias("low"), F.max(place).alias("high"), F.max("kind").alias("known"))
        mine = self.spark.table(run).where("kind < 2")
        return mine.join(places, "spot").where((F.col("known") > 0) | (place != F.col("low")) | (place != F.col("high"))).select("id", "sig", "at")

    def add(self, batch: DataFrame) -> DataFrame:
        """Take in a batch of entries (key, id, sig, at), or of what ``fingerprints`` has made of them. Returns the places (id, sig, at) of entries, new and old, that it
        shows to be repeated; some may have been told of with earlier batches."""
        old = [name for _, name in self.runs]
        settled = batch if "kind" in batch.columns else batch.mapInArrow(_settle, _RUN)
        new = self._write(settled.repartition(self.buckets, "spot"), 0)
        found = [self._also_in(new, new), self.spark.table(new).where("kind > 0").select("id", "sig", "at")]
        for run in old:
            found += [self._also_in(new, run), self._also_in(run, new)]
        hits = materialize(reduce(DataFrame.union, found), "hits")  # so nothing reads runs that are merged away
        self.compact()
        return hits

    def compact(self) -> None:
        """Merge the runs of each level that holds ``fan`` of them into one run of the next level, and delete them. Runs
        share their buckets, so bucket meets bucket and nothing is shuffled."""
        level = 0
        while True:
            same = [name for at, name in self.runs if at == level]
            if len(same) >= self.fan:
                self._write(reduce(DataFrame.union, [self.spark.table(x) for x in same]), level + 1)
                for x in same:
                    self._drop(x)
                self.runs = [x for x in self.runs if x[1] not in same]
            if level >= max(at for at, _ in self.runs):
                return
            level += 1

    def close(self) -> None:
        """Drop all runs. An index that is to serve later batches stays open."""
        for _, name in self.runs:
            self._drop(name)
        self.runs = []
        remove(self.spark, self.path)


def _mark(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    """Entries with ``spot`` and ``kind``: of a key at several places, one entry goes on to meet others, known to be
    repeated, and the rest need not. Of copies of a text, the one of the least id stands for all."""
    table = pa.Table.from_batches(batches)
    key, ident, sig, at = (table.column(i).to_numpy() for i in range(4))
    order = np.lexsort((ident, at, sig, key))
    key, ident, sig, at = (x[order] for x in (key, ident, sig, at))
    once = np.append(True, (key[1:] != key[:-1]) | (sig[1:] != sig[:-1]) | (at[1:] != at[:-1]))[: len(key)]
    key, ident, sig, at = (x[once] for x in (key, ident, sig, at))
    new = np.append(True, key[1:] != key[:-1])[: len(key)]
    begin = np.flatnonzero(new)
    end = np.append(begin[1:], len(key)) - 1
    several = ((sig[begin] != sig[end]) | (at[begin] != at[end]))[np.cumsum(new) - 1]
    kind = np.where(several, np.where(new, 1, 2), 0).astype(np.int32)
    spot = np.where(kind == 2, mix(ident.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + at.astype(np.uint64)).view(np.int64), key)
    return pa.RecordBatch.from_arrays([pa.array(x) for x in (spot, ident, sig, at, kind)], ["spot", "id", "sig", "at", "kind"])


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= _HELD:
            yield _mark(held)
            held, n = [], 0
    if n:
        yield _mark(held)


def fingerprints(keyed_docs: DataFrame, length: int, gram: int) -> DataFrame:
    """Winnowed fingerprints of all windows of ``length`` words as the index keeps them (see ``_mark``); ``at`` counts
    words."""
    width = length - gram + 1

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            did, sig = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
            for c in chunks(batch.column(2)):
                w = words(c)
                grams = gram_hash(prefix_hash(w.hash), gram)
                place = winnow(grams, width, w.first[:-1], np.maximum(w.first[1:] - gram + 1, w.first[:-1]))
                doc = w.doc[place]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (mix(grams[place]).view(np.int64), did[c.first + doc], sig[c.first + doc], place - w.first[doc])], ["key", "id", "sig", "at"])

    return keyed_docs.mapInArrow(lambda batches: _settle(found(batches)), _RUN)


def _whole(column: pa.Array) -> Chunk:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return next(chunks(column, 1 << 62))


def repeated_word_windows(table: pa.Table, length: int, gram: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Rows and bounds (in words) of what repeated windows around the anchors cover; equal hashes are verified."""
    c = _whole(table["context"])
    w = words(c)
    inside = ~SPACE[c.data]
    keep = inside | np.append(False, inside[:-1])  # words and one separator after each
    place = np.append(0, np.cumsum(keep))
    flat = np.where(SPACE[c.data], np.uint8(32), c.data)[keep].tobytes()
    start, end = place[w.start], place[w.end]
    _, segment = np.unique(table["key"].to_numpy(), return_inverse=True)
    left, at = table["left"].to_numpy().astype(np.int64), table["at"].to_numpy()
    prefix = prefix_hash(w.hash)
    anchor, last = w.first[:-1] + left, w.first[1:]
    offsets = length - gram + 1
    rows = np.repeat(np.arange(len(at)), offsets)
    back = np.tile(np.arange(offsets), len(at))
    ok = (back <= left[rows]) & (anchor[rows] - back + length <= last[rows])
    rows, back = rows[ok], back[ok]
    begin = anchor[rows] - back
    value = mix(stretch_hash(prefix, begin, begin + length) + (segment[rows] * offsets + back).astype(np.uint64) * np.uint64(0xD1B54A32D192ED03))
    by = np.argsort(value)
    same = np.flatnonzero(value[by][1:] == value[by][:-1])
    one, two = by[same], by[same + 1]
    a, b = start[begin], end[begin + length - 1]
    true = np.fromiter((flat[p:q] == flat[r:s] for p, q, r, s in zip(a[one].tolist(), b[one].tolist(), a[two].tolist(), b[two].tolist(), strict=True)), bool, len(one))
    hit = np.zeros((len(at), offsets), bool)
    for side in (one[true], two[true]):
        hit[rows[side], back[side]] = True
    for v in np.unique(value[one[~true]]):  # different windows of one hash: group them by their words
        alike: dict[bytes, list[int]] = {}
        for i in np.flatnonzero(value == v):
            alike.setdefault(flat[a[i] : b[i]], []).append(i)
        for group in alike.values():
            hit[rows[group], back[group]] = len(group) > 1
    row, first, stop = windows.runs_of(hit)
    if len(row):
        yield row, at[row] - (stop - 1), at[row] - first + length


def substring_dedup(docs: DataFrame, length: int = 35, gram: int = 8, batches: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Cut every word that a window of ``length`` words covers whose words also start anywhere else in the corpus.

    The rows enter the index in ``batches`` by a hash of their id, as a corpus would over time; the outcome is that of
    all batches together. Returns (id, text: kept words joined by one space, n_words, n_removed, spans), a row for each
    input row. Words are runs of bytes other than ASCII white space. Null and empty texts have no words; repeated rows
    are copies of each other; an empty table gives an empty one; other columns are ignored.
    """
    spark = docs.sparkSession
    rows = windows.keyed(docs, id_col, text_col)
    index = FingerprintIndex(spark)
    hits = []
    for k in range(batches):
        batch = rows.where(F.pmod(F.xxhash64("did"), F.lit(batches)) == k)
        hits.append(index.add(fingerprints(batch.select("did", "sig", "text"), length, gram)))
    index.close()
    found = reduce(DataFrame.union, hits)  # an entry may be found again with a later batch; ``context_rows`` minds that

    reach = length - gram

    def cut(text: bytes, at: np.ndarray) -> tuple:
        data = np.frombuffer(text, np.uint8)
        w = words(Chunk(0, data, np.array([0]), np.array([len(data)])))
        low = np.maximum(at - reach, 0)
        high = np.minimum(at + length, len(w.start))
        key = mix(gram_hash(prefix_hash(w.hash), gram)[at]).view(np.int64)
        return [text[a:b] for a, b in zip(w.start[low].tolist(), w.end[high - 1].tolist(), strict=True)], at - low, high - at, key

    spans = windows.spans(windows.context_rows(rows, found, cut), length, lambda t: repeated_word_windows(t, length, gram), shuffle_partitions(spark))
    whole = windows.with_spans(rows, spans, windows.copies(rows))
    cover, runs_of = windows.cover, windows.runs_of

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.list_(pa.struct([("first", pa.int64()), ("stop", pa.int64())]))]
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for i in range(batch.num_rows):
                held = batch.column(2)[i].as_buffer().to_pybytes().split()
                gone = np.full(len(held), len(held) >= length) if batch.column(3)[i].as_py() else cover(len(held), batch.column(4)[i])
                _, a, b = runs_of(gone[None, :])
                kept, at = [], 0
                for p, q in zip(a.tolist(), b.tolist(), strict=True):
                    kept += held[at:p]
                    at = q
                kept += held[at:]
                for column, x in zip(out, (b" ".join(kept), len(held), len(held) - len(kept), [{"first": p, "stop": q} for p, q in zip(a.tolist(), b.tolist(), strict=True)]), strict=True):
                    column.append(x)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out[0], pa.binary()).cast(pa.string()), *(pa.array(x, k) for x, k in zip(out[1:], kinds[1:], strict=True))], ["did", "no_id", "text", "n_words", "n_removed", "spans"])

    done = whole.mapInArrow(finish, "did long, no_id boolean, text string, n_words long, n_removed long, spans array<struct<first:long,stop:long>>")
    return done.select(F.when(~F.col("no_id"), F.col("did")).alias(id_col), F.col("text").alias(text_col), "n_words", "n_removed", "spans")
