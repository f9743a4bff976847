"""Common frame of the two operators that cut repeated windows out of texts.

A window is ``length`` consecutive symbols (words or bytes) of one text. Repeated windows share a winnowed anchor gram at
the same offset, so only the surroundings of repeated anchors need comparing. Whole copies of a text never get there: a
hash of the text finds them, and all of their windows are repeated.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import packed_groups

CONTEXT = "key long, did long, sig long, at long, left int, right int, twin boolean, context binary"
SPANS = "did long, sig long, first long, stop long"


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(did, sig, text): a document is known by its id and a hash of its text, so repeated rows, ids used twice and null
    ids keep apart. Null texts count as empty."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("did"), F.xxhash64(text).alias("sig"), text.alias("text"), F.col(id_col).isNull().alias("no_id"))


def copies(keyed_docs: DataFrame) -> DataFrame:
    """(did, sig, copied) of the documents whose whole text occurs in more than one row. Only digests are shuffled."""
    digests = keyed_docs.select("did", "sig", F.unhex(F.md5("text")).alias("digest"))
    several = digests.groupBy("digest").agg(F.count("*").alias("n")).where("n > 1")
    return digests.join(several, "digest").select("did", "sig").distinct().withColumn("copied", F.lit(True))


def context_rows(keyed_docs: DataFrame, anchors: DataFrame, cut: Callable[[bytes, np.ndarray], tuple]) -> DataFrame:
    """The surroundings of each anchor (key, id, sig, at). ``cut(text, places)`` gives them, and how many symbols lie
    before the anchor and from it on; where ``anchors`` carry no key, it gives the keys too.

    Of surroundings that a task holds more than once (texts of one repeating pattern, near copies), one travels on; the
    others are known to be repeated (``twin``) and go without their text, under a key of their own.
    """
    keyed = "key" in anchors.columns
    place = F.struct(F.col("at").cast("int").alias("at"), *(["key"] if keyed else []))
    wanted = anchors.groupBy(F.col("id").alias("did"), "sig").agg(F.collect_list(place).alias("anchors"))
    # all columns go along, so that ``with_spans`` can reuse this shuffle of the texts
    both = keyed_docs.join(wanted, ["did", "sig"], "left").select("did", "sig", "text", "anchors", "no_id")

    def batch_of(rows: list[list]) -> pa.RecordBatch:
        seen: dict[tuple[int, bytes, int], int] = {}
        key, at, left, context = list(rows[0]), rows[3], rows[4], list(rows[6])
        twin = [False] * len(key)
        for i, same in enumerate(zip(rows[0], rows[6], left, strict=True)):
            first = seen.setdefault(same, i)
            if first != i:
                twin[first] = twin[i] = True
                key[i], context[i] = (rows[1][i] * 31 + at[i]) * 0x9E3779B97F4A7C15 % (1 << 63), None
        columns = (key, rows[1], rows[2], at, left, rows[5], twin, context)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _TYPES, strict=True)], _NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[list] = [[], [], [], [], [], [], []]
        for batch in batches:
            did, sig, text, lists = (batch.column(i) for i in range(4))
            for i in range(batch.num_rows):
                if not lists[i].is_valid:
                    continue
                inner = lists[i].values
                at = inner.field(0).to_numpy(zero_copy_only=False).astype(np.int64)
                at, once = np.unique(at, return_index=True)  # repeated rows bring their anchors again
                pieces, left, right, *given = cut(text[i].as_buffer().to_pybytes(), at)
                key = inner.field(1).to_numpy(zero_copy_only=False)[once] if keyed else given[0]
                n = len(at)
                for column, value in zip(rows, (key.tolist(), [did[i].as_py()] * n, [sig[i].as_py()] * n, at.tolist(), left.tolist(), right.tolist(), pieces), strict=True):
                    column.extend(value)
                if len(rows[0]) > 40_000:
                    yield batch_of(rows)
                    rows = [[], [], [], [], [], [], []]
        if rows[0]:
            yield batch_of(rows)

    return both.mapInArrow(run, CONTEXT)


_NAMES = ["key", "did", "sig", "at", "left", "right", "twin", "context"]
_TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.binary()]


def spans(contexts: DataFrame, length: int, resolve: Callable[[pa.Table], Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]], partitions: int) -> DataFrame:
    """Repeated stretches (did, sig, first, stop). ``resolve`` gets whole anchor groups and gives (row, first, stop)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(table: pa.Table, row: np.ndarray, first: np.ndarray, stop: np.ndarray) -> pa.RecordBatch:
            did, sig = table["did"].to_numpy()[row], table["sig"].to_numpy()[row]
            return pa.RecordBatch.from_arrays([pa.array(x) for x in (did, sig, first, stop)], ["did", "sig", "first", "stop"])

        for table in packed_groups(batches, "key"):
            at, left, right = (table[c].to_numpy().astype(np.int64) for c in ("at", "left", "right"))
            known = np.flatnonzero(table["twin"].to_numpy() & (left + right >= length))
            yield out(table, known, at[known] - left[known], at[known] + right[known])
            table = table.filter(table["context"].is_valid())
            if table.num_rows > 1:
                for row, first, stop in resolve(table):
                    yield out(table, row, first, stop)

    return contexts.repartition(partitions, "key").sortWithinPartitions("key").mapInArrow(run, SPANS)


def runs_of(hit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of True in each row of a matrix: (row, first column, column after the last)."""
    padded = np.zeros((hit.shape[0], hit.shape[1] + 2), np.int8)
    padded[:, 1:-1] = hit
    step = np.diff(padded, axis=1)
    row, first = np.nonzero(step == 1)
    _, stop = np.nonzero(step == -1)
    return row, first, stop


def with_spans(keyed_docs: DataFrame, found: DataFrame, copied: DataFrame) -> DataFrame:
    """(did, no_id, text, copied, spans) for every row of the input."""
    per_doc = found.groupBy("did", "sig").agg(F.collect_list(F.struct("first", "stop")).alias("spans"))
    return keyed_docs.join(per_doc, ["did", "sig"], "left").join(copied, ["did", "sig"], "left").select("did", "no_id", "text", F.coalesce("copied", F.lit(False)).alias("copied"), "spans")


def cover(n: int, lists: pa.Scalar) -> np.ndarray:
    """Mask of length n of what the spans cover."""
    mask = np.zeros(n + 1, np.int32)
    if lists.is_valid:
        inner = lists.values
        np.add.at(mask, inner.field(0).to_numpy(zero_copy_only=False), 1)
        np.add.at(mask, np.minimum(inner.field(1).to_numpy(zero_copy_only=False), n), -1)
    return np.cumsum(mask[:-1]) > 0
