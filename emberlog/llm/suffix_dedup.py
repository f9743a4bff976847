"""Suffix-array deduplication of byte strings, sorted deep-shallow.

Suffixes are sorted where anchors lie, forwards from the anchor and backwards from it: multikey quicksort orders them to
a shallow depth, and blind tries order the groups that still agree there. The common-prefix lengths of both orders tell
which windows around the anchors are equal, so no window is compared with all others.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import windows
from .repeats import entries, repeated
from .shared import materialize, shuffle_partitions
from .textvec import byte_prefix, chunks, gram_hash, winnow

SHALLOW = 32


def multikey_sort(words: np.ndarray, segment: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order rows of ``words`` (n x d, big-endian 8-byte symbols) within ``segment`` by multikey quicksort.

    Every round splits all open segments at once, each around its own pivot symbol, into less, equal and greater; only
    the equal part moves on to the next symbol. Returns the order and, for it, the segment of rows equal throughout.
    """
    n, depth_limit = words.shape
    order = np.argsort(segment, kind="stable")
    group = np.zeros(n, np.int64)
    group[1:] = np.cumsum(segment[order][1:] != segment[order][:-1])
    depth = np.zeros(n, np.int64)  # by place
    while n:
        size = np.bincount(group)
        open_ = (size[group] > 1) & (depth < depth_limit)
        if not open_.any():
            break
        at = np.flatnonzero(open_)
        g = group[at]
        new = np.ones(len(at), bool)
        new[1:] = g[1:] != g[:-1]
        first = np.flatnonzero(new)
        count = np.diff(np.append(first, len(at)))
        symbol = words[order[at], depth[at]]
        local = np.cumsum(new) - 1
        pivot = symbol[first + count // 2][local]
        side = (symbol > pivot).astype(np.int64) * 2 + (symbol == pivot)
        by = np.argsort(local * 3 + side, kind="stable")
        order[at] = order[at][by]
        depth[at] = depth[at][by] + (side[by] == 1)
        sub = (local * 3 + side)[by]
        cut = np.zeros(n, bool)
        cut[1:] = group[1:] != group[:-1]
        cut[at[1:]] |= sub[1:] != sub[:-1]
        group = np.cumsum(cut)
    return order, group


def blind_trie_order(strings: list[bytes], members: list[int]) -> tuple[list[int], list[int]]:
    """Order ``members`` by their strings with a blind trie; also the common prefix of each with the one before it.

    Inner nodes know only the depth at which their children differ and one byte for each child. A string descends by
    these bytes alone, is compared once with the leaf it reaches, and branches off at their common prefix. A string that
    ends sorts before its extensions.
    """
    root: list = [members[0]]  # a leaf: the members with one same string
    for m in members[1:]:
        s = strings[m]
        node = root
        while isinstance(node, tuple):
            d, kids = node
            node = kids.get(s[d] if d < len(s) else -1) or next(iter(kids.values()))
        t = strings[node[0]]
        if s == t:
            node.append(m)
            continue
        k = min(len(s), len(t))
        diff = int.from_bytes(s[:k], "big") ^ int.from_bytes(t[:k], "big")
        common = k - (diff.bit_length() + 7) // 8
        above, byte, node = None, 0, root
        while isinstance(node, tuple) and node[0] < common:
            above, byte = node, s[node[0]] if node[0] < len(s) else -1
            node = node[1][byte]
        mine = s[common] if common < len(s) else -1
        if isinstance(node, tuple) and node[0] == common:
            node[1][mine] = [m]
        else:
            fork = (common, {t[common] if common < len(t) else -1: node, mine: [m]})
            if above is None:
                root = fork
            else:
                above[1][byte] = fork
    order: list[int] = []
    lcp: list[int] = []
    stack: list = [(root, 0)]
    while stack:
        node, shared = stack.pop()
        if isinstance(node, tuple):
            d, kids = node
            ordered = sorted(kids)
            for c in reversed(ordered[1:]):
                stack.append((kids[c], d))
            stack.append((kids[ordered[0]], shared))
        else:
            order += node
            lcp.append(shared)
            lcp += [len(strings[node[0]])] * (len(node) - 1)
    return order, lcp


def deep_shallow(strings: list[bytes], segment: np.ndarray, shallow: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """Order strings within ``segment`` and give each one's common prefix with the one before (0 at a segment's start)."""
    n = len(strings)
    head = np.frombuffer(b"".join(s[:shallow].ljust(shallow, b"\0") for s in strings), ">u8").reshape(n, shallow // 8).astype(np.uint64)
    order, group = multikey_sort(head, segment)
    lcp = np.zeros(n, np.int64)
    differ = head[order[1:]] != head[order[:-1]]
    same_segment = segment[order[1:]] == segment[order[:-1]]
    word = differ.argmax(axis=1)
    x = np.take_along_axis(head[order[1:]] ^ head[order[:-1]], word[:, None], 1)[:, 0]
    shift = np.array([56, 48, 40, 32, 24, 16, 8], np.uint64)
    zeros = (x[:, None] >> shift == 0).sum(axis=1)
    length = np.fromiter(map(len, strings), np.int64, n)
    lcp[1:] = np.where(differ.any(axis=1), word * 8 + zeros, shallow)
    lcp[1:] = np.where(same_segment, np.minimum(lcp[1:], np.minimum(length[order[1:]], length[order[:-1]])), 0)
    first = np.flatnonzero(np.append(True, group[1:] != group[:-1])) if n else np.zeros(0, np.int64)
    size = np.diff(np.append(first, n))
    for a, k in zip(first[size > 1].tolist(), size[size > 1].tolist(), strict=True):
        got, depth = blind_trie_order(strings, order[a : a + k].tolist())
        order[a : a + k] = got
        lcp[a + 1 : a + k] = depth[1:]
    return order, lcp


def repeated_windows(table: pa.Table, length: int, gram: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Rows and bounds of the bytes around anchors that repeated windows cover."""
    _, segment = np.unique(table["key"].to_numpy(), return_inverse=True)
    left, at = table["left"].to_numpy(), table["at"].to_numpy()
    context = table["context"].to_pylist()
    n = len(context)
    after = [c[k:] for c, k in zip(context, left.tolist(), strict=True)]
    before = [c[:k][::-1] for c, k in zip(context, left.tolist(), strict=True)]
    right = np.fromiter(map(len, after), np.int64, n)
    order_r, lcp_r = deep_shallow(after, segment)
    order_l, lcp_l = deep_shallow(before, segment)
    fresh_r = np.append(True, segment[order_r][1:] != segment[order_r][:-1])
    fresh_l = np.append(True, segment[order_l][1:] != segment[order_l][:-1])
    offsets = length - gram + 1
    hit = np.zeros((n, offsets), bool)
    class_r, class_l = np.empty(n, np.int64), np.empty(n, np.int64)
    for o in range(offsets):
        valid = np.flatnonzero((left >= o) & (right >= length - o))
        if len(valid) < 2:
            continue
        class_r[order_r] = np.cumsum(fresh_r | (lcp_r < length - o))
        class_l[order_l] = np.cumsum(fresh_l | (lcp_l < o))
        pair = class_l[valid] * (n + 1) + class_r[valid]
        by = np.argsort(pair)
        same = pair[by][1:] == pair[by][:-1]
        hit[valid[by[1:][same]], o] = True
        hit[valid[by[:-1][same]], o] = True
    row, first, stop = windows.runs_of(hit)
    if len(row):
        yield row, at[row] - (stop - 1), at[row] - first + length


def suffix_dedup(docs: DataFrame, length: int = 200, gram: int = 32, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Cut every byte that a ``length``-byte string covers which also starts anywhere else in the corpus.

    Returns (id, text binary: what remains, n_bytes, n_removed, n_spans, spans array<struct<first, stop>>), a row for
    each input row. Strings lie within one document; overlaps count; all are judged on the input. Null texts count as
    empty; texts shorter than ``length`` and empty ones stay as they are; repeated rows are copies of each other and go
    in full; an empty table gives an empty one; other columns are ignored. The shuffled anchors are about 2 in
    ``length - gram`` places, and only repeated ones carry text.
    """
    spark = docs.sparkSession
    n = shuffle_partitions(spark)
    width = length - gram + 1
    reach = length - gram

    def anchors(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        did, sig = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
        for c in chunks(batch.column(2)):
            grams = gram_hash(byte_prefix(c.data), gram)
            place = winnow(grams, width, c.start, np.maximum(c.end - gram + 1, c.start))
            doc = np.searchsorted(c.end, place, side="right")
            yield entries(grams[place], did[c.first + doc], sig[c.first + doc], place - c.start[doc])

    def cut(text: bytes, at: np.ndarray) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        low, high = np.maximum(at - reach, 0), np.minimum(at + length, len(text))
        return [text[a:b] for a, b in zip(low.tolist(), high.tolist(), strict=True)], at - low, high - at

    rows = windows.keyed(docs, id_col, text_col)
    found = materialize(repeated(rows.select("did", "sig", "text"), anchors, n), "anchors")
    spans = windows.spans(windows.context_rows(rows, found, cut), length, lambda t: repeated_windows(t, length, gram), n)
    whole = windows.with_spans(rows, spans, windows.copies(rows))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for i in range(batch.num_rows):
                data = np.frombuffer(batch.column(2)[i].as_buffer(), np.uint8)
                gone = np.full(len(data), len(data) >= length) if batch.column(3)[i].as_py() else cover(len(data), batch.column(4)[i])
                _, a, b = windows.runs_of(gone[None, :])
                kept = data[~gone].tobytes() if len(a) else data.tobytes()
                for column, x in zip(out, (kept, len(data), int(gone.sum()), len(a), [{"first": p, "stop": q} for p, q in zip(a.tolist(), b.tolist(), strict=True)]), strict=True):
                    column.append(x)
            kinds = [pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.struct([("first", pa.int64()), ("stop", pa.int64())]))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(x, k) for x, k in zip(out, kinds, strict=True))], ["did", "no_id", "text", "n_bytes", "n_removed", "n_spans", "spans"])

    cover = windows.cover
    done = whole.mapInArrow(finish, "did long, no_id boolean, text binary, n_bytes long, n_removed long, n_spans long, spans array<struct<first:long,stop:long>>")
    return done.select(F.when(~F.col("no_id"), F.col("did")).alias(id_col), F.col("text").alias(text_col), "n_bytes", "n_removed", "n_spans", "spans")


