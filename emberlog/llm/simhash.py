"""SimHash near-duplicates: fingerprints of 64 bits and all links between those that differ in a few.

Links are found by the generalised pigeonhole principle. Bits that go together are grouped into partitions. Every
fingerprint spreads its tolerance over the partitions by dynamic programming on how many candidates each partition would
give it: if allowances (threshold + 1, nought being "don't look here") sum to the distance + 1, every fingerprint within
the distance differs in some partition by no more than its threshold. Probes look up what a fingerprint's projection
turns into with that many flipped bits, and what they meet is verified by counting differing bits.

A projection that very many fingerprints share isn't compared in pairs: what is left of the bits is partitioned anew, so
its group falls apart by a second projection, a third, and so on, until groups are small. Copies of a text have one
fingerprint and count once.

Null texts, empty ones and those without words have fingerprint zero and link like any other. Null ids don't take part in
the least id of a component; where all are null it is null. Repeated ids are rows of their own. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, count
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .shared import materialize, summed
from .textvec import LOWER, U64, chunks, words

_LOW_BITS = U64(0x0101010101010101)
_BLOCK = 1 << 16  # shingles that are hashed together
_KEY_COST = 50.0  # candidates that one more probe is worth
_SEED = 42


def _add_bits(counts: np.ndarray, hashes: np.ndarray, doc: np.ndarray) -> None:
    """Add to ``counts`` (documents by 64) how often each bit is set in the hashes of each document. Eight counters of a
    byte each go through one sum, over at most 255 hashes."""
    new = np.append(True, doc[1:] != doc[:-1])
    begin = np.flatnonzero(new)
    cut = np.flatnonzero((np.arange(len(doc)) - begin[np.cumsum(new) - 1]) % 255 == 0)
    for j in range(8):
        lanes = np.add.reduceat(hashes >> U64(j) & _LOW_BITS, cut)
        np.add.at(counts[:, j::8], doc[cut], lanes.view(np.uint8).reshape(-1, 8))


def _fingerprints(column: pa.Array, n: int) -> np.ndarray:
    from xxhash import xxh64_intdigest

    out = np.zeros(len(column), U64)
    for chunk in chunks(column):
        data = LOWER[chunk.data]
        w = words(chunk, data)
        docs = len(chunk.end)
        held = np.diff(w.first)
        size = w.end - w.start
        stop = np.cumsum(size + 1) - 1  # the words again, joined by one space each
        joined = np.full(int(stop[-1]) + 1 if len(stop) else 0, 0x20, np.uint8)
        letters = np.ones(len(joined), bool)
        letters[stop] = False
        inside = np.zeros(len(data) + 1, np.int8)
        np.add.at(inside, w.start, 1)
        np.add.at(inside, w.end, -1)
        joined[letters] = data[np.cumsum(inside[:-1]) > 0]
        many = np.where(held > 0, np.maximum(held - n + 1, 1), 0)
        doc = np.repeat(np.arange(docs), many)
        one = w.first[doc] + np.arange(len(doc)) - np.repeat(np.append(0, np.cumsum(many)[:-1]), many)
        last = np.minimum(one + n, w.first[doc + 1]) - 1
        a, b = stop[one] - size[one], stop[last]
        raw = joined.tobytes()
        counts = np.zeros((docs, 64), np.int64)
        for i in range(0, len(doc), _BLOCK):
            at = slice(i, i + _BLOCK)
            hashes = np.fromiter((xxh64_intdigest(raw[x:y], _SEED) for x, y in zip(a[at].tolist(), b[at].tolist(), strict=True)), U64, len(a[at]))
            _add_bits(counts, hashes, doc[at])
        bits = 2 * counts > many[:, None]
        out[chunk.first : chunk.first + docs] = np.packbits(bits, axis=1, bitorder="little").view(U64).ravel()
    return out


def with_fingerprint(docs: DataFrame, n: int = 3, text_col: str = "text", fp_col: str = "fp", id_col: str = "doc_id") -> DataFrame:
    """(``id_col``, ``fp_col`` long): the SimHash of each document's shingles of ``n`` words, A-Z lower-cased, each as often
    as it is there; a text of fewer words is one shingle. A bit is set if it is in over half the hashes (XXH64, seed 42)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_fingerprints(batch.column(1), n).view(np.int64))], [id_col, fp_col])

    return docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).alias("text")).mapInArrow(run, f"`{id_col}` long, `{fp_col}` long")


def bit_statistics(fps: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints and how often each pair of bits is set together, over all of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((64, 65))
        for batch in batches:
            raw = np.ascontiguousarray(batch.column(0).to_numpy()).view(np.uint8).reshape(-1, 8)
            for i in range(0, len(raw), 1 << 14):
                bits = np.unpackbits(raw[i : i + (1 << 14)], axis=1, bitorder="little").astype(np.float64)
                total[:, :64] += bits.T @ bits
                total[0, 64] += len(bits)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()])], ["v"])

    total = summed(fps.select("fp").mapInArrow(run, "v binary"), fps.rdd.getNumPartitions())
    total = total.reshape(64, 65) if len(total) else np.zeros((64, 65))
    return int(total[0, 64]), total[:, :64]


def group_bits(n: int, together: np.ndarray, parts: int) -> list[list[int]]:
    """Partitions of the 64 bits, of even sizes: each begins with the free bit that is most correlated with others and takes
    in, one by one, the free bit that is most correlated with those it has."""
    p = np.diag(together) / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    near = np.abs(together / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread)
    np.fill_diagonal(near, 0)
    free, out = set(range(64)), []
    for i in range(parts):
        rest = sorted(free)
        part = [max(rest, key=lambda b: (near[b, rest].sum(), -b))]
        while len(part) < (64 - 64 * i // parts) - (64 - 64 * (i + 1) // parts):
            part.append(max(sorted(free - set(part)), key=lambda b: (near[b, part].sum(), -b)))
        free -= set(part)
        out.append(sorted(part))
    return out


def allowances(fp: np.ndarray, counted: np.ndarray, n: int, p: np.ndarray, parts: list[list[int]], distance: int) -> np.ndarray:
    """Per fingerprint and partition, its threshold + 1, summing to ``distance`` + 1, of least estimated cost.

    ``counted``: fingerprints with the same projection, which is what a threshold of nought meets. What flipped bits add is
    estimated from how often each bit is set. A dynamic program over partitions adds up costs of candidates and probes.
    """
    sums = distance + 1
    best = np.full((len(fp), sums + 1), np.inf)
    best[:, 0] = 0
    taken = []
    for i, part in enumerate(parts):
        bits = (fp[:, None] >> np.array(part, U64) & U64(1)).astype(bool)
        same = np.clip(np.where(bits, p[part], 1 - p[part]), 1e-6, 1 - 1e-6)
        flips = np.zeros((len(fp), sums))  # by how many bits are flipped, the share of fingerprints there
        flips[:, 0] = same.prod(axis=1)
        for b in range(len(part)):
            odds = (1 - same[:, b]) / same[:, b]
            flips[:, 1:] += flips[:, :-1] * odds[:, None]
        cost = np.zeros((len(fp), sums + 1))
        cost[:, 1:] = counted[:, i, None] + np.cumsum(np.where(np.arange(sums) > 0, n * flips, 0), axis=1)
        cost[:, 1:] += _KEY_COST * np.cumsum([comb(len(part), t) for t in range(sums)])
        whole = best[:, :, None] + cost[:, None, :]
        nxt, pick = np.full_like(best, np.inf), np.zeros(best.shape, np.int64)
        for s in range(sums + 1):
            options = np.stack([whole[:, s - t, t] for t in range(s + 1)], axis=1)
            pick[:, s] = options.argmin(axis=1)
            nxt[:, s] = options.min(axis=1)
        best = nxt
        taken.append(pick)
    out = np.zeros((len(fp), len(parts)), np.int64)
    left = np.full(len(fp), sums)
    for i in range(len(parts) - 1, -1, -1):
        out[:, i] = taken[i][np.arange(len(fp)), left]
        left -= out[:, i]
    return out


def _mask(bits: list[int]) -> int:
    """As a signed long."""
    value = sum(1 << b for b in bits)
    return value - (1 << 64) if value >> 63 else value


def _keys(fps: DataFrame, parts: list[list[int]]) -> DataFrame:
    each = F.array(*(F.struct(F.lit(i).alias("path"), F.col("fp").bitwiseAND(F.lit(_mask(b)).cast("long")).alias("key")) for i, b in enumerate(parts)))
    return fps.select("fp", F.explode(each).alias("at")).select("at.path", "at.key", "fp")


def _probes(fps: DataFrame, parts: list[list[int]], n: int, p: np.ndarray, distance: int) -> DataFrame:
    keys = _keys(fps, parts)
    held = keys.groupBy("path", "key").agg(F.count("*").alias("held"))
    wide = keys.join(held, ["path", "key"]).groupBy("fp").agg(*(F.max(F.when(F.col("path") == i, F.col("held"))).alias(f"n{i}") for i in range(len(parts))))
    flips = {(i, t): np.array([0, *(sum(1 << b for b in f) for k in range(1, t + 1) for f in combinations(part, k))], U64) for i, part in enumerate(parts) for t in range(distance + 1)}
    masks = [U64(sum(1 << b for b in part)) for part in parts]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy().view(U64)
            allowed = allowances(fp, np.stack([c.to_numpy() for c in batch.columns[1:]], axis=1).astype(np.float64), n, p, parts, distance)
            for (i, t), flip in flips.items():
                mine = fp[allowed[:, i] == t + 1]
                step = max(1, (1 << 17) // len(flip))
                for a in range(0, len(mine), step):
                    own = mine[a : a + step]
                    key = ((own & masks[i])[:, None] ^ flip).ravel()
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), i, np.int32)), pa.array(key.view(np.int64)), pa.array(np.repeat(own, len(flip)).view(np.int64))], ["path", "key", "fp"])

    return wide.mapInArrow(run, "path int, key long, fp long")


def fingerprint_links(fps: DataFrame, distance: int = 2, parts: int = 3, hot: int = 512) -> DataFrame:
    """Links (a, b), a below b, between the distinct fingerprints of ``fps`` (fp) that differ in at most ``distance`` bits;
    one may come up twice. A projection of over ``hot`` fingerprints is split by the bits that it leaves."""
    n, together = bit_statistics(fps)
    groups = group_bits(n, together, parts)
    index, probe = _keys(fps, groups), materialize(_probes(fps, groups, n, np.diag(together) / max(n, 1), distance), "probes")
    rest = {i: [b for b in range(64) if b not in g] for i, g in enumerate(groups)}
    paths = count(len(groups))
    near = (F.col("u.fp") < F.col("v.fp")) & (F.bit_count(F.col("u.fp").bitwiseXOR(F.col("v.fp"))) <= distance)
    found = None

    def meet(u: DataFrame, v: DataFrame) -> DataFrame:
        links = u.alias("u").join(v.alias("v"), ["path", "key"]).where(near).select(F.col("u.fp").alias("a"), F.col("v.fp").alias("b"))
        return links if found is None else found.union(links)

    def deeper(df: DataFrame, large: DataFrame, table: DataFrame) -> DataFrame:
        key = F.xxhash64("key", F.col("fp").bitwiseAND(F.col("mask"))).alias("key")
        return df.join(large, ["path", "key"], "left_semi").join(F.broadcast(table), "path").select(F.col("child").alias("path"), key, "fp")

    while True:
        # a projection splits as long as it leaves more bits than its group could fill
        large = index.groupBy("path", "key").agg(F.count("*").alias("held")).where(F.col("held") > hot).select("path", "key")
        open_ = [k for k, bits in rest.items() if len(bits) > distance and 1 << len(bits) > hot]
        large = materialize(large.where(F.col("path").isin(open_)), "large")
        if not large.limit(1).count():
            return meet(probe, index)
        found = meet(probe.join(large, ["path", "key"], "left_anti"), index.join(large, ["path", "key"], "left_anti"))
        ways = distance + 1
        child = [(k, next(paths), bits[i::ways], bits) for k, bits in rest.items() if k in open_ for i in range(ways)]
        # (distance + 1) rows a path: a few hundred at most
        table = fps.sparkSession.createDataFrame([(k, c, _mask(own)) for k, c, own, _ in child], "path int, child int, mask long")
        index, probe = (materialize(deeper(df, large, table), "deeper") for df in (index, probe))
        rest = {c: [b for b in bits if b not in own] for _, c, own, bits in child}


def near_duplicates(docs: DataFrame, n: int = 3, distance: int = 2, parts: int = 3, hot: int = 512, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(``id_col``, fp, component_id): per document its fingerprint and the least id that links of at most ``distance``
    differing bits reach, its own included. An empty table gives an empty one."""
    own = materialize(with_fingerprint(docs, n, text_col, id_col=id_col), "fingerprints")
    fps = materialize(own.groupBy("fp").agg(F.min(id_col).alias("least")), "distinct")
    roots = connected_components(fingerprint_links(fps.select("fp"), distance, parts, hot)).select(F.col("node").alias("fp"), "root")
    placed = materialize(fps.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), "placed")
    first = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    return own.join(placed.join(first, "root").select("fp", "component_id"), "fp").select(id_col, "fp", "component_id")
