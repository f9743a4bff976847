"""Nearest neighbours through an inverted multi-index.

The two halves of each vector are quantised apart, so k centroids a half make k * k cells, each with a list of entries.
Lists lie in blocks of bounded size by their first centroid; a cell with more entries is split over several. A query visits
cells in order of the summed distance of their two centroids, taken from a heap, until the cells it has seen hold enough
entries. It goes to the blocks that hold some of its cells and no others, looks these cells' lists up there, and reranks
their entries by exact cosine. How many entries are enough is measured, not guessed: a bounded set of queries is searched
by brute force, and their true neighbours tell how far the traversal must go.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import materialize, shuffle_partitions
from .textvec import ranges


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(np.float64) if len(column) else np.zeros((0, 1))


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def cosine(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Cosines of the rows of x with q; each row's value depends on that row and q alone."""
    return (x * q).sum(axis=1) / (np.sqrt((x * x).sum(axis=1)) * np.sqrt((q * q).sum()))


def _nearest(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return ((centroids**2).sum(axis=1) - 2 * x @ centroids.T).argmin(axis=1)


def fit_halves(sample: np.ndarray, k: int, rounds: int = 10, seed: int = 5) -> list[np.ndarray]:
    """k-means centroids of both halves of unit vectors."""
    rng = np.random.default_rng(seed)
    out = []
    for half in np.split(_unit(sample), [sample.shape[1] // 2], axis=1):
        c = half[rng.permutation(len(half))[:k]].copy()
        for _ in range(rounds):
            at = _nearest(half, c)
            n = np.bincount(at, minlength=len(c))
            total = np.zeros_like(c)
            np.add.at(total, at, half)
            c[n > 0] = total[n > 0] / n[n > 0, None]
        out.append(c)
    return out


def half_distances(q: np.ndarray, centroids: list[np.ndarray]) -> list[np.ndarray]:
    u = q / np.sqrt((q * q).sum())
    cut = len(q) // 2
    return [((c - part) ** 2).sum(axis=1) for c, part in zip(centroids, (u[:cut], u[cut:]), strict=True)]


def traverse(d1: np.ndarray, d2: np.ndarray) -> Iterator[tuple[float, int, int]]:
    """(summed distance, i, j) of all centroid pairs, nearest first. The heap holds one pair per row that is open."""
    o1, o2 = np.argsort(d1, kind="stable"), np.argsort(d2, kind="stable")
    s1, s2 = d1[o1].tolist(), d2[o2].tolist()
    heap = [(s1[0] + s2[0], 0, 0)]
    while heap:
        d, i, j = heapq.heappop(heap)
        yield d, int(o1[i]), int(o2[j])
        if j + 1 < len(s2):
            heapq.heappush(heap, (s1[i] + s2[j + 1], i, j + 1))
        if j == 0 and i + 1 < len(s1):
            heapq.heappush(heap, (s1[i + 1] + s2[0], i + 1, 0))


class Blocks:
    """Where the lists of the cells lie: of each first centroid its first block, in how many its entries are split by a
    hash, and which centroids share it. Two small arrays, whatever the number of entries."""

    def __init__(self, held: np.ndarray, rows: int) -> None:
        total = held.sum(axis=1)
        self.split = np.maximum(-(-total // rows), 1)
        self.first = np.zeros(len(total), np.int64)
        self.low: list[int] = []  # per block, its first centroid
        room = 0
        for c, (n, parts) in enumerate(zip(total.tolist(), self.split.tolist(), strict=True)):
            if parts > 1 or n > room:
                self.low += [c] * parts
                room = rows if parts == 1 else 0
            self.first[c] = len(self.low) - parts
            room -= n

    def of(self, c1: np.ndarray, ids: np.ndarray) -> np.ndarray:
        return self.first[c1] + (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % self.split[c1]


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v) of the vectors that take part: not null, not zero, of finite components, of the commonest length."""
    v = F.col(vector_col).cast("array<double>")
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & ~F.exists("v", bad) & F.exists("v", lambda x: x != 0))
    common = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    return rows.where(F.size("v") == (common[0]["n"] if common else 0))


def nearest_neighbours(vectors: DataFrame, top: int = 5, every: int = 50, recall: float = 0.95, sample_rows: int = 20_000, probe_rows: int = 100, block_rows: int = 4096, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose id is divisible by ``every``, its ``top`` nearest other rows by
    cosine in double precision, nearest first, ties to the smaller id; all candidates if there are fewer.

    The centroids are fitted on at most ``sample_rows`` vectors and the depth of the traversal on at most ``probe_rows``
    queries, both taken in order of a hash of the id; every vector is indexed. Of rows with one same vector only the
    ``top + 1`` smallest ids can be among the nearest of any query, so no more are kept of a vector that very many rows
    share; that loses nothing. Null, zero, not finite and odd-sized vectors take no part, nor do null ids. An empty table
    gives an empty result; other columns are ignored.
    """
    spark = vectors.sparkSession
    good = usable(vectors, id_col, vector_col)
    rank = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    entries = materialize(good.withColumn("r", rank).where(F.col("r") <= top + 1).drop("r"), "vectors")
    queries = good.where(F.col("vec_id") % every == 0)
    schema = "query_id long, rank int, vec_id long, score double"
    n = entries.count()
    if not n:
        return spark.createDataFrame([], schema)
    k = int(np.clip(round((n / 4) ** 0.5), 2, 512))
    by_hash = lambda x, m: [(r.vec_id, np.array(r.v)) for r in x.orderBy(F.xxhash64("vec_id", F.lit(3)), "vec_id").limit(m).collect()]
    centroids = fit_halves(np.array([v for _, v in by_hash(entries, sample_rows)]), k)
    k = min(len(c) for c in centroids)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _unit(_matrix(batch.column(1)))
            codes = [_nearest(h, c) for h, c in zip(np.split(x, [x.shape[1] // 2], axis=1), centroids, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c.astype(np.int32)) for c in codes)], ["vec_id", "v", "c1", "c2"])

    index = materialize(entries.mapInArrow(encode, "vec_id long, v array<double>, c1 int, c2 int"), "index")
    held = np.zeros((k, k), np.int64)
    for r in index.groupBy("c1", "c2").count().collect():  # at most k * k numbers, k being 512 at most
        held[r.c1, r.c2] = r["count"]

    # how many entries a traversal sees before it comes to a true neighbour, by brute force for a bounded set of queries
    probes = by_hash(queries, probe_rows)

    def best(x: np.ndarray, ids: np.ndarray, q: np.ndarray, own: int) -> tuple[np.ndarray, np.ndarray]:
        score = cosine(x, q)
        keep = ids != own
        order = np.lexsort((ids[keep], -score[keep]))[:top]
        return np.flatnonzero(keep)[order], score[keep][order]

    def brute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, x = batch.column(0).to_numpy(), _matrix(batch.column(1))
            for i, (own, q) in enumerate(probes):
                at, score = best(x, ids, q, own)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), i)), pa.array(ids[at]), pa.array(score), batch.column(2).take(pa.array(at)), batch.column(3).take(pa.array(at))], ["q", "vec_id", "score", "c1", "c2"])

    order = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    true = index.mapInArrow(brute, "q long, vec_id long, score double, c1 int, c2 int").withColumn("r", F.row_number().over(order)).where(F.col("r") <= top).collect()
    depths = []
    for i, (_, q) in enumerate(probes):
        wanted = {(r.c1, r.c2): sum((x.c1, x.c2) == (r.c1, r.c2) for x in true if x.q == i) for r in true if r.q == i}
        seen = 0
        for _, a, b in traverse(*half_distances(q, centroids)):
            seen += int(held[a, b])
            if (a, b) in wanted:
                depths += [seen] * wanted.pop((a, b))
            if not wanted:
                break
    enough = max(int(np.quantile(depths, recall, method="higher")) if depths else n, 4 * top)

    layout = Blocks(held, block_rows)

    def plan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The cells that each query visits, a row for each block that holds some of them: numbers c1 * k + c2."""
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for i, q in enumerate(_matrix(batch.column(1))):
                seen, visited = 0, []
                for _, a, b in traverse(*half_distances(q, centroids)):
                    if held[a, b]:
                        seen += int(held[a, b])
                        visited.append(a * k + b)
                        if seen >= enough:
                            break
                cells = np.sort(np.array(visited, np.int64))
                block = layout.first[cells // k]
                cuts = np.flatnonzero(np.append(True, block[1:] != block[:-1]))
                for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(cells)], strict=True):
                    for part in range(int(layout.split[cells[a] // k])):
                        for column, value in zip(out, (int(block[a]) + part, batch.column(0)[i].as_py(), i, cells[a:b].astype(np.int32).tobytes()), strict=True):
                            column.append(value)
            columns = [pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), batch.column(1).take(pa.array(out[2], pa.int64())), pa.array(out[3], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["block", "vec_id", "v", "cells"])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, c1, c2 = (batch.column(i).to_numpy().astype(np.int64) for i in (0, 2, 3))
            yield pa.RecordBatch.from_arrays([pa.array(layout.of(c1, ids)), batch.column(0), batch.column(1), pa.array((c1 * k + c2).astype(np.int32))], ["block", "vec_id", "v", "cell"])

    lists = index.mapInArrow(place, "block long, vec_id long, v array<double>, cell int")
    visits = queries.mapInArrow(plan, "block long, vec_id long, v array<double>, cells binary")
    one = lists.select("block", "cell", "vec_id", "v", F.lit(None).cast("binary").alias("cells"))
    two = visits.select("block", F.lit((1 << 31) - 1).alias("cell"), "vec_id", "v", "cells")  # queries come after the lists

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held_block, ready = None, [], False
        for batch in batches:
            at_block, is_query = batch.column(0).to_numpy(), batch.column(4).is_valid().to_numpy(zero_copy_only=False)
            cuts = [0, *(1 + np.flatnonzero((at_block[1:] != at_block[:-1]) | (is_query[1:] != is_query[:-1]))).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                if at_block[a] != block:
                    block, held_block, ready = at_block[a], [], False
                part = batch.slice(a, b - a)
                if not is_query[a]:
                    held_block.append(part)
                    continue
                if not held_block:
                    continue
                if not ready:
                    own = pa.Table.from_batches(held_block)
                    ids, cell, x, ready = own["vec_id"].to_numpy(), own["cell"].to_numpy(), _matrix(own["v"].combine_chunks()), True
                    unit = _unit(x)
                out: list[list] = [[], [], []]
                for query, q, cells in zip(part.column(2).to_numpy().tolist(), _matrix(part.column(3)), part.column(4), strict=True):
                    wanted = np.frombuffer(cells.as_buffer(), np.int32)
                    low, high = np.searchsorted(cell, wanted), np.searchsorted(cell, wanted, side="right")
                    at = ranges(low, high - low)
                    if len(at) > 8 * top:  # of those far from the best in plain arithmetic no exact cosine is needed
                        near = unit[at] @ (q / np.sqrt((q * q).sum()))
                        at = at[near >= np.partition(near, len(at) - top - 1)[len(at) - top - 1] - 1e-9]
                    got, score = best(x[at], ids[at], q, query)
                    out[0] += [query] * len(got)
                    out[1] += ids[at][got].tolist()
                    out[2] += score.tolist()
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.float64()), strict=True)], ["query_id", "vec_id", "score"])

    blocks = max(len(layout.low), shuffle_partitions(spark))
    found = one.union(two).repartition(min(blocks, 100_000), "block").sortWithinPartitions("block", "cell").mapInArrow(search, "query_id long, vec_id long, score double")
    nearest = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", nearest.cast("int")).where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")
