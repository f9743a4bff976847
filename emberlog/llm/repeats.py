"""Which keys occur more than once among many billions, without a JVM row for each.

Every map task sorts its own keys. A key that it holds more than once is settled there, and one entry of it travels on,
so the hottest key sends a few entries per task. Entries travel as sorted blocks, one per target partition.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialize

#: A key at place ``at`` of the document (``id``, ``sig``); ``sig`` is a hash of the whole text.
ENTRY = np.dtype([("key", "<u8"), ("id", "<i8"), ("sig", "<i8"), ("at", "<i8")])
#: A key or node, an id and what ``stars`` needs to know of it.
PAIR = np.dtype([("key", "<u8"), ("id", "<i8"), ("spare", "<i4")])
_BLOCK = "part int, block binary"
_FLUSH = 250_000  # entries that a task holds before it sends them on; bounds its memory
_OVER = 4  # blocks per partition, so that hashing them gives even partitions


def entries(key: np.ndarray, ident: np.ndarray, sig: np.ndarray | int = 0, at: np.ndarray | int = 0) -> np.ndarray:
    out = np.empty(len(key), ENTRY)
    out["key"], out["id"], out["sig"], out["at"] = key, ident, sig, at
    return out


def _blocks(rows: np.ndarray, mark: bytes, parts: int, by: str = "key") -> tuple[list[int], list[bytes]]:
    part = (rows[by].astype(np.uint64) % np.uint64(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    rows, cuts = rows[order], np.searchsorted(part[order], np.arange(parts + 1))
    full = np.flatnonzero(np.diff(cuts))
    return full.tolist(), [mark + rows[cuts[p] : cuts[p + 1]].tobytes() for p in full]


def _pairs(key: np.ndarray, ident: np.ndarray, spare: np.ndarray | int = 0) -> np.ndarray:
    out = np.empty(len(key), PAIR)
    out["key"], out["id"], out["spare"] = key, ident, spare
    return out


def _changes(*columns: np.ndarray) -> np.ndarray:
    new = np.ones(len(columns[0]), bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return new


def _batches(parts: list[int], blocks: list[bytes], size: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Blocks in batches of about ``size`` bytes, so that neither end holds many."""
    a = weight = 0
    for b, block in enumerate(blocks, 1):
        weight += len(block)
        if weight >= size or b == len(blocks):
            yield pa.RecordBatch.from_arrays([pa.array(parts[a:b], pa.int32()), pa.array(blocks[a:b], pa.binary())], ["part", "block"])
            a, weight = b, 0


def _exchange(df: DataFrame, entries_of: Callable, local: Callable, meet: Callable, partitions: int, schema: str, kind: np.dtype = ENTRY) -> DataFrame:
    parts = partitions * _OVER

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        n = 0
        for batch in batches:
            for got in entries_of(batch):
                held.append(got if kind == ENTRY else _pairs(got["key"], got["id"], got["at"]))
                n += len(got)
                if n > _FLUSH:
                    every, held, n = np.concatenate(held), [], 0
                    yield from local(every, parts)
        if n:
            yield from local(np.concatenate(held), parts)

    def receive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got: dict[int, dict[int, list[np.ndarray]]] = {}
        for batch in batches:
            for part, block in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw = block.as_buffer()
                mark = np.frombuffer(raw, np.uint8, 1)[0]
                got.setdefault(part, {}).setdefault(int(mark), []).append(np.frombuffer(raw, kind, offset=1))
        for part in list(got):  # one part after the other, to bound what is sorted at once
            blocks = got.pop(part)
            yield from meet({mark: np.concatenate(blocks.pop(mark)) for mark in list(blocks)})

    return df.mapInArrow(send, _BLOCK).repartition(partitions, "part").mapInArrow(receive, schema)


def _rows(found: np.ndarray, names: tuple[str, ...], out: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    for a in range(0, len(found), 50_000):
        yield pa.RecordBatch.from_arrays([pa.array(found[n][a : a + 50_000].astype(np.int64)) for n in names], list(out))


def repeated(df: DataFrame, entries_of: Callable[[pa.RecordBatch], Iterator[np.ndarray]], partitions: int) -> DataFrame:
    """Rows (key, id, sig, at) of the entries whose key also occurs at another (sig, at).

    Entries with the same key, sig and at come from copies of one text; of those in one task, the least id stands for
    all. A key that only copies share isn't repeated in this sense.
    """

    def local(rows: np.ndarray, parts: int) -> Iterator[pa.RecordBatch]:
        rows = rows[np.lexsort((rows["id"], rows["at"], rows["sig"], rows["key"]))]
        rows = rows[_changes(rows["key"], rows["sig"], rows["at"])]
        new = _changes(rows["key"])
        at = np.flatnonzero(new)
        several = (np.diff(np.append(at, len(rows))) > 1)[np.cumsum(new) - 1]
        a, b = _blocks(rows[several], b"\x01", parts)
        c, d = _blocks(rows[~several], b"\x00", parts)
        # one entry of a settled key goes along, for the other tasks' sake
        e, f = _blocks(rows[several & new], b"\x02", parts)
        yield from _batches(a + c + e, b + d + f)

    def meet(got: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
        names = ("key", "id", "sig", "at")
        yield from _rows(got.get(1, np.zeros(0, ENTRY)), names, names)
        single, known = got.get(0, np.zeros(0, ENTRY)), got.get(2, np.zeros(0, ENTRY))
        if not len(single):
            return
        single = single[np.lexsort((single["at"], single["sig"], single["key"]))]
        new = _changes(single["key"])
        places = np.add.reduceat(_changes(single["key"], single["sig"], single["at"]).astype(np.int64), np.flatnonzero(new))
        many = (places > 1)[np.cumsum(new) - 1] | np.isin(single["key"], known["key"])
        yield from _rows(single[many], names, names)

    return _exchange(df, entries_of, local, meet, partitions, "key long, id long, sig long, at long")


def plain_stars(df: DataFrame, entries_of: Callable[[pa.RecordBatch], Iterator[np.ndarray]], partitions: int) -> DataFrame:
    """Rows (a, b), a < b, that connect all ids that share a key. A task links the ids of a key to the least of them, and
    only that one travels on to meet those of other tasks."""

    def linked(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The least row of each key, and the links to it."""
        key = np.ascontiguousarray(rows["key"])
        order = np.argsort(key)
        key, ident = key[order], rows["id"][order]
        begin = np.flatnonzero(_changes(key))
        least = np.minimum.reduceat(ident, begin) if len(begin) else ident
        hub = np.repeat(least, np.diff(np.append(begin, len(key))))
        far = hub < ident
        hub, ident = hub[far], ident[far]
        order = np.lexsort((ident, hub))
        hub, ident = hub[order], ident[order]
        once = _changes(hub, ident) if len(hub) else np.zeros(0, bool)
        return _pairs(key[begin], least), np.stack([hub[once], ident[once]], axis=1)

    def local(rows: np.ndarray, parts: int) -> Iterator[pa.RecordBatch]:
        least, links = linked(rows)
        a, b = _blocks(least, b"\x00", parts)
        c, d = _blocks(_pairs(links[:, 0].astype(np.uint64), links[:, 1]), b"\x01", parts, "id")
        yield from _batches(a + c, b + d)

    def meet(got: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, PAIR)
        settled, (_, links) = got.get(1, none), linked(got.get(0, none))
        every = np.concatenate([links, np.stack([settled["key"].view(np.int64), settled["id"]], axis=1)])
        for a in range(0, len(every), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(every[a : a + 50_000, i]) for i in (0, 1)], ["a", "b"])

    return _exchange(df, entries_of, local, meet, partitions, "a long, b long", PAIR)


def stars(df: DataFrame, entries_of: Callable[[pa.RecordBatch], Iterator[np.ndarray]], partitions: int, often: int = 20) -> DataFrame:
    """Rows (a, b), a < b, that link every id to the least id that shares a key with it: ids with a common key are
    connected, through one edge per id and key instead of all pairs.

    The ``at`` of an entry tells twice how many keys its id shares with any partner that matters, plus a class (0 or 1)
    within which that holds. With 0 all keys of the id count, and each links its ids to the least of them. Else pairs are counted:
    keys of more than ``often`` ids are frequent; a pair makes an edge if the other keys that it shares and the frequent
    ones that it may share are as many as it has to. Pairs that share frequent keys alone are those of ids that both have
    as many frequent keys as they share, and these are linked to the least id of each.
    """

    def ordered(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct rows in order of key and id, where keys begin, and the number of ids of each row's key."""
        rows = rows[np.lexsort((rows["id"], rows["key"]))]
        rows = rows[_changes(rows["key"], rows["id"], rows["spare"])]
        new = _changes(rows["key"])
        at = np.flatnonzero(new)
        return rows, new, np.diff(np.append(at, len(rows)))[np.cumsum(new) - 1]

    def local(rows: np.ndarray, parts: int) -> Iterator[pa.RecordBatch]:
        rows, new, count = ordered(rows)
        frequent = count > often
        a, b = _blocks(rows[frequent], b"\x01", parts, "id")  # known to be frequent: dealt by id
        c, d = _blocks(rows[frequent & new], b"\x02", parts)  # tells the others
        e, f = _blocks(rows[~frequent], b"\x00", parts)
        yield from _batches(a + c + e, b + d + f)

    def out(kind: int, key: np.ndarray, a: np.ndarray, b: np.ndarray, n: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
        n = np.zeros(len(key), np.int64) if n is None else n
        for at in range(0, len(key), 50_000):
            part = slice(at, at + 50_000)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key[part]), kind, np.int32)), *(pa.array(x[part].astype(np.int64)) for x in (key, a, b, n))], ["kind", "key", "a", "b", "n"])

    def pairs_of(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Pairs within each key of at most ``often`` ids, counted: what they must share at least, and their classes."""
        found = []
        for d in range(1, often):
            i = np.flatnonzero(rows["key"][d:] == rows["key"][:-d])
            if not len(i):
                break
            one, two = rows[i], rows[i + d]
            need = np.maximum(one["spare"] >> 1, two["spare"] >> 1).astype(np.int64)
            found.append(np.stack([one["id"], two["id"], need * 4 + (one["spare"] & 1) * 2 + (two["spare"] & 1)], 1))
        if found:
            pair = np.concatenate(found)
            pair = pair[np.lexsort((pair[:, 2], pair[:, 1], pair[:, 0]))]
            at = np.flatnonzero(_changes(pair[:, 0], pair[:, 1], pair[:, 2]))
            far = pair[at, 0] < pair[at, 1]
            yield from out(2, pair[at, 2][far], pair[at, 0][far], pair[at, 1][far], np.diff(np.append(at, len(pair)))[far])

    def meet(got: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, PAIR)
        known = got.pop(1, none)
        yield from out(1, known["key"], known["id"], known["spare"])
        rows, new, count = ordered(got.pop(0, none))
        frequent = (count > often) | np.isin(rows["key"], got.pop(2, none)["key"])
        hot = rows[frequent]
        yield from out(1, hot["key"], hot["id"], hot["spare"])
        group = np.cumsum(new) - 1
        need = rows["spare"] >> 1
        loose = np.minimum.reduceat(need, np.flatnonzero(new))[group] == 0 if len(rows) else np.zeros(0, bool)
        yield from pairs_of(rows[~frequent & ~loose & (count > 1)])
        hub = rows["id"][new][group]
        far = ~frequent & loose & (hub < rows["id"])
        hub, other = hub[far], rows["id"][far]
        order = np.lexsort((other, hub))
        hub, other = hub[order], other[order]
        once = _changes(hub, other)
        yield from out(0, hub[once], hub[once], other[once])

    met = materialize(_exchange(df, entries_of, local, meet, partitions, "kind int, key long, a long, b long, n long", PAIR), "keys")
    frequent = met.where("kind = 1").select("key", "a", "b").distinct().withColumn("class", F.col("b") % 2)
    held = frequent.groupBy("a", "class").agg(F.count("*").alias("n"), F.max(F.floor(F.col("b") / 2)).alias("shared"))
    needy = held.where("n >= shared").select("a", "class")
    kept = frequent.join(needy, ["a", "class"], "left_semi").select("key", "a").distinct()
    least = kept.groupBy("key").agg(F.min("a").alias("hub"))
    pairs = met.where("kind = 2").groupBy("a", "b", "key").agg(F.sum("n").alias("n")).select("a", "b", "n", F.floor(F.col("key") / 4).alias("need"), (F.floor(F.col("key") / 2) % 2).alias("ca"), (F.col("key") % 2).alias("cb"))
    more = lambda end, c: held.select(F.col("a").alias(end), F.col("class").alias(c), F.col("n").alias(f"hot_{end}"))
    pairs = pairs.join(more("a", "ca"), ["a", "ca"], "left").join(more("b", "cb"), ["b", "cb"], "left")
    near = pairs.where(F.col("n") + F.least(F.coalesce("hot_a", F.lit(0)), F.coalesce("hot_b", F.lit(0))) >= F.col("need")).select("a", "b")
    return met.where("kind = 0").select("a", "b").union(near).union(kept.join(least, "key").where("a > hub").select(F.col("hub").alias("a"), F.col("a").alias("b"))).distinct()
