"""Which members of candidate groups are similar enough: signature trees over the members' sets.

A node of a tree holds the OR of the bitmaps of the sets below it, the range of their sizes, and how many of their values
share a bit with others, so the most that sets below two nodes can have in common has a bound. Trees are traversed against
each other from their roots; pairs of nodes that cannot reach the wanted similarity are passed over.

A candidate group of any size is dealt to tasks in parts of bounded bytes. Parts that leave a group unconnected are dealt
anew by the size of their sets. Their roots (bitmap and size range) meet in a join, which prunes as the traversal does, and
each pair of parts that survives is one task: two trees of bounded size, traversed against each other.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .shared import materialize, packed_groups

_BITS = 2048
_FAN = 8
_PART_BYTES = 2_000_000  # most text of one part; a longer single text is a part of its own
_PART_ROWS = 4000
_PAIRS = 4096  # node or set pairs that are looked at together
_QUANTILES = 64  # by which the sets of a group that stays unconnected are dealt by size

#: Texts as sets: all values in order of set and value, and the bounds of each text's.
Sets = Callable[[pa.ChunkedArray], tuple[np.ndarray, np.ndarray]]


class _Union:
    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = i = self.up[self.up[i]]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.find(i), self.find(j)
        self.up[max(i, j)] = min(i, j)
        return i != j

    def roots(self) -> np.ndarray:
        return np.fromiter(map(self.find, range(len(self.up))), np.int64, len(self.up))


def similar_pairs(value: np.ndarray, first: np.ndarray, one: np.ndarray, two: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets ``one`` and ``two`` (numbers, pairwise) have a Jaccard similarity of ``percent`` or more."""
    size = np.diff(first)
    out = np.zeros(len(one), bool)
    small, large = np.minimum(size[one], size[two]), np.maximum(size[one], size[two])
    open_ = np.flatnonzero((small > 0) & (small * 100 >= percent * large))
    cost = np.cumsum(size[one[open_]] + size[two[open_]])
    cuts = np.unique(np.concatenate([np.arange(0, len(open_), _PAIRS), np.searchsorted(cost, np.arange(1 << 20, int(cost[-1]) if len(cost) else 0, 1 << 20)), [len(open_)]]))
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        at = open_[a:b]
        ends = np.concatenate([one[at], two[at]])
        n = size[ends]
        pair = np.repeat(np.tile(np.arange(len(at)), 2), n)
        place = np.arange(int(n.sum())) + np.repeat(first[ends] - np.append(0, np.cumsum(n)[:-1]), n)
        both = pair.astype(np.uint64) << np.uint64(50) | value[place] >> np.uint64(14)  # values count by their upper 50 bits
        both.sort()
        same = both[1:][both[1:] == both[:-1]] >> np.uint64(50)
        shared = np.bincount(same.astype(np.int64), minlength=len(at))
        out[at] = shared * 100 >= percent * (n[: len(at)] + n[len(at) :] - shared)
    return out


class Forest:
    """Trees over the sets of several groups at once. A set's ``tree`` is a number; levels go from the sets up to one root
    a tree, all trees having the same number of levels."""

    def __init__(self, value: np.ndarray, first: np.ndarray, tree: np.ndarray) -> None:
        size = np.diff(first)
        low = np.zeros(len(size), np.uint64)
        low[size > 0] = value[first[:-1][size > 0]]
        self.order = np.lexsort((size, low, tree))  # like sets have the same least value by and large
        bits = np.zeros(len(size) * _BITS, bool)
        bits[np.repeat(np.arange(len(size)) * _BITS, size) + (value >> np.uint64(14) & np.uint64(_BITS - 1)).astype(np.int64)] = True
        bitmap = np.packbits(bits.reshape(-1, _BITS), axis=1).view(np.uint64)[self.order]
        size, tree = size[self.order], tree[self.order]
        lost = size - np.bitwise_count(bitmap).sum(axis=1)
        #: per level: bitmap, least and greatest size, most values that share a bit, first set, first child
        self.levels = [(bitmap, size, size, lost, np.arange(len(size)), np.arange(len(size)))]
        while len(tree) > len(np.unique(tree)):
            new = np.append(True, tree[1:] != tree[:-1])
            begin = np.flatnonzero(new)
            rank = np.arange(len(tree)) - begin[np.cumsum(new) - 1]
            cut = np.flatnonzero(rank % _FAN == 0)
            bm, lo, hi, co, start, _ = self.levels[-1]
            self.levels.append((np.bitwise_or.reduceat(bm, cut), np.minimum.reduceat(lo, cut), np.maximum.reduceat(hi, cut), np.maximum.reduceat(co, cut), start[cut], cut))
            tree = tree[cut]
        self.tree = tree  # of each root

    def links(self, value: np.ndarray, first: np.ndarray, percent: int, union: _Union, one: np.ndarray, two: np.ndarray) -> list[tuple[int, int]]:
        """Traverse roots ``one`` and ``two`` (pairwise) against each other. Links that connect what is similar; sets
        that are connected already aren't compared again."""
        found: list[tuple[int, int]] = []
        stack = [(len(self.levels) - 1, one, two)]
        root = union.roots()[self.order]
        while stack:
            depth, u, v = stack.pop()
            if len(u) > _PAIRS:
                stack += [(depth, u[a : a + _PAIRS], v[a : a + _PAIRS]) for a in range(0, len(u), _PAIRS)]
                continue
            bm, lo, hi, co, start, _ = self.levels[depth]
            least, most = np.minimum.reduceat(root, start), np.maximum.reduceat(root, start)
            done = (least[u] == most[v]) & (most[u] == least[v])
            apart = (hi[u] * 100 < percent * lo[v]) | (hi[v] * 100 < percent * lo[u])
            shared = np.bitwise_count(bm[u] & bm[v]).sum(axis=1).astype(np.int64) + np.minimum(co[u], co[v])
            short = percent * (lo[u] + lo[v]) > (100 + percent) * np.minimum(shared, np.minimum(hi[u], hi[v]))
            keep = ~(done | apart | short)
            u, v = u[keep], v[keep]
            if not len(u):
                continue
            if not depth:
                i, j = self.order[u], self.order[v]
                hit = similar_pairs(value, first, i, j, percent)
                for a, b in zip(i[hit].tolist(), j[hit].tolist(), strict=True):
                    if union.join(a, b):
                        found.append((a, b))
                if hit.any():
                    root = union.roots()[self.order]
                continue
            child = np.append(self.levels[depth][5], len(self.levels[depth - 1][0]))
            grid = np.arange(_FAN)
            cu = (child[u][:, None, None] + grid[None, :, None] + 0 * grid[None, None, :]).ravel()
            cv = (child[v][:, None, None] + grid[None, None, :] + 0 * grid[None, :, None]).ravel()
            ok = (cu < np.repeat(child[u + 1], _FAN * _FAN)) & (cv < np.repeat(child[v + 1], _FAN * _FAN)) & (cu <= cv)
            ok &= (cu != cv) if depth == 1 else True
            stack.append((depth - 1, cu[ok], cv[ok]))
        return found


def tree_links(value: np.ndarray, first: np.ndarray, group: np.ndarray, percent: int, side: np.ndarray | None = None, shortcut: bool = True) -> list[tuple[int, int]]:
    """Links (set numbers) that connect the sets of each group as all similar pairs do; with ``side`` (0 or 1), as all
    similar pairs of different sides do in groups that have both.

    ``shortcut`` compares sets that are neighbours by their least value first; most groups are whole after that, and
    only the others get trees. Links are the same components with and without it.
    """
    n = len(first) - 1
    union, found = _Union(n), []
    size = np.diff(first)
    if shortcut and n > 1:
        low = np.zeros(n, np.uint64)
        low[size > 0] = value[first[:-1][size > 0]]
        order = np.lexsort((size, low, group))
        begin = np.append(True, group[order][1:] != group[order][:-1])
        head = order[np.flatnonzero(begin)][np.cumsum(begin) - 1]
        for one, two in ((order[:-1], order[1:]), (head, order)):
            near = (group[one] == group[two]) & (one != two)
            one, two = one[near], two[near]
            root = union.roots()
            apart = root[one] != root[two]
            one, two = one[apart], two[apart]
            hit = similar_pairs(value, first, one, two, percent)
            found += [(a, b) for a, b in zip(one[hit].tolist(), two[hit].tolist(), strict=True) if union.join(a, b)]
    root = union.roots()
    # groups that are not one component yet
    ids, group = np.unique(group, return_inverse=True)
    least, most = np.full(len(ids), n), np.full(len(ids), -1)
    np.minimum.at(least, group, root)
    np.maximum.at(most, group, root)
    mine = np.flatnonzero((least < most)[group])
    if not len(mine):
        return found
    length = size[mine]
    at = np.arange(int(length.sum())) + np.repeat(first[mine] - np.append(0, np.cumsum(length)[:-1]), length)
    part, bounds = value[at], np.append(0, np.cumsum(length))
    tree = group[mine] * 2 + (side[mine] if side is not None else 0)
    within = _Union(len(mine))
    leader: dict[int, int] = {}
    for k, r in enumerate(root[mine].tolist()):
        within.join(leader.setdefault(r, k), k)
    forest = Forest(part, bounds, tree)
    trees = forest.tree
    if side is None:
        one = two = np.arange(len(trees))
    else:
        pairs = np.flatnonzero((trees[:-1] + 1 == trees[1:]) & (trees[1:] % 2 == 1))
        one = np.concatenate([pairs, np.setdiff1d(np.arange(len(trees)), np.concatenate([pairs, pairs + 1]))])
        two = np.concatenate([pairs + 1, one[len(pairs) :]])
    return found + [(int(mine[a]), int(mine[b])) for a, b in forest.links(part, bounds, percent, within, one, two)]


def _links(dealt: DataFrame, sets_of: Sets, percent: int, partitions: int, shortcut: bool) -> DataFrame:
    """Links (a, b) within each ``grp`` of rows (grp, side, did, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in packed_groups(batches, "grp", 2000, _PART_BYTES, "text"):
            if table.num_rows > 1:
                ids, side = table["did"].to_numpy(), table["side"].to_numpy()
                _, group = np.unique(table["grp"].to_numpy(), return_inverse=True)
                links = tree_links(*sets_of(table["text"]), group, percent, side if side.any() else None, shortcut)
                if links:
                    at = np.array(links)
                    yield pa.RecordBatch.from_arrays([pa.array(ids[at[:, 0]]), pa.array(ids[at[:, 1]])], ["a", "b"])

    return dealt.select("grp", "side", "did", "text").repartition(partitions, "grp").sortWithinPartitions("grp").mapInArrow(run, "a long, b long")


def _part_pairs(loose: DataFrame, sets_of: Sets, percent: int) -> DataFrame:
    """(grp, side, did, text): the members of groups that stay unconnected, once for each pair of parts that must meet.

    ``loose``: (root, did, text, now), ``now`` being the component so far. Members are dealt to parts by quantiles of
    their sets' sizes, and within a quantile by a hash if it is too large for one part.
    """

    def signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            value, first = sets_of(pa.chunked_array([batch.column(2)]))
            size = np.diff(first)
            bits = np.zeros(len(size) * _BITS, bool)
            bits[np.repeat(np.arange(len(size)) * _BITS, size) + (value >> np.uint64(14) & np.uint64(_BITS - 1)).astype(np.int64)] = True
            bitmap = np.packbits(bits.reshape(-1, _BITS), axis=1).view(np.int64)
            lost = size - np.bitwise_count(bitmap.view(np.uint64)).sum(axis=1).astype(np.int64)
            words = pa.FixedSizeListArray.from_arrays(pa.array(bitmap.ravel()), _BITS // 64).cast(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(size.astype(np.int64)), pa.array(lost), words], [*batch.schema.names, "n", "lost", "bits"])

    signed = materialize(loose.select("root", "did", "text", "now").mapInArrow(signatures, "root long, did long, text binary, now long, n long, lost long, bits array<long>"), "signatures")
    cuts = signed.groupBy("root").agg(F.percentile_approx("n", [i / _QUANTILES for i in range(1, _QUANTILES)]).alias("cuts"))
    ranked = signed.join(cuts, "root").withColumn("q", F.size(F.filter("cuts", lambda c: c < F.col("n")))).drop("cuts")
    parts = ranked.groupBy("root", "q").agg(F.greatest(F.ceil(F.sum(F.length("text")) / _PART_BYTES), F.ceil(F.count("*") / _PART_ROWS)).alias("parts"))
    part = F.xxhash64("root", "q", F.pmod(F.xxhash64("did"), "parts"))
    dealt = materialize(ranked.join(parts, ["root", "q"]).select("root", part.alias("part"), "did", "text", "now", "n", "lost", "bits"), "parts")
    word = [F.bit_or(F.col("bits")[i]).alias(f"w{i}") for i in range(_BITS // 64)]
    nodes = dealt.groupBy("root", "part").agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.max("lost").alias("lost"), F.min("now").alias("least"), F.max("now").alias("most"), *word)
    nodes = materialize(nodes.select("root", "part", "lo", "hi", "lost", "least", "most", F.array(*(F.col(f"w{i}") for i in range(_BITS // 64))).alias("bits")), "nodes")
    u, v = nodes.alias("u"), nodes.alias("v")
    c = F.col
    shared = F.aggregate(F.zip_with("u.bits", "v.bits", lambda x, y: F.bit_count(x.bitwiseAND(y))), F.lit(0), lambda t, x: t + x) + F.least("u.lost", "v.lost")
    meets = (
        (c("u.part") <= c("v.part")) & ~((c("u.least") == c("v.most")) & (c("u.most") == c("v.least"))) & (c("u.hi") * 100 >= c("v.lo") * percent) & (c("v.hi") * 100 >= c("u.lo") * percent)
        & (percent * (c("u.lo") + c("v.lo")) <= (100 + percent) * F.least(shared, c("u.hi"), c("v.hi")))
    )
    pairs = u.join(v, "root").where(meets).select("root", F.xxhash64("root", "u.part", "v.part").alias("grp"), F.col("u.part").alias("p"), F.col("v.part").alias("q"))
    ends = pairs.select("root", "grp", F.explode(F.when(c("p") == c("q"), F.array(F.struct(F.lit(0).alias("side"), c("p").alias("part")))).otherwise(F.array(F.struct(F.lit(0).alias("side"), c("p").alias("part")), F.struct(F.lit(1).alias("side"), c("q").alias("part"))))).alias("e")).select("root", "grp", "e.side", "e.part")
    return dealt.select("root", "part", "did", "text").join(ends, ["root", "part"]).select("grp", "side", "did", "text")


def group_links(rows: DataFrame, members: DataFrame, sets_of: Sets, percent: int, partitions: int, shortcut: bool = True) -> DataFrame:
    """Links (a, b) that connect the members (did, root) of each candidate group as all pairs of similar ones would.

    ``sets_of`` makes the sets of ``rows`` (did, text). A group with more text than one part holds is dealt out by a
    hash; every part also gets the group's least member. Groups that are not one component after that are dealt anew, by
    the sizes of their sets, and the parts meet in pairs, but for pairs that their roots rule out. A task holds two parts
    at most, whatever the group.
    """
    several = members.groupBy("root").agg(F.count("*").alias("k")).where("k > 1").select("root")
    kept = members.join(several, "root", "left_semi")
    # a merge join whatever the size of members, so that a plan that is cheap on little data is not another one on much
    held = materialize(rows.hint("merge").join(kept, "did").select("root", "did", F.col("text").cast("binary").alias("text")), "members")
    parts = F.greatest(F.ceil(F.sum(F.length("text")) / _PART_BYTES), F.ceil(F.count("*") / _PART_ROWS))
    large = materialize(held.groupBy("root").agg(parts.alias("parts"), F.min("did").alias("hub")).where("parts > 1"), "large")
    sized = held.join(large.select("root", "parts"), "root", "left")
    dealt = sized.select(F.xxhash64("root", F.pmod(F.xxhash64("did"), F.coalesce("parts", F.lit(1)))).alias("grp"), F.lit(0).alias("side"), "did", "text")
    if not large.limit(1).count():
        return materialize(_links(dealt, sets_of, percent, partitions, shortcut), "links")
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part")
    hubs = large.select("root", "parts", F.col("hub").alias("did")).join(held.select("root", "did", "text"), ["root", "did"])
    home = F.pmod(F.xxhash64("did"), "parts")
    shown = hubs.select("root", "did", "text", home.alias("home"), every).where("part <> home").select(F.xxhash64("root", "part").alias("grp"), F.lit(0).alias("side"), "did", "text")
    links = materialize(_links(dealt.union(shown), sets_of, percent, partitions, shortcut), "links")
    roots = connected_components(links).select("node", F.col("root").alias("now"))
    now = held.join(large.select("root"), "root", "left_semi").join(roots, F.col("did") == F.col("node"), "left").select("root", "did", "text", F.coalesce("now", "did").alias("now"))
    now = materialize(now, "now")
    split = materialize(now.groupBy("root").agg(F.min("now").alias("a"), F.max("now").alias("b")).where("a < b").select("root"), "split")
    if not split.limit(1).count():
        return links
    loose = now.join(split, "root", "left_semi")
    return links.union(materialize(_links(_part_pairs(loose, sets_of, percent), sets_of, percent, partitions, shortcut), "links"))
