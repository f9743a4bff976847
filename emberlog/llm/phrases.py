"""Phrase collocations by dynamic itemset counting.

Documents are dealt to shards, which are scanned in a cycle. Words are counted from the first scan on. A longer phrase
becomes active at the first scan before which both of its subphrases (without its last word, without its first) have
reached the threshold, and is counted for one full cycle from there, so lengths interleave and no phrase waits for shorter
ones to be complete. A phrase that reaches the threshold at all has subphrases that do, so none is missed.

Texts are split into words once: shards are written as numbers of words, in blocks of a few MB with their words behind
them, and scans read these. What a task counts in its part of a shard travels as (phrase, count). Running counts hold only what is between activation
and the end of its cycle; then a phrase is kept or forgotten.

Tasks know the active subphrases of a length exactly: they are sent out while they have at most ``most_bytes`` of text in
all. A longer list stays a table: tasks then count all phrases of the next length, and two joins keep those whose
subphrases are active. Results are the same.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import materialize
from .textvec import LOWER, chunks

_BREAK = np.zeros(256, bool)
_BREAK[[*b".,;:!?\n\x0b\x0c\r"]] = True
_GAP = _BREAK.copy()
_GAP[[0x20, 0x09]] = True
_CUT = re.compile(r"[.,;:!?\n\x0b\x0c\r]")
_LONG = 8_000_000  # characters from which a text is cut where a piece ends
_HELD = 5_000_000  # characters of text whose words are numbered and counted together
_NEVER = 1 << 30

#: By length of a phrase, the active ones (``language newline phrase``) and since which scan; None: not sent out.
Active = dict[int, tuple[pa.Array, np.ndarray] | None]
_NONE = (pa.array([], pa.large_string()), np.zeros(0, np.int64))


def _cut(text: str) -> Iterator[str]:
    a = 0
    while len(text) - a > _LONG and (m := _CUT.search(text, a + _LONG)):
        yield text[a : m.end()]
        a = m.end()
    yield text[a:]


def _joined(left: pa.Array, right: pa.Array | pa.Scalar, by: str) -> pa.Array:
    return pc.binary_join_element_wise(left, right, pa.scalar(by, pa.large_string()))


def _since(active: Active, k: int, keys: pa.Array) -> np.ndarray:
    """Since which scan each phrase is active; ``_NEVER`` if it isn't, nought if all count."""
    if active[k] is None:
        return np.zeros(len(keys), np.int64)
    known, since = active[k]
    at = pc.index_in(keys, value_set=known)
    found = at.is_valid().to_numpy(zero_copy_only=False)
    out = np.full(len(keys), _NEVER)
    out[found] = since[at.drop_null().to_numpy()]
    return out


def _recent(active: Active, scan: int, shards: int) -> pa.Array | None:
    """First words, with their language, of active phrases whose cycle isn't over; None if some length isn't known."""
    if any(v is None for v in active.values()):
        return None
    firsts = [pc.list_element(pc.split_pattern(known.filter(pa.array(since + shards > scan)), " ", max_splits=1), 0) for known, since in active.values()]
    return pc.unique(pa.concat_arrays([_NONE[0], *firsts]))


def _near_recent(ids: np.ndarray, keys: pa.Array, longest: int, recent: pa.Array | None) -> np.ndarray:
    """Places of words from which on phrases may be due. A phrase that is has a subphrase whose cycle as an active one isn't
    over, at its own place or the next; so only places near the first words of such subphrases matter."""
    if recent is None:
        return np.arange(len(ids))
    begins = pc.is_in(keys, value_set=recent).to_numpy(zero_copy_only=False)[ids]
    wanted = begins.copy()
    wanted[:-1] |= begins[1:]
    near = wanted.copy()
    for k in range(1, longest):
        near[k:] |= wanted[:-k]
    return np.flatnonzero(near)


@dataclass
class Numbered:
    """Texts as numbers: ``ids`` are all words in order, each the number of its (language, word) pair, with all bits flipped
    where it is the first of its piece. Pair i is word ``spelt[i]`` of language ``names[code[i]]``; ``n``: words of each."""

    names: pa.Array
    n: np.ndarray
    code: np.ndarray
    spelt: pa.Array
    ids: np.ndarray


def number_words(lang: pa.Array, text: pa.Array) -> Numbered | None:
    """The words of texts; None if there are none."""
    langs = lang.dictionary_encode()
    letters, offsets, begins, owner = [], [np.zeros(1, np.int64)], [], []
    for chunk in chunks(text):
        data = LOWER[chunk.data]
        gap = np.append(_GAP[data], True)
        edge = np.zeros(len(data) + 1, bool)
        edge[chunk.start] = edge[chunk.end] = True
        begin = np.flatnonzero(~gap & (edge | np.append(True, gap[:-1])))
        inside = ~gap[:-1]
        stop = np.flatnonzero(np.append(False, inside) & (edge | gap))
        # breaks and ends of documents before a word begin a piece
        broken = np.cumsum(np.append(0, _BREAK[data]))[begin]
        doc = np.searchsorted(chunk.end, begin, side="right")
        new = np.ones(len(begin), bool)
        new[1:] = (broken[1:] != broken[:-1]) | (doc[1:] != doc[:-1])
        begins.append(new)
        owner.append(chunk.first + doc)
        letters.append(data[inside])
        offsets.append(np.cumsum(stop - begin) + offsets[-1][-1])
    if not letters or not sum(map(len, begins)):
        return None
    new, code = np.concatenate(begins), langs.indices.to_numpy()[np.concatenate(owner)].astype(np.int64)
    words = pa.LargeStringArray.from_buffers(len(new), pa.py_buffer(np.concatenate(offsets)), pa.py_buffer(np.concatenate(letters))).dictionary_encode()
    names = langs.dictionary.cast(pa.large_string())
    size = len(words.dictionary)
    # numbers of the (language, word) pairs that are there, and where they are
    at_pair = code * size + words.indices.to_numpy()
    if size * len(names) > 8 * len(at_pair) + (1 << 20):  # very many languages
        pair, ids = np.unique(at_pair, return_inverse=True)
    else:
        often = np.bincount(at_pair)
        pair = np.flatnonzero(often)
        number = np.zeros(len(often), np.int32)
        number[pair] = np.arange(len(pair))
        ids = number[at_pair]
    ids = ids.astype(np.int32)
    return Numbered(names, np.bincount(code, minlength=len(names)), (pair // size).astype(np.int32), words.dictionary.take(pa.array(pair % size)), np.where(new, ~ids, ids))


def count_phrases(lang: pa.Array, text: pa.Array, longest: int, active: Active, scan: int, shards: int) -> Iterator[tuple[int, pa.Array, np.ndarray, np.ndarray]]:
    """(length, phrases as ``language newline phrase``, counts, activation scan) of what is in its cycle at this scan.
    Length nought is the number of words of a language."""
    if texts := number_words(lang, text):
        yield from count_numbered(texts, longest, active, _recent(active, scan, shards), scan, shards)


def count_numbered(texts: Numbered, longest: int, active: Active, recent: pa.Array | None, scan: int, shards: int) -> Iterator[tuple[int, pa.Array, np.ndarray, np.ndarray]]:
    """``count_phrases`` of texts whose words have numbers; ``recent``: what ``_recent`` gives."""
    if scan < shards:
        yield 0, _joined(texts.names, pa.scalar("", pa.large_string()), "\n"), texts.n, np.zeros(len(texts.n), np.int64)
    spelt, new = texts.spelt, texts.ids < 0
    word = np.where(new, ~texts.ids, texts.ids)
    pairs = len(spelt)
    keys = _joined(texts.names.take(pa.array(texts.code)), spelt, "\n")
    if scan < shards:
        yield 1, keys, np.bincount(word, minlength=pairs), np.zeros(pairs, np.int64)
    if not active:
        return
    at = _near_recent(word, keys, longest, recent)
    if not len(at):
        return
    ids, piece = word[at], np.cumsum(new, dtype=np.int32)
    for k in range(2, longest + 1):
        if k - 1 not in active:
            return
        since = _since(active, k - 1, keys)
        # at[i] is where the phrase of k - 1 words number ids[i] begins; it goes on if the next place begins an active one too
        alive = since[ids] < _NEVER
        at, ids = at[alive], ids[alive]
        follows = np.flatnonzero((at[1:] == at[:-1] + 1) & (piece[np.minimum(at[:-1] + k - 1, len(piece) - 1)] == piece[at[:-1]]) & (at[:-1] + k - 1 < len(piece)))
        whole = ids[follows].astype(np.int64) * pairs + word[at[follows] + k - 1]
        one, two = ids[follows], ids[follows + 1]
        at = at[follows]
        if not len(at):
            return
        encoded = pa.array(whole).dictionary_encode()
        found, ids = encoded.dictionary.to_numpy(), encoded.indices.to_numpy()
        place = np.zeros(len(found), np.int64)
        place[ids] = np.arange(len(ids))  # some place of each
        begun = np.maximum(since[one[place]], since[two[place]])
        keys = _joined(keys.take(pa.array(found // pairs)), spelt.take(pa.array(found % pairs)), " ")
        due = begun + shards > scan if active[k - 1] is not None else np.ones(len(found), bool)
        if due.any():
            yield k, keys.filter(pa.array(due)), np.bincount(ids, minlength=len(found))[due], begun[due]


_NUMBERED = "names array<string>, n array<long>, code binary, ends binary, spelt binary, ids binary"


def _numbered(rows: DataFrame, shards: int) -> DataFrame:
    """Texts (lang, text, shard) as ``Numbered`` ones of about ``_HELD`` bytes of text, each of one shard."""

    def row(shard: int, langs: list[str], texts: list[str]) -> Iterator[pa.RecordBatch]:
        if got := number_words(pa.array(langs, pa.string()), pa.array(texts, pa.large_string())):
            _, ends, letters = got.spelt.buffers()
            values = [[shard], [got.names.to_pylist()], [got.n.tolist()], [got.code.tobytes()], [np.frombuffer(ends, np.int64)[: len(got.spelt) + 1].tobytes()], [letters.to_pybytes()], [got.ids.tobytes()]]
            types = [pa.int32(), pa.list_(pa.string()), pa.list_(pa.int64()), *[pa.binary()] * 4]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, types, strict=True)], ["shard", "names", "n", "code", "ends", "spelt", "ids"])
        langs.clear(), texts.clear()
        pa.default_memory_pool().release_unused()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[list[str], list[str]]] = [([], []) for _ in range(shards)]
        size = [0] * shards
        for batch in batches:
            for lang, text, shard in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for part in _cut(text):
                    held[shard][0].append(lang)
                    held[shard][1].append(part)
                    size[shard] += len(part)
                    if size[shard] >= _HELD:
                        yield from row(shard, *held[shard])
                        size[shard] = 0
        for shard in range(shards):
            yield from row(shard, *held[shard])

    return rows.mapInArrow(run, f"shard int, {_NUMBERED}")


def _scan(shard: DataFrame, longest: int, sent: Broadcast[Active], scan: int, shards: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        recent = _recent(known, scan, shards)
        for texts in _blocks(batches):
            for k, keys, often, begun in count_numbered(texts, longest, known, recent, scan, shards):
                for i in range(0, len(keys), 1 << 16):
                    at = slice(i, i + (1 << 16))
                    part = keys.slice(i, 1 << 16)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), k, np.int32)), part.cast(pa.string()), pa.array(often[at].astype(np.int64)), pa.array(begun[at].astype(np.int32))], ["k", "phrase", "n", "begun"])

    return shard.mapInArrow(run, "k int, phrase string, n long, begun int")


def _lang(key: str = "phrase") -> Column:
    """A phrase has no line breaks, so the last one ends the language."""
    return F.expr(f"substring({key}, 1, length({key}) - length(substring_index({key}, '\\n', -1)) - 1)")


def _spelt(key: str = "phrase") -> Column:
    return F.substring_index(key, "\n", -1)


def _known_by_join(counted: DataFrame, reached: list[DataFrame], k: int, scan: int, shards: int) -> DataFrame:
    """Of phrases of ``k`` words that were counted unseen, those whose subphrases are active and that are in their cycle."""
    known = reduce(DataFrame.union, reached).where(F.col("k") == k - 1).select("phrase", "since")
    end = F.concat(_lang(), F.lit("\n"), F.substring_index(_spelt(), " ", 1 - k))
    rows = counted.where(F.col("k") == k).select("k", "phrase", "n", F.concat(_lang(), F.lit("\n"), F.substring_index(_spelt(), " ", k - 1)).alias("head"), end.alias("tail"))
    rows = rows.join(known.select(F.col("phrase").alias("head"), F.col("since").alias("s1")), "head").join(known.select(F.col("phrase").alias("tail"), F.col("since").alias("s2")), "tail")
    return rows.select("k", "phrase", "n", F.greatest("s1", "s2").cast("int").alias("begun")).where(F.col("begun") + shards > scan)


_BITS = 30  # of the number of a subphrase; three more tell how many words there are
_ID = (1 << _BITS) - 1


#: Rising numbers as steps of four bytes, and places and sizes of the longer steps.
Steps = tuple[np.ndarray, np.ndarray, np.ndarray]


def _steps(numbers: np.ndarray) -> Steps:
    steps = np.diff(numbers, prepend=0)
    far = np.flatnonzero(steps >> 32)
    return steps.astype(np.uint32), far.astype(np.int32), steps[far]


def _climbed(steps: Steps) -> np.ndarray:
    near, at, far = steps
    out = near.astype(np.int64)
    out[at] = far
    return np.cumsum(out)


@dataclass
class Known:
    """Active phrases, by their numbers. ``words``: ``language newline word``; ``pairs``: of each longer length, the numbers of
    the two subphrases in one, rising within what became active after one scan; ``due``: of each length, the first number
    whose cycle isn't over; ``recent``: whether a word is the first of such a phrase."""

    words: pa.Array
    pairs: dict[int, list[Steps]]
    due: dict[int, int]
    recent: np.ndarray

    @cached_property
    def ordered(self) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        """Of each length, all pairs rising, and the number of each; a worker puts them in order once."""
        out = {}
        for k, lists in self.pairs.items():
            pairs = np.concatenate([_climbed(x) for x in lists])
            order = np.argsort(pairs, kind="stable").astype(np.int32)
            out[k] = pairs[order], order
        return out


def _halves(pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (pair >> _BITS) & _ID, pair & _ID


def count_pairs(texts: Numbered, longest: int, known: Known) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, pairs of numbers of subphrases, counts) of the phrases of two to ``longest`` words that are in their cycle."""
    new = texts.ids < 0
    word = np.where(new, ~texts.ids, texts.ids)
    keys = _joined(texts.names.take(pa.array(texts.code)), texts.spelt, "\n")
    number = pc.fill_null(pc.index_in(keys, value_set=known.words), -1).to_numpy().astype(np.int64)
    # as in _near_recent
    begins = (np.append(known.recent, False)[number])[word]
    wanted = begins.copy()
    wanted[:-1] |= begins[1:]
    near = wanted.copy()
    for k in range(1, longest):
        near[k:] |= wanted[:-k]
    at = np.flatnonzero(near)
    ids, piece = number[word[at]], np.cumsum(new, dtype=np.int32)
    for k in range(2, longest + 1):
        alive = ids >= 0
        at, ids = at[alive], ids[alive]
        # the phrase of k - 1 words at a place goes on if the next place begins an active one too
        end = at[:-1] + k - 1
        follows = np.flatnonzero((at[1:] == at[:-1] + 1) & (end < len(piece)) & (piece[np.minimum(end, len(piece) - 1)] == piece[at[:-1]]))
        at = at[follows]
        if not len(at):
            return
        encoded = pa.array((ids[follows] << _BITS) | ids[follows + 1]).dictionary_encode()
        found, place = encoded.dictionary.to_numpy(), encoded.indices.to_numpy()
        head, tail = _halves(found)
        due = np.maximum(head, tail) >= known.due[k - 1]
        if due.any():
            yield k, found[due], np.bincount(place, minlength=len(found))[due]
        if k == longest or k not in known.ordered:
            return
        pairs, numbers = known.ordered[k]
        where = np.minimum(np.searchsorted(pairs, found), len(pairs) - 1)
        ids = np.where(pairs[where] == found, numbers[where], -1).astype(np.int64)[place]


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[Numbered]:
    for batch in batches:
        for names, n, code, ends, letters, ids in zip(*batch.columns, strict=True):
            ends = np.frombuffer(ends.as_buffer(), np.int64)
            spelt = pa.LargeStringArray.from_buffers(len(ends) - 1, pa.py_buffer(ends), letters.as_buffer())
            yield Numbered(pa.array(names.as_py(), pa.large_string()), np.array(n.as_py(), np.int64), np.frombuffer(code.as_buffer(), np.int32), spelt, np.frombuffer(ids.as_buffer(), np.int32))
            pa.default_memory_pool().release_unused()


def _scan_words(shard: DataFrame) -> DataFrame:
    """(phrase, n): words, and of each language an empty one that stands for all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts in _blocks(batches):
            for _, keys, often, _ in count_numbered(texts, 1, {}, None, 0, 1):
                for i in range(0, len(keys), 1 << 16):
                    yield pa.RecordBatch.from_arrays([keys.slice(i, 1 << 16).cast(pa.string()), pa.array(often[i : i + (1 << 16)].astype(np.int64))], ["phrase", "n"])

    return shard.mapInArrow(run, "phrase string, n long")


def _scan_pairs(shard: DataFrame, longest: int, sent: Broadcast[Known]) -> DataFrame:
    """(key, n): ``count_pairs`` with the length before the pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for texts in _blocks(batches):
            for k, pairs, often in count_pairs(texts, longest, known):
                keys = pairs | (k << 2 * _BITS)
                for i in range(0, len(keys), 1 << 16):
                    at = slice(i, i + (1 << 16))
                    yield pa.RecordBatch.from_arrays([pa.array(keys[at]), pa.array(often[at].astype(np.int64))], ["key", "n"])

    return shard.mapInArrow(run, "key long, n long")


def _spell(counts: DataFrame, words: pa.Array, lists: dict[int, list[Steps]]) -> DataFrame:
    """(k, phrase, n) of (key, n)."""
    sent = counts.sparkSession.sparkContext.broadcast((words, lists))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, lists = sent.value
        bare = pc.replace_substring_regex(words, r"(?s)^.*\n", "")
        pairs = {k: np.concatenate([_climbed(x) for x in lists[k]]) for k in lists}

        def parts(k: int, pair: np.ndarray) -> list[np.ndarray]:
            """The numbers of the words of phrases."""
            head, tail = _halves(pair)
            if k == 2:
                return [head, tail]
            return [*parts(k - 1, pairs[k - 1][head]), parts(k - 1, pairs[k - 1][tail])[-1]]

        for batch in batches:
            keys, n = (c.to_numpy() for c in batch.columns)
            for k in np.unique(keys >> 2 * _BITS).tolist():
                mine = keys >> 2 * _BITS == k
                first, *others = parts(k, keys[mine])
                spelt = words.take(pa.array(first))
                for ids in others:
                    spelt = _joined(spelt, bare.take(pa.array(ids)), " ")
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(first), k, np.int32)), spelt.cast(pa.string()), pa.array(n[mine])], ["k", "phrase", "n"])

    return counts.mapInArrow(run, "k int, phrase string, n long")


def _merged(counted: DataFrame, state: DataFrame | None, key: str, least: int, scan: int) -> DataFrame:
    """Running counts with those of this scan, and since when they reach the threshold."""
    rows = counted.select(key, "n", F.lit(None).cast("int").alias("since"))
    rows = rows if state is None else rows.union(state.select(key, "n", "since"))
    sums = rows.groupBy(key).agg(F.sum("n").alias("n"), F.max("since").alias("since"))
    return sums.select(key, "n", F.when(F.col("n") >= least, F.coalesce("since", F.lit(scan + 1))).alias("since"))


def _by_number(dealt: DataFrame, longest: int, least: int, shards: int, most_bytes: int) -> DataFrame | None:
    """(k, phrase, n) of written shards; None if the active phrases of a length have more than ``most_bytes``."""
    spark = dealt.sparkSession
    k, m = F.shiftright("key", 2 * _BITS), F.greatest(F.shiftright("key", _BITS).bitwiseAND(F.lit(_ID)), F.col("key").bitwiseAND(F.lit(_ID)))
    words, size = _NONE[0], 0
    lists: dict[int, list[Steps]] = {}
    since = {j: np.zeros(0, np.int32) for j in range(1, longest)}
    first = {j: np.zeros(0, np.int32) for j in range(1, longest)}  # word of each active phrase
    of_words: DataFrame | None = None
    state: DataFrame | None = None
    done: list[DataFrame] = []
    scan = 0
    while True:
        most = max((j for j in since if len(since[j]) and since[j][-1] + shards > scan), default=0)
        if scan >= shards and not most:
            break
        shard = dealt.where(F.col("shard") == scan % shards).drop("shard")
        more: dict[int, np.ndarray] = {}
        if most:
            recent = np.zeros(len(words), bool)
            for j in since:
                recent[first[j][since[j] + shards > scan]] = True
            due = {j: int(np.searchsorted(since[j], scan - shards, "right")) for j in since}
            sent = spark.sparkContext.broadcast(Known(words, lists, due, recent))
            # numbers rise with the scans, so the greater one of a pair tells when it began
            begun = F.lit(0)
            for j in range(2, most + 2):
                for scanned in np.unique(since[j - 1]):
                    begun = F.when((k == j) & (m >= int(np.searchsorted(since[j - 1], scanned))), int(scanned)).otherwise(begun)
            rows = _merged(_scan_pairs(shard, most + 1, sent), state, "key", least, scan).withColumn("over", begun + shards <= scan + 1)
            # what ends its cycle below the threshold is forgotten
            merged = materialize(rows.where(~F.col("over") | F.col("since").isNotNull()), "counts")
            sent.destroy()
            done.append(merged.where("over").select("key", "n"))
            state = merged.where("not over")
            new = merged.where((F.col("since") == scan + 1) & (k < longest))
            for row in new.groupBy(k.alias("k")).count().collect():
                if (row["count"] + len(since[row["k"]])) * 4 > most_bytes:
                    return None
            keys = np.sort(new.select("key").toArrow()["key"].to_numpy())
            more = {j: keys[keys >> 2 * _BITS == j] & ((1 << 2 * _BITS) - 1) for j in range(2, longest)}
        if scan < shards:
            rows = _merged(_scan_words(shard), of_words, "phrase", least, scan)
            of_words = materialize(rows if scan + 1 < shards else rows.where(F.col("since").isNotNull() | F.endswith("phrase", F.lit("\n"))), "words")
            new = of_words.where((F.col("since") == scan + 1) & ~F.endswith("phrase", F.lit("\n"))).select("phrase")
            size += new.agg(F.coalesce(F.sum(F.octet_length("phrase") + 8), F.lit(0))).first()[0]
            if size > most_bytes and longest > 1:
                return None
            if longest > 1:
                got = new.toArrow()["phrase"].cast(pa.large_string())
                first[1] = np.arange(len(words) + len(got), dtype=np.int32)
                since[1] = np.append(since[1], np.full(len(got), scan + 1, np.int32))
                words = pa.concat_arrays([words, *got.chunks])
        for j, got in more.items():
            if len(got):
                lists.setdefault(j, []).append(_steps(got))
                since[j] = np.append(since[j], np.full(len(got), scan + 1, np.int32))
                first[j] = np.append(first[j], first[j - 1][_halves(got)[0]])
                if sum(x.nbytes for steps in lists[j] for x in steps) > most_bytes:
                    return None
        scan += 1
    found = of_words.select(F.when(F.endswith("phrase", F.lit("\n")), 0).otherwise(1).alias("k"), "phrase", "n")
    return found.union(_spell(reduce(DataFrame.union, done), words, lists)) if done else found


def frequent_phrases(docs: DataFrame, longest: int = 4, least: int = 30, shards: int = 3, most_bytes: int = 32_000_000, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(k, lang, phrase, n): phrases of up to ``longest`` words within a piece that occur at least ``least`` times in a
    language, overlaps included, words joined by one space; with k = 0 and an empty phrase, the words of each language.

    A-Z are lower-cased, pieces end at ``. , ; : ! ?`` and line breaks, words at spaces and tabs. A null language is
    ``und``, a null text has no words. An empty table gives an empty one; other columns are ignored.
    """
    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).alias("text")).where("text is not null")
    # shards are equal parts of the rows, whatever these hold; the numbers hold once they are written
    dealt = materialize(_numbered(rows.withColumn("shard", F.pmod(F.monotonically_increasing_id(), F.lit(shards)).cast("int")), shards), "shards", by="shard")
    got = _by_number(dealt, longest, least, shards, most_bytes) if longest < 8 else None
    got = _by_text(dealt, longest, least, shards, most_bytes) if got is None else got
    return got.select("k", _lang().alias("lang"), _spelt().alias("phrase"), "n")


def _by_text(dealt: DataFrame, longest: int, least: int, shards: int, most_bytes: int) -> DataFrame:
    """(k, phrase, n) of written shards, whatever the length of the lists of active phrases."""
    spark = dealt.sparkSession
    state: DataFrame | None = None
    done: list[DataFrame] = []
    reached: list[DataFrame] = []  # by scan, what became active after it
    active: Active = {}
    size, last = dict.fromkeys(range(1, longest), 0), dict.fromkeys(range(1, longest), 0)
    scan = 0
    while True:
        # a length goes on while the cycle of some phrase with a subphrase of the length before may
        most = max((k for k in active if last[k] + shards > scan), default=0)
        if scan >= shards and not most:
            break
        sent = spark.sparkContext.broadcast({k: active[k] for k in range(1, most + 1)})
        counted = _scan(dealt.where(F.col("shard") == scan % shards).drop("shard"), longest, sent, scan, shards)
        unseen = [k + 1 for k in range(1, most + 1) if active[k] is None]
        if unseen:
            whole = materialize(counted.groupBy("k", "phrase").agg(F.sum("n").alias("n"), F.max("begun").alias("begun")), "counted")
            counted = whole.where(~F.col("k").isin(unseen))
            for k in unseen:
                counted = counted.unionByName(_known_by_join(whole, reached, k, scan, shards))
        # of a phrase, length and begin are always the same, so the greatest number of all three has the one ``since`` there is
        packed = lambda since: ((since * (1 << 20) + F.col("begun")) * (1 << 8) + F.col("k")).alias("all")
        rows = counted.select("phrase", "n", packed(F.lit(0).cast("long")))
        if state is not None:
            rows = rows.union(state.select("phrase", "n", packed(F.coalesce("since", F.lit(0)).cast("long"))))
        k, begun, since = F.col("all") % (1 << 8), F.shiftright("all", 8) % (1 << 20), F.nullif(F.shiftright("all", 28), F.lit(0))
        merged = rows.groupBy("phrase").agg(F.sum("n").alias("n"), F.max("all").alias("all"))
        merged = merged.select(k.cast("int").alias("k"), "phrase", "n", begun.cast("int").alias("begun"), F.when(F.col("n") >= least, F.coalesce(since.cast("int"), F.lit(scan + 1))).alias("since"))
        over = F.col("begun") + shards <= scan + 1
        # what ends its cycle below the threshold is forgotten
        merged = materialize(merged.where(~over | F.col("since").isNotNull() | (F.col("k") == 0)), "counts")
        sent.destroy()
        done.append(merged.where(over).select("k", "phrase", "n"))
        state = merged.where(~over)
        new = merged.where((F.col("since") == scan + 1) & F.col("k").between(1, longest - 1)).select("k", "phrase", "since")
        reached.append(new)
        for r in new.groupBy("k").agg(F.sum(F.octet_length("phrase") + 8).alias("bytes")).collect():
            size[r["k"]] += r["bytes"]
            last[r["k"]] = scan + 1
            active[r["k"]] = active.get(r["k"], _NONE) if size[r["k"]] <= most_bytes else None
        got = new.where(F.col("k").isin([k for k in active if active[k] is not None])).select("k", "phrase").toArrow()
        for k in active:
            if active[k] is not None and (more := got.filter(pc.equal(got["k"], k))).num_rows:
                active[k] = (pa.concat_arrays([active[k][0], *more["phrase"].cast(pa.large_string()).chunks]), np.append(active[k][1], np.full(more.num_rows, scan + 1)))
        scan += 1
    return reduce(DataFrame.union, done).select("k", "phrase", "n")


def collocations(docs: DataFrame, longest: int = 4, least: int = 30, cover: int = 80, shards: int = 3, most_bytes: int = 32_000_000, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, phrase, a, l, r, n, score) of phrases of two to ``longest`` words that occur at least ``least`` times (a), but
    for those that lie in a longer one with ``cover`` percent of their occurrences or more.

    A phrase is cut in two after each of its words; l and r are how often the parts occur, and the score, which is
    floor(2000000 * a / (l + r)), is that of the lowest cut (ties: of the shortest first part). n: words of the language.
    """
    counts = materialize(frequent_phrases(docs, longest, least, shards, most_bytes, text_col, lang_col), "phrases")
    f = counts.where("k > 0").select("lang", "phrase", "n")
    phrases = counts.where("k > 1").select("lang", "phrase", F.col("n").alias("a"), "k")
    cut = phrases.select("lang", "phrase", "a", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"), "k")
    cut = cut.select("*", F.expr("substring_index(phrase, ' ', cut)").alias("first"), F.expr("substring_index(phrase, ' ', cut - k)").alias("rest"))
    cut = cut.join(f.select("lang", F.col("phrase").alias("first"), F.col("n").alias("l")), ["lang", "first"]).join(f.select("lang", F.col("phrase").alias("rest"), F.col("n").alias("r")), ["lang", "rest"])
    # decimals: the product may pass 64 bits
    cut = cut.withColumn("score", F.expr("(cast(2000000 as decimal(10, 0)) * cast(a as decimal(20, 0))) div cast(l + r as decimal(20, 0))"))
    scored = cut.groupBy("lang", "phrase").agg(F.min(F.struct("score", "cut", "a", "l", "r")).alias("low"))
    inner = F.expr("flatten(transform(sequence(2, k - 1), m -> transform(sequence(0, k - m), i -> concat_ws(' ', slice(split(phrase, ' '), i + 1, m)))))")
    within = phrases.where("k > 2").select("lang", F.explode(inner).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("outer"))
    kept = scored.join(within, ["lang", "phrase"], "left").where(F.expr(f"outer is null or 100 * cast(outer as decimal(20, 0)) < {cover} * cast(low.a as decimal(20, 0))"))
    totals = counts.where("k = 0").select("lang", F.col("n").alias("total"))
    return kept.join(totals, "lang").select("lang", "phrase", "low.a", "low.l", "low.r", F.col("total").alias("n"), "low.score")


def best_phrases(scored: DataFrame, top: int = 2000, salts: int = 64) -> DataFrame:
    """The first ``top`` of each language with their ``rank``: score and count falling, then phrases in byte order. The best
    of each of ``salts`` parts of a language are found first, so one task gets ``salts`` times ``top`` rows at most."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    rank = F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))
    part = scored.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(salts))).withColumn("rank", rank).where(F.col("rank") <= top).drop("salt", "rank")
    return part.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
