"""SimHash links, phrase collocations and whitening against plain versions on small fixtures, with the odd cases."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pytest
from xxhash import xxh64_intdigest

from emberlog.llm import phrases, queries, simhash, whitening

DOCS = "doc_id long, text string, lang string, fp long, least int, count long, x string, phrase string, k int"


def table(spark, rows):
    return spark.createDataFrame([(i, t, lang, 1, 2, 3, "x", "p", 4) for i, t, lang in rows], DOCS).repartition(3)


# SimHash


def plain_fingerprint(text: str | None, n: int = 3) -> int:
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))] if words else []
    hashes = [xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(ids: list, fps: list[int], distance: int = 2) -> list:
    up = list(range(len(fps)))

    def find(i: int) -> int:
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= distance:
                up[find(i)] = find(j)
    least: dict = {}
    for i, k in enumerate(ids):
        if k is not None:
            least[find(i)] = min(k, least.get(find(i), k))
    return [least.get(find(i)) for i in range(len(fps))]


def texts() -> list[str | None]:
    rng = random.Random(3)
    vocabulary = ["".join(rng.choice("abcdefÉß") for _ in range(rng.randint(1, 8))) for _ in range(400)]
    out: list[str | None] = [None, "", " \t\r\n ", "One", "one", "ONE two", "a\x0bb\x0cc d", "word " * 700]
    for _ in range(12):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(200, 900))]
        out.append(" ".join(base))
        for _ in range(4):
            near = list(base)
            for _ in range(rng.randint(0, 3)):
                near[rng.randrange(len(near))] = rng.choice(vocabulary)
            out.append("\n".join(near) if rng.random() < 0.3 else "  ".join(near).upper())
    out.append(" ".join(rng.choice(vocabulary) for _ in range(70_000)))  # more than a block of shingles
    return out


def test_fingerprints_and_components_are_those_of_plain_python(spark):
    held = texts()
    ids = [None if i == 9 else 7 if i in (20, 21) else i for i in range(len(held))]
    fps = [plain_fingerprint(t) for t in held]
    want = sorted(map(str, zip(ids, [f"{f:016x}" for f in fps], plain_components(ids, fps), strict=True)))
    rows = table(spark, [(i, t, "en") for i, t in zip(ids, held, strict=True)])
    got = simhash.near_duplicates(rows).collect()
    assert sorted(str((r["doc_id"], f"{r['fp'] & (1 << 64) - 1:016x}", r["component_id"])) for r in got) == want
    assert len(set(fps)) > len(set(plain_components(list(range(len(fps))), fps)))  # some link without being equal


def links(spark, values: list[int], **options) -> set[tuple[int, int]]:
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    rows = simhash.fingerprint_links(spark.createDataFrame([(v,) for v in signed], "fp long"), **options).collect()
    return {(min(a, b), max(a, b)) for a, b in ((r["a"] & (1 << 64) - 1, r["b"] & (1 << 64) - 1) for r in rows)}


@pytest.mark.parametrize(("distance", "parts", "hot"), [(2, 3, 512), (2, 3, 8), (2, 2, 8), (1, 3, 512), (3, 3, 20), (0, 1, 2)])
def test_every_link_is_found_whatever_the_partitions(spark, distance, parts, hot):
    rng = random.Random(distance * 10 + parts)
    values = {0, (1 << 64) - 1, 1 << 63}
    for _ in range(8):  # crowds that share most of their bits, so that projections are hot
        centre = rng.getrandbits(64)
        values |= {centre ^ sum(1 << rng.randrange(64) for _ in range(rng.randint(0, 4))) & (1 << 64) - 1 for _ in range(40)}
    values |= {rng.getrandbits(64) for _ in range(60)}
    held = sorted(values)
    want = {(a, b) for i, a in enumerate(held) for b in held[i + 1 :] if (a ^ b).bit_count() <= distance}
    assert links(spark, held, distance=distance, parts=parts, hot=hot) == want
    assert len(want) > 20 or not distance


def test_allowances_cost_least_and_add_up():
    rng = np.random.default_rng(1)
    fp = rng.integers(0, 1 << 63, 30, dtype=np.uint64)
    parts = [list(range(10)), list(range(10, 40)), list(range(40, 64))]
    counted = rng.integers(1, 5000, (30, 3)).astype(float)
    p = rng.uniform(0.2, 0.8, 64)
    got = simhash.allowances(fp, counted, 1000, p, parts, 2)
    assert (got.sum(axis=1) == 3).all()
    crowded = simhash.allowances(fp, np.tile([1e9, 1.0, 1.0], (30, 1)), 1000, p, parts, 2)
    assert (crowded[:, 0] == 0).all()  # a partition in which all are candidates isn't looked at


def test_correlated_bits_go_together():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2, (2000, 4)).astype(float)
    bits = np.hstack([np.where(rng.random((2000, 16)) < 0.05, 1 - base[:, [g]], base[:, [g]]) for g in range(4)])
    order = rng.permutation(64)
    groups = simhash.group_bits(2000, (bits[:, order].T @ bits[:, order]), 4)
    assert sorted(sorted({int(order[b]) // 16 for b in g}) for g in groups) == [[0], [1], [2], [3]]


def test_no_documents_no_links(spark):
    assert simhash.near_duplicates(table(spark, [])).collect() == []


# Phrases


def plain_collocations(rows: list[tuple[str | None, str | None]], longest: int, least: int, cover: int = 80) -> list[tuple]:
    f, n = Counter(), Counter()
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(words)
            for k in range(1, longest + 1):
                f.update((lang or "und", tuple(words[i : i + k])) for i in range(len(words) - k + 1))
    found = {key: a for key, a in f.items() if len(key[1]) > 1 and a >= least}
    hidden = set()
    for (lang, words), a in found.items():
        for m in range(2, len(words)):
            for i in range(len(words) - m + 1):
                if 100 * a >= cover * f[lang, words[i : i + m]]:
                    hidden.add((lang, words[i : i + m]))
    out = []
    for (lang, words), a in found.items():
        if (lang, words) not in hidden:
            cuts = [(2_000_000 * a // (f[lang, words[:j]] + f[lang, words[j:]]), j) for j in range(1, len(words))]
            score, j = min(cuts)
            out.append((lang, " ".join(words), a, f[lang, words[:j]], f[lang, words[j:]], n[lang], score))
    return sorted(out, key=lambda r: (r[0], -r[6], -r[2], r[1].encode()))


def prose() -> list[tuple[str | None, str | None]]:
    rng = random.Random(8)
    vocabulary = [chr(97 + i % 26) + "éxyz"[: i % 5] for i in range(40)]
    odd: list[tuple[str | None, str | None]] = [(None, None), ("en", ""), ("en", " \t "), ("en", ".,;\r\n!"), ("en", "A a\tA"), ("x\ny", "odd language, odd language odd"), (None, "no tongue no tongue no tongue"), ("en", "und\x0bso weiter\x0cund so weiter und so weiter")]
    for i in range(120):
        words = rng.choices(vocabulary, [1 / (r + 1) for r in range(40)], k=rng.randint(1, 120))
        if i % 4 == 0:
            words[3:3] = ["over", "the", "Rainbow", "bridge"]
        if i % 5 == 0:
            words += ["new", "york", "city"]
        text = "".join(w + rng.choice(["  ", " ", " ", "\t", ", ", ". ", "\n"]) for w in words)
        odd.append((rng.choice(["en", "en", "en", "de", None]), text))
    return odd + [odd[-1]] * 3


@pytest.mark.parametrize(("longest", "least", "shards", "most_bytes"), [(4, 5, 3, 32_000_000), (4, 5, 3, 0), (4, 3, 2, 300), (3, 8, 1, 32_000_000), (5, 4, 4, 32_000_000)])
def test_phrases_are_those_of_plain_counting(spark, longest, least, shards, most_bytes):
    rows = prose()
    got = phrases.collocations(table(spark, [(i, t, lang) for i, (lang, t) in enumerate(rows)]), longest=longest, least=least, shards=shards, most_bytes=most_bytes)
    want = plain_collocations(rows, longest, least)
    ranked = phrases.best_phrases(got, top=10_000, salts=3).orderBy("lang", "rank").collect()
    assert [(r["lang"], r["phrase"], r["a"], r["l"], r["r"], r["n"], r["score"]) for r in ranked] == want
    assert len(want) > 20
    ranks = Counter(r["lang"] for r in ranked)
    assert [r["rank"] for r in ranked] == [i for lang in sorted(ranks) for i in range(1, ranks[lang] + 1)]
    few = phrases.best_phrases(got, top=2, salts=3)
    assert sorted(r["phrase"] for r in few.collect()) == sorted(r["phrase"] for r in ranked if r["rank"] <= 2)


def test_a_phrase_waits_for_its_subphrases_and_is_counted_for_one_cycle(spark):
    words = ["in", "medias", "res"]
    import pyarrow as pa

    once = lambda active, scan: {(k, p): (int(n), int(b)) for k, keys, ns, bs in phrases.count_phrases(pa.array(["en"]), pa.array([" ".join(words * 4)]), 3, active, scan, 3) for p, n, b in zip(keys.to_pylist(), ns, bs, strict=True)}
    known = (pa.array(["en\nin", "en\nmedias"], pa.large_string()), np.array([1, 2]))
    assert (2, "en\nmedias res") not in once({1: known}, 2)
    assert once({1: known}, 2)[2, "en\nin medias"] == (4, 2)
    assert (2, "en\nin medias") in once({1: known}, 4)
    assert (2, "en\nin medias") not in once({1: known}, 5)
    assert not [key for key in once({1: known}, 3) if key[0] < 2]


def test_long_texts_are_cut_where_pieces_end(monkeypatch):
    monkeypatch.setattr(phrases, "_LONG", 10)
    text = "aaaa bbbb cccc, dd. eeeeeeeeeeeeeeeeeeeeeee f; g"
    assert "".join(phrases._cut(text)) == text
    assert list(phrases._cut(text)) == ["aaaa bbbb cccc,", " dd. eeeeeeeeeeeeeeeeeeeeeee f;", " g"]


def test_no_documents_no_phrases(spark):
    assert phrases.best_phrases(phrases.collocations(table(spark, []))).collect() == []


# Whitening

VECTORS = "vec_id long, embedding array<float>, x string, n int, v binary"


def vectors(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if c is None else float(c) for c in v], "x", 1, b"") for i, v in rows], VECTORS).repartition(3)


def check_whitening(spark, given, kept, components):
    """``given``: (id, vector) rows; ``kept``: those that take part."""
    got = whitening.whitened(vectors(spark, given), components).collect()
    x = np.array([[int(np.floor(64 * float(np.float32(c)))) + 1_000_000 for c in v] for _, v in kept])
    n, sums = len(x), x.sum(axis=0)
    centred = (n * x - sums) / n
    cov = centred.T @ centred / n
    values, u = np.linalg.eigh(cov)
    values, u = values[::-1], u[:, ::-1]
    k = min(components, int((values > 1e-9 * np.trace(cov)).sum()))
    assert len(got) == len(kept) * k
    deviation = {i: int(((n * row - sums) ** 2).sum()) for (i, _), row in zip(kept, x, strict=True)}
    w = {i: row @ u / np.sqrt(np.maximum(values, 1e-30)) for (i, _), row in zip(kept, centred, strict=True)}
    anchor = max(w, key=lambda i: np.abs(w[i][:k]).min())
    sign = {r["component"]: np.sign(r["whitened"]) * np.sign(w[anchor][r["component"] - 1]) for r in got if r["vec_id"] == anchor}
    for r in got:
        c = r["component"] - 1
        assert (r["n"], r["deviation"]) == (n, deviation[r["vec_id"]])
        assert r["whitened"] == pytest.approx(sign[c + 1] * w[r["vec_id"]][c], abs=1e-7)
        assert r["explained"] == pytest.approx(values[c] / np.trace(cov), rel=1e-9)
        assert r["identity_error"] < 1e-10
    return got


def test_whitening_is_that_of_a_dense_solver(spark):
    rng = np.random.default_rng(4)
    good = [(i, v) for i, v in enumerate(rng.standard_normal((150, 40)) * (0.93 ** np.arange(40)) * 3)]
    odd = [(900, None), (901, [float("nan")] * 40), (902, [1.0] * 39 + [float("inf")]), (903, [None] + [1.0] * 39), (904, [1.0] * 39), (905, [])]
    check_whitening(spark, good + odd, good, 6)
    check_whitening(spark, good, good, 64)


def test_ranks_repeated_rows_and_ids(spark):
    rng = np.random.default_rng(5)
    flat = [(i, v) for i, v in enumerate(rng.integers(-9, 9, (60, 3)) @ rng.integers(-3, 3, (3, 12)))]
    got = check_whitening(spark, flat + [flat[0]] * 40, flat + [flat[0]] * 40, 32)
    assert {r["component"] for r in got} == {1, 2, 3}


def test_nothing_to_whiten(spark):
    assert whitening.whitened(vectors(spark, [])).collect() == []
    assert whitening.whitened(vectors(spark, [(1, [1.0, 2.0])])).collect() == []
    assert whitening.whitened(vectors(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0]), (None, None)])).collect() == []


def test_large_entries_stay_exact(spark):
    rows = [(i, [float(2**40 + 3 * i), float(-i)]) for i in range(1, 9)]
    check_whitening(spark, rows, rows, 2)


@pytest.mark.parametrize(("n", "size", "fall"), [(400, 200, 0.97), (300, 120, 1.0), (50, 20, 0.5)])
def test_jacobi_davidson_reaches_rounding_level(n, size, fall):
    x = np.random.default_rng(n).standard_normal((n, size)) * fall ** np.arange(size)
    cov = x.T @ x / n
    asked = []

    def product(b):
        asked.append(b.shape[1])
        return x.T @ (x @ b) / n

    values, u = whitening.jacobi_davidson(product, size, 12, float(np.trace(cov)))
    assert np.abs(values - np.linalg.eigvalsh(cov)[::-1][:12]).max() < 1e-13 * np.trace(cov)
    assert np.linalg.norm(cov @ u - u * values, axis=0).max() < 1e-13 * np.trace(cov)
    assert np.abs(u.T @ u - np.eye(12)).max() < 1e-13
    assert max(asked) <= 16  # never a whole matrix


def test_minres_solves_symmetric_indefinite_systems():
    rng = np.random.default_rng(6)
    q = np.linalg.qr(rng.standard_normal((30, 30)))[0]
    a = q * np.concatenate([np.linspace(-3, -1, 10), np.linspace(1, 4, 20)]) @ q.T
    b = rng.standard_normal((30, 4))
    b[:, 3] = 0
    x = whitening.minres(lambda v: a @ v, b, 200, 1e-12)
    assert np.abs(a @ x - b).max() < 1e-9


# The queries


@pytest.mark.parametrize("name", ["op11_simhash", "op12_phrases", "op13_whitening"])
def test_registered_queries_have_the_columns_of_their_contract(spark, name):
    df = queries.QUERIES[name](spark, "/root/testdata/sf0.001")
    want = {
        "op11_simhash": [("doc_id", "bigint"), ("fingerprint", "string"), ("component_id", "bigint")],
        "op12_phrases": [("lang", "string"), ("rank", "bigint"), ("phrase", "string"), ("a", "bigint"), ("l", "bigint"), ("r", "bigint"), ("n", "bigint"), ("score", "bigint")],
        "op13_whitening": [("vec_id", "bigint"), ("component", "int"), ("n", "bigint"), ("deviation", "bigint"), ("whitened", "double"), ("explained", "double"), ("identity_error", "double")],
    }[name]
    assert df.dtypes == want
    assert df.count() > 0
