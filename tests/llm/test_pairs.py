"""Similarity operators against brute force, and their edge cases."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lumiframe.llm import line_dedup, linking, neighbours
from lumiframe.llm import words as W
from lumiframe.llm.components import connected_components
from lumiframe.llm.decontamination import _NEAR, RADIUS, Benchmark, HammingIndex, benchmark_hits, decontaminate
from lumiframe.llm.line_dedup import dedup_lines, line_components
from lumiframe.llm.neighbours import nearest_neighbours
from lumiframe.llm.ngram_join import bands, max_difference, ngram_jaccard_components, signatures
from lumiframe.llm.queries import op4_line_dedup
from lumiframe.llm.storage import Scratch


def union(pairs, nodes):
    top = {n: n for n in nodes}

    def find(n):
        while top[n] != n:
            top[n] = top[top[n]]
            n = top[n]
        return n

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        top[b] = a
    return {n: find(n) for n in nodes}


def prose(rng, n, words=400):
    return " ".join(f"w{int(rng.paretovariate(0.6)) % words}" for _ in range(n))


def near(rng, text, edits):
    parts = text.split(" ")
    for _ in range(edits):
        parts[rng.randrange(len(parts))] = f"x{rng.randrange(10**6)}"
    return " ".join(parts)


def shingle_set(text, size):
    ws = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(ws[i : i + size]) for i in range(max(1, len(ws) - size + 1))} if ws else set()


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(160)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5, 5)]
    got = connected_components(spark.createDataFrame(edges, "a bigint, b bigint"), Scratch(spark, "t"))
    edges_ = [e for e in edges if e[0] != e[1]]
    want = union(edges_, {n for e in edges_ for n in e})
    assert {r["node"]: r["component"] for r in got.collect()} == want


def test_ngram_join_matches_brute_force(spark):
    rng, rows = random.Random(2), []
    for g in range(30):
        base = prose(rng, rng.choice([3, 5, 8, 12, 20, 40, 120, 300]))
        rows += [base] + [near(rng, base, rng.choice([0, 1, 1, 2, 5])) for _ in range(rng.randrange(5))]
    shared = prose(rng, 30)
    rows += [f"{prose(rng, 40)} {shared} {prose(rng, 40)}" for _ in range(12)]
    hub = prose(rng, 200)
    rows += [near(rng, hub, rng.choice([1, 2, 3, 4, 6])) for _ in range(40)]
    rows += ["", None, "  \n\t ", "One two", "one\x0btwo", "ONE TWO", "é à"]
    docs = list(enumerate(rows))
    rng.shuffle(docs)
    sets = {i: shingle_set(t, 4) for i, t in docs}
    pairs = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    want = union(pairs, sets)
    df = spark.createDataFrame([(i, t, "x", 0) for i, t in docs], "doc_id bigint, text string, component_id string, n int")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_jaccard_components(df).collect()}
    assert got == {i: (len(sets[i]), want[i]) for i in sets}
    assert len(set(want.values())) < len(want)


def test_ngram_join_edges(spark):
    df = spark.createDataFrame([(1, "a b c d e"), (1, "a b c d e"), (None, "a b c d e"), (2, None)], "doc_id bigint, text string")
    got = sorted((r["doc_id"] or -1, r["n_shingles"], r["component_id"]) for r in ngram_jaccard_components(df).collect())
    assert got == [(-1, 2, None), (1, 2, 1), (1, 2, 1), (2, 0, 2)]
    assert ngram_jaccard_components(df.limit(0)).collect() == []


def test_signatures_meet():
    """Any two sets within the threshold share a key, at every size."""
    rng, lows = np.random.default_rng(3), bands(85, 100)
    for n in [*range(6, 40), 63, 94, 200, 700]:
        for _ in range(12):
            a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
            cut = next(d for d in range(len(a), -1, -1) if (len(a) - d) * 100 >= 85 * len(a))
            b = np.sort(rng.permutation(a)[cut:]) if rng.random() < 0.5 else np.sort(np.concatenate([rng.permutation(a)[: len(a) - max_difference(2 * len(a), 85, 100) // 2], rng.integers(0, 2**63, max_difference(2 * len(a), 85, 100) // 2).astype(np.uint64)]))
            inter = len(np.intersect1d(a, b))
            if 100 * inter >= 85 * (len(a) + len(b) - inter) and inter < max(len(a), len(b)):
                assert len(np.intersect1d(signatures(a, lows, 85, 100), signatures(b, lows, 85, 100)))


def brute_lines(rows):
    lines = [(d, i, t.strip(" \t\r\x0b\x0c")) for d, text in rows for i, t in enumerate((text or "").split("\n"))]
    lines = [(d, i, "".join(c.lower() if c.isascii() else c for c in t)) for d, i, t in lines if t]
    sets = [{t[k : k + 8] for k in range(max(1, len(t) - 7))} for _, _, t in lines]
    n = len(lines)
    pairs = [(a, b) for a in range(n) for b in range(a + 1, n) if 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b])]
    top = union(pairs, range(n))
    best = {}
    for k, (d, i, _) in enumerate(lines):
        best[top[k]] = min(best.get(top[k], (d, i)), (d, i))
    return {(d, i): best[top[k]] == (d, i) for k, (d, i, _) in enumerate(lines)}


def test_line_dedup(spark):
    rng = random.Random(4)
    base = [prose(rng, 30) for _ in range(12)]
    rows = [(d, "\n".join([*(near(rng, b, rng.choice([0, 0, 1])) for b in rng.sample(base, 4)), prose(rng, 20), "", "short", " ÄÖ é ü "])) for d in range(15)] + [(90, None), (91, ""), (92, "\n\n")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("line", F.lit("clash"))
    want = brute_lines(rows)
    got = {(r["doc_id"], r["line"]): r["keep"] for r in line_components(df).collect()}
    assert got == want
    texts = {r["doc_id"]: r["text"] for r in dedup_lines(df.select("doc_id", "text")).collect()}
    for d, t in rows:
        kept = None if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if want.get((d, i), True))
        assert texts[d] == kept
    assert line_components(df.limit(0)).collect() == []


def test_line_dedup_short_lines(spark, tmp_path):
    lines = ["Copyright 2019 The Example Authors, all rights reserved", "Licensed under the MIT license, see LICENSE file", "Share this article with your friends on our forum", "Subscribe to the newsletter for weekly news and offers from all shops"]
    rng = random.Random(5)
    rows, planted = [], []
    for d, line in enumerate(lines):
        at = rng.randrange(12, len(line) - 12)
        planted.append(line[:at] + ("#" if line[at] != "#" else "+") + line[at + 1 :])
        rows += [(d, line), (100 + d, planted[-1]), (200 + d, prose(rng, 6))]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r["n_kept"] for r in op4_line_dedup(spark, str(tmp_path)).collect()}
    assert all(40 <= len(p) < 79 for p in planted)
    assert got == {d: 0 if 100 <= d < 200 else 1 for d, _ in rows}


def test_buckets_of_two_are_done_after_the_stars(spark, monkeypatch):
    """Lines that share bands but aren't similar enough meet once; only buckets of three go on to pairs."""
    calls, inner = [], linking._open_pairs
    monkeypatch.setattr(linking, "_open_pairs", lambda *a: calls.append(a) or inner(*a))
    rng = random.Random(7)
    base = [prose(rng, 40) for _ in range(8)]
    rows = [(d, b) for d, b in enumerate(base)] + [(50 + d, near(rng, b, 5)) for d, b in enumerate(base)]
    got = {r["doc_id"]: r["keep"] for r in line_components(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {d: k for (d, _), k in brute_lines(rows).items()} and sum(got.values()) > 10
    assert not calls


def test_line_profiles_bound_the_difference():
    """Never more than the elements that lie in one set only, and nearly all of them."""
    rng = np.random.default_rng(8)
    low = [chr(97 + i) for i in range(26)]
    texts = ["".join(rng.choice(low, 300)) for _ in range(60)]
    others = [t[: 40 + k] + "".join(rng.choice(low, k)) + t[40 + 2 * k :] for k, t in enumerate(texts)]
    a, b = (line_dedup._line_sets(pa.array(x), 4) for x in (texts, others))
    p, q = (line_dedup._profiles(x, 60) for x in (a, b))
    n, m = (np.bincount((x >> np.uint64(48)).astype(int)) for x in (a, b))
    far = line_dedup._apart(1, 1000)(n, p, m, q)
    true = [len({s[i : i + 4] for i in range(297)} ^ {t[i : i + 4] for i in range(297)}) for s, t in zip(texts, others, strict=True)]
    assert all(0.8 * t <= f <= t for f, t in zip(far.tolist(), true, strict=True))


def test_short_lines_have_short_profiles():
    """A profile has at most a byte for four shingles beyond 128 bits, and folded ones bound the difference too."""
    rng = np.random.default_rng(9)
    sets = []
    for size in (1, 5, 100, 128, 129, 150, 256, 257, 300, 512, 513, 900):
        own = rng.integers(0, 1 << 48, size).astype(np.uint64)
        new = rng.integers(0, 1 << 48, size // 6).astype(np.uint64)
        sets += [own, np.append(own[size // 12 :], new[: size // 12]), np.append(own, new)]
    sets = [np.unique(s) for s in sets]
    n = np.array([len(s) for s in sets])
    keys = np.concatenate([s | np.uint64(i << 48) for i, s in enumerate(sets)])
    short = line_dedup._short(line_dedup._profiles(keys, len(sets)), n)
    assert all(len(p) <= max(16, k // 4) for p, k in zip(short.to_pylist(), n.tolist(), strict=True))
    profiles = linking._matrix(short)
    i, j = np.triu_indices(len(sets), 1)
    far = line_dedup._apart(80, 100)(n[i], profiles[i], n[j], profiles[j])
    linked = 0
    for a, b, f in zip(i, j, far.tolist(), strict=True):
        common = len(np.intersect1d(sets[a], sets[b]))
        if 100 * common >= 80 * (n[a] + n[b] - common):
            linked += 1
            assert f <= n[a] + n[b] - 2 * common
    assert linked >= 24 and (far < linking.NEVER).sum() < 2 * linked


def test_neighbour_recall(spark):
    """At least 0.9 against brute force at the defaults, at three sizes, on vectors without any structure."""
    rng = np.random.default_rng(6)
    x = rng.standard_normal((6000, 64)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    for n in (500, 2000, 6000):
        df = spark.createDataFrame(pa.table({"vec_id": pa.array(range(n), pa.int64()), "embedding": pa.array(list(x[:n]), pa.list_(pa.float32()))}))
        got = {(r["query_id"], r["vec_id"]) for r in nearest_neighbours(df, F.col("vec_id") % 50 == 0, k=10).collect()}
        want = set()
        for q in range(0, n, 50):
            d = ((x[:n].astype(np.float64) - x[q]) ** 2).sum(axis=1)
            d[q] = np.inf
            want |= {(q, int(i)) for i in np.argsort(d)[:10]}
        assert len(got) == len(want) and len(got & want) >= 0.9 * len(want), (n, len(got & want) / len(want))
        print(n, len(got & want) / len(want))


def test_neighbours(spark, monkeypatch):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((600, 16)).astype(np.float32)
    x[100:140] = x[7]
    rows = [(i, [float(v) for v in x[i]]) for i in range(600)] + [(1000, None), (1001, []), (1002, [0.0] * 16), (1003, [float("nan")] * 16), (1004, [1.0] * 3), (1005, [None] + [1.0] * 15), (None, [1.0] * 16), (7, [float(v) for v in x[7]])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    out = nearest_neighbours(df, F.col("vec_id") % 50 == 0, k=10, leaf=32, effort=1e9)
    got = {}
    for r in out.collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert sorted(got) == list(range(0, 600, 50))
    for q, found in got.items():
        d = np.sqrt(((x.astype(np.float64) - x[q]) ** 2).sum(axis=1))
        d[q] = np.inf
        want = sorted(range(600), key=lambda i: (d[i], i))[:10]
        assert [v for _, v, _ in sorted(found)] == want
        assert [s for _, _, s in sorted(found)] == pytest.approx(list(d[want]))
    monkeypatch.setattr(neighbours, "PART", 7)  # leaves and their queries in parts
    parts = nearest_neighbours(df, F.col("vec_id") % 50 == 0, k=10, leaf=32, effort=1e9).collect()
    assert {(r["query_id"], r["rank"], r["vec_id"]) for r in parts} == {(q, n, v) for q, f in got.items() for n, v, _ in f}
    far = df.select("vec_id", F.transform("embedding", lambda v: v.cast("double") * 1e170).alias("embedding"))  # squares overflow
    assert len(nearest_neighbours(far, F.col("vec_id") == 50, k=10, leaf=32).collect()) == 10
    assert nearest_neighbours(df.limit(0), F.lit(True)).collect() == []
    assert nearest_neighbours(df.filter("vec_id = 3"), F.lit(True)).collect() == []


def test_neighbours_found_by_several_trees_are_merged(monkeypatch):
    rows = [([5, 7], [[0.5, 1.0, 2.0], [0.25]], [[3, 4, 9], [8]]), ([5, 5], [[0.5, 0.75], [1.0, 1.5]], [[3, 6], [4, 2]])]
    batches = [pa.RecordBatch.from_pydict({"query_id": pa.array(q), "s": pa.array(s), "n": pa.array(n)}) for q, s, n in rows]
    for held in (1 << 18, 3):
        monkeypatch.setattr(neighbours, "HELD", held)
        got = {x for b in neighbours._best(3)(iter(batches)) for x in zip(*(c.to_pylist() for c in b.columns), strict=True)}
        want = {(5, 0.5, 3), (5, 0.75, 6), (5, 1.0, 4), (7, 0.25, 8)}
        assert got == want if held > 3 else got >= want


def test_decontamination(spark):
    rng = random.Random(6)
    items = [(i, prose(rng, n)) for i, n in enumerate([15, 16, 20, 27, 33, 40, 52, 59, 80])]
    docs = [(100 + i, f"{prose(rng, rng.randrange(200))} {t.upper() if i % 2 else t} {prose(rng, rng.randrange(200))}") for i, t in items]
    docs += [(200, items[3][1]), (201, near(rng, items[8][1], 1)), (202, " ".join(items[7][1].split()[:20])), (203, None), (204, ""), (205, "a"), (206, prose(rng, 3000))]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("similarity", F.lit(1))
    bench = spark.createDataFrame([*items, (50, None), (51, "")], "item_id bigint, text string")
    got = {(r["doc_id"], r["item_id"]): r for r in benchmark_hits(df, bench).collect()}
    assert set(got) == {(100 + i, i) for i, _ in items} | {(200, 3), (201, 8)}
    for i, t in items:
        r = got[100 + i, i]
        own = dict(docs)[100 + i].lower().split()
        assert own[r["first_word"] : r["first_word"] + r["n_words"]] == t.lower().split() and r["similarity"] == pytest.approx(1)
    assert {r["doc_id"] for r in decontaminate(df, bench).collect()} == {d for d, _ in docs} - {d for d, _ in got}
    assert benchmark_hits(df, bench.limit(0)).collect() == [] and benchmark_hits(df.limit(0), bench).collect() == []


def slow_similarity(items, i, window):
    holders = Counter(x for h in items for x in set(h.tolist()))
    weight = lambda x: 1 + math.log((1 + len(items)) / max(holders[x], 1))
    own, other = Counter(items[i].tolist()), Counter(window)
    return round(sum(weight(x) * min(own[x], other[x]) for x in own) / sum(weight(x) * max(own[x], other[x]) for x in own.keys() | other.keys()), 9)


def test_decontamination_matches_brute_force(spark, monkeypatch):
    """Hits of all items and documents by every window, also with the benchmark in parts; shared shingles, repeated items and
    words, short items, an item that is longer than a text."""
    from lumiframe.llm import decontamination

    rng = random.Random(9)
    stock = prose(rng, 60, 40)
    items = [(i, f"{prose(rng, rng.randrange(2, 40))} {stock if i % 5 == 0 else ''} {prose(rng, rng.randrange(1, 30))}") for i in range(30)]
    items += [(50, "yes"), (51, "a b c d"), (52, "la " * 30), (53, items[2][1]), (54, None), (55, " ")]
    docs = []
    for d in range(120):
        i, t = items[d % 30]
        docs.append((d, f"{prose(rng, rng.randrange(30))} {near(rng, t, rng.choice([0, 0, 1, 2, 4]))} {prose(rng, rng.randrange(30))}" if d % 3 else prose(rng, 80)))
    docs += [(200, "YES"), (201, "a b  c d"), (202, "la " * 27), (203, items[7][1][: len(items[7][1]) * 9 // 10]), (204, stock), (204, stock), (None, items[3][1]), (205, None), (206, "")]
    real = [(i, t) for i, t in items if t and t.strip()]
    hashes = [h for h in decontamination.item_shingles(pa.array([t for _, t in real], pa.large_string()))]
    want = []
    for d, t in docs:
        own = next(decontamination.item_shingles(pa.array([t or ""], pa.large_string()))).tolist()
        for k, (i, _) in enumerate(real):
            n = len(hashes[k])
            best = max((slow_similarity(hashes, k, own[s : s + n]), -s) for s in range(max(1, len(own) - n + 1)))
            if best[0] >= 0.8:
                want.append((d, i, pytest.approx(best[0]), -best[1]))
    df = spark.createDataFrame(docs, "doc_id bigint, text string").withColumns({"d": F.lit(1), "i": F.lit("x"), "item_id": F.lit(2)})
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    order = lambda rows: sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    for parts in (20_000, 8):
        monkeypatch.setattr(decontamination, "ITEMS_AT_ONCE", parts)
        got = [(r["doc_id"], r["item_id"], r["similarity"], r["first_word"]) for r in benchmark_hits(df, bench).collect()]
        assert order(got) == order(want) and len(want) > 30
        left = [r["doc_id"] for r in decontaminate(df, bench).collect()]
        assert sorted(map(str, left)) == sorted(str(d) for d, _ in docs if d not in {w[0] for w in want})


def test_decontamination_finds_every_near_copy():
    rng = random.Random(8)
    sizes = [49, 50, 53, 56, 59, 61]
    items = [(k, " ".join(f"v{rng.randrange(30000)}" for _ in range(n))) for k, n in enumerate(sizes * 5)]
    bench = Benchmark(items, 0.8)
    texts, want = [], []
    for k in range(1500):
        i, t = items[k % len(items)]
        texts.append(" ".join(f"u{rng.randrange(30000)}" for _ in range(rng.randrange(9))) + " " + near(rng, t, 1) + " " + " ".join(f"u{rng.randrange(30000)}" for _ in range(9)))
        for _, words in W.slices(pa.array(texts[-1:])):
            hashes, _ = W.shingles(words, 5)
        n = len(bench.hashes[i])
        best = max(slow_similarity(bench.hashes, i, hashes[s : s + n].tolist()) for s in range(len(hashes) - n + 1))
        if best >= 0.8:
            want.append((k, i, pytest.approx(best)))
    got = [(at + d, i, best) for at, words in W.slices(pa.array(texts)) for d, i, best, _, _ in bench.hits(words)]
    assert len(want) > 1000 and sum(0.8 <= b < 0.85 for _, _, b in got) > 500
    assert sorted(got) == want


def test_hamming_search_is_complete():
    rng = np.random.default_rng(7)
    index = HammingIndex(rng.integers(0, 2**63, 30).astype(np.uint64))
    prints = []
    for k in range(300):
        p = int(index.prints[k % 30])
        for b in rng.choice(64, rng.integers(0, RADIUS + 6), replace=False):
            p ^= 1 << int(b)
        prints.append(p)
    prints = np.array(prints, dtype=np.uint64)
    got = set(zip(*(x.tolist() for x in index.search(prints)), strict=True))
    want = {(w, i) for w in range(300) for i in range(30) if int(np.bitwise_count(prints[w] ^ index.prints[i])) <= RADIUS}
    assert got == want and len(_NEAR) == 697


def test_words():
    import pyarrow as pa

    texts = ["a B  c\n", None, "", "ab", "Ab cD", "é\x0bÉ"]
    (_, w), = list(W.slices(pa.array(texts)))
    assert [[w.text(i).decode() for i in range(w.first[d], w.first[d + 1])] for d in range(6)] == [["a", "B", "c"], [], [], ["ab"], ["Ab", "cD"], ["é", "É"]]
    assert w.hash[0] != w.hash[1] and w.hash[w.first[3]] == w.hash[w.first[4]]


def _spread_keys(rng, nodes, keys, groups):
    """Random keys and levels of nodes, of which some keys are shared by two to `groups` nodes."""
    own = rng.integers(0, 2**63, (nodes, keys), dtype=np.uint64) * np.uint64(2)
    for size in [*rng.integers(2, 9, 60), 30, 31, 40, groups]:
        own[rng.choice(nodes, size, replace=False), rng.integers(keys)] = rng.integers(0, 2**63, dtype=np.uint64)
    return own


def test_dealt_keys_lose_no_pair():
    """Nodes that share a key and may be linked by their sizes come out as a pair or in one bucket, whatever the batches; what
    else meets doesn't; and no part gets a key's group."""
    rng = np.random.default_rng(11)
    keys, nodes = _spread_keys(rng, 400, 5, 150), rng.integers(0, 2**63, 400, dtype=np.uint64)
    sizes = rng.choice([20, 26, 33, 41, 90, 112], 400)
    level, apart = linking.levels(sizes), linking.levels_apart(80, 100)
    a, b = np.meshgrid(np.arange(1, 3000), np.arange(1, 3000))
    assert (np.abs(linking.levels(a).astype(int) - linking.levels(b))[(a * 10 >= b * 8) & (b * 10 >= a * 8)] <= apart).all()
    # two tasks that have a few lines in common
    dealt = [r for x in (np.arange(250), np.arange(240, 400)) for r in linking.deal_keys(keys[x], nodes[x], level[x], 12)]
    dealt += [*linking.deal_rows(np.array([5, 0]), np.array([7, 8]), np.array([9, 10]), np.array([False, True]))]
    rows = pa.Table.from_batches(dealt).sort_by("part")
    assert sum(map(len, rows.column(1).filter(pa.compute.greater_equal(rows.column(0), 0)).to_pylist())) <= 400 * 5 * 15
    for size in (1, 7, 1000):
        got = [r for batch in linking._met(apart)(iter(rows.to_batches(size))) for r in batch.to_pylist()]
        assert sorted((r["a"] or 0, r["b"], r["c"]) for r in got if r["kind"] == linking.ROW) == [(0, 8, 10), (5, 7, 9)]
        assert sum(r["kind"] == linking.EXTRA for r in got) > 100 - linking.SENT
        met, buckets = {(r["a"], r["b"]) for r in got if r["kind"] == linking.PAIR}, {}
        for r in got:
            if r["kind"] in (linking.MEMBER, linking.EXTRA):
                buckets.setdefault(r["a"], set()).add(r["b"])
        met |= {(x, y) for own in buckets.values() for x in own for y in own if x < y}
        want, ids, some = set(), nodes.view(np.int64).tolist(), set()
        for j in range(5):
            for i, k in zip(*np.nonzero(keys[:, j][:, None] == keys[:, j]), strict=True):
                if ids[i] < ids[k]:
                    (want if abs(int(level[i]) - int(level[k])) <= apart else some).add((ids[i], ids[k]))
        assert want <= met <= want | some and len(want) > 1000
        assert len([x for x in met - want if not any(len(b) >= linking.SENT and x[0] in b for b in buckets.values())]) < len(some - want) / 10


def test_line_dedup_large_groups(spark):
    """More near copies in one task than it sends to one part, and lines that meet them."""
    rng = random.Random(12)
    base = prose(rng, 60)
    rows = [(d, near(rng, base, rng.choice([0, 1, 2]))) for d in range(120)] + [(200 + d, near(rng, base[: 40 + 12 * d], 1) + prose(rng, 3)) for d in range(20)]
    got = line_components(spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1)).collect()
    assert {(r["doc_id"], r["line"]): r["keep"] for r in got} == brute_lines(rows)


def test_line_keys_are_in_no_table(spark):
    """Keys of lines without a partner are 14 bytes of a shuffle, and no table has them."""
    rng = random.Random(13)
    df = spark.createDataFrame([(d, "\n".join(prose(rng, 30, 10**6) for _ in range(20))) for d in range(200)], "doc_id bigint, text string")
    with Scratch(spark, "keys") as scratch:
        tables = {}
        save = scratch.save
        scratch.save = lambda t, label="t": tables.setdefault(label, []).append(t := save(t, label)) or t
        lines = line_components(df, scratch=scratch)
        assert lines.filter("keep").count() == 4000
        assert not any(kind.startswith("array") for found in tables.values() for t in found for _, kind in t.dtypes)
