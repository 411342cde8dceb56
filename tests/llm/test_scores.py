"""Models, sharding, mixing, WARC records and the pipeline on small fixtures."""

import math
import pickle
import random
import re
import time
import zlib
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lumiframe.llm import lm_score, warc
from lumiframe.llm.langid import detect_language, sample_texts
from lumiframe.llm.lm_score import AttentionModel, score_texts
from lumiframe.llm.mixing import budgets, count_tokens, mix_sources
from lumiframe.llm.sampling import fit_on
from lumiframe.llm.sharding import shard_documents
from lumiframe.llm.toxicity import _sample, score_toxicity

DIR = "/root/testdata/sf0.001"


def docs_of(spark):
    return spark.read.parquet(f"{DIR}/documents.parquet")


def check_shards(rows, shards, largest):
    sizes, slots = [0] * shards, [[] for _ in range(shards)]
    for r in rows:
        sizes[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots)
    mean = sum(sizes) / shards
    assert all(abs(s - mean) <= 0.005 * mean + largest for s in sizes)


def test_sharding(spark):
    rng = random.Random(1)
    rows = [(i, "x" * rng.randrange(3000), "c") for i in range(900)] + [(2000 + i, "copy " * 20, "c") for i in range(900)] + [(5, "same", "c")] * 50 + [(None, "n", "c"), (6000, None, "c"), (6001, "", "c"), (6002, "ü€", "c")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, shard string")
    got = shard_documents(df, shards=7).collect()
    assert len(got) == len(rows) and {r["law"] for r in got} == {"bytes"}
    check_shards(got, 7, 3016)
    by_id = {r["doc_id"]: r for r in got}
    assert by_id[6002]["size"] == 5 + 16 and by_id[6002]["text_crc32"] == zlib.crc32("ü€".encode())
    assert by_id[6000]["size"] == 16 and by_id[6000]["text_crc32"] is None
    few = shard_documents(df, shards=7, segment_rows=100).collect()
    assert {(r["doc_id"], r["text"]): r["shard"] for r in few if r["doc_id"] != 5} == {(r["doc_id"], r["text"]): r["shard"] for r in got if r["doc_id"] != 5}
    check_shards(few, 7, 3016)
    assert shard_documents(df.limit(0)).collect() == []
    assert sorted(r["shard"] for r in shard_documents(df.limit(1), shards=3).collect()) != []


def test_sharding_borders(spark):
    """Ids beyond the precision of doubles, groups that lie over several borders, clashing names; against a sorted list."""
    rng = random.Random(4)
    rows = [(2**60 + i, "same text") for i in range(200)] + [(2**62 + 3 * i, "y" * rng.randrange(400)) for i in range(150)] + [(2**63 - 1 - i, "end") for i in range(40)] + [(-(2**63) + i, "end") for i in range(40)] + [(None, "end")] * 30 + [(7, "z" * 9000)]
    df = spark.createDataFrame([(i, t, 1, "h", i, "s") for i, t in rows], "doc_id bigint, text string, __row int, __hash string, __id bigint, kept string")
    hashed = {r["text"]: r["h"] for r in df.select("text", F.xxhash64("text", F.col("text").isNull()).alias("h")).distinct().collect()}
    for shards in (1, 2, 13, 40):
        got = sorted(shard_documents(df, shards=shards).collect(), key=lambda r: (r["shard"], r["slot"]))
        assert len(got) == len(rows) and [(r["__row"], r["kept"]) for r in got] == [(1, "s")] * len(rows)
        keys = [(hashed[r["text"]], -(2**63) if r["doc_id"] is None else r["doc_id"]) for r in got]
        assert keys == sorted(keys)
        total, sums, borders = sum(r["size"] for r in got), 0, {}
        for i, r in enumerate(got):
            for s in range(got[i - 1]["shard"] if i else 0, r["shard"]):
                borders[s + 1] = sums
            sums += r["size"]
        for s, size in borders.items():
            target, upto = total * s / shards, 0
            row = next(r["size"] for r in got if (upto := upto + r["size"]) >= target)
            assert abs(size - target) <= max(0.0025 * total / shards, row / 2) + 1e-6


def test_language(spark):
    df = docs_of(spark)
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    got = detect_language(df.withColumn("score", F.lit("clash")), train=fold != 0).collect()
    assert len(got) == df.count() and all(0 <= r["score"] <= 1 for r in got)
    held = [r for r in got if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert sum(r["lang"] == r["lang_pred"] for r in held) >= 0.9 * len(held)
    odd = spark.createDataFrame([(1, None, None), (2, "", None), (3, "123 ...", None), (4, "zq" * 5, None)], "doc_id bigint, text string, lang string")
    got = {r["doc_id"]: r for r in detect_language(odd.unionByName(df.select("doc_id", "text", "lang").filter("doc_id > 10"))).filter("lang is null").collect()}
    assert [got[i]["lang_pred"] for i in (1, 2, 3)] == ["und"] * 3 and all(got[i]["rejected"] for i in (1, 2, 3)) and got[4]["lang_pred"] != "und"
    assert {r["lang_pred"] for r in detect_language(odd).collect()} == {"und"} and detect_language(df.limit(0)).collect() == []
    long = spark.createDataFrame([(None, " ".join(r["text"] or "" for r in df.filter("lang = 'de'").limit(60).collect()) * 3, "x")], "doc_id bigint, text string, lang string")
    got = detect_language(df.select("doc_id", "text", "lang").unionByName(long).unionByName(long), F.col("doc_id") > 20).filter("doc_id is null").collect()
    assert [r["lang_pred"] for r in got] == ["de", "de"]


def test_toxicity(spark):
    rng = random.Random(2)
    word = lambda: f"w{int(rng.paretovariate(0.7)) % 300}"
    rows = []
    for i in range(700):
        bad = i % 4 == 0
        parts = [" ".join(word() for _ in range(10)) + "." for _ in range(rng.randrange(1, 8))]
        if bad:
            parts.insert(rng.randrange(len(parts) + 1), f"{word()} vile{rng.choice(['a', 'b', 'nasty'])} {word()} {rng.choice(['rotten', 'foul'])}!")
        rows.append((i, " ".join(parts), int(bad)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string, label int")
    got = {r["doc_id"]: r for r in score_toxicity(df.drop("label"), df.drop("text"), F.col("doc_id") < 500, spans=True).collect()}
    held = [(got[i], y) for i, _, y in rows if i >= 500]
    assert sum(r["predicted"] == y for r, y in held) >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 for r in got.values())
    found = [r["sentences"] for r, y in held if y]
    assert sum(len(s) == 1 and "vile" in s[0] for s in found) >= 0.9 * len(found)
    odd = spark.createDataFrame([(1, None, 1), (2, "", 0)], "doc_id bigint, text string, label int")
    assert [r["score"] for r in score_toxicity(odd, df.limit(0)).collect()] == [0.5, 0.5]
    assert score_toxicity(df.limit(0), df).collect() == []
    texts = df.drop("label").unionByName(spark.createDataFrame([(None, None), (None, "a vilea rotten!"), (900, ""), (901, "word " * 60_000 + "vilea foul!"), (1, rows[0][1]), (1, "plain")], "doc_id bigint, text string"))
    got = score_toxicity(texts.withColumn("label", F.lit("clash")).withColumn("h", F.lit(1)), df.drop("text").unionByName(df.drop("text")), F.col("doc_id").isNotNull()).collect()
    assert len(got) == len(rows) + 6 and all(0 <= r["score"] <= 1 for r in got)
    assert {r["predicted"] for r in got if r["text"] in (None, "", "plain")} == {0} and {r["predicted"] for r in got if r["doc_id"] in (None, 901) and r["text"]} == {1}


def test_bounded_sample(spark):
    rows = spark.createDataFrame([(5, "de", f"de {i}") for i in range(50)] + [(5, "fr", f"fr {i}") for i in range(50)] + [(None, "fr", "fr null"), (6, None, "none"), (7, "de", None), (8, "it", "")], "doc_id bigint, lang string, text string")
    sampled = lambda n, chars, df=rows: pickle.loads(fit_on(sample_texts(df, F.col("lang"), "text", "doc_id", n, chars), dict) or pickle.dumps({}))
    got = sampled(20, 10**9)
    assert {k: len(v) for k, v in got.items()} == {"de": 20, "fr": 20} and all(t.startswith(k) for k, v in got.items() for t in v)
    few = sampled(20, 12)
    assert all(few[k] == got[k][: len(few[k])] and sum(map(len, few[k][:-1])) < 12 <= sum(map(len, few[k])) for k in few)
    assert sampled(20, 12, rows.limit(0)) == {}
    labels = spark.createDataFrame([(5, 1), (5, 0), (None, 1), (8, 0)], "doc_id bigint, label int")
    sample, share = _sample(rows, labels, "label", "doc_id", "text", 30, 10**9)
    got = sample.collect()
    assert len({r["text"] for r in got}) == 30 and {r["label"] for r in got} == {1} and share == pytest.approx(100 / 101)


def test_warc(spark):
    page = "<html><head><title>A &amp; B</title><style>p{}</style></head><body><script>x</script><p>One <b>two</b><br>three</p><!-- no --><a href='u'>go</a></body></html>"
    rows = [(1, "http://a/", page), (2, None, None), (None, "http://b/", ""), (1, "http://a/", page)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    records = warc.build_derivatives(warc.responses_of_pages(pages, "2024-01-01T00:00:00Z"))
    got = records.collect()
    assert len(got) == 8
    text = next(r for r in got if r["source_id"] == 1 and r["warc_type"] == "conversion")
    assert text["block"] == "One two\nthree\ngo" and text["payload_digest"] == warc.digest(page.encode())
    meta = next(r for r in got if r["source_id"] == 1 and r["warc_type"] == "metadata")
    assert "title: A & B\r\n" in meta["block"] and "link-count: 1\r\n" in meta["block"] and "source-content-type: text/html; charset=utf-8\r\n" in meta["block"]
    assert meta["refers_to"] == text["refers_to"] and len({r["record_id"] for r in got}) == 6
    data = b"".join(bytes(r["record"]) for r in warc.warc_bytes(records).collect())
    back = list(warc.parse(data))
    assert len(back) == 8
    for h, block in back:
        assert h["WARC-Block-Digest"] == warc.digest(block) and h["WARC-Refers-To"].startswith("<urn:uuid:") and int(h["Content-Length"]) == len(block)
    assert sorted(b for _, b in back) == sorted(r["block"].encode() for r in got)
    assert warc.build_derivatives(warc.responses_of_pages(pages.limit(0), "d")).collect() == []


class SlowPage(HTMLParser):
    """The text, title and links of a page by Python's own parser."""

    def __init__(self, page):
        super().__init__(convert_charrefs=True)
        self.parts, self.hidden, self.head, self.title, self.links, self.in_title = [], [], False, None, 0, False
        self.feed(page)
        self.close()
        self.text = re.sub(r" ?\n[ \n]*", "\n", re.sub(r"[ \t\r\f\v\xa0]+", " ", "".join(self.parts))).strip()

    def handle_starttag(self, tag, attrs):
        if self.hidden:
            return
        if tag == "head":
            self.head = True
        elif tag not in "base link meta title noscript script style template html".split():
            self.head = False
        self.links += tag == "a" and any(k == "href" for k, _ in attrs)
        if tag in ("script", "style", "template", "noscript"):
            self.hidden.append(tag)
            self.handle_data(" ")
        elif tag == "title" and self.title is None:
            self.title, self.in_title = "", True
        elif tag in warc._BLOCK:
            self.say("\n")

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if self.hidden:
            if tag == self.hidden[-1]:
                self.hidden.pop()
            return
        if tag == "title":
            self.in_title = False
        if tag == "head":
            self.head = False
        elif tag in warc._BLOCK and not self.head:
            self.say("\n")

    def say(self, data):
        if not self.head:
            self.parts.append(data)

    def handle_data(self, data):
        if self.hidden:
            if data == " " and not self.head:
                self.parts.append(data)
            return
        if self.in_title:
            self.title += data
        if self.head and not self.in_title and data.strip():
            self.head = False
        if not (self.in_title and self.head):
            self.say(data)


def test_page_matches_slow_parser(spark):
    rng = random.Random(7)
    pieces = ["<p>", "</p>", "word ", "Ab &amp; c ", "<b class='x>y'>", "</b>", "<br/>", '<a href="u?a=1&b=2">', "</a>", "<a name=z>", "<script>if (a<b) {}</script>", "<style>p{}</style>", "<!-- no <p> -->", "<!doctype html>", "3 < 4 ", "<div title='it is'>", "</div>", "\n", "é&nbsp;", "<img alt=\"a>b\" />", "<TEMPLATE><p>x</p></TEMPLATE>", "<noscript>n</noscript>"]
    heads = ["", "<html><head><title>T &lt; 1</title></head><body>", "<html><head><meta charset=utf-8><title>T</title><body>", "<head><link rel=x><title>T</title><p>", "<html><head><title>T</title>text"]
    pages = [rng.choice(heads) + "".join(rng.choice(pieces) for _ in range(rng.randrange(30))) for _ in range(400)] + [r["html"] for r in spark.read.parquet(f"{DIR}/pages.parquet").collect()]
    for page in pages:
        got, want = warc.Page(page), SlowPage(page)
        assert (got.text, got.title, got.links) == (want.text, want.title, want.links), page
    assert warc.visible_text("<html><head><title>T</title><body><p>Hello world</p></body></html>") == "Hello world"
    for odd in ("<a ", "<title>", "<script", "<!--", "<noscript>", "</a", "<a b='", '<p c="', "<", "<template>", "&#", "<title>x</title>", "<script></script>", " \n"):
        began = time.perf_counter()
        warc.Page(odd * (1_000_000 // len(odd)))
        assert time.perf_counter() - began < 5, odd


def test_source_headers_are_kept():
    given = [{"name": "WARC-Payload-Digest", "value": "sha1:GIVEN"}, {"name": "WARC-IP-Address", "value": "192.0.2.1"}, {"name": "WARC-Type", "value": "response"}, {"name": "x", "value": None}]
    for r in warc.derive(1, "<urn:uuid:1>", "http://a/", "2024-01-01T00:00:00Z", "HTTP/1.1 200 OK\r\nServer: s\r\n\r\n", "<p>x", given):
        headers = {h["name"]: h["value"] for h in r[5]}
        assert headers["WARC-Refers-To"] == "<urn:uuid:1>" and headers["X-Source-Payload-Digest"] == r[10] == "sha1:GIVEN"
        assert headers["X-Source-WARC-IP-Address"] == "192.0.2.1" and headers["X-Source-HTTP-Server"] == "s" and headers["WARC-Refers-To-Target-URI"] == "http://a/" and "X-Source-x" not in headers


def test_budgets():
    tokens = {("a", "x", "s"): 10, ("a", "y", "s"): 1000, ("b", "x", "s"): 1000}
    got = budgets(tokens, 400, [{}, {}, {}], 1)
    assert got == {("a", "x", "s"): 10, ("a", "y", "s"): 190, ("b", "x", "s"): 200}  # the sibling takes what x lacks
    short = budgets({("a", "x", "s"): 10, ("a", "y", "s"): 20, ("b", "x", "s"): 1000}, 400, [{"a": 3.0}, {}, {}], 1)
    assert short == {("a", "x", "s"): 10, ("a", "y", "s"): 20, ("b", "x", "s"): 370}  # then the ancestors' sibling
    assert budgets(tokens, 10**9, [{}, {}, {}], 3) == {k: 3 * v for k, v in tokens.items()}
    assert budgets({}, 5, [{}, {}, {}], 1) == {}


def test_mixing(spark):
    df = docs_of(spark).select("doc_id", "text", "lang", "source").withColumn("tokens", F.lit("clash"))
    clash = {c: F.lit(c) for c in ("_id", "_rest", "_domain", "kept", "_k", "_whole")}
    df = df.unionByName(spark.createDataFrame([(9001, None, None, None, ""), (9002, "", "en", "src0", ""), (None, "a b", "en", "src0", "")], df.schema))
    domain = F.when(F.col("source").rlike("[02468]$"), "even").otherwise("odd")
    weights = [{"even": 3.0}, {"en": 2.0}, {"src0": 5.0}]
    out = mix_sources(df.withColumns(clash), domain, weights, fraction=0.7, max_epochs=2, seed=1)
    assert out.select(*clash).distinct().collect() == [tuple(clash)]
    got = out.collect()
    count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    leaf = lambda r: ("even" if r["source"] and r["source"][-1] in "02468" else "odd", r["lang"], r["source"])
    have, taken = {}, {}
    for r in df.collect():
        have.setdefault(leaf(r), {})[r["doc_id"]] = count(r["text"])
    for r in got:
        assert r["tokens"] == count(r["text"])
        taken.setdefault(leaf(r), {}).setdefault(r["epoch"], []).append(r["doc_id"])
    plan = budgets({k: sum(v.values()) for k, v in have.items()}, 0.7 * sum(sum(v.values()) for v in have.values()), weights, 2)
    for k, ids in have.items():
        epochs, total = taken.get(k, {}), sum(ids.values())
        whole, rest = divmod(plan[k], total) if total else (0, 0)
        for e in range(whole):
            assert sorted(epochs[e], key=str) == sorted(ids, key=str)
        part = epochs.get(whole, [])
        used = sum(ids[i] for i in part)
        assert used <= rest
        order = {r["doc_id"]: r["k"] for r in spark.createDataFrame([(i,) for i in ids], "doc_id bigint").select("doc_id", F.xxhash64(F.lit(1), F.lit(whole).cast("bigint"), "doc_id").alias("k")).collect()}
        ranked, acc, want = sorted(ids, key=lambda i: order[i]), 0, []
        for i in ranked:
            acc += ids[i]
            if acc > rest:
                break
            want.append(i)
        if total and rest:
            assert sorted(part, key=str) == sorted(want, key=str)
    assert mix_sources(df.limit(0), domain, weights).collect() == []
    texts = ["", " ", "a", " a  b ", "a\tb\n\x0b", None]
    assert [r["n"] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(count_tokens(F.col("t")).alias("n")).collect()] == [0, 0, 1, 2, 2, 0]


def test_lm_score(spark):
    df = docs_of(spark).select("doc_id", "text").filter("doc_id < 60")
    df = df.unionByName(spark.createDataFrame([(900, None), (901, ""), (902, "zzqx"), (None, "The the")], "doc_id bigint, text string")).withColumns({"score": F.lit("clash"), **{c: F.lit(c) for c in "k s m h c row rare kept train".split()}})
    train = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 != 0
    rows = df.select("doc_id", "text").collect()
    words = {i: re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in t or "")) for i, t in rows}
    learned = [i for i in words if i is not None and zlib.crc32(str(i).encode()) % 10 != 0]
    counts = {}
    for i in learned:
        for w in words[i]:
            counts[w] = counts.get(w, 0) + 1
    total, kinds = sum(counts.values()) + len(learned), len(counts) + 1
    price = lambda c: math.log10((c + 0.1) / (total + 0.1 * (kinds + 1)))
    runs = [{r["doc_id"]: r for r in score_texts(df, train, common=n).collect()} for n in (1 << 19, 40)]
    for got in runs:
        assert set(got) == set(words)
        for i, ws in words.items():
            r = got[i]
            assert (r["n_tokens"], r["train_tokens"]) == (len(ws) + 1, total)
            assert r["n_known"] == 1 + sum(w in counts for w in ws)
            assert r["base_score"] == pytest.approx(price(len(learned)) + sum(price(counts.get(w, 0)) for w in ws))
            assert r["score"] < 0 and r["n_subwords"] >= r["n_tokens"]
    assert {i: r["score"] for i, r in runs[0].items()} == pytest.approx({i: r["score"] for i, r in runs[1].items()})
    assert sum(r["score"] for r in runs[0].values()) > sum(r["n_subwords"] for r in runs[0].values()) * math.log10(1 / 32000)
    assert score_texts(df.limit(0), train).collect() == []


def test_lm_gradients():
    rng = np.random.default_rng(1)
    model = AttentionModel(np.array([5.0, 0, 3, 2, 2, 1, 1, 0, 4]))
    model.p = {k: v.astype(np.float64) + 0.2 * rng.standard_normal(v.shape) for k, v in model.p.items()}
    ids = rng.integers(0, model.kinds, (3, lm_score.WINDOW + 1))
    _, g = model.gradients(ids)
    for k, v in model.p.items():
        for at in rng.choice(v.size, min(v.size, 12), replace=False):
            old, cost = v.flat[at], []
            for step in (1e-5, -1e-5):
                v.flat[at] = old + step
                cost.append(model.gradients(ids)[0])
            v.flat[at] = old
            assert (cost[0] - cost[1]) / 2e-5 == pytest.approx(np.asarray(g[k]).flat[at], abs=1e-6), k


def test_lm_run_sums():
    rng = np.random.default_rng(5)
    for size in ([1], [lm_score.SHORT], [lm_score.SHORT + 1], [1, 700, 2, 8, 9, 1, 7, 40, 1], rng.integers(1, 20, 300)):
        starts = np.cumsum([0, *size[:-1]])
        rows = rng.standard_normal((sum(size), 6)).astype(np.float32)
        found = lm_score._run_sums(rows, starts)
        naive = [rows[a : a + n].astype(np.float64).sum(axis=0) for a, n in zip(starts, size, strict=True)]
        assert found.dtype == rows.dtype and np.allclose(found, naive, atol=1e-4)


def test_lm_softmaxes_at_any_level():
    """Logits that all are far below or above 0 have the same probabilities and gradients; in float32 their exponentials vanish
    or overflow."""
    rng = np.random.default_rng(4)
    model = AttentionModel(np.array([5.0, 0, 3, 2, 2, 1, 1, 0, 4]))
    ids = rng.integers(0, model.kinds, (40, lm_score.WINDOW + 1))
    score = lambda: model.score(ids[:, :-1], 0, ids[:, 1:])
    logs, (loss, g) = score(), model.gradients(ids)
    for name in ("bg", "bo"):
        for level in (-200, 200):
            model.p[name] += np.float32(level)
            assert score() == pytest.approx(logs, abs=1e-3), (name, level)
            cost, found = model.gradients(ids)
            assert cost == pytest.approx(loss, abs=1e-3), (name, level)
            assert all(found[k] == pytest.approx(g[k], abs=1e-4) for k in g), (name, level)
            model.p[name] -= np.float32(level)


def test_lm_batches_hold_every_window():
    """Whatever their size, batches hold the same windows, each once."""
    rng = np.random.default_rng(6)
    texts = pa.array([" ".join(rng.choice(["one", "two", "three", "four"], 700)) for _ in range(900)])
    sub = lm_score.Subwords(open(lm_score.VOCABULARY, "rb").read())
    model = AttentionModel(np.ones(sub.size + 1))
    found = []
    for size in (lm_score.BATCH, lm_score.BATCH * lm_score.MOST):
        batches = list(lm_score._windows(iter([texts[:400], texts[400:]]), model, sub, 1.0, np.random.default_rng(0), size))
        assert {len(b) for b in batches[:-1]} == {size} and 0 < len(batches[-1]) <= size
        found.append(sorted(map(tuple, np.concatenate(batches).tolist())))
    assert found[0] == found[1] and len(found[0]) > 32 * lm_score.BATCH * lm_score.MOST


def test_lm_training_takes_every_text(spark):
    """However large the corpus is said to be, each subword is a target of one window."""
    rng = np.random.default_rng(5)
    texts = [" ".join(rng.choice(["one", "two", "three", "four"], 60)) for _ in range(300)]
    data = open(lm_score.VOCABULARY, "rb").read()
    flat = lm_score._stream(next(lm_score.W.slices(pa.array(texts)))[1], lm_score.Subwords(data))[0]
    for said in (1e12, 1_900_000):  # once, and 1.6 times
        model = AttentionModel(np.bincount(flat, minlength=flat.max() + 1).astype(float))
        h = F.pmod(F.xxhash64("i"), F.lit(lm_score.PLACES))
        learned = spark.createDataFrame(list(enumerate(texts)), "i bigint, text string").repartition(2, "i").select("text", h.alias("h"))
        seen = lm_score._train(learned, model, spark.sparkContext.broadcast(data), said) * lm_score.WINDOW
        most = max(1.0, lm_score.LEAST / said)
        assert 0.95 * most * len(flat) <= seen <= 1.05 * most * len(flat) + lm_score.ROUNDS * 2 * lm_score.WINDOW
        assert seen >= len(flat)


def test_lm_forward_matches_naive_one():
    """Every token of every text is scored once, with the window's context and nothing after it."""
    rng, counts = np.random.default_rng(2), np.array([50.0, 0, 30, 20, 0, 10, 9, 8, 7, 40])
    model = AttentionModel(counts)
    p, kinds = model.p, model.kinds
    lengths = [1, 2, 23, 24, 25, 26, 44, 45, 63, 64, 65, 130]
    texts = [np.append(rng.integers(0, 9, n - 1), 9) for n in lengths]
    first = np.concatenate([[0], np.cumsum(lengths)])
    got = model.logs(np.concatenate(texts).astype(np.int32), first)
    assert not np.isnan(got).any()

    def naive(context, target):
        x = p["E"][context]
        e = (x[-1] @ p["q"]) @ (x @ p["k"]).T / math.sqrt(lm_score.WIDTH) + p["r"][np.arange(len(x))[::-1]]
        w = np.exp(e) / np.exp(e).sum()
        y = x[-1] + w @ (x @ p["v"])
        h = np.concatenate([y, np.maximum(y @ p["m"], 0)])
        soft = lambda z: np.exp(z) / np.exp(z).sum()
        groups = soft(h @ p["g"] + p["bg"])
        within = [slice(*model.starts[i : i + 2]) for i in range(model.groups)]
        every = np.concatenate([groups[i] * soft(h @ p["o"][w].T + p["bo"][w]) for i, w in enumerate(within)])
        by_id = np.array([every[model.index[i]] / (model.unseen if model.index[i] == kinds - 1 else 1) for i in range(10)]) * (1 - lm_score.EVEN) + lm_score.EVEN / 10
        assert by_id.sum() == pytest.approx(1, abs=1e-5)
        return math.log10(by_id[target])

    for d, text in enumerate(texts):
        inputs, n = model.index[np.append(9, text[:-1])], len(text)
        for t in range(n):
            turn = 0 if t < 24 else 1 + (t - 24) // 20
            begin = min(turn * 20, max(n - 24, 0))
            assert got[first[d] + t] == pytest.approx(naive(inputs[begin : t + 1], text[t]), abs=1e-4)


def test_lm_beats_the_base(spark):
    """On held-out texts, by the attention model alone."""
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    train = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 != 0
    got = [r for r in score_texts(df, train).collect() if zlib.crc32(str(r["doc_id"]).encode()) % 10 == 0]
    assert sum(r["score"] for r in got) > sum(r["base_score"] for r in got)
    print(sum(r["score"] for r in got), sum(r["base_score"] for r in got), sum(r["score"] > r["base_score"] for r in got), len(got), sum(r["n_tokens"] for r in got))


def test_pipeline(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    from lumiframe.llm.ngram_join import ngram_jaccard_components

    docs = docs_of(spark)
    odd = spark.createDataFrame([(7001, None, "en", "src0", 0), (7002, "...", "en", "src0", 3), (7003, docs.filter("doc_id = 1").first()["text"], "en", "src1", 5)], docs.schema)
    docs, seen = docs.unionByName(odd), []
    for k, (name, stage) in enumerate(pipeline.STAGES):
        out = stage(spark, docs, DIR)
        rows = out.collect()
        seen.append({r["doc_id"] for r in rows})
        assert len(rows) == len(seen[-1])
        if k < len(pipeline.STAGES) - 1:
            assert out.columns == docs.columns
            if name == "language_id":
                assert not seen[-1] & {7001, 7002} and len(rows) >= 0.97 * docs.count()
            if name == "ngram_jaccard_join":
                groups = {r["component_id"] for r in ngram_jaccard_components(docs).collect()}
                assert seen[-1] == groups and 7003 not in groups
            docs = spark.createDataFrame(rows, docs.schema)
    assert seen[-1] == seen[-2] and {r["shard"] for r in rows} <= set(range(40))
