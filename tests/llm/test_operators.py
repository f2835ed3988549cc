"""Corpus operators against brute force, round trips and planted cases; every operator on odd rows."""

import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from meteolith.llm import ann, common, decontaminate, graph, hilbert, language, minhash, packing, pii, quality, toxicity
from meteolith.llm import html as pages

import public_tokenizers

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
ODD = [(1, None), (2, ""), (3, "   \n\t "), (4, "1 2 3"), (5, "word"), (5, "word"), (None, "no id here at all"), (6, "The same old text about nothing in particular. " * 3), (7, "The same old text about nothing in particular. " * 3), (8, "x" * 50_000), (9, "ein sehr langer Satz " * 4000), (10, "🙂 éàü ñ 漢字 mixed text end")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, "en", "s", 0, "extra") for i, t in ODD], "doc_id long, text string, lang string, source string, n_chars long, items string")


@pytest.fixture(scope="module")
def empty(odd):
    return odd.limit(0)


def docs(spark, small):
    return common.read(spark, small, "documents")


# 1


def brute_hits(text, items):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    w, hit, ids = words(text), set(), set()
    for i, t in items:
        v = words(t)
        for win in [v] if 0 < len(v) < 10 else [v[k : k + 10] for k in range(len(v) - 9)]:
            for k in range(len(w) - len(win) + 1):
                if w[k : k + len(win)] == win:
                    hit |= set(range(k, k + len(win)))
                    ids.add(str(i))
    return len(w), len(hit), sorted(ids)


@pytest.mark.parametrize("block_bytes", [decontaminate.BLOCK_BYTES, 1])
def test_decontamination(spark, odd, empty, block_bytes):
    items = [(1, "Alpha beta, gamma! delta ünder 42"), (2, "one two three four five six seven eight nine ten eleven"), (3, ""), (4, None), (5, "alpha beta")]
    texts = [(20, "x ALPHA-beta gamma delta ünder 42 y"), (21, "zero one two three four five six seven eight nine ten one two"), (22, "alphabeta one two")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    df = odd.select("doc_id", "text").union(spark.createDataFrame(texts, "doc_id long, text string"))
    for r in decontaminate.decontaminate(df, bench, block_bytes=block_bytes).collect():
        n, hit, ids = brute_hits(r["text"], items)
        assert (r["n_words"], sum(b - a for a, b in r["hit_words"]), r["items"]) == (n, hit, ids)
        if r["doc_id"] == 20:
            assert [r["text"][a:b] for a, b in r["spans"]] == ["ALPHA-beta gamma delta ünder 42"]
    assert decontaminate.decontaminate(empty, bench).count() == 0
    assert all(r["items"] == [] for r in decontaminate.decontaminate(odd, bench.limit(0)).collect())


# 2


def test_packing(spark, small, odd, empty):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(TOKENIZER)
    df = docs(spark, small).select("doc_id", "text").union(odd.select("doc_id", "text"))
    rows = packing.pack(df, TOKENIZER, block=64).collect()
    ids = lambda t: np.array([*tok.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
    want = sorted(str((r["doc_id"], k, s, min(2048, len(x) - s), zlib.crc32(x[s : s + 2048].tobytes()))) for r in df.collect() for x in [ids(r["text"])] for k, s in enumerate(range(0, len(x), 2048)))
    assert sorted(str((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"])) for r in rows) == want
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for placed in by.values():
        at = 0
        for o, n in sorted(placed):
            assert o == at
            at += n
        assert at <= 2048
    assert len(by) <= -(-sum(r["length"] for r in rows) // 2048) + 3
    assert packing.pack(empty, TOKENIZER).count() == 0


def test_packing_does_not_depend_on_splits(spark, small):
    """Pieces and places fit together however the tables in between are cut when they are read."""
    df = common.read(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text").repartition(7)
    sums = []
    for most, least in (("128m", "1"), ("20k", "40"), ("3k", "200")):
        spark.conf.set("spark.sql.files.maxPartitionBytes", most)
        spark.conf.set("spark.sql.files.minPartitionNum", least)
        spark.conf.set("spark.sql.files.openCostInBytes", "1k")
        packed = packing.pack(df, TOKENIZER, block=64)
        spark.conf.set("spark.sql.files.maxPartitionBytes", "9k")  # and read otherwise than planned
        rows = packed.collect()
        by = {}
        for r in rows:
            by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        for placed in by.values():
            at = 0
            for o, n in sorted(placed):
                assert o == at
                at += n
            assert at <= 2048
        sums.append(sorted((r["doc_id"], r["piece"], r["length"], r["ids_crc32"]) for r in rows))
    for name in ("maxPartitionBytes", "minPartitionNum", "openCostInBytes"):
        spark.conf.unset(f"spark.sql.files.{name}")
    assert sums[0] == sums[1] == sums[2]


def test_encoder_equals_tokenizer():
    e = packing.Encoder(TOKENIZER)
    texts = ["It's 12 o'clock—don't", "<|endoftext|> a<|endoftext|>b", "ÀÉ ÑÇ ß Ǆ İ", "ΑΣ ὈΔΥΣΣΕΎΣ", "á b c\x0bd\r\ne", "!!!...??? $$$###", "漢字 かな 한글 🙂🙂", "x²³ ½ µ", "'s't 'LL"]
    for t, got in zip(texts, e.encode(texts), strict=True):
        assert np.frombuffer(got, "<u4").tolist() == [*e.tok.encode(t, add_special_tokens=False).ids, 0], t


# 3


def test_quality(spark, small, odd, empty):
    d, labels = docs(spark, "/root/testdata/sf0.01"), common.read(spark, "/root/testdata/sf0.01", "labels")
    trusted = labels.where("quality = 1").select("doc_id")
    a = {r["id"]: r for r in quality.classify(d, trusted).collect()}
    truth = {r["doc_id"]: r["quality"] for r in labels.collect()}
    held = lambda i: zlib.crc32(str(i).encode()) % quality.HELD == 0
    kept = lambda q: np.mean([r["kept"] for i, r in a.items() if truth.get(i) == q and held(i)])
    assert kept(1) > 0.95 and kept(0) < 0.5
    got = {r["id"]: r for r in quality.classify(odd, trusted.limit(0)).collect()}
    assert not got[1]["kept"] and not got[3]["kept"] and got[5]["kept"] and got[5]["threshold"] is None
    assert quality.classify(empty, trusted).count() == 0


def test_shards_change_nothing(spark, small, monkeypatch):
    d, trusted = docs(spark, small), common.read(spark, small, "labels").where("quality = 1").select("doc_id")
    a = {r["id"]: (r["perplexity"], r["kept"]) for r in quality.classify(d, trusted).collect()}
    monkeypatch.setattr(quality, "SHARD", 3000)
    monkeypatch.setattr(quality, "STRETCH", 5000)
    b = {r["id"]: (r["perplexity"], r["kept"]) for r in quality.classify(d, trusted).collect()}
    assert all(b[i][0] == pytest.approx(p) and b[i][1] == k for i, (p, k) in a.items())


def kneser_ney(texts):
    """p(last character | those before) of an n-gram as a tuple of codes, by the textbook on dictionaries."""
    counts = {}
    for t in texts:
        c = quality.codes(t).tolist()
        for i in range(quality.ORDER, len(c) + 1):
            counts[tuple(c[i - quality.ORDER : i])] = counts.get(tuple(c[i - quality.ORDER : i]), 0) + 1
    levels = {quality.ORDER: counts}
    for n in range(quality.ORDER - 1, 0, -1):
        levels[n] = {}
        for g in levels[n + 1]:
            levels[n][g[1:]] = levels[n].get(g[1:], 0) + 1
    discounts = {}
    for n, c in levels.items():
        n1, n2, n3, n4 = (max(1, sum(v == i for v in c.values())) for i in range(1, 5))
        y = n1 / (n1 + 2 * n2)
        d = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3]
        discounts[n] = [min(max(d[0], 0.1), 0.99), min(max(d[1], 0.1), 1.99), min(max(d[2], 0.1), 2.9)]

    def p(g):
        if not g:
            return 1 / (1 << quality.CHAR_BITS)
        c, d = levels[len(g)], discounts[len(g)]
        after = {h: v for h, v in c.items() if h[:-1] == g[:-1]}
        total = sum(after.values())
        if not total:
            return p(g[1:])
        cut = lambda v: d[min(v, 3) - 1]
        return (max(c.get(g, 0) - cut(c[g]), 0) if g in c else 0) / total + sum(map(cut, after.values())) / total * p(g[1:])

    return p


def test_kneser_ney_equals_the_textbook(spark):
    texts = ["abracadabra abba cab", "a bad cab. The cab was bad; a drab abacus", "éa cab ÉA bad"]
    p, w = quality.model(quality.count(spark.createDataFrame([(t,) for t in texts], "text string"), "text"))
    shared = quality.share(quality.keyed(p, w))
    loaders = [quality._loader(s) for s in shared]
    probe = np.unique(np.concatenate([quality.grams(quality.codes(t)) for t in [*texts, "a new cabal drabs", "zzz abr"]]))
    got, want = np.exp(quality.log_probabilities(probe, loaders)), kneser_ney(texts)
    mask = (1 << quality.CHAR_BITS) - 1
    for k, x in zip(probe.tolist(), got.tolist(), strict=True):
        assert x == pytest.approx(want(tuple((k >> quality.CHAR_BITS * i) & mask for i in range(quality.ORDER - 1, -1, -1))), rel=1e-9)
    every = (int(quality.grams(quality.codes("dabra"))[-1]) >> quality.CHAR_BITS << quality.CHAR_BITS) | np.arange(1 << quality.CHAR_BITS)
    assert np.exp(quality.log_probabilities(every, loaders)).sum() == pytest.approx(1.0, abs=1e-6)


# 4


def test_language(spark, small, odd, empty):
    d = docs(spark, "/root/testdata/sf0.01")
    part = common.doc_bucket("doc_id", 3)
    rows = language.identify(d, d.where(part != 1)).where(part == 1).collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in rows]) > 0.97 and all(0 <= r["score"] <= 1 for r in rows)
    got = {r["doc_id"]: r for r in language.identify(odd, d).collect()}
    assert [got[i]["lang_pred"] for i in (1, 2, 3, 4)] == ["und"] * 4 and got[9]["lang_pred"] == "de"
    signs = spark.createDataFrame([(1, "½ ²"), (2, "①② ⅷ 12"), (3, "x½"), (4, None), (5, "Das ist ein Tag and we are here")], "doc_id long, text string")
    assert [r["lang_pred"] == "und" for r in language.identify(signs, d).orderBy("doc_id").collect()] == [True, True, False, True, False]
    found = {r["doc_id"]: r["words"] for r in language.label_words(signs, d).collect()}
    assert found[1] == [] and found[4] == [] and [x["word"] for x in found[5]] == "das ist ein tag and we are here".split()
    assert found[5][0]["lang"] == "de" and found[5][-1]["lang"] == "en"
    assert len(language.sample(d.where("lang is not null"), "text", "lang", "doc_id", 7)) == 7 * d.where("lang is not null").select("lang").distinct().count()
    assert language.identify(odd, d.limit(0)).where("lang_pred <> 'und'").count() == 0 and language.identify(empty, d).count() == 0


def test_every_language_and_whole_texts_are_learned(spark):
    rng = np.random.default_rng(6)
    names = [f"l{k:02}" for k in range(70)]
    words = {n: ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 6)) for _ in range(30)] for n in names}
    heading = "foreign heading " * 300
    rows = [(100 * k + i, (heading if n == "l00" else "") + " ".join(rng.choice(words[n], 300)), n) for k, n in enumerate(names) for i in range(6 - (k > 64))]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = language.sample(df, "text", "lang", "doc_id", 400)
    assert {lang for _, lang in got} == set(names) and all(len(t) > len(heading) for t, lang in got if lang == "l00")


def test_forward_backward_equals_enumeration():
    import itertools

    rng = np.random.default_rng(0)
    e, moves, start = rng.normal(size=(7, 3)), rng.normal(size=(3, 3)), rng.normal(size=3)
    got, _, _ = language.forward_backward(e, np.array([4, 3]), moves, start)
    for a, b in ((0, 4), (4, 7)):
        want = np.zeros((b - a, 3))
        for path in itertools.product(range(3), repeat=b - a):
            s = start[path[0]] + sum(e[a + i, k] for i, k in enumerate(path)) + sum(moves[x, y] for x, y in zip(path, path[1:], strict=False))
            for i, k in enumerate(path):
                want[i, k] += np.exp(s)
        assert np.allclose(got[a:b], want / want.sum(axis=1, keepdims=True))


def test_long_chains_equal_whole_ones():
    rng = np.random.default_rng(1)
    f = language.Field(["a", "b"], {})
    f.weights = rng.normal(size=f.weights.shape)
    words = ["".join(rng.choice(list("abcdef"), 5)) for _ in range(5000)]
    sums, n = language.Tagger(f).marginals([words])
    whole, _, _ = language.forward_backward(f.emissions(words), np.array([5000]), f.moves, f.start)
    assert n[0] == 5000 and np.allclose(sums[0], whole.sum(axis=0), atol=1e-6)


# 5


def luhn(d):
    return sum(int(c) if not i % 2 else (2 * int(c) - 9 if int(c) > 4 else 2 * int(c)) for i, c in enumerate(reversed(d))) % 10 == 0


def brute_spans(t):
    plain = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    out = []
    for k in pii.KINDS:
        for m in re.finditer(plain[k], t or ""):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": k == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 16 <= len(d) <= 19 and luhn(d), "phone": 8 <= len(d) <= 15}[k]
            if ok:
                out.append(f"{k}:{m.start()}:{m.end()}")
    return ",".join(out)


def test_personal_data(spark, small, odd, empty):
    more = ["a@b.com_x@y.com é😀 a@b", "1" * 60_000, "1 2 3 " * 9000, "a.b@c-d.e.f. 1.2.3.4.5.6.7.8 256.1.1.1 001.002.003.004", "+1 (017) 555-7713 +123 +49 30 1234567 +" + "1" * 40, "4111 1111 1111 1111 4111-1111-1111-1111 41111111111111112", "a@b@c.de f@g..h i@-.-", "+1" + " " * 40_000, "a@" * 3000 + "b.c"]
    df = docs(spark, small).select("doc_id", "text").union(odd.select("doc_id", "text")).union(spark.createDataFrame([(100 + i, t) for i, t in enumerate(more)], "doc_id long, text string"))
    for r in pii.personal_data(df).select("doc_id", "text", pii.listed("base").alias("b"), pii.listed("spans").alias("s")).collect():
        assert r["b"] == brute_spans(r["text"]), r["doc_id"]
        assert set(filter(None, r["b"].split(","))) <= set(r["s"].split(","))
    assert pii.personal_data(empty).count() == 0


def test_thresholds_come_from_examples_that_grew_no_tree(spark):
    for (model, least), kind in zip(pii.models(spark), pii.KINDS, strict=True):
        assert 20 < model.held.sum() < len(model.held) / 2 and 0.5 <= least <= 1, kind


def test_many_matches_in_one_text(spark):
    text = "1.2.3.4 a@b.co é call (555) 123-4567 " * 2000
    found = pii.personal_data(spark.createDataFrame([(1, text)], "doc_id long, text string"))
    r = found.select(pii.listed("base").alias("b"), F.size("spans").alias("n"), pii.redact(found).alias("t")).first()
    assert r["b"] == brute_spans(text) and r["n"] == 6000 and r["t"] == "[IP] [EMAIL] é call [PHONE] " * 2000


def test_added_spans_and_redaction(spark):
    df = spark.createDataFrame([(1, "😀 call (555) 123-4567 or mail bob at foo dot com; a@b.co"), (2, "order 555-123-4567 in version 1.2.3"), (3, None)], "doc_id long, text string")
    found = pii.personal_data(df)
    got = [r[0] for r in found.select(pii.redact(found).alias("t")).orderBy("doc_id").collect()]
    assert got == ["😀 call [PHONE] or mail [EMAIL]; [EMAIL]", "order 555-123-4567 in version 1.2.3", None]


# 6


def test_page_text(spark, empty):
    cases = {
        "<html><body><nav><a>Menu</a></nav><article><h1>Title</h1><p>One &amp; two<p>three<br>four</article><footer>x</footer></body></html>": "Title One & two three four",
        "<body><div class='sidebar'>Side</div><div class=post-12><p>Main text of the page.</p><form>f<input></form><div id=comments>c</div><script>var a='<p>no</p>'</script></div></body>": "Main text of the page.",
        "just text &lt;kept&gt;": "just text <kept>",
        "<article><p>cut <b>off &am": "cut off &am",
        "": "",
    }
    df = spark.createDataFrame([(i, f"https://h{i}.example/x", h) for i, h in enumerate(cases)] + [(99, None, None)], "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in pages.extract(df).collect()}
    assert [got[i] for i in range(len(cases))] == list(cases.values()) and got[99] == ""
    assert pages.extract(df.limit(0)).count() == 0


def test_hosts_vote(spark):
    good = "<body><div class=story><p>{}</p></div><div class=box><p>{}</p></div></body>"
    rows = [(i, "http://a.example/", good.format("long story " * 20, "box")) for i in range(3)] + [(9, "http://a.example/", good.format("short", "a very long box " * 9))]
    got = {r["page_id"]: r["text"] for r in pages.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[9] == "short"


def test_deep_and_wide_pages_take_linear_time():
    import time

    cases = ["<div>" * 100_000 + "text" + "</div>" * 100_000, "<table>" + "<tr>" + "<td>cell</td>" * 100_000 + "</table>", "<span>" * 50_000 + "<li>x</p>" * 50_000, "<p>" + "<b>" * 50_000 + "<p>x" * 20_000]
    began = time.time()
    for source in cases:
        page = pages.Page(source)
        path = page.path(page.best()[0])
        assert page.text(path) and pages.Page(source).text(">table>td") == page.text(">table>td")
    assert time.time() - began < 20


def test_repeated_pages_and_clashing_columns(spark):
    rows = [(1, "http://a.example/", "<article><p>One text</p></article>")] * 3
    got = pages.extract(spark.createDataFrame([(*r, "old", "old", "old") for r in rows], "page_id long, url string, html string, text string, path string, host string")).collect()
    assert [r["text"] for r in got] == ["One text"] * 3


# 7


def test_neighbours(spark, small):
    v = common.read(spark, small, "embeddings").select("vec_id", "embedding")
    bad = spark.createDataFrame([(900_001, None), (900_002, [0.0] * 64), (900_003, [float("nan")] * 64), (900_004, [1.0, None] * 32), (900_005, [])], "vec_id long, embedding array<float>")
    v = v.union(bad).union(v.where("vec_id = 1").select(F.lit(900_006).cast("long"), "embedding"))
    rows = [(r[0], r[1]) for r in v.collect() if r[1] and len(r[1]) == 64 and None not in r[1] and np.isfinite(r[1]).all() and any(r[1])]
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    got = {}
    for r in ann.search(v, v.where("vec_id % 50 = 0 or vec_id > 900000")).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(got) == set(ids[(ids % 50 == 0) | (ids > 900_000)].tolist())
    hits = total = 0
    for q, found in got.items():
        s = x @ x[ids == q][0]
        s[ids == q] = -9
        best = np.lexsort((ids, -np.round(s, 12)))[:5]
        hits += len(set(ids[best].tolist()) & {f[1] for f in found})
        total += 5
        assert [f[0] for f in sorted(found)] == [1, 2, 3, 4, 5]
        assert all(abs(f[2] - s[ids == f[1]][0]) < 1e-12 for f in found)
    assert hits / total >= 0.9
    assert ann.search(v.limit(0), v.limit(0)).count() == 0


def clustered(spark, n, centres, hot=0, dim=32):
    """Vectors around centres; `hot` of them around one point."""
    import pandas as pd

    rng = np.random.default_rng(2)
    x = rng.normal(size=(centres, dim))[rng.integers(0, centres, n)] + 0.5 * rng.normal(size=(n, dim))
    if hot:
        x[:hot] = x[0] + 0.05 * rng.normal(size=(hot, dim))
    x = x[rng.permutation(n)]
    return spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(n), "embedding": x.tolist()}), "vec_id long, embedding array<double>"), x / np.linalg.norm(x, axis=1, keepdims=True)


def recall(found, x):
    got = {}
    for r in found:
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    hits = 0
    for q, ids in got.items():
        s = x @ x[q]
        s[q] = -9
        hits += len(set(np.lexsort((np.arange(len(x)), -s))[:5].tolist()) & ids)
    return hits / (5 * len(got)), len(got)


def test_lists_are_probed_and_pruned(spark):
    v, x = clustered(spark, 50_000, 150)
    share, n = recall(ann.search(v, v.where("vec_id % 250 = 0")).collect(), x)
    assert share >= 0.9 and n == 200
    turned = x @ ann.rotation(32)
    lists = ann.Lists(turned[: ann.SAMPLE], len(x))
    assert ann.probes_for(turned[: ann.SAMPLE], lists, 5) < lists.count / 4 and lists.count > 90
    near = np.sort(x[:1] @ x.T)[0, -6]
    _, read = ann.scan(turned[:2048], np.arange(2048), x[:2048], turned[:1], np.arange(1), x[:1], np.array([2 - 2 * near]), 5)
    assert read < 0.7 * 2048 * 32


@pytest.mark.parametrize("sample, block", [(400, 2048), (5000, 64)])
def test_two_levels_of_lists_and_a_hot_list(spark, monkeypatch, sample, block):
    """400 sampled vectors bear 50 first centroids only; a third of all vectors lies in one list, cut into blocks."""
    for name, value in (("SAMPLE", sample), ("BLOCK", block), ("QUERIES", 16), ("PER_LIST", 64), ("PROBES", 4)):
        monkeypatch.setattr(ann, name, value)
    v, x = clustered(spark, 9000, 60, hot=3000)
    found = ann.search(v, v.where("vec_id % 90 = 0")).collect()
    share, n = recall(found, x)
    assert share >= 0.9 and n == 100 and {r["rank"] for r in found} == {1, 2, 3, 4, 5}
    assert len(ann.Lists(x[:sample], len(x)).second) == (3 if sample == 400 else 1)


# 8


def brute_components(texts, k, percent):
    sets = {}
    for i, t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} or ({tuple(w)} if w else set())
    comp = {i: i for i in sets}
    ids = sorted(sets)
    for _ in range(len(ids)):
        moved = False
        for n, a in enumerate(ids):
            for b in ids[n + 1 :]:
                if sets[a] and sets[b] and comp[a] != comp[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                    lo = min(comp[a], comp[b])
                    comp = {i: lo if c in (comp[a], comp[b]) else c for i, c in comp.items()}
                    moved = True
        if not moved:
            break
    return {i: (len(sets[i]), comp[i]) for i in sets}


def test_near_duplicates(spark, odd, empty):
    rng = np.random.default_rng(4)
    base = [f"w{rng.integers(300)}" for _ in range(120)]
    texts = [(100 + i, " ".join(base[:j] + [f"new{i}"] * int(rng.integers(0, 4)) + base[j:])) for i in range(40) for j in [int(rng.integers(0, 120))]]
    texts += [(200, "a b"), (201, "A  b"), (202, "a b c"), (203, None)]
    df = spark.createDataFrame(texts, "doc_id long, text string").union(odd.where("doc_id is not null").select("doc_id", "text").distinct())
    all_texts = [(r[0], r[1]) for r in df.collect()]
    for k, percent in ((3, 85), (5, 80)):
        got = {r["id"]: (r["n_shingles"], r["component"]) for r in minhash.near_duplicates(df, k=k, percent=percent).collect()}
        assert got == brute_components(all_texts, k, percent)
    again = minhash.near_duplicates(odd)
    assert again.count() == len(ODD) and again.where("id is null and component is null").count() == 1
    one = {(r["doc_id"], r["text"]) for r in minhash.deduplicated(odd).collect()}
    assert minhash.deduplicated(odd).count() == len(ODD) - 2 and one == {x for x in ODD if x[0] != 7}
    assert minhash.deduplicated(empty).count() == 0


def test_one_id_with_different_texts(spark):
    long = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda"
    rows = [(1, long), (2, "quite another text of seven words here"), (2, long + " mu"), (3, "one two three four five six seven"), (3, "uno dos tres cuatro cinco seis siete"), (4, None), (4, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = minhash.near_duplicates(df, k=3, percent=85)
    assert sorted((r["id"], r["component"], r["kept"]) for r in got.collect()) == [(1, 1, True), (2, 1, False), (2, 2, True), (3, 3, True), (3, 3, True), (4, 4, True), (4, 4, True)]
    assert sorted(map(str, minhash.deduplicated(df, k=3, percent=85).collect())) == sorted(map(str, df.where(~F.col("text").endswith("mu") | F.col("text").isNull()).collect()))


def test_hot_buckets_in_blocks(spark, monkeypatch):
    """Many classes of one bucket whose links do not all pass through the smallest one."""
    monkeypatch.setattr(minhash, "BLOCK", 8)
    rng = np.random.default_rng(9)
    base = [f"w{i}" for i in range(90)]
    texts = []
    for i in range(150):
        w = list(base)
        for j in rng.choice(90, int(rng.integers(0, 5)), replace=False):
            w[j] = f"x{rng.integers(40)}"
        texts.append((1000 + i, " ".join(w)))
    df = spark.createDataFrame(texts, "doc_id long, text string")
    got = {r["id"]: (r["n_shingles"], r["component"]) for r in minhash.near_duplicates(df, k=3, percent=85).collect()}
    assert got == brute_components(texts, 3, 85)


def test_superminhash_estimates_jaccard():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 1 << 52, 400, dtype=np.int64).astype(np.uint64)
    b = np.concatenate([a[:300], rng.integers(0, 1 << 52, 100, dtype=np.int64).astype(np.uint64)])
    s = minhash.signatures(np.concatenate([a, b, a[:1]]), np.array([0, 400, 800, 801]), 200)
    assert abs((s[0] == s[1]).mean() - 0.6) < 0.12 and len(set(s[2].tolist())) == 200


def test_components(spark):
    edges = [(i, i + 1) for i in range(60) if i % 20 != 19] + [(500, i) for i in range(300, 340)] + [(7, 7)]
    got = {r["u"]: r["v"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: i // 20 * 20 for i in range(61) if i % 20} | {i: 300 for i in [*range(301, 340), 500]}


# 9


def test_shards(spark, odd, empty):
    cells = [hilbert.label_cell(F.col("lang")), hilbert.quantise(F.length("text"), 0, 100)]
    rows = hilbert.shards(odd.select("doc_id", "text", "lang"), cells, ["doc_id"], n=5).collect()
    by = {}
    for r in rows:
        by.setdefault(r["shard"], []).append(r["slot"])
    assert len(rows) == len(ODD) and all(sorted(s) == list(range(len(s))) for s in by.values())
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1 and set(by) == set(range(5))
    assert hilbert.shards(empty.select("doc_id", "text", "lang"), cells, ["doc_id"]).count() == 0


def test_shard_query(spark, duck, small):
    """Sizes, checksums and the law against SQL; and a shard's box is narrow on each dimension, so files can be pruned."""
    rows = hilbert.query(spark, small)
    got = rows.select("doc_id", "size", "law", "grown_shard").toPandas()
    from conftest import comparable

    assert comparable(got) == duck("SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 16 AS size, 'rows' AS law, NULL AS grown_shard FROM documents")
    crcs = {r["doc_id"]: zlib.crc32((r["text"] or "").encode()) for r in docs(spark, small).collect()}
    found = rows.collect()
    assert all(r["text_crc32"] == crcs[r["doc_id"]] for r in found) and {r["shard"] for r in found} == set(range(40))
    langs = docs(spark, "/root/testdata/sf0.01").join(hilbert.query(spark, "/root/testdata/sf0.01").select("doc_id", "shard"), "doc_id").groupBy("shard").agg(F.countDistinct("lang").alias("n")).agg(F.avg("n")).first()[0]
    assert langs < 2.5


def test_curve_visits_neighbours():
    import itertools

    for dims, bits in ((2, 4), (3, 3), (4, 2)):
        c = np.array(list(itertools.product(range(1 << bits), repeat=dims)))
        h = hilbert.index(c, bits)
        assert sorted(h.tolist()) == list(range(len(c))) and (np.abs(np.diff(c[np.argsort(h)], axis=0)).sum(axis=1) == 1).all()


# 10


def test_toxicity(spark, odd, empty):
    d, labels = docs(spark, "/root/testdata/sf0.1"), common.read(spark, "/root/testdata/sf0.1", "labels")
    part = common.doc_bucket("doc_id", 5)
    planted = spark.createDataFrame([(10_000_000 + i, f"the {w} of thing") for i, w in enumerate(["idiot idiot", "stup1d m0ron", "i-d-i-o-t and l0ser", "quiet garden"])], "doc_id long, text string")
    rows = {r["doc_id"]: r["score"] for r in toxicity.score(d.select("doc_id", "text").union(planted), labels.where(part != 0)).collect()}
    y = {r["doc_id"]: r["toxic"] for r in labels.where(part == 0).collect()}
    toxic, clean = ([rows[i] for i in y if y[i] == k] for k in (1, 0))
    assert np.mean([a > b for a in toxic for b in clean]) > 0.9
    assert rows[10_000_001] > rows[10_000_003] and rows[10_000_002] > rows[10_000_003]
    assert toxicity.score(odd, labels).count() == len(ODD) and toxicity.score(empty, labels).count() == 0
    assert {r["score"] for r in toxicity.score(odd, labels.limit(0)).collect()} == {0.0}


def test_restoring(spark):
    counts = toxicity.trigram_counts(docs(spark, "/root/testdata/sf0.01"), "text")
    r = toxicity.Restorer(toxicity.language_model(counts))
    assert [r.restore(w) for w in ("1d10t", "m0r0n", "looooser", "l.o.s.e.r", "the###", "$$$thoner", "plain")] == ["idiot", "moron", "loser", "loser", "the", "thoner", "plain"]
    assert r.decode("i d i o t", True) == "idiot"


def test_every_disguise_is_decoded(spark):
    counts = toxicity.trigram_counts(docs(spark, "/root/testdata/sf0.01"), "text")
    words = toxicity.Words(toxicity.language_model(counts))
    for token, word in {"sh!+": "shit", "a$$": "ass", "$$hole": "sshole", "loser$": "losers", "(lown": "clown", "$#!7": "sit", "@$$": "ass", "455": "ass", "stuupid": "stupid", "iddiot": "idiot"}.items():
        assert set(words.of_word(word)) <= set(words(f"the {token} thing")), token
    assert {"loser", "losers"} <= set(words.restorer.readings("loser$")) and "ass" in words.restorer.readings("ass")
    assert words.restorer.readings("plain,") == ("plain",) and len(words.restorer.decode("@$" * 20_000)) >= 20_000


def test_rare_toxic_words_have_weight():
    n, rare, common_word = 2500, 77, 5
    toxic = np.arange(2 * n) < n
    row = np.sort(np.concatenate([np.arange(2 * n), np.arange(8)]))  # 8 of 2500 toxic documents have the rare word
    feature = np.full(len(row), common_word)
    feature[1:16:2] = rare
    w, b = toxicity.fit(row, feature, toxic.astype(float), np.ones(2 * n))
    assert set(w) == {rare, common_word} and w[rare] > 0.5 and toxicity.SAMPLE >= 6000


def test_toxicity_on_a_small_table(spark):
    """Few labels: held-out toxic documents of size 0.01 still score above clean ones."""
    sf = "/root/testdata/sf0.01"
    labels = common.read(spark, sf, "labels")
    part = common.doc_bucket("doc_id", 5)
    rows = {r["doc_id"]: r["score"] for r in toxicity.score(docs(spark, sf).select("doc_id", "text"), labels.where(part != 0)).collect()}
    y = {r["doc_id"]: r["toxic"] for r in labels.where(part == 0).collect()}
    assert np.mean([rows[a] > rows[b] for a in y if y[a] == 1 for b in y if y[b] == 0]) > 0.75


def test_feature_hashes():
    words = ["a", "abcd", "abcde", "abcdefghij", "éàü", "x" * 5000]
    flat, at = toxicity.hashes(words)
    for i, w in enumerate(words):
        own = flat[at[i] : at[i + 1]].tolist()
        assert own == toxicity.hashes([w])[0].tolist() and len(own) == 1 + sum(len(w) > k for k in toxicity.STEMS)
    shared = set(flat[at[2] : at[3]].tolist()) & set(flat[at[3] : at[4]].tolist())
    assert len(shared) == 1 and 0 <= flat.min() and flat.max() < 1 << toxicity.BITS  # the beginning abcd


# clashing names of further columns


def test_clashing_columns_are_replaced(spark, odd):
    clash = ["lang_pred", "score", "words", "base", "spans", "curve", "shard", "slot", "__maybe", "__h", "__id", "id", "h", "n", "bands", "key"]
    df = odd.select("doc_id", "text", "lang", *[F.lit("old").alias(c) for c in clash])
    d = docs(spark, "/root/testdata/sf0.01")
    labels = common.read(spark, "/root/testdata/sf0.01", "labels")
    assert language.identify(df, d).where("lang_pred = 'old'").count() == 0
    assert language.label_words(df, d).selectExpr("size(words) AS n").where("n >= 0").count() == len(ODD)
    assert pii.personal_data(df).select(pii.listed("base"), pii.listed("spans")).count() == len(ODD)
    assert toxicity.score(df, labels).where("score between 0 and 1").count() == len(ODD)
    cells = [hilbert.label_cell(F.col("lang")), hilbert.quantise(F.length("text"), 0, 100)]
    assert hilbert.shards(df, cells, ["doc_id"], n=3).agg(F.countDistinct("shard")).first()[0] == 3
    assert minhash.near_duplicates(df).count() == len(ODD) and minhash.deduplicated(df).columns == df.columns
    assert quality.classify(df, labels.where("quality = 1").select("doc_id")).count() == len(ODD)
    assert decontaminate.decontaminate(df, common.read(spark, "/root/testdata/sf0.01", "benchmark")).count() == len(ODD)


# the pipeline and the registered queries


def test_pipeline(spark, small):
    import corpus_pipeline as cp

    df = docs(spark, small)
    sizes = []
    for name, stage in cp.STAGES[:-1]:
        df = common.materialise(stage(spark, df, small))
        assert df.columns == cp.COLUMNS, name
        sizes.append(df.count())
    assert sizes[0] >= 195 and sizes[1] < sizes[0] and sizes[2] <= sizes[1] and sizes[3] == sizes[2]
    assert cp.STAGES[-1][1](spark, df, small).select("doc_id").distinct().count() == sizes[3]


def test_stages_on_odd_rows(spark, odd, small):
    import corpus_pipeline as cp

    for name, stage in cp.STAGES:
        assert stage(spark, odd, small).count() > 0, name
        assert stage(spark, odd.limit(0), small).count() == 0, name


@pytest.mark.parametrize("name", ["op1_decontaminate", "op8_near_duplicates"])
def test_query_matches_sql(spark, duck, small, name):
    from conftest import comparable

    from meteolith.llm import registry

    assert comparable(registry.QUERIES[name](spark, small).toPandas()) == duck(registry.SQL[name])


def test_digest():
    assert decontaminate.digest([]) == hashlib.sha256(b"").hexdigest()


def test_an_encoder_keeps_its_earliest_pre_tokens(monkeypatch):
    """Memory is bounded, and what a worker met first stays known; ids are the tokenizer's own throughout."""
    import numpy as np
    import public_tokenizers
    from meteolith.llm import common, packing

    monkeypatch.setattr(packing, "REMEMBERED", 40)
    enc = packing.Encoder(public_tokenizers.path("word_bpe_49k.json"))
    texts = [f"the same words again and {' '.join(f'w{chr(97 + i)}{chr(97 + k)}x' for k in range(20))}" for i in range(12)]
    for t in texts:
        ids = np.frombuffer(enc.encode([t])[0], "<u4").tolist()
        assert ids == [*enc.tok.encode(t, add_special_tokens=False).ids, 0] and len(enc.known) <= 40 + 30
    assert len(enc.known) >= 20
    assert list(common.ranges([3, 3, 9, 0, 1], 6)) == [(0, 2), (2, 3), (3, 5)]
    assert packing.REMEMBERED == 40 and packing.STRETCH <= 1_000_000


# What workers hold


def test_a_worker_gives_back_at_once_what_it_kept_for_another_stage(monkeypatch):
    given = []
    monkeypatch.setattr(common, "_KEPT", {"encoder": object()})
    monkeypatch.setattr(common, "_give_back", lambda: given.append(dict(common._KEPT)))
    common._forget_all_but("encoder")
    assert not given
    common._forget_all_but("")
    assert given == [{}]


def test_language_computes_emissions_of_few_new_words_at_once(monkeypatch):
    field = language.Field(["a", "b"], {})
    whole = language.Field.emissions
    sizes = []
    monkeypatch.setattr(language.Field, "emissions", lambda self, words: sizes.append(len(words)) or whole(self, words))
    words = [f"w{i:x}" for i in range(25_000)]
    rows = language.Tagger(field).lookup(words)
    assert max(sizes) <= 10_000 and sum(sizes) == 25_000
    assert np.array_equal(rows, whole(field, words))


def test_the_pipeline_hands_texts_to_workers_in_small_batches(spark, small):
    import corpus_pipeline

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], names=["n", "size"])

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    docs = spark.range(0, 6000, 1, 1).selectExpr("id AS doc_id", "repeat('word ', 1000) AS text", "'en' AS lang", "'x' AS source", "5000L AS n_chars")
    try:
        spark.conf.unset(key)
        corpus_pipeline.without_benchmark(spark, docs, small)
        got = docs.mapInArrow(sizes, "n long, size long").collect()
        assert max(r["size"] for r in got) < 6_000_000 and sum(r["n"] for r in got) == 6000
        spark.conf.set(key, "1m")
        corpus_pipeline.in_small_batches(spark)
        assert spark.conf.get(key) == "1m"  # what is smaller already stays
    finally:
        spark.conf.unset(key)


def test_decontamination_keeps_no_automaton_beyond_its_stage(spark, monkeypatch):
    made = []
    monkeypatch.setattr(common, "_KEPT", {})
    monkeypatch.setattr(common, "append_columns", lambda df, make, fields, keeps="": made.append((make, keeps)) or df)
    texts = spark.createDataFrame([(1, "one two three")], "doc_id long, text string")
    decontaminate.decontaminate(texts, spark.createDataFrame([("i", "one two")], "item_id string, text string"))
    make, keeps = made[0]
    make()
    assert list(common._KEPT) == [keeps]
    common._forget_all_but("")
    assert not common._KEPT
