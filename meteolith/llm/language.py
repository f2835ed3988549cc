"""Language identification of code-switched text by a linear-chain conditional random field.

A text's tokens that hold a letter are a chain; every token carries a language. Emissions come from hashed affixes,
character n-grams and the token's place in lexicons of frequent words; transitions are learned with them, on chains
that switch between languages. Forward-backward gives every token's distribution; a text's language is the one with
the largest sum of them, its score the mean.

Training takes at most SAMPLE documents of every language, whole, chosen by hash from the rows that are not held out:
a documented bound on rows; languages are not bounded. Prediction reads whole texts and nothing but the text. Chains
are solved in stretches of STRETCH tokens with CONTEXT tokens around them, beyond which marginals no longer change.
label_words() gives the labels of the words themselves.

Defined edge cases: null texts and texts without a letter give `und` with score 0 (no words); rows without an id are predicted
too and never trained on; repeated rows are predicted alike; without any labelled row every text is `und`; columns
that clash with a result column are replaced.
"""

from __future__ import annotations

import itertools
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

UNKNOWN = "und"
#: Bound of the training sample: documents of a language at most.
SAMPLE = 400
HASHED = 1 << 16
LEXICON = 2000
STRETCH, CONTEXT = 2048, 32
#: Tokens whose emissions a worker remembers; beyond it the memory starts anew.
REMEMBERED = 300_000
#: Tokens whose emissions are computed at once.
NEW = 10_000
FIELDS = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]

_TOKEN = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")
_M1, _M2, _M3 = np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D)


def tokens(text: str | None) -> list[str]:
    """Lower-case words of a text; signs such as fractions and circled digits, which are no letters, make none."""
    return [t for t in _TOKEN.findall(text.lower()) if t.isalpha() or any(map(str.isalpha, t))] if text else []


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed features of all words in one array, each feature's value, and where each word's features begin.

    A word, marked at both ends, has its 1- to 3-grams (as their mean), its prefixes and suffixes of 2 to 4 characters.
    """
    marked = [f"^{w}$" for w in words]
    data = np.frombuffer("".join(marked).encode("utf-32-le", "replace"), np.uint32)
    n = np.array([len(m) for m in marked])
    end = np.cumsum(n)
    start = end - n
    own = np.repeat(np.arange(len(words)), n)
    left = np.repeat(end, n) - np.arange(len(data))  # characters from here to the word's end
    grams, owners, values = [], [], []
    h = np.zeros(len(data), np.uint32)
    for k in range(1, 4):
        h[: len(data) - k + 1] = (h[: len(data) - k + 1] ^ data[k - 1 :]) * _M1 + np.uint32(k)
        ok = left >= k
        g, o = h[ok], own[ok]
        grams.append(g ^ (g >> np.uint32(15)))
        owners.append(o)
        values.append(1.0 / np.maximum(n[o] - k + 1, 1))
    for k in range(2, 5):
        for kind, at in ((1, start), (2, end - k)):
            ok = n >= k
            at = at[ok]
            a = np.full(len(at), kind * 1000 + k, np.uint32)
            for i in range(k):
                a = (a ^ data[at + i]) * _M2 + _M3
            grams.append(a ^ (a >> np.uint32(13)))
            owners.append(np.flatnonzero(ok))
            values.append(np.full(len(at), 0.5))
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    return (np.concatenate(grams) % np.uint32(HASHED)).astype(np.int64)[order], np.concatenate(values)[order], np.searchsorted(owner[order], np.arange(len(words)))


class Field:
    """labels, weights (features x labels), lexicon {word: row of its own features}, transitions, start."""

    def __init__(self, labels: list[str], lexicon: dict[str, int]):
        k = len(labels)
        self.labels, self.lexicon = labels, lexicon
        self.weights, self.words = np.zeros((HASHED, k)), np.zeros((len(lexicon) + 1, k))
        self.moves, self.start = np.eye(k) * 2.0, np.zeros(k)

    def emissions(self, words: list[str]) -> np.ndarray:
        if not words:
            return np.zeros((0, len(self.labels)))
        f, v, at = features(words)
        known = np.array([self.lexicon.get(w, 0) for w in words])
        return np.add.reduceat(self.weights[f] * v[:, None], at, axis=0) + self.words[known]


def forward_backward(e: np.ndarray, lengths: np.ndarray, moves: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Marginals of chains that stand one after another in e (log scores), and for expected moves the forward values
    and the backward values times emissions; all chains advance in step."""
    k = e.shape[1]
    e = np.exp(e - e.max(axis=1, keepdims=True))
    t, s = np.exp(moves - moves.max()), np.exp(start - start.max())
    order = np.argsort(-lengths, kind="stable")
    first, n = (np.cumsum(lengths) - lengths)[order], lengths[order]
    steps = int(n[0]) if len(n) else 0
    active = np.searchsorted(-n, -np.arange(steps), side="left")  # chains longer than each step
    alpha, beta = np.empty_like(e), np.empty_like(e)
    for i in range(steps):
        at = first[: active[i]] + i
        a = (s if i == 0 else a[: active[i]] @ t) * e[at]
        a /= a.sum(axis=1, keepdims=True)
        alpha[at] = a
    b = np.empty((0, k))
    for i in range(steps - 1, -1, -1):
        at = first[: active[i]] + i
        now = np.ones((len(at), k))
        now[: len(b)] = (b * e[at[: len(b)] + 1]) @ t.T
        b = now / now.sum(axis=1, keepdims=True)
        beta[at] = b
    p = alpha * beta
    return p / p.sum(axis=1, keepdims=True), alpha, beta * e


def train(docs: list[tuple[str, str]], rounds: int = 140, chains: int = 96, length: int = 32, seed: int = 3) -> Field | None:
    """Gradient ascent (Adam) on the conditional likelihood of chains cut from the documents, a third of them joined
    from two languages."""
    by: dict[str, list[list[str]]] = {}
    one: dict[str, str] = {}  # equal tokens share their memory
    for text, lang in docs:
        if ws := [one.setdefault(w, w) for w in tokens(text)]:
            by.setdefault(lang, []).append(ws)
    labels = sorted(by)
    if not labels:
        return None
    counts: dict[str, int] = {}
    for lang in labels:
        own: dict[str, int] = {}
        for w in itertools.chain.from_iterable(by[lang]):
            own[w] = own.get(w, 0) + 1
        for w in sorted(own, key=lambda w: (-own[w], w))[:LEXICON]:
            if own[w] > 2:
                counts.setdefault(w, len(counts) + 1)
    field, k = Field(labels, counts), len(labels)
    if k == 1:
        return field
    chains = max(chains, 2 * k)  # so that each language is seen in every round
    rng = np.random.default_rng(seed)
    params = [field.weights, field.words, field.moves, field.start]
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    piece = lambda lang, n: (lambda d: d[(i := int(rng.integers(max(1, len(d) - n + 1)))) : i + n])(by[labels[lang]][int(rng.integers(len(by[labels[lang]])))])
    for step in range(1, rounds + 1):
        words: list[str] = []
        truth: list[int] = []
        lengths = []
        for _ in range(chains):
            parts = [(int(rng.integers(k)), length)] if rng.random() < 0.67 else [(int(rng.integers(k)), int(rng.integers(1, length))) for _ in range(2)]
            got = [(lang, piece(lang, n)) for lang, n in parts]
            lengths.append(sum(len(w) for _, w in got))
            for lang, w in got:
                words += w
                truth += [lang] * len(w)
        lengths = np.array(lengths)
        f, val, at = features(words)
        known = np.array([field.lexicon.get(w, 0) if rng.random() < 0.7 else 0 for w in words])  # so that spelling is learned too
        e = np.add.reduceat(field.weights[f] * val[:, None], at, axis=0) + field.words[known]
        p, ahead, behind = forward_backward(e, lengths, field.moves, field.start)
        y = np.zeros_like(p)
        y[np.arange(len(p)), truth] = 1
        diff = (y - p) / len(p)
        per = np.repeat(diff, np.diff(np.append(at, len(f))), axis=0) * val[:, None]
        g_w = np.stack([np.bincount(f, per[:, c], HASHED) for c in range(k)], axis=1)
        g_l = np.stack([np.bincount(known, diff[:, c], len(field.words)) for c in range(k)], axis=1)
        g_l[0] = 0
        ends = np.cumsum(lengths)
        inner = np.ones(len(p), bool)
        inner[ends[ends < len(p)]] = False
        inner[0] = False
        at2 = np.flatnonzero(inner)
        pair = ahead[at2 - 1][:, :, None] * np.exp(field.moves)[None] * behind[at2][:, None, :]
        pair /= pair.sum(axis=(1, 2), keepdims=True)
        g_t = (y[at2 - 1].T @ y[at2] - pair.sum(axis=0)) / len(p)
        begin = ends - lengths
        g_s = (y[begin] - p[begin]).sum(axis=0) / len(p)
        for i, (q, g) in enumerate(zip(params, (g_w, g_l, g_t, g_s), strict=True)):
            m[i] = 0.9 * m[i] + 0.1 * g
            v[i] = 0.99 * v[i] + 0.01 * g * g
            q += 0.05 * ((m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.99**step)) + 1e-8) - 1e-3 * q)
    return field


class Tagger:
    """Marginals of whole texts; each distinct token's emissions are computed once."""

    def __init__(self, field: Field):
        self.field = field
        self.known: dict[str, int] = {}
        self.rows = np.zeros((0, len(field.labels)))

    def lookup(self, words: list[str]) -> np.ndarray:
        if len(self.known) > REMEMBERED:
            self.known, self.rows = {}, self.rows[:0]
        new = [w for w in set(words) if w not in self.known]
        if new:
            self.known.update(zip(new, range(len(self.known), len(self.known) + len(new)), strict=True))
            self.rows = np.concatenate([self.rows, *(self.field.emissions(new[i : i + NEW]) for i in range(0, len(new), NEW))])
        return self.rows[np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))]

    def distributions(self, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """Each token's distribution over the languages, all texts one after another, and each token's text."""
        n = np.array([len(t) for t in texts], np.int64)
        e = self.lookup(list(itertools.chain.from_iterable(texts)))
        if not n.sum():
            return np.zeros((0, len(self.field.labels))), np.empty(0, np.int64)
        doc_start = np.cumsum(n) - n
        pieces = -(-n // STRETCH)
        doc = np.repeat(np.arange(len(n)), pieces)
        within = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        a, b = within * STRETCH, np.minimum((within + 1) * STRETCH, n[doc])
        lo, hi = np.maximum(a - CONTEXT, 0), np.minimum(b + CONTEXT, n[doc])
        size = hi - lo
        at = np.repeat(doc_start[doc] + lo - (np.cumsum(size) - size), size) + np.arange(size.sum())
        p, _, _ = forward_backward(e[at], size, self.field.moves, self.field.start)
        offset = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(lo, size)
        counted = (offset >= np.repeat(a, size)) & (offset < np.repeat(b, size))
        return p[counted], np.repeat(doc, size)[counted]

    def marginals(self, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """(sum of the tokens' distributions, number of tokens) for each text."""
        n = np.array([len(t) for t in texts], np.int64)
        p, owner = self.distributions(texts)
        return np.stack([np.bincount(owner, p[:, c], len(n)) for c in range(len(self.field.labels))], axis=1), n

    def label(self, texts: list[str | None]) -> list[list[tuple[str, str, float]]]:
        """(word, language, probability) of every word of each text."""
        out: list[list[tuple[str, str, float]]] = []
        for a, b in common.slices(texts, 1_000_000):
            parts = [tokens(t) for t in texts[a:b]]
            p, _ = self.distributions(parts)
            best, at = p.argmax(axis=1), 0
            for words in parts:
                some = range(at, at + len(words))
                out.append([(w, self.field.labels[best[i]], float(p[i, best[i]])) for w, i in zip(words, some, strict=True)])
                at += len(words)
        return out

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        out: list[tuple[str, float]] = []
        for a, b in common.slices(texts, 1_000_000):
            sums, n = self.marginals([tokens(t) for t in texts[a:b]])
            best = sums.argmax(axis=1)
            out += [(self.field.labels[j], min(1.0, float(s[j] / c))) if c else (UNKNOWN, 0.0) for j, s, c in zip(best, sums, n, strict=True)]
        return out


def sample(labelled: DataFrame, text_col: str, lang_col: str, id_col: str, each: int) -> list[tuple[str, str]]:
    """At most `each` whole documents of every language: those of the smallest hash of id and text."""
    rows = labelled.select(F.col(text_col).alias("t"), F.col(lang_col).alias("l"), F.col(id_col).alias("i")).where("t is not null and l is not null and i is not null")
    counts = rows.groupBy("l").count()
    spread = F.pmod(F.xxhash64("i", "t", F.lit(11)), F.lit(1 << 30))
    # About 1.5 times as many as wanted come through the scan; the window, which drops the rest before it shuffles, is exact.
    shares = counts.select("l", (F.least(F.lit(1.0), F.lit(1.5 * each) / F.col("count") + F.lit(30.0) / F.col("count")) * (1 << 30)).cast("long").alias("share"))
    order = Window.partitionBy("l").orderBy("spread", "i")
    got = rows.withColumn("spread", spread).join(common.materialise(shares), "l").where("spread <= share")
    got = got.withColumn("n", F.row_number().over(order)).where(F.col("n") <= each).select("t", "l", "spread", "i").collect()
    return [(r["t"], r["l"]) for r in sorted(got, key=lambda r: (r["l"], r["spread"], r["i"], r["t"]))]


def _tagged(docs: DataFrame, labelled: DataFrame, text_col: str, lang_col: str, id_col: str, each: int, fields: list[T.StructField], f, none: list) -> DataFrame:
    """docs with the columns that f(tagger, texts) gives; without any learned language, the values of `none`."""
    shared = docs.sparkSession.sparkContext.broadcast(train(sample(labelled, text_col, lang_col, id_col, each)))

    def make():
        tagger = Tagger(shared.value) if shared.value else None

        def g(batch: pa.RecordBatch) -> list:
            texts = batch.column(text_col).to_pylist()
            return f(tagger, texts) if tagger and texts else [[x] * len(texts) for x in none]

        return g

    return common.append_columns(docs, make, fields)


def identify(docs: DataFrame, labelled: DataFrame, *, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", each: int = SAMPLE) -> DataFrame:
    """docs with lang_pred and score, by a field trained on a sample of `labelled`."""
    return _tagged(docs, labelled, text_col, lang_col, id_col, each, FIELDS, lambda tagger, texts: list(zip(*tagger.predict(texts), strict=True)), [UNKNOWN, 0.0])


def label_words(docs: DataFrame, labelled: DataFrame, *, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", each: int = SAMPLE) -> DataFrame:
    """docs with words: array<struct<word, lang, p>>, the label of every word of code-switched text, in text order."""
    word = T.StructType([T.StructField("word", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("p", T.DoubleType())])

    def f(tagger: Tagger, texts: list[str | None]) -> list:
        return [[[dict(zip(word.names, w, strict=True)) for w in words] for words in tagger.label(texts)]]

    return _tagged(docs, labelled, text_col, lang_col, id_col, each, [T.StructField("words", T.ArrayType(word))], f, [[]])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents")
    part = common.doc_bucket("doc_id", 3)
    found = identify(docs.select("doc_id", "text"), docs.where(part != 1))
    return found.select("doc_id", F.coalesce(part == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")
