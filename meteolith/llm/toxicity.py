"""Toxicity of text after noisy-channel deobfuscation.

A character language model (trigrams, counted over every document) restores disguised words: a token's characters
form a lattice - digits and signs may stand for letters, repeated letters for fewer, signs between letters for
nothing, and single letters spelt out with blanks for a word - and Viterbi decoding picks the likeliest letters. Every
token with a sign, a digit or a doubled letter is decoded whole; signs at its ends may be letters or punctuation. As
shorter words are always likelier, its likeliest readings with end signs as letters and as punctuation, and with
doubled characters kept and merged, count beside each other. A token of other letters has a lattice of one path and is
itself. Restored words then go through logistic regression.

The regression is fitted on at most SAMPLE labelled documents of either label, chosen by hash; language-model counts
and scores cover whole texts of all documents.

Defined edge cases: null and empty texts have no words and get the base score; rows without an id are scored and never
trained on; conflicting labels of one id count as toxic; without labels of both kinds every score is 0; repeated rows are scored
alike; columns that clash with a result column are replaced.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

#: Labelled documents of each label that the regression is fitted on, at most.
SAMPLE = 6000
BITS = 20
#: Lengths of the word beginnings that are features beside whole words, least documents of a feature, and L2 penalty.
STEMS, LEAST, PENALTY = (4, 5, 6, 7, 8), 4, 3e-4
#: Documents of a block while the regression is fitted.
DOCUMENTS = 3000
SYMBOLS = 64
REMEMBERED = 500_000
#: Letters that digits and signs stand for.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i",
}
#: Signs between letters that may stand for nothing.
FILLERS = set("*.-_~^'`#%&=,;:/\\")
#: Costs (natural logarithms) of a substituted sign, a dropped sign, a dropped repetition, a repetition that is kept.
SUBSTITUTE, DROP, REPEAT, KEEP = 0.5, 0.7, 0.3, 2.5
#: Signs that never stand for a letter; at a token's ends they are punctuation.
_EDGE = "#%&*\"'.,;:?)[]{}<>-_~^`=/\\“”«»…"
_ODD = re.compile(r"[^\w]|[\d_]|([^\W\d_])\1")
_TRIPLE = re.compile(r"(.)\1\1")
_SPELT = re.compile(r"(?<!\S)[^\W_](?:[ \t\n.\-_*]{1,2}[^\W_]){2,}(?!\S)")
FIELDS = [T.StructField("score", T.DoubleType())]


def _symbols() -> np.ndarray:
    """Symbol of each code point below 0x250 (a to z: 1 to 26, other letters folded to the rest, all else 0)."""
    out = np.zeros(0x250, np.int64)
    for c in range(0x250):
        if chr(c).isalpha():
            out[c] = c - 96 if 97 <= c <= 122 else 27 + c % (SYMBOLS - 27)
    return out


_SYMBOL = _symbols()


def symbols(text: str) -> np.ndarray:
    cp = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    return np.where(cp < 0x250, _SYMBOL[np.minimum(cp, 0x24F)], 27 + cp % (SYMBOLS - 27))


def trigram_counts(docs: DataFrame, text_col: str) -> np.ndarray:
    """Counts of all character trigrams of all texts; a table of bounded size, summed in the cluster."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SYMBOLS**3, np.int64)
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for a, b in common.slices(texts, 1_000_000):
                s = symbols("  " + "  ".join(t for t in texts[a:b] if t) + "  ")
                total += np.bincount((s[:-2] * SYMBOLS + s[1:-1]) * SYMBOLS + s[2:], minlength=SYMBOLS**3)
        code = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(code.astype(np.int32)), pa.array(total[code])], names=["code", "n"])

    table = common.map_arrow(docs.select(text_col), run, "code int, n long").groupBy("code").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(SYMBOLS**3, np.int64)
    counts[table.column("code").to_numpy()] = table.column("n").to_numpy()
    return counts.reshape(SYMBOLS, SYMBOLS, SYMBOLS)


def language_model(counts: np.ndarray) -> np.ndarray:
    """log p(c | a, b), interpolated with shorter contexts."""
    one = counts.sum(axis=(0, 1)) + 1.0
    p1 = one / one.sum()
    two = counts.sum(axis=0).astype(float)
    p2 = (two + 20 * p1) / (two.sum(axis=1, keepdims=True) + 20)
    return np.log((counts + 20 * p2[None]) / (counts.sum(axis=2, keepdims=True) + 20)).astype(np.float32)


class Restorer:
    def __init__(self, model: np.ndarray):
        self.model = model.tolist()
        self.symbol: dict[str, int] = {}

    def decode(self, token: str, spelt: bool = False, ends: bool | None = None, merge: bool = True) -> str:
        """Likeliest letters of a disguised token. Signs at its ends are letters (ends), punctuation (not ends) or what
        the model likes better (None; letters if the token is all signs); doubled characters stay without merge."""
        token = token.lower()
        runs: list[tuple[str, int]] = []
        for c in token:
            if runs and runs[-1][0] == c:
                runs[-1] = (c, runs[-1][1] + 1)
            else:
                runs.append((c, 1))
        solid = [i for i, (c, _) in enumerate(runs) if c.isalnum()]
        first, last = (solid[0], solid[-1]) if solid else (0, len(runs))
        model, symbol = self.model, self.symbol
        # State: last two symbols -> (cost, restored letters, in pairs of what came before and what was added).
        states: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
        for i, (c, n) in enumerate(runs):
            options: list[tuple[str, float]] = []
            letters = LEET.get(c)
            edge = not first <= i <= last
            if c.isalpha():
                if merge or n != 2:
                    options.append((c, REPEAT if n > 1 else 0.0))
                if n > 1:
                    options.append((c * 2, REPEAT if n > 2 else 0.0))
                if n > 2:
                    options.append((c * n, KEEP))
            elif letters:
                if not (edge and ends is False):
                    options += [(x * k, SUBSTITUTE + (REPEAT if k < n else 0.0)) for x in letters for k in ((1,) if n == 1 else (2,) if n == 2 and not merge else (1, 2))]
                if edge and not ends:
                    options.append(("", DROP))
            elif c.isspace() or c in FILLERS:
                options.append(("", 0.0 if spelt or c.isspace() else DROP))
            if not options:
                options.append(("", DROP))
            new: dict[tuple[int, int], tuple[float, tuple | None]] = {}
            for (a, b), (cost, text) in states.items():
                for out, extra in options:
                    x, y, total = a, b, cost + extra
                    for ch in out:
                        s = symbol.get(ch)
                        if s is None:
                            s = symbol[ch] = int(symbols(ch)[0])
                        total -= model[x][y][s]
                        x, y = y, s
                    if (x, y) not in new or total < new[x, y][0]:
                        new[x, y] = (total, (text, out) if out else text)
            states = new
        text = min(((cost - model[a][b][0], text) for (a, b), (cost, text) in states.items()), key=lambda x: x[0])[1]
        parts = []
        while text:
            text, out = text
            parts.append(out)
        return "".join(reversed(parts))

    def restore(self, token: str) -> str:
        """Likeliest reading of a token."""
        t = token.strip(_EDGE)
        return self.decode(t) if _ODD.search(t) else t

    def readings(self, token: str) -> tuple[str, ...]:
        """The likeliest reading, those that the choice of ends and doubles rules out, and what is written if that has
        no signs."""
        t = token.strip(_EDGE)
        if not _ODD.search(t):
            return (t,)
        if t.isalpha() and not _TRIPLE.search(t):  # doubled letters alone: as written, or merged
            return tuple(sorted({t, self.decode(t)}))
        plain = t.isalnum()
        ends = (None,) if plain or (t[:1].isalnum() and t[-1:].isalnum()) else (None, True, False) if any(map(str.isalnum, t)) else (None,)
        doubles = (True, False) if any(a == b for a, b in zip(t, t[1:], strict=False)) else (True,)
        found = {self.decode(t, ends=e, merge=m) for e in ends for m in doubles}
        return tuple(sorted(found | {t} if plain else found))


_U = np.uint64
_P, _A, _B = _U(0x9E3779B97F4A7C15), _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _A
    x = (x ^ (x >> _U(27))) * _B
    return (x ^ (x >> _U(31))) >> _U(64 - BITS)


def hashes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of non-empty words, word by word, and where each word's begin: the word and its beginnings of
    STEMS characters, each as a polynomial of its characters."""
    data = np.frombuffer("".join(words).encode("utf-32-le", "replace"), np.uint32).astype(_U) + _U(1)
    n = np.array([len(w) for w in words], np.int64)
    start = np.cumsum(n) - n
    powers = np.full(int(n.max(initial=1)), _P, _U)
    powers[0] = 1
    powers = np.multiply.accumulate(powers)
    sums = np.concatenate([np.zeros(1, _U), np.cumsum(data * powers[np.arange(len(data)) - np.repeat(start, n)], dtype=_U)])
    found, owner = [_mix(sums[start + n] - sums[start] + n.astype(_U) * _P)], [np.arange(len(words))]
    for k in STEMS:
        at = np.flatnonzero(n > k)
        found.append(_mix((sums[start[at] + k] - sums[start[at]]) ^ _U(k * int(_B) % (1 << 64))))
        owner.append(at)
    owner = np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    return np.concatenate(found)[order].astype(np.int32), np.searchsorted(owner[order], np.arange(len(words) + 1))


class Words:
    """Hashed features of texts' distinct restored words: each word, and its beginnings of STEMS characters. Each
    distinct token is read once. Features that are not `used` (a mask) are left out."""

    def __init__(self, model: np.ndarray, used: np.ndarray | None = None):
        self.restorer, self.used = Restorer(model), used
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, tuple[int, ...]] = {}  # token: numbers of its readings
        self.numbers: dict[str, int] = {}
        self.flat, self.at = np.empty(0, np.int32), np.zeros(1, np.int64)

    def of_word(self, word: str) -> list[int]:
        return hashes([word])[0].tolist()

    def _number(self, word: str) -> int:
        return self.numbers.setdefault(word, len(self.numbers))

    def features(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(text, feature), texts ascending: one entry for each word of a text that has the feature."""
        if len(self.known) > REMEMBERED:
            self._forget()
        rows: list[set[int]] = []
        for text in texts:
            text = text.lower() if text else ""
            tokens = set(text.split())
            for t in tokens:
                if t not in self.known:
                    self.known[t] = tuple(self._number(w) for w in self.restorer.readings(t) if w)
            own = set(itertools.chain.from_iterable(map(self.known.__getitem__, tokens)))
            own.update(self._number(w) for m in _SPELT.finditer(text) if (w := self.restorer.decode(m[0], spelt=True)))
            rows.append(own)
        new = list(itertools.islice(self.numbers, len(self.at) - 1, None))
        if new:
            flat, at = hashes(new)
            if self.used is not None:
                keep = self.used[flat]
                flat, at = flat[keep], np.concatenate([[0], np.cumsum(keep)])[at]
            self.flat, self.at = np.concatenate([self.flat, flat]), np.concatenate([self.at, self.at[-1] + at[1:]])
        n = np.array([len(r) for r in rows], np.int64)
        words = np.fromiter(itertools.chain.from_iterable(rows), np.int64, int(n.sum()))
        size = self.at[words + 1] - self.at[words]
        place = np.repeat(self.at[words] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        return np.repeat(np.repeat(np.arange(len(texts)), n), size), self.flat[place]

    def __call__(self, text: str | None) -> list[int]:
        """Features of one text."""
        return self.features([text])[1].tolist()


def fit(row: np.ndarray, feature: np.ndarray, labels: np.ndarray, weights: np.ndarray, rounds: int = 200) -> tuple[dict[int, float], float]:
    """Logistic regression (Adam on the whole sample) on log2(1 + words that have a feature), over the features of at
    least LEAST documents: {feature: weight}, bias. row, feature: one entry for each word's feature, row ascending. Arrays
    of the entries are narrow, and made in blocks of documents where they have to be wide."""
    n = len(labels)
    cuts = np.searchsorted(row, np.append(np.arange(0, n, DOCUMENTS), n))
    blocks = []
    for a, b in zip(cuts, cuts[1:], strict=False):
        key, count = np.unique(row[a:b].astype(np.int64) << BITS | feature[a:b], return_counts=True)
        blocks.append(((key >> BITS).astype(np.int32), (key & ((1 << BITS) - 1)).astype(np.int32), np.log2(1 + count).astype(np.float32)))
    seen = sum(np.bincount(flat, minlength=1 << BITS) for _, flat, _ in blocks)
    used = np.flatnonzero(seen >= LEAST)
    place = np.full(1 << BITS, -1, np.int32)
    place[used] = np.arange(len(used))
    for k, (own, flat, value) in enumerate(blocks):
        keep = place[flat] >= 0
        blocks[k] = own[keep] - DOCUMENTS * k, place[flat[keep]], value[keep]
    w, b = np.zeros(len(used)), 0.0
    m, v = np.zeros(len(used) + 1), np.zeros(len(used) + 1)
    weights = weights / weights.sum()
    for step in range(1, rounds + 1):
        g = np.append(PENALTY * w, 0.0)
        for k, (own, col, value) in enumerate(blocks):
            at = slice(DOCUMENTS * k, min(DOCUMENTS * (k + 1), n))
            z = np.bincount(own, w[col] * value, at.stop - at.start) + b
            d = weights[at] * (1 / (1 + np.exp(-np.clip(z, -40, 40))) - labels[at])
            g[:-1] += np.bincount(col, d[own] * value, len(used))
            g[-1] += d.sum()
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        move = 0.08 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
        w, b = w - move[:-1], b - move[-1]
    return dict(zip(used.tolist(), w.tolist(), strict=True)), float(b)


def score(docs: DataFrame, labels: DataFrame, *, text_col: str = "text", id_col: str = "doc_id", label_col: str = "toxic", sample: int = SAMPLE) -> DataFrame:
    """docs with score. `labels` (id_col, label_col): the rows that may be learned from."""
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(language_model(trigram_counts(docs, text_col)))
    known = labels.select(F.col(id_col), F.col(label_col).cast("int").alias("y")).where(F.col(id_col).isNotNull() & F.col("y").isin(0, 1)).groupBy(id_col).agg(F.max("y").alias("y"))
    sizes = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(sizes) < 2:
        return docs.drop("score").withColumn("score", F.lit(0.0))
    spread = F.pmod(F.xxhash64(F.col(id_col), F.lit(23)), F.lit(1 << 30))
    chosen = known.where(spread < F.when(F.col("y") == 1, int(min(1, sample / sizes[1]) * (1 << 30)) + 1).otherwise(int(min(1, sample / sizes[0]) * (1 << 30)) + 1)).limit(3 * sample)

    def hashed():
        words = Words(model.value)
        return lambda batch: [[sorted(words(t)) for t in batch.column("__text").to_pylist()]]

    # The sample is bounded, so it may be broadcast to the one scan that picks its texts.
    picked = docs.select(id_col, F.col(text_col).alias("__text")).join(F.broadcast(chosen), id_col)
    rows = common.append_columns(picked, hashed, [T.StructField("words", T.ArrayType(T.IntegerType()))]).select(id_col, "y", "words").toArrow()
    order = np.argsort(rows.column(id_col).to_numpy(), kind="stable")
    y = rows.column("y").to_numpy()[order].astype(float)
    if len(set(y.tolist())) < 2:
        return docs.drop("score").withColumn("score", F.lit(0.0))
    words = rows.column("words").combine_chunks()
    words = words.take(pa.array(order))
    at = np.repeat(np.arange(len(y), dtype=np.int32), np.diff(words.offsets.to_numpy()))
    share = np.array([sizes[0] / max(1, (y == 0).sum()), sizes[1] / max(1, (y == 1).sum())])  # as frequent as before sampling
    fitted = spark.sparkContext.broadcast(fit(at, words.flatten().to_numpy(), y, share[y.astype(int)]))

    def scored():
        found, bias = fitted.value
        weight, used = np.zeros(1 << BITS), np.zeros(1 << BITS, bool)
        weight[list(found)], used[list(found)] = list(found.values()), True
        words = Words(model.value, used)

        def f(batch: pa.RecordBatch) -> list:
            texts, out = batch.column(text_col).to_pylist(), []
            for a, b in common.slices(texts, 1_000_000):
                row, feature = words.features(texts[a:b])
                key, n = np.unique(row << BITS | feature, return_counts=True)
                z = bias + np.bincount(key >> BITS, weight[key & ((1 << BITS) - 1)] * np.log2(1 + n), b - a)
                out += (1 / (1 + np.exp(-np.clip(z, -40, 40)))).tolist()
            return [out]

        return f

    return common.append_columns(docs, scored, FIELDS)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents").select("doc_id", "text")
    part = common.doc_bucket("doc_id", 5)
    found = score(docs, common.read(spark, sf_dir, "labels").select("doc_id", "toxic").where(part != 0))
    return found.select("doc_id", F.coalesce(part == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
