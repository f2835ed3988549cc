"""Near-duplicate grouping with SuperMinHash signatures.

A document's set holds its distinct runs of `k` words (with fewer words: the whole sequence as one); words are what
stands between ASCII white space, with A-Z lower-cased. Every element of a set walks through a random permutation of
the signature's places; in step j it offers the value j + r at its j-th place. Elements of a batch walk in step, and a
set stops at the first step after which none of its places can become smaller: long texts after one or two.

Documents with equal sets are one class with a number of its own, so rows that share an id but not the text stay apart.
Classes are bucketed by bands of four places, as many bands as make a missed pair at the threshold less likely than
MISS. In each bucket every class is linked with the bucket's smallest one; links are confirmed on full sets, read again
from the texts. Buckets whose classes are then still in several components are gone through once more, for every pair
across components, except pairs that cannot meet the threshold, as lower bounds of their symmetric difference show
(elements that no other open class has, differing distances to the smallest class, differing parities of hashed
elements): so no pair within a bucket is left out, yet a group of copies never makes all its pairs.

A bucket's rows are dealt over all tasks by a salt: statistics are made by (bucket, salt) first, and what holds for the
bucket comes back by (bucket, salt). Pairs are compared in blocks of BLOCK rows of a bucket. Of the texts only those
are shuffled that a bitmap of the wanted rows lets through.

Defined edge cases: null texts, empty texts and texts without words have the empty set and are linked with nothing;
rows without an id take no part (component null, kept); repeated rows share their component; rows with one id and
different texts are documents of their own, whose component may be the same id; columns other than id and text are not
read.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, graph

#: Default shingle length and similarity (in hundredths).
WORDS, PERCENT = 5, 80
ROWS = 4
#: Rows of a bucket that one task compares with the others.
BLOCK = 256
#: Places of the parity sketch that bounds symmetric differences.
PARITY = 2048
#: Largest chance that a pair exactly at the threshold shares no bucket.
MISS = 1e-6

_U = np.uint64
_P, _A, _B, _C = _U(0x9E3779B97F4A7C15), _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB), _U(0xD6E8FEB86659FD93)
_P_INVERSE = _U(pow(int(_P), -1, 1 << 64))
_SET_BITS = _U(12)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _A
    x = (x ^ (x >> _U(27))) * _B
    return x ^ (x >> _U(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, _P, _U), np.full(n, _P_INVERSE, _U)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words, and how many words the texts before each text have (one entry more than texts)."""
    raw = [t.encode("utf-8", "replace").lower() if t else b"" for t in texts]
    data = np.frombuffer(b" " + b" ".join(raw) + b" ", np.uint8)
    space = (data == 32) | ((data >= 9) & (data <= 13))
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    start, end = edge[0::2], edge[1::2]
    up, down = _powers(len(data) + 1)
    total = np.empty(len(data) + 1, _U)
    total[0] = 0
    np.cumsum((data.astype(_U) + _U(1)) * up[: len(data)], out=total[1:])
    first = np.cumsum([1, *(len(r) + 1 for r in raw)])
    return mix((total[end] - total[start]) * down[start] + (end - start).astype(_U) * _C), np.searchsorted(start, first)


def shingles(texts: list[str | None], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct 52-bit shingle ids of at most 4096 texts, text by text, and where each text's begin."""
    h, at = word_hashes(texts)
    n = np.diff(at)
    doc = np.repeat(np.arange(len(texts)), n)
    if len(h) >= k:
        s = np.zeros(len(h) - k + 1, _U)
        for i in range(k):
            s = mix(s * _P + h[i : i + len(s)] + _C)
        keep = doc[k - 1 :] == doc[: len(s)]
        s, of = s[keep], doc[: len(s)][keep]
    else:
        s, of = np.empty(0, _U), np.empty(0, np.int64)
    short = np.flatnonzero((n > 0) & (n < k))
    if len(short):
        one = np.array([functools.reduce(lambda a, x: mix(a * _P + x + _B), h[at[d] : at[d + 1]], np.full(1, n[d], _U))[0] for d in short], _U)
        s, of = np.concatenate([s, one]), np.concatenate([of, short])
    key = np.unique((of.astype(_U) << (_U(64) - _SET_BITS)) | (s >> _SET_BITS))
    owner = key >> (_U(64) - _SET_BITS)
    return key & _U((1 << 52) - 1), np.searchsorted(owner, np.arange(len(texts) + 1, dtype=_U))


def signatures(ids: np.ndarray, at: np.ndarray, m: int) -> np.ndarray:
    """SuperMinHash: one row of m values for each set ids[at[i]:at[i+1]] (an empty set: all ones)."""
    docs = len(at) - 1
    sig = np.full(docs * m, ~_U(0), _U)
    seed, doc = mix(ids * _P + _A), np.repeat(np.arange(docs), np.diff(at))
    perm = None
    for j in range(m):
        draw = mix(seed + _U(j * int(_C) % (1 << 64)))
        k = j + (draw & _U(0xFFFFFFFF)) % _U(m - j)
        k = k.astype(np.int64)
        if perm is None:
            place = k
        else:
            row = np.arange(len(k))
            place = perm[row, k].astype(np.int64)
            perm[row, k] = perm[:, j]
        np.minimum.at(sig, doc * m + place, (_U(j) << _U(32)) | (draw >> _U(32)))
        if j < 4 or j % 8 == 0:
            worst = sig.reshape(docs, m).max(axis=1)
            live = (worst >= _U(j + 1) << _U(32))[doc]
            if not live.any():
                break
            if perm is None:
                k = k[live]
                perm = np.tile(np.arange(m, dtype=np.uint8), (len(k), 1))
                perm[np.arange(len(k)), k] = 0
                seed, doc = seed[live], doc[live]
            elif not live.all():
                seed, doc, perm = seed[live], doc[live], perm[live]
    return sig.reshape(docs, m)


def bands_for(percent: int) -> int:
    return min(63, math.ceil(math.log(MISS) / math.log1p(-((percent / 100) ** ROWS))))


def _slices(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    for a, b in common.slices(texts, 1_000_000):
        for i in range(a, b, 1024):
            yield i, min(b, i + 1024)


def sketch(docs: DataFrame, id_col: str, text_col: str, k: int, bands: int) -> DataFrame:
    """id, h (hash of the text), n (set size), s1 and s2 (fingerprint of the set), bands (bucket keys; none for an empty
    set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).to_pylist()
            for a, b in _slices(texts):
                ids, at = shingles(texts[a:b], k)
                n = np.diff(at)
                sig = signatures(ids, at, bands * ROWS)
                parts = sig.reshape(b - a, bands, ROWS)
                key = np.full((b - a, bands), _C, _U) + np.arange(bands, dtype=_U)
                for r in range(ROWS):
                    key = mix(key * _P + parts[:, :, r])
                sums = np.concatenate([[_U(0)], np.cumsum(mix(ids), dtype=_U)])
                sums2 = np.concatenate([[_U(0)], np.cumsum(mix(ids ^ _A) * _P, dtype=_U)])
                keys = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.where(n > 0, bands, 0))]).astype(np.int32)), pa.array(key[n > 0].ravel().view(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(n.astype(np.int64)), pa.array((sums[at[1:]] - sums[at[:-1]]).view(np.int64)), pa.array((sums2[at[1:]] - sums2[at[:-1]]).view(np.int64)), keys],
                    names=["id", "h", "n", "s1", "s2", "bands"],
                )

    return common.map_arrow(_rows(docs, id_col, text_col), run, "id long, h long, n long, s1 long, s2 long, bands array<long>")


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, h, text: a row is known by its id and the hash of its text."""
    return docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.col(text_col)).alias("h"), F.col(text_col).alias("text"))


def confirm(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """pairs (a, b) with the size of their symmetric difference and whether they meet the threshold; the pairs of a class with very many
    partners are independent rows, which the join may split."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            texts = [*batch.column(2).to_pylist(), *batch.column(3).to_pylist()]
            first = {i: n for n, i in enumerate([*a, *b])}  # each text once
            rows = list(first.values())
            sets: dict[int, np.ndarray] = {}
            for x, y in _slices([texts[r] for r in rows]):
                ids, at = shingles([texts[r] for r in rows[x:y]], k)
                for j, r in enumerate(rows[x:y]):
                    sets[r] = ids[at[j] : at[j + 1]]
            both = np.empty(len(a), np.int64)
            for n, (i, j) in enumerate(zip(a, b, strict=True)):
                merged = np.concatenate([sets[first[i]], sets[first[j]]])
                merged.sort(kind="stable")
                both[n] = (merged[1:] == merged[:-1]).sum()
            size = np.array([[len(sets[first[i]]), len(sets[first[j]])] for i, j in zip(a, b, strict=True)], np.int64).reshape(-1, 2).sum(axis=1)
            union = size - both
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(size - 2 * both), pa.array(100 * both >= percent * union)], names=["a", "b", "apart", "linked"])

    one = texts.select(F.col("id").alias("a"), F.col("text").alias("ta"))
    two = texts.select(F.col("id").alias("b"), F.col("text").alias("tb"))
    return common.map_arrow(pairs.join(one, "a").join(two, "b").select("a", "b", "ta", "tb"), run, "a long, b long, apart long, linked boolean")


def lone(texts: DataFrame, k: int) -> DataFrame:
    """class, lone: how many elements of each text's set are in no other of these texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, own = batch.column(1).to_pylist(), batch.column(0).to_numpy()
            for a, b in _slices(texts):
                ids, at = shingles(texts[a:b], k)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(own[a:b], np.diff(at))), pa.array(ids.view(np.int64))], names=["class", "e"])

    elements = common.map_arrow(texts.select("id", "text"), run, "class long, e long")
    once = elements.groupBy("e").agg(F.count(F.lit(1)).alias("c"), F.min("class").alias("class")).where("c = 1")
    return once.groupBy("class").agg(F.count(F.lit(1)).alias("lone"))


def parities(texts: DataFrame, k: int) -> DataFrame:
    """class, odd: for each of PARITY places, whether an odd number of the set's elements hash there. Every place in
    which two sets differ takes an element of their symmetric difference, so differing places bound its size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in _slices(texts):
                ids, at = shingles(texts[a:b], k)
                owner = np.repeat(np.arange(b - a), np.diff(at))
                count = np.bincount(owner * PARITY + (mix(ids ^ _B) % _U(PARITY)).astype(np.int64), minlength=(b - a) * PARITY)
                bits = np.packbits((count & 1).astype(np.uint8)).view(np.int64)
                words = PARITY // 64
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.ListArray.from_arrays(pa.array(np.arange(0, words * (b - a) + 1, words, dtype=np.int32)), pa.array(bits))], names=["class", "odd"])

    return common.map_arrow(texts.select("id", "text"), run, "class long, odd array<long>")


def _of_bucket(rows: DataFrame, stats: dict[str, tuple[str, str]], where: str) -> DataFrame:
    """rows (with key, salt) and statistics of their buckets, of buckets where a condition on them holds. No task gets
    a whole bucket: rows meet by (key, salt), and of a bucket at most one row for each salt meets by key."""
    part = rows.groupBy("key", "salt").agg(*[getattr(F, f)(c).alias(name) for name, (f, c) in stats.items()])
    whole = part.groupBy("key").agg(*[getattr(F, "sum" if f == "count" else f)(name).alias(name) for name, (f, _) in stats.items()]).where(where)
    return rows.join(part.select("key", "salt").join(whole, "key"), ["key", "salt"])


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", k: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """id, h (hash of the text), n_shingles, component (smallest id reachable), kept (whether the row's id and text are
    the first of its component): one row for each input row."""
    bands = bands_for(percent)
    salts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sketches = common.materialise(sketch(docs, id_col, text_col, k, bands))
    own = F.struct("id", "h")
    classes = sketches.where("n > 0 and id is not null").groupBy("n", "s1", "s2").agg(F.min(own).alias("low"), F.min_by("bands", own).alias("bands"))
    classes = common.materialise(classes.withColumn("class", F.monotonically_increasing_id()))
    members = classes.select("class", F.pmod(F.xxhash64("class"), F.lit(salts)).alias("salt"), F.posexplode("bands").alias("band", "key"))
    members = common.materialise(_of_bucket(members, {"head": ("min", "class"), "size": ("count", "class")}, "size > 1"))
    pairs = common.materialise(members.where("class <> head").select(F.col("class").alias("a"), F.col("head").alias("b")).distinct())
    wanted = pairs.select(F.col("a").alias("class")).union(pairs.select(F.col("b").alias("class"))).distinct()
    wanted = common.materialise(classes.select("class", "low.id", "low.h").join(wanted, "class", "left_semi"))
    row = F.xxhash64("id", "h")
    texts = common.maybe_in(_rows(docs, id_col, text_col), row, wanted, row).where("__maybe").join(wanted, ["id", "h"]).dropDuplicates(["id", "h"])
    texts = common.materialise(texts.select(F.col("class").alias("id"), "text"))
    stars = common.materialise(confirm(pairs, texts, k, percent))
    labels = graph.components(stars.where("linked"))

    # Buckets that still hold several components: every pair across them that can still meet the threshold, once.
    label = F.coalesce("v", "class")
    several = {"lo": ("min", "label"), "hi": ("max", "label"), "low": ("min", "n"), "size": ("count", "n")}
    sized = members.drop("size").join(classes.select("class", "n"), "class").join(labels.withColumnRenamed("u", "class"), "class", "left").withColumn("label", label).drop("v")
    rest = common.materialise(_of_bucket(sized, several, "lo <> hi").drop("lo", "hi", "size"))
    open_texts = common.materialise(texts.join(rest.select(F.col("class").alias("id")).distinct(), "id", "left_semi"))
    # Elements that no other open class has are in no intersection; m bounds the intersection with any class here.
    rest = rest.join(lone(open_texts, k), "class", "left").withColumn("m", F.col("n") - F.coalesce("lone", F.lit(0)))
    able = lambda a, b, m: F.lit(100) * m >= F.lit(percent) * (a + b - m)
    rest = rest.where(able(F.col("n"), F.greatest("low", "m"), F.col("m"))).drop("low")
    # Sizes of symmetric differences are a metric: they to the bucket's head can differ by no more than the pair's own.
    rest = rest.join(stars.select(F.col("a").alias("class"), F.col("b").alias("head"), "apart"), ["class", "head"], "left").withColumn("apart", F.coalesce("apart", F.lit(0)))
    rest = _of_bucket(common.materialise(rest), several, "lo <> hi").withColumn("blocks", F.ceil(F.col("size") / BLOCK))
    rest = common.materialise(rest.join(classes.select("class", "bands"), "class").join(parities(open_texts, k), "class"))
    left = rest.select("key", F.pmod(F.xxhash64("class", F.lit(3)), "blocks").alias("block"), F.col("class").alias("a"), F.col("label").alias("la"), F.col("n").alias("na"), F.col("m").alias("ma"), F.col("apart").alias("da"), F.col("bands").alias("ba"), F.col("odd").alias("oa"), "band")
    right = rest.select("key", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), F.col("class").alias("b"), F.col("label").alias("lb"), F.col("n").alias("nb"), F.col("m").alias("mb"), F.col("apart").alias("db"), F.col("bands").alias("bb"), F.col("odd").alias("ob"))
    # A pair at the threshold differs in (1 - t) / (1 + t) of both sizes at most; elements of no other class all differ.
    least = F.greatest(F.abs(F.col("da") - F.col("db")), F.col("na") - F.col("ma") + F.col("nb") - F.col("mb"))
    differing = sum((F.bit_count(F.col("oa")[i].bitwiseXOR(F.col("ob")[i])) for i in range(1, PARITY // 64)), F.bit_count(F.col("oa")[0].bitwiseXOR(F.col("ob")[0])))
    least = F.greatest(least, differing)
    close = least * (100 + percent) <= F.lit(100 - percent) * (F.col("na") + F.col("nb"))
    # A pair that shares several buckets stands in the first of them.
    first = F.expr("NOT exists(slice(zip_with(ba, bb, (x, y) -> x = y), 1, band), e -> e)")
    across = left.join(right, ["key", "block"]).where((F.col("la") < F.col("lb")) & able(F.col("na"), F.col("nb"), F.least("ma", "mb")) & close & first).select("a", "b").distinct()
    known = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    across = across.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().join(known, ["a", "b"], "left_anti")
    more = confirm(across, texts, k, percent).where("linked").select("a", "b")
    joined = common.materialise(more.unionByName(labels.select(F.col("u").alias("a"), F.col("v").alias("b"))))
    labels = graph.components(joined)

    named = classes.select("n", "s1", "s2", "low", "class").join(labels.withColumnRenamed("u", "class"), "class", "left").withColumn("root", label)
    owner = common.materialise(named.join(named.groupBy("root").agg(F.min("low").alias("first")), "root").select("n", "s1", "s2", "first"))
    for made in (members, pairs, wanted, texts, stars, open_texts, rest, joined):
        common.release(made)
    found = sketches.select("id", "h", "n", "s1", "s2").join(owner, ["n", "s1", "s2"], "left")
    there = F.col("id").isNotNull() & F.col("first").isNotNull()
    kept = ~there | ((F.col("id") == F.col("first.id")) & (F.col("h") == F.col("first.h")))
    return found.select("id", "h", F.col("n").alias("n_shingles"), F.coalesce(F.when(there, F.col("first.id")), "id").alias("component"), F.coalesce(kept, F.lit(True)).alias("kept"))


def deduplicated(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", k: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """docs with one row of each group of near duplicates: the smallest id's, and of several rows that share it, one.
    Rows without an id or without words stay. Only rows that go or are repeated are shuffled."""
    found = common.materialise(near_duplicates(docs, id_col=id_col, text_col=text_col, k=k, percent=percent))
    some = found.where("id is not null and n_shingles > 0").groupBy(F.col("id").alias("__id"), F.col("h").alias("__h"))
    marks = common.materialise(some.agg(F.bool_or("kept").alias("__kept"), F.count(F.lit(1)).alias("__n")).where("not __kept or __n > 1").drop("__n"))
    row = F.xxhash64("__id", "__h")
    df = docs.withColumns({"__id": F.col(id_col).cast("long"), "__h": F.xxhash64(F.col(text_col))})
    df = common.maybe_in(df, row, marks, row)
    met = df.where("__maybe").join(marks, ["__id", "__h"], "left")
    out = df.where("not __maybe").select(docs.columns).unionByName(met.where("__kept is null").select(docs.columns))
    return out.unionByName(met.where("__kept").dropDuplicates(["__id", "__h"]).select(docs.columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(common.read(spark, sf_dir, "documents"), k=3, percent=85)
    return found.select(F.col("id").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"), (F.col("id") == F.col("component")).alias("kept"))


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS g FROM w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS t(i) WHERE len(w) > 0),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS MATERIALIZED (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b),
m AS (SELECT a, min(b) AS lo FROM r GROUP BY a)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(w.doc_id, coalesce(lo, w.doc_id)) AS component_id, w.doc_id = least(w.doc_id, coalesce(lo, w.doc_id)) AS kept
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN m ON m.a = w.doc_id
"""
