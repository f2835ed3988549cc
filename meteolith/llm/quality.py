"""Quality by perplexity under an interpolated modified Kneser-Ney model of character n-grams.

Trusted texts (label 1) give counts of n-grams up to ORDER characters; counts are summed, continued into lower orders
and joined with their contexts' totals in the cluster, sharded by n-gram, with three discounts for each order. One
trusted document in HELD, by hash of its id, is not counted: for each language the threshold is a quantile of the
perplexities of these, which the model has not seen. Every document's perplexity is the mean over all its characters.

The model is dealt over shards of about SHARD rows, at every size alike. Each shard is a broadcast of its own; a worker
gathers the distinct n-grams of a bounded stretch of texts, looks them up in one shard after another, holding one at a
time, and then interpolates. (Joining every document's n-grams with the shards instead would shuffle some ten bytes
for each character of the corpus.)

Defined edge cases: null and empty texts have no characters, perplexity null, and are not kept; null languages form a
group of their own; a language without held-back trusted documents gets the quantile over all of them; without any the
threshold is null and every text with characters is kept; repeated rows are scored alike; labels without an id are
ignored, conflicting labels of one id count as trusted.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

ORDER = 5
#: Bits of a character in an n-gram's key; rarer characters share the codes above 0x24F.
CHAR_BITS = 12
#: Quantile of the held-back trusted documents' perplexities; one trusted document in HELD is held back.
QUANTILE, HELD = 0.98, 4
#: Rows of a shard of the model, about; characters of texts whose n-grams are looked up at once.
SHARD, STRETCH = 1_000_000, 2_000_000
#: Width of the steps of ln perplexity in which quantiles are counted.
STEP = 0.0005
_SPACE = 32


def codes(text: str | None) -> np.ndarray:
    """Character codes of the lower-cased text, white space as single blanks, after ORDER - 1 leading blanks."""
    if not text or not (flat := " ".join(text.lower().split())):
        return np.empty(0, np.int64)
    cp = np.frombuffer(flat.encode("utf-32-le", "replace"), np.uint32).astype(np.int64)
    room = (1 << CHAR_BITS) - 0x250
    return np.concatenate([np.full(ORDER - 1, _SPACE), np.where(cp < 0x250, cp, 0x250 + cp % room)])


def grams(c: np.ndarray) -> np.ndarray:
    """Keys of the n-grams that end at each character."""
    n = len(c) - ORDER + 1
    if n <= 0:
        return np.empty(0, np.int64)
    key = np.zeros(n, np.int64)
    for i in range(ORDER):
        key = key << CHAR_BITS | c[i : i + n]
    return key


def count(texts: DataFrame, text_col: str) -> DataFrame:
    """key, c: n-gram counts of all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(0).to_pylist()
            for a, b in common.slices(column, 1_000_000):
                key, n = np.unique(np.concatenate([grams(codes(t)) for t in column[a:b]]), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(n)], names=["key", "c"])

    return common.map_arrow(texts.select(text_col), run, "key long, c long").groupBy("key").agg(F.sum("c").alias("c"))


def model(counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(order, key, p) and (order, ctx, gamma): interpolated probabilities of seen n-grams, weights of lower orders.

    Lower orders count the distinct characters before an n-gram. Each order joins its counts with its contexts' totals
    and with the probabilities of the order below, on keys that spread evenly."""
    spark = counts.sparkSession
    levels = {ORDER: common.materialise(counts)}
    for n in range(ORDER - 1, 0, -1):
        levels[n] = common.materialise(levels[n + 1].groupBy(F.col("key").bitwiseAND(F.lit((1 << CHAR_BITS * n) - 1)).alias("key")).agg(F.count(F.lit(1)).alias("c")))
    below = None
    probabilities, weights = [], []
    for n in range(1, ORDER + 1):
        t = levels[n].agg(*[F.sum(F.when(F.col("c") == i, 1).otherwise(0)).alias(f"n{i}") for i in range(1, 5)]).first()
        n1, n2, n3, n4 = (max(1, t[f"n{i}"] or 0) for i in range(1, 5))
        y = n1 / (n1 + 2 * n2)
        d = [min(max(x, 0.1), 2.9) for x in (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)]
        d = [min(d[0], 0.99), min(d[1], 1.99), d[2]]
        discount = F.when(F.col("c") == 1, d[0]).when(F.col("c") == 2, d[1]).otherwise(d[2])
        rows = levels[n].withColumn("ctx", F.shiftright("key", CHAR_BITS))
        ctx = rows.groupBy("ctx").agg(F.sum("c").alias("total"), F.sum(discount).alias("mass"))
        ctx = ctx.select("ctx", "total", (F.col("mass") / F.col("total")).alias("gamma"))
        rows = rows.join(ctx, "ctx").select("key", "gamma", ((F.col("c") - discount) / F.col("total")).alias("own"))
        if below is None:
            rows = rows.select("key", (F.col("own") + F.col("gamma") / float(1 << CHAR_BITS)).alias("p"))
        else:
            suffix = F.col("key").bitwiseAND(F.lit((1 << CHAR_BITS * (n - 1)) - 1))
            rows = rows.withColumn("suffix", suffix).join(below.select(F.col("key").alias("suffix"), F.col("p").alias("lower")), "suffix").select("key", (F.col("own") + F.col("gamma") * F.col("lower")).alias("p"))
        below = common.materialise(rows)
        probabilities.append(below.select(F.lit(n).alias("order"), "key", "p"))
        weights.append(ctx.select(F.lit(n).alias("order"), "ctx", "gamma"))
    empty = spark.createDataFrame([], "order int, key long, p double")
    union = lambda xs, e: functools.reduce(DataFrame.unionByName, xs, e)
    return union(probabilities, empty), common.materialise(union(weights, spark.createDataFrame([], "order int, ctx long, gamma double")))


def _shard(key: np.ndarray, shards: int) -> np.ndarray:
    return (key ^ (key >> 17) ^ (key >> 31)) % shards


def keyed(probabilities: DataFrame, weights: DataFrame) -> DataFrame:
    """key, value: n-grams' probabilities under (order << 60) + n-gram, contexts' weights under (6 << 60) + (order << 48) + context."""
    p = probabilities.select((F.shiftleft(F.col("order").cast("long"), 60) + F.col("key")).alias("key"), F.col("p").alias("value"))
    w = weights.select((F.lit(6 << 60) + F.shiftleft(F.col("order").cast("long"), 48) + F.col("ctx")).alias("key"), F.col("gamma").alias("value"))
    return p.unionByName(w)


def lookups(key: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each order, the distinct model keys of the n-grams' endings and contexts and where each n-gram finds its own."""
    out = []
    for n in range(1, ORDER + 1):
        own = key & ((1 << CHAR_BITS * n) - 1)
        out.append(np.unique((n << 60) + own, return_inverse=True))
        out.append(np.unique((6 << 60) + (n << 48) + (own >> CHAR_BITS), return_inverse=True))
    return out


def log_probabilities(key: np.ndarray, shards: list) -> np.ndarray:
    """ln p of distinct n-grams; shards: functions that give (sorted keys, values)."""
    wanted = lookups(key)
    found = [np.full(len(k), np.nan) for k, _ in wanted]
    of = [_shard(k, len(shards)) for k, _ in wanted]
    for s, load in enumerate(shards):
        keys, values = load()
        if not len(keys):
            continue
        for (k, _), out, own in zip(wanted, found, of, strict=True):
            at = np.flatnonzero(own == s)
            place = np.minimum(np.searchsorted(keys, k[at]), len(keys) - 1)
            hit = keys[place] == k[at]
            out[at[hit]] = values[place[hit]]
    p = np.full(len(key), 1.0 / (1 << CHAR_BITS))
    for n in range(ORDER):
        seen, gamma = (found[2 * n + i][wanted[2 * n + i][1]] for i in range(2))
        p = np.where(np.isnan(seen), np.where(np.isnan(gamma), 1.0, gamma) * p, seen)
    return np.log(p)


def share(table: DataFrame) -> list:
    """One broadcast of sorted keys and values for each shard of the model; the driver holds one at a time."""
    spark = table.sparkSession
    shards = (table.count() // SHARD) | 1
    k = F.col("key")
    own = (k.bitwiseXOR(F.shiftright(k, 17)).bitwiseXOR(F.shiftright(k, 31)) % shards).alias("shard")
    path = common.materialise(table.select("key", "value", own), by=["shard"])
    out = []
    for s in range(shards):
        t = path.where(F.col("shard") == s).select("key", "value").toArrow()
        keys, values = t.column("key").to_numpy(), t.column("value").to_numpy()
        at = np.argsort(keys)
        out.append(spark.sparkContext.broadcast((keys[at], values[at])))
    return out


def _loader(shared):
    def load():
        value = shared.value
        shared.__dict__.pop("_value", None)  # the next shard takes its place
        return value

    return load


def score(docs: DataFrame, text_col: str, shared: list) -> DataFrame:
    """docs with n (characters) and logp (their sum)."""
    from pyspark.sql import types as T

    def make():
        loaders = [_loader(s) for s in shared]

        def f(batch: pa.RecordBatch) -> list:
            column = batch.column(text_col).to_pylist()
            n, total = [], []
            for a, b in common.slices(column, STRETCH):
                parts = [grams(codes(t)) for t in column[a:b]]
                size = np.array([len(p) for p in parts])
                key, back = np.unique(np.concatenate(parts), return_inverse=True)
                sums = np.bincount(np.repeat(np.arange(len(parts)), size), log_probabilities(key, loaders)[back], len(parts)) if len(key) else np.zeros(len(parts))
                n += size.tolist()
                total += sums.tolist()
            return [n, total]

        return f

    return common.append_columns(docs, make, [T.StructField("n", T.LongType()), T.StructField("logp", T.DoubleType())])


def quantiles(values: DataFrame, by: list[str], q: float) -> DataFrame:
    """by, threshold: the upper edge of the step of ln perplexity in which the quantile lies. Steps are counted exactly
    and there are at most ln(2 ** CHAR_BITS) / STEP of them, so neither order nor size of the data matters."""
    steps = values.withColumn("__step", F.ceil(F.ln("perplexity") / STEP)).groupBy(*by, "__step").agg(F.count(F.lit(1)).alias("__n"))
    upto = Window.partitionBy(*by).orderBy("__step")
    steps = steps.withColumn("__upto", F.sum("__n").over(upto)).withColumn("__all", F.sum("__n").over(Window.partitionBy(*by)))
    return steps.where(F.col("__upto") >= q * F.col("__all")).groupBy(*by).agg(F.exp(F.min("__step") * STEP).alias("threshold"))


def classify(docs: DataFrame, trusted: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", quantile: float = QUANTILE, held: int = HELD) -> DataFrame:
    """id, lang, n_chars, perplexity, threshold, kept. `trusted`: the ids of trusted documents."""
    back = common.doc_bucket("id", held) == 0
    ids = common.materialise(trusted.select(F.col(id_col).alias("id")).where("id is not null").distinct())
    marked = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    probabilities, weights = model(count(common.rows_in(marked, "id", ids.where(~back)), "text"))
    scored = score(marked, "text", share(keyed(probabilities, weights)))
    scored = common.materialise(scored.select("id", "lang", F.col("n").alias("n_chars"), F.when(F.col("n") > 0, F.exp(-F.col("logp") / F.col("n"))).alias("perplexity")))
    own = common.materialise(scored.where("perplexity is not null").join(ids.where(back), "id", "left_semi").select("lang", "perplexity"))
    limits = quantiles(own, ["lang"], quantile).withColumnRenamed("lang", "__lang")
    overall = quantiles(own.withColumn("one", F.lit(1)), ["one"], quantile).select(F.col("threshold").alias("__overall"), F.lit(True).alias("__one"))
    out = scored.join(F.broadcast(overall), F.col("__one"), "left").join(limits, F.col("lang").eqNullSafe(F.col("__lang")), "left").withColumn("threshold", F.coalesce("threshold", "__overall"))
    return out.select("id", "lang", "n_chars", "perplexity", "threshold", F.coalesce(F.col("perplexity") <= F.col("threshold"), F.col("perplexity").isNotNull()).alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    trusted = common.read(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return classify(common.read(spark, sf_dir, "documents"), trusted).withColumnRenamed("id", "doc_id")
