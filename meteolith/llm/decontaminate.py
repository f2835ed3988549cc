"""Benchmark decontamination with one Aho-Corasick automaton over normalised benchmark windows.

Normalisation lower-cases A-Z and keeps digits, letters and everything outside ASCII as words; the rest separates.
A benchmark item gives every run of `width` consecutive words (an item of fewer words: itself). The automaton holds
those windows, blank-delimited, and each text is scanned once; matches are mapped back to words and to character
offsets of the original text.

Defined edge cases: null and empty texts and texts without words have no words and no hits; items without words give
no window; an item without an id marks words but is not counted as an item; repeated items count once; columns of the
input are kept, those named like a result column are replaced. With an empty benchmark nothing is hit.
"""

from __future__ import annotations

import hashlib
import re
import uuid

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

WIDTH = 10
#: Window text that one automaton may hold; a larger benchmark is scanned in several blocks.
BLOCK_BYTES = 32 << 20
#: Fixed value of the word class: ASCII characters that separate words.
SEPARATORS = bytes([*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
_TABLE = bytes.maketrans(SEPARATORS + bytes(range(0x41, 0x5B)), b" " * len(SEPARATORS) + bytes(range(0x61, 0x7B)))
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")

SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
FIELDS = [
    T.StructField("n_words", T.LongType()),
    T.StructField("hit_words", SPANS),
    T.StructField("spans", SPANS),
    T.StructField("items", T.ArrayType(T.StringType())),
]


def words(text: str | None) -> list[bytes]:
    """Normalised words as UTF-8 bytes."""
    return text.encode("utf-8", "replace").translate(_TABLE).split() if text else []


def windows(text: str | None, width: int = WIDTH) -> list[tuple[str, int]]:
    """Blank-delimited windows of an item and their word counts; bytes are held as Latin-1 characters."""
    ws = words(text)
    if not ws:
        return []
    k = min(width, len(ws))
    return [(f" {b' '.join(ws[i : i + k]).decode('latin-1')} ", k) for i in range(len(ws) - k + 1)]


def blocks(benchmark: DataFrame, text_col: str, id_col: str, width: int, block_bytes: int):
    """The benchmark's windows, streamed from the cluster and cut into blocks of bounded size: {window: (k, ids)}."""
    block: dict[str, tuple[int, set]] = {}
    size = 0
    for row in benchmark.select(F.col(id_col).cast("string").alias("i"), F.col(text_col).alias("t")).dropDuplicates().toLocalIterator():
        for w, k in windows(row["t"], width):
            ids = block.setdefault(w, (k, set()))[1]
            if row["i"] is not None:
                ids.add(row["i"])
            size += len(w) + 16
        if size > block_bytes:
            yield block
            block, size = {}, 0
    if block:
        yield block


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def automaton(shared) -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for w, (k, ids) in shared.value.items():
        a.add_word(w, (len(w), k, tuple(ids)))
    if len(a):
        a.make_automaton()
    return a


def scan(a: ahocorasick.Automaton, text: str | None) -> tuple[int, list, list, list]:
    """n_words, hit word ranges, their character ranges in the original text, sorted item ids."""
    ws = words(text)
    if not ws or not len(a):
        return len(ws), [], [], []
    flat = f" {b' '.join(ws).decode('latin-1')} "
    found = list(a.iter(flat))
    if not found:
        return len(ws), [], [], []
    gaps = np.flatnonzero(np.frombuffer(flat.encode("latin-1"), np.uint8) == 32)
    ids: set[str] = set()
    hit = []
    for end, (n, k, own) in found:
        first = int(np.searchsorted(gaps, end - n + 1))
        hit.append((first, first + k))
        ids.update(own)
    hit = merge(hit)
    at = [m.span() for m in _WORD.finditer(text)]
    return len(ws), hit, [(at[i][0], at[j - 1][1]) for i, j in hit], sorted(ids)


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_text: str = "text", item_id: str = "item_id", width: int = WIDTH, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs with n_words, hit_words (word ranges), spans (character ranges of the original) and items.

    A benchmark is a bounded test set; its windows are still measured, and beyond `block_bytes` further automata scan
    the same rows in turn, so that no worker holds more than one block.
    """
    spark = docs.sparkSession
    shared = [spark.sparkContext.broadcast({w: (k, sorted(i)) for w, (k, i) in b.items()}) for b in blocks(benchmark, item_text, item_id, width, block_bytes)] or [spark.sparkContext.broadcast({})]
    out = docs
    for n, one in enumerate(shared):
        key = f"automaton {uuid.uuid4().hex}"

        def make(one=one, key=key, again=n > 0):
            a = common.kept(key, lambda: automaton(one))  # built once in each Python worker for each block

            def f(batch: pa.RecordBatch) -> list:
                rows = [scan(a, t) for t in batch.column(text_col).to_pylist()]
                if again:
                    before = zip(*(batch.column(x.name).to_pylist() for x in FIELDS), strict=True)
                    rows = [
                        (r[0], merge(r[1] + [(s["start"], s["end"]) for s in b[1]]), r[2] + [(s["start"], s["end"]) for s in b[2]], sorted({*r[3], *b[3]}))
                        for r, b in zip(rows, before, strict=True)
                    ]
                spans = lambda x: [{"start": i, "end": j} for i, j in x]
                return [[r[0] for r in rows], [spans(r[1]) for r in rows], [spans(merge(r[2])) for r in rows], [r[3] for r in rows]]

            return f

        out = common.append_columns(out, make, FIELDS, keeps=key)
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate(docs, common.read(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("hit_words", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


_NORMAL = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
SQL = f"""
WITH d AS (SELECT doc_id, {_NORMAL} AS w FROM documents),
b AS (SELECT item_id, {_NORMAL} AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(len(w), {WIDTH}) AS k, array_to_string(w[i:i + {WIDTH - 1}], ' ') AS g
        FROM b, unnest(range(1, greatest(len(w) - {WIDTH - 1}, 1) + 1)) AS t(i) WHERE len(w) > 0),
grams AS (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS g
          FROM d, (SELECT DISTINCT k FROM win) AS ks, unnest(range(1, len(w) - k + 2)) AS t(i) WHERE len(w) >= k),
m AS (SELECT doc_id, k, i, item_id FROM grams JOIN win USING (k, g)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM m, unnest(range(i, i + k)) AS u(p) GROUP BY doc_id),
ids AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item_id, ',' ORDER BY item_id)) AS h
        FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item_id FROM m) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       coalesce(h, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN ids USING (doc_id)
"""
