"""Best-fit packing by sums of squares.

Every text becomes token ids plus a closing id 0. Texts longer than a sequence are cut into full pieces and one last
piece; full pieces fill a sequence of their own. The other pieces are dealt evenly over blocks of bounded size; within
a block they are placed, longest first, into open bins: of all residual gaps that fit, and a new bin where nothing
fits, the one is taken for which the sum over gaps of squared counts of open bins becomes smallest. Bins that stay
notably unfilled are then packed once more as a whole, in blocks again, so that cutting into blocks costs next to
nothing.

Defined edge cases: null and empty texts give one piece of length 1 (the closing id); null or repeated document ids
are pieces of their own; an empty table gives no pieces. Input columns other than id and text are not read.
"""

from __future__ import annotations

import itertools
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

SIZE = 2048
#: Pieces that one packing task gets.
BLOCK = 16_384
#: Distinct pre-tokens whose ids a worker remembers; beyond it the later half is forgotten (frequent ones come early).
REMEMBERED = 200_000
#: Bytes of text that a worker takes apart at once.
STRETCH = 500_000

PIECES = T.StructType([
    T.StructField("doc_id", T.LongType()),
    T.StructField("piece", T.IntegerType()),
    T.StructField("start", T.LongType()),
    T.StructField("length", T.LongType()),
    T.StructField("ids_crc32", T.LongType()),
])


#: Texts of these characters need no composition, and their pre-tokens are those of _PRE after lower-casing.
_PLAIN = re.compile(r"[\n\x20-\x7e\xa1-\u024f]*")
#: Fixed value: the tokenizer file's own splitting pattern, spelt out for the characters above.
_PRE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºÀ-ÖØ-öø-ɏ]+|[0-9²³¹¼½¾]|[^\sa-zªµºÀ-ÖØ-öø-ɏ0-9²³¹¼½¾]+")


class Encoder:
    """Token ids as little-endian bytes. A pre-token's ids depend on nothing around it, so each distinct one is encoded
    once by the tokenizer and remembered; joining the parts equals encoding the whole text. Texts with characters
    beyond Latin letters or with a special token's marks are instead cut at blanks and line ends only."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.last = np.array([t.endswith("</w>") for t, _ in sorted(self.tok.get_vocab().items(), key=lambda x: x[1])])
        self.known: dict[str, bytes] = {}
        self.chunks: dict[str, bytes] = {"": b""}

    def learn(self, new: list[str]) -> None:
        for i in range(0, len(new), 2000):
            some = new[i : i + 2000]
            ids = np.array(self.tok.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, "<u4")
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) != len(some):  # never seen; then one by one
                self.known.update((s, np.array(self.tok.encode(s, add_special_tokens=False).ids, "<u4").tobytes()) for s in some)
                continue
            raw, a = ids.tobytes(), 0
            for s, e in zip(some, (4 * ends).tolist(), strict=True):
                self.known[s] = raw[a:e]
                a = e

    def odd(self, text: str) -> bytes:
        parts = text.replace("\n", " ").split(" ")
        if len(self.chunks) > REMEMBERED // 4:
            self.chunks = {"": b""}
        new = list({p for p in parts if p not in self.chunks})
        for i in range(0, len(new), 2000):
            some = new[i : i + 2000]
            for s, e in zip(some, self.tok.encode_batch_fast(some, add_special_tokens=False), strict=True):
                self.chunks[s] = np.array(e.ids, "<u4").tobytes()
        return b"".join([self.chunks[p] for p in parts])

    def encode(self, texts: list[str | None]) -> list[bytes]:
        if len(self.known) > REMEMBERED:
            self.known = dict(itertools.islice(self.known.items(), REMEMBERED // 2))
        plain = [_PRE.findall(t.lower()) if t and _PLAIN.fullmatch(t) and "<|" not in t else None for t in texts]
        self.learn([p for p in set().union(*filter(None, plain)) if p not in self.known])
        get = self.known.__getitem__
        return [(b"".join(map(get, ps)) if ps is not None else self.odd(t) if t else b"") + b"\0\0\0\0" for ps, t in zip(plain, texts, strict=True)]


def cut(ids: bytes, size: int = SIZE) -> list[tuple[int, int, int, int]]:
    """(piece, start, length, crc32) of a document's ids."""
    n = len(ids) // 4
    return [(k, s, min(size, n - s), zlib.crc32(ids[4 * s : 4 * (s + size)])) for k, s in enumerate(range(0, n, size))]


def tokenise(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = common.kept(f"encoder {path}", lambda: Encoder(path))
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_pylist()
            for a, b in common.ranges(sizes, STRETCH):
                ids, texts = (c.slice(a, b - a).to_pylist() for c in batch.columns)
                rows = [(i, *x) for i, e in zip(ids, enc.encode(texts), strict=True) for x in cut(e, size)]
                cols = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=PIECES.names)

    return common.map_arrow(docs.select(F.col(id_col).cast("long"), text_col), run, PIECES, keeps=f"encoder {path}")


def sum_of_squares(lengths: np.ndarray, size: int = SIZE) -> tuple[np.ndarray, np.ndarray]:
    """Bin number and offset of each item; items are taken longest first, ties in the given order."""
    count = np.zeros(size + 1, np.int64)  # open bins by residual gap; gaps 0 and `size` are not counted
    stacks: list[list[int]] = [[] for _ in range(size + 1)]
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    made = 0
    largest = 0
    for i in np.argsort(-lengths, kind="stable"):
        s = int(lengths[i])
        # Moving a bin from gap g to g - s changes the sum of squares by 2 (N[g-s] - N[g]) + 2, or 1 - 2 N[s] if it closes.
        g = -1
        if largest >= s:
            have = count[s : largest + 1]
            change = 2 * (count[: largest + 1 - s] - have) + 2
            change[0] = 1 - 2 * have[0]
            change[have == 0] = 1 << 60
            k = int(change.argmin())
            if have[k]:
                g = s + k
        if g < 0:
            g, b = size, made
            made += 1
        else:
            b = stacks[g].pop()
            count[g] -= 1
        bins[i], offsets[i] = b, size - g
        if rest := g - s:
            stacks[rest].append(b)
            count[rest] += 1
            largest = max(largest, rest)
        while largest and not count[largest]:
            largest -= 1
    return bins, offsets


PLACED = T.StructType([
    T.StructField("n", T.LongType()),
    T.StructField("block", T.LongType()),
    T.StructField("bin", T.LongType()),
    T.StructField("offset", T.LongType()),
])


def place(items: DataFrame, blocks: int, size: int) -> DataFrame:
    """items (n, length) dealt evenly over blocks and packed there: n, block, bin, offset."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [[c.to_numpy(zero_copy_only=False) for c in b.columns] for b in batches]
        if not got:
            return
        n, length, block = map(np.concatenate, zip(*got, strict=True))
        order = np.lexsort((n, block))
        n, length, block = n[order], length[order], block[order]
        starts = np.flatnonzero(np.r_[True, block[1:] != block[:-1]]) if len(block) else []
        for a, b in zip(starts, [*starts[1:], len(block)], strict=True):
            bins, offsets = sum_of_squares(length[a:b], size)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (n[a:b], block[a:b], bins, offsets)], names=PLACED.names)

    dealt = items.select("n", "length", F.pmod(F.xxhash64("n"), F.lit(blocks)).alias("block"))
    return common.map_arrow(dealt.repartition(blocks, "block"), run, PLACED)


def pack(docs: DataFrame, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, block: int = BLOCK) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    # Row numbers are written down with the rows: made on a read, they would change with how the read is split.
    pieces = common.materialise(tokenise(docs, tokenizer_path, id_col=id_col, text_col=text_col, size=size).withColumn("n", F.monotonically_increasing_id()))
    small = pieces.where(F.col("length") < size).select("n", "length")
    first = common.materialise(place(small, max(1, -(-small.count() // block)), size).join(small, "n"))
    # Bins left with a notable gap become items of a second round, in blocks of the same size.
    fill = first.groupBy("block", "bin").agg(F.sum("length").alias("length"))
    loose = common.materialise(fill.where(F.col("length") < size - size // 64).withColumn("n", F.monotonically_increasing_id()))
    again = place(loose.select("n", "length"), max(1, -(-loose.count() // block)), size)
    moved = loose.select("n", "block", "bin").join(again.select("n", F.col("block").alias("to"), F.col("bin").alias("to_bin"), F.col("offset").alias("shift")), "n").drop("n")
    number = lambda kind, b, k: F.lit(kind).cast("long") + 4 * (F.shiftleft(b, 31) + k)
    put = (
        first.join(moved, ["block", "bin"], "left")
        .select(
            "n",
            F.when(F.col("to").isNull(), number(1, F.col("block"), F.col("bin"))).otherwise(number(2, F.col("to"), F.col("to_bin"))).alias("sequence_id"),
            (F.col("offset") + F.coalesce("shift", F.lit(0))).alias("offset"),
        )
    )
    full = pieces.where(F.col("length") == size).select(*PIECES.names, (4 * F.col("n")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return full.unionByName(pieces.join(put, "n").select(*PIECES.names, "sequence_id", "offset"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(common.read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
