"""Helpers that the corpus operators share."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a local master (tests) gets
    a temporary folder; a cluster has none that all can read, so that is an error."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if named is None:
        current = sc._jsc.sc().getCheckpointDir()
        if current.isDefined():
            return current.get()
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="meteolith-")
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(named)
    return named


def materialise(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Write df as Parquet in the shared folder (a folder for each value of `by`) and read it again: cuts lineage,
    survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/t-{uuid.uuid4().hex}"
    (df.write.partitionBy(*by) if by else df.write).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._table_path = path
    if _SCOPES:
        _SCOPES[-1].append(out)
    return out


_SCOPES: list[list[DataFrame]] = []


@contextlib.contextmanager
def scope() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables materialised within are deleted at its end, except those passed to the function it gives."""
    _SCOPES.append([])
    kept: list[DataFrame] = []
    try:
        yield lambda df: kept.append(df) or df
    finally:
        made = _SCOPES.pop()
        if _SCOPES:
            _SCOPES[-1].extend(kept)
        for df in made:
            if not any(df is k for k in kept):
                release(df)


#: Most rows of a membership table, of 64 places each.
PLACES = 1 << 21


def maybe_in(df: DataFrame, key: Column, ids: DataFrame, id_key: Column, name: str = "__maybe") -> DataFrame:
    """df with a boolean: false only where the key is surely not among ids. A bitmap of hashes, 16 places for each id
    and PLACES rows at most, is broadcast; a fuller one is still right and only lets more rows pass."""
    words = 1 << min(PLACES.bit_length() - 1, max(6, (ids.count() // 4).bit_length()))
    place = lambda k: F.pmod(F.xxhash64(k, F.lit(29)), F.lit(64 * words))
    bits = ids.select(place(id_key).alias("p")).groupBy(F.shiftright("p", 6).alias("__word")).agg(F.expr("bit_or(shiftleft(1L, int(p & 63)))").alias("__bits"))
    out = df.withColumn("__place", place(key)).withColumn("__word", F.shiftright("__place", 6)).join(F.broadcast(materialise(bits)), "__word", "left")
    hit = F.expr("shiftright(__bits, int(__place & 63)) & 1") == 1
    return out.withColumn(name, F.coalesce(hit, F.lit(False))).drop("__place", "__word", "__bits")


def rows_in(df: DataFrame, column: str, ids: DataFrame) -> DataFrame:
    """Rows whose `column` is among ids (one column of that name): only they, and a few others, are shuffled."""
    return maybe_in(df, F.col(column), ids, F.col(column)).where("__maybe").drop("__maybe").join(ids, column, "left_semi")


def release(df: DataFrame) -> None:
    """Delete what materialise() wrote, once nothing reads it any more."""
    path = getattr(df, "_table_path", None)
    if path:
        jvm = df.sparkSession._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(p, True)


def _give_back() -> None:
    """Return freed memory to the system: an idle Python worker would hold it while the JVM runs the next stage."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not glibc
        pass


_KEPT: dict[str, object] = {}


def kept(name: str, make: Callable[[], object]) -> object:
    """An object that a worker process keeps from task to task, until it runs a task of another kind."""
    if name not in _KEPT:
        _KEPT[name] = make()
    return _KEPT[name]


def _forget_all_but(name: str) -> None:
    """What the worker kept for another stage goes back to the system at once, not when the next task ends."""
    if others := [k for k in _KEPT if k != name]:
        for other in others:
            del _KEPT[other]
        _give_back()


def map_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType | str, keeps: str = "") -> DataFrame:
    """mapInArrow, after which a worker gives its freed memory back; `keeps`: the name of what run() keeps."""

    def trimmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            _forget_all_but(keeps)
            yield from run(batches)
        finally:
            _give_back()

    return df.mapInArrow(trimmed, schema)


def append_columns(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], list]], fields: list[T.StructField], keeps: str = "") -> DataFrame:
    """df with further columns computed per Arrow batch; input columns of the same names are replaced.

    make() runs once per task and gives the function from a batch to the new columns' values; `keeps` as in map_arrow().
    """
    names = [f.name for f in fields]
    schema = T.StructType([f for f in df.schema.fields if f.name not in names] + fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        f = make()
        types = [x.type for x in to_arrow_schema(T.StructType(fields))]
        for batch in batches:
            new = [x if isinstance(x, pa.Array) else pa.array(x, t) for x, t in zip(f(batch), types, strict=True)]
            old = [c for c in batch.schema.names if c not in names]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in old), *new], names=[*old, *names])

    return map_arrow(df, run, schema, keeps)


def slices(texts: list[str | None], most: int) -> Iterator[tuple[int, int]]:
    """Row ranges of about `most` characters (a longer text alone)."""
    return ranges([len(t) if t else 0 for t in texts], most)


def ranges(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Ranges of places whose sizes add up to about `most` (a larger one alone)."""
    start = size = 0
    for i, n in enumerate(sizes):
        if size and size + n > most:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(sizes):
        yield start, len(sizes)


def doc_bucket(doc_id: Column | str, n: int) -> Column:
    """crc32 of the id as text, modulo n: the deterministic split used for held-out rows (null ids: null)."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary") if isinstance(doc_id, str) else doc_id.cast("string").cast("binary")) % n
