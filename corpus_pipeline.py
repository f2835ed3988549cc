"""The corpus pipeline: language ID, near-duplicate removal, decontamination, redaction, packing.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame, which is written as Parquet and read again as the next
stage's docs. All but the last give the columns of documents. The language stage rejects rows without a language (null
or without a letter); a low score alone rejects nothing, as short and code-switched texts have one too. The
near-duplicate stage keeps one row of each group, of the smallest id (rows without an id stay); decontamination
drops documents that hold a window of a benchmark item; redaction puts kinds in place of personal data; packing gives
pieces with their places in sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meteolith.llm import common, decontaminate, language, minhash, packing, pii

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Bytes of text that go to a Python worker at once. Executor and worker hold several copies of a batch each, and a
#: Spark of many stages has little memory left beside its heap; results don't depend on it.
BATCH_BYTES = 4 << 20


def in_small_batches(spark: SparkSession) -> None:
    """Holds for the session from now on, as a stage's result is computed after the stage's function has returned."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    most = spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch()
    if not 0 < most <= BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def by_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    in_small_batches(spark)
    labelled = docs.where(common.doc_bucket("doc_id", 3) != 1)
    found = language.identify(docs.select(*COLUMNS), labelled)
    return found.where(F.col("lang_pred") != language.UNKNOWN).select(*COLUMNS)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    in_small_batches(spark)
    return minhash.deduplicated(docs.select(*COLUMNS))


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    in_small_batches(spark)
    found = decontaminate.decontaminate(docs.select(*COLUMNS), common.read(spark, sf_dir, "benchmark"))
    return found.where(F.size("hit_words") == 0).select(*COLUMNS)


def redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = pii.personal_data(docs.select(*COLUMNS))
    text = pii.redact(found)
    return found.withColumn("text", text).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    in_small_batches(spark)
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language", by_language),
    ("near_duplicates", without_near_duplicates),
    ("decontaminate", without_benchmark),
    ("pii", redacted),
    ("pack", packed),
]
#: The language model, the tokenizer and the packing are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        if i == len(STAGES) - 1:
            return stage(spark, docs, sf_dir)
        with common.scope() as keep:  # what a stage wrote goes once its result is written
            made = keep(common.materialise(stage(spark, docs, sf_dir)))
        common.release(docs)
        docs = made
    return docs
