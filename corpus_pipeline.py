"""From documents to token files: five stages over the whole corpus, each written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tamiz.llm import decontamination, language, mixing, simhash, token_files
from tamiz.llm.queries import DOMAINS, byte_tokenizer, domain_model, table
from tamiz.session import scratch

#: No SQL: compression, hashing, a fitted classifier and a tokenizer. The tests hold each stage to invariants.
ORACLE_SQL = None


#: Bytes of text that go to a Python worker at once.
BATCH_BYTES = 8 << 20


def _packed(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``text``, and all other columns in one, so that no column's name can clash and no text is there twice."""
    others = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    return docs.select(F.struct(*others).alias("_document"), "doc_id", "text")


def _unpacked(rows: DataFrame, columns: list[str]) -> DataFrame:
    return rows.select(*[F.col("text") if c == "text" else F.col(f"_document.`{c}`") for c in columns])


def _bounded(spark: SparkSession) -> None:
    """Workers get batches of a bounded size, however long the texts are."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def identify_language(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Drops documents whose language cannot be told: without letters, or by too narrow a margin."""
    _bounded(spark)
    found = language.identify(_packed(docs), language.fit(docs))
    return _unpacked(found.where(~F.col("rejected")), docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of near-duplicates."""
    _bounded(spark)
    return simhash.keep_one(docs, distance=2, words=3)


def drop_benchmark_passages(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Drops documents that hold a benchmark item."""
    _bounded(spark)
    found = decontamination.find_passages(_packed(docs), table(spark, folder, "benchmark"))
    return _unpacked(found.where(F.size("passages") == 0), docs.columns)


def mix_domains(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Keeps each document with the probability of its rate, which is 1 at most."""
    model = domain_model(docs, table(spark, folder, "labels"))
    mixed = mixing.mix(_packed(docs), model, list(DOMAINS.values()), keep=["_document", "doc_id", "text"])
    return _unpacked(mixed.where("copies > 0"), docs.columns)


def write_tokens(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Writes token files and returns what was read back from them."""
    _bounded(spark)
    read = token_files.round_trip(docs.select("doc_id", "text"), byte_tokenizer())
    return read.select("doc_id", "start", "n_tokens", "ids_crc32")


STAGES = [
    ("language", identify_language),
    ("near duplicates", drop_near_duplicates),
    ("decontamination", drop_benchmark_passages),
    ("mixture", mix_domains),
    ("token files", write_tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after another; each reads what the one before has written."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
