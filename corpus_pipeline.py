"""A training-data pipeline over the ``documents`` table: five stages, each written and read again as the next one's documents.

Each stage takes ``(spark, docs, sf_dir)``.  All but the last return the columns of ``documents``:

1. ``quality``: the compression classifier's rejected documents go.
2. ``lines``: runs of lines that occur earlier are cut out; ``n_chars`` follows, documents left without a line go.
3. ``near_duplicates``: of each group of near-duplicates one document stays.
4. ``decontaminate``: documents that hold a benchmark item go.
5. ``encode``: documents become piece ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quartzite.llm import compression, decontaminate, linededup, pieces, simhash
from quartzite.llm.common import cut, read_table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = compression.fit(docs, read_table(spark, sf_dir, "labels"))
    return compression.score(docs, model).where("_score >= 0.5").drop("_score")


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = linededup.remove_runs(docs)
    left = found.where((F.col("_removed") < F.col("_lines")) | (F.col("_lines") == 0))
    text = F.when(F.col("_removed") > 0, F.col("_kept")).otherwise(F.col("text"))
    size = F.when(F.col("_removed") > 0, F.length("_kept").cast("long")).otherwise(F.col("n_chars"))
    return left.withColumns({"text": text, "n_chars": size}).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, read_table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pieces.encoded(docs, pieces.load(), with_ids=True).select("doc_id", "n_tokens", "ids", "ids_sha256", "round_trip")


STAGES = [
    ("quality classifier", quality),
    ("line dedup", lines),
    ("SimHash near-dedup", near_duplicates),
    ("benchmark decontamination", decontaminate_stage),
    ("SentencePiece encoding", encode),
]

#: SQL cannot express the compressor, the hashes or the merges; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = cut(docs, f"stage{k}")
    return docs
