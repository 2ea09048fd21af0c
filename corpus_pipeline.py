"""From raw documents to training text: what is poor goes, then copies, test passages and personal data; what is left is tokenised."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import bpe, decontaminate, pii, quality, simjoin
from quire.llm.common import drop, stored, sweep, written
from quire.llm.queries import tokenizer_file
from quire.session import ship

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


#: Tables that the stage before left in the shared folder.
_left: set[str] = set()


def _tidy(stage: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """A stage that first removes the tables behind the result of the stage before it, which has been written by then."""

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        ship(spark)
        sweep(spark, _left)
        _left.clear()
        known = written()
        out = stage(spark, docs, sf_dir)
        _left.update(written() - known)
        return out

    return run_stage


@_tidy
def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the quality classifier finds poor or toxic.

    Null and blank texts are judged by what an empty text shows; repeated rows are judged alike; an empty table stays empty; columns beyond
    those of documents go, in all stages.
    """
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.score(docs, model, "source", "lang").filter("keep").select(*COLUMNS)


@_tidy
def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group that five-word shingles link at a similarity of 0.8: that of least id, null ids last.

    Documents without words (null or blank) link with nothing and all stay; of rows that repeat id and text one stays; an empty table stays empty.
    """
    return simjoin.one_of_each(docs, n=5, percent=80).select(*COLUMNS)


@_tidy
def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold ten consecutive words of a benchmark item, or all words of a shorter one.

    Null texts hold nothing and stay, as do repeated rows that are clean; an empty table, or no items, changes nothing.
    """
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(*COLUMNS)


@_tidy
def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks personal data, and what gives it away, in the texts; n_chars is counted anew. All rows stay, null texts as nulls."""
    return pii.sanitise(docs).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


@_tidy
def tokenised(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encodes the texts; the text that comes out is decoded from the ids. All rows stay; null texts give no ids and the empty text."""
    path = tokenizer_file()
    ids = bpe.encode(docs.select("doc_id", "text", "lang", "source"), path).drop("text")
    return bpe.decode(ids, path, text="text").select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"), (F.length("ids") / 4).cast("long").alias("n_tokens"), "ids")


STAGES = [("quality classifier", classify), ("n-gram Jaccard join", deduplicate), ("benchmark decontamination", decontaminated), ("PII", private), ("BPE encoding and decoding", tokenised)]
#: The classifier and the tokenizer are beyond SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again before the next."""
    ship(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES[:-1]):
        before, docs = docs, stored(stage(spark, docs, sf_dir), f"stage{i}")
        drop(before)
    return STAGES[-1][1](spark, docs, sf_dir)
