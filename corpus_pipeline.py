"""From raw documents to packed sequences: each stage reads what its predecessor kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame, which ``run`` writes as Parquet
to the shared folder and reads back as the next stage's documents. All stages but the last
return the columns of ``docs``.
"""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from etalase.llm import decontamination, jaccard_join, packing, secret_scans, toxicity
from etalase.llm.common import stored, table
from etalase.llm.registry import tokenizer_path

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the classifier rejects go. It learns from the labelled rows among ``docs``."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), toxicity.learnable())
    return toxicity.without_toxic(docs, model)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest id stays.

    Of rows alike in id and text one stays. Rows without an id cannot be named and stay.
    """
    rows = "_rows"
    while rows in docs.columns:
        rows = f"_{rows}"
    groups = jaccard_join.joined(docs)
    first = groups.where("doc_id = component_id").groupBy("doc_id").agg(F.count(F.lit(1)).alias(rows))
    # The ids grow with the documents, so they are never sent whole to every task.
    chosen = docs.join(stored(first, "firsts").hint("merge"), "doc_id")
    single = chosen.where(F.col(rows) == 1)
    repeated = chosen.where(F.col(rows) > 1).dropDuplicates(["doc_id", "text"])
    kept = single.unionByName(repeated).select(*[F.col(c) for c in docs.columns])
    return kept.unionByName(docs.where("doc_id is null"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced in the text; every document stays."""
    return secret_scans.redacted(docs, secret_scans.train(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their sequence and offset."""
    return packing.pack(docs, tokenizer_path())


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("jaccard_join", one_of_each),
    ("decontamination", drop_contaminated),
    ("secret_scans", redact_secrets),
    ("packing", pack),
]

# Tokens and trained scores have no SQL; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
