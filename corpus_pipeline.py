"""A training-data pipeline of five stages over ``documents``.

Each stage takes (spark, docs, sf_dir), docs read from files, and returns a
DataFrame. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taskloom.llm import decontaminate, mixture, near_dedup
from taskloom.llm.common import kept_rows, stored, table, with_row_id
from taskloom.llm.line_dedup import line_dedup
from taskloom.llm.queries import quality_scores


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a score of 0.3 or more.

    Null and empty texts are scored like others; repeated rows are scored each
    for itself; an empty table stays empty.
    """
    return kept_rows(docs, quality_scores(spark, docs, sf_dir).where("score >= 0.3"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that an earlier line resembles; n_chars follows the text.

    Every document stays, null texts as they are; the copy of a repeated row
    loses all its lines. An empty table stays empty.
    """
    return line_dedup(docs).withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the first by doc_id.

    Null texts and texts without words resemble nothing and stay; of repeated
    rows one stays. An empty table stays empty.
    """
    return kept_rows(docs, near_dedup.near_groups(docs).where("kept"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs.

    Null and empty texts stay; repeated rows are judged alike. An empty table
    stays empty, and without items every document stays.
    """
    _, hits = decontaminate.contaminated_spans(docs, table(spark, sf_dir, "benchmark"))
    return kept_rows(docs, hits.select("_rid").distinct(), "left_anti")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes, with their words (``size``) and number of copies (``copies``).

    Null and empty texts have no words and aren't taken; null sources are one
    source; repeated rows are separate documents. Columns of docs with the two
    new names are replaced. An empty table stays empty.
    """
    mixed = mixture.mix_sources(docs).where("copies > 0").select("_rid", "size", "copies")
    rows = with_row_id(docs.select(F.struct("*").alias("row"))).join(mixed, "_rid")
    return rows.select(*(F.col("row")[c].alias(c) for c in docs.columns if c not in ("size", "copies")), "size", "copies")


STAGES = [
    ("quality classifier", drop_low_quality),
    ("line dedup", drop_repeated_lines),
    ("minhash near-dedup", keep_one_of_each_group),
    ("benchmark decontamination", drop_contaminated),
    ("mixing sources", mix_sources),
]

#: The classifier, the signatures and the draws of the mix are not SQL; tests/llm holds the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
