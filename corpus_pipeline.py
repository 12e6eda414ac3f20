"""A corpus pipeline of four of the training-data operators.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and read again as the
next stage's docs; all but the last return the columns of docs.

1. quality rules: rejected documents go; failing lines of the others are removed from their text
2. language ID: models are fitted on the stage's own input; rejected documents go
3. near-duplicates: of each group the document of the smallest id stays
4. packing: the documents left, as pieces packed into sequences

Edge cases are those of the operators: rows without an id pass the stages (they can't be duplicates of
anything); of rows that repeat an id the third stage keeps one for each distinct text, the smallest as
JSON, so a stage that runs again keeps the same; null texts fail the quality rules; and columns besides
those used are carried whatever their names are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm.blocks import by_ids, discard, fold, persisted
from lodestar.llm.langid import fit, identify
from lodestar.llm.neardup import near_duplicates
from lodestar.llm.packing import pack, vocabulary_path
from lodestar.llm.quality import judge_documents


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    others = [c for c in docs.columns if c not in ("text", "n_chars")]
    aside = [f"own_{i}" for i in range(len(others))]
    source = docs.select(*[F.col(f"`{c}`").alias(a) for c, a in zip(others, aside)], "text")
    judged = judge_documents(source, carry=aside, cleaned="cleaned").filter("kept")
    made = dict(zip(others, map(F.col, aside))) | {"text": F.col("cleaned"), "n_chars": F.length("cleaned").cast("long")}
    return judged.select(*[made[c].alias(c) for c in docs.columns])


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    models = fit(docs, fold("doc_id", 5) != 0)
    if not models.languages:  # nothing to learn from: nothing can be rejected
        return docs
    aside = [c if c == "text" else f"own_{i}" for i, c in enumerate(docs.columns)]
    source = docs.select(*[F.col(f"`{c}`").alias(a) for c, a in zip(docs.columns, aside)])
    found = identify(source, models).filter("NOT rejected")
    return found.select(*[F.col(a).alias(c) for c, a in zip(docs.columns, aside)])


def near_duplicate_groups(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    groups = persisted(near_duplicates(docs).select("doc_id", "kept").filter("doc_id IS NOT NULL"), "groups")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    left = by_ids(docs, groups.filter("NOT kept").select("doc_id").distinct(), "left_anti").select(*columns)
    repeated = persisted(groups.filter("kept").groupBy("doc_id").count().filter("count > 1").select("doc_id"), "repeated")
    if repeated.isEmpty():
        return left
    once = by_ids(left, repeated, "left_anti").select(*columns)
    row = F.struct(*columns)
    several = by_ids(left, repeated, "left_semi").groupBy("doc_id", "text").agg(F.min_by(row, F.to_json(row)).alias("row"))
    return once.union(several.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns]))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs, vocabulary_path())


STAGES = [
    ("quality_rules", quality_rules),
    ("language_id", language_id),
    ("near_duplicates", near_duplicate_groups),
    ("packing", packing),
]

#: Character models, near-duplicate groups and tokenisation aren't expressible in SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, from documents on."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for n, (name, stage) in enumerate(STAGES[:-1]):
        before, docs = docs, persisted(stage(spark, docs, sf_dir), f"stage-{name}")
        if n:
            discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
