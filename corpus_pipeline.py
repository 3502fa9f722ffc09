"""Corpus pipeline: each stage reads what its predecessor kept, as Parquet.

In every stage a null or empty text is a text without words or lines: it is not toxic
by any word, loses nothing, duplicates nothing and holds no passage. A null id is an id
like others. Columns beyond those of ``documents`` are not read, and an empty table gives
an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from repeatloom.llm import decontaminate, line_dedup, near_dedup, packing, toxicity
from repeatloom.llm.common import DOCUMENT_COLUMNS, cut, new_path, perhaps_among, table

#: A document is dropped when this share of its words lies in benchmark passages.
HIT_SHARE = 0.5
#: A line goes when it is on more than this share of its source's pages; op1's own ratio is that of its SQL.
LINE_RATIO = 0.01


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted toxic.

    Empty and null texts are scored as texts without words. Repeated rows have one score,
    so they stay or go together, as do rows of equal text. Without labels of both kinds
    nothing is rejected unless most labels are toxic.
    """
    scored = toxicity.score_toxicity(docs, table(spark, sf_dir, "labels"), keep=tuple(DOCUMENT_COLUMNS))
    return scored.where("predicted = 0").select(*DOCUMENT_COLUMNS)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their source's boilerplate lines.

    A document that loses all its lines stays, with an empty text; null and empty texts
    stay as they are. Repeated rows count as pages each; a null source is a source.
    """
    found = line_dedup.drop_boilerplate(docs, LINE_RATIO)
    return found.withColumn("n_chars", F.length("text").cast("long")).select(*DOCUMENT_COLUMNS)


def keep_one(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates, of the smallest id (null last).

    Of rows that tie the one of the least hash, and then of the least other columns, stays.
    Texts without words duplicate nothing, so they stay, but for equal rows.
    Ids may repeat, so rows are known by a hash of id and text. Rows that share it are
    copies, of which one stays; only hashes on several rows are brought together. Rows that
    surely stay are told by a filter of the other hashes, so their texts are not moved.
    """
    keyed = docs.select(*DOCUMENT_COLUMNS, F.xxhash64("doc_id", "text").alias("_key"))
    found = near_dedup.near_duplicates(keyed, width=5, id_column="_key").groupBy("_key").agg(F.min("component_id").alias("group"))
    rows = keyed.groupBy("_key").agg(F.min("doc_id").alias("id"), F.count("*").alias("_rows"))
    grouped = cut(found.join(rows, "_key"), "grouped")
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "_key", "_rows")).alias("first")
    kept = cut(grouped.groupBy("group").agg(first).select("first._key", "first._rows"), "kept")
    other = cut(grouped.select("_key").join(kept.where("_rows = 1"), "_key", "left_anti"), "other")
    told = perhaps_among(keyed, "_key", other, "_other")
    stay, unsure = (told.where(x).drop("_other") for x in ("not _other", "_other"))
    # merged at every size, as a filter's errors and the rows that go grow with the input
    single = unsure.join(kept.where("_rows = 1").hint("merge"), "_key", "left_semi").unionByName(stay).select(*DOCUMENT_COLUMNS)
    copies = unsure.join(kept.where("_rows > 1").hint("merge"), "_key", "left_semi").groupBy("_key").agg(F.min(F.struct(*DOCUMENT_COLUMNS)).alias("row"))
    return single.unionByName(copies.select("row.*"))


def decontaminate_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go; from the others the benchmark's passages are cut.

    Contaminated are documents with passages of two or more items, or with more than
    ``HIT_SHARE`` of their words in passages. A document may keep an empty text. Null and
    empty texts stay; repeated rows are judged each; an empty benchmark cuts nothing.
    """
    found = decontaminate.find_contamination(docs, table(spark, sf_dir, "benchmark"), keep=tuple(DOCUMENT_COLUMNS))
    found = found.where((F.col("n_items") < 2) & (F.col("n_hit") <= HIT_SHARE * F.col("n_words")))
    cut = decontaminate.cut_passages(found)
    return cut.withColumn("n_chars", F.length("text").cast("long")).select(*DOCUMENT_COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in context windows.

    A null or empty text is its end id alone; repeated rows are packed each.
    """
    return packing.pack_documents(docs)


STAGES = [
    ("toxicity", reject_toxic),
    ("line dedup", drop_lines),
    ("near dedup", keep_one),
    ("decontamination", decontaminate_texts),
    ("packing", pack),
]

#: Learnt scores, hashed candidates and token ids are not SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; between stages rows are written and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            path = new_path(spark, f"pipeline-{k}-{name.replace(' ', '-')}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
