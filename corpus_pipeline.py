"""Corpus pipeline: language ID, near-dedup, substring dedup, decontamination, BPE.

Each stage takes (spark, docs, sf_dir), works on all that the stage before it kept, and
calls one operator. The driver writes each result as Parquet and reads it back;
``run`` does the same in the shared folder. All stages but the last return the columns
of ``documents``; ``n_chars`` follows the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfolio.llm import bpe, decontaminate, language, near_dups, substring_dedup
from kinfolio.llm.common import crc_mod, table
from kinfolio.llm.queries import tokenizer_path
from kinfolio.session import cut, scratch_table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Cosine with the nearest language prototype below which a document is rejected, as
#: one without letters is; ordinary text of a learned language lies far above.
MIN_COSINE = 0.1
#: Words in a shingle and percent of equal shingles from which on documents are near-duplicates.
SHINGLE, PERCENT = 5, 80


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in which a learned language is recognised."""
    model = language.fit(docs.where(crc_mod(F.col("doc_id"), 3) != 1))
    seen = language.predict(docs, model, *(F.col(c) for c in COLUMNS))
    return seen.where((F.col("lang_pred") != language.UNKNOWN) & (F.col("cosine") >= MIN_COSINE)).select(COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """Keeps one document of each group of near-duplicates: the smallest id, with repeated rows once."""
    linked = near_dups.link(docs, shingle=shingle, percent=percent).where("n_shingles > 0")
    first = F.col("doc").eqNullSafe(F.col("component_id")) & (F.col("part") == F.col("component_part"))
    rows = scratch_table(linked.groupBy("doc", "part", first.alias("first")).agg(F.count("*").alias("n")), "linked")
    kept = _without(docs, rows.where("not first").select("doc", "part"))
    again = cut(rows.where("first and n > 1").select("doc", "part"))
    if again.isEmpty():
        return kept
    # Rows that repeat the id and text of their group's first document: the least of them stays.
    marked = kept.withColumn("_part", F.xxhash64("text"))
    same = marked["doc_id"].eqNullSafe(again["doc"]) & (marked["_part"] == again["part"])
    once = marked.join(again, same, "left_semi").groupBy("doc_id", "_part").agg(F.min(F.struct(*COLUMNS)).alias("x"))
    return _without(kept, again).unionByName(once.select("x.*"))


def substring(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes passages that start in an earlier document; a document left without words goes."""
    found = substring_dedup.dedup(docs).where("n_removed > 0").select("doc", "part", "kept").distinct()
    new = F.when(F.col("found"), F.col("kept")).otherwise(F.col("text"))
    rows = docs.withColumn("_part", F.xxhash64("text"))
    both = rows.join(found.withColumn("found", F.lit(True)), F.col("doc_id").eqNullSafe(F.col("doc")) & (F.col("_part") == F.col("part")), "left")
    kept = both.where("found is null or kept <> ''").withColumn("text", new)
    return kept.withColumn("n_chars", F.when(F.col("found"), F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that aren't contaminated by a benchmark item."""
    found = decontaminate.judged(docs, table(spark, sf_dir, "benchmark"))
    return _without(docs, found.where("contaminated").select(F.col("doc_id").alias("doc"), "part").distinct())


def bpe_codec(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encodes and decodes every text that is left."""
    return bpe.encode_digests(docs, tokenizer_path())


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """Documents that aren't among ``gone``, by id and the text's hash."""
    rows = docs.withColumn("_part", F.xxhash64("text"))
    same = rows["doc_id"].eqNullSafe(gone["doc"]) & (rows["_part"] == gone["part"])
    return rows.join(gone, same, "left_anti").select(COLUMNS)


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring),
    ("decontamination", decontamination),
    ("bpe", bpe_codec),
]

#: The language model is not SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(COLUMNS)
    for name, stage in STAGES[:-1]:
        docs = scratch_table(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
