"""A corpus pipeline of five stages: language ID, line dedup, n-gram Jaccard join, mixing, packing.

Each stage takes (spark, docs, sf_dir); all but the last return the columns of documents. What a stage decides
takes effect: documents that language ID rejects go, repeated lines go from the texts, one document of each group
of near copies stays, the mix repeats documents (the one at a source's budget is cut there), packing cuts and
places what the mix holds.

Near copies are found by five-word shingles at 80 %. Nulls, empty and very long texts, ties and repeated rows are as
each operator defines them; rows without an id go through all stages as others do. An empty table gives no rows. Columns
of any other name stay as they are: names for what a stage adds are chosen so that no column of the table has them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import language_id, line_dedup, mixing, ngram_join, packing
from tessera.llm.common import stored, unused_name

SHINGLE_WORDS, SIMILAR_PERCENT = 5, 80


def _with_text(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """rows with docs' columns and n_chars as the text has it now."""
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return rows.select(*docs.columns)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language; a missing language is filled in. Null texts and texts without a letter go."""
    model = language_id.fit(language_id.learnable(docs))
    pred, score = unused_name(docs, "_lang_pred"), unused_name(docs, "_lang_score")
    out = language_id.predict(docs, "text", model, pred, score, keep_text=True)
    reject = F.col(pred) == "und" if model is not None else F.lit(False)
    return out.where(~reject).withColumn("lang", F.coalesce("lang", pred)).select(*docs.columns)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _with_text(docs, line_dedup.dedup_lines(docs))


def near_copy_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group: of the least id (null last), then of the least hash of the row. Texts without words stay."""
    row = F.xxhash64(*[F.col(c).cast("string") for c in docs.columns])
    groups = ngram_join.jaccard_components(docs, k=SHINGLE_WORDS, percent=SIMILAR_PERCENT, row_key=row)
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row_key")
    key = unused_name(docs, "_row")
    kept = groups.where("group_key is not null").groupBy("group_key").agg(F.min(place).alias("p")).select(F.col("p.row_key").alias(key))
    words = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    one = docs.where(words).withColumn(key, row).join(kept, key, "left_semi").dropDuplicates([key])  # of wholly equal rows one
    return one.select(*docs.columns).union(docs.where(~words))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it; the one at a source's budget once more with its first words."""
    text = F.col("text")
    prefix, names = "_mix_", {c.lower() for c in docs.columns}
    while any(prefix + c in names for c in ("size", "source_size", "target", "taken")):
        prefix += "_"
    taken, size = F.col(prefix + "taken"), F.col(prefix + "size")
    mixed = mixing.mix(docs, "doc_id", "source", mixing.n_words(text), mixing.quality(text), F.xxhash64("text"), prefix=prefix).where(taken > 0)
    whole = mixed.withColumn(unused_name(mixed, "_copy"), F.explode(F.array_repeat(F.lit(0), F.floor(taken / size).cast("int"))))
    some = mixed.where(taken % size > 0).withColumn("text", F.array_join(F.slice(F.regexp_extract_all("text", F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0)), F.lit(1), (taken % size).cast("int")), ""))
    return whole.select(*docs.columns).union(_with_text(docs, some))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("language_id", language_stage),
    ("line_dedup", line_stage),
    ("ngram_jaccard", near_copy_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: Language models, MinHash and a tokenizer are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = stored(docs, f"stage-{name}")
    return docs
