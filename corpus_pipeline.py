"""Five stages from raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and works on every row that the stage before it kept; all but the
last return the columns of ``documents`` and no others, whatever else the input has. Between stages the
rows are written as Parquet and read again. Empty tables pass through all stages.

1. language_id: rows without a language (null text, no letter) or with an unsure guess go.
2. near_duplicates: of each group linked by five-word shingles at 80 percent, the row with the least id
   (then least text hash) stays; rows with a null id or no words stay.
3. suffix_dedup: bytes of 50-byte strings that also start in a document with a smaller id are cut out;
   a character that a cut breaks goes with it, and a row of which nothing is left goes.
4. decontaminate: documents that contain a benchmark item go.
5. packing: the rest is tokenized and packed, one row per piece.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riboplan.llm import decontaminate, language_id, ngram_join, packing, suffix_dedup
from riboplan.llm.common import durable, read, shared_folder, small_side

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Least mean probability of the guessed language: little above chance among four.
SURE = 0.3


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = docs.select(*COLUMNS)
    out = language_id.predict(docs, language_id.fit(docs), keep=COLUMNS)
    return out.filter((F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") >= SURE)).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = docs.select(*COLUMNS)
    rows = durable(ngram_join.join(docs, k=5, percent=80).filter("component_id is not null and n_shingles > 0"))
    one = F.struct("doc_id", "text_hash")
    stay = rows.groupBy("component_id").agg(F.min(one).alias("_one")).select("_one.*")
    gone = durable(rows.select("doc_id", "text_hash").distinct().join(stay, ["doc_id", "text_hash"], "left_anti"))
    text_hash = F.xxhash64(F.coalesce("text", F.lit("")))
    out = docs.withColumn("text_hash", text_hash).join(small_side(gone, gone.count()), ["doc_id", "text_hash"], "left_anti")
    again = rows.groupBy("doc_id", "text_hash").count().filter("count > 1")
    if not again.isEmpty():  # the same row several times
        out = out.filter("doc_id is not null").dropDuplicates(["doc_id", "text_hash"]).unionByName(out.filter("doc_id is null"))
    return out.select(*COLUMNS)


def suffix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = docs.select(*COLUMNS)
    out = suffix_dedup.dedup(docs, keep=("text", "lang", "source", "n_chars"), as_text=True)
    cut = F.col("n_removed") > 0
    out = out.filter(~cut | (F.trim("kept") != "")).withColumns({
        "text": F.when(cut, F.col("kept")).otherwise(F.col("text")),
        "n_chars": F.when(cut, F.length("kept").cast("long")).otherwise(F.col("n_chars")),
    })
    return out.select(*COLUMNS)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = docs.select(*COLUMNS)
    hits = durable(decontaminate.contained(docs, read(spark, sf_dir, "benchmark")).select("doc_id").distinct())
    return docs.join(small_side(hits, hits.count()), "doc_id", "left_anti").select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language_id", language),
    ("near_duplicates", near_duplicates),
    ("suffix_dedup", suffix),
    ("decontaminate", decontaminated),
    ("packing", packed),
]

#: No SQL expresses a trained classifier or a tokenizer: tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, with the rows between them in the folder that the cluster shares."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = read(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{k}-{name}")
            docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return docs
