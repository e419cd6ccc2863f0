"""From raw documents to token files, in five stages.

Each stage gets what its predecessor kept, as Parquet. All but the last return
the columns of `documents`. The stage on shingles takes five words.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelloom.llm.common import shared_dir, stage, with_broadcast_if_small
from labelloom.llm.decontaminate import mark_contaminated
from labelloom.llm.importance import fit_resampling
from labelloom.llm.mixing import mix_sources, mixed_documents
from labelloom.llm.near_duplicates import near_duplicates
from labelloom.llm.token_files import read_token_files, write_token_files
from labelloom.shipping import ship_package

#: Rows up to which ids of rejected documents are broadcast.
BROADCAST_ROWS = 500_000
#: Rows of an Arrow batch: texts are long, and a worker holds a batch and what it makes of it.
ARROW_ROWS = 250


def _ready(spark: SparkSession) -> None:
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
    # its reader threads each keep buffers as large as their reads, outside the heap
    spark.conf.set("parquet.hadoop.vectored.io.enabled", "false")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling draws. Null and empty texts score as the raw text does; repeated rows share one fate."""
    _ready(spark)
    draw, _ = fit_resampling(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    # scored again rather than staged with their texts
    return docs.where(draw.kept(F.col("doc_id"), F.col("text")))


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates.

    Of rows that share an id only those go whose text is a copy; rows repeated
    whole, or with another column changed, leave one. Null texts and those
    without words have no copies but their own repetition; rows without id stay.
    """
    _ready(spark)
    found = near_duplicates(docs.select("doc_id", "text"))
    gone = stage(found.where(~F.col("leads") & F.col("doc_id").isNotNull()).select("doc_id", "text_hash").distinct(), "duplicates")
    again = found.where("leads and doc_id is not null").groupBy("doc_id", "text_hash").agg(F.count("*").alias("n")).where("n > 1")
    again = stage(again.select("doc_id", "text_hash"), "repeated")
    once = _matching(docs, gone, "left_anti")
    several = _matching(once, again, "left_semi").select(F.struct(*docs.columns).alias("row"), "doc_id", F.xxhash64("text").alias("hash"))
    return _matching(once, again, "left_anti").unionByName(several.dropDuplicates(["doc_id", "hash"]).select("row.*"))


def _matching(docs: DataFrame, rows: DataFrame, how: str) -> DataFrame:
    """The documents whose id and text are (left_semi) or aren't (left_anti) among the rows (doc_id, text_hash)."""
    d, r = docs.alias("d"), with_broadcast_if_small(rows, rows.count(), BROADCAST_ROWS).alias("r")
    return d.join(r, F.col("d.doc_id").eqNullSafe(F.col("r.doc_id")) & (F.xxhash64("d.text") == F.col("r.text_hash")), how)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without contamination by the benchmark; those without words are clean."""
    _ready(spark)
    marked = mark_contaminated(docs.select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    gone = stage(marked.where("contaminated").select("doc_id", "text_hash").distinct(), "contaminated")
    return _matching(docs, gone, "left_anti")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that the mix takes of each document, a row for each pass; texts without words give none."""
    _ready(spark)
    _, pieces = mix_sources(docs)
    return mixed_documents(docs, pieces)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the mix, as they read back."""
    _ready(spark)
    path = f"{shared_dir(spark)}/token-files-{uuid.uuid4().hex}"
    write_token_files(docs, path, public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return read_token_files(spark, path)


STAGES = [
    ("quality classifier", quality),
    ("near duplicates", deduplicate),
    ("benchmark decontamination", decontaminate),
    ("mixing sources", mix),
    ("token files", tokens),
]

#: Tokens and hashed models are beyond SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES:
        path = f"{shared_dir(spark)}/corpus-{name.replace(' ', '-')}-{uuid.uuid4().hex}"
        step(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
