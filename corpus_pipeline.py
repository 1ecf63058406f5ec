"""Five stages from raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir), works on all rows of docs, and returns the columns of
documents; the last one returns pieces of sequences. run() writes every stage's rows as Parquet in
the shared folder and reads them again, so a lost executor costs a stage at most.

1. quality: positive-unlabelled classifier; documents that it rejects go.
2. near_duplicates: of each group of rows that link (5-word shingles, Jaccard 0.8 or more) exactly one
   stays: that with the smallest doc_id, those without one last; of equals the first by a hash of the
   text, then any. Groups are of rows, so what other rows have the same doc_id, or none, is no matter.
   Rows without words link with nothing and all stay.
3. decontamination: documents that leak a benchmark item go.
4. secrets: every reported span is replaced in the text, and n_chars follows.
5. packing: sequences of 1024 tokens.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from gridloom.llm import decontaminate, ngram_jaccard, packing, quality_pu, secret_links
from gridloom.llm.graph import light, sized, unused
from gridloom.session import stored, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_pu.keep(docs, quality_pu.fit(docs, table(spark, sf_dir, "labels")))


def _rows(docs: DataFrame, row: str) -> DataFrame:
    """docs with a key of each row in column row. Rows read from files have their place in them, which stays the same
    however the files are split; files' places overlap only where the 62-bit hashes of two paths lie closer
    than a file has rows. Rows of anything else are numbered and written, so that the numbers stay."""
    try:
        if unused(docs, "_metadata") != "_metadata":  # a column of the table's own
            raise AnalysisException("no place in files")
        places = docs.select("*", F.struct("_metadata.file_path", "_metadata.row_index").alias(row))
    except AnalysisException:
        return stored(docs.withColumn(row, F.monotonically_increasing_id()), "keyed")
    return places.withColumn(row, F.shiftright(F.xxhash64(f"{row}.file_path"), 2) + F.col(f"{row}.row_index"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    row = unused(docs, "near_duplicates_row")
    keyed = _rows(docs, row)
    own = keyed.select(F.col(row).alias("row"), "doc_id", "text")  # no other column's name can clash
    group = stored(ngram_jaccard.link(own, key="row").select(F.col("row"), F.col("component_id").alias("group")), "groups")
    several = group.groupBy("group").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("group")
    members, count, _ = sized(group.join(several, "group"), "members")
    order = F.struct(F.col("doc_id").isNull().alias("bare"), "doc_id", F.xxhash64("text").alias("text"), "row")
    ordered = stored(own.join(light(members, count), "row").select("group", order.alias("order")), "order")
    first = ordered.groupBy("group").agg(F.min("order").alias("first"))
    others, count, _ = sized(ordered.join(first, "group").where("order.row <> first.row").select(F.col("order.row").alias(row)), "others")
    return keyed.join(light(others, count), row, "left_anti").drop(row)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = secret_links.redact(docs)
    return out.withColumn("n_chars", F.length("text").cast("long"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secrets", secrets),
    ("packing", packed),
]

#: No stage but the last two could be put in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents: a row for each piece of a sequence."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
