"""A corpus pipeline of five stages, each written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import functions as F

from framelark.llm._shared import cut, documents, fingerprint
from framelark.llm.decontaminate import decontaminate
from framelark.llm.lines import drop_repeated_lines
from framelark.llm.near import near_groups
from framelark.llm.packing import pack, with_crc
from framelark.llm.toxicity import toxicity

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark, docs, sf_dir: str):
    """Documents that the classifier chain doesn't call toxic."""
    return toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).where(~F.col("toxic")).select(COLUMNS)


def drop_lines(spark, docs, sf_dir: str):
    """All documents, without the lines that repeat across three or more; n_chars follows the text."""
    return drop_repeated_lines(docs).withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text")).cast("long")).select(COLUMNS)


def drop_near_duplicates(spark, docs, sf_dir: str):
    """One row of each group of near duplicates, one with the least doc_id (null: the largest); documents without words are in no group and stay."""
    keys = near_groups(docs).groupBy("doc_id", "a", "b").agg(F.first("component").alias("component"), F.count(F.lit(1)).alias("n"))
    keys = cut(keys, "keys")
    least = keys.where("component IS NOT NULL").groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "a", "b", "n")).alias("x"))
    wordless = keys.where("component IS NULL").select("doc_id", "a", "b", F.lit(False).alias("many"))
    chosen = least.select("x.doc_id", "x.a", "x.b", (F.col("x.n") > 1).alias("many")).unionByName(wordless).withColumnRenamed("doc_id", "id")
    keyed = docs.withColumn("_f", fingerprint())
    same = keyed["doc_id"].cast("long").eqNullSafe(chosen["id"]) & (keyed["_f.a"] == chosen["a"]) & (keyed["_f.b"] == chosen["b"])
    rows = keyed.join(chosen, same)
    # rows equal in id and text: one of them
    one = rows.where("many").groupBy("id", "a", "b").agg(F.min(F.struct(*COLUMNS)).alias("r")).select("r.*")
    return rows.where("NOT many").select(COLUMNS).unionByName(one.select(COLUMNS))


def drop_contaminated(spark, docs, sf_dir: str):
    """Documents that overlap with no benchmark item."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).where(~F.col("contaminated")).select(COLUMNS)


def pack_sequences(spark, docs, sf_dir: str):
    """Sequences of at most 2048 token ids: a row for each piece."""
    return with_crc(pack(docs)).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("packing", pack_sequences),
]
#: Trained models, signatures and tokenizers have no SQL.
ORACLE_SQL = None


def run(spark, sf_dir: str):
    """All stages, applied to ``documents``."""
    docs = documents(spark, sf_dir)
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = cut(docs, name)
    return docs
