"""A corpus in stages: each takes the documents its predecessor kept.

Toxic documents go; one document of each group of near duplicates stays; word windows that an earlier document
holds are taken out; sources are mixed to their targets, a document standing once per copy; and every copy is
encoded as sampled pieces. All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillflow.llm.jaccard_join import join_similar
from tillflow.llm.mixing import mix_sources
from tillflow.llm.pieces import encode_samples
from tillflow.llm.substring_dedup import remove_repeats
from tillflow.llm.toxicity import scorer, train
from tillflow.session import materialise


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below one half; a null text counts as empty and stays."""
    score = scorer(spark, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return docs.filter(score(F.col("text").cast("string")) < 0.5)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents one: that with the smallest id, of rows that share it one text.

    Rows with one id but different texts may belong to several groups, each of which keeps its own. Documents
    without words are no group and stay. Groups in which no row has an id keep one text.
    """
    found = join_similar(docs)
    alone = found.filter("n_shingles = 0").select("doc_id", "text_hash")
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")).alias("first")
    leading = found.filter("n_shingles > 0").groupBy("root").agg(first).select("first.doc_id", "first.text_hash")
    kept = leading.unionByName(alone).distinct()
    hashed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "doc_id",
                         F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("hash"))
    same = hashed["doc_id"].eqNullSafe(kept["doc_id"]) & (hashed["hash"] == kept["text_hash"])
    return hashed.join(kept, same, "left_semi").dropDuplicates(["doc_id", "hash"]).select("row.*")


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the words of windows that a document with a smaller id holds.

    A document that loses nothing keeps its text as it is; of others, words are joined by one space and
    ``n_chars`` is counted anew. A document may become empty; none is dropped.
    """
    done = remove_repeats(docs, carried=docs.columns, keep_form=True)
    changed = {"text": F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("row.text")),
               "n_chars": F.when(F.col("n_removed") > 0, F.length("kept")).otherwise(F.col("row.n_chars"))}
    return done.select(*(changed.get(c, F.col(f"row.`{c}`")).cast(docs.schema[c].dataType).alias(c) for c in docs.columns))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of its source takes it: not at all, once or twice."""
    mixed = mix_sources(docs, carry=True).filter("copies > 0")
    return mixed.select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(
        *(F.col(f"row.`{c}`").alias(c) for c in docs.columns))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sampled pieces of every document, copies of one document alike."""
    return encode_samples(docs)


STAGES = [("toxicity", toxicity), ("near_duplicates", near_duplicates), ("substring_dedup", substring_dedup),
          ("mixing", mixing), ("encoding", encoding)]

#: SQL cannot express the learned and sampled stages; tests/llm compares each stage with its definition.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
