"""A corpus pipeline: quality, near duplicates, secrets, mixing, tokens. Each stage is written and read again as the next one's documents.

All stages take documents with a text in ``text``, an id in ``doc_id`` and a source in ``source``, any of them null, and return the
columns of the documents (the last: one row for each document). Whole texts are used, however long. An empty table stays
empty. Further columns are carried along untouched, whatever their names."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import ngram_join, pfair_mixing, queries, rule_ensemble, secret_scan
from docloom.llm.common import shared_folder


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, taught by the labels, does not reject.

    A null text is judged as an empty one; equal texts are judged alike; without usable labels nothing is rejected."""
    model = rule_ensemble.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return rule_ensemble.score(docs, model).where("predicted = 1").select(*_columns(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (word 5-shingles, similarity 0.8 or more) one row: that of the least id, an id before none, and of equal ids the text of least hash.

    Rows that repeat an id and a text are one document and stay once; a row without an id is a duplicate like any other; of two texts with one id
    each is judged by itself. Documents without words are no duplicates. The rows to drop are few beside the documents."""
    own, same = _unused(docs, "own"), _unused(docs, "same")
    marked = docs.select(*_columns(docs), F.col("doc_id").alias(own), F.xxhash64(F.col("text").cast("string")).alias(same))
    groups = ngram_join.join(marked.select("doc_id", "text", own, same), shingle=5, num=80, den=100, keep=(own, same))
    documents = groups.where("group is not null").groupBy("group", own, same).agg(F.count("*").alias("rows"))
    order = F.struct(F.col(own).isNull(), own, same)
    chosen = documents.groupBy("group").agg(F.min(order).alias("first"), F.sum("rows").alias("all")).where("`all` > 1")
    judged = documents.join(chosen, "group").withColumn("kept", order == F.col("first"))
    judged = ngram_join.checkpoint(judged.where("not kept or rows > 1").select(F.col(own).alias("of"), F.col(same).alias("like"), "kept"))
    match = marked[own].eqNullSafe(judged["of"]) & (marked[same] == judged["like"])
    once = marked.join(judged, match, "left_anti")
    repeated = marked.join(judged.where("kept"), match, "left_semi").dropDuplicates([own, same])
    return once.unionAll(repeated).select(*_columns(docs))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their secrets replaced; ``n_chars`` follows. A null text stays null; equal texts of one source become equal texts."""
    forest = secret_scan.fit(secret_scan.labelled_findings(spark))
    return secret_scan.redact(docs, forest)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in the order of the mixture to the sources' target weights; no row is dropped or repeated, a null source is one of its own."""
    whole = docs.select("doc_id", "source", F.struct(*_columns(docs)).alias("document"))
    return pfair_mixing.in_order(pfair_mixing.mix(whole)).select("document.*")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' tokens, checked by decoding them, with slot and place in the mixture; a null text has no tokens.

    The mixture follows from the rows alone, so it is found again here: files that are read again tell no order."""
    whole = docs.select("doc_id", "source", "lang", "text", F.struct(*_columns(docs)).alias("document"))
    out = queries.tokens(pfair_mixing.mix(whole), keep=("doc_id", "source", "lang", "slot", "place"))
    return out.select("doc_id", "source", "lang", "slot", "place", "n_tokens", "token_ids", F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def _columns(docs: DataFrame) -> list:
    return [F.col(f"`{c}`") for c in docs.columns]


def _unused(docs: DataFrame, name: str) -> str:
    """A column name that the documents do not have."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name = f"_{name}"
    return name


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("secrets", secrets), ("mixing", mixing), ("tokens", tokens)]

#: The quality classifier, the forest and the tokenizer are not SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; what a stage returns is written to the shared folder and read again, and removed when the next one is written."""
    root = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for k, (name, stage) in enumerate(STAGES):
        out = f"{root}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
        if before is not None:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(before)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        before = out
    return docs
