"""A training corpus from the documents table, in five stages that each work on what the one before kept.

run() writes every stage as Parquet in the shared checkpoint folder, reads it back for the next one, and deletes what
the next one has read.

Cases, in all stages: a null or empty text is a text without letters, words, secrets and tokens (so the first stage
drops it, and the others leave it as it is); null ids and other null columns stay null; repeated rows are judged one by
one, but are one group of copies; texts are read whole; an empty table gives an empty table of the same columns. Any
further columns of documents are carried along, whatever their names (those of the last stage's own columns, n_tokens
and ids, are replaced); n_chars and lang may be missing.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from auditspark.llm import bpe, fm_index, jaccard, langid, secret_scan
from auditspark.llm.common import ensure_checkpoint_dir, without
from auditspark.llm.queries import tokenizer_path

#: A text of so many letters whose best cosine lies within so many times the spread of random vectors is in no
#: language that was learned.
LETTERS = 200
NOISE = 4.0


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in none of the learned languages go; the others get the language found where they had none.

    Profiles are learned from all labelled documents. A document is rejected if it has no letter, or LETTERS of them
    and a cosine with every profile that random vectors have too. Where no document is labelled, all with a letter stay.
    """
    named = docs if "lang" in docs.columns else docs.withColumn("lang", F.lit(None).cast("string"))
    profiles = langid.train(named)
    known = bool(profiles.languages)
    if not known:  # nothing to tell apart: one empty profile stands for any language
        profiles = langid.Profiles(["any"], np.zeros((1, profiles.dimensions), np.float32), profiles.dimensions, profiles.seed)
    found = _beside(docs, lambda d: langid.identify(d, profiles, lang_out="__lang", score_out="__score"))
    letters = F.length(F.regexp_replace("text", r"\P{L}", ""))
    foreign = F.lit(known) & (F.col("__score") < NOISE / profiles.dimensions**0.5) & (letters >= LETTERS)
    kept = found.where((F.col("__lang") != langid.UNDETERMINED) & ~foreign)
    return _restored(kept, docs, lang=lambda old: F.coalesce(old, F.when(F.lit(known), F.col("__lang"))))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies one document stays: that of the smallest id (null ids last), of these the least text.

    Documents without words stand for themselves, but of rows of one id without words one stays.
    """
    return jaccard.drop_near_copies(docs)


def remove_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut out of the texts; a document that is nothing else goes."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = _beside(docs, lambda d: fm_index.find_contamination(d, benchmark, cleaned_col="__cleaned"))
    left = found.where("n_hit = 0 OR n_hit < n_words").withColumn("text", F.col("__cleaned"))
    return _restored(left, docs, n_chars=_counted)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts are replaced by a mark."""
    return _restored(_beside(docs, secret_scan.redact), docs, n_chars=_counted)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with n_tokens and ids (little-endian unsigned 32-bit integers)."""
    docs = without(docs, ["n_tokens", "ids"])
    return _restored(_beside(docs, lambda d: bpe.encode_documents(d, tokenizer_path())), docs, "n_tokens", "ids")


def _beside(docs: DataFrame, operator: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The operator's result for the text alone, with all other columns out of its way in one."""
    others = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    return operator(docs.select(F.struct(*others, F.lit(0).alias("__none")).alias("__doc"), "text"))


def _restored(found: DataFrame, docs: DataFrame, *new: str, **changed: Callable[[Column], Column]) -> DataFrame:
    """The columns of docs, some of them changed, and new ones."""
    out = []
    for c in docs.columns:
        old = F.col("text") if c == "text" else F.col("__doc").getField(c)
        out.append((changed[c](old) if c in changed else old).cast(docs.schema[c].dataType).alias(c))
    return found.select(*out, *new)


def _counted(old: Column) -> Column:
    return F.coalesce(F.length("text"), old)


STAGES = [
    ("language_id", identify_language),
    ("ngram_jaccard", drop_near_duplicates),
    ("decontaminate", remove_benchmarks),
    ("secret_scan", redact_secrets),
    ("bpe_codec", tokenize),
]

#: SQL cannot express these stages; tests compare them with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ensure_checkpoint_dir(spark)
    base = f"{spark.sparkContext.getCheckpointDir()}/corpus-{uuid.uuid4().hex}"
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for k, (name, stage) in enumerate(STAGES):
        path = f"{base}/{k}_{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            _delete(spark, before)
        before = path
    return docs


def _delete(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
