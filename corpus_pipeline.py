"""A training-corpus pipeline: each stage is one of the operators of ``sigloom.llm``, applied to all that its predecessor kept.

``run`` writes each stage's rows as Parquet under the shared folder and reads them back, so a later
stage never recomputes an earlier one and a lost executor costs at most the running stage.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from sigloom.llm import decontaminate, language, minhash, pieces, toxicity
from sigloom.llm.common import shared_root, table
from sigloom.llm.queries import held_out_of


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter (null and empty texts too), or that are like no learned language (scrambled letters, other scripts, keys), go.  Learns from the labelled rows of its input."""
    model = language.fit(language.sample(docs.filter(~held_out_of(4, 2))))
    return language.keep_identified(docs, model)


def filter_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.5 or more go; a text without words scores 0 and stays."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    model = toxicity.fit(toxicity.sample(docs, labels.filter(~held_out_of(5, 0))))
    return toxicity.keep_clean(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by Jaccard >= 0.8 over five-word shingles, one row stays, that of the smallest doc_id; documents without words and null ids all stay."""
    return minhash.deduplicate(docs, words=5)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark window of ten words (a shorter item whole) go."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, the ids of the sampled segmentation and their digest; lossless says that decoding the stored ids gave the text back."""
    folder = f"{shared_root(spark)}/pieces-{uuid.uuid4().hex}"
    return pieces.stored(docs, public_tokenizers.path("piece_bpe_32k.model"), folder, keep=("doc_id", "lang", "source"))


STAGES = [
    ("language", identify_language),
    ("toxicity", filter_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("pieces", encode_pieces),
]

#: The trained classifiers and the sampled segmentations are no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_root(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
