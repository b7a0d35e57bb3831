"""The corpus pipeline: five stages over ``documents``, each calling one operator of lexaudit.llm.

1. language_id drops texts without a determined language (no letter, or a rate of the winning language
   below ``MIN_LANGUAGE_RATE``; that rate doesn't depend on how many other languages are learned).
2. near_dedup keeps the document with the smallest doc_id of each group of near duplicates (five-word shingles, 0.8).
   Rows that repeat a doc_id are one document and stay together; rows without a doc_id stay.
3. decontamination drops documents that hold a benchmark item (five-word shingles, 0.8 of the item).
4. secret_redaction replaces secrets in the text and adjusts n_chars.
5. bpe_encoding returns the packed token ids and the decoded text of each document.

Defined results: null and empty texts, and texts without a letter, have no determined language and go at stage 1. Texts of any length are read whole. Rows that repeat a doc_id
stay or go together in stage 2 and are each kept otherwise. Extra columns of any name are passed on up to stage 4. An empty table gives an empty table of each stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexaudit.llm.bpe import encode_documents
from lexaudit.llm.decontaminate import drop_contaminated
from lexaudit.llm.language_id import UNDETERMINED, fit_language_model, fold, identify_languages
from lexaudit.llm.near_dup import BROADCAST_IDS, near_duplicates
from lexaudit.llm.secrets import redact_secrets
from lexaudit.llm.storage import Workspace

MIN_LANGUAGE_RATE = 0.05
TOKENIZER = "word_bpe_49k.json"


def _new_name(docs: DataFrame, name: str) -> str:
    """``name``, made longer while ``docs`` has a column of it."""
    while name in map(str.lower, docs.columns):
        name += "_"
    return name


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = fit_language_model(docs, fold(F.col("doc_id"), 5) != 0)
    lang, score, rate = (_new_name(docs, f"pipeline_{c}") for c in ("lang", "score", "rate"))
    found = identify_languages(docs, model, lang, score, rate)
    return found.where((F.col(lang) != UNDETERMINED) & (F.col(rate) >= MIN_LANGUAGE_RATE)).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    dropped = Workspace(spark, "dedup-stage").save(near_duplicates(docs).where("not kept").select("doc_id").distinct(), "dropped")
    return docs.join(F.broadcast(dropped) if dropped.count() <= BROADCAST_IDS else dropped, "doc_id", "left_anti").select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return redact_secrets(docs)


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return encode_documents(docs, public_tokenizers.path(TOKENIZER))


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("secret_redaction", secret_redaction),
    ("bpe_encoding", bpe_encoding),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ws = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = ws.save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


#: Language identification learns a model, which SQL can't express; tests hold the stages against brute force.
ORACLE_SQL = None
