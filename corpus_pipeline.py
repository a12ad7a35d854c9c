"""A training corpus from raw documents, in stages that each write their rows for the next.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return
the columns of documents.  ``run`` applies them to the table of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glintsieve.llm import decontaminate, jaccard, language, packing, secrets
from glintsieve.llm.common import VOCABULARY, new_folder, remove_folder, table, unused

#: Near duplicates: words of a shingle, and the least Jaccard in hundredths.
SHINGLE_WORDS, LEAST_JACCARD = 5, 80


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a language: no letters, or too few words that their likeliest language knows."""
    own = unused(docs, "language")
    judged = language.identify(docs, language.learn(docs, F.lit(True)), own)
    return judged.where(F.col(own)["fits"]).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near duplicates, that with the least doc_id; rows without words are in no group and stay."""
    return jaccard.distinct_documents(docs, SHINGLE_WORDS, LEAST_JACCARD, 100)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents of which a twentieth or more of the words lies in windows of test items, and cuts such windows out of all others."""
    own = unused(docs, "contamination")
    judged = decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"), out_col=own, remove=True)
    kept = judged.where(~F.col(own)["contaminated"])
    hit = F.col(own)["n_hit"] > 0
    changed = {"text": F.col(own)["cleaned"]}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(hit, F.length(changed["text"])).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return kept.withColumns(changed).select(*docs.columns)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces every character of a secret with an asterisk; all documents stay, as long as they were."""
    own = unused(docs, "secrets")
    return secrets.scan_documents(docs, secrets.learn(docs), own, redact=True).withColumn("text", F.col(own)["redacted"]).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into few sequences of 2048 tokens; a row for each piece of a document."""
    return packing.pack_documents(docs, VOCABULARY)


STAGES = [
    ("language_id", keep_known_languages),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secret_scan", redact_secrets),
    ("packing", pack_sequences),
]

#: SQL can express neither the learnt stages nor the tokeniser.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table of documents, each written to the shared folder and read again.

    A stage's rows are deleted when the next one's are written; the last one's stay.
    """
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        folder = new_folder(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
        if before:
            remove_folder(spark, before)
        before = folder
    return docs
