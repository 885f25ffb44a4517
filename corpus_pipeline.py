"""A corpus pipeline: language ID, exact dedup, near-dedup, decontamination, BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes
each stage's rows as Parquet in the shared folder and reads them again for the
next.  All but the last return the columns of ``documents``.

Defined results, stage by stage.  Language ID: null texts and texts without letters go;
rows with a null language are judged like others; without labels to learn from, every text with letters stays.
Exact dedup: of repeated rows one stays; a null id comes last.
Near dedup: the smallest doc_id of a group stays; texts without words, and rows with a null id, stay.  Decontamination:
null and empty texts stay; repeated rows are judged alike.  BPE: a null text has no ids.  Each stage gives an
empty table for an empty table, and takes other columns along whatever their names (BPE returns its own columns only).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from temblor.llm import bpe, decontamination, exact_dedup, language_id, near_dedup
from temblor.llm.frames import fresh, held_out, stored, table
from temblor.llm.queries import tokenizer

#: Texts whose best language holds a smaller share of their n-grams are in none of the languages learned.
LEAST_SHARE = 0.25
#: Percent of shingles shared by near copies, and share of a benchmark item's shingles that makes a leak.
NEAR_PERCENT = 80
LEAK = 0.8


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts without letters and texts in no learned language; if none was learned, only the former."""
    filters = language_id.fit(docs.where(~held_out(F.col("doc_id"), 4, 2)))
    if not filters.langs:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    lang, score = fresh(docs, "lang"), fresh(docs, "score")
    found = language_id.predict(docs, filters, keep=docs.columns, names=(lang, score))
    return found.where((F.col(lang) != language_id.NONE) & (F.col(score) >= LEAST_SHARE)).select(docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.dedup(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays."""
    return near_dedup.dedup(docs, percent=NEAR_PERCENT)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"), LEAK)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and digests of the ids and of the decoded text."""
    return bpe.encode_digests(docs, tokenizer("byte_bpe_50k.json"))


STAGES = [
    ("language ID", identify_language),
    ("exact dedup", drop_copies),
    ("near dedup", drop_near_copies),
    ("decontamination", drop_leaks),
    ("BPE", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return stored(STAGES[-1][1](spark, docs, sf_dir), "encoded")


#: Language ID and BPE are beyond SQL; the tests hold run() against a brute-force version.
ORACLE_SQL = None
