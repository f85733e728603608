"""A training-corpus pipeline over documents: five stages, each one operator applied in full.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns the
rows it keeps with the columns of documents, the last one their encoding. ``run`` applies
them in order and writes what each stage returns to the shared folder, so that a lost
executor sets back one stage at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm import bpe, language_id, mixing, pii, simhash
from tidelog.llm.common import documents, durable

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Below this lead no language stands out from the others: the text is in none that was learnt.
LEAST_MARGIN = 0.01


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop texts without letters (null and empty ones too) and those no learnt language fits.

    Where nothing is labelled no language is learnt and every text goes. Repeated rows fare alike.
    """
    docs = docs.select(*COLUMNS)
    found = language_id.predict(docs, language_id.fit(docs), COLUMNS)
    return found.where((F.col("lang_pred") != language_id.UNKNOWN) & (F.col("margin") >= LEAST_MARGIN)).select(*COLUMNS)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest doc_id, a null id last.

    Near are texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more;
    groups are connected by such pairs. Null, empty and blank texts are one group; so are
    repeated rows.
    """
    return simhash.one_of_each(docs.select(*COLUMNS))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by its kind in brackets; no document is dropped. A null text stays null."""
    return pii.redact(docs.select(*COLUMNS))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each time that the mix takes of a document, whole; documents it takes nothing of go.

    The document at which a source's budget is cut is taken whole, once. Null and empty texts
    have no words, so none is taken. Of repeated rows each counts; a null source is a source.
    """
    taken = mixing.mix(docs.select(*COLUMNS), keep=("text", "lang", "n_chars"))
    times = F.ceil(F.col("taken") / F.col("size")).cast("int")
    taken = taken.where("taken > 0").withColumn("_time", F.explode(F.sequence(F.lit(1), times)))
    return taken.select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and of the text decoded from them; a null text counts as empty."""
    return bpe.encode(docs)


STAGES = [("language_id", identify), ("simhash", deduplicate), ("pii", redact), ("mixing", mix), ("bpe", encode)]

#: Kernels, fingerprints and merges can't be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for _, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
