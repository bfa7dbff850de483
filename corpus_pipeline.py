"""A training-data pipeline over ``documents``.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before
it kept; its result is written as Parquet and read again as the next one's
docs. All but the last return the columns of documents.

Defined results: null and empty texts, and those without a letter, go in the
first stage; rows with a null doc_id are never copies of others, and are judged
by the other stages like any row; of rows with equal doc_ids each is judged by
its own text, and of rows alike in both one stays; very long texts are read
whole by every stage; an empty table gives no row; extra columns stay, and
where they have the names of added ones (ids, decoded) these get underscores.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cairnspark.llm import common, decontamination, jaccard, langid, secret_crf, sentencepieces

#: Documents in no language go; one of each group of near copies stays; documents with benchmark windows go; secrets are replaced; ids and the texts that they decode to are added.
STAGES = [
    ("language ID", langid.stage),
    ("n-gram Jaccard join", jaccard.stage),
    ("benchmark decontamination", decontamination.stage),
    ("secret scans", secret_crf.stage),
    ("SentencePiece encoding and decoding", sentencepieces.round_trip_stage),
]

#: Language models and the conditional random field are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read_table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = common.stored(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)
