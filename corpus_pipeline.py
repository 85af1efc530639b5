"""Corpus pipeline: each stage takes (spark, docs, sf_dir), is written as Parquet and read again as the next one's docs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pagemill.llm import common, langid, mixing, packing, pii, simhash

STAGES = [
    ("language", langid.stage),
    ("near-duplicates", simhash.stage),
    ("surrogates", pii.stage),
    ("mixing", mixing.stage),
    ("packing", packing.stage),
]

#: The stages learn models, hash with keys and link near-duplicates, which SQL can't express; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents, each result cut off from its lineage by a table in the shared folder."""
    docs = common.documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = common.write_table(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
