"""Cleans, mixes and shards a corpus in stages.

STAGES lists (name, function). Each function takes (spark, docs, sf_dir) and returns a DataFrame; its rows
are written as Parquet and read again as the next one's docs. All but the last keep the columns of
`documents`. No stage needs anything of an earlier one but its rows.
"""

from __future__ import annotations

from tallylens.llm import decontamination, langid, mixing, neardup, sharding
from tallylens.llm.common import drop_from, mark, materialize, table


def language(spark, docs, sf_dir):
    """Rejects documents without a recognised language (op6)."""
    return langid.kept_documents(docs, langid.fit(docs))


def near_duplicates(spark, docs, sf_dir):
    """Keeps one document of each group of near-duplicates (op8)."""
    return neardup.deduplicated(docs)


def decontaminate(spark, docs, sf_dir):
    """Removes documents that hold a passage of the benchmark (op5)."""
    return decontamination.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def mix(spark, docs, sf_dir):
    """Repeats or leaves out documents so that the sources' words meet their targets (op9)."""
    return mixing.mixed_documents(docs)


def shard(spark, docs, sf_dir):
    """Puts the documents into shards of nearly equal bytes (op2)."""
    return sharding.sharded_documents(docs)


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminate),
    ("mix", mix),
    ("shard", shard),
]

#: Near-duplicate search and language models can't be put into one SQL statement; the tests compare each
#: stage with a brute-force version.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    first = mark()
    for k, (name, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES):
            docs = materialize(docs, name)
            drop_from(spark, first, keep=1)  # what the stage wrote on its way, and its input
    return docs
