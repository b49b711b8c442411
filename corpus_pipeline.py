"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; ``run`` writes what a stage returns as Parquet
and reads it again as the next one's documents, so a lost executor never sends a later stage back further than its input. All stages but
the last return the columns of ``documents``.

Nulls and edge cases: a null text is empty and fails the quality rules; rows without an id, or that share one, are told apart by their texts, and none is
lost for its id: of equal texts, and of each class of near copies, the row of the smallest id stays (rows without an id last, then by a digest of the text). An
empty table gives an empty result; further columns, clashing names included, pass through to the last stage, which returns its own.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from chunkwell.llm import exact_dedup, ngram_join, packing, pii, quality
from chunkwell.llm.common import save, shared_dir

STAGES = [
    ("quality_rules", quality.stage),
    ("exact_dedup", exact_dedup.stage),
    ("ngram_jaccard_join", ngram_join.stage),
    ("pii", pii.stage),
    ("packing", packing.stage),
]

#: SQL can express neither the similarity join's classes at this size, nor the field, nor tokens; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_dir(spark)}/chunkwell/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        docs = save(stage(spark, docs, sf_dir), f"{folder}/{k}-{name}")
    return docs
