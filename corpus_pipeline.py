"""The corpus pipeline: quality, language, repeated lines, near duplicates, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before has kept, written as Parquet and read again.
All but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.common import drop_path, scratch_root, table
from tidemark.llm.language_id import keep_identified
from tidemark.llm.line_dedup import drop_repeated_lines
from tidemark.llm.minhash_dedup import keep_representatives
from tidemark.llm.packing import pack_stage
from tidemark.llm.quality import keep_good

STAGES = [
    ("quality", keep_good),
    ("language", keep_identified),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", keep_representatives),
    ("packing", pack_stage),
]

#: Models and near duplicates can't be written in SQL; tests compare the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = f"{scratch_root(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:  # nothing reads the stage before any more
            drop_path(spark, before)
        before = path
    return docs
