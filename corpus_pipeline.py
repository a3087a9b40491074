"""The training-data pipeline: quality rules, line dedup, near-duplicate removal, decontamination, mixing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it as Parquet in
the shared folder and rereads it as the next stage's docs. All stages but the last return the
columns of documents; the last adds ``copy``, the number of a document's copy.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomspan.llm.common import table, written
from loomspan.llm.decontaminate import decontaminate_stage
from loomspan.llm.line_dedup import line_dedup_stage
from loomspan.llm.mixing import mix_stage
from loomspan.llm.near_dup import near_dup_stage
from loomspan.llm.quality import quality_stage

STAGES = [
    ("quality rules", quality_stage),
    ("line dedup", line_dedup_stage),
    ("near duplicates", near_dup_stage),
    ("decontamination", decontaminate_stage),
    ("mixing", mix_stage),
]

#: The near-duplicate stage closes a graph and the mixing stage solves for rates: SQL can't
#: express run()'s rows. tests/llm/test_pipeline.py holds them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = written(stage(spark, docs, sf_dir), f"stage-{i}")
    return docs
