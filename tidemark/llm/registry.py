"""The subpackage's queries and their SQL, for __spark_entry__.py."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.alignment import op11_token_alignment
from tidemark.llm.ann import op9_ann
from tidemark.llm.bpe import op7_bpe
from tidemark.llm.collocations import OP12_SQL, op12_collocations
from tidemark.llm.language_id import op8_language_id
from tidemark.llm.license_scan import OP10_SQL, op10_license_scan
from tidemark.llm.line_dedup import OP5_SQL, op5_line_dedup
from tidemark.llm.matroska import op4_matroska
from tidemark.llm.minhash_dedup import op1_minhash_dedup
from tidemark.llm.packing import op2_packing
from tidemark.llm.quality import op3_quality
from tidemark.llm.token_files import op13_token_files
from tidemark.llm.warc import OP6_SQL, op6_warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_minhash_dedup": op1_minhash_dedup,
        "op2_packing": op2_packing,
        "op3_quality": op3_quality,
        "op4_matroska": op4_matroska,
        "op5_line_dedup": op5_line_dedup,
        "op6_warc": op6_warc,
        "op7_bpe": op7_bpe,
        "op8_language_id": op8_language_id,
        "op9_ann": op9_ann,
        "op10_license_scan": op10_license_scan,
        "op11_token_alignment": op11_token_alignment,
        "op12_collocations": op12_collocations,
        "op13_token_files": op13_token_files,
    }


def oracle_sql() -> dict[str, str]:
    return {"op5_line_dedup": OP5_SQL, "op6_warc": OP6_SQL, "op10_license_scan": OP10_SQL, "op12_collocations": OP12_SQL}
