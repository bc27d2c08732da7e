"""Token files against the library, and what their indexes skip."""

import os
import zlib
from collections import Counter

import numpy as np
import pytest

from tests.llm.data import ROWS, documents, empty
from tidemark.llm import token_files

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def encode():
    import public_tokenizers as P
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    return lambda text: [*library.encode(text or "", add_special_tokens=False).ids, 1]


def plain(rows, encode):
    """(doc_id, start, n_tokens, crc) of rows in the order of their ids; those without an id first."""
    out, start = [], 0
    for doc, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = encode(text)
        out.append((doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return Counter(out)


def test_op13_matches_the_library(spark, encode):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert Counter(tuple(r) for r in token_files.op13_token_files(spark, SF).collect()) == plain(rows, encode)


def test_files_of_odd_rows(spark, tmp_path, encode):
    token_files.write_tokens(documents(spark).coalesce(1), f"{tmp_path}/odd", token_files.FileConfig(batch_rows=2))
    assert Counter(tuple(r) for r in token_files.token_digests(spark, f"{tmp_path}/odd").collect()) == plain([r[:2] for r in ROWS], encode)
    token_files.write_tokens(empty(spark), f"{tmp_path}/none")
    assert token_files.token_digests(spark, f"{tmp_path}/none").count() == 0


def test_one_id_may_fill_several_files(spark, tmp_path, encode):
    rows = [(7 if i % 3 else i, f"text number {i}") for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(2)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        token_files.write_tokens(df, f"{tmp_path}/t")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert Counter(tuple(r) for r in token_files.token_digests(spark, f"{tmp_path}/t").collect()) == plain(rows, encode)
    parts = [r.part for r in token_files.read_tokens(spark, f"{tmp_path}/t").where("doc_id = 7").select("part").distinct().collect()]
    assert len(parts) > 1


def rows_read(df):
    """Rows that leave the scan."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    plan = plan.executedPlan() if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec" else plan
    scan = plan.collectLeaves().head()
    return scan.metrics().apply("numOutputRows").value()


def test_look_ups_read_row_groups_that_may_hold_the_id(spark, tmp_path):
    from pyarrow import orc

    df = spark.range(0, 20_000, 2).selectExpr("id AS doc_id", "concat('words of text ', id, repeat(' and more', 20)) AS text")
    c = token_files.FileConfig(stripe_bytes=65_536, index_rows=1_000)
    token_files.write_tokens(df, f"{tmp_path}/t", c)
    files = [f for f in os.listdir(f"{tmp_path}/t") if f.endswith(".orc")]
    told = [orc.ORCFile(f"{tmp_path}/t/{f}") for f in files]
    assert {t.row_index_stride for t in told} == {1_000} and {t.compression for t in told} == {"ZSTD"}
    assert sum(t.nstripes for t in told) > len(files)  # stripes are what readers share out
    found = token_files.look_up(spark, f"{tmp_path}/t", [4_000, 12_346])
    assert {r.doc_id for r in found.collect()} == {4_000, 12_346}
    assert "In(doc_id" in found._jdf.queryExecution().executedPlan().toString() or "Or(EqualTo(doc_id" in found._jdf.queryExecution().executedPlan().toString()
    assert rows_read(found) <= 2 * 1_000  # a row group each, read in batches
    assert rows_read(token_files.look_up(spark, f"{tmp_path}/t", [5_001])) == 0  # inside the bounds of a row group: the Bloom filter tells


def test_starts_don_t_read_ids(spark, tmp_path):
    token_files.write_tokens(documents(spark), f"{tmp_path}/t")
    text = token_files.file_starts(token_files.read_tokens(spark, f"{tmp_path}/t"))._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<part:int,n_tokens:bigint>" in text
