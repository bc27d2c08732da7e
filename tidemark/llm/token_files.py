"""Token ids as ORC files in the order of document ids.

Documents are dealt by ranges of their ids and sorted, so files hold ascending ids and follow one another. Each file is cut
into stripes; ids are run-length encoded integers; every few documents an index entry holds the smallest and largest document
id, and a Bloom filter tells ids that aren't there. A reader takes stripes in parallel, and a look-up by document id reads only
row groups that may hold it. A row knows how many ids lie before it in its file; what lies before the file comes from
one small aggregate over the files' counts, which doesn't touch the ids.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.common import scratch_root, sole_cache, table
from tidemark.llm.packing import PackConfig, _words


@dataclass(frozen=True)
class FileConfig:
    tokens: PackConfig = PackConfig(cached_words=1_000_000)  # the tokenizer and the id that ends a document
    stripe_bytes: int = 16 << 20
    index_rows: int = 1_000  # documents of an index entry; the format takes no fewer
    bloom_error: float = 0.01
    batch_rows: int = 500  # documents handed to the writer at a time


#: part: the file's place among the files; before: ids in the file before this document.
ROWS = "part int, doc_id long, before long, n_tokens long, ids array<int>"


def write_tokens(docs: DataFrame, path: str, config: FileConfig = FileConfig(), id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes the ids of every row, in ascending order of document ids, as ORC files under path.

    Null and empty texts are one end id. Rows with the same id keep the table's order and may fill several files; those without an id
    come first. Very long texts are single rows. An empty table gives files without rows. Other columns are not looked at.
    """
    c = config

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = sole_cache(_words(c.tokens))
        end, part, before = np.array([c.tokens.end_id], "<u4"), TaskContext.get().partitionId(), 0
        for batch in batches:
            for at in range(0, batch.num_rows, c.batch_rows):
                rows = batch.slice(at, c.batch_rows)
                ids = [np.concatenate([words.ids(t), end]) for t in pc.fill_null(rows.column(1), "").to_pylist()]
                sizes = np.array(list(map(len, ids)), np.int64)
                ends = np.concatenate([[0], np.cumsum(sizes)])
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(ids).view("<i4")))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), part, np.int32)), rows.column(0), pa.array(before + ends[:-1]), pa.array(sizes), lists], names=[x.split()[0] for x in ROWS.split(", ")])
                before += int(ends[-1])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.monotonically_increasing_id().alias("_turn"))
    dealt = rows.repartitionByRange("doc_id", "_turn").sortWithinPartitions("doc_id", "_turn").select("doc_id", "text")
    options = {"compression": "zstd", "orc.stripe.size": c.stripe_bytes, "orc.row.index.stride": c.index_rows, "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": c.bloom_error}
    dealt.mapInArrow(run, ROWS).write.options(**options).orc(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(part, doc_id, before, n_tokens, ids) as written; filters on doc_id reach the files' indexes and Bloom filters."""
    return spark.read.schema(ROWS).orc(path)


def file_starts(tokens: DataFrame) -> DataFrame:
    """(part, first): the ids of all files before each. One row a file goes through the window."""
    files = tokens.groupBy("part").agg(F.sum("n_tokens").alias("held"))
    return files.select("part", F.coalesce(F.sum("held").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("first"))


def look_up(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """(doc_id, ids) of the documents with these ids."""
    return read_tokens(spark, path).where(F.col("doc_id").isin(doc_ids)).select("doc_id", "ids")


DIGESTS = "part int, doc_id long, before long, n_tokens long, ids_crc32 long"


def token_digests(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every row in the files: start is the ids of all rows before it, the rest is made of the ids read."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3)
            ids, ends = lists.flatten().to_numpy().astype("<u4"), np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy())]).tolist()
            crc = [zlib.crc32(ids[i:j]) for i, j in zip(ends, ends[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(np.diff(ends).astype(np.int64)), pa.array(crc, pa.int64())], names=[x.split()[0] for x in DIGESTS.split(", ")])

    tokens = read_tokens(spark, path)
    digests = tokens.select("part", "doc_id", "before", "ids").mapInArrow(run, DIGESTS)
    return digests.join(file_starts(tokens), "part").select("doc_id", (F.col("first") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{scratch_root(spark)}/tokens-{uuid.uuid4().hex}"
    write_tokens(table(spark, sf_dir, "documents"), path)
    return token_digests(spark, path)
