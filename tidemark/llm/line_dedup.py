"""Repeated runs of lines, found in a sparse suffix array over line ids, natively.

All documents, in order of their ids, are one sequence of line ids. Only suffixes that begin with a repeated line can
begin a repeated run, so the suffix array holds only those. Prefix doubling ranks them by their first 1, 2, 4, ... lines: the new
rank is the old one plus the number of suffixes of the same old rank with a smaller rank 2^j lines on, which needs only the
counts of distinct rank pairs, summed up in buckets of ranks: no task sorts all followers of one line. Suffixes whose rank becomes unique leave.

Suffixes that share their first l lines are an interval of the suffix array with a longest common prefix of at least l; the
interval is named by the ranks of the first and of the last 2^j of the l lines. A run counts if it has at least
`min_words` words. For that it is enough to look at the intervals of the shortest runs that begin, or end, at each line and reach
min_words: every line of a longer run lies in one of these, and which they are depends on the run's own lines alone, so all copies
agree. What the later copies cover, joined together, are the later copies of the maximal repeated runs; they are deleted.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.common import drop_scratch, materialize, table


@dataclass(frozen=True)
class LineConfig:
    min_words: int = 50
    rank_buckets_bits: int = 16


def _lines(docs: DataFrame, c: LineConfig) -> DataFrame:
    """Lines with a position that grows along each document and from document to document, and the shortest runs around them.

    (pos, doc_id, thash, line_no, left, h, h2, ahead, back): left counts the lines up to the document's end, ahead the lines of
    the shortest run of min_words words from here on, back those of the shortest one that ends here; null where there is none.
    """
    split = docs.select("doc_id", F.xxhash64("text").alias("thash"), F.split("text", "\n").alias("lines")).where(F.col("lines").isNotNull())
    rows = split.select("doc_id", "thash", F.size("lines").alias("n"), F.posexplode("lines").alias("line_no", "line"))
    words = F.least(F.regexp_count("line", F.lit("[^ \\t\\r\\f\\n]+")), F.lit(c.min_words)).cast("long")
    rows = materialize(rows.select("doc_id", "thash", "n", "line_no", F.xxhash64("line").alias("h"), F.hash("line").alias("h2"), words.alias("w")), "lines-raw")
    ranged = rows.dropDuplicates(["doc_id", "thash", "line_no"]).repartitionByRange("doc_id", "thash")
    doc = Window.partitionBy("doc_id", "thash")
    summed = ranged.select("*", F.sum("w").over(doc.orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)).alias("upto"))
    summed = summed.select("*", (F.col("upto") - F.col("w")).alias("before"), F.max("upto").over(doc).alias("total"))
    m = c.min_words
    stop = F.min("line_no").over(doc.orderBy("before").rangeBetween(m, 2 * m - 1))
    start = F.max("line_no").over(doc.orderBy("upto").rangeBetween(-(2 * m - 1), -m)) + 1
    found = summed.select("*", stop.alias("stop"), start.alias("start"))
    ahead = F.coalesce("stop", F.when(F.col("total") - F.col("before") >= m, F.col("n"))) - F.col("line_no")
    back = F.col("line_no") + 1 - F.coalesce("start", F.when(F.col("upto") >= m, F.lit(0)))
    ordered = found.select("doc_id", "thash", "line_no", (F.col("n") - F.col("line_no")).alias("left"), "h", "h2", ahead.alias("ahead"), back.alias("back")).sortWithinPartitions("doc_id", "thash", "line_no")
    out = materialize(ordered.select(F.monotonically_increasing_id().alias("pos"), "*"), "lines")
    drop_scratch(rows)
    return out


def _first_ranks(lines: DataFrame, c: LineConfig) -> DataFrame:
    """Suffixes that begin with a repeated line, ranked by it: the number of such suffixes whose line hashes lower."""
    repeated = lines.groupBy("h", "h2").agg(F.count("*").alias("c")).where("c > 1").withColumn("bucket", F.shiftright("h", 64 - c.rank_buckets_bits))
    repeated = materialize(repeated, "line-groups")
    sums = repeated.groupBy("bucket").agg(F.sum("c").alias("c"))  # at most 2**rank_buckets_bits rows
    base = sums.select("bucket", (F.sum("c").over(Window.orderBy("bucket")) - F.col("c")).alias("base"))
    inner = F.sum("c").over(Window.partitionBy("bucket").orderBy("h", "h2")) - F.col("c")
    ranks = repeated.select("h", "h2", "bucket", inner.alias("inner")).join(base, "bucket").select("h", "h2", (F.col("base") + F.col("inner")).alias("rank"))
    out = materialize(lines.join(ranks, ["h", "h2"]).select("pos", "doc_id", "thash", "line_no", "left", "ahead", "back", "rank"), "suffixes")
    drop_scratch(repeated)
    return out


def _doubled(ranked: DataFrame, size: int, width: int) -> DataFrame:
    """(pos, left, rank) by the first 2 * size lines, of (pos, left, rank) by the first size; unique suffixes leave.

    The followers of one rank are dealt into buckets of `width` ranks; sums over buckets give each bucket's base.
    """
    after = ranked.select((F.col("pos") - size).alias("pos"), F.col("rank").alias("next"))
    pairs = materialize(ranked.where(F.col("left") >= 2 * size).join(after, "pos"), "line-pairs")
    counted = pairs.groupBy("rank", "next").agg(F.count("*").alias("c")).where("c > 1")
    groups = materialize(counted.withColumn("bucket", F.floor(F.col("next") / width)), "line-groups")
    sums = groups.groupBy("rank", "bucket").agg(F.sum("c").alias("c"))  # at most 2**rank_buckets_bits rows a rank
    base = sums.select("rank", "bucket", (F.sum("c").over(Window.partitionBy("rank").orderBy("bucket")) - F.col("c")).alias("base"))
    inner = F.sum("c").over(Window.partitionBy("rank", "bucket").orderBy("next")) - F.col("c")
    named = groups.select("rank", "bucket", "next", inner.alias("inner")).join(base, ["rank", "bucket"]).select("rank", "next", (F.col("rank") + F.col("base") + F.col("inner")).alias("own"))
    named = materialize(named, "line-names")  # read anew, so that AQE can split the rows of a frequent pair
    out = materialize(pairs.join(named, ["rank", "next"]).select("pos", "left", F.col("own").alias("rank")), "suffixes")
    for used in (pairs, groups, named):
        drop_scratch(used)
    return out


def repeated_runs(docs: DataFrame, config: LineConfig = LineConfig()) -> DataFrame:
    """(doc_id, thash, first_line, end_line): the maximal stretches of lines that are later copies of repeated runs.

    The earlier copy is the one in the document with the smaller id (null first), or further up in the same document.
    """
    c = config
    lines = _lines(docs, c)
    suffixes = _first_ranks(lines, c)
    drop_scratch(lines)
    at = ["doc_id", "thash"]
    forward = suffixes.where("ahead is not null").select(*at, "line_no", "pos", F.col("ahead").cast("long").alias("size"))
    backward = suffixes.where("back > 1").select(*at, (F.col("line_no") - F.col("back") + 1).alias("line_no"), (F.col("pos") - F.col("back") + 1).alias("pos"), F.col("back").cast("long").alias("size"))
    windows = materialize(forward.union(backward).distinct(), "line-windows")
    longest = windows.agg(F.max("size")).first()[0] or 0
    width = ((suffixes.agg(F.max("rank")).first()[0] or 0) >> c.rank_buckets_bits) + 1
    ranked, size, later = suffixes.select("pos", "left", "rank"), 1, []
    levels = []
    while size <= longest:
        own = windows.where((F.col("size") >= size) & (F.col("size") < 2 * size))
        first = ranked.select("pos", F.col("rank").alias("a"))
        last = ranked.select(F.col("pos").alias("tail"), F.col("rank").alias("b"))
        keyed = materialize(own.join(first, "pos").withColumn("tail", F.col("pos") + F.col("size") - size).join(last, "tail"), "line-keyed")
        interval = keyed.groupBy("size", "a", "b").agg(F.min("pos").alias("first"), F.count("*").alias("c")).where("c > 1").drop("c")
        interval = materialize(interval, "line-intervals")  # read anew, so that AQE can split the rows of a frequent run
        later.append(materialize(keyed.join(interval, ["size", "a", "b"]).where("pos > first").select(*at, "line_no", "size"), "line-later"))
        for used in (keyed, interval):
            drop_scratch(used)
        if 2 * size > longest:
            break
        ranked = _doubled(ranked, size, width)
        levels.append(ranked)
        size *= 2
    for used in (*levels, suffixes, windows):
        drop_scratch(used)
    if not later:
        return docs.sparkSession.createDataFrame([], "doc_id long, thash long, first_line int, end_line int")
    covered = later[0]
    for more in later[1:]:
        covered = covered.union(more)
    spans = covered.select(*at, F.col("line_no").cast("int").alias("first_line"), (F.col("line_no") + F.col("size")).cast("int").alias("end_line"))
    along = Window.partitionBy(*at).orderBy("first_line", "end_line")
    seen = F.max("end_line").over(along.rowsBetween(Window.unboundedPreceding, -1))
    opened = spans.select("*", F.when(F.col("first_line") <= seen, 0).otherwise(1).alias("opens"))
    stretches = opened.select("*", F.sum("opens").over(along.rowsBetween(Window.unboundedPreceding, 0)).alias("stretch"))
    runs = stretches.groupBy(*at, "stretch").agg(F.min("first_line").alias("first_line"), F.max("end_line").alias("end_line")).drop("stretch")
    out = materialize(runs, "line-runs")
    for used in later:
        drop_scratch(used)
    return out


def _decided(docs: DataFrame, config: LineConfig) -> DataFrame:
    """(doc, kept, n_lines, n_deleted) of every row: doc holds all of its columns, kept is the text that stays."""
    runs = repeated_runs(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), config)
    stretch = F.array_sort(F.collect_list(F.struct("first_line", "end_line")))
    per_doc = runs.groupBy("doc_id", "thash").agg(stretch.alias("runs")).withColumnRenamed("doc_id", "id")
    rows = docs.select(F.struct(*(F.col(f"`{x}`") for x in docs.columns)).alias("doc"), F.col("doc_id").cast("long").alias("own_id"), F.xxhash64("text").alias("own_hash"))
    per_doc = per_doc.hint("merge")  # one plan at all sizes: texts are dealt by id, and the list of runs grows with them
    joined = rows.join(per_doc, F.col("own_id").eqNullSafe(F.col("id")) & (F.col("own_hash") == F.col("thash")), "left")
    text = F.col("doc")["text"]
    lines = F.split(text, "\n")
    begins = F.concat(F.array(F.lit(0)), F.transform("runs", lambda r: r["end_line"]))
    ends = F.concat(F.transform("runs", lambda r: r["first_line"]), F.array(F.size(lines)))
    kept = F.flatten(F.zip_with(begins, ends, lambda a, b: F.slice(lines, a + 1, b - a)))
    deleted = F.aggregate("runs", F.lit(0), lambda total, r: total + r["end_line"] - r["first_line"])
    return joined.select(
        "doc",
        F.when(F.col("runs").isNull(), text).otherwise(F.array_join(kept, "\n")).alias("kept"),
        F.when(text.isNull(), 0).otherwise(F.size(lines)).cast("long").alias("n_lines"),
        F.coalesce(deleted, F.lit(0)).cast("long").alias("n_deleted"),
    )


def delete_repeats(docs: DataFrame, config: LineConfig = LineConfig()) -> DataFrame:
    """docs with _text (lines of later copies deleted), _lines and _deleted (their numbers) added; columns of these names are replaced.

    Lines are compared exactly. Null texts stay null with 0 lines, an empty text is one empty line. Rows that repeat both id
    and text are one document with one decision. If all lines go, the text is empty. An empty table stays empty.
    """
    added = {"_text": "kept", "_lines": "n_lines", "_deleted": "n_deleted"}
    own = [F.col("doc")[x].alias(x) for x in docs.columns if x not in added]
    return _decided(docs, config).select(*own, *(F.col(v).alias(k) for k, v in added.items()))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return delete_repeats(docs).select("doc_id", F.col("_lines").alias("n_lines"), F.col("_deleted").alias("n_deleted"), F.col("_text").alias("text"))


OP5_SQL = """
WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL),
l AS (SELECT doc_id, ls, unnest(range(len(ls))) AS i FROM d),
w AS (SELECT *, least(len(regexp_extract_all(ls[i + 1], '[^ \\t\\r\\f\\n]+')), 50) AS w FROM l),
s AS (SELECT *, sum(w) OVER (PARTITION BY doc_id ORDER BY i) AS upto, sum(w) OVER (PARTITION BY doc_id ORDER BY i) - w AS before, sum(w) OVER (PARTITION BY doc_id) AS total FROM w),
e AS (SELECT *, min(i) OVER (PARTITION BY doc_id ORDER BY before RANGE BETWEEN 50 FOLLOWING AND 99 FOLLOWING) AS stop,
      max(i) OVER (PARTITION BY doc_id ORDER BY upto RANGE BETWEEN 99 PRECEDING AND 50 PRECEDING) + 1 AS start FROM s),
r AS (SELECT doc_id, ls, i AS a, coalesce(stop, CASE WHEN total - before >= 50 THEN len(ls) END) AS b FROM e
      UNION SELECT doc_id, ls, coalesce(start, CASE WHEN upto >= 50 THEN 0 END), i + 1 FROM e),
k AS (SELECT doc_id, a, b, array_to_string(ls[a + 1:b], chr(10)) AS run FROM r WHERE a IS NOT NULL AND b IS NOT NULL),
f AS (SELECT *, row_number() OVER (PARTITION BY run, b - a ORDER BY doc_id, a) AS copy FROM k),
x AS (SELECT DISTINCT doc_id, unnest(range(a, b)) AS i FROM f WHERE copy > 1),
g AS (SELECT doc_id, list(i) AS gone FROM x GROUP BY doc_id)
SELECT t.doc_id, coalesce(len(string_split(t.text, chr(10))), 0) AS n_lines, coalesce(len(gone), 0) AS n_deleted,
       CASE WHEN gone IS NULL THEN t.text ELSE coalesce(array_to_string(list_filter(string_split(t.text, chr(10)), lambda y, j: NOT list_contains(gone, j - 1)), chr(10)), '') END AS text
FROM documents t LEFT JOIN g USING (doc_id)
"""


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: later copies of repeated runs go from the texts; n_chars is counted anew. All documents stay, but those without text left."""
    done = _decided(docs, LineConfig()).where((F.col("n_deleted") == 0) | (F.length("kept") > 0))
    fresh = {"text": F.col("kept"), "n_chars": F.when(F.col("n_deleted") > 0, F.length("kept").cast("long")).otherwise(F.col("doc")["n_chars"])}
    return done.select(*(fresh.get(x, F.col("doc")[x]).alias(x) for x in docs.columns))
