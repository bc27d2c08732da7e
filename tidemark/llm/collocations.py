"""Collocations by stripes.

A stripe is a counter of what follows a prefix. Texts are gathered into blocks of numbered words. In each round every block makes
the stripes of its frequent phrases of k words, Spark merges the stripes of a prefix element by element, and the entries that
reach the least count, the phrases of k + 1 words, go back to the blocks that hold them. A phrase of k + 1 words can only be
frequent where its first and its last k words are, so a round looks only at places where both are known. The entry of a stripe is
named by the phrase of k words one place further on: with the prefix it gives the next word, the rest of the phrase after any cut, and
both one-word extensions of which a shorter phrase may be a mere part.

A stripe is cut into parts by the hash of its entries, the more the oftener its prefix occurs, so the stripe of a very common word is
not one group; a block hands in each entry once, with its count, and lays the stripes of a bucket of prefixes end to end in one row.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.common import drop_scratch, materialize, table


@dataclass(frozen=True)
class PhraseConfig:
    longest: int = 5
    least: int = 100  # occurrences of a candidate
    part_of: int = 100  # percent of a phrase's occurrences from which a longer one takes its place
    top: int = 2000  # of a language in the report
    block_words: int = 1_500_000  # a block ends after the document that reaches this
    buckets: int = 2048  # of prefixes and parts; tasks that merge stripes are no more than these
    word_parts: int = 64  # parts of the stripe of all words of a language
    part_count: int = 100_000  # occurrences of a prefix from which its stripe has one more part


UNKNOWN = "und"
#: A block has one row with `places`: numbers of its entries along its texts, squeezed. Other rows are parts of its stripes: what the entries
#: are (words of a language, or heads and tails), their counts in the block and their numbers there, listed or from `start` on.
_STRIPES = "block long, places binary, lang string, bucket int, words array<string>, heads array<long>, tails array<long>, counts array<int>, entries array<int>, start int"
_TYPES = [pa.int64(), pa.binary(), pa.string(), pa.int32(), pa.list_(pa.string()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.int32()]
_NAMES = [x.split()[0] for x in _STRIPES.split(", ")]

_ENTRY_BITS = 27  # of a phrase's name: its entry in a block; then 14 bits for the block in its partition and 22 for the partition
_BREAK = b"\xff"  # no byte of UTF-8
_LOWER = bytes.maketrans(bytes(range(65, 91)) + b".,;:!?\x0b\x0c\r\t", bytes(range(97, 123)) + b"\n" * 9 + b" ")


class _Numbers(dict):
    def __missing__(self, word):
        self[word] = n = len(self)
        return n


def _split(bounds: np.ndarray, values: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(values, kind))


def _squeeze(places: np.ndarray) -> bytes:
    """Numbers from -1 on, byte by byte of all of them."""
    import zstandard

    return zstandard.compress((places + 1).astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), 3)


def _places(data: bytes) -> np.ndarray:
    import zstandard

    return np.frombuffer(zstandard.decompress(data), np.uint8).reshape(4, -1).T.copy().view("<u4").ravel().astype(np.int64) - 1


def _columns(n: int, **known) -> list:
    return [known[x] if x in known else pa.nulls(n, t) for x, t in zip(_NAMES, _TYPES, strict=True)]


def _batch(n: int, **known) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(_columns(n, **known), names=_NAMES)


def _grouped(keys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The order that brings equal keys together, and where groups begin in it, with the end."""
    order = np.lexsort(keys[::-1])
    changed = reduce(np.logical_or, ((k := x[order])[1:] != k[:-1] for x in keys))
    return order, np.concatenate([[0], np.flatnonzero(changed) + 1, [len(order)]])


def word_blocks(docs: DataFrame, c: PhraseConfig, lang_col: str, text_col: str) -> DataFrame:
    """Blocks of numbered words with the stripes of all words: one prefix a language."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 14
        numbers: dict[str, _Numbers] = {}
        held: list[tuple[str, np.ndarray]] = []
        words = 0
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                lang, text = UNKNOWN if lang is None else lang, text.as_py()
                found = (text or "").encode().translate(_LOWER).replace(b"\n", b" \xff ").split(b" ")
                own = numbers.setdefault(lang, _Numbers({_BREAK: 0, b"": 1}))
                places = np.fromiter(map(own.__getitem__, found), np.int32, len(found))
                held.append((lang, places[places != 1]))
                words += len(found)
                if words >= c.block_words:
                    yield from _first_stripes(block, numbers, held, c)
                    block, numbers, held, words = block + 1, {}, [], 0
        yield from _first_stripes(block, numbers, held, c)

    return docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text")).mapInArrow(run, _STRIPES)


def _first_stripes(block: int, numbers: dict[str, _Numbers], held: list[tuple[str, np.ndarray]], c: PhraseConfig) -> Iterator[pa.RecordBatch]:
    if not held:
        return
    first, at = {}, 0  # languages' words have numbers of their own, one after the other
    for lang, own in numbers.items():
        first[lang], at = at, at + len(own) - 2
    places = np.concatenate([np.concatenate([np.where(p, p + (first[lang] - 2), -1), [-1]]) for lang, p in held]).astype(np.int32)
    counts = np.bincount(places[places >= 0], minlength=at)
    turn = np.empty(at + 1, np.int32)  # common words get small numbers, which squeeze well; -1 stays
    turn[np.argsort(-counts, kind="stable")], turn[at] = np.arange(at), -1
    yield _batch(1, block=pa.array([block]), places=pa.array([_squeeze(turn[places])]))
    for lang, own in numbers.items():
        n = len(own) - 2
        if n:
            words = pa.array(list(own)[2:], pa.binary()).cast(pa.string())
            part = np.fromiter((zlib.crc32(w) % c.word_parts for w in own), np.int64, n + 2)[2:]
            order, bounds = _grouped([part])
            m = len(bounds) - 1
            yield _batch(
                m, block=pa.array(np.full(m, block)), lang=pa.array([lang] * m), words=pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), words.take(pa.array(order))), bucket=pa.array(part[order[bounds[:-1]]], pa.int32()),
                counts=_split(bounds, counts[first[lang] + order], pa.int32()), entries=_split(bounds, turn[first[lang] + order], pa.int32()),
            )


def _mix(x: np.ndarray) -> np.ndarray:
    """A hash of numbers, as unsigned 64 bits."""
    x = x.astype(np.uint64)
    for shift, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(33))


def longer_stripes(blocks: DataFrame, merged: DataFrame, c: PhraseConfig) -> DataFrame:
    """The blocks of the next round: places of phrases one word longer, and the stripes of the phrases that are frequent."""
    def run(block: pa.Table, told: pa.Table) -> pa.Table:
        empty = pa.Table.from_batches([_batch(0)])
        if not len(block) or not len(told):
            return empty
        number, places = block["block"][0].as_py(), _places(block["places"][0].as_py())
        entry, phrase, parts = (told[x].to_numpy() for x in ("entry", "phrase", "parts"))
        known = np.full(max(int(places.max()), int(entry.max())) + 1, -1, np.int64)
        known[entry] = np.arange(len(entry))
        at = np.where(places >= 0, known[places], -1)
        here = np.flatnonzero((at[:-1] >= 0) & (at[1:] >= 0))
        if not len(here):
            return empty
        codes, own, counts = np.unique(at[here] * len(entry) + at[here + 1], return_inverse=True, return_counts=True)
        head, tail = codes // len(entry), phrase[codes % len(entry)]
        part = _mix(tail) % parts[head].astype(np.uint64)
        head = phrase[head]
        bucket = (_mix(head + part.astype(np.int64)) % np.uint64(c.buckets)).astype(np.int64)
        order = np.lexsort((tail, head, bucket))  # entries are numbered in this order
        bounds = np.concatenate([[0], np.flatnonzero(np.diff(bucket[order])) + 1, [len(order)]])
        number_of = np.empty(len(order), np.int64)
        number_of[order] = np.arange(len(order))
        after = np.full(len(at), -1, np.int64)
        after[here] = number_of[own]
        after = after[(after >= 0) | np.concatenate([[False], after[:-1] >= 0])]  # one -1 is enough between runs
        m = len(bounds) - 1
        stripes = _batch(
            m, block=pa.array(np.full(m, number)), bucket=pa.array(bucket[order[bounds[:-1]]], pa.int32()), start=pa.array(bounds[:-1], pa.int32()),
            heads=_split(bounds, head[order], pa.int64()), tails=_split(bounds, tail[order], pa.int64()), counts=_split(bounds, counts[order], pa.int32()),
        )
        return pa.Table.from_batches([_batch(1, block=pa.array([number]), places=pa.array([_squeeze(after)])), stripes])

    told = merged.select(F.col("block").alias("to"), "entry", "phrase", F.least(1 + F.floor(F.col("total") / c.part_count), F.lit(1 << 30)).cast("int").alias("parts"))
    return blocks.where("places is not null").select("block", "places").groupBy("block").cogroup(told.groupBy("to")).applyInArrow(run, _STRIPES)


def merged_stripes(blocks: DataFrame, c: PhraseConfig) -> DataFrame:
    """(block, entry, phrase, total, own, item columns) of the frequent entries of each block.

    Stripes meet by their bucket, once; their entries are added up there. A phrase is named by the first of its entries, block and number
    in one; the row of that entry alone, `own`, says what the phrase is: lang and word, or head and tail.
    """
    stripes, item = blocks.where("places is null"), ["lang", "word"] if "words" in blocks.columns else ["head", "tail"]
    if "words" in blocks.columns:
        dealt = stripes.select("block", "lang", "bucket", "words", "counts", "entries").repartition("lang", "bucket")
        each = F.explode(F.arrays_zip(F.col("words").alias("word"), F.col("counts").alias("n"), F.col("entries").alias("entry"))).alias("e")
        rows = dealt.select("block", "lang", "bucket", each).select("block", "lang", "bucket", "e.word", "e.n", "e.entry")
        same = Window.partitionBy("lang", "bucket", "word")
    else:
        dealt = stripes.select("block", "bucket", "start", "heads", "tails", "counts").repartition("bucket")
        each = F.posexplode(F.arrays_zip(F.col("heads").alias("head"), F.col("tails").alias("tail"), F.col("counts").alias("n"))).alias("at", "e")
        rows = dealt.select("block", "bucket", "start", each).select("block", "bucket", "e.head", "e.tail", "e.n", (F.col("start") + F.col("at")).alias("entry"))
        same = Window.partitionBy("bucket", "head", "tail")
    name = F.shiftleft("block", _ENTRY_BITS).bitwiseOR(F.col("entry").cast("long"))
    totals = rows.select("block", "entry", *item, F.sum("n").over(same).alias("total"), F.min(name).over(same).alias("phrase"), name.alias("_name")).where(F.col("total") >= c.least)
    own = F.col("phrase") == F.col("_name")
    return totals.select("block", "entry", "phrase", "total", own.alias("own"), *(F.when(own, F.col(x)).alias(x) for x in item))


def phrases(docs: DataFrame, config: PhraseConfig = PhraseConfig(), lang_col: str = "lang", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(words per language: lang, n) and the frequent phrases of two words or more that no longer one replaces: phrase (a number among those
    of its length), lang, words, total, heads, tails, head, tail. heads[k - 1] and tails[k - 1] count the first k words and those after them.

    A longer phrase that holds another one as often as it occurs holds an extension of it by a word as often, so only those are looked at.
    """
    c = config
    blocks = materialize(word_blocks(docs, c, lang_col, text_col), "phrase-blocks")
    first = blocks.where("places is null").select("lang", F.aggregate("counts", F.lit(0).cast("long"), lambda s, x: s + x).alias("n"))
    lengths = materialize(first.groupBy("lang").agg(F.sum("n").alias("n")), "phrase-words")
    none = F.array().cast("array<long>")
    found = []
    for k in range(1, c.longest + 1):
        merged = materialize(merged_stripes(blocks if k == 1 else blocks.drop("words"), c), "phrase-merged")
        own = merged.where("own")
        if k == 1:
            level = own.select("phrase", "lang", F.array("word").alias("words"), "total", none.alias("heads"), none.alias("tails"), F.lit(0).cast("long").alias("head"), F.lit(0).cast("long").alias("tail"))
        else:
            h = before.select(F.col("phrase").alias("head"), "lang", F.col("words").alias("h_words"), F.concat(F.col("heads"), F.array("total")).alias("heads"))
            t = before.select(F.col("phrase").alias("tail"), F.element_at("words", -1).alias("last"), F.concat(F.array("total"), F.col("tails")).alias("tails"))
            level = own.select("phrase", "head", "tail", "total").join(h, "head").join(t, "tail").select("phrase", "lang", F.concat("h_words", F.array("last")).alias("words"), "total", "heads", "tails", "head", "tail")
        level = materialize(level, "phrases")
        found.append(level)
        before = level
        if k < c.longest:
            after = materialize(longer_stripes(blocks, merged, c), "phrase-blocks")
            drop_scratch(blocks)
            drop_scratch(merged)
            blocks = after
    kept = []
    for level, longer in zip(found[1:], [*found[2:], None], strict=True):
        if longer is None:
            kept.append(level)
            continue
        sides = longer.select(F.col("head").alias("phrase"), F.col("total").alias("most")).unionAll(longer.select(F.col("tail").alias("phrase"), F.col("total").alias("most")))
        most = sides.groupBy("phrase").agg(F.max("most").alias("most"))
        kept.append(level.join(most, "phrase", "left").where(F.col("most").isNull() | (100 * F.col("most") < c.part_of * F.col("total"))).drop("most"))
    return lengths, reduce(DataFrame.unionAll, kept) if kept else found[0].limit(0)


def collocations(docs: DataFrame, config: PhraseConfig = PhraseConfig(), lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): per language the first phrases by score, then count, then text.

    A phrase counts all its occurrences inside pieces of texts, overlapping ones too. Its score is the lowest of 1000 * a * n / (l * r) over
    its cuts into two parts, rounded down, the first of equal ones. Candidates that only occur inside a longer one are left out. Null and
    empty texts have no words; a null language is `und`, together with texts whose language says so. Repeated rows count again. An empty
    table gives an empty result. Very long texts are cut into blocks of their own. Other columns are not looked at.
    """
    lengths, found = phrases(docs, config, lang_col, text_col)
    exact = lambda x: x.cast("decimal(18,0)")
    rows = found.join(lengths, "lang").withColumn("a", F.col("total"))
    above = F.lit(1000).cast("decimal(4,0)") * exact(F.col("a")) * exact(F.col("n"))
    cuts = F.transform(F.sequence(F.lit(0), F.size("heads") - 1), lambda i: F.struct(F.call_function("div", above, exact(F.col("heads")[i]) * exact(F.col("tails")[i])).alias("score"), i.alias("k"), F.col("heads")[i].alias("l"), F.col("tails")[i].alias("r")))
    scored = rows.select("lang", F.array_join("words", " ").alias("phrase"), "a", "n", F.array_min(cuts).alias("cut"))
    order = Window.partitionBy("lang").orderBy(F.col("cut.score").desc(), F.col("a").desc(), "phrase")
    ranked = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= config.top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "cut.l", "cut.r", "n", F.col("cut.score").cast("long").alias("score"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


OP12_SQL = """
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM pieces),
n AS (SELECT lang, CAST(sum(len(w)) AS HUGEINT) AS n FROM w GROUP BY 1),
grams AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase FROM (SELECT lang, w, k, unnest(range(1, CAST(len(w) AS BIGINT) - k + 2)) AS i FROM w, (SELECT unnest(range(1, 6)) AS k))),
f AS (SELECT lang, k, phrase, CAST(count(*) AS HUGEINT) AS a FROM grams GROUP BY ALL HAVING count(*) >= 100),
cuts AS (SELECT lang, k, phrase, a, string_split(phrase, ' ') AS p, unnest(range(1, k)) AS cut FROM f WHERE k >= 2),
scored AS (
  SELECT c.lang, c.phrase, c.k, c.a, c.cut, x.a AS l, y.a AS r, n.n, 1000 * c.a * n.n // (x.a * y.a) AS score FROM cuts c JOIN n ON n.lang = c.lang
  JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(p[1:cut], ' ') JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(p[cut + 1:], ' ')),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
inner_ AS (
  SELECT lang, a, array_to_string(p[s:s + m - 1], ' ') AS phrase FROM (SELECT lang, a, p, m, unnest(range(1, k - m + 2)) AS s FROM (SELECT lang, k, a, string_split(phrase, ' ') AS p, unnest(range(2, k)) AS m FROM f WHERE k > 2))),
most AS (SELECT lang, phrase, max(a) AS most FROM inner_ GROUP BY 1, 2),
kept AS (SELECT b.* FROM best b LEFT JOIN most m ON m.lang = b.lang AND m.phrase = b.phrase WHERE m.most IS NULL OR 100 * m.most < 100 * b.a)
SELECT lang, CAST(row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS BIGINT) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM kept QUALIFY rank <= 2000"""
