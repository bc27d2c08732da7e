"""String similarity that has no built-in form: small helpers over Arrow batches of distinct pairs."""

from __future__ import annotations

import hashlib
from difflib import SequenceMatcher
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Weights of a title's score, and the least length of a word that matches by ratio.
OVERLAP_WEIGHT, RATIO_WEIGHT, LONG_TOKEN = 0.62, 0.38, 4


@lru_cache(maxsize=50_000)
def ratio(left: str, right: str) -> float:
    return SequenceMatcher(None, left, right).ratio() if left != right else 1.0


def fuzzy_overlap(left: list[str], right: list[str], least: float) -> float:
    """Jaccard of token lists where tokens of four letters or more may match by ratio; greedy in the left list's order. The plain rule: overlap_column does it on pairs."""
    if not left or not right:
        return float(not left and not right)
    rest, hits = list(right), 0
    for token in left:
        at = rest.index(token) if token in rest else None
        if at is None and len(token) >= LONG_TOKEN:
            best = max(((ratio(token, x), -i) for i, x in enumerate(rest) if len(x) >= LONG_TOKEN), default=(0.0, 0))
            at = -best[1] if best[0] >= least else None
        if at is not None:
            rest.pop(at)
            hits += 1
    return hits / (len(left) + len(right) - hits)


def overlap_column(left: Column, right: Column, near: Column) -> Column:
    """fuzzy_overlap of two token columns, given the left side's `near`: token -> {alike token -> ratio}.

    The state is what is left of the right list; a hit takes one token out, so that hits are what the list lost.
    """
    without = lambda rest, at: F.concat(F.slice(rest, F.lit(1), at - 1), F.slice(rest, at + 1, F.size(rest)))
    blank = F.array().cast("array<struct<ratio:double,at:int>>")

    def place(rest: Column, token: Column) -> Column:
        mine = F.try_element_at(near, token)
        alike = F.filter(F.transform(rest, lambda x, i: F.struct(F.try_element_at(mine, x).alias("ratio"), (-i).alias("at"))), lambda x: x["ratio"].isNotNull())
        best = F.array_max(F.when(mine.isNotNull(), alike).otherwise(blank))
        return F.coalesce(F.nullif(F.array_position(rest, token).cast("int"), F.lit(0)), 1 - best["at"], F.lit(0))

    rest = F.aggregate(left, right, lambda rest, token: F.when(place(rest, token) > 0, without(rest, F.greatest(place(rest, token), F.lit(1)))).otherwise(rest))
    hits = F.size(right) - F.size(rest)
    return F.when((F.size(left) == 0) | (F.size(right) == 0), (F.size(left) == F.size(right)).cast("double")).otherwise(hits / (F.size(left) + F.size(right) - hits).cast("double"))


def exact_overlap(left: Column, right: Column) -> Column:
    """overlap_column where no other token is alike one of the left side's: hits are what numbered tokens both have."""
    hits = F.size(F.array_intersect(left, right))
    return F.when((F.size(left) == 0) | (F.size(right) == 0), (F.size(left) == F.size(right)).cast("double")).otherwise(hits / (F.size(left) + F.size(right) - hits).cast("double"))


def bag_ratio(left: Column, right: Column) -> Column:
    """No ratio of two strings is above this: twice the characters they share in any order, over all of them. The columns are numbered characters."""
    size = F.size(left) + F.size(right)
    return F.when(size == 0, 1.0).otherwise(2 * F.size(F.array_intersect(left, right)) / size.cast("double"))


def title_score(overlap: float, a: str, b: str) -> float:
    """Score of two titles from their overlap and the ratio of their sorted words."""
    return round(OVERLAP_WEIGHT * overlap + RATIO_WEIGHT * (ratio(a, b) if a and b else float(not a and not b)), 4)


def title_bound(overlap: Column, bag: Column) -> Column:
    """No title score of a pair is above this."""
    return F.least(F.lit(1.0), OVERLAP_WEIGHT * overlap + RATIO_WEIGHT * bag + 1e-4)


@lru_cache(maxsize=200_000)
def gram_place(gram: str, dimension: int) -> tuple[int, float]:
    """Where a gram counts, and its sign."""
    digest = hashlib.sha256(gram.encode()).digest()
    return int.from_bytes(digest[:4], "little") % dimension, -1.0 if digest[4] % 2 else 1.0


@lru_cache(maxsize=100_000)
def gram_vector(text: str, dimension: int) -> np.ndarray:
    """Signed counts of the hashed 2- and 3-grams of the padded text."""
    padded, sums = f"  {text.lower()}  ", [0.0] * dimension
    for size in (2, 3):
        for i in range(len(padded) - size + 1):
            at, sign = gram_place(padded[i : i + size], dimension)
            sums[at] += sign
    return np.array(sums, np.int32)


def gram_cosines(left: list[str], right: list[str], dimension: int) -> np.ndarray:
    """Cosines of the n-gram vectors of pairs of texts. Products are sums of whole numbers, so no order changes them."""
    texts, at = np.unique(np.array([*left, *right], object), return_inverse=True)
    vectors = np.array([gram_vector(x, dimension) for x in texts], np.float64).reshape(len(texts), dimension)
    squares = (vectors * vectors).sum(axis=1)
    a, b = at[: len(left)], at[len(left) :]
    size = np.sqrt(squares[a] * squares[b])
    dots = np.concatenate([np.einsum("ij,ij->i", vectors[a[i : i + 4096]], vectors[b[i : i + 4096]]) for i in range(0, max(1, len(a)), 4096)])
    return np.clip(np.divide(dots, size, out=np.zeros(len(a)), where=size > 0), 0.0, 1.0)


def gram_cosine(left: str, right: str, dimension: int) -> float:
    return float(gram_cosines([left], [right], dimension)[0])


def document_cosine(dimension: int):
    """UDF of (left document, right document): the cosine of their n-gram vectors."""
    @F.pandas_udf("double")
    def scores(left: pd.Series, right: pd.Series) -> pd.Series:
        return pd.Series(gram_cosines(list(left), list(right), dimension), dtype="float64")

    return scores


def title_scores():
    """UDF of (overlap of the words, left words sorted, right ones): the titles' part of text_scores."""
    @F.pandas_udf("double")
    def scores(overlap: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([title_score(*x) for x in zip(overlap, a, b)], dtype="float64")

    return scores


def text_scores(dimension: int):
    """UDF of (overlap of the words, left words sorted, right ones, left document, right document)."""
    @F.pandas_udf("title double, embedding double")
    def scores(overlap: pd.Series, a: pd.Series, b: pd.Series, left: pd.Series, right: pd.Series) -> pd.DataFrame:
        titles = [title_score(*x) for x in zip(overlap, a, b)]
        return pd.DataFrame({"title": pd.Series(titles, dtype="float64"), "embedding": pd.Series(gram_cosines(list(left), list(right), dimension), dtype="float64")})

    return scores


def cosine(left, right):
    """Cosine of two array columns in [0, 1]; 0 for other lengths or zero vectors."""
    dot = F.aggregate(F.zip_with(left, right, lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda s, x: s + x)
    norm = lambda v: F.sqrt(F.aggregate(F.transform(v, lambda a: a.cast("double") * a.cast("double")), F.lit(0.0), lambda s, x: s + x))
    size = norm(left) * norm(right)
    return F.when((F.size(left) == F.size(right)) & (size > 0), F.least(F.lit(1.0), F.greatest(F.lit(0.0), dot / size))).otherwise(0.0)


def ratio_column():
    """UDF of (left, right): the ratio of two strings."""
    @F.pandas_udf("double")
    def ratios(left: pd.Series, right: pd.Series) -> pd.Series:
        return pd.Series([ratio(a, b) for a, b in zip(left, right)], dtype="float64")

    return ratios


def _grams(s, size: int):
    """Distinct substrings of a length."""
    return F.when(F.length(s) >= size, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(s) - size + 1), lambda i: F.substring(s, i, F.lit(size))))).otherwise(F.array().cast("array<string>"))


def _containing(outer: DataFrame, inner: DataFrame) -> DataFrame:
    """(o, i): every string of outer with those of inner that lie in it. An inner one is looked for by its rarest three characters, or all if it is shorter."""
    held = outer.select("o", F.explode(F.concat(*(_grams(F.col("o"), n) for n in (1, 2, 3)))).alias("gram"))
    often = held.groupBy("gram").agg(F.count("*").alias("n"))
    own = F.when(F.length("i") >= 3, _grams(F.col("i"), 3)).otherwise(F.array("i"))
    sought = inner.select("i", F.explode(own).alias("gram")).join(often, "gram", "left")
    rarest = sought.groupBy("i").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("rarest")).where("rarest.n > 0").select("i", F.col("rarest.gram").alias("gram"))
    return held.join(rarest, "gram").where(F.contains("o", "i")).select("o", "i")


def _ranked(strings: DataFrame, often: DataFrame, least: float) -> DataFrame:
    """(s, size, all tokens, pos, token) of the prefix of every string: its characters, numbered where they repeat, rarest first."""
    placed = strings.select("s", F.explode(characters(F.col("s"))).alias("token")).join(often, "token")
    lists = placed.groupBy("s").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "token"))), lambda x: x["token"]).alias("tokens")).withColumn("size", F.size("tokens"))
    prefix = F.col("size") - F.ceil(F.lit(least / (2 - least)) * F.col("size") - 1e-9) + 1
    return lists.select("s", "size", "tokens", F.posexplode(F.slice("tokens", F.lit(1), prefix.cast("int"))).alias("pos", "token"))


def numbered(strings: Column) -> Column:
    """Strings in their order, numbered where they repeat."""
    ranked = F.array_sort(strings)
    return F.transform(ranked, lambda x, i: F.concat(x, F.lit("|"), (i + 1 - F.array_position(ranked, x)).cast("string")))


def characters(s: Column) -> Column:
    """The characters of a string, numbered where they repeat; none of an empty one."""
    return numbered(F.filter(F.split(s, ""), lambda x: x != ""))


def close_strings(left: DataFrame, right: DataFrame, least: float, known: DataFrame | None = None) -> DataFrame:
    """(l, r, ratio) of the distinct strings s of both sides whose ratio is at least `least`, but for pairs already known.

    A ratio counts characters matched in order, so twice the characters in common, in any order, over all characters is no smaller. That makes the
    characters a set (repeated ones are numbered) and the pairs a set-similarity join: with characters in one global order, rarest
    first, a pair shares a character in the first few of both; lengths and the places of the shared one bound what else can be
    shared. Only pairs whose sets pass are compared as strings, each once.
    """
    left, right = left.select("s").where("s <> ''").distinct(), right.select("s").where("s <> ''").distinct()
    often = left.unionAll(right).select(F.explode(characters(F.col("s"))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    a = _ranked(left, often, least).select("token", F.col("s").alias("l"), F.col("size").alias("n"), F.col("tokens").alias("ls"), F.col("pos").alias("i"))
    b = _ranked(right, often, least).select("token", F.col("s").alias("r"), F.col("size").alias("m"), F.col("tokens").alias("rs"), F.col("pos").alias("j"))
    needed = F.lit(least / 2) * (F.col("n") + F.col("m")) - 1e-9
    met = a.join(b, "token").where((F.least("n", "m") >= needed) & (F.least(F.col("n") - F.col("i"), F.col("m") - F.col("j")) >= needed))
    close = met.where(F.size(F.array_intersect("ls", "rs")) >= needed).select("l", "r").distinct()
    if known is not None:
        close = close.join(known, ["l", "r"], "left_anti")
    return close.withColumn("ratio", ratio_column()("l", "r")).where(F.col("ratio") >= least)


def alike_strings(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """(l, r) of distinct strings s of both sides where one holds the other or their ratio is at least `least`."""
    o, i = (lambda x: x.select(F.col("s").alias("o"))), (lambda x: x.select(F.col("s").alias("i")))
    left, right = left.select("s").where("s <> ''").distinct(), right.select("s").where("s <> ''").distinct()
    within = _containing(o(left), i(right)).select(F.col("o").alias("l"), F.col("i").alias("r")).unionAll(_containing(o(right), i(left)).select(F.col("i").alias("l"), F.col("o").alias("r"))).distinct()
    return within.unionAll(close_strings(left, right, least, within).select("l", "r"))


def near_tokens(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """(token, near): for each long left token the other long right tokens that are alike, with their ratios. Strings come as s."""
    long = lambda x: x.where(F.length("s") >= LONG_TOKEN)
    found = close_strings(long(left), long(right), least).where("l <> r")
    return found.groupBy(F.col("l").alias("token")).agg(F.map_from_entries(F.collect_list(F.struct("r", "ratio"))).alias("near"))
