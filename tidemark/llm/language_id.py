"""Language identification by compression.

Every learned language has a raw-content zstandard dictionary made of sampled training texts. A text, in lower case, is cut into
blocks, each block is compressed with every language's dictionary, and the language with the smallest sum wins.
Where the best two are too close the text is rejected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.common import held_out, table


@dataclass(frozen=True)
class LanguageConfig:
    sample_docs: int = 200  # bound of the sample a dictionary is made of, per language
    sample_chars: int = 1024  # characters taken of each sampled text, in pieces from all over it
    sample_pieces: int = 8
    block_bytes: int = 2048
    level: int = 9  # 0.995 of held-out rows right on 10 000 documents, 0.986 at level 3
    min_margin: float = 0.004  # below this relative distance of the best two the text is rejected
    half_score: float = 0.02  # the relative distance that scores 0.5


UNDETERMINED = "und"


def _pieces(text: F.Column, c: LanguageConfig) -> F.Column:
    """Pieces of equal length whose first begins where the text does and whose last ends where it ends; a short text is one piece."""
    width = c.sample_chars // c.sample_pieces
    last = F.length(text) - width
    spread = F.transform(F.sequence(F.lit(0), F.lit(c.sample_pieces - 1)), lambda i: F.substring(text, F.floor(last * i / (c.sample_pieces - 1)).cast("int") + 1, F.lit(width)))
    return F.when(F.length(text) <= c.sample_chars, text).otherwise(F.array_join(spread, "\n"))


def dictionaries(docs: DataFrame, c: LanguageConfig = LanguageConfig()) -> dict[str, bytes]:
    """A raw-content dictionary per language, from a bounded sample of texts: sample_docs each, those whose id and text hash lowest.

    Of languages with many texts only some multiple of the sample is sorted, by a bound on the hash. Languages are a handful.
    """
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    counts = labelled.groupBy("lang").count().collect()
    if not counts:
        return {}
    most = F.element_at(F.create_map(*(F.lit(x) for r in counts for x in (r.lang, min(1.0, 16 * c.sample_docs / r["count"])))), F.col("lang"))
    hashed = labelled.select("lang", "text", F.xxhash64("doc_id", "text").alias("draw")).where(F.pmod("draw", F.lit(1 << 40)) <= most * (1 << 40))
    turn = Window.partitionBy("lang").orderBy("draw", "text")
    drawn = hashed.select("lang", "draw", _pieces(F.col("text"), c).alias("text")).select("*", F.row_number().over(turn).alias("turn")).where(F.col("turn") <= c.sample_docs)
    found: dict[str, list[str]] = {}
    for row in sorted(drawn.collect(), key=lambda r: (r.lang, r.turn)):  # at most sample_docs * sample_chars characters a language
        found.setdefault(row.lang, []).append(row.text)
    return {k: "\n".join(v).lower().encode("utf-8", "replace") for k, v in found.items()}


def _compressors(learned: dict[str, bytes], level: int) -> list:
    import zstandard as z

    out = []
    for lang in sorted(learned):
        d = z.ZstdCompressionDict(learned[lang], dict_type=z.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level=level)
        out.append((lang, z.ZstdCompressor(level=level, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)))
    return out


def classify(text: str | None, compressors: list, c: LanguageConfig) -> tuple[str, float, bool]:
    """(language, score, rejected) of a whole text; of languages with the same size the first by name wins, and is rejected."""
    if text is None or not compressors or not any(map(str.isalpha, text)):  # ½, ① and Ⅷ are numbers, not letters
        return UNDETERMINED, 0.0, True
    data = text.lower().encode("utf-8", "replace")
    blocks = [data[i : i + c.block_bytes] for i in range(0, len(data), c.block_bytes)]
    sizes = sorted((sum(len(z.compress(b)) for b in blocks), lang) for lang, z in compressors)
    if len(sizes) == 1:
        return sizes[0][1], 1.0, False
    margin = (sizes[1][0] - sizes[0][0]) / sizes[1][0]
    return sizes[0][1], margin / (margin + c.half_score), margin < c.min_margin


def language_column(learned: dict[str, bytes], c: LanguageConfig, spark: SparkSession):
    shared = spark.sparkContext.broadcast(learned)  # at most sample_docs * sample_chars characters a language

    @F.pandas_udf("lang_pred string, score double, rejected boolean")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        compressors = _compressors(shared.value, c.level)
        for texts in batches:
            yield pd.DataFrame([classify(t, compressors, c) for t in texts], columns=["lang_pred", "score", "rejected"])

    return predict


def identify(docs: DataFrame, learned: dict[str, bytes], config: LanguageConfig = LanguageConfig()) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, rejected) of every row.

    lang_pred is a learned language, or `und` with score 0 for null texts, texts without a letter, and all texts if
    nothing was learned; those are rejected, like texts whose best two languages are closer than min_margin. Only the
    text is looked at, from end to end: a very long one is compressed in blocks, whose sizes are summed. Repeated rows get
    the same values; an empty table gives an empty result.
    """
    predict = language_column(learned, config, docs.sparkSession)
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), predict(F.col("text")).alias("p"))
    return rows.select("doc_id", "held_out", "p.lang_pred", "p.score", "p.rejected")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return identify(docs, dictionaries(docs))


def keep_identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents whose language can't be told go.

    Null and empty texts and those without a letter go. Very long texts are compressed whole. Ids take no part: rows without one, and repeated
    rows, are judged by their texts. Where no row has a language nothing can be told, and all go.
    """
    c = LanguageConfig()
    learned = dictionaries(docs.select("doc_id", "text", "lang"), c)
    return docs.where(~language_column(learned, c, spark)(F.col("text"))["rejected"])
