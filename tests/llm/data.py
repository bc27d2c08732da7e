"""Rows that every operator must bear: nulls, empty and long texts, repeats, and columns with clashing names."""

LONG = " ".join(f"word{i % 97} is{i % 13} here." for i in range(20_000))
ROWS = [
    (1, "one two three four five six seven eight nine ten", "en", "a", 9), (1, "one two three four five six seven eight nine ten", "en", "a", 9), (2, None, "en", None, None), (3, "", None, "a", 0),
    (None, "one two three four five six seven eight nine ten", "en", "a", 9), (4, " \n\t ", "de", "a", 4), (5, "tiny", "en", "b", 4), (6, "123 456", "en", "b", 7), (7, LONG, "en", "b", len(LONG)), (8, "é ß 日本 \x1c  <|endoftext|> 's\r\n\n", "fr", "b", 9),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, rows=ROWS):
    from pyspark.sql import functions as F

    clash = {x: F.lit(7) for x in ("id", "n", "bands", "key", "pos", "rank", "h", "line_no", "comp", "score", "kept", "at", "batch", "ids", "_text", "_lines", "_runs", "_id", "_thash", "doc", "runs", "thash", "own_id", "start")}
    return spark.createDataFrame(rows, SCHEMA).withColumns(clash)


def empty(spark):
    return documents(spark, []).limit(0)
