"""Phrases against a plain count."""

import random
import re
from collections import Counter, defaultdict

import pytest

from tests.llm.data import documents, empty
from tests.oracle import connect, same
from tidemark.llm import collocations

NAMES = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def plain(rows, least, top=2000, longest=5):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, counts in f.items():
        found = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        inside = {q for p, a in found.items() for i in range(len(p)) for j in range(i + 2, len(p) + 1) if (q := p[i:j]) != p and a >= counts[q]}
        scored = []
        for p, a in found.items():
            if p not in inside:
                score, k = min((1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
                scored.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        out += [(lang, i, p.decode(), -a, x, y, n[lang], -score) for i, (score, a, p, x, y) in enumerate(sorted(scored)[:top], 1)]
    return out


def got(df):
    return sorted(tuple(r[x] for x in NAMES) for r in df.collect())


@pytest.mark.parametrize(("block", "part"), [(50, 3), (1_000_000, 100_000)])
def test_phrases_match_a_plain_count(spark, block, part):
    rng = random.Random(block)
    words = ["a", "b", "A", "of", "the", "new", "york", "ñu", "É", "\x1cx", "c."]
    rows = [(rng.choice(["en", "de", None, "und"]), "".join(rng.choice(words) + rng.choice([" ", " ", " ", "\t", "  ", ", ", "\n", "! "]) for _ in range(rng.randrange(40)))) for _ in range(200)]
    rows += [("en", "new york of the a new york of the a")] * 30 + [("fr", None), ("fr", ""), ("es", ".,;")]
    df = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    c = collocations.PhraseConfig(least=9, block_words=block, part_count=part, word_parts=3, buckets=2 if part == 3 else 2048)
    assert got(collocations.collocations(df, c)) == sorted(plain(rows, 9))
    assert got(collocations.collocations(df, collocations.PhraseConfig(least=9, block_words=block, top=4))) == sorted(plain(rows, 9, 4))


def test_phrases_of_odd_rows(spark):
    df = documents(spark)
    rows = [(r.lang, r.text) for r in df.select("lang", "text").collect()]
    assert got(collocations.collocations(df)) == sorted(plain(rows, 100))
    assert collocations.collocations(empty(spark)).count() == 0


def test_op12_matches_its_sql_and_a_plain_count(spark):
    sf = "/root/testdata/sf0.01"
    found = collocations.op12_collocations(spark, sf)
    df = spark.createDataFrame(found.collect(), found.schema)
    same(df, collocations.OP12_SQL, connect(sf))
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("lang", "text").collect()]
    assert got(df) == sorted(plain(rows, 100)) and df.count() > 50
