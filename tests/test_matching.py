"""The similarity join of matching against all pairs."""

import random
from difflib import SequenceMatcher

import pytest

from pyspark.sql import functions as F

from tidemark.functions.similarity import alike_strings, fuzzy_overlap, gram_cosine, near_tokens, overlap_column, ratio, title_score
from tidemark.operators import matching

SCHEMA = "cid string, side string, title string, brand string, category_slug string, identifiers array<struct<kind:string,value:string>>, attributes map<string,string>"


def listings(seed, n):
    rng = random.Random(seed)
    words, brands = ["nova", "novas", "quasar", "rim", "pro", "max", "12", "ultra"], ["Acme", "Acmee", "Zeta", "Zeta Ltd", None, ""]
    out = []
    for side in ("left", "right"):
        for i in range(n):
            title = rng.choice([" ".join(rng.choice(words) for _ in range(rng.randrange(1, 5))), "Black phone", "Case for nova", "smartphone 64 GB", ""])
            ids = [("upc", f"{rng.randrange(6):012d}")] if rng.random() < 0.2 else []
            out.append((f"{side[0]}{i}", side, f"{title} {rng.choice(['', 'black', '64 GB', 'phone'])}", rng.choice(brands), rng.choice(["mobiles", "accessories"]) if rng.random() < 0.1 else "mobiles", ids, {"Storage": rng.choice(["64 GB", "128GB"])} if rng.random() < 0.4 else {}))
    return out


@pytest.mark.parametrize("least", [0.86, 0.6])
def test_alike_strings_are_those_of_all_pairs(spark, least):
    rng = random.Random(int(least * 100))
    draw = lambda: "".join(rng.choice("aabc12 -é") for _ in range(rng.randrange(0, 14)))
    left, right = [draw() for _ in range(120)] + ["nova 12", "a", "aaaaaaaa"], [draw() for _ in range(120)] + ["nova 21", "supernova 12 max", "aaaaaaab"]
    frame = lambda x: spark.createDataFrame([(s,) for s in x] + [(None,)], "s string")
    got = [tuple(r) for r in alike_strings(frame(left), frame(right), least).collect()]
    want = {(a, b) for a in set(left) for b in set(right) if a and b and (a in b or b in a or SequenceMatcher(None, a, b).ratio() >= least)}
    assert set(got) == want and len(got) == len(want) > 100


def test_telling_pairs_lose_no_match_of_all_pairs(spark):
    prepared = matching.prepare(spark.createDataFrame(listings(3, 70), SCHEMA))
    told = [(r.left_id, r.right_id) for r in matching.telling_pairs(prepared).collect()]
    assert len(told) == len(set(told)) < 70 * 70 / 2
    side = lambda s: prepared.where(F.col("side") == s).select(F.col("cid").alias(f"{s}_id"))
    decided = matching.decide(matching.scored_pairs(prepared, side("left").crossJoin(side("right")))).collect()
    found = {(r.left_id, r.right_id) for r in decided if r.classification != "DIFFERENT_PRODUCT"}
    words = {r.cid: (set(r.tokens) | set((r.hint or "").split()), bool(r.brand_sig), bool(r.hint)) for r in prepared.collect()}
    lost = found - set(told)
    assert len(found) > 100
    for a, b in lost:  # only where neither brands nor hints can be compared and no word is shared
        (x, brand, hint), (y, other, another) = words[a], words[b]
        assert not x & y and not (brand and other) and not (hint and another)


def test_the_best_pair_is_that_of_all_blocked_pairs(spark):
    prepared = matching.prepare(spark.createDataFrame(listings(4, 40), SCHEMA))
    best = {r.left_id: r for r in matching.best_of_all(prepared).collect()}
    every = matching.blocked_pairs(prepared).unionAll(matching.telling_pairs(prepared)).distinct()
    want = {r.left_id: r for r in matching.best_matches(matching.decide(matching.scored_pairs(prepared, every))).collect()}
    assert best == want and {r.classification for r in best.values()} >= {"SAME_PRODUCT", "DIFFERENT_PRODUCT"}


def test_overlap_of_words_is_that_of_the_plain_rule(spark):
    rng = random.Random(8)
    draw = lambda: [rng.choice(["nova", "novas", "novax", "anova", "phone", "phones", "ab", "a", "ultra", "ultar", "xultra", "12"]) for _ in range(rng.randrange(0, 7))]
    rows = [(i, draw(), draw()) for i in range(400)]
    pairs = spark.createDataFrame(rows, "i int, l array<string>, r array<string>")
    words = lambda c: pairs.select(F.explode(c).alias("s")).distinct()
    near = near_tokens(words("l"), words("r"), 0.84).agg(F.map_from_entries(F.collect_list(F.struct("token", "near"))).alias("near"))
    got = {r.i: r.x for r in pairs.join(near).select("i", overlap_column(F.col("l"), F.col("r"), F.col("near")).alias("x")).collect()}
    assert got == {i: fuzzy_overlap(a, b, 0.84) for i, a, b in rows}
    assert any(got[i] > len(set(a) & set(b)) / max(1, len(set(a) | set(b))) for i, a, b in rows)


def test_text_scores_are_plain_ones_and_stay_under_their_bounds(spark):
    prepared = matching.stored(matching.prepare(spark.createDataFrame(listings(5, 40), SCHEMA)))
    side = lambda s: prepared.where(F.col("side") == s).select(F.col("cid").alias(f"{s}_id"))
    every = matching.stored(side("left").crossJoin(side("right")))
    scored = matching.stored(matching.scored_pairs(prepared, every))
    of = {r.cid: r for r in prepared.collect()}
    for r in scored.collect():
        a, b = of[r.left_id], of[r.right_id]
        assert r.title_score == title_score(fuzzy_overlap(a.tokens, b.tokens, 0.84), " ".join(sorted(a.tokens)), " ".join(sorted(b.tokens)))
        assert r.embedding_score == gram_cosine(a.document, b.document, 256)
        for match, x, y in ((r.brand_match, a.brand_sig, b.brand_sig), (r.model_match, a.hint, b.hint)):
            assert match == ((x in y or y in x or ratio(x, y) >= 0.86) if x and y else None)
    decided = matching.decide(scored).where("classification = 'DIFFERENT_PRODUCT'")
    met = matching.stored(decided.join(matching.bounds(prepared, every), ["left_id", "right_id"]))
    assert met.where("score > bound").count() == 0 and met.where("bound < 0.6").count() > 400


def test_few_pairs_are_scored_to_find_the_best(spark):
    prepared = matching.stored(matching.prepare(spark.createDataFrame(listings(6, 60), SCHEMA)))
    different = matching.stored(matching.decide(matching.scored_pairs(prepared, matching.blocked_pairs(prepared))).where("classification = 'DIFFERENT_PRODUCT'"))
    bounded = matching.stored(matching.bounds(prepared, different.select("left_id", "right_id")))
    left = matching.contenders(prepared, bounded)
    got = {r.left_id: r for r in matching.best_matches(different.join(left, ["left_id", "right_id"])).collect()}
    assert got == {r.left_id: r for r in matching.best_matches(different).collect()}
    assert left.count() < different.count() / 3


def test_pairs_follow_the_listings(spark):
    from tidemark.plans import registry

    small, large = (registry.queries()["mat18_pairs"](spark, f"/root/testdata/sf{x}").count() for x in ("0.001", "0.01"))
    assert large < 30 * small  # ten times the listings; all pairs would be a hundred times as many
