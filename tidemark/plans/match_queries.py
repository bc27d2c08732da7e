"""Evidence of matching, stage by stage, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.config import MatchingConfig
from tidemark.functions.similarity import document_cosine
from tidemark.operators import matching as G
from tidemark.plans.base_sql import SNAP
from tidemark.plans.ops_queries import candidates
from tidemark.sources.scratch import spread
from tidemark.sources.tables import products

P = lambda: F.col("product_id")
_text = lambda c: F.array_join(c, ",")
_pick = lambda n, *values: F.element_at(F.array(*values), (P() % n + 1).cast("int"))


def mat4_identifiers(spark: SparkSession, d: str) -> DataFrame:
    """Identifiers of two listings of every part: barcodes in other forms or of another product, part numbers spelled otherwise."""
    one = lambda kind, value, where: F.when(where, F.struct(F.lit(kind).alias("kind"), value.alias("value")))
    ids = lambda *x: G.identifier_values(F.array_compact(F.array(*x)))
    gtin = lambda n: F.lpad((P() * 7 + n).cast("string"), 12, "0")
    left = ids(one("upc", gtin(1_000_000), P() % 3 == 0), one("mpn", F.concat(F.lit("pn-"), P()), P() % 2 == 0))
    right = ids(one("ean", F.concat(F.lit("0"), F.when(P() % 6 == 0, gtin(1_000_000)).otherwise(gtin(2_000_000))), (P() % 6 == 0) | (P() % 9 == 0)), one("model_number", F.concat(F.lit("PN "), P() + F.when(P() % 8 == 0, 1).otherwise(0)), P() % 4 == 0))
    matches, conflicts = G.identifier_signals(F.col("l"), F.col("r"))
    return products(spark, d).select("product_id", left.alias("l"), right.alias("r")).select("product_id", _text(matches).alias("matches"), _text(conflicts).alias("conflicts"))


def mat5_attributes(spark: SparkSession, d: str) -> DataFrame:
    """Attributes under other names, units and spellings, in their normal form."""
    entries = [("Colour", F.lit("Dark  Colour")), ("Internal Storage", F.concat("size", _pick(3, F.lit(" GB"), F.lit(".50 tb"), F.lit("  MB ")))), ("gen", _pick(3, F.lit("2nd Gen"), F.lit("Generation 5"), F.lit("mk 7"))), ("Tank", F.when(P() % 2 == 0, F.concat(F.lit("00"), "size", F.lit(" L"))).otherwise(" ")), ("Display Size", F.concat("size", F.lit(" in")))]
    made = G.attribute_map(F.map_from_arrays(F.array(*(F.lit(k) for k, _ in entries)), F.array(*(v for _, v in entries))))
    listed = F.transform(F.array_sort(F.map_entries(made)), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return products(spark, d).select("product_id", F.array_join(listed, ";").alias("attributes"))


def mat6_title_attributes(spark: SparkSession, d: str) -> DataFrame:
    """What titles tell of memory, storage, generation and colour; the listing's own colour comes first."""
    title = F.concat_ws(" ", F.lit("Nova"), F.concat("size", F.lit("GB RAM")), F.concat(F.col("size") * 2, F.lit(" GB")), _pick(3, F.lit("3rd Gen"), F.lit("gen 4"), F.lit("x")), _pick(4, F.lit("Black"), F.lit("Rose Gold"), F.lit("plain"), F.lit("grey/BLUE")))
    own = F.when(P() % 5 == 0, F.create_map(F.lit("Color"), F.lit("Mint"))).otherwise(F.create_map().cast("map<string,string>"))
    got = G.merged_attributes(own, title)
    return spread(products(spark, d), "product_id").select("product_id", *(got[k].alias(k) for k in ("ram", "storage", "generation", "color")))


def mat8_hints(spark: SparkSession, d: str) -> DataFrame:
    """Brand, model hint and kind of every listing."""
    return G.prepare(candidates(spark, d)).select("cid", "hint", "brand_sig", "accessory")


def mat9_attribute_signals(spark: SparkSession, d: str) -> DataFrame:
    """Attributes of two listings of every part held against each other."""
    left = G.attribute_map(F.create_map(F.lit("Storage"), F.concat("size", F.lit(" GB")), F.lit("Color"), F.lit("Black Blue"), F.lit("RAM"), F.when(P() % 2 == 0, "8 GB").otherwise("")))
    right = G.attribute_map(F.create_map(F.lit("ssd"), F.concat(F.col("size") + F.when(P() % 4 == 1, 1).otherwise(0), F.lit("gb")), F.lit("colour"), _pick(3, F.lit("blue"), F.lit("red"), F.lit("black blue dark")), F.lit("memory"), F.when(P() % 3 == 0, _pick(5, F.lit("8GB"), F.lit("8 gb"), F.lit("16 GB"), F.lit("8gb"), F.lit("8 GB"))).otherwise("")))
    conflicts, overlapping, agreeing = G.attribute_signals(F.col("l"), F.col("r"))
    return products(spark, d).select("product_id", left.alias("l"), right.alias("r")).select("product_id", _text(conflicts).alias("conflicts"), overlapping.alias("overlapping"), agreeing.alias("agreeing"))


def mat13_documents(spark: SparkSession, d: str) -> DataFrame:
    """Cosine of the hashed n-grams of both listings of every part."""
    rows = G.prepare(candidates(spark, d)).select(F.substring("cid", 2, 20).cast("long").alias("product_id"), "side", "document")
    side = lambda s: rows.where(F.col("side") == s).select("product_id", F.col("document").alias(s))
    return side("left").join(side("right"), "product_id").select("product_id", F.round(document_cosine(MatchingConfig().dimension)("left", "right"), 5).alias("cosine"))


def mat12_titles(spark: SparkSession, d: str) -> DataFrame:
    """Scores of the titles of both listings of every part, and the bound that each keeps under."""
    cid = lambda x: F.concat(F.lit(x), P())
    pairs = products(spark, d).select(cid("L").alias("left_id"), cid("R").alias("right_id"))
    return G.compared_titles(candidates(spark, d), pairs).withColumn("overlap", F.round("overlap", 6))


def mat15_stages(spark: SparkSession, d: str) -> DataFrame:
    """Decisions on evidence of all kinds, made by rule from every part."""
    flag = lambda n, *values: _pick(n, *(F.lit(v).cast("boolean") for v in values))
    some = lambda n, word: F.when(P() % n == 0, F.array(F.lit(word))).otherwise(F.array().cast("array<string>"))
    rows = products(spark, d).select(
        P().cast("string").alias("left_id"), P().cast("string").alias("right_id"), some(5, "barcode").alias("id_matches"), some(7, "part").alias("id_conflicts"), flag(3, None, True, False).alias("brand_match"), flag(4, True, None, True, False).alias("model_match"),
        some(11, "color").alias("variant_conflicts"), (P() % 3).alias("overlapping"), F.least(P() % 2, P() % 3).alias("agreeing"), (P() % 13 == 0).alias("accessory_mismatch"), (P() % 101 / 100.0).alias("title_score"), (P() * 7 % 101 / 100.0).alias("embedding_score"),
    )
    return G.decide(rows).select("left_id", "classification", "method", "confidence", "score", "explanation")


_LIST = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
_TOKENS = lambda x: f"list_filter(string_split(regexp_replace(lower({x}), '[^a-z0-9]+', ' ', 'g'), ' '), lambda w: w <> '')"
_CANDIDATES = """ca AS (
  SELECT 'L' || product_id AS cid, product_id, 'left' AS side, concat_ws(' ', brand, title, size, 'Smartphone') AS title, brand, category, size AS storage FROM prod
  UNION ALL SELECT 'R' || product_id, product_id, 'right', CASE WHEN product_id % 5 = 4 THEN concat_ws(' ', 'Cover for', title, size) ELSE concat_ws(' ', 'New', title, brand, size, 'mobile') END, CASE WHEN product_id % 7 <> 0 THEN brand END, category, CASE WHEN product_id % 4 = 1 THEN size + 1 ELSE size END FROM prod)"""
_MAT15 = """e AS (SELECT product_id AS p, product_id % 5 = 0 AS m, product_id % 7 = 0 AS c, [NULL, true, false][product_id % 3 + 1] AS b, [true, NULL, true, false][product_id % 4 + 1] AS md, product_id % 11 = 0 AS v, product_id % 3 AS ov, least(product_id % 2, product_id % 3) AS ag, product_id % 13 = 0 AS acc, product_id % 101 / 100.0::DOUBLE AS t, product_id * 7 % 101 / 100.0::DOUBLE AS em FROM prod),
a AS (SELECT *, CASE WHEN acc OR v THEN 0.0 WHEN md = false THEN 0.05 WHEN b = false THEN 0.1 ELSE least(1.0, round_even(0.35::DOUBLE * (CASE WHEN b IS NULL THEN 0.5 WHEN b THEN 1.0 ELSE 0.0 END)::DOUBLE + 0.35::DOUBLE * (CASE WHEN md IS NULL THEN 0.5 WHEN md THEN 1.0 ELSE 0.0 END)::DOUBLE + 0.30::DOUBLE * (CASE WHEN ov > 0 THEN ag / ov::DOUBLE ELSE 0.0 END)::DOUBLE, 4)) END::DOUBLE AS attr, CASE WHEN c THEN 0.0 WHEN m THEN 1.0 END::DOUBLE AS idn FROM e),
s AS (SELECT *, round_even(least(1.0, greatest(0.0, (coalesce(idn, 0.0::DOUBLE) * 0.45::DOUBLE + attr * 0.35::DOUBLE + t * 0.12::DOUBLE + em * 0.08::DOUBLE) / (CASE WHEN idn IS NULL THEN 0.0 ELSE 0.45 END::DOUBLE + 0.35::DOUBLE + 0.12::DOUBLE + 0.08::DOUBLE))), 4) AS s FROM a),
d AS (SELECT *, CASE WHEN c THEN ['DIFFERENT_PRODUCT', 'exact_identifier', 'HIGH', 'identifiers conflict'] WHEN m AND v THEN ['NEEDS_REVIEW', 'conflicting_evidence', 'MEDIUM', 'identifiers match, variants conflict'] WHEN m AND b = false THEN ['NEEDS_REVIEW', 'conflicting_evidence', 'MEDIUM', 'identifiers match, brands disagree']
    WHEN acc THEN ['DIFFERENT_PRODUCT', 'normalized_attributes', 'HIGH', 'accessory against primary product'] WHEN v THEN ['DIFFERENT_PRODUCT', 'normalized_attributes', 'HIGH', 'variants conflict'] WHEN md = false AND NOT m THEN ['DIFFERENT_PRODUCT', 'normalized_attributes', 'HIGH', 'model hints disagree'] WHEN b = false AND NOT m THEN ['DIFFERENT_PRODUCT', 'normalized_attributes', 'HIGH', 'brands disagree']
    WHEN m THEN ['SAME_PRODUCT', 'exact_identifier', 'HIGH', 'identifiers match'] WHEN b AND md THEN ['SAME_PRODUCT', 'normalized_attributes', CASE WHEN t >= 0.60 THEN 'HIGH' ELSE 'MEDIUM' END, 'brand and model agree'] WHEN t >= 0.82 AND em >= 0.86 AND b THEN ['POSSIBLE_MATCH', 'combined', 'MEDIUM', 'brand agrees, texts are alike']
    WHEN t >= 0.82 AND em >= 0.86 AND b IS NULL THEN ['NEEDS_REVIEW', 'combined', 'LOW', 'texts are alike, brand is missing'] WHEN s >= 0.52 AND (t >= 0.60 OR em >= 0.72) THEN ['POSSIBLE_MATCH', 'combined', 'LOW', 'evidence together'] WHEN s >= 0.34 THEN ['NEEDS_REVIEW', 'combined', 'LOW', 'evidence is ambiguous'] ELSE ['DIFFERENT_PRODUCT', 'combined', 'MEDIUM', 'evidence is weak'] END AS r FROM s)
SELECT CAST(p AS VARCHAR) AS left_id, r[1] AS classification, r[2] AS method, r[3] AS confidence, r[4] AS explanation, round_even(CASE r[4] WHEN 'identifiers conflict' THEN least(s, 0.2) WHEN 'identifiers match, variants conflict' THEN least(greatest(s, 0.45), 0.7) WHEN 'identifiers match, brands disagree' THEN least(greatest(s, 0.45), 0.7) WHEN 'accessory against primary product' THEN least(s, 0.25)
    WHEN 'variants conflict' THEN least(s, 0.45) WHEN 'model hints disagree' THEN least(s, 0.4) WHEN 'brands disagree' THEN least(s, 0.35) WHEN 'identifiers match' THEN greatest(s, 0.9) WHEN 'brand and model agree' THEN greatest(s, 0.78) WHEN 'brand agrees, texts are alike' THEN greatest(s, 0.52) WHEN 'texts are alike, brand is missing' THEN greatest(s, 0.34) ELSE s END::DOUBLE, 4) AS score FROM d"""

QUERIES = {
    "mat4_identifiers": (mat4_identifiers, f"""WITH {SNAP}, i AS (SELECT product_id, CASE WHEN product_id % 3 = 0 THEN product_id * 7 + 1000000 END AS bl, CASE WHEN product_id % 6 = 0 THEN product_id * 7 + 1000000 WHEN product_id % 9 = 0 THEN product_id * 7 + 2000000 END AS br, CASE WHEN product_id % 2 = 0 THEN product_id END AS pl, CASE WHEN product_id % 4 = 0 THEN product_id + (product_id % 8 = 0)::INT END AS pr FROM prod)
SELECT product_id, concat_ws(',', CASE WHEN bl = br THEN 'barcode' END, CASE WHEN pl = pr THEN 'part' END) AS matches, concat_ws(',', CASE WHEN bl <> br THEN 'barcode' END, CASE WHEN pl <> pr THEN 'part' END) AS conflicts FROM i"""),
    "mat5_attributes": (mat5_attributes, f"WITH {SNAP} SELECT product_id, CASE WHEN product_id % 2 = 0 THEN 'capacity=' || size || 'l;' ELSE '' END || 'color=dark color;generation=' || ['2', '5', '7'][product_id % 3 + 1] || ';size=' || size || 'inch;storage=' || size || ['gb', '.5tb', 'mb'][product_id % 3 + 1] AS attributes FROM prod"),
    "mat6_title_attributes": (mat6_title_attributes, f"WITH {SNAP} SELECT product_id, size || 'gb' AS ram, 2 * size || 'gb' AS storage, ['3', '4', NULL][product_id % 3 + 1] AS generation, CASE WHEN product_id % 5 = 0 THEN 'mint' ELSE ['black', 'gold', NULL, 'grey blue'][product_id % 4 + 1] END AS color FROM prod"),
    "mat8_hints": (mat8_hints, f"""WITH {SNAP}, {_CANDIDATES}, w AS (SELECT *, {_TOKENS('title')} AS words, coalesce({_TOKENS('brand')}, []) AS own FROM ca),
k AS (SELECT *, list_filter(words, lambda x: NOT list_contains(own, x) AND NOT list_contains({_LIST([*G.ACCESSORIES, *G.HINT_SKIPS, *G.COLORS])}, x) AND NOT regexp_full_match(x, '[0-9]+(gb|tb|mb|mm|cm)') AND NOT (regexp_full_match(x, '[0-9]+') AND coalesce(try_cast(x AS HUGEINT), 0) >= 32)) AS kept FROM w)
SELECT cid, nullif(array_to_string(kept[1:4], ' '), '') AS hint, nullif(regexp_replace(regexp_replace(lower(trim(brand)), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), '') AS brand_sig, contains(lower(category), 'accessor') OR (list_has_any(words, {_LIST(G.ACCESSORIES)}) AND NOT list_has_any(words, {_LIST(G.PRIMARIES)})) AS accessory FROM k"""),
    "mat9_attribute_signals": (mat9_attribute_signals, f"""WITH {SNAP}, x AS (SELECT product_id, product_id % 4 = 1 AS st, product_id % 3 = 1 AS co, product_id % 2 = 0 AND product_id % 3 = 0 AS has, product_id % 5 = 2 AS other FROM prod)
SELECT product_id, concat_ws(',', CASE WHEN co THEN 'color' END, CASE WHEN has AND other THEN 'ram' END, CASE WHEN st THEN 'storage' END) AS conflicts, CAST(2 + has::INT AS INTEGER) AS overlapping, CAST((NOT co)::INT + (NOT st)::INT + (has AND NOT other)::INT AS INTEGER) AS agreeing FROM x"""),
    "mat12_titles": (mat12_titles, None),
    "mat13_documents": (mat13_documents, f"""WITH {SNAP}, {_CANDIDATES}, dc AS (SELECT cid, product_id, side, '  ' || array_to_string({_TOKENS("concat_ws(' ', brand, title, 'Storage', storage || ' GB')")}, ' ') || '  ' AS t FROM ca),
gr AS (SELECT cid, product_id, side, sha256(unnest(list_concat(list_transform(range(1, length(t)), lambda i: substr(t, i, 2)), list_transform(range(1, length(t) - 1), lambda i: substr(t, i, 3))))) AS h FROM dc),
vc AS (SELECT product_id, side, substr(h, 1, 2) AS k, sum(CASE WHEN contains('13579bdf', substr(h, 10, 1)) THEN -1 ELSE 1 END)::DOUBLE AS x FROM gr GROUP BY ALL),
nm AS (SELECT product_id, side, sqrt(sum(x * x)) AS n FROM vc GROUP BY ALL), dt AS (SELECT a.product_id, sum(a.x * b.x) AS d FROM vc a JOIN vc b ON a.product_id = b.product_id AND a.k = b.k AND a.side = 'left' AND b.side = 'right' GROUP BY 1)
SELECT product_id, round(least(1.0, greatest(0.0, coalesce(d, 0) / (l.n * r.n))), 5) AS cosine FROM (SELECT product_id, n FROM nm WHERE side = 'left') l JOIN (SELECT product_id, n FROM nm WHERE side = 'right') r USING (product_id) LEFT JOIN dt USING (product_id)"""),
    "mat15_stages": (mat15_stages, f"WITH {SNAP}, {_MAT15}"),
}
