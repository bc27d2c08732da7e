"""Quality, language, media, WARC, neighbours, the pipeline."""

import gzip
import hashlib
import io
import math
import os
import re
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.data import ROWS, documents, empty
from tidemark.llm import ann, language_id, matroska, quality, warc
from tidemark.llm.common import held_out

SF = "/root/testdata/sf0.01"


def held(doc_id) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 4 == 2


def test_held_out_rows(spark):
    got = spark.range(50).select("id", held_out(F.col("id")).alias("h")).collect()
    assert [r.h for r in got] == [held(r.id) for r in got]


# -- quality


def test_quality_on_held_out_rows(spark):
    truth = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = [r for r in quality.op3_quality(spark, SF).collect() if r.held_out and r.doc_id in truth]
    assert np.mean([r.predicted == truth[r.doc_id] for r in rows]) >= 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)


def test_quality_scores_match_plain_ones(spark):
    """The n-grams, their scaling and the margin, written out row by row."""
    import xxhash

    docs, labels = (spark.read.parquet(f"{SF}/{x}.parquet") for x in ("documents", "labels"))
    model = quality.fit(docs.select("doc_id", "text"), labels)
    texts = {r.doc_id: r.text for r in docs.limit(60).collect()} | {-1: None, -2: "", -3: "Ab 12"}
    mask = (1 << 64) - 1

    def plain(text):
        words = (text or "").split()
        shape = lambda w: "".join("X" if r.isupper() and len(r) > 1 else "Xx" if r[:1].isupper() else "x" if r[:1].isalpha() else "9" if r.isdigit() else r for r in re.findall(r"[^\W\d_]+|\d+|[\W_]", w))
        a, b = [xxhash.xxh3_64_intdigest(w.lower()) for w in words], [xxhash.xxh3_64_intdigest(shape(w), 1) for w in words]
        pair = lambda x, y: (x * 0x9E3779B97F4A7C15 + y) & mask
        two, s2 = [pair(*x) for x in zip(a, a[1:])], [pair(*x) for x in zip(b, b[1:])]
        grams = a + two + b + s2 + [pair(x, y) for x, y in zip(s2, b[2:])]
        at = {(((g ^ (g >> 31)) * 0x9E3779B97F4A7C15 & mask) >> 20) % model.buckets for g in grams}
        margin = (sum(float(model.weights[i]) for i in at) / len(at) ** 0.5 if at else 0.0) + model.bias
        return 1 / (1 + math.exp(-min(30, max(-30, model.slope * margin + model.shift))))

    rows = [(i, t) for i, t in texts.items()] * 2
    scored = quality.score_quality(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()
    assert len(scored) == len(rows)
    for r in scored:
        assert abs(r.score - plain(texts[r.doc_id])) < 1e-4


def test_quality_of_odd_rows(spark):
    labels = spark.createDataFrame([(1, 1), (5, 0), (7, None), (None, 1)], "doc_id long, quality int")
    for marked in (labels, labels.limit(0)):
        model = quality.fit(documents(spark), marked)
        rows = quality.score_quality(documents(spark), model).collect()
        assert len(rows) == len(ROWS) and all(r.score is not None for r in rows)
        assert quality.score_quality(empty(spark), model).count() == 0
    assert quality.fit(empty(spark), labels.limit(0)).score(None) == 0.5


def test_dual_descent_separates():
    rng = np.random.default_rng(0)
    rows = [np.unique(rng.integers(0 if y > 0 else 20, 30 if y > 0 else 50, 15)) for y in (1, -1) for _ in range(60)]
    y = np.array([1] * 60 + [-1] * 60)
    ratio = np.ones(50)
    w, b = quality.descend(rows, ratio, y, quality.QualityConfig(c=1.0, epochs=50))
    margins = np.array([w[r].sum() / np.sqrt(len(r)) + b for r in rows])
    assert ((margins > 0) == (y > 0)).mean() > 0.97


# -- language


def test_language_on_held_out_rows(spark):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = [r for r in language_id.op8_language_id(spark, SF).collect() if r.held_out]
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in rows]) >= 0.97


def test_languages_match_plain_sizes(spark):
    """The language with the smallest sum of compressed blocks, ties to the first name, margins as documented."""
    import zstandard

    c = language_id.LanguageConfig()
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    learned = language_id.dictionaries(docs)
    assert sorted(learned) == sorted({r.lang for r in docs.select("lang").collect() if r.lang})
    rows = [(r.doc_id, r.text) for r in docs.limit(80).collect()] + [(-1, None), (-2, ""), (-3, "12 34"), (-4, "é")]
    got = language_id.identify(spark.createDataFrame(rows * 2, "doc_id long, text string"), learned).collect()
    dicts = {k: zstandard.ZstdCompressionDict(v, dict_type=zstandard.DICT_TYPE_RAWCONTENT) for k, v in learned.items()}
    for r in got:
        text = dict(rows)[r.doc_id]
        if text is None or not any(x.isalpha() for x in text):
            assert (r.lang_pred, r.score, r.rejected) == ("und", 0.0, True)
            continue
        data = text.lower().encode()
        size = {}
        for lang, d in dicts.items():
            z = zstandard.ZstdCompressor(level=c.level, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)
            size[lang] = sum(len(z.compress(data[i : i + c.block_bytes])) for i in range(0, len(data), c.block_bytes))
        best, second = sorted(size, key=lambda k: (size[k], k))[:2]
        margin = (size[second] - size[best]) / size[second]
        assert (r.lang_pred, r.rejected) == (best, margin < c.min_margin) and abs(r.score - margin / (margin + c.half_score)) < 1e-12


def test_samples_come_from_all_over_a_text(spark):
    text = "a" * 5000 + "b" * 5000 + "c" * 5000
    c = language_id.LanguageConfig()
    made = language_id.dictionaries(spark.createDataFrame([(1, text, "en"), (3, "short", "de"), (5, None, "fr"), (7, "x", None)], "doc_id long, text string, lang string"))
    assert set(made) == {"en", "de"} and made["de"] == b"short"
    assert made["en"].startswith(b"a") and made["en"].endswith(b"c") and b"b" * 100 in made["en"] and len(made["en"]) <= c.sample_chars + c.sample_pieces


@pytest.mark.parametrize("text", ["½", "²³ ① Ⅷ", "१२३", "_ 7 .", "\u0301"])
def test_texts_without_letters_are_undetermined(text):
    c = language_id.LanguageConfig()
    compressors = language_id._compressors({"de": b"und der die das", "en": b"the and of to"}, c.level)
    assert language_id.classify(text, compressors, c) == ("und", 0.0, True)
    assert language_id.classify(text + "ª", compressors, c)[0] in ("de", "en")


def test_language_of_odd_rows(spark):
    docs = documents(spark)
    learned = language_id.dictionaries(docs)
    got = {r.doc_id: r for r in language_id.identify(docs, learned).collect()}
    assert {got[i].lang_pred for i in (2, 3, 4, 6)} == {"und"} and got[7].lang_pred in learned and all(0 <= r.score <= 1 for r in got.values())
    assert language_id.identify(empty(spark), learned).count() == 0
    assert language_id.dictionaries(empty(spark)) == {}
    assert {r.lang_pred for r in language_id.identify(docs, {}).collect()} == {"und"}


# -- Matroska


@pytest.mark.parametrize("size", [0, 1, 64, 65, 255, 256, 257, 5000, 2048 * 8 + 5, 100_000])
def test_media_round_trip(size):
    _, padded = matroska.text_payload("x" * size)
    payload = os.urandom(len(padded))
    raw = matroska.mux(payload)
    m = matroska.parse(raw)
    assert len(payload) % 64 == 0 and payload and matroska.demux(raw) == payload
    assert [p for _, _, p in m.cues] == m.clusters and m.tracks[0]["codec"] == "A_PCM/INT/LIT"
    assert all(p.timestamp_ns == i * 32_000_000 for i, p in enumerate(m.packets))


@pytest.mark.parametrize("kind", [matroska.XIPH, matroska.EBML_LACING])
def test_lacing(kind):
    rng = np.random.default_rng(3)
    for _ in range(200):
        frames = [os.urandom(int(n)) for n in rng.choice([0, 1, 254, 255, 256, 510, 5000, 17_000], rng.integers(2, 20))]
        body = matroska.write_vint(3) + struct.pack(">hB", -7, kind << 1) + matroska._lace(frames, kind)
        track, relative, _, found = matroska.block_frames(memoryview(body), 0, len(body))
        assert (track, relative) == (3, -7) and [body[a : a + n] for a, n in found] == frames


def element(ident, body, size=None):
    return ident.to_bytes((ident.bit_length() + 7) // 8, "big") + (size or matroska.write_vint(len(body))) + body


def test_unknown_sizes_and_groups():
    unknown = b"\x01" + b"\xff" * 7
    block = matroska.write_vint(2) + struct.pack(">hB", 5, 0) + b"abc"
    group = element(matroska.BLOCK_GROUP, element(matroska.BLOCK, block) + element(matroska.REFERENCE_BLOCK, b"\x01"))
    cluster = element(matroska.CLUSTER, element(matroska.TIMESTAMP, b"\x0a") + group, unknown)
    raw = element(matroska.EBML, b"") + element(matroska.SEGMENT, cluster + cluster, unknown)
    m = matroska.parse(raw)
    assert [(p.track, p.timestamp_ns, p.keyframe, p.length) for p in m.packets] == [(2, 15_000_000, False, 3)] * 2


def test_media_tables(spark):
    stored = matroska.store_texts(documents(spark))
    rows = matroska.media_digests(stored).collect()
    want = {(r[0], len((r[1] or "").encode()), hashlib.sha256(matroska.text_payload(r[1])[1]).hexdigest(), zlib.crc32(matroska.text_payload(r[1])[1][-64:])) for r in ROWS}
    assert len(rows) == len(ROWS) and {(r.doc_id, r.n_bytes, r.payload_sha256, r.tail_crc32) for r in rows} == want
    files = stored.select("doc_id", "media").union(spark.createDataFrame([(90, bytearray(b"\x1a\x45\xdf\xa3\x84ab")), (91, None)], "doc_id long, media binary"))
    packets = matroska.packet_table(files, "doc_id", "media")
    assert packets.where("doc_id = 90 and error is not null").count() == 1 and packets.where("doc_id = 91").count() == 0
    assert packets.where("error is null and not cued").count() == 0
    assert matroska.media_digests(matroska.store_texts(empty(spark))).count() == 0


# -- WARC

PAGES = [(3, "http://a/1\r\nX: y", "same"), (1, "http://a/2", "same"), (2, None, "same"), (4, "u", None), (5, "u", ""), (6, "u", "é" * 40_000), (6, "u", "é" * 40_000), (None, "u", "same"), (None, "u", "alone"), (7, "u", "\r\n\r\nHTTP")]


def test_archives(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumns({"n": F.lit(1), "hex": F.lit("z"), "first": F.lit(2), "seq": F.lit(0)})
    c = warc.WarcConfig(chunk_bytes=100)
    archive = warc.write_archive(pages, c)
    parts = {}
    for r in archive.orderBy("archive", "seq", "chunk_no").collect():
        parts.setdefault(r.archive, io.BytesIO()).write(r.data)
        assert len(r.data) <= 400
    assert sum(gzip.decompress(x.getvalue()).count(b"WARC/1.1\r\nWARC-Type: re") for x in parts.values()) == len(PAGES)
    chunks = warc.read_archive(archive, c).where("record_type <> 'warcinfo'")
    assert chunks.selectExpr("max(length(payload)) as n").first().n <= 100
    last = sorted((tuple(r) for r in chunks.where("last").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=str)
    digest = lambda t: warc.bare_digest(hashlib.sha1((t or "").encode()).digest())
    want = []
    for page, _, html in PAGES:
        first = min((p for p, _, h in PAGES if (h or "") == (html or "") and p is not None), default=None)
        response = first is None or page == first
        want.append((page, len((html or "").encode()), digest(html), "response" if response else "revisit", None if response else first))
    assert last == sorted(want, key=str)
    big = chunks.where("page_id = 6").orderBy("archive", "seq", "chunk_no").collect()
    assert b"".join(r.payload for r in big) == ("é" * 40_000).encode() * 2
    assert warc.read_archive(warc.write_archive(pages.limit(0)), c).where("record_type <> 'warcinfo'").count() == 0


def test_broken_archives_give_error_rows(spark):
    pages = spark.createDataFrame([(i, "u", f"page {i} " * 500) for i in range(1, 6)], "page_id long, url string, html string")
    c = warc.WarcConfig(chunk_bytes=60)
    archive = [tuple(r) for r in warc.write_archive(pages, c).collect()]
    by = {}
    for r in archive:
        by.setdefault(r[:2], []).append(r)
    records = sorted(k for k in by if k[1] > 0)
    cut, torn, junk = records[0], records[1], records[2]
    rows = [r for k in by for r in by[k] if k not in (cut, torn, junk)]
    rows += [r for r in by[cut] if r[2] < 1]  # the rest of the member is missing
    rows += [(*r[:4], bytes(len(r[4])) if r[2] == 1 else r[4]) for r in by[torn]]
    rows += [(*junk, 0, True, b"not gzip"), ("x", 1, 0, True, gzip.compress(b"no heads at all")), ("x", 2, 0, True, None), ("x", 3, 0, True, gzip.compress(b"WARC/1.1\r\nContent-Length: many\r\n\r\n"))]
    found = warc.read_archive(spark.createDataFrame(rows, warc.ARCHIVE), c).collect()
    bad = {(r.archive, r.seq) for r in found if r.error}
    assert bad == {cut, torn, junk, ("x", 1), ("x", 2), ("x", 3)}
    assert not [r for r in found if r.error and r.last] and {(r.archive, r.seq) for r in found if r.last} == set(by) - bad


def test_writing_gives_pieces_before_the_record_ends():
    """Pieces leave as soon as they are full: a payload of any size never lies there in one piece."""
    given = []

    def parts():
        for k in range(200):
            given.append(k)
            yield os.urandom(1000)

    pieces = warc.gzip_pieces(parts(), 500)
    next(pieces)
    assert len(given) < 200


def test_small_payloads_are_never_revisits(spark):
    pages = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab")], "page_id long, url string, html string")
    c = warc.WarcConfig(min_revisit_bytes=3)
    assert {r.record_type for r in warc.read_archive(warc.write_archive(pages, c), c).collect()} == {"warcinfo", "response"}


# -- neighbours


def test_recall_against_brute_force(spark):
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], dtype=float)
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    found = ann.nearest(vectors, vectors.where("vec_id % 100 = 0"), ann.AnnConfig(cell_rows=600, block_rows=250, query_rows=5)).collect()
    hits = total = 0
    for q in ids[ids % 100 == 0]:
        d = np.sqrt(((x - x[ids == q]) ** 2).sum(axis=1))
        d[ids == q] = np.inf
        order = np.lexsort((ids, d))[:10]
        own = sorted((r.rank, r.vec_id, r.score) for r in found if r.query_id == q)
        assert [r[0] for r in own] == list(range(1, 11)) and [r[2] for r in own] == sorted(r[2] for r in own)
        hits += len({r[1] for r in own} & set(ids[order].tolist()))
        total += 10
    assert hits / total >= 0.9


def clouds(kind, n=12_000, width=64):
    rng = np.random.default_rng(3)
    if kind == "gaussian":
        return rng.standard_normal((n, width))
    centres = rng.standard_normal((n // 60, width)) * (3 if kind == "far clusters" else 1)
    return centres[rng.integers(0, len(centres), n)] + rng.standard_normal((n, width)) * (1 if kind == "far clusters" else 0.3)


def found_share(x, asked, c):
    m, quantile = ann.projection(x.shape[1], c), ann.chi_square_quantile(c.confidence, c.dims)
    tree = ann.KdTree(x @ m, c.leaf)
    hits = verified = 0
    for i in asked:
        got, n = ann.search_block(tree, tree.order, x[tree.order], int(i), x[i], x[i] @ m, quantile, c.k)
        d = np.sqrt(((x - x[i]) ** 2).sum(axis=1))
        d[i] = np.inf
        hits += len(set(np.argsort(d, kind="stable")[: c.k].tolist()) & {j for _, j in got})
        verified += n
    return hits / (c.k * len(asked)), verified / (len(asked) * len(x))


@pytest.mark.parametrize(("kind", "most"), [("gaussian", 0.6), ("far clusters", 0.05), ("near clusters", 0.4)])
def test_the_search_stops_early_and_finds_most(kind, most):
    x = clouds(kind)
    recall, share = found_share(x, np.arange(0, len(x), 200), ann.AnnConfig())
    assert recall >= 0.93 and share <= most, (recall, share)


def test_cells_that_hold_nothing_near_are_not_visited(spark):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((20, 16))[rng.integers(0, 20, 6_000)] * 10 + rng.standard_normal((6_000, 16))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    found = ann.nearest(df, df.where("vec_id % 100 = 0"), ann.AnnConfig(cell_rows=300, block_rows=200)).collect()
    hits = 0
    for q in range(0, len(x), 100):
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        d[q] = np.inf
        hits += len(set(np.argsort(d, kind="stable")[:10].tolist()) & {r.vec_id for r in found if r.query_id == q})
    assert len(found) == 600 and hits / 600 >= 0.93
    c = ann.AnnConfig(leaf=300)
    p = x @ ann.projection(16, c)
    splits = ann.KdTree(p, 300).splits
    cell = ann.leaves(splits, p)
    cells = np.unique(cell)
    low, high = (np.array([f(p[cell == k], axis=0) for k in cells]) for f in (np.min, np.max))
    visited = []
    for q in range(0, len(x), 100):
        d = np.sort(np.sqrt(((x - x[q]) ** 2).sum(axis=1)))[10]
        visited.append((ann.box_gaps(low, high, p[q]) <= ann.chi_square_quantile(c.confidence, c.dims) * d * d).mean())
    assert len(cells) >= 20 and np.mean(visited) < 0.5


def test_tree_leaves_hold_their_own_points():
    p = np.random.default_rng(1).standard_normal((1000, 6))
    tree = ann.KdTree(p, 20)
    where = ann.leaves(tree.splits, p)
    assert sorted(tree.order.tolist()) == list(range(1000)) and (tree.end - tree.at).max() <= 20
    for i, (a, b) in enumerate(zip(tree.at, tree.end)):
        assert set(where[tree.order[a:b]]) == {i}


def test_neighbours_of_odd_vectors(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [float("nan"), 1.0]), (5, [float("inf"), 1.0]), (6, [None, 1.0]), (7, [2.0, 0.0]), (7, [3.0, 0.0]), (8, [1.0, 1.0, 1.0]), (None, [1.0, 0.0]), (9, [1.0, 0.0]), (10, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"v": F.lit(1), "block": F.lit(2), "turn": F.lit(3)})
    got = [tuple(r) for r in ann.nearest(df, df.where("vec_id in (0, 2, 8)")).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1, 0.0), (0, 2, 9, 0.0), (0, 3, 7, 1.0)]
    assert ann.nearest(df.limit(0), df.limit(0)).count() == 0


# -- pipeline


def test_pipeline_matches_plain_stages(spark, tmp_path):
    """Each stage against a plain version of it on what the stage before has kept."""
    import corpus_pipeline as p

    from tests.llm.test_text_operators import brute_components, brute_lines

    small = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns, kept, out = docs.columns, [{r.doc_id: r for r in docs.collect()}], docs
    for k, (_, stage) in enumerate(p.STAGES):
        made = stage(spark, out, small)
        assert k == len(p.STAGES) - 1 or made.columns == columns
        made.write.parquet(str(tmp_path / str(k)))
        out = spark.read.parquet(str(tmp_path / str(k)))
        kept.append({r.doc_id: r for r in out.collect()})
    start, good, known, lines, single = kept[:5]
    frame = lambda rows: spark.createDataFrame([(r.doc_id, r.text, r.lang) for r in rows.values()], "doc_id long, text string, lang string")
    model = quality.fit(frame(start), spark.read.parquet(f"{small}/labels.parquet"))
    assert set(good) == {i for i, r in start.items() if model.score(r.text) >= 0.7}
    c = language_id.LanguageConfig()
    zips = language_id._compressors(language_id.dictionaries(frame(good)), c.level)
    assert set(known) == {i for i, r in good.items() if not language_id.classify(r.text, zips, c)[2]}
    plain = brute_lines({i: r.text.split("\n") for i, r in known.items()}, 50)
    assert {i: r.text for i, r in lines.items()} == {i: t for i, t in plain.items() if t or t == known[i].text}
    assert any(t != known[i].text for i, t in plain.items())
    assert set(single) == {i for i, (_, comp) in brute_components({i: r.text for i, r in lines.items()}, 5).items() if i == comp}
    assert {i: r.text for i, r in single.items()} == {i: lines[i].text for i in single}
    pieces = out.collect()
    assert {r.doc_id for r in pieces} == set(single) and sum(r.length for r in pieces) == sum({r.doc_id: r.doc_tokens for r in pieces}.values())


def test_run_keeps_its_last_stage_only(spark):
    import corpus_pipeline as p

    from tidemark.llm.common import scratch_root

    found = p.run(spark, "/root/testdata/sf0.001")
    left = [x for x in os.listdir(scratch_root(spark).removeprefix("file:")) if x.startswith("pipeline-")]
    assert found.count() > 50 and len(left) == 1 and left[0].startswith("pipeline-packing")


def test_stages_bear_odd_rows(spark):
    import corpus_pipeline as p

    clean = spark.createDataFrame([tuple(r) for r in ROWS], "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in p.STAGES:
        ids = [r.doc_id for r in stage(spark, clean, SF).select("doc_id").collect()]
        assert set(ids) <= {r[0] for r in ROWS}, name
        assert name != "line_dedup" or sorted(ids, key=str) == sorted((r[0] for r in ROWS), key=str)
        assert name != "near_dedup" or sorted(ids, key=str) == sorted((r[0] for r in ROWS), key=str)  # rows with one id are one document
        assert name != "packing" or set(ids) == {r[0] for r in ROWS}
        assert name != "quality" or (2 in ids) == (3 in ids)  # null and empty texts alike
        assert name != "language" or not {2, 3, 4, 6} & set(ids)
        assert stage(spark, clean.limit(0), SF).count() == 0, name


def test_samples_are_bounded_by_rows_and_characters(spark):
    docs = spark.createDataFrame([(i, "x" * 100) for i in range(60)] + [(5, "x" * 50), (70, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(80)] + [(4, 0)], "doc_id long, quality int")
    counts = lambda **k: sorted((r.quality, r["count"]) for r in quality.sample(docs, labels, quality.QualityConfig(**k)).groupBy("quality").count().collect())
    assert counts(sample_per_class=7) == [(0, 7), (1, 7)]
    assert counts(sample_chars=450) == [(0, 5), (1, 5)] or counts(sample_chars=450) == [(0, 5), (1, 4)]
    assert counts(sample_chars=1) == [(0, 1), (1, 1)]
