"""Alignment of two tokenizers against the libraries and a plain count of all links."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from tests.llm.data import ROWS, documents, empty
from tidemark.llm import alignment

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def libraries():
    import public_tokenizers as P
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    kept = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    byte_of = {chr(x): x for x in kept} | {chr(256 + i): x for i, x in enumerate(x for x in range(256) if x not in kept)}

    def tokens(text):
        """[(id, bytes)] of both sides."""
        e = a.encode(" " + text, add_special_tokens=False)
        of_b = lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
        return [(i, bytes(byte_of[x] for x in t)) for i, t in zip(e.ids, e.tokens, strict=True)], [(i, of_b(i)) for i in b.encode(text)]

    return tokens


def plain(texts, tokens):
    """What the contract says, from all links of all groups, one by one."""
    found, count = [], Counter()
    for text in texts:
        groups = []
        if text:
            a, b = tokens(text)
            if b"".join(t for _, t in a) == b"".join(t for _, t in b) == (" " + text).encode():
                ends_a, ends_b = ({e: k for k, e in enumerate(np.cumsum([len(t) for _, t in x]).tolist(), 1)} for x in (a, b))
                i = j = 0
                for end in sorted(ends_a.keys() & ends_b.keys()):
                    k, m = ends_a[end], ends_b[end]
                    groups.append(([x for x, _ in a[i:k]], [x for x, _ in b[j:m]]))
                    i, j = k, m
        links = Counter((x, y) for p, q in groups for x in p for y in q)
        count.update(set(links))
        found.append((groups, links))
    top = defaultdict(int)
    for (x, _), n in count.items():
        top[x] = max(top[x], n)
    return [
        (sum(len(p) for p, _ in groups), sum(len(q) for _, q in groups), len(groups), sum(links.values()), sum(n for (x, y), n in links.items() if count[x, y] == top[x]), sum(n * count[k] for k, n in links.items()),
         hashlib.sha256(";".join(",".join(map(str, p)) + "|" + ",".join(map(str, q)) for p, q in groups).encode()).hexdigest() if groups else "")
        for groups, links in found
    ]


NAMES = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
ODD = ["x", " ", "  two  spaces ", "\n\n a \n b\n", "tab\t and nbsp   em", "a▁b", "<|endoftext|> <s> </s> <unk>", "日本語 テキスト 🙂🙂", "a" * 700, "\x00\x1c \x1d x", "don't we're I'LL 's", "1234567 89, 10.5e7 --- !!!", "é" * 50 + " ñandú", "́ ½"]


@pytest.mark.parametrize(("piece", "words", "together"), [(1, 3, 2), (7, 40, 10), (128, 3_000_000, 400_000)])
def test_alignment_matches_plain_links(spark, libraries, piece, words, together):
    rng = random.Random(piece)
    letters = ["a", "b", "the", " ", " ", " ", "ing", "\n", "é", "9", ".", "日", "🙂", "X"]
    texts = [*ODD, *("".join(rng.choice(letters) for _ in range(rng.randrange(1, 60))) for _ in range(120))]
    texts += [*texts[:9], None, ""]
    c = alignment.AlignConfig(piece_tokens=piece, block_words=words, together_words=together, cached_segments=60)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    got = {r.doc_id: tuple(r[x] for x in NAMES) for r in alignment.align(df, c).collect()}
    assert [got[i] for i in range(len(texts))] == plain(texts, libraries)


def test_op11_matches_plain_links(spark, libraries):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: tuple(r[x] for x in NAMES) for r in alignment.op11_token_alignment(spark, SF).collect()}
    assert [got[r.doc_id] for r in docs] == plain([r.text for r in docs], libraries)


def test_alignment_of_odd_rows(spark, libraries):
    df = documents(spark)
    got = Counter(tuple(r) for r in alignment.align(df).select("doc_id", *NAMES).collect())
    assert got == Counter((r[0], *p) for r, p in zip(ROWS, plain([r[1] for r in ROWS], libraries), strict=True))
    assert {r for r in got if r[0] in (2, 3)} == {(i, 0, 0, 0, 0, 0, 0, "") for i in (2, 3)}
    assert alignment.align(empty(spark)).count() == 0


def test_pieces_of_a_merge_hold_equal_work():
    a, b = np.cumsum(np.tile([1, 5, 2], 500)), np.cumsum(np.tile([4, 4], 500))
    at = np.arange(0, len(a) + len(b), 64)
    taken = alignment.crossings(a, b, at)
    for d, i in zip(at.tolist(), taken.tolist(), strict=True):
        first = np.sort(np.concatenate([a * 2, b * 2 + 1]), kind="stable")[:d]  # A's ends come first of equal ones
        assert i == int((first % 2 == 0).sum())


def test_a_group_without_common_ends_is_not_multiplied_out():
    """Both sides cover the same bytes with ends that never meet: the links are counted from distinct ids."""
    known = alignment.Segments(alignment.AlignConfig())
    known.learn(["a" * 40_000])
    n_a, n_b, n_groups, n_links, sizes, pairs, links = known.columns()
    assert n_links[0] == links.sum() and len(pairs) == sizes[0] < 100 and n_a[0] > 1000
