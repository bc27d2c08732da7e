"""Alignment of two tokenizers' ids by the bytes they cover.

The ends of A's and B's tokens in the same bytes are two ascending lists. Merging them gives groups: runs of tokens between
places where both end. The merge is divided along its path: a binary search on every diagonal of the grid (tokens of A by tokens
of B) finds where the merge crosses it, so all pieces between two diagonals hold the same number of tokens and can be merged on
their own, all in step. A piece numbers the groups it closes from 0; adding up what the pieces before it have closed stitches
a group that crosses a border.

A text is cut at single spaces between words, where both tokenizers always begin a token, and a segment that a worker has met
before comes from its cache. Texts are gathered into blocks. Each block hands in its own pairs with the number of its
documents that hold them, so what is shuffled grows with the distinct pairs of blocks, never with the links; the counts come
back to the block, where they are summed up per segment and then per document.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.bpe import PIECE, PRINTABLE
from tidemark.llm.common import materialize, sole_cache, table


@dataclass(frozen=True)
class AlignConfig:
    tokenizer_a: str | None = None  # path of a byte-level tokenizers file; None: the public one
    tokenizer_b: str | None = None  # path of a sentencepiece model that adds a space in front; None: the public one
    piece_tokens: int = 128  # tokens of both sides that a piece of a merge holds
    cached_segments: int = 250_000
    block_words: int = 1_500_000  # a block ends after the document that reaches this
    together_words: int = 200_000  # words whose documents are summed up in one step

    def paths(self) -> tuple[str, str]:
        if self.tokenizer_a and self.tokenizer_b:
            return self.tokenizer_a, self.tokenizer_b
        import public_tokenizers

        return self.tokenizer_a or public_tokenizers.path("byte_bpe_50k.json"), self.tokenizer_b or public_tokenizers.path("piece_bpe_32k.model")


def crossings(ends_a: np.ndarray, ends_b: np.ndarray, diagonals: np.ndarray) -> np.ndarray:
    """How many tokens of A the merge has taken when it has taken as many in all as each diagonal says; of equal ends A's comes first."""
    low, high = np.maximum(0, diagonals - len(ends_b)), np.minimum(diagonals, len(ends_a))
    while (open_ := low < high).any():
        middle = (low + high) // 2
        taken = open_ & (ends_a[np.minimum(middle, len(ends_a) - 1)] <= ends_b[np.maximum(diagonals - middle - 1, 0)])
        low, high = np.where(taken, middle + 1, low), np.where(open_ & ~taken, middle, high)
    return low


def merged_groups(ends_a: np.ndarray, ends_b: np.ndarray, piece: int) -> tuple[np.ndarray, np.ndarray]:
    """The group of every token of A and of B. Both lists of ends are strictly ascending and have the same last end."""
    na, nb = len(ends_a), len(ends_b)
    group_a, group_b = np.zeros(na, np.int64), np.zeros(nb, np.int64)
    if not na or not nb:
        return group_a, group_b
    borders = np.append(np.arange(0, na + nb, piece), na + nb)
    from_a = crossings(ends_a, ends_b, borders)
    i, left = from_a[:-1].copy(), np.diff(borders)
    j = borders[:-1] - i
    from_b = np.append(j, nb)
    closed = np.zeros(len(i), np.int64)
    beyond = np.iinfo(np.int64).max
    a, b = np.append(ends_a, beyond), np.append(ends_b, beyond)
    for step in range(int(left.max())):
        if step == left[-1] < left[0]:  # the last piece is shorter
            i, j, closed_last, closed = i[:-1], j[:-1], closed[-1:], closed[:-1]
        take = a[i] <= b[j]
        ia, jb = i[take], j[~take]
        group_a[ia] = closed[take]
        group_b[jb] = closed[~take]
        i = i + take
        j = j + ~take
        closed[~take] += a[i[~take] - 1] == b[jb]  # a token of B that ends where A's last one did closes the group
    if len(closed) < len(from_a) - 1:
        closed = np.concatenate([closed, closed_last])
    before = np.cumsum(closed) - closed  # stitches: groups closed by the pieces before
    return group_a + np.repeat(before, np.diff(from_a)), group_b + np.repeat(before, np.diff(from_b))


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The positions start, start + 1, ... of each run, one run after the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


def _counted(keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, with the sum of their weights."""
    if not len(keys):
        return keys, weights
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(weights[order], first)


class Segments:
    """Segments that a worker has met: their tokens, groups and linked pairs, by number."""

    #: A space with white space, or an end of the text, beside it.
    _ODD = re.compile(r" (?:(?!\S)|(?<=\A )|(?<=\s ))")
    _CUT = re.compile(r"(?<=\S) (?=\S)")
    CHUNK = 300_000  # characters of new segments that are merged at a time; a longer segment is merged alone

    def __init__(self, c: AlignConfig):
        import sentencepiece
        import tiktoken

        self.c = c
        path_a, path_b = c.paths()
        spec = json.load(open(path_a, encoding="utf-8"))
        vocabulary = spec["model"]["vocab"]
        byte_of = {chr(b): b for b in PRINTABLE} | {chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in set(PRINTABLE))}
        special = {t["content"] for t in spec["added_tokens"]}
        of_a = {bytes(byte_of[x] for x in t): i for t, i in vocabulary.items() if t not in special}
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        made = [vocabulary["".join(m)] for m in merges]
        if made != sorted(made):
            raise ValueError("ids of the first tokenizer must follow its merges")
        self.a = tiktoken.Encoding("a", pat_str=PIECE, mergeable_ranks=of_a, special_tokens={})  # the same vocabulary as ranks
        self.bytes_a = {i: t for t, i in of_a.items()}
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.vocab_size())]
        if any("▁" in p.lstrip("▁") for p in pieces):
            raise ValueError("pieces of the second tokenizer must not reach over a space")
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.size_a = np.array([len(self.bytes_a.get(i, b"")) for i in range(max(self.bytes_a) + 1)], np.int64)
        self.size_b = np.array(list(map(len, self.bytes_b)), np.int64)
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.said: list[str | None] = []  # `a1,a2|b1;...`; None where the bytes of the tokens aren't those of the text
        self._parts: list[tuple[np.ndarray, ...]] = []
        self._whole: tuple[np.ndarray, ...] | None = None

    def columns(self) -> tuple[np.ndarray, ...]:
        """By number: tokens of A, of B, groups, links, where the pairs end; then of all pairs: A << 32 | B, and the links of it."""
        if self._parts:
            parts = list(zip(*([self._whole] if self._whole else []) + self._parts, strict=True))
            *flat, sizes, pairs, links = (np.concatenate(x) for x in parts)
            self._whole, self._parts = (*flat, sizes, pairs, links), []
        if self._whole is None:
            return tuple(np.zeros(0, np.int64) for _ in range(7))
        return self._whole

    def cut(self, text: str) -> list[str]:
        return self._CUT.split(text) if self._ODD.search(text) else text.split(" ")

    def numbers(self, segments: list[str]) -> list[int]:
        return list(map(self.number.__getitem__, segments))

    def learn(self, new: list[str]) -> None:
        chunk: list[str] = []
        held = 0
        for s in new:
            chunk.append(s)
            held += len(s) + 1
            if held >= self.CHUNK:
                self._learn(chunk)
                chunk, held = [], 0
        if chunk:
            self._learn(chunk)

    def _learn(self, new: list[str]) -> None:
        plain = [s for s in new if s and not s[0].isspace() and not s[-1].isspace()]
        if len(plain) < len(new):
            new = plain + [s for s in new if not s or s[0].isspace() or s[-1].isspace()]
        ids_a = self.a.encode_ordinary(" " + " ".join(plain)) if plain else []
        for s in new[len(plain) :]:
            ids_a += self.a.encode_ordinary(" " + s)
        ids_b = self.b.encode(new, num_threads=1)
        texts = [b" " + s.encode() for s in new]
        ends = np.cumsum([len(t) for t in texts])
        a = np.array(ids_a, np.int64)
        ends_a = np.cumsum(self.size_a[a])
        at_a = np.searchsorted(ends_a, ends, "right")  # tokens of A up to the end of each segment
        name, bytes_b = len(self.said), self.bytes_b
        sound = np.array([b"".join([bytes_b[i] for i in x]) == t for x, t in zip(ids_b, texts, strict=True)])
        if b"".join(map(self.bytes_a.__getitem__, ids_a)) != b"".join(texts):
            raise ValueError("the first tokenizer doesn't keep all bytes")
        sizes_a = np.diff(at_a, prepend=0)
        sizes_b = np.where(sound, [len(x) for x in ids_b], 0)
        a = a[np.repeat(sound, sizes_a)]
        sizes_a = np.where(sound, sizes_a, 0)
        b = np.array([i for x, good in zip(ids_b, sound.tolist(), strict=True) if good for i in x], np.int64)
        group_a, group_b = merged_groups(np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b]), self.c.piece_tokens)
        groups = int(group_a[-1]) + 1 if len(a) else 0
        cut_a, cut_b = (np.searchsorted(x, np.arange(groups + 1)) for x in (group_a, group_b))
        last = np.append(group_a, -1)[np.cumsum(sizes_a) - 1] if len(a) else np.full(len(new), -1)
        to_group = np.maximum.accumulate(np.where(sound, last + 1, 0)) if len(new) else last
        n_groups = np.diff(to_group, prepend=0)

        words_a, words_b = list(map(str, a.tolist())), list(map(str, b.tolist()))
        ca, cb = cut_a.tolist(), cut_b.tolist()
        said = [
            (words_a[p] if q - p == 1 else ",".join(words_a[p:q])) + "|" + (words_b[r] if s - r == 1 else ",".join(words_b[r:s]))
            for p, q, r, s in zip(ca, ca[1:], cb, cb[1:], strict=False)
        ]
        tg = [0, *to_group.tolist()]
        self.said += [(said[p] if q - p == 1 else ";".join(said[p:q])) if good else None for p, q, good in zip(tg, tg[1:], sound.tolist(), strict=False)]

        # a group links its distinct ids of A with its distinct ids of B, so a long group costs what its ids make, not its links
        one_a, times_a = _counted(group_a << 32 | a, np.ones(len(a), np.int64))
        one_b, times_b = _counted(group_b << 32 | b, np.ones(len(b), np.int64))
        edge_b = np.searchsorted(one_b >> 32, np.arange(groups + 1))
        own = one_a >> 32
        fan = (edge_b[1:] - edge_b[:-1])[own] if groups else np.zeros(0, np.int64)
        with_b = _spread(edge_b[own], fan)
        code = np.repeat(one_a & 0xFFFFFFFF, fan) << 32 | (one_b[with_b] & 0xFFFFFFFF)
        links = np.repeat(times_a, fan) * times_b[with_b]
        segment = np.searchsorted(to_group, np.repeat(own, fan), "right")
        order = np.lexsort((code, segment))
        segment, code, links = segment[order], code[order], links[order]
        first = np.flatnonzero(np.concatenate([[True], (segment[1:] != segment[:-1]) | (code[1:] != code[:-1])])) if len(code) else np.zeros(0, np.int64)
        pairs = np.bincount(segment[first], minlength=len(new)).astype(np.int64)
        links = np.add.reduceat(links, first) if len(first) else links
        total = np.concatenate([[0], np.cumsum(links)])
        bounds = np.concatenate([[0], np.cumsum(pairs)])
        self._parts.append((sizes_a, sizes_b, n_groups, total[bounds[1:]] - total[bounds[:-1]], pairs, code[first], links))
        self.number.update(zip(new, range(name, name + len(new)), strict=True))


_LOADED: dict[AlignConfig, Segments] = {}
_NO_CACHE: dict = {}


def _segments(c: AlignConfig) -> Segments:
    if c not in _LOADED:
        _LOADED[c] = Segments(c)
    return _LOADED[c]


#: A document has doc_id to segments; a block has one more row, without `of`, with pairs to links: its distinct pairs A << 32 | B, how many
#: of its documents hold each, and of its distinct segments the number of pairs, their places and links.
_BLOCKS = "block long, of long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, segments binary, pairs array<long>, docs array<int>, sizes array<int>, places array<int>, links array<long>"
_TYPES = [pa.int64()] * 7 + [pa.string(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int64())]


def _rows(columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, t) for x, t in zip(columns, _TYPES, strict=True)], names=[x.split()[0] for x in _BLOCKS.split(", ")])


def _squeeze(ascending: np.ndarray, times: np.ndarray) -> bytes:
    """A document's distinct segments as steps, and how often it has each, byte by byte of all numbers."""
    import zstandard

    both = np.concatenate([np.diff(ascending, prepend=0), times]).astype("<u4")
    return zstandard.compress(both.view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def _unsqueezed(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    import zstandard

    both = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(4, -1).T.copy().view("<u4").ravel().astype(np.int64)
    return np.cumsum(both[: len(both) // 2]), both[len(both) // 2 :]


class _Block:
    """Documents whose pairs are counted together."""

    def __init__(self, block: int, known: Segments):
        self.block, self.known = block, known
        self.words = self.docs = 0
        self.steps: list[tuple] = []
        self.pairs: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, ids: list, segments: list[list[str]]) -> None:
        """Documents with their segments; without any, a document has no tokens."""
        known = self.known
        met = set().union(*segments)
        known.learn([s for s in met if s not in known.number])
        n_a, n_b, n_groups, n_links, sizes, pairs, links = known.columns()
        numbers = [known.numbers(s) for s in segments]
        digests, good = [], []
        for own in numbers:
            said = [known.said[k] for k in own]
            whole = bool(said) and None not in said
            good.append(whole)
            digests.append(hashlib.sha256(";".join(said).encode()).hexdigest() if whole else "")
        counts = np.array([len(x) if g else 0 for x, g in zip(numbers, good, strict=True)], np.int64)
        flat = np.array([k for x, g in zip(numbers, good, strict=True) if g for k in x], np.int64)
        bounds = np.concatenate([[0], np.cumsum(counts)])
        summed = [np.diff(np.concatenate([[0], np.cumsum(x[flat])])[bounds]) for x in (n_a, n_b, n_groups, n_links)] if len(flat) else [np.zeros(len(ids), np.int64)] * 4
        keys, times = _counted(np.repeat(np.arange(len(ids)), counts) << 32 | flat, np.ones(len(flat), np.int64))
        doc, segment = keys >> 32, keys & 0xFFFFFFFF
        self.steps.append((ids, *summed, digests, np.bincount(doc, minlength=len(ids)), segment, times))
        if len(flat):
            starts = np.cumsum(sizes) - sizes
            at = _spread(starts[segment], sizes[segment])
            distinct, place = np.unique(pairs[at], return_inverse=True)
            once = np.unique(np.repeat(doc, sizes[segment]) * len(distinct) + place)  # each pair once a document
            self.pairs.append((distinct, np.bincount(once % len(distinct), minlength=len(distinct))))
        self.words += int(counts.sum())
        self.docs += len(ids)

    def rows(self) -> Iterator[pa.RecordBatch]:
        if not self.docs:
            return
        *_, sizes, pairs, links = self.known.columns()
        own = np.unique(np.concatenate([s[7] for s in self.steps]))
        of = 0
        for ids, a, b, groups, n_links, digests, counts, segment, times in self.steps:
            bounds = np.concatenate([[0], np.cumsum(counts)])
            n, local = len(ids), np.searchsorted(own, segment)
            squeezed = [_squeeze(local[i:j], times[i:j]) if i < j else b"" for i, j in zip(bounds.tolist(), bounds[1:].tolist(), strict=False)]
            yield _rows([np.full(n, self.block), np.arange(of, of + n), ids, a, b, groups, n_links, digests, squeezed, *([[None] * n] * 5)])
            of += n
        distinct, docs = _counted(*(np.concatenate(x) for x in zip(*self.pairs, strict=True))) if self.pairs else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        at = _spread((np.cumsum(sizes) - sizes)[own], sizes[own]) if len(own) else np.zeros(0, np.int64)
        yield _rows([[self.block], *([[None]] * 8), [distinct], [docs], [sizes[own] if len(own) else []], [np.searchsorted(distinct, pairs[at]) if len(own) else []], [links[at] if len(own) else []]])


def aligned_blocks(docs: DataFrame, c: AlignConfig, id_col: str, text_col: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sole_cache(_segments(c))
        first = number = TaskContext.get().partitionId() << 32
        block = _Block(number, known)
        for batch in batches:
            ids, cut, words = [], [], 0
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py()
                ids.append(doc)
                cut.append(known.cut(text) if text else [])
                words += len(cut[-1])
                if words >= c.together_words:
                    block.add(ids, cut)
                    ids, cut, words = [], [], 0
                if block.words >= c.block_words:
                    yield from block.rows()
                    number += 1
                    block = _Block(number, known)
                    if len(known.number) > c.cached_segments:
                        known.clear()
            block.add(ids, cut)
        yield from block.rows()
        if len(known.number) > c.cached_segments:
            known.clear()
        assert number - first < 1 << 32

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, _BLOCKS)


RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def _scored(block: pa.Table, told: pa.Table) -> pa.Table:
    """The documents of a block; told: of each of its pairs (place), the count and whether it is the highest of its id of A."""
    import pyarrow.compute as pc

    sole_cache(_NO_CACHE)
    docs = block.filter(pc.is_valid(block["of"])).combine_chunks()
    head = block.filter(pc.is_null(block["of"])).combine_chunks()
    array = lambda x: x.to_numpy().astype(np.int64)
    values = lambda rows, name: array(rows[name].combine_chunks().flatten())
    n = len(head["pairs"][0])
    count, best = np.zeros(n, np.int64), np.zeros(n, np.int64)
    place = array(told["place"])
    count[place], best[place] = array(told["n"]), array(told["best"])
    places, links, sizes = (values(head, x) for x in ("places", "links", "sizes"))
    ends = np.cumsum(sizes)
    summed = lambda x, ends: np.diff(np.concatenate([[0], np.cumsum(x)])[ends], prepend=0)
    of_segment = [summed(links * x[places], ends) for x in (best, count)]
    own = [_unsqueezed(x) if x else (np.zeros(0, np.int64),) * 2 for x in docs["segments"].to_pylist()]
    n_best, count_sum = ([int((times * x[segment]).sum()) for segment, times in own] for x in of_segment)
    out = docs.select(["doc_id", "n_a", "n_b", "n_groups", "n_links"])
    return out.append_column("n_best", pa.array(n_best, pa.int64())).append_column("count_sum", pa.array(count_sum, pa.int64())).append_column("groups_sha256", docs["groups_sha256"])


def pair_counts(blocks: DataFrame) -> DataFrame:
    """(pair, n, best) of all blocks: pair is the id of A << 32 | that of B, n the documents that hold it linked, best whether no pair of A's id has more."""
    counts = _pairs_of(blocks).groupBy("pair").agg(F.sum("docs").alias("n")).withColumn("a", F.shiftright("pair", 32))
    counts = materialize(counts, "pair-counts")
    top = counts.groupBy("a").agg(F.max("n").alias("top"))
    return counts.join(top, "a").select("pair", "n", (F.col("n") == F.col("top")).cast("int").alias("best"))


def _pairs_of(blocks: DataFrame) -> DataFrame:
    return blocks.where("of is null").select("block", F.posexplode(F.arrays_zip("pairs", "docs")).alias("place", "own")).select("block", "place", F.col("own.pairs").alias("pair"), F.col("own.docs").alias("docs"))


def align(docs: DataFrame, config: AlignConfig = AlignConfig(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: tokens of A and B, groups, links, links whose count is the highest of their A id, sum of counts, digest of the groups.

    A reads a space and the text, B, which adds the space itself, the text. Null and empty texts, and those whose tokens of B don't
    give back the text's bytes (U+2581 in the text), have no tokens: zeros and an empty digest. Special tokens in a text are plain
    text. The count of a pair is the number of rows that hold it linked: rows with repeated or null ids are documents of their
    own. Very long texts are merged in pieces of equal size; a block ends after the document that fills it. An empty table gives an
    empty result. Other columns are not looked at.
    """
    blocks = materialize(aligned_blocks(docs, config, id_col, text_col), "aligned")
    told = _pairs_of(blocks).join(pair_counts(blocks), "pair").select(F.col("block").alias("to"), "place", "n", "best")
    return blocks.groupBy("block").cogroup(told.groupBy("to")).applyInArrow(_scored, RESULT)


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(table(spark, sf_dir, "documents"))
