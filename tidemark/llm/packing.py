"""Packing of token streams into windows by an order-preserving dynamic programme.

The documents of a partition, in their order, are one stream of ids. A window may end at the
end of a document or of a sentence; where a sentence is longer than a window, also after every
`stride` ids. Over these cut points c_0 < c_1 < ... the programme finds

    cost(j) = min over i < j with c_j - c_i <= length of cost(i) + padding(c_j - c_i) + penalty(j)

where padding is length - size, or 0 if size is a power of two, and penalty is what a cut inside
a document costs. cost(i) + length + c_i does not depend on j, so the minimum over the reachable i is the
head of a monotone queue; the powers of two from 64 on are looked up one by one. A stream is solved in
blocks; the last window of a block is carried over into the next one, so memory is bounded by
the block and the longest document, and padding is lost only at the end of a partition.
"""

from __future__ import annotations

import json
import re
import zlib
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import sole_cache, table


@dataclass(frozen=True)
class PackConfig:
    tokenizer: str | None = None  # path of a tokenizers file; None: the public word-level one
    end_id: int = 1
    length: int = 2048
    cut_penalty: int = 8
    stride: int = 64
    block_windows: int = 256
    cached_words: int = 600_000

    def path(self) -> str:
        if self.tokenizer:
            return self.tokenizer
        import public_tokenizers

        return public_tokenizers.path("word_bpe_49k.json")


#: Words in which lower-casing is all that the normalizer does: printable ASCII and the letters of Latin-1.
_PLAIN = re.compile("[\x21-\x7e\xc0-\xff]+")


def _lowers(spec: dict) -> bool:
    """Whether a tokenizer composes, collapses white space, lower-cases, cuts by a pattern and maps bytes: then plain words can go to its model directly."""
    steps = (spec.get("normalizer") or {}).get("normalizers", [])
    cuts = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
    return [x["type"] for x in steps] == ["NFC", "Replace", "Lowercase"] and [x["type"] for x in cuts] == ["Split", "ByteLevel"] and cuts[0]["invert"] and not cuts[1]["use_regex"] and not cuts[1]["add_prefix_space"]


class _PieceIds(dict):
    """Ids of a piece between cuts, from the tokenizer's own model."""

    def __init__(self, tokenizer, limit: int):
        self.model, self.limit = tokenizer.model, limit

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= self.limit:
            self.clear()
        mapped = piece if piece.isascii() else "".join(_CHAR_OF[b] for b in piece.encode("utf-8"))
        self[piece] = ids = np.array([t.id for t in self.model.tokenize(mapped)], "<u4").tobytes()
        return ids


#: The bytes that byte-level vocabularies write as themselves; the others follow from 256 on.
_KEPT = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
_CHAR_OF = {b: chr(b) for b in _KEPT} | {b: chr(256 + i) for i, b in enumerate(x for x in range(256) if x not in _KEPT)}


class _WordIds(dict):
    """Ids of a word as little-endian bytes. The tokenizer drops white space and never joins over it, so words stand alone."""

    def __init__(self, path: str, limit: int):
        from tokenizers import Tokenizer

        self.tokenizer, self.limit = Tokenizer.from_file(path), limit
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        spec = json.load(open(path, encoding="utf-8"))
        self.plain = _PieceIds(self.tokenizer, limit) if _lowers(spec) else None
        if self.plain is not None:
            import regex

            self.pieces = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]).findall
        self.ends = np.zeros(max(vocabulary.values(), default=0) + 2, bool)
        for token, i in vocabulary.items():
            self.ends[i] = token.removesuffix("</w>")[-1:] in (".", "!", "?") and not token[:1].isalnum()

    def __missing__(self, word: str) -> bytes:
        if len(self) >= self.limit:
            self.clear()
        if self.plain is not None and _PLAIN.fullmatch(word) and "<|" not in word:
            ids = b"".join(map(self.plain.__getitem__, self.pieces(word.lower())))
        else:
            ids = np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, "<u4").tobytes()
        self[word] = ids
        return ids

    def clear(self) -> None:
        super().clear()
        if self.plain is not None:
            self.plain.clear()

    def ids(self, text: str) -> np.ndarray:
        if any(x in text for x in _CONTROLS):  # white space to Python, not to the tokenizer
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")
        return np.frombuffer(b"".join(map(self.__getitem__, text.split())), "<u4")


_CONTROLS = "\x1c\x1d\x1e\x1f"
_LOADED: dict[tuple[str, int], _WordIds] = {}


def _words(c: PackConfig) -> _WordIds:
    key = (c.path(), c.cached_words)
    if key not in _LOADED:
        _LOADED[key] = _WordIds(*key)
    return _LOADED[key]


def window_cuts(cuts: np.ndarray, soft: np.ndarray, length: int, penalty: int) -> list[int]:
    """Indexes into cuts (ascending, from 0, no gap above length) at which the cheapest windows end."""
    at, inner = cuts.tolist(), soft.tolist()
    powers = [1 << k for k in range(6, length.bit_length()) if 1 << k <= length]  # short windows save no padding worth a look
    index = {p: i for i, p in enumerate(at)}
    cost, back = [0] * len(at), [0] * len(at)
    queue: deque[tuple[int, int]] = deque([(at[0], 0)])  # (cost(i) + c_i, i), increasing
    for j in range(1, len(at)):
        end = at[j]
        while at[queue[0][1]] < end - length:
            queue.popleft()
        best, i = queue[0][0] + length - end, queue[0][1]
        for p in powers:
            k = index.get(end - p)
            if k is not None and cost[k] < best:
                best, i = cost[k], k
        best += penalty if inner[j] else 0
        cost[j], back[j] = best, i
        entry = best + end
        while queue and queue[-1][0] >= entry:
            queue.pop()
        queue.append((entry, j))
    out, j = [], len(at) - 1
    while j:
        out.append(j)
        j = back[j]
    return out[::-1]


def _cut_points(lengths: list[int], ends: np.ndarray, length: int, stride: int) -> tuple[np.ndarray, np.ndarray]:
    """Places where a window may end, from 0 on, and whether each lies inside a document."""
    docs = np.cumsum(lengths)
    hard = np.concatenate([[0], docs])
    points = np.union1d(hard, np.flatnonzero(ends) + 1)
    gaps = np.flatnonzero(np.diff(points) > length - stride)
    if len(gaps):
        points = np.union1d(points, np.concatenate([np.arange(points[g], points[g + 1], stride) for g in gaps]))
    return points, ~np.isin(points, hard, assume_unique=True)


class _Packer:
    """Packs one stream; gives pieces (doc position, start, length, sequence, offset) as windows are settled."""

    def __init__(self, c: PackConfig, ends: np.ndarray, first_sequence: int):
        self.c, self.ends, self.sequence = c, ends, first_sequence
        self.docs: list[tuple[object, int, int, np.ndarray]] = []  # (doc, start, doc_tokens, ids still to pack)
        self.held = 0

    def add(self, doc: object, ids: np.ndarray) -> Iterator[tuple]:
        self.docs.append((doc, 0, len(ids), ids))
        self.held += len(ids)
        if self.held >= self.c.block_windows * self.c.length:
            yield from self.settle(False)

    def settle(self, final: bool) -> Iterator[tuple]:
        if not self.docs:
            return
        lengths = [len(d[3]) for d in self.docs]
        points, soft = _cut_points(lengths, self.ends[np.minimum(np.concatenate([d[3] for d in self.docs]), len(self.ends) - 1)], self.c.length, self.c.stride)
        stops = points[window_cuts(points, soft, self.c.length, self.c.cut_penalty)].tolist()
        if not final:
            stops.pop()
        d = offset = begin = 0
        for stop in stops:
            while begin < stop:
                doc, start, total, ids = self.docs[d]
                take = min(len(ids), stop - begin)
                yield doc, start, take, zlib.crc32(ids[:take].tobytes()), total, self.sequence, offset
                begin, offset = begin + take, offset + take
                if take == len(ids):
                    d += 1
                else:
                    self.docs[d] = (doc, start + take, total, ids[take:])
            self.sequence, offset = self.sequence + 1, 0
        self.docs = self.docs[d:]
        self.held = sum(len(x[3]) for x in self.docs)


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, config: PackConfig = PackConfig(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece of a document in a packed window.

    doc_tokens counts the document's ids and its end id. sequence_id is the partition's number times 2**33 plus
    the window's place there; a partition is packed on its own, in its order, so nothing is shuffled. Null and
    empty texts are one end id. Rows with repeated or null ids are packed like any other. An empty table
    gives an empty result. Other columns are not looked at.
    """
    c = config

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = sole_cache(_words(c))
        packer = _Packer(c, words.ends, TaskContext.get().partitionId() << 33)
        end = np.array([c.end_id], "<u4")

        def rows(pieces: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (zip(*pieces, strict=True) if pieces else [[]] * 7)], names=[x.split()[0] for x in PIECES.split(", ")])

        for batch in batches:
            pieces: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), pc.fill_null(batch.column(1), "").to_pylist(), strict=True):
                pieces.extend(packer.add(doc, np.concatenate([words.ids(text), end])))
            yield rows(pieces)
        yield rows(list(packer.settle(True)))

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, PIECES)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


def pack_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the packed pieces of what the stages before have kept; null and empty texts are one end id, repeated rows are packed each, long texts cut."""
    return pack(docs)
