"""Byte-level BPE by a pair occurrence index.

The distinct pieces of a batch of texts lie one after the other in one array of symbols. An index maps
every mergeable pair to all its positions there. The ranks that occur are taken in ascending order; all
positions of a rank are merged together, and only the lists of the pairs beside them change. Pieces that were
encoded before come from a bounded cache.
"""

from __future__ import annotations

import hashlib
import heapq
import itertools
import json
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import sole_cache, table


@dataclass(frozen=True)
class BpeConfig:
    tokenizer: str | None = None  # path of a byte-level tokenizers file; None: the public one
    cached_pieces: int = 900_000

    def path(self) -> str:
        if self.tokenizer:
            return self.tokenizer
        import public_tokenizers

        return public_tokenizers.path("byte_bpe_50k.json")


#: How the vocabulary file writes bytes as printable characters, and how texts are cut before merging.
PRINTABLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
PIECE = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Where no white space meets a space, every space begins a piece.
_IRREGULAR = re.compile(r" \s|\s |\A | \Z|[\x1c-\x1f]")


class ByteBpe:
    TOGETHER = 8_000_000  # characters of texts whose new pieces are merged in one index; a longer text is one group

    def __init__(self, path: str, limit: int):
        import regex

        spec = json.load(open(path, encoding="utf-8"))
        vocabulary = spec["model"]["vocab"]
        char_of = {b: chr(b) for b in PRINTABLE} | {b: chr(256 + i) for i, b in enumerate(x for x in range(256) if x not in set(PRINTABLE))}
        byte_of = {c: b for b, c in char_of.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of = {str(i): bytes(byte_of[c] for c in token) for token, i in vocabulary.items() if all(c in byte_of for c in token)} | {str(i): t.encode() for t, i in self.special.items()}
        self.of_byte = np.array([vocabulary[char_of[b]] for b in range(256)], np.int64)
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        left, right, self.made = (np.array(x, np.int64) for x in zip(*((vocabulary[a], vocabulary[b], vocabulary[a + b]) for a, b in pairs), strict=True))
        codes = left << 32 | right
        order = np.argsort(codes, kind="stable")
        self.codes, self.rank_at = codes[order], order
        self.piece, self.limit = regex.compile(PIECE), limit
        self.split_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.mark = os.path.commonprefix(list(self.special)) if self.special else "\0"
        self.cache: dict[str, str] = {}  # ids of a segment as decimals joined by commas

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, -1 where there is none."""
        code = left << 32 | right
        at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        return np.where(self.codes[at] == code, self.rank_at[at], -1)

    def merge(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces (none of them empty), one after the other, and where each piece's begin and the last one's end."""
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        symbol = self.of_byte[np.frombuffer(b"".join(pieces), np.uint8)]
        n = len(symbol)
        starts = np.concatenate([[0], np.cumsum(sizes)])
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        after[starts[1:] - 1] = n  # the position n stands for no neighbour
        before[starts[:-1]] = n
        symbol, after, before = np.append(symbol, -1), np.append(after, n), np.append(before, n)
        index: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def enlist(positions: np.ndarray) -> None:
            rank = self.ranks(symbol[positions], symbol[after[positions]])
            positions, rank = positions[rank >= 0], rank[rank >= 0]
            if not len(rank):
                return
            order = np.argsort(rank, kind="stable")
            found, first = np.unique(rank[order], return_index=True)
            for r, at in zip(found.tolist(), np.split(positions[order], first[1:]), strict=True):
                if r not in index:
                    index[r] = []
                    heapq.heappush(active, r)
                index[r].append(at)

        begin = np.arange(n)
        enlist(begin[after[:n] < n])
        while active:
            rank = heapq.heappop(active)
            lists = index.pop(rank)
            at = np.unique(np.concatenate(lists)) if len(lists) > 1 else lists[0]
            place = np.searchsorted(self.codes, self.pair_code(rank))
            a, b = int(self.codes[place] >> 32), int(self.codes[place] & 0xFFFFFFFF)
            at = at[(symbol[at] == a) & (symbol[after[at]] == b)]
            if a == b and len(at) > 1:  # in a run of the same symbol every second position merges
                at.sort()
                taken = []
                last = -1
                for p in at.tolist():
                    if p != last:
                        taken.append(p)
                        last = int(after[p])
                at = np.array(taken, np.int64)
            if not len(at):
                continue
            gone = after[at]
            rest = after[gone]
            symbol[at] = self.made[rank]
            symbol[gone] = -1
            after[at] = rest
            inner = rest < n
            before[rest[inner]] = at[inner]
            ahead = before[at]
            ahead = ahead[ahead < n]
            enlist(np.unique(np.concatenate([ahead, at[inner]])))
        left = symbol[:n] >= 0
        ids = symbol[:n][left]
        return ids, np.concatenate([[0], np.cumsum(left)])[starts]

    def pair_code(self, rank: int) -> int:
        if not hasattr(self, "_code_of"):
            self._code_of = np.empty(len(self.codes), np.int64)
            self._code_of[self.rank_at] = self.codes
        return self._code_of[rank]

    def _pieces(self, segment: str) -> list[str]:
        """Pieces to merge, and special tokens."""
        if self.mark in segment and any(x in segment for x in self.special):
            return [y for x in self.split_special.split(segment) for y in ([x] if x in self.special else self.piece.findall(x))]
        return self.piece.findall(segment)

    def _segments(self, text: str) -> list[str]:
        """Parts of a text that can be encoded alone."""
        if not text:
            return []
        if _IRREGULAR.search(text):
            return self._whole(text)
        first, *rest = text.split(" ")
        return [first, *(" " + x for x in rest)]

    def _whole(self, text: str) -> list[str]:
        parts = self.split_special.split(text) if self.split_special else [text]
        return [y for x in parts if x for y in ([x] if x in self.special else self.piece.findall(x))]

    def clear(self) -> None:
        self.cache.clear()

    def _learn(self, new: list[str]) -> None:
        """Encode segments together."""
        parts = list(map(self._pieces, new))
        distinct = list({p for x in parts for p in x if p not in self.special})
        merged = {t: str(i) for t, i in self.special.items()}
        if distinct:
            ids, at = self.merge([p.encode("utf-8") for p in distinct])
            words, at = list(map(str, ids.tolist())), at.tolist()
            merged |= {p: ",".join(words[i:j]) for p, i, j in zip(distinct, at, at[1:])}
        self.cache.update((s, merged[x[0]] if len(x) == 1 else ",".join(map(merged.__getitem__, x))) for s, x in zip(new, parts, strict=True))

    def encode(self, texts: list[str]) -> Iterator[str]:
        """The ids of each text as decimals joined by commas."""
        ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts))) // self.TOGETHER
        for own in np.split(np.arange(len(texts)), np.flatnonzero(np.diff(ends)) + 1):
            cut = [self._segments(texts[i]) for i in own]
            met = set(itertools.chain.from_iterable(cut))
            if len(self.cache) > self.limit:
                self.cache = {s: self.cache[s] for s in met if s in self.cache}
            self._learn([s for s in met if s not in self.cache])
            for segments in cut:
                yield ",".join(map(self.cache.__getitem__, segments))

    def decode(self, ids: str) -> str:
        """The text of ids given as decimals joined by commas."""
        return b"".join(map(self.bytes_of.__getitem__, ids.split(","))).decode("utf-8", "replace") if ids else ""


_LOADED: dict[tuple[str, int], ByteBpe] = {}


def tokenizer(c: BpeConfig) -> ByteBpe:
    key = (c.path(), c.cached_pieces)
    if key not in _LOADED:
        _LOADED[key] = ByteBpe(*key)
    return _LOADED[key]


def encode_texts(docs: DataFrame, config: BpeConfig = BpeConfig(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids) of every row: ids is an array of the whole text's ids, empty for null and empty texts. Ids may repeat or be null."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = sole_cache(tokenizer(config))
        for batch in batches:
            ids = [np.array(x.split(","), np.int32) if x else np.empty(0, np.int32) for x in bpe.encode([t or "" for t in batch.column(1).to_pylist()])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def decode_ids(encoded: DataFrame, config: BpeConfig = BpeConfig()) -> DataFrame:
    """(doc_id, text) of (doc_id, ids); null ids give a null text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = sole_cache(tokenizer(config))
        for batch in batches:
            texts = [None if x is None else bpe.decode(",".join(map(str, x))) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def encoding_digests(docs: DataFrame, config: BpeConfig = BpeConfig(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row: each text is encoded, and the ids are decoded again.

    Null and empty texts have no ids; both digests are then those of the empty string. Rows with repeated or null
    ids are treated like any other, other columns are not looked at, an empty table gives an empty result.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = sole_cache(tokenizer(config))
        for batch in batches:
            sha = lambda s: hashlib.sha256(s.encode("utf-8")).hexdigest()
            rows = [(ids.count(",") + 1 if ids else 0, sha(ids), sha(bpe.decode(ids))) for ids in bpe.encode([t or "" for t in batch.column(1).to_pylist()])]
            n, encoded, decoded = zip(*rows, strict=True) if rows else ([], [], [])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(encoded, pa.string()), pa.array(decoded, pa.string())],
                names=[x.split()[0] for x in DIGESTS.split(", ")],
            )

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, DIGESTS)


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding_digests(table(spark, sf_dir, "documents"))
