"""Near-duplicate documents by min-max hashing.

Every document becomes the set of its distinct word shingles (64-bit hashes). Each of
`permutations` multiplicative permutations is evaluated once over the set and gives two
signature values, its minimum and its maximum, so a signature of 2p values costs p
evaluations. Bands of `rows` values of different permutations are the candidate keys.

Exact copies of a set are one node, buckets with the same nodes are one bucket. First every node is compared with one hub,
the member of its buckets that shares most buckets with others; in a group of copies this joins most. Only buckets
that hold several components after that stay open: in each of them, the nodes outside its largest component are compared with the
members of other components, in pairs of blocks of bounded size. A pair is looked at in the first bucket that it shares. Signatures
are compared first, and only nodes that have a candidate in a block send their full sets there; on these the candidates are
confirmed where both lie, and what leaves a task are only links between components that it had not joined yet. So rows grow with nodes and links, never with the pairs of a group; no bucket is capped.

What is missed: a pair of similarity 0.8 shares no band with a probability of 3e-6, and its signatures differ by more than
`screen_deviations` with 3e-7; pairs that are more alike are missed less.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import connected_components, drop_scratch, materialize, sole_cache, table


@dataclass(frozen=True)
class MinMaxConfig:
    shingle_words: int = 5
    threshold_percent: int = 80
    permutations: int = 80
    rows: int = 5
    screen_deviations: float = 5.0  # pairs whose signatures agree so much less than at the threshold aren't confirmed
    block_shingles: int = 300_000  # of the sets that a task compares with as many others
    seed: int = 20240229


class _WordHashes(dict):
    LIMIT = 500_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_WORDS = _WordHashes()


def _own_cache() -> None:
    """For tasks: functions that are shipped to them would bring copies of the module's names along, this one is looked up there."""
    sole_cache(_WORDS)


_MIX = np.uint64(0x9E3779B97F4A7C15)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles of the whole text; of the whole sequence if it has fewer words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    ids = np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))
    k = min(k, len(ids))
    n = len(ids) - k + 1
    h = np.full(n, k, np.uint64)
    for i in range(k):
        h = _mixed(h * _MIX + ids[i : i + n])
    return np.unique(h)


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if not len(small) or 100 * len(small) < percent * len(large):
        return False
    at = np.minimum(np.searchsorted(large, small), len(large) - 1)
    common = int((large[at] == small).sum())
    return 100 * common >= percent * (len(a) + len(b) - common)


def _permutations(c: MinMaxConfig) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(c.seed)
    draw = lambda: rng.integers(0, 2**63, c.permutations, dtype=np.uint64)
    return draw() * np.uint64(2) + np.uint64(1), draw()


def signature(hashes: np.ndarray, c: MinMaxConfig, drawn: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, bytes]:
    """One key per band, and a byte per signature value.

    A band takes its values from different permutations; minima and maxima are grouped differently.
    """
    mul, xor = drawn
    low, high = np.full(c.permutations, 2**64 - 1, np.uint64), np.zeros(c.permutations, np.uint64)
    for at in range(0, len(hashes), 8192):
        block = (hashes[None, at : at + 8192] ^ xor[:, None]) * mul[:, None]
        low, high = np.minimum(low, block.min(axis=1)), np.maximum(high, block.max(axis=1))
    bands = c.permutations // c.rows
    values = np.concatenate([low[: bands * c.rows].reshape(bands, c.rows), high[: bands * c.rows].reshape(c.rows, bands).T])
    key = np.arange(1, len(values) + 1, dtype=np.uint64)
    for i in range(c.rows):
        key = _mixed(key * _MIX + values[:, i])
    return key.view(np.int64), _mixed(np.concatenate([low, high]) * _MIX).astype(np.uint8).tobytes()


def least_agreement(c: MinMaxConfig) -> float:
    """Signatures that agree in fewer values aren't those of a linked pair, give or take some deviations."""
    t = c.threshold_percent / 100
    return 2 * c.permutations * t - c.screen_deviations * float(np.sqrt(2 * c.permutations * t * (1 - t)))


def signatures(docs: DataFrame, c: MinMaxConfig, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n, digest, bands, sketch) of every row, from whole texts."""
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drawn = _permutations(c)
        _own_cache()
        for batch in batches:
            n, digest, flat, sketch = [], [], [], []
            offsets = [0]
            for text in batch.column(1).to_pylist():
                s = shingle_set(text, c.shingle_words)
                n.append(len(s))
                digest.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                keys, sketched = signature(s, c, drawn) if len(s) else (None, None)
                sketch.append(sketched)
                if len(s):
                    flat.append(keys)
                offsets.append(offsets[-1] + (len(flat[-1]) if len(s) else 0))
            keys = np.concatenate(flat) if flat else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(keys, pa.int64())), pa.array(sketch, pa.binary())],
                names=["id", "n", "digest", "bands", "sketch"],
            )

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(sign, "id long, n long, digest binary, bands array<long>, sketch binary")


def shingle_sets(docs: DataFrame, c: MinMaxConfig) -> DataFrame:
    """(id, set) of (id, text): the sorted hashes as bytes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _own_cache()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sets = [shingle_set(t, c.shingle_words).tobytes() for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.binary())], names=["id", "set"])

    return docs.mapInArrow(run, "id long, set binary")


def _set(data: pa.Scalar) -> np.ndarray:
    return np.frombuffer(data.as_buffer(), np.uint64)


def _members(nodes: DataFrame) -> DataFrame:
    """(key, id): the nodes of every bucket with more than one; of buckets with the same nodes only one is listed."""
    banded = nodes.select(F.explode("bands").alias("key"), "id")
    marks = [F.bit_xor(F.xxhash64("id", F.lit(i))).alias(f"mark{i}") for i in range(2)]
    shared = banded.groupBy("key").agg(F.count("*").alias("m"), *marks).where("m > 1")
    single = shared.groupBy("m", "mark0", "mark1").agg(F.min("key").alias("key")).select("key", "m")
    return banded.join(single, "key")


def _hub_pairs(members: DataFrame) -> DataFrame:
    """One pair (a, b) per node: the node and the hub of its buckets that shares most buckets with others, ties to the smaller id."""
    degrees = members.groupBy("id").agg(F.sum("m").alias("degree"))
    hubs = members.join(degrees, "id").groupBy("key").agg(F.max(F.struct("degree", (-F.col("id")).alias("minus"))).alias("hub"))
    best = members.join(hubs, "key").groupBy("id").agg((-F.max("hub")["minus"]).alias("hub"))
    return best.where("id <> hub").select(F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b")).distinct()


def _hub_links(pairs: DataFrame, about: DataFrame, c: MinMaxConfig) -> DataFrame:
    """The pairs (a, b) that are linked on their full sets. A hub's rows meet in a join that AQE can split."""
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column(2), batch.column(3)
            keep = pa.array([linked(_set(a[i]), _set(b[i]), c.threshold_percent) for i in range(batch.num_rows)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])

    side = lambda x: about.select(F.col("id").alias(x), F.col("n").alias(f"n_{x}"), F.col("set").alias(f"set_{x}"))
    sides = pairs.join(side("a"), "a").join(side("b"), "b").where(100 * F.least("n_a", "n_b") >= c.threshold_percent * F.greatest("n_a", "n_b"))
    return sides.select("a", "b", "set_a", "set_b").mapInArrow(verify, "a long, b long").distinct()


def _find(parent: dict[int, int], x: int) -> int:
    while parent.setdefault(x, x) != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


BOTH, LEFT, RIGHT = range(3)


def block_candidates(key: int, block: pa.Table, c: MinMaxConfig) -> Iterator[tuple[int, list[int]]]:
    """(row, rows) of a block of a bucket: for rows outside the bucket's largest component the rows of others that may be linked, most alike first.

    Of (id, comp, n, sketch, keys, outside, role): rows of role LEFT are only compared, those of role RIGHT only compared with.
    """
    ids, comps, sizes, role = (block.column(x).to_numpy() for x in ("id", "comp", "n", "role"))
    outside = block.column("outside").to_numpy(zero_copy_only=False)
    sketches = np.frombuffer(b"".join(block.column("sketch").to_pylist()), np.uint8).reshape(len(ids), -1)
    buckets = block.column("keys").to_pylist()
    least, rights = least_agreement(c), np.flatnonzero(role != LEFT)
    for i in np.flatnonzero(outside & (role != RIGHT)).tolist():
        smaller, larger = np.minimum(sizes[rights], sizes[i]), np.maximum(sizes[rights], sizes[i])
        once = ~outside[rights] | (ids[rights] > ids[i])
        at = rights[(comps[rights] != comps[i]) & once & (100 * smaller >= c.threshold_percent * larger)]
        agreed = (sketches[at] == sketches[i]).sum(axis=1)
        order = np.lexsort((ids[at], -agreed))[: int((agreed >= least).sum())]
        mine = set(buckets[i])
        found = [j for j in at[order].tolist() if min(mine.intersection(buckets[j])) == key]
        if found:
            yield i, found


def block_links(key: int, block: pa.Table, c: MinMaxConfig) -> list[tuple[int, int]]:
    """Links between components of a block, at most as many as join those of its candidates that are linked on their sets."""
    ids, comps, sets = block.column("id").to_pylist(), block.column("comp").to_pylist(), block.column("set")
    parent: dict[int, int] = {}
    links = []
    for i, others in block_candidates(key, block, c):
        own = _set(sets[i])
        for j in others:
            x, y = _find(parent, comps[i]), _find(parent, comps[j])
            if x != y and linked(own, _set(sets[j]), c.threshold_percent):
                parent[max(x, y)] = min(x, y)
                links.append((ids[i], ids[j]))
    return links


def _blocks(batches: Iterator[pa.RecordBatch], columns: tuple[str, ...] = ("key", "left", "right")) -> Iterator[pa.Table]:
    """The stretches of rows with the same values in some columns, of sorted batches."""
    place, held = None, []  # the block whose end hasn't been seen yet
    for batch in batches:
        if not batch.num_rows:
            continue
        where = np.stack([batch.column(x).to_numpy() for x in columns])
        starts = np.flatnonzero(np.concatenate([[True], (where[:, 1:] != where[:, :-1]).any(axis=0)])).tolist()
        for at, end in zip(starts, [*starts[1:], batch.num_rows]):
            if (own := tuple(where[:, at].tolist())) != place:
                if held:
                    yield pa.Table.from_batches(held)
                place, held = own, []
            held.append(batch.slice(at, end - at))
    if held:
        yield pa.Table.from_batches(held)


def _open_links(members: DataFrame, comps: DataFrame, about: DataFrame, c: MinMaxConfig) -> DataFrame:
    """Links (a, b) in the buckets whose nodes lie in different components.

    Blocks are dealt by hash and their number follows the shingles in the bucket, so a task holds two blocks and the longest
    set at a time, whatever the size of the bucket. A bucket of one block lists each of its nodes once.
    """
    known = members.join(comps, "id", "left").select("key", "id", F.coalesce("comp", "id").alias("comp"))
    sized = known.join(about.select("id", "n"), "id")
    parts = sized.groupBy("key", "comp").agg(F.count("*").alias("size"), F.sum("n").alias("n"))
    largest = F.max(F.struct("size", (-F.col("comp")).alias("minus"), "n")).alias("main")
    cut = parts.groupBy("key").agg(F.count("*").alias("comps"), F.sum("n").alias("n"), largest).where("comps > 1")
    blocks = lambda n: F.greatest(F.ceil(n / c.block_shingles), F.lit(1)).cast("int")
    cut = cut.select("key", (-F.col("main")["minus"]).alias("main"), blocks(F.col("n")).alias("rights"), blocks(F.col("n") - F.col("main")["n"]).alias("lefts"))
    rows = known.join(cut, "key").withColumn("outside", F.col("comp") != F.col("main"))
    deal = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    several = rows.where("rights > 1")
    alone = rows.where("rights = 1").select("key", "id", "comp", "outside", F.lit(0).alias("left"), F.lit(0).alias("right"), F.lit(BOTH).alias("role"))
    outer = several.where("outside").select("key", "id", "comp", "outside", deal("lefts").alias("left"), every("rights").alias("right"), F.lit(LEFT).alias("role"))
    inner = several.select("key", "id", "comp", "outside", every("lefts").alias("left"), deal("rights").alias("right"), F.lit(RIGHT).alias("role"))
    place = ["key", "left", "right"]
    dealt = alone.unionByName(outer).unionByName(inner).join(about.drop("set"), "id").repartition(*place).sortWithinPartitions(*place)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches):
            needed = np.zeros(block.num_rows, bool)
            for i, others in block_candidates(block.column("key")[0].as_py(), block, c):
                needed[i] = True
                needed[others] = True
            yield from block.filter(pa.array(needed)).combine_chunks().to_batches()

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches):
            links = block_links(block.column("key")[0].as_py(), block, c)
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in range(2)], names=["a", "b"])

    slim = dealt.select(*place, "role", "id", "comp", "n", "sketch", "keys", "outside")
    needed = materialize(slim.mapInArrow(mark, slim.schema), "minmax-open")
    full = needed.join(about.select("id", "set"), "id").repartition(*place).sortWithinPartitions(*place)
    found = materialize(full.mapInArrow(compare, "a long, b long").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "minmax-links")
    drop_scratch(needed)
    return found


def near_duplicates(docs: DataFrame, config: MinMaxConfig = MinMaxConfig(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of docs.

    component_id is the smallest id reachable over links (itself included), kept says whether it is the
    row's own. Null, empty and wordless texts have n_shingles 0 and are linked with nothing. Rows with a
    null id can't be named by a component: they are linked with nothing, component_id null, kept true.
    Rows that share an id are one document; a link of one of them is a link of all. An empty table gives
    an empty result. Other columns of docs are not looked at. The result lies in the shared folder.
    """
    c = config
    signed = materialize(signatures(docs, c, id_col, text_col), "minmax-signed")
    named = signed.where("n > 0 and id is not null")
    nodes = materialize(named.groupBy("digest").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.first("bands").alias("bands")), "minmax-nodes")
    members = materialize(_members(nodes), "minmax-members")
    buckets = members.groupBy("id").agg(F.collect_list("key").alias("keys"))  # at most one a band
    sets = shingle_sets(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).join(buckets.select("id").hint("merge"), "id", "left_semi"), c)  # one plan at all sizes: texts are dealt by id
    about = materialize(nodes.select("id", "n", "sketch").join(buckets, "id").join(sets, "id"), "minmax-about")
    links = materialize(_hub_links(_hub_pairs(members), about, c), "minmax-links")
    first = connected_components(links)
    more = _open_links(members, first, about, c)
    comps = first if more.isEmpty() else connected_components(links.union(more))

    of_set = nodes.select("digest", "id").join(comps, "id", "left").select("digest", F.coalesce("comp", "id").alias("comp"))
    by_set = signed.select("id", "n", "digest").join(of_set, "digest", "left")
    shared = by_set.where("id is not null").groupBy("id").agg(F.min("comp").alias("least"), F.max("comp").alias("most"))
    torn, joined = materialize(shared.where("least < most").select(F.col("least").alias("a"), F.col("most").alias("b")), "minmax-torn"), None
    if not torn.isEmpty():  # ids whose rows have different sets tie their components together
        joined = connected_components(torn)
        by_set = by_set.join(joined.select(F.col("id").alias("comp"), F.col("comp").alias("root")), "comp", "left").withColumn("comp", F.coalesce("root", "comp"))
    component = F.when(F.col("id").isNotNull(), F.coalesce("comp", "id"))
    result = by_set.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"))
    out = materialize(result, "minmax-result")
    for used in {id(x): x for x in (signed, nodes, members, about, links, first, more, comps, torn, joined) if x is not None}.values():
        drop_scratch(used)
    return out


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), MinMaxConfig(shingle_words=4))


def keep_representatives(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each group of near duplicates (five words, 0.8) the document with the smallest id stays.

    Null, empty and wordless texts are linked with nothing and stay, as do rows without an id; all rows of an id that stays do. Very
    long texts are compared whole.
    """
    found = near_duplicates(docs)
    lost = found.where(~F.col("kept")).select("doc_id").distinct()
    return docs.join(lost, "doc_id", "left_anti").select(docs.columns)
