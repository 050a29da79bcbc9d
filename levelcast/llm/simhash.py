"""SimHash near-duplicates: fingerprints, pigeonhole blocks, Hamming verification, components.

A fingerprint of 64 bits is cut into six blocks. Two fingerprints that differ in at most
three bits agree on at least three of the six, so they meet under one of the twenty keys
that three blocks make. Keys of some 32 bits keep chance meetings rare at any corpus size.

Equal fingerprints are one node. Under a key, all the nodes are compared (with popcounts of
XORs over the nodes not yet reached) and a star of links is kept for each linked set, never
all its pairs. A key with more than ``GROUP_LIMIT`` nodes goes on to a second level, where the
bits outside the key are cut into blocks again by the same argument; there at most 2**18
different fingerprints can share a key, and these are compared in the same way.

Sixty-four bits and a distance of three find texts that hardly differ. ``one_of_each`` asks for a
similarity of the sets of shingles instead, say 0.8, at which fingerprints differ in some 15 % of
their bits. There fingerprints have 1,024 bits and blocks are short: the bits are permuted and cut into
blocks, as often as it takes. A pair that differs in fewer bits than one permutation has blocks agrees
on one for certain, as above; so many blocks are taken that a pair at the bound itself misses them all with
a probability of ``MISS``. All the nodes under a block are compared, first by two words of the
fingerprint that no block uses, and what is close there by the whole fingerprint.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from .graph import connected_components

BITS = 64
SEED = 42
#: Nodes of one key that one task compares; keys with more are refined.
GROUP_LIMIT = 65_536
#: Words (of 64 bits) of a wide fingerprint; its first words that are compared under a block and are in none.
WIDE, FIRST = 16, 2
#: Standard deviations by which a wide distance may exceed what the similarity lets expect; and the first words' distance.
SLACK, FIRST_SLACK = 1.0, 3.0
#: Probability that two fingerprints at the bound agree on none of the blocks; bits of a block at least, and nodes that may agree on one by chance before it gets longer.
MISS, SHORTEST, CHANCE = 0.002, 12, 2048
#: Nodes of one block's key that are compared in a task; larger groups are dealt and compared part by part.
MEMBERS = 4096
#: Bitmaps (of 4 KB) of the rows that stay up to which they are broadcast.
BITMAPS = 8192
#: Hashes of n-grams that are scrambled at a time, and the odd numbers that scramble them.
PIECE = 255 * 8
SALTS = np.random.default_rng(SEED).integers(0, 1 << 63, WIDE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
UPPER_TO_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def fingerprint(text: str | None, n: int = 3) -> int:
    """SimHash of a text's word n-grams, repeats included; 0 for a text without words.

    A-Z are lower-cased; words are separated by the ASCII white space characters; with fewer than ``n``
    words the whole sequence is the one shingle; a bit is set if it is set in over half of
    the shingles' XXH64 values (seed 42).
    """
    words = (text or "").encode("utf-8", "surrogatepass").translate(UPPER_TO_LOWER).split()
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= n:
        return xxhash.xxh64_intdigest(line, SEED)
    size = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(size + 1) - 1
    starts = ends - size
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(line[a:b], SEED) for a, b in zip(starts[: len(words) - n + 1].tolist(), ends[n - 1 :].tolist(), strict=True)], dtype="<u8")
    ones = np.zeros(BITS, np.int64)
    for part in np.array_split(hashes, len(hashes) // 50_000 + 1):
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, n: int = 3, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, fp (the fingerprint's bits as a signed long) and the columns ``keep``, for every row."""
    common.missing_columns(docs, "doc_id", "text")
    kinds = "".join(f", `{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = batch.column(1).to_pylist()
            fps = np.fromiter((fingerprint(t, n) for t in texts), np.uint64, len(texts)).view(np.int64)
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps), *batch.columns[2:]], names=["doc_id", "fp", *keep])

        return each

    return common.map_arrow(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), *keep), make, f"doc_id long, fp long{kinds}")


def _blocks(bits: list[int], blocks: int) -> list[int]:
    """``bits`` (their numbers) dealt to masks of nearly equal size."""
    masks = [0] * blocks
    for i, b in enumerate(bits):
        masks[i * blocks // len(bits)] |= 1 << b
    return masks


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def key_masks(distance: int = 3, blocks: int = 6) -> list[int]:
    """Masks of the bits that make each key: all choices of ``blocks - distance`` blocks."""
    parts = _blocks(list(range(BITS)), blocks)
    return [sum(c) for c in combinations(parts, blocks - distance)]


def refined_masks(mask: int, distance: int = 3, blocks: int = 6) -> list[int]:
    """The second level's masks for a first-level mask: it, and blocks of the other bits."""
    parts = _blocks([b for b in range(BITS) if not mask >> b & 1], blocks)
    return [mask | sum(c) for c in combinations(parts, blocks - distance)]


def _stars(fps: np.ndarray, distance: int) -> Iterator[tuple[int, np.ndarray]]:
    """The linked sets of two or more among different fingerprints: (one of them, the others)."""
    left = fps.view(np.uint64)
    while len(left) > 1:
        root, left = left[0], left[1:]
        found, edge = [], [root]
        while edge and len(left):
            near = np.bitwise_count(left ^ edge.pop()) <= distance
            if near.any():
                new = left[near]
                found.append(new)
                edge.extend(new)
                left = left[~near]
        if found:
            yield int(np.array([root], np.uint64).view(np.int64)[0]), np.concatenate(found).view(np.int64)


def _linked(keyed: DataFrame, distance: int, limit: int) -> DataFrame:
    """Rows (key_no, key, fp), grouped by key and streamed: links (a, b) and, where a key has
    more than ``limit`` nodes, the nodes again as rows with key_no >= 0 to be refined."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        now: tuple[int, int] | None = None
        over = False

        def links(fps: np.ndarray) -> Iterator[pa.RecordBatch]:
            for root, others in _stars(fps, distance):
                yield out(-1, root, others)

        def out(no: int, a, fps: np.ndarray) -> pa.RecordBatch:
            n = len(fps)
            return pa.RecordBatch.from_arrays([pa.array(np.full(n, no, np.int32)), pa.array(np.full(n, a, np.int64)), pa.array(fps)], names=["key_no", "a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            no, keys, fps = (batch.column(k).to_numpy() for k in range(3))
            cut = np.flatnonzero((no[1:] != no[:-1]) | (keys[1:] != keys[:-1])) + 1
            heads = np.concatenate([[0], cut])
            ends = np.append(cut, len(no))
            alone = ends - heads == 1
            roots, others = [], []
            for i in np.flatnonzero(~alone | (np.arange(len(heads)) == 0) | (np.arange(len(heads)) == len(heads) - 1)).tolist():
                own, part = (int(no[heads[i]]), int(keys[heads[i]])), fps[heads[i] : ends[i]]
                if own != now:
                    if held and not over:
                        yield from links(np.concatenate(held))
                    held, now, over = [], own, False
                if i < len(heads) - 1 and not held and not over and len(part) <= limit:
                    for root, rest in _stars(part, distance):
                        roots.append(np.full(len(rest), root, np.int64))
                        others.append(rest)
                    continue
                held.append(part)
                if over or sum(map(len, held)) > limit:
                    over = True
                    yield out(own[0], 0, np.concatenate(held))
                    held = []
            if roots:
                a, b = np.concatenate(roots), np.concatenate(others)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(a), -1, np.int32)), pa.array(a), pa.array(b)], names=["key_no", "a", "b"])
        if held and not over:
            yield from links(np.concatenate(held))

    common.bounded(keyed.sparkSession)
    grouped = keyed.repartition("key_no", "key").sortWithinPartitions("key_no", "key", "fp")
    return grouped.mapInArrow(run, "key_no int, a long, b long")


def _keyed(fps: DataFrame, masks: list[tuple[int, int]], number: Column | None = None) -> DataFrame:
    """Each node under each of the masks (number, mask)."""
    keys = [F.struct(F.lit(no).cast("int").alias("key_no"), F.col("fp").bitwiseAND(F.lit(_signed(m)).cast("long")).alias("key")) for no, m in masks]
    return fps.select("fp", F.explode(F.array(*keys)).alias("k")).select("k.key_no", "k.key", "fp")


def fingerprint_links(nodes: DataFrame, distance: int = 3, limit: int = GROUP_LIMIT) -> DataFrame:
    """Links (a, b) that connect what is connected by pairs within ``distance``; nodes: distinct ``fp``."""
    masks = key_masks(distance)
    first = common.staged(_linked(_keyed(nodes, list(enumerate(masks))), distance, limit), "simhash-links")
    links = first.filter("key_no < 0").select("a", "b")
    crowded = [r["key_no"] for r in first.filter("key_no >= 0").select("key_no").distinct().collect()]
    if crowded:
        again = None
        for no in crowded:
            fine = refined_masks(masks[no], distance)
            part = _keyed(first.filter(F.col("key_no") == no).select(F.col("b").alias("fp")), [(no * len(masks) + i, m) for i, m in enumerate(fine)])
            again = part if again is None else again.unionByName(part)
        second = common.staged(_linked(again, distance, 2**18), "simhash-links-refined")
        links = links.unionByName(second.filter("key_no < 0").select("a", "b"))
    return links


def _components(prints: DataFrame, distance: int, limit: int) -> DataFrame:
    """(fp, first): per fingerprint, the least (id is null, id, row) of its component."""
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row"))
    nodes = common.staged(prints.groupBy("fp").agg(least.alias("first")), "simhash-nodes")
    labels = connected_components(fingerprint_links(nodes.select("fp"), distance, limit))
    named = nodes.join(labels.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    first = named.groupBy("component").agg(F.min("first").alias("first"))
    return named.select("fp", "component").join(first, "component").select("fp", "first")


def near_duplicates(docs: DataFrame, n: int = 3, distance: int = 3, limit: int = GROUP_LIMIT) -> DataFrame:
    """doc_id, fp and component_id (the smallest doc_id reachable), for every row.

    Null and empty texts have fingerprint 0 and are linked like any other. Rows whose doc_id
    is null keep their fingerprint; a component's id is null only if all its ids are.
    Repeated rows each give a row. An empty table gives no rows.
    """
    prints = common.staged(fingerprints(docs, n).withColumn("row", F.monotonically_increasing_id()), "simhash-fp")
    found = common.settled(lambda: _components(prints, distance, limit), "simhash-components")
    return prints.join(found, "fp").select("doc_id", "fp", F.col("first.doc_id").alias("component_id"))


def sketch(text: str | None, n: int) -> tuple[bytes, bytes]:
    """Of the set of a text's word n-grams: a digest and the wide fingerprint.

    Words as for ``fingerprint``; with fewer than ``n`` words the whole sequence is the one n-gram.
    """
    words = (text or "").encode("utf-8", "surrogatepass").translate(UPPER_TO_LOWER).split()
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    own = np.fromiter((xxhash.xxh64_intdigest(w, SEED) for w in number), np.uint64, len(number))
    at, mix = own[ids], np.uint64(0x9E3779B97F4A7C15)
    size = min(n, len(words))
    h = np.zeros(max(0, len(words) - size + 1) if words else 0, np.uint64)
    for k in range(size):
        h = (h ^ (h >> np.uint64(29))) * mix + at[k : k + len(h)]
    h = np.unique(h)
    digest = xxhash.xxh3_128_digest(h.tobytes())
    if not len(h):
        return digest, bytes(8 * WIDE)
    ones = np.zeros((WIDE, BITS), np.int64)
    scrambled = h ^ (h >> np.uint64(31))
    for at in range(0, len(h), PIECE):
        g = scrambled[at : at + PIECE, None] * SALTS
        g = (g ^ (g >> np.uint64(32))) * mix
        ones += set_bits(g)
    return digest, np.packbits(ones * 2 > len(h), axis=1, bitorder="little").tobytes()


def set_bits(g: np.ndarray) -> np.ndarray:
    """How often each bit is set, by column of a matrix of 64-bit numbers: (columns, 64).

    Eight bits at a time, one of each byte, are counted in the bytes of a number, for 255 rows.
    """
    few = np.zeros((-(-len(g) // 255) * 255, g.shape[1]), np.uint64)
    few[: len(g)] = g
    few = few.reshape(-1, 255, g.shape[1])
    every = np.uint64(0x0101010101010101)
    counts = [((few >> np.uint64(b)) & every).sum(axis=1).astype("<u8").view(np.uint8).reshape(len(few), g.shape[1], 8).sum(axis=0, dtype=np.int64) for b in range(8)]
    return np.stack(counts, axis=2).reshape(g.shape[1], BITS)


def differing(similarity: float) -> float:
    """Share of bits in which fingerprints of sets of this Jaccard similarity differ: the cosine is at least 2 s / (1 + s), and a bit differs with the angle over pi."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def furthest(similarity: float, bits: int = WIDE * BITS, slack: float | None = None) -> int:
    """Bits in which fingerprints of sets of at least this Jaccard similarity differ, but for ``SLACK``."""
    p = differing(similarity)
    return math.floor(bits * p + (SLACK if slack is None else slack) * math.sqrt(bits * p * (1 - p)))


def cut_blocks(nodes: int, similarity: float) -> np.ndarray:
    """(blocks, bits): the numbers of the bits of each block, without those of the first words.

    Blocks are so long that at most ``CHANCE`` nodes or so agree on one by chance, and so many that a pair at the bound misses all with probability ``MISS``.
    The bits are cut in a fixed random order, then in another one.
    """
    long = max(SHORTEST, math.ceil(math.log2(max(1, nodes) / CHANCE)))
    many = math.ceil(-math.log(MISS) / (1 - differing(similarity)) ** long)
    rest, pick = np.arange(FIRST * BITS, WIDE * BITS), np.random.default_rng(SEED)
    each = len(rest) // long
    cut = [pick.permutation(rest)[: each * long].reshape(each, long) for _ in range(-(-many // each))]
    return np.concatenate(cut)[:many]


def _near_sets(fps: np.ndarray, most: int) -> Iterator[tuple[int, np.ndarray]]:
    """The linked sets of two or more among wide fingerprints (rows): (number of one, numbers of the others)."""
    left = np.arange(len(fps))
    while len(left) > 1:
        root, left = left[0], left[1:]
        found, edge = [], [root]
        while edge and len(left):
            near = np.bitwise_count(fps[left] ^ fps[edge.pop()]).sum(axis=1) <= most
            if near.any():
                new = left[near]
                found.append(new)
                edge.extend(new)
                left = left[~near]
        if found:
            yield int(root), np.concatenate(found)


def _close_sets(first: np.ndarray, most: int) -> Iterator[tuple[int, np.ndarray]]:
    """As ``_near_sets`` for groups in which few are near another: only those are told apart."""
    hit = np.zeros(len(first), bool)
    for at in range(0, len(first) - 1, 128):
        d = sum(np.bitwise_count(first[at : at + 128, k, None] ^ first[None, at:, k]) for k in range(first.shape[1]))
        near = d <= most
        np.fill_diagonal(near, False)
        hit[at : at + 128] |= near.any(axis=1)
        hit[at:] |= near.any(axis=0)
    own = np.flatnonzero(hit)
    for root, others in _near_sets(first[own], most):
        yield int(own[root]), own[others]


def _blocked(nodes: DataFrame, blocks: np.ndarray) -> DataFrame:
    """Each node under each of the blocks: key (the block's number and its bits), node and the first words."""
    powers = np.int64(1) << np.arange(blocks.shape[1], dtype=np.int64)
    numbers = np.arange(len(blocks), dtype=np.int64) << 40
    words = [f"w{k}" for k in range(FIRST)]

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            n = batch.num_rows
            wide = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(n, -1)
            bits = np.unpackbits(wide, axis=1, bitorder="little")
            keys = np.stack([bits[:, b] @ powers + no for b, no in zip(blocks, numbers, strict=True)])
            first = wide[:, : 8 * FIRST].copy().view(np.int64)
            columns = [np.tile(c, len(blocks)) for c in (batch.column(0).to_numpy(), *first.T)]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in (keys.ravel(), *columns)], names=["key", "node", *words])

        return each

    return common.map_arrow(nodes.select("node", "wide"), make, ", ".join(f"{c} long" for c in ("key", "node", *words)))


def _close(rows: DataFrame, by: list[str], most: int) -> DataFrame:
    """Sets of nodes of one group that are linked by their first words: (members' digest, root, node), equal sets of several groups once."""
    words = [f"w{k}" for k in range(FIRST)]

    def each(group):
        node, first = group["node"], np.stack([group[w] for w in words], axis=1).view(np.uint64)
        for root, others in _close_sets(first, most):
            own = np.sort(node[np.append(others, root)])
            digest = np.array([xxhash.xxh64_intdigest(own.tobytes(), SEED)], np.uint64).view(np.int64)[0]
            yield np.full(len(own), digest), np.full(len(own), own[0]), own

    dealt = rows.repartition(*by).sortWithinPartitions(*by, "node")
    return common.grouped(dealt, by, each, ["digest", "root", "node"], "digest long, root long, node long")


def similar_links(nodes: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b) that connect what is connected by pairs which share a block and whose fingerprints are near enough for the similarity.

    nodes: node, wide. A key's nodes beyond ``MEMBERS`` are dealt to parts of about that many, and each pair
    of parts is compared in a task of its own, so no task holds a large group.
    """
    rows = _blocked(nodes, cut_blocks(nodes.count(), similarity))
    most = furthest(similarity, FIRST * BITS, FIRST_SLACK)
    large = common.staged(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > MEMBERS), "simhash-large")
    count = large.count()
    if count:
        parts = common.sized(large.select("key", F.ceil(F.col("n") / MEMBERS).cast("int").alias("parts")), count)
        dealt = rows.join(parts, "key").withColumn("own", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        dealt = dealt.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")}).drop("own", "other", "parts")
        close = _close(rows.join(common.sized(large.select("key"), count), "key", "left_anti"), ["key"], most).unionByName(_close(dealt, ["key", "i", "j"], most))
    else:
        close = _close(rows, ["key"], most)
    close = common.staged(close.distinct(), "simhash-close")
    whole = close.join(nodes.select("node", "wide"), "node").repartition("digest", "root").sortWithinPartitions("digest", "root", "node")
    far = furthest(similarity)

    def each(group):
        node, fps = group["node"], np.frombuffer(b"".join(group["wide"]), np.uint64).reshape(-1, WIDE)
        for root, others in _near_sets(fps, far):
            yield np.full(len(others), node[root]), node[others]

    return common.grouped(whole.select("digest", "root", "node", "wide"), ["digest", "root"], each, ["a", "b"], "a long, b long")


def _of_rows(table: DataFrame, kept: Callable[[], DataFrame]) -> DataFrame:
    """The rows of a staged table whose ``row`` is one of those that ``kept`` gives, as bitmaps of 2**15 numbers, which are broadcast while they are few: only numbers are shuffled."""
    bits = lambda: kept().groupBy(F.shiftright("row", 15).alias("chunk")).agg(F.bitmap_construct_agg(F.col("row").bitwiseAND(32767)).alias("bits"))
    maps = common.settled(bits, "simhash-kept")
    at = F.col("row").bitwiseAND(32767)
    byte = F.conv(F.hex(F.substring("bits", (F.shiftright(at, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("long")
    few = maps.count() <= BITMAPS
    rows = table.withColumn("chunk", F.shiftright("row", 15)).join(F.broadcast(maps) if few else maps.hint("merge"), "chunk")
    return rows.filter(F.getbit(byte, at.bitwiseAND(7).cast("int")) == 1).drop("chunk", "bits")


def one_of_each(docs: DataFrame, n: int = 5, similarity: float = 0.8) -> DataFrame:
    """``docs`` with one row of each group of texts whose sets of word n-grams are similar: that of the smallest doc_id, null last.

    Null and empty texts, and those without a word, are alike and one of them stays. Of rows of one id
    the one whose text has the smallest digest stays, of repeated rows any one. Groups are connected
    by links, so two texts of a group may be less similar. Similarity is told from wide fingerprints: within
    some 0.05 of the bound, and in sets of under about 20 n-grams, it may fall on either side. Extra columns pass through; an empty
    table gives no rows.
    """
    common.missing_columns(docs, "doc_id", "text")
    whole = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.struct(*docs.columns).alias("whole"))

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [sketch(t, n) for t in batch.column(1).to_pylist()]
            exact = [xxhash.xxh3_128_digest((t or "").encode("utf-8", "surrogatepass")) for t in batch.column(1).to_pylist()]
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(exact, pa.binary()), *[pa.array(c, pa.binary()) for c in zip(*found, strict=True)], batch.column(2)], names=["doc_id", "exact", "digest", "wide", "whole"])

        return each

    kinds = T.StructType([*T.StructType.fromDDL("doc_id long, exact binary, digest binary, wide binary").fields, whole.schema["whole"]])
    prints = common.staged(common.map_arrow(whole, make, kinds).withColumn("row", F.monotonically_increasing_id()), "simhash-rows")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "exact", "row"))

    def kept() -> DataFrame:
        nodes = prints.groupBy("digest").agg(F.first("wide").alias("wide"), least.alias("first"))
        nodes = common.staged(nodes.withColumn("node", F.monotonically_increasing_id()), "simhash-sets")
        labels = connected_components(similar_links(nodes, similarity))
        named = nodes.select("node", "first").join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
        return named.groupBy("component").agg(F.min("first").alias("first")).select(F.col("first.row").alias("row"))

    return _of_rows(prints, kept).select("whole.*")


def hex_digits(fp: Column) -> Column:
    """A signed long as the 16 lowercase hexadecimal digits of its bits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
