"""Embedding near-duplicates by NN-descent.

Equal vectors are one node with a multiplicity. A neighbour graph (the ``LIST`` nearest found
so far of each node) starts from blocks of several orders of the nodes by random-hyperplane
signatures, and is refined as in NN-descent (Dong et al., 2011): the neighbours of a node, in
either direction, are compared with one another, and each keeps what is nearer than its
farthest. A node whose whole list is above the threshold is saturated; its list is doubled, up
to ``LIST_MOST``. Of all pairs above the threshold that a block or a neighbourhood compared, also
those that no list has room for, a spanning forest is kept; these edges make components. Counts
are exact: within each component all nodes are compared, in blocks. Finally a
bounded sample of nodes is compared with all nodes, larger until it shows enough links; links it
shows to be missing are added, and below the wanted recall the search goes on with other orders
and longer lists. A search that stays below ``LEAST_RECALL`` fails.

Cosines are computed in double precision.
"""

from __future__ import annotations

import logging
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from .graph import connected_components

#: Neighbours a list holds at first and at most.
LIST, LIST_MOST = 8, 32
#: Rows of a block of an order; consecutive blocks share half.
BLOCK = 256
#: Nodes of a component's block in the exact comparison.
MEMBERS = 1024
#: NN-descent rounds at most, and the share of list places changed under which they end.
ROUNDS, SETTLED = 4, 0.01
#: Nodes of the audit at first and at most; links under which it is doubled.
AUDIT, AUDIT_MOST, AUDIT_LINKS = 512, 8192, 512
#: Recall under which the search goes on, how often at most, and the recall under which it fails then.
RECALL, TRIES, LEAST_RECALL = 0.98, 5, 0.9
#: Chance that a pair at the threshold shares no block, for which the number of orders is chosen.
MISSED = 0.01


def unit(blobs: list[bytes], kind: str) -> np.ndarray:
    """Unit vectors (float64 rows) of equally long vectors given by their bytes."""
    x = np.frombuffer(b"".join(blobs), kind).reshape(len(blobs), -1).astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _forest(near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ends of a spanning forest of a symmetric boolean matrix: it joins whatever the matrix joins."""
    free = near.any(axis=1)
    a, b = [], []
    for root in np.flatnonzero(free).tolist():
        if not free[root]:
            continue
        free[root] = False
        front = [root]
        while front:
            i = front.pop()
            new = np.flatnonzero(near[i] & free).tolist()
            free[new] = False
            a += [i] * len(new)
            b += new
            front += new
    return np.array(a, np.int64), np.array(b, np.int64)


def _valid(column: str) -> Column:
    """Whether a vector can link: it has components, all are finite numbers, and not all are zero."""
    wide = F.col(column).cast("array<double>")
    finite = F.forall(wide, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce((F.size(wide) > 0) & finite & F.exists(wide, lambda x: x != 0), F.lit(False))


def _nodes(rows: DataFrame, column: str) -> tuple[DataFrame, DataFrame, str]:
    """Valid vectors: (vec_id, blob) of the rows, (node, first_id, mult, dim, blob) of the different ones, and numpy's type."""
    element = rows.schema[column].dataType.elementType
    kind = "<f4" if isinstance(element, T.FloatType) else "<f8"
    valid = rows.filter(_valid(column)).select("vec_id", F.col(column).cast("array<float>" if kind == "<f4" else "array<double>").alias("v"))

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            v = batch.column(1)
            flat, ends = v.flatten().to_numpy(), np.cumsum([0, *v.value_lengths().to_pylist()])
            flat = (flat + 0.0).astype(kind)  # -0.0 and 0.0 are one
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array([flat[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.binary())], names=["vec_id", "blob"])

        return each

    members = common.staged(common.map_arrow(valid, make, "vec_id long, blob binary"), "nn-members")
    nodes = members.groupBy("blob").agg(F.min("vec_id").alias("first_id"), F.count(F.lit(1)).alias("mult"))
    nodes = nodes.select(F.monotonically_increasing_id().alias("node"), "first_id", "mult", (F.length("blob") / int(kind[2])).cast("int").alias("dim"), "blob")
    return members, common.staged(nodes, "nn-nodes"), kind


def orders(n: int, threshold: float) -> int:
    """Orders needed so that a pair at the threshold shares a block but for a chance of MISSED."""
    agree = 1 - math.acos(min(1.0, threshold)) / math.pi
    p = agree ** max(1.0, math.log2(max(n, 2) / (BLOCK / 2)))
    return max(2, math.ceil(math.log(MISSED) / math.log(1 - p))) if p < 1 else 2


def _started(nodes: DataFrame, kind: str, threshold: float, count: int, first: int, keep: int, at_random: bool = False) -> DataFrame:
    """(node, nbr, sim, link): the nearest within the blocks of ``count`` orders, those from number ``first`` on; marked ``link``, a forest of each block's pairs at or above the threshold.

    ``at_random``: random orders instead of signatures, which leaves all finding to the descent.
    """

    def make():
        planes: dict[tuple[int, int], np.ndarray] = {}

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            node, dim, blob = batch.columns
            dims, blobs = dim.to_numpy(), blob.to_pylist()
            table = np.repeat(np.arange(first, first + count), len(dims))
            sig = np.empty(len(table), np.int64)
            for d in np.unique(dims).tolist():
                at = np.flatnonzero(dims == d)
                x = unit([blobs[i] for i in at], kind)
                for t in range(count):
                    if at_random:
                        sig[t * len(dims) + at] = [zlib.crc32(f"{first + t}:{i}".encode()) for i in node.take(pa.array(at)).to_pylist()]
                        continue
                    p = planes.setdefault((first + t, d), np.random.default_rng([first + t, d]).normal(size=(d, 64)))
                    sig[t * len(dims) + at] = np.packbits(x @ p > 0, axis=1, bitorder="big").view(">i8").ravel().astype(np.int64)
            every = pa.array(np.tile(np.arange(len(dims)), count))
            return pa.RecordBatch.from_arrays([pa.array(table.astype(np.int32)), dim.take(every), pa.array(sig), node.take(every), blob.take(every)], names=["t", "dim", "sig", "node", "blob"])

        return each

    signed = common.map_arrow(nodes.select("node", "dim", "blob"), make, "t int, dim int, sig long, node long, blob binary")
    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = signed.repartitionByRange(parts, "t", "dim", "sig", "node").sortWithinPartitions("t", "dim", "sig", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, int, bytes]] = []

        def block(rows: list) -> pa.RecordBatch | None:
            by: dict[tuple[int, int], list[int]] = {}
            for i, r in enumerate(rows):
                by.setdefault(r[:2], []).append(i)
            a, b, s, link = [], [], [], []
            for at in by.values():
                if len(at) < 2:
                    continue
                x = unit([rows[i][3] for i in at], kind)
                node = np.array([rows[i][2] for i in at])
                sim = x @ x.T
                np.fill_diagonal(sim, -2)
                k = min(keep, len(at) - 1)
                best = np.argpartition(-sim, k - 1, axis=1)[:, :k]
                a.append(np.repeat(node, k))
                b.append(node[best].ravel())
                s.append(np.take_along_axis(sim, best, axis=1).ravel())
                link.append(np.zeros(best.size, bool))
                i, j = _forest(sim >= threshold)
                a.append(node[i])
                b.append(node[j])
                s.append(sim[i, j])
                link.append(np.ones(len(i), bool))
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in (a, b, s, link)], names=["node", "nbr", "sim", "link"]) if a else None

        for batch in batches:
            held += zip(*(batch.column(c).to_pylist() for c in ("t", "dim", "node", "blob")), strict=True)
            while len(held) >= BLOCK:
                if (found := block(held[:BLOCK])) is not None:
                    yield found
                held = held[BLOCK // 2 :]
        if held and (found := block(held)) is not None:
            yield found

    return ordered.select("t", "dim", "node", "blob").mapInArrow(run, "node long, nbr long, sim double, link boolean")


def _shortened(pairs: DataFrame, lengths: DataFrame | None, keep: int) -> DataFrame:
    """Lists (node, nbr, sim, k): the nearest of each node's pairs, as many as its own length ``k``."""
    pairs = pairs.groupBy("node", "nbr").agg(F.max("sim").alias("sim"))
    rank = F.row_number().over(Window.partitionBy("node").orderBy(F.desc("sim"), "nbr"))
    ranked = pairs.withColumn("rank", rank).filter(F.col("rank") <= LIST_MOST)
    ranked = ranked.withColumn("k", F.lit(keep)) if lengths is None else ranked.join(lengths, "node", "left").withColumn("k", F.coalesce("k", F.lit(keep)))
    return ranked.filter("rank <= k").select("node", "nbr", "sim", "k")


def _descended(lists: DataFrame, nodes: DataFrame, kind: str, threshold: float, keep: int) -> tuple[DataFrame, float, DataFrame]:
    """One round of NN-descent: the new lists, the share of places that changed, and (a, b), a forest of each neighbourhood's pairs at or above the threshold."""
    state = lists.groupBy("node").agg(F.min("sim").alias("least"), F.count(F.lit(1)).alias("held"), F.max("k").alias("k"))
    # a saturated list is doubled; one with free places takes whatever comes
    state = state.withColumn("k", F.when((F.col("held") >= F.col("k")) & (F.col("least") >= threshold), F.least(F.col("k") * 2, F.lit(LIST_MOST))).otherwise(F.col("k")))
    state = common.staged(state.select("node", F.when(F.col("held") < F.col("k"), F.lit(-2.0)).otherwise(F.col("least")).alias("least"), "k"), "nn-state")
    both = lists.select(F.col("node").alias("v"), F.col("nbr").alias("u"), "sim").unionByName(lists.select(F.col("nbr").alias("v"), F.col("node").alias("u"), "sim")).groupBy("v", "u").agg(F.max("sim").alias("sim"))
    near = both.withColumn("rank", F.row_number().over(Window.partitionBy("v").orderBy(F.desc("sim"), "u"))).filter(F.col("rank") <= 2 * keep).select("v", "u")
    told = nodes.select("node", "blob").join(state, "node", "left").select(F.col("node").alias("u"), F.coalesce("least", F.lit(-2.0)).alias("least"), "blob")
    met = near.join(told, "u").repartition("v").sortWithinPartitions("v", "u")

    def each(group):
        u, least = group["u"], group["least"]
        if len(u) < 2:
            return
        x = unit(group["blob"], kind)
        sim = x @ x.T
        better = sim > least[:, None]
        np.fill_diagonal(better, False)
        i, j = np.nonzero(better)
        near = sim >= threshold
        np.fill_diagonal(near, False)
        p, q = _forest(near)
        if len(i) + len(p):
            yield np.concatenate([u[i], u[p]]), np.concatenate([u[j], u[q]]), np.concatenate([sim[i, j], sim[p, q]]), np.arange(len(i) + len(p)) >= len(i)

    found = common.grouped(met.select("v", "u", "least", "blob"), ["v"], each, ["node", "nbr", "sim", "link"], "node long, nbr long, sim double, link boolean")
    found = found.groupBy("node", "nbr").agg(F.max("sim").alias("sim"), F.max("link").alias("link"), F.min("link").alias("only"))
    known = lists.select("node", "nbr", F.lit(True).alias("known"))
    found = found.join(known, ["node", "nbr"], "left").withColumn("new", F.col("known").isNull() & ~F.col("only")).filter("new or link")
    found = common.staged(found.select("node", "nbr", "sim", "link", "new"), "nn-found")
    links = found.filter("link").select(F.col("node").alias("a"), F.col("nbr").alias("b"))
    found = found.filter("new").select("node", "nbr", "sim")
    fresh = common.staged(_shortened(lists.select("node", "nbr", "sim").unionByName(found), state.select("node", "k"), keep), "nn-lists")
    changed = fresh.join(found.select("node", "nbr"), ["node", "nbr"], "left_semi").count()
    return fresh, changed / max(1, fresh.count()), links


def _counted(nodes: DataFrame, components: DataFrame, kind: str, threshold: float) -> DataFrame:
    """(node, links): vectors at or above the threshold in the node's component, itself aside.

    A component's nodes are dealt to blocks by hash; each pair of blocks is compared once.
    """
    sizes = components.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / MEMBERS).cast("int").alias("blocks"))
    rows = components.join(sizes, "component").join(nodes.select("node", "mult", "blob"), "node").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("component", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "mult", "blob")
    rows = rows.repartition("component", "i", "j").sortWithinPartitions("component", "i", "j", "own", "node")

    def each(group):
        node, mult, own = group["node"], group["mult"], group["own"]
        i, j = int(group["i"][0]), int(group["j"][0])
        x = unit(group["blob"], kind)
        cut = len(node) if i == j else int((own == i).sum())
        if not 0 < cut <= len(node) or (i != j and cut == len(node)):
            return
        if i == j:
            links = np.zeros(len(node), np.int64)
            for a in range(0, len(node), 2048):
                near = x[a : a + 2048] @ x.T >= threshold
                near[np.arange(len(near)), a + np.arange(len(near))] = False
                links[a : a + 2048] = near @ mult
        else:
            near = x[:cut] @ x[cut:].T >= threshold
            links = np.concatenate([near @ mult[cut:], near.T @ mult[:cut]])
        yield node, links.astype(np.int64)

    return common.grouped(rows, ["component", "i", "j"], each, ["node", "links"], "node long, links long").groupBy("node").agg(F.sum("links").alias("links"))


def _audited(nodes: DataFrame, kind: str, threshold: float, size: int) -> DataFrame:
    """(a, b): all links of a bounded sample of nodes (the ``size`` smallest hashes)."""
    few = nodes.orderBy(F.xxhash64("node"), "node").limit(size).select("node", "dim", "blob").collect()
    by: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for d in {r["dim"] for r in few}:
        own = [r for r in few if r["dim"] == d]
        by[d] = np.array([r["node"] for r in own]), unit([bytes(r["blob"]) for r in own], kind)
    shared = nodes.sparkSession.sparkContext.broadcast(by)

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch | None:
            node, dims, blobs = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_pylist()
            a, b = [], []
            for d, (ids, x) in shared.value.items():
                at = np.flatnonzero(dims == d)
                if not len(at):
                    continue
                other = unit([blobs[k] for k in at], kind).T
                for lo in range(0, len(ids), AUDIT):
                    i, j = np.nonzero(x[lo : lo + AUDIT] @ other >= threshold)
                    a.append(ids[lo + i])
                    b.append(node[at][j])
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"]) if a else None

        return each

    return common.map_arrow(nodes.select("node", "dim", "blob"), make, "a long, b long").filter("a != b")


def audit(nodes: DataFrame, components: DataFrame, kind: str, threshold: float) -> tuple[DataFrame, int, int]:
    """The links (a, b) of the audited nodes, how many there are, and how many lie within a component.

    The sample is doubled until it shows ``AUDIT_LINKS`` links, or holds ``AUDIT_MOST`` nodes.
    """
    side, size, n = components.select("node", "component"), AUDIT, nodes.count()
    while True:
        links = common.staged(_audited(nodes, kind, threshold, size), "nn-audit")
        checked = links.join(side.toDF("a", "ca"), "a", "left").join(side.toDF("b", "cb"), "b", "left")
        seen = checked.agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce(F.col("ca") == F.col("cb"), F.lit(False)).cast("long")).alias("same")).first()
        if seen["n"] >= AUDIT_LINKS or size >= min(AUDIT_MOST, n):
            return links, seen["n"], seen["same"] or 0
        size *= 2


def searched(nodes: DataFrame, kind: str, threshold: float, n: int, at_random: bool, rounds: int) -> tuple[DataFrame, float]:
    """(node, component) of the ``n`` nodes with a link, and the audited recall of the search."""
    count, keep, first = orders(n, threshold), LIST, 0
    pairs, edges, recall = None, None, 1.0
    for attempt in range(TRIES):
        met = common.staged(_started(nodes, kind, threshold, count, first, keep, at_random), "nn-started")
        more, own = met.filter("not link").select("node", "nbr", "sim"), met.filter("link").select(F.col("node").alias("a"), F.col("nbr").alias("b"))
        lists = common.staged(_shortened(more if pairs is None else pairs.unionByName(more), None, keep), "nn-lists")
        for _ in range(rounds):
            lists, changed, links = _descended(lists, nodes, kind, threshold, keep)
            own = own.unionByName(links)
            if changed < SETTLED:
                break
        pairs = lists.select("node", "nbr", "sim")
        edges = common.staged(own if edges is None else edges.unionByName(own), "nn-edges")
        components = common.staged(connected_components(edges), "nn-components")
        shown, seen, same = audit(nodes, components, kind, threshold)
        recall = same / seen if seen else 1.0
        logging.getLogger(__name__).info("search %d: %d of %d audited links found", attempt + 1, same, seen)
        if recall >= RECALL:
            break
        # what the audit shows is not added yet: the next search is to be measured by what it finds itself
        first, count, keep = first + count, count * 2, min(2 * keep, LIST_MOST)
    if recall < LEAST_RECALL:
        raise RuntimeError(f"recall {recall:.3f} of {seen} audited links after {TRIES} searches")
    if same < seen:
        components = common.staged(connected_components(edges.unionByName(shown)), "nn-components")
    return components, recall


def near_duplicates(rows: DataFrame, column: str = "embedding", threshold: float = 0.95, at_random: bool = False, rounds: int = ROUNDS) -> tuple[DataFrame, float]:
    """(vec_id, n_links, component_id, kept) of every row, and the recall that the audit measured.

    Vectors that are null, empty, zero, or hold null or non-finite components link with
    nothing, nor do vectors of different lengths with each other. Rows of equal vectors are
    linked and counted one by one; repeated rows likewise. A null id is never a component's
    smallest unless all are null. An empty table gives no rows. The recall is that of the search
    before the links which the audit itself showed were added; it is logged, and below ``LEAST_RECALL``
    after ``TRIES`` searches RuntimeError is raised. ``at_random`` starts from random neighbours.
    """
    common.missing_columns(rows, "vec_id", column)
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), column)
    members, nodes, kind = _nodes(rows, column)
    n = nodes.count()
    recall = 1.0

    def found() -> DataFrame:
        nonlocal recall
        components, recall = searched(nodes, kind, threshold, n, at_random, rounds)
        return components

    components = common.settled(found, "nn-components")
    links = _counted(nodes, components, kind, threshold)
    named = nodes.select("node", "first_id", "mult").join(components, "node", "left").withColumn("component", F.coalesce("component", F.col("node"))).join(links, "node", "left")
    least = named.groupBy("component").agg(F.min("first_id").alias("component_id"))
    named = named.join(least, "component").select("node", (F.coalesce("links", F.lit(0)) + F.col("mult") - 1).alias("n_links"), "component_id")
    named = nodes.select("node", "blob").join(named, "node").drop("node")
    linked = members.join(named, "blob").select("vec_id", "n_links", "component_id")
    alone = rows.filter(~_valid(column)).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = linked.unionByName(alone)
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id"))), recall
