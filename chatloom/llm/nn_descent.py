"""Embedding near-duplicates by NN-descent, threshold links and exact counts inside components.

1. Equal vectors of a label become one node with a weight.
2. Neighbour lists start from random hyperplane leaves (a few trees; leaves that are too large
   are split by hash). Each round every node introduces its neighbours, and those it is a
   neighbour of, to each other (hubs are split into blocks), and each keeps its nearest, until
   a round finds no new link.
   Introductions also keep one link at least as near as the threshold per member and block, to
   the block's smallest id, so that a cluster larger than any list stays connected.
3. Links give components. A list that is full of links is too short for its cluster; lists are
   enlarged to the whole component, whose pairs are counted tile by tile, exactly and without
   writing them out.
4. A bounded sample is compared with all rows of its labels. While it shows a missing link, the
   search goes on from new trees; labels that still miss one after the last restart are compared
   in full, tile by tile, so no result comes back that its audit refutes.

Components stay float or are taken as double. Every row with an id is a vector of its own, also
where rows repeat an id: equal rows are linked, unlike rows of one id only if their vectors are.

Defined cases: a null label or a vector that is null, empty, zero or holds null or non-finite
components links with nothing; vectors of unequal length are not compared; rows with a null id come
back each, unlinked; an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chatloom.llm.components import connected_components
from chatloom.llm.util import by_group, map_batches, only, save


@dataclass(frozen=True)
class Search:
    """k: list length; trees and leaf: the start; block: members that a node introduces at once; tile: rows of a count; audit: sample."""

    k: int = 12
    trees: int = 6
    leaf: int = 64
    leaf_most: int = 256
    rounds: int = 8
    block: int = 64
    tile: int = 128
    audit: int = 256
    restarts: int = 4


def _unit(column: pa.ChunkedArray) -> np.ndarray:
    rows = np.array(column.to_pylist(), np.float64)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def nodes_of(vectors: DataFrame) -> DataFrame:
    """Distinct usable vectors per label: node, its smallest id, weight (rows), group (label and length), vec.

    A node is named by its smallest id, or by a hash above all usual ids where other vectors have that id too.
    """
    usable = vectors.where("h2 IS NOT NULL")
    own = usable.groupBy("h1", "h2").agg(F.min("vec_id").alias("low"), F.count("*").alias("weight"), F.first("label").alias("label"), F.first("embedding").alias("vec"))
    shared = usable.groupBy("vec_id").agg(F.min("h1").alias("a"), F.max("h1").alias("b")).where("a <> b").select(F.col("vec_id").alias("low"), F.lit(True).alias("shared"))
    hashed = F.shiftrightunsigned(F.xxhash64("h2", "h1"), 2).bitwiseOR(F.lit(1 << 62))
    return own.join(shared, "low", "left").select(
        "h1", "h2", F.when(F.col("shared"), hashed).otherwise(F.col("low").cast("long")).alias("node"), "low", "weight", F.xxhash64("label", F.size("vec")).alias("grp"), "vec")


def _keyed(vectors: DataFrame) -> DataFrame:
    """The rows with an id and a 128-bit key of (label, vector), whose second half is null where it cannot link."""
    one = vectors.where("vec_id IS NOT NULL")
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    usable = F.col("label").isNotNull() & F.col("embedding").isNotNull() & finite & F.exists("embedding", lambda x: x != 0)
    return one.withColumn("h1", F.when(usable, F.xxhash64(F.lit(1), "label", "embedding")).otherwise(F.xxhash64("vec_id"))).withColumn(
        "h2", F.when(usable, F.xxhash64(F.lit(2), "embedding", "label")))


def _introduce(p: Search, threshold: float):
    """Within one block: better neighbours for each member, and a link to the smallest linked id."""

    def run(group: pa.Table) -> pa.Table | None:
        ids, first = np.unique(group["node"].to_numpy(), return_index=True)
        if len(ids) < 2:
            return None
        group = group.take(pa.array(first))
        x = _unit(group["vec"])
        cos = x @ x.T
        np.fill_diagonal(cos, -2)
        linked = cos >= threshold
        low = np.argmax(linked, axis=1)  # ids are sorted
        has = np.flatnonzero(linked.any(axis=1) & (low < np.arange(len(ids))))
        worst = group["worst"].to_numpy()
        if len(ids) > p.k + 1:
            worst = np.maximum(worst, np.partition(cos, -p.k, axis=1)[:, -p.k] - 1e-12)
        i, j = np.nonzero(cos > worst[:, None])
        return pa.table({"node": np.append(ids[i], ids[has]), "nbr": np.append(ids[j], ids[low[has]]),
                         "cos": np.append(cos[i, j], cos[has, low[has]]), "link": np.append(np.zeros(len(i), bool), np.ones(len(has), bool))})

    return run


_FOUND = "node long, nbr long, cos double, link boolean"


def _nearest(edges: DataFrame, k: int) -> DataFrame:
    """The k nearest of each node; equal ones by the smaller id."""
    best = edges.groupBy("node", "nbr").agg(F.max("cos").alias("cos"))
    place = F.row_number().over(Window.partitionBy("node").orderBy(F.desc("cos"), "nbr"))
    return best.withColumn("place", place).where(F.col("place") <= k).drop("place")


def _leaves(nodes: DataFrame, p: Search, seed: int) -> DataFrame:
    """Nodes by tree, leaf and split: signs of random projections, as many as make leaves of about `leaf` nodes."""
    depth = nodes.groupBy("grp").agg(F.greatest(F.lit(0), F.ceil(F.log2(F.count("*") / p.leaf))).cast("int").alias("depth"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        depth = batch.column("depth").to_numpy()
        for dim in {len(v) for v in batch.column("vec").to_pylist()}:
            at = np.flatnonzero(np.array([len(v) for v in batch.column("vec").to_pylist()]) == dim)
            x = _unit(batch.column("vec").take(pa.array(at)))
            for tree in range(p.trees):
                planes = np.random.default_rng([seed, tree, dim]).standard_normal((dim, 60))
                bits = (x @ planes > 0) & (np.arange(60) < depth[at, None])
                leaf = bits.astype(np.int64) @ (1 << np.arange(60, dtype=np.int64))
                t = pa.Table.from_batches([batch.take(pa.array(at))]).select(["node", "grp", "vec"])
                out.append(t.append_column("tree", pa.array(np.full(len(at), tree))).append_column("leaf", pa.array(leaf)))
        return pa.concat_tables(out).combine_chunks().to_batches()[0]

    kind = nodes.schema["vec"].dataType.simpleString()
    placed = map_batches(nodes.join(depth, "grp").select("node", "grp", "vec", "depth"), run, f"node long, grp long, vec {kind}, tree long, leaf long")
    sizes = placed.groupBy("grp", "tree", "leaf").count().where(F.col("count") > p.leaf_most)
    split = F.coalesce(F.pmod(F.xxhash64("node", "tree", F.lit(seed)), F.ceil(F.col("count") / p.leaf_most)), F.lit(0)).cast("long")
    return placed.join(sizes, ["grp", "tree", "leaf"], "left").withColumn("split", split).drop("count")


def neighbour_lists(nodes: DataFrame, p: Search, threshold: float, seed: int) -> tuple[DataFrame, DataFrame]:
    """NN-descent: (node, nbr, cos) lists, and links (a, b) met on the way."""
    start = _leaves(nodes, p, seed).withColumn("worst", F.lit(-2.0))
    found = save(by_group(start, ["grp", "tree", "leaf", "split"], _introduce(p, threshold), _FOUND), "nn-found")
    links = found.where("link").select("node", "nbr")
    lists = save(_nearest(found.where("NOT link").drop("link"), p.k), "nn-lists")
    near = lists.where(F.col("cos") >= threshold).count()
    for _ in range(p.rounds):
        full = lists.groupBy("node").agg(F.count("*").alias("n"), F.min("cos").alias("worst")).select(
            "node", F.when(F.col("n") >= p.k, F.col("worst")).otherwise(-2.0).alias("worst"))
        meet = lists.select(F.col("node").alias("pivot"), F.col("nbr").alias("node")).unionByName(lists.select(F.col("nbr").alias("pivot"), "node"))
        meet = save(meet.groupBy("pivot", "node").count().drop("count"), "nn-meet")
        hubs = meet.groupBy("pivot").count().where(F.col("count") > p.block)
        part = F.coalesce(F.pmod(F.xxhash64("node", "pivot"), F.ceil(F.col("count") / p.block)), F.lit(0)).cast("long")
        met = meet.join(hubs, "pivot", "left").withColumn("part", part).drop("count")
        known = save(nodes.select("node", "vec").join(full, "node"), "nn-known")
        found = save(by_group(met.join(known, "node"), ["pivot", "part"], _introduce(p, threshold), _FOUND), "nn-found")
        links = links.unionByName(found.where("link").select("node", "nbr"))
        before = near
        lists = save(_nearest(lists.unionByName(found.where("NOT link").drop("link")), p.k), "nn-lists")
        near = lists.where(F.col("cos") >= threshold).count()
        if near == before:  # a round without a new link; the audit sees what it missed
            break
    return lists, links.toDF("a", "b").unionByName(lists.where(F.col("cos") >= threshold).select(F.col("node").alias("a"), F.col("nbr").alias("b")))


def _tile_pairs(nodes: DataFrame, label: DataFrame, p: Search) -> DataFrame:
    """The nodes of each component once for every pair of tiles that they take part in."""
    sizes = label.groupBy("component").agg(F.ceil(F.count("*") / p.tile).cast("long").alias("tiles"))
    placed = nodes.select("node", "weight", "vec").join(label, "node").join(sizes, "component").withColumn("tile", F.pmod(F.xxhash64("node"), F.col("tiles")))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1))
    return placed.withColumn("other", other).select(
        "component", F.least("tile", "other").alias("lo"), F.greatest("tile", "other").alias("hi"), "tile", "node", "weight", "vec")


def exact_links(nodes: DataFrame, groups: list[int], p: Search, threshold: float) -> DataFrame:
    """Links (a, b) that connect all near nodes of `groups`: every pair is compared, each pair of tiles names the smallest of what it connects."""

    def run(group: pa.Table) -> pa.Table | None:
        node, x = group["node"].to_numpy(), _unit(group["vec"])
        near = (x @ x.T) >= threshold
        np.fill_diagonal(near, True)
        low = node
        while True:
            lower = np.where(near, low, np.iinfo(np.int64).max).min(axis=1)
            if (lower == low).all():
                break
            low = lower
        at = np.flatnonzero(low < node)
        return pa.table({"a": node[at], "b": low[at]}) if len(at) else None

    whole = nodes.where(F.col("grp").isin(groups)).select("node", F.col("grp").alias("component"))
    return by_group(_tile_pairs(nodes, whole, p), ["component", "lo", "hi"], run, "a long, b long")


def count_links(nodes: DataFrame, label: DataFrame, p: Search, threshold: float) -> DataFrame:
    """(node, links): the weight of all other nodes of its component that are as near as the threshold."""
    pairs = _tile_pairs(nodes, label, p)

    def run(group: pa.Table) -> pa.Table | None:
        tile, node, weight = (group[c].to_numpy() for c in ("tile", "node", "weight"))
        x = _unit(group["vec"])
        lo, hi = group["lo"][0].as_py(), group["hi"][0].as_py()
        a = np.flatnonzero(tile == lo)
        b = np.flatnonzero(tile == hi)
        if not len(a) or not len(b):
            return None
        near = (x[a] @ x[b].T) >= threshold
        if lo == hi:
            np.fill_diagonal(near, False)
            return pa.table({"node": node[a], "links": near @ weight[b]})
        return pa.table({"node": np.append(node[a], node[b]), "links": np.append(near @ weight[b], weight[a] @ near)})

    return by_group(pairs, ["component", "lo", "hi"], run, "node long, links long").groupBy("node").agg(F.sum("links").alias("links"))


def audit(nodes: DataFrame, counted: DataFrame, p: Search, threshold: float) -> tuple[int, int, list[int]]:
    """Links of a bounded sample (`audit` nodes by hash) that exist, and that were counted; groups with a missing link."""
    sample = nodes.orderBy(F.xxhash64("node"), "node").limit(p.audit).select("node", "grp", "vec").collect()
    if not sample:
        return 0, 0, []
    by_grp: dict[int, list] = {}
    for r in sample:
        by_grp.setdefault(r["grp"], []).append(r)
    held = {g: ([r["node"] for r in rs], _unit(pa.chunked_array([pa.array([r["vec"] for r in rs])]))) for g, rs in by_grp.items()}

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        grp, node, weight = (batch.column(c).to_numpy() for c in ("grp", "node", "weight"))
        ids, n = [], []
        for g in set(grp.tolist()) & held.keys():
            at = np.flatnonzero(grp == g)
            near = (held[g][1] @ _unit(batch.column("vec").take(pa.array(at))).T) >= threshold
            ids += held[g][0]
            n += ((near & (np.array(held[g][0])[:, None] != node[at])) @ weight[at]).tolist()
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n, pa.int64())], names=["node", "n"])

    true = map_batches(nodes.select("grp", "node", "weight", "vec"), run, "node long, n long").groupBy("node").agg(F.sum("n").alias("n"))
    got = {r["node"]: (r["n"], r["links"]) for r in true.join(counted, "node", "left").select("node", "n", F.coalesce("links", F.lit(0)).alias("links")).collect()}
    missed = sorted({r["grp"] for r in sample if got[r["node"]][1] < got[r["node"]][0]})
    return sum(n for n, _ in got.values()), sum(n for _, n in got.values()), missed


def near_duplicates(vectors: DataFrame, threshold: float = 0.98, p: Search = Search(), seed: int = 11) -> DataFrame:
    """vec_id, n_links, component_id, kept of every vector of (vec_id, embedding, label)."""
    own = only(vectors, "vec_id", "embedding", "label")
    if own.schema["embedding"].dataType.simpleString() != "array<float>":
        own = own.withColumn("embedding", F.col("embedding").cast("array<double>"))
    keyed = save(_keyed(own), "nn-vectors")
    nodes = save(nodes_of(keyed), "nn-nodes")
    links = None
    missed: list[int] = []
    for restart in range(2 + p.restarts):
        more = exact_links(nodes, missed, p, threshold) if restart > p.restarts else neighbour_lists(nodes, p, threshold, seed + restart)[1]
        links = save(more if links is None else links.unionByName(more), "nn-links")
        label = save(connected_components(links), "nn-components")
        counted = save(count_links(nodes, label, p, threshold), "nn-counts")
        _, _, missed = audit(nodes, counted, p, threshold)
        if not missed:
            break
    if missed:
        raise RuntimeError("the audit misses links after a full comparison")
    # components are named by nodes; those with hashed nodes take the smallest id behind them
    named = save(nodes.select("h1", "h2", "node", "low", "weight").join(label, "node", "left").withColumn("component", F.coalesce("component", "node")), "nn-placed")
    lows = named.where("node <> low").groupBy("component").agg(F.min("low").alias("behind"))
    named = named.join(lows, "component", "left").join(counted, "node", "left")
    named = save(named.select("h1", "h2", F.least("component", "behind").alias("component_id"), (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")), "nn-named")
    out = keyed.select("vec_id", "h1", "h2").join(named, ["h1", "h2"], "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    lost = own.where("vec_id IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.unionByName(lost).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
