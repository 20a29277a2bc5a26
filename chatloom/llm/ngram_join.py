"""N-gram Jaccard join: documents whose word n-gram sets are similar, as connected components.

1. Blocks of documents list their distinct n-gram keys; the parts of the key space count in how
   many documents each key stands (one packed row per block and part, see `blocks`).
2. Back at the documents, n-grams are ordered by that count, rarest first: a global order in
   which n-grams of one document only come first. The first `n - ceil(t n) + 1` form the
   *prefix*; two sets of similarity t share an n-gram of their prefixes. A document whose
   prefix holds only n-grams of its own has no partner and leaves.
3. Equal sets become one node, and nodes of equal prefix and size one *group*.
4. Prefix keys join groups, with length and positional filters. First every group meets the
   most shared group of each of its keys, and every member its group's smallest (stars: linear,
   not all pairs); found links are verified on whole sets and give labels of connected nodes.
   Stars in random blocks of each key join what lay too far from the first centre. Then only pairs
   that differ in their label are left: group pairs of those are joined by key, filtered,
   expanded to members and verified. Every link between different labels is found, so the
   components are exact, while large groups of near copies never meet pairwise.

Keys of step 1 are the upper 48 bits of a 64-bit hash: a collision makes a count larger, which
changes the order and no result. Sets are compared by 64-bit hashes of their n-grams.

Defined cases: fewer than n words are one n-gram; null, empty and blank texts have no n-grams
and link with nothing; equal texts link; rows that share an id are one document for links; a
null id takes its component from its copies; an empty table gives an empty table; extra columns
are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatloom.llm import blocks
from chatloom.llm.components import connected_components
from chatloom.llm.util import only, parts_of, release, save, space_words

_PRIME = np.uint64(0x9E3779B97F4A7C15)


def ngram_set(text: str | None, n: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word n-grams of a text, A-Z lower-cased."""
    words = space_words(text, lower=True)
    if not words:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    size = min(n, len(w))
    h = np.full(len(w) - size + 1, size, np.uint64)
    for j in range(size):
        h = (h ^ w[j:len(w) - size + 1 + j]) * _PRIME
        h ^= h >> np.uint64(32)
    return np.unique(h)


def required(n: int, percent: int) -> int:
    """N-grams that a set of n shares with any partner."""
    return -(-percent * n // 100)


def prefixes(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, size, and for documents that may have a partner: set digest, shared n-grams, prefix.

    The arrays are null but for the first row of a digest in a block.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    parts = parts_of(docs.sparkSession)
    packed = blocks.pack(only(docs, "doc_id", "text"), lambda block: [(blocks.DOCS, block)], "text", "ngram-blocks")

    def rank(block: pa.Table, answers: list[pa.Table]) -> pa.Table:
        keys, dfs = blocks.joined_counts(answers)
        out, seen = [], set()
        for text in block["text"].to_pylist():
            grams = ngram_set(text, n)
            size = len(grams)
            at, known_here = blocks.lookup(keys, blocks.short(grams))
            lead = size - required(size, percent) + 1 - int(size - known_here.sum())  # prefix places left for shared n-grams
            if not size or lead <= 0:
                out.append((size, None, None, None))
                continue
            digest = xxhash.xxh3_128_digest(grams.tobytes())
            if digest in seen:
                out.append((size, digest, None, None))
                continue
            seen.add(digest)
            shared, df = grams[known_here], dfs[at[known_here]]
            order = np.lexsort((shared, df))[:lead]
            out.append((size, digest, shared.view(np.int64), shared[order].view(np.int64)))
        size, digest, shared, prefix = zip(*out)
        longs = pa.list_(pa.int64())
        return pa.table({"doc_id": block["doc_id"], "size": pa.array(size, pa.int64()), "digest": pa.array(digest, pa.binary()),
                         "shared": pa.array(shared, longs), "prefix": pa.array(prefix, longs)})

    counts = blocks.shared_counts(packed, lambda block: [ngram_set(t, n) for t in block["text"].to_pylist()], parts)
    found = blocks.finish(packed, counts, rank, f"doc_id {kind}, size long, digest binary, shared array<long>, prefix array<long>")
    found = save(found, "ngram-prefixes")
    release(packed)
    return found


def _verify(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The (a, b) whose sets reach the threshold."""
    one = nodes.select(F.col("node").alias("a"), F.col("size").alias("na"), F.col("shared").alias("sa"))
    two = nodes.select(F.col("node").alias("b"), F.col("size").alias("nb"), F.col("shared").alias("sb"))
    common = F.size(F.array_intersect("sa", "sb"))
    return pairs.join(one, "a").join(two, "b").where(100 * common >= percent * (F.col("na") + F.col("nb") - common)).select("a", "b")


def _may_link(x: str, y: str, percent: int):
    """Length filter, and the positional filter of a common key: what both have from its place on must do."""
    nx, ny = F.col(f"{x}.size"), F.col(f"{y}.size")
    need = F.ceil(percent * (nx + ny) / F.lit(100.0 + percent) - 1e-9)
    after = F.least(F.col(f"{x}.rest"), F.col(f"{y}.rest"))
    return (100 * F.least(nx, ny) >= percent * F.greatest(nx, ny)) & (after >= need)


def _near_labels(links: DataFrame) -> DataFrame:
    """(node, component): a smaller node that links lead to within a few steps.

    Two nodes of a label are connected; the whole component may have several labels. That is
    enough to leave most pairs out, and costs a few joins.
    """
    ends = links.toDF("node", "other").unionByName(links.select(F.col("b").alias("node"), F.col("a").alias("other")))
    label = save(ends.groupBy("node").agg(F.min("other").alias("m")).select("node", F.least("node", "m").alias("component")), "ngram-labels")
    for _ in range(2):
        far = label.select(F.col("node").alias("component"), F.col("component").alias("further"))
        label = label.join(far, "component").select("node", F.col("further").alias("component"))
    return save(label, "ngram-labels")


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))


def _stars(entry: DataFrame, turn: int, percent: int, block: int = 32) -> DataFrame:
    """Pairs (a, b) of each entry of a key with one entry of another component.

    That centre is the entry with the most n-grams in common with others, so the nearest to what
    its copies came from: of the whole key on the first turn, then of blocks to which the entries
    of a key are dealt by hash. Either way a key gives fewer pairs than it has entries.
    """
    if turn == 0:
        dealt = entry.withColumn("block", F.lit(0).cast("long")).withColumn("draw", F.struct(-F.col("len"), "rep"))
    else:
        sizes = entry.groupBy("key").agg(F.ceil(F.count("*") / block).alias("blocks"))
        dealt = entry.join(sizes, "key").withColumn("block", F.pmod(F.xxhash64("rep", "key", F.lit(turn)), F.col("blocks"))).withColumn(
                "draw", F.struct(-F.col("len"), F.xxhash64("rep", F.lit(-turn))))
    centre = save(dealt.groupBy("key", "block").agg(F.min(F.struct("draw", "rep", "comp", "size", "rest")).alias("c"), F.count("*").alias("n")).where("n > 1").select(
        "key", "block", "c.rep", "c.comp", "c.size", "c.rest"), "ngram-centres")
    return dealt.alias("x").join(centre.alias("y"), ["key", "block"]).where("x.comp <> y.comp").where(_may_link("x", "y", percent)).select(
        F.col("x.rep").alias("a"), F.col("y.rep").alias("b"))


def similar_components(docs: DataFrame, n: int = 5, percent: int = 80, rounds: int = 1) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id reachable by links) of every document.

    `rounds` of random stars follow the first ones; they change the cost, not the result.
    """
    found = prefixes(docs, n, percent)
    alive = found.where("digest IS NOT NULL")
    ids = save(alive.groupBy("digest").agg(F.min("doc_id").alias("node")).where("node IS NOT NULL"), "ngram-ids")
    sets = alive.where("shared IS NOT NULL").groupBy("digest").agg(F.first("size").alias("size"), F.first("shared").alias("shared"), F.first("prefix").alias("prefix"))
    # rest: n-grams from a key's place on, in the set's whole order
    nodes = save(sets.join(ids, "digest").drop("digest"), "ngram-nodes")
    # a key in one group only finds nothing; nodes of equal prefix and size are one group
    members = save(nodes.select("node", F.xxhash64("prefix", "size").alias("g"), "size", "prefix"), "ngram-members")
    groups = members.groupBy("g", "size", "prefix").agg(F.min("node").alias("head"))
    places = groups.select("g", "size", "head", F.size("prefix").alias("len"), F.posexplode("prefix").alias("pos", "key"))
    # the prefix ends at place size - required(size), so a key's rest is required(size) + len - 1 - pos
    need = F.ceil(percent * F.col("size") / 100.0 - 1e-9)
    places = save(places.select("key", "g", "head", "size", "len", (need + F.col("len") - 1 - F.col("pos")).alias("rest")), "ngram-places")

    heads = members.join(groups.select("g", "size", "prefix", "head"), ["g", "size", "prefix"]).where("node <> head").select(F.col("node").alias("a"), F.col("head").alias("b"))
    own = save(members.select("node", "g", "size").withColumn("comp", F.col("node")), "ngram-own")
    entry = places.withColumn("rep", F.col("head")).withColumn("comp", F.col("head"))
    links = tried = label = None
    for turn in range(1 + rounds):
        met = _stars(entry, turn, percent)
        if turn == 0:
            met = met.unionByName(heads)
        else:
            met = met.join(tried, ["a", "b"], "left_anti")
        met = save(_ordered(met).groupBy("a", "b").count().select("a", "b"), "ngram-stars")
        new = save(_verify(met, nodes, percent), "ngram-links")
        tried = met if tried is None else tried.unionByName(met)
        links = new if links is None else links.unionByName(new)
        label = _near_labels(links)
        own = members.select("node", "g", "size").join(label, "node", "left").select("g", "size", "node", F.coalesce("component", "node").alias("comp"))
        own = save(own, "ngram-own")
        entry = save(places.join(own.groupBy("g", "comp").agg(F.min("node").alias("rep")), "g"), "ngram-entries")
        open_keys = entry.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("key")
        entry = save(entry.join(open_keys, "key", "left_semi"), "ngram-open")

    # what is left: pairs of a key in different components
    pairs = entry.alias("x").join(entry.alias("y"), "key").where("x.comp < y.comp").where(_may_link("x", "y", percent)).select(
        F.col("x.g").alias("gx"), F.col("x.comp").alias("cx"), F.col("y.g").alias("gy"), F.col("y.comp").alias("cy"))
    pairs = save(pairs.groupBy("gx", "cx", "gy", "cy").count().drop("count"), "ngram-group-pairs")
    one = own.select(F.col("g").alias("gx"), F.col("comp").alias("cx"), F.col("node").alias("a"))
    two = own.select(F.col("g").alias("gy"), F.col("comp").alias("cy"), F.col("node").alias("b"))
    rest = _ordered(pairs.join(one, ["gx", "cx"]).join(two, ["gy", "cy"]).select("a", "b")).join(tried, ["a", "b"], "left_anti")
    more = save(_verify(rest, nodes, percent), "ngram-more")
    label = connected_components(links.unionByName(more))
    named = ids.join(label, "node", "left").select("digest", F.coalesce("component", "node").alias("component"))
    named = save(named, "ngram-named")
    # documents without a partner get keys of their own, so that they spread
    key = F.coalesce(F.col("digest"), F.concat(F.lit("-"), F.col("doc_id").cast("string"), F.lit("-"), F.col("size").cast("string")).cast("binary"))
    out = save(found.select("doc_id", "size", key.alias("digest")).join(named, "digest", "left").select(
        "doc_id", F.col("size").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id")), "ngram-result")
    release(found, nodes, members, places, ids, named)
    return out
