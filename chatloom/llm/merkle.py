"""Merkle dataset manifest with pointer-jumping proofs.

Every row is a leaf; per source, and then over the sources, runs of `fanout` consecutive nodes are
hashed into their parent until one node is left. A proof is the list of a leaf's steps to the root,
each with the leaf's ancestor's place in its run and the digests of the run's others.

Proofs come from pointer jumping: every inner node holds the siblings on the way to an ancestor, at
first its parent. A self-join appends to each node's segment the segment of the ancestor it points
at, so the distance doubles until all point at the root. The inner nodes are a sixteenth of the
leaves; a leaf makes the last hop, from its run to the root, by one join in which at most `fanout`
rows share a key.

Positions come from one range sort; a source or a repeated row that holds a third of the table is
spread over many ranges (ties are broken by the row's place in the saved table). A run is gathered by
its parent's id, `fanout` digests at most. The side that a jump looks up shrinks by `fanout` per
level; it is broadcast only if its counted nodes times the longest segment fit in 32 MB, and merged
otherwise.

Defined cases: null columns are hashed as `-`; null ids and the null source come first; rows that
share source and id are ordered by their leaf; a lone leaf is its own subroot, and a lone subroot the
root, with no step for it; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chatloom.llm.util import only, release, save
from chatloom.operators.positions import dense_positions_by

FANOUT = 16
#: Columns of a leaf, in the order in which they are hashed.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Largest side of a jump that is broadcast, in bytes of its longest rows.
BROADCAST_BYTES = 32 << 20
STEPS = "array<struct<at: int, siblings: binary>>"


def leaf_digest(**fields: Column) -> Column:
    """SHA-256 (lowercase hex) over the fields: `-` for null, else byte count, `:` and value."""
    coded = [F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c))
             for c in (fields[name].cast("string") for name in FIELDS)]
    return F.sha2(F.concat(*coded), 256)


def lowered(text: Column) -> Column:
    """A-Z in lower case, all else as it is."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def leaves(docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """(source, doc_id, leaf, other): every row's digest, and that of the row after tampering where `tampered` holds.

    `tampered` is a condition on the columns of FIELDS; tampering lower-cases A-Z in the text.
    """
    rows = only(docs, *FIELDS)
    own = {name: F.col(name) for name in FIELDS}
    other = leaf_digest(**(own | {"text": lowered(F.col("text"))}))
    hit = F.lit(False) if tampered is None else F.coalesce(tampered, F.lit(False))
    rows = rows.select("source", "doc_id", leaf_digest(**own).alias("leaf"), F.when(hit, other).alias("other"))
    return rows.withColumn("other", F.coalesce("other", "leaf"))


def _height(n: Column, fanout: int) -> Column:
    """Levels above `n` nodes until one is left."""
    powers, p = [], 1
    while p < 1 << 62:
        powers.append(p)
        p *= fanout
    return sum(((n > F.lit(p)).cast("int") for p in powers), F.lit(0))


def _placed(rows: DataFrame, fanout: int) -> DataFrame:
    """`rows` with `tree` (the source's number), `idx` (place in the source) and `height` of the source's tree."""
    order = ["source", "doc_id", "leaf", "_tie"]
    table = save(rows, "merkle-leaves")
    tied = table.withColumn("_tie", F.monotonically_increasing_id())
    ranged = save(tied.repartitionByRange(*order).sortWithinPartitions(*order).drop("_tie").withColumn("_at", F.monotonically_increasing_id()), "merkle-sorted")
    release(table)
    piece = F.shiftright("_at", 33).alias("_piece")
    counts = save(ranged.groupBy(piece, "source").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n")), "merkle-counts")
    sources = dense_positions_by(counts.groupBy("source").agg(F.sum("_n").alias("_total")), ["source"], "tree")
    before = Window.partitionBy("source").orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    offsets = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).alias("c").join(
        sources.alias("s"), F.col("c.source").eqNullSafe(F.col("s.source"))).select(
        "_piece", F.col("c.source").alias("_source"), "_first", "_before", "tree", _height(F.col("_total"), fanout).alias("height"))
    met = ranged.withColumn("_piece", piece).join(offsets.withColumnRenamed("_piece", "_p"), (F.col("_piece") == F.col("_p")) & F.col("source").eqNullSafe(F.col("_source")))
    return met.select(*rows.columns, "tree", (F.col("_before") + F.col("_at") - F.col("_first")).alias("idx"), "height")


def _runs(nodes: DataFrame, fanout: int) -> DataFrame:
    """Parents (tree, height, idx, kids, digest) of nodes (tree, height, idx, digest hex); `kids` holds their bytes in order."""
    kids = F.array_sort(F.collect_list(F.struct("idx", "digest")))  # a run: fanout rows at most
    grouped = nodes.groupBy("tree", "height", F.floor(F.col("idx") / fanout).alias("up")).agg(kids.alias("kids"))
    joined = F.array_join(F.transform("kids", lambda k: k["digest"]), "")
    return grouped.select("tree", "height", F.col("up").alias("idx"), F.unhex(joined).alias("kids"), F.sha2(joined, 256).alias("digest"))


#: The tree over the sources; a source's subroot is its node of level 0 at the source's number.
TOP = -1


def _tree(nodes: DataFrame, name: str, height: int, fanout: int) -> list[DataFrame]:
    """Saved runs of level 1, 2, ... of all trees, each built while its tree has a level above."""
    levels = []
    for level in range(1, height + 1):
        nodes = save(_runs(nodes.where(F.col("height") >= level).select("tree", "height", "idx", "digest"), fanout).withColumn("level", F.lit(level)), f"merkle-{name}-{level}")
        levels.append(nodes)
    return levels


def _named(run: DataFrame) -> DataFrame:
    """Runs under the ids they have as nodes: a source's last run is a node of the top tree."""
    last = (F.col("tree") != TOP) & (F.col("level") == F.col("height"))
    return run.select(F.when(last, TOP).otherwise(F.col("tree")).alias("tree"), F.when(last, 0).otherwise(F.col("level")).alias("level"),
                      F.when(last, F.col("tree")).otherwise(F.col("idx")).alias("idx"), "kids", "digest",
                      F.col("tree").alias("from_tree"), F.col("idx").alias("from_idx"), F.col("level").alias("from_level"), last.alias("last"))


def _others(kids: str, at: Column) -> Column:
    return F.concat(F.substring(kids, F.lit(1), at * 32), F.substring(kids, at * 32 + 33, F.lit(1 << 30)))


def _pointers(runs: DataFrame, fanout: int) -> DataFrame:
    """For every node below `runs`: its parent, the one step to it, and the subroot where the parent is one."""
    at = F.explode(F.sequence(F.lit(0), (F.octet_length("kids") / 32).cast("int") - 1))
    child = _named(runs).select("*", at.alias("at"))
    return child.select(F.col("from_tree").alias("tree"), (F.col("from_level") - 1).alias("level"), (F.col("from_idx") * fanout + F.col("at")).alias("idx"),
                        F.col("tree").alias("to_tree"), F.col("level").alias("to_level"), F.col("idx").alias("to_idx"),
                        F.array(F.struct(F.col("at").cast("int").alias("at"), _others("kids", F.col("at")).alias("siblings"))).alias("steps"),
                        F.when(F.col("last"), F.col("digest")).alias("subroot"))


def _jump(pointers: DataFrame, reached: int, rows: int, fanout: int) -> DataFrame:
    """Each node's segment with that of the node it points at, `reached` levels up; nodes that point at the root stay."""
    far = pointers.where((F.col("tree") == TOP) | (F.col("level") > reached)).select(
        F.col("tree").alias("to_tree"), F.col("level").alias("to_level"), F.col("idx").alias("to_idx"), F.struct(
            F.col("to_tree").alias("tree"), F.col("to_level").alias("level"), F.col("to_idx").alias("idx"), "steps", "subroot").alias("far"))
    small = rows * reached * (32 * fanout + 64) <= BROADCAST_BYTES
    met = pointers.join(far.hint("broadcast" if small else "merge"), ["to_tree", "to_level", "to_idx"], "left")
    return met.select("tree", "level", "idx", *[F.coalesce(F.col(f"far.{c}"), F.col(f"to_{c}")).alias(f"to_{c}") for c in ("tree", "level", "idx")],
                      F.when(F.col("far").isNull(), F.col("steps")).otherwise(F.concat("steps", "far.steps")).alias("steps"),
                      F.coalesce("subroot", "far.subroot").alias("subroot"))


def prove(rows: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """`rows` (source, doc_id, leaf, ...) with `subroot`, `root` and `proof` (array of (at, siblings), leaf to root)."""
    if fanout < 2:
        raise ValueError("a run needs two nodes at least")
    placed = save(_placed(rows, fanout), "merkle-placed")
    sizes = placed.groupBy("tree", "height").agg(F.min_by("leaf", "idx").alias("leaf"), F.count(F.lit(1)).alias("n"))
    sizes = save(sizes, "merkle-sizes")
    tallest, trees = sizes.agg(F.max("height"), F.count(F.lit(1))).first()
    if not trees:
        return rows.select("*", F.lit(None).cast("string").alias("subroot"), F.lit(None).cast("string").alias("root"), F.lit(None).cast(STEPS).alias("proof")).limit(0)
    low = _tree(placed.withColumnRenamed("leaf", "digest"), "source", tallest, fanout)
    lone = sizes.where("height = 0").select(F.col("tree").alias("idx"), F.col("leaf").alias("digest"))
    for run in low:
        lone = lone.unionByName(run.where(F.col("level") == F.col("height")).select(F.col("tree").alias("idx"), "digest"))
    high, p = 0, 1
    while p < trees:
        high, p = high + 1, p * fanout
    subroots = save(lone.select(F.lit(TOP).cast("long").alias("tree"), F.lit(high).alias("height"), "idx", "digest"), "merkle-subroots")
    top = _tree(subroots, "top", high, fanout)
    root = (top[-1] if top else subroots).first()["digest"]

    pointers = None
    for run in low[1:] + top:
        some = _pointers(run, fanout)
        pointers = some if pointers is None else pointers.unionByName(some)
    if pointers is not None:
        pointers, reached, depth = save(pointers, "merkle-pointers"), 1, max(0, tallest - 1) + high
        while reached < depth:
            rows_far = pointers.where((F.col("tree") == TOP) | (F.col("level") > reached)).count()
            further = save(_jump(pointers, reached, rows_far, fanout), "merkle-pointers")
            release(pointers)
            pointers, reached = further, 2 * reached

    # the last hop: a leaf's run, and the way of that run to the root
    first = [_named(r) for r in low[:1]] + [_named(r) for r in top[:1]]
    hop = placed.select(*rows.columns, "tree", "idx", "height")
    if not first:  # one source with one row
        proof = F.array().cast(STEPS)
        return hop.select(*rows.columns, F.col("leaf").alias("subroot"), F.lit(root).alias("root"), proof.alias("proof"))
    run = first[0] if len(first) == 1 else first[0].unionByName(first[1])
    run = run.select("tree", "level", "idx", "kids", "digest")
    if pointers is not None:
        run = run.join(pointers.select("tree", "level", "idx", "steps", "subroot"), ["tree", "level", "idx"], "left")
    else:
        run = run.withColumn("steps", F.lit(None).cast(STEPS)).withColumn("subroot", F.lit(None).cast("string"))
    run = run.select(F.col("tree").alias("to_tree"), F.col("level").alias("to_level"), F.col("idx").alias("to_idx"), "kids", "digest", "steps", F.col("subroot").alias("way"))
    h, place = F.col("height"), F.when(F.col("height") == 0, F.col("tree")).otherwise(F.col("idx"))
    met = hop.select("*", F.when(h <= 1, TOP).otherwise(F.col("tree")).alias("to_tree"), F.when(h == 1, 0).otherwise(1).alias("to_level"),
                     F.when(h == 1, F.col("tree")).otherwise(F.floor(place / fanout)).alias("to_idx"), (place % fanout).cast("int").alias("at"))
    met = met.join(run.hint("merge"), ["to_tree", "to_level", "to_idx"], "left")
    own = F.array(F.struct("at", _others("kids", F.col("at")).alias("siblings")))
    steps = F.concat(own, F.coalesce("steps", F.array().cast(STEPS))).cast(STEPS)
    subroot = F.when(h == 0, F.col("leaf")).when(h == 1, F.col("digest")).otherwise(F.col("way"))
    return met.select(*rows.columns, subroot.alias("subroot"), F.lit(root).alias("root"),
                      F.when(F.col("kids").isNull(), F.array().cast(STEPS)).otherwise(steps).alias("proof"))


def proof_digest(proof: Column) -> Column:
    """SHA-256 over all sibling digests (hex text) of a proof, leaf to root, left to right."""
    return F.sha2(F.array_join(F.transform(proof, lambda s: F.lower(F.hex(s["siblings"]))), ""), 256)


def fold(leaf: Column, proof: Column) -> Column:
    """The root that `leaf` gives with the siblings of `proof`."""
    def up(digest: Column, step: Column) -> Column:
        text, cut = F.lower(F.hex(step["siblings"])), step["at"] * 64
        return F.sha2(F.concat(F.substring(text, F.lit(1), cut), digest, F.substring(text, cut + 1, F.length(text))), 256)

    return F.aggregate(proof, leaf, up)


def verify(proofs: DataFrame) -> DataFrame:
    """The rows of `prove` that had `leaf` and `other`: digests of their proofs and what `other` folds to."""
    found = proofs.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("proof")).alias("proof_sha256"), fold(F.col("other"), F.col("proof")).alias("folded_root"))
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))
