"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame functions only.

Every document is to be taken `target / source size` times on average: a whole number of
copies, and a fraction that is rounded dependently. Within a block of about `BLOCK` documents
of a source, pairs of fractions exchange word mass at random until one of them is integral
(the sum of size * probability stays, and so does each expectation); one document at most is
left over. The leftovers of all blocks are dealt to blocks again, so that a reduction tree of
depth log(documents) ends with one leftover per source. It is rounded so that the source comes
nearest to its target, where one other document of the last block may be taken the other way;
the words taken of a source differ from its target by less than one document.

Defined cases: rows that agree in source, id and size are one unit whose copies are spread
evenly over its rows; a null source is a source of its own, the last one; null and empty texts
have size 0 and are taken 0 times; an empty table gives an empty table; extra columns stay in
`mix_documents`. The same rows give the same result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chatloom.llm.util import only, save, shelter

#: Documents of a block on average; hashing bounds the largest block near it.
BLOCK = 128
WEIGHTS = (5, 2, 1)
_EPS = 1e-9
_UNIT = ("doc_id", "size", "rows", "whole", "source_size", "target", "u", "p")


def n_words(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def uniform(*cols) -> Column:
    """A number in [0, 1) that is fixed by the columns."""
    return F.pmod(F.xxhash64(*cols), F.lit(1 << 52)) / F.lit(float(1 << 52))


def ranked_sources(sources: DataFrame) -> DataFrame:
    """`sources` with `rank` from 0 in code point order, null last: a range sort, and one row of counts per range."""
    order = [F.col("source").isNull(), F.col("source")]
    ranged = save(sources.repartitionByRange(int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions")), *order)
                  .withColumn("range", F.spark_partition_id()), "mix-sources")
    before = ranged.groupBy("range").count().select(
        "range", F.coalesce(F.sum("count").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy("range").orderBy(*order))
    return ranged.withColumn("rank", inside).join(before, "range").withColumn("rank", F.col("rank") - 1 + F.col("before")).drop("range", "before")


def source_targets(sources: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """Adds `target` to (source, source_size, ...): `share` of all sizes by weight, each at most `most` times its size.

    The excess of capped sources goes to the others by weight. The capped ones are those with
    most * size / weight below a level that rises until it is consistent; each step is one
    aggregate of the source table and moves three numbers to the driver.
    """
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    table = save(ranked_sources(sources).withColumn("weight", F.element_at(cycle, (F.col("rank") % len(weights) + 1).cast("int")))
                 .withColumn("cap", most * F.col("source_size")), "mix-weights")
    level, capped_before = 0.0, -1
    while True:
        capped = F.col("cap") < level * F.col("weight")
        total, taken, weight, n = table.agg(F.sum("source_size"), F.sum(F.when(capped, F.col("cap")).otherwise(0.0)),
                                            F.sum(F.when(capped, 0.0).otherwise(F.col("weight"))), F.count(F.when(capped, 1))).first()
        if n == capped_before or not weight:
            break
        capped_before, level = n, (share * total - taken) / weight
    return table.withColumn("target", F.least(F.col("cap"), level * F.col("weight"))).drop("rank", "weight", "cap")


def _let(value: Column, use) -> Column:
    """Names a value for use in a lambda, so that it is computed once."""
    return F.transform(F.array(value), use)[0]


def _exchange(unit_type: str):
    """The pivotal step for `aggregate`: the open document `acc.open` and the next one, `b`."""

    def step(acc: Column, b: Column) -> Column:
        a = acc["open"]
        unit = [f for f in _UNIT if f != "p"]

        def moved(x, p):
            return F.struct(*[x[f].alias(f) for f in unit], p.alias("p"))

        def snapped(p):
            return F.when(p < _EPS, 0.0).when(p > 1 - _EPS, 1.0).otherwise(p)

        def settle(s):
            whole = lambda p: (p == 0) | (p == 1)
            first, second = moved(a, s["pa"]), moved(b, s["pb"])
            nothing = F.lit(None).cast(unit_type)
            return (F.when(whole(s["pa"]) & whole(s["pb"]), F.struct(nothing.alias("open"), F.concat(acc["done"], F.array(first, second)).alias("done")))
                    .when(whole(s["pa"]), F.struct(second.alias("open"), F.concat(acc["done"], F.array(first)).alias("done")))
                    .otherwise(F.struct(first.alias("open"), F.concat(acc["done"], F.array(second)).alias("done"))))

        def exchange(m):
            up = b["u"] * (m["up"] + m["down"]) < m["down"]  # the open one gains with the probability that keeps its mean
            return _let(F.struct(
                snapped(F.when(up, a["p"] + m["up"] / a["size"]).otherwise(a["p"] - m["down"] / a["size"])).alias("pa"),
                snapped(F.when(up, b["p"] - m["up"] / b["size"]).otherwise(b["p"] + m["down"] / b["size"])).alias("pb")), settle)

        masses = F.struct(F.least((1 - a["p"]) * a["size"], b["p"] * b["size"]).alias("up"),
                          F.least(a["p"] * a["size"], (1 - b["p"]) * b["size"]).alias("down"))
        return F.when(a.isNull(), F.struct(b.alias("open"), acc["done"].alias("done"))).otherwise(_let(masses, exchange))

    return step


def _last(out: Column) -> Column:
    """All documents of a source's last block, the open one rounded.

    Of rounding it down or up, alone or with one other document of the block taken the other
    way, the choice is what leaves the source nearest to its target.
    """
    left, done = out["open"], out["done"]

    def choices(x: float):
        return F.transform(F.sequence(F.lit(0), F.size(done)), lambda i: F.struct(
            F.abs((F.lit(x) - left["p"]) * left["size"]
                  + F.when(i == 0, 0.0).otherwise(_let(F.get(done, i - 1), lambda d: (1 - 2 * d["p"]) * d["size"]))).alias("off"),
            i.alias("other"), F.lit(x).alias("p")))

    def taken(best):
        flipped = F.transform(done, lambda d, i: F.when(i + 1 == best["other"], d.withField("p", 1 - d["p"])).otherwise(d))
        return F.concat(flipped, F.array(left.withField("p", best["p"])))

    return _let(F.array_min(F.concat(choices(0.0), choices(1.0))), taken)


def copies(units: DataFrame, seed: int = 7) -> DataFrame:
    """Total `copies` of each unit (source, doc_id, size, rows, source_size, target), one row each."""
    ratio = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(2.0))).otherwise(0.0)
    mean = F.when(F.col("size") > 0, F.col("rows") * ratio).otherwise(0.0)
    level = save(units.withColumn("mean", mean).withColumn("whole", F.floor(F.col("mean") + _EPS).cast("long"))
                 .withColumn("p", F.greatest(F.lit(0.0), F.col("mean") - F.col("whole")))
                 .withColumn("p", F.when(F.col("p") < _EPS, 0.0).otherwise(F.col("p")))
                 .withColumn("u", uniform("source", "doc_id", "size", F.lit(seed)))
                 .select("source", *_UNIT), "mix-level")
    unit_type = level.select(F.struct(*_UNIT).alias("x")).schema["x"].dataType.simpleString()
    settled = [level.where("p = 0")]
    level = level.where("p > 0")
    for depth in range(1, 64):
        # one block per BLOCK open units of a source
        sizes = level.groupBy("source").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
        deal = level.join(sizes, level["source"].eqNullSafe(sizes["source"]), "inner").drop(sizes["source"])
        block = F.pmod(F.xxhash64("doc_id", "size", "source", F.lit(seed + depth)), F.col("blocks"))
        folded = (deal.withColumn("u", uniform("source", "doc_id", "size", F.lit(seed + 1000 * depth)))
                  .groupBy("source", block.alias("block"), "blocks").agg(F.array_sort(F.collect_list(F.struct(*_UNIT))).alias("units"))
                  .select("source", "blocks", F.aggregate(
                      "units", F.struct(F.lit(None).cast(unit_type).alias("open"), F.array().cast(f"array<{unit_type}>").alias("done")),
                      _exchange(unit_type)).alias("out")))
        folded = save(folded, "mix-level")
        done = F.when((F.col("blocks") > 1) | F.col("out.open").isNull(), F.col("out.done")).otherwise(_last(F.col("out")))
        settled.append(folded.select("source", F.explode(done).alias("x")).select("source", "x.*"))
        level = folded.where("blocks > 1 AND out.open IS NOT NULL").select("source", "out.open.*")
        if level.isEmpty():
            break
    done = reduce(DataFrame.unionByName, settled)
    return done.select("source", "doc_id", "size", "rows", "source_size", "target", (F.col("whole") + F.col("p").cast("long")).alias("copies"))


def mix(docs: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple[int, ...] = WEIGHTS, seed: int = 7) -> DataFrame:
    """Units of `docs` (doc_id, text, source) with their sizes, targets and copies."""
    units = save(only(docs, "source", "doc_id", "text").select("source", "doc_id", n_words().alias("size"))
                 .groupBy("source", "doc_id", "size").agg(F.count("*").alias("rows")), "mix-units")
    sources = units.groupBy("source").agg(F.sum(F.col("size") * F.col("rows")).alias("source_size"))
    targets = source_targets(sources, share, most, weights)
    joined = units.join(targets, units["source"].eqNullSafe(targets["source"])).drop(targets["source"])
    return copies(joined, seed)


def per_row(units: DataFrame) -> DataFrame:
    """One row per document: the copies of a unit spread over its rows."""
    row = units.withColumn("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))))
    return row.withColumn("copies", F.floor(F.col("copies") / F.col("rows")) + (F.col("row") <= F.col("copies") % F.col("rows")).cast("long")).drop("row", "rows")


#: Rows of a unit that are numbered in one piece, about.
UNIT_BUCKET = 65_536


def _shares(rows: DataFrame, columns: list[str]) -> DataFrame:
    """`rows` of units with several rows, once per different row, with `_times`, the copies of all its repeats.

    The rows of a unit stand in the order of a hash of all their columns, in buckets; the unit's copies are
    dealt over these places as by :func:`per_row`, so they depend on nothing but the rows.
    """
    unit = ["_s", "_d", "_n"]
    once = rows.groupBy(*columns, *unit, "_copies", "_rows").agg(F.count(F.lit(1)).alias("_c"))
    once = once.withColumn("_h", F.xxhash64(*columns)).withColumn("_b", F.pmod(F.xxhash64("_h"), F.ceil(F.col("_rows") / UNIT_BUCKET)))
    once = save(once, "mix-repeats")
    buckets = once.groupBy(*unit, "_b").agg(F.sum("_c").alias("_size"))
    before = Window.partitionBy(*unit).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)  # one row per bucket
    offsets = buckets.select(*[F.col(c).alias(f"{c}2") for c in (*unit, "_b")], F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_off"))
    inside = Window.partitionBy(*unit, "_b").orderBy("_h", "text").rowsBetween(Window.unboundedPreceding, -1)
    placed = once.withColumn("_in", F.coalesce(F.sum("_c").over(inside), F.lit(0)))
    same = [F.col(c).eqNullSafe(F.col(f"{c}2")) for c in (*unit, "_b")]
    placed = placed.join(offsets, reduce(lambda x, y: x & y, same)).withColumn("_at", F.col("_off") + F.col("_in"))
    more = F.least(F.col("_at") + F.col("_c"), F.col("_copies") % F.col("_rows")) - F.col("_at")
    times = F.col("_c") * F.floor(F.col("_copies") / F.col("_rows")) + F.greatest(F.lit(0), more)
    return placed.select(*columns, times.cast("int").alias("_times"))


def mix_documents(docs: DataFrame, **options) -> DataFrame:
    """The mixed documents: each row as often as it is taken; same columns.

    Rows that share source, id and size share their unit's copies in the order of a hash of the row;
    nothing depends on how the rows are partitioned.
    """
    docs, names = shelter(docs, "doc_id", "text", "source")
    chosen = save(mix(docs, **options), "mix-copies").select(
        F.col("source").alias("_s"), F.col("doc_id").alias("_d"), F.col("size").alias("_n"), F.col("copies").alias("_copies"), F.col("rows").alias("_rows"))
    sized = docs.withColumn("_words", n_words())
    same = sized["source"].eqNullSafe(chosen["_s"]) & sized["doc_id"].eqNullSafe(chosen["_d"]) & (sized["_words"] == chosen["_n"])
    # the copies grow with the documents: they are joined by a merge at every size
    met = sized.join(chosen.hint("merge"), same)
    if chosen.where("_rows > 1").isEmpty():
        taken = met.select(*docs.columns, F.col("_copies").cast("int").alias("_times"))
    else:
        taken = met.where("_rows = 1").select(*docs.columns, F.col("_copies").cast("int").alias("_times")).unionByName(_shares(met.where("_rows > 1"), docs.columns))
    return taken.where("_times > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_times")))).select(*docs.columns).toDF(*names)
