"""Exact and near-duplicate removal."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from chatloom.functions import canonical_text
from chatloom.operators.components import connected_components
from chatloom.operators.keep_first import stream_bucket_keep_first, stream_keep_first
from chatloom.session import HASHES, TEXTS, lasting, saved, saved_counted, saved_parts, scratch_block, share, shares, ship_package


def exact_dedup(samples: DataFrame, key=None) -> DataFrame:
    """Keep the first sample (lowest ``ord``) per canonical text; order is kept by ``ord``.

    A hash aggregate over ``(key, ord)`` alone, with partial (map-side) aggregation: a key
    that holds a third of all rows collapses to one row per map task before the shuffle. The
    texts join the winners by ``ord``. The group key is SHA-256 of the canonical text.
    """
    key = key if key is not None else F.sha2(canonical_text("messages"), 256)
    winners = samples.select(key.alias("_k"), "ord").groupBy("_k").agg(F.min("ord").alias("ord"))
    return samples.join(winners.select("ord"), "ord", "left_semi")


# ---------------------------------------------------------------------------
# Near duplicates
# ---------------------------------------------------------------------------

def token_sets(df: DataFrame, text=None) -> DataFrame:
    """``(ord, tokens, n_tokens)``: distinct lower-cased whitespace tokens.

    ``text`` defaults to the canonical sample text of ``messages``.
    """
    from chatloom.functions import tokens

    src = text if text is not None else canonical_text("messages")
    return df.select("ord", tokens(src).alias("tokens")).withColumn("n_tokens", F.size("tokens").cast("bigint"))


def _set_key() -> F.Column:
    return F.when(F.col("n_tokens") > 0, F.sha2(F.array_join(F.array_sort("tokens"), "\x00"), 256)).otherwise(
        F.concat(F.lit("empty:"), F.col("ord").cast("string")))


def collapse_identical_sets(sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Group identical non-empty token sets; the lowest ``ord`` represents each group.

    Returns ``(reps(rep, tokens, n_tokens), members(ord, rep))``. Copies of a set always
    lose to its first member under keep-first, so only representatives take part in the
    similarity join. The group key and ``ord`` alone are aggregated (a hash aggregate, partial
    where rows are read); token arrays join the winners. Empty sets are never duplicates and
    stay their own representatives.
    """
    keyed = sets.select("ord", _set_key().alias("_k"))
    first = saved(keyed.groupBy("_k").agg(F.min("ord").alias("rep")), "identical-sets")
    reps = sets.join(first.select(F.col("rep").alias("ord")), "ord").select(F.col("ord").alias("rep"), "tokens", "n_tokens")
    return reps, keyed.join(first, "_k").select("ord", "rep")


def _hashed(reps: DataFrame) -> DataFrame:
    """``(rep, n, toks)`` of non-empty sets: tokens as sorted 64-bit hashes."""
    return reps.where("n_tokens > 0").select("rep", F.col("n_tokens").alias("n"), F.array_sort(F.transform("tokens", lambda t: F.xxhash64(t))).alias("toks"))


def _need(n, threshold: float) -> F.Column:
    """Tokens that a set of ``n`` shares with any partner; the epsilon guards float error at exact products."""
    return F.ceil(n * F.lit(threshold) - F.lit(1e-9))


#: Tokens and postings that move in one exchange, about: more of them move in shares, so many at most, and the files of one go before the next.
SHARE_TOKENS, TOKEN_SHARES = 1 << 22, 4
SHARE_POSTINGS, POSTING_SHARES = 1 << 20, 8


def _token_shares(sets: DataFrame) -> int:
    return shares(sets.agg(F.sum("n")).first()[0], SHARE_TOKENS, TOKEN_SHARES)


def _collapsed_hashes(sets: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """:func:`collapse_identical_sets` with the sets as hashes → ``(hashed(rep, n, toks), reps(rep), members(ord, rep))``.

    The strings of the tokens are not written: a row is saved with the key of its set and the hashes, until
    the sets that are left are.
    """
    hashes = F.array_sort(F.transform("tokens", lambda t: F.xxhash64(t)))
    with scratch_block(sets.sparkSession) as keep:
        own = sets.select("ord", _set_key().alias("_k"), F.col("n_tokens").alias("n"), hashes.alias("toks"))
        keyed = saved_parts(sets.sparkSession, [lambda: own], "near-keyed", HASHES)
        names = keep(saved(keyed.select("ord", "_k"), "near-names"))
        first = keep(saved(names.groupBy("_k").agg(F.min("ord").alias("rep")), "identical-sets"))
        repeated = not names.groupBy("ord").agg(F.count(F.lit(1)).alias("m")).where("m > 1").isEmpty()
        of = _token_shares(keyed)

        def part(i: int) -> DataFrame:
            reps = share(first.select(F.col("rep").alias("ord")), "ord", i, of)
            own = share(keyed.where("n > 0"), "ord", i, of).join(reps, "ord", "left_semi")
            own = own.dropDuplicates(["ord", "_k"]) if repeated else own  # rows that repeat an id and its set are one set
            return own.select(F.col("ord").alias("rep"), "n", "toks")

        hashed = keep(saved_parts(sets.sparkSession, [partial(part, i) for i in range(of)], "near-hashed", HASHES))
    return hashed, first.select("rep"), names.join(first, "_k").select("ord", "rep")


#: 64-bit words of a set's sketch.
SKETCH_WORDS = 8
_SKETCH = [f"s{i}" for i in range(SKETCH_WORDS)]
#: The most frequent tokens, whose counts every task holds: those in more than 1 / FREQUENT of all places, so fewer than FREQUENT.
FREQUENT = 1 << 16
#: Tokens behind the prefix by which keys can be made longer.
LONGER = 3


def _marked(hashed: DataFrame, frequent: tuple[np.ndarray, np.ndarray], threshold: float) -> DataFrame:
    """``(rep, n, rare, known, s0, ...)`` of sets: tokens that are not frequent, and the least frequent ones of the others where the former do not fill the prefix."""
    by_count = np.lexsort(frequent)
    rank = np.empty(len(by_count), np.int64)
    rank[by_count] = np.arange(len(by_count))
    order = np.argsort(frequent[0])
    names, rank = frequent[0][order], rank[order]
    bits = 64 * SKETCH_WORDS

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.column(1).to_numpy()
            toks = batch.column(2).flatten().to_numpy()
            of = np.repeat(np.arange(len(n)), n)
            at = np.minimum(np.searchsorted(names, toks), max(len(names) - 1, 0))
            often = names[at] == toks if len(names) else np.zeros(len(toks), bool)
            rare = np.bincount(of[~often], minlength=len(n))
            lack = n - np.ceil(n * threshold - 1e-9).astype(np.int64) + 1 + LONGER - rare
            pick = np.flatnonzero(often & (lack[of] > 0))
            pick = pick[np.lexsort((rank[at[pick]], of[pick]))]
            many = np.bincount(of[pick], minlength=len(n))
            place = np.arange(len(pick)) - np.repeat(np.cumsum(many) - many, many)
            pick = pick[place < lack[of[pick]]]
            many = np.bincount(of[pick], minlength=len(n))
            odd = np.bincount(of * bits + (toks & (bits - 1)), minlength=len(n) * bits).astype(np.uint8) & 1
            words = np.packbits(odd).view(np.int64).reshape(len(n), SKETCH_WORDS)
            lists = [pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(size))), pa.int32()), pa.array(values, pa.int64()))
                     for size, values in ((rare, toks[~often]), (many, toks[pick]))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *lists, *(pa.array(words[:, i], pa.int64()) for i in range(SKETCH_WORDS))],
                                             names=["rep", "n", "rare", "known", *_SKETCH])

    ship_package(hashed.sparkSession)
    return hashed.select("rep", "n", "toks").mapInArrow(run, "rep long, n long, rare array<long>, known array<long>, " + ", ".join(f"{w} long" for w in _SKETCH))


def prefix_sets(hashed: DataFrame, threshold: float) -> DataFrame:
    """Sets that may have a partner → ``(rep, n, size, toks, lead, s0, ...)``, saved.

    ``toks`` are the first ``lead + LONGER`` of the ``size`` tokens that stand in two sets or more, by (number of
    sets, hash). Tokens of one set only come first in that order, match nothing and fill prefix places, so the
    prefix has ``lead`` places left for shared ones; a set with none left has no partner. The sketch holds the
    parity of the set's tokens per bit: two sets differ in at least as many tokens as bits.

    The counts of frequent tokens, a bounded number, are held by every task, so these tokens move only
    where a prefix needs them; the others meet their counts in a join.
    """
    shared = saved(hashed.select(F.explode("toks").alias("tok")).groupBy("tok").agg(F.count(F.lit(1)).alias("sets")).where("sets > 1"), "near-counts")
    places = hashed.agg(F.sum("n")).first()[0] or 0
    least, of = places // FREQUENT, shares(places, SHARE_TOKENS, TOKEN_SHARES)
    often = shared.where(F.col("sets") > least).toPandas()
    often = often["tok"].to_numpy(np.int64), often["sets"].to_numpy(np.int64)

    def part(i: int) -> DataFrame:
        marked = _marked(share(hashed, "rep", i, of), often, threshold)
        rare = marked.select("rep", F.explode("rare").alias("tok")).join(shared.where(F.col("sets") <= least), "tok")
        rare = rare.groupBy("rep").agg(F.sort_array(F.collect_list(F.struct("sets", "tok"))).alias("_s"))
        heads = marked.select("rep", "n", F.size("rare").alias("_rare"), "known", *_SKETCH)
        ranked = heads.join(rare, "rep", "left").withColumn("_s", F.coalesce(F.transform("_s", lambda x: x["tok"]), F.array().cast("array<long>")))
        size = F.col("n") - F.col("_rare") + F.size("_s")
        ranked = ranked.select("rep", "n", size.cast("int").alias("size"), F.concat("_s", "known").alias("toks"),
                               (size - _need(F.col("n"), threshold) + 1).cast("int").alias("lead"), *_SKETCH).where("lead > 0")
        return ranked.withColumn("toks", F.slice("toks", F.lit(1), F.col("lead") + LONGER))

    return saved_parts(hashed.sparkSession, [partial(part, i) for i in range(of)], "near-ranked")


def prefix_postings(sets: DataFrame) -> DataFrame:
    """Postings ``(key, rep, n, rest, pos, s0, ...)`` of the prefix tokens of :func:`prefix_sets`.

    ``rest``, the number of shared tokens from the key on, bounds the overlap of two sets whose
    first common token it is.
    """
    places = sets.select("rep", "n", "size", *_SKETCH, F.posexplode(F.slice("toks", F.lit(1), F.col("lead"))).alias("pos", "key"))
    return places.select("key", "rep", F.col("n").cast("int").alias("n"), (F.col("size") - F.col("pos")).alias("rest"), "pos", *_SKETCH)


def _may_be_similar(x: str, y: str, threshold: float, sketched: bool = True) -> F.Column:
    """Length filter, positional filter of a common key, and the sketches' bound on the overlap."""
    nx, ny = F.col(f"{x}.n"), F.col(f"{y}.n")
    overlap = F.ceil((nx + ny) * F.lit(threshold / (1 + threshold)) - F.lit(1e-9))
    may = (F.least(nx, ny) >= F.lit(threshold) * F.greatest(nx, ny) - F.lit(1e-9)) & (F.least(f"{x}.rest", f"{y}.rest") >= overlap)
    if not sketched:
        return may
    differ = sum((F.bit_count(F.col(f"{x}.{w}").bitwiseXOR(F.col(f"{y}.{w}"))) for w in _SKETCH), F.lit(0))
    return may & (nx + ny - differ >= overlap * 2)


def verify_pairs(cands: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Exact Jaccard of candidate pairs of ``sets(rep, n, toks)``; keeps those ≥ ``threshold`` → ``(a, b, jaccard)``.

    ``toks`` may leave out tokens that no other set has.
    """
    ta = sets.select(F.col("rep").alias("a"), F.col("n").alias("na"), F.col("toks").alias("ta"))
    tb = sets.select(F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("toks").alias("tb"))
    j = cands.join(ta, "a").join(tb, "b")
    return _similar(j, threshold)


def _similar(j: DataFrame, threshold: float) -> DataFrame:
    inter = F.size(F.array_intersect("ta", "tb"))
    jac = inter / (F.col("na") + F.col("nb") - inter)
    return j.select("a", "b", jac.alias("jaccard")).where(F.col("jaccard") >= F.lit(threshold))


def _with_sets(rows: DataFrame, sets: DataFrame, on: str, i: int, of: int) -> DataFrame:
    """A share of ``rows`` joined with their sets ``(rep, n, toks)``, named by ``on``."""
    return share(rows, on, i, of).join(share(sets.withColumnRenamed("rep", on), on, i, of), on)


def _verified(cands: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """:func:`verify_pairs`, saved; the tokens of many sets move in shares, once to the lower and once to the higher ends."""
    spark, of = sets.sparkSession, _token_shares(sets)
    if of == 1:
        return saved(verify_pairs(cands, sets, threshold), "near-links")
    a = sets.select("rep", F.col("n").alias("na"), F.col("toks").alias("ta"))
    b = sets.select("rep", F.col("n").alias("nb"), F.col("toks").alias("tb"))
    with scratch_block(spark) as keep:
        lower = saved_parts(spark, [partial(_with_sets, cands, a, "a", i, of) for i in range(of)], "near-lower", HASHES)
        return keep(saved_parts(spark, [lambda i=i: _similar(_with_sets(lower, b, "b", i, of), threshold) for i in range(of)], "near-links"))


def _ordered(met: DataFrame) -> DataFrame:
    """Distinct ``(a, b)``, a < b, of joined rows ``x`` and ``y``."""
    pairs = met.select(F.least("x.rep", "y.rep").alias("a"), F.greatest("x.rep", "y.rep").alias("b"))
    return pairs.groupBy("a", "b").count().select("a", "b")


def _pairs(x: DataFrame, y: DataFrame, on: list[str], cond: F.Column) -> DataFrame:
    """Distinct ``(a, b)``, a < b, of rows ``x`` and ``y`` that agree on ``on``."""
    return _ordered(x.alias("x").join(y.alias("y"), on).where(cond))


#: Postings of a key that meet in one piece of a join.
KEY_BLOCK = 2048


def _key_pairs(entry: DataFrame, cond: F.Column, block: int | None = None) -> DataFrame:
    """Distinct ``(a, b)`` of entries that share a key, each pair of entries looked at once per key.

    The entries of a key are salted into blocks of about ``block`` and every two blocks meet on their
    own, so a key with any number of entries is spread over tasks of at most twice that many rows.
    """
    block = block or KEY_BLOCK
    large = entry.groupBy("key").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > block)
    large = saved(large.select("key", F.ceil(F.col("m") / block).alias("_blocks")), "near-large-keys")
    # both sides are one exchange
    own = entry.join(large, "key", "left_anti") if not large.isEmpty() else entry
    met = own.alias("x").join(own.alias("y"), "key").where((F.col("x.rep") < F.col("y.rep")) & cond).select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b"))
    if large.isEmpty():
        return met.groupBy("a", "b").count().select("a", "b")
    dealt = entry.join(large, "key").withColumn("_mine", F.pmod(F.xxhash64("rep", "key"), F.col("_blocks")))
    x = dealt.withColumn("_i", F.col("_mine")).withColumn("_j", F.explode(F.sequence(F.col("_mine"), F.col("_blocks") - 1)))
    y = dealt.withColumn("_j", F.col("_mine")).withColumn("_i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_mine"))))
    once = (F.col("_i") < F.col("_j")) | (F.col("x.rep") < F.col("y.rep"))
    far = x.alias("x").join(y.alias("y"), ["key", "_i", "_j"]).where(once & cond).select(F.least("x.rep", "y.rep").alias("a"), F.greatest("x.rep", "y.rep").alias("b"))
    return met.unionByName(far).groupBy("a", "b").count().select("a", "b")


def _met_by_shares(entry: DataFrame, met: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Distinct ``(a, b)`` that ``met`` finds among entries, a share of the keys at a time; saved, and left to be read again."""
    of = shares(entry.count(), SHARE_POSTINGS, POSTING_SHARES)
    with scratch_block(entry.sparkSession) as keep:
        found = saved_parts(entry.sparkSession, [lambda i=i: met(share(entry, "key", i, of)) for i in range(of)], "near-met")
        found = keep(found if of == 1 else saved(found.groupBy("a", "b").count().select("a", "b"), "near-met"))
    return lasting(found)


def band_keys(reps: DataFrame, threshold: float, num_perm: int = 128, bands: tuple[int, int] | None = None) -> DataFrame:
    """``(rep, keys)``: the band slices of each MinHash signature, hashed with their band number (D3)."""
    from chatloom.operators.minhash import lsh_params, minhash_udf, token_hashes

    b, r = bands or lsh_params(threshold, num_perm)
    sig = reps.select("rep", minhash_udf(num_perm)(token_hashes(F.col("tokens"), F.col("rep"))).alias("sig"))
    return sig.select("rep", F.transform(F.sequence(F.lit(0), F.lit(b - 1)), lambda i: F.xxhash64(i, F.slice("sig", i * r + 1, r))).alias("keys"))


def lsh_candidates(reps: DataFrame, threshold: float, num_perm: int = 128, bands: tuple[int, int] | None = None) -> DataFrame:
    """Pairs ``(a, b)`` whose MinHash signatures agree on at least one whole band (D4 lsh).

    As large as its answer; :func:`bucket_keep_first` decides without pairs.
    """
    keys = saved(band_keys(reps, threshold, num_perm, bands), "lsh-keys")
    return _key_pairs(keys.select("rep", F.explode("keys").alias("key")), F.lit(True))


def minhash_signatures(sets: DataFrame, num_perm: int = 128) -> DataFrame:
    from chatloom.operators.minhash import minhash_udf, token_hashes

    return sets.select("ord", minhash_udf(num_perm)(token_hashes(F.col("tokens"), F.col("ord"))).alias("signature"))


def near_dup_pairs(sets: DataFrame, threshold: float = 0.85) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All similar pairs of representatives → ``(pairs(a, b, jaccard), reps, members)``.

    Pairs between copies follow from ``members`` and are not written out. The pair table is as
    large as its answer; the keep-first decision (:func:`near_dedup`) does not need it.
    """
    hashed, reps, members = _collapsed_hashes(sets)
    entry = prefix_postings(prefix_sets(hashed, threshold))
    may = _may_be_similar("x", "y", threshold)
    pairs = _verified(_met_by_shares(entry, lambda own: _key_pairs(own, may)), hashed, threshold)
    return pairs, sets.withColumnRenamed("ord", "rep").join(reps, "rep").select("rep", "tokens", "n_tokens"), members


def greedy_keep_first(pairs: DataFrame) -> DataFrame:
    """Nodes of the pair graph dropped by sequential keep-first → ``(x)``.

    A node is dropped iff some *kept* lower neighbour exists. Rounds: a node whose lower
    neighbours are all decided and none kept is kept; a node with a kept lower neighbour
    is dropped. This equals the sequential scan because a node's fate depends only on
    lower nodes. Rounds read the narrow pair table alone and follow the longest chain of
    open neighbours; a round that decides nothing would be a bug and is an error.
    """
    edges = saved(pairs.select("a", "b"), "greedy-edges")
    nodes = edges.select(F.col("a").alias("x")).union(edges.select(F.col("b").alias("x"))).distinct()
    # status: 0 undecided, 1 kept, 2 dropped
    status = saved(nodes.withColumn("s", F.lit(0)), "greedy-status")
    open_nodes = status.count()
    while open_nodes:
        low = (edges.join(status.withColumnRenamed("x", "a"), "a")
               .groupBy(F.col("b").alias("x"))
               .agg(F.max((F.col("s") == 1).cast("int")).alias("any_kept"),
                    F.max((F.col("s") == 0).cast("int")).alias("any_open")))
        status = saved(status.join(low, "x", "left").select(
            "x", F.when(F.col("s") != 0, F.col("s")).when(F.coalesce("any_kept", F.lit(0)) == 1, F.lit(2))
            .when(F.coalesce("any_open", F.lit(0)) == 0, F.lit(1)).otherwise(F.lit(0)).alias("s")), "greedy-status")
        before, open_nodes = open_nodes, status.where("s = 0").count()
        if open_nodes == before:
            raise RuntimeError("a round of keep-first decided nothing")
    return status.where("s = 2").select("x")


def _star_pairs(entry: DataFrame, cond: F.Column, block: int = 64) -> DataFrame:
    """Pairs of each entry of a key with the key's lowest and with one drawn from its block; linear in the entries."""
    row = F.struct(*[c for c in entry.columns if c != "key"])
    lowest = entry.groupBy("key").agg(F.min(F.struct("rep", row.alias("row"))).alias("c"), F.count(F.lit(1)).alias("m")).where("m > 1")
    first = entry.alias("x").join(lowest.select("key", "c.row.*").alias("y"), "key").where((F.col("x.rep") != F.col("y.rep")) & cond)
    # a key of few entries has its lowest; in a larger one the lowest may lie in another cluster
    many = lowest.where("m > 8").select("key", F.ceil(F.col("m") / block).alias("blocks"))
    dealt = entry.join(many, "key").withColumn("block", F.pmod(F.xxhash64("rep", "key"), F.col("blocks"))).drop("blocks")
    drawn = dealt.groupBy("key", "block").agg(F.min(F.struct(F.xxhash64("rep").alias("draw"), row.alias("row"))).alias("c")).select("key", "block", "c.row.*")
    second = dealt.alias("x").join(drawn.alias("y"), ["key", "block"]).where((F.col("x.rep") != F.col("y.rep")) & cond)
    ends = [F.least("x.rep", "y.rep").alias("a"), F.greatest("x.rep", "y.rep").alias("b")]
    return first.select(*ends).unionByName(second.select(*ends)).groupBy("a", "b").count().select("a", "b")


def _labels(links: DataFrame) -> DataFrame:
    """``(rep, label)`` of every linked set: the least one within a few links; saved. Equal labels imply one component."""
    both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(links.select(F.col("b").alias("u"), F.col("a").alias("v")))
    near = saved(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "near-least")
    next_ = both.join(near.select(F.col("u").alias("v"), "m"), "v").groupBy("u").agg(F.min("m").alias("m2"))
    two = saved(near.join(next_, "u").select("u", F.least("m", "m2").alias("m")), "near-least")
    jump = two.select(F.col("u").alias("m"), F.col("m").alias("m3"))
    return saved(two.join(jump, "m").select(F.col("u").alias("rep"), F.col("m3").alias("label")), "near-label")


def _longer_keys(entry: DataFrame, sets: DataFrame, threshold: float, level: int, hot: int) -> DataFrame | None:
    """Postings with every key of more than ``hot`` entries lengthened by one more token; None without such a key.

    Two sets that share ``level`` tokens share their first ``level`` common ones within a prefix
    that is ``level - 1`` longer, so similar sets still meet; sets that may be similar with fewer
    common tokens keep their key among themselves.
    """
    hot_keys = entry.groupBy("key").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > hot).select("key")
    if hot_keys.isEmpty():
        return None
    hot_rows = entry.join(hot_keys, "key", "left_semi")
    grown = hot_rows.join(sets.select("rep", "toks", "lead"), "rep")
    last = F.least(F.col("lead") + level - 2, F.size("toks") - 1)
    grown = grown.where(F.col("pos") < last).withColumn("pos2", F.explode(F.sequence(F.col("pos") + 1, last)))
    grown = grown.withColumn("key", F.xxhash64("key", F.get("toks", F.col("pos2")))).withColumn("pos", F.col("pos2")).select(entry.columns)
    short = hot_rows.where(_need(F.col("n"), threshold) < level).withColumn("key", F.xxhash64("key", F.lit(f"short-{level}"))).select(entry.columns)
    return entry.join(hot_keys, "key", "left_anti").select(entry.columns).unionByName(grown).unionByName(short)


def _open(entry: DataFrame) -> DataFrame:
    """Entries of keys that hold several labels."""
    several = entry.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("key")
    return entry.join(several, "key", "left_semi")


#: Keys of more entries have stars first.
STAR_KEYS = 256
#: Keys of more entries are made longer.
HOT_KEYS = 1 << 16


def similar_components(entry: DataFrame, sets: DataFrame, threshold: float, ranked: DataFrame | None = None) -> DataFrame:
    """``(rep, comp)`` of every set that is similar to another one with which it shares a key; saved.

    In keys of more than ``STAR_KEYS`` entries stars join the entries to a few single centres, and what is
    verified labels sets by the least one within a few links. Entries of different labels then meet,
    block by block, those of very hot prefix tokens (``ranked`` has the prefixes) made longer first. No similar pair lies
    between two components in the end; a cluster of near copies costs about as much as it has members.
    """
    may = _may_be_similar("x", "y", threshold, sketched=ranked is not None)
    crowded = saved(entry.groupBy("key").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > STAR_KEYS), "near-crowded")
    if crowded.isEmpty():
        met = _met_by_shares(entry, lambda own: _key_pairs(own, may))
        links = _verified(met, sets, threshold).select("a", "b")
        found = connected_components(links).toDF("rep", "comp")
        return saved(found, "near-components")
    stars = _met_by_shares(entry, lambda own: _star_pairs(own.join(crowded.select("key"), "key", "left_semi"), may))
    links = _verified(stars, sets, threshold).select("a", "b")
    label = _labels(links)
    hot = ranked is not None and not crowded.where(F.col("m") > HOT_KEYS).isEmpty()

    def across(own: DataFrame) -> DataFrame:
        marked = own.join(label, "rep", "left").withColumn("label", F.coalesce("label", "rep")).select(*entry.columns, "label")
        left = saved(_open(marked), "near-open") if hot else marked
        for k in range(2, LONGER + 2) if hot else ():
            longer = _longer_keys(left, ranked, threshold, k, HOT_KEYS)
            if longer is None:
                break
            left = saved(_open(longer), "near-open")
        return _key_pairs(left, (F.col("x.label") != F.col("y.label")) & may)

    more = _verified(_met_by_shares(entry, across), sets, threshold).select("a", "b")
    links = links.unionByName(more)
    # what is left to connect are labels
    la, lb = label.toDF("a", "la"), label.toDF("b", "lb")
    met = links.join(la, "a", "left").join(lb, "b", "left").select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b"))
    edges = met.unionByName(label.toDF("a", "b"))
    found = connected_components(edges).toDF("label", "comp")
    nodes = links.select(F.col("a").alias("rep")).unionByName(links.select(F.col("b").alias("rep"))).distinct().join(label, "rep", "left")
    nodes = nodes.select("rep", F.coalesce("label", "rep").alias("label")).join(found, "label", "left")
    return saved(nodes.select("rep", F.coalesce("comp", "label").alias("comp")), "near-components")


#: Tokens (or keys) of a component that one task decides as a stream; larger ones are decided by joins.
STREAM_TOKENS = 4 << 20


def _split_by_size(members: DataFrame, sized: DataFrame, bound: int) -> tuple[DataFrame, DataFrame | None]:
    """``members(rep, comp)`` of components of at most ``bound`` in ``sized(rep, w)``, and of larger ones (None: there are none)."""
    large = saved(members.join(sized, "rep").groupBy("comp").agg(F.sum("w").alias("w")).where(F.col("w") > bound).select("comp"), "near-large")
    if large.isEmpty():
        return members, None
    return members.join(large, "comp", "left_anti"), members.join(large, "comp", "left_semi")


def keep_first(entry: DataFrame, sets: DataFrame, threshold: float, ranked: DataFrame | None = None, bound: int | None = None) -> DataFrame:
    """Sets dropped by sequential keep-first → ``(x)``; sets are similar when they share a key and verify.

    A component's sets come sorted to one task, which keeps sketches and tokens of the sets it has
    kept, and drops what is similar to one of them: one pass, however long chains are. Components
    of more than ``bound`` tokens are decided by joins (:func:`_keep_first_wide`).
    """
    bound = STREAM_TOKENS if bound is None else bound
    members = similar_components(entry, sets, threshold, ranked)
    prefixed = ranked is not None
    small, large = _split_by_size(members, sets.select("rep", F.col("n").alias("w")), bound)
    columns = ["comp", "rep", "n", "toks"] + ([] if prefixed else ["keys"])
    of = _token_shares(sets)
    rows = small.join(sets, "rep") if of == 1 else saved_parts(sets.sparkSession, [partial(_with_sets, small, sets, "rep", i, of) for i in range(of)], "near-members", HASHES)
    dropped = stream_keep_first(rows.select(*columns), threshold)
    return dropped if large is None else dropped.unionByName(_keep_first_wide(saved(large, "near-large"), entry, sets, threshold, prefixed))


def _met_lowest(own: DataFrame, open_sets: DataFrame, lowest: DataFrame) -> DataFrame:
    return _pairs(own.join(open_sets, "rep"), own.join(lowest, "rep"), ["comp", "key"], F.col("x.rep") != F.col("y.rep"))


def _keep_first_wide(open_sets: DataFrame, entry: DataFrame, sets: DataFrame, threshold: float, sketched: bool, waves: int = 3) -> DataFrame:
    """:func:`keep_first` of large components ``open_sets(rep, comp)`` by joins.

    In each of a few waves the lowest open set of a component is kept, as nothing lower can be
    similar to it, and drops what is similar to it. What is still open is paired within its
    component, verified once, and decided on the pair table.
    """
    dropped = None
    for _ in range(waves):
        lowest = saved(open_sets.groupBy("comp").agg(F.min("rep").alias("rep")), "near-lowest")
        met = _met_by_shares(entry, partial(_met_lowest, open_sets=open_sets, lowest=lowest))
        gone = _verified(met, sets, threshold).select(F.col("b").alias("x"))
        dropped = gone if dropped is None else dropped.unionByName(gone)
        decided = gone.unionByName(lowest.select(F.col("rep").alias("x")))
        open_sets = saved(open_sets.join(decided.withColumnRenamed("x", "rep"), "rep", "left_anti"), "near-undecided")
        if open_sets.isEmpty():
            return dropped
    within = (F.col("x.comp") == F.col("y.comp")) & _may_be_similar("x", "y", threshold, sketched)
    rest = _met_by_shares(entry, lambda own: _key_pairs(own.join(open_sets, "rep").withColumn("key", F.xxhash64("comp", "key")), within))
    return dropped.unionByName(greedy_keep_first(_verified(rest, sets, threshold)))


def bucket_keep_first(keyed: DataFrame, bound: int | None = None) -> DataFrame:
    """Sets of ``keyed(rep, keys)`` dropped by sequential keep-first when sharing a key is similarity itself → ``(x)``.

    Sets that share keys make components (each key's entries point at its lowest); a component comes
    sorted to one task, which holds the keys of the sets it has kept. Components of more than
    ``bound`` keys are decided in rounds over their postings.
    """
    bound = STREAM_TOKENS if bound is None else bound
    keyed = saved(keyed.select("rep", "keys"), "bucket-keys")
    places = keyed.select("rep", F.explode(F.array_distinct("keys")).alias("key"))
    low = places.groupBy("key").agg(F.min("rep").alias("low"), F.count(F.lit(1)).alias("m")).where("m > 1").select("key", "low")
    members = saved(connected_components(places.join(low, "key"), "rep", "low").toDF("rep", "comp"), "bucket-components")
    small, large = _split_by_size(members, keyed.select("rep", F.size("keys").alias("w")), bound)
    dropped = stream_bucket_keep_first(small.join(keyed, "rep").select("comp", "rep", "keys"))
    return dropped if large is None else dropped.unionByName(_bucket_rounds(places.join(large.select("rep"), "rep")))


def _bucket_rounds(places: DataFrame) -> DataFrame:
    """:func:`bucket_keep_first` of postings ``(rep, key)`` by joins.

    Each round keeps the sets that are the lowest open one of all their keys and drops the other
    members of these keys; it reads the open postings once and writes no pairs.
    """
    places, dropped = saved(places.select("key", "rep"), "bucket-places"), None
    left = places.count()
    while left:
        low = places.groupBy("key").agg(F.min("rep").alias("low"))
        marked = saved(places.join(low, "key"), "bucket-marked")
        kept = saved(marked.groupBy("rep").agg(F.max((F.col("rep") != F.col("low")).cast("int")).alias("blocked")).where("blocked = 0").select("rep"), "bucket-kept")
        gone = saved(marked.join(kept.withColumnRenamed("rep", "low"), "low", "left_semi").where("rep <> low").select("rep").distinct(), "bucket-gone")
        dropped = gone if dropped is None else dropped.unionByName(gone)
        places = saved(places.join(kept.unionByName(gone), "rep", "left_anti"), "bucket-places")
        before, left = left, places.count()
        if left == before:
            raise RuntimeError("a round of keep-first decided nothing")
    return (dropped if dropped is not None else places.select("rep")).withColumnRenamed("rep", "x")


def near_dedup(df: DataFrame, threshold: float = 0.85, mode: str = "exact", text=None, verify: bool = True) -> DataFrame:
    """Keep-first near-duplicate removal (D5): drop a row only when it is similar to an
    earlier *kept* row. Rows come back with their columns; order key is ``ord``.

    ``mode="exact"`` finds every similar pair by the prefix filter; ``mode="lsh"`` takes sets
    that share a MinHash band, verified by their Jaccard similarity or not.
    """
    if not (0.0 < threshold <= 1.0):
        raise ValueError(f"similarity_threshold must be in (0.0, 1.0], got {threshold!r}")
    with scratch_block(df.sparkSession) as keep:
        if mode == "exact":
            sets, reps, _ = _collapsed_hashes(token_sets(df, text))
            ranked = prefix_sets(sets, threshold)
            dropped = keep_first(prefix_postings(ranked), sets, threshold, ranked)
        elif mode == "lsh":
            reps, _ = collapse_identical_sets(saved(token_sets(df, text), "near-sets"))
            bands = band_keys(reps, threshold)
            if verify:
                sets = saved(_hashed(reps).join(bands, "rep"), "near-hashed")
                postings = sets.select(F.explode("keys").alias("key"), "rep", "n", F.col("n").alias("rest"))
                dropped = keep_first(postings, sets, threshold)
            else:
                dropped = bucket_keep_first(bands)
        else:
            raise ValueError(f"unknown near-dup mode {mode!r}")
        # the answer needs no other table
        kept = keep(saved(reps.select(F.col("rep").alias("ord")).join(dropped.withColumnRenamed("x", "ord"), "ord", "left_anti"), "near-kept"))
    return df.join(kept, "ord", "left_semi")


def length_filtered(parts: list[DataFrame], min_assistant_chars: int = 50) -> tuple[DataFrame, dict[str, int]]:
    """The length filter of samples in parts, saved, and the counts ``before`` and ``filtered``; the input is evaluated once."""
    from chatloom.operators.validate import min_answer_filter

    before, after = ([Observation() for _ in parts] for _ in range(2))
    rows = F.count(F.lit(1)).alias("n")

    def part(i: int) -> DataFrame:
        return min_answer_filter(parts[i].observe(before[i], rows), min_assistant_chars).observe(after[i], rows)

    filtered = saved_parts(parts[0].sparkSession, [partial(part, i) for i in range(len(parts))], "filtered", TEXTS)
    return filtered, {"before": sum(int(x.get["n"]) for x in before), "filtered": sum(int(x.get["n"]) for x in after)}


def deduped(filtered: DataFrame, similarity_threshold: float = 0.85, mode: str = "exact") -> tuple[DataFrame, int]:
    """Near-duplicate removal (``mode='exact_text'`` = exact dedup only), saved and counted; ``filtered`` is read twice."""
    kept = exact_dedup(filtered) if mode == "exact_text" else near_dedup(filtered, similarity_threshold, mode)
    return saved_counted(kept, "deduped", TEXTS)


def dedup_and_filter(samples: DataFrame, similarity_threshold: float = 0.85, min_assistant_chars: int = 50,
                     mode: str = "exact") -> tuple[DataFrame, dict[str, int]]:
    """Length filter, then near-duplicate removal (``mode='exact_text'`` = exact dedup only), both saved.

    Returns the samples and the counts ``before``, ``filtered`` and ``after``, observed as the stages
    are written; the input is evaluated once. Of the tables on the way none is left.
    """
    if not (0.0 < similarity_threshold <= 1.0):
        raise ValueError(f"similarity_threshold must be in (0.0, 1.0], got {similarity_threshold!r}")
    with scratch_block(samples.sparkSession) as keep:
        filtered, counts = length_filtered([samples], min_assistant_chars)
        kept, n_kept = deduped(filtered, similarity_threshold, mode)
        keep(kept)
    return kept, counts | {"after": n_kept}
