"""Candidate pairs ``(i, j)`` with ``i < j``, each once.

A hot key doesn't go to one task: blocks above ``SPLIT`` records are dealt into chunks
and joined chunk pair by chunk pair, so every join key has a bounded number of rows on
each side.  Guards look at block sizes, never at pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kinlake.functions.text import clean, pairs_of, prefix_key
from kinlake.operators.ordering import global_rank, running_total
from kinlake.session import BROADCAST_ROWS, stash

MAX_PAIRS = 2_000_000
SPLIT = 2_000
SEEDS = 1_500
WINDOW = 20


class PairBudgetExceeded(ValueError):
    """More candidate pairs than allowed."""


def keyed(records: DataFrame, key: Column, rid: str = "rid") -> DataFrame:
    """``(rid, key)`` of the records that have a key."""
    return records.select(F.col(rid).alias("rid"), key.alias("key")).where("key IS NOT NULL")


def block_sizes(keys: DataFrame) -> DataFrame:
    """``(key, size, pairs)``."""
    return keys.groupBy("key").agg(F.count("*").alias("size")).withColumn("pairs", pairs_of("size"))


def count_pairs(keys: DataFrame) -> int:
    return block_sizes(keys).agg(F.coalesce(F.sum("pairs"), F.lit(0)).alias("n")).first()["n"]


def agreeing_pairs(keys: DataFrame, value: str) -> DataFrame:
    """One row ``(pairs, agreeing)``: how many pairs equal keys make, and how many of those agree in a
    ``value`` that isn't NULL, from sizes alone."""
    cells = keys.where("key IS NOT NULL").groupBy("key", value).agg(F.count("*").alias("n"))
    same = F.sum(F.when(F.col(value).isNotNull(), pairs_of("n")).otherwise(0))
    sizes = cells.groupBy("key").agg(F.sum("n").alias("size"), same.alias("same"))
    return sizes.agg(F.coalesce(F.sum(pairs_of("size")), F.lit(0)).alias("pairs"), F.coalesce(F.sum("same"), F.lit(0)).alias("agreeing"))


def all_pair_sums(records: DataFrame, rid: str = "rid") -> DataFrame:
    """One row ``(pairs, sum_i, sum_j)`` of :func:`block_all` without a pair made: an id is the larger
    end of as many pairs as ids are below it, the smaller of as many as are above."""
    ids = records.where(F.col(rid).isNotNull()).groupBy(F.col(rid).cast("long").alias("rid")).agg(F.count("*").alias("n"))
    placed = running_total(ids, [F.col("rid")], F.col("n"), "below")
    total = placed.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"))
    made, above = F.col("n") * F.col("below"), F.col("n") * (F.col("total") - F.col("below") - F.col("n"))
    sums = placed.join(F.broadcast(total)).agg(F.sum(made).alias("pairs"), F.sum(F.col("rid") * above).alias("sum_i"), F.sum(F.col("rid") * made).alias("sum_j"))
    some = F.col("pairs") > 0
    return sums.select(F.coalesce("pairs", F.lit(0)).alias("pairs"), F.when(some, F.col("sum_i")).alias("sum_i"), F.when(some, F.col("sum_j")).alias("sum_j"))


def guard(count: int, max_pairs: int | None) -> None:
    if max_pairs is not None and count > max_pairs:
        raise PairBudgetExceeded(f"pair budget exceeded: {count} > {max_pairs}")


def pairs_within(keys: DataFrame, split: int = SPLIT) -> DataFrame:
    """All pairs of records with equal keys."""
    sizes = keys.groupBy("key").agg(F.ceil(F.count("*") / split).cast("int").alias("chunks"))
    placed = keys.join(sizes, "key").withColumn("chunk", F.pmod(F.xxhash64("rid"), "chunks").cast("int"))
    low = placed.select("key", F.col("rid").alias("x"), F.col("chunk").alias("p"), F.explode(F.sequence(F.col("chunk"), F.col("chunks") - 1)).alias("q"))
    high = placed.select("key", F.col("rid").alias("y"), F.col("chunk").alias("q"), F.explode(F.sequence(F.lit(0), F.col("chunk"))).alias("p"))
    met = low.join(high, ["key", "p", "q"]).where((F.col("p") < F.col("q")) | (F.col("x") < F.col("y")))
    return met.select(F.least("x", "y").alias("i"), F.greatest("x", "y").alias("j"))


def block_standard(records: DataFrame, key: str, rid: str = "rid", max_pairs: int | None = None) -> DataFrame:
    """Equal cleaned keys; a record without a key pairs with nothing."""
    keys = keyed(records, clean(key), rid)
    if max_pairs is not None:
        guard(count_pairs(keys), max_pairs)
    return pairs_within(keys)


def block_prefix(records: DataFrame, key: str, n: int = 3, rid: str = "rid", max_pairs: int | None = None) -> DataFrame:
    """Equal first ``n`` characters of the cleaned key."""
    keys = keyed(records, prefix_key(key, n), rid)
    if max_pairs is not None:
        guard(count_pairs(keys), max_pairs)
    return pairs_within(keys)


def block_all(records: DataFrame, rid: str = "rid", max_pairs: int | None = MAX_PAIRS) -> DataFrame:
    """Every pair, refused before any is made when there are more than ``max_pairs``."""
    n = records.count()
    guard(n * (n - 1) // 2, max_pairs)
    return pairs_within(records.select(F.col(rid).alias("rid"), F.lit(0).alias("key")))


def block_sorted(records: DataFrame, key: str, window: int = WINDOW, rid: str = "rid", normalise: Column | None = None) -> DataFrame:
    """Sorted neighbourhood: each record with the next ``window`` in the order of the lower-cased
    key (missing first, ties by id)."""
    text = F.coalesce(F.lower(F.col(key).cast("string")), F.lit("")) if normalise is None else normalise
    ranked = global_rank(records.select(F.col(rid).alias("rid"), text.alias("key")), [F.col("key"), F.col("rid")])
    here = ranked.select(F.col("rid").alias("x"), F.explode(F.sequence(F.col("rank") + 1, F.col("rank") + window)).alias("rank"))
    return here.join(ranked.select(F.col("rid").alias("y"), "rank"), "rank").select(F.least("x", "y").alias("i"), F.greatest("x", "y").alias("j"))


def undirect(stubs: DataFrame, *scores: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Directed ``(i, j)`` as unordered pairs, once (for each value of ``by``), with the largest of each score."""
    pairs = stubs.select(*by, F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), *scores)
    return pairs.groupBy(*by, "i", "j").agg(*(F.max(s).alias(s) for s in scores)) if scores else pairs.distinct()


def report(pairs: DataFrame, n_records: int, gold: DataFrame | None = None) -> DataFrame:
    """One row: pairs, reduction ratio, pairs per record, and pair completeness against ``gold(i, j)``."""
    ends = pairs.select(F.explode(F.array("i", "j")).alias("rid")).groupBy("rid").agg(F.count("*").alias("degree"))
    possible = n_records * (n_records - 1) / 2
    out = pairs.agg(F.count("*").alias("n_candidate_pairs")).join(ends.agg(F.coalesce(F.max("degree"), F.lit(0)).alias("pairs_per_record_max")))
    out = out.select(
        F.lit(n_records).cast("long").alias("n_records"),
        "n_candidate_pairs",
        (1 - F.col("n_candidate_pairs") / possible if possible else F.lit(1.0)).alias("reduction_ratio"),
        (2 * F.col("n_candidate_pairs") / n_records if n_records else F.lit(0.0)).alias("pairs_per_record_mean"),
        "pairs_per_record_max",
    )
    if gold is None:
        return out
    hit = gold.join(pairs, ["i", "j"], "left_semi").agg(F.count("*").alias("__hit"))
    total = gold.agg(F.count("*").alias("n_truth_pairs"))
    return out.join(total).join(hit).withColumn("pair_completeness", F.when(F.col("n_truth_pairs") > 0, F.col("__hit") / F.col("n_truth_pairs"))).drop("__hit")


def report_of_keys(keys: DataFrame) -> DataFrame:
    """As :func:`report` for the pairs that equal keys make, from sizes alone; ``keys(rid, key, truth)``
    has every record, those without a key too."""
    n = F.col("n_records")
    sizes = keys.where("key IS NOT NULL").groupBy("key").agg(F.count("*").alias("size"))
    most = sizes.agg(F.coalesce(F.max("size") - 1, F.lit(0).cast("long")).alias("pairs_per_record_max"))
    gold = agreeing_pairs(keys.where("truth IS NOT NULL").select(F.col("truth").alias("key"), F.lit(None).cast("int").alias("none")), "none")
    one = keys.agg(F.count("*").alias("n_records")).join(agreeing_pairs(keys, "truth")).join(most).join(gold.select(F.col("pairs").alias("n_truth_pairs")))
    possible = n * (n - 1) / 2
    return one.select(
        "n_records",
        F.col("pairs").alias("n_candidate_pairs"),
        F.when(possible > 0, 1 - F.col("pairs") / possible).otherwise(1.0).alias("reduction_ratio"),
        F.when(n > 0, 2 * F.col("pairs") / n).otherwise(0.0).alias("pairs_per_record_mean"),
        "pairs_per_record_max",
        "n_truth_pairs",
        F.when(F.col("n_truth_pairs") > 0, F.col("agreeing") / F.col("n_truth_pairs")).alias("pair_completeness"),
    )


# --- token blocking and meta-blocking


def token_postings(records: DataFrame, tokens: Column, rid: str = "rid", least: int = 2, most_floor: int = 50, most_share: float = 0.05) -> DataFrame:
    """``(rid, token, size)`` of the tokens in at least ``least`` and at most
    ``max(most_floor, most_share * n)`` records; ``size`` counts a record's tokens that stay."""
    n = records.count()
    posted = records.select(F.col(rid).alias("rid"), F.explode(tokens).alias("token"))
    kept = posted.groupBy("token").agg(F.count("*").alias("df")).where((F.col("df") >= least) & (F.col("df") <= max(most_floor, most_share * n)))
    posted = posted.join(kept.select("token"), "token")
    return posted.join(posted.groupBy("rid").agg(F.count("*").alias("size")), "rid").select("rid", "token", "size")


def meta_blocking(postings: DataFrame) -> DataFrame:
    """``(i, j, cbs, js)``: common blocks, and their share of the blocks of both."""
    a = postings.select("token", F.col("rid").alias("i"), F.col("size").alias("size_i"))
    b = postings.select("token", F.col("rid").alias("j"), F.col("size").alias("size_j"))
    met = a.join(b, "token").where("i < j").groupBy("i", "j", "size_i", "size_j").agg(F.count("*").alias("cbs"))
    return met.select("i", "j", "cbs", (F.col("cbs") / (F.col("size_i") + F.col("size_j") - F.col("cbs"))).alias("js"))


def heaviest_by_cbs(postings: DataFrame, budget: int, seeds: int = SEEDS) -> DataFrame:
    """The ``budget`` edges ``(i, j, cbs)`` of most common blocks, ties by ids, without the whole graph.

    No edge has more common blocks than either end has blocks.  The edges of the ``seeds`` largest records give a bound
    that the result can't fall below; records with fewer blocks than that have no edge in it.
    """
    postings = stash(postings, "postings")
    sizes = stash(postings.select("rid", "size").distinct(), "posting-sizes")
    top = lambda kept: stash(meta_blocking(postings.join(kept.select("rid"), "rid", "left_semi")).orderBy(F.desc("cbs"), "i", "j").limit(budget).select("i", "j", "cbs"), "heaviest")
    some = stash(sizes.orderBy(F.desc("size"), "rid").limit(seeds), "posting-seeds")
    found = top(some)
    row = found.agg(F.count("*").alias("n"), F.min("cbs").alias("least")).first()
    needed = sizes.where(F.col("size") >= (row["least"] if row["n"] >= budget else 1))
    return found if needed.join(some, "rid", "left_anti").isEmpty() else top(needed)


def edges_from(postings: DataFrame, least: float) -> DataFrame:
    """The edges ``(i, j, cbs, js)`` of a Jaccard of ``least`` or more.

    Two records that share so many of their blocks share one of the first ``size - ceil(least * size) + 1`` of each,
    rarest first; only records that do so meet.
    """
    rare = postings.groupBy("token").agg(F.count("*").alias("df"))
    ranked = postings.join(rare, "token").withColumn("at", F.row_number().over(Window.partitionBy("rid").orderBy("df", "token")))
    first = stash(ranked.where(F.col("at") <= F.col("size") - F.ceil(F.col("size") * least - 1e-9) + 1).select("token", "rid", "size"), "first-tokens")
    end = lambda e: first.select("token", F.col("rid").alias(e), F.col("size").alias(f"size_{e}"))
    alike = F.least("size_i", "size_j") >= F.greatest("size_i", "size_j") * least - 1e-9
    some = stash(end("i").join(end("j"), "token").where((F.col("i") < F.col("j")) & alike).select("i", "j", "size_i", "size_j").distinct(), "candidates")
    sets = postings.groupBy("rid").agg(F.collect_list("token").alias("tokens"))
    both = some.join(sets.select(F.col("rid").alias("i"), F.col("tokens").alias("x")), "i").join(sets.select(F.col("rid").alias("j"), F.col("tokens").alias("y")), "j")
    counted = both.select("i", "j", "size_i", "size_j", F.size(F.array_intersect("x", "y")).cast("long").alias("cbs"))
    return counted.select("i", "j", "cbs", (F.col("cbs") / (F.col("size_i") + F.col("size_j") - F.col("cbs"))).alias("js")).where(F.col("js") >= least)


def wnp(edges: DataFrame, weight: str = "cbs") -> DataFrame:
    """Weighted node pruning: edges at least as heavy as the mean at both ends."""
    ends = edges.select("i", F.col(weight).alias("w")).unionByName(edges.select(F.col("j").alias("i"), F.col(weight).alias("w")))
    means = ends.groupBy("i").agg(F.avg("w").alias("mean_i"))
    both = edges.join(means, "i").join(means.select(F.col("i").alias("j"), F.col("mean_i").alias("mean_j")), "j")
    return both.where((F.col(weight) >= F.col("mean_i")) & (F.col(weight) >= F.col("mean_j"))).select("i", "j", weight)


# --- MinHash


def minhash(shingles: Column, perms: int = 128) -> Column:
    """``perms`` minima of hashes ``(a * x + b) mod p`` of the shingles' 32-bit digests."""
    base = F.transform(shingles, lambda s: F.conv(F.substring(F.md5(s), 1, 7), 16, 10).cast("long"))
    prime = 2**31 - 1

    def permuted(digests: Column, k: Column) -> Column:
        return F.array_min(F.transform(digests, lambda x: (x * (2 * k + 1) + 7919 * k * k + 104729) % prime))

    numbers = F.sequence(F.lit(0).cast("long"), F.lit(perms - 1).cast("long"))
    # an array of one binds the digests, so that they are made once
    return F.transform(F.array(base), lambda digests: F.transform(numbers, lambda k: permuted(digests, k)))[0]


def lsh_pairs(signatures: DataFrame, bands: int = 16, rows: int = 8, bucket_cap: int = 300) -> DataFrame:
    """``(i, j, agreement)`` of records that share a band, of buckets of up to ``bucket_cap``;
    ``signatures(rid, sig)``."""
    keys = F.array(*(F.concat_ws("-", F.lit(b), F.slice("sig", b * rows + 1, rows)) for b in range(bands)))
    banded = signatures.select("rid", F.explode(keys).alias("key"))
    fit = banded.groupBy("key").agg(F.count("*").alias("n")).where((F.col("n") > 1) & (F.col("n") <= bucket_cap))
    pairs = pairs_within(banded.join(fit.select("key"), "key")).distinct()
    a, b = signatures.select(F.col("rid").alias("i"), F.col("sig").alias("a")), signatures.select(F.col("rid").alias("j"), F.col("sig").alias("b"))
    same = F.aggregate(F.zip_with("a", "b", lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, v: s + v)
    return pairs.join(a, "i").join(b, "j").select("i", "j", (same / (bands * rows)).alias("agreement"))


# --- canopies


CANOPY_LIMIT = 5_000
QUANTILES = [round(0.50 + 0.04 * k, 2) for k in range(13)]


def removed(tight: DataFrame) -> DataFrame:
    """``(g, i)``: the records that another's canopy removes, for each graph ``g`` of ``tight(g, i, j)``, ``i < j``.

    In id order a record that is not removed opens a canopy and removes its neighbours.  So one without a smaller
    neighbour left opens, whatever the others do, and all such are taken in one round.
    """
    left, out = stash(tight.select("g", "i", "j").distinct(), "canopy-edges"), tight.select("g", "i").limit(0)
    while not left.isEmpty():
        opens = left.select("g", "i").distinct().join(left.select("g", F.col("j").alias("i")).distinct(), ["g", "i"], "left_anti")
        gone = stash(left.join(opens, ["g", "i"]).select("g", F.col("j").alias("i")).distinct(), "canopy-removed")
        left = left.join(opens, ["g", "i"], "left_anti").join(gone, ["g", "i"], "left_anti").join(gone.withColumnRenamed("i", "j"), ["g", "j"], "left_anti")
        left, out = stash(left, "canopy-edges"), out.unionByName(gone)
    return out


def _members(edges: DataFrame, nodes: DataFrame, grid: list[tuple[float, float]]) -> DataFrame:
    """``(g, i, j)``: the members ``j`` of each canopy, itself too, under the pair of bounds ``grid[g]``."""
    bounds = lambda which: F.explode(F.array(*(F.struct(F.lit(g).alias("g"), F.lit(b[which]).alias("bound")) for g, b in enumerate(grid)))).alias("b")
    near = edges.where((F.col("cos") >= min(map(min, grid))) & (F.col("i") != F.col("j")))
    near = stash(near.select(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), "cos"), "canopy-near")
    within = lambda which: near.select("*", bounds(which)).where(F.col("cos") >= F.col("b.bound")).select("b.g", "i", "j")
    opens = nodes.select(F.explode(F.array(*(F.lit(g) for g in range(len(grid))))).alias("g"), F.col("rid").alias("i"))
    opens = stash(opens.join(removed(within(1).join(nodes.select(F.col("rid").alias("i")), "i", "left_semi")), ["g", "i"], "left_anti"), "canopies")
    loose = within(0)
    both = loose.unionByName(loose.select("g", F.col("j").alias("i"), F.col("i").alias("j")))
    return both.join(opens, ["g", "i"], "left_semi").select("g", "i", "j").unionByName(opens.select("g", "i", F.col("i").alias("j"))).distinct()


def canopies(edges: DataFrame, nodes: DataFrame, tight: float, loose: float, limit: int | None = CANOPY_LIMIT) -> DataFrame:
    """Canopy pairs from cosines ``edges(i, j, cos)`` of at least ``loose``.

    In id order, a record not yet removed opens a canopy of all records within ``loose``
    (removed ones too), all paired; those within ``tight`` are removed.  Refuses more than ``limit``
    records, as the method does; without a limit all are taken, in rounds.
    """
    guard(nodes.count(), limit)
    members = stash(_members(edges, nodes, [(loose, tight)]).select("i", "j"), "canopy-members")
    lists = members.groupBy("i").agg(F.array_sort(F.collect_list("j")).alias("all"))
    lists = F.broadcast(lists) if members.count() <= BROADCAST_ROWS else lists
    # pairs are made where the smaller record's canopies meet, so only its canopies are moved
    tasks = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    meets = members.repartition(tasks, "j").join(lists, "i").select(F.col("j").alias("a"), F.explode(F.filter("all", lambda x: x > F.col("j"))).alias("b"))
    return meets.groupBy("a", "b").agg(F.lit(1).alias("one")).select(F.col("a").alias("i"), F.col("b").alias("j"))


def tune_canopies(edges: DataFrame, nodes: DataFrame, pool: DataFrame, budget: int, limit: int | None = CANOPY_LIMIT) -> DataFrame:
    """``(loose, tight, pairs)``: the inner bound, of the quantiles ``QUANTILES`` of the pool's cosines, whose
    canopies' pairs (counted with overlaps) come closest to the budget; the smallest of several.

    ``tight`` is 0.05 above ``loose``, 0.99 at most.  All bounds are scanned together.
    Without a pool no bound exists and no row comes back.
    """
    found = canopy_bounds(pool)
    if not found:
        return pool.sparkSession.createDataFrame([], "loose double, tight double, pairs long")
    guard(nodes.count(), limit)
    sizes = _members(edges, nodes, found).groupBy("g", "i").agg(F.count("*").alias("n"))
    counted = sizes.groupBy("g").agg(F.sum(pairs_of("n")).alias("pairs"))
    grid = pool.sparkSession.createDataFrame([(g, *map(float, b)) for g, b in enumerate(found)], "g int, loose double, tight double")
    return grid.join(counted, "g", "left").select("loose", "tight", F.coalesce("pairs", F.lit(0).cast("long")).alias("pairs")).orderBy(F.abs(F.col("pairs") - budget), "loose").limit(1)


def canopy_bounds(pool: DataFrame) -> list[tuple[float, float]]:
    """The pairs of bounds ``(loose, tight)`` that :func:`tune_canopies` tries, smallest first."""
    found = pool.agg(F.percentile("score", QUANTILES).alias("q")).first()["q"]
    return [(q, min(0.99, q + 0.05)) for q in sorted(set(found or []))]
