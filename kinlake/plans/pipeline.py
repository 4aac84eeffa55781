"""Whole runs: block, score, classify, cluster, evaluate; and the reports around them."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinlake import registry
from kinlake.functions.similarity import score_pairs
from kinlake.functions.text import clean, prefix_key, record_text
from kinlake.operators import blocking, budget, grouping, metrics, profile, supervised, truth
from kinlake.operators.neighbors import gram_cosines, pool
from kinlake.operators.retriever import block_embed
from kinlake.session import stash


@dataclass
class Config:
    """A run's settings; ``fields`` maps columns to similarities."""

    fields: dict[str, str]
    block_method: str = "prefix"
    block_key: str | None = None
    classify_method: str = "threshold"
    threshold: float = 0.5
    cluster_method: str = "tc"
    hc_h: float = 0.5
    hdbscan_min_pts: int = 2
    prefix_len: int = 3
    window: int = 20
    max_pairs: int | None = 2_000_000
    held_out: bool = False
    truth_col: str | None = None
    weights: dict[str, float] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.fields = profile.without_truth(self.fields, self.truth_col)
        for kind, name, known in (("blocking", self.block_method, registry.BLOCKING), ("classify", self.classify_method, registry.CLASSIFIERS), ("cluster", self.cluster_method, registry.CLUSTERERS)):
            if name not in known:
                raise ValueError(f"unknown {kind} method: {name}; known: {', '.join(known)}")
        if self.block_method in ("standard", "prefix", "sn") and not self.block_key:
            self.block_key = profile.smart_key(list(self.fields))


@dataclass
class Result:
    """Tables of a run: ``labels(rid, label)``, scored ``pairs``, ``links``, one-row ``quality`` (or None), and warnings."""

    labels: DataFrame
    pairs: DataFrame
    links: DataFrame
    quality: DataFrame | None
    warnings: list[str]


def candidates(records: DataFrame, config: Config, gold: DataFrame | None = None, rid: str = "rid") -> tuple[DataFrame, int | None]:
    """Candidate pairs, and the neighbours per record where the method has them."""
    c = config
    if c.block_method == "none":
        return blocking.block_all(records, rid, c.max_pairs), None
    if c.block_method == "standard":
        return blocking.block_standard(records, c.block_key, rid, c.max_pairs), None
    if c.block_method == "prefix":
        return blocking.block_prefix(records, c.block_key, c.prefix_len, rid, c.max_pairs), None
    if c.block_method == "sn":
        n = records.count()
        blocking.guard(sum(max(0, n - k) for k in range(1, c.window + 1)), c.max_pairs)
        return blocking.block_sorted(records, c.block_key, c.window, rid), None
    texts = records.select(F.col(rid).alias("rid"), record_text(list(c.fields)).alias("text"))
    return block_embed(texts, "text", c.max_pairs or blocking.MAX_PAIRS, gold)


def resolve(records: DataFrame, config: Config, known: DataFrame | None = None, rid: str = "rid") -> Result:
    """Runs ``config`` over ``records``; ``known(rid, truth)`` takes precedence over ``truth_col``."""
    warnings: list[str] = []
    if known is None and config.truth_col:
        known = truth.from_column(records, config.truth_col, rid)
    if config.classify_method in registry.MODELS and known is None:
        raise ValueError(f"{config.classify_method} is supervised and needs truth")
    gold = truth.gold_pairs(known) if known is not None and config.block_method == "embed" else None
    pairs, _ = candidates(records, config, gold, rid)
    scored = stash(score_pairs(pairs, records, config.fields, config.weights, rid), "scored-pairs")
    features = [f"s_{c}" for c in config.fields]
    test = None
    if config.classify_method in registry.MODELS:
        labelled = truth.pair_labels(scored.where("score > 0"), known)
        if config.held_out:
            split = truth.entity_split(known)
            if split.where("part = 'both'").isEmpty():
                named = known.join(split.select("truth", "part"), "truth")
                train = named.where("part = 'train'").select("rid")
                labelled = budget.inside(labelled, train)
                test = named.where("part = 'test'").select("rid")
            else:
                warnings.append("fewer than 10 entities: trained and judged on the same records")
        if supervised.trainable(labelled):
            model = supervised.train(config.classify_method, labelled, features)
            links = model(scored.where("score > 0")).where(F.col("p") >= config.threshold).select("i", "j", F.col("p").alias("score"))
        else:
            warnings.append("too few labelled pairs to train: links are pairs at the threshold")
            links = scored.where(F.col("score") >= config.threshold).select("i", "j", "score")
    elif config.classify_method in registry.COMMUNITIES:
        options = {"threshold": config.threshold} if config.classify_method == "gc" else {}
        links = grouping.community_links(scored, registry.COMMUNITIES[config.classify_method](scored, records, rid, **options))
    else:
        links = scored.where(F.col("score") >= config.threshold).select("i", "j", "score")
    links = stash(links, "links")
    labels = registry.CLUSTERERS[config.cluster_method](links, scored, records, rid, hc_h=config.hc_h, hdbscan_min_pts=config.hdbscan_min_pts)
    labels = stash(labels, "labels")
    quality = None
    if known is not None:
        judged = labels.join(known, "rid")
        quality = metrics.quality(judged if test is None else judged.join(test, "rid", "left_semi"))
    if labels.count() and metrics.dominance(labels).first()["warning"]:
        warnings.append("one entity holds more than half of the records")
    return Result(labels, scored, links, quality, warnings)


def blocking_report(records: DataFrame, config: Config, known: DataFrame | None = None, rid: str = "rid") -> DataFrame:
    """One row on the candidate pairs alone."""
    if known is None and config.truth_col:
        known = truth.from_column(records, config.truth_col, rid)
    gold = truth.gold_pairs(known) if known is not None else None
    pairs, k = candidates(records, config, gold, rid)
    return blocking.report(stash(pairs, "pairs"), records.count(), gold).withColumns({"block_method": F.lit(config.block_method), "k": F.lit(k).cast("int")})


def plan(records: DataFrame, config: Config, rid: str = "rid") -> int:
    """How many pairs a run would score, without making any."""
    n, c = records.count(), config
    if c.block_method == "none":
        return n * (n - 1) // 2
    if c.block_method == "sn":
        return sum(max(0, n - k) for k in range(1, c.window + 1))
    if c.block_method == "embed":
        return n * budget.k_for_budget(c.max_pairs or blocking.MAX_PAIRS, n) // 2
    key = clean(c.block_key) if c.block_method == "standard" else prefix_key(c.block_key, c.prefix_len)
    return blocking.count_pairs(blocking.keyed(records, key, rid))


KS = (10, 20, 50)


def budget_lab(texts: DataFrame, known: DataFrame, replicates: int = 19, ks: tuple[int, ...] = KS) -> tuple[DataFrame, dict]:
    """Compares the arms at the budget of fixed-k on test entities: ``(k, arm, budget, pc)``, and a
    permutation test of the allocation at the best training ``k``.

    ``texts(rid, text)``, ``known(rid, truth)``.
    """
    cosines = stash(gram_cosines(texts), "lab-cosines")
    stubs = stash(pool(cosines), "lab-stubs")
    named = known.join(truth.record_split(known).select("truth", "part"), "truth")
    train, test = (stash(named.where(F.col("part") == p).select("rid", "truth"), f"lab-{p}") for p in ("train", "test"))
    gold = truth.gold_pairs(known)
    both = lambda df, part: budget.inside(df, part.select("rid"))
    gold_train, gold_test = (stash(both(gold, part), "lab-gold") for part in (train, test))
    best = max(((budget.completeness(budget.fixed_k(stubs, k, train), gold_train).first()["pc"], -k) for k in ks))
    k_star = -best[1]
    labelled = truth.pair_labels(budget.pool_pairs(both(stubs, train)), known).withColumnRenamed("score", "cos")
    slope, intercept = budget.platt(labelled)
    pool_test = stash(both(stubs, test).withColumn("value", 1 / (1 + F.exp(-(F.col("cos") * slope + intercept)))), "lab-test")
    comm = grouping.louvain_communities(budget.pool_pairs(pool_test), test.select("rid")).withColumnRenamed("label", "comm")
    within = both(cosines, test)
    rows, arms = None, {}
    for k in ks:
        fixed = stash(budget.fixed_k(stubs, k, test), "lab-fixed")
        b = fixed.count()
        alpha = budget.tune_alpha(both(stubs, train), budget.fixed_k(stubs, k, train).count()).first()["alpha"]
        arms = {
            "fixed_k": fixed,
            "collective": budget.collective(within, pool_test, comm, b),
            "waterfill": budget.waterfill(pool_test.select("i", "j", "rank", "value"), b),
            "global_top": budget.global_top(pool_test, b),
            "adaptive_k": budget.align(budget.adaptive_k(pool_test, alpha), budget.pool_pairs(pool_test), b),
        }
        for arm, pairs in arms.items():
            got = budget.completeness(pairs, gold_test).select(F.lit(k).alias("k"), F.lit(arm).alias("arm"), F.lit(b).cast("long").alias("budget"), "pc")
            rows = got if rows is None else rows.unionByName(got)
    grid = stash(rows, "lab-grid")
    at_star = {r["arm"]: (r["pc"], r["budget"]) for r in grid.where(F.col("k") == k_star).collect()}
    spent = at_star["fixed_k"][1]
    chosen = budget.waterfill(pool_test.select("i", "j", "rank", "value"), spent)
    profile_of = metrics.degrees(chosen, test).select(F.col("rid").alias("i"), F.col("degree").alias("n"))
    null = []
    permuted = stash(budget.permuted_allocations(profile_of, replicates), "lab-permuted")
    for r in range(1, replicates + 1):
        one = permuted.where(F.col("replicate") == r).select("i", "n")
        null.append(budget.completeness(budget.by_allocation(pool_test.select("i", "j", "value"), one, spent), gold_test).first()["pc"] - at_star["fixed_k"][0])
    gain = at_star["waterfill"][0] - at_star["fixed_k"][0]
    p = (1 + sum(x >= gain for x in null)) / (len(null) + 1)
    return grid, {"k_star": k_star, "gain": gain, "null": null, "p": p, "verdict": budget.verdict(gain, p), "slope": slope, "intercept": intercept}


def script(config: Config) -> str:
    """Python text that repeats a run."""
    lines = ["from kinlake.plans.pipeline import Config, resolve", "", "config = Config("]
    lines += [f"    {k}={v!r}," for k, v in vars(config).items()]
    return "\n".join([*lines, ")", "result = resolve(records, config)", "result.labels.show()", ""])
