"""Exhaustive evaluation of contiguous execution windows.

Queries are (model, origin) with one row per horizon 1..H. Every operator is grouped by the query, so the work spreads over queries; a query
itself has H rows and H (H + 1) / 2 windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

TIE = 1e-9
QUERY = ["model", "origin"]


def valid_durations(durations, horizon: int) -> list[int]:
    """Distinct whole numbers 1..horizon, sorted; anything else is an error."""
    out = set()
    for d in durations:
        if isinstance(d, bool) or not isinstance(d, int):
            raise ValueError(f"durations must be integers: {d!r}")
        if not 1 <= d <= horizon:
            raise ValueError(f"duration {d} is outside 1..{horizon}")
        out.add(d)
    if not out:
        raise ValueError("no duration given")
    return sorted(out)


def query_violations(p: DataFrame, horizon: int = 24, step: int = 3600) -> DataFrame:
    """``violation, n``: how often each rule of a complete query is broken (rules that hold have n = 0).

    Rules: values finite, no duplicate (model, origin, horizon), horizons exactly 1..H, target = origin + horizon, the same origins for
    every model, the same actual for every model.
    """
    bad = lambda c: F.col(c).isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    rows = p.agg(F.sum((bad("prediction") | bad("actual")).cast("long")).alias("not_finite"), F.sum((F.col("target") != F.col("origin") + F.col("horizon") * step).cast("long")).alias("target_mismatch"))
    dup = p.groupBy(*QUERY, "horizon").count().agg(F.sum((F.col("count") > 1).cast("long")).alias("duplicate_key"))
    sizes = p.groupBy(*QUERY).agg(F.countDistinct("horizon").alias("n"), F.min("horizon").alias("lo"), F.max("horizon").alias("hi"))
    incomplete = sizes.agg(F.sum(((F.col("n") != horizon) | (F.col("lo") != 1) | (F.col("hi") != horizon)).cast("long")).alias("incomplete_horizons"))
    models = p.select("model").distinct().agg(F.count("*").alias("_models"))
    support = p.select(*QUERY).distinct().groupBy("origin").agg(F.count("*").alias("_n")).join(F.broadcast(models)).agg(F.sum((F.col("_n") != F.col("_models")).cast("long")).alias("origin_support"))
    actual = p.groupBy("origin", "horizon").agg((F.max("actual") - F.min("actual")).alias("_d")).agg(F.sum((F.col("_d") > TIE).cast("long")).alias("actual_mismatch"))
    names = ["not_finite", "target_mismatch", "duplicate_key", "incomplete_horizons", "origin_support", "actual_mismatch"]
    one = rows
    for other in (dup, incomplete, support, actual):
        one = one.join(F.broadcast(other))  # one row each
    return one.select(F.inline(F.array(*[F.struct(F.lit(n).alias("violation"), F.coalesce(F.col(n), F.lit(0)).alias("n")) for n in names])))


def assert_complete(p: DataFrame, horizon: int = 24) -> None:
    broken = [r["violation"] for r in query_violations(p, horizon).filter("n > 0").collect()]
    if broken:
        raise ValueError(f"incomplete queries: {', '.join(broken)}")


def catalog(p: DataFrame, horizon: int = 24, durations: list[int] | None = None) -> DataFrame:
    """All contiguous windows: ``model, origin, duration, start, end, predicted, actual`` (mean costs; ``end`` inclusive).

    Running sums per query, then each end paired with the starts before it within the same query: the array of the query's prefix sums is at most
    H long.
    """
    wanted = valid_durations(durations, horizon) if durations is not None else None
    d = p.filter(F.col("horizon").between(1, horizon))
    w = W.partitionBy(*QUERY).orderBy("horizon")
    d = d.withColumn("_p", F.sum("prediction").over(w)).withColumn("_a", F.sum("actual").over(w))
    before = F.collect_list(F.struct((F.col("horizon") - 1).alias("h"), (F.col("_p") - F.col("prediction")).alias("p"), (F.col("_a") - F.col("actual")).alias("a"))).over(w)
    d = d.withColumn("_before", before).withColumn("_from", F.explode("_before")).withColumn("duration", F.col("horizon") - F.col("_from.h"))
    if wanted is not None:
        d = d.filter(F.col("duration").isin(wanted))
    return d.select(
        *QUERY, "duration", (F.col("_from.h") + 1).alias("start"), F.col("horizon").alias("end"), ((F.col("_p") - F.col("_from.p")) / F.col("duration")).alias("predicted"), ((F.col("_a") - F.col("_from.a")) / F.col("duration")).alias("actual")
    )


def _average_rank(value: str, keys: list[str]) -> Column:
    by = W.partitionBy(*keys)
    return F.rank().over(by.orderBy(value)) + (F.count("*").over(by.orderBy(value).rangeBetween(W.currentRow, W.currentRow)) - 1) / 2.0


def decisions(cat: DataFrame, epsilon: float = 1.0, tie: float = TIE) -> DataFrame:
    """The window each model picks per (model, origin, duration), and how it compares.

    The pick is the earliest window within ``tie`` of the lowest prediction, the oracle the earliest within it of the lowest actual cost. Spearman's
    correlation uses average ranks of values rounded to the tie; it is null for one candidate or a constant side.
    """
    if epsilon < 0 or tie < 0:
        raise ValueError("epsilon and tie must be non-negative")
    key = [*QUERY, "duration"]
    w = W.partitionBy(*key)
    d = cat.withColumn("_pmin", F.min("predicted").over(w)).withColumn("_amin", F.min("actual").over(w))
    d = d.withColumn("_p", F.round("predicted", 9)).withColumn("_a", F.round("actual", 9))
    d = d.withColumn("_rp", _average_rank("_p", key)).withColumn("_ra", _average_rank("_a", key))
    picked, ideal = F.col("predicted") - F.col("_pmin") <= tie, F.col("actual") - F.col("_amin") <= tie
    d = d.withColumn("_sel", F.min(F.when(picked, F.struct("start", "predicted", "actual"))).over(w))
    g = d.groupBy(*key).agg(
        F.count("*").alias("candidates"), F.first("_sel").alias("_sel"), F.min(F.when(ideal, F.struct("start", "actual"))).alias("_best"), F.min(F.struct("start", "actual")).alias("_first"), F.avg("actual").alias("random_cost"),
        F.sum((F.col("actual") < F.col("_sel.actual") - tie).cast("long")).alias("_better"), F.sum(picked.cast("long")).alias("predicted_ties"), F.sum(ideal.cast("long")).alias("oracle_ties"),
        (F.max("predicted") - F.min("predicted")).alias("_prange"), (F.max("actual") - F.min("actual")).alias("_arange"),
        F.avg("_rp").alias("_mp"), F.avg("_ra").alias("_ma"), F.avg(F.col("_rp") * F.col("_ra")).alias("_mpa"), F.avg(F.col("_rp") * F.col("_rp")).alias("_mpp"), F.avg(F.col("_ra") * F.col("_ra")).alias("_maa"),
    )
    cov, vp, va = F.col("_mpa") - F.col("_mp") * F.col("_ma"), F.col("_mpp") - F.col("_mp") ** 2, F.col("_maa") - F.col("_ma") ** 2
    rho = F.when((F.col("candidates") > 1) & (F.col("_prange") > tie) & (F.col("_arange") > tie), F.try_divide(cov, F.sqrt(vp * va)))
    sel, best, asap, rank = F.col("_sel.actual"), F.col("_best.actual"), F.col("_first.actual"), 1 + F.col("_better")
    return g.select(
        *key, "candidates", F.col("_sel.start").alias("selected_start"), F.col("_sel.predicted").alias("selected_predicted"), sel.alias("selected_cost"), F.col("_best.start").alias("oracle_start"), best.alias("oracle_cost"),
        asap.alias("asap_cost"), "random_cost", (sel - best).alias("regret"), (asap - sel).alias("savings"), (asap - best).alias("opportunity"), (F.col("random_cost") - sel).alias("random_improvement"), (F.col("random_cost") - best).alias("random_regret"),
        (sel - best <= tie).alias("top1"), (sel <= best + epsilon + tie).alias("epsilon_optimal"), rank.alias("rank"), F.when(F.col("candidates") > 1, (rank - 1) / (F.col("candidates") - 1)).otherwise(0.0).alias("rank_percentile"),
        (rank <= F.greatest(F.lit(1), F.ceil(0.1 * F.col("candidates")))).alias("top10"), rho.alias("spearman"), "predicted_ties", "oracle_ties",
    )


def potential(numerator: str, denominator: str) -> Column:
    """100 * sum / sum, not clipped; null if the denominator's sum is at most 1e-12."""
    return F.when(F.sum(denominator) > 1e-12, 100.0 * F.sum(numerator) / F.sum(denominator))


def aggregate(dec: DataFrame, keys: list[str] = ["model", "duration"]) -> DataFrame:  # noqa: B006
    d = dec.withColumn("_rand", F.col("asap_cost") - F.col("random_cost"))
    mean = lambda c: F.avg(F.col(c).cast("double"))
    return d.groupBy(*keys).agg(
        F.countDistinct("origin").alias("origins"), mean("selected_cost").alias("mean_selected"), mean("oracle_cost").alias("mean_oracle"), mean("asap_cost").alias("mean_asap"), mean("random_cost").alias("mean_random"), mean("regret").alias("mean_regret"),
        mean("savings").alias("mean_savings"), mean("opportunity").alias("mean_opportunity"), potential("savings", "opportunity").alias("oracle_potential"), potential("_rand", "opportunity").alias("random_potential"),
        mean("top1").alias("top1_rate"), mean("epsilon_optimal").alias("epsilon_rate"), mean("rank_percentile").alias("mean_rank_percentile"), mean("top10").alias("top10_rate"), mean("spearman").alias("mean_spearman"),
        F.sum((F.col("opportunity") > 1e-12).cast("long")).alias("positive_origins"),
    )


def summarize(dec: DataFrame, keys: list[str]) -> DataFrame:
    """Per group: queries, mean / p90 / tail mean of the regret (mean of the values at or above the interpolated 95th percentile), potentials, mean delay."""
    q = dec.groupBy(*keys).agg(F.expr("percentile(regret, 0.95)").alias("_p95"))
    d = dec.join(q, keys)
    return d.groupBy(*keys).agg(
        F.count("*").alias("queries"), F.countDistinct("origin").alias("origins"), F.avg("regret").alias("mean_regret"), F.expr("percentile(regret, 0.9)").alias("p90_regret"), F.avg(F.when(F.col("regret") >= F.col("_p95"), F.col("regret"))).alias("cvar95_regret"),
        potential("savings", "opportunity").alias("oracle_potential"), potential("random_improvement", "random_regret").alias("versus_random_potential"), F.avg(F.col("selected_start") - 1.0).alias("mean_delay"), F.sum((F.col("opportunity") > 1e-12).cast("long")).alias("positive_queries"),
    )


def daily_deltas(dec: DataFrame, primary: str, most: int = 24) -> DataFrame:
    """Per origin and other model: its mean regret minus the primary model's, over durations below ``most``."""
    daily = dec.filter(F.col("duration") < most).groupBy("origin", "model").agg(F.avg("regret").alias("r"))
    own = daily.filter(F.col("model") == primary).select("origin", F.col("r").alias("_own"))
    return daily.filter(F.col("model") != primary).join(own, "origin").select("origin", F.col("model").alias("reference"), (F.col("r") - F.col("_own")).alias("delta"))


def paired(dec: DataFrame, primary: str, most: int = 24) -> DataFrame:
    d = daily_deltas(dec, primary, most)
    pct = lambda c: 100.0 * F.avg(c.cast("double"))
    return d.groupBy("reference").agg(F.avg("delta").alias("mean_delta"), pct(F.col("delta") > 1e-12).alias("better_pct"), pct(F.abs("delta") <= 1e-12).alias("tie_pct"), F.count("*").alias("origins"))


def block_bootstrap(values: DataFrame, keys: list[str], order: str, value: str, block: int = 14, draws: int = 20_000, seed: int = 42) -> DataFrame:
    """95 % interval of the mean by circular block bootstrap: ``keys, low, high, draws``.

    A counter-based hash gives the start of every block of every draw, so the result doesn't depend on partitioning or call order. Means of
    blocks come from running sums over the doubled series; draws are spread over tasks.
    """
    w = W.partitionBy(*keys).orderBy(order)
    d = values.filter(F.col(value).isNotNull()).withColumn("_i", F.row_number().over(w) - 1).withColumn("_n", F.count("*").over(W.partitionBy(*keys)))
    size = F.least(F.lit(block), F.col("_n"))
    both = d.withColumn("_i", F.explode(F.array(F.col("_i"), F.col("_i") + F.col("_n"))))
    run = F.sum(value).over(W.partitionBy(*keys).orderBy("_i"))
    prefix = both.withColumn("_s", run).select(*keys, "_i", "_s", "_n")
    ends = prefix.withColumnsRenamed({"_i": "_e", "_s": "_se"}).drop("_n")
    starts = prefix.filter("_i < _n").withColumn("_e", F.col("_i") + size)
    total = prefix.select(*keys, (F.col("_i") + 1).alias("_i"), F.col("_s").alias("_before"))
    blocks = starts.drop("_s").join(total, [*keys, "_i"], "left").withColumn("_before", F.coalesce("_before", F.lit(0.0)))
    shape = blocks.select(*keys, "_n").distinct().withColumn("_draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1)))).withColumn("_k", F.explode(F.sequence(F.lit(1), F.ceil(F.col("_n") / size).cast("int"))))
    picks = shape.withColumn("_i", F.pmod(F.xxhash64(F.lit(seed), "_draw", "_k"), F.col("_n")))
    last = F.col("_n") - (F.col("_k") - 1) * size  # the last block is cut so that n values are drawn
    picks = picks.withColumn("_len", F.least(size, last))
    picked = picks.join(blocks.select(*keys, "_i", "_before"), [*keys, "_i"]).withColumn("_e", F.col("_i") + F.col("_len") - 1).join(ends, [*keys, "_e"])
    means = picked.groupBy(*keys, "_draw").agg((F.sum(F.col("_se") - F.col("_before")) / F.sum("_len")).alias("_m"))
    return means.groupBy(*keys).agg(F.expr("percentile(_m, 0.025)").alias("low"), F.expr("percentile(_m, 0.975)").alias("high"), F.count("*").alias("draws"))


def hour_selection(p: DataFrame, now: DataFrame) -> DataFrame:
    """Single-hour selection per strategy: realized cost, regret, captured share, Spearman, top-1 rate, queries; with rows ``oracle`` and ``run_now``.

    ``now`` has ``origin, now``: the cost at the origin. Queries with fewer than two rows or a missing actual are left out; the first lowest
    prediction wins. An origin without cost only drops out of the mean of run_now.
    """
    w = W.partitionBy(*QUERY)
    d = p.withColumn("_n", F.count("*").over(w)).withColumn("_ok", F.min((F.col("actual").isNotNull() & ~F.isnan("actual")).cast("int")).over(w)).filter("_n >= 2 and _ok = 1")
    d = d.withColumn("_p", F.round("prediction", 9)).withColumn("_a", F.round("actual", 9)).withColumn("_rp", _average_rank("_p", QUERY)).withColumn("_ra", _average_rank("_a", QUERY))
    q = d.groupBy(*QUERY).agg(
        F.min(F.struct("prediction", "horizon", "actual"))["actual"].alias("real"), F.min("actual").alias("best"), (F.max("prediction") - F.min("prediction")).alias("_pr"), (F.max("actual") - F.min("actual")).alias("_ar"),
        F.avg("_rp").alias("_mp"), F.avg("_ra").alias("_ma"), F.avg(F.col("_rp") * F.col("_ra")).alias("_mpa"), F.avg(F.col("_rp") ** 2).alias("_mpp"), F.avg(F.col("_ra") ** 2).alias("_maa"),
    ).join(now, "origin", "left")
    rho = F.when((F.col("_pr") > 0) & (F.col("_ar") > 0), F.try_divide(F.col("_mpa") - F.col("_mp") * F.col("_ma"), F.sqrt((F.col("_mpp") - F.col("_mp") ** 2) * (F.col("_maa") - F.col("_ma") ** 2))))
    q = q.withColumn("_rho", rho)
    gap = F.avg("now") - F.avg("best")
    rows = q.groupBy(F.col("model").alias("strategy")).agg(
        F.avg("real").alias("mean_realized"), F.avg(F.col("real") - F.col("best")).alias("mean_regret"), F.when(gap > TIE, 100.0 * (F.avg("now") - F.avg("real")) / gap).alias("captured_pct"), F.avg("_rho").alias("spearman"),
        F.avg((F.col("real") <= F.col("best") + TIE).cast("double")).alias("top1"), F.count("*").alias("n"),
    )
    one = q.groupBy("origin").agg(F.min("best").alias("best"), F.min("now").alias("now"))
    null, num = F.lit(None).cast("double"), lambda x: F.lit(float(x))
    oracle = one.agg(F.avg("best").alias("mean_realized"), F.count("*").alias("n")).select(F.lit("oracle").alias("strategy"), "mean_realized", num(0).alias("mean_regret"), num(100).alias("captured_pct"), num(1).alias("spearman"), num(1).alias("top1"), "n")
    run = one.agg(F.avg("now").alias("mean_realized"), F.avg("best").alias("_b"), F.count("now").alias("n")).select(F.lit("run_now").alias("strategy"), "mean_realized", (F.col("mean_realized") - F.col("_b")).alias("mean_regret"), num(0).alias("captured_pct"), null.alias("spearman"), null.alias("top1"), "n")
    return rows.unionByName(oracle).unionByName(run)


def attach_comparators(frame: DataFrame, direct: DataFrame, published: DataFrame, name: str = "direct") -> DataFrame:
    """``frame`` (``origin, horizon, target``) with another model's predictions of the same keys as ``name``, and ``d1``: the value published for a day before the
    target, null unless that lies before the origin. Reading a row whose key the model doesn't cover, or covers twice, is an error."""
    once = direct.groupBy("origin", "horizon", "target").agg(F.min("prediction").alias(name), F.count("*").alias("_n"))
    covered = F.assert_true(F.coalesce((F.col("_n") == 1) & F.col(name).isNotNull(), F.lit(False)), F.lit(f"{name} predictions don't cover every key once"))
    d = frame.join(once, ["origin", "horizon", "target"], "left").withColumn(name, F.when(covered.isNull(), F.col(name)))
    d = d.join(published.select((F.col("t") + 86400).alias("target"), F.col("carbon").alias("_d1")), "target", "left")
    return d.select(*frame.columns, name, F.when(F.col("target") - 86400 < F.col("origin"), F.col("_d1")).alias("d1"))


def policy(cat: DataFrame, duration: int, deadline: int, least_reduction: float = 5.0) -> DataFrame:
    """DEFER or RUN_NOW per query: defer if a window of the duration ends by the deadline with a predicted reduction of at least the given percentage."""
    d = cat.filter((F.col("duration") == duration) & (F.col("end") <= deadline))
    g = d.groupBy(*QUERY).agg(F.min(F.struct("predicted", "start", "actual")).alias("_w"), F.min_by("predicted", "start").alias("now_predicted"), F.min_by("actual", "start").alias("now_actual"), F.min("actual").alias("foresight"))
    cut = F.when(F.col("now_predicted") > 0, 100.0 * (F.col("now_predicted") - F.col("_w.predicted")) / F.col("now_predicted"))
    defer = (F.col("_w.start") > 1) & (cut >= least_reduction)
    g = g.select(*QUERY, F.when(F.coalesce(defer, F.lit(False)), "DEFER").otherwise("RUN_NOW").alias("decision"), F.when(F.coalesce(defer, F.lit(False)), F.col("_w.start")).otherwise(1).alias("start"), cut.alias("reduction_pct"), "now_actual", F.when(F.coalesce(defer, F.lit(False)), F.col("_w.actual")).otherwise(F.col("now_actual")).alias("chosen_actual"), "foresight")
    return g


def savings(p: DataFrame, energy_kwh: float, pue: float) -> DataFrame:
    """Carbon of running now, as decided and with perfect foresight for an amount of energy, the paired and the captured saving, and the facility's carbon."""
    d = p.select(*QUERY, *[(F.col(c) * energy_kwh).alias(n) for c, n in (("now_actual", "now_g"), ("chosen_actual", "chosen_g"), ("foresight", "foresight_g"))])
    pct = lambda a, b: F.when(b > 1e-12, 100.0 * a / b)
    return d.select("*", pct(F.col("now_g") - F.col("chosen_g"), F.col("now_g")).alias("saving_pct"), pct(F.col("now_g") - F.col("chosen_g"), F.col("now_g") - F.col("foresight_g")).alias("captured_pct"), (F.col("chosen_g") * pue).alias("facility_g"))
