"""Problem 8: sources combined to target shares of the total size.

Labelled documents belong to their source; the others get posteriors from a classifier trained on labelled ones. Nonnegative rates
(how often each document is used) are fitted by distributed projected-gradient least squares, so that the expected tokens of all
sources meet their targets; the rates are then rounded to whole uses that keep the token totals.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed
from .packing import enough, ranked

#: The classifier: hashed features, at most so many labelled rows per source to train on, passes and step of gradient descent.
FEATURES, SAMPLE_PER_SOURCE, EPOCHS, STEP, DECAY = 4096, 1000, 150, 2.0, 1e-4
#: The fit ends when every source's expected share is within ACCURACY of its target, or when a step moves less than STILL of all tokens (the
#: optimum under the caps). ITERATIONS only bounds a fit that does neither, which ``Fit.ended`` tells. After REPLAY steps the rates are written down.
ITERATIONS, ACCURACY, STILL, REPLAY = 300, 1e-5, 1e-7, 30
#: Largest total: labelled documents that suffice for NEARLY of the upper bound decide it, else it is sought by BISECTIONS halvings.
NEARLY, BISECTIONS = 0.99, 4
#: Sizes up to EXACT tokens are rounded size by size, larger ones in classes of 1/32 octave: a bounded number of classes.
EXACT, PER_OCTAVE = 1024, 32


def source_name(column: str = "source") -> Column:
    """Lower case, without blanks around, with underscores for hyphens and blanks."""
    return F.regexp_replace(F.lower(F.btrim(column, F.lit(" \t\r\n"))), r"[-\s]+", "_")


def features(pdf: pd.DataFrame, dimension: int = FEATURES) -> list[np.ndarray]:
    """Per row the hashed features: repository, author's mail domain, language, and all words of the whole text."""
    out = []
    for repo, mail, lang, text in zip(pdf.repo, pdf.author_email, pdf.lang, pdf.text):
        text = text or ""
        words = [f"r:{repo}", f"m:{(mail or '').rpartition('@')[2]}", f"l:{(lang or '').lower()}", *set(text.split())]
        out.append(np.unique([zlib.crc32(w.encode("utf-8", "replace")) % dimension for w in words]))
    return out


def train(sample: pd.DataFrame, names: list[str], prior: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Softmax regression on rows ``label, f`` (hashed features), weighted so that every source has its true share of the labelled rows."""
    y = np.array([names.index(s) for s in sample.label])
    X = np.zeros((len(sample), FEATURES), dtype="float32")
    for i, f in enumerate(sample.f):
        X[i, f] = 1 / np.sqrt(len(f))
    weight = (prior / np.maximum(np.bincount(y, minlength=len(names)), 1))[y].astype("float32")
    target = np.eye(len(names), dtype="float32")[y]
    Wt, b = np.zeros((FEATURES, len(names)), dtype="float32"), np.log(np.maximum(prior, 1e-9)).astype("float32")
    for _ in range(EPOCHS):
        z = X @ Wt + b
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        g = (p - target) * weight[:, None]
        Wt -= STEP * (X.T @ g + DECAY * Wt)
        b -= STEP * 0.1 * g.sum(axis=0)
    return Wt, b


def posteriors(documents: DataFrame, names: list[str]) -> DataFrame:
    """``doc_id, label, tokens`` and ``p``, the array of membership probabilities in the order of ``names``: 1 for a labelled document's source.

    ``documents`` has ``doc_id, label, tokens, repo, author_email, lang, text``. The classifier sees at most SAMPLE_PER_SOURCE labelled
    rows of each source, chosen by the hash of their id; without any labelled row all sources are equally probable.
    """
    from pyspark.sql import Window as W

    spark = documents.sparkSession
    order = W.partitionBy("label").orderBy(F.xxhash64("doc_id"), "doc_id")
    known = documents.filter(F.col("label").isNotNull())
    chosen = known.select("doc_id", "label").withColumn("_k", F.row_number().over(order)).filter(F.col("_k") <= SAMPLE_PER_SOURCE)
    text = known.join(F.broadcast(chosen.select("doc_id")), "doc_id").select("label", "repo", "author_email", "lang", "text")

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"label": pdf.label, "f": features(pdf)})

    sample = text.mapInPandas(hashed, "label string, f array<int>").toPandas()  # bounded: SAMPLE_PER_SOURCE rows of each source, FEATURES numbers in each
    counts = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    prior = np.array([counts.get(n, 0) for n in names], dtype=float)
    prior = prior / prior.sum() if prior.sum() else np.full(len(names), 1 / len(names))
    model = spark.sparkContext.broadcast(train(sample, names, prior) if len(sample) else None)

    def predict(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [np.full(len(names), 1 / len(names))] * len(pdf)
            if model.value is not None:
                Wt, b = model.value
                rows = []
                for f in features(pdf):
                    z = Wt[f].sum(axis=0) / np.sqrt(len(f)) + b
                    e = np.exp(z - z.max())
                    rows.append(e / e.sum())
            yield pd.DataFrame({"doc_id": pdf.doc_id, "tokens": pdf.tokens, "p": [np.asarray(r, dtype="float64") for r in rows]})

    soft = documents.filter(F.col("label").isNull()).select("doc_id", "tokens", "repo", "author_email", "lang", "text").mapInPandas(predict, "doc_id bigint, tokens bigint, p array<double>")
    hard = F.array(*[F.when(F.col("label") == n, 1.0).otherwise(0.0) for n in names])
    return known.select("doc_id", "label", "tokens", hard.alias("p")).unionByName(soft.select("doc_id", F.lit(None).cast("string").alias("label"), "tokens", "p"))


class Fit(NamedTuple):
    """How a fit went: tokens aimed at, iterations, largest deviation of a source's expected tokens relative to the total, and why it ended
    (``reached``, ``optimum`` under the caps, or ``iterations``)."""

    total: float
    iterations: int
    deviation: float
    ended: str


def reachable(groups: DataFrame, shares: np.ndarray) -> tuple[np.ndarray, float, float]:
    """Tokens by source, the largest total that the documents which surely are a source's own can fill, and an upper bound with all memberships."""
    k = len(shares)
    sums = lambda rate: [F.sum(F.col("p")[i] * F.col("mass") * rate) for i in range(k)]
    sure = F.when(F.array_max("p") >= 1, F.col("cap")).otherwise(0)
    row = groups.agg(*[x.alias(f"{n}{i}") for n, rate in (("m", F.lit(1.0)), ("c", F.col("cap")), ("s", sure)) for i, x in enumerate(sums(rate))]).first()
    mass, most, own = (np.array([row[f"{n}{i}"] or 0.0 for i in range(k)]) for n in "mcs")
    wanted = shares > 0
    least = lambda x: float((x[wanted] / shares[wanted]).min()) if wanted.any() else 0.0
    return mass, least(own), least(most)


GROUP = "doc_id bigint, label string, tokens bigint, p array<double>, cap int, mass double"


def fit_rates(groups: DataFrame, shares: np.ndarray, mass: np.ndarray, total: float, iterations: int = ITERATIONS) -> tuple[DataFrame, Fit]:
    """Rates 0..cap of groups of documents with one membership (``GROUP``): ``groups`` plus ``rate``, and how the fit went.

    Minimises the squared deviations of the sources' expected tokens from share * total, each divided by the source's mass. In the metric of the
    documents' sizes the step 1 is safe, because the scaled Gram matrix of the memberships has no eigenvalue above 1. Steps have momentum, which
    starts anew when the objective rises. A step is a few numbers per source, worked out on the driver from sums over all groups; workers apply the
    steps so far to their groups and sum up again.
    """
    k = len(shares)
    goal, scale = shares * total, np.divide(1.0, mass, out=np.zeros(k), where=mass > 0)
    first = goal * scale

    def applied(pdf: pd.DataFrame, steps: list) -> tuple[np.ndarray, ...]:
        p, cap = np.stack(pdf.p.to_numpy()) if len(pdf) else np.zeros((0, k)), pdf.cap.to_numpy(dtype=float)
        if "rate" in pdf:
            rate, ahead = pdf.rate.to_numpy(), pdf.ahead.to_numpy()
        else:
            rate = ahead = np.clip(p @ first, 0, cap)
        step = np.zeros(len(pdf))
        for v, momentum, anew in steps:
            new = np.clip((rate if anew else ahead) - p @ v, 0, cap)
            rate, ahead, step = new, new + momentum * (new - rate), new - rate
        return p, rate, ahead, step

    def sums(steps: list):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            out = np.zeros(2 * k + 1)
            for pdf in batches:
                p, rate, ahead, step = applied(pdf, steps)
                m = pdf.mass.to_numpy()
                out += np.concatenate([(m * rate) @ p, (m * ahead) @ p, [m @ np.abs(step)]])
            yield pd.DataFrame({"s": [out]})

        return run

    def state(steps: list):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                _, rate, ahead, _ = applied(pdf, steps)
                yield pdf.assign(rate=rate, ahead=ahead)

        return run

    columns = [c.split()[0] for c in GROUP.split(", ")]
    current, steps, t, last = groups.select(*columns), [], 1.0, np.inf
    for n in range(iterations + 1):
        now = np.sum([r.s for r in current.mapInPandas(sums(steps), "s array<double>").collect()], axis=0)  # a row for each partition
        reached, ahead, moved = now[:k], now[k : 2 * k], now[-1]
        off = float(np.abs(reached - goal).max()) / total if total > 0 else 0.0
        ended = "reached" if off <= ACCURACY else "optimum" if n and moved <= STILL * total else "iterations" if n == iterations else ""
        if ended:
            break
        value = float((scale * (reached - goal) ** 2).sum())
        anew = value > last  # momentum has overshot: on from the rates themselves
        t, last = 1.0 if anew else t, value
        after = (1 + np.sqrt(1 + 4 * t * t)) / 2
        steps.append((((reached if anew else ahead) - goal) * scale, float((t - 1) / after), anew))
        t = after
        if len(steps) == REPLAY:
            current, steps = checkpointed(current.mapInPandas(state(steps), GROUP + ", rate double, ahead double")), []
    return current.mapInPandas(state(steps), GROUP + ", rate double, ahead double").drop("ahead"), Fit(total, n, off, ended)


def size_class(tokens: Column) -> Column:
    return F.when(tokens <= EXACT, tokens).otherwise(EXACT + F.floor(F.log2(tokens / EXACT) * PER_OCTAVE)).cast("long")


SCHEMA = "doc_id bigint, label string, tokens bigint, p array<double>, rate double, cap int, uses bigint"


def mixture(documents: DataFrame, targets: DataFrame, total: float | None = None) -> tuple[DataFrame, Fit]:
    """How often to use every document: ``doc_id, label, tokens, p, rate, cap, uses``, documents with no use included; and how the fit went.

    ``documents`` has ``doc_id`` (unique), ``source, tokens, repo, author_email, lang, text``; ``targets`` has ``source_name, target_share, max_repeats``
    (a small table; rows with a null are ignored). A source that compares equal after ``source_name`` labels a document; null and unknown
    sources leave it to the classifier, and such a document is used at most as often as every source allows. Without ``total`` the largest total is
    taken whose shares all sources can fill, with their own documents and the expected tokens of the others: what the own documents suffice for if that is
    NEARLY the upper bound, else the bound, or if it can't be reached what BISECTIONS halvings find between the two. Empty texts have no tokens and rate 0. Empty tables
    give no rows.
    """
    wanted = sorted((r[0], float(r[1]), int(r[2])) for r in targets.select(source_name("source_name"), "target_share", "max_repeats").distinct().collect() if None not in tuple(r))
    names, shares, caps = [w[0] for w in wanted], np.array([w[1] for w in wanted]), np.array([max(0, w[2]) for w in wanted])
    spark = documents.sparkSession
    if not names:
        return spark.createDataFrame([], SCHEMA), Fit(0.0, 0, 0.0, "reached")
    label = source_name("source")
    labelled = documents.withColumn("label", F.when(label.isin(names), label))
    members = posteriors(labelled, names)
    cap = F.coalesce(F.element_at(F.create_map(*[x for n, c in zip(names, caps) for x in (F.lit(n), F.lit(int(c)))]), F.col("label")), F.lit(int(caps.min())))
    members = checkpointed(members.withColumn("cap", cap))
    # labelled documents of one source move alike: one group for each source; every other document is a group of its own
    some = members.filter("tokens > 0")
    sure = some.filter("label is not null").groupBy("label").agg(F.first("p").alias("p"), F.first("cap").alias("cap"), F.sum("tokens").cast("double").alias("mass"))
    columns = ["doc_id", "label", "tokens", "p", "cap", F.col("tokens").cast("double").alias("mass")]
    groups = some.filter("label is null").select(*columns).unionByName(sure.select(F.lit(None).cast("bigint").alias("doc_id"), "label", F.lit(None).cast("bigint").alias("tokens"), "p", "cap", "mass"))
    groups = checkpointed(groups.hint("rebalance"))  # few rows, read once for each iteration
    mass, own, most = reachable(groups, shares)
    aim = total if total is not None else own if own >= NEARLY * most else most
    rates, fit = fit_rates(groups, shares, mass, aim)
    if total is None and aim > own and fit.deviation > ACCURACY:
        low, high, (rates, fit) = own, most, fit_rates(groups, shares, mass, own)
        for _ in range(BISECTIONS):
            middle = fit_rates(groups, shares, mass, (low + high) / 2)
            if middle[1].deviation <= ACCURACY:
                low, (rates, fit) = (low + high) / 2, middle
            else:
                high = (low + high) / 2
    rates = checkpointed(rates)
    by_source = rates.filter("label is not null").select("label", "rate")  # a row for each source
    hard = members.filter("label is not null").join(F.broadcast(by_source), "label", "left").withColumn("rate", F.when(F.col("tokens") > 0, F.coalesce("rate", F.lit(0.0))).otherwise(0.0))
    keep = ["doc_id", "label", "tokens", "p", "cap", "rate"]
    d = hard.select(*keep).unionByName(rates.filter("label is null").select(*keep))
    d = d.unionByName(members.filter("label is null and coalesce(tokens, 0) <= 0").select(*keep[:-1], F.lit(0.0).alias("rate")))
    d = checkpointed(d.withColumn("_class", size_class(F.col("tokens"))))
    return _rounded(d), fit


def _rounded(d: DataFrame) -> DataFrame:
    """Whole uses: the rate's whole part, and one more for as many documents of each size class as the token balance asks for.

    Per source the size classes (a bounded number) are gone through from large to small, and what one class is over or under is made
    good by the next; which documents of a class get the extra use is settled by rank.
    """
    spark = d.sparkSession
    part = F.col("rate") - F.floor("rate")
    kind = F.coalesce("label", F.lit(""))
    d = d.withColumn("_kind", kind).withColumn("_part", part)
    rows = d.filter("_part > 0").groupBy("_kind", "_class").agg(F.count("*").alias("n"), F.avg("tokens").alias("size"), F.sum(F.col("_part") * F.col("tokens")).alias("due")).collect()
    extra, debt = [], {}
    for r in sorted(rows, key=lambda r: (r["_kind"], -r["_class"])):
        owed = debt.get(r["_kind"], 0.0) + r["due"]
        take = int(min(r["n"], max(0, np.floor(owed / r["size"] + 0.5))))
        debt[r["_kind"]] = owed - take * r["size"]
        extra.append((r["_kind"], r["_class"], take))
    plan = spark.createDataFrame(extra, "_kind string, _class bigint, _take bigint")
    fractional = ranked(d.filter("_part > 0"), ["_kind", "_class"], ["doc_id"], enough(max((r["n"] for r in rows), default=0))).join(F.broadcast(plan), ["_kind", "_class"])
    fractional = fractional.withColumn("uses", (F.floor("rate") + (F.col("rank") < F.col("_take")).cast("int")).cast("long"))
    columns = ["doc_id", "label", "tokens", "p", "rate", "cap", "uses"]
    whole = d.filter("_part = 0").withColumn("uses", F.floor("rate").cast("long"))
    return fractional.select(*columns).unionByName(whole.select(*columns))


def reached_shares(mixed: DataFrame, fit: Fit, targets: DataFrame) -> DataFrame:
    """Per source: target share, share of the tokens really used (by label), expected share with the unlabelled documents' posteriors, documents, most uses;
    and of the whole fit the deviation (of the total), the iterations and why it ended."""
    names = sorted(r[0] for r in targets.select(source_name("source_name"), "target_share", "max_repeats").distinct().collect() if None not in tuple(r))
    used = F.col("tokens") * F.col("uses")
    listed = F.array(*[F.struct(F.lit(n).alias("source"), (F.col("p")[i]).alias("w")) for i, n in enumerate(names)])
    d = mixed.select("label", used.alias("used"), "uses", F.inline(listed)).filter("w > 0")
    own = F.col("label").eqNullSafe(F.col("source"))
    per = d.groupBy("source").agg(
        F.sum(F.when(own, F.col("used")).otherwise(0)).alias("tokens"), F.sum(F.col("w") * F.col("used")).alias("expected_tokens"), F.sum((own & (F.col("uses") > 0)).cast("long")).alias("documents"), F.max(F.when(own, F.col("uses"))).alias("most_uses")
    )
    t = targets.select(source_name("source_name").alias("source"), "target_share", "max_repeats").distinct()
    total = mixed.agg(F.sum(used).alias("total"))
    d = t.join(per, "source", "left").join(F.broadcast(total))  # one row
    return d.select("source", "target_share", (F.col("tokens") / F.col("total")).alias("labelled_share"), (F.col("expected_tokens") / F.col("total")).alias("expected_share"), "tokens", "documents", "max_repeats", "most_uses", F.lit(fit.deviation).alias("deviation"), F.lit(fit.iterations).alias("iterations"), F.lit(fit.ended).alias("ended"))
