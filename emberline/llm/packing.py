"""Problem 7: items of varying length in containers of fixed capacity.

Best-fit decreasing over the whole table: lengths are whole numbers up to the capacity, so the algorithm runs on the histogram of
lengths (at most as many rows as the capacity, however large the table), with a segment tree over remaining capacities that finds the
tightest open container. Containers in the same state are handled together; the result is a list of placements, by which every item
finds its container from its rank among the items of its length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import checkpointed

#: Items of one length are ranked in this many buckets or more, so that a bucket holds about PER_BUCKET items of the most frequent length.
BUCKETS, PER_BUCKET = 64, 200_000


def enough(most: int, buckets: int = BUCKETS) -> int:
    """Buckets for ``most`` items of one length."""
    return max(buckets, -(-most // PER_BUCKET))


class OpenBins:
    """Ranges of open containers by remaining capacity, and a segment tree that finds the least remaining capacity >= a size."""

    def __init__(self, capacity: int):
        self.leaves = 1 << max(1, capacity.bit_length())
        self.some = bytearray(2 * self.leaves)
        self.ranges: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]

    def add(self, remaining: int, first: int, count: int) -> None:
        if remaining > 0 and count > 0:
            if not self.ranges[remaining]:
                k = remaining + self.leaves
                while k and not self.some[k]:
                    self.some[k] = 1
                    k >>= 1
            self.ranges[remaining].append((first, count))

    def take(self, remaining: int) -> tuple[int, int]:
        taken = self.ranges[remaining].pop()
        if not self.ranges[remaining]:
            k = remaining + self.leaves
            self.some[k] = 0
            while k > 1 and not self.some[k ^ 1]:
                k >>= 1
                self.some[k] = 0
        return taken

    def tightest(self, size: int) -> int:
        """Least remaining capacity >= size with an open container; 0 if there is none."""
        k = size + self.leaves
        if self.some[k]:
            return size
        while k > 1:
            if not k & 1 and self.some[k + 1]:
                k += 1
                while k < self.leaves:
                    k = 2 * k + (not self.some[2 * k])
                return k - self.leaves
            k >>= 1
        return 0


def placements(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Best-fit decreasing on a histogram of sizes 1..capacity: rows ``(size, rank_from, rank_to, first_bin, per_bin)`` and the number of containers.

    The items of one size with ranks from rank_from on go per_bin to a container, from first_bin on. Each size splits at most one range of containers
    and opens at most two new ones, and filling a range leaves less than half of its remaining capacity, so there are at most
    3 * capacity * log2(capacity) rows whatever the counts.
    """
    bins, rows, opened = OpenBins(capacity), [], 0
    for size in sorted(counts, reverse=True):
        left, rank = counts[size], 0
        while left:
            remaining = bins.tightest(size)
            if remaining:
                first, count = bins.take(remaining)
            else:
                remaining = capacity
                first, count = opened, -(-left // (capacity // size))
                opened += count
            per = remaining // size
            full = min(count, left // per)
            if full:
                rows.append((size, rank, rank + full * per, first, per))
                rank, left = rank + full * per, left - full * per
                bins.add(remaining - per * size, first, full)
            used = full
            if full < count and left:  # the last items of this size: fewer than fill one more container
                rows.append((size, rank, rank + left, first + full, left))
                bins.add(remaining - left * size, first + full, 1)
                rank, left, used = rank + left, 0, full + 1
            bins.add(remaining, first + used, count - used)
    return rows, opened


def ranked(items: DataFrame, keys: list[str], order: list[str], buckets: int = BUCKETS) -> DataFrame:
    """``items`` with ``rank``: 0, 1, ... among the rows of equal keys, in an order fixed by the columns ``order`` (unique per row).

    Ranks are taken within hashed buckets and moved by the buckets' offsets, so no task sees all rows of a key.
    """
    d = items.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    by = [*keys, "_bucket"]
    counts = d.groupBy(*by).agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.partitionBy(*keys).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select(*by, before.alias("_before"))
    local = d.withColumn("_local", F.row_number().over(W.partitionBy(*by).orderBy(*order)) - 1)
    return local.join(offsets, by).withColumn("rank", F.col("_before") + F.col("_local")).drop("_bucket", "_local", "_before")


def pack(sizes: DataFrame, containers: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """Every piece of every document in a container of each class: ``container_class, doc_id, piece, tokens, container_id``.

    ``sizes`` has ``doc_id`` (unique) and ``tokens``; ``containers`` has ``container_class`` and ``capacity_tokens`` (a small fixed table, read by
    the driver; rows with a null or a capacity below 1 are ignored). A document that exceeds the capacity is cut into full pieces and a
    rest; others have the one piece 0. Documents without tokens (null or empty texts) take no space: they come out once per class with a null
    container. An empty table gives no rows.
    """
    spark = sizes.sparkSession
    classes = [(r[0], int(r[1])) for r in containers.select("container_class", "capacity_tokens").distinct().collect() if r[0] is not None and r[1] is not None and r[1] >= 1]
    if not classes:
        return spark.createDataFrame([], "container_class string, doc_id bigint, piece bigint, tokens bigint, container_id bigint")
    sizes = checkpointed(sizes.select("doc_id", F.greatest(F.coalesce("tokens", F.lit(0)), F.lit(0)).cast("long").alias("tokens")))  # counted once, read for the histogram and for the ranks
    listed = F.array(*[F.struct(F.lit(i).alias("_class"), F.lit(c).cast("long").alias("_capacity")) for i, (_, c) in enumerate(classes)])
    d = sizes.select("doc_id", "tokens", F.inline(listed))
    whole, rest = F.expr("tokens div _capacity"), F.col("tokens") % F.col("_capacity")
    histogram = d.select("_class", F.inline(F.array(F.struct(F.col("_capacity").alias("size"), whole.alias("n")), F.struct(rest.alias("size"), F.lit(1).cast("long").alias("n"))))).filter("n > 0 and size > 0")
    counted = histogram.groupBy("_class", "size").agg(F.sum("n").alias("n")).collect()  # at most the sum of the capacities
    plan: dict[int, list[tuple[int, int, int, int, int]]] = {}
    for i, (_, capacity) in enumerate(classes):
        plan[i] = placements({r["size"]: r["n"] for r in counted if r["_class"] == i}, capacity)[0]
    table = {i: tuple(np.array(sorted(rows), dtype="int64").reshape(-1, 5).T) for i, rows in plan.items()}
    shared = spark.sparkContext.broadcast(table)
    piece = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.expr("cast(ceil(tokens / _capacity) as bigint)"), F.lit(1)) - 1))
    items = d.withColumn("piece", piece).withColumn("size", F.least(F.col("tokens") - F.col("piece") * F.col("_capacity"), F.col("_capacity")))
    items = ranked(items.select("_class", "doc_id", "piece", "size"), ["_class", "size"], ["doc_id", "piece"], enough(max((r["n"] for r in counted), default=0), buckets))
    names = [name for name, _ in classes]

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lookup = shared.value
        for pdf in batches:
            bin_id = pd.array([pd.NA] * len(pdf), dtype="Int64")
            for i, (size, start, _, first, per) in lookup.items():
                here = np.flatnonzero((pdf["_class"].to_numpy() == i) & (pdf["size"].to_numpy() > 0))
                if len(here):
                    s, r = pdf["size"].to_numpy()[here], pdf["rank"].to_numpy()[here]
                    base = int(max(start.max(), r.max())) + 1  # one sorted key of (size, rank); sizes and ranks stay far below 2 ** 31
                    at = np.searchsorted(size * base + start, s * base + r, side="right") - 1
                    bin_id[here] = first[at] + (r - start[at]) // per[at]
            yield pd.DataFrame({"container_class": [names[i] for i in pdf["_class"]], "doc_id": pdf["doc_id"], "piece": pdf["piece"], "tokens": pdf["size"], "container_id": bin_id})

    return items.select("_class", "size", "rank", "doc_id", "piece").mapInPandas(place, "container_class string, doc_id bigint, piece bigint, tokens bigint, container_id bigint")


def fill_report(packed: DataFrame, containers: DataFrame) -> DataFrame:
    """Per class: containers used, tokens in them, unused tokens, the share filled, and the fewest containers that could hold the tokens."""
    used = packed.filter("container_id is not null").groupBy("container_class", "container_id").agg(F.sum("tokens").alias("t"))
    per = used.groupBy("container_class").agg(F.count("*").alias("containers"), F.sum("t").alias("tokens"), F.max("t").alias("fullest"))
    d = per.join(containers.select("container_class", "capacity_tokens").distinct(), "container_class")
    space = F.col("containers") * F.col("capacity_tokens")
    return d.select("container_class", "containers", "tokens", "fullest", (space - F.col("tokens")).alias("unused"), (F.col("tokens") / space).alias("filled"), F.ceil(F.col("tokens") / F.col("capacity_tokens")).alias("fewest"))
