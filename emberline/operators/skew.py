"""Help against hot keys: bounded lists of hot keys, salts on one side, copies on the other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: A key is hot if it holds more than this share of all rows, and more than LEAST rows. At most 1 / SHARE keys can be hot,
#: which bounds every broadcast of the list.
SHARE, LEAST = 1 / 128, 50_000


def hot_keys(df: DataFrame, keys: list[str], share: float = SHARE, least: int = LEAST) -> DataFrame:
    """``keys`` and the number of ``_salts`` of each key with more than its share of rows: at most ``1 / share`` rows. No job runs while the plan is built."""
    counted = df.groupBy(*keys).agg(F.count("*").alias("_n"))
    limit = F.greatest(F.lit(float(least)), F.col("_total") * share)
    total = counted.agg(F.sum("_n").alias("_total"))  # one row
    return counted.join(F.broadcast(total)).filter(F.col("_n") > limit).select(*keys, F.ceil(F.col("_n") / limit).cast("int").alias("_salts"))


def salted(df: DataFrame, hot: DataFrame, keys: list[str], row_id: str) -> DataFrame:
    """``df`` with ``_salt``: 0, or for rows of hot keys a number drawn from the row's identity (the same on a retry)."""
    return df.join(F.broadcast(hot), keys, "left").withColumn("_salt", F.coalesce(F.pmod(F.xxhash64(row_id), F.col("_salts")).cast("int"), F.lit(0))).drop("_salts")


def copied(df: DataFrame, hot: DataFrame, keys: list[str]) -> DataFrame:
    """``df`` with each row of a hot key once for each ``_salt``."""
    return df.join(F.broadcast(hot), keys, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_salts"), F.lit(1)) - 1))).drop("_salts")


def side_by_side(left: DataFrame, right: DataFrame, keys: list[str], width: int, after: float, before: float, row_id: str, share: float = SHARE, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """Both sides of a join by time, placed in cells of time that bounded tasks can sort: each with ``_b, _piece, _salt``.

    Both have ``keys`` and ``_t`` (not null), ``right`` also a struct ``_r`` and no two rows of one key and time. A left row's partners lie in its own cell: the right rows of the
    cell, and of each earlier cell the last row (if it reaches it within ``after``), of each later cell the first one (within ``before``). Rows of
    both sides are counted: cells crowded on the right are cut into pieces of time, of whose rows again only the last and first are entered
    elsewhere; in cells crowded on the left the left rows are spread over salts, for each of which the piece's right rows are copied.
    """
    cell = lambda c: floor_div(F.floor(c).cast("long"), width)
    by = [*keys, "_b"]
    lo, ro = left.withColumn("_b", cell(F.col("_t"))), right.withColumn("_b", cell(F.col("_t")))
    counted = lo.select(*by, F.lit(1).alias("_l"), F.lit(0).alias("_n")).unionByName(ro.select(*by, F.lit(0).alias("_l"), F.lit(1).alias("_n"))).groupBy(*by).agg(F.sum("_l").alias("_l"), F.sum("_n").alias("_n"))
    total = counted.agg((F.sum("_l") + F.sum("_n")).alias("_total"))  # one row
    limit = F.greatest(F.lit(float(least)), F.col("_total") * share)
    hot = counted.join(F.broadcast(total)).filter((F.col("_l") > limit) | (F.col("_n") > limit)).select(*by, F.ceil(F.col("_l") / limit).cast("int").alias("_salts"), F.ceil(F.col("_n") / limit).cast("int").alias("_pieces"))
    hot = F.broadcast(hot)  # at most 2 / share rows
    one = lambda c: F.greatest(F.coalesce(c, F.lit(1)), F.lit(1))
    piece = lambda t: F.least(F.greatest(F.floor((t - F.col("_b") * width) * one(F.col("_pieces")) / width), F.lit(0)), one(F.col("_pieces")) - 1).cast("int")
    lo = lo.join(hot, by, "left").withColumn("_piece", piece(F.col("_t"))).withColumn("_salt", F.pmod(F.xxhash64(row_id), one(F.col("_salts"))).cast("int")).drop("_salts", "_pieces")
    own = ro.join(hot, by, "left").withColumn("_piece", piece(F.col("_t")))
    ends = own.groupBy(*by, "_piece").agg(F.max(F.struct("_t", "_r")).alias("_last"), F.min(F.struct("_t", "_r")).alias("_first"))
    entered = []
    sides = [("_last", F.col("_last._t"), F.col("_last._t") + after), ("_first", F.col("_first._t") - before, F.col("_first._t"))]
    for row, low, high in sides[: 2 if before else 1]:
        d = ends.select(*keys, F.col("_b").alias("_ob"), F.col("_piece").alias("_op"), f"{row}._t", f"{row}._r", low.alias("_low"), high.alias("_high"))
        d = d.withColumn("_b", F.explode(F.sequence(cell(F.col("_low")), cell(F.col("_high"))))).join(hot, by, "left")
        d = d.withColumn("_piece", F.explode(F.sequence(piece(F.col("_low")), piece(F.col("_high"))))).filter("not (_b = _ob and _piece = _op)")
        entered.append(d.select(*by, "_piece", "_salts", "_t", "_r"))
    both = own.select(*by, "_piece", "_salts", "_t", "_r")
    for d in entered:
        both = both.unionByName(d)
    return lo, both.withColumn("_salt", F.explode(F.sequence(F.lit(0), one(F.col("_salts")) - 1))).drop("_salts")


def clean_key(column: Column | str) -> Column:
    """Upper case without white space around: how identifiers, areas and statuses compare."""
    return F.upper(F.btrim(column, F.lit(" \t\r\n ")))


def floor_div(x: Column, width: Column | int) -> Column:
    """Exact integer quotient, rounded down, of bigints."""
    w = F.lit(width) if isinstance(width, int) else width
    return ((x - F.pmod(x, w)) / w).cast("long")  # the division is exact: the dividend is a multiple below 2 ** 53


def next_in_order(df: DataFrame, keys: list[str], order: list[str], width: int, payload: list[str], out: str = "_next") -> DataFrame:
    """Add ``out``: the struct (order, payload) of the next row of the same keys, or null.

    ``order[0]`` is a number (a time); rows are cut into chunks of ``width`` along it, so a key that holds a third
    of all rows is still sorted by many tasks. The next row of a chunk's last row is the first one of the next chunk
    that has rows, found among one row per chunk.
    """
    d = df.withColumn("_chunk", floor_div(F.floor(order[0]).cast("long"), width))
    by = [*keys, "_chunk"]
    row = F.struct(*order, *payload)
    heads = d.groupBy(*by).agg(F.min(row).alias("_head"))
    ahead = heads.select(*by, F.lead("_head").over(W.partitionBy(*keys).orderBy("_chunk")).alias("_ahead"))
    inner = d.withColumn(out, F.lead(row).over(W.partitionBy(*by).orderBy(*order)))
    joined = inner.alias("i").join(ahead.alias("a"), [F.col(f"i.{k}").eqNullSafe(F.col(f"a.{k}")) for k in by], "left")
    return joined.select(*[f"i.{c}" for c in df.columns], F.coalesce(F.col(f"i.{out}"), F.col("a._ahead")).alias(out))


def spread(df: DataFrame, key: str) -> DataFrame:
    """``df``, hashed over all cores if it would otherwise come in fewer partitions than there are (a small input in one file).

    For work that costs far more than the shuffle of its rows; large inputs have enough partitions and are left alone.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df
