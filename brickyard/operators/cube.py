"""A mergeable histogram of whole numbers, and exact moments and quantiles of all its roll-ups.

``histogram`` counts the values of every cell (a combination of dimension values) by bucket.  A bucket holds the
numbers that agree in sign and in their ten leading bits, and at most 2^20 numbers, so its lower end is
known from any of its values.  Per bucket it keeps the count, the sum and the sum of squares of the
distances to that end, the smallest and the largest value and the days seen: whole numbers throughout.
Histograms of separate rows **merge** by plain sums, in any order and any partitioning, to the same bits.

``rolled`` sums cells to groups (grouping sets that overlap are fine: a cell belongs to as many groups as it
names).  ``profiles`` turns that into one row per group.  Mean and deviation come from exact totals, the
deviation around the whole number next to the mean.  For quantiles the running count tells the buckets
that hold the wanted ranks (targets).  One further read of the rows serves the targets of all groups at
once: only rows in a cell's bucket that some target needs are kept, counted by value before they are shuffled, and
ranked within their bucket.  A task ranks at most the 2^20 numbers of a bucket, whatever the size of the group.

The result of a quantile is ``lo * (1 - f) + hi * f`` with ``pos = (n - 1) * q``, ``f = pos - floor(pos)`` and the values
at the ranks around ``pos``: PERCENTILE_CONT.  In this form a median is rounded once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import materialize

#: Leading bits that a bucket's values share (1/512: a bucket is at most 0.2 % wide).
BITS = 10
#: A bucket never holds more numbers than two to this power.
MOST_BITS = 20

COUNTS = ("n", "s", "q", "mn", "mx", "days")
WHOLE = "decimal(38,0)"


def bucket(v: Column) -> Column:
    """Lower end (towards 0) of the bucket of a whole number; ascends with the number."""
    size = F.abs(v)
    shift = F.least(F.greatest(F.length(F.bin(size)) - F.lit(BITS), F.lit(0)), F.lit(MOST_BITS))
    low = F.call_function("shiftleft", F.call_function("shiftright", size, shift), shift)
    return F.when(v < 0, -low).otherwise(low)


def _off() -> Column:
    return F.col("v") - F.col("b")


# Sums of squares go by their upper and lower bits, each a long: a sum of decimals costs several times as much.
def _bits(q: Column) -> tuple[Column, Column]:
    """A whole number of at least 0 as two."""
    unit = F.lit(1 << MOST_BITS)
    return F.call_function("div", q, unit).cast("bigint"), (q % unit).cast("bigint")


def _whole(high: Column, low: Column) -> Column:
    return (high.cast("decimal(19,0)") * F.lit(1 << MOST_BITS).cast("decimal(7,0)") + low.cast("decimal(19,0)")).cast(WHOLE)


def histogram(rows: DataFrame, dims: Sequence[str]) -> DataFrame:
    """(dims, b, n, s, q, mn, mx, days) of rows with dims, the whole number ``v`` and the day of the month ``day``."""
    square = _off() * _off()  # below 2^40
    return rows.withColumn("b", bucket(F.col("v"))).groupBy(*dims, "b").agg(
        F.count(F.lit(1)).alias("n"), F.sum(_off()).alias("s"),
        _whole(F.sum(F.shiftright(square, MOST_BITS)), F.sum(square.bitwiseAND(F.lit((1 << MOST_BITS) - 1)))).alias("q"),
        F.min("v").alias("mn"), F.max("v").alias("mx"),
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("day"))).alias("days"))


def rolled(hist: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Histograms summed to ``keys``: roll-up, or merge of several histograms of the same cells."""
    return hist.groupBy(*keys, "b").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").cast(WHOLE).alias("q"), F.min("mn").alias("mn"), F.max("mx").alias("mx"),
                                        F.bit_or("days").alias("days"))


def _groups(df: DataFrame, sets: Column, *more: str) -> DataFrame:
    """Rows of ``df`` once for each group they belong to."""
    return df.select(*more, F.explode(sets).alias("k")).where("k is not null").select(*more, "k.*")


def profiles(rows: DataFrame, hist: DataFrame, dims: Sequence[str], sets: Column, keys: Sequence[str],
             quantiles: Column, names: Sequence[str], scale: int = 100, exact: bool = True) -> DataFrame:
    """One row per group: keys, n, total, mean, min, max, stddev, days and one column per quantile.

    ``sets`` gives a cell's groups (an array of structs of ``keys``; NULL is no group), ``quantiles`` those wanted for a group (an array of
    (name, p) structs over ``keys``), ``names`` all of their names.  Dimensions and keys hold no NULLs.  Values are whole
    numbers in 1/``scale``; ``total`` is an exact decimal, the others are doubles in units.  Not
    ``exact``: quantiles are interpolated within their bucket, without a further read of the rows.
    """
    keys, dims = list(keys), list(dims)
    high, low = _bits(F.col("q"))
    each = _groups(hist.select("*", high.alias("qh"), low.alias("ql")), sets, "b", "n", "s", "qh", "ql", "mn", "mx", "days")
    # the groups' histogram: all that follows reads it, not the groups' cells
    g = each.groupBy(*keys, "b").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("qh").alias("qh"), F.sum("ql").alias("ql"),
                                     F.min("mn").alias("mn"), F.max("mx").alias("mx"), F.bit_or("days").alias("days"))
    sums = _sums(_whole(F.col("qh"), F.col("ql")))
    if not names:
        return _moments(g.groupBy(*keys).agg(*[v.alias(k) for k, v in sums.items()]), keys, scale)
    group = Window.partitionBy(*keys)
    upto = group.orderBy("b").rowsBetween(Window.unboundedPreceding, 0)
    g = g.select(*keys, "b", "n", "mn", "mx", *[v.over(group).alias(f"all_{k}") for k, v in sums.items()], F.sum("n").over(upto).alias("end"))
    # the ranks around a quantile's position; a bucket that holds one of them is a target.  A nameless quantile, the
    # smallest value, makes a target in every group: it carries the group's sums
    wanted = F.concat(quantiles, F.array(F.struct(F.lit(None).cast("string").alias("name"), F.lit(0.0).alias("p"))))
    asked = g.select("*", F.inline(wanted)).withColumn("pos", (F.col("all_n") - 1) * F.col("p")).withColumn("low", F.floor("pos"))
    start = F.col("end") - F.col("n")
    asked = asked.where((F.ceil("pos") >= start) & (F.col("low") < F.col("end"))).withColumn("f", F.col("pos") - F.col("low"))
    sides = F.array(F.struct(F.lit(False).alias("upper"), F.col("low").alias("at")), F.struct(F.lit(True).alias("upper"), F.ceil("pos").alias("at")))
    targets = (asked.select("*", F.inline(sides)).where((F.col("at") >= start) & (F.col("at") < F.col("end")))
               .select(*keys, "b", "name", "upper", "f", (F.col("at") - start).alias("rank"), "n", "mn", "mx", *[f"all_{k}" for k in sums]))
    targets = materialize(targets)
    stats = _moments(targets.where("name is null and not upper").select(*keys, *[F.col(f"all_{k}").alias(k) for k in sums]), keys, scale)
    targets = targets.where("name is not null")
    one = targets.where("mn = mx").select(*keys, "name", "upper", "f", F.col("mn").cast("double").alias("x"))
    more = targets.where("mn < mx")
    if exact:
        found = _ranked(rows, hist, dims, sets, keys, more)
    else:
        found = more.select(*keys, "name", "upper", "f", (F.col("mn") + (F.col("mx") - F.col("mn")) * (F.col("rank") + 0.5) / F.col("n")).alias("x"))
    # in units before they are interpolated: the form that SQL and pandas compute
    both = one.unionByName(found).withColumn("x", F.col("x") / F.lit(float(scale)))
    at = lambda q, side: F.max(F.when((F.col("name") == q) & (F.col("upper") == side), F.col("x")))
    part = lambda q: F.max(F.when(F.col("name") == q, F.col("f")))
    picked = both.groupBy(*keys).agg(*[(at(q, False) * (F.lit(1.0) - part(q)) + at(q, True) * part(q)).alias(q) for q in names])
    return stats.join(picked, keys, "left")


def _sums(squares: Column) -> dict[str, Column]:
    """Exact sums of a group over its buckets, given a bucket's sum of squares around its end."""
    b, n, s = F.col("b").cast("decimal(19,0)"), F.col("n").cast("decimal(18,0)"), F.col("s").cast("decimal(19,0)")
    squares = squares + (b * s * 2).cast(WHOLE) + ((b * b).cast(WHOLE) * n).cast(WHOLE)  # of the values, from those around b
    return {"n": F.sum("n"), "t": F.sum(((b * n).cast(WHOLE) + s).cast(WHOLE)), "v": F.sum(squares.cast(WHOLE)),
            "least": F.min("mn"), "most": F.max("mx"), "seen": F.bit_or("days")}


def _moments(t: DataFrame, keys: list[str], scale: int) -> DataFrame:
    """What follows from the exact sums of every group."""
    unit, count, n = F.lit(float(scale)), F.col("n").cast("double"), F.col("n").cast("decimal(18,0)")
    # squares around the whole number c next to the mean, still exact; the mean is less than one away from it
    t = t.withColumn("c", F.round(F.col("t") / n).cast("decimal(19,0)"))
    around = F.col("v") - (F.col("c") * F.col("t") * 2).cast(WHOLE) + ((F.col("c") * F.col("c")).cast(WHOLE) * n).cast(WHOLE)
    shift = (F.col("t") - (F.col("c") * n).cast(WHOLE)).cast("double") / count
    return t.select(*keys, "n", (F.col("t") / F.lit(scale).cast("decimal(3,0)")).cast("decimal(38,2)").alias("total"), (F.col("t").cast("double") / count / unit).alias("mean"),
                    (F.col("least") / unit).alias("min"), (F.col("most") / unit).alias("max"),
                    F.when(F.col("n") > 1, F.sqrt(F.greatest(around.cast("double") - count * shift * shift, F.lit(0.0)) / (count - 1)) / unit).alias("stddev"),
                    F.bit_count("seen").cast("int").alias("days"))


#: Up to so many buckets of groups are sent to all executors.
FEW = 50_000


def _ranked(rows: DataFrame, hist: DataFrame, dims: list[str], sets: Column, keys: list[str], targets: DataFrame) -> DataFrame:
    """The values at the targets' ranks, from one read of the rows."""
    at, cell = [*keys, "b"], [*dims, "b"]
    asked = targets.select(*at).distinct()
    # there are a few for each group; what was checkpointed has no size that Spark knows
    few = F.broadcast if targets.count() <= FEW else lambda df: df
    buckets = few(asked.select("b").distinct())  # few buckets are asked for at all
    # the cells' buckets that groups ask for, with the groups that do; the read is for those of more than one value
    inner = [f"d_{d}" for d in dims]
    named = hist.join(buckets, "b", "left_semi").select("*", *[F.col(d).alias(i) for d, i in zip(dims, inner, strict=True)])
    hits = _groups(named, sets, *inner, "b", "n", "mn", "mx").join(few(asked), at, "left_semi")
    several = hits.where("mn < mx").select(*inner, *at)
    needed = several.select(*[F.col(i).alias(d) for d, i in zip(dims, inner, strict=True)], "b").distinct()
    # an inner join, as needed is distinct: Spark would move a semi-join below the projection that makes the dimensions,
    # and make them twice
    read = (rows.select(*dims, "v").withColumn("b", bucket(F.col("v"))).join(buckets, "b", "left_semi").join(needed, cell)
            .groupBy(*cell, "v").agg(F.count(F.lit(1)).alias("m")).select(*[F.col(d).alias(i) for d, i in zip(dims, inner, strict=True)], "b", "v", "m"))
    values = several.join(read, [*inner, "b"]).select(*at, "v", "m").unionByName(hits.where("mn = mx").select(*at, F.col("mn").alias("v"), F.col("n").alias("m")))
    values = values.groupBy(*at, "v").agg(F.sum("m").alias("m"))
    values = values.withColumn("upto", F.sum("m").over(Window.partitionBy(*at).orderBy("v").rowsBetween(Window.unboundedPreceding, 0)))
    return (targets.join(values, at).where((F.col("rank") < F.col("upto")) & (F.col("rank") >= F.col("upto") - F.col("m")))
            .select(*keys, "name", "upper", "f", F.col("v").cast("double").alias("x")))
