"""Exact grouped quantiles (PERCENTILE_CONT) and moments of doubles without one-task groups.

Prices are whole cents and go through ``cube``; this operator serves columns of doubles.

Spark's ``percentile`` keeps, per group, a map of every distinct value and
merges a group's maps in one task: one heavy place (the capital may hold a
third of all sales) then sits in a single task's memory.  This operator
computes the same numbers with bounded state per task:

1. **Histogram.**  Each value falls in a log-scale bucket
   ``floor(sign(v) * log1p(|v|) * RES)`` (monotone in ``v``; ~0.2 % wide).
   ``groupBy(keys, bucket)`` with map-side partial aggregation gives per
   bucket: count, sum, min, max and the central second moment; per-group
   windows add the running count, group totals and merged moments (Chan et
   al.).  Its size is groups x occupied buckets, not rows.  It is
   checkpointed (lineage cut; pass 2 does not recompute pass 1) while its
   largest bucket is observed.
2. **Targets.**  For each probability ``q`` with ``pos = (n - 1) * q``, the
   buckets holding ranks ``floor(pos)`` and ``ceil(pos)`` become target
   value ranges [bucket min, bucket max] with the rank wanted inside.
3. **Refinement** (only if some bucket exceeds ``max_range_rows``).  A big
   target range is split into ``sub_buckets`` linear sub-ranges over only
   its rows (partial-aggregated count/min/max), the sub-range holding the
   rank becomes the target; repeat until small or single-valued.
4. **Resolve.**  A single-valued range is its own answer.  Otherwise the
   range's rows (join on keys + level-0 bucket + ``lo <= v <= hi``, broadcast
   only where Spark finds the targets small in bytes) are de-duplicated into
   (value, count) map-side and ranked: at most ``max_range_rows`` rows per
   range, whatever the group size.

The result is ``lo + (hi - lo) * (pos - floor(pos))``: the definition of
PERCENTILE_CONT / DuckDB ``quantile_cont`` / Spark ``percentile``.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation, Window, functions as F

from ..session import materialize

RES = 512.0  # buckets per unit of log1p(|v|)
DEFAULT_MAX_RANGE_ROWS = 2_000_000  # rows one task may rank for one target range


def value_bucket(v: Column) -> Column:
    return F.floor(F.signum(v) * F.log1p(F.abs(v)) * F.lit(RES))


def _ns_cond(left: DataFrame, right: DataFrame, keys: Sequence[str]):
    """Null-safe equality on ``keys`` (SQL GROUP BY keeps a NULL group)."""
    cond = None
    for k in keys:
        c = left[k].eqNullSafe(right[f"__r_{k}"])
        cond = c if cond is None else cond & c
    return cond


def _renamed(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    for k in keys:
        df = df.withColumnRenamed(k, f"__r_{k}")
    return df


def _ns_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """Equi-join on ``keys`` that also matches NULL keys."""
    if not keys:
        raise ValueError("join keys required")
    r = _renamed(right, keys)
    out = left.join(r, _ns_cond(left, r, keys), how)
    return out if how == "left_semi" else out.drop(*[f"__r_{k}" for k in keys])


def _in_ranges(base: DataFrame, ranges: DataFrame, keys: Sequence[str], v: str) -> DataFrame:
    """Rows of ``base`` inside one of the (disjoint) value ranges of their group and level-0 bucket.

    Equi-join on (keys, bucket) plus ``lo <= v <= hi``: a hot group is spread
    over its buckets; a hot bucket is split by AQE's skew-join handling.
    """
    jk = list(keys) + ["__b"]
    r = _renamed(ranges, jk)
    cond = _ns_cond(base, r, jk) & (base[v] >= r["__lo"]) & (base[v] <= r["__hi"])
    return base.join(r, cond, "inner").drop(*[f"__r_{k}" for k in jk])


def approx_profile(df: DataFrame, keys: Sequence[str], value: str,
                   quantiles: Mapping[str, float] | None = None, accuracy: int = 10_000) -> DataFrame:
    """Opt-in approximate form: one aggregation with a bounded-size quantile sketch per group
    (``percentile_approx``, rank error <= 1/accuracy).  Same columns as ``grouped_profile``."""
    keys = list(keys)
    quantiles = dict(quantiles or {})
    _check_quantiles(quantiles, keys)
    v = F.col(value).cast("double")
    aggs = [F.count(v).alias("n"), F.sum(v).alias("total"), F.min(v).alias("min"), F.max(v).alias("max"),
            F.avg(v).alias("mean"), F.stddev_samp(v).alias("stddev")]
    if quantiles:
        aggs.append(F.percentile_approx(v, list(quantiles.values()), accuracy).alias("__q"))
    out = df.where(v.isNotNull() & ~F.isnan(v)).groupBy(*keys).agg(*aggs)
    for i, name in enumerate(quantiles):
        out = out.withColumn(name, F.col("__q")[i])
    return out.drop("__q") if quantiles else out


RESERVED = ("n", "total", "mean", "min", "max", "stddev")


def _check_quantiles(quantiles: Mapping[str, float], keys: Sequence[str]) -> None:
    for name, p in quantiles.items():
        if not 0.0 <= float(p) <= 1.0:
            raise ValueError(f"quantile {name!r}: probability {p} is outside [0, 1]")
        if name in RESERVED or name in keys or name.startswith("__"):
            raise ValueError(f"quantile name {name!r} clashes with an output or key column")


def grouped_profile(df: DataFrame, keys: Sequence[str], value: str,
                    quantiles: Mapping[str, float] | None = None,
                    max_range_rows: int = DEFAULT_MAX_RANGE_ROWS,
                    sub_buckets: int = 4096, max_levels: int = 8) -> DataFrame:
    """One row per group of ``keys`` over the non-null ``value`` rows.

    Columns: keys, ``n`` (bigint count), ``total`` (sum), ``mean``, ``min``,
    ``max``, ``stddev`` (sample, NULL when n = 1), and one column per entry
    of ``quantiles`` (name -> probability in [0, 1]).

    Runs the histogram checkpoint eagerly (plus, only when some bucket holds
    more than ``max_range_rows`` rows, one small check and one checkpoint per
    refinement level); the returned DataFrame is lazy.
    """
    keys = list(keys)
    quantiles = dict(quantiles or {})
    _check_quantiles(quantiles, keys)
    v = "__v"
    base = (df.select(*[F.col(k) for k in keys], F.col(value).cast("double").alias(v))
              .where(F.col(v).isNotNull() & ~F.isnan(F.col(v)))
              .withColumn("__b", value_bucket(F.col(v))))

    # pass 1: per-bucket histogram with mergeable moments; every per-group window
    # (running count, group totals, merged moments) is computed before the
    # checkpoint, so later stages only project, filter and join small tables
    hist = base.groupBy(*keys, "__b").agg(
        F.count(F.lit(1)).alias("__c"),
        F.sum(v).alias("__s"),
        F.min(v).alias("__mn"),
        F.max(v).alias("__mx"),
        (F.var_pop(v) * F.count(F.lit(1))).alias("__m2"))
    gw = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    cw = gw.orderBy("__b").rowsBetween(Window.unboundedPreceding, 0)
    gmean = F.sum("__s").over(gw) / F.sum("__c").over(gw)
    hist = (hist.select(*keys, "__b", "__c", "__mn", "__mx",
                        F.sum("__c").over(cw).alias("__end"),
                        F.sum("__c").over(gw).alias("n"),
                        F.sum("__s").over(gw).alias("total"),
                        F.min("__mn").over(gw).alias("min"),
                        F.max("__mx").over(gw).alias("max"),
                        (F.col("__m2") + F.col("__c") * F.pow(F.col("__s") / F.col("__c") - gmean, 2)).alias("__dev"))
                .withColumn("__m2", F.sum("__dev").over(gw))
                .drop("__dev"))
    # Observed while the histogram is written (no extra job); a max is safe under task or stage retries.
    seen = Observation()
    hist = materialize(hist.observe(seen, F.max("__c").alias("biggest")))
    biggest = seen.get["biggest"] or 0

    stat_cols = ["n", "total", "min", "max", "__m2"]

    def finish(df: DataFrame) -> DataFrame:
        return (df.withColumn("mean", F.col("total") / F.col("n"))
                  .withColumn("stddev", F.when(F.col("n") > 1, F.sqrt(F.greatest(F.col("__m2"), F.lit(0.0))
                                                                      / (F.col("n") - 1))))
                  .drop("__m2"))

    if not quantiles:
        return finish(hist.where(F.col("__end") == F.col("n")).select(*keys, *stat_cols))

    # locate the buckets holding ranks floor(pos) and ceil(pos): each target is a
    # value range [lo, hi] (the bucket's own min and max), a row count and the
    # rank r wanted inside it
    probs = F.array(*[F.struct(F.lit(name).alias("__q"), F.lit(float(p)).alias("__p"))
                      for name, p in quantiles.items()])
    pos = (F.col("n") - 1) * F.col("__p")
    t = (hist.select("*", F.inline(probs))
             .withColumn("__pos", pos)
             .withColumn("__frac", F.col("__pos") - F.floor(F.col("__pos")))
             .select(*keys, *stat_cols, "__b", "__c", "__end", "__mn", "__mx", "__q", "__frac",
                     F.inline(F.array(
                         F.struct(F.lit("lo").alias("__side"), F.floor("__pos").alias("__k")),
                         F.struct(F.lit("hi").alias("__side"), F.ceil("__pos").alias("__k"))))))
    start = F.col("__end") - F.col("__c")
    tcols = [*keys, *stat_cols, "__b", "__q", "__side", "__frac", "__r", "__cnt", "__lo", "__hi"]
    targets = (t.where((F.col("__k") >= start) & (F.col("__k") < F.col("__end")))
                .select(*keys, *stat_cols, "__b", "__q", "__side", "__frac", (F.col("__k") - start).alias("__r"),
                        F.col("__c").alias("__cnt"), F.col("__mn").alias("__lo"), F.col("__mx").alias("__hi")))
    # refine any target range holding more than max_range_rows rows: split it into
    # sub_buckets linear sub-ranges (a partial-aggregated histogram of only its
    # rows), keep the sub-range holding the wanted rank, repeat; a range whose
    # min equals its max needs no further work
    big_cond = (F.col("__cnt") > F.lit(max_range_rows)) & (F.col("__lo") < F.col("__hi"))
    level = 0
    while biggest > max_range_rows and level < max_levels and not targets.where(big_cond).isEmpty():
        big = targets.where(big_cond)
        ranges = big.select(*keys, "__b", "__lo", "__hi").distinct()
        rows = _in_ranges(base, ranges, keys, v)
        sb = F.least(F.floor((F.col(v) - F.col("__lo")) / (F.col("__hi") - F.col("__lo")) * F.lit(float(sub_buckets))),
                     F.lit(sub_buckets - 1))
        rk = [*keys, "__b", "__lo", "__hi"]
        sub = (rows.withColumn("__sb", sb)
                   .groupBy(*rk, "__sb").agg(F.count(F.lit(1)).alias("__sc"), F.min(v).alias("__smn"),
                                             F.max(v).alias("__smx")))
        sw = Window.partitionBy(*rk).orderBy("__sb").rowsBetween(Window.unboundedPreceding, 0)
        sub = sub.withColumn("__send", F.sum("__sc").over(sw))
        refined = (_ns_join(big, sub.withColumnRenamed("__lo", "__rlo").withColumnRenamed("__hi", "__rhi"),
                            [*keys, "__b"], "inner")
                   .where((F.col("__lo") == F.col("__rlo")) & (F.col("__hi") == F.col("__rhi"))
                          & (F.col("__r") >= F.col("__send") - F.col("__sc")) & (F.col("__r") < F.col("__send")))
                   .select(*keys, *stat_cols, "__b", "__q", "__side", "__frac",
                           (F.col("__r") - (F.col("__send") - F.col("__sc"))).alias("__r"),
                           F.col("__sc").alias("__cnt"), F.col("__smn").alias("__lo"), F.col("__smx").alias("__hi")))
        targets = materialize(targets.where(~big_cond).select(*tcols).unionByName(refined.select(*tcols)))
        level += 1
    if level == max_levels and not targets.where(big_cond).isEmpty():
        raise RuntimeError(f"a range still holds more than {max_range_rows} rows after {max_levels} refinements")

    # resolve: a single-valued range is its value; otherwise rank the range's
    # distinct values (de-duplicated map-side; at most max_range_rows of them)
    single = targets.where(F.col("__lo") == F.col("__hi")).select(*tcols, F.col("__lo").alias(v))
    multi = targets.where(F.col("__lo") < F.col("__hi"))
    if level == 0:
        # every range is a whole level-0 bucket: a semi-join on (keys, bucket) selects it
        needed = multi.select(*keys, "__b").distinct()
        rows = _ns_join(base, needed, [*keys, "__b"], "left_semi")
        rk = [*keys, "__b"]
    else:
        ranges = multi.select(*keys, "__b", "__lo", "__hi").distinct()
        rows = _in_ranges(base, ranges, keys, v)
        rk = [*keys, "__b", "__lo", "__hi"]
    vals = rows.groupBy(*rk, v).agg(F.count(F.lit(1)).alias("__vc"))
    vw = Window.partitionBy(*rk).orderBy(v).rowsBetween(Window.unboundedPreceding, 0)
    vals = vals.withColumn("__vend", F.sum("__vc").over(vw))
    same_range = F.lit(True)
    if level > 0:
        vals = vals.withColumnRenamed("__lo", "__rlo").withColumnRenamed("__hi", "__rhi")
        same_range = (F.col("__lo") == F.col("__rlo")) & (F.col("__hi") == F.col("__rhi"))
    found = (_ns_join(multi, vals, [*keys, "__b"], "inner")
               .where(same_range & (F.col("__r") >= F.col("__vend") - F.col("__vc")) & (F.col("__r") < F.col("__vend")))
               .select(*tcols, v))
    picked = found.unionByName(single)

    aggs = [F.first(c).alias(c) for c in stat_cols]
    for name in quantiles:
        is_q = F.col("__q") == F.lit(name)
        lo = F.max(F.when(is_q & (F.col("__side") == "lo"), F.col(v)))
        hi = F.max(F.when(is_q & (F.col("__side") == "hi"), F.col(v)))
        frac = F.max(F.when(is_q, F.col("__frac")))
        aggs.append((lo + (hi - lo) * frac).alias(name))
    return finish(picked.groupBy(*keys).agg(*aggs))

