"""A Merkle manifest of a table and the proofs of all its rows by pointer jumping.

Every row is a leaf: the hash of its columns.  Leaves of a group ascend by id; while several nodes remain, every
``fanout`` consecutive ones become the hash of their hashes (the last run may be shorter, even one).  What
remains is the group's subroot; the subroots in the order of their groups make the root likewise.

**Places.**  Leaves are sorted over all partitions by range (group, id, leaf, row); a row's place follows from
its place in its partition and the counts of the group's earlier partitions, so a group that holds a third of
all rows is many partitions, never one task.

**Tree.**  A level is one aggregation of at most ``fanout`` hashes a run, a ``fanout``-th of the level below; it
is stored before the next.

**Proofs.**  Every inner node holds a pointer to an ancestor and the segment of siblings on the way there:
at first its parent and the run's other hashes.  A self-join then lets each node take over its ancestor's
pointer and append that ancestor's segment, which doubles the distance; after log2(height) rounds all
point past the root.  From the fourth distance on many nodes share an ancestor, so the few ancestors
are copied under ``SALTS`` salts.  At the end a run's leaves take the run's segment behind their own siblings.

Nulls and ties: a null value counts as ``-``; null groups come first, null ids before others; rows with the same id
are ordered by their leaf, and rows with the same leaf are interchangeable.  Empty texts are values of
length 0.  A table of one row is its own root with an empty proof; an empty one gives an empty result.
Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from brickyard.llm.common import partitions, stored

SALTS = 64
#: The tree over the subroots; the groups' trees count from 0.
TOP = -1


def encoded(value: Column) -> Column:
    """A value with its length in bytes before it, so that no two lists of values run into the same text."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def digest(*texts: Column) -> Column:
    return F.sha2(F.concat(*texts), 256)


def lower_ascii(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf's hash and its siblings give."""
    return F.aggregate(path, leaf, lambda h, s: digest(s["left"], h, s["right"]))


def proof_digest(path: Column) -> Column:
    """Hash of a proof's siblings, from the leaf to the root and from left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def _ordered(rows: DataFrame, *order: Column) -> DataFrame:
    """Stored rows in a total order over all partitions: ``_at`` ascends, without gaps in a partition (``_at >> 33``)."""
    n = partitions(rows)
    return stored(rows.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), "ordered")


def _placed(rows: DataFrame) -> DataFrame:
    """(tree, trees, n, pos, id, leaf, changed): the number of the row's group, its size and the row's place in it."""
    order = [F.col("grp").asc_nulls_first(), F.col("id").asc_nulls_first(), F.col("leaf"), F.col("_tie")]
    rows = _ordered(rows.withColumn("_tie", F.monotonically_increasing_id()), *order).withColumn("part", F.shiftright("_at", 33))
    parts = stored(rows.groupBy("grp", "part").agg(F.min("_at").alias("lo"), F.count("*").alias("m")), "parts")
    groups = _ordered(parts.groupBy("grp").agg(F.sum("m").alias("n")), F.col("grp").asc_nulls_first()).withColumn("part", F.shiftright("_at", 33))
    # one row a partition, hence a small window over all
    before = groups.groupBy("part").agg(F.count("*").alias("m")).withColumn("before", F.sum("m").over(W.orderBy("part")) - F.col("m"))
    trees = before.agg(F.sum("m")).first()[0] or 0
    groups = (groups.join(before.select("part", "before"), "part")
              .select(F.col("grp").alias("g"), "n", (F.col("before") + F.col("_at") - F.shiftleft("part", 33)).alias("tree")))
    # a group has at most one row a partition here
    earlier = F.sum("m").over(W.partitionBy("grp").orderBy("part")) - F.col("m")
    shift = (parts.withColumn("shift", earlier - F.col("lo")).join(groups, F.col("grp").eqNullSafe(F.col("g")))
             .select(F.col("grp").alias("g"), F.col("part").alias("p"), "shift", "n", "tree"))
    return (rows.join(stored(shift, "places"), (F.col("part") == F.col("p")) & F.col("grp").eqNullSafe(F.col("g")))
            .select("tree", F.lit(trees).cast("long").alias("trees"), "n", (F.col("_at") + F.col("shift")).alias("pos"), "id", "leaf", "changed"))


def _levels(nodes: DataFrame, most: int, fanout: int) -> list[DataFrame]:
    """The stored levels above ``nodes`` (tree, n, pos, child level and place, h) of trees with at most ``most`` nodes."""
    levels, level = [], 0
    while most > 1:
        level += 1
        kid = F.struct("pos", F.col("ctree").alias("tree"), F.col("clevel").alias("level"), F.col("cidx").alias("idx"), "h")
        runs = (nodes.filter("n > 1").groupBy("tree", F.floor(F.col("pos") / fanout).alias("idx"), F.ceil(F.col("n") / fanout).alias("n"))
                .agg(F.sort_array(F.collect_list(kid)).alias("kids"))  # at most `fanout`
                .withColumn("h", F.sha2(F.array_join("kids.h", ""), 256)).withColumn("level", F.lit(level)))
        levels.append(stored(runs.select("tree", "level", "idx", "n", "kids", "h"), "level"))
        nodes = levels[-1].select("tree", "n", F.col("idx").alias("pos"), F.col("tree").alias("ctree"), F.col("level").alias("clevel"),
                                  F.col("idx").alias("cidx"), "h")
        most = -(-most // fanout)
    return levels


def _sides(hashes: Column, place: Column) -> Column:
    """The hashes of a run before and after one of them."""
    return F.struct(F.array_join(F.slice(hashes, F.lit(1), place), "").alias("left"),
                    F.array_join(F.slice(hashes, place + 2, F.size(hashes)), "").alias("right"))


def _jump(cur: DataFrame, height: int, salts: int) -> DataFrame:
    """Pointers doubled until all are past the root."""
    key = ("tree", "level", "idx")
    distance = 1
    while distance < height:
        n = salts if distance >= 4 else 1
        # inside a group's tree a pointer at this distance ends above this level
        ancestors = cur.filter((F.col("tree") == TOP) | (F.col("level") > distance)).select(*[F.col(c).alias(f"a_{c}") for c in cur.columns], F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("a_salt"))
        open_ = cur.filter("up_tree is not null").withColumn("salt", F.pmod(F.xxhash64(*key), F.lit(n)).cast("int"))
        on = [F.col(f"up_{c}") == F.col(f"a_{c}") for c in key] + [F.col("salt") == F.col("a_salt")]
        moved = open_.join(ancestors, on).select(*key, *[F.col(f"a_up_{c}").alias(f"up_{c}") for c in key], F.concat("seg", "a_seg").alias("seg"),
                                                  F.coalesce("subroot", "a_subroot").alias("subroot"), F.col("a_root").alias("root"))
        cur = stored(cur.filter("up_tree is null").unionByName(moved), "jumps")
        distance *= 2
    return cur


def manifest(docs: DataFrame, columns: list[str], id: str, group: str, changed: Column | None = None, fanout: int = 16, salts: int = SALTS) -> DataFrame:
    """One row per row of ``docs``: id, leaf, changed, subroot, root, path.

    ``columns`` are hashed in their order; ``changed`` (a hash, or null) is carried along.  ``path`` holds, from the leaf
    to the root, the siblings left and right of the node, as one text each.
    """
    rows = stored(docs.select(F.col(f"`{group}`").alias("grp"), F.col(f"`{id}`").alias("id"), digest(*[encoded(F.col(f"`{c}`")) for c in columns]).alias("leaf"),
                              (F.lit(None).cast("string") if changed is None else changed).alias("changed")), "leaves")
    placed = _placed(rows)
    first = stored(placed.groupBy("tree", "trees", F.col("n").alias("size"), F.floor(F.col("pos") / fanout).alias("idx"))
                   .agg(F.sort_array(F.collect_list(F.struct("pos", "leaf", "id", "changed"))).alias("kids"))  # at most `fanout`
                   .withColumn("n", F.ceil(F.col("size") / fanout))
                   # a lone leaf is its own subroot, without a hash
                   .withColumn("h", F.when(F.col("size") == 1, F.col("kids")[0]["leaf"]).otherwise(F.sha2(F.array_join("kids.leaf", ""), 256))), "runs")
    trees, most = first.agg(F.max("trees"), F.max("n")).first()
    trees, most = trees or 0, most or 0
    lowest = first.select("tree", F.lit(1).alias("level"), "idx", "n", "h")
    as_node = lambda df: df.select("tree", "n", F.col("idx").alias("pos"), F.col("tree").alias("ctree"), F.col("level").alias("clevel"), F.col("idx").alias("cidx"), "h")
    inner = [df.withColumn("level", F.lit(k + 2)) for k, df in enumerate(_levels(as_node(lowest), most, fanout))]
    subroots = lowest.filter("n = 1")
    for level in inner:
        subroots = subroots.unionByName(level.select(*lowest.columns).filter("n = 1"))
    upper = [] if trees <= 1 else _levels(subroots.select(F.lit(TOP).cast("long").alias("tree"), F.lit(trees).cast("long").alias("n"), F.col("tree").alias("pos"),
                                                          F.col("tree").alias("ctree"), F.col("level").alias("clevel"), F.col("idx").alias("cidx"), "h"), trees, fanout)
    # inside the groups' trees a run's kids are one level below it, whatever number they were stored with
    top = (subroots if trees <= 1 else upper[-1]).select("tree", "level", "idx", "h")
    null = F.lit(None).cast("long")
    cur = top.select("tree", "level", "idx", null.alias("up_tree"), null.cast("int").alias("up_level"), null.alias("up_idx"),
                     F.array().cast("array<struct<left: string, right: string>>").alias("seg"),
                     F.when(F.col("tree") >= 0, F.col("h")).alias("subroot"), F.col("h").alias("root"))
    for runs, inside in [*((r, True) for r in inner), *((r, False) for r in upper)]:
        each = runs.select(F.col("tree").alias("t"), F.col("level").alias("l"), F.col("idx").alias("i"), F.col("kids.h").alias("hashes"), F.posexplode("kids").alias("place", "kid"))
        below = (F.col("l") - 1).cast("int") if inside else F.col("kid.level").cast("int")
        sub = F.when((F.col("t") == TOP) & (F.col("kid.tree") >= 0), F.col("kid.h"))
        cur = cur.unionByName(each.select(F.col("kid.tree").alias("tree"), below.alias("level"), F.col("kid.idx").alias("idx"), F.col("t").alias("up_tree"), F.col("l").alias("up_level"),
                                          F.col("i").alias("up_idx"), F.array(_sides(F.col("hashes"), F.col("place"))).alias("seg"), sub.alias("subroot"), F.lit(None).cast("string").alias("root")))
    cur = _jump(stored(cur, "jumps"), len(inner) + len(upper) + 1, salts)
    above = cur.filter("level = 1 and tree >= 0").select(F.col("tree").alias("t"), F.col("idx").alias("i"), "seg", "subroot", "root")
    runs = first.join(above, (F.col("tree") == F.col("t")) & (F.col("idx") == F.col("i")))
    leaves = runs.select("size", "seg", "subroot", "root", F.col("kids.leaf").alias("hashes"), F.posexplode("kids").alias("place", "kid"))
    path = F.when(F.col("size") == 1, F.col("seg")).otherwise(F.concat(F.array(_sides(F.col("hashes"), F.col("place"))), F.col("seg")))
    return leaves.select(F.col("kid.id").alias("id"), F.col("kid.leaf").alias("leaf"), F.col("kid.changed").alias("changed"), "subroot", "root", path.alias("path"))


def verified(proofs: DataFrame) -> DataFrame:
    """``proofs`` with the hash of each proof, the root that the changed (else the original) leaf folds to, and whether it is the root."""
    out = proofs.withColumn("proof_sha256", proof_digest(F.col("path"))).withColumn("folded_root", folded(F.coalesce("changed", "leaf"), F.col("path")))
    return out.withColumn("verified", F.col("folded_root") == F.col("root")).drop("path")
