"""Helpers shared by the operators: tables, stored intermediate results, components."""

from __future__ import annotations

import threading
import uuid
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brickyard.session import ensure_checkpoint_dir

#: A word: a run of bytes other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(df: DataFrame, rows: int = 1000) -> None:
    """From now on at most ``rows`` rows go to Python at once: whole texts may be long, and a batch is held several times.

    A session setting, since it is read when a plan runs.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(df.sparkSession.conf.get(key)) <= rows:
        df.sparkSession.conf.set(key, str(rows))


#: Folders written by ``stored`` inside the open scopes of this thread, innermost last.
_scopes = threading.local()


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet below the session's checkpoint folder and read it back.

    The folder is shared (``spark.checkpoint.dir``), so what follows neither recomputes ``df`` nor
    depends on the executors that made it.  Like checkpoints, the files live as long as the folder, or
    as the innermost open ``scope``.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if getattr(_scopes, "open", None):
        _scopes.open[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scope(spark: SparkSession):
    """Removes what ``stored`` wrote inside, however the block ends.

    The list it gives is that of the folders; one that is taken off it stays.  A DataFrame that reads
    a folder must have been written elsewhere before the block ends.
    """
    if not hasattr(_scopes, "open"):
        _scopes.open = []
    written: list[str] = []
    _scopes.open.append(written)
    try:
        yield written
    finally:
        _scopes.open.pop()
        remove(spark, written)


def remove(spark: SparkSession, folders: list[str]) -> None:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for folder in folders:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def word_count(text):
    """Number of words of whole texts; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def text_crc32(text):
    """Unsigned CRC-32 of the UTF-8 bytes; null counts as empty."""
    return F.crc32(F.coalesce(text, F.lit("")).cast("binary")).cast("long")


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node reachable over undirected ``edges`` (a, b).

    Alternating large-star and small-star steps.  Each step is two shuffles of the edge list, every
    node's neighbourhood is only ever aggregated (never gathered), and the edges are stored after
    each round.  Nodes without edges are absent.  Raises if the rounds run out.
    """
    cur = stored(edges.select(F.col("a").cast("long"), F.col("b").cast("long"))
                 .filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                 .distinct(), "edges")
    if cur.isEmpty():
        return cur.select(F.col("a").alias("node"), F.col("b").alias("component"))
    last = None
    for _ in range(max_rounds):
        # large star: every neighbour larger than u points at u's smallest neighbour (or u)
        both = cur.unionAll(cur.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = (both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .filter("a <> b").distinct())
        # small star: u and its smaller neighbours point at the smallest of them
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (large.join(low, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")),
                                                               F.struct(F.col("b").alias("a"), F.col("m").alias("b"))))
                                             .alias("e")).select("e.a", "e.b").filter("a <> b").distinct())
        cur = stored(small, "edges")
        seen = cur.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == last:
            break
        last = seen
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return cur.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component")).unionAll(
        cur.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def whole_groups(batches, keys: list[str]):
    """Arrow tables that hold whole groups, from the batches of a partition sorted by ``keys``."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        cut = int(group_starts(batch, keys)[-1])
        if cut or any(batch.column(k)[0] != held[0].column(k)[0] for k in keys):
            yield pa.Table.from_batches([*held[:-1], batch.slice(0, cut)])
            held = [batch.slice(cut)]
    if held:
        yield pa.Table.from_batches(held)


def group_starts(rows, keys: list[str]) -> np.ndarray:
    """Positions at which a sorted batch's or table's groups start; keys are integers without nulls."""
    new = np.zeros(rows.num_rows, bool)
    new[:1] = True
    for k in keys:
        v = rows.column(k).to_numpy(zero_copy_only=False) if isinstance(rows, pa.RecordBatch) else rows.column(k).to_numpy()
        new[1:] |= v[1:] != v[:-1]
    return np.flatnonzero(new)


def pairs_within(starts: np.ndarray, n: int, at_once: int = 200_000, runs: np.ndarray | None = None):
    """All (x, y), x < y, of rows in the same group, as arrays of about ``at_once`` pairs.

    ``runs``: where the runs inside the groups start; pairs of one run are left out.
    """
    sizes = np.diff(np.append(starts, n))
    ends = np.repeat(starts + sizes, sizes)
    begin = np.arange(n) + 1 if runs is None else np.repeat(np.append(runs[1:], n), np.diff(np.append(runs, n)))
    rest = ends - begin
    upto = np.cumsum(rest)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + at_once)))
        r = rest[lo:hi]
        x = np.repeat(np.arange(lo, hi), r)
        y = begin[x] + np.arange(len(x)) - np.repeat(np.cumsum(r) - r, r)
        if len(x):
            yield x, y
        lo = hi


def read_vectors(batches, kind: str, any_size: bool = False):
    """(id, digest, vector bytes) with null bytes for vectors that take no part.

    ``any_size``: also those whose squares are too large or too small for a double.
    """
    for batch in batches:
        digest, raw = [], []
        for v in batch.column(1):
            v = v.values.to_numpy(zero_copy_only=False).astype(kind) if v.is_valid and len(v) and not v.values.null_count else None
            wide = None if v is None else v.astype(float)
            with np.errstate(over="ignore", under="ignore"):
                fits = wide is not None and np.isfinite(wide).all() and wide.any() and (any_size or 0 < (wide * wide).sum() < np.inf)
            if not fits:
                raw.append(None)
                digest.append(None)
            else:
                raw.append(v.tobytes())
                digest.append(xxhash.xxh3_128_digest(raw[-1]))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digest, pa.binary()), pa.array(raw, pa.binary())],
                                         names=["vec_id", "digest", "raw"])


def by_length(raw, kind: str, scaled: bool = False):
    """(rows, their vectors in double precision) for each length of vector.

    ``scaled``: by a power of two each, so that the largest component is below 1; angles stay exactly the same.
    """
    raw = raw.to_pylist()
    sizes = np.array([len(r) for r in raw])
    for size in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == size)
        vectors = np.frombuffer(b"".join(raw[k] for k in at), kind).reshape(len(at), -1).astype(float)
        yield at, np.ldexp(vectors, -np.frexp(np.abs(vectors).max(1))[1][:, None]) if scaled else vectors
