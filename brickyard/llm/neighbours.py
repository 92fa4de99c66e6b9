"""Approximate nearest neighbours with learned partitions.

Fit, on a sample of at most ``sample`` vectors: the sample's neighbour graph is cut into balanced parts
(principal-direction halving, then rounds in which vertices move to the part of most of their
neighbours while parts stay within ``slack`` of equal size), and two small networks with one hidden layer
learn a row's part from the row, and the parts of a query's neighbours from the query.  The number of parts grows with the number
of rows up to ``most_parts``; the sample and the parts bound what goes through the driver.

Index: every row goes to its most probable part.  Search: every query goes to its most probable parts,
until their joint probability reaches ``mass`` and at least ``least`` of all parts are in; where the neighbours
of queries kept out of the fit need more than ``mass`` to reach ``goal``, that is taken.  What it
meets there is ranked by the exact measure in double precision.  A part that holds many rows, or a part
with many queries, is dealt into blocks, so no task gets a hot part whole; equal vectors are scored once.

The measure is the inner product; ties go to the smaller id.  It ranks the same whatever the query's own
length is, so queries are scaled to length 1, and the graph has the true neighbours of the scaled sample among its
unscaled rows.  Rows keep their length: the halving sees them lifted to (v, sqrt(M^2 - |v|^2)), as the product with
(q, 0) is theirs with q, and their network has the length as one more component.  ``recall`` measures a result against brute force.

Nulls and ties: vectors that are null, empty, zero or hold null or non-finite components take no part, nor
do rows without an id.  Only vectors with as many components are compared; those of another number than most
of the sample's are a part for each number, which their queries search whole, in blocks.
A query is never its own neighbour; other rows with its id are the same row.  Repeated rows come once.
Extra columns are ignored.  An empty input gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from brickyard.llm.common import by_length, group_starts, partitions, read_vectors, stored, whole_groups


def directions(vectors: np.ndarray) -> np.ndarray:
    """Vectors scaled to length 1: all that a query's neighbours depend on."""
    return (vectors / np.sqrt((vectors * vectors).sum(1, keepdims=True))).astype(np.float32)


def features(vectors: np.ndarray, scale: float) -> np.ndarray:
    """Unit vectors with the logarithm of their length, relative to ``scale``, as one more component."""
    norm = np.sqrt((vectors * vectors).sum(1, keepdims=True))
    return np.hstack([directions(vectors), np.clip(np.log2(norm / scale), -8.0, 8.0)]).astype(np.float32)


def lifted(vectors: np.ndarray) -> np.ndarray:
    """Rows with one more component that makes them equally long: nearest by angle is then largest by product."""
    square = (vectors * vectors).sum(1, keepdims=True)
    return (np.hstack([vectors, np.sqrt(square.max() - square)]) / np.sqrt(square.max())).astype(np.float32)


def neighbour_graph(x: np.ndarray, k: int, step: int = 1024, queries: np.ndarray | None = None) -> np.ndarray:
    """Indices of the k other rows with the largest product with each row, or with the row's own vector in ``queries``."""
    out = np.empty((len(x), k), np.int32)
    for lo in range(0, len(x), step):
        near = (x if queries is None else queries)[lo : lo + step] @ x.T
        near[np.arange(len(near)), np.arange(lo, lo + len(near))] = -np.inf
        out[lo : lo + step] = np.argpartition(-near, k - 1, axis=1)[:, :k]
    return out


def balanced_parts(x: np.ndarray, graph: np.ndarray, parts: int, slack: float = 0.05, rounds: int = 8) -> np.ndarray:
    """A part for every vertex of the neighbour graph; ``parts`` is a power of two."""
    part = np.zeros(len(x), np.int64)
    for _ in range(parts.bit_length() - 1):
        new = part * 2
        for p in range(part.max() + 1):
            at = np.flatnonzero(part == p)
            own = x[at] - x[at].mean(0)
            way = np.linalg.eigh(own.T @ own)[1][:, -1]
            new[at[np.argsort(own @ way, kind="stable")[len(at) // 2 :]]] += 1
        part = new
    most = int(np.ceil(len(x) / parts * (1 + slack)))
    size = np.bincount(part, minlength=parts)
    for _ in range(rounds):
        votes = np.zeros((len(x), parts), np.int16)
        for column in graph.T:
            votes[np.arange(len(x)), part[column]] += 1
        np.add.at(votes, (graph.ravel(), np.repeat(part, graph.shape[1])), 1)
        best = votes.argmax(1)
        gain = votes[np.arange(len(x)), best] - votes[np.arange(len(x)), part]
        moved = 0
        for v in np.argsort(-gain, kind="stable").tolist():
            if gain[v] <= 0:
                break
            if size[best[v]] < most:
                size[part[v]] -= 1
                size[best[v]] += 1
                part[v] = best[v]
                moved += 1
        if not moved:
            break
    return part


class Router:
    """Probabilities of the parts for feature rows: one hidden layer, trained by Adam."""

    def __init__(self, weights: list[np.ndarray]):
        self.weights = weights

    def __call__(self, x: np.ndarray) -> np.ndarray:
        a, b, c, d = self.weights
        z = np.maximum(x @ a + b, 0) @ c + d
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)

    @classmethod
    def fit(cls, x: np.ndarray, target: np.ndarray, hidden: int = 128, epochs: int = 12, batch: int = 256, rate: float = 3e-3, seed: int = 11) -> Router:
        rng = np.random.default_rng(seed)
        a = rng.normal(0, np.sqrt(2 / x.shape[1]), (x.shape[1], hidden)).astype(np.float32)
        c = rng.normal(0, np.sqrt(1 / hidden), (hidden, target.shape[1])).astype(np.float32)
        weights = [a, np.zeros(hidden, np.float32), c, np.zeros(target.shape[1], np.float32)]
        first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
        step = 0
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for lo in range(0, len(x), batch):
                at = order[lo : lo + batch]
                h = np.maximum(x[at] @ weights[0] + weights[1], 0)
                z = h @ weights[2] + weights[3]
                z = np.exp(z - z.max(1, keepdims=True))
                dz = (z / z.sum(1, keepdims=True) - target[at]) / len(at)
                dh = (dz @ weights[2].T) * (h > 0)
                step += 1
                for k, g in enumerate((x[at].T @ dh, dh.sum(0), h.T @ dz, dz.sum(0))):
                    first[k] = 0.9 * first[k] + 0.1 * g
                    second[k] = 0.999 * second[k] + 0.001 * g * g
                    weights[k] -= rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
        return cls(weights)


def needed_mass(p: np.ndarray, wanted: np.ndarray, goal: float) -> float:
    """The joint probability up to which queries must take parts to meet ``goal`` of the parts ``wanted``."""
    order = np.argsort(-p, axis=1, kind="stable")
    place = np.argsort(order, axis=1)
    before = np.cumsum(np.take_along_axis(p, order, 1), axis=1) - np.take_along_axis(p, order, 1)
    # a part is taken if those before it hold less than the mass
    need = np.sort(np.take_along_axis(before, np.take_along_axis(place, wanted, 1), 1).ravel())
    return float(np.nextafter(need[min(int(np.ceil(goal * len(need))), len(need)) - 1], 2))


def fit(vectors: np.ndarray, parts: int, k: int = 10, goal: float = 0.96) -> tuple[float, list[np.ndarray], list[np.ndarray], float]:
    """(scale, weights of the rows' router, weights of the queries' router, mass needed), learned from a sample of vectors."""
    scale = float(np.median(np.sqrt((vectors * vectors).sum(1))))
    x, q = features(vectors, scale), directions(vectors)
    k = min(k, len(x) - 1)
    if parts == 1 or k < 1:
        one = [np.zeros((1, 1), np.float32), np.zeros(1, np.float32)]
        return scale, *([np.zeros((f.shape[1], 1), np.float32), one[1], *one] for f in (x, q)), 0.0
    graph = neighbour_graph(vectors.astype(np.float32), k, queries=q)
    part = balanced_parts(lifted(vectors), graph, parts)
    target = np.zeros((len(x), parts), np.float32)
    target[np.arange(len(x)), part] = 1
    rows = Router.fit(x, target).weights
    held = Router(rows)(x).argmax(1)[graph]  # where the neighbours are in the index
    target[:] = 0
    for column in held.T:
        target[np.arange(len(x)), column] += 1 / k
    out = max(1, len(x) // 8)
    asks = Router.fit(q[out:], target[out:]).weights
    return scale, rows, asks, needed_mass(Router(asks)(q[:out]), held[:out], goal)


def _route(model, kind: str, mass: float, least: float):
    """Adds a row's most probable part, and for queries all parts that they are sent to."""
    def run(batches: Iterator[pa.RecordBatch]):
        size, scale, weights, asks, needed = model.value
        rows, asks, most = Router(weights), Router(asks), max(mass, needed)
        for batch in batches:
            own: list = [None] * batch.num_rows
            sent: list = [None] * batch.num_rows
            query = batch.column("query").to_pylist()
            for at, vectors in by_length(batch.column("raw"), kind):
                if vectors.shape[1] != size:  # a part of its own, searched exactly
                    for row in at.tolist():
                        own[row], sent[row] = -vectors.shape[1], [-vectors.shape[1]] if query[row] else []
                    continue
                best = rows(features(vectors, scale)).argmax(1)
                p = asks(directions(vectors))
                order = np.argsort(-p, axis=1, kind="stable")
                n = (np.cumsum(np.take_along_axis(p, order, 1), axis=1) < most).sum(1) + 1
                n = np.minimum(np.maximum(n, int(np.ceil(least * p.shape[1]))), p.shape[1])
                for k, row in enumerate(at.tolist()):
                    own[row] = int(best[k])
                    sent[row] = order[k, : n[k]].tolist() if query[row] else []
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own, pa.int32()), pa.array(sent, pa.list_(pa.int32()))],
                                             names=[*batch.schema.names, "own", "sent"])
    return run


def nearest(queries: np.ndarray, query_ids: np.ndarray, vectors: np.ndarray, ids: np.ndarray, k: int, step: int = 512):
    """(query, id, inner product) of each query's k nearest, ties to the smaller id; equal vectors are scored once."""
    unique, place = np.unique(vectors, axis=0, return_inverse=True)
    order = np.lexsort((ids, place.ravel()))
    start = np.searchsorted(place.ravel()[order], np.arange(len(unique) + 1))
    length = np.sqrt((unique * unique).sum(1).max())
    for lo in range(0, len(queries), step):
        rough = queries[lo : lo + step] @ unique.T
        few = min(k + 1, len(unique))  # one more, as a query may be its own best
        level = np.partition(rough, len(unique) - few, axis=1)[:, len(unique) - few]
        slack = 1e-9 * length * np.sqrt((queries[lo : lo + step] ** 2).sum(1))
        for j, row in enumerate(rough):
            at = np.flatnonzero(row >= level[j] - slack[j])
            exact = (unique[at] * queries[lo + j]).sum(1)
            found: list[tuple[float, int]] = []
            for u, score in sorted(zip(at.tolist(), exact.tolist(), strict=True), key=lambda p: -p[1]):
                if len(found) >= k and -found[k - 1][0] > score:
                    break
                own = ids[order[start[u] : start[u + 1]][: k + 1]]
                found = sorted([*found, *((-score, i) for i in own.tolist() if i != query_ids[lo + j])])
            yield [(int(query_ids[lo + j]), i, -s) for s, i in found[:k]]


def _search(kind: str, k: int):
    def run(batches: Iterator[pa.RecordBatch]):
        keys = ["part", "rows", "asks"]
        for table in whole_groups(batches, keys):
            starts = group_starts(table, keys).tolist()
            for lo, hi in zip(starts, [*starts[1:], table.num_rows], strict=True):
                t = table.slice(lo, hi - lo)
                ids, ask = t.column("vec_id").to_numpy(), t.column("ask").to_numpy(zero_copy_only=False).astype(bool)
                vectors = np.frombuffer(b"".join(t.column("raw").to_pylist()), kind).reshape(len(ids), -1).astype(float)
                if ask.all() or not ask.any():
                    continue
                out = [r for rows in nearest(vectors[ask], ids[ask], vectors[~ask], ids[~ask], k) for r in rows]
                if out:
                    q, v, s = zip(*out, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(v, pa.int64()), pa.array(s, pa.float64())], names=["query_id", "vec_id", "score"])
    return run


def search(vectors: DataFrame, is_query, k: int = 20, sample: int = 16384, rows_per_part: int = 2048, most_parts: int = 512,
           mass: float = 0.96, least: float = 0.0, goal: float = 0.96, block: int = 8192, seed: int = 23) -> DataFrame:
    """One row per query and neighbour found: query_id, rank, vec_id, score.  ``is_query`` is a condition on the rows."""
    spark, n = vectors.sparkSession, partitions(vectors)
    kind = "float32" if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else "float64"
    typed = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(f"array<{'float' if kind == 'float32' else 'double'}>").alias("embedding"))
    rows = typed.mapInArrow(lambda b: read_vectors(b, kind), "vec_id long, digest binary, raw binary")
    rows = rows.filter("raw is not null and vec_id is not null").groupBy("vec_id").agg(F.min("raw").alias("raw"))
    rows = stored(rows.withColumn("query", F.coalesce(is_query, F.lit(False))), "vectors")
    total = rows.count()
    pick = F.xxhash64(F.lit(seed), "vec_id")
    share = min(1.0, sample / max(total, 1))
    some = rows.filter(F.pmod(pick, F.lit(1 << 20)) < share * (1 << 20)).orderBy(pick).limit(sample).select("raw").toPandas()["raw"]  # at most ``sample`` rows
    if not len(some):
        some = pd.Series([r.raw for r in rows.limit(1).collect()], dtype=object)
    if not len(some):
        return rows.select(F.col("vec_id").alias("query_id"), F.lit(0).alias("rank"), "vec_id", F.lit(0.0).alias("score"))
    size = some.map(len).mode().iloc[0]
    learned = np.frombuffer(b"".join(r for r in some if len(r) == size), kind).reshape(-1, size // np.dtype(kind).itemsize).astype(float)
    parts = 1
    while parts * 2 <= min(total // rows_per_part, most_parts, max(1, len(learned) // 32)):
        parts *= 2
    model = spark.sparkContext.broadcast((learned.shape[1], *fit(learned, parts, goal=goal)))
    routed = stored(rows.mapInArrow(_route(model, kind, mass, least), "vec_id long, raw binary, query boolean, own int, sent array<int>"), "routed")
    asked = routed.filter("query").select("vec_id", "raw", F.explode("sent").alias("part"))
    # blocks of a part's rows and of its queries; one row per part and per other length
    counts = (routed.groupBy(F.col("own").alias("part")).agg(F.ceil(F.count("*") / block).alias("row_blocks"))
              .join(asked.groupBy("part").agg(F.ceil(F.count("*") / block).alias("ask_blocks")), "part"))
    counts = F.broadcast(spark.createDataFrame([tuple(int(v) for v in r) for r in counts.collect()], "part int, row_blocks int, ask_blocks int"))
    spread = F.xxhash64("vec_id")
    held = (routed.select("vec_id", "raw", F.col("own").alias("part")).join(counts, "part")
            .withColumn("rows", F.pmod(spread, F.col("row_blocks")).cast("int"))
            .withColumn("asks", F.explode(F.sequence(F.lit(0), F.col("ask_blocks") - 1))).withColumn("ask", F.lit(False)))
    asked = (asked.join(counts, "part").withColumn("asks", F.pmod(spread, F.col("ask_blocks")).cast("int"))
             .withColumn("rows", F.explode(F.sequence(F.lit(0), F.col("row_blocks") - 1))).withColumn("ask", F.lit(True)))
    cols = ["part", "rows", "asks", "vec_id", "raw", "ask"]
    found = (held.select(cols).unionAll(asked.select(cols)).repartition(n, "part", "rows", "asks").sortWithinPartitions("part", "rows", "asks")
             .mapInArrow(_search(kind, k), "query_id long, vec_id long, score double"))
    best = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def recall(found: pd.DataFrame, vectors: np.ndarray, ids: np.ndarray, query_ids: np.ndarray, k: int) -> float:
    """Share of the true k nearest that a search has found, by brute force."""
    place = {i: p for p, i in enumerate(ids.tolist())}
    hits = wanted = 0
    have = found.groupby("query_id")["vec_id"].agg(set).to_dict()
    for q in query_ids.tolist():
        score = vectors @ vectors[place[q]]
        score[place[q]] = -np.inf
        true = ids[np.lexsort((ids, -score))[: min(k, len(ids) - 1)]]
        hits += len(have.get(q, set()) & set(true.tolist()))
        wanted += len(true)
    return hits / max(wanted, 1)
