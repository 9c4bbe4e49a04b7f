"""Nearest neighbours by randomly rotated one-bit codes with error bounds (operator 6).

Every vector, less the centre of all vectors and scaled to length one, is
turned by a random rotation and stored as the signs of its components, with
two scalars: its distance to the centre and its product with its own code.  For a
query, the product with the code, divided by the second scalar, estimates the
product of the two directions without bias; its error is at most
``EPS * sqrt(1 - p * p) / (p * sqrt(d - 1))`` with high probability (p: the
second scalar).  From that follow bounds of each distance.

Search.  The queries are dealt into blocks and every vector's partition meets
each block: of a block of vectors, those whose lower bound is not over the
k-th smallest upper bound are measured exactly, and the k nearest of these are
kept; a window over the few kept rows of a query gives the result.  The index
holds every vector; nothing is fitted on a sample.

Defined results: vectors that are null, empty, zero, of another length than
most, or hold null or non-finite components take no part, nor do rows with a
null id; equal distances go to the smaller id; a repeated id is a row of its
own, and a query's own id is never its neighbour; with fewer than k candidates
all are returned.  Further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize, ship_package

K, EPS, SEED = 10, 3.0, 7
BLOCK_QUERIES, BLOCK_VECTORS = 1024, 8192


def rotation(d: int, seed: int = SEED) -> np.ndarray:
    """A random orthogonal matrix, the same everywhere."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, d)))
    return q * np.sign(np.diag(r))


def code(x: np.ndarray, centre: np.ndarray, turn: np.ndarray):
    """Packed signs, distance to the centre and product with the own code of each row of x."""
    r = x - centre
    norm = np.sqrt((r * r).sum(axis=1))
    unit = np.divide(r, norm[:, None], out=np.zeros_like(r), where=norm[:, None] > 0) @ turn
    signs = unit >= 0
    return np.packbits(signs, axis=1), norm, np.abs(unit).sum(axis=1) / np.sqrt(x.shape[1])


def bounds(packed, norm, p, query: np.ndarray, centre: np.ndarray, turn: np.ndarray, eps: float = EPS):
    """Lower and upper bounds of the squared distances (queries x vectors)."""
    d = len(centre)
    signs = np.unpackbits(packed, axis=1, count=d).astype(np.float32) * 2 - 1
    q = query - centre
    qn = np.sqrt((q * q).sum(axis=1))
    unit = np.divide(q, qn[:, None], out=np.zeros_like(q), where=qn[:, None] > 0) @ turn
    safe = np.maximum(p, 1e-9)
    product = (unit.astype(np.float32) @ signs.T).astype(np.float64) / (np.sqrt(d) * safe)
    error = eps * np.sqrt(np.maximum(1 - p * p, 0)) / (safe * np.sqrt(max(d - 1, 1))) + 1e-5
    base = qn[:, None] ** 2 + norm[None, :] ** 2
    scale = 2 * qn[:, None] * norm[None, :]
    return base - scale * np.minimum(product + error, 1), base - scale * np.maximum(product - error, -1)


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Euclidean distances of each row of x to y, added up component by component."""
    total = np.zeros(len(x))
    for j in range(x.shape[1]):
        diff = x[:, j] - y[j]
        total += diff * diff
    return np.sqrt(total)


def _best(queries: np.ndarray, query_ids, vectors: np.ndarray, ids, packed, norm, p, centre, turn, k: int):
    """(query id, vector id, distance) of each query's k nearest among the vectors of a block."""
    out = []
    low, high = bounds(packed, norm, p, queries, centre, turn)
    for i, qid in enumerate(query_ids):
        other = ids != qid
        if not other.any():
            continue
        h = high[i][other]
        limit = np.partition(h, k - 1)[k - 1] if len(h) > k else np.inf
        near = np.flatnonzero(other & (low[i] <= limit))
        dist = distances(vectors[near], queries[i])
        order = np.lexsort((ids[near], dist))[:k]
        out += [(qid, ids[near[j]], dist[j]) for j in order]
    return out


def usable(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v array<double>) of the rows that take part."""
    v = F.col("v")
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    # (a NaN or infinite component makes the sum of the zeros that it is multiplied with NaN)
    rows = rows.where(F.col("id").isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull())
                      & (F.aggregate(v, F.lit(0.0), lambda a, x: a + x * 0.0) == 0.0) & F.exists(v, lambda x: x != 0.0))
    length = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return rows.where(F.size("v") == (length["d"] if length else 0))


def nearest(df: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest rows of each row where ``is_query`` (of the column id) holds."""
    spark = df.sparkSession
    ship_package(spark)
    rows = usable(df, id_col, vector_col)
    found = "query_id long, vec_id long, score double"
    first = rows.first()
    if first is None:
        return spark.createDataFrame([], f"query_id long, rank int, {id_col} long, score double")
    d = len(first["v"])
    mean = rows.agg(*[F.avg(F.col("v")[j]).alias(f"m{j}") for j in range(d)]).first()
    centre, turn = np.array(mean, dtype=np.float64), rotation(d)

    def index(batches):
        schema = pa.schema([("id", pa.int64()), ("v", pa.binary()), ("code", pa.binary()), ("norm", pa.float64()),
                            ("p", pa.float64())])
        for batch in batches:
            if batch.num_rows:
                x = batch.column(1).flatten().to_numpy().reshape(-1, d)
                bits, norm, p = code(x, centre, turn)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array([r.tobytes() for r in x], pa.binary()),
                     pa.array([r.tobytes() for r in bits], pa.binary()), pa.array(norm), pa.array(p)], schema=schema)

    coded = materialize(rows.mapInArrow(index, "id long, v binary, code binary, norm double, p double"), "codes")
    counted = coded.agg(F.count(F.lit(1)), F.sum(is_query.cast("long"))).first()
    n_blocks, n_query_blocks = max(1, -(-counted[0] // BLOCK_VECTORS)), max(1, -(-(counted[1] or 0) // BLOCK_QUERIES))
    pmod = lambda col, n, seed: F.pmod(F.xxhash64(col, F.lit(seed)), F.lit(n)).cast("int")
    vectors = (coded.withColumn("block", pmod("id", n_blocks, 1))
               .withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(n_query_blocks - 1)))))
    queries = (coded.where(is_query).select("id", "v").withColumn("q", pmod("id", n_query_blocks, 2))
               .withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1)))))

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if left.num_rows and right.num_rows:
            def matrix(t, name, kind):
                return np.frombuffer(b"".join(t.column(name).to_pylist()), kind).reshape(t.num_rows, -1)
            out = _best(matrix(right, "v", np.float64), right.column("id").to_numpy(), matrix(left, "v", np.float64),
                        left.column("id").to_numpy(), matrix(left, "code", np.uint8), left.column("norm").to_numpy(),
                        left.column("p").to_numpy(), centre, turn, k)
        a, b, c = zip(*out) if out else ((), (), ())
        return pa.table({"query_id": pa.array(a, pa.int64()), "vec_id": pa.array(b, pa.int64()), "score": pa.array(c, pa.float64())})

    near = (vectors.groupBy("block", "q").cogroup(queries.groupBy("block", "q")).applyInArrow(meet, found))
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return (near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias(id_col), "score"))
