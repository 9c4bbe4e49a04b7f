"""Vector codes by dual-tree Lloyd rounds on integers (operator 12).

Each component x becomes the integer ``floor(256 * x)`` and every vector is cut
into ``PARTS`` equal parts.  A part position's codebook starts as that part of the
``ENTRIES`` vectors with the smallest ids; each of ``ROUNDS`` rounds assigns every
part to the nearest entry (squared Euclidean distance, ties to the lower index)
and replaces each entry by the floor of its parts' mean; an entry without parts
stays.  A last assignment gives the codes.

Vectors are written once in blocks of at most ``CELLS`` components.  A block holds, for each
part position, the order of a balanced tree over its parts: every node has its bounding box,
the number of its parts and their sum.  The codebooks, which are small, get such a
tree in each task.  Both trees are descended together: from the boxes of a
pair of nodes follow a smallest and a largest distance, and entry nodes whose
smallest distance is over the least largest one are dropped.  A node with one
entry left is assigned as a whole by its cached sum; leaves that are still
uncertain are decided part by part.  All distances are exact integers, so the
result doesn't depend on blocks, tasks or their order.

What a round sends is a count and a sum per task, part and entry; Spark adds these
up, and the driver sees the totals only.

Defined results: rows whose vector is null or empty or holds null or non-finite
components are dropped; so are vectors of another length than most (ties: the
shorter).  A vector with a component whose integer is over ``LARGEST`` in size,
where squared distances leave 64 bits, keeps its row with null code, error and
label_error and takes no part.  Rows with a null id come last in the first codebook; equal ids
are ordered by vector.  With fewer vectors than ``ENTRIES`` the codebooks have
as many entries as there are vectors; an empty table gives no rows.  Null labels
are one label.  Further columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize, ship_package

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
CELLS, LEAF, LARGEST = 1 << 20, 8, 1 << 27


class Tree:
    """Balanced trees over rows of several tables at once; level l has ``2 ** l`` nodes of equal size.

    ``points``: (tables, rows, d).  Rows are repeated, with weight 0, up to ``leaf`` times a power of two.  ``order``: of an
    earlier tree over the same points.
    """

    def __init__(self, points: np.ndarray, leaf: int, order: np.ndarray | None = None):
        tables, n, d = points.shape
        self.depth = max(0, int(np.ceil(np.log2(max(n, 1) / leaf))))
        size = -(-n // (1 << self.depth)) << self.depth
        if order is None:
            order = np.broadcast_to(np.arange(size), (tables, size))
            for level in range(self.depth):
                x = np.take_along_axis(points, order[:, :, None] % n, 1).reshape(tables, 1 << level, -1, d)
                widest = (x.max(2) - x.min(2)).argmax(2)
                by = np.take_along_axis(x, widest[:, :, None, None], 3)[..., 0].argsort(2, kind="stable")
                order = np.take_along_axis(order.reshape(by.shape), by, 2).reshape(tables, size)
        self.places, self.weight, self.order = order, order < n, order % n
        self.points = np.take_along_axis(points, self.order[:, :, None], 1)
        leaves = (tables, 1 << self.depth, -1)
        x, w = self.points.reshape(*leaves, d), self.weight.reshape(leaves)
        # from the leaves up: each node's box, sum and count
        self.low, self.high, self.total, self.count = [x.min(2)], [x.max(2)], [(x * w[..., None]).sum(2)], [w.sum(2)]
        for level in range(self.depth - 1, -1, -1):
            for have, join in ((self.low, np.min), (self.high, np.max), (self.total, np.sum), (self.count, np.sum)):
                have.insert(0, join(have[0].reshape(tables, 1 << level, 2, *have[0].shape[2:]), axis=2))


def _square(x: np.ndarray) -> np.ndarray:
    return (x * x).sum(-1)


def _starts(node: np.ndarray) -> np.ndarray:
    """Where each node's pairs begin."""
    return np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))


def assign(parts: Tree, codebooks: Tree):
    """Assigns the parts to entries.  Yields, table by table, (table, whole, rest).

    whole: arrays (level, node, entry) of the nodes that were assigned as one.
    rest: arrays (place in the tree, entry) of the parts of uncertain leaves.
    """
    size = parts.points.shape[1] >> parts.depth
    for t in range(len(parts.points)):
        # pairs of a node and an entry node, by node; entry trees have leaves of one entry
        node, entry, depth, whole = np.zeros(1, np.int64), np.zeros(1, np.int64), 0, []
        for level in range(max(parts.depth, codebooks.depth) + 1):
            here = min(level, parts.depth)
            if level and here == level:
                node, entry = np.concatenate([node * 2, node * 2 + 1]), np.tile(entry, 2)
                by = np.argsort(node, kind="stable")
                node, entry = _pruned(parts, codebooks, t, here, node[by], depth, entry[by])
            if depth < codebooks.depth:
                depth += 1
                node, entry = np.repeat(node, 2), (entry[:, None] * 2 + np.arange(2)).ravel()
                real = codebooks.count[depth][t][entry] > 0
                node, entry = _pruned(parts, codebooks, t, here, node[real], depth, entry[real])
            if depth == codebooks.depth:
                start = _starts(node)
                alone = np.diff(np.append(start, len(node))) == 1
                whole.append((here, node[start[alone]], codebooks.order[t][entry[start[alone]]]))
                more = np.repeat(~alone, np.diff(np.append(start, len(node))))
                node, entry = node[more], entry[more]
            if not len(node):
                break
        rest = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if len(node):
            index = codebooks.order[t][entry]
            start = _starts(node)
            own = node[start]
            x = parts.points[t].reshape(-1, size, parts.points.shape[2])
            dist = np.empty((len(node), size), np.int64)
            for a in range(0, len(node), 8192):
                dist[a: a + 8192] = _square(x[node[a: a + 8192]] - codebooks.points[t][entry[a: a + 8192], None, :])
            least = np.repeat(np.minimum.reduceat(dist, start, axis=0), np.diff(np.append(start, len(node))), axis=0)
            nearest = np.minimum.reduceat(np.where(dist == least, index[:, None], codebooks.points.shape[1]), start, axis=0)
            rest = (own[:, None] * size + np.arange(size)).ravel(), nearest.ravel()
        yield t, whole, rest


def _pruned(parts: Tree, codebooks: Tree, t: int, level: int, node: np.ndarray, depth: int, entry: np.ndarray):
    """The pairs without those whose entry node is farther, in any case, than some other of the node is at most."""
    low, high = parts.low[level][t][node], parts.high[level][t][node]
    e_low, e_high = codebooks.low[depth][t][entry], codebooks.high[depth][t][entry]
    most = _square(np.maximum(high - e_low, e_high - low))
    start = _starts(node)
    limit = np.repeat(np.minimum.reduceat(most, start), np.diff(np.append(start, len(node))))
    keep = _square(np.maximum(np.maximum(low - e_high, e_low - high), 0)) <= limit
    return node[keep], entry[keep]


def sums(parts: Tree, codebooks: Tree, k: int):
    """(tables, k) counts and (tables, k, d) sums of the parts assigned to each entry."""
    tables, _, d = parts.points.shape
    count, total = np.zeros((tables, k), np.int64), np.zeros((tables, k, d), np.int64)
    for t, whole, (place, entry) in assign(parts, codebooks):
        for level, node, e in whole:
            np.add.at(count[t], e, parts.count[level][t][node])
            np.add.at(total[t], e, parts.total[level][t][node])
        own = parts.weight[t][place]
        np.add.at(count[t], entry[own], 1)
        np.add.at(total[t], entry[own], parts.points[t][place[own]])
    return count, total


def codes(parts: Tree, codebooks: Tree, n: int) -> np.ndarray:
    """(tables, n) entries of the parts, in the order in which the tree was given them."""
    tables, size, _ = parts.points.shape
    out = np.zeros((tables, n), np.int64)
    for t, whole, (place, entry) in assign(parts, codebooks):
        found = np.zeros(size, np.int64)
        found[place] = entry
        for level, node, e in whole:
            found.reshape(1 << level, -1)[node] = e[:, None]
        out[t, parts.order[t][parts.weight[t]]] = found[parts.weight[t]]
    return out


def cut(vectors: np.ndarray, parts: int) -> np.ndarray:
    """(n, dim) to (parts, n, dim / parts)."""
    return vectors.reshape(len(vectors), parts, vectors.shape[1] // parts).transpose(1, 0, 2)


def _blocks(dim: int, parts: int):
    """Rows (id, label, v) to blocks of them with the integers of their vectors and the trees over their parts."""
    def run(batches):
        for batch in batches:
            size = -(-batch.num_rows // max(1, -(-batch.num_rows * dim // CELLS)))      # blocks of a batch are alike
            for at in range(0, batch.num_rows, max(size, 1)):
                part = batch.slice(at, size)
                n = part.num_rows
                x = np.floor(part.column(2).flatten().to_numpy().reshape(n, dim) * SCALE)
                far = (np.abs(x) > LARGEST).any(axis=1)
                ids, labels = part.column(0), part.column(1)
                lists = [pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), a) for a in (ids, labels)]
                x = x[~far].astype(np.int64)
                order = Tree(cut(x, parts), LEAF).places if len(x) else x
                yield pa.RecordBatch.from_arrays(
                    [*lists, *[pa.array([b.tobytes()], pa.binary()) for b in (np.packbits(far), x, order.astype(np.int32))]],
                    names=["ids", "labels", "far", "v", "trees"])
    return run


def _block(batch, row: int, dim: int, parts: int):
    """Ids, labels, whether a vector takes part, the parts of those that do, and their trees."""
    ids, labels = batch.column(0)[row].values, batch.column(1)[row].values
    far, x, order = (np.frombuffer(batch.column(i)[row].as_buffer(), kind) for i, kind in ((2, np.uint8), (3, np.int64), (4, np.int32)))
    mine = cut(x.reshape(-1, dim), parts)
    tree = Tree(mine, LEAF, order.reshape(parts, -1)) if len(x) else None
    return ids, labels, ~np.unpackbits(far, count=len(ids)).astype(bool), mine, tree


def _round(books, dim: int, parts: int):
    def run(batches):
        book = Tree(books.value, 1)
        k = books.value.shape[1]
        count, total = np.zeros((parts, k), np.int64), np.zeros((parts, k, dim // parts), np.int64)
        for batch in batches:
            for row in range(batch.num_rows):
                *_, tree = _block(batch, row, dim, parts)
                if tree:
                    c, s = sums(tree, book, k)
                    count += c
                    total += s
        part, entry = np.nonzero(count)
        flat = np.concatenate([count[part, entry][:, None], total[part, entry]], axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(entry.astype(np.int32)),
                                          pa.array(list(flat), pa.list_(pa.int64()))], names=["part", "entry", "sums"])
    return run


def _encode(books, dim: int, parts: int):
    def run(batches):
        book = Tree(books.value, 1)
        for batch in batches:
            for row in range(batch.num_rows):
                ids, labels, near, mine, tree = _block(batch, row, dim, parts)
                code, error = np.full(len(near), None, object), np.zeros(len(near), np.int64)
                if tree:
                    entry = codes(tree, book, mine.shape[1])
                    error[near] = sum(_square(mine[p] - books.value[p][entry[p]]) for p in range(parts))
                    code[near] = [bytes(c).hex() for c in entry.T.astype(np.uint8)]
                yield pa.RecordBatch.from_arrays([ids, labels, pa.array(code, pa.string()), pa.array(error, mask=~near)],
                                                 names=["id", "label", "code", "error"])
    return run


def usable(df: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """(id, label, v array<double>) of the rows that take part."""
    v = F.col("v")
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{label_col}`").alias("label"),
                     F.col(f"`{vector_col}`").cast("array<double>").alias("v"))
    # (a NaN or infinite component makes the sum of the zeros that it is multiplied with NaN)
    rows = rows.where((F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull())
                      & (F.aggregate(v, F.lit(0.0), lambda a, x: a + x * 0.0) == 0.0))
    length = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return rows.where(F.size("v") == (length["d"] if length else 0))


def train(blocks: DataFrame, start: np.ndarray, dim: int, parts: int, rounds: int) -> np.ndarray:
    """The codebooks (parts, entries, dim / parts) after the rounds."""
    books = start
    sc = blocks.sparkSession.sparkContext
    for _ in range(rounds):
        found = (blocks.mapInArrow(_round(sc.broadcast(books), dim, parts), "part int, entry int, sums array<long>")
                 .groupBy("part", "entry").agg(F.array(*[F.sum(F.col("sums")[j]) for j in range(dim // parts + 1)]).alias("sums")))
        books = books.copy()
        for r in found.collect():       # at most one row an entry
            books[r["part"], r["entry"]] = np.array(r["sums"][1:]) // r["sums"][0]
    return books


def compress(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
             parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """(id, label, code, error) of every vector that takes part, and the codebooks.

    Vectors must have a length that ``parts`` divides; ``entries`` may be up to 256.
    """
    spark = df.sparkSession
    ship_package(spark)
    if not 0 < entries <= 256:
        raise ValueError("an index has two hexadecimal digits: entries must be in 1..256")
    rows = usable(df, id_col, vector_col, label_col)
    fine = F.forall("v", lambda x: F.abs(F.floor(x * SCALE)) <= LARGEST)
    smallest = rows.where(fine).orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).select("v").collect()
    kind = rows.schema["label"].dataType.simpleString()
    out = f"id long, label {kind}, code string, error long"
    if not smallest:
        return rows.select("id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error")), np.zeros((parts, 0, 0), np.int64)
    first = np.floor(np.array([r["v"] for r in smallest], np.float64) * SCALE).astype(np.int64)
    dim = first.shape[1]
    if dim % parts:
        raise ValueError(f"vectors of {dim} components can't be cut into {parts} equal parts")
    blocks = materialize(rows.mapInArrow(_blocks(dim, parts), f"ids array<long>, labels array<{kind}>, far binary, v binary, trees binary"), "vectors")
    books = train(blocks, np.ascontiguousarray(cut(first, parts)), dim, parts, rounds)
    return blocks.mapInArrow(_encode(spark.sparkContext.broadcast(books), dim, parts), out), books


def codebooks_sha256(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def digest(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """The columns of the query: id, code, error, label_error, codebooks_sha256."""
    coded, books = compress(df, id_col, vector_col, label_col)
    coded = materialize(coded, "codes")
    labels = coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "of")
    return (coded.join(labels, F.col("label").eqNullSafe(F.col("of")))
            .select(F.col("id").alias(id_col), "code", "error", F.when(F.col("error").isNotNull(), F.col("label_error")).alias("label_error"),
                    F.lit(codebooks_sha256(books)).alias("codebooks_sha256")))
