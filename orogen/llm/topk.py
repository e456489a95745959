"""Exact top-k inner products by multi-resolution segment statistics."""

from __future__ import annotations

from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def quantised(vectors: DataFrame, scale: float = 256.0) -> DataFrame:
    """vec_id and ``v``, each component as floor(scale * x); vectors that are null or hold a null or non-finite component, and rows without a vec_id, are left out. Components beyond 64 bits stop at the ends of that range."""
    x = F.col("embedding")
    sound = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) != float("inf")))
    whole = F.transform(x, lambda c: F.floor(c.cast("double") * scale).cast("long"))
    return vectors.where(x.isNotNull() & F.col("vec_id").isNotNull()).where(sound).select(F.col("vec_id").cast("long").alias("vec_id"), whole.alias("v"))


class Levels:
    """Vectors at falling resolution: each segment's mean and deviation, scaled so that dot products bound inner products.

    For segments of length L, q.x = sum L * mean_q * mean_x + the residuals' product, which is at most
    L * dev_q * dev_x. With |q|^2 and |x|^2 that is the lower bound of the squared distance
    sum L * ((mean_q - mean_x)^2 + (dev_q - dev_x)^2).
    """

    def __init__(self, x: np.ndarray, segments: tuple[int, ...] = (1, 4, 16)):
        self.exact = x.astype(np.float64)
        self.levels = []
        for s in segments:
            if s >= x.shape[1]:
                break
            cuts = np.linspace(0, x.shape[1], s + 1).astype(int)
            length = np.diff(cuts)
            mean = np.add.reduceat(self.exact, cuts[:-1], 1) / length
            square = np.add.reduceat(self.exact**2, cuts[:-1], 1) / length
            dev = np.sqrt(np.maximum(square - mean**2, 0))
            self.levels.append(np.concatenate((mean, dev), 1) * np.sqrt(np.tile(length, 2)))


def products_of(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Exact inner products of rows of integers with one: in floats while no sum can leave 2^53, else in 64-bit integers while none can leave them, else in Python's."""
    if not x.size:
        return np.zeros(len(x), np.int64)
    most = int(max(x.max(), -int(x.min()))) * int(max(q.max(), -int(q.min()))) * len(q)
    if most < 1 << 53:
        return np.rint(x.astype(np.float64) @ q.astype(np.float64)).astype(np.int64)
    if most < 1 << 63:
        return x @ q
    return x.astype(object) @ q.astype(object)


def search(q: np.ndarray, q_ids: np.ndarray, x: np.ndarray, x_ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """For each query the k best rows of ``x`` but its own id, (query, id, score) arrays, and how many exact products that took."""
    queries, rows = Levels(q), Levels(x)
    out_q, out_x, out_s, products = [], [], [], 0
    slack = 1e-9 * (np.abs(queries.exact).max(initial=1) * np.abs(rows.exact).max(initial=1) * x.shape[1] + 1) + 1e-3
    for i in range(len(q)):
        at = np.flatnonzero(x_ids != q_ids[i])
        if not len(at):
            continue
        bar = -np.inf
        for coarse, own in zip(rows.levels, queries.levels, strict=True):
            bound = coarse[at] @ own[i] + slack
            if len(at) > 4 * k:  # the rows of the highest bounds set the bar
                probe = at[np.argpartition(-bound, 2 * k)[: 2 * k]]
                bar = max(bar, np.sort(rows.exact[probe] @ queries.exact[i])[-k])
                products += len(probe)
            at = at[bound >= bar]
        score = products_of(x[at], q[i])
        products += len(at)
        best = np.lexsort((x_ids[at], -score)) if score.dtype != object else np.array(sorted(range(len(at)), key=lambda j: (-score[j], x_ids[at[j]])))
        best = best[:k]
        out_q.append(np.full(len(best), q_ids[i]))
        out_x.append(x_ids[at[best]])
        out_s.append(score[best])
    if not out_q:
        return *(np.zeros(0, np.int64) for _ in range(3)), products
    return np.concatenate(out_q), np.concatenate(out_x), np.concatenate(out_s), products


def top_k(vectors: DataFrame, every: int = 50, k: int = 5, query_block: int = 2048, row_block: int = 8192) -> DataFrame:
    """query_id, rank, vec_id and score: each query's k highest integer inner products, ties to the smaller vec_id.

    Queries are the rows whose vec_id is divisible by ``every``, candidates all rows. Queries
    come in blocks of about ``query_block`` and candidates in blocks of about ``row_block``; each pair
    of blocks of one dimension is searched in a task, coarse to fine, and keeps k rows a query. Rows of one
    vec_id are one vector to the exclusion of a query itself. Vectors are only compared with those of as many
    components; without components the product is 0. Null vectors and such with null or non-finite
    components take no part. Products beyond 64 bits rank as they are and show the end of that range. An
    empty table gives no rows; other columns are not read.
    """
    rows = quantised(vectors).withColumn("dim", F.size("v"))
    n = rows.agg(F.count("*").alias("n"), F.count_if(F.col("vec_id") % every == 0).alias("q")).first()
    q_blocks, x_blocks = max(1, -(-n["q"] // query_block)), max(1, -(-n["n"] // row_block))
    mixed = F.xxhash64("vec_id")
    asked = rows.where(F.col("vec_id") % every == 0).withColumn("qb", F.pmod(mixed, F.lit(q_blocks))).withColumn("xb", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(x_blocks - 1).cast("long"))))
    given = rows.withColumn("xb", F.pmod(mixed, F.lit(x_blocks))).withColumn("qb", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(q_blocks - 1).cast("long"))))
    wide = pa.decimal128(38, 0)
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", wide)])

    def met(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        dim = left["dim"][0].as_py()
        q, x = (t["v"].combine_chunks().flatten().to_numpy().reshape(t.num_rows, dim) for t in (left, right))
        a, b, s, _ = search(q, left["vec_id"].to_numpy(), x, right["vec_id"].to_numpy(), k)
        score = pa.array(s).cast(wide) if s.dtype != object else pa.array([Decimal(max(-(10**38) + 1, min(10**38 - 1, v))) for v in s.tolist()], wide)
        return pa.table([pa.array(a), pa.array(b), score], schema=schema)

    found = asked.groupBy("dim", "qb", "xb").cogroup(given.groupBy("dim", "qb", "xb")).applyInArrow(met, "query_id long, vec_id long, score decimal(38,0)")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    held = F.greatest(F.least("score", F.lit(2**63 - 1)), F.lit(-(2**63))).cast("long")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", held.alias("score"))
