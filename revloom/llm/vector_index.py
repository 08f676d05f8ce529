"""Approximate nearest neighbours by multi-index hashing.

* **Codes.** Directions are centred, rotated and cut to signs. The rotation is learnt (iterative quantisation:
  alternate between signs and the rotation that fits them best) on a bounded sample of ``sample`` vectors.
* **Index.** A code of b bits is split into substrings of 8 bits; every block of rows keeps one table per substring,
  from value to rows. A code within Hamming radius r differs in some substring by at most its share of r (pigeonhole),
  so probing each table with all values in that ball retrieves every code within r; codes are then compared
  in full, and those within r are ranked by inner product in double precision.
* **Radius.** It is learnt too: the least radius within which ``target`` of the true neighbours in the sample
  lie. Neighbours in the whole table are nearer than those in a sample, so recall rises with the data. A query
  that finds fewer than k rows within r takes the nearest codes of the block instead.
* **Work.** Queries in blocks meet rows in blocks (one task per pair of blocks); each pair returns k rows per query,
  of which the best k stay. No bucket meets in one task, whatever its size.

Vectors of isotropic data have no near neighbours: the learnt radius is then near half of the bits, and probing
prunes little. Vectors that are null, zero, or hold null or non-finite components take no part; of rows with the same
vec_id the one with the least vector does; vectors of another length than the commonest raise an error. Ties go to the
smaller vec_id. Null ids take no part. Other columns are ignored.
"""

from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from revloom.plans.runtime import Scratch

BITS_PER_TABLE = 8
SAMPLE = 8192
SAMPLE_QUERIES = 512
TARGET = 0.97
BLOCK = 16384
ROUNDS = 30


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding as doubles) of the rows that take part, one per id."""
    v = F.col("embedding").cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).select(
        F.col("vec_id").cast("long").alias("vec_id"), v.alias("embedding"))
    rows = rows.filter(F.forall("embedding", lambda x: x.isNotNull())).filter(finite).filter(
        F.exists("embedding", lambda x: x != 0))
    return rows.groupBy("vec_id").agg(F.min("embedding").alias("embedding"))


def _matrix(column) -> np.ndarray:
    return np.vstack([np.asarray(v, dtype=np.float64) for v in column])


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


class Coder:
    """Learnt rotation and radius."""

    def __init__(self, sample: np.ndarray, k: int, target: float = TARGET):
        unit = _unit(sample)
        self.mean = unit.mean(axis=0)
        dims = sample.shape[1]
        bits = -(-dims // BITS_PER_TABLE) * BITS_PER_TABLE
        rng = np.random.default_rng(17)
        # more bits than dimensions: the rest are zero columns before the rotation
        wide = np.zeros((len(unit), bits))
        wide[:, :dims] = unit - self.mean
        turn = np.linalg.qr(rng.normal(size=(bits, bits)))[0]
        for _ in range(ROUNDS):
            u, _, vt = np.linalg.svd(np.where(wide @ turn >= 0, 1.0, -1.0).T @ wide)
            turn = (u @ vt).T
        self.turn, self.bits = turn[:dims], bits
        self.tables = bits // BITS_PER_TABLE
        self.radius = self._radius(sample, k, target)

    def codes(self, x: np.ndarray) -> np.ndarray:
        """(rows, tables) bytes."""
        return np.packbits((_unit(x) - self.mean) @ self.turn >= 0, axis=1)

    def _radius(self, sample: np.ndarray, k: int, target: float) -> int:
        codes, n = self.codes(sample), min(SAMPLE_QUERIES, len(sample))
        apart = []
        for i in range(n):
            inner = sample @ sample[i]
            inner[i] = -np.inf
            near = np.argsort(-inner, kind="stable")[:min(k, len(sample) - 1)]
            apart.append(np.bitwise_count(codes[near] ^ codes[i]).sum(axis=1))
        every = np.concatenate(apart) if apart else np.zeros(1)
        return int(np.quantile(every, target, method="higher")) if len(every) else self.bits

    def shares(self) -> list[int]:
        """Radius of each table: sum of (share + 1) exceeds the radius, so one of them must hold."""
        base, extra = divmod(self.radius, self.tables)
        return [base if i <= extra else base - 1 for i in range(self.tables)]


_DISTANCE = np.bitwise_count(np.arange(256, dtype=np.uint8)[:, None] ^ np.arange(256, dtype=np.uint8)[None, :])


class Block:
    """The index of one block of rows."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, coder: Coder):
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors, self.coder = ids[order], vectors[order], coder
        self.codes = coder.codes(self.vectors)
        self.rows, self.sizes = [], []
        for t in range(coder.tables):
            self.rows.append(np.argsort(self.codes[:, t], kind="stable"))
            self.sizes.append(np.bincount(self.codes[:, t], minlength=256))

    def within(self, code: np.ndarray) -> np.ndarray:
        """All rows whose code is within the radius: probe every table, then compare whole codes."""
        hit = np.zeros(len(self.ids), dtype=bool)
        for t, share in enumerate(self.coder.shares()):
            if share < 0:
                continue
            ball = _DISTANCE[code[t]] <= share
            hit[self.rows[t][np.repeat(ball, self.sizes[t])]] = True
        rows = np.flatnonzero(hit)
        return rows[np.bitwise_count(self.codes[rows] ^ code).sum(axis=1) <= self.coder.radius]

    def search(self, query_id: int, vector: np.ndarray, code: np.ndarray, k: int):
        """The best k rows but the query's own, by inner product, then id."""
        rows = self.within(code)
        rows = rows[self.ids[rows] != query_id]
        if len(rows) < k:
            apart = np.bitwise_count(self.codes ^ code).sum(axis=1).astype(np.int64)
            apart[self.ids == query_id] = self.coder.bits + 1
            want = min(4 * k, int((self.ids != query_id).sum()))
            rows = np.argsort(apart, kind="stable")[:want]
        score = np.einsum("ij,j->i", self.vectors[rows], vector)
        best = np.lexsort((self.ids[rows], -score))[:k]
        return self.ids[rows[best]], score[best]


def _search(key, queries: pd.DataFrame, rows: pd.DataFrame, shared, k: int) -> pd.DataFrame:
    out = []
    if len(queries) and len(rows):
        coder = shared.value
        block = Block(rows["vec_id"].to_numpy(), _matrix(rows["embedding"]), coder)
        vectors = _matrix(queries["embedding"])
        for query, vector, code in zip(queries["vec_id"], vectors, coder.codes(vectors)):
            ids, scores = block.search(query, vector, code, k)
            out.append((query, list(ids), list(scores)))
    return pd.DataFrame(out, columns=["query_id", "ids", "scores"])


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, sample: int = SAMPLE,
            block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` best rows of ``vectors`` found for each row of ``queries``.

    Both tables have (vec_id, embedding); a query is no neighbour of its own vec_id. Fits when called.
    """
    spark = vectors.sparkSession
    with Scratch(spark) as scratch:
        rows = scratch.settle(usable(vectors))
        asked = scratch.settle(usable(queries))
        taken = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).collect()
        if not taken:
            return scratch.settle(spark.createDataFrame(
                [], "query_id long, rank int, vec_id long, score double"), keep=True)
        shared = spark.sparkContext.broadcast(Coder(_matrix(r.embedding for r in taken), k))
        n_rows, n_asked = (max(1, -(-df.count() // block)) for df in (rows, asked))
        part = lambda df, n: df.withColumn("_b", F.pmod(F.xxhash64("vec_id"), F.lit(n)))
        copies = lambda df, n, name: df.withColumn(
            name, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))))
        left = copies(part(asked, n_asked).withColumnRenamed("_b", "qb"), n_rows, "rb")
        right = copies(part(rows, n_rows).withColumnRenamed("_b", "rb"), n_asked, "qb")
        best = left.groupBy("qb", "rb").cogroup(right.groupBy("qb", "rb")).applyInPandas(
            partial(_search, shared=shared, k=k), "query_id long, ids array<long>, scores array<double>")
        each = best.select("query_id", F.explode(F.arrays_zip("ids", "scores")).alias("e")).select(
            "query_id", F.col("e.ids").alias("vec_id"), F.col("e.scores").alias("score"))
        order = W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
        return scratch.settle(each.withColumn("rank", F.row_number().over(order)).filter(
            F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"), keep=True)
