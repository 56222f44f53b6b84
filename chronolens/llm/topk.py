"""Exact inner-product top-k over an impact-ordered index, score at a time.

The index holds blocks of up to BLOCK vectors. In each block and dimension the components fall into LEVELS steps of equal width; the rows of a step
are a posting segment. For a query, a segment's quantised impact is what its step adds to the score over the least that the dimension can give.
Segments are processed by descending impact down to the last, in batches that end at the shares STOPS of the largest impact; all of a block's
segments of an impact come before any of a lower one. A row's score so far is a lower bound of its score. What it can still gain is bounded by the
largest impacts left of as many dimensions as have not met the row yet, and the width of a step. After each batch, processing stops if it is proven
that at most one of SHARE rows (or FEW) has an upper bound that reaches the k-th best lower bound or the k-th best score known of the query; these
possible members are scored exactly. On 10,256 unit vectors of 64 isotropic dimensions this stops after about two thirds of the postings once k scores
are known. Ties at the k-th place are all rescored, so the smaller id wins. Where sums of impacts would leave the exact range of doubles, all rows are rescored.

Vectors that are null or hold null or non-finite components take no part; nor do pairs of different lengths. Equal vectors and repeated rows are rows
of their own; only a query's own row is no candidate. Among equal scores the smaller id comes first, a null id last. Fewer than k candidates give
fewer rows; an empty table, or one without queries, gives no rows. Extra columns are ignored. Scores must fit 64 bits; components must be below 2**31.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

BLOCK, QUERIES_AT_ONCE, LEVELS, FEW, SHARE, GROUPS = 8192, 512, 64, 96, 4, 4096
#: Shares of the largest impact at which bounds are compared.
STOPS = (0.2, 0.12, 0.085, 0.06, 0.04, 0.02, 0.0)
#: Queries of which a task keeps the best rows before it hands them on.
HELD = 20_000


def usable(vector: str) -> Column:
    v = F.col(vector)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    return v.isNotNull() & ~F.coalesce(bad, F.lit(True))


class Block:
    """Components (rows x dimensions) with their posting segments: rows by dimension, then step; ends of the steps."""

    def __init__(self, m: np.ndarray, rows: np.ndarray | None = None, ends: np.ndarray | None = None) -> None:
        self.m = m
        n, d = m.shape
        self.low = m.min(0)
        self.width = np.maximum(1, -(-(m.max(0) - self.low + 1) // LEVELS))
        if rows is None:
            code = (m - self.low) // self.width
            order = np.argsort(code, axis=0, kind="stable")
            rows = order.T
            ends = np.stack([np.searchsorted(code[order[:, j], j], np.arange(LEVELS), "right") for j in range(d)]) if d else np.zeros((0, LEVELS), np.int64)
        self.rows, self.ends = np.ascontiguousarray(rows).astype(np.int64), ends
        #: the segment of each posting, and where segments begin
        self.edge = np.concatenate([np.zeros((d, 1), np.int64), ends], 1)
        self.segment = np.repeat(np.arange(d * LEVELS), np.diff(self.edge, axis=1).ravel()).reshape(d, n)
        #: postings processed so far, for whoever wants to know
        self.touched = 0

    def possible(self, q: np.ndarray, k: int, known: int | None) -> np.ndarray:
        """The rows that can be among the k best; no others can."""
        n, d = self.m.shape
        enough = max(k, FEW, n // SHARE)
        if n <= max(k, FEW) or not d:
            return np.arange(n)
        step, up = np.abs(q) * self.width, q >= 0
        top = int(step.max()) * (LEVELS - 1)
        if top == 0 or int(step.sum()) * LEVELS * (d + 1) >= 1 << 52:
            return np.arange(n)
        # the least score, by the dimension's lowest step for a positive component and its highest for a negative one
        base = int(np.where(up, q * self.low, q * (self.low + LEVELS * self.width - 1)).sum())
        slack = int((np.abs(q) * (self.width - 1)).sum())
        steps = np.arange(LEVELS)
        # a posting adds its impact times (d + 1), and 1: sums hold a row's score and the number of dimensions that have met it
        worth = (step[:, None] * np.where(up[:, None], steps, LEVELS - 1 - steps) * (d + 1) + 1).ravel().astype(np.float64)
        total, dims = np.zeros(n), np.arange(d)
        done = np.full(d, LEVELS)  # of each dimension's steps, counted from the least impact, those from here on are processed
        for share in STOPS:
            least = -(-int(share * top) // np.maximum(step, 1)) if share else np.zeros(d, np.int64)
            least = np.minimum(np.where(step > 0, least, 0 if not share else LEVELS), done)
            first, last = np.where(up, least, LEVELS - done), np.where(up, done, LEVELS - least)
            spans = [(j, x, y) for j, x, y in zip(range(d), self.edge[dims, first].tolist(), self.edge[dims, last].tolist()) if y > x]
            done = least
            if spans:
                met = np.concatenate([self.rows[j, x:y] for j, x, y in spans])
                total += np.bincount(met, worth.take(np.concatenate([self.segment[j, x:y] for j, x, y in spans])), n)
                self.touched += len(met)
            score = np.floor(total / (d + 1))
            unmet = d - (total - score * (d + 1)).astype(np.int64)
            left = np.concatenate([[0], np.sort(step * np.maximum(done - 1, 0))[::-1].cumsum()])
            kth = np.partition(score, n - k)[n - k]
            if known is not None:
                kth = max(kth, known - base)
            out = np.flatnonzero(score + left[unmet] + slack >= kth)
            if len(out) <= enough:
                return out
        return out


def _blocks(batches: Iterator[pa.RecordBatch], names: tuple[str, str, str], size: int, build: bool) -> Iterator[pa.RecordBatch]:
    held: dict[int, list] = {}

    def flush(d: int) -> pa.RecordBatch:
        ids, uids, rows = zip(*held.pop(d))
        m = np.array(rows, np.int64).reshape(len(ids), d)
        given = np.array([x is not None for x in ids])
        out = {"d": [d], "n": [len(ids)], "ids": [np.array([x or 0 for x in ids], np.int64).tobytes()], "given": [given.tobytes()], "uids": [np.array(uids, np.int64).tobytes()], "m": [m.astype(np.int32).tobytes()]}
        if build:
            b = Block(m)
            out |= {"rows": [b.rows.astype(np.int32).tobytes()], "ends": [b.ends.astype(np.int64).tobytes()]}
        return pa.RecordBatch.from_pydict(out, pa.schema([("d", pa.int32()), ("n", pa.int32()), *[(c, pa.binary()) for c in list(out)[2:]]]))

    for batch in batches:
        for i, u, v in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in names)):
            held.setdefault(len(v), []).append((i, u, v))
            if len(held[len(v)]) == size:
                yield flush(len(v))
    for d in list(held):
        yield flush(d)


_BLOCK = "d int, n int, ids binary, given binary, uids binary, m binary"


def _load(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    ids, given = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["given"], bool)
    return ids, given, np.frombuffer(row["uids"], np.int64), np.frombuffer(row["m"], np.int32).reshape(row["n"], row["d"]).astype(np.int64)


def _groups(index: DataFrame) -> DataFrame:
    """(part, before): how many blocks lie before each of the partitions that wrote them, so that block numbers run without gaps. A row a partition."""
    n = sorted((r["part"], r["n"]) for r in index.groupBy(F.shiftright("block", 33).alias("part")).agg(F.count(F.lit(1)).alias("n")).collect())
    before = np.concatenate([[0], np.cumsum([k for _, k in n])]).astype(int).tolist()
    return index.sparkSession.createDataFrame([(p, b) for (p, _), b in zip(n, before)], "part long, before long")


def _dealt(index: DataFrame, asked: DataFrame) -> DataFrame:
    """Blocks of the index by group, each followed by the blocks of queries that its group is asked. No join: Spark would judge the blocks of queries by
    their files, before each is there once a group, and send them all through the driver; and a join's rows would repeat a block of the index."""
    none = [F.lit(None).cast("binary").alias(c) for c in ("rows", "ends")]
    both = index.withColumn("asks", F.lit(False)).unionByName(asked.select("*", *none, F.lit(True).alias("asks")))
    return both.repartition("g").sortWithinPartitions("g", "asks")


def search(df: DataFrame, is_query: Column, id_col: str = "vec_id", vector: str = "embedding", scale: int = 256, k: int = 5, name: str = "topk") -> DataFrame:
    """query_id, rank (from 1), the candidate's id under id_col, score: floor(scale * x) components, integer inner products."""
    rows = df.where(usable(vector)).select(F.col(id_col).cast("long").alias("id"), F.transform(vector, lambda x: F.floor(x.cast("double") * scale)).alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    rows = materialise(rows.withColumn("uid", F.monotonically_increasing_id()), f"{name}-vectors")
    cols = ("id", "uid", "v")
    index = rows.select(*cols).mapInArrow(lambda it: _blocks(it, cols, BLOCK, True), _BLOCK + ", rows binary, ends binary")
    index = materialise(index.withColumn("block", F.monotonically_increasing_id()), f"{name}-index")
    index = index.join(F.broadcast(_groups(index)), F.shiftright("block", 33) == F.col("part"), "inner").withColumn("g", ((F.col("before") + F.col("block").bitwiseAND((1 << 33) - 1)) % GROUPS).cast("int"))
    groups = [r["g"] for r in index.select("g").distinct().collect()]  # at most GROUPS
    asked = rows.where("asks").select(*cols).repartition(max(1, min(64, len(groups)))).mapInArrow(lambda it: _blocks(it, cols, QUERIES_AT_ONCE, False), _BLOCK)
    asked = materialise(asked, f"{name}-queries")
    asked = asked.withColumn("g", F.explode(F.array(*map(F.lit, groups)) if groups else F.array().cast("array<int>")))
    both = _dealt(index.drop("block", "part", "before"), asked)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, list[tuple]] = {}
        schema = pa.schema([("quid", pa.int64()), ("query_id", pa.int64()), ("id", pa.int64()), ("uid", pa.int64()), ("score", pa.int64())])
        name_of: dict[int, int] = {}

        def flush() -> pa.RecordBatch:
            out = [(q, name_of[q], i if has else None, u, -s) for q, top in best.items() for s, has_not, i, u in top for has in [not has_not]]
            best.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 5, schema.types)], schema=schema)

        def answer(q_ids: np.ndarray, q_given: np.ndarray, q_uids: np.ndarray, q_m: np.ndarray, ids: np.ndarray, given: np.ndarray, uids: np.ndarray, block: Block) -> None:
            for qi, has, qu, q in zip(q_ids.tolist(), q_given.tolist(), q_uids.tolist(), q_m):
                name_of[qu] = qi if has else None
                had = best.get(qu, [])
                # the query's own row may hold a place, hence one more
                can = block.possible(q, min(k + 1, len(block.m)), -had[k - 1][0] if len(had) >= k else None)
                can = can[uids[can] != qu]
                score = block.m[can] @ q
                new = list(zip((-score).tolist(), (~given[can]).tolist(), ids[can].tolist(), uids[can].tolist()))
                best[qu] = sorted(had + new)[:k]

        held: list[tuple] = []  # the group's blocks of the index
        at = None
        for batch in batches:
            for r in range(batch.num_rows):
                row = {c: batch.column(j)[r].as_py() for j, c in enumerate(batch.schema.names)}
                if row["g"] != at:
                    held, at = [], row["g"]
                ids, given, uids, m = _load(row)
                if not row["asks"]:
                    block = Block(m, np.frombuffer(row["rows"], np.int32).reshape(row["d"], row["n"]), np.frombuffer(row["ends"], np.int64).reshape(row["d"], LEVELS))
                    held.append((ids, given, uids, block))
                    continue
                for its, has_id, its_uids, block in held:
                    if block.m.shape[1] == row["d"]:
                        answer(ids, given, uids, m, its, has_id, its_uids, block)
                if len(best) > HELD:
                    yield flush()
        yield flush()

    found = both.mapInArrow(run, "quid long, query_id long, id long, uid long, score long")
    w = Window.partitionBy("quid").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last(), "uid")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id_col), "score")
