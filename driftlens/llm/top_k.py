"""Exact top-k inner products by norm-bucketed retrieval.

Candidates are sorted by length and cut into buckets of similar length. Each query gets a first threshold, its k-th
best product in the longest buckets. A block of queries meets a group of buckets, and of these a bucket, only where
its longest vector is long enough for some query's threshold: that is tested before anything is moved. For every block
and bucket that meet, the local cosine threshold, the threshold divided by both lengths, decides: above one the bucket
is skipped for the query; where it is high, coordinate pruning
keeps the candidates whose largest query coordinates lie in the feasible interval; else length pruning keeps a
prefix of the bucket. The products of what is left are verified exactly.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from driftlens.llm.common import stash

#: Candidates in a bucket, queries in a block, buckets for the first thresholds.
BUCKET, BLOCK, SEEDS = 4096, 256, 2
#: Groups of buckets, at most.
GROUPS = 4096
COORDINATE_FROM = 0.9
#: Products of doubles are exact below this.
EXACT = float(1 << 53)


def quantized(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component as a double, null if the vector or a component is null or not finite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    whole = F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(float(scale))).cast("double"))
    return F.when(vector.isNotNull() & ~bad, whole)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(-1, width)


def _pack(ids: np.ndarray, rows: np.ndarray, floor: np.ndarray | None = None) -> dict[str, object]:
    small = np.abs(rows).max(initial=0) < 32768
    return {
        "dims": rows.shape[1], "n": len(ids), "longest": float(np.sqrt((rows**2).sum(1).max(initial=0))), "ids": ids.astype(np.int64).tobytes(),
        "kind": "i2" if small else "f8", "rows": rows.astype(np.int16 if small else np.float64).tobytes(),
        "floor": b"" if floor is None else floor.astype(np.float64).tobytes(), "reach": _reach(rows, floor),
    }


def _reach(rows: np.ndarray, floor: np.ndarray | None) -> float:
    """The least length of a vector that may come up to some query's threshold."""
    if floor is None or not len(rows):
        return 0.0
    lengths = np.sqrt((rows**2).sum(1))
    with np.errstate(divide="ignore", invalid="ignore"):
        least = np.where(floor <= 0, 0.0, np.where(lengths > 0, floor / lengths, np.inf))
    return float(least.min()) * (1 - 1e-9)


def _unpack(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rows = np.frombuffer(row["rows"], np.int16 if row["kind"] == "i2" else np.float64).astype(np.float64)
    return np.frombuffer(row["ids"], np.int64), rows.reshape(row["n"], row["dims"]), np.frombuffer(row["floor"], np.float64)


def products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Inner products of integer rows: doubles where they are exact, else Python's integers."""
    if q.size and c.size and q.shape[1] * np.abs(q).max() * np.abs(c).max() >= EXACT:
        return (q.astype(object) @ c.astype(object).T)
    return q @ c.T


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> list[tuple[int, int]]:
    """The k highest (score, id), ties to the smaller id."""
    order = np.lexsort((ids, -scores))[:k] if scores.dtype != object else sorted(range(len(ids)), key=lambda j: (-scores[j], ids[j]))[:k]
    return [(int(scores[j]), int(ids[j])) for j in order]


def search_block(qids, q, floor, cids, c, longest, k) -> Iterator[tuple[int, list[tuple[int, int]]]]:
    """For each query of a block its best in one bucket, whose rows stand from long to short; floors are thresholds."""
    lengths = np.sqrt((q**2).sum(1))
    sizes = np.sqrt((c**2).sum(1))
    with np.errstate(divide="ignore", invalid="ignore"):
        local = np.where(floor == -np.inf, -np.inf, np.where(lengths * longest > 0, floor / (lengths * longest), np.where(floor > 0, np.inf, -np.inf)))
    live = local <= 1 + 1e-9
    high = live & (local >= COORDINATE_FROM)
    low = np.flatnonzero(live & ~high)
    if len(low):  # length pruning: one prefix for all of them
        with np.errstate(divide="ignore"):
            least = np.where((floor[low] > 0) & (lengths[low] > 0), floor[low] / np.maximum(lengths[low], 1e-300), 0).min()
        n = int(np.searchsorted(-sizes, -least * (1 - 1e-9), side="right"))
        found = products(q[low], c[:n])
        for row, scores in zip(low, found, strict=True):
            keep = np.flatnonzero((scores >= floor[row]) & (cids[:n] != qids[row]))
            if len(keep):
                yield row, best(scores[keep], cids[keep], k)
    unit = c[:, :] / np.maximum(sizes, 1e-300)[:, None] if high.any() else None
    for row in np.flatnonzero(high):  # coordinate pruning on the query's three largest coordinates
        t, u = min(1.0, float(local[row])), q[row] / max(lengths[row], 1e-300)
        keep = cids != qids[row]
        for f in np.argsort(-np.abs(u))[:3]:
            room = np.sqrt(max(0.0, (1 - t * t) * (1 - u[f] ** 2))) + 1e-7
            keep &= (unit[:, f] >= t * u[f] - room) if u[f] >= 0 else (unit[:, f] <= t * u[f] + room)
        at = np.flatnonzero(keep)
        scores = products(q[row : row + 1], c[at])[0] if len(at) else np.empty(0)
        at, scores = at[scores >= floor[row]], scores[scores >= floor[row]]
        if len(at):
            yield row, best(scores, cids[at], k)


def met(asked: DataFrame, buckets: DataFrame) -> DataFrame:
    """The pairs of a block of queries and a bucket that may hold one of its results.

    Buckets stand from long to short; neighbours form groups, more of them the more data there is. A block is copied to
    the groups only that its reach admits.
    """
    parts = (buckets.agg(F.max(F.shiftright("block", 33))).first()[0] or 0) + 1
    split = 8 if parts < 64 else 1
    group = (F.floor(F.shiftright("block", 33) / -(-parts // GROUPS)) * split + F.pmod("block", F.lit(split))).cast("int")
    right = buckets.select("dims", *(F.col(c).alias(f"c_{c}") for c in ("n", "longest", "ids", "kind", "rows")), group.alias("g"))
    longest = right.groupBy("g").agg(F.max("c_longest").alias("top")).collect()  # one row for each of at most GROUPS
    tops = F.lit([float(r["top"]) for r in sorted(longest, key=lambda r: r["g"])] or [0.0])
    numbers = F.lit(sorted(r["g"] for r in longest) or [0])
    open_to = F.filter(F.arrays_zip(numbers.alias("g"), tops.alias("top")), lambda x: x["top"] >= F.col("reach"))
    left = asked.select("dims", "reach", *(F.col(c).alias(f"q_{c}") for c in ("block", "n", "ids", "kind", "rows", "floor")), F.explode(F.transform(open_to, lambda x: x["g"])).alias("g"))
    return left.join(right, ["g", "dims"]).where("c_longest >= reach").drop("reach")


def top_k(vectors: DataFrame, every: int = 50, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Per query (rows whose id is divisible by ``every``) and rank: query_id, rank, id, score.

    Candidates are all rows but those with the query's id; ties go to the smaller id. Vectors that are null, empty or
    hold null or non-finite components, and rows with null id, take no part; vectors of other lengths than the
    query's are no candidates. A repeated query row counts once, a repeated candidate row as often as it stands; different
    query rows of one id share one ranking, of the best of them. An
    empty table gives no rows; queries without candidates give none.
    """
    spark = vectors.sparkSession
    ready = vectors.select(vectors[id_col].cast("long").alias("id"), quantized(vectors[vector_col]).alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0))
    ready = ready.withColumn("dims", F.size("v")).withColumn("norm", F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    kind = "block long, dims int, n int, longest double, ids binary, kind string, rows binary, floor binary, reach double"

    def blocks(size: int, seeds: list[dict]):
        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            made = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 33
            held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
            ready_seeds = [_unpack(s) + (s["longest"],) for s in seeds]

            def flush(width: int) -> pa.RecordBatch:
                nonlocal made
                ids, rows = (np.concatenate(x) for x in zip(*held.pop(width), strict=True))
                floor = None
                if seeds:
                    tops = [[] for _ in ids]
                    for cids, c, _, longest in ready_seeds:
                        if c.shape[1] == width:
                            for row, top in search_block(ids, rows, np.full(len(ids), -np.inf), cids, c, longest, k):
                                tops[row] += top
                    floor = np.array([sorted(s for s, _ in t)[-k] if len(t) >= k else -np.inf for t in tops])
                out = {"block": made} | _pack(ids, rows, floor)
                made += 1
                return pa.RecordBatch.from_pylist([out], schema=arrow)

            for batch in batches:
                ids, widths = batch.column(0).to_numpy(), batch.column(2).to_numpy()
                for width in np.unique(widths):
                    at = np.flatnonzero(widths == width)
                    rows = _matrix(batch.column(1).take(pa.array(at)), int(width))
                    for start in range(0, len(at), size):
                        own = held.setdefault(int(width), [])
                        part = slice(start, start + size)
                        if own and sum(len(x) for x, _ in own) + len(at[part]) > size:
                            yield flush(int(width))
                            own = held.setdefault(int(width), [])
                        own.append((ids[at[part]], rows[part]))
            for width in list(held):
                yield flush(width)

        return work

    arrow = pa.schema([("block", pa.int64()), ("dims", pa.int32()), ("n", pa.int32()), ("longest", pa.float64()), ("ids", pa.binary()), ("kind", pa.string()), ("rows", pa.binary()), ("floor", pa.binary()), ("reach", pa.float64())])
    ordered = ready.repartitionByRange(F.desc("norm"), "id").sortWithinPartitions(F.desc("norm"), "id").select("id", "v", "dims")
    buckets = stash(ordered.mapInArrow(blocks(BUCKET, []), kind), "buckets")
    # a few buckets of bounded size: the longest vectors
    seeds = [r.asDict() | {"rows": bytes(r["rows"]), "ids": bytes(r["ids"]), "floor": b""} for r in buckets.orderBy(F.desc("longest"), "block").limit(SEEDS).collect()]
    queries = ready.where(F.col("id") % every == 0).select("id", "v", "dims").dropDuplicates(["id", "v"])
    asked = queries.mapInArrow(blocks(BLOCK, seeds), kind)
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: OrderedDict[int, np.ndarray] = OrderedDict()  # thresholds of the blocks seen last rise as buckets go by
        for batch in batches:
            for k_row in range(batch.num_rows):
                r = batch.slice(k_row, 1).to_pylist()[0]
                qids, q, floor = _unpack({"dims": r["dims"], **{c: r[f"q_{c}"] for c in ("n", "ids", "kind", "rows", "floor")}})
                cids, c, _ = _unpack({"dims": r["dims"], "floor": b"", **{x: r[f"c_{x}"] for x in ("n", "ids", "kind", "rows")}})
                floor = known.pop(r["q_block"], floor if len(floor) else np.full(len(qids), -np.inf)).copy()
                out = []
                for row, top in search_block(qids, q, floor, cids, c, r["c_longest"], k):
                    out += [(int(qids[row]), i, s) for s, i in top]
                    if len(top) == k:
                        floor[row] = max(floor[row], top[-1][0])
                known[r["q_block"]] = floor
                if len(known) > 256:
                    known.popitem(last=False)
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], names=["query_id", "id", "score"])

    pairs = met(asked, buckets).mapInArrow(search, "query_id long, id long, score long")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias(id_col), "score")
