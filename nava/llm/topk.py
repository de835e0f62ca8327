"""Exact top-k inner products over norm-sorted blocks.

Components are turned into integers, so scores are exact. Vectors are ordered by descending length and packed into blocks. A
rotation from the SVD of a bounded sample puts most of a vector's length into its first coordinates. For a query q and a vector x
the first HEAD rotated coordinates give a partial sum, and |rest of q| * |rest of x| bounds what is missing (Cauchy-Schwarz).
Each query's k-th best score over the longest block is its threshold, which names the least length that a vector of the result can have.
Blocks of queries and of vectors are first paired by these two numbers alone, in buckets of lengths; only pairs that remain are sent,
the queries to the vectors' block, so vectors that are too short never leave their place. Within a pair of blocks only vectors whose
bound reaches the threshold are scored.

The rotation changes only how much is pruned, never the result. The sample for it has at most SAMPLE rows.

Nulls, ties and edges: vectors that are null or hold a null or non-finite component take no part, as query or as candidate;
ties go to the smaller vec_id; rows that share the query's vec_id count as its own row; a vec_id that repeats among the queries is
asked once for each row; shorter vectors count as padded with zeros; components of which the square isn't finite as a double count as
non-finite; a score beyond 64 bits counts as the nearest 64-bit integer; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nava.session import ship, stored

SCALE = 256
K = 5
QUERY_BLOCK = 512
BLOCK = 2048
#: Blocks of queries that meet a block of vectors in one task, about; buckets of lengths for each doubling.
GROUP = 64
BUCKETS = 16
HEAD = 16
SAMPLE = 4096

PACKED = "block long, n int, dim int, longest double, ids binary, vectors binary, heads binary, rests binary"


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, v: integer components as doubles, of the vectors that take part."""
    fits = "embedding is not null and size(embedding) > 0 and forall(embedding, x -> x is not null and not isnan(x) and 256 * cast(x as double) * 256 * cast(x as double) < double('infinity'))"
    return vectors.where(fits).select("vec_id", F.expr(f"transform(embedding, x -> cast(floor({SCALE} * cast(x as double)) as double))").alias("v"))


def rotation(vectors: DataFrame, dim: int) -> np.ndarray:
    """Rows: the right singular vectors of a bounded sample, largest first."""
    sample = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("v").toArrow().column("v").to_pylist()
    if not len(sample):
        return np.eye(dim)
    rows = np.zeros((len(sample), dim))
    for i, v in enumerate(sample):
        rows[i, : len(v)] = v
    scale = max(np.abs(rows).max(), 1.0)
    return np.linalg.svd(rows.T @ rows / scale**2)[2]


def packer(dim: int, turn: np.ndarray, size: int):
    """Packs the rows of a partition, in their order, into blocks of at most size rows."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def block(ids: np.ndarray, rows: np.ndarray) -> pa.RecordBatch:
            turned = rows @ turn.T
            head = np.ascontiguousarray(turned[:, :HEAD])
            rest = np.sqrt((turned[:, HEAD:] ** 2).sum(1))
            longest = float(np.sqrt((rows**2).sum(1)).max())
            values = [[0], [len(ids)], [dim], [longest], [ids.tobytes()], [rows.tobytes()], [head.tobytes()], [rest.tobytes()]]
            types = [pa.int64(), pa.int32(), pa.int32(), pa.float64()] + [pa.binary()] * 4
            names = ["block", "n", "dim", "longest", "ids", "vectors", "heads", "rests"]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, types)], names=names)

        ids, parts, held = [], [], 0
        for batch in batches:
            column = batch.column(1)
            lengths = np.diff(column.offsets.to_numpy())
            rows = np.zeros((batch.num_rows, dim))
            flat = column.flatten().to_numpy(zero_copy_only=False)
            rows[np.arange(dim)[None, :] < lengths[:, None]] = flat
            ids.append(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64))
            parts.append(rows)
            held += len(rows)
            while held >= size:
                all_ids, all_rows = np.concatenate(ids), np.concatenate(parts)
                yield block(all_ids[:size], all_rows[:size])
                ids, parts, held = [all_ids[size:]], [all_rows[size:]], held - size
        if held:
            yield block(np.concatenate(ids), np.concatenate(parts))

    return pack


def unpacked(row: dict, prefix: str = "") -> tuple[np.ndarray, ...]:
    n, dim = row[f"{prefix}n"], row["dim"]
    ids = np.frombuffer(row[f"{prefix}ids"], np.int64)
    vectors = np.frombuffer(row[f"{prefix}vectors"]).reshape(n, dim)
    heads = np.frombuffer(row[f"{prefix}heads"]).reshape(n, -1)
    return ids, vectors, heads, np.frombuffer(row[f"{prefix}rests"])


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Indices of the k highest scores, ties to the smaller id."""
    if scores.dtype == object:
        return np.array(sorted(range(len(scores)), key=lambda j: (-scores[j], ids[j]))[:k], np.int64)
    if len(scores) > 4 * k:
        edge = np.partition(scores, len(scores) - k)[len(scores) - k]
        near = np.flatnonzero(scores >= edge)
    else:
        near = np.arange(len(scores))
    return near[np.lexsort((ids[near], -scores[near]))][:k]


def exact(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Integer products: in doubles while all sums fit 53 bits, else in Python's integers, kept within 64 bits."""
    if len(queries) == 0 or len(vectors) == 0:
        return np.zeros((len(queries), len(vectors)))
    if np.abs(queries).max() * np.abs(vectors).max() * queries.shape[1] < 2**53:
        return queries @ vectors.T
    whole = lambda a: np.array([[int(x) for x in r] for r in a], dtype=object)
    return np.minimum(np.maximum(whole(queries) @ whole(vectors).T, -(2**63)), 2**63 - 1)


def thresholds(k: int):
    """Adds to each block of queries its rows' k-th best scores over the longest block, or minus infinity, and the least length needed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                q_ids, q, _, _ = unpacked(row, "q_")
                ids, vectors, _, _ = unpacked(row)
                scores = exact(q, vectors)
                least = np.full(len(q_ids), -np.inf)
                for i in range(len(q_ids)):
                    own = np.asarray(scores[i][ids != q_ids[i]], dtype=float)
                    if len(own) >= k:
                        least[i] = np.partition(own, len(own) - k)[len(own) - k]
                # |q| * |x| must reach the score, within half a unit and rounding; a query of zeros scores zero everywhere.
                lengths = np.sqrt((q**2).sum(1))
                need = np.where(lengths > 0, (least - 0.5) / np.maximum(lengths, 1e-300) * (1 - 1e-9 * np.sign(least)), -np.inf)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["q_block"]], pa.int64()), pa.array([least.tobytes()], pa.binary()), pa.array([float(max(0.0, need.min()))])],
                    names=["q_block", "least", "need"],
                )

    return run


def scorer(k: int):
    """The k best of each query within a block of vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                q_ids, q, q_heads, q_rests = unpacked(row, "q_")
                ids, vectors, heads, rests = unpacked(row)
                least = np.frombuffer(row["least"])
                bound = q_heads @ heads.T + q_rests[:, None] * rests[None, :]
                bound += 0.5 + 1e-9 * np.abs(bound)
                reaches = bound >= least[:, None]
                out: list[tuple[int, int, int]] = []
                some = np.flatnonzero(reaches.any(1))
                used = np.flatnonzero(reaches.any(0))
                scores = exact(q[some], vectors[used])
                for i, q_row in enumerate(some):
                    keep = reaches[q_row][used] & (ids[used] != q_ids[q_row])
                    near = np.flatnonzero(keep)
                    for j in near[best(scores[i][near], ids[used][near], k)]:
                        out.append((int(q_ids[q_row]), int(q_row), int(ids[used][j]), int(scores[i][j])))
                columns = list(zip(*out)) or [[], [], [], []]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["q_block"]] * len(out), pa.int64())] + [pa.array(c, pa.int64()) for c in columns],
                    names=["q_block", "query_id", "q_row", "vec_id", "score"],
                )

    return run


def top_k(vectors: DataFrame, query_modulus: int = 50, k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score: the k best inner products of each row whose vec_id is divisible by query_modulus."""
    spark = vectors.sparkSession
    ship(spark)
    ready = stored(usable(vectors), "topk-vectors")
    facts = ready.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("dim")).first()
    result = "query_id long, rank int, vec_id long, score long"
    if not facts["n"]:
        return spark.createDataFrame([], result)
    n, dim = facts["n"], facts["dim"]
    turn = rotation(ready, dim)
    length = F.expr("aggregate(v, double(0), (s, x) -> s + x * x)")
    by_length = ready.withColumn("length", length).repartitionByRange(max(1, -(-n // (4 * BLOCK))), F.desc("length"), F.col("vec_id"))
    by_length = by_length.sortWithinPartitions(F.desc("length"), "vec_id").select("vec_id", "v")
    numbered = F.monotonically_increasing_id()
    blocks = stored(by_length.mapInArrow(packer(dim, turn, BLOCK), PACKED).withColumn("block", numbered), "topk-blocks")
    asked = ready.where(F.col("vec_id") % query_modulus == 0)
    n_asked = asked.count()
    if not n_asked:
        return spark.createDataFrame([], result)
    asked = asked.repartition(max(1, -(-n_asked // QUERY_BLOCK)))
    asked = stored(asked.mapInArrow(packer(dim, turn, QUERY_BLOCK), PACKED).withColumn("q_block", numbered), "topk-queries")
    asked = asked.select("q_block", *[F.col(c).alias(f"q_{c}") for c in ("n", "ids", "vectors", "heads", "rests")])
    groups = max(1, -(-asked.count() // GROUP))

    lengths = blocks.select("block", "longest")
    longest = lengths.orderBy(F.desc("longest"), "block").first()
    # One block of BLOCK vectors is broadcast.
    seed = blocks.where(F.col("block") == longest["block"]).withColumn("seed", F.pmod("block", F.lit(1)))
    seeds = asked.withColumn("seed", F.pmod("q_block", F.lit(1))).join(F.broadcast(seed), "seed")
    seeds = stored(seeds.mapInArrow(thresholds(k), "q_block long, least binary, need double"), "topk-seeds")

    def bucket(length: Column) -> Column:
        return F.floor(F.log2(length + 1) * BUCKETS)

    needed = seeds.select("q_block", "need", F.explode(F.sequence(bucket(F.col("need")), bucket(F.lit(longest["longest"])))).alias("bucket"))
    pairs = needed.join(lengths.withColumn("bucket", bucket(F.col("longest"))), "bucket").where("longest >= need")
    # Many blocks of queries share a long block of vectors: they are dealt to groups, of which each has its own copy.
    pairs = stored(pairs.select("q_block", "block", F.pmod(F.xxhash64("q_block"), F.lit(groups)).alias("group")), "topk-pairs")
    sent = pairs.join(asked.join(seeds.select("q_block", "least"), "q_block"), "q_block")
    met = blocks.join(pairs.select("block", "group").distinct(), "block")
    found = sent.join(met, ["block", "group"]).mapInArrow(scorer(k), "q_block long, query_id long, q_row long, vec_id long, score long")
    order = Window.partitionBy("q_block", "q_row").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
