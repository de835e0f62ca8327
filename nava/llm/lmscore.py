"""Cross-entropy difference: documents scored by two n-gram models over one vocabulary.

The target model counts the words and bigrams of the documents that `target` marks, the background model those of all other
documents; both are counted over every document. They are matched: one vocabulary (the same words and bigrams), the same
smoothing, and background counts scaled to the target's total. A document's score is the mean over its words of the target loss
less the background loss, so a lower score is nearer the target. Each document is scored without its own counts, which are taken out of the
model that it belongs to: being in the target is not rewarded, only being like its other documents.

Words and bigrams are counted exactly, by 64-bit digests, in tables that grow with the input and stay distributed. Documents lie in
pieces of some PIECE words, a compressed row each. A piece sends each of its distinct n-grams once, however often it comes, packed by shards, which are equal
ranges of the digests and grow in number with the input; a shard adds up its n-grams and sends each piece the sums of the piece's own, in order.

Nulls, ties and edges: a null text is an empty one; a document without words has losses and score 0; where no document or every
document is marked, the empty model is uniform; repeated rows count each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nava.llm.textfeed import shingles, words_of
from nava.session import ship, stored

#: A word that neither model has seen has the probability UNIFORM / 2**UNIGRAMS.
UNIGRAMS = 17
#: The uniform share of a unigram, and the words that a bigram takes from the unigram.
UNIFORM, BACKOFF = 0.1, 2.0
#: Words of a piece of the documents; n-grams of a shard, about.
PIECE = 1_000_000
SHARD = 500_000


def grams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Digests of words, and of bigrams: each word but the first with the word before."""
    words = words_of(text)
    return shingles(words, 1), shingles(words, 2) if len(words) > 1 else np.zeros(0, np.uint64)


def packed(values: np.ndarray) -> bytes:
    """64-bit numbers by byte planes: the planes of small numbers' upper bytes are zeros, which the shuffle compresses."""
    return np.ascontiguousarray(values).view(np.uint8).reshape(-1, 8).T.tobytes()


def unpacked(data: bytes, kind: type) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view(kind).ravel()


def ranked(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values in order, and each value's place among them: a range of values at a time, as sorting all would take several times their memory."""
    where, parts, size = np.empty(len(values), np.int32), [np.zeros(0, np.uint64)], 0
    ranges = (values >> np.uint64(60)).astype(np.uint8)
    for k in range(16):
        rows = np.flatnonzero(ranges == k)
        own, inverse = np.unique(values[rows], return_inverse=True)
        where[rows] = inverse + size
        parts.append(own)
        size += len(own)
    return np.concatenate(parts), where


def pieces(most: int):
    """Pieces: their words of the target and of the background, and their documents as a compressed Arrow stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece, size = TaskContext.get().partitionId() << 32, {True: 0, False: 0}
        held: list[pa.RecordBatch] = []

        def flush() -> pa.RecordBatch:
            nonlocal piece
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, held[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
                for part in held:
                    stream.write_batch(part)
            row = [pa.array([x], pa.int64()) for x in (piece, size[True], size[False])] + [pa.array([sink.getvalue().to_pybytes()], pa.binary())]
            held.clear()
            piece, size[True], size[False] = piece + 1, 0, 0
            return pa.RecordBatch.from_arrays(row, names=["piece", "near", "far", "docs"])

        for batch in batches:
            start = 0
            for i, (text, mark) in enumerate(zip(batch.column(1), batch.column(2).to_pylist())):
                size[mark] += len(words_of(text.as_py()))
                if size[True] + size[False] >= most:
                    held.append(batch.slice(start, i + 1 - start))
                    start = i + 1
                    yield flush()
            if start < batch.num_rows:
                held.append(batch.slice(start))
        if held:
            yield flush()

    return run


def documents(data: bytes) -> Iterator[tuple[int | None, str | None, bool]]:
    """doc_id, text, mark of a piece's documents."""
    for batch in pa.ipc.open_stream(data):
        yield from zip(batch.column(0).to_pylist(), (x.as_py() for x in batch.column(1)), batch.column(2).to_pylist())


def sender(bits: int):
    """Each piece's distinct n-grams by shard, with their target and background counts."""

    def send(piece: int, data: bytes) -> Iterator[pa.RecordBatch]:
        held: dict[bool, list[np.ndarray]] = {True: [], False: []}
        for _, text, mark in documents(data):
            held[mark] += grams(text)
        border = sum(map(len, held[True]))
        values, where = ranked(np.concatenate([np.zeros(0, np.uint64), *held.pop(True), *held.pop(False)]))
        counts = [np.bincount(w, minlength=len(values)) for w in (where[:border], where[border:])]
        shards = (values >> np.uint64(64 - bits)).astype(np.int64)
        starts = np.flatnonzero(np.diff(shards, prepend=-1))
        rows = [(packed(np.diff(values[i:j], prepend=np.uint64(0))), packed(counts[0][i:j]), packed(counts[1][i:j])) for i, j in zip(starts, [*starts[1:], len(values)])]
        if rows:
            columns = [pa.array(c, pa.binary()) for c in zip(*rows)]
            yield pa.RecordBatch.from_arrays([pa.array(shards[starts]), pa.array(np.full(len(rows), piece, np.int64)), *columns], names=["shard", "piece", "grams", "target", "background"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                yield from send(piece, data.as_py())

    return run


def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each shard and piece the sums of the piece's n-grams, from rows in order of shard."""
    current, held = None, []

    def flush() -> Iterator[pa.RecordBatch]:
        if not held:
            return
        own = [np.cumsum(unpacked(r[1], np.uint64), dtype=np.uint64) for r in held]
        values, where = np.unique(np.concatenate(own), return_inverse=True)
        ends = np.cumsum([len(x) for x in own])
        # Sums of counts are exact as doubles below 2**53.
        sums = [np.bincount(where, np.concatenate([unpacked(r[i], np.int64) for r in held]), len(values)).astype(np.int64)[where] for i in (2, 3)]
        columns = [pa.array([packed(c) for c in np.split(x, ends[:-1])], pa.binary()) for x in sums]
        pieces = pa.array([r[0] for r in held], pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(held), current, np.int64)), pieces, *columns], names=["shard", "piece", "target", "background"])
        held.clear()

    for batch in batches:
        for shard, *row in zip(*(c.to_pylist() for c in batch.columns)):
            if shard != current:
                yield from flush()
                current = shard
            held.append(row)
    yield from flush()


def own_counts(where: np.ndarray) -> np.ndarray:
    """How often each entry's value occurs among the entries."""
    _, inverse, counts = np.unique(where, return_inverse=True, return_counts=True)
    return counts[inverse]


def losses(single: np.ndarray, double: np.ndarray, total: int, scale: float) -> np.ndarray:
    """Losses of words after words, from the counts of a document's words and bigrams in a model of total words."""
    single, double = single * scale, double * scale
    share = UNIFORM if total > 0 else 1.0
    p = (1 - share) * single / max(total * scale, 1e-9) + share / (1 << UNIGRAMS)
    if len(double):
        p[1:] = (double + BACKOFF * p[1:]) / (single[:-1] + BACKOFF)
    return -np.log(np.clip(p, 1e-12, 1.0))


def scorer(near: int, far: int):
    """Scores of documents, from rows in order of piece and shard, a piece's documents (without a shard) after its sums."""
    models = (True, near, 1.0), (False, far, near / far if near and far else 1.0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: list[tuple[bytes, bytes]] = []

        def scores(data: bytes) -> pa.RecordBatch:
            docs = [(doc_id, mark, *grams(text)) for doc_id, text, mark in documents(data)]
            sizes = [(doc_id, mark, len(single), len(double)) for doc_id, mark, single, double in docs]
            _, where = ranked(np.concatenate([x for d in docs for x in d[2:]]))
            del docs
            # The sums are in the order of the piece's distinct n-grams.
            tables = [np.concatenate([np.zeros(0, np.int64), *(unpacked(x[k], np.int64) for x in sums)]) for k in (0, 1)]
            rows, at = [], 0
            for doc_id, mark, single, double in sizes:
                middle, end = at + single, at + single + double
                words, pairs = where[at:middle], where[middle:end]
                own = own_counts(words), own_counts(pairs)
                found = []
                for (side, total, scale), table in zip(models, tables):
                    one, two = table[words], table[pairs]
                    if side == mark:
                        one, two, total = one - own[0], two - own[1], total - single
                    found.append(float(losses(one, two, total, scale).mean()) if single else 0.0)
                a, b = found
                rows.append((doc_id, single, a, b, a - b))
                at = end
            arrays = [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64()))]
            return pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_words", "target_loss", "background_loss", "score"])

        for batch in batches:
            _, shards, docs, near, far = batch.columns
            for i, shard in enumerate(shards.to_pylist()):
                if shard is not None:
                    sums.append((near[i].as_py(), far[i].as_py()))
                else:
                    yield scores(docs[i].as_py())
                    sums.clear()

    return run


def score(docs: DataFrame, target: Column, piece: int = PIECE) -> DataFrame:
    """doc_id, n_words, target_loss, background_loss, score."""
    ship(docs.sparkSession)
    marked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(target, F.lit(False)).alias("mark"))
    docs = stored(marked.mapInArrow(pieces(piece), "piece long, near long, far long, docs binary"), "lm-pieces")
    totals = docs.agg(F.sum("near").alias("near"), F.sum("far").alias("far")).first()
    near, far = totals["near"] or 0, totals["far"] or 0
    bits = max(6, (2 * (near + far) // SHARD).bit_length())
    sent = docs.select("piece", "docs").mapInArrow(sender(bits), "shard long, piece long, grams binary, target binary, background binary")
    dealt = sent.repartition("shard").sortWithinPartitions("shard").select("shard", "piece", "grams", "target", "background")
    sums = dealt.mapInArrow(summed, "shard long, piece long, target binary, background binary")
    none = F.lit(None).cast("binary")
    both = sums.select("piece", "shard", none.alias("docs"), "target", "background").unionByName(
        docs.select("piece", F.lit(None).cast("long").alias("shard"), "docs", none.alias("target"), none.alias("background"))
    )
    ordered = both.repartition("piece").sortWithinPartitions("piece", F.col("shard").asc_nulls_last())
    schema = "doc_id long, n_words long, target_loss double, background_loss double, score double"
    return ordered.mapInArrow(scorer(near, far), schema)
