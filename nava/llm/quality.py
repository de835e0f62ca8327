"""Quality classifier: a byte-level convolutional network in numpy.

A text's bytes are embedded; learned filters of WIDTH bytes run over them every STEP bytes; their rectified answers are max-pooled
over chunks of CHUNK bytes that overlap by half and cover the whole text; a small dense layer gives each chunk a logit; and the
mean and the extremes of a text's chunk logits combine into one probability.

Training reads the whole texts of at most TRAIN_DOCS labelled documents of each class (the first by a hash of the id). The filters learn
from at most TRAIN_CHUNKS chunks, drawn by a hash from all chunks of all those texts; the combination learns from the chunk logits of the
whole texts. Texts stay on the executors: chunks and three numbers a text reach the driver. These bounds are parameters; scoring covers every
byte of every text.

Nulls, ties and edges: a null text is an empty one, and both are scored as one chunk of padding; repeated rows score equally; a
labelled id that repeats counts once, with its lowest label and the first of its texts in order; without labels of both classes every score
is 0.5; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nava.session import ship, stored

EMBED, STEP, TAPS, FILTERS, HIDDEN = 4, 4, 4, 24, 16
WIDTH = STEP * TAPS
CHUNK = 512
HALF = CHUNK // 2
TRAIN_DOCS = 1500
TRAIN_CHUNKS = 16_000
EPOCHS = 8
#: Bytes that one pass of the network takes.
PIECE = 1 << 18


def held_out(doc_id: Column) -> Column:
    """Documents whose labels are never learned from."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1


@dataclass
class Network:
    embed: np.ndarray  # 256 x EMBED
    filters: np.ndarray  # STEP * EMBED x TAPS * FILTERS
    bias: np.ndarray
    dense: np.ndarray  # FILTERS x HIDDEN
    dense_bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray
    combine: np.ndarray  # weights of mean, lowest, highest, and one

    def answers(self, data: np.ndarray) -> np.ndarray:
        """Filter answers every STEP bytes; data has WIDTH - STEP bytes more than the answers cover."""
        steps = self.embed[data].reshape(-1, STEP * EMBED) @ self.filters
        n = len(steps) - TAPS + 1
        total = steps[:n, :FILTERS] + self.bias
        for k in range(1, TAPS):
            total += steps[k : k + n, k * FILTERS : (k + 1) * FILTERS]
        return total

    def logits(self, pooled: np.ndarray) -> np.ndarray:
        return np.tanh(np.maximum(pooled, 0) @ self.dense + self.dense_bias) @ self.out + self.out_bias[0]

    def halves(self, data: np.ndarray, skipped: np.ndarray) -> np.ndarray:
        """Each half chunk's strongest answers but for skipped places; data is whole half chunks and WIDTH - STEP bytes more."""
        found = self.answers(data)
        found[skipped] = -1e9
        return found.reshape(-1, HALF // STEP, FILTERS).max(1)

    def score(self, texts: list[bytes]) -> np.ndarray:
        """Probabilities of whole texts."""
        return 1 / (1 + np.exp(-self.features(texts) @ self.combine))

    def features(self, texts: list[bytes]) -> np.ndarray:
        """Mean, lowest and highest chunk logit of whole texts, and one."""
        # Padding ends each text, so the last filter places, which reach into the next text, hold nothing of this one.
        counts = [-(-(len(t) + WIDTH - STEP) // HALF) for t in texts]
        data = b"".join([t.ljust(n * HALF, b"\0") for t, n in zip(texts, counts)]) + bytes(WIDTH - STEP)
        flat = np.frombuffer(data, np.uint8)
        size = PIECE // HALF * HALF
        whole = len(flat) - (WIDTH - STEP)
        ends = np.cumsum(counts)
        crossing = (ends[:, None] * (HALF // STEP) - 1 - np.arange(TAPS - 1)[::-1]).ravel()
        parts = []
        for start in range(0, whole, size):
            stop = min(start + size, whole)
            own = crossing[np.searchsorted(crossing, start // STEP) : np.searchsorted(crossing, stop // STEP)]
            parts.append(self.halves(flat[start : stop + WIDTH - STEP], own - start // STEP))
        halves = np.concatenate(parts)
        # A chunk is two neighbouring halves of one text; a text of one half is a chunk by itself.
        paired = np.maximum(halves, np.concatenate([halves[1:], halves[-1:]]))
        last = ends - 1
        paired[last] = halves[last]
        keep = np.ones(len(paired), bool)
        keep[last[np.array(counts) > 1]] = False
        logits = np.clip(self.logits(paired[keep]), -8, 8)
        starts = np.concatenate([[0], np.cumsum([max(1, n - 1) for n in counts])[:-1]])
        sizes = np.diff(np.concatenate([starts, [len(logits)]]))
        return np.stack(
            [np.add.reduceat(logits, starts) / sizes, np.minimum.reduceat(logits, starts), np.maximum.reduceat(logits, starts), np.ones(len(texts))], 1
        )


def initial(seed: int = 7) -> Network:
    random = np.random.default_rng(seed)
    normal = lambda *shape, scale: (random.standard_normal(shape) * scale).astype(np.float32)
    return Network(
        normal(256, EMBED, scale=0.5),
        normal(STEP * EMBED, TAPS * FILTERS, scale=WIDTH**-0.5),
        np.zeros(FILTERS, np.float32),
        normal(FILTERS, HIDDEN, scale=FILTERS**-0.5),
        np.zeros(HIDDEN, np.float32),
        normal(HIDDEN, scale=HIDDEN**-0.5),
        np.zeros(1, np.float32),
        np.array([1.0, 0, 0, 0]),
    )


#: Rejecting a good text counts so many times as much as keeping a poor one, with classes otherwise balanced.
CARE = 2.0


def class_weights(labels: np.ndarray) -> np.ndarray:
    return np.where(labels == 1, CARE * 0.5 / max(labels.mean(), 1e-6), 0.5 / max(1 - labels.mean(), 1e-6))


def learn_chunks(net: Network, chunks: np.ndarray, labels: np.ndarray, epochs: int, seed: int = 11, batch: int = 64) -> None:
    """Adam on the cross-entropy of chunks; chunks has CHUNK + WIDTH - STEP bytes a row."""
    random = np.random.default_rng(seed)
    names = ("embed", "filters", "bias", "dense", "dense_bias", "out", "out_bias")
    moments = {k: (np.zeros_like(getattr(net, k)), np.zeros_like(getattr(net, k))) for k in names}
    weight = class_weights(labels).astype(np.float32)
    n_steps, at = CHUNK // STEP, 0
    total = epochs * -(-len(chunks) // batch)
    for _ in range(epochs):
        order = random.permutation(len(chunks))
        for start in range(0, len(order), batch):
            own = order[start : start + batch]
            data, b = chunks[own], len(own)
            steps = net.embed[data].reshape(b, -1, STEP * EMBED)
            product = steps @ net.filters
            found = product[:, :n_steps, :FILTERS] + net.bias
            for k in range(1, TAPS):
                found = found + product[:, k : k + n_steps, k * FILTERS : (k + 1) * FILTERS]
            best = found.argmax(1)
            pooled = np.maximum(np.take_along_axis(found, best[:, None], 1)[:, 0], 0)
            hidden = np.tanh(pooled @ net.dense + net.dense_bias)
            logit = hidden @ net.out + net.out_bias[0]
            error = ((1 / (1 + np.exp(-logit)) - labels[own]) * weight[own] / b).astype(np.float32)
            grads = {"out": hidden.T @ error, "out_bias": np.array([error.sum()], np.float32)}
            back = error[:, None] * net.out * (1 - hidden**2)
            grads["dense"], grads["dense_bias"] = pooled.T @ back, back.sum(0)
            back = (back @ net.dense.T) * (pooled > 0)
            grads["bias"] = back.sum(0)
            filters, embed = np.zeros_like(net.filters), np.zeros_like(net.embed)
            rows = np.arange(b)[:, None]
            for k in range(TAPS):
                piece = steps[rows, best + k]  # b x FILTERS x STEP * EMBED
                filters[:, k * FILTERS : (k + 1) * FILTERS] = np.einsum("bf,bfd->df", back, piece)
                to_bytes = (back[..., None] * net.filters[:, k * FILTERS : (k + 1) * FILTERS].T).reshape(-1, EMBED)
                places = data[rows[..., None], (best[..., None] + k) * STEP + np.arange(STEP)].reshape(-1)
                for e in range(EMBED):
                    embed[:, e] += np.bincount(places, to_bytes[:, e], 256)
            grads["filters"], grads["embed"] = filters, embed
            at += 1
            rate = 0.004 * (1 - at / (total + 1))
            for k, g in grads.items():
                m, v = moments[k]
                m *= 0.9
                m += 0.1 * g
                v *= 0.99
                v += 0.01 * g * g
                getattr(net, k)[...] -= rate * (m / (1 - 0.9**at)) / (np.sqrt(v / (1 - 0.99**at)) + 1e-8)


def learn_combination(net: Network, x: np.ndarray, labels: np.ndarray) -> None:
    """Logistic regression of a text's label on its features."""
    first = np.array([1.0, 0, 0, 0])
    w = first
    weight = class_weights(labels)
    for _ in range(30):
        p = 1 / (1 + np.exp(np.clip(-x @ w, -60, 60)))
        gradient = x.T @ (weight * (p - labels)) + 0.5 * (w - first)
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x + 0.5 * np.eye(4)
        w = w - np.linalg.solve(curve, gradient)
    net.combine = w


SIZE = CHUNK + WIDTH - STEP


def cut(key: int, text: bytes) -> tuple[list[bytes], np.ndarray]:
    """All training chunks of a whole text, and for each a place in the order that all texts' chunks are drawn by.

    A text's chunks are shuffled, and all texts' first ones come before any second one, so long texts don't crowd out short ones.
    """
    random = np.random.default_rng([5, key % 2**32, zlib.crc32(text)])
    chunks = []
    for start in range(0, max(1, len(text) - HALF), HALF):
        piece = text[start : start + SIZE]
        if len(piece) >= 32:
            chunks.append(piece.ljust(SIZE, b"\0"))
    turns = random.permutation(len(chunks)).tolist()
    # Whole short texts are rare in a sample and look poor in variety, so each text also gives two short pieces, in its first turns.
    for turn, length in enumerate(random.integers(24, HALF, 2)):
        start = text.find(b" ", int(random.integers(0, max(1, len(text) - int(length))))) + 1
        if len(text) > 2 * length and start:
            chunks.append(text[start : start + int(length)].rpartition(b" ")[0].ljust(SIZE, b"\0"))
            turns.append(turn)
    return chunks, (np.array(turns, np.int64) << 40) + random.integers(0, 1 << 40, len(chunks))


def learn_filters(chunks: list[bytes], marks: np.ndarray, epochs: int) -> Network | None:
    """A network from chunks in their drawn order, or None without both classes."""
    if len(set(marks.tolist())) < 2:
        return None
    net = initial()
    data = np.frombuffer(b"".join(chunks), np.uint8).reshape(-1, SIZE)
    # Few chunks are seen more often, up to a fixed number of steps.
    learn_chunks(net, data, marks.astype(np.float32), max(epochs, min(60, epochs * TRAIN_CHUNKS // (4 * len(data)))))
    return net


def train(texts: list[bytes], labels: np.ndarray, epochs: int = EPOCHS) -> Network | None:
    """A network from texts in memory."""
    drawn = [(place, chunk, label) for key, (text, label) in enumerate(zip(texts, labels)) for chunk, place in zip(*cut(key, text))]
    drawn = sorted(drawn)[:TRAIN_CHUNKS]
    net = learn_filters([x[1] for x in drawn], np.array([x[2] for x in drawn]), epochs)
    if net is not None:
        learn_combination(net, net.features(texts), labels)
    return net


def sample(docs: DataFrame, labels: DataFrame, most: int = TRAIN_DOCS) -> DataFrame:
    """doc_id, quality, text of labelled documents, at most `most` of each class, written out."""
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.min("quality").alias("quality"))
    order = F.xxhash64("doc_id")
    picked = [known.where(F.col("quality") == k).orderBy(order, "doc_id").limit(most) for k in (0, 1)]
    picked = picked[0].unionByName(picked[1])
    texts = (
        docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
        .join(F.broadcast(picked), "doc_id")  # 2 * most rows at most
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("double").alias("quality"))
        .agg(F.min("text").alias("text"))
    )
    return stored(texts, "quality-sample")


def learn(texts: DataFrame, epochs: int = EPOCHS) -> Network | None:
    """A network from a sample; whole texts are read where they lie."""
    ship(texts.sparkSession)

    def cutter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, mark, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                chunks, places = cut(key, text.as_py().encode("utf-8", "surrogatepass"))
                if chunks:
                    yield pa.RecordBatch.from_arrays([pa.array(places, pa.int64()), pa.array(chunks, pa.binary()), pa.array([mark] * len(chunks))], names=["place", "chunk", "mark"])

    drawn = texts.mapInArrow(cutter, "place long, chunk binary, mark double").orderBy("place", "chunk", "mark").limit(TRAIN_CHUNKS).toArrow()
    net = learn_filters(drawn.column("chunk").to_pylist(), drawn.column("mark").to_numpy(), epochs)
    if net is None:
        return None
    del drawn

    def describer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = net.features([t.as_py().encode("utf-8", "surrogatepass") for t in batch.column(2)])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *map(pa.array, found.T[:3])], names=["doc_id", "quality", "mean", "least", "most"])

    found = texts.mapInArrow(describer, "doc_id long, quality double, mean double, least double, most double").orderBy("doc_id").toArrow()
    labels = found.column("quality").to_numpy()
    learn_combination(net, np.stack([*(found.column(c).to_numpy() for c in ("mean", "least", "most")), np.ones(len(labels))], 1), labels)
    return net


#: The score's column, of a name that no table has.
SCORE = "__nava_score"


def scored(docs: DataFrame, net: Network | None, columns: list[str]) -> DataFrame:
    """The named columns of docs and SCORE, from whole texts."""
    ship(docs.sparkSession)
    kept = docs.select(*columns, F.col("text").alias("__nava_text"))
    schema = docs.select(*columns).schema.add(SCORE, "double")
    names = [f.name for f in schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                texts = [(t.as_py() or "").encode("utf-8", "surrogatepass") for t in part.column(part.num_columns - 1)]
                scores = np.full(len(texts), 0.5) if net is None else net.score(texts)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(scores, pa.float64())], names=names)

    return kept.mapInArrow(run, schema)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    net = learn(sample(docs, labels))
    return scored(docs, net, ["doc_id"]).withColumnRenamed(SCORE, "score").select(
        "doc_id",
        F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
