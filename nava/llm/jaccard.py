"""Self-join of documents on n-gram Jaccard similarity: a size-aware heavy-light join.

A document's set holds its distinct shingles of N words. Documents with equal sets are one class, and the join is between classes.

Small sets (light side) enumerate their subsets of the fixed sizes that a link needs: two small sets link exactly if they share
such a subset. Large sets are found by scanning inverted lists: under one order of all shingles, two linked sets of sizes n and m share
one of their first n - ceil(T * n) + 1 and m - ceil(T * m) + 1 shingles, so only these are listed. The boundary between small and
large is the largest size whose subsets cost less than its lists would.

Shingles that repeat much come last in the order, so passages that many documents share are listed only by documents of hardly
anything else. The order is a matter of speed alone: any order gives the same links. Lists of up to WINDOW classes give all their
pairs (of sizes and places that allow a link). Longer lists first give neighbouring pairs; when links found so far have been
merged, they give the pairs between different components, in blocks. So copies of one text or near copies in thousands never
become all pairs, and no pair that could join two components is left out.

Pairs are verified on whole texts, those with an upper bound below the threshold excepted: a sketch counts a set's shingles by
bucket, and the sum of the smaller counts bounds the overlap.

Nulls, ties and edges: a null or empty text, or one without words, has an empty set, links with nothing and is its own component;
rows that repeat a text are in its class; a repeated doc_id takes part with each of its rows; rows without an id take part too, and
a component of only such rows has none; an empty table gives an empty result; other columns are ignored. Shingles and classes are told apart
by 64-bit digests, those of words cryptographic.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nava.llm.components import components, lookup
from nava.llm.textfeed import mixed, shingles, words_of
from nava.session import ship, stored

N = 5
#: The threshold as a fraction.
UP, DOWN = 3, 4
#: Lists of more classes are resolved by components; rows of a block of such a list.
WINDOW = 16
BLOCK = 2048
#: A shingle that repeats so often comes late in the order, at most HOT_KEPT of them: a matter of speed, not of results.
HOT = 24
HOT_KEPT = 200_000
#: Work of verifying a candidate in listed rows, for the boundary between small and large sets; the largest boundary.
VERIFY = 8
SMALLEST_LARGE = 13
#: Shingles whose repeats are counted at once.
PIECE = 2_000_000
#: Sets or pairs that a task remembers, to give them once; more may come again, which costs work and changes nothing.
REMEMBERED = 100_000
#: Ids that may be broadcast; more are joined by shuffle.
BROADCAST_IDS = 1_000_000
BUCKETS, FULL = 128, 255


def needed(n: int, m: int) -> int:
    """Overlap that a link of sizes n and m needs: DOWN * o >= UP * (n + m - o)."""
    return -(-UP * (n + m) // (UP + DOWN))


def partners(n: int) -> range:
    """Sizes that can link with size n."""
    return range(-(-UP * n // DOWN), DOWN * n // UP + 1)


def listed(n: int) -> int:
    """Shingles that a set of size n lists."""
    return n - -(-UP * n // DOWN) + 1


def subset_sizes(n: int) -> list[int]:
    return sorted({needed(n, m) for m in partners(n) if m > 0 and needed(n, m) <= min(n, m)})


def boundary(mean_list: float) -> int:
    """The largest size that enumerates subsets: their number against the listed shingles with the pairs of their lists."""
    best = 0
    for n in range(1, SMALLEST_LARGE):
        if sum(comb(n, c) for c in subset_sizes(n)) > listed(n) * (1 + VERIFY * mean_list):
            break
        best = n
    return best


def shingle_set(text: str | None) -> np.ndarray:
    return np.unique(shingles(words_of(text), N))


def set_key(own: np.ndarray) -> int:
    """A signed 64-bit digest of a set."""
    total = (int(own.sum(dtype=np.uint64)) + len(own) * 0x9E3779B97F4A7C15) % 2**64
    return int(signed(mixed(np.array([total], np.uint64)))[0]) if len(own) else 0


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each document (doc_id, row, n, k, and a sketch the first time a piece has this set), and rows (token, times) for shingles
    that repeat within a piece of the input."""
    names = ["doc_id", "row", "n", "k", "token", "times", "sketch"]
    seen: set[int] = set()
    held: list[np.ndarray] = []
    size = 0

    def repeats() -> pa.RecordBatch:
        nonlocal size
        values, counts = np.unique(np.concatenate(held), return_counts=True)
        held.clear()
        seen.clear()
        size = 0
        values, counts = signed(values[counts > 1]), counts[counts > 1]
        none = pa.nulls(len(values), pa.int64())
        drawn = pa.nulls(len(values), pa.binary())
        return pa.RecordBatch.from_arrays([none, none, none, none, pa.array(values), pa.array(counts.astype(np.int64)), drawn], names=names)

    for batch in batches:
        ids, sizes, keys, drawn = batch.column(0), [], [], []
        for text in batch.column(1):
            own = shingle_set(text.as_py())
            key = set_key(own)
            sizes.append(len(own))
            keys.append(key)
            drawn.append(None)
            if len(own) and key not in seen:
                drawn[-1] = sketch(own)
                seen.add(key)
                held.append(own)
                size += len(own)
                if size >= PIECE:
                    yield repeats()
        none = pa.nulls(len(sizes), pa.int64())
        columns = [ids.cast(pa.int64()), batch.column(2), pa.array(sizes, pa.int64()), pa.array(keys, pa.int64()), none, none, pa.array(drawn, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, names=names)
    if held:
        yield repeats()


def lister(hot: np.ndarray, order: np.ndarray, small: int):
    """Rows (token, k, n, pos, prev) of what each set lists; subsets of c shingles have pos -c. hot is sorted, order its counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        parts: list[tuple[np.ndarray, ...]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal size
            columns = [np.concatenate(c) for c in zip(*parts)]
            parts.clear()
            size = 0
            return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["token", "k", "n", "pos", "prev"])

        def add(tokens: np.ndarray, key: int, n: int, pos: np.ndarray, prev: np.ndarray) -> None:
            nonlocal size
            rows = len(tokens)
            parts.append((signed(tokens), np.full(rows, key, np.int64), np.full(rows, n, np.int32), pos.astype(np.int32), prev.astype(np.int32)))
            size += rows

        for batch in batches:
            for text in batch.column(1):
                own = shingle_set(text.as_py())
                n, key = len(own), set_key(own)
                if not n or key in seen:
                    continue
                if len(seen) < REMEMBERED:
                    seen.add(key)
                if n <= small:
                    for c in subset_sizes(n):
                        chosen = [own[list(i)].sum(dtype=np.uint64) for i in combinations(range(n), c)]
                        tokens = mixed(np.array(chosen, np.uint64) ^ np.uint64(0xA5A5A5A5 + c))
                        add(tokens, key, n, np.full(len(tokens), -c), np.zeros(len(tokens), np.int64))
                if n > small or partners(n)[-1] > small:
                    if len(hot):
                        at = np.minimum(np.searchsorted(hot, own), len(hot) - 1)
                        is_hot = hot[at] == own
                        if is_hot.any():
                            late = own[is_hot]
                            own = np.concatenate([own[~is_hot], late[np.lexsort((late, order[at[is_hot]]))]])
                    count = listed(n)
                    prev = np.concatenate([[0], (signed(own[: count - 1]) & 0x7FFFFFFF) + 1]) if count > 1 else np.zeros(1)
                    add(own[:count], key, n, np.arange(count), prev)
                if size >= 200_000:
                    yield flush()
        if parts:
            yield flush()

    return run


def needed_of(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    return -(-UP * (n + m) // (UP + DOWN))


def allowed(n: np.ndarray, m: np.ndarray, pos_n: np.ndarray, pos_m: np.ndarray, prev_n: np.ndarray, prev_m: np.ndarray) -> np.ndarray:
    """Pairs that their sizes and the places of a shared shingle let link; n <= m.

    Equal shingles before the shared one are shared too, and the pair comes up at the first of these.
    """
    o = needed_of(n, m)
    return (o <= n) & (pos_n <= n - o) & (pos_m <= m - o) & ((prev_n != prev_m) | (prev_n == 0))


def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reads lists in order of (token, n, k). kind 0: candidate a, b; kind 1: link a, b; kind 2: a row of a long list.

    Rows before a batch's last complete list wait for the next batch; of a long list only the last WINDOW classes wait.
    """
    names = ["kind", "token", "a", "b", "n", "pos", "prev"]
    carry: list[np.ndarray] | None = None
    carried_long = None  # token of a long list of which rows were already passed on
    hub: tuple[int, int, int] | None = None  # token, k, n of the smallest set of a subset's list
    pairs: set[tuple[int, int]] = set()

    def out(kind: int, token, a, b, n, pos, prev) -> pa.RecordBatch:
        rows = len(a)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(rows, kind, np.int32)), pa.array(np.asarray(token, np.int64)), pa.array(np.asarray(a, np.int64)), pa.array(np.asarray(b, np.int64)),
             pa.array(np.asarray(n, np.int32)), pa.array(np.asarray(pos, np.int32)), pa.array(np.asarray(prev, np.int32))], names=names,
        )

    def fresh(a: np.ndarray, b: np.ndarray) -> tuple[list[int], list[int]]:
        """Candidates that this task hasn't given yet, as far as it remembers."""
        if len(pairs) > REMEMBERED:
            pairs.clear()
        new = dict.fromkeys(zip(a.tolist(), b.tolist()))
        kept = [p for p in new if p not in pairs]
        pairs.update(kept)
        return [p[0] for p in kept], [p[1] for p in kept]

    def lists(columns: list[np.ndarray], last: bool) -> Iterator[pa.RecordBatch]:
        nonlocal carry, carried_long, hub
        token, k, n, pos, prev = columns
        starts = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
        lengths = np.diff(np.concatenate([starts, [len(token)]]))
        length = np.repeat(lengths, lengths)
        # Lists of one class that are complete have nothing to give.
        old = carry_size if carried_long is not None and len(token) and token[0] == carried_long else 0
        subset = pos < 0
        if subset.any():
            # All that link by a shared subset link with its smallest set.
            first = np.repeat(starts, lengths)
            rows = np.flatnonzero(subset)
            hub_k, hub_n = k[first[rows]].copy(), n[first[rows]].copy()
            if hub is not None:
                own = token[rows] == hub[0]
                hub_k[own], hub_n[own] = hub[1], hub[2]
            good = (needed_of(hub_n, n[rows]) <= -pos[rows]) & (k[rows] != hub_k)
            if good.any():
                a, b = fresh(hub_k[good], k[rows][good])
                yield out(1, np.zeros(len(a)), a, b, np.zeros(len(a)), np.zeros(len(a)), np.zeros(len(a)))
            tail = rows[-1]
            if tail == len(token) - 1 and (hub is None or hub[0] != token[tail]):
                f = first[tail]
                hub = (int(token[f]), int(k[f]), int(n[f]))
        for d in range(1, min(WINDOW, len(token))):
            i = np.flatnonzero((token[d:] == token[:-d]) & ~subset[d:])
            i = i[i + d >= old]
            if not len(i):
                break
            j = i + d
            i = i[good] if (good := allowed(n[i], n[j], pos[i], pos[j], prev[i], prev[j])).any() else i[:0]
            if len(i):
                j = i + d
                a, b = fresh(np.minimum(k[i], k[j]), np.maximum(k[i], k[j]))
                if a:
                    yield out(0, np.zeros(len(a)), a, b, np.zeros(len(a)), np.zeros(len(a)), np.zeros(len(a)))
        long = (length > WINDOW) & ~subset
        if carried_long is not None:
            long |= (token == carried_long) & ~subset
        long[:old] = False
        if long.any():
            yield out(2, token[long], k[long], np.zeros(long.sum()), n[long], pos[long], prev[long])

    carry_size = 0
    for batch in batches:
        columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if not len(columns[0]):
            continue
        if carry is not None:
            columns = [np.concatenate([c, x]) for c, x in zip(carry, columns)]
        # Copies in other tasks repeat a class in a list; what is counted and carried below are classes.
        token, k = columns[:2]
        same = np.zeros(len(token), bool)
        same[1:] = (token[1:] == token[:-1]) & (k[1:] == k[:-1])
        if same.any():
            columns = [c[~same] for c in columns]
        token = columns[0]
        end = int(np.searchsorted(token, token[-1]))  # tokens are in order, so the last list begins here
        open_rows = len(token) - end
        if open_rows <= 4 * WINDOW and end:
            yield from lists([c[:end] for c in columns], False)
            carry, carry_size, carried_long, = [c[end:] for c in columns], 0, None
        elif open_rows > 4 * WINDOW:
            yield from lists(columns, False)
            carry = [c[-WINDOW:] for c in columns]
            carry_size, carried_long = WINDOW, int(token[-1])
        else:
            carry = columns
    if carry is not None:
        yield from lists(carry, True)


def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Candidates between components within each block pair of a long list, rows in order of (token, left, right)."""
    held: list[list[np.ndarray]] = []
    given: set[tuple[int, int]] = set()

    def pairs(columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        _, left, right, block, k, n, pos, prev, component = columns
        order = np.lexsort((k, n))
        block, k, n, pos, prev, component = (c[order] for c in (block, k, n, pos, prev, component))
        cross = left[0] != right[0]
        if (component == component[0]).all():
            return
        for i in range(len(k) - 1):
            upto = int(np.searchsorted(n, DOWN * int(n[i]) // UP, side="right"))
            j = np.arange(i + 1, upto)
            if cross:
                j = j[block[j] != block[i]]
            j = j[component[j] != component[i]]
            j = j[k[j] != k[i]]
            if len(j):
                j = j[allowed(np.full(len(j), n[i]), n[j], np.full(len(j), pos[i]), pos[j], np.full(len(j), prev[i]), prev[j])]
            new = [p for p in zip(np.minimum(k[i], k[j]).tolist(), np.maximum(k[i], k[j]).tolist()) if p not in given]
            if new:
                if len(given) > REMEMBERED:
                    given.clear()
                given.update(new)
                a, b = zip(*new)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    for batch in batches:
        columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if not len(columns[0]):
            continue
        if held:
            columns = [np.concatenate([h, c]) for h, c in zip(held, columns)]
        change = np.flatnonzero((np.diff(columns[0]) != 0) | (np.diff(columns[1]) != 0) | (np.diff(columns[2]) != 0)) + 1
        bounds = [0, *change.tolist()]
        for s, t in zip(bounds, bounds[1:]):
            yield from pairs([c[s:t] for c in columns])
        held = [c[bounds[-1] :] for c in columns]
    if held:
        yield from pairs(held)


def sketch(own: np.ndarray) -> bytes:
    """A set's shingles by bucket, two of them in a bucket at most on average; a bucket of FULL or more says nothing."""
    buckets = max(BUCKETS, 1 << (len(own) // 2 - 1).bit_length())
    return np.minimum(np.bincount((own >> np.uint64(24)).astype(np.int64) & (buckets - 1), minlength=buckets), FULL).astype(np.uint8).tobytes()


def may_link(left: bytes, right: bytes, o: int) -> bool:
    """Whether two sketches allow an overlap of o. The larger one is folded to the smaller's buckets: both are powers of two."""
    x, y = np.frombuffer(left, np.uint8), np.frombuffer(right, np.uint8)
    if x.max() == FULL or y.max() == FULL:
        return True
    if len(x) > len(y):
        x, y = y, x
    if len(y) > len(x):
        return bool(np.minimum(x, y.reshape(-1, len(x)).sum(0, dtype=np.int64)).sum() >= o)
    return bool(np.minimum(x, y).sum(dtype=np.int64) >= o)


def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose sketches allow a link."""
    for batch in batches:
        *pair, n, m, left, right = batch.columns
        o = needed_of(n.to_numpy(), m.to_numpy()).tolist()
        keep = pa.array([may_link(x.as_py(), y.as_py(), z) for x, y, z in zip(left, right, o)], pa.bool_())
        yield pa.RecordBatch.from_arrays([c.filter(keep) for c in pair], names=["a", "b", "ca", "cb"])


def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """k, the key of the text's own set, text."""
    for batch in batches:
        own = [set_key(shingle_set(t.as_py())) for t in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own, pa.int64()), batch.column(1)], names=["k", "own", "text"])


def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Components of the pairs whose whole texts link; neighbouring rows share their first text."""
    last: tuple[int, np.ndarray] | None = None
    for batch in batches:
        keep = []
        for a, left, right in zip(batch.column(0).to_pylist(), batch.column(3), batch.column(4)):
            if last is None or last[0] != a:
                last = a, shingle_set(left.as_py())
            own = shingle_set(right.as_py())
            o = len(np.intersect1d(last[1], own, assume_unique=True))
            keep.append(DOWN * o >= UP * (len(last[1]) + len(own) - o))
        mask = pa.array(keep, pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column(1).filter(mask), batch.column(2).filter(mask)], names=["a", "b"])


class Join:
    """The steps of one join; each leaves a table in the shared folder."""

    def __init__(self, docs: DataFrame, key: Column | None = None):
        self.spark = docs.sparkSession
        ship(self.spark)
        row = F.lit(None) if key is None else key
        described = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", row.cast("long").alias("row"))
        self.docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        schema = "doc_id long, row long, n long, k long, token long, times long, sketch binary"
        described = stored(described.mapInArrow(describe, schema), "jaccard-described")
        self.described = described.where("token is null").select("doc_id", "row", "n", "k")
        drawn = described.where("token is null and n > 0").groupBy("k").agg(
            F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("sketch", ignorenulls=True).alias("sketch"), F.count("*").alias("rows")
        )
        self.classes = stored(drawn, "jaccard-classes")
        self.repeated = not self.described.groupBy("doc_id").count().where("count > 1 and doc_id is not null").isEmpty()
        repeats = described.where("token is not null").groupBy("token").agg(F.sum("times").alias("times"))
        # At most HOT_KEPT rows reach the driver.
        hot = repeats.where(F.col("times") >= HOT).orderBy(F.desc("times"), "token").limit(HOT_KEPT).toArrow()
        tokens = hot["token"].to_numpy().astype(np.int64).view(np.uint64)
        order = np.argsort(tokens)
        tokens, times = tokens[order], hot["times"].to_numpy().astype(np.int64)[order]
        facts = described.agg(
            F.sum("n").alias("n"), F.sum("times").alias("times"), F.count_if(F.expr("token is null and n > 0")).alias("rows"), F.count_if(F.expr("n > 0 and doc_id is null")).alias("nameless")
        ).first()
        self.rows, self.nameless = facts["rows"], facts["nameless"]
        self.small = boundary((facts["times"] or 0) / max(1, facts["n"] or 0))
        rows = self.docs.mapInArrow(lister(tokens, times, self.small), "token long, k long, n int, pos int, prev int")
        lists = rows.repartition("token").sortWithinPartitions("token", "n", "k")
        self.found = stored(lists.mapInArrow(scan, "kind int, token long, a long, b long, n int, pos int, prev int"), "jaccard-found")
        #: Component of each class that a link was found of, by the steps so far.
        self.labels: DataFrame | None = None

    def texts_of(self, keys: DataFrame) -> DataFrame:
        """k, text of one document of each class."""
        reps = stored(self.classes.select("k", "doc_id").join(keys, "k", "left_semi"), "jaccard-reps")
        chosen = F.broadcast(reps) if reps.count() <= BROADCAST_IDS else reps
        texts = self.docs.join(chosen, "doc_id").select("k", "text")
        by_key = "k long, own long, text string"
        if self.repeated:
            # A repeated doc_id may bring the texts of other classes.
            texts = texts.mapInArrow(keyed, by_key).where("k = own").select("k", "text").dropDuplicates(["k"])
        if self.nameless:
            # Classes of which no row has an id are found by their key.
            own = self.docs.where("doc_id is null").select(F.lit(0).cast("long").alias("k"), "text").mapInArrow(keyed, by_key)
            wanted = reps.where("doc_id is null").select("k")
            texts = texts.unionByName(own.select(F.col("own").alias("k"), "text").join(wanted, "k", "left_semi").dropDuplicates(["k"]))
        return texts

    def named(self, pairs: DataFrame) -> DataFrame:
        """Pairs with the components ca, cb of their sides; those within one component are dropped."""
        if self.labels is None:
            return pairs.select("a", "b", F.col("a").alias("ca"), F.col("b").alias("cb"))
        left = self.labels.select(F.col("node").alias("a"), F.col("component").alias("ca"))
        right = self.labels.select(F.col("node").alias("b"), F.col("component").alias("cb"))
        joined = pairs.join(left, "a", "left").join(right, "b", "left")
        return joined.select("a", "b", F.coalesce("ca", "a").alias("ca"), F.coalesce("cb", "b").alias("cb")).where("ca <> cb")

    def merge(self, links: DataFrame) -> None:
        """Adds links between components: only these are contracted, and the labels so far follow their component."""
        more = components(links)
        if self.labels is None:
            self.labels = stored(more, "jaccard-labels")
            return
        more = stored(more, "jaccard-merged")
        if more.isEmpty():
            return
        moved = more.select(F.col("node").alias("component"), F.col("component").alias("now"))
        if more.count() <= BROADCAST_IDS:
            moved = F.broadcast(moved)
        known = self.labels.join(moved, "component", "left").select("node", F.coalesce("now", "component").alias("component"))
        self.labels = stored(known.unionByName(more.join(self.labels, "node", "left_anti")), "jaccard-labels")

    def verify(self, pairs: DataFrame) -> DataFrame:
        """The components a, b of the pairs (a, b, ca, cb) that link."""
        s = self.classes.select(F.col("k").alias("a"), "n", F.col("sketch").alias("left"))
        t = self.classes.select(F.col("k").alias("b"), F.col("n").alias("m"), F.col("sketch").alias("right"))
        likely = pairs.join(s, "a").join(t, "b").select("a", "b", "ca", "cb", "n", "m", "left", "right")
        likely = stored(likely.mapInArrow(bounded, "a long, b long, ca long, cb long"), "jaccard-likely")
        keys = likely.select(F.explode(F.array("a", "b")).alias("k")).distinct()
        texts = stored(self.texts_of(keys), "jaccard-texts")
        left = texts.select(F.col("k").alias("a"), F.col("text").alias("left"))
        right = texts.select(F.col("k").alias("b"), F.col("text").alias("right"))
        both = likely.join(right, "b").join(left, "a").select("a", "ca", "cb", "left", "right")
        return stored(both.mapInArrow(verified, "a long, b long"), "jaccard-links")

    def run(self) -> DataFrame:
        pairs = self.found.where("kind = 0").groupBy("a", "b").agg(F.count("*").alias("times"))
        pairs = stored(pairs, "jaccard-pairs")
        # The likeliest partner of each class first: copies merge, and most other pairs then lie within a component.
        best = pairs.groupBy("b").agg(F.max_by("a", F.struct("times", "a")).alias("a")).select("a", "b")
        subsets = self.found.where("kind = 1").select("a", "b").distinct()
        self.merge(self.verify(self.named(best)).unionByName(subsets))
        self.merge(self.verify(self.named(pairs.select("a", "b")).join(best, ["a", "b"], "left_anti")))
        long = self.found.where("kind = 2")
        if not long.isEmpty():
            self.merge(self.verify(self.long_pairs(long, pairs)))
        return self.labels

    def long_pairs(self, long: DataFrame, pairs: DataFrame) -> DataFrame:
        """Candidates between components of the long lists, each list in block pairs of at most 2 * BLOCK rows."""
        rows = long.select("token", F.col("a").alias("k"), "n", "pos", "prev").distinct()
        names = self.labels.select(F.col("node").alias("k"), "component")
        rows = stored(rows.join(names, "k", "left").withColumn("component", F.coalesce("component", "k")), "jaccard-long")
        facts = rows.groupBy("token").agg(F.count("*").alias("rows"), F.min("component").alias("least"), F.max("component").alias("most"))
        facts = facts.where("least <> most").select("token", "rows", F.ceil(F.col("rows") / BLOCK).cast("int").alias("blocks"))
        # A list of much of the rows meets its number of blocks where it lies.
        rows = lookup(rows, stored(facts, "jaccard-open"), "token", "rows", rows.count())
        rows = rows.withColumn("block", F.pmod(F.xxhash64("k"), F.col("blocks")).cast("int"))
        rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        rows = rows.select(
            "token", F.least("block", "other").alias("left"), F.greatest("block", "other").alias("right"), "block", "k", "n", "pos", "prev", "component"
        )
        rows = rows.repartition("token", "left", "right").sortWithinPartitions("token", "left", "right")
        found = rows.mapInArrow(across, "a long, b long").distinct()
        return stored(self.named(found.join(pairs.select("a", "b"), ["a", "b"], "left_anti")), "jaccard-across")


def classes(work: Join) -> DataFrame:
    """k, rows, component (its smallest class), component_id of every class."""
    labels = work.run().select(F.col("node").alias("k"), "component")
    sets = work.classes.select("k", "doc_id", "rows").join(labels, "k", "left").withColumn("component", F.coalesce("component", "k"))
    sets = stored(sets, "jaccard-labelled")
    least = stored(sets.groupBy("component").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("classes")), "jaccard-least")
    named = lookup(sets.drop("doc_id"), least, "component", "classes", sets.count())
    return stored(named.select("k", "rows", "component", "component_id"), "jaccard-named")


def join(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id: the smallest doc_id reachable by links."""
    work = Join(docs)
    # By class first, so copies are one row; then the rows of a class look up what holds for all of it.
    found = lookup(work.described.where("n > 0"), classes(work).drop("component"), "k", "rows", work.rows)
    alone = work.described.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return found.select("doc_id", F.col("n").alias("n_shingles"), "component_id").unionByName(alone)


def representatives(docs: DataFrame, key: Column) -> DataFrame:
    """key of one row of each component that has words: its smallest doc_id, null last, then its smallest key."""
    work = Join(docs, key)
    found = lookup(work.described.where("n > 0"), classes(work).drop("component_id"), "k", "rows", work.rows)
    first = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "row")
    return found.groupBy("component").agg(F.min(first).alias("first")).select(F.col("first.row").alias("key"))
