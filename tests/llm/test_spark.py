"""Operators on small tables, held against brute force; nulls, empty tables, repeats and clashing columns."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from nava.llm import bpe, components, gif, htmltext, jaccard, licenses, lmscore, mixing, quality, tokencount, topk

RNG = random.Random(11)
WORDS = ["".join(RNG.choices("etaoins", k=RNG.randrange(1, 6))) for _ in range(300)]
TEXTS = [" ".join(RNG.choices(WORDS, k=RNG.choice([1, 4, 7, 30, 200]))) for _ in range(40)]
TEXTS += [None, "", " \t\n", TEXTS[3], TEXTS[3], "Released under the MIT License.\nx apache license", "Ünïcode Σ <|endoftext|> 中文 ​x", "a" * 20_000]
ROWS = [(i, t, "en", [None, "b", "a", "c"][i % 4], len(t or ""), "extra", float(i)) for i, t in enumerate(TEXTS)]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, k string, score double"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3).withColumn("token", F.lit("x")).withColumn("size", F.lit(1)).cache()


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_bpe(docs, empty):
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    out = by_id(bpe.round_trip(docs, path))
    assert len(out) == len(TEXTS)
    for i, text in enumerate(TEXTS):
        ids = library.encode(text or "", add_special_tokens=False).ids
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        assert tuple(out[i])[1:] == (len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False)))
    assert bpe.round_trip(empty, path).count() == 0


def test_gif(docs, empty):
    out = by_id(gif.store(docs))
    for i, text in enumerate(TEXTS):
        raw = (text or "").encode()
        data = raw.ljust(max(192, -(-len(raw) // 192) * 192))
        assert tuple(out[i])[1:5] == (len(raw), len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-16:]))
    assert tuple(out[3])[1:] == tuple(out[43])[1:] and gif.store(empty).count() == 0


def test_gif_frames(spark):
    data = gif.encode(np.arange(192 * 200, dtype=np.int64).astype(np.uint8))
    images = spark.createDataFrame([("a", bytearray(data)), ("b", None)], "name string, content binary")
    out = gif.frames(images, "name", "content").orderBy("frame").collect()
    assert [(r.id, r.frame, r.delay, r.width, r.height) for r in out] == [("a", 0, 4, 192, 192), ("a", 1, 4, 192, 192)]
    assert sum(out[1].histogram) == 3 * 192 * 8


def test_html(spark):
    pages = spark.createDataFrame([(1, "u", "<article><p>a</p></article>", "x"), (2, None, None, "x")], "page_id long, url string, html string, text string")
    assert sorted(tuple(r) for r in htmltext.extract(pages).collect()) == [(1, "u", "a", 1), (2, None, "", 0)]
    assert htmltext.extract(pages.limit(0)).count() == 0


def test_licenses(docs, empty, spark):
    words = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    more = ["this work is licensed under cc by nc 4 0", "CC BY", "license " * 3000, "mit mit license apache license mit license", "The General-Public/License!", "MİT LICENSE"]
    rows = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(100 + i, t) for i, t in enumerate(more)], "doc_id long, text string"))
    out = by_id(licenses.scan(rows))
    for i, text in [*enumerate(TEXTS), *enumerate(more, 100)]:
        own = words.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        found = [(s, label) for phrase, label in licenses.BASE for s in range(len(own)) if own[s : s + len(phrase.split())] == phrase.split()]
        starts = [s for s, _ in found]
        wanted = (len(own), len(found), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in found})))
        assert tuple(out[i])[1:6] == wanted, text
        assert set(filter(None, wanted[4].split(","))) <= set(out[i]["labels"].split(",")) and 0 <= out[i]["score"] <= 1
    assert out[100]["labels"] == "cc-by-nc" and out[101]["labels"] == "" and out[102]["score"] == 0
    assert licenses.scan(empty).count() == 0


def test_all_notices_of_a_file(spark):
    """A file with every notice has every label, also where some notices are common and others rare."""
    common = [t for label, t, _ in licenses.TEMPLATES if label in ("mit", "lgpl", "unlicense", "proprietary")]
    rows = [(i, common[i % len(common)]) for i in range(60)] + [(60, " x\n".join(t for _, t, _ in licenses.TEMPLATES))] + [(i, "none") for i in range(61, 200)]
    out = by_id(licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")))
    assert set(out[60]["labels"].split(",")) == {label for label, _, _ in licenses.TEMPLATES}
    assert out[60]["score"] == 1


def plain_targets(sizes):
    """Shares by weight, the excess over three times a size shared again until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, open_, left = {}, set(order), float(sum(sizes.values()))
    while open_:
        whole = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / whole > 3 * sizes[s]]
        if not over:
            target |= {s: left * weight[s] / whole for s in open_}
            break
        for s in over:
            target[s] = 3.0 * sizes[s]
        left -= sum(3.0 * sizes[s] for s in over)
        open_ -= set(over)
    return target


def test_mixing(docs, empty):
    out = by_id(mixing.mix(docs))
    size = [len(re.findall(r"[^\x20\x09-\x0d]+", t or "")) for t in TEXTS]
    sums = collections.Counter()
    for row, n in zip(ROWS, size):
        sums[row[3]] += n
    target = plain_targets(sums)
    taken = collections.Counter()
    for i, row in enumerate(ROWS):
        assert (out[i]["size"], out[i]["source_size"]) == (size[i], sums[row[3]])
        assert out[i]["target"] == pytest.approx(target[row[3]]) and 0 <= out[i]["taken"] <= 3 * size[i]
        taken[row[3]] += out[i]["taken"]
    for source, n in taken.items():
        assert n == pytest.approx(target[source], rel=0.03, abs=8)
    again = by_id(mixing.mix(docs.repartition(5)))
    assert {k: v["taken"] for k, v in again.items()} == {k: v["taken"] for k, v in out.items()}
    assert mixing.mix(empty).count() == 0
    silent = by_id(mixing.mix(docs.where("text is null or trim(text) = ''")))
    assert {(r["target"], r["taken"]) for r in silent.values()} == {(0.0, 0)}


def test_targets_that_are_full(spark):
    rows = [(i, "w " * n, s) for i, (s, n) in enumerate([("a", 1), ("b", 400), ("c", 300), (None, 2), ("e", 50)])]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = by_id(mixing.mix(df))
    target = plain_targets({"a": 1, "b": 400, "c": 300, None: 2, "e": 50})
    assert all(out[i]["target"] == pytest.approx(target[s]) for i, _, s in rows) and out[0]["taken"] == 3


def test_small_sources_come_near_their_targets(spark):
    """Beside a source of many blocks; and against a plain schedule, slot by slot."""
    counts = {"big": 600_000, "t1": 20, "t2": 100, "t3": 257, "t4": 1000, "t5": 30_000}
    rows, n = [], 0
    for source, words in counts.items():
        while words:
            own = min(words, RNG.choice([1, 7, 90, 3000]))
            rows.append((n, "w " * own, source))
            words, n = words - own, n + 1
    out = by_id(mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)))
    taken, target = collections.Counter(), {}
    for i, _, source in rows:
        taken[source] += out[i]["taken"]
        target[source] = out[i]["target"]
        assert 0 <= out[i]["taken"] <= 3 * out[i]["size"]
    assert target == pytest.approx(plain_targets(counts))
    assert all(abs(taken[s] - target[s]) <= 4 + 0.003 * target[s] for s in counts), (taken, target)

    order = sorted(counts)
    block = {s: max(1, min(mixing.BLOCK, counts[s] // mixing.FINEST)) for s in order}
    need = [target[s] / block[s] for s in order]
    edges = np.cumsum(need) / sum(need)
    edges[-1] = 1
    times, rank = collections.Counter(), collections.Counter()
    for slot in range(int(np.ceil(sum(need)))):
        s = order[int(np.searchsorted(edges, slot * mixing.PHI % 1.0, side="right"))]
        blocks = -(-counts[s] // block[s])
        times[s, rank[s] % blocks] += rank[s] < 3 * blocks
        rank[s] += 1
    start = collections.Counter()
    for i, text, s in sorted(rows, key=lambda r: int(hashlib.md5(f"17:{r[0]}".encode()).hexdigest()[:13], 16)):
        own = len(text) // 2
        wanted = sum(times[s, w // block[s]] for w in range(start[s], start[s] + own))
        start[s] += own
        assert abs(out[i]["taken"] - wanted) <= 0, (i, s)


def test_ranked_schedule(spark):
    shares = spark.createDataFrame([("sa", "a", 0.0, 0.7), ("sb", "b", 0.7, 1.0)], "key string, source string, lo double, hi double")
    plan = mixing.ranked_schedule(mixing.schedule(shares, 1000), chunk=64).collect()
    for source, share in (("a", 700), ("b", 300)):
        ranks = [r["rank"] for r in sorted((r for r in plan if r["source"] == source), key=lambda r: r["slot"])]
        assert ranks == list(range(len(ranks))) and abs(len(ranks) - share) <= 3


def test_top_k(spark):
    rng = np.random.default_rng(5)
    vectors = rng.normal(size=(700, 8)) * rng.exponential(size=(700, 1))
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vectors)]
    rows[7] = (7, rows[8][1])
    rows[50] = (50, rows[100][1])
    rows += [(1000, None), (1050, [1.0, None] + [0.0] * 6), (1100, [float("nan")] * 8), (1150, [float("inf")] * 8), (1200, [0.0] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3).withColumn("score", F.lit(1))
    before, topk.BLOCK, topk.QUERY_BLOCK = (topk.BLOCK, topk.QUERY_BLOCK), 64, 8
    try:
        got = sorted(tuple(r) for r in topk.top_k(df).collect())
    finally:
        topk.BLOCK, topk.QUERY_BLOCK = before
    good = [(i, np.floor(256 * np.array(v, np.float32).astype(float))) for i, v in rows if v and not any(x is None or not np.isfinite(x) for x in v)]
    wanted = []
    for q, v in good:
        if q % 50 == 0:
            scores = sorted((-int(v @ x), i) for i, x in good if i != q)[:5]
            wanted += [(q, r, i, -s) for r, (s, i) in enumerate(scores, 1)]
    assert got == sorted(wanted)
    assert topk.top_k(df.limit(0)).count() == 0 and topk.top_k(df.where("vec_id = 50")).count() == 0
    assert topk.top_k(df.where("vec_id in (1, 50, 51)")).count() == 2


def test_top_k_of_huge_components(spark):
    """Products beyond 2 ** 53 are exact, beyond 64 bits the nearest 64-bit integer; zeros score zero."""
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(40, 3)) * 1e5)] + [(50, [1e30, -1e30, 1.0]), (51, [1e30, 0.0, 0.0]), (100, [0.0] * 3)]
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    whole = {i: [int(np.floor(256 * x)) for x in v] for i, v in rows}
    for q in (0, 50, 100):
        products = {i: sum(a * b for a, b in zip(whole[q], v)) for i, v in whole.items() if i != q}
        scores = sorted((-min(max(s, -(2**63)), 2**63 - 1), i) for i, s in products.items())[:5]
        assert [got[q, r] for r in range(1, 6)] == [(i, -s) for s, i in scores]
    rows = [(i, [1.0, float("1e200")]) for i in range(3)] + [(50, [2.0, 1.0]), (51, [1.0, 1.0])]
    assert [tuple(r) for r in topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()] == [(50, 1, 51, 512 * 256 + 256 * 256)]


def test_top_k_sends_only_blocks_that_matter(spark):
    """One long vector among short ones: its block answers all, and no other block is sent."""
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=6) * (1000 if i < 64 else 0.5)]) for i in range(600)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    kept, names = topk.stored, {}

    def watched(df, name, *rest):
        names[name] = kept(df, name, *rest)
        return names[name]

    before, topk.BLOCK, topk.stored = (topk.BLOCK, topk.stored), 64, watched
    try:
        topk.top_k(df, 7).count()
    finally:
        topk.BLOCK, topk.stored = before
    assert names["topk-blocks"].count() >= 9 and names["topk-pairs"].select("block").distinct().count() <= 2


def brute_groups(rows):
    sets = {}
    for i, text in rows:
        w = (text or "").encode().lower().split()
        sets[i] = frozenset(tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))) if w else frozenset()
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    own = [(i, s) for i, s in sets.items() if s]
    for a, (i, s) in enumerate(own):
        for j, t in own[:a]:
            if 3 * max(len(s), len(t)) <= 4 * min(len(s), len(t)) and 4 * len(s & t) >= 3 * len(s | t):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def near_copies():
    rng = random.Random(3)
    base = [rng.choices(WORDS[:30], k=rng.choice([1, 3, 5, 6, 7, 8, 9, 10, 12, 15, 20, 40, 80])) for _ in range(40)]
    passage = [f"p{i}" for i in range(60)]
    rows = []
    for k in range(450):
        words = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2, 3])):
            words[rng.randrange(len(words))] = rng.choice(WORDS)
        if rng.random() < 0.3:
            words = [f"u{k}_{i}" for i in range(rng.choice([3, 30, 60]))] + passage
        rows.append((k, " ".join(words).upper() if rng.random() < 0.2 else " ".join(words)))
    group = [f"g{i}" for i in range(200)]
    for k in range(450, 560):
        words = list(group)
        for _ in range(rng.choice([1, 4, 8, 10])):
            words[rng.randrange(200)] = f"x{rng.randrange(10**6)}"
        rows.append((k, " ".join(words)))
    return rows + [(900, None), (901, ""), (902, " \n"), (903, "One"), (904, "one")]


@pytest.mark.parametrize("batch", [10_000, 53])
def test_jaccard(spark, empty, batch):
    """Small batches cut lists, also long ones, at every place."""
    rows = near_copies()
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4).withColumn("k", F.lit(1)).withColumn("n", F.lit(2))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.join(df).collect()}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert got == brute_groups(rows)
    assert jaccard.join(empty).count() == 0


@pytest.mark.parametrize("batch", [10_000, 1_000, 53])
def test_jaccard_of_copies_in_many_tasks(spark, batch):
    """Copies of a short text in more partitions than a long list has rows, and near copies that link with them."""
    rng = random.Random(7)
    rows = []
    for g in range(30):
        words = [f"g{g}w{i}" for i in range(14)]
        rows += [" ".join(words)] * 72 + [" ".join([*words[:-1], f"x{g}"]), " ".join([f"y{g}", *words[1:]])]
    rows += [" ".join(rng.choices(WORDS, k=14)) for _ in range(200)]
    rows = list(enumerate(rows))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(72, "doc_id")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.join(df).collect()}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert got == brute_groups(rows)


def test_jaccard_of_rows_without_id(spark):
    """Rows without an id link too; a repeated id may hold different texts."""
    a, b = [f"a{i}" for i in range(60)], [f"b{i}" for i in range(60)]
    rows = [(None, a), (None, [*a, "z"]), (4, ["q", *a]), (None, b), (None, [*b, "z"]), (7, a[:20]), (7, b[:20]), (8, [*b[:20], "z"])]
    out = jaccard.join(spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")).collect()
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in out), key=str)
    wanted = [(None, 56, 4), (None, 57, 4), (4, 57, 4), (None, 56, None), (None, 57, None), (7, 16, 7), (7, 16, 7), (8, 17, 7)]
    assert got == sorted(wanted, key=str)


@pytest.mark.parametrize("piece", [8, 500_000])
def test_components(spark, piece, monkeypatch):
    """A path, a hub, a cycle and random links, by rounds of stars and by one union-find; heavy nodes are looked up where they lie."""
    monkeypatch.setattr(components, "HEAVY_ROWS", 20)
    rng = random.Random(5)
    links = [(i, i + 1) for i in range(100, 160)] + [(500, i) for i in range(501, 640)] + [(i, 640) for i in range(600, 620)]
    links += [(700 + i, 700 + (i + 1) % 9) for i in range(9)] + [(rng.randrange(1000, 1200), rng.randrange(1000, 1200)) for _ in range(120)] + [(5, 5)]
    parent = {x: x for pair in links for x in pair}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x, y in links:
        x, y = find(x), find(y)
        parent[max(x, y)] = min(x, y)
    wanted = {x: find(x) for x, y in ((x, y) for pair in links if pair[0] != pair[1] for x, y in (pair, pair[::-1]))}
    df = spark.createDataFrame(links, "a long, b long").repartition(3)
    got = [(r["node"], r["component"]) for r in components.components(df, piece).collect()]
    assert len(got) == len(wanted) and dict(got) == wanted
    assert components.components(df.limit(0), piece).count() == 0


def test_token_counts(docs, empty):
    import base64

    import tiktoken

    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    with open(path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    out = collections.defaultdict(list)
    for r in tokencount.count(docs, path, pattern).collect():
        out[r["doc_id"]].append(r)
    for i, text in enumerate(TEXTS):
        rows = sorted(out[i], key=lambda r: r["section"])
        ids = library.encode_ordinary(text or "")
        assert sum(r["n_tokens"] for r in rows) == len(ids) == rows[0]["doc_tokens"]
        assert sum(r["n_chars"] for r in rows) == len(text or "")
        starts = [r["first_char"] for r in rows]
        assert [(text or "")[s - 1] for s in starts[1:]] == ["\n"] * (len(starts) - 1)
        at, begins = 0, []
        for t in ids:
            begins.append(len((text or "").encode()[:at].decode("utf-8", "ignore")))
            at += len(library.decode_single_token_bytes(t))
        for k, r in enumerate(rows):
            end = starts[k + 1] if k + 1 < len(rows) else len(text or "") + 1
            assert r["n_tokens"] == sum(r["first_char"] <= b < end for b in begins)
    assert tokencount.count(empty, path, pattern).count() == 0


def plain_lm(rows):
    """Scores of (id, words, near) by two models in which each document's own words don't count."""
    one, two = {}, {}
    for side in (True, False):
        one[side] = collections.Counter(x for _, w, near in rows if near == side for x in w)
        two[side] = collections.Counter(x for _, w, near in rows if near == side for x in zip(w, w[1:]))
    totals = {side: sum(c.values()) for side, c in one.items()}
    out = {}
    for i, w, near in rows:
        found = []
        for side in (True, False):
            scale = 1 if side or not (totals[True] and totals[False]) else totals[True] / totals[False]
            own = (collections.Counter(w), collections.Counter(zip(w, w[1:]))) if side == near else ({}, {})
            total, losses = totals[side] - (len(w) if side == near else 0), []
            share = 0.1 if total > 0 else 1.0
            for j, x in enumerate(w):
                p = (1 - share) * (one[side][x] - own[0].get(x, 0)) / max(total, 1e-9) + share / 2**lmscore.UNIGRAMS
                if j:
                    pair = w[j - 1], x
                    p = ((two[side][pair] - own[1].get(pair, 0)) * scale + 2 * p) / ((one[side][w[j - 1]] - own[0].get(w[j - 1], 0)) * scale + 2)
                losses.append(-np.log(p))
            found.append(float(np.mean(losses)) if w else 0.0)
        out[i] = len(w), found[0], found[1], found[0] - found[1]
    return out


def test_lm_scores(docs, empty):
    out = by_id(lmscore.score(docs, F.col("source") == "a"))
    wanted = plain_lm([(i, (t or "").encode().lower().split(), r[3] == "a") for i, (t, r) in enumerate(zip(TEXTS, ROWS))])
    for i in range(len(TEXTS)):
        assert tuple(out[i])[1:] == pytest.approx(wanted[i], abs=1e-9), i
    assert tuple(out[40])[1:] == (0, 0.0, 0.0, 0.0) and lmscore.score(empty, F.col("source") == "a").count() == 0
    assert lmscore.score(docs, F.lit(None).cast("boolean")).count() == len(TEXTS)


def test_lm_counts_are_exact(spark):
    """More bigrams than any fixed table; several pieces in each task; short documents too."""
    rng = random.Random(8)
    rows = [(i, " ".join(f"w{rng.randrange(90_000)}" for _ in range(rng.choice([1, 2, 5, 400]))), i % 3 == 0) for i in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, near boolean").repartition(3)
    out = by_id(lmscore.score(df, F.col("near"), 40_000))
    wanted = plain_lm([(i, t.split(), near) for i, t, near in rows])
    assert len(out) == len(rows)
    assert all(tuple(out[i])[1:] == pytest.approx(wanted[i], abs=1e-9) for i in wanted)


def test_lm_target_gains_nothing_by_membership(spark):
    """A text like no other scores alike whether it is marked or not."""
    rng = random.Random(4)
    rows = [(i, " ".join(f"w{rng.randrange(50)}" for _ in range(80)), i % 2 == 0) for i in range(40)]
    odd = " ".join(f"odd{i}" for i in range(60))
    scores = [by_id(lmscore.score(spark.createDataFrame([*rows, (99, odd, mark)], "doc_id long, text string, near boolean"), F.col("near")))[99]["score"] for mark in (True, False)]
    assert scores[0] == pytest.approx(scores[1], abs=0.05)


def test_quality(docs, empty, spark):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(48)] + [(None, 1, 0), (1, None, 0)], "doc_id long, quality int, toxic int")
    out = by_id(quality.classify(docs, labels))
    assert len(out) == len(TEXTS)
    for i, r in out.items():
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
    assert out[40]["score"] == out[41]["score"] and out[3]["score"] == out[43]["score"]
    assert quality.classify(empty, labels).count() == 0
    assert {r["score"] for r in quality.classify(docs, labels.limit(0)).collect()} == {0.5}
    # Labels of held-out documents change nothing.
    other = labels.where(~quality.held_out(F.col("doc_id")) | F.col("doc_id").isNull())
    assert {k: v["score"] for k, v in by_id(quality.classify(docs, other)).items()} == {k: v["score"] for k, v in out.items()}


def test_quality_of_repeated_ids(spark):
    """An id with several texts is learned from alike in every run; texts in memory and on executors give the same network."""
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choices(WORDS, k=60)) + (" !!! ###" * 20 if i % 2 else ".")) for i in range(90)] + [(3, "another text " * 20), (3, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(90)], "doc_id long, quality int")
    one, two = (quality.sample(df.repartition(n), labels) for n in (2, 7))
    texts = {r["doc_id"]: r["text"] for r in one.collect()}
    assert texts == {r["doc_id"]: r["text"] for r in two.collect()} and (3 not in texts or texts[3] == "")
    nets = [quality.learn(x, 2) for x in (one, two)]
    probe = [t.encode() for _, t in rows[:20]]
    assert np.allclose(nets[0].score(probe), nets[1].score(probe), atol=1e-6)
    assert all(quality.held_out is not None and zlib.crc32(str(i).encode()) % 3 != 1 for i in texts)
