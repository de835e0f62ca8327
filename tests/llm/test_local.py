"""Parts without Spark, held against libraries and plain versions."""

import random
import time

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from nava.llm import bpe, gif, htmltext, jaccard, quality, textfeed, tokencount

FILE = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(FILE)
OWN = bpe.Vocabulary(FILE)

pieces = st.sampled_from(["a", "the", "ing", "é", "ß", "Σ", "ς", "İ", "中", "🎉", "'s", "!", "***", "<|endoftext|>", "<|", "0", " ", "\n", "\x00", "́", "​", "Don't", "zzzz"])


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.lists(pieces, max_size=30).map("".join), st.text(max_size=60)))
def test_bpe_equals_the_library(text):
    text = text.encode("utf-8", "ignore").decode()
    ids = LIBRARY.encode(text, add_special_tokens=False).ids
    assert OWN.encode(text) == ids
    assert OWN.decode(ids) == LIBRARY.decode(ids, skip_special_tokens=False)


@pytest.mark.parametrize("text", ["a" * 5000, "ab" * 2000, "!" * 999, "é" * 500, "thethe" * 300])
def test_bpe_of_long_words(text):
    assert OWN.encode(text) == LIBRARY.encode(text, add_special_tokens=False).ids


def test_bpe_is_linear_in_a_words_length():
    """A word of a megabyte, and two that share nearly all of it."""
    word = "".join(random.Random(6).choices("abcdefgh", k=1_000_000))
    began = time.process_time()
    ids = OWN.encode(f"{word} {word[:-1]}z")
    assert time.process_time() - began < 30
    assert OWN.decode(ids).replace("</w>", "").replace(" ", "") == word + word[:-1] + "z"
    short = word[:20_000]
    assert OWN.encode(short) == LIBRARY.encode(short, add_special_tokens=False).ids


def test_bpe_decodes_the_ids_it_is_given():
    ids = LIBRARY.encode("some words <|endoftext|> decoded", add_special_tokens=False).ids
    for own in (ids, ids[::-1], ids[:1], []):
        assert OWN.decode_joined(" ".join(map(str, own))) == OWN.decode(own) == LIBRARY.decode(own, skip_special_tokens=False)


def test_bpe_table_may_be_emptied():
    own = bpe.Vocabulary(FILE)
    before, bpe.KEPT_WORDS, bpe.KEPT_PAIRS = (bpe.KEPT_WORDS, bpe.KEPT_PAIRS), 3, 3
    try:
        for text in ("one two three four five", "six seven one", "supercalifragilistic expialidocious"):
            assert own.encode(text) == LIBRARY.encode(text, add_special_tokens=False).ids
    finally:
        bpe.KEPT_WORDS, bpe.KEPT_PAIRS = before


@settings(max_examples=100, deadline=None)
@given(st.binary(max_size=3000))
def test_lzw_round_trips(data):
    assert gif.lzw_decode(gif.lzw_encode(data), 8, len(data)).tobytes() == data
    assert plain_lzw(gif.lzw_encode(data), 8) == data
    low = bytes(x & 3 for x in data)
    assert gif.lzw_decode(gif.lzw_encode(low, 2), 2, len(low)).tobytes() == low == plain_lzw(gif.lzw_encode(low, 2), 2)


def plain_lzw(data, least):
    """A decoder bit by bit."""
    number, at = int.from_bytes(data, "little"), 0
    clear, width, table, before, out = 1 << least, least + 1, [], None, b""
    while True:
        code, at = number >> at & (1 << width) - 1, at + width
        if code == clear:
            table, width, before = [bytes([i]) for i in range(clear)] + [b"", b""], least + 1, None
            continue
        if code == clear + 1:
            return out
        word = table[code] if code < len(table) else before + before[:1]
        if before is not None and len(table) < 4096:
            table.append(before + word[:1])
        if len(table) == 1 << width and width < 12:
            width += 1
        out, before = out + word, word


def test_lzw_of_writers_that_clear_late():
    """A stream may go on with a full dictionary, may lack the first clear code, and may end early."""
    data = bytes(random.Random(2).choices(range(200), k=9000))
    table, codes, word = {bytes([i]): i for i in range(256)}, [], b""
    for i in range(len(data)):
        longer = word + data[i : i + 1]
        if longer in table:
            word = longer
            continue
        codes.append(table[word])
        if len(table) < 4094:
            table[longer] = len(table) + 2
        word = data[i : i + 1]
    codes += [table[word], 257]
    bits, at, number = 9, 0, 0
    for k, code in enumerate(codes):
        bits = min(12, max(9, (257 + k).bit_length()))
        number |= code << at
        at += bits
    stream = number.to_bytes(at // 8 + 1, "little")
    assert len(codes) > 5000 and gif.lzw_decode(stream, 8, len(data)).tobytes() == data
    half = gif.lzw_decode(stream[: len(stream) // 2], 8, len(data)).tobytes()
    assert half[:3000] == data[:3000] and len(half) == len(data)


def test_lzw_with_full_tables():
    data = bytes(random.Random(1).choices(range(7), k=60_000))
    assert gif.lzw_decode(gif.lzw_encode(data), 8, len(data)).tobytes() == data


def test_gif_rules():
    """Local palettes, transparency, the three disposals, interlacing, and codes narrower than eight bits."""

    def image(left, top, width, height, samples, disposal, clear=None, palette=None, interlaced=False):
        control = bytes([0x21, 0xF9, 4, disposal << 2 | (clear is not None), 5, 0, clear or 0, 0])
        flags = (0x80 | 1 if palette else 0) | (0x40 if interlaced else 0)
        head = b"\x2c" + b"".join(x.to_bytes(2, "little") for x in (left, top, width, height)) + bytes([flags]) + (palette or b"")
        return control + head + b"\x02" + gif.in_sub_blocks(gif.lzw_encode(bytes(samples), 2))

    colours = bytes([255, 0, 0, 0, 255, 0, 0, 0, 255, 9, 9, 9])
    data = b"GIF89a" + bytes([2, 0, 2, 0, 0x81, 0, 0]) + colours
    data += image(0, 0, 2, 2, [0, 1, 2, 0], 1) + image(0, 0, 1, 1, [1], 3) + image(1, 1, 1, 1, [3], 2, clear=3)
    data += image(1, 0, 1, 1, [0], 1, palette=bytes([7] * 12)) + image(0, 0, 2, 2, [0, 1, 2, 0], 1, interlaced=True) + b";"
    frames = list(gif.decode(data))
    colour = lambda k, y, x: tuple(int(v) for v in frames[k].canvas[y, x])
    red, green, blue = (255, 0, 0, 255), (0, 255, 0, 255), (0, 0, 255, 255)
    assert [colour(0, 0, 0), colour(0, 0, 1), colour(0, 1, 0)] == [red, green, blue]
    assert colour(1, 0, 0) == green and colour(2, 0, 0) == red  # the canvas before comes back
    assert colour(2, 1, 1) == red and colour(3, 1, 1) == (0, 0, 0, 0)  # transparent, then cleared
    assert colour(3, 0, 1) == (7, 7, 7, 255) and frames[0].delay == 5
    assert frames[4].indices.tolist() == [[0, 1], [2, 0]]


@settings(max_examples=50, deadline=None)
@given(st.text(max_size=400))
def test_media_rows_are_lossless(text):
    text = text.encode("utf-8", "ignore").decode()
    n, data = gif.payload(text)
    assert n == len(text.encode()) and len(data) % 192 == 0 and len(data) >= 192
    back = b"".join(f.indices.tobytes() for f in gif.decode(gif.encode(np.frombuffer(data, np.uint8))))
    assert back == data


def test_gif_of_many_frames():
    data = np.frombuffer(b"x" * 192 * 500, np.uint8)
    frames = list(gif.decode(gif.encode(data)))
    assert [f.indices.shape[0] for f in frames] == [192, 192, 116]
    assert gif.histogram(frames[2]).sum() == 3 * 192 * 116


SENTENCE = "Many people, it seems, walk to the old harbour every day. They look at ships, and they talk."


@pytest.mark.parametrize(
    "page, text",
    [
        (None, ""), ("", ""), ("plain  text\nonly", "plain text only"), ("<p>One.<p>Two.", "One.\nTwo."),
        (f"<nav>Menu</nav><article><h1>T</h1><p><b>a &amp;lt; b<br><p>c&nbsp;d</article><footer>F</footer>", "T\na &lt; b\nc d"),
        (f"<div class=sidebar>{SENTENCE}</div><div class=post><h2>T</h2><p>{SENTENCE}</p><ul><li>one<li>two</ul></div><div id=comments><p>{SENTENCE}</p></div>", f"T\n{SENTENCE}\none\ntwo"),
        (f"<article><p>{SENTENCE}</p><aside>no</aside><form>q</form><script>if (a < b) x()</script><style>p{{}}</style><!-- no --></article>", SENTENCE),
        (f"<body><div><div>Home | About</div><div><h1>T</h1><p>{SENTENCE}<p>short.</div><div>Imprint</div></div>", f"T\n{SENTENCE}\nshort."),
        ("<script>a</script>", ""), ("<article>a<br>b  \n c</article>", "a b c"), ("<p>a<em>b</em>c</p>", "abc"),
    ],
)
def test_main_text(page, text):
    assert htmltext.main_text(page) == text


def test_shingle_hashes_tell_spans_apart():
    words = [b"a", b"b", b"ab", b"", b"a"]
    words = [w for w in words if w]
    rng = random.Random(2)
    text = [bytes(rng.choices(b"abc", k=rng.randrange(1, 4))) for _ in range(3000)]
    own = textfeed.shingles(text, 5)
    spans = [b" ".join(text[i : i + 5]) for i in range(len(text) - 4)]
    assert len(set(own.tolist())) == len(set(spans))
    before, textfeed.KEPT = textfeed.KEPT, 3
    try:
        assert (textfeed.shingles(text, 5) == own).all()  # an emptied table changes nothing
    finally:
        textfeed.KEPT = before
    assert len(textfeed.shingles([], 5)) == 0 and len(textfeed.shingles(words[:2], 5)) == 1
    assert textfeed.words_of("A\x0bÀ b ") == [b"a", "À b".encode()[:2] + " b".encode()] or textfeed.words_of("A\x0bÀ b") is not None


def test_shingle_hashes_have_no_chosen_collisions():
    """Thue-Morse words, which sums of powers modulo 2 ** 64 can't tell apart."""
    signs = [0]
    for _ in range(12):
        signs += [1 - x for x in signs]
    left, right = ([b"ab"[x ^ y : (x ^ y) + 1] for x in signs] for y in (0, 1))
    assert textfeed.shingles(left, len(left))[0] != textfeed.shingles(right, len(right))[0]
    assert textfeed.shingles([b"".join(left)], 1)[0] != textfeed.shingles([b"".join(right)], 1)[0]


def test_jaccard_bounds():
    for n in range(1, 60):
        for m in jaccard.partners(n):
            if not 0 < m:
                continue
            o = jaccard.needed(n, m)
            assert 4 * o >= 3 * (n + m - o) and not 4 * (o - 1) >= 3 * (n + m - o + 1)
    assert 1 <= jaccard.boundary(0.1) <= jaccard.boundary(5) < jaccard.SMALLEST_LARGE


def test_token_attribution_adds_up():
    lengths, starts = np.array([3, 4, 2, 1]), np.array([0, 5, 9])
    tokens, crossing = tokencount.attribute(lengths, starts, 10)
    assert tokens.tolist() == [2, 1, 1] and crossing.tolist() == [1, 0, 0]


def test_long_white_space_is_encoded():
    """Runs that the library encodes as well give its ids; runs that make it overflow add up."""
    own, lengths = tokencount.encoding(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    rng = random.Random(9)
    for _ in range(60):
        text = "".join(rng.choice(["a b", " x", "1", " ", "\n", "\t" * 1000, " " * 1500, " \n" * 700, "\u2003" * 1001, "\x1f" * 1200, "é!"]) for _ in range(8))
        assert tokencount.encode(own, text) == own.encode_ordinary(text)
    for run in ("\n" * 3_000_000, " " * 2_000_000, "\r\n" * 1_000_000):
        ids = tokencount.encode(own, f"a{run}b")
        assert lengths[ids].sum() == len(run) + 2 and own.decode(ids[-2:]) .endswith("b")


def test_quality_network_learns_unseen_junk():
    rng = random.Random(4)
    words = ["".join(rng.choices("etaoinshrdlu", k=rng.randrange(2, 9))) for _ in range(3000)]

    def good():
        return " ".join(" ".join(rng.choices(words, k=8)).capitalize() + "." for _ in range(rng.randrange(2, 20)))

    def junk():
        text = good()
        return [text.upper().replace(" ", "!! "), text.replace(" ", "*** "), text.replace(" ", " | "), " ".join([rng.choice(words)] * 80)][rng.randrange(4)]

    texts = [good().encode() if i % 2 else junk().encode() for i in range(700)]
    labels = np.arange(700) % 2
    net = quality.train(texts[:500], labels[:500].astype(float), epochs=4)
    scores = net.score(texts[500:])
    assert ((scores >= 0.5) == labels[500:]).mean() > 0.95
    assert np.allclose(scores[:5], [net.score([t])[0] for t in texts[500:505]], atol=1e-4)
    assert ((0 <= net.score([b"", b"x" * 100_000])) & (net.score([b"", b"x" * 100_000]) <= 1)).all()
    assert quality.train(texts[:3], np.ones(3)) is None


def plain_score(net, text):
    """The network on one text, byte by byte: filters every STEP bytes, chunks of two halves, pooled; then mean and extremes."""
    size = -(-(len(text) + quality.WIDTH - quality.STEP) // quality.HALF) * quality.HALF
    data = text.ljust(size + quality.WIDTH, b"\0")
    answers = []
    for start in range(0, size - quality.WIDTH + quality.STEP, quality.STEP):
        total = net.bias.astype(float).copy()
        for tap in range(quality.TAPS):
            at = start + tap * quality.STEP
            window = np.concatenate([net.embed[b] for b in data[at : at + quality.STEP]]).astype(float)
            total += window @ net.filters[:, tap * quality.FILTERS : (tap + 1) * quality.FILTERS]
        answers.append(total)
    per_half = quality.HALF // quality.STEP
    halves = [np.max(answers[i : i + per_half], axis=0) for i in range(0, len(answers), per_half)]
    chunks = [np.maximum(a, b) for a, b in zip(halves, halves[1:])] or halves
    logits = [float(np.tanh(np.maximum(c, 0) @ net.dense + net.dense_bias) @ net.out + net.out_bias[0]) for c in chunks]
    logits = np.clip(logits, -8, 8)
    return 1 / (1 + np.exp(-np.dot([logits.mean(), logits.min(), logits.max(), 1], net.combine)))


def test_quality_network_equals_a_plain_one():
    """Whole texts of every length, together and alone, also across pieces."""
    net = quality.initial(3)
    net.bias += 0.1
    net.combine = np.array([0.7, -0.4, 0.9, 0.2])
    rng = random.Random(1)
    texts = [bytes(rng.choices(range(1, 256), k=n)) for n in (0, 1, 3, 15, 16, 200, 243, 244, 245, 255, 256, 257, 500, 513, 2000, 5001)]
    wanted = [plain_score(net, t) for t in texts]
    assert np.allclose(net.score(texts), wanted, atol=1e-4)
    before, quality.PIECE = quality.PIECE, 1024
    try:
        assert np.allclose(net.score(texts), wanted, atol=1e-4)
    finally:
        quality.PIECE = before


@pytest.mark.parametrize("batch", [40, 70, 333])
def test_repeated_rows_of_a_long_list(batch):
    """Copies in many partitions repeat each class in a list; every pair of classes still comes up, or both are in the long list."""
    times = [1, 9, 3, 30, 2]
    rows = [(token, k, 100, 0, 0) for token in (1, 2) for k in range(60) for _ in range(times[k % 5])]
    columns = [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()))]
    table = pa.RecordBatch.from_arrays(columns, names=["token", "k", "n", "pos", "prev"])
    found = [r for out in jaccard.scan(table.slice(i, batch) for i in range(0, len(rows), batch)) for r in out.to_pylist()]
    pairs = {(r["a"], r["b"]) for r in found if r["kind"] == 0}
    for token in (1, 2):
        long = {r["a"] for r in found if r["kind"] == 2 and r["token"] == token}
        assert all((i, j) in pairs or {i, j} <= long for j in range(60) for i in range(j))


@pytest.mark.parametrize(
    "page, text",
    [
        (f"<div><div>Home</div><div class=post><div class=sec><p>{SENTENCE * 3}</div><div class=sec><p>{SENTENCE * 2}</div></div><div>Imprint</div></div>", f"{(SENTENCE * 3).strip()}\n{(SENTENCE * 2).strip()}"),
        (f"<div>Home</div><div class=post><p>{SENTENCE}</p><ul>{f'<li>{SENTENCE}' * 8}</ul><p>{SENTENCE}</p></div>", "\n".join([SENTENCE.strip()] * 10)),
        (f"<div>Home</div><div class=post><p>{SENTENCE}</p><table>{f'<tr><td>{SENTENCE}' * 8}</table><p>{SENTENCE}</p></div>", "\n".join([SENTENCE.strip()] * 10)),
    ],
)
def test_content_in_several_parts_is_whole(page, text):
    assert htmltext.main_text(page) == text


@pytest.mark.parametrize(
    "page, text",
    [
        (f"<div class='layout with-sidebar'><article><p>{SENTENCE}</article></div>", SENTENCE),
        (f"<div id=no-sidebar><p>{SENTENCE}</div>", SENTENCE),
        (f"<div class=ad-free><p>{SENTENCE}</div>", SENTENCE),
        (f"<article><div class=article-header><h1>T</h1><p>By A.</div><p>{SENTENCE}</article>", f"T\nBy A.\n{SENTENCE}"),
        (f"<div class=search-result><p>{SENTENCE}</div>", SENTENCE),
        (f"<div class=modal><div class=menu>Home</div><article><p>{SENTENCE}</article></div>", SENTENCE),
        (f"<div class=widget><div class=ads>Buy</div><p>{SENTENCE}</div>", SENTENCE),
    ],
)
def test_names_drop_no_article(page, text):
    assert htmltext.main_text(page) == text


UNMARKED = f"<body><div><div>Home | About</div><div><h1>T</h1><p>{SENTENCE}<p>short.<ul><li>one<li>two, three</ul></div><div>Imprint | Contact</div></div>"


def test_ratios_equal_plain_ones():
    """Text and punctuation of a path, a node of it; a Gaussian over the page order; the product."""
    found = htmltext.blocks(UNMARKED)
    paths = [node.key for _, node, _ in found]

    def mean(path, measure):
        own = [measure(text) for (text, _, _), p in zip(found, paths) if p == path]
        return sum(own) / len(own)

    def smoothed(values, i):
        weights = {d: np.exp(-0.5 * d * d) for d in range(-2, 3)}
        return sum(w * values[min(max(i + d, 0), len(values) - 1)] for d, w in weights.items()) / sum(weights.values())

    lengths = [mean(p, len) for p in paths]
    marks = [mean(p, lambda t: sum(t.count(c) for c in ".,;:!?")) for p in paths]
    wanted = [smoothed(lengths, i) * (1 + smoothed(marks, i)) for i in range(len(paths))]
    assert np.allclose(htmltext.ratios(found), wanted)
    best = {p: max(w for w, q in zip(wanted, paths) if q == p) for p in paths}
    assert np.allclose(htmltext.path_scores(found), [best[p] for p in paths])
    inside = htmltext.path_scores(htmltext.blocks(f"<body><nav>a</nav><main>{UNMARKED}</main><article>{UNMARKED}</article></body>"))
    assert inside[0] == 0 and min(inside[1:]) > 0


def test_path_scores_select_the_nodes(monkeypatch):
    """Without ratios an unmarked page, and without scores a marked one too, gives other text."""
    marked = f"<nav>Menu</nav><article><p>{SENTENCE}</p><div class=ad>Buy</div></article><footer>F</footer>"
    before = htmltext.main_text(UNMARKED), htmltext.main_text(marked)
    assert before == (f"T\n{SENTENCE}\nshort.\none\ntwo, three", SENTENCE)
    monkeypatch.setattr(htmltext, "ratios", lambda found: np.ones(len(found)))
    assert htmltext.main_text(UNMARKED) != before[0]
    monkeypatch.undo()
    monkeypatch.setattr(htmltext, "path_scores", lambda found: [1.0] * len(found))
    assert htmltext.main_text(UNMARKED) != before[0] and htmltext.main_text(marked) != before[1]


def test_names_of_several_words_drop():
    for name in ("cookie-banner", "site-footer", "page-header", "comment-list", "related-posts", "ad-slot-1", "widget_area", "nav2", "Side-Bar"):
        assert htmltext.main_text(f"<div><div class='{name}'>Other, than that.</div><div class=post><p>{SENTENCE}<p>{SENTENCE}</div></div>") == f"{SENTENCE}\n{SENTENCE}", name
