"""BPE encoding and decoding with a trie of distinct words.

The last token of a prefix's encoding determines the rest: the encoding of a text is the sequence of tokens of which each two
neighbours encode to themselves. So distinct words go into a trie, and a walk in depth-first order finds each prefix's last token
from those of shorter prefixes on the path: the token t that ends the prefix, where what remains has a last token that may stand
before t. A shared prefix is computed once. A word's own last symbol is another symbol (it bears the word end), so words end in
leaves, and their tokens are read back along the path. The trie's nodes are never objects: words in order, each with the length of the prefix
that it shares with the one before, are the walk itself, and a branch is two lists of numbers, linear in the length of a word.
Decoding looks up the ids that encoding gave.

Whole texts: special tokens are cut out of the raw text first, then NFC and lower case, then the pattern's words. Encodings of
words are kept in a bounded table for each worker; the table is emptied when it is full, which changes speed only.

Nulls, ties and edges: a null text is an empty one and has no tokens; equal texts give equal rows; texts of any length are encoded
whole; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from nava.session import ship

#: Encodings (words, and their characters) and pair answers that a worker keeps.
KEPT_WORDS = 250_000
KEPT_CHARS = 8_000_000
KEPT_PAIRS = 250_000
END = "</w>"


def byte_symbols() -> list[str]:
    """Byte-level alphabet: printable Latin-1 bytes stand for themselves, the others for 256, 257, ... in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(other)) for b in range(256)]


def unassigned() -> str:
    """Ranges of code points that this Python's Unicode tables leave out, for a pattern's class."""
    out, start = [], None
    for c in range(0x110001):
        free = c < 0x110000 and unicodedata.category(chr(c)) == "Cn"
        if free and start is None:
            start = c
        elif not free and start is not None:
            out.append(f"\\U{start:08x}-\\U{c - 1:08x}")
            start = None
    return "".join(out)


class Vocabulary:
    """A tokenizers file of kind BPE with word ends."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.text = {i: t for t, i in self.ids.items()}
        self.special: dict[str, int] = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.text |= {i: t for t, i in self.special.items()}
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        # A token's order is its merge; symbols come before all merges.
        self.merged: dict[tuple[int, int], int] = {}
        self.halves: dict[int, tuple[int, int]] = {}
        self.order: dict[int, int] = {}
        for rank, (a, b) in enumerate(merges):
            pair = self.ids[a], self.ids[b]
            token = self.ids[a + b]
            self.merged.setdefault(pair, token)
            if token not in self.halves:
                self.halves[token], self.order[token] = pair, rank
        self.longest = max(map(len, self.ids))
        split = next(x for x in spec["pre_tokenizer"]["pretokenizers"] if x["type"] == "Split")["pattern"]["Regex"]
        self.pattern = regex.compile(split)
        # Unicode tables differ between versions in what one of them lacks; such texts are cut by the library's own tables.
        self.path = path
        self.late = re.compile("[^\x00-\u0557]")
        self.unassigned = re.compile(f"[{unassigned()}]")
        self.cutter = None
        self.specials = regex.compile("|".join(f"({regex.escape(s)})" for s in self.special)) if self.special else None
        symbols = byte_symbols()
        self.to_symbols = {b: symbols[b] for b in range(256)}
        self.from_symbols = {ord(s): b for b, s in enumerate(symbols)}
        self.pairs: dict[int, bool] = {}
        self.encoded: dict[str, str] = {}  # ids of a word, joined by spaces
        self.held = 0  # characters of the words in it
        self.named = {str(i): t for i, t in self.text.items()}

    def may_follow(self, first: int, second: int) -> bool:
        """Whether encoding the two tokens' joined text gives just these two.

        Undo merges, the latest first, on either side of the border; a merge across the border that comes before the one just
        undone would have been made instead.
        """
        key = first << 20 | second
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) >= KEPT_PAIRS:
                self.pairs.clear()
            known = self.pairs[key] = self._may_follow(first, second)
        return known

    def _may_follow(self, first: int, second: int) -> bool:
        order, merged, halves = self.order, self.merged, self.halves
        left, right = first, second
        # The border pair (left, right) exists from when both are made until the first of them is merged on.
        until_left = until_right = 1 << 40
        while True:
            across = merged.get((left, right))
            if across is not None:
                at = order[across]
                # On equal order the merge further left comes first.
                if at < until_right and at < until_left or at == until_right and at < until_left:
                    return False
            made_left, made_right = order.get(left, -1), order.get(right, -1)
            if made_left < 0 and made_right < 0:
                return True
            # Of equal merges the one further left was made first, so the right one is undone first.
            if made_left > made_right:
                until_left, left = made_left, halves[left][1]
            else:
                until_right, right = made_right, halves[right][0]

    def learn(self, words: set[str]) -> None:
        """Encode distinct words and keep their ids.

        Words in order with the length of the prefix that each shares with the one before are their trie in depth-first order: path and
        lengths hold the states of the current branch, of which the shared part stays.
        """
        table, ids, longest, pairs, may_follow = self.to_symbols, self.ids, self.longest, self.pairs, self.may_follow
        spelled = [(w if w.isascii() and w.isprintable() else "".join([table[b] for b in w.encode("utf-8", "surrogatepass")]), w) for w in words]
        spelled.sort()
        path: list[int] = []  # last token of each prefix on the branch
        lengths: list[int] = []  # and its length
        before = ""
        for symbols, word in spelled:
            n = len(symbols)
            shared, upto = 0, min(n - 1, len(path))
            while shared < upto and symbols[shared] == before[shared]:
                shared += 1
            del path[shared:], lengths[shared:]
            before = symbols
            for depth in range(shared + 1, n):
                for size in range(1, min(depth, longest) + 1):
                    token = ids.get(symbols[depth - size : depth])
                    if token is None:
                        continue
                    if size == depth:
                        break
                    last = path[depth - size - 1]
                    fits = pairs.get(last << 20 | token)
                    if fits is None:
                        fits = may_follow(last, token)
                    if fits:
                        break
                path.append(token)
                lengths.append(size)
            # A word's last symbol bears the word end, so words end in leaves.
            for size in range(1, min(n, longest) + 1):
                token = ids.get(symbols[n - size :] + END)
                if token is None:
                    continue
                if size == n:
                    break
                last = path[n - size - 1]
                fits = pairs.get(last << 20 | token)
                if fits is None:
                    fits = may_follow(last, token)
                if fits:
                    break
            tokens, at = [token], n - size
            while at:
                tokens.append(path[at - 1])
                at -= lengths[at - 1]
            tokens.reverse()
            self.encoded[word] = " ".join(map(str, tokens))
            self.held += n

    def words(self, text: str | None) -> list[str]:
        """The pattern's words of a whole text; special tokens stand as they are."""
        if not text:
            return []
        if self.specials is None or "<|" not in text:
            return self._words(text)
        out: list[str] = []
        for part in self.specials.split(text):
            if part in self.special:
                out.append(part)
            elif part:
                out += self._words(part)
        return out

    def _words(self, text: str) -> list[str]:
        if not text.isascii():
            if self.late.search(text) and self.unassigned.search(text):
                return self._cut(text)
            text = unicodedata.normalize("NFC", text)
            if "Σ" in text:  # lower case is taken by character here, without the rule for a final sigma
                text = text.replace("Σ", "σ")
        return self.pattern.findall(text.lower())

    def _cut(self, text: str) -> list[str]:
        """Words by the tokenizer library's normalizer and pattern."""
        if self.cutter is None:
            from tokenizers import Tokenizer

            self.cutter = Tokenizer.from_file(self.path)
        pieces = self.cutter.pre_tokenizer.pre_tokenize_str(self.cutter.normalizer.normalize_str(text))
        return [bytes(self.from_symbols[ord(c)] for c in piece).decode() for piece, _ in pieces]

    def prepare(self, texts: list[list[str]]) -> None:
        """Learn what the texts hold and the table lacks."""
        if len(self.encoded) > KEPT_WORDS or self.held > KEPT_CHARS:
            self.encoded.clear()
            self.held = 0
        for special, i in self.special.items():
            self.encoded[special] = str(i)
        new: set[str] = set()
        for words in texts:
            new.update(words)
        new.difference_update(self.encoded)
        self.learn(new)

    def encode(self, text: str | None) -> list[int]:
        words = self.words(text)
        self.prepare([words])
        return [int(i) for w in words for i in self.encoded[w].split(" ")]

    def decode(self, ids: list[int]) -> str:
        """The tokens' texts, joined by a space: the file names no decoder."""
        return self.decode_joined(" ".join(map(str, ids)))

    def decode_joined(self, ids: str) -> str:
        """The same from decimal ids joined by a space."""
        return " ".join(map(self.named.__getitem__, ids.split(" "))) if ids else ""


_loaded: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    """One for each worker and file."""
    if path not in _loaded:
        _loaded[path] = Vocabulary(path)
    return _loaded[path]


SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
#: Characters of text whose distinct words make one trie.
TRIE_CHARS = 1_000_000


def digests(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary(path)

        def flush(keys: list, texts: list[list[str]]) -> pa.RecordBatch:
            known.prepare(texts)
            encoded = known.encoded
            counts, ids_sha, decoded_sha = [], [], []
            for words in texts:
                ids = " ".join([encoded[w] for w in words])
                counts.append(ids.count(" ") + 1 if ids else 0)
                ids_sha.append(hashlib.sha256(ids.encode()).hexdigest())
                decoded_sha.append(hashlib.sha256(known.decode_joined(ids).encode()).hexdigest())
            return pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.int64()), pa.array(counts, pa.int64()), pa.array(ids_sha), pa.array(decoded_sha)],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

        for batch in batches:
            keys, texts, held = [], [], 0
            for key, text in zip(batch.column(0), batch.column(1)):
                text = text.as_py()
                keys.append(key.as_py())
                texts.append(known.words(text))
                held += len(text or "")
                if held >= TRIE_CHARS:
                    yield flush(keys, texts)
                    keys, texts, held = [], [], 0
            if keys:
                yield flush(keys, texts)

    return run


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens and digests of the ids and of their decoded text, for every whole text."""
    ship(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(digests(path), SCHEMA)
