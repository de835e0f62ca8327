"""Token counts by section, from one encoding of each whole document.

A document is encoded once; the bytes of its tokens give each token's span. Sections (lines, or fields given as spans) are joined
with the tokens as intervals: both are in order, so a token's section is found by search in the section starts. A token that crosses a
border belongs to the section that holds its first byte; that it crosses is counted there too. So the sections' tokens add up to
the document's.

Nulls, ties and edges: a null text is an empty one; an empty document has one empty section; a line feed belongs to the line that it
ends; repeated rows give equal rows; texts of any length are encoded whole; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from nava.session import ship

_encodings: dict[str, tuple] = {}
#: Long runs of white space (fixed values: Unicode's property White_Space).
RUN = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{1000,}")


def encoding(path: str, pattern: str) -> tuple:
    """A ranks file's encoding and its tokens' byte lengths; one for each worker."""
    if path not in _encodings:
        import tiktoken

        with open(path, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        lengths = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, rank in ranks.items():
            lengths[rank] = len(token)
        _encodings[path] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), lengths
    return _encodings[path]


def encode(own, text: str) -> list[int]:
    """Ids of a whole text. The pattern takes a run of white space up to its last character, which goes to the word that follows,
    and a run at the end whole; the library's own search overflows on runs of a million, so long runs are cut out just there."""
    ids: list[int] = []
    at = 0
    for run in RUN.finditer(text):
        end = run.end() - (run.end() < len(text))
        ids += own.encode_ordinary(text[at : run.start()])
        ids += own._encode_single_piece(text[run.start() : end])
        at = end
    return ids + own.encode_ordinary(text[at:])


def line_starts(raw: np.ndarray) -> np.ndarray:
    """First bytes of lines; one that would begin at the end of the text isn't a line."""
    starts = np.flatnonzero(raw == 10) + 1
    return np.concatenate([[0], starts[starts < len(raw)]])


def attribute(lengths: np.ndarray, starts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """For each section (its first byte in starts, in order) the tokens that begin in it, and how many of these end beyond it."""
    ends = np.cumsum(lengths)
    begins = ends - lengths
    section = np.searchsorted(starts, begins, side="right") - 1
    borders = np.append(starts[1:], size)
    tokens = np.bincount(section, minlength=len(starts))
    crossing = np.bincount(section[ends > borders[section]], minlength=len(starts))
    return tokens, crossing


SCHEMA = "doc_id long, section long, first_char long, n_chars long, n_tokens long, n_crossing long, doc_tokens long"


def counter(path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, token_bytes = encoding(path, pattern)
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        for batch in batches:
            for start in range(0, batch.num_rows, 200):
                part = batch.slice(start, 200)
                columns: list[list[np.ndarray]] = [[] for _ in names]
                keys: list[int | None] = []
                for key, text in zip(part.column(0).to_pylist(), part.column(1)):
                    text = (text.as_py() or "").encode("utf-8", "replace").decode()
                    raw = np.frombuffer(text.encode(), np.uint8)
                    ids = np.array(encode(own, text), np.int64)
                    starts = line_starts(raw)
                    tokens, crossing = attribute(token_bytes[ids], starts, len(raw))
                    # Characters begin at bytes that don't continue one.
                    chars = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
                    at = chars[starts]
                    n = len(starts)
                    keys += [key] * n
                    for column, values in zip(columns[1:], (np.arange(n), at, np.diff(np.append(at, chars[-1])), tokens, crossing, np.full(n, len(ids)))):
                        column.append(values)
                arrays = [pa.array(keys, pa.int64())] + [pa.array(np.concatenate(c).astype(np.int64)) if c else pa.array([], pa.int64()) for c in columns[1:]]
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    return run


def count(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """A row for each line of each document, with its tokens."""
    ship(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(counter(path, pattern), SCHEMA)
