"""GIF images as columns: encoding, LZW decoding, frames with palettes, disposal and transparency, and colour histograms.

encode() stores bytes losslessly as palette indices of timed frames. decode() reads any GIF87a or GIF89a: variable-width LZW codes,
global and local palettes, interlacing, transparency, and the disposal rules keep, background and previous.

Streams hold the usual dictionary codes. Code widths depend only on a code's place after the last clear code, so codes are packed and cut
out as arrays; the dictionary itself is built code by code.

Nulls, ties and edges: a null text is an empty one, of which the payload is one row of spaces; equal texts give equal values;
very long texts make more frames, never larger ones; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from nava.session import ship

WIDTH = 192
#: Rows of pixels in a frame at most, and a frame's time in hundredths of a second.
ROWS = 192
DELAY = 4
#: Entries of a full dictionary, and its widest code.
FULL, WIDEST = 4096, 12
BINS = 16


@dataclass
class Frame:
    """A composited frame: its time in hundredths of a second, the canvas as RGBA, and the frame's own indices and place."""

    delay: int
    canvas: np.ndarray
    indices: np.ndarray
    left: int
    top: int
    palette: np.ndarray


def widths(least: int, count: int) -> np.ndarray:
    """Bits of the codes after a clear code: the k-th comes when the dictionary has k entries besides the symbols, clear and end."""
    entries = np.minimum((1 << least) + 2 + np.arange(count), FULL)
    return np.maximum(least + 1, np.ceil(np.log2(entries)).astype(np.int64))


def in_sub_blocks(data: bytes) -> bytes:
    full, rest = divmod(len(data), 255)
    grid = np.full((full, 256), 255, np.uint8)
    grid[:, 1:] = np.frombuffer(data, np.uint8, full * 255).reshape(full, 255)
    return grid.tobytes() + (bytes([rest]) + data[full * 255 :] if rest else b"") + b"\0"


def encode(samples: np.ndarray, width: int = WIDTH, rows: int = ROWS, delay: int = DELAY) -> bytes:
    """A GIF of grey frames, each with up to rows rows of samples; the last may be lower than the canvas."""
    height = len(samples) // width
    canvas = min(height, rows)
    grey = np.repeat(np.arange(256, dtype=np.uint8), 3).tobytes()
    parts = [b"GIF89a", struct.pack("<HHBBB", width, canvas, 0xF7, 0, 0), grey]
    for start in range(0, height, rows):
        own = min(rows, height - start)
        # Disposal 2: a lower last frame stands on the background.
        parts.append(b"\x21\xf9\x04" + struct.pack("<BHB", 2 << 2, delay, 0) + b"\0")
        parts.append(b"\x2c" + struct.pack("<HHHHB", 0, 0, width, own, 0) + b"\x08")
        parts.append(in_sub_blocks(lzw_encode(samples[start * width : (start + own) * width].tobytes())))
    return b"".join(parts) + b"\x3b"


def lzw_encode(samples: bytes, least: int = 8) -> bytes:
    """Variable-width codes; the dictionary is cleared when it is full."""
    clear, end = 1 << least, (1 << least) + 1
    codes = [clear]
    put = codes.append
    table: dict[int, int] = {}
    known = table.get
    following = end + 1
    rest = iter(samples)
    word = next(rest, None)
    for sample in rest:
        pair = word << 8 | sample
        longer = known(pair)
        if longer:
            word = longer
            continue
        put(word)
        if following < FULL:
            table[pair] = following
            following += 1
        else:
            put(clear)
            table.clear()
            following = end + 1
        word = sample
    if word is not None:
        put(word)
    put(end)
    # After each clear code stand FULL - end codes and the next clear code.
    own = widths(least, FULL - end + 1)
    bits = np.append(least + 1, np.resize(own, len(codes) - 1))
    digits = np.unpackbits(np.array(codes, "<u2").view(np.uint8).reshape(-1, 2), axis=1, bitorder="little")
    return np.packbits(digits[np.arange(16) < bits[:, None]], bitorder="little").tobytes()


def cut_codes(data: np.ndarray, at: int, bits: np.ndarray) -> np.ndarray:
    """Codes of the given widths from bit at; data ends with three bytes of padding."""
    ends = at + np.cumsum(bits)
    bits = bits[: np.searchsorted(ends, (len(data) - 3) * 8, side="right")]
    start = ends[: len(bits)] - bits
    byte = start >> 3
    return (data[byte] | data[byte + 1] << 8 | data[byte + 2] << 16) >> (start & 7) & ((1 << bits) - 1)


def lzw_decode(data: bytes, least: int, n: int) -> np.ndarray:
    """n samples from variable-width codes; least is the stream's minimum code size. Missing samples are 0."""
    padded = np.frombuffer(data + bytes(3), np.uint8).astype(np.int64)
    clear, end = 1 << least, (1 << least) + 1
    symbols = [bytes([i]) for i in range(clear)] + [b"", b""]
    out: list[bytes] = []
    size, at = 0, 0
    schedule = widths(least, FULL)
    table, before, place = symbols.copy(), None, 0
    while size < n:
        bits = schedule if not place else np.full(FULL, WIDEST)
        codes = cut_codes(padded, at, bits)
        if not len(codes):
            break
        stops = np.flatnonzero((codes == clear) | (codes == end))
        stop = int(stops[0]) if len(stops) else len(codes)
        words: list[bytes] = []
        add, enter, entries = words.append, table.append, len(table)
        for code in codes[:stop].tolist():
            if code < entries:
                word = table[code]
            elif before is not None and code == entries < FULL:
                word = before + before[:1]
            else:
                raise ValueError(f"LZW code {code} beyond the table of {entries}")
            if entries < FULL and before is not None:
                enter(before + word[:1])
                entries += 1
            add(word)
            before = word
        out.append(b"".join(words))
        size += len(out[-1])
        at += int(bits[: stop + 1].sum())
        place = 1
        if stop < len(codes):
            if codes[stop] == end:
                break
            table, before, place = symbols.copy(), None, 0
    return np.frombuffer(b"".join(out)[:n].ljust(n, b"\0"), np.uint8)


def sub_blocks(data: bytes, at: int) -> tuple[bytes, int]:
    """The joined data sub-blocks from at, and the place after their end."""
    parts = []
    while size := data[at]:
        parts.append(data[at + 1 : at + 1 + size])
        at += 1 + size
    return b"".join(parts), at + 1


def decode(data: bytes) -> Iterator[Frame]:
    """The frames of a GIF, one at a time."""
    if data[:6] not in (b"GIF87a", b"GIF89a"):
        raise ValueError("no GIF")
    width, height, flags, background, _ = struct.unpack("<HHBBB", data[6:13])
    at = 13
    shared = np.zeros((256, 3), np.uint8)
    if flags & 0x80:
        size = 2 << (flags & 7)
        shared[:size] = np.frombuffer(data, np.uint8, size * 3, at).reshape(size, 3)
        at += size * 3
    canvas = np.zeros((height, width, 4), np.uint8)
    delay = disposal = 0
    clear_index = -1
    while at < len(data):
        kind = data[at]
        if kind == 0x3B:
            break
        if kind == 0x21:
            body, after = sub_blocks(data, at + 2)
            if data[at + 1] == 0xF9:
                disposal, delay = body[0] >> 2 & 7, body[1] | body[2] << 8
                clear_index = body[3] if body[0] & 1 else -1
            at = after
            continue
        if kind != 0x2C:
            raise ValueError(f"unknown block {kind}")
        left, top, own_width, own_height, own_flags = struct.unpack("<HHHHB", data[at + 1 : at + 10])
        at += 10
        palette = shared
        if own_flags & 0x80:
            size = 2 << (own_flags & 7)
            palette = np.zeros((256, 3), np.uint8)
            palette[:size] = np.frombuffer(data, np.uint8, size * 3, at).reshape(size, 3)
            at += size * 3
        least = data[at]
        body, at = sub_blocks(data, at + 1)
        indices = lzw_decode(body, least, own_width * own_height).reshape(own_height, own_width)
        if own_flags & 0x40:
            order = [y for first, step in ((0, 8), (4, 8), (2, 4), (1, 2)) for y in range(first, own_height, step)]
            plain = np.empty_like(indices)
            plain[order] = indices
            indices = plain
        kept = canvas.copy() if disposal == 3 else None
        region = canvas[top : top + own_height, left : left + own_width]
        visible = indices[: region.shape[0], : region.shape[1]]
        if clear_index < 0:
            region[..., :3], region[..., 3] = palette[visible], 255
        else:
            opaque = visible != clear_index
            region[opaque, :3], region[opaque, 3] = palette[visible[opaque]], 255
        yield Frame(delay, canvas.copy(), indices, left, top, palette)
        if disposal == 2:
            region[...] = 0
        elif kept is not None:
            canvas = kept
        delay = disposal = 0
        clear_index = -1


def histogram(frame: Frame, bins: int = BINS) -> np.ndarray:
    """Opaque pixels of the composited canvas by channel and bin."""
    seen = frame.canvas[..., 3] > 0
    opaque = frame.canvas.reshape(-1, 4) if seen.all() else frame.canvas[seen]
    return np.stack([np.bincount(opaque[:, c], minlength=256).reshape(bins, -1).sum(1) for c in range(3)])


def payload(text: str | None, width: int = WIDTH) -> tuple[int, bytes]:
    """Unpadded bytes, and the text with spaces up to a positive multiple of width."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return len(raw), raw.ljust(max(1, -(-len(raw) // width)) * width, b" ")


def media_row(text: str | None) -> tuple:
    """Stores a text as a GIF, reads it back, and describes what was read."""
    n, data = payload(text)
    media = encode(np.frombuffer(data, np.uint8))
    back, bins, time = [], np.zeros((3, BINS), np.int64), 0
    for frame in decode(media):
        region = frame.canvas[frame.top : frame.top + frame.indices.shape[0], frame.left : frame.left + frame.indices.shape[1]]
        back.append(np.ascontiguousarray(region[..., 0]).tobytes())
        bins += histogram(frame)
        time += frame.delay
    read = b"".join(back)
    feature = f"frames={len(back)};time={time};grey=" + ",".join(map(str, bins[0]))
    return (
        n, len(read), hashlib.sha256(read).hexdigest(), zlib.crc32(read[-16:]) & 0xFFFFFFFF, len(media),
        hashlib.sha256(media).hexdigest(), feature,
    )


SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
TYPES = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]


def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    for batch in batches:
        for start in range(0, batch.num_rows, 256):
            part = batch.slice(start, 256)
            rows = [media_row(t) for t in (x.as_py() for x in part.column(1))]
            columns = list(zip(*rows))
            yield pa.RecordBatch.from_arrays([part.column(0)] + [pa.array(c, t) for c, t in zip(columns, TYPES)], names=names)


def store(docs: DataFrame) -> DataFrame:
    """doc_id and the digests of each text's GIF."""
    ship(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(digests, SCHEMA)


def frames(images: DataFrame, id_column: str, content: str) -> DataFrame:
    """A row for each timed frame of the GIFs in a binary column: id, frame, delay, width, height, and its colour histogram."""
    ship(images.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if data is None:
                    continue
                for k, frame in enumerate(decode(data)):
                    height, width = frame.canvas.shape[:2]
                    yield pa.RecordBatch.from_pylist(
                        [{"id": key, "frame": k, "delay": frame.delay, "width": width, "height": height, "pixels": frame.canvas.tobytes(), "histogram": histogram(frame).ravel().tolist()}],
                        schema=pa.schema([("id", pa.string()), ("frame", pa.int32()), ("delay", pa.int32()), ("width", pa.int32()), ("height", pa.int32()), ("pixels", pa.binary()), ("histogram", pa.list_(pa.int64()))]),
                    )

    return images.selectExpr(f"cast({id_column} as string) as id", f"{content} as content").mapInArrow(
        run, "id string, frame int, delay int, width int, height int, pixels binary, histogram array<long>"
    )
