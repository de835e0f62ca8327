"""PCM and FLAC audio: headers and samples from bytes."""

from __future__ import annotations

import io
import wave

import numpy as np


def facts(content: bytes) -> tuple[int, int, int, float] | None:
    """Rate, channels, frames, seconds of WAV or FLAC; None for anything else."""
    return flac_facts(content) if content[:4] == b"fLaC" else wav_facts(content)


def samples(content: bytes) -> tuple[int, np.ndarray]:
    """Rate and mono samples in [-1, 1)."""
    return flac_samples(content) if content[:4] == b"fLaC" else wav_samples(content)


def wav_facts(content: bytes) -> tuple[int, int, int, float] | None:
    """Rate, channels, frames, seconds of PCM audio; None for anything else."""
    try:
        with wave.open(io.BytesIO(content)) as audio:
            return audio.getframerate(), audio.getnchannels(), audio.getnframes(), audio.getnframes() / audio.getframerate()
    except (wave.Error, EOFError, ZeroDivisionError):
        return None


def wav_samples(content: bytes) -> tuple[int, np.ndarray]:
    """Rate and mono samples in [-1, 1)."""
    with wave.open(io.BytesIO(content)) as audio:
        width, channels, rate = audio.getsampwidth(), audio.getnchannels(), audio.getframerate()
        raw = audio.readframes(audio.getnframes())
    if width == 1:
        data = (np.frombuffer(raw, np.uint8).astype(float) - 128) / 128
    elif width == 3:
        data = (np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32) @ np.array([1, 256, 65536]) + 2**23) % 2**24 / 2**23 - 1
    else:
        data = np.frombuffer(raw, {2: "<i2", 4: "<i4"}[width]).astype(float) / 2 ** (8 * width - 1)
    return rate, data.reshape(-1, channels).mean(1)


def wav_bytes(samples: np.ndarray, rate: int) -> bytes:
    """Mono 16-bit PCM."""
    out = io.BytesIO()
    with wave.open(out, "wb") as audio:
        audio.setnchannels(1)
        audio.setsampwidth(2)
        audio.setframerate(rate)
        audio.writeframes((np.clip(samples, -1, 1) * 32767).round().astype("<i2").tobytes())
    return out.getvalue()


# FLAC


def flac_facts(content: bytes) -> tuple[int, int, int, float] | None:
    """From the stream information block, which comes first."""
    if len(content) < 42 or content[4] & 0x7F:
        return None
    word = int.from_bytes(content[18:26], "big")
    rate, channels, frames = word >> 44, (word >> 41 & 7) + 1, word & (1 << 36) - 1
    return (rate, channels, frames, frames / rate) if rate else None


class Bits:
    """Reads numbers of any width from the first bit on."""

    def __init__(self, data: bytes):
        self.digits = np.unpackbits(np.frombuffer(data, np.uint8))
        self.ones = np.flatnonzero(self.digits)
        self.at = 0

    def number(self, width: int) -> int:
        own = self.digits[self.at : self.at + width]
        if len(own) < width:
            raise ValueError("the stream ends early")
        self.at += width
        out = 0
        for chunk in range(0, width, 56):
            part = own[chunk : chunk + 56]
            out = out << len(part) | int.from_bytes(np.packbits(np.concatenate([np.zeros(-len(part) % 8, np.uint8), part])).tobytes(), "big")
        return out

    def signed(self, width: int) -> int:
        value = self.number(width)
        return value - (1 << width) if width and value >> width - 1 else value

    def zeros(self) -> int:
        """The zeros before the next one, which is read too."""
        k = np.searchsorted(self.ones, self.at)
        if k == len(self.ones):
            raise ValueError("the stream ends early")
        count = int(self.ones[k]) - self.at
        self.at += count + 1
        return count

    def rice(self, count: int, low: int) -> list[int]:
        """count folded numbers, each zeros up to a one and low bits."""
        out = []
        k = int(np.searchsorted(self.ones, self.at))
        at, ones, digits = self.at, self.ones, self.digits
        weights = 1 << np.arange(low)[::-1]
        for _ in range(count):
            while k < len(ones) and ones[k] < at:
                k += 1
            if k == len(ones):
                raise ValueError("the stream ends early")
            one = int(ones[k])
            value = one - at
            at = one + 1
            if low:
                value = value << low | int(digits[at : at + low] @ weights)
                at += low
            out.append(value >> 1 ^ -(value & 1))
        self.at = at
        return out


#: Predictors of the fixed orders.
FIXED = ((), (1,), (2, -1), (3, -3, 1), (4, -6, 4, -1))


def residuals(bits: Bits, size: int, order: int) -> list[int]:
    method = bits.number(2)
    if method > 1:
        raise ValueError("unknown residual coding")
    width, parts = 4 + method, 1 << bits.number(4)
    out: list[int] = []
    for part in range(parts):
        count = size // parts - (0 if part else order)
        low = bits.number(width)
        if low == (1 << width) - 1:
            raw = bits.number(5)
            out += [bits.signed(raw) for _ in range(count)]
        else:
            out += bits.rice(count, low)
    return out


def subframe(bits: Bits, size: int, width: int) -> np.ndarray:
    """One channel's samples of a frame."""
    if bits.number(1):
        raise ValueError("no subframe begins here")
    kind = bits.number(6)
    wasted = bits.zeros() + 1 if bits.number(1) else 0
    width -= wasted
    if kind == 0:
        own = np.full(size, bits.signed(width), np.int64)
    elif kind == 1:
        own = np.array([bits.signed(width) for _ in range(size)], np.int64)
    else:
        if 8 <= kind <= 12:
            order, shift, factors = kind - 8, 0, FIXED[kind - 8]
            values = [bits.signed(width) for _ in range(order)]
        elif kind >= 32:
            order = kind - 31
            values = [bits.signed(width) for _ in range(order)]
            precision = bits.number(4) + 1
            shift = bits.signed(5)
            factors = tuple(bits.signed(precision) for _ in range(order))
        else:
            raise ValueError("unknown subframe")
        for step in residuals(bits, size, order):
            guess = sum(f * v for f, v in zip(factors, reversed(values[-order:]))) if order else 0
            values.append((guess >> shift) + step)
        own = np.array(values, np.int64)
    return own << wasted


#: Bits of a sample by the frame's code.
WIDTHS = (0, 8, 12, 0, 16, 20, 24, 32)


def flac_samples(content: bytes) -> tuple[int, np.ndarray]:
    """Rate and mono samples; frames are read one after the other."""
    word = int.from_bytes(content[18:26], "big")
    rate, own_width = word >> 44, (word >> 36 & 31) + 1
    at = 4
    while True:
        last, length = content[at] >> 7, int.from_bytes(content[at + 1 : at + 4], "big")
        at += 4 + length
        if last:
            break
    parts = []
    while at + 2 < len(content):
        # A frame is at most its raw size and its headers; the block size bounds what must be unpacked.
        bits = Bits(content[at : at + 64 + 65536 * 8 * 4] if len(content) - at > 64 + 65536 * 32 else content[at:])
        if bits.number(14) != 0x3FFE:
            break
        bits.number(2)
        size_code, rate_code, layout, width_code = bits.number(4), bits.number(4), bits.number(4), bits.number(3)
        bits.number(1)
        lead = bits.number(8)
        more = 0
        while more < 7 and lead << more & 0x80:
            more += 1
        for _ in range(max(0, more - 1)):
            bits.number(8)
        size = 192 if size_code == 1 else 576 << size_code - 2 if 2 <= size_code <= 5 else bits.number(8) + 1 if size_code == 6 else bits.number(16) + 1 if size_code == 7 else 256 << size_code - 8
        if rate_code in (12, 13, 14):
            bits.number(8 if rate_code == 12 else 16)
        bits.number(8)
        width = WIDTHS[width_code] or own_width
        if layout < 8:
            channels = [subframe(bits, size, width) for _ in range(layout + 1)]
        else:
            # Left and side, side and right, middle and side: the side is a bit wider.
            one = subframe(bits, size, width + (layout == 9))
            two = subframe(bits, size, width + (layout != 9))
            if layout == 8:
                channels = [one, one - two]
            elif layout == 9:
                channels = [one + two, two]
            else:
                middle = one << 1 | two & 1
                channels = [middle + two >> 1, middle - two >> 1]
        parts.append(np.mean(channels, axis=0) / 2.0 ** (width - 1))
        bits.at += -bits.at % 8 + 16
        at += bits.at // 8
    return rate, np.concatenate(parts) if parts else np.zeros(0)


def flac_bytes(values: np.ndarray, rate: int, block: int = 4096) -> bytes:
    """Mono 16-bit FLAC with fixed predictors of order 2 and Rice-coded residuals."""
    values = (np.clip(values, -1, 1) * 32767).round().astype(np.int64)

    def checked(data: bytes, polynomial: int, width: int) -> int:
        value = 0
        for byte in data:
            value ^= byte << width - 8
            for _ in range(8):
                value = value << 1 ^ polynomial if value >> width - 1 else value << 1
                value &= (1 << width) - 1
        return value

    frames = []
    for number, start in enumerate(range(0, len(values), block)):
        own = values[start : start + block]
        code = number.to_bytes(1, "big") if number < 128 else chr(number).encode("utf-8", "surrogatepass")
        head = bytes([0xFF, 0xF8, 7 << 4, 4 << 1]) + code + (len(own) - 1).to_bytes(2, "big")
        head += bytes([checked(head, 0x07, 8)])
        order = min(2, len(own))
        steps = np.diff(own, 2) if order == 2 else np.zeros(0, np.int64)
        folded = np.where(steps < 0, -2 * steps - 1, 2 * steps)
        low = min(14, max(0, int(folded.mean()).bit_length() - 1)) if len(folded) else 0
        text = ["0", f"{8 + order:06b}", "0", *[f"{int(v) & 0xFFFF:016b}" for v in own[:order]], "00", "0000", f"{low:04b}"]
        text += ["0" * (int(v) >> low) + "1" + (f"{int(v) & (1 << low) - 1:0{low}b}" if low else "") for v in folded]
        body = "".join(text)
        body += "0" * (-len(body) % 8)
        frame = head + int(body, 2).to_bytes(len(body) // 8, "big")
        frames.append(frame + checked(frame, 0x8005, 16).to_bytes(2, "big"))
    facts_ = (rate << 44 | 0 << 41 | 15 << 36 | len(values)).to_bytes(8, "big")
    info = block.to_bytes(2, "big") * 2 + bytes(6) + facts_ + bytes(16)
    return b"fLaC" + bytes([0x80]) + len(info).to_bytes(3, "big") + info + b"".join(frames)
