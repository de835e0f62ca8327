"""FLAC streams: round trips, and frames written by hand with every kind of subframe and channel layout."""

import random

import numpy as np
import pytest

from nava.functions import signal as S
from nava.functions.edits import edits
from nava.sources import audio


@pytest.mark.parametrize("n", [0, 1, 2, 3, 100, 4096, 4097, 20_000])
def test_flac_round_trips(n):
    rng = np.random.default_rng(n)
    wave = np.cumsum(rng.normal(size=n)) / 300
    wave = np.clip(wave, -1, 1)
    data = audio.flac_bytes(wave, 16000)
    rate, back = audio.samples(data)
    assert rate == 16000 and audio.facts(data)[:3] == (16000, 1, n)
    assert np.array_equal((back * 32768).round().astype(int), (wave * 32767).round().astype(int))


class Writer:
    def __init__(self):
        self.text = ""

    def put(self, value, width):
        self.text += f"{value & (1 << width) - 1:0{width}b}" if width else ""

    def rice(self, values, low):
        for v in values:
            folded = 2 * v if v >= 0 else -2 * v - 1
            self.text += "0" * (folded >> low) + "1"
            self.put(folded, low)


def frame(layout, width_code, size, subframes):
    w = Writer()
    w.put(0x3FFE, 14)
    w.put(0, 2)
    w.put(6, 4), w.put(0, 4), w.put(layout, 4), w.put(width_code, 3), w.put(0, 1)
    w.put(0, 8), w.put(size - 1, 8), w.put(0, 8)
    for write in subframes:
        w.put(0, 1)
        write(w)
    w.text += "0" * (-len(w.text) % 8) + "0" * 16
    return int(w.text, 2).to_bytes(len(w.text) // 8, "big")


def stream(channels, width, frames, rate=8000):
    facts = (rate << 44 | channels - 1 << 41 | width - 1 << 36 | 0).to_bytes(8, "big")
    info = (16).to_bytes(2, "big") * 2 + bytes(6) + facts + bytes(16)
    return b"fLaC" + bytes([0, 0, 0, 34]) + info + bytes([0x81, 0, 0, 5]) + b"extra" + b"".join(frames)


def constant(value, width):
    return lambda w: (w.put(0, 7), w.put(value, width))


def verbatim(values, width):
    return lambda w: (w.put(1, 6), w.put(0, 1), [w.put(v, width) for v in values])


def wasted(values, width, zeros):
    return lambda w: (w.put(1, 6), w.put(1, 1), w.put(1, zeros), [w.put(v >> zeros, width - zeros) for v in values])


def linear(values, width, factors, shift):
    order = len(factors)
    guesses = [sum(f * v for f, v in zip(factors, reversed(values[i - order : i]))) >> shift for i in range(order, len(values))]
    steps = [v - g for v, g in zip(values[order:], guesses)]

    def write(w):
        w.put(31 + order, 6), w.put(0, 1)
        [w.put(v, width) for v in values[:order]]
        w.put(11, 4), w.put(shift, 5)
        [w.put(f, 12) for f in factors]
        w.put(0, 2), w.put(1, 4)  # two parts: one Rice-coded, one raw
        w.put(3, 4)
        half = len(values) // 2 - order
        w.rice(steps[:half], 3)
        w.put(15, 4), w.put(20, 5)
        [w.put(s, 20) for s in steps[half:]]

    return write


def test_flac_subframes_and_layouts():
    rng = random.Random(1)
    a = [rng.randrange(-3000, 3000) for _ in range(16)]
    b = [4 * rng.randrange(-500, 500) for _ in range(16)]
    side = [x - y for x, y in zip(a, b)]
    middle = [(x + y) >> 1 for x, y in zip(a, b)]
    mean = [(x + y) / 2 / 32768 for x, y in zip(a, b)]
    cases = [
        (1, verbatim(a, 16), wasted(b, 16, 2)), (8, linear(a, 16, (900, -300), 9), verbatim(side, 17)),
        (9, verbatim(side, 17), verbatim(b, 16)), (10, linear(middle, 16, (512,), 9), linear(side, 17, (500, 20, -7), 9)),
    ]
    for layout, one, two in cases:
        rate, back = audio.samples(stream(2, 16, [frame(layout, 4, 16, (one, two))] * 2))
        assert rate == 8000 and np.allclose(back, mean * 2), layout
    _, back = audio.samples(stream(1, 16, [frame(0, 0, 16, (constant(-77, 16),))]))
    assert np.allclose(back, -77 / 32768)


def test_what_is_no_audio():
    assert audio.facts(b"") is None and audio.facts(b"fLaC") is None and audio.facts(b"RIFF") is None


def test_edits_equal_the_matrix():
    rng = random.Random(1)

    def plain(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            before, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
        return row[-1]

    for _ in range(500):
        a = [rng.randrange(rng.choice([2, 5, 50])) for _ in range(rng.randrange(90))]
        b = [x for x in a if rng.random() < 0.8] if rng.random() < 0.5 else [rng.randrange(4) for _ in range(rng.randrange(90))]
        assert edits(a, b) == plain(a, b)
    assert edits("é", "e") == 1 and edits(range(30_000), range(1, 30_001)) == 2


def test_signal_edges():
    empty = np.zeros(0)
    assert S.best_lag(empty, empty, 5) == (0, 0.0) and S.best_lag(None, empty, 5) == (0, 0.0) and S.high_fraction(empty, 16000, 100) == 0
    x = np.random.default_rng(0).normal(size=500)
    assert S.best_lag(-x, x, 20)[0] == 0 and S.best_lag(-x, x, 20)[1] == pytest.approx(-1)
    assert S.best_lag(np.concatenate([np.zeros(7), x]), x, 20)[0] == 7
    assert not S.burst_mask(50, -1, 2, np.random.default_rng(1)).any() and S.burst_mask(50, 2, 2, np.random.default_rng(1)).all()
    t = np.arange(16000) / 16000
    inside, outside = (S.bandpass(np.sin(2 * np.pi * f * t), 16000, 300, 3400)[2000:-2000].std() for f in (1000, 100))
    assert inside == pytest.approx(2**-0.5, rel=1e-3) and outside < 1e-4
    assert len(S.bandpass(empty, 16000, 300, 3400)) == 0


def test_degradation_is_seeded_and_whole():
    from nava.plans.sounds import _CONFIG

    x = np.sin(np.arange(16000) / 9) * 0.3
    noise = {"id": "n", "samples": np.random.default_rng(2).normal(size=5000), "rate": 8000}
    seen = set()
    for seed in range(30):
        y, target, facts = S.degrade_item(x, 16000, seed, _CONFIG, [noise])
        again = S.degrade_item(x, 16000, seed, _CONFIG, [noise])
        assert np.array_equal(y, again[0]) and facts == again[2] and len(y) == len(target) == 16000
        assert max(abs(y).max(), abs(target).max()) <= 0.5 + 1e-9
        seen.add((facts["profile"], facts["codec"], facts["channel_path"], facts["snr_db"] is None, facts["observed_loss"] > 0))
        quiet = S.degrade_item(x, 16000, seed, _CONFIG, [])
        assert quiet[2]["profile"] == facts["profile"] and quiet[2]["snr_db"] is None
    assert len(seen) > 8
    with pytest.raises(ValueError):
        S.degrade_item(x, 16000, 1, _CONFIG | {"codec_distribution": [{"codec": "gsm"}]}, [])
    given = S.degrade_item(x, 16000, 1, _CONFIG | {"codec_distribution": [{"codec": "gsm"}]}, [], {"gsm": lambda y, rate: y * 0.5})
    assert given[2]["channel_sample_rate"] == 8000
