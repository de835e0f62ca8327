"""Numeric work on waveforms that needs transforms or a chain of states: numpy in Arrow functions, and plain functions for tests."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nava.operators.constraints import CODEC_PATHS
from nava.sources.files import merged

#: Types as objects: workers import this module, and there type names can't be parsed.
LONG, DOUBLE, DOUBLES = T.LongType(), T.DoubleType(), T.ArrayType(T.DoubleType())
LAG = T.StructType([T.StructField("lag", LONG), T.StructField("corr", DOUBLE)])


def stable_seed(seed: int, split: str, key: str, variant: int) -> int:
    """32 bits from BLAKE2b of the four values joined by a bar."""
    text = f"{seed}|{split}|{key}|{variant}".encode()
    return int.from_bytes(hashlib.blake2b(text, digest_size=8).digest(), "little") % 2**32


@F.pandas_udf(LONG)
def stable_seeds(seed: pd.Series, split: pd.Series, key: pd.Series, variant: pd.Series) -> pd.Series:
    return pd.Series([stable_seed(*x) for x in zip(seed, split, key, variant)])


def correlation(reference: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lags and the full cross-correlation sum(reference[t] * other[t + lag])."""
    n = len(reference) + len(other) - 1
    size = 1 << max(1, (n - 1).bit_length())
    product = np.fft.irfft(np.conj(np.fft.rfft(reference, size)) * np.fft.rfft(other, size), size)
    lags = np.arange(-(len(reference) - 1), len(other))
    return lags, product[lags % size]


def alignment_lag(reference: np.ndarray, other: np.ndarray, most: int) -> int:
    """The lag of the highest signed correlation of the mean-free signals, within most samples."""
    a, b = np.asarray(reference, float), np.asarray(other, float)
    lags, values = correlation(a - a.mean(), b - b.mean())
    inside = np.abs(lags) <= most
    return int(lags[inside][np.argmax(values[inside])])


@F.pandas_udf(LONG)
def alignment_lags(reference: pd.Series, other: pd.Series, most: pd.Series) -> pd.Series:
    return pd.Series([alignment_lag(x, y, int(m)) if x is not None and y is not None and len(x) and len(y) else 0 for x, y, m in zip(reference, other, most)])


def best_lag(other: np.ndarray | None, reference: np.ndarray | None, most: int) -> tuple[int, float]:
    """The lag in -most .. most at which the two correlate most in size, and the signed, normalized correlation there.

    Positive where `other` comes later than the reference. Both are cut to the common length; (0, 0.0) without samples.
    """
    n = min(len(x) if x is not None else 0 for x in (other, reference))
    if not n:
        return 0, 0.0
    a, b = (np.asarray(x[:n], float) for x in (reference, other))
    a, b = a - a.mean(), b - b.mean()
    lags, values = correlation(a, b)
    inside = np.abs(lags) <= min(most, n - 1)
    k = np.argmax(np.abs(values[inside]))
    return int(lags[inside][k]), float(values[inside][k] / (np.sqrt((a @ a) * (b @ b)) + 1e-12))


@F.pandas_udf(LAG)
def best_lags(other: pd.Series, reference: pd.Series, most: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([best_lag(x, y, int(m)) for x, y, m in zip(other, reference, most)], columns=["lag", "corr"])


def high_fraction(x: np.ndarray, rate: int, cutoff: float) -> float:
    """Energy above a frequency, of all; 0 without samples."""
    if x is None or not len(x):
        return 0.0
    power = np.abs(np.fft.rfft(np.asarray(x, float))) ** 2
    frequency = np.fft.rfftfreq(len(x), 1 / rate)
    return float(power[frequency > cutoff].sum() / (power.sum() + 1e-12))


@F.pandas_udf(DOUBLE)
def high_fractions(x: pd.Series, rate: pd.Series, cutoff: pd.Series) -> pd.Series:
    return pd.Series([high_fraction(a, r, c) for a, r, c in zip(x, rate, cutoff)])


def bandpass(x: np.ndarray, rate: int, low: float, high: float, order: int = 6) -> np.ndarray:
    """Zero-phase Butterworth band-pass: the squared magnitude of the digital filter, as passes forward and back give it, on the spectrum.

    The upper cut-off is kept below 0.98 of half the rate and the lower one below 0.8 of the upper. Ends are mirrored, where a recursive
    filter has its own transients; inside, both agree.
    """
    x = np.asarray(x, float)
    if low <= 0 or high <= 0:
        raise ValueError("cut-offs must be positive")
    if not len(x):
        return x
    high = min(high, 0.49 * rate)
    low = min(low, 0.8 * high)
    # The bilinear transform's frequencies.
    f = np.tan(np.pi * np.minimum(np.fft.rfftfreq(2 * len(x), 1 / rate) / rate, 0.4999999))
    f1, f2 = np.tan(np.pi * low / rate), np.tan(np.pi * high / rate)
    shifted = (f**2 - f1 * f2) / np.maximum(f * (f2 - f1), 1e-300)
    gain = 1 / (1 + np.minimum(np.abs(shifted), 1e20) ** (2 * order))
    return np.fft.irfft(np.fft.rfft(np.concatenate([x, x[::-1]])) * gain, 2 * len(x))[: len(x)]


@F.pandas_udf(DOUBLES)
def bandpassed(x: pd.Series, rate: pd.Series, low: pd.Series, high: pd.Series) -> pd.Series:
    return pd.Series([bandpass(a, r, lo, hi) for a, r, lo, hi in zip(x, rate, low, high)])


def resample(x: np.ndarray, before: int, after: int) -> np.ndarray:
    """Band-limited resampling by cutting or padding the spectrum of the mirrored signal."""
    x = np.asarray(x, float)
    if before == after or not len(x):
        return x
    n, m = len(x), int(round(len(x) * after / before))
    spectrum = np.fft.rfft(np.concatenate([x, x[::-1]]))
    bins = m + 1
    spectrum = spectrum[:bins] if bins <= len(spectrum) else np.pad(spectrum, (0, bins - len(spectrum)))
    return (np.fft.irfft(spectrum, 2 * m) * (m / n))[:m]


def mu_law(x: np.ndarray, bits: int = 8) -> np.ndarray:
    """Companded, quantized and expanded again."""
    mu = 2**bits - 1
    y = np.sign(x) * np.log1p(mu * np.minimum(np.abs(x), 1)) / np.log1p(mu)
    y = np.round((y + 1) / 2 * mu) / mu * 2 - 1
    return np.sign(y) * np.expm1(np.abs(y) * np.log1p(mu)) / mu


def a_law(x: np.ndarray, bits: int = 8, a: float = 87.6) -> np.ndarray:
    magnitude = np.minimum(np.abs(x), 1)
    y = np.where(magnitude < 1 / a, a * magnitude, 1 + np.log(np.maximum(a * magnitude, 1e-12))) / (1 + np.log(a)) * np.sign(x)
    y = np.round((y + 1) / 2 * (2**bits - 1)) / (2**bits - 1) * 2 - 1
    y_abs = np.abs(y) * (1 + np.log(a))
    return np.sign(y) * np.where(y_abs < 1, y_abs / a, np.exp(y_abs - 1) / a)


def burst_mask(n: int, loss: float, burst: float, random: np.random.Generator) -> np.ndarray:
    """Lost frames of a two-state chain with this loss rate (kept within 0 and 1) and mean burst length, from its stationary state.

    One draw a frame, the first for the starting state: equal seeds give equal masks of this engine, not those of others.
    """
    loss = min(max(loss, 0.0), 1.0)
    leave = 1 / max(burst, 1.0)
    enter = min(1.0, loss * leave / max(1 - loss, 1e-9))
    leave = 0.0 if loss == 1 else leave
    draws = random.random(n)
    lost = np.zeros(n, bool)
    state = bool(draws[0] < loss) if n else False
    for i in range(n):
        if i:
            state = draws[i] >= leave if state else draws[i] < enter
        lost[i] = state
    return lost


def drop_frames(x: np.ndarray, lost: np.ndarray, frame: int) -> tuple[np.ndarray, float]:
    """Lost frames are silent; also the share that was lost."""
    out = np.array(x, float)
    for i in np.flatnonzero(lost):
        out[i * frame : (i + 1) * frame] = 0
    return out, float(lost.mean()) if len(lost) else 0.0


def mel_filters(rate: int, bands: int, size: int) -> np.ndarray:
    """bands x bins triangles of equal area, evenly spaced in mel."""
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(mel(0), mel(rate / 2), bands + 2) / 2595) - 1)
    f = np.fft.rfftfreq(size, 1 / rate)
    up = (f[None] - edges[:-2, None]) / (edges[1:-1] - edges[:-2])[:, None]
    down = (edges[2:, None] - f[None]) / (edges[2:] - edges[1:-1])[:, None]
    return np.maximum(0, np.minimum(up, down)) * (2 / (edges[2:] - edges[:-2]))[:, None]


def log_mel(x: np.ndarray, rate: int = 16000, bands: int = 80, size: int = 400, hop: int = 160, frames: int | None = None) -> np.ndarray:
    """bands x frames log-mel magnitudes; with a number of frames, the signal is cut or padded to it."""
    x = np.asarray(x, float)
    if frames is not None:
        x = np.pad(x[: frames * hop], (0, max(0, frames * hop - len(x))))
    x = np.pad(x, size // 2, mode="reflect" if len(x) > size // 2 else "constant")
    windows = np.lib.stride_tricks.sliding_window_view(x, size)[::hop]
    power = np.abs(np.fft.rfft(windows * np.hanning(size + 1)[:-1], axis=1)) ** 2
    power = power[:frames] if frames is not None else power
    out = np.log10(np.maximum(mel_filters(rate, bands, size) @ power.T, 1e-10))
    return (np.maximum(out, out.max() - 8) + 4) / 4


def normalized_mel(x: np.ndarray, rate: int = 16000, bands: int = 80, size: int = 512, window: int = 400, hop: int = 160, emphasis: float = 0.97) -> np.ndarray:
    """bands x frames natural-log mel powers of the emphasized signal, each band with mean 0 and deviation 1 over the frames."""
    x = np.asarray(x, float)
    x = np.concatenate([x[:1], x[1:] - emphasis * x[:-1]])
    shape = np.zeros(size)
    at = (size - window) // 2
    shape[at : at + window] = np.hanning(window)
    windows = np.lib.stride_tricks.sliding_window_view(np.pad(x, size // 2), size)[::hop]
    power = np.abs(np.fft.rfft(windows * shape, axis=1)) ** 2
    out = np.log(mel_filters(rate, bands, size) @ power.T + 2.0**-24)[:, : max(1, len(x) // hop)]
    deviation = out.std(1, ddof=1, keepdims=True) if out.shape[1] > 1 else 0.0
    return (out - out.mean(1, keepdims=True)) / (deviation + 1e-5)


def aligned_target(clean: np.ndarray, rate: int, length: int, model_rate: int = 16000, band: tuple[float, float] | None = None, channel_rate: int | None = None, scale: float | None = None) -> np.ndarray:
    """The clean target as the channel could have carried it: through the channel's rate and band where these are given, cut or padded
    to the degraded length, at the pair's scale."""
    x = np.asarray(clean, float)
    if band is not None and channel_rate is not None:
        x = resample(bandpass(resample(x, rate, channel_rate), channel_rate, *band), channel_rate, model_rate)
    else:
        x = resample(x, rate, model_rate)
    x = np.pad(x[:length], (0, max(0, length - len(x))))
    return x if scale is None else x * scale


#: What a codec does to samples at its channel's rate; others are given by the caller.
Codec = Callable[[np.ndarray, int], np.ndarray]


def drawn(random: np.random.Generator, choices: list[dict]) -> dict:
    """One of some entries by their weights."""
    weights = np.array([max(0.0, float(c.get("weight", 1.0))) for c in choices])
    return choices[min(int(np.searchsorted(np.cumsum(weights) / weights.sum(), random.random(), side="right")), len(choices) - 1)]


def degrade_item(x: np.ndarray, rate: int, seed: int, config: dict, noises: list[dict], codecs: dict[str, Codec] | None = None) -> tuple[np.ndarray, np.ndarray, dict]:
    """degraded, target and facts of one variant by a configuration.

    One generator gives all draws in this order: profile, noise (drawn whether or not there are noises), scenes, level bucket and level,
    assets and their offsets, gain, clipping, codec, path, network, loss bucket and rate, burst, mask. A noise has id, scene, samples, rate.
    """
    known = {"g711_alaw": lambda y, _: a_law(y), "g711_mulaw": lambda y, _: mu_law(y), "pass_through": lambda y, _: y} | (codecs or {})
    random = np.random.default_rng(seed)
    profile = drawn(random, config.get("profiles") or [{"name": "legacy"}])
    own = merged({k: v for k, v in config.items() if k != "profiles"}, {k: v for k, v in profile.items() if k not in ("name", "weight", "description")})
    model = int(own.get("model_sample_rate", 16000))
    clean = resample(np.asarray(x, float), rate, model)
    out = clean.copy()
    facts: dict = {"seed": seed, "profile": profile.get("name", "unnamed"), "noise_ids": [], "noise_scenes": [], "snr_db": None}
    noise, uniform = own["noise"], lambda bounds: float(random.uniform(*bounds))
    if random.random() < noise["probability"] and noises:
        count = 2 if random.random() < noise.get("second_scene_probability", 0.0) else 1
        facts["snr_db"] = uniform(noise["snr_buckets"][int(random.integers(len(noise["snr_buckets"])))])
        mixed = np.zeros(len(out))
        for _ in range(count):
            asset = noises[int(random.integers(len(noises)))]
            wave = resample(np.asarray(asset["samples"], float), asset["rate"], model)
            start = int(random.integers(0, len(wave) - len(out) + 1)) if len(wave) > len(out) else 0
            mixed += np.resize(wave[start:], len(out)) if len(wave) else 0.0
            facts["noise_ids"].append(asset["id"])
            facts["noise_scenes"].append(asset.get("scene", asset["id"]))
        level = lambda y: np.sqrt(np.mean(y**2) + 1e-12) if len(y) else 0.0
        if len(out) and np.any(mixed):
            out = out + mixed * (level(out) / level(mixed) / 10 ** (facts["snr_db"] / 20))
    facts["gain_db"] = uniform(own["level"]["gain_db"])
    out = out * 10 ** (facts["gain_db"] / 20)
    clipping = own["level"].get("clipping", {})
    facts["clipped_fraction"] = facts["clip_level"] = None
    if clipping.get("enabled") and random.random() < clipping.get("probability", 0.0):
        facts["clip_level"] = limit = uniform(clipping.get("threshold", (0.8, 0.98)))
        facts["clipped_fraction"] = float(np.mean(np.abs(out) > limit)) if len(out) else 0.0
        out = np.clip(out, -limit, limit)
    facts["codec"] = codec = drawn(random, own["codec_distribution"])["codec"]
    path = CODEC_PATHS.get(codec, "drawn")
    facts["channel_path"] = path = drawn(random, own["channel"].get("paths", [{"path": "wide"}]))["path"] if path == "drawn" else path
    low, high, channel = BANDS[path]
    facts["channel_sample_rate"], facts["channel_bandpass_hz"] = channel, (low, high)
    if codec not in known:
        raise ValueError(f"no codec {codec} is given")
    network = own.get("network_impairment", {})
    lossy = bool(network.get("enabled", True)) and random.random() < network.get("probability", 0.0)
    wave = bandpass(resample(out, model, channel), channel, low, high)
    peak = np.abs(wave).max() if len(wave) else 0.0
    facts["guard_scale"] = guard = 0.99 / peak if peak > 0.99 else 1.0
    wave = known[codec](wave * guard, channel)
    facts["observed_loss"] = 0.0
    if lossy:
        rates = network["loss_rate_buckets"]
        loss = uniform(rates[int(random.integers(len(rates)))])
        burst = int(random.integers(network["burst_length"][0], network["burst_length"][1] + 1))
        frame = max(1, channel * int(network.get("frame_ms", 20)) // 1000)
        wave, facts["observed_loss"] = drop_frames(wave, burst_mask(-(-len(wave) // frame), loss, burst, random), frame)
    out = resample(wave, channel, model)
    out = np.pad(out[: len(clean)], (0, max(0, len(clean) - len(out))))
    most = int(own.get("max_alignment_samples", 0))
    facts["lag"] = lag = alignment_lag(clean, out, most) if most and len(clean) else 0
    out = np.concatenate([out[lag:], np.zeros(lag)]) if lag > 0 else np.concatenate([np.zeros(-lag), out[: len(out) + lag]])
    target = aligned_target(x, rate, len(out), model, (low, high), channel)
    peak = max((np.abs(y).max() for y in (out, target) if len(y)), default=0.0)
    facts["normalization_scale"] = scale = float(own.get("pair_peak", 0.5)) / peak if peak > float(own.get("pair_peak", 0.5)) else 1.0
    return out * scale, target * scale, facts


#: Codecs of each channel path and the drawn ones' weights.
CODECS = (("g711_alaw", "narrow"), ("g711_mulaw", "narrow"), ("pass_through", "wide"))
BANDS = {"narrow": (300.0, 3400.0, 8000), "wide": (50.0, 7000.0, 16000)}


def degrade(x: np.ndarray, noise: np.ndarray | None, rate: int, seed: int) -> tuple[np.ndarray, dict]:
    """One seeded variant of a clip: noise at a drawn level, gain, clipping, channel band, codec, frame loss, peak safety.

    The draws come in this order from one generator, each whether or not it is used, so equal seeds give equal variants.
    Codecs that need external programs are left to a converter given by the caller.
    """
    random = np.random.default_rng(seed)
    use_noise, snr, offset = random.random() < 0.6, random.uniform(0, 30), random.random()
    gain, codec = random.uniform(-6, 6), CODECS[int(random.integers(len(CODECS)))]
    loss, burst = random.uniform(0.003, 0.1), random.uniform(1, 5)
    out = np.array(x, float)
    facts: dict = {"seed": seed, "codec": codec[0], "target_bandwidth": codec[1], "gain_db": gain, "snr_db": None}
    if noise is not None and len(noise) and use_noise:
        start = int(offset * len(noise))
        own = np.resize(np.roll(noise, -start), len(out))
        level = np.sqrt((out @ out) / len(out) + 1e-12) / (np.sqrt((own @ own) / len(own) + 1e-12) * 10 ** (snr / 20))
        out, facts["snr_db"] = out + own * level, snr
    out = np.clip(out * 10 ** (gain / 20), -1, 1)
    low, high, channel = BANDS[codec[1]]
    out = resample(resample(bandpass(out, rate, low, high), rate, channel), channel, rate)[: len(x)]
    out = np.pad(out, (0, len(x) - len(out)))
    out = a_law(out) if codec[0] == "g711_alaw" else mu_law(out) if codec[0] == "g711_mulaw" else out
    frame = max(1, rate // 50)
    out, facts["observed_loss"] = drop_frames(out, burst_mask(-(-len(out) // frame), loss, burst, random), frame)
    peak = np.abs(out).max() if len(out) else 0.0
    facts["normalization_scale"] = 0.99 / peak if peak > 0.99 else 1.0
    return out * facts["normalization_scale"], facts
