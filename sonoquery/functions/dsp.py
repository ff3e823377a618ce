"""Numpy kernels for Arrow functions on waveforms: what array expressions can't do at length.

A waveform is a float64 array.  Nothing is changed in place.
"""

from __future__ import annotations

import io
import math
import struct
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np

EPS = 1e-12
SPEED_OF_SOUND = 343.0


@dataclass(frozen=True)
class Source:
    """A dry clip, the response from its place, and the distance."""

    clip: np.ndarray
    response: np.ndarray
    distance: float
    offset_ms: float = 0.0


def direct_sample(response: np.ndarray, distance: float, sr: int, window_ms: float = 1.0) -> int:
    centre, reach = round(distance / SPEED_OF_SOUND * sr), round(sr * window_ms / 1000)
    low = max(0, centre - reach)
    window = np.abs(response[low : max(low, centre + reach + 1)])
    if not window.size:
        raise ValueError("the search window for the direct sound is outside the response")
    return low + int(window.argmax())


def drr_db(response: np.ndarray, distance: float, sr: int, half_window_ms: float = 1.25) -> float:
    at, half = direct_sample(response, distance, sr), round(sr * half_window_ms / 1000)
    near = response[max(0, at - half) : at + half + 1]
    direct = float(near @ near)
    rest = max(float(response @ response) - direct, 0.0)
    return 10 * math.log10((direct + EPS) / (rest + EPS))


def trimmed(response: np.ndarray, distance: float, sr: int, lead_ms: float = 1.0) -> np.ndarray:
    return response[max(0, direct_sample(response, distance, sr) - round(sr * lead_ms / 1000)) :]


def convolution(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Full linear convolution by FFT."""
    n = len(a) + len(b) - 1
    if n <= 0 or not len(a) or not len(b):
        return np.zeros(0)
    size = 1 << (n - 1).bit_length()
    return np.fft.irfft(np.fft.rfft(a, size) * np.fft.rfft(b, size), size)[:n]


def looped(clip: np.ndarray, length: int, offset_ms: float, sr: int) -> np.ndarray:
    if not len(clip):
        raise ValueError("an empty clip can't be looped")
    return clip[(round(offset_ms * sr / 1000) + np.arange(length)) % len(clip)]


def activity(speech: np.ndarray, sr: int, frame_ms: float = 25.0, threshold: float = 0.01) -> np.ndarray:
    """Samples in frames whose mean square reaches a share of the largest."""
    n = int(sr * frame_ms / 1000)
    first = np.arange(0, len(speech), n)
    length = np.minimum(len(speech) - first, n)
    powers = np.add.reduceat(speech**2, first) / length
    return np.repeat(powers >= threshold * (powers.max() + EPS), length)


def mean_power(signal: np.ndarray, mask: np.ndarray) -> float:
    if not mask.any():
        raise ValueError("the mask selects no sample")
    return float(np.square(signal[mask]).mean())


def ratio_db(speech_power: float, noise_power: float) -> float:
    ratio = speech_power / (noise_power + EPS)
    return 10 * math.log10(ratio) if ratio > 0 else -math.inf


def pink(n: int, rng: np.random.Generator) -> np.ndarray:
    """Noise with a 1/f power spectrum, without offset and of unit deviation."""
    if n < 2:
        raise ValueError("pink noise needs two samples at least")
    bins = n // 2 + 1
    real, imaginary = rng.standard_normal(bins), rng.standard_normal(bins)
    shape = np.zeros(bins)
    shape[1:] = np.fft.rfftfreq(n)[1:] ** -0.5
    wave = np.fft.irfft((real + 1j * imaginary) * shape, n)
    return wave / (wave.std() + EPS)


@dataclass(frozen=True)
class Room:
    """What of a scene doesn't depend on the target ratio."""

    speech: np.ndarray
    noise: np.ndarray
    pink: np.ndarray
    mask: np.ndarray
    speech_drr: float
    noise_drrs: tuple[float, ...]

    def gain(self, target_db: float) -> float:
        now = ratio_db(mean_power(self.speech, self.mask), mean_power(self.noise, self.mask))
        return 10 ** ((now - target_db) / 20)

    def statistics(self) -> tuple[float, float, float, float]:
        """Powers of speech, noise and pink noise, and the mean product of the noises, where speech is active."""
        m = self.mask
        return mean_power(self.speech, m), mean_power(self.noise, m), mean_power(self.pink, m), float((self.noise[m] * self.pink[m]).mean())


def room(speech: Source, noises: Sequence[Source], sr: int, pink_db: float, rng: np.random.Generator) -> Room:
    """Speech and noises as they arrive; the noises run before the speech begins, so that their tails are there."""
    if not noises:
        raise ValueError("a scene needs a noise source")
    heard = convolution(speech.clip, trimmed(speech.response, speech.distance, sr))
    total = np.zeros(len(heard))
    for source in noises:
        lead = len(source.response) - 1
        level = math.sqrt(float(np.square(source.clip).mean())) if len(source.clip) else 0.0
        dry = looped(source.clip / (level + EPS), lead + len(heard), source.offset_ms, sr)
        total = total + convolution(dry, trimmed(source.response, source.distance, sr))[lead : lead + len(heard)]
    mask = activity(heard, sr)
    bed = math.sqrt(mean_power(heard, mask)) * 10 ** (-pink_db / 20) * pink(len(heard), rng)
    return Room(heard, total, bed, mask, drr_db(speech.response, speech.distance, sr), tuple(drr_db(s.response, s.distance, sr) for s in noises))


@dataclass(frozen=True)
class Mix:
    audio: np.ndarray
    final_snr_db: float
    scale: float

    @property
    def clipped(self) -> bool:
        return self.scale != 1.0


def mixed(scene: Room, target_db: float, limit: float = 0.99) -> Mix:
    """Speech and noise at the target ratio, scaled as a whole if the peak is above the limit."""
    noise = scene.gain(target_db) * scene.noise + scene.pink
    audio = scene.speech + noise
    peak = float(np.abs(audio).max())
    scale = limit / peak if peak > limit else 1.0
    final = ratio_db(mean_power(scale * scene.speech, scene.mask), mean_power(scale * noise, scene.mask))
    return Mix(scale * audio, final, scale)


def resampled(wave: np.ndarray, rate: int, wanted: int, half_width: int = 10, beta: float = 5.0) -> np.ndarray:
    """``wave`` at another rate: a Kaiser-windowed sinc low-pass between the grids, zero phase.

    The filter's shape follows the usual defaults; results agree with other
    implementations to a tolerance, not in each bit.
    """
    if rate == wanted or not len(wave):
        return wave
    g = math.gcd(rate, wanted)
    up, down = wanted // g, rate // g
    most = max(up, down)
    reach = half_width * most
    t = np.arange(-reach, reach + 1)
    taps = np.sinc(t / most) * np.kaiser(2 * reach + 1, beta)
    taps *= up / taps.sum()
    n = -(-len(wave) * up // down)
    spread = np.zeros((len(wave) - 1) * up + 1)
    spread[::up] = wave
    full = convolution(spread, taps)[reach:]
    out = np.zeros(n)
    picked = full[: n * down : down][:n]
    out[: len(picked)] = picked
    return out


def c50_db(response: np.ndarray, direct: int, sr: int) -> float:
    split = direct + int(0.05 * sr)
    early, late = float(np.square(response[direct:split]).sum()), float(np.square(response[split:]).sum())
    return 10 * math.log10(early / late) if early > 0 and late > 0 else math.nan


def t30_s(response: np.ndarray, direct: int, sr: int) -> float:
    left = np.cumsum(np.square(response[direct:])[::-1])[::-1]
    if not left.size or left[0] <= 0:
        return math.nan
    fall = 10 * np.log10(np.maximum(left / left[0], 1e-20))
    if fall[-1] > -35.0 and fall.min() > -35.0:
        return math.nan
    return float(2 * (np.argmax(fall <= -35.0) - np.argmax(fall <= -5.0)) / sr)


def wav_bytes(wave: np.ndarray, sr: int, subtype: str = "PCM_16") -> bytes:
    """A mono WAV file; the level isn't touched."""
    if subtype == "PCM_16":
        code, width = 1, 2
        data = np.clip(np.rint(np.asarray(wave, np.float32).astype(np.float64) * 32767), -32768, 32767).astype("<i2").tobytes()
    elif subtype == "FLOAT":
        code, width = 3, 4
        data = np.asarray(wave, "<f4").tobytes()
    else:
        raise ValueError(f"unknown subtype {subtype}")
    form = struct.pack("<HHIIHH", code, 1, sr, sr * width, width, 8 * width)
    body = b"WAVEfmt " + struct.pack("<I", len(form)) + form + b"data" + struct.pack("<I", len(data)) + data
    return b"RIFF" + struct.pack("<I", len(body)) + body


def _wav_parts(data: bytes) -> tuple[int, int, int, int, memoryview]:
    """Format code, channels, rate, bits and samples of a WAV file."""
    file = io.BytesIO(data)
    if file.read(4) != b"RIFF" or not file.read(4) or file.read(4) != b"WAVE":
        raise ValueError("not a WAV file")
    form = None
    while head := file.read(8):
        name, size = struct.unpack("<4sI", head)
        if name == b"fmt ":
            code, channels, rate, _, _, bits = struct.unpack("<HHIIHH", (block := file.read(size))[:16])
            form = struct.unpack("<H", block[24:26])[0] if code == 0xFFFE else code, channels, rate, bits
        elif name == b"data" and form:
            return *form, memoryview(data)[file.tell() : file.tell() + size]
        else:
            file.seek(size + size % 2, 1)
    raise ValueError("a WAV file without samples")


def wav_read(data: bytes) -> tuple[np.ndarray, int]:
    """Samples (float64, channels averaged) and rate."""
    code, channels, rate, bits, raw = _wav_parts(data)
    if code == 3:
        wave = np.frombuffer(raw, f"<f{bits // 8}").astype(np.float64)
    elif code == 1 and bits in (16, 32):
        wave = np.frombuffer(raw, f"<i{bits // 8}") / float(1 << bits - 1)
    elif code == 1 and bits == 8:
        wave = (np.frombuffer(raw, np.uint8) - 128.0) / 128
    elif code == 1 and bits == 24:
        b = np.frombuffer(raw, np.uint8)[: len(raw) // 3 * 3].reshape(-1, 3).astype(np.int32)
        wave = (b[:, 0] << 8 | b[:, 1] << 16 | b[:, 2] << 24) / float(1 << 31)
    else:
        raise ValueError(f"unsupported WAV format {code} with {bits} bits")
    return wave if channels == 1 else wave[: len(wave) // channels * channels].reshape(-1, channels).mean(1), rate


def wav_seconds(data: bytes) -> float:
    """Duration, from the header alone."""
    _, channels, rate, bits, raw = _wav_parts(data)
    return len(raw) // (channels * bits // 8) / rate
