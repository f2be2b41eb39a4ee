"""Causal Butterworth band-pass as second-order sections, chunk by chunk, and FIR decimation."""

from __future__ import annotations

import numpy as np


def butter_bandpass(low: float, high: float, rate: float, order: int = 4) -> np.ndarray:
    """Sections (order x 6: b0 b1 b2 a0 a1 a2) of a digital Butterworth band-pass: analog prototype, band transform, bilinear map."""
    warp = 2 * rate * np.tan(np.pi * np.array([low, high]) / rate)
    width, middle = warp[1] - warp[0], warp[0] * warp[1]
    prototype = np.exp(1j * np.pi * (2 * np.arange(1, order + 1) + order - 1) / (2 * order))
    half = prototype * width / 2
    root = np.sqrt(half**2 - middle)
    analog = np.concatenate([half + root, half - root])
    digital = (2 * rate + analog) / (2 * rate - analog)
    gain = np.real(width**order * (2 * rate) ** order / np.prod(2 * rate - analog))
    kept = sorted(digital[digital.imag > 0], key=abs)
    real = sorted(digital[np.abs(digital.imag) <= 1e-12].real)
    pairs = [(z, np.conj(z)) for z in kept] + list(zip(real[::2], real[1::2], strict=True))
    sections = np.array([[1, 0, -1, 1, -np.real(a + b), np.real(a * b)] for a, b in pairs], float)
    sections[0, :3] *= gain
    return sections


def unit_step_state(sections: np.ndarray) -> np.ndarray:
    """The state (sections x 2) in which a constant input of one gives a constant output."""
    out, level = [], 1.0
    for b0, b1, b2, _, a1, a2 in sections:
        dc = (b0 + b1 + b2) / (1 + a1 + a2)
        out.append([(dc - b0) * level, (b2 - a2 * dc) * level])
        level *= dc
    return np.array(out)


def sosfilt(sections: np.ndarray, x: np.ndarray, state: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Filter channels x times, any number of channels at once; ``state`` (sections x 2 x channels) is carried over and given back."""
    state = np.zeros((len(sections), 2, len(x))) if state is None else state.copy()
    y = np.array(x.T, float, order="C")
    for v in y:
        for s, (b0, b1, b2, _, a1, a2) in enumerate(sections):
            z = state[s]
            out = b0 * v + z[0]
            z[0] = b1 * v - a1 * out + z[1]
            z[1] = b2 * v - a2 * out
            v[:] = out
    return y.T, state


def decimation_taps(q: int) -> np.ndarray:
    """20 q + 1 taps of a Hamming-windowed low-pass with its cut-off at 1 / q of the Nyquist rate; they sum to one."""
    at = np.arange(-10 * q, 10 * q + 1)
    taps = np.sinc(at / q) * np.hamming(20 * q + 1)
    return taps / taps.sum()
