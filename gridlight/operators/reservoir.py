"""A simulated chain of interacting two-level atoms as a feature map: NumPy kernel, no Spark needed to run it.

A state of n atoms is an array of 2 ** n amplitudes, atom 0 the highest bit, its real and imaginary parts apart, in single
precision unless the tolerance is finer. The Hamiltonian is real: a diagonal plus the sum of bit flips. Flips of up to GROUP neighbouring bits are one product with
a small matrix, so that a step of the expansion is a few matrix products on arrays that fit the cache. Steps are Chebyshev
expansions, whose coefficients come from a Fourier transform; all means of Z and ZZ come from one Walsh-Hadamard transform.
"""

from __future__ import annotations

import functools
import hashlib
import json
from dataclasses import asdict, dataclass

import numpy as np
from pyspark.sql import DataFrame

from gridlight.operators.noise import generator
from gridlight.operators.pca import map_vectors


#: Bits whose flips are one matrix.
GROUP = 6


# The chain and its driving.
@dataclass(frozen=True)
class Config:
    atoms: int = 18
    steps: int = 8
    dt: float = 0.5
    omega: float = 2 * np.pi
    detuning: float = 4.5
    gain: float = 9.0
    coupling: float = 5.42
    power: int = 6
    shots: int | None = None
    seed: int = 42
    tol: float = 1e-7

    @property
    def width(self) -> int:
        return self.steps * (self.atoms + self.atoms * (self.atoms - 1) // 2)

    @property
    def dtype(self) -> type:
        """Double precision only where the tolerance asks for more than single precision has."""
        return np.float32 if self.tol >= 1e-7 else np.float64

    def key(self) -> str:
        """A name for results of this configuration."""
        return hashlib.sha256(json.dumps(asdict(self), sort_keys=True).encode()).hexdigest()[:16]


@functools.lru_cache(maxsize=4)
def signs(n: int) -> np.ndarray:
    """Z of each atom in each state: +1 for bit 0, atom 0 at the highest bit."""
    states = np.arange(2**n)
    return np.stack([1.0 - 2.0 * ((states >> (n - 1 - i)) & 1) for i in range(n)])


@functools.lru_cache(maxsize=4)
def fixed_diagonal(cfg: Config) -> np.ndarray:
    """Detuning and pair terms; the constant of the pair terms, a global phase, is left out."""
    z, out = signs(cfg.atoms), 0.5 * cfg.detuning * signs(cfg.atoms).sum(0)
    for i in range(cfg.atoms):
        for j in range(i + 1, cfg.atoms):
            out += cfg.coupling / (j - i) ** cfg.power / 4 * (z[i] + z[j] + z[i] * z[j])
    return out


def data_diagonal(x: np.ndarray, cfg: Config) -> np.ndarray:
    return -0.5 * cfg.gain * (x @ signs(cfg.atoms))


@functools.lru_cache(maxsize=8)
def flip_matrix(bits: int) -> np.ndarray:
    """1 where two states of a group of bits differ in one bit."""
    states = np.arange(2**bits)
    return np.bitwise_count(states[:, None] ^ states) == 1


def flips(psi: np.ndarray, n: int, scale: float, out: np.ndarray, spare: np.ndarray) -> np.ndarray:
    """``scale`` times the sum over atoms of the states with that atom's bit flipped; psi is planes x 2 ** n."""
    planes, low, first = len(psi), 0, True
    while low < n:
        bits = min(GROUP, n - low)
        matrix = flip_matrix(bits).astype(psi.dtype) * psi.dtype.type(scale)
        shape = (planes << (n - low - bits), 2**bits, 2**low)
        into = out if first else spare
        if low:
            np.matmul(matrix, psi.reshape(shape), out=into.reshape(shape))
        else:
            np.matmul(psi.reshape(shape[:2]), matrix, out=into.reshape(shape[:2]))
        if not first:
            out += spare
        low, first = low + bits, False
    return out


def chebyshev(width: np.ndarray, tol: float) -> np.ndarray:
    """Coefficients of exp(-i w cos t) in cos(k t), per column w; terms after the last one above tol are left out."""
    n = 1 << int(np.ceil(np.log2(2 * (width.max() + 40))))
    t = 2 * np.pi * np.arange(n) / n
    c = np.fft.fft(np.exp(-1j * np.cos(t)[:, None] * width[None, :]), axis=0)[: n // 2] / n
    c[1:] *= 2
    large = np.flatnonzero(np.abs(c).max(1) > tol)
    return c[: large[-1] + 1 if len(large) else 1]


def walsh(p: np.ndarray, n: int) -> np.ndarray:
    """The Walsh-Hadamard transform of 2 ** n numbers, in place."""
    for i in range(n):
        pair = p.reshape(2**i, 2, -1)
        a, b = pair[:, 0], pair[:, 1]
        a += b
        b *= -2
        b += a
    return p


def evolve(diagonal: np.ndarray, cfg: Config):
    """Probabilities of all states after each step, from the state of all bits 0. The spectral bounds are the row's own."""
    n = cfg.atoms
    high, low = diagonal.max() + n * cfg.omega, diagonal.min() - n * cfg.omega
    centre, half = (high + low) / 2, (high - low) / 2
    c = chebyshev(np.array([half * cfg.dt]), cfg.tol)[:, 0]
    kind = cfg.dtype
    twice, scale = (2 * (diagonal - centre) / half).astype(kind), 2 * cfg.omega / half
    now, before, spare, total, psi = (np.zeros((2, 2**n), kind) for _ in range(5))
    psi[0, 0] = 1
    after = np.empty_like(now)

    def add(k: int, state: np.ndarray) -> None:
        """Coefficients are real for even k and imaginary for odd k; the phase of the centre has no effect on probabilities."""
        if k % 2:
            np.multiply(state[::-1], np.array([[-c[k].imag], [c[k].imag]], kind), out=spare)
        else:
            np.multiply(state, kind(c[k].real), out=spare)
        np.add(total, spare, out=total)

    for _ in range(cfg.steps):
        total[:] = 0
        before[:] = psi
        add(0, before)
        for k in range(1, len(c)):
            # T1 = H, and T(k + 1) = 2 H T(k) - T(k - 1), with H in scaled units
            source = before if k == 1 else now
            flips(source, n, scale, after, spare)
            np.multiply(source, twice, out=spare)
            after += spare
            if k == 1:
                after *= 0.5
                now, after = after, now
            else:
                after -= before
                before, now, after = now, after, before
            add(k, now)
        psi[:] = total
        p = (psi.astype(np.float64) ** 2).sum(0)
        yield p / p.sum()


def embed(x: np.ndarray, cfg: Config, keys=None) -> np.ndarray:
    """Rows in 0..1 to rows of cfg.width: per step all <Z_i>, then all <Z_i Z_j>, i < j. A row's result does not depend on the
    rows beside it."""
    n = cfg.atoms
    masks = [1 << (n - 1 - i) for i in range(n)] + [(1 << (n - 1 - i)) | (1 << (n - 1 - j)) for i in range(n) for j in range(i + 1, n)]
    out = np.empty((len(x), cfg.width))
    for r, row in enumerate(x):
        draw = generator(cfg.seed, keys[r] if keys is not None else r) if cfg.shots else None
        steps = []
        for p in evolve(fixed_diagonal(cfg) + data_diagonal(row, cfg), cfg):
            steps.append(walsh(draw.multinomial(cfg.shots, p) / cfg.shots if draw else p, n)[masks])
        out[r] = np.concatenate(steps)
    return out


def reservoir(df: DataFrame, vector: str, out: str = "embedding", cfg: Config | None = None) -> DataFrame:
    """df with the features of a vector column of cfg.atoms numbers in 0..1; a worker holds one state at a time."""
    cfg = cfg or Config()
    return map_vectors(df, vector, out, lambda x: embed(x, cfg))
