"""Sequence kernels on numpy arrays: bases as 0-3, hashes as unsigned 64-bit numbers.

All of a sequence's windows are computed together; nothing loops over bases but the
minimum over a window, which takes one pass for each place in the window.
"""

from __future__ import annotations

import numpy as np
import xxhash

U = np.uint64
# fixed values: IUPAC letters onto the four bases, and the multipliers of the public mixers
FOLD = {"A": 0, "R": 0, "W": 0, "M": 0, "D": 0, "H": 0, "V": 0, "N": 0, "C": 1, "Y": 1, "S": 1, "B": 1, "G": 2, "K": 2, "T": 3, "U": 3}
XXH_PRIMES = [0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5]
MURMUR = [0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53]
SPLITMIX = [0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB]
SEED = 0x8F3F73B5CF1C9ADE
STROBE_MASK = (1 << 64) - (1 << 26)
_TABLE = np.full(256, 255, np.uint8)
for _letter, _base in FOLD.items():
    _TABLE[ord(_letter)] = _TABLE[ord(_letter.lower())] = _base


def encode(seq: str) -> np.ndarray:
    """Bases of a sequence; a letter that is no IUPAC code is an error."""
    out = _TABLE[np.frombuffer(seq.encode("latin-1", "replace"), np.uint8)]
    if (out == 255).any():
        raise ValueError("not a nucleotide sequence")
    return out


def windows(bases: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Forward and reverse-complement codes, two bits a base, of all k-mers."""
    n = max(0, len(bases) - k + 1)
    fwd, rev = np.zeros(n, U), np.zeros(n, U)
    for j in range(k):
        b = bases[j : j + n].astype(U)
        fwd = (fwd << U(2)) | b
        rev |= (U(3) - b) << U(2 * j)
    return fwd, rev


def rotated(x: np.ndarray, by: int) -> np.ndarray:
    return (x << U(by)) | (x >> U(64 - by))


def packed_mix(x: np.ndarray) -> np.ndarray:
    """XXH64's round and finish for one 64-bit word, without a seed."""
    p1, p2, p3, p4, p5 = map(U, XXH_PRIMES)
    h = (p5 + U(8)) ^ (rotated(x * p2, 31) * p1)
    h = rotated(h, 27) * p1 + p4
    for shift, times in ((33, p2), (29, p3)):
        h = (h ^ (h >> U(shift))) * times
    return h ^ (h >> U(32))


def murmur_mix(x: np.ndarray) -> np.ndarray:
    """The finisher of MurmurHash3's 64-bit half."""
    for times in MURMUR:
        x = (x ^ (x >> U(33))) * U(times)
    return x ^ (x >> U(33))


def splitmix(x: np.ndarray) -> np.ndarray:
    x = x + U(SPLITMIX[0])
    for shift, times in ((30, SPLITMIX[1]), (27, SPLITMIX[2])):
        x = (x ^ (x >> U(shift))) * U(times)
    return x ^ (x >> U(31))


def xxh3(x: np.ndarray, seed: int) -> np.ndarray:
    """XXH3 with a seed of each word's eight bytes, little end first."""
    raw = np.ascontiguousarray(x, "<u8").tobytes()
    return np.array([xxhash.xxh3_64_intdigest(raw[i : i + 8], seed) for i in range(0, len(raw), 8)], U)


def smer_size(k: int) -> int:
    """Of the sizes from 4 to k - 2 that differ from k by an even number, so that a middle exists, the one nearest k - 16, or k - 2 for a k up to 16."""
    aim = k - 16 if k > 16 else k - 2
    fit = [s for s in range(4, k - 1) if (k - s) % 2 == 0]
    return min(fit, key=lambda s: (abs(s - aim), s), default=max(1, k - 2))


CHUNK = 1 << 20  # bases whose windows stand in memory at one time


def _chunks(bases: np.ndarray, overlap: int):
    """Consecutive stretches and their starts; each shares its last `overlap` bases with the next."""
    for at in range(0, max(1, len(bases) - overlap), CHUNK):
        yield at, bases[at : at + CHUNK + overlap]


def syncmers(bases: np.ndarray, k: int = 28) -> tuple[np.ndarray, np.ndarray]:
    """Hash and position of the k-mers whose middle s-mer has the least hash of their s-mers."""
    s = smer_size(k)
    span = k - s + 1
    hashes, places = [np.zeros(0, U)], [np.zeros(0, np.int64)]
    for start, part in _chunks(bases, k - 1):
        n = len(part) - k + 1
        if n < 1:
            continue
        smer = packed_mix(np.minimum(*windows(part, s)))
        least = smer[:n].copy()
        for j in range(1, span):
            np.minimum(least, smer[j : j + n], out=least)
        at = np.flatnonzero(smer[span // 2 : span // 2 + n] == least)
        hashes.append(packed_mix(np.minimum(*windows(part, k))[at]))
        places.append(at + start)
    return np.concatenate(hashes), np.concatenate(places)


def contents(bases: np.ndarray, k: int = 28, w_min: int = 12, w_max: int = 32) -> tuple[np.ndarray, np.ndarray]:
    """Content and position of the order-2 strobemers, in the order of their positions.

    A syncmer's partner is, of those w_min to w_max places on and near enough, the first
    whose hash differs in fewest of the low eight bits; without any, itself.
    """
    h, at = syncmers(bases, k)
    n = len(h)
    if not n:
        return h, at
    reach = min(k + w_max, 255)
    best, partner = np.full(n, 99, np.int16), np.arange(n)
    for step in range(max(1, w_min), max(1, w_min, w_max) + 1):
        if step >= n:
            break
        far = at[step:] - at[:-step] <= reach
        if not far.any():  # those farther on are farther off
            break
        bits = np.bitwise_count((h[step:] ^ h[:-step]) & U(255)).astype(np.int16)
        better = far & (bits < best[:-step])
        best[:-step][better] = bits[better]
        partner[:-step][better] = np.flatnonzero(better) + step
    main, rest = U(STROBE_MASK), U(~STROBE_MASK & (1 << 64) - 1)
    p = h[partner]
    both = [((a & main) | (b & rest)) & ~U(255) for a, b in ((h, p), (p, h))]
    return np.minimum(*both), at


def strobemers(bases: np.ndarray, k: int = 28, w_min: int = 12, w_max: int = 32) -> np.ndarray:
    """The strobemers' hashes, in the order of their positions."""
    return xxh3(contents(bases, k, w_min, w_max)[0], SEED >> (64 - 2 * k))


def minimizers(bases: np.ndarray, k: int = 15, w: int = 10) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Canonical code, position and strand of the leftmost least-ranked k-mer of each w, each once in a row."""
    codes, places, strands = [np.zeros(0, U)], [np.zeros(0, np.int64)], [np.zeros(0, np.int8)]
    last = -1
    for start, part in _chunks(bases, k + w - 2):
        fwd, rev = windows(part, k)
        if len(fwd) < w:
            continue
        code = np.minimum(fwd, rev)
        view = np.lib.stride_tricks.sliding_window_view(murmur_mix(code), w)
        at = np.arange(len(view)) + view.argmin(axis=1)
        at = at[np.flatnonzero(np.diff(at, prepend=last - start))]
        if len(at):
            last = int(at[-1]) + start
        codes.append(code[at])
        places.append(at + start)
        strands.append((fwd > rev)[at].astype(np.int8))
    return np.concatenate(codes), np.concatenate(places), np.concatenate(strands)
