"""CRC-32 of word n-grams from the CRCs of their words, in GF(2) algebra.

The CRC of A + B is the CRC of A, moved on by as many zero bytes as B has, xor the
CRC of B. Moving on by n bytes is a linear map of 32 bits; it is applied as four
look-ups of 256 entries for each length, made from the map's 32 basis images. So
each word's CRC is computed once and no n-gram is ever written out as a string.
"""

from __future__ import annotations

import zlib

import numpy as np

#: Words up to this many bytes go through the byte loop side by side; longer ones are hashed one by one.
_SIDE_BY_SIDE = 48
#: Lengths below this have their own look-ups; a longer one is put together from powers of two of it.
_DIRECT = 64

_bits = np.arange(256, dtype=np.uint32)
for _ in range(8):
    _bits = np.where(_bits & 1, (_bits >> 1) ^ np.uint32(0xEDB88320), _bits >> 1)
#: What a byte does to a CRC.
BYTE = _bits


def _lookups(basis: np.ndarray) -> np.ndarray:
    """Four tables of 256 entries that apply the linear map with these 32 basis images."""
    out = np.zeros((4, 256), np.uint32)
    for byte in range(4):
        for bit in range(8):
            out[byte, 1 << bit : 2 << bit] = out[byte, : 1 << bit] ^ basis[8 * byte + bit]
    return out


def _apply(tables: np.ndarray, x: np.ndarray) -> np.ndarray:
    return tables[0][x & 255] ^ tables[1][(x >> 8) & 255] ^ tables[2][(x >> 16) & 255] ^ tables[3][x >> 24]


def _build() -> tuple[np.ndarray, list[np.ndarray]]:
    basis = np.uint32(1) << np.arange(32, dtype=np.uint32)
    direct = [_lookups(basis)]
    for _ in range(_DIRECT):
        basis = (basis >> 8) ^ BYTE[basis & 255]
        direct.append(_lookups(basis))
    doubled = [direct[_DIRECT]]
    for _ in range(26):
        basis = _apply(doubled[-1], basis)
        doubled.append(_lookups(basis))
    return np.ascontiguousarray(np.stack(direct[:_DIRECT], 1)).reshape(4, -1), doubled


_SHORT, _LONG = _build()


def moved_on(crc: np.ndarray, n: np.ndarray) -> np.ndarray:
    """CRCs after n more zero bytes each, without the bytes."""
    at = (n & (_DIRECT - 1)) << 8
    out = _SHORT[0][at + (crc & 255)] ^ _SHORT[1][at + ((crc >> 8) & 255)] ^ _SHORT[2][at + ((crc >> 16) & 255)] ^ _SHORT[3][at + (crc >> 24)]
    rest, power = n >> 6, 0
    while rest.any():
        own = np.flatnonzero(rest & 1)
        out[own] = _apply(_LONG[power], out[own])
        rest, power = rest >> 1, power + 1
    return out


def crc_of(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-32 of raw[start:end] for every pair."""
    size = ends - starts
    out = np.full(len(starts), 0xFFFFFFFF, np.uint32)
    order = np.argsort(-np.minimum(size, _SIDE_BY_SIDE + 1), kind="stable")
    order = order[np.searchsorted(-size[order], -_SIDE_BY_SIDE) :] if len(order) and size.max() > _SIDE_BY_SIDE else order
    ascending = size[order][::-1]
    for k in range(int(ascending[-1]) if len(order) else 0):
        own = order[: len(order) - np.searchsorted(ascending, k, "right")]
        now = out[own]
        out[own] = (now >> 8) ^ BYTE[(now ^ raw[starts[own] + k]) & 255]
    out ^= np.uint32(0xFFFFFFFF)
    for i in np.flatnonzero(size > _SIDE_BY_SIDE):
        out[i] = zlib.crc32(raw[starts[i] : ends[i]])
    return out


def ngram_crcs(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, row: np.ndarray, longest: int = 3) -> list[tuple[np.ndarray, np.ndarray]]:
    """For n = 1..longest: the words that begin an n-gram of their row, and the CRC of the n words joined by one space."""
    size = ends - starts
    word = crc_of(raw, starts, ends)
    spaced = moved_on(np.full(len(word), zlib.crc32(b" "), np.uint32), size) ^ word
    at, crc = np.arange(len(word)), word
    out = [(at, crc)]
    for n in range(1, longest):
        own = np.flatnonzero(at + n < len(word))
        own = own[row[at[own] + n] == row[at[own]]]
        at, nxt = at[own], at[own] + n
        crc = moved_on(crc[own], size[nxt] + 1) ^ spaced[nxt]
        out.append((at, crc))
    return out
