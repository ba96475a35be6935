"""Vectorised 64-bit hashes of the words of a batch of texts."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

LOWERED = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
BYTES = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64)
P, Q = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
#: Bytes whose sums are taken at once.
BLOCK = 1 << 16
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def mixed(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(32))) * Q
        h = (h ^ (h >> np.uint64(29))) * P
        return h ^ (h >> np.uint64(32))


@lru_cache(16)
def powers(base: int, n: int) -> np.ndarray:
    """The first ``n`` powers of a number, modulo 2^64."""
    return np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(n - 1, base % 2**64, np.uint64))))


def lowered(texts: list[str | None]) -> list[bytes]:
    """UTF-8 with A-Z lower-cased; null is empty."""
    return [b"" if t is None else t.encode("utf-8", "surrogatepass").translate(LOWERED) for t in texts]


class Words:
    """The words of a batch of texts: bytes, where each word begins and ends, and the number of its text."""

    def __init__(self, raw: list[bytes]):
        self.data = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
        edges = np.cumsum([len(r) + 1 for r in raw], dtype=np.int64)
        self.inside = ~_SPACE[self.data]
        turn = np.flatnonzero(np.diff(np.concatenate(([False], self.inside))))
        self.begin, self.end = turn[::2], turn[1::2]  # the last byte is a line feed, so every word ends
        self.text = np.searchsorted(edges, self.begin, "right")

    def hashes(self, *tables: np.ndarray) -> list[np.ndarray]:
        """Of each word, for each table: its bytes' random values times powers of an odd number by place, mixed.

        That is the difference of two sums over all bytes before its end and its begin, turned back to the first place.
        """
        base, blocks = int(P), len(self.data) // BLOCK + 1
        up, down = powers(base, BLOCK), powers(pow(base, -1, 2**64), BLOCK)
        ups, downs = (powers(pow(base, sign * BLOCK, 2**64), blocks) for sign in (1, -1))
        back, out = down[self.begin % BLOCK] * (downs[self.begin // BLOCK] * P), []
        for table in tables:
            sums = np.zeros(len(self.data) + 1, np.uint64)
            for i, lift in enumerate(ups):
                own = table[self.data[i * BLOCK : (i + 1) * BLOCK]]
                own *= up[: len(own)]
                own *= lift
                np.cumsum(own, out=own)
                np.add(own, sums[i * BLOCK], out=sums[i * BLOCK + 1 : i * BLOCK + 1 + len(own)])
            out.append(mixed((sums[self.end] - sums[self.begin]) * back))
        return out


def word_hashes(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every word of every text, in order, and the number of the text that each is in."""
    w = Words(raw)
    return w.hashes(BYTES)[0], w.text
