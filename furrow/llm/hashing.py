"""Hashes of space-separated words, 128 bits as two lanes or 64 as one, and of word windows of many texts at once."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import xxhash

_SPACE = re.compile(rb"[\x20\x09-\x0D]")
#: Bytes whose words are held as Python objects at one time.
BLOCK = 1 << 20


def blocks(text: bytes, size: int = BLOCK) -> Iterator[bytes]:
    """A text in parts of about `size` bytes, cut at white space only."""
    at = 0
    while len(text) - at > size and (cut := _SPACE.search(text, at + size)):
        yield text[at : cut.start()]
        at = cut.end()
    yield text[at:] if at else text


def finish(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xFF51AFD7ED558CCD)
    return h ^ (h >> np.uint64(32))


class Words:
    """The words of several texts: a hash each and each text's range of words; with `spelled` also the words.

    Words are objects for one block of text at a time only: a very long text costs 8
    bytes a word and lane.
    """

    def __init__(self, texts: list[bytes], spelled: bool = False, n_lanes: int = 2):
        counts = np.zeros(len(texts) + 1, np.int64)
        flat: list[bytes] = []
        lanes, data, sizes, held = [], [], [], 0

        def flush():
            if n_lanes == 2:
                lanes.append(np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, flat)), np.uint64).reshape(-1, 2).T.copy())
            else:
                lanes.append(np.fromiter(map(xxhash.xxh3_64_intdigest, flat), np.uint64, len(flat))[None])
            if spelled:
                data.append(b" ".join(flat))
                sizes.append(np.fromiter(map(len, flat), np.int64, len(flat)))
            flat.clear()

        for i, text in enumerate(texts):
            for part in blocks(text):
                words = part.split()
                counts[i + 1] += len(words)
                flat += words
                held += len(part)
                if held > BLOCK:
                    flush()
                    held = 0
        flush()
        self.lanes = np.concatenate(lanes, axis=1)
        self.bounds = np.cumsum(counts)
        if spelled:
            self.data = b" ".join(x for x in data if x)
            size = np.concatenate(sizes)
            self.ends = np.cumsum(size + 1) - 1
            self.starts = self.ends - size

    def windows(self, n: int, lane: int = 0) -> np.ndarray:
        """Hash of the n words from each word on; those that run into the next text are meaningless."""
        h = self.lanes[lane]
        m = max(0, len(h) - n + 1)
        total = np.zeros(m, np.uint64)
        for k in range(n):
            total *= np.uint64(0x9E3779B97F4A7C15)
            total += h[k : k + m]
        return finish(total)
