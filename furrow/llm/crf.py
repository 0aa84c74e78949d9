"""A linear-chain conditional random field over words: features, training and decoding in numpy.

Labels are O, index 0, and kinds; a span is a run of words of one kind. A word's features
are its shape, its punctuation, counts of its characters and, where training saw it, the
word itself; labels see those of the word, the two before and the one after. Transitions
are free weights. Training maximises the penalised likelihood by gradient steps over all
examples at once. Decoding is exact and cheap: where a word's margin for O is more than
any pair of transitions can make up for, every best path has O there, so the sequence may
be cut; what is left between is decoded by Viterbi for all pieces in step.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np

#: Stands before, after and between sequences, twice.
EDGE = b""
#: Words whose features a label sees, by distance.
SEEN = (0, -1, -2, 1)
_PUNCT = re.compile(rb"^[!-/:-@\[-`{-~]+|[!-/:-@\[-`{-~]+$")
#: Letters and digits become the signs of a shape; bytes of other scripts count as small letters.
_SIGNS = bytes(88 if 65 <= b <= 90 else 120 if 97 <= b <= 122 or b >= 128 else 100 if 48 <= b <= 57 else b for b in range(256))
_AGAIN = re.compile(rb"([Xxd])\1+")
_SMALL = [b"x" * n for n in range(32)]
#: Letters at a word's end that count as a feature, and how often training must see those or a word.
TAIL, OFTEN = 5, 6


def core(word: bytes) -> tuple[int, int]:
    """Start and end of a word without the ASCII punctuation around it."""
    start, end = 0, len(word)
    for m in _PUNCT.finditer(word):
        if m.start() == 0:
            start = m.end()
        else:
            end = m.start()
    return start, max(start, end)


def signs(word: bytes) -> bytes:
    """X, x and d for capitals, other letters and digits; what else stays. Of long words the first 64 bytes and the length's first bits."""
    out = word.translate(_SIGNS)
    start, end = core(out)
    if start < end and word[start] >= 0x80:
        size = 2 if word[start] < 0xE0 else 3 if word[start] < 0xF0 else 4
        if word[start : start + size].decode(errors="ignore").isupper():
            out = out[:start] + b"X" + out[start + 1 :]
    if len(out) > 64:
        out = out[:64] + b"d" * (end - start).bit_length()
    return out


def spelling(word: bytes) -> tuple[bytes, bytes]:
    """What of a word counts by itself: its lower-case letters with the mark behind them, and the last few letters."""
    start, end = core(word)
    inner = word[start : min(end, start + 32)].lower() if end - start <= 32 else word[end - 32 : end].lower()
    return b"word=" + inner + word[end : end + 1], b"tail=" + inner[-TAIL:]


def shape_features(signed: bytes) -> list[bytes]:
    """Features of a word that its signs tell."""
    if signed == EDGE:
        return [b"edge"]
    start, end = core(signed)
    inner, n = signed[start:end], end - start
    shape = _AGAIN.sub(rb"\1", inner)
    digits = inner.count(b"d")
    out = [
        b"shape=" + shape[:9],
        b"length=%d" % min(n.bit_length(), 6),
        b"digits=%d" % min(digits, 12),
        b"before=" + signed[:start][-1:],
        b"after=" + signed[end:][:1],
        b"first=" + shape[:1],
    ]
    if digits and digits < n:
        out.append(b"mixed=%d" % min(n.bit_length(), 7))
    if n > 1 and inner.count(b"X") == n:
        out.append(b"capitals")
    return out


@dataclass
class Model:
    labels: tuple[str, ...]
    index: dict[bytes, int]
    #: weights[s][feature, label] for the s-th distance of SEEN.
    weights: np.ndarray
    moves: np.ndarray

    def key(self, word: bytes) -> tuple:
        """All that the scores of a word depend on."""
        if word.islower() and word.isalpha() and len(word) < 32:  # nothing around the letters
            return _SMALL[len(word)], self.words.get(word), self.tails.get(word[-TAIL:])
        inner, tail = spelling(word)
        return signs(word), self.index.get(inner), self.index.get(tail)

    def __post_init__(self):
        self.words, self.tails = ({f[5:]: k for f, k in self.index.items() if f.startswith(kind)} for kind in (b"word=", b"tail="))

    def emission(self, key: tuple) -> np.ndarray:
        """(distance, label): what a word of this key adds to the labels around it."""
        known = [k for k in (*map(self.index.get, shape_features(key[0])), *key[1:]) if k is not None]
        return self.weights[:, known].sum(axis=1)

    def slack(self) -> np.ndarray:
        """The most that transitions can gain by each label in place of O between any neighbours."""
        t = self.moves
        gain = (t[:, :, None] + t[None, :, :]) - (t[:, :1, None] + t[None, :1, :])
        return gain.max(axis=(0, 2))


def summed(seen: np.ndarray) -> np.ndarray:
    """Scores (word, label) from (word, distance, label) along one stream of words."""
    out = seen[:, 0].copy()
    for s, d in enumerate(SEEN[1:], 1):
        if d < 0:
            out[-d:] += seen[:d, s]
        else:
            out[:-d] += seen[d:, s]
    return out


def forced(scores: np.ndarray, slack: np.ndarray) -> np.ndarray:
    """Words that have O on every best path."""
    return (scores[:, :1] - scores[:, 1:] > slack[1:]).all(axis=1)


def viterbi(scores: np.ndarray, cut: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """Best labels of a stream of words with O at all cut places, which the first and the last are."""
    labels = np.zeros(len(scores), np.int8)
    stops = np.flatnonzero(cut)
    start, n = stops[:-1] + 1, np.diff(stops) - 1
    start, n = start[n > 0], n[n > 0]
    if not len(n):
        return labels
    order = np.argsort(-n, kind="stable")
    start, n = start[order], n[order]
    best, back = scores[start] + moves[0], []
    done = np.zeros(best.shape, best.dtype)
    for t in range(1, n[0]):
        live = int(np.searchsorted(-n, -t, "left"))  # pieces longer than t
        done[live : len(best)] = best[live:]
        step = best[:live, :, None] + moves[None]
        back.append(step.argmax(axis=1).astype(np.int8))
        best = step.max(axis=1) + scores[start[:live] + t]
    done[: len(best)] = best
    at = (done + moves[:, 0]).argmax(axis=1)
    for t in range(n[0] - 1, -1, -1):
        live = int(np.searchsorted(-n, -t, "left"))
        labels[start[:live] + t] = at[:live]
        if t:
            at[:live] = back[t - 1][np.arange(live), at[:live]]
    return labels


def train(examples: list[tuple[list[bytes], list[str]]], kinds: tuple[str, ...], steps: int = 70, rate: float = 0.25, penalty: float = 0.02) -> Model:
    """Fit to sequences of words and their kinds ("" for none)."""
    labels = ("", *kinds)
    words, gold, bounds = [EDGE, EDGE], [0, 0], []
    for some, kind in examples:
        bounds.append((len(words), len(some)))
        words += [*some, EDGE, EDGE]
        gold += [*(labels.index(k) for k in kind), 0, 0]
    often = Counter(f for word in words for f in spelling(word))
    each = [shape_features(signs(word)) + [f for f in spelling(word) if word and often[f] >= OFTEN] for word in words]
    index = {f: k for k, f in enumerate(sorted({f for some in each for f in some}))}
    rows = np.repeat(np.arange(len(words)), [len(some) for some in each])
    columns = np.array([index[f] for some in each for f in some])
    by_word = np.flatnonzero(np.diff(rows, prepend=-1))
    order = np.argsort(columns, kind="stable")
    by_feature = np.flatnonzero(np.diff(columns[order], prepend=-1))
    gold, n = np.array(gold), len(labels)
    start, size = map(np.array, zip(*bounds, strict=True))
    longest = int(size.max())
    place = np.minimum(start[:, None] + np.arange(longest), len(words) - 1)
    inside = np.arange(longest) < size[:, None]
    target = np.eye(n)[gold]
    weights, moves = np.zeros((len(SEEN), len(index), n)), np.zeros((n, n))
    state = [np.zeros_like(x) for x in (weights, weights, moves, moves)]
    lead, tail = np.concatenate([start - 1, (start + size - 1)]), np.concatenate([start, start + size])
    pair = np.zeros(len(words), bool)
    for a, m in bounds:
        pair[a : a + m - 1] = True
    pair = np.flatnonzero(pair)
    counted = np.zeros((n, n))
    np.add.at(counted, (gold[pair], gold[pair + 1]), 1)
    np.add.at(counted, (gold[lead], gold[tail]), 1)

    def logsum(x: np.ndarray, axis: int) -> np.ndarray:
        top = x.max(axis=axis, keepdims=True)
        return np.log(np.exp(x - top).sum(axis=axis)) + top.squeeze(axis)

    for step in range(1, steps + 1):
        e = summed(np.add.reduceat(weights[:, columns], by_word, axis=1).transpose(1, 0, 2))[place]
        ahead, behind = np.zeros(e.shape), np.zeros(e.shape)
        ahead[:, 0] = moves[0] + e[:, 0]
        for t in range(1, longest):
            ahead[:, t] = np.where(inside[:, t, None], logsum(ahead[:, t - 1, :, None] + moves, 1) + e[:, t], ahead[:, t - 1])
        behind[:, -1] = moves[:, 0]
        for t in range(longest - 2, -1, -1):
            behind[:, t] = np.where(inside[:, t + 1, None], logsum((behind[:, t + 1] + e[:, t + 1])[:, None] + moves, 2), moves[:, 0])
        total = logsum(ahead[:, -1] + moves[:, 0], 1)
        chance = np.where(inside[..., None], np.exp(ahead + behind - total[:, None, None]), 0)
        expected = np.zeros((n, n))
        for t in range(longest - 1):
            both = np.exp(ahead[:, t, :, None] + moves + (behind[:, t + 1] + e[:, t + 1])[:, None] - total[:, None, None])
            expected += (both * inside[:, t + 1, None, None]).sum(axis=0)
        expected[0] += chance[:, 0].sum(axis=0)
        expected[:, 0] += chance[np.arange(len(size)), size - 1].sum(axis=0)
        error = np.zeros((len(words), n))
        error[place[inside]] = target[place[inside]] - chance[inside]
        slope = np.zeros_like(weights)
        for s, d in enumerate(SEEN):
            moved = np.zeros_like(error)
            moved[max(0, d) : len(error) + min(0, d)] = error[max(0, -d) : len(error) - max(0, d)]
            slope[s] = np.add.reduceat(moved[rows[order]], by_feature, axis=0)
        for x, g, first, second in ((weights, slope - penalty * weights, *state[:2]), (moves, counted - expected - penalty * moves, *state[2:])):
            first += 0.1 * (g - first)
            second += 0.01 * (g * g - second)
            x += rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    return Model(labels, index, weights, moves)


class Decoder:
    """Labels of long streams of words; a table of the words met so far, begun anew at most_words."""

    def __init__(self, model: Model, most_words: int = 200_000):
        self.model, self.most = model, most_words
        self.moves, self.slack = model.moves.astype(np.float32), model.slack().astype(np.float32) + 1e-3
        self.clear()

    def clear(self) -> None:
        self.at: dict[bytes, int] = {}
        self.row_of: dict[tuple, int] = {}
        self.seen = np.zeros((1024, len(SEEN), len(self.model.labels)), np.float32)

    def row(self, word: bytes) -> int:
        key = self.model.key(word)
        row = self.row_of.get(key)
        if row is None:
            row = self.row_of[key] = len(self.row_of)
            if row == len(self.seen):
                self.seen = np.concatenate([self.seen, np.zeros_like(self.seen)])
            self.seen[row] = self.model.emission(key)
        return row

    def scores(self, words: list[bytes]) -> np.ndarray:
        if len(self.at) > self.most:
            self.clear()
        at = self.at
        for word in dict.fromkeys(words):
            if word not in at:
                at[word] = self.row(word)
        return summed(self.seen[np.fromiter(map(at.__getitem__, words), np.int64, len(words))])

    def decode(self, blocks: Iterable[list[bytes]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(places, labels) of all words that are not O in a stream given in blocks, which EDGEs begin and end."""
        held: list[bytes] = []
        base, context = 0, 0
        blocks = iter(blocks)
        block = next(blocks, None)
        while block is not None:
            held += block
            block = next(blocks, None)
            if not held:
                continue
            scores = self.scores(held)
            cut = forced(scores, self.slack)
            cut |= np.fromiter((w == EDGE for w in held), bool, len(held))
            cut[:context] = False
            stops = np.flatnonzero(cut)
            if block is not None:
                stops = stops[stops < len(held) - 1]  # the last word's scores want its next
            if not len(stops) or (block is not None and len(stops) < 2):
                continue
            first, last = stops[0], stops[-1]
            found = viterbi(scores[first : last + 1], cut[first : last + 1], self.moves)
            where = np.flatnonzero(found)
            if len(where):
                yield base + first + where, found[where]
            keep = max(0, last - 2)
            held, base, context = held[keep:], base + keep, last - keep


