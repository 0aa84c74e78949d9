"""A word BPE as a finite-state transducer over the bytes of a word.

The encoding of a prefix ends in exactly one token, and what comes before that token is the
encoding of the shorter prefix. So a prefix needs no more than this of its past: the last
bytes, as far as a token can still begin in them, and for each place among them the
last token there and how many tokens were emitted by then. Two neighbours may stand
side by side if merging their text gives these two tokens again, which their merge
trees decide. The states are finitely many and shared by all words that end alike.
"""

from __future__ import annotations

import json

#: Last bytes; last token before each of them and after all; tokens emitted there, relative to now.
State = tuple[bytes, tuple[int, ...], tuple[int, ...]]
START: State = (b"", (-1,), (0,))


def _bytes_of_names() -> dict[str, int]:
    """The byte that each printable character stands for in a byte-level vocabulary."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(256, 512))
    return {chr(b) if b in plain else chr(next(others)): b for b in range(256)}


class MergeMachine:
    def __init__(self, tokenizer_file: str):
        with open(tokenizer_file, encoding="utf-8") as source:
            model = json.load(source)["model"]
        suffix = model["end_of_word_suffix"]
        names = _bytes_of_names()
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        # tokens are numbered in the order in which merges make them, single bytes first
        number: dict[str, int] = {}
        for name in names:
            for token in (name, name + suffix):
                number[token] = len(number)
        self.left, self.right = list(range(len(number))), list(range(len(number)))
        self.merged: dict[tuple[int, int], int] = {}
        for a, b in pairs:
            if a + b not in number:
                number[a + b] = len(number)
                self.left.append(number[a])
                self.right.append(number[b])
            self.merged.setdefault((number[a], number[b]), number[a + b])
        self.inner: dict[bytes, int] = {}
        self.final: dict[bytes, int] = {}
        for token, k in number.items():
            last = token.endswith(suffix)
            text = bytes(names[c] for c in (token[: -len(suffix)] if last else token))
            (self.final if last else self.inner)[text] = k
        self.begun = {t[:n] for t in (*self.inner, *self.final) for n in range(1, len(t) + 1)}
        self.known: dict[tuple[int, int], bool] = {}

    def beside(self, a: int, b: int) -> bool:
        """Whether the text of tokens a and b is encoded as a, b again (-1: nothing before b)."""
        if a < 0:
            return True
        found = self.known.get((a, b))
        if found is None:
            found = self.known[a, b] = self._beside(a, b)
        return found

    def _beside(self, a: int, b: int) -> bool:
        # no pair along the seam may merge before both of its sides are whole
        limit = 1 << 60
        while self.merged.get((a, b), limit) >= limit:
            # undo the later token; a single byte can't be undone, then it is the other's turn
            for side in (0, 1) if a > b else (1, 0):
                whole, part = (a, self.right[a]) if side == 0 else (b, self.left[b])
                if part != whole:
                    limit = whole + side
                    a, b = (part, b) if side == 0 else (a, part)
                    break
            else:
                return True
        return False

    def step(self, state: State, byte: int) -> tuple[int, State]:
        """Tokens emitted (fewer than before counts below 0) and the state after one more byte."""
        past, tokens, counts = state
        text = past + bytes((byte,))
        for at in range(len(text)):
            token = self.inner.get(text[at:])
            if token is not None and self.beside(tokens[at], token):
                break
        else:
            raise ValueError("a byte that the vocabulary lacks")
        emitted = counts[at] + 1
        tokens, counts = (*tokens, token), (*(n - emitted for n in counts), 0)
        first = 0
        while first < len(text) and text[first:] not in self.begun:
            first += 1
        return emitted, (text[first:], tokens[first:], counts[first:])

    def finish(self, state: State) -> int:
        """Tokens emitted when the word ends here: its last token is one for word ends."""
        past, tokens, counts = state
        for at in range(len(past)):
            token = self.final.get(past[at:])
            if token is not None and self.beside(tokens[at], token):
                return counts[at] + 1
        if past or len(tokens) > 1:
            raise ValueError("a byte that the vocabulary lacks")
        return 0

    def count(self, word: bytes) -> int:
        """Tokens of one word."""
        n, state = 0, START
        for byte in word:
            emitted, state = self.step(state, byte)
            n += emitted
        return n + self.finish(state)
