"""Token counts by a finite-state transducer over bytes.

The tokenizer is compiled into one deterministic transducer: states are numbers, a
transition goes from a state over a class of bytes to a state and is annotated with
the tokens emitted. A state knows what the splitter has open (nothing, a run of letters, a
run of marks, an apostrophe that may begin a contraction) and, inside a run, the state of
the merges (see merges). Transitions are compiled when they are first met, from then
on they are rows of one hash table, and white space leads from every state back to the first.

The transducer reads bytes in the normal form of the tokenizer. ASCII and the letters of
Latin-1 are brought to it by tables. Words with other bytes (any script, controls) go through
the tokenizer's own normaliser, each different one once a slice, and run as texts of their own;
whether a character is a letter, a number or a mark is asked of the tokenizer's splitter
when it is first met. Only words with a special string's opening are left to the library.

Texts are cut into chunks of equal size wherever the cut falls. All chunks of a slice run
in lockstep, one byte of each a step. A chunk that begins inside a text starts behind its
first white space, where its state is known whatever came before: its state map is
constant there, and only the head before it depends on the state that the chunk is
entered with. The entering states are a prefix scan over those maps, and the heads
run in lockstep too. A chunk without white space (a long word, a text in a script without
spaces) has a map over its live states, those that the map of the chunk before may leave.
Such maps are grown in lockstep too, from a guess behind a short run-up, until no state is
new, and are composed pairwise, in as many steps as the logarithm of a chain's length.
"""

from __future__ import annotations

import os

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from furrow.llm.merges import START, MergeMachine
from furrow.llm.text import annotate, held

CHUNK_BYTES = 512
#: Transitions that a worker keeps; beyond it starts afresh.
MAX_TRANSITIONS = 800_000
#: Bytes before a chunk without white space from which its entering state is guessed.
RUN_UP = 48

_SPACE, _LETTER, _DIGIT, _MARK, _FOREIGN = range(5)
_KIND = np.full(256, _FOREIGN, np.uint8)
_KIND[[0x20, *range(0x09, 0x0E)]] = _SPACE
_KIND[0x30:0x3A] = _DIGIT
_KIND[[b for b in range(0x21, 0x7F) if not chr(b).isalnum()]] = _MARK
_KIND[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = _LETTER
#: Second bytes of letters of Latin-1 behind 0xC3: small ones, and capitals that are 0x20 less.
_SMALL, _CAPITAL = np.zeros(256, bool), np.zeros(256, bool)
_SMALL[[*range(0x9F, 0xB7), *range(0xB8, 0xC0)]] = True
_CAPITAL[[*range(0x80, 0x97), *range(0x98, 0x9F)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
#: One class for all digits and one for all white space; other bytes are their own.
_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[_KIND == _DIGIT], _CLASS[_KIND == _SPACE] = 0x30, 0x20
#: Contractions: letters after an apostrophe that complete one, and those that may.
_SHORT, _LONG = b"stmd", {ord("r"): ord("e"), ord("v"): ord("e"), ord("l"): ord("l")}
#: Above a byte: what it is part of, where that is no letter (0). The first byte of a number begins a word.
_IN_MARK, _IN_NUMBER, _NUMBER = 1 << 8, 2 << 8, 3 << 8
_BITS = 10


class CountTransducer:
    """States are numbers; 0 is the first, with nothing open."""

    def __init__(self, tokenizer_file: str, limit: int = MAX_TRANSITIONS):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.merges, self.limit = MergeMachine(tokenizer_file), limit
        #: What a character is, by code point; -1: not asked yet.
        self.kinds = np.full(0x110000, -1, np.int8)
        self.kinds[:0x80] = np.where(_KIND[:0x80] == _FOREIGN, _MARK, _KIND[:0x80])
        self.restart()

    def restart(self) -> None:
        self.names: list[tuple] = [("none", START)]
        self.states: dict[tuple, int] = {self.names[0]: 0}
        self.merges.known.clear()
        self.n = 0
        self._room(16)

    def _room(self, bits: int) -> None:
        self.shift = np.uint64(64 - bits)
        self.keys = np.full(1 << bits, -1, np.int64)
        self.to = np.zeros(1 << bits, np.int32)
        self.emits = np.zeros(1 << bits, np.int16)

    # --- compilation ----------------------------------------------------------

    def _end(self, name: tuple) -> int:
        """Tokens emitted when what is open ends here."""
        kind, state = name
        if kind == "none":
            return 0
        if kind == "apostrophe":
            return self.merges.count(b"'") + (self.merges.count(state) if state else 0)
        return self.merges.finish(state)

    def target(self, name: tuple, symbol: int) -> tuple[int, tuple]:
        """Tokens emitted on a byte in normal form, with what it is part of, and the state it leads to."""
        kind, state = name
        part, byte = symbol & ~0xFF, symbol & 0xFF
        if part in (_NUMBER, _IN_NUMBER):
            inside = part == _IN_NUMBER and kind == "number"
            emitted, now = self.merges.step(state if inside else START, byte)
            return emitted + (0 if inside else self._end(name)), ("number", now)
        what = _MARK if part == _IN_MARK else _LETTER if byte >= 0x80 else int(_KIND[byte])
        if what == _SPACE:
            return self._end(name), self.names[0]
        if what == _DIGIT:  # each is a word
            return self._end(name) + self.merges.count(b"0"), self.names[0]
        if kind == "apostrophe" and what == _LETTER:
            if not state and byte in _SHORT or state and _LONG[state[0]] == byte:
                return self.merges.count(b"'" + state + bytes((byte,))), self.names[0]
            if not state and byte in _LONG:
                return 0, (kind, bytes((byte,)))
            # no contraction: the mark is a word, its letters begin another
            emitted, now = self.merges.count(b"'"), START
            for b in (*state, byte):
                more, now = self.merges.step(now, b)
                emitted += more
            return emitted, ("letters", now)
        if kind == "apostrophe" and not state:  # a run of marks that begins with it
            first, now = self.merges.step(START, 0x27)
            more, now = self.merges.step(now, byte)
            return first + more, ("marks", now)
        run = "letters" if what == _LETTER else "marks"
        if kind == run:
            emitted, now = self.merges.step(state, byte)
            return emitted, (run, now)
        if byte == 0x27:
            return self._end(name), ("apostrophe", b"")
        emitted, now = self.merges.step(START, byte)
        return self._end(name) + emitted, (run, now)

    def _target(self, key: int) -> tuple[int, int]:
        """(state after, tokens emitted) of a (state, class) key, by numbers."""
        emitted, name = self.target(self.names[key >> _BITS], key & (1 << _BITS) - 1)
        number = self.states.setdefault(name, len(self.names))
        if number == len(self.names):
            self.names.append(name)
        return number, emitted

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def _compile(self, keys: list[int]) -> None:
        """Transitions of the given (state, class) keys as rows of the table."""
        if 2 * (self.n + len(keys)) > len(self.keys):
            old = self.keys >= 0
            rows = self.keys[old], self.to[old], self.emits[old]
            self._room(int(2 * (self.n + len(keys))).bit_length() + 1)
            self._insert(*rows)
        emitted, to = [], []
        for key in keys:
            number, more = self._target(key)
            emitted.append(more)
            to.append(number)
        self._insert(np.array(keys, np.int64), np.array(to, np.int32), np.array(emitted, np.int16))
        self.n += len(keys)

    def _insert(self, keys: np.ndarray, to: np.ndarray, emits: np.ndarray) -> None:
        at = self._slots(keys)
        while len(keys):
            # of those that want one free slot the first takes it, the others go on
            free = self.keys[at] < 0
            took = np.zeros(len(keys), bool)
            took[np.unique(at, return_index=True)[1]] = True
            took &= free
            self.keys[at[took]], self.to[at[took]], self.emits[at[took]] = keys[took], to[took], emits[took]
            keys, to, emits, at = (x[~took] for x in (keys, to, emits, at))
            at = (at + 1) & (len(self.keys) - 1)

    def _find(self, keys: np.ndarray) -> np.ndarray:
        """Table rows of keys, -1 for those not compiled."""
        at = self._slots(keys)
        found = self.keys[at]
        open_ = np.flatnonzero(found != keys)
        while len(open_):
            new = found[open_] < 0
            at[open_[new]] = -1
            open_ = open_[~new]
            at[open_] = (at[open_] + 1) & (len(self.keys) - 1)
            found[open_] = self.keys[at[open_]]
            open_ = open_[found[open_] != keys[open_]]
        return at

    def advance(self, states: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(states after, tokens emitted) of one byte of each."""
        keys = states.astype(np.int64) << _BITS | classes
        at = self._find(keys)
        if (missing := at < 0).any():
            self._compile(np.unique(keys[missing]).tolist())
            at = self._find(keys)
        return self.to[at], self.emits[at]

    # --- runs -----------------------------------------------------------------

    def run(self, classes: np.ndarray, starts: np.ndarray, ends: np.ndarray, states: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(state at its end, tokens emitted) of each range, all in lockstep."""
        order = np.argsort(starts - ends, kind="stable")
        at, state = starts[order], states[order].astype(np.int32)
        sizes, total = (ends - starts)[order], np.zeros(len(starts), np.int64)
        live = np.searchsorted(-sizes, -np.arange(1, int(sizes.max(initial=0)) + 1), side="right")
        for step, k in enumerate(live.tolist()):
            state[:k], emitted = self.advance(state[:k], classes[at[:k] + step])
            total[:k] += emitted
        back = np.argsort(order)
        return state[back], total[back]

    def _foreign(self, data: np.ndarray, raw: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the words that have a byte outside the alphabet."""
        kind = _KIND[data]
        bad = kind == _FOREIGN
        lead = np.flatnonzero((data[:-1] == 0xC3) & (_SMALL[data[1:]] | _CAPITAL[data[1:]]))
        bad[lead] = bad[lead + 1] = False
        bad[:-1] |= (data[:-1] == 0x3C) & (data[1:] == 0x7C)  # special strings begin <|
        space = np.flatnonzero(kind == _SPACE)
        nth = np.unique(np.searchsorted(space, np.flatnonzero(bad)))
        # the last byte of the data is white space
        return np.where(nth > 0, space[nth - 1] + 1, 0), space[nth]

    def _library(self, words: list[bytes]) -> list[int]:
        return [len(x) for x in self.tokenizer.encode_batch_fast([x.decode() for x in words], add_special_tokens=False)]

    def _symbols(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of the normal forms of words, each with a white space behind it, and their sizes."""
        normal = [self.tokenizer.normalizer.normalize_str(w.decode()) for w in words]
        joined = " ".join(normal) + " "
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        kinds = self.kinds[points]
        for point in np.unique(points[kinds < 0]).tolist():
            # alone between the runs of its kind: one run with a letter, a run of its own, words of their own, or nothing
            found = self.tokenizer.pre_tokenizer.pre_tokenize_str("a" + 2 * chr(point))
            self.kinds[point] = {2: _MARK, 3: _DIGIT}.get(len(found), _LETTER if found[0][1][1] == 3 else _SPACE)
        kinds = self.kinds[points]
        data = np.frombuffer(joined.encode(), np.uint8)
        widths = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
        kind, plain = np.repeat(kinds, widths), data < 0x80
        lead = np.zeros(len(data), bool)
        lead[np.cumsum(widths) - widths] = True
        out = np.where(plain, _CLASS[data], data).astype(np.uint16)
        out[(kind == _MARK) & ~(plain & (_KIND[data] == _MARK))] |= _IN_MARK
        number = (kind == _DIGIT) & ~plain
        out[number] |= np.where(lead[number], _NUMBER, _IN_NUMBER).astype(np.uint16)
        out[kind == _SPACE] = 0x20
        return out, np.fromiter((len(w.encode()) + 1 for w in normal), np.int64, len(normal))

    def count(self, texts: list[bytes], chunk: int = CHUNK_BYTES) -> np.ndarray:
        """Tokens of each text."""
        if max(self.n, len(self.names)) > self.limit:
            self.restart()
        raw = b" ".join(texts) + b" "
        sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        offsets = np.cumsum(sizes) - sizes
        data = np.frombuffer(raw, np.uint8)
        total = np.zeros(len(texts), np.int64)
        first, last = self._foreign(data, raw)
        lower = _LOWER[data]
        behind = np.flatnonzero((data[:-1] == 0xC3) & _CAPITAL[data[1:]]) + 1
        lower[behind] += 0x20
        classes = _CLASS[lower].astype(np.uint16)
        if len(first):
            # by text and word, so that a word's tokens count as often as the text has it
            of: dict[tuple[int, bytes], int] = {}
            for text, a, b in zip((np.searchsorted(offsets, first, side="right") - 1).tolist(), first.tolist(), last.tolist(), strict=True):
                word = raw[a:b]
                of[text, word] = of.get((text, word), 0) + 1
            words = sorted({w for _, w in of})
            place = {w: i for i, w in enumerate(words)}
            text, word, n = (np.fromiter(x, np.int64, len(of)) for x in ((t for t, _ in of), (place[w] for _, w in of), of.values()))
            special = np.fromiter((b"<|" in w for w in words), bool, len(words))
            tokens = np.zeros(len(words), np.int64)
            tokens[special] = self._library([words[i] for i in np.flatnonzero(special).tolist()])
            if not special.all():
                tokens[~special] = self._words([words[i] for i in np.flatnonzero(~special).tolist()], chunk)
            np.add.at(total, text, tokens[word] * n)
            edges = np.zeros(len(data) + 1, np.int8)
            np.add.at(edges, first, 1)
            np.add.at(edges, last, -1)
            classes[np.cumsum(edges[:-1]).astype(bool)] = 0x20
        owner, emitted = self._chunks(classes, offsets, sizes, chunk)
        np.add.at(total, owner, emitted)
        return total

    def _words(self, words: list[bytes], chunk: int) -> np.ndarray:
        """Tokens of each word, by its normal form."""
        symbols, sizes = self._symbols(words)
        owner, emitted = self._chunks(symbols, np.cumsum(sizes) - sizes, sizes, chunk)
        out = np.zeros(len(words), np.int64)
        np.add.at(out, owner, emitted)
        return out

    def _chunks(self, classes: np.ndarray, offsets: np.ndarray, sizes: np.ndarray, chunk: int) -> tuple[np.ndarray, np.ndarray]:
        """(text, tokens) of every chunk: inner parts in lockstep, entering states by a scan, then heads in lockstep."""
        n = -(-sizes // chunk)
        owner = np.repeat(np.arange(len(sizes)), n)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
        start = offsets[owner] + nth * chunk
        end = np.minimum(start + chunk, (offsets + sizes)[owner])
        space = np.flatnonzero(classes == 0x20)
        at = np.minimum(np.searchsorted(space, start), len(space) - 1)
        # where a chunk's map becomes constant: at once in a text's first one, else behind the first white space
        sync = np.where(nth == 0, start, np.where((space[at] >= start) & (space[at] < end), space[at] + 1, -1))
        known = sync >= 0
        left, emitted = np.full(len(owner), -1, np.int64), np.zeros(len(owner), np.int64)
        left[known], emitted[known] = self.run(classes, sync[known], end[known], np.zeros(int(known.sum()), np.int64))
        if not known.all():
            unknown = np.flatnonzero(~known)
            at, exits, sums = self._composed(classes, start, end, offsets[owner], unknown, left)
            left[at] = exits
            emitted[unknown] += sums
        # scan: a chunk is entered with what the chunk before leaves
        entered = np.concatenate(([0], left[:-1]))
        heads = np.flatnonzero(known & (sync > start))
        emitted[heads] += self.run(classes, start[heads], sync[heads], entered[heads])[1]
        return owner, emitted

    def _composed(self, classes: np.ndarray, start: np.ndarray, end: np.ndarray, text: np.ndarray, unknown: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(last chunk of each chain, state that it leaves) and the tokens of each chain, at its first chunk, of chunks without a reset."""
        n = len(unknown)
        start, end = start[unknown], end[unknown]
        behind = np.zeros(n + 1, bool)  # whether the chunk before has no reset either; a first chunk of a text always has one
        behind[1:n] = unknown[1:] == unknown[:-1] + 1
        heads = np.flatnonzero(~behind[:n])
        entry, _ = self.run(classes, np.maximum(start - RUN_UP, text[unknown]), start, np.zeros(n, np.int64))
        entry = entry.astype(np.int64)
        entry[heads] = left[unknown[heads] - 1]
        # a map is its rows (chunk, entering state) -> (state left, tokens); it grows by what the map before may leave
        of, rows = np.arange(n), []
        keys, first = np.empty(0, np.int64), of << 32 | entry
        while len(of):
            exits, tokens = self.run(classes, start[of], end[of], entry)
            rows.append((of << 32 | entry, exits.astype(np.int64), tokens))
            keys = np.union1d(keys, rows[-1][0])
            new = np.unique((of + 1 << 32 | exits.astype(np.int64))[behind[of + 1]])
            new = new[~np.isin(new, keys)]
            of, entry = new >> 32, new & 0xFFFFFFFF
        keys, exits, tokens = (np.concatenate(x) for x in zip(*rows, strict=True))
        order = np.argsort(keys)
        keys, exits, tokens = keys[order], exits[order], np.append(tokens[order], 0)
        # composition by doubling: each row with the row that it leads to, to the chain's end
        of, stop = keys >> 32, len(keys)
        to = np.where(behind[of + 1], np.searchsorted(keys, of + 1 << 32 | exits), stop)
        to, final = np.append(to, stop), np.arange(stop + 1)
        while (to < stop).any():
            tokens = tokens + tokens[to]
            final = np.where(to < stop, final[to], final)
            to = to[to]
        at = np.searchsorted(keys, first[heads])
        sums = np.zeros(n, np.int64)
        sums[heads] = tokens[at]
        return unknown[of[final[at]]], exits[final[at]], sums


def transducer(tokenizer_file: str) -> CountTransducer:
    """One per worker process: what earlier tasks compiled is used again."""
    return held(("counts", tokenizer_file), lambda: CountTransducer(tokenizer_file))


def token_counts(docs: DataFrame, tokenizer_file: str, max_tokens: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of every whole text.

    Null and empty texts: 0 bytes, 0 tokens, not over the limit. Special strings in a
    text count as the library reads them by default. Very long texts, also one very
    long word, take time that grows with their length. Repeated rows give repeated rows.
    """

    def make():
        machine = transducer(tokenizer_file)

        def score(batch):
            data = [t or b"" for t in batch]
            for t, n in zip(data, machine.count(data).tolist(), strict=True):
                yield len(t), n, n > max_tokens

        return score

    fields = [T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())]
    return annotate(docs, id_col, text_col, fields, make)
