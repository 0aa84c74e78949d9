"""Licence notices: exact phrases, and short notices with bounded errors.

Fuzzy search by the pigeonhole rule: a notice that may have k errors is cut into k+1
seeds; a text with the notice in it, at k errors or fewer, holds one seed unchanged.
Seeds are found by plain substring search over the normalised words; around each seed
the regex library looks for the whole notice with at most k errors and gives the
span and the number of edits.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from furrow.llm.text import alnum_words, annotate

#: Exact phrases and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

#: Short notices searched with errors: label, text in normalised words, most errors.
NOTICES = [
    ("gpl", "gnu general public license", 3),
    ("apache", "licensed under the apache license", 3),
    ("mit", "released under the mit license", 2),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy", 6),
    ("cc-by", "creative commons attribution", 2),
    ("bsd", "redistribution and use in source and binary forms", 4),
    ("mpl", "mozilla public license", 2),
    ("cc0", "dedicated to the public domain", 2),
    ("all-rights-reserved", "all rights reserved", 1),
]


#: Bytes that a window reaches for a word end, and what marks a cut word: more letters than any notice has errors.
WIDEN, PAD = 64, "x" * 16


@dataclass
class Notice:
    label: str
    text: str
    errors: int
    seeds: list[tuple[int, bytes]] = field(init=False)

    def __post_init__(self):
        n = self.errors + 1
        cuts = [len(self.text) * i // n for i in range(n + 1)]
        self.seeds = [(a, self.text[a:b].encode()) for a, b in zip(cuts, cuts[1:])]
        self.pattern = regex.compile(rf"(?b)\b(?:{regex.escape(self.text)}){{e<={self.errors}}}\b")


@dataclass(frozen=True)
class Span:
    label: str
    first_word: int
    last_word: int
    edits: int
    score: float


class Scanner:
    def __init__(self, phrases: dict[str, str] = PHRASES, notices: list[tuple[str, str, int]] = NOTICES):
        self.phrases = [(b" " + p.encode() + b" ", label) for p, label in phrases.items()]
        self.notices = [Notice(*n) for n in notices]

    def exact(self, line: bytes) -> list[tuple[int, str]]:
        """(byte position, label) of every phrase in a line of words with a space at both ends."""
        found = []
        for phrase, label in self.phrases:
            at = line.find(phrase)
            while at >= 0:
                found.append((at, label))
                at = line.find(phrase, at + 1)
        return found

    def fuzzy(self, line: bytes, spaces: np.ndarray) -> list[Span]:
        """Best match around every seed; places that overlap are looked at once.

        Each place costs a window of bounded length, also inside a very long word.
        """
        spans = []
        for notice in self.notices:
            places = set()
            for offset, seed in notice.seeds:
                at = line.find(seed)
                while at >= 0:
                    places.add(at - offset)
                    at = line.find(seed, at + 1)
            slack, done = notice.errors + 1, -1
            for start in sorted(places):
                if start < done:
                    continue
                # the window is widened to word ends; a longer word is cut, and padded so that its cut is no word end
                low, high = max(0, start - slack), min(len(line), start + 4 * len(notice.text) + slack)
                a = line.rfind(b" ", max(0, low - WIDEN), max(1, low))
                b = line.find(b" ", min(len(line) - 1, start + len(notice.text) + slack), high + WIDEN)
                cut = max(0, low - WIDEN) if a < 0 else a
                window = line[cut : high + WIDEN if b < 0 else b].decode(errors="ignore")
                pad = PAD if a < 0 and cut > 0 else ""
                text = pad + window + (PAD if b < 0 and high + WIDEN < len(line) else "")
                if m := notice.pattern.search(text):
                    at = cut + len(text[len(pad) : m.start()].encode())
                    first = int(np.searchsorted(spaces, at)) - 1
                    edits = sum(m.fuzzy_counts)
                    n_words = m.group().strip().count(" ")
                    first += m.group()[:1] == " "
                    spans.append(Span(notice.label, first, first + n_words, edits, 1 - edits / len(notice.text)))
                    done = cut + len(text[len(pad) : m.end()].encode())
        return spans

    def scan(self, data: bytes | None) -> tuple:
        words = alnum_words(data or b"")
        line = b" " + b" ".join(words) + b" "
        spaces = np.flatnonzero(np.frombuffer(line, np.uint8) == 0x20)
        base = self.exact(line)
        spans = self.fuzzy(line, spaces)
        first = last = None
        if base:
            places = [p for p, _ in base]
            first, last = (int(np.searchsorted(spaces, p)) for p in (min(places), max(places)))
        labels = {label for _, label in base}
        every = labels | {s.label for s in spans}
        score = 1.0 if base else max((s.score for s in spans), default=0.0)
        return (len(words), len(base), first, last, ",".join(sorted(labels)), ",".join(sorted(every)), score), spans


_FIELDS = [
    T.StructField("n_words", T.LongType()),
    T.StructField("n_base", T.LongType()),
    T.StructField("first_word", T.LongType()),
    T.StructField("last_word", T.LongType()),
    T.StructField("base_labels", T.StringType()),
    T.StructField("labels", T.StringType()),
    T.StructField("score", T.DoubleType()),
]
_SPANS = T.ArrayType(
    T.StructType(
        [T.StructField("label", T.StringType()), T.StructField("first_word", T.LongType()), T.StructField("last_word", T.LongType()), T.StructField("edits", T.LongType()), T.StructField("score", T.DoubleType())]
    )
)


def scan_licences(docs: DataFrame, phrases: dict[str, str] = PHRASES, notices: list[tuple[str, str, int]] = NOTICES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans) of every whole text.

    n_base counts exact phrases; labels adds those of notices found within their
    error bound; spans lists the latter by word positions with their edits. score is 1
    with an exact phrase, else 1 - edits / length of the best notice, else 0. Null and
    empty texts: no words, null positions, empty labels. Very long texts are scanned
    whole, in time that grows with their length. Repeated rows repeat.
    """

    def make():
        scanner = Scanner(phrases, notices)

        def score(batch):
            for t in batch:
                row, spans = scanner.scan(t)
                yield *row, [{"label": s.label, "first_word": s.first_word, "last_word": s.last_word, "edits": s.edits, "score": s.score} for s in spans]

        return score

    return annotate(docs, id_col, text_col, [*_FIELDS, T.StructField("spans", _SPANS)], make)
