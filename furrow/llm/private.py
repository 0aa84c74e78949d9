"""Personal data in texts: exact patterns, and spans of a conditional random field over word shapes."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from furrow.llm import crf
from furrow.llm.hashing import blocks
from furrow.llm.text import annotate, held, rewrite, sha256_hex

#: Kinds found by patterns, and those that the field is trained for, in the order in which spans of one start are listed.
BASE = ("email", "ip", "card", "phone")
KINDS = ("name", "address", "id", "account", "secret")
#: Kinds of which a guessed span must hold a digit.
NUMBERED = {"address", "id", "account"}
_DIGIT = re.compile(rb"[0-9]")

# Linear forms of the patterns: runs are possessive, and an address is looked for from its @.
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9]++(?:[\x20-][0-9]++)*+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_NO_DIGIT = re.compile(r"[^0-9]+")

Span = tuple[int, int, str]


def luhn(digits: str) -> bool:
    """Whether the last digit is the check digit."""
    twice = [0, 2, 4, 6, 8, 1, 3, 5, 7, 9]
    total = sum(int(c) if i % 2 == 0 else twice[int(c)] for i, c in enumerate(reversed(digits)))
    return total % 10 == 0


def emails(text: str) -> Iterator[Span]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end(), "email"
            done = m.end()
        at = text.find("@", max(at + 1, done))


def exact(text: str) -> list[Span]:
    """Spans of the four patterns, leftmost and non-overlapping within a kind, in time linear in the text."""
    found = list(emails(text))
    found += [(m.start(), m.end(), "ip") for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = _NO_DIGIT.sub("", m[0]) if m.end() - m.start() <= 40 else ""
            if 14 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), m.end(), "card"))
    for m in _PHONE.finditer(text):
        if 10 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
            found.append((m.start(), m.end(), "phone"))
    return listed(found)


def listed(spans: list[Span]) -> list[Span]:
    """By start, then kind as listed."""
    rank = {kind: i for i, kind in enumerate((*BASE, *KINDS))}
    return sorted(spans, key=lambda s: (s[0], rank.get(s[2], len(rank)), s[2], s[1]))


def spelled(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


# --- the labelled table -------------------------------------------------------

_GIVEN = "Anna Lukas Marie Paul Sofia James Emma Pierre Carmen Jürgen Chloé José Olivia Hans Élise Miguel Grace Karl Louise Diego".split()
_FAMILY = "Smith Müller Dupont García Johnson Weber Lefèvre Martínez Brown Schneider Moreau Fernández Walker Fischer Laurent Romero Clarke Wagner Girard Navarro".split()
_STREETS = "Elm Oak Maple Station Park Linden Victor Mayor Garten Church Mill Castle".split()
#: Sentences with places for personal data, and sentences without any.
_TEMPLATES = [
    "My name is {n} and I live nearby.", "Please contact {n} for details.", "Dear {n}, thank you for the letter.", "Mr. {n} called yesterday.", "The form was signed by {n} on Monday.", "Patient: {n}", "Name: {n}", "Written by {n}, with thanks.",
    "Mrs. {n} asked for a new card.", "Mein Name ist {n} und ich komme heute.", "Ich heiße {n}.", "Frau {n} hat den Brief gelesen.", "Herr {n} war nicht da.", "Je m'appelle {n} et je suis ici.", "Monsieur {n} est parti.", "Madame {n} arrive demain.", "Me llamo {n} y vivo aquí.", "La señora {n} vive cerca.", "El señor {n} no estaba.",
    "She lives at {h} {s} Street in town.", "Address: {h} {s} Avenue", "Send it to {h} {s} Road, please.", "He moved to {h} {s} Lane last year.", "Adresse : {h} rue {s}", "Sie wohnt in der {s}straße {h} seit Jahren.", "Vive en la Calle {s} {h} desde enero.",
    "My social security number is {i}.", "SSN: {i}", "SSN {i} was on the form.", "Her social security number, {i}, is private.",
    "IBAN: {b}", "Transfer it to IBAN {b} today.", "Bitte auf IBAN {b} überweisen.", "account number {a} at the bank", "Account: {a}", "Kontonummer {a} bitte nennen.",
    'token = "{x}" in the file', 'api_key = "{x}"', "password: {p}", "The password is {p} for now.", "secret: {x}", "api key {x} must go", 'und token = "{x}" oder nicht', 'de token = "{x}" la',
]
_PLAIN = [
    "The quick brown fox jumps over the lazy dog. Then it rests.", "On Monday we went to Paris and London. It rained.", "Version 2.10.3 came out on 2024-03-05, see page 17.", "It costs 1,299.00 or 12 % less. Order 8812734 now.", "Der Zug nach Berlin fährt um 12:45 Uhr ab. Dann kam Regen.", "Le chat dort. La maison est grande.", "La casa es grande. El perro duerme en Madrid.", "Rows 12-45 and 100-200 of the table were read.",
    "Commit 9f86d081884c7d65 changed 14 files. Tests pass.", "A name is given to each token and each key of the table.", "The street was empty. The account was closed; the number grew.", "My answer is no. Her reply is late. His idea is good.", "Please contact support. Dear reader, thank you.", "Signed copies were sold by the dozen. Written rules help.",
    "Call +1 (555) 010-0199 or write to info@mail.example.com today.", "The host 10.0.0.12 answered; card 4111 1111 1111 1111 did not.", "Copyright 2019. All rights reserved. MIT License.", "| token | name | address | id |", "token = 5 and key = None", "His name is not known. The password is wrong.", "Mein Name ist kurz. Die Adresse fehlt.", "Je suis ici. Monsieur est parti.", "Me llamo así. La señora vive cerca.",
]
_SOUNDS = [["b", "d", "f", "g", "h", "k", "l", "m", "n", "p", "r", "s", "t", "th", "w", "sch", "ch", "qu", "ll", "ñ", "ç"], ["a", "e", "i", "o", "u", "é", "ü", "ió", "ea", "ou", "è"], ["", "", "n", "r", "s", "st", "nd", "ng"]]


#: Small words around personal data, which also stand where there is none.
_CUES = sorted({w.strip(".,:") for t in _TEMPLATES for w in t.split() if w[0].islower() and "{" not in w})


def word(rng: np.random.Generator) -> str:
    """A word of one to four made-up syllables."""
    return "".join(str(rng.choice(part)) for _ in range(int(rng.integers(1, 5))) for part in _SOUNDS)


def prose(rng: np.random.Generator) -> str:
    """Sentences of made-up words with capitals, numbers, marks and the patterns' kinds in them, and nothing private by the field."""
    digits = lambda k: "".join(map(str, rng.integers(0, 10, k)))
    out: list[str] = []
    capitals, mark = rng.choice([0.0, 0.0, 0.3]), str(rng.choice(["", "", "", "!!", "%%%", " |"]))
    for _ in range(int(rng.integers(1, 3))):
        some = [word(rng) if rng.random() < 0.6 else str(rng.choice(_CUES)) for _ in range(int(rng.integers(1, 9)))]
        some = [w.capitalize() if i == 0 or rng.random() < capitals else w for i, w in enumerate(some)]
        some = [w + "," if rng.random() < 0.1 else w for w in some]
        if rng.random() < 0.35:
            number = digits(int(rng.integers(1, 18)))
            odd = [number, number, f"+1 ({digits(3)}) {digits(3)}-{digits(4)}", f"{word(rng)}.{digits(2)}@{word(rng)}.example.com", ".".join(str(x) for x in rng.integers(1, 256, 4)), f"20{digits(2)}-0{int(rng.integers(1, 10))}-1{digits(1)}", " ".join(digits(4) for _ in range(4)), f"({number})", "token", "name"]
            some.insert(int(rng.integers(0, len(some) + 1)), odd[int(rng.integers(len(odd)))])
        line = " ".join(w + mark for w in some)
        out.append((line.upper() if rng.random() < 0.08 else line) + str(rng.choice([".", ".", ".", ",", "", ":", "?"])))
    return " ".join(out)


_SCHEMA = "text string, spans array<struct<first:long,last:long,kind:string>>"


def filled(given: list[str], family: list[str], n: int, seed: int, invented: bool = True) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """n texts from the templates in turn, with the places (in code points) of their personal data; two names in three are made up."""
    rng = np.random.default_rng(seed)
    pick = lambda some: some[int(rng.integers(len(some)))]
    digits = lambda k: "".join(map(str, rng.integers(0, 10, k)))
    out = []
    for k in range(n):
        first, last = (str(pick(some)) if rng.integers(3) == 0 or not invented else word(rng).capitalize() for some in (given, family))
        number = f"{pick(['DE', 'FR', 'ES', 'GB'])}{digits(20)}"
        values = {
            "n": ("name", " ".join([*([first] if rng.integers(4) else []), last])),
            "h": ("address", str(int(rng.integers(1, 300)))),
            "s": ("address", pick(_STREETS)),
            "i": ("id", f"{digits(3)}-{digits(2)}-{digits(4)}"),
            "b": ("account", number if rng.integers(2) else " ".join(number[i : i + 4] for i in range(0, 22, 4))),
            "a": ("account", digits(int(rng.integers(8, 13)))),
            "x": ("secret", "".join("0123456789abcdef"[i] for i in rng.integers(0, 16, int(rng.integers(28, 42))))),
            "p": ("secret", f"{pick(['Hunter', 'blue', 'S3cret', 'qwErty', 'Sun'])}{digits(int(rng.integers(1, 5)))}{pick(['!', '#', 'x', ''])}"),
        }
        text, spans = "", []
        for piece in re.split(r"(\{\w\})", _TEMPLATES[k % len(_TEMPLATES)]):
            if piece[:1] == "{":
                kind, value = values[piece[1]]
                spans.append((len(text), len(text) + len(value.rstrip("!#")), kind))
                piece = value
            text += piece
        joined: list[tuple[int, int, str]] = []
        for start, end, kind in spans:  # number and street are one address, with the words that belong to it
            if joined and joined[-1][2] == kind:
                joined[-1] = (joined[-1][0], end, kind)
            else:
                joined.append((start, end, kind))
        for i, (start, end, kind) in enumerate(joined):
            if kind == "address" and (m := re.match(r" (?:Street|Avenue|Road|Lane)|straße \d+", text[end:])):
                joined[i] = (start, end + m.end(), kind)
        out.append((text, joined))
    return out


def labelled_table(spark: SparkSession) -> DataFrame:
    """(text, spans) for training: several hundred short texts in four languages with and without personal data."""
    rng = np.random.default_rng(3)
    rows = filled(_GIVEN[:12], _FAMILY[:12], 8 * len(_TEMPLATES), 7) + [(text, []) for text in [*_PLAIN, *_PLAIN, *(prose(rng) for _ in range(400))]]
    return spark.createDataFrame(rows, _SCHEMA)


# --- training and search ------------------------------------------------------

#: Labelled rows that a model is fitted to, at most; a larger table is read in the order of its texts.
MAX_ROWS = 5000


def _example(text: str, spans: tuple) -> tuple[list[bytes], list[str]]:
    words, kinds = [], []
    for m in re.finditer(r"[^\x20\x09-\x0D]+", text):
        words.append(m[0].encode())
        kinds.append(next((kind for first, last, kind in spans if first < m.end() and m.start() < last), ""))
    return words, kinds


@lru_cache(maxsize=4)
def _fitted(rows: tuple) -> crf.Model:
    examples = [e for e in (_example(text, spans) for text, spans in rows) if e[0]]
    return crf.train(examples, tuple(dict.fromkeys([*KINDS, *(k for _, kinds in examples for k in kinds if k)])))


def train(labelled: DataFrame, max_rows: int = MAX_ROWS) -> crf.Model:
    """Fit the field to (text, spans: first and end in code points, kind); null texts and spans count as empty."""
    rows = labelled.select("text", "spans").orderBy("text").limit(max_rows).collect()
    return _fitted(tuple((r.text or "", tuple((s.first, s.last, s.kind) for s in r.spans or ())) for r in rows))


BLOCK_BYTES = 1 << 20
_WHITE = np.zeros(256, bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True


@dataclass
class Finder:
    decoder: crf.Decoder

    def guessed(self, batch: list[bytes]) -> list[list[Span]]:
        """Spans of the field in each text."""
        starts, at = [], 0

        def stream():
            nonlocal at
            waiting, size = [crf.EDGE, crf.EDGE], 0
            at = 2
            for text in batch:
                starts.append(at)
                for part in blocks(text, BLOCK_BYTES):
                    words = part.split()
                    waiting += words
                    at, size = at + len(words), size + len(part)
                    if size > BLOCK_BYTES:
                        yield waiting
                        waiting, size = [], 0
                waiting += [crf.EDGE, crf.EDGE]
                at += 2
            yield waiting

        places, labels = [np.zeros(0, np.int64)], [np.zeros(0, np.int8)]
        for where, found in self.decoder.decode(stream()):
            places.append(where)
            labels.append(found)
        place, label = np.concatenate(places), np.concatenate(labels)
        out: list[list[Span]] = [[] for _ in batch]
        doc = np.searchsorted(np.array(starts), place, "right") - 1
        for d in np.unique(doc).tolist():
            mine = doc == d
            out[d] = self._spans(batch[d], place[mine] - starts[d], label[mine])
        return out

    def _spans(self, text: bytes, word: np.ndarray, label: np.ndarray) -> list[Span]:
        """Runs of neighbouring words of one label, without the punctuation around them, in code points."""
        white = _WHITE[np.frombuffer(text, np.uint8)]
        first = np.flatnonzero(~white & np.concatenate([[True], white[:-1]]))
        last = np.flatnonzero(~white & np.concatenate([white[1:], [True]])) + 1
        new = np.concatenate([[True], (np.diff(word) != 1) | (np.diff(label) != 0)])
        lead, tail = np.flatnonzero(new), np.append(np.flatnonzero(new)[1:], len(word)) - 1
        spans, seen, chars = [], 0, 0
        for a, b in zip(lead.tolist(), tail.tolist(), strict=True):
            start, end = int(first[word[a]]), int(last[word[b]])
            low, high = crf.core(text[start:end])
            kind = self.decoder.model.labels[label[a]]
            if low == high or (kind in NUMBERED and not _DIGIT.search(text, start, end)):
                continue
            start, end = start + low, start + high
            chars += len(text[seen:start].decode())
            width = len(text[start:end].decode())
            spans.append((chars, chars + width, kind))
            seen, chars = end, chars + width
        return spans

    def find(self, batch: list[bytes | None]) -> Iterator[tuple[list[Span], list[Span]]]:
        """(spans of the patterns, all spans) per text; a guessed span that meets an exact one is dropped."""
        batch = [t or b"" for t in batch]
        for text, guesses in zip(batch, self.guessed(batch), strict=True):
            base = exact(text.decode())
            taken = [(a, b) for a, b, _ in base]
            extra = [s for s in guesses if not any(a < s[1] and s[0] < b for a, b in taken)]
            yield base, listed(base + extra)


def _finder(model: crf.Model) -> Finder:
    return held(("private", model.weights.shape, model.weights.tobytes()[:4096]), lambda: Finder(crf.Decoder(model)))


_FIELDS = [*(T.StructField(f"n_{kind}", T.LongType()) for kind in BASE), T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType())]


def find_private(docs: DataFrame, model: crf.Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_email, n_ip, n_card, n_phone, base_sha256, spans) of every whole text.

    spans lists kind:start:end in code points, by start and then by kind as listed, of the
    patterns and of the field; base_sha256 is over those of the patterns alone. Null and
    empty texts have none. Very long texts are decoded in blocks cut where the field has no
    choice, which changes no label. Repeated rows repeat.
    """

    def make():
        finder = _finder(model)

        def score(batch):
            for base, spans in finder.find(batch):
                kinds = [kind for *_, kind in base]
                yield *map(kinds.count, BASE), sha256_hex(spelled(base).encode()), spelled(spans)

        return score

    return annotate(docs, id_col, text_col, _FIELDS, make)


def redact(docs: DataFrame, model: crf.Model, text_col: str = "text") -> DataFrame:
    """docs with all their columns and each span replaced by its kind in brackets; of spans that overlap the earliest counts, then the longest."""

    def make():
        finder = _finder(model)

        def mask(text: bytes | None, spans: list[Span]):
            if not spans:
                return text
            letters, out, at = text.decode(), [], 0
            for start, end, kind in sorted(spans, key=lambda s: (s[0], -s[1])):
                if start >= at:
                    out += [letters[at:start], f"[{kind.upper()}]"]
                at = max(at, end)
            return "".join([*out, letters[at:]]).encode()

        return lambda batch: [mask(t, spans) for t, (_, spans) in zip(batch, finder.find(batch), strict=True)]

    return rewrite(docs, text_col, make, keep_rows=False)
