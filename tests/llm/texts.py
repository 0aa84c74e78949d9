"""A small table of awkward documents, and brute-force versions of the operators."""

import hashlib
import re
from collections import Counter

from pyspark.sql import types as T

SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("n_words", T.StringType()),  # a name that results use, too
        T.StructField("id", T.StringType()),
    ]
)
PASSAGE = " ".join(f"passage{i}" for i in range(60))
LONG = " ".join(f"w{(i * i) % 977} the" for i in range(20_000))
TEXTS = [
    None,
    "",
    "\n",
    " \t\x0b\x0c\r ",
    "One",
    "one  TWO\tthree",
    "loop " * 90,
    f"start {PASSAGE} end of the first",
    f"another start {PASSAGE} and another end",
    f"{PASSAGE}",
    LONG,
    LONG + " tail",
    "Ünïcödé ß ẞ Σίσυφος 日本語 テキスト   x y",
    "line a\nLINE A \nline b\n\nline a",
    "### $$$ *** |||| <<<< words and symbols here " * 5,
    "Licensed under the Apache License, Version 2.0. MIT license; CC-BY 4.0 cc by",
    "Permision is hereby granted, free of charge, to any persn obtaining a copy",
    "it's we'll don't 12345 a1b2 <|endoftext|> <|startoftext|>x",
]


def rows():
    out = [(i, t, "en" if i % 2 else None, "clash", "x") for i, t in enumerate(TEXTS)]
    out += [(100 + i, f"shared line\nown line {i}\n  Shared LINE \t", "de", None, None) for i in range(12)]
    out += [(7, TEXTS[7], "en", "again", "x"), (7, "another text under the same id", "en", "again", "x"), (None, f"no id {PASSAGE}", None, None, None), (None, None, None, None, None)]
    return out


def table(spark, some=None):
    return spark.createDataFrame(rows() if some is None else some, SCHEMA)


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def alnum(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))


def spaced(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def decontaminate(docs, items):
    grams = {}
    for item, text in items:
        w = alnum(text)
        for i in range(max(1, len(w) - 12) if w else 0):
            grams.setdefault(tuple(w[i : i + 13]), set()).add(item)
    out = []
    for d, text in docs:
        w, hit, found = alnum(text), set(), set()
        for n in {len(g) for g in grams}:
            for i in range(len(w) - n + 1):
                if (g := tuple(w[i : i + n])) in grams:
                    hit |= set(range(i, i + n))
                    found |= {str(x) for x in grams[g] if x is not None}
        out.append((d, len(w), len(hit), len(found), sha(",".join(sorted(found))), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return out


def substring(docs, n=20):
    """docs: (order key, id, text); rows of one key are one document."""
    first = {}
    for key, _, text in docs:
        w = spaced(text)
        for i in range(len(w) - n + 1):
            g = tuple(w[i : i + n])
            first[g] = min(first.get(g, (key, i)), (key, i))
    out = []
    for key, d, text in docs:
        w, gone = spaced(text), set()
        for i in range(len(w) - n + 1):
            if first[tuple(w[i : i + n])] < (key, i):
                gone |= set(range(i, i + n))
        out.append((d, len(w), len(gone), sha(" ".join(x for i, x in enumerate(w) if i not in gone))))
    return out


def lines(docs, least=10):
    key = lambda x: lower(x.strip("\x20\x09\x0a\x0b\x0c\x0d"))
    seen = Counter(k for _, t in docs for k in {key(x) for x in (t or "").split("\n")} if k)
    out = []
    for d, t in docs:
        ls = (t or "").split("\n")
        kept = [x for x in ls if not key(x) or seen[key(x)] < least]
        out.append((d, len(ls), len(ls) - len(kept), sha("\n".join(kept))))
    return out


def near(docs, n, share):
    sets = []
    for _, t in docs:
        w = spaced(lower(t))
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= share * len(a | sets[j]):
                root[find(i)] = find(j)
    out = []
    for i, (d, _) in enumerate(docs):
        ids = [docs[j][0] for j in range(len(docs)) if find(j) == find(i) and docs[j][0] is not None] if sets[i] else [d]
        c = min(ids) if ids and ids[0] is not None else None
        out.append((d, len(sets[i]), c, d == c))
    return out


def quality(text):
    w = spaced(text)
    n = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    again = {k for i in range(len(w) - 2) if n[tuple(w[i : i + 3])] > 1 for k in range(i, i + 3)}
    ls = [x for x in (text or "").split("\n") if spaced(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(ls) - len(set(ls)), len(again)


def ordered(found):
    return sorted(found, key=lambda r: tuple((x is None, str(x)) for x in r))
