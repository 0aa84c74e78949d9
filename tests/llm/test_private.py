"""Personal data: patterns against the plain regexes, decoding against a plain Viterbi, held-out accuracy of the field."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import texts as X
from furrow.llm import crf, private

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n // 10 + n % 10
    return total % 10 == 0


def plain(text):
    out = []
    for rank, (kind, pattern) in enumerate(PLAIN.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": max(map(int, re.findall("[0-9]+", m[0]))) <= 255 if kind == "ip" else False, "card": 14 <= len(digits) <= 19 and luhn(digits), "phone": 10 <= len(digits) <= 15}[kind]
            if good:
                out.append((m.start(), rank, m.end(), kind))
    return [(a, b, kind) for a, _, b, kind in sorted(out)]


CASES = [
    "a@b.c a@b a@b@c.d x@y.z.@w.v mail..%+-@a-b.c-d.e, .@-.-", "1.2.3.4.5.6.7.8 256.1.1.1 001.002.003.0255 1.2.3 1..2.3.4 9.9.9.9@x.y",
    "4111 1111 1111 1111 4111-1111-1111-1111 4111  1111 1111 1111 79927398713 0000000000000000 4111111111111111111 4222222222222-", "+1 (555) 010-0199 +49 30 901820 +1-2 +12345678901234567 +1 () 2 +1 555 0100 199) ++44 20 7946 0958.",
    "٣٤٥@example.com ١.٢.٣.٤ +٤٤ 20", "x" * 50 + "@y.z" + "1" * 30 + ".2.3.4", "a@b.c.d@e.f", "5 5 5 5", "",
]


def test_patterns_are_those_of_the_plain_regexes():
    rng = random.Random(1)
    texts = CASES + ["".join(rng.choices(some, k=rng.randrange(80))) for _ in range(2000) for some in ("a1 2.@-+()3%_é\n4567890", "a.@_é-b1", "12. ..", "0123456789 -9876543210", "+12345678 (0)-.9")]
    for text in texts:
        assert private.exact(text) == plain(text), text
    found = [kind for text in texts for *_, kind in plain(text)]
    assert min(found.count(kind) for kind in PLAIN) > 20


@pytest.mark.parametrize("part", ["1", "a", "1.", "1 ", "a@", "a@b", "+1", "+1 (", ".", "%", "1.1.1.1 "])
def test_patterns_take_linear_time(part):
    private.exact(part * (1_000_000 // len(part)))


@pytest.fixture(scope="module")
def model(spark):
    return private.train(private.labelled_table(spark))


def viterbi(model, words):
    """Plain decoding of one sequence."""
    stream = [crf.EDGE, crf.EDGE, *words, crf.EDGE, crf.EDGE]
    scores = crf.summed(np.array([model.emission(model.key(w)) for w in stream], np.float32))[2:-2]
    best, back = scores[0] + model.moves[0], []
    for s in scores[1:]:
        step = best[:, None] + model.moves
        back.append(step.argmax(axis=0))
        best = step.max(axis=0) + s
    out = [int((best + model.moves[:, 0]).argmax())]
    for b in reversed(back):
        out.append(int(b[out[-1]]))
    return out[::-1]


def test_decoding_is_exact(model):
    rng = np.random.default_rng(11)
    some = private.filled(private._GIVEN, private._FAMILY, 60, 5) + [(private.prose(rng), []) for _ in range(60)]
    texts = [" ".join(some[int(i)][0] for i in rng.integers(0, len(some), int(rng.integers(0, 9)))).encode() for _ in range(80)]
    texts += [b"", b"token", b" ".join([b"name", b"Mr."] * 200), b'"' * 5000, b"Mr. " * 30_000]
    for block in (1 << 20, 40):
        finder = private.Finder(crf.Decoder(model, most_words=50))
        stream = [[crf.EDGE, crf.EDGE]]
        want, at = [], 2
        for text in texts:
            words = text.split()
            stream += [words[i : i + block] for i in range(0, len(words), block)] + [[crf.EDGE, crf.EDGE]]
            want += [(at + i, label) for i, label in enumerate(viterbi(model, words) if words else []) if label]
            at += len(words) + 2
        got = [(int(p), int(x)) for places, labels in finder.decoder.decode(iter(stream)) for p, x in zip(places, labels, strict=True)]
        assert got == want and len(got) > 50


def test_held_out_spans(model):
    """Names that training never saw, in the sentences' forms: nine spans in ten, and nothing in prose of unseen words."""
    finder = private.Finder(crf.Decoder(model))
    test = private.filled(private._GIVEN[12:], private._FAMILY[12:], 4 * len(private._TEMPLATES), 99, invented=False)
    right = found = 0
    for (_, spans), got in zip(test, finder.guessed([t.encode() for t, _ in test]), strict=True):
        right += len(set(spans) & set(got))
        found += len(got)
    n = sum(len(spans) for _, spans in test)
    assert right >= 0.85 * n and right >= 0.95 * found
    rng = np.random.default_rng(77)
    clean = [private.prose(rng).encode() for _ in range(400)]
    assert sum(map(bool, finder.guessed(clean))) <= 8


def test_spans_of_documents(spark, model):
    rows = [(r[0], r[1]) for r in X.rows()]
    rows += [(1000 + i, t) for i, t in enumerate(CASES)] + [(2000, "é日 My name is Anna Kowalska, mail a@b.cd; Address: 12 Elm Street."), (2001, "x " * 300_000 + "SSN: 123-45-6789")]
    table = X.table(spark, [(d, t, None, "clash", "x") for d, t in rows]).withColumn("n_email", F.lit(0)).repartition(3)
    got = private.find_private(table, model)
    assert got.columns == ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"]
    want = [(d, *(sum(k == kind for *_, k in base) for kind in PLAIN), X.sha(",".join(f"{k}:{a}:{b}" for a, b, k in base))) for d, t in rows for base in [plain(t or "")]]
    assert X.ordered([tuple(r) for r in got.drop("spans").collect()]) == X.ordered(want)
    spans = {r.doc_id: r.spans for r in got.filter("doc_id >= 2000").collect()}
    assert spans == {2000: "name:14:27,email:34:40,address:51:64", 2001: "id:600005:600016"}
    text = {r.doc_id: r.text for r in private.redact(table, model).filter("doc_id >= 2000 or doc_id < 5").collect()}
    assert text[2000] == "é日 My name is [NAME], mail [EMAIL]; Address: [ADDRESS]." and text[2001].endswith("x SSN: [ID]")
    assert text[0] is None and text[1] == "" and text[4] == "One"
    assert private.find_private(table.limit(0), model).count() == 0


def test_training_takes_other_kinds_and_odd_rows(spark):
    rows = [(f"code {w} here", [(5, 5 + len(w), "code")]) for w in ("AB-1", "CD-2", "EF-3", "GH-4", "IJ-5", "KL-6")] * 4 + [(None, None), ("", []), ("nothing here at all", [])]
    model = private.train(spark.createDataFrame(rows, private._SCHEMA))
    docs = X.table(spark, [(1, "the code XY-7 here", None, None, None), (2, None, None, None, None)])
    assert {r.doc_id: r.spans for r in private.find_private(docs, model).collect()} == {1: "code:9:13", 2: ""}
