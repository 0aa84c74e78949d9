"""Alignment of two tokenizers against a brute-force version over whole texts by the libraries."""

import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

import texts as X
from conftest import DATA
from furrow.llm import alignment
from furrow.llm.queries import QUERIES

JSON, MODEL = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def whole(texts):
    """Per text: ids of A and B with their bytes' ends, or nothing."""
    a, b = Tokenizer.from_file(JSON), sentencepiece.SentencePieceProcessor(model_file=MODEL)
    a.encode_special_tokens = True
    values = alignment.byte_values()
    out = []
    for text in texts:
        if not text:
            out.append(None)
            continue
        data = (" " + text).encode()
        a_ids, b_ids = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        a_bytes = [bytes(values[c] for c in a.id_to_token(i)) for i in a_ids]
        b_bytes = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i in b_ids for p in [b.id_to_piece(i)]]
        fits = b"".join(a_bytes) == data == b"".join(b_bytes)
        out.append((a_ids, np.cumsum([len(x) for x in a_bytes]).tolist(), b_ids, np.cumsum([len(x) for x in b_bytes]).tolist()) if fits else None)
    return out


def brute(docs):
    links, groups, counts = [], [], Counter()
    encoded = whole([t for _, t in docs])
    for e in encoded:
        mine, cut = [], []
        if e:
            a_ids, a_ends, b_ids, b_ends = e
            i = j = 0
            while i < len(a_ids):
                mine.append((a_ids[i], b_ids[j]))
                x, y = a_ends[i], b_ends[j]
                i, j = i + (x <= y), j + (y <= x)
            both, i, j = sorted(set(a_ends) & set(b_ends)), 0, 0
            for end in both:
                k, m = a_ends.index(end, i) + 1, b_ends.index(end, j) + 1
                cut.append(f"{','.join(map(str, a_ids[i:k]))}|{','.join(map(str, b_ids[j:m]))}")
                i, j = k, m
        links.append(mine)
        groups.append(cut)
        counts.update(set(mine))
    best = defaultdict(int)
    for (a, _), n in counts.items():
        best[a] = max(best[a], n)
    rows = []
    for (d, _), e, mine, cut in zip(docs, encoded, links, groups, strict=True):
        rows.append((d, len(e[0]) if e else 0, len(e[2]) if e else 0, len(cut), len(mine), sum(counts[p] == best[p[0]] for p in mine), sum(counts[p] for p in mine), X.sha(";".join(cut)) if e else ""))
    total = Counter(p for mine in links for p in mine)
    return X.ordered(rows), X.ordered([(a, b, n, total[a, b], n == best[a]) for (a, b), n in counts.items()])


ODD = [
    " leading", "trailing ", "  two  spaces  ", "\n\nlines\n\n next\n", "a\tb\t c \t\n d", "x y  z　 w　", "a▁b", "fine text\nwith a▁mark", "naïve café ﬁ ﬀ Å Å", "\x00 null \x01", "<s> </s> <unk> <0x0A> <|endoftext|>", "😀👍🏽 emoji",
    "日本語の文章。 次の文\n한국어 문장 العربية نص", " line sep\u0085nel", "'s it's don't  ' s", "\r\n windows\r\nlines\r\n", "!!! ... ??? ---- ====\n====", "1234567890 12 345", "word" * 400, " ", "\n", "\t", "é", "​zero​ width",
]


@pytest.mark.parametrize("postings", [alignment.BLOCK_POSTINGS, 50])
def test_scores_and_pairs_equal_brute_force(spark, postings):
    docs = [(r[0], r[1]) for r in X.rows()] + [(1000 + i, t) for i, t in enumerate(ODD)]
    rng = random.Random(3)
    letters = "ab \n\t é▁日 　.1'<|>" + " " * 5
    docs += [(2000 + i, "".join(rng.choices(letters.replace("▁", "") if i % 4 else letters, k=rng.randrange(60)))) for i in range(150)]
    table = X.table(spark, [(d, t, None, "clash", "x") for d, t in docs]).repartition(3)
    found = alignment.align(table, JSON, MODEL, block_postings=postings)
    rows, pairs = brute(docs)
    assert X.ordered([tuple(r[c] for c in COLUMNS) for r in found.scores().collect()]) == rows
    assert X.ordered([tuple(r) for r in found.pairs.select("a_id", "b_id", "n_docs", "n_links", "best").collect()]) == pairs


def test_query_equals_brute_force(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]
    rows, pairs = brute(docs)
    assert X.ordered([tuple(r[c] for c in COLUMNS) for r in QUERIES["op12_token_alignment"](spark, DATA).collect()]) == rows
    assert X.ordered([tuple(r) for r in QUERIES["aligned_token_pairs"](spark, DATA).select("a_id", "b_id", "n_docs", "n_links", "best").collect()]) == pairs


def test_empty_tables(spark):
    none = alignment.align(X.table(spark).limit(0), JSON, MODEL)
    assert none.scores().count() == 0 and none.pairs.count() == 0
    blank = alignment.align(X.table(spark, [(1, None, None, None, None), (2, "", None, None, None)]), JSON, MODEL)
    assert X.ordered([tuple(r) for r in blank.scores().collect()]) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]


def test_parts_and_blocks_do_not_matter():
    """Long texts in parts, and postings in many planes: the same as at once."""
    rng = random.Random(9)
    text = (" " + "".join(rng.choices(["the ", "word", " x", "\n", "été ", "  ", "日本 ", "."], k=4000))).encode()
    for size in (1, 7, 300):
        cut = list(alignment.parts(text, size))
        assert b"".join(cut) == text and len(cut) > 10
        assert [s for p in cut for s in alignment._SEGMENT.findall(p)] == alignment._SEGMENT.findall(text)
    doc, pair = np.divmod(np.array(rng.sample(range(300 * 40), 5000)), 40)
    times = np.array([rng.choice([1, 1, 1, 2, 3, 4, 8, 70]) for _ in doc])
    block = alignment.Block()
    block.add(300, doc, pair, times)
    got = Counter()
    for plane, pairs, n, docs in block.planes():
        for p, k, data in zip(pairs.tolist(), n.tolist(), docs.to_pylist(), strict=True):
            for d in alignment.members(data, k).tolist():
                got[d, p] += 1 if plane == 0 else 1 << (plane - 1)
    assert got == Counter({(d, p): t for d, p, t in zip(doc.tolist(), pair.tolist(), times.tolist(), strict=True)})
