"""Each text operator against a brute-force version on awkward documents, repeated rows, empty tables and clashing columns."""

import base64
import gzip
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import texts as X
from furrow.llm import bpe, counts, decontaminate, fmindex, hashing, langid, licences, lines, merges, neardup, rules, substrings, warc
from furrow.session import fresh_path

RANKS, WORDS = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("word_bpe_49k.json")


def plain(df, *cols):
    return X.ordered([tuple(r[c] for c in cols) for r in df.select(*cols).collect()])


@pytest.fixture(scope="module")
def docs(spark):
    return X.table(spark).repartition(3).cache()


@pytest.fixture(scope="module")
def pairs():
    return [(r[0], r[1]) for r in X.rows()]


ITEMS = [(1, " ".join(X.PASSAGE.split()[5:30]).upper()), (2, "tail"), (3, None), (4, ""), (None, "charge, to any"), (1, X.PASSAGE), (5, "never found in any of these documents at all, however long one may look")]


# --- 1: decontamination -------------------------------------------------------

@pytest.mark.parametrize("most", [decontaminate.MAX_WINDOWS, 3])
def test_decontamination(spark, docs, pairs, most):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    cols = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    assert plain(decontaminate.flag(docs, items, max_windows=most), *cols) == X.ordered(X.decontaminate(pairs, ITEMS))
    kept = decontaminate.clean(docs, items, max_windows=most)
    assert kept.columns == docs.columns
    clean = {(r[0]) for r in X.decontaminate(pairs, ITEMS) if not r[5]}
    assert {r[0] for r in kept.select("doc_id").collect()} <= clean
    assert decontaminate.flag(docs, items.limit(0), max_windows=most).filter("contaminated").count() == 0
    assert decontaminate.flag(docs.limit(0), items, max_windows=most).count() == 0


def test_spans_are_cut(spark):
    items = spark.createDataFrame([(1, X.PASSAGE)], "item_id long, text string")
    docs = X.table(spark, [(1, f"Before, {X.PASSAGE}! after", None, None, None), (2, "clean text", None, None, None), (3, None, None, None, None)])
    got = {r.doc_id: r.text for r in decontaminate.clean(docs, items, action="cut").collect()}
    assert got == {1: "Before, ! after", 2: "clean text", 3: None}


@pytest.mark.parametrize("action", ["drop", "cut"])
def test_large_benchmarks_clean_alike(spark, docs, pairs, action):
    """Beyond the window cap the same rows and texts are left, also where ids are null or shared."""
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    small, large = (decontaminate.clean(docs, items, action=action, max_windows=most) for most in (decontaminate.MAX_WINDOWS, 3))
    assert large.schema == small.schema
    assert plain(large, *docs.columns) == plain(small, *docs.columns)
    if action == "drop":
        clean = [p for p, r in zip(pairs, X.decontaminate(pairs, ITEMS), strict=True) if not r[5]]
        assert plain(large, "doc_id", "text") == X.ordered(clean)
        assert (None, None) in clean and (7, "another text under the same id") in clean


# --- 2: WARC ------------------------------------------------------------------

PAGES = [(1, "http://b.example/x?q=1", "same"), (2, "http://a.example/", "same"), (9, "http://a.example/", "same"), (3, None, None), (4, "not a url", ""), (5, "http://a.example:8080/ü", "a\r\n\r\nb\x00 ünï"), (5, "http://a.example:8080/ü", "a\r\n\r\nb\x00 ünï"), (None, "http://c/", "same"), (None, None, "lonely"), (6, "http://[bad", "x" * 200_000)]


def warc_expected(least=0):
    out = []
    for page, _, html in PAGES:
        data = (html or "").encode()
        ids = [p for p, _, h in PAGES if (h or "") == (html or "") and p is not None]
        same = [p for p, _, h in PAGES if (h or "") == (html or "")]
        revisit = len(same) > 1 and len(data) >= least and page != (max(ids) if ids else None)
        out.append((page, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if revisit else "response", max(ids) if revisit else None))
    return X.ordered(out)


@pytest.mark.parametrize("least", [0, 5])
def test_warc_round_trip(spark, least):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumn("archive", F.lit("clash")).repartition(4)
    cols = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert plain(warc.capture_records(pages, min_bytes=least), *cols) == warc_expected(least)
    assert warc.capture_records(pages.limit(0)).count() == 0


def test_history_is_globally_ordered(spark):
    rows = [(i, f"http://h{i % 7}.example/{'hot' if i % 3 else i}", f"body {i % 50}") for i in range(3000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(6)
    folder = fresh_path(spark, "warc")
    manifest = warc.write_archives(pages, folder)
    for fan_in in (128, 2):
        history = warc.merge_runs(spark, manifest, folder, ranges=5, fan_in=fan_in)
        parts = history.select(F.spark_partition_id().alias("p"), "url_key", "captured", "page").collect()
        keys = [tuple(r)[1:] for r in parts]
        assert keys == sorted(keys) and len(keys) == 3000
        assert len({r[0] for r in parts}) > 2
    fs, path = warc.filesystem(manifest.first().archive)
    text = gzip.decompress(fs.open_input_stream(path, compression=None).read())
    assert text.startswith(b"WARC/1.1\r\nWARC-Type: ")


@pytest.mark.parametrize("hot", [50_000, 3])
def test_archives_are_entered_at_any_record(spark, monkeypatch, hot):
    """Archives cut into many ranges are read back in as many tasks; hot payloads are salted by their counts."""
    monkeypatch.setattr(warc, "SPLIT_BYTES", 2000)
    monkeypatch.setattr(warc, "HOT_ROWS", hot)
    rows = [(i, f"http://h{i % 7}.example/", None if i % 3 else f"body {i % 11} " * 40) for i in range(400)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)
    manifest = warc.write_archives(pages, fresh_path(spark, "warc"))
    found = warc.read_archives(manifest)
    assert len({r[0] for r in found.select(F.spark_partition_id()).collect()}) > 5
    same = {}
    for i, _, html in rows:
        same.setdefault(html or "", []).append(i)
    got = {r.page_id: (r.payload_bytes, r.record_type, r.refers_to) for r in found.collect()}
    assert got == {i: (len(h or ""), *(("response", None) if i == max(same[h or ""]) else ("revisit", max(same[h or ""])))) for i, _, h in rows}


def test_hot_url_is_read_once(spark, tmp_path, monkeypatch):
    """A url with a third of 200,000 captures: each range reads its own row groups and at most one at each end."""
    rows = sorted(("com,hot)/" if i % 3 == 0 else f"com,h{i})/", i, i, "u", "a", i, 1) for i in range(200_000))
    uri, n, keys = warc._write_run(str(tmp_path), iter(rows))
    firsts = [r[:3] for r in rows[:: warc.GROUP_ROWS]]
    bounds = [None, *(rows[i][:3] for i in range(5000, 200_000, 5000)), None]
    read = [len(warc.overlapping(firsts, low, high)) for low, high in zip(bounds, bounds[1:])]
    assert n == 200_000 and max(read) <= 3
    opened = []
    whole = warc.pq.ParquetFile.read_row_group
    monkeypatch.setattr(warc.pq.ParquetFile, "read_row_group", lambda self, g: opened.append(g) or whole(self, g))
    got = [row for low, high in zip(bounds, bounds[1:]) for row in warc.run_rows(uri, low, high)]
    assert got == rows and len(opened) == sum(read)
    repeated = [("k", 1, 1)] * 4
    assert warc.overlapping(repeated, ("k", 1, 1), None) == range(4) and not warc.overlapping(repeated, None, ("k", 1, 1))


def test_loser_tree():
    rng = random.Random(3)
    for k in range(0, 12):
        runs = [sorted((rng.randrange(50), i) for _ in range(rng.randrange(9))) for i in range(k)]
        assert list(warc.LoserTree([iter(r) for r in runs])) == sorted(x for r in runs for x in r)


# --- 3: substrings ------------------------------------------------------------

def test_substrings(spark, docs):
    keyed = []
    ties = {(r[0], r[1]): r[2] for r in docs.select("doc_id", "text", F.xxhash64("text")).collect()}
    for r in X.rows():
        keyed.append(((r[0] is not None, r[0] or 0, ties[(r[0], r[1])]), r[0], r[1]))
    for shards in (1, 7):
        got = substrings.substring_digests(docs, shards=shards)
        assert plain(got, "doc_id", "n_words", "n_removed", "kept_sha256") == X.ordered(X.substring(keyed))
    assert substrings.substring_digests(docs.limit(0)).count() == 0


def test_substrings_random(spark):
    rng = random.Random(5)
    words = [f"v{i}" for i in range(6)]
    some = []
    base = [" ".join(rng.choice(words) for _ in range(60)) for _ in range(12)]
    for i in range(150):
        a, b = rng.choice(base).split(), rng.choice(base).split()
        some.append((i, " ".join(a[: rng.randrange(60)] + b[rng.randrange(60) :] + ["x"] * rng.randrange(50)), None, None, None))
    got = substrings.substring_digests(X.table(spark, some).repartition(5), shards=3)
    assert plain(got, "doc_id", "n_words", "n_removed", "kept_sha256") == X.ordered(X.substring([(r[0], r[0], r[1]) for r in some]))


def test_substrings_of_long_texts_and_other_ids(spark):
    """One text far longer than a block, short ids, and ids without an order of whole numbers."""
    long = " ".join(f"u{i % 5003}" for i in range(200_000))
    some = [(1, long, None, None, None), (2, "x" * 3_000_000 + " " + " ".join(long.split()[100:160]), None, None, None), (-(2**63), "a b", None, None, None), (None, "a b", None, None, None)]
    df = X.table(spark, some)
    got = {(r.doc_id, r.n_words): r.n_removed for r in substrings.substring_digests(df).collect()}
    assert got == {(1, 200_000): 200_000 - 5003, (2, 61): 60, (-(2**63), 2): 0, (None, 2): 0}
    kinds = substrings.deduplicated_texts(df.withColumn("doc_id", F.lit(3).cast("smallint")).limit(1)).schema
    assert kinds["doc_id"].dataType.simpleString() == "smallint"
    with pytest.raises(TypeError):
        substrings.substring_digests(df.withColumn("doc_id", F.col("doc_id").cast("string")))


def test_hot_minimisers_change_nothing(spark, monkeypatch):
    some = [(i, f"own{i} words{i} here{i} {X.PASSAGE} tail{i} of{i}", None, None, None) for i in range(80)]
    expected = X.ordered(X.substring([(r[0], r[0], r[1]) for r in some]))
    lows = substrings.Segments([r[1].encode() for r in some], 20, 5).minimiser
    hot = [int(x) for x in np.unique(lows)[:40]]
    monkeypatch.setattr(substrings, "_hot_minimisers", lambda *a: hot)
    assert plain(substrings.substring_digests(X.table(spark, some), shards=5), "doc_id", "n_words", "n_removed", "kept_sha256") == expected


def test_all_repeats_come_from_intervals():
    """Places of shared sequences, a place given twice, and windows shared by different sequences, against brute force."""
    rng = random.Random(8)
    for window in (1, 3, 5):
        contents = sorted({" ".join(rng.choice("abc") for _ in range(rng.randrange(window, 12))).encode() for _ in range(30)})
        places = [(i, rng.randrange(-3, 4), rng.randrange(2), 100 * rng.randrange(6)) for i in range(len(contents)) for _ in range(rng.randrange(1, 4))]
        seen: dict[tuple, set] = {}
        for i, doc, tie, start in places:
            words = contents[i].split()
            for k in range(len(words) - window + 1):
                seen.setdefault(tuple(words[k : k + window]), set()).add((doc, tie, start + k))
        want = {p for found in seen.values() for p in found if p != min(found)}
        of, ids, ties, starts = (np.array(c, np.int64) for c in zip(*places))
        runs = substrings.indexed_repeats(contents, of, ids, ties, starts, window)
        assert {(d, t, s + k) for d, t, s, n in zip(*(c.tolist() for c in runs)) for k in range(n)} == want
    # a window that only one sequence has lies between two that others share
    gap = substrings.indexed_repeats([b"p q", b"r s", b"x p q r s"], np.arange(3), np.arange(3), np.zeros(3, np.int64), np.zeros(3, np.int64), 2)
    assert sorted(zip(*(c.tolist() for c in gap))) == [(2, 0, 1, 1), (2, 0, 3, 1)]
    alone = substrings.indexed_repeats([b"a b c"], *(np.zeros(1, np.int64) for _ in range(4)), 3)
    assert [len(c) for c in alone] == [0, 0, 0, 0]


def test_null_id_beside_the_least_id(spark):
    """The least id shares the null id's number: the two are ordered by their texts, and one of two copies loses its words."""
    text = " ".join(f"w{i}" for i in range(25))
    got = substrings.substring_digests(spark.createDataFrame([(None, text + " a"), (-(2**63), text), (1, text + " b")], "doc_id long, text string"), shards=2).collect()
    assert {r.doc_id: r.n_words for r in got} == {None: 26, -(2**63): 25, 1: 26}
    assert sorted(r.n_removed for r in got) == [0, 25, 25] and {r.n_removed for r in got if r.doc_id == 1} == {25}


def test_fm_index_counts():
    rng = np.random.default_rng(1)
    text = np.append(rng.integers(1, 5, 400), 0)
    index = fmindex.FMIndex(text, 8)
    ends = np.arange(7, 400)
    length, start = index.repeats(text, ends, 8)
    seq = text.tolist()
    for e, n, s in zip(ends, length, start):
        times = lambda k: sum(seq[i : i + k] == seq[e - k + 1 : e + 1] for i in range(400 - k + 1))  # noqa: E731,B023
        assert n == max(k for k in range(9) if k == 0 or times(k) >= 2)
        assert (s >= 0) == (n == 8)


# --- 4: lines -----------------------------------------------------------------

@pytest.mark.parametrize("limit", [lines.MAX_INDEX_BYTES, 0])
def test_lines_clash_with_no_column(spark, docs, limit):
    """Columns may have the names of everything that is computed on the way."""
    names = ["row", "n_lines", "n_dropped", "kept_text", "kept_sha256", "hits", "high", "low", "unit", "shard", "part", "data", "c0"]
    wide = docs.select("*", *(F.lit(i).alias(c) for i, c in enumerate(names)))
    assert plain(lines.line_digests(wide, max_index_bytes=limit), "doc_id", "n_lines", "n_dropped") == plain(lines.line_digests(docs), "doc_id", "n_lines", "n_dropped")
    kept = lines.drop_lines(wide, max_index_bytes=limit)
    assert kept.schema == wide.schema and plain(kept, "doc_id", "text") == plain(lines.drop_lines(docs), "doc_id", "text")
    assert kept.filter("row = 0 AND data = 11").count() == docs.count()


@pytest.mark.parametrize("limit", [lines.MAX_INDEX_BYTES, 0])
def test_lines_over_many_shards(spark, monkeypatch, limit):
    monkeypatch.setattr(lines, "KEYS_PER_SHARD", 8)
    rng = random.Random(4)
    some = [(i, "\n".join(f"line {rng.randrange(300)}" for _ in range(rng.randrange(30))), None, None, None) for i in range(200)]
    got = lines.line_digests(X.table(spark, some).repartition(5), max_index_bytes=limit)
    assert plain(got, "doc_id", "n_lines", "n_dropped", "kept_sha256") == X.ordered(X.lines([(r[0], r[1]) for r in some]))


@pytest.mark.parametrize("limit", [lines.MAX_INDEX_BYTES, 0])
def test_lines(spark, docs, pairs, limit):
    got = lines.line_digests(docs, max_index_bytes=limit)
    assert plain(got, "doc_id", "n_lines", "n_dropped", "kept_sha256") == X.ordered(X.lines(pairs))
    kept = lines.drop_lines(docs, max_index_bytes=limit)
    assert kept.columns == docs.columns and kept.count() == docs.count()
    assert {r.doc_id: r.text for r in kept.filter("doc_id >= 100").collect()} == {100 + i: f"own line {i}" for i in range(12)}
    assert kept.filter("doc_id = 0 AND text IS NULL").count() == 1
    assert lines.line_digests(docs.limit(0), max_index_bytes=limit).count() == 0


@pytest.mark.parametrize("limit", [lines.MAX_INDEX_BYTES, 0])
def test_one_line_index_for_any_threshold(spark, monkeypatch, limit):
    monkeypatch.setattr(lines, "KEYS_PER_SHARD", 16)
    rng = random.Random(8)
    some = [(i, "\n".join(f"line {min(rng.randrange(60), rng.randrange(60))}" for _ in range(rng.randrange(8))), None, None, None) for i in range(60)]
    docs = X.table(spark, some)
    for least in (1, 2, 3, 7, 30):
        got = lines.line_digests(docs, min_docs=least, max_index_bytes=limit)
        assert plain(got, "doc_id", "n_lines", "n_dropped", "kept_sha256") == X.ordered(X.lines([(r[0], r[1]) for r in some], least))


def test_lines_that_share_half_a_hash():
    high, low, n = np.array([5, 5, 9, 5], np.uint64), np.array([1, 2, 1, 3], np.uint64), np.array([4, 6, 2**40, 8])
    shard = lines.Shard.loads(lines.Shard.build(high, low, n).dumps())
    assert shard.counts(high, low).tolist() == [4, 6, lines.MOST, 8]
    assert shard.counts(np.array([5, 9, 7], np.uint64), np.array([4, 2, 1], np.uint64)).tolist() == [1, 1, 1]


def test_perfect_hash():
    keys = np.unique(np.random.default_rng(2).integers(0, 2**64, 5000, np.uint64))
    perfect = lines.PerfectHash.build(keys)
    assert sorted(perfect.slots(keys).tolist()) == list(range(len(keys)))
    assert len(lines.PerfectHash.build(keys[:0]).slots(keys)) == len(keys)


# --- 5: BPE -------------------------------------------------------------------

def test_bpe_round_trip(docs, pairs):
    codec = bpe.codec(RANKS, public_tokenizers.PATTERN)
    expected = []
    for d, t in pairs:
        ids = codec.encoding.encode_ordinary(t or "")
        expected.append((d, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), X.sha(t or "")))
    got = bpe.token_digests(docs, RANKS, public_tokenizers.PATTERN)
    assert plain(got, "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == X.ordered(expected)
    back = bpe.decode(bpe.encode(docs, RANKS, public_tokenizers.PATTERN), RANKS, public_tokenizers.PATTERN)
    assert X.ordered((r.doc_id, bytes(r.bytes)) for r in back.collect()) == X.ordered((d, (t or "").encode()) for d, t in pairs)


def test_bpe_cuts_are_safe():
    codec = bpe.codec(RANKS, public_tokenizers.PATTERN)
    for t in X.TEXTS:
        data = (t or "").encode()[:3000].decode(errors="ignore").encode()
        whole = codec.encoding.encode_ordinary(data.decode())
        for size in (1, 7, 50):
            parts = codec.parts(data, size)
            assert b"".join(parts) == data
            assert [i for p in parts for i in codec.encoding.encode_ordinary(p.decode())] == whole


def test_bpe_encodes_any_long_text():
    """No cut changes the ids, and texts that overflow the library's regex are encoded as the pattern says."""
    codec, rng = bpe.codec(RANKS, public_tokenizers.PATTERN), random.Random(1)
    alphabet = ["a", "B", "7", " ", "  ", "\n", "\t", "'", "'s", "!", "-", "好", "。", "，", "ж", "\u3000", "\u00a0", "é", "'re", "\x1c", "ab12"]
    for _ in range(1500):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 40)))
        whole = codec.encoding.encode_ordinary(text)
        for size, run in ((1, 1), (3, 2), (7, 5)):
            parts = codec.parts(text.encode(), size, run)
            assert b"".join(parts) == text.encode()
            assert [i for p in parts for i in codec.encoding.encode_ordinary(p.decode())] == whole
    for text in (" " * 300_000, "x" + " " * 300_000 + "y", "\n" * 200_000 + "a", "a " * 200_000, "\u3000" * 100_000 + " b"):
        assert codec.encode(text.encode()) == codec.encoding.encode_ordinary(text)
    for text in (" " * 2_000_000, "\n" * 2_000_000, "a" * 1_000_000, "好的" * 400_000, "aB3/+x9Q" * 200_000, "x" + "\u3000" * 1_000_000 + "y"):
        assert codec.decode(codec.encode(text.encode())) == text.encode()


# --- 6: language --------------------------------------------------------------

def test_language_accuracy(spark):
    from conftest import DATA

    d = spark.read.parquet(f"{DATA}/documents.parquet")
    got = langid.identify(d).join(d.select("doc_id", "lang"), "doc_id").filter("held_out")
    assert got.filter("lang = lang_pred").count() >= 0.95 * got.count() > 0
    assert got.filter("score < 0 OR score > 1").count() == 0


def test_language_brute_force(spark):
    train = [(1, "the cat sat", "en"), (2, "der Hund saß über", "de"), (3, "the dog", "en"), (4, None, "en"), (5, "x", None)]
    model = langid.fit(spark.createDataFrame(train, "doc_id long, text string, lang string"))
    assert model.langs == ("de", "en")

    def bits(lang, text):
        data = [[0, 0, 0, *t.encode()] for _, t, x in train if x == lang and t]
        total, s = 0.0, [0, 0, 0, *text.encode()]
        for i in range(3, len(s)):
            p = 1 / langid.ALPHABET
            for k in range(0, 4):
                c = [x[j] for x in data for j in range(3, len(x)) if x[j - k : j] == s[i - k : i]]
                if c:
                    n, d = c.count(s[i]), len(set(c))
                    p = n / (len(c) + d) if n else d / (len(c) + d) * p
            total -= np.log2(p)
        return total + -np.log2(sum(x == lang and t is not None for _, t, x in train) / 3)

    scorer = langid.Scorer(model)
    for text in ("the", "der", "über saß", "zzz the"):
        e = np.array([bits(x, text) for x in model.langs])
        lang, p = scorer([text.encode()])[0]
        assert lang == model.langs[int(e.argmin())]
        assert p == pytest.approx(1 / np.exp2(e.min() - e).sum(), rel=1e-4)


SCRIPTS = {
    "ru": "который ещё этот больше после время если только может быть первый объект здесь нашей съезд эти была мы вы они сыр рынок",
    "uk": "який ще цей більше після час якщо тільки може бути перший об'єкт тут нашої з'їзд ці була ми ви вони сир ринок їжа є",
    "el": "και είναι που για από αυτό μια δεν στο όμως μετά χρόνος πρώτος μπορεί εδώ αγορά νερό ημέρα",
    "he": "של את על לא הוא היא זה אני אתה אבל אחרי זמן ראשון יכול כאן שוק מים יום",
    "ar": "من في على هذا التي كان بعد وقت أول يمكن هنا سوق ماء يوم كل بين حتى",
    "fa": "از در که این را است برای بعد وقت اول می‌تواند اینجا بازار آب روز همه بین تا پنج گفت چه",
    "hi": "और है के लिए यह वह नहीं में पर समय पहला यहाँ बाजार पानी दिन सब बीच तक",
    "mr": "आणि आहे साठी हा तो नाही मध्ये वर वेळ पहिला येथे बाजार पाणी दिवस सर्व पर्यंत",
}
LATIN = "über größe füße naïve déjà façade ångström øre señor ação coração été œuvre çà là où hôtel île août žena čas říz šest łódź ćma ńa ś ż ğ ş ı ő ű đ þ æ"


def test_language_minority_scripts(spark):
    """Languages of other scripts keep their bytes where a Latin-script source holds most text."""
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choices(LATIN.split(), k=60)), "la") for i in range(600)]
    for lang, words in SCRIPTS.items():
        rows += [(len(rows) + i, " ".join(rng.choices(words.split(), k=4)), lang) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    got = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out AND lang <> 'la'").collect()
    right = sum(r.lang == r.lang_pred for r in got) / len(got)
    print(f"held-out accuracy, {len(got)} documents: {right:.4f}")
    assert right >= 0.97


def test_language_tables_have_all_that_was_seen():
    rng = np.random.default_rng(3)
    codes = np.unique(rng.integers(0, 2**32, 5000, np.uint32))
    table = langid.CodeTable(codes[::2])
    assert (table.keys[table.find(codes[::2])] == codes[::2]).all() and (table.find(codes[1::2]) == table.n).all()
    model = langid.LanguageModel("k", ("a", "b"), (1, 3), *((x.tobytes(), y.tobytes()) for x, y in ((codes[:9], codes[4:20]), (np.arange(1, 10), np.arange(1, 17)))))
    bits = langid.Scorer(model).rare(np.concatenate((codes[:30], np.array([0], np.uint32))))
    assert bits.shape == (31, 2) and (bits > 0).all()


def test_language_edges(spark, docs):
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(docs).collect()}
    assert got[0] == got[1] == got[2] == got[3] == ("und", 0.0)
    assert got[4][0] in ("en", "de")
    kept = langid.keep_identified(docs)
    assert kept.columns == docs.columns and kept.filter("doc_id IN (0, 1, 2, 3)").count() == 0
    none = langid.identify(docs.withColumn("lang", F.lit(None).cast("string")))
    assert none.filter("lang_pred <> 'und'").count() == 0
    assert langid.identify(docs.limit(0)).count() == 0


# --- 7: token counts ----------------------------------------------------------

def test_token_counts(docs, pairs):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(WORDS)
    expected = [(d, len((t or "").encode()), n := len(library.encode(t or "", add_special_tokens=False)), n > 2048) for d, t in pairs]
    got = counts.token_counts(docs, WORDS)
    assert plain(got, "doc_id", "n_bytes", "n_tokens", "over_limit") == X.ordered(expected)


PIECES = ["a", "b", "the", "ing", "'", "'s", "'t", "'re", "'rx", "'ve", "'l", "'ll", "'m", "!", "..", "1", "23", " ", "  ", "\n", "É", "é", "ß", "ü", "A", "Re", "S", "-", "_", "日", "\x01", "<|endoftext|>", "<", "|", "×", "÷", "''", "'r", " '"]


def test_transducer_equals_library():
    """Any cut into chunks gives the library's counts: contractions, marks, digits, Latin-1 letters, foreign words."""
    from tokenizers import Tokenizer

    library, machine, rng = Tokenizer.from_file(WORDS), counts.transducer(WORDS), random.Random(1)
    some = ["".join(rng.choice(PIECES) for _ in range(rng.randrange(0, 60))) for _ in range(1500)] + [(t or "")[:3000] for t in X.TEXTS]
    want = [len(library.encode(t, add_special_tokens=False)) for t in some]
    for chunk in (1, 3, 64, 1 << 20):
        assert machine.count([t.encode() for t in some], chunk).tolist() == want


FOREIGN = ["привет", "ЖУК", "İ", "ſ", "Σ", "ς", "é", "\u0301", "٣", "½", "²", "\u00a0", "\u3000", "हिन्दी", "ไทย", "한국어", "ㄱ", "\u1100\u1161", "😀", "\ue000", "ﬁ", "żółw", "ğ", "—", "’s", "\x85", "\x1c", "ǅ", "𝒜", "Ⅷ", "\ufeff", "\u200b", "本語", "\x00"]


def test_all_scripts_run_through_the_transducer():
    """Words of any script and normal form equal the library's, which counts words with a special string only."""
    from tokenizers import Tokenizer

    library, machine, rng = Tokenizer.from_file(WORDS), counts.CountTransducer(WORDS), random.Random(3)
    points = [c for c in range(0x20, 0x20000) if not 0xD800 <= c < 0xE000]
    some = ["".join(rng.choice(PIECES + FOREIGN) for _ in range(rng.randrange(0, 60))) for _ in range(800)]
    some += ["".join(chr(rng.choice(points)) if rng.random() < 0.7 else rng.choice(" a1'") for _ in range(rng.randrange(0, 40))) for _ in range(800)]
    want = [len(e) for e in library.encode_batch(some, add_special_tokens=False)]
    asked: list[bytes] = []
    real = machine._library
    machine._library = lambda words: (asked.extend(words), real(words))[1]
    for chunk in (1, 7, 512):
        assert machine.count([t.encode() for t in some], chunk).tolist() == want
    assert asked and all(b"<|" in w for w in asked)
    asked.clear()
    whole = ["żółw gęś łąka ćma", "съешь ещё этих мягких булок", "".join(chr(0x4E00 + rng.randrange(900)) for _ in range(5000)), "पानी 水 მთა ہے"]
    assert machine.count([t.encode() for t in whole]).tolist() == [len(library.encode(t, add_special_tokens=False)) for t in whole]
    assert not asked


def test_maps_without_a_reset_are_composed(monkeypatch):
    """Wrong guesses of entering states only add rows to the maps: counts are the same without any run-up."""
    from tokenizers import Tokenizer

    library, rng = Tokenizer.from_file(WORDS), random.Random(4)
    some = ["".join(rng.choice("abcdeing") for _ in range(3000)), "a" * 4001, "!?" * 1500 + "x" * 900, "ab " + "水火木" * 700 + " c", "½" * 500, ""]
    want = [len(library.encode(t, add_special_tokens=False)) for t in some]
    for run_up in (0, 5, counts.RUN_UP):
        monkeypatch.setattr(counts, "RUN_UP", run_up)
        machine = counts.CountTransducer(WORDS)
        for chunk in (2, 16, 100):
            assert machine.count([t.encode() for t in some], chunk).tolist() == want


def test_token_counts_of_an_empty_table(docs):
    assert counts.token_counts(docs.limit(0), WORDS).collect() == []


def test_long_words_run_through_many_chunks():
    from tokenizers import Tokenizer

    library, machine, rng = Tokenizer.from_file(WORDS), counts.CountTransducer(WORDS), random.Random(2)
    some = ["a" * 50_000, "".join(rng.choice("abc") for _ in range(20_000)), "!" * 30_000, "x" * 3000 + " y " + "z" * 3000, "日本" * 5000, " " * 10_000, ""]
    assert machine.count([t.encode() for t in some]).tolist() == [len(library.encode(t, add_special_tokens=False)) for t in some]


def test_small_tables_start_afresh():
    small, text = counts.CountTransducer(WORDS, limit=3), b"one two three four five one"
    first = small.count([text])
    assert small.n > 3 and (small.count([text]) == first).all() and (counts.transducer(WORDS).count([text]) == first).all()


def test_merges_equal_library():
    from tokenizers import Tokenizer

    library, machine, rng = Tokenizer.from_file(WORDS), merges.MergeMachine(WORDS), random.Random(1)
    words = ["".join(rng.choice("abcdeéß") for _ in range(rng.randrange(1, 30))) for _ in range(500)] + ["a" * n for n in range(1, 20)]
    words += ["".join(rng.choice("!?.-#*_=+/") for _ in range(rng.randrange(1, 12))) for _ in range(300)]
    assert [machine.count(w.encode()) for w in words] == [len(library.encode(w, add_special_tokens=False)) for w in words]


# --- 8: near duplicates -------------------------------------------------------

def test_near_duplicates(docs, pairs):
    for n in (4, 5):
        got = neardup.components(docs, n=n, share=80)
        assert plain(got, "doc_id", "n_shingles", "component_id", "kept") == X.ordered(X.near(pairs, n, 80))
    assert neardup.components(docs.limit(0)).count() == 0
    kept = neardup.keep_first(docs)
    assert kept.columns == docs.columns


def test_keep_first_judges_rows(spark):
    """One row of each group stays; rows that only share an id, or have none, are judged by their own texts."""
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(40)) for x in "abcd")
    some = [
        (3, a, "en", None, None), (5, a + " more", "en", None, None), (None, "no id " + a, None, None, None),
        (5, "clean text under an id that goes", "en", None, None), (None, "unique without an id", None, None, None),
        (None, None, None, None, None), (None, "", None, None, None), (8, "", None, None, None), (8, "", None, None, None),
        (6, b, "en", "x", None), (6, b, "de", None, "y"), (6, b, "de", None, "y"), (9, b, "en", None, None),
        (None, c, "en", None, None), (None, c, "en", None, None), (None, c + " tail", "en", None, None),
        (7, d, None, None, None), (7, d + " tail", None, None, None),
    ]
    df = X.table(spark, some).repartition(3)
    kept = neardup.keep_first(df)
    assert kept.schema == df.schema
    found = [tuple(r) for r in kept.collect()]
    assert all(r in some for r in found)
    # brute force: groups of rows, not of ids
    groups = {}
    for i, (_, _, comp, _) in enumerate(X.near([(i, r[1]) for i, r in enumerate(some)], 5, 80)):
        groups.setdefault(comp, []).append(some[i])
    expected = [min(g, key=lambda r: (r[0] is None, r[0] or 0, hashlib.md5((r[1] or "").encode()).digest()))[:2] for g in groups.values()]
    assert X.ordered(r[:2] for r in found) == X.ordered(expected)


def test_near_duplicate_chains(spark):
    """A family whose members are linked only through one another, at and around the threshold."""
    rng = random.Random(11)
    base = [f"t{i}" for i in range(120)]
    some = []
    for i in range(90):
        w = list(base)
        for _ in range(rng.randrange(0, 9)):
            w[rng.randrange(len(w))] = f"e{rng.randrange(400)}"
        some.append((i, " ".join(w), None, None, None))
    got = neardup.components(X.table(spark, some).repartition(4), n=4)
    assert plain(got, "doc_id", "n_shingles", "component_id", "kept") == X.ordered(X.near([(r[0], r[1]) for r in some], 4, 80))


def test_near_duplicates_take_few_stages(spark):
    """Components of a family cost few shuffles: with many partitions, stages of small tasks were what took the time."""
    rng = random.Random(11)
    base = [f"t{i}" for i in range(120)]
    some = []
    for i in range(90):
        w = list(base)
        for _ in range(rng.randrange(0, 9)):
            w[rng.randrange(len(w))] = f"e{rng.randrange(400)}"
        some.append((i, " ".join(w), None, None, None))
    spark.sparkContext.setJobGroup("few stages", "")
    try:
        got = neardup.components(X.table(spark, some).repartition(4), n=4).collect()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(got) == 90
    seen = spark.sparkContext.statusTracker()
    stages = {s for j in seen.getJobIdsForGroup("few stages") for s in seen.getJobInfo(j).stageIds}
    # 114 before components were contracted to parents
    assert 0 < sum(bool((x := seen.getStageInfo(s)) and x.numCompletedTasks) for s in stages) < 95


def test_registers_estimate_similarity():
    rng = np.random.default_rng(4)
    both, a, b = (rng.integers(0, 2**64, n, np.uint64) for n in (800, 100, 100))
    x, y = (neardup.registers(np.unique(np.concatenate((both, s)))) for s in (a, b))
    found = neardup.estimate((x == y).mean(), np.array([900]), np.array([900]))[0]
    assert abs(found - 0.8) < 0.15
    assert (neardup.registers(both) >> 10).max() < 64


def test_word_hashes_depend_on_words_only():
    one, two = hashing.Words([b"a bb  ccc", b"bb"], spelled=True), hashing.Words([b"xx\tbb", b"", b"ccc a"])
    for lane in (0, 1):
        a, b = one.lanes[lane], two.lanes[lane]
        assert a[1] == a[3] == b[1] and a[2] == b[2] and a[0] == b[3]
    assert two.bounds.tolist() == [0, 2, 2, 4]
    assert [one.data[x:y] for x, y in zip(one.starts, one.ends)] == [b"a", b"bb", b"ccc", b"bb"]


def test_long_texts_are_hashed_in_blocks(monkeypatch):
    text = " ".join(f"w{i % 97}" for i in range(5000)).encode()
    whole = hashing.Words([text, b"tail"], spelled=True)
    assert b" ".join(hashing.blocks(text, 100)) == text
    monkeypatch.setattr(hashing, "BLOCK", 64)
    cut = hashing.Words([text, b"tail"], spelled=True)
    assert (cut.lanes == whole.lanes).all() and cut.data == whole.data and (cut.starts == whole.starts).all() and cut.bounds.tolist() == [0, 5000, 5001]


def test_words_of_one_polynomial_hash_are_told_apart(spark):
    """A Thue-Morse word and its complement agree in every polynomial hash with an odd base modulo 2 ** 64; here they are different words."""
    morse = "".join("ab"[bin(i).count("1") % 2] for i in range(2048))
    other = morse.translate(str.maketrans("ab", "ba"))
    some = [(1, morse, None, None, None), (2, other, None, None, None), (3, f"{morse} x y z", None, None, None), (4, f"{other} x y z", None, None, None), (5, morse, None, None, None)]
    got = {r.doc_id: r.component_id for r in neardup.components(X.table(spark, some), n=4).collect()}
    assert got == {1: 1, 2: 2, 3: 3, 4: 4, 5: 1}


def test_string_ids_and_one_huge_group(spark):
    """Ids need only an order; thousands of copies and a chain beside them give one component each."""
    a, b = (" ".join(f"{x}{i}" for i in range(60)) for x in "ab")
    rows = [(f"k{i:05}", a if i % 2 else a + f" t{i % 7}") for i in range(2000)] + [("zz", b), (None, b)]
    got = neardup.components(spark.createDataFrame(rows, "doc_id string, text string").repartition(5), n=4).collect()
    assert {r.component_id for r in got if r.doc_id not in ("zz", None)} == {"k00000"}
    assert {r.component_id for r in got if r.doc_id in ("zz", None)} == {"zz"}


def test_exact_sets_equal_sets_of_words():
    rng = random.Random(9)
    batch = [" ".join(rng.choice("a b c dd".split()) for _ in range(rng.randrange(0, 40))).encode() for _ in range(30)]
    for n in (1, 4, 5):
        real = [{tuple(w[i : i + n]) for i in range(len(w) - n + 1)} for w in (t.split() for t in batch)]
        found = neardup.exact_sets(batch, n)
        for i in range(30):
            for j in range(i):
                if real[i] and real[j]:
                    assert len(np.intersect1d(found[i], found[j])) == len(real[i] & real[j])


# --- 9: quality rules ---------------------------------------------------------

def test_quality(docs, pairs):
    rows = rules.ledger(docs)
    got = plain(rows, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    assert got == X.ordered((d, *X.quality(t)) for d, t in pairs)
    judged = rules.judge(rows, "strict-1")
    assert judged.filter("base_failed AND kept").count() == 0
    for r in judged.collect():
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
    table = {r.rule: r for r in rules.ablate(rows, "strict-1").collect()}
    n = rows.count()
    assert all(t.n_docs == n and t.n_kept == judged.filter("kept").count() and t.n_kept_without == t.n_kept + t.n_failing_alone for t in table.values())
    assert rules.ablate(rows.limit(0), "base-1").filter("n_docs = 0").count() == 2


# --- 10: licences -------------------------------------------------------------

def test_licences(docs, pairs):
    expected = []
    for d, t in pairs:
        w, places, labels = X.alnum(t), [], set()
        for phrase, label in licences.PHRASES.items():
            p = phrase.split()
            found = [i for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
            places += found
            labels |= {label} if found else set()
        expected.append((d, len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))))
    got = licences.scan_licences(docs)
    assert plain(got, "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels") == X.ordered(expected)
    by = {r.doc_id: r for r in got.collect()}
    assert by[16].labels == "mit" and by[16].base_labels == "" and 0 < by[16].score < 1
    assert by[16].spans[0].first_word == 0 and by[16].spans[0].edits == 2
    assert by[15].labels == "apache,cc-by,mit" and by[15].score == 1.0
    assert by[0].labels == "" and by[0].score == 0.0


def test_licences_in_long_texts():
    """Many notices and very long words: positions are right, and a word cut for a window is no word end."""
    scanner = licences.Scanner()
    row, spans = scanner.scan(b"released under the mit license " * 2000)
    assert row[:4] == (10_000, 2000, 3, 9998) and [s.first_word for s in spans] == list(range(0, 10_000, 5))
    for text in (b"mozilla" * 20_000, b"x" * 500 + b"mozilla public license" + b"y" * 500, ("ü" * 3000 + " end").encode()):
        assert scanner.scan(text)[0][4:] == ("", "", 0.0)
    assert scanner.scan(b"x" * 5000 + b" mozila public license " + b"y" * 5000)[0][5] == "mpl"


def test_seeds_lose_no_notice():
    """Every text within the error bound is found (pigeonhole), whatever the edits."""
    rng, text, k = random.Random(8), "mozilla public license", 2
    scanner = licences.Scanner({}, [("mpl", text, k)])
    for _ in range(300):
        s = list(text)
        for _ in range(rng.randrange(k + 1)):
            i = rng.randrange(1, len(s) - 1)
            s[i : i + 1] = rng.choice([[], [s[i], "q"], ["z"]])
        assert scanner.scan(f"some words before {''.join(s)} and after".encode())[0][5] == "mpl"


# --- very long texts ----------------------------------------------------------

def test_very_long_texts(spark):
    """One huge word, nothing but white space, and very many words, through every operator that reads documents."""
    word, blank, many = "a" * 1_500_000, " \n" * 400_000, "The quick, brown fox! " * 60_000
    some = [(1, word, "en", None, None), (2, blank, "en", None, None), (3, many, "en", None, None), (4, many + "end", "de", None, None), (5, word, None, None, None)]
    df = X.table(spark, some).repartition(2)
    items = spark.createDataFrame([(1, "quick brown fox the quick brown fox the quick brown fox the quick")], "item_id long, text string")
    by = lambda out, *cols: {r.doc_id: tuple(r[c] for c in cols) for r in out.collect()}
    assert by(decontaminate.flag(df, items), "n_words", "contaminated") == {1: (1, False), 2: (0, False), 3: (240_000, True), 4: (240_001, True), 5: (1, False)}
    assert by(substrings.substring_digests(df), "n_words", "n_removed") == {1: (1, 0), 2: (0, 0), 3: (240_000, 239_996), 4: (240_001, 240_000), 5: (1, 0)}
    assert by(lines.line_digests(df), "n_lines", "n_dropped") == {1: (1, 0), 2: (400_001, 0), 3: (1, 0), 4: (1, 0), 5: (1, 0)}
    assert {k: v[1] for k, v in by(bpe.token_digests(df, RANKS, public_tokenizers.PATTERN), "n_tokens", "decoded_sha256").items()} == {r[0]: X.sha(r[1]) for r in some}
    langs = by(langid.identify(df), "lang_pred")
    assert langs[2] == ("und",) and set(langs) == {1, 2, 3, 4, 5}
    assert by(counts.token_counts(df, WORDS), "n_bytes", "over_limit") == {r[0]: (len(r[1]), r[0] != 2) for r in some}
    assert by(neardup.components(df, n=4), "n_shingles", "component_id") == {1: (1, 1), 2: (0, 2), 3: (4, 3), 4: (5, 3), 5: (1, 1)}
    assert by(rules.ledger(df), "n_words", "n_repeat_words") == {1: (1, 0), 2: (0, 0), 3: (240_000, 240_000), 4: (240_001, 240_000), 5: (1, 0)}
    assert by(licences.scan_licences(df), "n_words", "labels") == {1: (1, ""), 2: (0, ""), 3: (240_000, ""), 4: (240_001, ""), 5: (1, "")}


# --- pipeline -----------------------------------------------------------------

def test_pipeline_brute_force(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(2)
    vocabulary = [f"word{i}" for i in range(500)]
    some = [(i, " ".join(rng.choice(vocabulary) for _ in range(80)) + "\nfooter line", "en", None, None) for i in range(30)]
    some += [(50 + i, some[i][1], "en", None, None) for i in range(5)]
    some += [(60, "12345 !!!", "en", None, None), (61, None, "en", None, None), (62, X.PASSAGE, "en", None, None)]
    X.table(spark, some).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, X.PASSAGE)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r.doc_id: r.decoded_sha256 for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert got == {r[0]: X.sha(r[1].removesuffix("\nfooter line")) for r in some[:30]}
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns


def test_pipeline_on_awkward_rows(spark, tmp_path):
    """Nulls, empty texts, shared ids and repeated rows through all stages, against brute force by rows; empty tables give no rows."""
    import corpus_pipeline

    awkward = [(r[0], (r[1] or "") + " and words of its own " + str(i) if i % 4 == 0 and r[1] else r[1], r[2], r[3], r[4]) for i, r in enumerate(X.rows())]
    rng = random.Random(3)
    awkward += [(200 + i, " ".join(rng.choice(["shared", "words", "row", "of", f"only{i}", "text"]) for _ in range(30)), "en", None, None) for i in range(20)]
    awkward += [awkward[-1], (None, awkward[-2][1], "en", None, None)]
    X.table(spark, awkward).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    left = [(r.doc_id, r.text) for r in langid.keep_identified(docs).collect()]
    seen = {}
    for _, t in left:
        for k in {X.lower(x.strip(" \t\n\x0b\x0c\r")) for x in t.split("\n")}:
            seen[k] = seen.get(k, 0) + 1
    cut = [(d, "\n".join(x for x in t.split("\n") if not (k := X.lower(x.strip(" \t\n\x0b\x0c\r"))) or seen[k] < 10)) for d, t in left]
    groups = {}
    for i, (_, n, comp, _) in enumerate(X.near([(i, t) for i, (_, t) in enumerate(cut)], 5, 80)):
        groups.setdefault(comp if n else ("none", i), []).append(cut[i])
    unique = [min(g, key=lambda r: (r[0] is None, r[0] or 0, hashlib.md5(r[1].encode()).digest())) for g in groups.values()]
    clean = [u for u, r in zip(unique, X.decontaminate(unique, ITEMS), strict=True) if not r[5]]
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert plain(got, "doc_id", "decoded_sha256") == X.ordered((d, X.sha(t)) for d, t in clean)
    for i, gone in enumerate(("documents", "benchmark")):
        other = tmp_path / f"empty{i}"
        for name in ("documents", "benchmark"):
            table = spark.read.parquet(f"{tmp_path}/{name}.parquet")
            (table.limit(0) if name == gone else table).write.parquet(f"{other}/{name}.parquet")
        assert (corpus_pipeline.run(spark, str(other)).count() == 0) == (gone == "documents")
