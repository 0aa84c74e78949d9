"""Language identification by prediction by partial matching over bytes.

Each language has a variable-order context tree of depth ORDER over all 256 byte
values. Training counts every position of every training text in Spark, as sparse rows
(language, context and byte, count); then the statistics are frozen. The probability of
a byte after a context uses escape method C: n / (N + d) if it was seen there, else the
escape probability d / (N + d) times its probability after the next shorter context,
down to a uniform one. As nothing adapts, the code lengths of all (context, byte) that
were really seen are rows of hashed tables, one column a language, and a text's code
length under a language is a sum.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from furrow.llm.text import annotate, held, rewrite, slices, texts, tidy
from furrow.session import materialise

ORDER = 3
#: Every byte is a symbol; a code of (context, symbol) fills 32 bits.
ALPHABET = 256
#: Before its first byte a text counts as NULs.
_PAD = b"\0" * ORDER
#: (context, symbol) counts that a task holds before it sends them on.
HELD = 1 << 20
#: Bytes of text whose contexts are looked up at one time.
PIECE = 512 << 10
#: Most bytes of the packed statistics, which are broadcast: checked when they are collected.
MAX_MODEL_BYTES = 512 << 20
_LETTER = re.compile(rb"[A-Za-z]")


def pieces(data: list[bytes]) -> Iterator[tuple[list[int], list[bytes]]]:
    """All texts in order, in groups of about PIECE bytes: text numbers, and parts that begin with the ORDER bytes before them."""
    owners: list[int] = []
    parts: list[bytes] = []
    held = 0
    for i, t in enumerate(data):
        for at in range(0, len(t), PIECE):
            part = t[max(0, at - ORDER) : at + PIECE] if at else _PAD + t[:PIECE]
            owners.append(i)
            parts.append(part)
            held += len(part)
            if held >= PIECE:
                yield owners, parts
                owners, parts, held = [], [], 0
    if parts:
        yield owners, parts


def gram_codes(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes (uint32) of (context, symbol) at every byte of each part but its first ORDER, and each part's range; codes between ranges belong to no part."""
    symbols = np.frombuffer(b"".join(parts), np.uint8).astype(np.uint32)
    codes = symbols[ORDER:].copy()
    for k in range(1, ORDER + 1):
        codes |= symbols[ORDER - k : len(symbols) - k] << np.uint32(8 * k)
    sizes = np.fromiter(map(len, parts), np.int64, len(parts)) - ORDER
    ends = np.cumsum(sizes + ORDER) - ORDER
    return codes, ends - sizes, ends


def summed(codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct codes and their summed counts."""
    order = np.argsort(codes, kind="stable")
    codes, counts = codes[order], counts[order]
    first = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1]))) if len(codes) else np.zeros(0, np.int64)
    return codes[first], np.add.reduceat(counts, first) if len(first) else counts


class CodeTable:
    """Row numbers of distinct uint32 codes by a hash into sorted buckets; rows are in the order of `keys`."""

    def __init__(self, codes: np.ndarray):
        bits = max(4, (2 * len(codes)).bit_length())
        self.shift = np.uint32(32 - min(bits, 31))
        at = self.slot(codes)
        self.order = np.argsort(at, kind="stable")
        self.keys = np.append(codes[self.order], np.uint32(0))
        self.n = len(codes)
        self.starts = np.searchsorted(at[self.order], np.arange((1 << min(bits, 31)) + 1)).astype(np.int32)

    def slot(self, codes: np.ndarray) -> np.ndarray:
        return ((codes ^ (codes >> np.uint32(15))) * np.uint32(0x9E3779B1)) >> self.shift

    def find(self, codes: np.ndarray) -> np.ndarray:
        """Row of each code, or the number of rows if it has none."""
        slot = self.slot(codes)
        at = self.starts[slot]
        out = np.where((self.keys[at] == codes) & (at < self.n), at, np.int32(self.n))
        open_ = np.flatnonzero(out == self.n)
        at, end, codes = at[open_] + np.int32(1), self.starts[slot[open_] + np.uint32(1)], codes[open_]
        while len(open_):
            more = at < end
            open_, at, end, codes = open_[more], at[more], end[more], codes[more]
            hit = self.keys[at] == codes
            out[open_[hit]] = at[hit]
            open_, at, end, codes = open_[~hit], at[~hit] + np.int32(1), end[~hit], codes[~hit]
        return out


def code_lengths(grams: list[np.ndarray], counts: list[np.ndarray]) -> list[tuple]:
    """Per depth 0..ORDER: table and bits of every (context, symbol) seen, table and escape bits of every context seen.

    Bits have one column a language and, at the end, a row of zeros for what wasn't seen.
    A symbol that a language has not seen after a context has its escapes added up.
    """
    levels, n = [], len(grams)
    for k in range(ORDER + 1):
        mask = np.uint32((1 << 8 * (k + 1)) - 1)
        own = [summed(g & mask, c) for g, c in zip(grams, counts, strict=True)]
        seen = np.unique(np.concatenate([g for g, _ in own]))
        table, contexts = CodeTable(seen), CodeTable(np.unique(seen >> np.uint32(8)))
        seen = table.keys[:-1]
        bits, escape = np.zeros((len(seen) + 1, n), np.float32), np.zeros((contexts.n + 1, n), np.float32)
        if k:
            below, lower = levels[-1][0], levels[-1][1]
            bits[:-1] = lower[below.find(seen & np.uint32((1 << 8 * k) - 1))]
        else:
            bits[:-1] = np.log2(ALPHABET)
        of = contexts.find(seen >> np.uint32(8))
        for i, (g, c) in enumerate(own):
            at, ctx = table.find(g), contexts.find(g >> np.uint32(8))
            total, kinds = np.bincount(ctx, c, contexts.n + 1), np.bincount(ctx, minlength=contexts.n + 1)
            known = kinds > 0
            escape[known, i] = np.log2((total + kinds)[known] / kinds[known])
            bits[:-1, i] += escape[of, i]
            bits[at, i] = np.log2((total + kinds)[ctx] / c)
        levels.append((table, bits, contexts, escape))
    return levels


@dataclass(frozen=True)
class LanguageModel:
    """Frozen statistics: sorted sparse (context, symbol) counts of each language, only of what was seen."""

    key: str
    langs: tuple[str, ...]
    docs: tuple[int, ...]
    grams: tuple[bytes, ...]
    counts: tuple[bytes, ...]


class Scorer:
    def __init__(self, model: LanguageModel):
        self.key, self.langs = model.key, model.langs
        if self.langs:
            self.levels = code_lengths([np.frombuffer(g, np.uint32) for g in model.grams], [np.frombuffer(c, np.int64) for c in model.counts])
        docs = np.array(model.docs, float)
        self.prior = -np.log2(docs / docs.sum()) if len(docs) else docs

    def rare(self, codes: np.ndarray) -> np.ndarray:
        """Bits (one column a language) of codes that no language has seen."""
        out = np.zeros((len(codes), len(self.langs)))
        left = np.arange(len(codes))
        for k in range(ORDER, -1, -1):
            table, bits, contexts, escape = self.levels[k]
            now = codes[left] & np.uint32((1 << 8 * (k + 1)) - 1)
            rows = table.find(now)
            out[left] += bits[rows]
            left, now = left[rows == table.n], now[rows == table.n]
            out[left] += escape[contexts.find(now >> np.uint32(8))]
        out[left] += np.log2(ALPHABET)
        return out

    def __call__(self, batch: list[bytes | None]) -> list[tuple[str, float]]:
        out = [("und", 0.0)] * len(batch)
        known = [i for i, t in enumerate(batch) if t and (_LETTER.search(t) or any(map(str.isalpha, t.decode())))]
        if not known or not self.langs:
            return out
        table, seen = self.levels[ORDER][:2]
        total = np.tile(self.prior, (len(known), 1))
        for owners, parts in pieces([batch[i] for i in known]):
            codes, starts, ends = gram_codes(parts)
            rows = table.find(codes)
            new = np.flatnonzero(rows == table.n)
            more = self.rare(codes[new])
            cuts = np.searchsorted(new, np.stack((starts, ends)))
            for k, owner in enumerate(owners):
                total[owner] += seen[rows[starts[k] : ends[k]]].sum(axis=0, dtype=np.float64) + more[cuts[0, k] : cuts[1, k]].sum(axis=0)
        for i, bits in zip(known, total, strict=True):
            odds = np.exp2(bits.min() - bits)
            best = int(bits.argmin())
            out[i] = (self.langs[best], float(odds[best] / odds.sum()))
        return out


def scorer(model: LanguageModel) -> Scorer:
    """Tables are built once per worker process and model."""
    return held(("language", model.key), lambda: Scorer(model))


def fit(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang") -> LanguageModel:
    """Learn from every row whose text and language are not null.

    Counts are combined inside each task first. No rows: a model without languages.
    A text that is empty counts as a document only, very long ones are counted in
    pieces. Statistics of more than MAX_MODEL_BYTES (ValueError) are not broadcast.
    """
    rows = labelled.select(labelled[text_col].cast("string").alias("text"), labelled[lang_col].cast("string").alias("lang")).filter("text IS NOT NULL AND lang IS NOT NULL")

    def count_grams(batches):
        seen: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        docs: dict[str, int] = {}

        def compact():
            for lang, parts in seen.items():
                if len(parts) > 1:
                    seen[lang] = [summed(*(np.concatenate(x) for x in zip(*parts)))]
            return sum(len(parts[0][0]) for parts in seen.values() if parts)

        def flush():
            compact()
            for lang, n in docs.items():
                grams, counts = seen[lang][0] if seen.get(lang) else (np.zeros(0, np.uint32), np.zeros(0, np.int64))
                yield pa.RecordBatch.from_pydict({"lang": pa.array([lang]), "gram": pa.array([-1], pa.int64()), "n": pa.array([n], pa.int64())})
                for at in range(0, len(grams), 1 << 18):
                    some = grams[at : at + (1 << 18)]
                    yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(some), pa.string()), "gram": pa.array(some.astype(np.int64)), "n": pa.array(counts[at : at + (1 << 18)])})
            seen.clear()
            for lang in docs:
                docs[lang] = 0

        for batch in batches:
            for part in slices(batch, "text", PIECE):
                by: dict[str, list[bytes]] = {}
                for lang, t in zip(part.column("lang").to_pylist(), texts(part.column("text")), strict=True):
                    by.setdefault(lang, []).append(t)
                for lang, data in by.items():
                    docs[lang] = docs.get(lang, 0) + len(data)
                    for _, parts in pieces(data):
                        codes, _, ends = gram_codes(parts)
                        real = np.ones(len(codes), bool)
                        real[(ends[:-1, None] + np.arange(ORDER)).ravel()] = False  # the context that opens the next part isn't part of it
                        seen.setdefault(lang, []).append(np.unique(codes[real], return_counts=True))
                        if sum(len(g) for some in seen.values() for g, _ in some) > HELD and compact() > HELD // 2:
                            yield from flush()
        yield from flush()

    def pack(table: pa.Table) -> pa.Table:
        gram, n = (table.column(c).to_numpy() for c in ("gram", "n"))
        order = np.argsort(gram)
        gram, n = gram[order], n[order]
        real = gram >= 0
        one = {"docs": int(n[~real].sum()), "grams": gram[real].astype(np.uint32).tobytes(), "counts": n[real].tobytes()}
        return pa.table({"lang": table.column("lang")[:1], "part": table.column("part")[:1], **{k: pa.array([v]) for k, v in one.items()}})

    counted = rows.mapInArrow(tidy(count_grams), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    # parts by the code's upper bits, so that no task packs a whole language; in order they join to a sorted table
    part = F.shiftright(F.col("gram"), 24).cast("int")
    packed = counted.withColumn("part", part).groupBy("lang", "part").applyInArrow(pack, "lang string, part int, docs long, grams binary, counts binary")
    packed = materialise(packed, "statistics")
    size = packed.agg(F.sum(F.length("grams") + F.length("counts"))).first()[0] or 0
    if size > MAX_MODEL_BYTES:
        raise ValueError(f"the statistics take {size} bytes, more than MAX_MODEL_BYTES")
    packed = packed.collect()
    by_lang: dict[str, list] = {}
    for r in sorted(packed, key=lambda r: (r["lang"], r["part"])):
        by_lang.setdefault(r["lang"], []).append(r)
    joined = [(lang, sum(r["docs"] for r in parts), b"".join(r["grams"] for r in parts), b"".join(r["counts"] for r in parts)) for lang, parts in by_lang.items()]
    return LanguageModel(uuid.uuid4().hex, *(tuple(r[i] for r in joined) for i in range(4)))


def held_out(docs: DataFrame, id_col: str = "doc_id"):
    """True where crc32 of the id as text is divisible by 5; a null id counts as empty text."""
    return F.crc32(F.coalesce(docs[id_col].cast("string"), F.lit(""))) % 5 == 0


def predict(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) of every whole text.

    score is the posterior probability of lang_pred (equal code lengths: the first
    language in order). `und` with score 0 if the text is null or has no letter, or
    nothing was learned. Repeated rows give repeated rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    fields = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    return annotate(docs, id_col, text_col, fields, lambda: scorer(shared.value))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(id, held_out, lang_pred, score): learns from the rows that are not held out, predicts all."""
    model = fit(docs.filter(~held_out(docs, id_col)), text_col, lang_col)
    rows = predict(docs, model, id_col, text_col)
    return rows.select(id_col, held_out(rows, id_col).alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, least: float = 0.5, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """docs without those that have no language: `und`, or a posterior below `least`."""
    spark: SparkSession = docs.sparkSession
    shared = spark.sparkContext.broadcast(fit(docs.filter(~held_out(docs, id_col)), text_col, lang_col))

    def make():
        score = scorer(shared.value)
        return lambda batch: [lang != "und" and p >= least for lang, p in score(batch)]

    return rewrite(docs, text_col, make, keep_rows=True)
