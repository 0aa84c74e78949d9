"""Which tokens of two tokenizers cover the same bytes, counted over the corpus by inverted bitmaps.

Texts are cut into segments at spaces and line ends where neither tokenizer lets a token
go over the cut: a byte-level BPE begins a new match before white space that follows
anything else, and no piece of the other vocabulary has its space mark behind another
character, or a line end beside one. A worker encodes and aligns each different segment
once and looks it up afterwards.

Every block of documents becomes postings: for each pair of linked ids a compressed bitmap
of the block's documents (plane 0: a sorted list of 16-bit places, or bits where these are
shorter), and for pairs linked several times in a document bitmaps of the binary digits of
the further links (planes 1, 2, ...). The bitmaps of a block's slices are OR-merged when it
closes. Popcounts added over blocks are document counts and, weighted by planes, link counts.
Counts then go along the postings of each block back to its documents as scores.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from furrow.llm.text import held, slices, texts, tidy
from furrow.session import materialise

#: Bytes behind which a space or line end may be cut: printable ASCII and ends of characters that are not white space.
_SAFE = rb"!-~\x81-\x84\x86-\x87\x8B-\x9E\xA1-\xA7\xAA-\xAE\xB0-\xBF"
_SEGMENT = re.compile(rb"(?s:.)[^\x20\n]*+(?:(?<![" + _SAFE + rb"])[\x20\n]++[^\x20\n]*+)*+")
_CUT = re.compile(rb"(?<=[" + _SAFE + rb"])(?=[\x20\n])")
#: Bytes of text whose segments are held at one time, and bytes of tables after which a worker starts afresh.
PART_BYTES, TABLE_BYTES = 2 << 20, 48 << 20
#: Documents of a block (places have 16 bits), and postings after which it closes.
BLOCK_DOCS, BLOCK_POSTINGS = 1 << 16, 1 << 21


def byte_values() -> dict[str, int]:
    """Characters of a byte-level vocabulary and their bytes: visible Latin-1 stands for itself, the rest follows U+0100."""
    seen = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = sorted(set(range(256)) - set(seen))
    return {chr(b): b for b in seen} | {chr(0x100 + i): b for i, b in enumerate(rest)}


def matched(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ends of two rows of tokens over the same bytes: indices of overlapping pairs, and the group of each token of either row."""
    starts = np.concatenate([[0], a[:-1]])
    low, high = np.searchsorted(b, starts, "right"), np.searchsorted(b, a, "left") + 1
    n = high - low
    of_a = np.repeat(np.arange(len(a)), n)
    of_b = np.arange(len(of_a)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
    closes_a = b[high - 1] == a
    closes_b = np.zeros(len(b), bool)
    closes_b[high[closes_a] - 1] = True
    return of_a, of_b, np.cumsum(closes_a) - closes_a, np.cumsum(closes_b) - closes_b


class Aligner:
    """Segments met so far: their numbers of tokens, groups and links, linked pairs and groups as text."""

    def __init__(self, json_file: str, model_file: str):
        import sentencepiece
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.a = Tokenizer.from_file(json_file)
        self.a.encode_special_tokens = True
        values, special = byte_values(), {t["id"] for t in json.loads(self.a.to_str())["added_tokens"]}
        self.a_bytes = {i: token.encode() if i in special else bytes(map(values.__getitem__, token)) for token, i in self.a.get_vocab(with_added_tokens=True).items()}
        self.b = sentencepiece.SentencePieceProcessor(model_file=model_file)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        if any("▁" in p.lstrip("▁") or "\n" in p for p in pieces):
            raise ValueError(f"{model_file} has pieces that go over spaces or line ends; texts cannot be cut there")
        self.b_bytes = [bytes([int(p[1:-1], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.mark = self.b.piece_to_id("▁")
        self.n_b = len(pieces)
        self.a_len = np.zeros(max(self.a_bytes) + 1, np.int64)
        self.a_len[list(self.a_bytes)] = [len(x) for x in self.a_bytes.values()]
        self.b_len = np.array([len(x) for x in self.b_bytes])
        self.n_ids = max(len(self.a_len), self.n_b)
        self.spelled = [b"%d%c" % (i, end) for end in b",|;\n" for i in range(self.n_ids)]
        self.clear()

    def clear(self) -> None:
        self.at: dict[bytes, int] = {}
        self.n_a, self.n_b_tokens, self.n_groups, self.n_links = (array("q") for _ in range(4))
        self.wrong = array("b")
        self.offset, self.pairs, self.groups = array("q", [0]), array("q"), []
        self.size = 0

    def learn(self, segments: list[bytes]) -> None:
        strings = [s.decode() for s in segments]
        a_ids = [e.ids for e in self.a.encode_batch(strings, add_special_tokens=False)] if segments else []
        # the library puts a space before each text: it stands for the one that was cut, or goes away before a line end
        b_ids = self.b.encode([s[1:] if s[0] == " " else s for s in strings], num_threads=1) if segments else []
        for i, (segment, b) in enumerate(zip(segments, b_ids, strict=True)):
            if segment == b" ":  # nothing was left for the library
                b_ids[i] = [self.mark]
            elif segment[0] != 0x20:
                b_ids[i] = b[1:] if b and b[0] == self.mark else [*b, self.mark]
        self.add(segments, a_ids, b_ids)

    def _spell_alike(self, segments: list[bytes], a_ids: list[list[int]], b_ids: list[list[int]]) -> list[bool]:
        """Whether the tokens of either side spell the segment."""
        return [b"".join(map(self.a_bytes.__getitem__, a)) == s == b"".join(map(self.b_bytes.__getitem__, b)) for s, a, b in zip(segments, a_ids, b_ids, strict=True)]

    def add(self, segments: list[bytes], a_ids: list[list[int]], b_ids: list[list[int]]) -> None:
        """Align new segments, all in one row of bytes."""
        good = self._spell_alike(segments, a_ids, b_ids)
        if not all(good):
            a_ids, b_ids = ([x if ok else [] for x, ok in zip(ids, good, strict=True)] for ids in (a_ids, b_ids))
        n_a, n_b = (np.fromiter(map(len, ids), np.int64, len(ids)) for ids in (a_ids, b_ids))
        a, b = (np.fromiter(chain.from_iterable(ids), np.int64, int(n.sum())) for ids, n in ((a_ids, n_a), (b_ids, n_b)))
        of_a, of_b, group_a, group_b = matched(np.cumsum(self.a_len[a]), np.cumsum(self.b_len[b])) if len(a) else (a, a, a, b)
        segment_a, segment_b = (np.repeat(np.arange(len(segments)), n) for n in (n_a, n_b))
        n_links = np.bincount(segment_a[of_a], minlength=len(segments))
        last_a, last_b = (np.flatnonzero(np.diff(g, append=-1)) for g in (group_a, group_b))
        n_groups = np.bincount(segment_a[last_a], minlength=len(segments))
        # ids in the order in which groups are written, and the mark behind each
        first = np.searchsorted(group_b, group_a, "left") if len(a) else a
        after = np.searchsorted(group_a, group_b, "right") if len(a) else b
        ids, mark = np.zeros(len(a) + len(b), np.int64), np.zeros(len(a) + len(b), np.int64)
        at_a, at_b = np.arange(len(a)) + first, np.arange(len(b)) + after
        ids[at_a], ids[at_b] = a, b
        mark[at_a[last_a]] = 1
        mark[at_b[last_b]] = 2
        mark[at_b[np.flatnonzero(np.diff(segment_b, append=-1))]] = 3
        lines = iter(b"".join(map(self.spelled.__getitem__, (ids + mark * self.n_ids).tolist())).split(b"\n"))
        texts = [next(lines) if n else b"" for n in n_a.tolist()]

        start = len(self.wrong)
        self.at.update(zip(segments, range(start, start + len(segments)), strict=True))
        self.wrong.extend(not ok for ok in good)
        for column, n in ((self.n_a, n_a), (self.n_b_tokens, n_b), (self.n_groups, n_groups), (self.n_links, n_links)):
            column.frombytes(n.astype(np.int64).tobytes())
        self.offset.frombytes((len(self.pairs) + np.cumsum(n_links)).astype(np.int64).tobytes())
        self.pairs.frombytes((a[of_a] * self.n_b + b[of_b]).tobytes())
        self.groups += texts
        self.size += 300 * len(segments) + sum(map(len, segments)) + sum(map(len, texts)) + 8 * len(of_a)

    def look_up(self, segments: list[bytes]) -> np.ndarray:
        if self.size > TABLE_BYTES:
            self.clear()
        if new := [s for s in dict.fromkeys(segments) if s not in self.at]:
            for i in range(0, len(new), 4096):
                self.learn(new[i : i + 4096])
        return np.fromiter(map(self.at.__getitem__, segments), np.int64, len(segments))


def parts(data: bytes, size: int = PART_BYTES) -> Iterator[bytes]:
    """A text in parts of about `size` bytes, cut between segments."""
    at = 0
    while len(data) - at > size and (cut := _CUT.search(data, at + size)):
        yield data[at : cut.start()]
        at = cut.start()
    yield data[at:] if at else data


class Slice:
    """Counts, digests and linked pairs of a few documents, part by part."""

    def __init__(self, aligner: Aligner, n: int):
        self.aligner = aligner
        self.counts = np.zeros((4, n), np.int64)
        self.wrong = np.zeros(n, bool)
        self.sha = [None] * n
        self.doc, self.pair, self.times = [], [], []

    def fold(self, some: list[tuple[int, bytes]]) -> None:
        t, found, sizes = self.aligner, [], []
        for _, part in some:
            segments = _SEGMENT.findall(part)
            found += segments
            sizes.append(len(segments))
        at = t.look_up(found)
        doc = np.repeat([i for i, _ in some], sizes)
        for row, column in zip(self.counts, (t.n_a, t.n_b_tokens, t.n_groups, t.n_links), strict=True):
            np.add.at(row, doc, np.frombuffer(column, np.int64)[at])
        self.wrong[doc[np.frombuffer(t.wrong, np.int8)[at] != 0]] = True
        start = 0
        for (i, _), n in zip(some, sizes, strict=True):
            text = b";".join(filter(None, map(t.groups.__getitem__, at[start : start + n].tolist())))
            if self.sha[i] is None:
                self.sha[i] = hashlib.sha256(text)
            else:
                self.sha[i].update(b";" + text)
            start += n
        offset = np.frombuffer(t.offset, np.int64)
        n = offset[at + 1] - offset[at]
        links = np.arange(n.sum()) + np.repeat(offset[at] - np.cumsum(n) + n, n)
        if len(links):
            key = np.repeat(doc, n) * (1 << 40) + np.frombuffer(t.pairs, np.int64)[links]
            key, times = np.unique(key, return_counts=True)
            self.doc.append(key >> 40)
            self.pair.append(key & ((1 << 40) - 1))
            self.times.append(times)

    def finish(self) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Digests, and (document, pair, times) once each."""
        none = [np.zeros(0, np.int64)]
        doc, pair, times = (np.concatenate(x or none) for x in (self.doc, self.pair, self.times))
        if len(self.doc) > 1:
            key, where = np.unique(doc * (1 << 40) + pair, return_inverse=True)
            doc, pair, times = key >> 40, key & ((1 << 40) - 1), np.bincount(where, times).astype(np.int64)
        self.counts[:, self.wrong] = 0
        good = ~self.wrong[doc]
        return ["" if s is None or w else s.hexdigest() for s, w in zip(self.sha, self.wrong)], doc[good], pair[good], times[good]


def bitmaps(doc: np.ndarray, pair: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Pairs, popcounts and compressed bitmaps of sorted (pair, doc) postings."""
    first = np.flatnonzero(np.diff(pair, prepend=-1))
    n = np.diff(first, append=len(pair))
    places = doc.astype("<u2")
    plain = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(np.append(first, len(pair)).astype(np.int32) * 2), pa.py_buffer(places.tobytes())])
    dense = np.flatnonzero(n * 2 > (n_docs + 7) // 8)
    if not len(dense):
        return pair[first], n, plain
    out = plain.to_pylist()
    for i in dense.tolist():
        bits = np.zeros(n_docs, bool)
        bits[doc[first[i] : first[i] + n[i]]] = True
        out[i] = np.packbits(bits).tobytes()
    return pair[first], n, pa.array(out, pa.binary())


def members(data: bytes, n: int) -> np.ndarray:
    """Places of the n documents of a bitmap."""
    if len(data) == 2 * n:
        return np.frombuffer(data, "<u2").astype(np.int64)
    return np.flatnonzero(np.unpackbits(np.frombuffer(data, np.uint8)))


class Block:
    """Postings of consecutive documents of a task."""

    def __init__(self):
        self.n_docs, self.n_postings, self.held = 0, 0, []

    def add(self, n: int, doc: np.ndarray, pair: np.ndarray, times: np.ndarray) -> None:
        self.held.append((doc + self.n_docs, pair, times))
        self.n_docs += n
        self.n_postings += len(doc)

    def planes(self) -> Iterator[tuple[int, np.ndarray, np.ndarray, pa.Array]]:
        doc, pair, times = map(np.concatenate, zip(*self.held, strict=True))
        order = np.argsort(pair << 16 | doc)
        doc, pair, times = doc[order], pair[order], times[order]
        if len(doc):
            yield 0, *bitmaps(doc, pair, self.n_docs)
        times, plane = times - 1, 1
        while len(left := np.flatnonzero(times)):
            doc, pair, times = doc[left], pair[left], times[left]
            odd = times & 1 == 1
            if odd.any():
                yield plane, *bitmaps(doc[odd], pair[odd], self.n_docs)
            times, plane = times >> 1, plane + 1


_POSTING = [("block", T.LongType()), ("a_id", T.IntegerType()), ("b_id", T.IntegerType()), ("plane", T.IntegerType()), ("n", T.LongType()), ("docs", T.BinaryType())]
_COUNTS = ["n_a", "n_b", "n_groups", "n_links"]


@dataclass
class Alignment:
    """An index over aligned documents; .docs and .postings are written tables."""

    docs: DataFrame
    postings: DataFrame

    @cached_property
    def pairs(self) -> DataFrame:
        """(a_id, b_id, n_docs, n_links, best): documents that hold the pair linked, its links, whether no pair of a_id has more documents."""
        weight = F.expr("if(plane = 0, 1L, shiftleft(1L, greatest(plane - 1, 0)))")
        counts = self.postings.groupBy("a_id", "b_id").agg(F.sum(F.when(F.col("plane") == 0, F.col("n"))).alias("n_docs"), F.sum(F.col("n") * weight).alias("n_links"))
        # a window over the pairs of one id: at most the other vocabulary's size
        return materialise(counts.withColumn("best", F.col("n_docs") == F.max("n_docs").over(Window.partitionBy("a_id"))), "pairs")

    def scores(self, id_col: str = "doc_id") -> DataFrame:
        """(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every document."""
        scored = self.postings.join(self.pairs.select("a_id", "b_id", "n_docs", "best"), ["a_id", "b_id"]).select("block", "plane", "n", "docs", "n_docs", "best")
        back = scored.groupBy("block").applyInArrow(_returned, "block long, place long, n_best long, count_sum long")
        joined = self.docs.join(back, ["block", "place"], "left")
        return joined.select(F.col("id").alias(id_col), *_COUNTS, F.coalesce("n_best", F.lit(0).cast("long")).alias("n_best"), F.coalesce("count_sum", F.lit(0).cast("long")).alias("count_sum"), "groups_sha256")


def _returned(block: pa.Table) -> pa.Table:
    """Scores of one block's documents from its postings: a block has a bounded number of them."""
    n = block.column("n").to_numpy()
    each = [members(d, k) for d, k in zip(block.column("docs").to_pylist(), n.tolist(), strict=True)]
    doc = np.concatenate(each)
    plane = block.column("plane").to_numpy().astype(np.int64)
    weight = np.where(plane == 0, 1, 1 << np.maximum(plane - 1, 0))
    best, total = np.zeros(doc.max() + 1, np.int64), np.zeros(doc.max() + 1, np.int64)
    np.add.at(total, doc, np.repeat(weight * block.column("n_docs").to_numpy(), n))
    np.add.at(best, doc, np.repeat(weight * block.column("best").to_numpy(zero_copy_only=False), n))
    place = np.flatnonzero(total)
    return pa.table({"block": np.full(len(place), block.column("block")[0].as_py()), "place": place, "n_best": best[place], "count_sum": total[place]})


def align(docs: DataFrame, json_file: str, model_file: str, id_col: str = "doc_id", text_col: str = "text", block_postings: int = BLOCK_POSTINGS) -> Alignment:
    """Encode every whole text with both tokenizers, align the tokens by bytes, and index the linked pairs.

    The first (tokenizers, .json) encodes a space and the text, the second
    (sentencepiece, .model) the text. Strings of special tokens are ordinary text. Null and
    empty texts, and texts whose tokens do not spell a space and the text in both, have no
    tokens and an empty groups_sha256. Every row is a document of its own, also where ids
    are null or shared. Very long texts are aligned in parts; a long text without a space or
    line end is one segment. Both files must be readable at these paths on every executor.
    """
    fields = [T.StructField("posting", T.BooleanType()), T.StructField("id", docs.schema[id_col].dataType), T.StructField("place", T.LongType())]
    fields += [T.StructField(c, T.LongType()) for c in _COUNTS] + [T.StructField("groups_sha256", T.StringType())] + [T.StructField(*f) for f in _POSTING]
    schema = T.StructType(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(schema)
        aligner = held(("align", json_file, model_file), lambda: Aligner(json_file, model_file))
        task, number, block = TaskContext.get().partitionId(), 0, Block()

        def rows(size: int, **columns) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(size, f.type) for f in arrow], schema=arrow)

        def close():
            for plane, pair, n, docs in block.planes():
                for i in range(0, len(n), 20_000):
                    s = slice(i, i + 20_000)
                    m = len(n[s])
                    yield rows(m, posting=[True] * m, block=np.full(m, (task << 32) + number), a_id=pair[s] // aligner.n_b, b_id=pair[s] % aligner.n_b, plane=np.full(m, plane), n=n[s], docs=docs[s])

        for batch in batches:
            for part in slices(batch, "text", PART_BYTES):
                if block.held and (block.n_docs + part.num_rows > BLOCK_DOCS or block.n_postings > block_postings):
                    yield from close()
                    number, block = number + 1, Block()
                here, waiting, size = Slice(aligner, part.num_rows), [], 0
                for i, text in enumerate(texts(part.column("text"))):
                    for some in parts(b" " + text) if text else ():
                        waiting.append((i, some))
                        size += len(some)
                        if size > PART_BYTES:
                            here.fold(waiting)
                            waiting, size = [], 0
                if waiting:
                    here.fold(waiting)
                sha, doc, pair, times = here.finish()
                counts = dict(zip(_COUNTS, here.counts, strict=True))
                yield rows(part.num_rows, posting=[False] * part.num_rows, block=np.full(part.num_rows, (task << 32) + number), id=part.column("id").cast(arrow.field("id").type), place=np.arange(part.num_rows) + block.n_docs, groups_sha256=sha, **counts)
                block.add(part.num_rows, doc, pair, times)
        if block.held:
            yield from close()

    pairs = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text")).mapInArrow(tidy(run), schema)
    found = materialise(pairs, "alignment")
    of_docs = [f.name for f in fields[1:] if f.name == "block" or f.name not in dict(_POSTING)]
    return Alignment(found.filter("not posting").select(of_docs), found.filter("posting").select([name for name, _ in _POSTING]))
