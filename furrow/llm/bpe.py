"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file.

Long texts are cut where the split pattern always begins a new match, so that the parts
encode to the same ids as the whole and the library never holds one huge text:

- before white space that follows anything else (only a match of white space can go on
  or begin there, and none looks back);
- between an ASCII letter and a digit, or one of both and an ASCII mark (not after an
  apostrophe, which may open a contraction), and between Han characters and full-width stops;
- in a run of white space before its last character, as the pattern leaves that one to
  what follows; a run that ends the text is one match.

A long run of white space is then one match by itself. It goes to the library's encoder
of single pieces, because the pattern's look-ahead overflows the stack of its regex.
"""

from __future__ import annotations

import base64
import re

import numpy as np
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from furrow.llm.text import annotate, held, sha256_hex

PART_BYTES = 64 << 10
#: Bytes from which a run of white space is a part of its own.
RUN_BYTES = 64 << 10
_BLANK = rb"(?:[\x20\x09-\x0D]|\xC2[\x85\xA0]|\xE1\x9A\x80|\xE2\x80[\x80-\x8A\xA8\xA9\xAF]|\xE2\x81\x9F|\xE3\x80\x80)"
_RUN = re.compile(_BLANK + rb"++")
_LAST = re.compile(_BLANK + rb"\Z")
_CUT = re.compile(
    rb"[^\x09-\x0D\x1C-\x20\x80-\xFF](?=[\x20\x09-\x0D])"
    rb"|[A-Za-z](?=[0-9])|[0-9](?=[A-Za-z])"
    rb"|[A-Za-z0-9](?=[!-/:-@\[-`{-~])|[!-&(-/:-@\[-`{-~](?=[A-Za-z0-9])"
    rb"|[\xE5-\xE8][\x80-\xBF]{2}(?=\x20|\xE3\x80[\x81\x82]|\xEF\xBC\x8C)"
    rb"|[\xD0\xD1][\x90-\xBF](?=\x20)"
)


class Codec:
    def __init__(self, rank_file: str, pattern: str):
        with open(rank_file, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(bytes.strip, lines))}
        self.encoding = tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def parts(self, data: bytes, size: int = PART_BYTES, run: int = RUN_BYTES) -> list[bytes]:
        if len(data) <= size:
            return [data]
        out, start = [], 0
        for m in _RUN.finditer(data):
            if m.end() - m.start() > run:
                end = m.end()
                if end < len(data):  # the last character stays with what follows
                    end = _LAST.search(data, max(m.start(), end - 3), end).start()
                out += self._cut(data[start : m.start()], size)
                out.append(data[m.start() : end])
                start = end
        return [p for p in [*out, *self._cut(data[start:], size)] if p]

    @staticmethod
    def _cut(data: bytes, size: int) -> list[bytes]:
        out, start = [], 0
        while len(data) - start > size and (cut := _CUT.search(data, start + size)):
            out.append(data[start : cut.end()])
            start = cut.end()
        out.append(data[start:])
        return out

    def encode(self, data: bytes) -> list[int]:
        ids: list[int] = []
        for part in self.parts(data):
            if len(part) > RUN_BYTES and _RUN.fullmatch(part):
                ids += self.encoding._encode_single_piece(part)
            else:
                ids += self.encoding.encode_ordinary(part.decode())
        return ids

    def decode(self, ids: list[int]) -> bytes:
        return self.encoding.decode_bytes(ids)


def codec(rank_file: str, pattern: str) -> Codec:
    """One codec per worker process and rank file."""
    return held(("bpe", rank_file, pattern), lambda: Codec(rank_file, pattern))


def encode(docs: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, token_ids array<int>) of every whole text, however long; null and empty texts have no ids.

    rank_file must be readable at this path on every executor.
    """

    def make():
        bpe = codec(rank_file, pattern)
        return lambda batch: [(bpe.encode(t or b""),) for t in batch]

    return annotate(docs, id_col, text_col, [T.StructField("token_ids", T.ArrayType(T.IntegerType(), False))], make)


def decode(tokens: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", ids_col: str = "token_ids") -> DataFrame:
    """(id, bytes binary): the raw bytes of each id sequence; null ids give null.

    Bytes, not text: a cut id sequence may end inside a character.
    """
    import pandas as pd

    schema = T.StructType([T.StructField(id_col, tokens.schema[id_col].dataType), T.StructField("bytes", T.BinaryType())])

    def run(frames):
        bpe = codec(rank_file, pattern)
        for frame in frames:
            yield pd.DataFrame({id_col: frame["id"], "bytes": [None if ids is None else bpe.decode(list(ids)) for ids in frame["ids"]]})

    return tokens.select(tokens[id_col].alias("id"), tokens[ids_col].alias("ids")).mapInPandas(run, schema)


def token_digests(docs: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256): encode and decode fused in one pass.

    ids_sha256 is over the ids as little-endian unsigned 32-bit integers. Null and
    empty texts: no tokens, digests of nothing. Very long texts, also without any white
    space or of nothing else, are encoded whole. Repeated rows give repeated rows.
    """

    def make():
        bpe = codec(rank_file, pattern)

        def score(batch):
            for t in batch:
                ids = bpe.encode(t or b"")
                yield len(ids), sha256_hex(np.array(ids, "<u4").tobytes()), sha256_hex(bpe.decode(ids))

        return score

    fields = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    return annotate(docs, id_col, text_col, fields, make)
