"""BPE encoding and decoding of whole texts (operator 3).

Every distinct word of a batch is encoded once with the contiguous rank
arrays of ``bpe.py``; a bounded per-worker table keeps common words.

Defined results: a null or empty text has no ids and decodes to "".  Rows are
independent, so ties, repeated rows and null keys return one row each; an
empty table returns no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from kirana.llm.common import prepare, texts
from kirana.llm.split import RARE, WORD_PIECE, splitter

#: Words kept by a worker; beyond it the table starts anew.
TABLE_WORDS = 200_000


class Codec:
    """Encodes whole texts and decodes ids for one tokenizer file."""

    def __init__(self, path: str):
        self.split = splitter(path)
        self.ranks = self.split.ranks
        self.table: dict[str, tuple[str, str, bytes]] = {}
        self.digits = [str(i) for i in range(len(self.ranks.tokens))]

    def _made(self, ids: list[int]) -> tuple[str, str, bytes]:
        """Ids as text, decoded text, and ids as 32-bit numbers."""
        return " ".join([self.digits[i] for i in ids]), self.decode(ids), array("i", ids).tobytes()

    def decode(self, ids: list[int]) -> str:
        """Tokens of the ids; the file names no decoder, so a space stands between them."""
        tokens = self.ranks.tokens
        return " ".join([tokens[i] for i in ids])

    def _learn(self, chunks: set[str]) -> None:
        new = sorted(chunks - self.table.keys())
        if len(self.table) + len(new) > TABLE_WORDS:
            self.table.clear()
            new = sorted(chunks)
        pieces = [[p.encode() for p in WORD_PIECE.findall(c)] for c in new]
        flat = sorted({p for ps in pieces for p in ps})
        ids = dict(zip(flat, self.ranks.encode(flat)))
        self.table.update((c, self._made([i for p in ps for i in ids[p]])) for c, ps in zip(new, pieces))

    def batch(self, batch: list[str]) -> list[tuple[str, str, bytes]]:
        """(ids as text, decoded text, ids as 32-bit numbers) of each text."""
        cut: list[list[str | tuple[str, str, bytes]]] = []
        for text in batch:
            at: list[str | tuple[str, str, bytes]] = []
            for k, part in enumerate(self.split.parts(text)):
                if k % 2:
                    at.append(self._made([self.ranks.specials[part]]))
                elif RARE.search(part):
                    pieces = self.split.by_library(part)
                    at.append(self._made([i for ids in self.ranks.encode(pieces) for i in ids]))
                else:
                    at += part.lower().split()
            cut.append(at)
        self._learn({c for at in cut for c in at if type(c) is str})
        out, table = [], self.table
        for at in cut:
            got = [table[c] if type(c) is str else c for c in at]
            got = [g for g in got if g[2]]
            out.append((" ".join([g[0] for g in got]), " ".join([g[1] for g in got]), b"".join([g[2] for g in got])))
        return out


#: What the operator can return, besides the key.
KINDS = {"n_tokens": T.LongType(), "ids": T.ArrayType(T.IntegerType()), "decoded": T.StringType(), "ids_sha256": T.StringType(), "decoded_sha256": T.StringType()}


def _column(name: str, got: list[tuple[str, str, bytes]]) -> pa.Array:
    if name == "n_tokens":
        return pa.array([len(g[2]) // 4 for g in got], pa.int64())
    if name == "decoded":
        return pa.array([g[1] for g in got], pa.string())
    if name == "ids":
        offsets = np.cumsum([0, *[len(g[2]) // 4 for g in got]]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join([g[2] for g in got]), np.int32)))
    at = 0 if name == "ids_sha256" else 1
    return pa.array([hashlib.sha256(g[at].encode()).hexdigest() for g in got], pa.string())


def encode_decode(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text",
                  give: tuple[str, ...] = ("n_tokens", "ids", "decoded")) -> DataFrame:
    """One row per text: the key and the columns of ``KINDS`` that ``give`` names; digests are of the UTF-8 bytes.

    ``tokenizer`` is the path of a byte-pair file of the tokenizers library that all executors have.
    """
    prepare(docs.sparkSession)
    schema = T.StructType([T.StructField(key, docs.schema[key].dataType), *[T.StructField(g, KINDS[g]) for g in give]])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(tokenizer)
        for b in batches:
            got = codec.batch(texts(b.column(1)))
            yield pa.RecordBatch.from_arrays([b.column(0), *[_column(g, got) for g in give]], [key, *give])

    return docs.select(key, text).mapInArrow(work, schema)
