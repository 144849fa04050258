"""Token counts without ids (operator 8).

1. Every text is split once.  Texts are dealt into blocks of bounded size; a block has
   a table of its distinct pre-tokens, and each text's frequencies refer to that table.
2. The tables' pre-tokens are brought together by a shuffle; the pieces of each distinct
   one are worked out once with the rank arrays of ``bpe.py`` and their number goes back
   to every block that has the pre-token.
3. Frequencies and piece counts meet block by block and are summed.

A pre-token travels once a block, however often it occurs, and a block is at most
``BLOCK_BYTES`` of text (or one text) with ``BLOCK_PIECES`` pre-tokens (or those of one
slice more), so no key is hot in either shuffle.

Defined results: a null or empty text has 0 bytes and 0 tokens; repeated rows
and null keys return a row each; an empty table returns no rows; other columns
are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from kirana.llm.bpe import ranks
from kirana.llm.common import prepare, stage, utf8
from kirana.llm.pretokens import Frequencies
from kirana.llm.split import splitter

BLOCK_BYTES = 1 << 25
BLOCK_PIECES = 1 << 19
#: Pre-tokens of a block's table in one row, and piece counts that a task holds back to send them by block.
ROW_PIECES, HELD = 1 << 14, 1 << 20


def _packed(numbers: np.ndarray) -> bytes:
    """32-bit numbers, their bytes of equal weight side by side, compressed."""
    return zstandard.compress(np.ascontiguousarray(numbers.astype("<i4").view(np.uint8).reshape(-1, 4).T).tobytes(), 1)


def _numbers(packed: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zstandard.decompress(packed), np.uint8).reshape(4, -1).T).view("<i4").ravel()


def frequencies(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows of some texts of a block (their keys, ``n_bytes``, ``special`` tokens and numbers of different pre-tokens; packed steps
    between the pre-tokens' numbers in the block's table, and how often each occurs) and rows of the blocks' tables (``first`` number, ``pieces``)."""
    prepare(docs.sparkSession)
    longs = T.ArrayType(T.LongType())
    schema = T.StructType([
        T.StructField("block", T.LongType()), T.StructField("keys", T.ArrayType(docs.schema[key].dataType)), T.StructField("n_bytes", longs), T.StructField("special", longs),
        T.StructField("many", longs), T.StructField("steps", T.BinaryType()), T.StructField("times", T.BinaryType()),
        T.StructField("first", T.IntegerType()), T.StructField("pieces", T.ArrayType(T.StringType()))])
    pieces_bound, bytes_bound, row = BLOCK_PIECES, BLOCK_BYTES, ROW_PIECES

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds, found = to_arrow_schema(schema), Frequencies(splitter(tokenizer))
        block, table, filled = TaskContext.get().partitionId() << 32, {}, 0

        def one_row(**columns: pa.Array) -> pa.RecordBatch:
            made = {c: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) if isinstance(x, pa.Array) else pa.array([x]) for c, x in columns.items()}
            return pa.RecordBatch.from_arrays([made[f.name].cast(f.type) if f.name in made else pa.nulls(1, f.type) for f in kinds], names=kinds.names)

        def close() -> Iterator[pa.RecordBatch]:
            every = list(table)
            for a in range(0, len(every), row):
                yield one_row(block=block, first=a, pieces=pa.array(every[a:a + row], pa.string()))

        for b in batches:
            size = np.diff(utf8(b.column(1))[1])
            for x, z, begin, which, times, pieces, special in found.of(b.column(1)):
                number = np.array([table.setdefault(p, len(table)) for p in pieces] or [0], np.int64)[which]
                many = np.diff(begin)
                doc = np.repeat(np.arange(z - x), many)
                order = np.lexsort((number, doc))
                number, times = number[order], times[order]
                steps = np.diff(number, prepend=0)
                steps[begin[:-1][many > 0]] = number[begin[:-1][many > 0]]
                yield one_row(block=block, keys=b.column(0).slice(x, z - x), n_bytes=pa.array(size[x:z]), special=pa.array(special), many=pa.array(many),
                              steps=_packed(steps), times=_packed(times))
                filled += int(size[x:z].sum())
                if len(table) >= pieces_bound or filled >= bytes_bound:
                    yield from close()
                    block, table, filled = block + 1, {}, 0
        yield from close()

    return docs.select(key, text).mapInArrow(work, schema)


def token_counts(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per text: the key, ``n_bytes`` and ``n_tokens``."""
    kind = docs.schema[key].dataType
    bound = HELD

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, tokens = None, 0  # rows of one pre-token follow one another
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def by_block() -> pa.RecordBatch:
            block, number, n = (np.concatenate(x) for x in zip(*held))
            held.clear()
            order = np.lexsort((number, block))
            block, number, n = block[order], number[order], n[order]
            cuts = np.flatnonzero(np.diff(block, prepend=-1)).tolist()
            spans = list(zip(cuts, [*cuts[1:], len(block)]))
            return pa.RecordBatch.from_arrays([pa.array(block[cuts]), pa.array([_packed(np.diff(number[a:z], prepend=0)) for a, z in spans], pa.binary()),
                                               pa.array([_packed(n[a:z]) for a, z in spans], pa.binary())], ["block", "steps", "tokens"])

        for b in batches:
            every = b.column(0).to_pylist()
            new = [p for p in dict.fromkeys(every) if p != last]
            known = dict(zip(new, ranks(tokenizer).counts([p.encode() for p in new]).tolist()))
            if last is not None:
                known[last] = tokens
            if every:
                last, tokens = every[-1], known[every[-1]]
                held.append((b.column(1).to_numpy(), b.column(2).to_numpy(), np.array([known[p] for p in every], np.int64)))
            if sum(len(x[0]) for x in held) >= bound:
                yield by_block()
        if held:
            yield by_block()

    def summed(texts: pa.Table, table: pa.Table) -> pa.Table:
        parts = [(np.cumsum(_numbers(a)), _numbers(n)) for a, n in zip(table.column("steps").to_pylist(), table.column("tokens").to_pylist())]
        each = np.zeros(max([int(a[-1]) + 1 for a, _ in parts], default=1), np.int64)
        for a, n in parts:
            each[a] = n
        out = []
        for row in texts.to_batches():
            for k in range(row.num_rows):
                keys, n_bytes, special, many = (row.column(c)[k].values for c in ("keys", "n_bytes", "special", "many"))
                many = many.to_numpy()
                steps, times = _numbers(row.column("steps")[k].as_py()).astype(np.int64), _numbers(row.column("times")[k].as_py())
                ends = np.cumsum(many)
                run = np.concatenate([[0], np.cumsum(steps)])
                number = run[1:] - np.repeat(run[ends - many], many)  # steps begin anew in every text
                sums = np.concatenate([[0], np.cumsum(each[number] * times)])
                out.append(pa.table([keys, n_bytes, pa.array(sums[ends] - sums[ends - many] + special.to_numpy())], names=[key, "n_bytes", "n_tokens"]))
        return pa.concat_tables(out)

    rows = stage(frequencies(docs, tokenizer, key, text), "frequencies", compression="zstd")
    named = rows.filter("pieces is not null").select("block", "first", F.posexplode("pieces").alias("at", "piece"))
    named = named.select("piece", "block", (F.col("first") + F.col("at")).alias("id")).repartition("piece").sortWithinPartitions("piece")
    tokens = named.mapInArrow(counted, "block long, steps binary, tokens binary")
    texts = rows.filter("pieces is null").select("block", "keys", "n_bytes", "special", "many", "steps", "times")
    schema = T.StructType([T.StructField(key, kind), T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])
    return texts.groupBy("block").cogroup(tokens.groupBy("block")).applyInArrow(summed, schema)
