"""Packing documents into fixed token windows with a bounded number of open windows per partition."""

from __future__ import annotations

import os
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from heatgrid.llm.common import documents
from heatgrid.session import cut_lineage

CAPACITY = 4096
OPEN_WINDOWS = 16
END_ID = 2
VOCABULARY = "word_bpe_49k.json"
CACHED_WORDS = 1_000_000  # words a task remembers at a time; a memory bound only
ROWS = 2048  # rows of an output batch
LEFT_BASE = 1 << 62  # sequence ids from here on are merged leftovers

PIECE = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"
_MARKS = b"!\"#$%&()*+,-./:;=?@[]^_`{|}~"


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


class WordIds:
    """Token ids of a text, word by word.

    The tokenizer drops white space and never joins across it, so a text's ids are those of its words in a row. Most
    words recur: their ids are remembered, without A-Z capitals and closing marks, which have ids of their own.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[bytes, bytes] = {}

    def encode(self, new: list[bytes]) -> None:
        found = self.tokenizer.encode_batch_fast([w.decode() for w in new], add_special_tokens=False)
        self.known.update((w, np.array(e.ids, dtype="<u4").tobytes()) for w, e in zip(new, found))

    def __call__(self, text: bytes) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        special = b"<|" in text
        words = text.split() if special else text.lower().split()
        new = set(words).difference(self.known)
        if new:
            if len(self.known) + len(new) > CACHED_WORDS:
                self.known.clear()
                new = set(words)
            parts = {}
            for w in () if special else new:
                core = w.rstrip(_MARKS)
                if len(core) < len(w) and core[-1:].isalnum():
                    parts[w] = core, w[len(core) :]
            plain = (new - parts.keys()) | {p for pair in parts.values() for p in pair}
            self.encode(sorted(plain.difference(self.known)))
            self.known.update((w, self.known[a] + self.known[b]) for w, (a, b) in parts.items())
        return b"".join(map(self.known.__getitem__, words))


class _Rows:
    """Output rows, column by column."""

    def __init__(self, names: list[str], types: list[pa.DataType]):
        self.names, self.types, self.columns = names, types, [[] for _ in names]

    def add(self, *row) -> None:
        for column, value in zip(self.columns, row):
            column.append(value)

    def full(self) -> bool:
        return len(self.columns[0]) >= ROWS

    def batch(self) -> pa.RecordBatch:
        arrays = [pa.array(c, t) for c, t in zip(self.columns, self.types)]
        self.columns = [[] for _ in self.names]
        return pa.RecordBatch.from_arrays(arrays, names=self.names)


_NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "part", "ids"]
_TYPES = [pa.int64()] * 8 + [pa.binary()]


def _fill(batches: Iterator[pa.RecordBatch], path: str, capacity: int, slots: int, keep_ids: bool) -> Iterator[pa.RecordBatch]:
    """Pieces of the windows a partition closes, then those of the windows still open (sequence_id null)."""
    part, ids_of, out = TaskContext.get().partitionId(), WordIds(path), _Rows(_NAMES, _TYPES)
    end, windows, sent = np.array([END_ID], dtype="<u4").tobytes(), [], 0

    def close(pieces):
        nonlocal sent
        at = 0
        for doc_id, start, ids, total in pieces:
            n = len(ids) // 4
            out.add(doc_id, start, n, crc32(ids), total, part << 32 | sent, at, part, ids if keep_ids else None)
            at += n
        sent += 1

    for batch in batches:
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
            ids = ids_of(text.as_py() or b"") + end
            total = len(ids) // 4
            for start in range(0, total, capacity):
                piece = (doc_id, start, ids[4 * start : 4 * (start + capacity)], total)
                n = len(piece[2]) // 4
                best = max((w for w in windows if w[0] + n <= capacity), key=lambda w: w[0], default=None)
                if best is None or n == capacity:
                    best = [0, []]
                    if n < capacity and len(windows) == slots:
                        fullest = max(windows, key=lambda w: w[0])
                        windows.remove(fullest)
                        close(fullest[1])
                    windows.append(best)
                best[0] += n
                best[1].append(piece)
                if best[0] == capacity:
                    windows.remove(best)
                    close(best[1])
                if out.full():
                    yield out.batch()
    at = 0
    for _, pieces in windows:
        for doc_id, start, ids, total in pieces:
            out.add(doc_id, start, len(ids) // 4, crc32(ids), total, None, at, part, ids)
            at += len(ids) // 4
    yield out.batch()


def _merge(batches: Iterator[pa.RecordBatch], capacity: int, keep_ids: bool) -> Iterator[pa.RecordBatch]:
    """Leftover pieces lie end to end (column ``base``); cut them where a window ends."""
    out = _Rows(_NAMES[:7] + ["ids"], _TYPES[:7] + [pa.binary()])
    for batch in batches:
        for row in batch.to_pylist():
            at, ids, done = row["base"] + row["offset"], row["ids"], 0
            while done < row["length"]:
                n = min(row["length"] - done, capacity - at % capacity)
                cut = ids[4 * done : 4 * (done + n)]
                out.add(row["doc_id"], row["start"] + done, n, crc32(cut), row["doc_tokens"], LEFT_BASE + at // capacity, at % capacity, cut if keep_ids else None)
                done, at = done + n, at + n
            if out.full():
                yield out.batch()
    yield out.batch()


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, open_windows: int = OPEN_WINDOWS, keep_ids: bool = False) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids]): one row for each piece of a document.

    A document's ids are those of its text and the end id; a null or empty text has the end id only. A document longer
    than ``capacity`` fills windows of its own; its rest, like a short document, goes best-fit into one of the
    partition's ``open_windows``. When none fits, the fullest is closed. Windows still open at the end of a partition are
    laid end to end over all partitions and cut at the capacity, so that only the last sequence of all is not full. This
    needs the partitions' totals only, no gathering. Every row is packed: repeated rows each, rows with a null doc_id
    under null. Columns other than doc_id and text are not read. With ``keep_ids`` the pieces carry their ids as
    little-endian unsigned 32-bit integers.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    filled = cut_lineage(rows.mapInArrow(lambda b: _fill(b, path, capacity, open_windows, keep_ids), f"{PIECE}, part bigint, ids binary"))
    left = filled.where("sequence_id IS NULL")
    sums = left.groupBy("part").agg(F.sum("length").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each input partition
    bases = sums.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    merged = left.join(bases, "part").mapInArrow(lambda b: _merge(b, capacity, keep_ids), f"{PIECE}, ids binary")
    out = filled.where("sequence_id IS NOT NULL").drop("part").unionByName(merged)
    return out if keep_ids else out.drop("ids")


def op7_bounded_packing(spark: SparkSession, sf: str) -> DataFrame:
    return pack(documents(spark, sf), vocabulary_path())


QUERIES = {"op7_bounded_packing": (op7_bounded_packing, None)}
