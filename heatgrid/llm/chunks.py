"""Repeated passages by content-defined chunks: the smallest values of a gear rolling hash set the cuts, digests find the repeats."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heatgrid.llm.common import documents, spread_join
from heatgrid.session import cut_lineage, distilled

REACH = 24  # bytes on either side over which a cut's hash is the smallest: chunks have 49 bytes on average
MIN_WORDS = 12  # words of a run of repeated chunks; a passage of over 50 words holds such a run
FAR = 48  # bytes from a smallest hash to the next white space beyond which a chunk ends between two characters instead
LETTERS = 12  # characters that count as a word where words are not set apart
SLICE = 1 << 22  # bytes hashed at once

#: Random 32-bit value of each byte, from a fixed seed.
GEAR = np.random.default_rng(20260102).integers(0, 1 << 32, 256, dtype=np.uint32)
WHITE = b" \t\n\r\v\f"
_GAP = np.zeros(256, dtype=bool)
_GAP[[9, 10, 11, 12, 13, 32]] = True

CHUNK = "d1 bigint, d2 bigint, doc_id bigint, start bigint, span bigint"


def gear(raw: np.ndarray) -> np.ndarray:
    """Rolling hash of every position, over the 16 bytes that end there: the sum of 2^k GEAR[byte k places back]."""
    h = GEAR[raw]
    for step in (1, 2, 4, 8):
        h[step:] += h[:-step] << np.uint32(step)
    return h


def lowest(h: np.ndarray) -> np.ndarray:
    """Positions whose hash is not above any of the ``REACH`` before and behind them; text that repeats itself has ties."""
    edge = np.full(REACH, 0xFFFFFFFF, dtype=np.uint32)
    low, width = np.concatenate([edge, h, edge]), 1  # low[i]: smallest of ``width`` hashes from i on
    while 2 * width <= REACH:
        low, width = np.minimum(low[:-width], low[width:]), 2 * width
    low = np.minimum(low[: len(low) - (REACH - width)], low[REACH - width :])
    return np.flatnonzero((h <= low[: len(h)]) & (h <= low[REACH + 1 : REACH + 1 + len(h)]))


def cuts(raw: np.ndarray, gaps: np.ndarray) -> np.ndarray:
    """Ends of a text's chunks: the white space that follows a smallest hash, or the next character where none is near.

    A cut depends on the bytes near it alone, so an insertion changes the chunks around it and no others.
    """
    hits = []
    for at in range(0, len(raw), SLICE):
        a, b = max(0, at - 16 - REACH), min(len(raw), at + SLICE + REACH)
        found = lowest(gear(raw[a:b])) + a
        hits.append(found[(found >= at) & (found < at + SLICE)])
    if not hits:
        return np.array([len(raw)])
    at = np.concatenate(hits)
    here = np.append(gaps, len(raw))[np.searchsorted(gaps, at)]
    lone = np.flatnonzero(here - at > FAR)
    if len(lone):
        border = np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw))
        here[lone] = border[np.searchsorted(border, at[lone], side="right")]
    return np.unique(np.append(here, len(raw)))


def split(text: bytes) -> list[tuple[int, int, int, bytes]]:
    """(start, size, words, digest) of a text's chunks that hold a character other than white space.

    Runs of white space are one space for hashes, cuts and digests, so a passage that is wrapped otherwise is the same;
    start and size are bytes of the text as it is. Long stretches without white space are cut between characters, and
    twelve characters there count as a word.
    """
    whole = np.frombuffer(text, dtype=np.uint8)
    blank = _GAP[whole]
    keep = ~blank
    keep[:1] = True
    keep[1:] |= ~blank[:-1]
    place = np.append(np.flatnonzero(keep), len(whole))
    raw = whole[keep]
    gap = _GAP[raw]
    raw = np.where(gap, np.uint8(32), raw)
    ends = cuts(raw, np.flatnonzero(gap))
    first = ~gap
    first[1:] &= gap[:-1]
    below = lambda mask: np.diff(np.searchsorted(np.flatnonzero(mask), ends), prepend=0)
    starts, letters = np.append(0, ends[:-1]), below(~gap & ((raw & 0xC0) != 0x80))
    words = np.maximum(below(first), -(-letters // LETTERS))
    bare, digest = raw.tobytes(), xxhash.xxh3_128_digest
    at, end = place[starts].tolist(), place[ends].tolist()
    return [(i, j - i, w, digest(bare[a:b].strip(WHITE))) for i, j, a, b, w in zip(at, end, starts.tolist(), ends.tolist(), words.tolist()) if w]


def _split_rows(docs: DataFrame) -> DataFrame:
    rows = docs.where("doc_id IS NOT NULL AND text IS NOT NULL")
    return rows.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("binary").alias("text"))


def digests(docs: DataFrame) -> DataFrame:
    """(d1, doc_id): half a digest of every chunk and its document, once for each document as far as a batch tells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, ids, size = [], [], 0
            for n, (key, text) in enumerate(zip(batch.column("doc_id").to_pylist(), batch.column("text")), 1):
                found = split(text.as_py())
                held.append(np.unique(np.frombuffer(b"".join([c[3] for c in found]), dtype="<i8")[::2]))
                ids.append(np.full(len(held[-1]), key))
                size += len(found)
                if size > 100_000 or n == batch.num_rows:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(held)), pa.array(np.concatenate(ids), pa.int64())], names=["d1", "doc_id"])
                    held, ids, size = [], [], 0

    return _split_rows(docs).mapInArrow(run, "d1 bigint, doc_id bigint")


def chunks(docs: DataFrame) -> DataFrame:
    """One row for each chunk. ``span`` holds 16 bits of a hash of the text, 16 of the words and 32 of the size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in CHUNK.split(", ")]
        for batch in batches:
            columns, marks, ids = [[], [], []], [], batch.column("doc_id").to_pylist()
            for n, text in enumerate(batch.column("text")):
                whole = text.as_py()
                found, tag = split(whole), (xxhash.xxh3_64_intdigest(whole) & 0xFFFF) << 48
                columns[0].extend([ids[n]] * len(found))
                columns[1].extend(c[0] for c in found)
                columns[2].extend(tag | c[2] << 32 | c[1] for c in found)
                marks.extend(c[3] for c in found)
                if len(marks) > 100_000 or n + 1 == len(ids):
                    pairs = np.frombuffer(b"".join(marks), dtype="<i8").reshape(-1, 2)
                    keys, at, span = (np.array(c, dtype=t) for c, t in zip(columns, (np.int64, np.int64, np.uint64)))
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (pairs[:, 0], pairs[:, 1], keys, at, span.view(np.int64))], names=names)
                    columns, marks = [[], [], []], []

    return _split_rows(docs).mapInArrow(run, CHUNK)


def _runs(docs: DataFrame, min_words: int) -> DataFrame:
    """:func:`repeats` with ``tag``, which tells texts of the same doc_id apart."""
    once = digests(docs).groupBy("d1").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count("*").alias("n"))
    once = cut_lineage(once.where("first <> last").select("d1", "n"))
    found = cut_lineage(spread_join(chunks(docs), once, ["d1"], "left_semi"))
    kept = found.groupBy("d1", "d2").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count("*").alias("n"))
    kept = cut_lineage(kept.where("first <> last").select("d1", "d2", "first", "n"))
    size, words = F.col("span").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftright("span", 32).bitwiseAND(F.lit(0xFFFF))
    later = spread_join(found, kept, ["d1", "d2"]).where("doc_id <> first").distinct()
    later = later.select("doc_id", F.shiftrightunsigned("span", 48).alias("tag"), "start", (F.col("start") + size).alias("end"), words.alias("words"), "first")
    line = Window.partitionBy("doc_id", "tag").orderBy("start")
    fresh = F.coalesce(F.col("start") > F.lag("end").over(line), F.lit(True)).cast("int")
    runs = later.withColumn("fresh", fresh).withColumn("run", F.sum("fresh").over(line)).groupBy("doc_id", "tag", "run")
    runs = runs.agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sum("words").alias("words"), F.mode("first", True).alias("first_doc_id"))
    return runs.where(F.col("words") >= min_words).select("doc_id", "tag", "first_doc_id", "start", (F.col("end") - F.col("start")).alias("length"), "words")


def repeats(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, first_doc_id, start, length, words): passages that a document of a smaller doc_id holds too.

    Chunks with the same 128-bit digest are the same; the smallest doc_id that holds one keeps it. Runs of neighbouring
    chunks kept elsewhere count from ``min_words`` words on; start and length are bytes. first_doc_id keeps most of the
    run's chunks. The texts are cut twice: first half digests alone are shuffled, to find those that several documents
    hold, then the chunks with one of these are taken; nothing is kept of the others. Digests are summed up before the
    shuffle as far as partitions allow; a passage that very many documents share is dealt over all partitions. Null and empty texts and rows with a null doc_id have no chunks; a passage repeated within one
    document, or in rows that repeat a doc_id, stays. Rows of one doc_id with different texts have spans of their own.
    """
    return _runs(docs, min_words).drop("tag")


@F.pandas_udf(T.StringType())
def _without(text: pd.Series, spans: pd.Series) -> pd.Series:
    def cut(t: str, parts) -> str:
        raw, at, out = t.encode(), 0, []
        for part in parts:
            out.append(raw[at : part["start"]])
            at = part["start"] + part["length"]
        return b"".join([*out, raw[at:]]).decode("utf-8", "replace")

    return pd.Series([t if s is None or t is None else cut(t, s) for t, s in zip(text, spans)])


@F.pandas_udf(T.IntegerType())
def _tag(text: pd.Series) -> pd.Series:
    """The bits of a text that :func:`chunks` packs into a span."""
    return pd.Series([None if t is None else xxhash.xxh3_64_intdigest(t.encode()) & 0xFFFF for t in text], dtype="Int32")


def without_repeats(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with the texts cut by :func:`repeats`; every row stays, a text may become empty. n_chars, if there, follows.

    Columns keep their names, whatever these are.
    """
    spans = lambda: _runs(docs, min_words).groupBy("doc_id", "tag").agg(F.sort_array(F.collect_list(F.struct("start", "length"))).alias("spans"))
    cut = distilled(docs.sparkSession, spans).select(F.struct("doc_id", "tag", "spans").alias("cut"))
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs.doc_id.cast("bigint").alias("key"))
    found = rows.join(cut, (F.col("key") == F.col("cut.doc_id")) & (_tag(F.col("row.text")) == F.col("cut.tag")), "left")
    text = F.when(F.col("cut").isNull(), F.col("row.text")).otherwise(_without(F.col("row.text"), F.col("cut.spans"))).alias("text")
    out = found.select(*[text if c == "text" else F.col(f"row.`{c}`") for c in docs.columns])
    return out.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"])) if "n_chars" in docs.columns else out


def op8_gear_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return repeats(documents(spark, sf))


QUERIES = {"op8_gear_chunks": (op8_gear_chunks, None)}
