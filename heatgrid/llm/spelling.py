"""Spelling variants: words one edit apart meet through one-edit neighbourhoods over a reduced alphabet."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heatgrid.llm.common import documents
from heatgrid.session import cut_lineage, distilled

SYMBOLS = 6  # the letters are hashed to these; more symbols mean more neighbours and fewer candidates
MIN_LETTERS, MIN_COUNT = 5, 3  # of a word that takes part
SLIP = 97  # one run in so many loses a letter
STRONGER = 2  # a form is so many times as frequent as its variant
STEP = 1 << 20  # characters searched at once, and neighbours made at once
HELD = 1 << 18  # words counted before they are handed on

RUN = re.compile("[A-Za-zÀ-ÿ]+")
GAP = re.compile("[^A-Za-zÀ-ÿ]")

#: Symbol of each letter: a hash of its code point. All letters lie below U+0100.
SYMBOL = np.array([zlib.crc32(bytes([c])) % SYMBOLS for c in range(256)], dtype=np.int64)
#: Value of each symbol in the polynomial hash of a reduced word, and the hash's base; from a fixed seed.
_VALUES = np.random.default_rng(20260301).integers(1, 1 << 63, SYMBOLS, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _lower(run: str) -> str:
    """A-Z in lower case, other letters as they are."""
    return run.lower() if run.isascii() else run.translate({c: c + 32 for c in range(65, 91)})


def runs(text: str) -> Counter:
    """How often each run of letters occurs in a text, A-Z in lower case."""
    raw, at = Counter(), 0
    while at < len(text):
        gap = GAP.search(text, at + STEP) if len(text) - at > STEP else None
        end = gap.start() if gap else len(text)
        raw.update(RUN.findall(text, at, end))
        at = end
    found = Counter()
    for run, n in raw.items():
        found[_lower(run)] += n
    return found


def slipped(run: str, seed: int) -> str:
    """The run, or the run without one letter; ``seed`` is the crc32 of what precedes the run in the hashed text."""
    h = zlib.crc32(run.encode(), seed)
    return run if h % SLIP else run[: h % len(run)] + run[h % len(run) + 1 :]


def vocabulary(docs: DataFrame, min_letters: int = MIN_LETTERS, min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n): runs of letters, after the slips, of ``min_letters`` and more that occur ``min_count`` times and more.

    Null and empty texts have no runs; a null doc_id is hashed as empty text. Words are counted inside the tasks first.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        out = lambda: pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])
        for batch in batches:
            for key, text in zip(batch.column("key").to_pylist(), batch.column("text")):
                seed = zlib.crc32(f"{key}:".encode())
                for word, n in runs(text.as_py()).items():
                    word = slipped(word, seed)
                    if len(word) >= min_letters:
                        held[word] += n
                if len(held) > HELD:
                    yield out()
                    held.clear()
        yield out()

    rows = docs.where("text IS NOT NULL").select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("key"), F.col("text"))
    return rows.mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def _by_length(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(which words, their symbols as a matrix) for every length among ``words``, not more than STEP letters at once."""
    letters = np.frombuffer("".join(words).encode("latin-1"), dtype=np.uint8)
    size = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    start = np.concatenate([[0], np.cumsum(size)[:-1]]).astype(np.int64)
    for length in np.unique(size).tolist():
        which = np.flatnonzero(size == length)
        few = max(1, STEP // (2 * SYMBOLS * max(1, length)))
        for at in range(0, len(which), few):
            some = which[at : at + few]
            yield some, SYMBOL[letters[start[some][:, None] + np.arange(length)]]


def _hashes(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the beginnings and of the ends of reduced words of one length, and the powers of the base."""
    n, length = symbols.shape
    power = np.ones(length + 2, dtype=np.uint64)
    head, tail = np.zeros((n, length + 1), dtype=np.uint64), np.zeros((n, length + 1), dtype=np.uint64)
    power[1:] = np.multiply.accumulate(np.full(length + 1, _BASE))
    for i in range(length):
        head[:, i + 1] = head[:, i] * _BASE + _VALUES[symbols[:, i]]
        j = length - 1 - i
        tail[:, j] = tail[:, j + 1] + _VALUES[symbols[:, j]] * power[i]
    return head, tail, power


def codes(words: list[str]) -> np.ndarray:
    """32-bit hash of each word's reduced form. Forms that share one by chance are ruled out by the words themselves."""
    out = np.zeros(len(words), dtype=np.uint64)
    for which, symbols in _by_length(words):
        out[which] = _hashes(symbols)[0][:, -1]
    return (out >> np.uint64(32)).astype(np.uint32).view(np.int32)


def _edits(symbols: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, hash) of every string that one edit or none makes of reduced words of one length.

    An edited string is a beginning, perhaps a symbol, and an end, so its hash follows from theirs. A symbol is deleted
    where a run of it starts and inserted behind the run, so no string comes twice. Long words are done in slices.
    """
    head, tail, power = _hashes(symbols)
    n, length = symbols.shape
    here = np.concatenate([symbols, np.full((n, 1), -1)], axis=1)
    yield np.arange(n), head[:, -1]
    for at in range(0, length + 1, STEP):
        i, j = np.arange(at, min(length, at + STEP)), np.arange(at, min(length + 1, at + STEP))
        first = (i == 0) | (symbols[:, i] != symbols[:, i - 1])
        dropped = head[:, i] * power[length - 1 - i] + tail[:, i + 1]
        yield np.nonzero(first)[0], dropped[first]
        for c, value in enumerate(_VALUES):
            other = symbols[:, i] != c
            replaced = head[:, i] * power[length - i] + value * power[length - 1 - i] + tail[:, i + 1]
            yield np.nonzero(other)[0], replaced[other]
            behind = here[:, j] != c
            inserted = head[:, j] * power[length + 1 - j] + value * power[length - j] + tail[:, j]
            yield np.nonzero(behind)[0], inserted[behind]


def neighbourhoods(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(which words, 32-bit hashes) of the full one-edit neighbourhoods of the words' reduced forms, a hash once a word."""
    for which, symbols in _by_length(words):
        found = [(rows.astype(np.uint64) << np.uint64(32)) | (keys >> np.uint64(32)) for rows, keys in _edits(symbols)]
        both = np.unique(np.concatenate(found))
        yield which[(both >> np.uint64(32)).astype(np.int64)], both.astype(np.uint32).view(np.int32)


def near(words: DataFrame) -> DataFrame:
    """(u, v, n_v): ordered pairs of ``words`` (word, n) that differ by one inserted, deleted or replaced letter.

    The neighbourhood of u's reduced form holds the reduced form of each such v: an edit of the word is an edit of its
    reduced form, or none. So they meet in a join on the hash, once, and the words themselves settle it. Words are
    distinct, so a crowded hash is a set of different words; Spark splits it where it is a skewed partition. The plan
    takes the neighbourhoods to be as small as the words they come from, a hundredth, so the join is told to shuffle:
    otherwise a vocabulary of a few MB has all of them sent to the driver.
    """

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column("word")
            for which, keys in neighbourhoods(words.to_pylist()):
                yield pa.RecordBatch.from_arrays([pa.array(keys), words.take(pa.array(which))], names=["key", "u"])

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(codes(batch.column("word").to_pylist())), batch.column("word"), batch.column("n")], names=["key", "v", "n_v"])

    keys, held = words.select("word").mapInArrow(spread, "key int, u string"), words.select("word", "n").mapInArrow(own, "key int, v string, n_v bigint")
    return keys.hint("merge").join(held, "key").where((F.col("u") != F.col("v")) & (F.levenshtein("u", "v", 1) == 1)).select("u", "v", "n_v")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): the end of each chain of ``forms`` (word, form), by doubling the steps until none goes on.

    Counts at least double from a word to its form, so chains are short and have no rings: the rounds are as few as the
    logarithm of a chain. Files of words are a fraction of the rows in memory, so these joins are told to shuffle too.
    """
    step = cut_lineage(forms.where("form IS NOT NULL").select("word", F.col("form").alias("to")))
    while True:
        ahead = step.select(F.col("word").alias("at"), F.col("to").alias("next"))
        step = cut_lineage(step.join(ahead.hint("merge"), F.col("to") == F.col("at"), "left").select("word", F.coalesce("next", "to").alias("to"), F.col("next").isNotNull().alias("moved")))
        if not step.where("moved").limit(1).count():
            return step.select("word", F.col("to").alias("root"))
        step = step.drop("moved")


def variants(words: DataFrame) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of ``words`` (word, n), each word once.

    n_near: near words; form: the most frequent of them, the first in code-point order of several, if it is at least
    twice as frequent as the word; root: where following the forms ends, the word itself without one.
    """
    best = F.min(F.struct((-F.col("n_v")).alias("n"), F.col("v").alias("v"))).alias("best")
    met = near(words).groupBy(F.col("u").alias("word")).agg(F.count("v").alias("n_near"), best)
    known = words.join(met, "word", "left")
    strong = -F.col("best.n") >= STRONGER * F.col("n")
    known = cut_lineage(known.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), F.when(strong, F.col("best.v")).alias("form"), F.when(strong, -F.col("best.n")).alias("form_n")))
    return known.join(roots(known).hint("merge"), "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))


def spelling_variants(docs: DataFrame, min_letters: int = MIN_LETTERS, min_count: int = MIN_COUNT) -> DataFrame:
    """:func:`variants` of the :func:`vocabulary` of ``docs`` (doc_id, text, any others, which are not read)."""
    words = cut_lineage(vocabulary(docs, min_letters, min_count))
    return variants(words)


def op12_reduced_alphabet(spark: SparkSession, sf: str) -> DataFrame:
    return distilled(spark, lambda: spelling_variants(documents(spark, sf)))


QUERIES = {"op12_reduced_alphabet": (op12_reduced_alphabet, None)}
