"""Toxicity by class-conditional Kneser-Ney models over words and word pairs."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heatgrid.llm.common import documents, held_out
from heatgrid.session import cut_lineage

PER_CLASS = 10_000  # labelled rows of each class that are learned from, at most; those with the smallest hashes
DISCOUNT = 4.0  # off every count: what a class has seen four times or less is left to the shared counts
STRONG = 1.5  # log-likelihood gain of a word from which on it also counts by itself
CUT = 0.7  # score from which on a document is called toxic
CALIBRATION = 4  # one learning row in so many sets the scale of the scores and is kept out of the counts
CACHED_WORDS = 500_000  # words a task remembers at a time; a memory bound only
HELD = 1 << 18  # distinct words, and pairs of learned texts, that a task counts before it hands them on

_FOLD = bytes(32 if c < 48 or 57 < c < 65 or 90 < c < 97 or 122 < c < 128 else c + 32 if 65 <= c <= 90 else c for c in range(256))
START = 0  # key of what comes before the first word


def word_key(word: bytes) -> int:
    """64-bit hash of a word, signed."""
    return xxhash.xxh3_64_intdigest(word) - (1 << 63)


def split(text: bytes | None) -> list[bytes]:
    """Words of a text: A-Z folded, ASCII marks apart."""
    return (text or b"").translate(_FOLD).split()


class Places(dict):
    """Word -> its place among the model's words; the last place stands for every word that the classes never held."""

    def __init__(self, keys: np.ndarray):
        super().__init__()
        self.keys = keys

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHED_WORDS:
            self.clear()
        key = word_key(word)
        at = int(np.searchsorted(self.keys, key))
        place = self[word] = at if at < len(self.keys) and self.keys[at] == key else len(self.keys)
        return place

    def of(self, text: bytes | None) -> np.ndarray:
        found = split(text)
        return np.fromiter(map(self.__getitem__, found), dtype=np.int64, count=len(found))


class Model:
    """Interpolated Kneser-Ney probabilities of both classes, as arrays over the words of the learned texts.

    A pair's count less a discount, then the class's continuation counts of the word (how many words it follows) less a
    discount, then the word's count in the whole corpus, which both classes share. A word that no learned text holds has
    the shared count alone in both classes, so that count cancels and is not needed. Pairs seen no more often than the
    discount add nothing of their own. So the arrays are as large as the learned texts' vocabulary, whatever the corpus.
    """

    def __init__(self, pairs: pd.DataFrame, before: pd.DataFrame, after: pd.DataFrame, shared: pd.DataFrame, n_all: int, n_kinds: int):
        self.keys = np.unique(np.concatenate([before["key"].to_numpy(np.int64), after["key"].to_numpy(np.int64), np.array([START])]))
        size, d = len(self.keys) + 1, DISCOUNT
        at = lambda keys: np.searchsorted(self.keys, keys.to_numpy(np.int64))
        base = np.ones(size, dtype=np.float64)
        base[at(shared["key"])] += shared["n"]
        base /= max(n_all + n_kinds, 1)
        codes = at(pairs["prev"]) * size + at(pairs["key"])
        order = np.argsort(codes)
        self.codes, self.start = codes[order], int(np.searchsorted(self.keys, START))
        self.pair, self.rest, self.word = [], [], []
        for c in ("toxic", "plain"):
            uses, spare, follows = np.zeros(size), np.zeros(size), np.zeros(size)
            uses[at(before["key"])], spare[at(before["key"])] = before[f"n_{c}"], before[f"d_{c}"]
            follows[at(after["key"])] = after[f"k_{c}"]
            total = max(follows.sum(), 1.0)
            word = np.maximum(follows - d, 0) / total
            word += (1 - word.sum()) * base
            self.word.append(word.astype(np.float32))
            self.pair.append(np.append(np.maximum(pairs[f"n_{c}"].to_numpy(np.float64)[order] - d, 0), 0).astype(np.float32))
            seen = np.maximum(uses, 1)
            self.rest.append((np.where(uses > 0, spare / seen, 1.0).astype(np.float32), (1 / seen).astype(np.float32)))
        self.gain = np.log(self.word[0] / self.word[1])

    def evidence(self, words: np.ndarray) -> tuple[float, float]:
        """Log-likelihood per word, toxic less ordinary, and its part from words beyond ``STRONG``; zeros without words."""
        if not len(words):
            return 0.0, 0.0
        first = np.concatenate([[self.start], words[:-1]])
        codes = first * (len(self.keys) + 1) + words
        slots = np.searchsorted(self.codes, codes)
        met = slots < len(self.codes)
        met[met] = self.codes[slots[met]] == codes[met]
        slots = np.where(met, slots, len(self.codes))
        logs = []
        for pair, (rest, share), word in zip(self.pair, self.rest, self.word):
            logs.append(np.log(pair[slots] * share[first] + rest[first] * word[words]))
        gain = float(np.mean(logs[0] - logs[1], dtype=np.float64))
        return gain, float(np.mean(np.maximum(self.gain[words] - STRONG, 0), dtype=np.float64))


def features(evidence: np.ndarray, n: np.ndarray) -> np.ndarray:
    """What the score's scale is fitted on, from (mean, strong) and the number of words."""
    mean, strong = evidence[:, 0], evidence[:, 1]
    return np.column_stack([np.ones(len(n)), np.clip(mean, -1, 1), np.log1p(100 * strong), np.log1p(strong * n), np.log1p(n) / 10])


def fit_scale(evidence: np.ndarray, n: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Logistic weights by Newton steps with a small ridge."""
    x = features(evidence, n)
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 0.05 * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (toxic - p) - 0.05 * w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return w


def learning_rows(labels: DataFrame) -> tuple[dict[int, int], list[int]]:
    """Documents to count, doc_id -> toxic, as many of either class; and documents that set the scale of the scores.

    Rows without an id or a label of 0 or 1, and rows held out, are not learned from; a document with several labels is
    toxic if any says so. Both are samples of PER_CLASS rows a class at most, taken by hash.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id")))
    known = known.groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    known = known.select("doc_id", "toxic", F.xxhash64("doc_id").alias("draw"), (F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(CALIBRATION)) == 0).alias("scale"))
    first = lambda rows, n: rows.orderBy("draw", "doc_id").limit(n).select("doc_id").collect()
    toxic = [r.doc_id for r in first(known.where("toxic = 1 AND NOT scale"), PER_CLASS)]
    plain = [r.doc_id for r in first(known.where("toxic = 0 AND NOT scale"), max(len(toxic), 1))]
    scale = [r.doc_id for r in first(known.where("scale"), 2 * PER_CLASS)]
    return dict.fromkeys(toxic, 1) | dict.fromkeys(plain, 0), scale


COUNTS = "prev bigint, key bigint, n_toxic bigint, n_plain bigint, n bigint"


def counts(docs: DataFrame, learned: dict[int, int]) -> DataFrame:
    """Counts by 64-bit hashes, in one pass: of words in all documents (prev null, n), and of each word with the one
    before it in the learned documents by class. Both are summed inside the tasks first, and grow with the corpus."""
    known = docs.sparkSession.sparkContext.broadcast(learned)

    def rows(prev: list | None, key: list, toxic: list, plain: list, n: list) -> pa.RecordBatch:
        before = pa.nulls(len(key), pa.int64()) if prev is None else pa.array(prev, pa.int64())
        return pa.RecordBatch.from_arrays([before, *(pa.array(c, pa.int64()) for c in (key, toxic, plain, n))], names=["prev", "key", "n_toxic", "n_plain", "n"])

    def words(held: Counter) -> pa.RecordBatch:
        zero = [0] * len(held)
        return rows(None, list(map(word_key, held)), zero, zero, list(held.values()))

    def pairs(held: tuple[Counter, Counter]) -> pa.RecordBatch:
        plain, toxic = held
        both = list(plain.keys() | toxic.keys())
        key = lambda w: START if w is None else word_key(w)
        return rows([key(a) for a, _ in both], [key(b) for _, b in both], [toxic[x] for x in both], [plain[x] for x in both], [0] * len(both))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every, held = Counter(), (Counter(), Counter())
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                found = split(text.as_py())
                every.update(found)
                toxic = known.value.get(doc_id)
                if toxic is not None:
                    held[toxic].update(zip([None, *found], found))
                if len(every) > HELD:
                    yield words(every)
                    every.clear()
                if len(held[0]) + len(held[1]) > HELD:
                    yield pairs(held)
                    held = (Counter(), Counter())
        yield words(every)
        yield pairs(held)

    sums = docs.mapInArrow(run, COUNTS).groupBy("prev", "key")
    return sums.agg(*[F.sum(c).alias(c) for c in ("n_toxic", "n_plain", "n")])


def model(counted: DataFrame) -> Model:
    """The written counts as arrays. What comes here has a row for each word of the learned texts, and one for each of
    their pairs that is more frequent than the discount: PER_CLASS bounds the texts."""
    pairs = counted.where("prev IS NOT NULL")
    every = counted.where("prev IS NULL")
    least = {f"d_{c}": F.sum(F.least(F.col(f"n_{c}").cast("double"), F.lit(DISCOUNT))) for c in ("toxic", "plain")}
    total = {f"n_{c}": F.sum(f"n_{c}") for c in ("toxic", "plain")}
    kinds = {f"k_{c}": F.sum(F.when(F.col(f"n_{c}") > 0, 1).otherwise(0)) for c in ("toxic", "plain")}
    table = lambda df: df.toArrow().to_pandas()
    by = lambda c, what: pairs.groupBy(F.col(c).alias("key")).agg(*[x.alias(k) for k, x in what.items()])
    after = cut_lineage(by("key", kinds))
    frequent = pairs.where((F.col("n_toxic") > DISCOUNT) | (F.col("n_plain") > DISCOUNT)).select("prev", "key", "n_toxic", "n_plain")
    shared = every.join(after.select("key"), "key", "left_semi").select("key", "n")
    size = every.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("key").alias("kinds")).first()
    return Model(table(frequent), table(by("prev", total | least)), table(after), table(shared), size.n, size.kinds)


def evidence(docs: DataFrame, fitted: Model) -> DataFrame:
    """(doc_id, n_words, mean, strong) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(fitted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = Places(shared.value.keys)
        for batch in batches:
            found, pairs = [], []
            for text in batch.column("text"):
                at = places.of(text.as_py())
                found.append(len(at))
                pairs.append(shared.value.evidence(at))
            both = np.array(pairs, dtype=np.float64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.int64()), pa.array(both[:, 0]), pa.array(both[:, 1])], names=["doc_id", "n_words", "mean", "strong"])

    return docs.mapInArrow(run, "doc_id bigint, n_words bigint, mean double, strong double")


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted, n_words, evidence) for every row of ``docs`` (doc_id, text, any others).

    Both classes' models are fitted to labelled rows that are not held out; the counts that rare expressions fall back
    on come from all documents. evidence: log-likelihood per word, toxic less ordinary. score: from evidence and length
    through a logistic scale fitted on learning rows that were not counted. Null and empty texts have no evidence; rows
    with a null doc_id are scored; repeated rows are scored alike. Without usable labels every score is 0.5.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    learned, scale = learning_rows(labels)
    fitted = model(cut_lineage(counts(rows, learned)))
    found = cut_lineage(evidence(rows, fitted))
    known = docs.sparkSession.createDataFrame([(i,) for i in scale], "doc_id bigint").join(labels.where("toxic IN (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic")), "doc_id")
    train = found.dropDuplicates(["doc_id"]).join(known, "doc_id").select("mean", "strong", "n_words", "toxic").toArrow().to_pandas()
    w = fit_scale(train[["mean", "strong"]].to_numpy(float), train["n_words"].to_numpy(float), train["toxic"].to_numpy(float))
    mean, strong, n = F.col("mean"), F.col("strong"), F.col("n_words")
    parts = [F.lit(1.0), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), mean)), F.log1p(100 * strong), F.log1p(strong * n), F.log1p(n) / 10]
    sure = sum((float(a) * p for a, p in zip(w[1:], parts[1:])), F.lit(float(w[0])))
    out = found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), (1 / (1 + F.exp(-sure))).alias("score"), "n_words", mean.alias("evidence"))
    return out.select("doc_id", "held_out", "score", F.when(F.col("score") >= CUT, 1).otherwise(0).alias("predicted"), "n_words", "evidence")


def op3_kneser_ney(spark: SparkSession, sf: str) -> DataFrame:
    return score(documents(spark, sf), spark.read.parquet(f"{sf}/labels.parquet"))


QUERIES = {"op3_kneser_ney": (op3_kneser_ney, None)}
