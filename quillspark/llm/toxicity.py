"""Toxicity by subword-bag embeddings under a linear softmax.

A word is a bag: itself and its character n-grams, each hashed to a row of an embedding table, of which the mean is taken.
A text's embedding is the mean over its distinct words plus that of its most toxic word, so that length does not dilute it; it
goes through a linear softmax.  Table and softmax are trained jointly in numpy by their gradients, first on the means, which
finds the telling n-grams, then on both.  Misspelled or inflected words that training never saw share the n-grams of those it
saw.

As the classes are two, only the difference of the two softmax columns matters, and a row's gradient is a multiple of it.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.llm.shared import bound_batches, held_out, hold

BUCKETS, WIDTH = 1 << 18, 8
GRAMS = range(3, 7)
#: Labelled rows of each class that training reads at most.
SAMPLE = 2000
#: Longer words are read as overlapping pieces of this many characters, each a word of its own.
LONG_WORD = 64
FIRST_STEPS, LAST_STEPS = 6, 200
#: Steps of the second phase: at most this many times the gradient.
FASTEST = 400.0
SOFTMAX_RATE = 0.5
KNOWN_WORDS = 500_000
PARTS = re.compile(r"[^\W_]+")


def bag(word: str) -> list[int]:
    """Table rows of the word and its n-grams; the word's ends are marked."""
    marked = f"<{word}>"
    rows = [zlib.crc32(b"=" + word.encode()) % BUCKETS]
    for n in GRAMS:
        rows += [zlib.crc32(marked[i : i + n].encode()) % BUCKETS for i in range(len(marked) - n + 1)]
    return rows


def parts_of(word: str) -> list[str]:
    """Runs of letters and digits; a long one in pieces that overlap by half, so that every n-gram of it counts."""
    found = PARTS.findall(word)
    if len(word) <= LONG_WORD:
        return found
    half = LONG_WORD // 2
    return [part[k : k + LONG_WORD] for part in found for k in range(0, max(1, len(part) - half), half)]


def distinct_parts(text: str | None) -> list[str]:
    return list({part for word in set((text or "").lower().split()) for part in parts_of(word)})


@dataclass
class Model:
    """``rows``: each table row's part in the difference of the logits; ``bias``: the difference for a text without words."""

    rows: np.ndarray
    bias: float

    def values(self, words: list[str]) -> np.ndarray:
        """Each word's part in the difference."""
        bags = [bag(word) for word in words]
        if not bags:
            return np.empty(0)
        sizes = np.fromiter(map(len, bags), np.int64, len(bags))
        flat = np.fromiter((x for b in bags for x in b), np.int64, sizes.sum())
        return np.add.reduceat(self.rows[flat], np.r_[0, np.cumsum(sizes)[:-1]]) / sizes


def train(texts: pa.ListArray, toxic: np.ndarray, seed: int = 7) -> Model:
    """``texts``: distinct words of each text; ``toxic``: 0 or 1.

    Words and n-grams are held as flat arrays of numbers, as the driver's memory is small.
    """
    random = np.random.default_rng(seed)
    table = random.uniform(-1 / WIDTH, 1 / WIDTH, (BUCKETS, WIDTH)).astype(np.float32) * np.float32(0.01)
    softmax = np.stack([-np.ones(WIDTH), np.ones(WIDTH)], axis=1) / np.sqrt(2 * WIDTH)
    prior = (toxic.sum() + 1) / (len(toxic) + 2)
    counts = np.asarray(texts.value_lengths().fill_null(0), dtype=np.int64)
    if not counts.sum():
        return Model(np.zeros(BUCKETS, np.float32), float(np.log(prior / (1 - prior))))
    full = np.flatnonzero(counts)
    label, counts = toxic[full].astype(float), counts[full]
    coded = texts.flatten().dictionary_encode()
    word_of = coded.indices.to_numpy()
    starts = np.r_[0, np.cumsum(counts)[:-1]]
    grams, sizes = array("i"), array("i")
    for word in coded.dictionary:
        rows = bag(word.as_py())
        grams.extend(rows)
        sizes.append(len(rows))
    grams, sizes = np.frombuffer(grams, np.int32), np.frombuffer(sizes, np.int32)
    n_words = len(sizes)
    gram_starts, word_of_gram = np.r_[0, np.cumsum(sizes)[:-1]], np.repeat(np.arange(n_words, dtype=np.int32), sizes)
    bias = np.log(prior / (1 - prior))

    def step(by_word: np.ndarray, most: float, fastest: float = np.inf) -> None:
        """One gradient step: ``by_word`` is the loss's derivative by each word's logit; the largest change is ``most``."""
        nonlocal table, softmax
        by_row = np.bincount(grams, weights=(by_word / sizes)[word_of_gram], minlength=BUCKETS)
        way = softmax[:, 1] - softmax[:, 0]
        largest = np.abs(by_row).max()
        if largest > 0:
            rate = min(most / largest, fastest) / (way @ way)
            by_way = SOFTMAX_RATE * (by_row @ table)
            table -= (rate * by_row)[:, None].astype(np.float32) * way.astype(np.float32)
            softmax += np.stack([by_way, -by_way], axis=1) / 2

    def word_values() -> np.ndarray:
        rows = table @ (softmax[:, 1] - softmax[:, 0]).astype(np.float32)
        return np.add.reduceat(rows[grams], gram_starts) / sizes

    def chance(logit: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))

    weight = np.full(len(full), 1 / len(full))
    each, text_of = np.repeat(weight / counts, counts), np.repeat(np.arange(len(full)), counts)
    for _ in range(FIRST_STEPS):
        error = (chance(word_values())[word_of] - label[text_of]) * each
        step(np.bincount(word_of, weights=error, minlength=n_words), 1.0)
    for _ in range(LAST_STEPS):
        of_word = word_values()[word_of]
        most, mean = np.maximum.reduceat(of_word, starts), np.add.reduceat(of_word, starts) / counts
        error = (chance(most + mean + bias) - label) * weight
        hit = np.flatnonzero(of_word == most[text_of])
        _, first = np.unique(text_of[hit], return_index=True)
        # in a text that is not toxic no word is
        rest = np.where(label[text_of] > 0, 0, each * chance(of_word + bias))
        by_word = np.bincount(word_of[hit[first]], weights=error, minlength=n_words)
        step(by_word + np.bincount(word_of, weights=rest + (error / counts)[text_of], minlength=n_words), 1.0, FASTEST)
        bias -= 0.5 * error.sum()
    return Model((table @ (softmax[:, 1] - softmax[:, 0]).astype(np.float32)).astype(np.float32), float(bias))


def training_sample(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[pa.ListArray, np.ndarray]:
    """Distinct words and labels of at most ``sample`` labelled documents of each class that are not held out."""
    known = labels.where("doc_id is not null and toxic in (0, 1)").where(~held_out("doc_id", 5, 0)).select("doc_id", "toxic")
    parts = [known.where(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for c in (0, 1)]
    chosen = parts[0].unionByName(parts[1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [sorted(distinct_parts(text.as_py())) for text in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(words, pa.list_(pa.string()))], names=["doc_id", "toxic", "words"])

    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")  # at most twice ``sample`` rows
    rows = found.select("doc_id", "toxic", "text").mapInArrow(run, "doc_id long, toxic int, words array<string>").toArrow().sort_by([("doc_id", "ascending"), ("toxic", "ascending")])
    words = rows.column("words").combine_chunks() if rows.num_rows else pa.array([], pa.list_(pa.string()))
    return words, rows.column("toxic").to_numpy()


_known: dict[str, float | None] = {}
_known_for: list = [None]


def text_logits(texts: list[str | None], model: Model, key: str) -> np.ndarray:
    """Difference of the logits for each text: of its most toxic word, its mean word and the bias."""
    hold(_known.clear)
    if _known_for[0] != key:
        _known.clear()
        _known_for[0] = key
    words = [set((text or "").lower().split()) for text in texts]
    new = set().union(*words).difference(_known)
    if len(_known) + len(new) > KNOWN_WORDS:
        _known.clear()
        new = set().union(*words)
    parts = {word: parts_of(word) for word in new}
    distinct = list({part for found in parts.values() for part in found})
    values = dict(zip(distinct, model.values(distinct).tolist()))
    for word, found in parts.items():
        _known[word] = max((values[part] for part in found), default=None)
    out = np.full(len(texts), model.bias)
    for k, own in enumerate(words):
        found = [value for value in map(_known.__getitem__, own) if value is not None]
        if found:
            out[k] += max(found) + sum(found) / len(found)
    return out


def score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``row, score``: each row of ``docs`` as a struct, and the probability of label 1 for its text."""
    spark = docs.sparkSession
    bound_batches(spark)
    sent, key = spark.sparkContext.broadcast(model), str(zlib.crc32(model.rows.tobytes()))  # of fixed size
    rows = docs.select(F.struct("*").alias("row"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            logits = text_logits(batch.column(1).to_pylist(), sent.value, key)
            scores = 1 / (1 + np.exp(-np.clip(logits, -50, 50)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores)], names=["row", "score"])

    return rows.mapInArrow(run, T.StructType([rows.schema["row"], T.StructField("score", T.DoubleType())]))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    return train(*training_sample(docs, labels, sample))


def score_documents(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row.

    Learns from labelled rows that are not held out, a bounded number of each class, by whole texts.  A null or empty text
    scores as an empty bag.  Null labels are not learned from; a null id counts as the empty text when folds are made.
    Repeated rows score alike.  An empty table gives no rows; without labels all score one half.
    """
    scored = score(docs.select("doc_id", "text"), fit(docs, labels, sample)).select("row.doc_id", "score")
    return scored.select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The rows of ``docs`` predicted not toxic, all columns whatever their names.

    Null and empty texts score as texts without words; long ones are read whole; repeated rows stay or go together; an empty
    table gives no rows.
    """
    return score(docs, fit(docs, labels, sample)).where("score < 0.5").select("row.*")
