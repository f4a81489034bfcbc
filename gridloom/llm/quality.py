"""Quality classifier: supervised subword embeddings.

A text's features are its words, its character n-grams and its immediate word repeats, each hashed to one of a fixed
number of rows of an embedding table. A document is the average of its features' vectors; a softmax over the two
labels follows. Both tables are learned by stochastic gradient descent in numpy, on a bounded sample of the labelled
rows (``per_class`` rows of each label, those with the smallest hashes of doc_id). What is learned is of a fixed size,
so broadcasting it doesn't grow with the data. As the output is linear in the average before the softmax, scoring
needs one number a feature; a document costs one gather.

Defined results: null or empty texts, and texts of white space only, have no features and get the score of the bias
alone, the same for all of them; repeated rows get the same score each; without labelled rows every score is 0.5;
labels other than 0 and 1, and null ones, aren't learned from, and of an id that has several the larger one counts; of a doc_id that is repeated one text is
learned from, that with the smallest hash; a score of exactly 0.5 is a prediction of 1; texts of any length are scored whole; an empty table gives none; columns of the input stay as they are, and a clashing
column name of it is kept while the new column takes the name asked for with underscores added.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm._words import Words, chunks, mix


@dataclass(frozen=True)
class QualityConfig:
    buckets_log2: int = 17
    dims: int = 8
    char_grams: tuple[int, ...] = (2, 3, 4)
    per_class: int = 2500
    epochs: int = 6
    least_steps: int = 4000
    rate: float = 8.0
    seed: int = 7


def features(words: Words, config: QualityConfig) -> tuple[np.ndarray, np.ndarray]:
    """Row and hashed id of every feature occurrence of a slice of texts."""
    mask = np.uint64((1 << config.buckets_log2) - 1)
    rows, ids = [words.row], [(mix(words.hash) & mask).astype(np.int64)]
    same = np.flatnonzero((words.hash[1:] == words.hash[:-1]) & (words.row[1:] == words.row[:-1]))
    rows.append(words.row[same])
    ids.append(np.zeros(len(same), np.int64))
    # Characters of words: bytes that don't continue one, each with the number of its word.
    word_at = np.zeros(len(words.data) + 1, np.int32)
    word_at[words.start] = 1
    np.cumsum(word_at, out=word_at)
    inside = np.zeros(len(words.data) + 1, np.int8)
    inside[words.start] += 1
    np.subtract.at(inside, words.end, 1)
    chars = np.flatnonzero((np.cumsum(inside[:-1]) > 0) & ((words.data & 0xC0) != 0x80))
    word = word_at[chars] - 1
    after = np.append(chars[1:], 0)
    if len(chars):
        last = np.append(word[1:] != word[:-1], True)
        after[last] = words.end[word[last]]
    for n in config.char_grams:
        j = np.arange(max(0, len(chars) - n + 1))
        j = j[word[j] == word[j + n - 1]]
        rows.append(words.row[word[j]])
        ids.append(((words.bytes.hash(chars[j], after[j + n - 1]) ^ np.uint64(n)) & mask).astype(np.int64))
    return np.concatenate(rows), np.concatenate(ids)


def counted(column: pa.Array, config: QualityConfig) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Distinct feature ids of each text and their counts."""
    for a, b in chunks(column):
        rows, ids = features(Words(column[a:b]), config)
        key, n = np.unique(rows << config.buckets_log2 | ids, return_counts=True)
        of, ids = key >> config.buckets_log2, (key & ((1 << config.buckets_log2) - 1)).astype(np.int32)
        cut = np.searchsorted(of, np.arange(b - a + 1))
        for i in range(b - a):
            yield ids[cut[i] : cut[i + 1]], n[cut[i] : cut[i + 1]].astype(np.int32)


def train(examples: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, config: QualityConfig) -> tuple[np.ndarray, float]:
    """A weight for each feature id and a bias: the difference of the two softmax outputs is bias + mean weight."""
    rng = np.random.default_rng(config.seed)
    table = rng.uniform(-1, 1, (1 << config.buckets_log2, config.dims)).astype(np.float32) / config.dims
    out, bias = np.zeros((config.dims, 2), np.float32), np.zeros(2, np.float32)
    epochs = max(config.epochs, -(-config.least_steps // max(1, len(examples))))  # few rows are seen more often
    total = max(1, epochs * len(examples))
    step = 0
    for _ in range(epochs):
        for i in rng.permutation(len(examples)):
            rate = np.float32(config.rate * (1 - step / total))
            step += 1
            ids, n = examples[i]
            share = (n / max(1, n.sum())).astype(np.float32)
            hidden = share @ table[ids]
            z = hidden @ out + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[labels[i]] -= 1
            back = out @ p
            out -= rate * 0.05 * np.outer(hidden, p)
            bias -= rate * np.float32(0.002) * p
            if len(ids):
                table[ids] -= rate * share[:, None] * back
    return table @ (out[:, 1] - out[:, 0]), float(bias[1] - bias[0])


def scores(column: pa.Array, weights: np.ndarray, bias: float, config: QualityConfig) -> np.ndarray:
    out = np.empty(len(column))
    for a, b in chunks(column):
        rows, ids = features(Words(column[a:b]), config)
        total, n = np.bincount(rows, weights[ids], b - a), np.bincount(rows, minlength=b - a)
        out[a:b] = 1 / (1 + np.exp(-np.clip(bias + total / np.maximum(n, 1), -30, 30)))
    return out


def held_out(doc_id: Column | str = "doc_id") -> Column:
    """Rows that are never learned from: crc32(doc_id as text) mod 3 is 1."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary") if isinstance(doc_id, str) else doc_id) % 3 == 1, F.lit(False))


@dataclass(frozen=True)
class QualityModel:
    weights: np.ndarray
    bias: float
    config: QualityConfig

    def score(self, spark: SparkSession, text: str = "text") -> Column:
        """A column with the probability of label 1 for each text."""
        model = spark.sparkContext.broadcast((self.weights, self.bias, self.config))

        @F.arrow_udf("double")
        def quality(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for x in batches:
                yield pa.array(scores(x, *model.value))

        return quality(F.col(text).cast("string"))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", config: QualityConfig = QualityConfig()) -> QualityModel:
    """Learns from labelled rows that aren't held out. docs: doc_id, text; labels: doc_id and the label, 0 or 1."""
    spark = docs.sparkSession
    usable = labels.select(F.col("doc_id").alias("_id"), F.col(label).cast("int").alias("_label")).where(F.col("_id").isNotNull() & ~held_out(F.col("_id").cast("string").cast("binary")))
    usable = usable.groupBy("_id").agg(F.max("_label").alias("_label"))
    order = [F.xxhash64("_id"), "_id"]
    chosen = [usable.where(F.col("_label") == y).orderBy(*order).limit(config.per_class) for y in (0, 1)]
    few = F.broadcast(chosen[0].unionByName(chosen[1]))  # at most 2 * per_class rows of two numbers
    sample = docs.select(F.col("doc_id").alias("_id"), F.col("text").cast("string").alias("_text")).join(few, "_id")
    # One text of each id, however often it is repeated; combined before the shuffle.
    sample = sample.groupBy("_id").agg(F.max("_label").alias("_label"), F.min_by("_text", F.xxhash64("_text")).alias("_text")).select("_id", "_text", "_label")

    def featurize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            ids, n = [], []
            for i, k in counted(x.column("_text"), config):
                ids.append(i.tobytes())
                n.append(k.tobytes())
            yield pa.RecordBatch.from_arrays([x.column("_id"), x.column("_label"), pa.array(ids, pa.binary()), pa.array(n, pa.binary())], ["_id", "_label", "ids", "n"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for x in batches for r in zip(x.column("_id").to_pylist(), x.column("_label").to_pylist(), x.column("ids").to_pylist(), x.column("n").to_pylist(), strict=True)]
        rows.sort(key=lambda r: (str(r[0]), r[1], r[2]))
        if rows:
            examples = [(np.frombuffer(i, np.int32), np.frombuffer(n, np.int32)) for _, _, i, n in rows]
            weights, bias = train(examples, np.array([r[1] for r in rows]), config)
            yield pa.RecordBatch.from_arrays([pa.array([weights.astype(np.float32).tobytes()], pa.binary()), pa.array([bias])], ["weights", "bias"])

    taught = sample.mapInArrow(featurize, "_id bigint, _label int, ids binary, n binary").repartition(1).mapInArrow(learn, "weights binary, bias double").collect()
    if not taught:
        return QualityModel(np.zeros(1 << config.buckets_log2, np.float32), 0.0, config)
    return QualityModel(np.frombuffer(taught[0]["weights"], np.float32), taught[0]["bias"], config)


def free_name(df: DataFrame, name: str) -> str:
    while name.lower() in {c.lower() for c in df.columns}:
        name += "_"
    return name


def with_quality(docs: DataFrame, model: QualityModel, name: str = "quality_score") -> tuple[DataFrame, str]:
    """docs and a column of scores; returns the column's name too."""
    name = free_name(docs, name)
    return docs.withColumn(name, model.score(docs.sparkSession)), name


def accepted(docs: DataFrame, model: QualityModel, threshold: float = 0.5) -> DataFrame:
    """The documents whose score reaches the threshold, with the columns they came with."""
    scored, name = with_quality(docs, model)
    return scored.where(F.col(name) >= threshold).drop(name)
