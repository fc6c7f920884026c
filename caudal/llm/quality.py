"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

score = sigmoid(w0 + sum of w_i x_i + sum over pairs of <v_i, v_j> x_i x_j), where the pairs cost linear time:
half the sum over factors of (sum of v_if x_i) squared minus the sum of (v_if x_i) squared.

Features of a text: which lower-cased words it has (hashed to `WORDS` places, one length for all texts), shares of kinds of
characters and words, each in one of a few bins, and the bin of its stated length (the column n_chars, if there is one).
The model is fitted on at most `SAMPLE` labelled rows, those with the least hash of doc_id among all that may be learnt
from; every text is scored.

Defined results: a null text counts as empty, an empty text has its own bins and a score like any other; rows without a
label or with a null doc_id are not learnt from; repeated rows are learnt from and scored one by one; without any label
every score is 0.5; an empty table gives an empty table; further columns pass through inside `doc`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caudal.llm.tables import doc_and, held_out, settled
from caudal.llm.words import row_slices, text_bytes, words_of

SAMPLE = 12_000
WORDS = 1 << 14
FACTORS = 6
EPOCHS, STEPS, BATCH, RATE, SHRINK = 12, 500, 256, 0.02, 1e-5  # small samples are gone through more often, for STEPS at least
FOLDS = 3

SHARES = np.array([0.002, 0.01, 0.03, 0.06, 0.1, 0.15, 0.2, 0.3, 0.45, 0.6, 0.8, 0.95])
SIZES = np.array([1, 4, 16, 64, 256, 1024, 4096, 16384, 65536])
LENGTHS = np.array([2.5, 3.5, 4.5, 5.5, 6.5, 7.5, 9, 12])
KINDS = 6  # of characters: capital, small or beyond ASCII, digit, white space, mark inside sentences, other mark
_KIND = np.full(256, 5, dtype=np.uint8)
_KIND[65:91], _KIND[97:123], _KIND[128:], _KIND[48:58] = 0, 1, 1, 2
_KIND[[0x20, *range(9, 14)]] = 3
_KIND[[ord(c) for c in ".,;:'\"-?()"]] = 4
STATISTICS = [SHARES] * (KINDS + 5) + [SIZES, LENGTHS, SIZES]
BINS = max(map(len, STATISTICS)) + 1
PLACES = WORDS + len(STATISTICS) * BINS


def statistics(data: np.ndarray, offsets: np.ndarray, words, distinct: np.ndarray, stated: np.ndarray) -> list[np.ndarray]:
    """The numbers behind STATISTICS, in its order, for each row."""
    n = len(offsets) - 1
    lengths, counts = np.diff(offsets), np.diff(words.first)
    kinds = _KIND[data]

    def by_row(marks: np.ndarray, begins: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(marks, dtype=np.int64)])
        return (total[begins[1:]] - total[begins[:-1]]).astype(float)

    out = [by_row(kinds == k, offsets) / np.maximum(lengths, 1) for k in range(KINDS)]
    size = words.ends - words.starts
    head, tail = kinds[words.starts] if len(size) else kinds[:0], kinds[words.ends - 1] if len(size) else kinds[:0]
    per_word = np.maximum(counts, 1)
    out += [by_row(size == 1, words.first) / per_word, by_row((head == 0) & (tail == 0) & (size > 1), words.first) / per_word, by_row(tail >= 4, words.first) / per_word, by_row(tail == 5, words.first) / per_word]
    out.append(np.bincount(distinct, minlength=n) / per_word)
    out += [counts.astype(float), by_row(size, words.first) / per_word, stated]
    return out


def features(column: pa.Array, stated: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """For consecutive rows: first row, end, first feature of each row, places, values. Every row has all statistics."""
    data, offsets = text_bytes(column)
    for a, b in row_slices(offsets):
        piece, edges = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        words = words_of(piece, edges)
        place = (words.hashes(lower=True) % np.uint64(WORDS)).astype(np.int64)
        keys = np.unique(words.row * WORDS + place)
        row, place = keys // WORDS, keys % WORDS
        value = 1 / np.sqrt(np.maximum(np.bincount(row, minlength=b - a), 1))[row]
        numbers = statistics(piece, edges, words, row, stated[a:b])
        bins = np.stack([WORDS + k * BINS + np.digitize(x, STATISTICS[k], right=False) for k, x in enumerate(numbers)], axis=1)
        rows = np.concatenate([row, np.repeat(np.arange(b - a), bins.shape[1])])
        order = np.argsort(rows, kind="stable")
        places = np.concatenate([place, bins.ravel()])[order]
        values = np.concatenate([value, np.full(bins.size, 0.5)])[order]
        yield a, b, np.searchsorted(rows[order], np.arange(b - a)), places, values


def machine(weights: np.ndarray, first: np.ndarray, places: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The raw score of each row and the factor sums. `weights`: a row (w, v_1 .. v_f) per place; the last has w0."""
    scaled = weights[places] * values[:, None]
    sums = np.add.reduceat(scaled, first, axis=0)
    squares = np.add.reduceat(np.square(scaled[:, 1:]), first, axis=0)
    return weights[-1, 0] + sums[:, 0] + 0.5 * (np.square(sums[:, 1:]) - squares).sum(axis=1), sums[:, 1:]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def fitted(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, seed: int = 7) -> np.ndarray:
    """Adam over shuffled batches of the logistic loss."""
    rng = np.random.default_rng(seed)
    weights = rng.normal(0, 0.02, (PLACES + 1, FACTORS + 1))
    weights[:, 0] = 0
    weights[-1] = 0
    if len(rows) == 0 or labels.min() == labels.max():
        if len(rows):
            weights[:] = 0
            weights[-1, 0] = 3.0 if labels[0] else -3.0
        return weights if len(rows) else np.zeros_like(weights)
    mean, spread, step = np.zeros_like(weights), np.zeros_like(weights), 0
    epochs = max(EPOCHS, -(-STEPS // -(-len(rows) // BATCH)))
    for epoch in range(epochs):
        order = rng.permutation(len(rows))
        rate = RATE * (1 - epoch / epochs)
        for at in range(0, len(order), BATCH):
            some = order[at : at + BATCH]
            counts = np.array([len(rows[i][0]) for i in some])
            first = np.cumsum(counts) - counts
            places, values = np.concatenate([rows[i][0] for i in some]), np.concatenate([rows[i][1] for i in some])
            raw, sums = machine(weights, first, places, values)
            error = np.repeat((sigmoid(raw) - labels[some]) / len(some), counts)
            slope = np.empty((len(places), FACTORS + 1))
            slope[:, 0] = error * values
            slope[:, 1:] = (error * values)[:, None] * (np.repeat(sums, counts, axis=0) - weights[places, 1:] * values[:, None])
            gradient = np.stack([np.bincount(places, weights=slope[:, k], minlength=PLACES + 1) for k in range(FACTORS + 1)], axis=1) + SHRINK * weights
            gradient[-1, 0] = ((sigmoid(raw) - labels[some]) / len(some)).sum()
            step += 1
            mean = 0.9 * mean + 0.1 * gradient
            spread = 0.999 * spread + 0.001 * np.square(gradient)
            weights -= rate * (mean / (1 - 0.9**step)) / (np.sqrt(spread / (1 - 0.999**step)) + 1e-8)
    return weights


def stated_lengths(column: pa.Array) -> np.ndarray:
    return np.nan_to_num(column.cast(pa.float64()).to_numpy(zero_copy_only=False), nan=0.0)


def sample_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(rank, label, text, stated) to (rank, label, places, values)."""
    for batch in batches:
        for a, b, first, places, values in features(batch.column(2), stated_lengths(batch.column(3))):
            edges = pa.array(np.append(first, len(places)).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.ListArray.from_arrays(edges, pa.array(places)), pa.ListArray.from_arrays(edges, pa.array(values))], ["rank", "label", "places", "values"])


def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All sample rows, at most `SAMPLE`, to one row with the weights."""
    rows, labels, ranks = [], [], []
    for batch in batches:
        ranks += batch.column(0).to_pylist()
        labels += batch.column(1).to_pylist()
        rows += [(p.values.to_numpy(), v.values.to_numpy()) for p, v in zip(batch.column(2), batch.column(3), strict=True)]
    order = np.argsort(np.array(ranks, dtype=np.int64), kind="stable")
    weights = fitted([rows[i] for i in order], np.array(labels, dtype=float)[order])
    yield pa.RecordBatch.from_arrays([pa.array([weights.astype(np.float32).tobytes()], pa.binary())], ["weights"])


def with_stated(docs: DataFrame) -> F.Column:
    return (docs["n_chars"] if "n_chars" in docs.columns else F.lit(None)).cast("double")


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> np.ndarray:
    """Weights learnt from `labels` (doc_id, quality), outside the held-out fold. The sample and the weights are bounded."""
    usable = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out("doc_id", FOLDS)).select("doc_id", F.col("quality").cast("int").alias("label"))
    chosen = usable.withColumn("rank", F.xxhash64("doc_id")).orderBy("rank", "doc_id", "label").limit(sample)
    texts = docs.select("doc_id", F.col("text"), with_stated(docs).alias("stated"))
    joined = texts.join(F.broadcast(chosen), "doc_id").select("rank", "label", "text", "stated")
    drawn = settled(joined.mapInArrow(sample_features, "rank long, label int, places array<long>, values array<double>"), "quality-sample")
    row = drawn.coalesce(1).mapInArrow(learn, "weights binary").first()
    return np.frombuffer(row["weights"], np.float32).reshape(PLACES + 1, FACTORS + 1)


def score(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """`docs` (doc_id, text, perhaps n_chars): a struct `doc` of all its columns, and score."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)  # PLACES rows, whatever the input

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [np.zeros(0)]
            for _, _, first, places, values in features(batch.column(1), stated_lengths(batch.column(2))):
                out.append(sigmoid(machine(shared.value.astype(np.float64), first, places, values)[0]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(out))], ["doc", "score"])

    inside = docs.select(F.struct("*").alias("doc"), docs["text"].alias("text"), with_stated(docs).alias("stated"))
    return inside.mapInArrow(scored, doc_and(inside, "score double"))


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc (all columns), held_out, score, predicted."""
    scored = score(docs, fit(docs, labels))
    return scored.select("doc", F.coalesce(F.crc32(F.col("doc.doc_id").cast("string").cast("binary")) % FOLDS == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
