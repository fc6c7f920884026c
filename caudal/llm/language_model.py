"""LM scoring: an interpolated modified Kneser-Ney bigram model, counted in Spark, kept as sorted hash arrays that the
workers map into memory.

Counting. Every task turns its texts into sorted arrays of word hashes (then of bigrams of word numbers) with counts, and
deals them out by ranges, the shards; a shard is merged by one task and written as plain arrays to the shared folder. The
number of shards follows the number of documents, so that a shard stays small. A word's number is its place in the sorted
hash arrays, a bigram is (number of the context << 32 | number of the word). Nothing but a few sums per shard reaches the
driver.

Model. p(w | h) = max(c(hw) - D(c(hw)), 0) / c(h) + g(h) p(w), with p(w) = max(k(w) - E(k(w)), 0) / K + g / (V + 1), where
c are counts, k(w) the number of different words before w, K their sum, D and E the three discounts of each order taken
from counts of counts, and g the mass that the discounts set free. A text starts with a context of its own and closes with
an end token. Unknown words share the part of one word; a context that training lacks leaves p(w).

Scoring. Workers map the arrays read-only; pages are shared between the workers of a machine and never copied to the heap.
The shared folder must be mounted as a file system on all machines (a `file:` path).

Defined results: a null text is empty and has the end token only; a null doc_id is not held out; repeated rows are counted
and scored one by one; without training rows every probability is 1; an empty table gives an empty table; further columns
pass through inside `doc`.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caudal.llm.tables import doc_and, settled, shared_path
from caudal.llm.words import row_slices, text_bytes, words_of

FOLDS = 5
SHARD_DOCUMENTS = 8_000
FLUSH = 2_500_000  # keys that a task holds before it deals them out
SLICE = 4 << 20
END = np.uint64(0x5EED0F7E47E4D001)
BLOCKS = "shard int, keys binary, counts binary"


def packed(keys: np.ndarray) -> bytes:
    """Sorted keys as differences, one plane for each byte, so that the shuffle compresses the high ones away."""
    steps = np.diff(keys, prepend=np.uint64(0))
    return np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T).tobytes()


def unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    new = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[new], np.add.reduceat(counts, new) if len(new) else counts


def blocks(keys: np.ndarray, counts: np.ndarray, limits: np.ndarray) -> pa.RecordBatch:
    """Sorted keys cut at the upper limits of the shards (all but the last)."""
    cuts = [0, *np.searchsorted(keys, limits, side="left").tolist(), len(keys)]
    used = [s for s in range(len(cuts) - 1) if cuts[s] < cuts[s + 1]]
    return pa.RecordBatch.from_arrays([
        pa.array(used, pa.int32()), pa.array([packed(keys[cuts[s] : cuts[s + 1]]) for s in used], pa.binary()), pa.array([counts[cuts[s] : cuts[s + 1]].astype(np.int64).tobytes() for s in used], pa.binary()),
    ], ["shard", "keys", "counts"])


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words with an end token after each row, and where each row begins."""
    words = words_of(data, offsets)
    hashes, n = words.hashes(lower=True), len(offsets) - 1
    first = words.first + np.arange(n + 1)
    out = np.empty(len(hashes) + n, np.uint64)
    ends = first[1:] - 1
    out[ends] = END
    inside = np.ones(len(out), bool)
    inside[ends] = False
    out[inside] = hashes
    return out, first


def dealt(batches: Iterator[pa.RecordBatch], keys_of: Callable[[np.ndarray, np.ndarray], np.ndarray], limits: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Counted keys of a partition of texts, by shard."""
    held, size = [], 0

    def flushed() -> pa.RecordBatch:
        keys, counts = summed(np.concatenate([k for k, _ in held]), np.concatenate([c for _, c in held]))
        return blocks(keys, counts, limits)

    for batch in batches:
        data, offsets = text_bytes(batch.column(0))
        for a, b in row_slices(offsets, SLICE):
            keys, counts = np.unique(keys_of(*tokens(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])), return_counts=True)
            held.append((keys, counts))
            size += len(keys)
            if size > FLUSH:
                yield flushed()
                held, size = [], 0
    if held:
        yield flushed()


def local(path: str) -> str:
    """The mounted folder behind a path of the shared file system."""
    parts = urlparse(path)
    if parts.scheme not in ("", "file"):
        raise ValueError(f"{path}: the language model is mapped into memory and needs a mounted shared folder (file:)")
    return parts.path


def kept(folder: str, name: str, values: np.ndarray) -> None:
    """Written beside and renamed, so that a task that is run again or twice leaves one whole file."""
    os.makedirs(folder, exist_ok=True)
    beside = f"{folder}/.{name}-{uuid.uuid4().hex}"
    values.tofile(beside)
    os.replace(beside, f"{folder}/{name}")


def mapped(folder: str, name: str, kind) -> np.ndarray:
    path = f"{folder}/{name}"
    return np.memmap(path, dtype=kind, mode="r") if os.path.exists(path) and os.path.getsize(path) else np.zeros(0, kind)


def merged(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    keys = np.concatenate([unpacked(x) for x in table.column("keys").to_pylist()])
    return summed(keys, np.concatenate([np.frombuffer(x, np.int64) for x in table.column("counts").to_pylist()]))


def counts_of_counts(counts: np.ndarray) -> list[int]:
    return [int((counts == i).sum()) for i in (1, 2, 3, 4)]


def discounts(ones: list[int]) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts from the numbers of keys seen once to four times; a half of each step where one is 0."""
    n1, n2, n3, n4 = ones
    if min(ones) == 0:
        return 0.5, 0.75, 1.0
    y = n1 / (n1 + 2 * n2)
    found = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
    return tuple(min(max(d, 0.01), i + 0.99) for i, d in enumerate(found))  # type: ignore[return-value]


def discounted(counts: np.ndarray, by: tuple[float, float, float]) -> np.ndarray:
    return np.maximum(counts - np.array([0.0, *by])[np.minimum(counts, 3).astype(np.int64)], 0)


@dataclass
class Model:
    folder: str
    shards: int
    begins: list[int]  # number of the first word of each shard, and the number of words
    limits: np.ndarray  # upper hash limits of the shards
    tokens: int
    pair: tuple[float, float, float]
    single: tuple[float, float, float]
    kinds: int  # different bigrams
    free: float  # mass of the single words' discounts

    @property
    def words(self) -> int:
        return self.begins[-1]

    @property
    def pair_limits(self) -> np.ndarray:
        """Upper limits of the bigram shards: those of contexts, the last of which is the start of a text."""
        return pair_limits(self.words, self.shards)


def context_limits(words: int, shards: int) -> list[int]:
    return [(words + 1) * s // shards for s in range(shards + 1)]


def pair_limits(words: int, shards: int) -> np.ndarray:
    return np.array(context_limits(words, shards)[1:-1], np.uint64) << np.uint64(32)


_MAPPED: dict[tuple[str, str, int], np.ndarray] = {}


def array(folder: str, name: str, shard: int, kind) -> np.ndarray:
    key = (folder, name, shard)
    if key not in _MAPPED:
        if _MAPPED and next(iter(_MAPPED))[0] != folder:
            _MAPPED.clear()
        _MAPPED[key] = mapped(folder, f"{name}-{shard}", kind)
    return _MAPPED[key]


def found_at(query: np.ndarray, limits: np.ndarray, shards: int, folder: str, name: str) -> Iterator[tuple[int, slice, np.ndarray, np.ndarray]]:
    """For sorted keys: shard, which of the keys fall in it, their places there, and whether they are there."""
    cuts = [0, *np.searchsorted(query, limits, side="left").tolist(), len(query)]
    for s in range(shards):
        part = slice(cuts[s], cuts[s + 1])
        known = array(folder, name, s, np.uint64)
        if part.start == part.stop:
            continue
        place = np.searchsorted(known, query[part])
        inside = np.minimum(place, max(len(known) - 1, 0))
        yield s, part, inside, (known[inside] == query[part]) if len(known) else np.zeros(len(place), bool)


def numbers(hashes: np.ndarray, limits: np.ndarray, begins: list[int], folder: str) -> np.ndarray:
    """Word numbers of sorted hashes; -1 for unknown ones."""
    out = np.full(len(hashes), -1, np.int64)
    for s, part, place, there in found_at(hashes, limits, len(begins) - 1, folder, "word"):
        out[part] = np.where(there, place + begins[s], -1)
    return out


def pairs_of(hashes: np.ndarray, first: np.ndarray, limits: np.ndarray, begins: list[int], folder: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of each token and of its context (-1 unknown; the start of a text comes after all words), and their key."""
    different, back = np.unique(hashes, return_inverse=True)
    word = numbers(different, limits, begins, folder)[back]
    context = np.empty_like(word)
    context[1:] = word[:-1]
    context[first[:-1]] = begins[-1]
    return word, context, (context.astype(np.uint64) << np.uint64(32)) | word.astype(np.uint64)


def train(docs: DataFrame) -> Model:
    """`docs` (text): the rows to learn from."""
    spark = docs.sparkSession
    folder = local(shared_path(spark, "language-model"))
    shards = 4
    while shards * SHARD_DOCUMENTS < docs.count() and shards < 1 << 16:
        shards *= 2
    texts = docs.select("text")
    limits = np.array([(s << 64) // shards for s in range(1, shards)], np.uint64)

    def keep_words(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        hashes, counts = merged(table)
        kept(folder, f"word-{shard}", hashes)
        kept(folder, f"count-{shard}", counts)
        return pa.table({"shard": pa.array([shard], pa.int32()), "words": [len(hashes)], "tokens": [int(counts.sum())]})

    counted = texts.mapInArrow(lambda b: dealt(b, lambda h, first: h, limits), BLOCKS).groupBy("shard").applyInArrow(keep_words, "shard int, words long, tokens long")
    rows = {r["shard"]: r for r in settled(counted, "lm-words").collect()}  # one row a shard
    begins = np.concatenate([[0], np.cumsum([rows[s]["words"] if s in rows else 0 for s in range(shards)])]).tolist()
    total = sum(r["tokens"] for r in rows.values())
    if begins[-1] >= 2**32 - 1:
        raise ValueError("more words than 32 bits can number")
    pair_ends, contexts = pair_limits(begins[-1], shards), context_limits(begins[-1], shards)
    word_ends = np.array(begins[1:-1], np.uint64)

    def keep_pairs(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        keys, counts = merged(table)
        kept(folder, f"pair-{shard}", keys)
        kept(folder, f"pair-count-{shard}", counts)
        low, size = contexts[shard], contexts[shard + 1] - contexts[shard]
        place = (keys >> np.uint64(32)).astype(np.int64) - low
        columns = [np.bincount(place, weights=counts, minlength=size)] + [np.bincount(place[m], minlength=size) for m in (counts == 1, counts == 2, counts >= 3)]
        kept(folder, f"context-{shard}", np.stack(columns, axis=1).astype(np.int64))
        before = np.unique(keys & np.uint64(0xFFFFFFFF), return_counts=True)
        out = blocks(*before, word_ends)
        n = out.num_rows
        ones = pa.array([counts_of_counts(counts) if i == 0 else None for i in range(n)], pa.list_(pa.int64()))
        return pa.Table.from_arrays([*out.columns, pa.array([len(keys) if i == 0 else 0 for i in range(n)], pa.int64()), ones], ["shard", "keys", "counts", "pairs", "ones"])

    spoken = texts.mapInArrow(lambda b: dealt(b, lambda h, first: pairs_of(h, first, limits, begins, folder)[2], pair_ends), BLOCKS)
    pairs = settled(spoken.groupBy("shard").applyInArrow(keep_pairs, f"{BLOCKS}, pairs long, ones array<long>"), "lm-pairs")
    stats = pairs.where("ones is not null").select("pairs", "ones").collect()  # one row a shard

    def keep_before(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        words, counts = merged(table)
        dense = np.zeros(begins[shard + 1] - begins[shard], np.int64)
        dense[words.astype(np.int64) - begins[shard]] = counts
        kept(folder, f"before-{shard}", dense)
        return pa.table({"shard": pa.array([shard], pa.int32()), "ones": pa.array([counts_of_counts(dense)], pa.list_(pa.int64())), "more": [int((dense >= 3).sum())]})

    before = settled(pairs.select("shard", "keys", "counts").groupBy("shard").applyInArrow(keep_before, "shard int, ones array<long>, more long"), "lm-before").collect()
    kinds = sum(r["pairs"] for r in stats)
    ones = [sum(r["ones"][i] for r in before) for i in range(4)]
    single = discounts(ones)
    free = (single[0] * ones[0] + single[1] * ones[1] + single[2] * sum(r["more"] for r in before)) / kinds if kinds else 1.0
    return Model(folder, shards, begins, limits, total, discounts([sum(r["ones"][i] for r in stats) for i in range(4)]), single, kinds, free)


def token_scores(model: Model, hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each token: training count, base log10 probability, log10 probability of the model."""
    word, context, keys = pairs_of(hashes, first, model.limits, model.begins, model.folder)
    order = np.argsort(word, kind="stable")
    count, before = np.zeros(len(word), np.int64), np.zeros(len(word), np.int64)
    cuts = np.searchsorted(word[order], model.begins)
    for s in range(model.shards):
        own = order[cuts[s] : cuts[s + 1]]
        place = word[own] - model.begins[s]
        count[own], before[own] = array(model.folder, "count", s, np.int64)[place], array(model.folder, "before", s, np.int64)[place]
    base = np.log10((count + 0.5) / (model.tokens + 0.5 * (model.words + 1)))
    p = model.free / (model.words + 1) + discounted(before, model.single) / max(model.kinds, 1)
    seen = np.flatnonzero((word >= 0) & (context >= 0))
    different, back = np.unique(keys[seen], return_inverse=True)
    times = np.zeros(len(different), np.int64)
    for s, part, place, there in found_at(different, model.pair_limits, model.shards, model.folder, "pair"):
        known = array(model.folder, "pair-count", s, np.int64)
        times[part] = np.where(there, known[place], 0) if len(known) else 0
    contexts = context_limits(model.words, model.shards)
    held = np.flatnonzero(context >= 0)
    by_context = held[np.argsort(context[held], kind="stable")]
    stats = np.zeros((len(word), 4))
    cuts = np.searchsorted(context[by_context], contexts)
    for s in range(model.shards):
        own = by_context[cuts[s] : cuts[s + 1]]
        rows = array(model.folder, "context", s, np.int64).reshape(-1, 4)
        if len(rows):
            stats[own] = rows[context[own] - contexts[s]]
    following = stats[:, 0]
    pair = np.zeros(len(word))
    pair[seen] = discounted(times[back], model.pair)
    known = following > 0
    free = stats[known, 1] * model.pair[0] + stats[known, 2] * model.pair[1] + stats[known, 3] * model.pair[2]
    p[known] = (pair[known] + free * p[known]) / following[known]
    return count, base, np.log10(p)


def scores(docs: DataFrame, model: Model) -> DataFrame:
    """`docs` (text, ...): a struct `doc` of all its columns, n_tokens, n_known, train_tokens, base_score, score."""

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            out: list[list[np.ndarray]] = [[], [], [], []]
            for a, b in row_slices(offsets, SLICE):
                hashes, first = tokens(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                count, base, own = token_scores(model, hashes, first)
                for into, x in zip(out, (np.diff(first), np.add.reduceat((count > 0).astype(np.int64), first[:-1]), np.add.reduceat(base, first[:-1]), np.add.reduceat(own, first[:-1])), strict=True):
                    into.append(x)
            n = batch.num_rows
            made = [pa.array(np.concatenate(x) if x else np.zeros(0)) for x in out]
            yield pa.RecordBatch.from_arrays([batch.column(0), made[0].cast(pa.int64()), made[1].cast(pa.int64()), pa.array(np.full(n, model.tokens, np.int64)), made[2], made[3]], ["doc", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    inside = docs.select(F.struct("*").alias("doc"), docs["text"].alias("text"))
    return inside.mapInArrow(scored, doc_and(inside, "n_tokens long, n_known long, train_tokens long, base_score double, score double"))


def lm_scores(docs: DataFrame) -> DataFrame:
    """Trained on the documents that are not held out; all are scored."""
    fold = F.coalesce(F.crc32(docs["doc_id"].cast("string").cast("binary")) % FOLDS == 1, F.lit(False))
    model = train(docs.where(~fold))
    out = scores(docs, model)
    return out.withColumn("held_out", F.coalesce(F.crc32(F.col("doc.doc_id").cast("string").cast("binary")) % FOLDS == 1, F.lit(False)))
