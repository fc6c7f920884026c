"""Substring dedup by Relative Lempel-Ziv parsing over words.

Every document is parsed against a reference that holds all documents with a smaller doc_id. The reference is a dictionary
of phrases, dealt into blocks by the hash of an anchor. Anchors are runs of `ANCHOR` words picked by content: of each
window of `window` words the run with the least hash, the leftmost of equal ones. All windows that pick the same anchor lie
side by side and make up one phrase, so equal windows have equal anchors at the same place and meet in the same block.

Parsing is greedy. The longest factor first: a phrase whose whole word sequence is in the dictionary from a smaller
document is taken as it is, and with it every window inside. Where that fails, the document has left its reference inside
the phrase: a factor ends and another begins there. At these boundaries each window is looked up by itself in the
dictionary of windows, which holds the windows of all phrases that share the anchor. Factors of at least `window` words
become spans, and the words in spans are removed. The parse finds each such window, and only those.

Words are compared by 64-bit hashes, phrases and windows by 128 bits.

Defined results: a null or empty text has no words; a null doc_id is parsed against nothing and is no reference; rows with
the same doc_id don't take words from each other; an empty table gives an empty table; texts of any length are parsed
whole; further columns pass through inside `doc`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caudal.llm.tables import doc_and, settled
from caudal.llm.words import Rolling, mixed, row_slices, runs_of, signed, text_bytes, words_of

WINDOW = 50
ANCHOR = 16


def leftmost_least(x: np.ndarray, width: int) -> np.ndarray:
    """For each i the leftmost place of the least of x[i : i + width]."""
    at, size = np.arange(len(x), dtype=np.int64), 1

    def joined(step: int) -> np.ndarray:
        left, right = at[: len(at) - step], at[step:]
        return np.where(x[right] < x[left], right, left)

    while size * 2 <= width:
        at = joined(size)
        size *= 2
    return joined(width - size) if width > size else at


def phrases(first: np.ndarray, hashes: tuple[np.ndarray, np.ndarray], window: int, anchor: int) -> tuple[np.ndarray, Rolling, np.ndarray, np.ndarray, np.ndarray]:
    """The phrases of the rows whose words begin at `first`: hashes of all runs of anchor length, polynomial sums over the words, and of each phrase the place of the
    anchor, first and last window start."""
    rolling, grams = Rolling.over(hashes[1]), runs_of(hashes[0], anchor)
    n, none = len(hashes[0]), np.zeros(0, np.int64)
    if n < window:
        return grams, rolling, none, none, none
    picked = leftmost_least(grams, window - anchor + 1)
    lengths = np.diff(first)
    starts = np.flatnonzero(np.arange(n) + window <= np.repeat(first[1:], lengths))  # windows inside one row
    if len(starts) == 0:
        return grams, rolling, none, none, none
    places = picked[starts]
    new = np.flatnonzero(np.concatenate([[True], (places[1:] != places[:-1]) | (starts[1:] != starts[:-1] + 1)]))
    last = np.concatenate([new[1:], [len(starts)]]) - 1
    return grams, rolling, places[new], starts[new], starts[last]


def read_phrases(batches: Iterator[pa.RecordBatch], window: int, anchor: int) -> Iterator[pa.RecordBatch]:
    """(doc_id, text_key, text) to the phrases of each row."""
    for batch in batches:
        data, offsets = text_bytes(batch.column(2))
        ids, keys = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
        for a, b in row_slices(offsets):
            words = words_of(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            grams, rolling, place, start, last = phrases(words.first, (words.hashes(), words.hashes(key=1)), window, anchor)
            row = np.searchsorted(words.first, start, side="right") - 1
            whole = rolling.run(start, last + window) ^ mixed((place - start).astype(np.uint64))
            yield pa.RecordBatch.from_arrays([
                pa.array(signed(grams[place])), pa.array(signed(whole)), pa.array(ids[a + row].astype(np.int64)), pa.array(keys[a + row].astype(np.int64)),
                pa.array((start - words.first[row]).astype(np.int32)), pa.array((last - words.first[row]).astype(np.int32)),
            ], ["anchor", "phrase", "doc_id", "text_key", "start", "last"])


def read_windows(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """(doc_id, text_key, text, ranges of window starts) to the hashes of these windows."""
    for batch in batches:
        data, offsets = text_bytes(batch.column(2))
        ids, keys = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        ranges = batch.column(3)
        counts = np.diff(ranges.offsets.to_numpy())
        flat = ranges.flatten()
        low, high = flat.field(0).to_numpy(), flat.field(1).to_numpy()
        begins = np.concatenate([[0], np.cumsum(counts)])
        for a, b in row_slices(offsets):
            words = words_of(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            names = [runs_of(words.hashes(key=k), window) for k in (0, 1)]
            sizes = high[begins[a] : begins[b]] - low[begins[a] : begins[b]] + 1
            row = np.repeat(np.arange(b - a), counts[a:b])
            within = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            start = np.repeat(low[begins[a] : begins[b]], sizes) + within
            row = np.repeat(row, sizes)
            at = words.first[row] + start
            yield pa.RecordBatch.from_arrays([
                *[pa.array(signed(x[at])) for x in names],
                pa.array(np.array(ids[a:b], np.int64)[row]), pa.array(np.array(keys[a:b], np.int64)[row]), pa.array(start.astype(np.int32)),
            ], ["window_a", "window_b", "doc_id", "text_key", "start"])


def repeated_spans(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """(doc_id, text_key, spans): by document the ranges of words covered by factors of at least `window` words."""
    texts = docs.where(F.col("doc_id").isNotNull()).select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    found = settled(
        texts.mapInArrow(lambda b: read_phrases(b, window, anchor), "anchor long, phrase long, doc_id long, text_key long, start int, last int"), "phrases",
    )
    # The dictionary: each phrase with the smallest document that has it, and whether its anchor has other phrases too.
    dictionary = settled(found.groupBy("anchor", "phrase").agg(F.min("doc_id").alias("source"), F.max("doc_id").alias("latest")), "phrase-dictionary")
    blocks = (
        dictionary.groupBy("anchor")
        .agg(F.min("source").alias("least"), F.max("latest").alias("greatest"), (F.min("phrase") != F.max("phrase")).alias("forked"))
        .where(F.col("least") < F.col("greatest"))
    )
    shared = settled(dictionary.join(settled(blocks, "blocks").select("anchor", "forked"), "anchor").where("forked or source < latest").select("anchor", "phrase", "source", "forked"), "shared-phrases")
    # Many rows may hold one phrase; both sides are plain scans, so that adaptive execution can split such a partition.
    parsed = settled(found.join(shared, ["anchor", "phrase"]).where("doc_id > source or forked").select("doc_id", "text_key", "start", "last", (F.col("doc_id") > F.col("source")).alias("taken")), "parsed")
    whole = parsed.where("taken").select("doc_id", "text_key", "start", (F.col("last") + window).alias("end"))
    # Boundaries: first occurrences of phrases whose anchor leads to several phrases.
    ranges = parsed.where("not taken").groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("start", "last")).alias("ranges"))
    looked_up = settled(
        texts.join(ranges, ["doc_id", "text_key"]).select("doc_id", "text_key", "text", "ranges").mapInArrow(lambda b: read_windows(b, window), "window_a long, window_b long, doc_id long, text_key long, start int"),
        "boundary-windows",
    )
    sources = looked_up.groupBy("window_a", "window_b").agg(F.min("doc_id").alias("source"), F.max("doc_id").alias("latest")).where("source < latest").select("window_a", "window_b", "source")
    single = looked_up.join(settled(sources, "window-sources"), ["window_a", "window_b"]).where("doc_id > source").select("doc_id", "text_key", "start", (F.col("start") + window).alias("end"))
    # A group is one document's own spans.
    return whole.unionByName(single).groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("start", "end")).alias("spans"))


def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, text, spans) to (doc, n_words, n_removed, kept)."""
    for whole in batches:
        for at in range(0, whole.num_rows, 500):
            batch = whole.slice(at, 500)
            n_words, n_removed, kept = [], [], []
            for text, spans in zip(batch.column(1), batch.column(2), strict=True):
                words = (text.as_buffer().to_pybytes() if text.is_valid else b"").split()
                n = len(words)
                if spans.is_valid:
                    change = np.zeros(n + 1, np.int64)
                    edges = spans.values
                    np.add.at(change, edges.field(0).to_numpy(), 1)
                    np.add.at(change, edges.field(1).to_numpy(), -1)
                    stays = np.cumsum(change[:-1]) == 0
                    words = [w for w, s in zip(words, stays.tolist(), strict=True) if s]
                n_words.append(n)
                n_removed.append(n - len(words))
                kept.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], ["doc", "n_words", "n_removed", "kept"])


def without_repeats(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """`docs` (doc_id, text, ...): a struct `doc` of all its columns, n_words, n_removed, and the kept words joined by spaces."""
    spans = repeated_spans(docs, window, anchor)
    inside = docs.select(F.struct("*").alias("doc"), F.col("doc_id").alias("doc_id"), F.xxhash64("text").alias("text_key"))
    schema = doc_and(inside, "n_words long, n_removed long, kept string")
    return inside.join(spans, ["doc_id", "text_key"], "left").select("doc", "doc.text", "spans").mapInArrow(cut_out, schema)
