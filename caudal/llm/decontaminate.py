"""Benchmark decontamination: CGK embedding, bit-sampling LSH over item-sized windows, exact edit verification.

Texts are sequences of lower-cased words. A document is contaminated by an item of n words when some run of its words is
within `share` * n edits (a word inserted, deleted or replaced).

1. Windows. Within k edits of n words at least n - q + 1 - q k runs of q words stay, for the largest q that leaves one.
   Only windows around so many of the item's runs, inside n + k words, can match; all of them go on (nothing is lost).
2. Embedding. A CGK walk reads a sequence with one random bit for each step and symbol: it writes the symbol it stands on
   and moves on where the bit is 1. Few edits become few differing places of the embedded sequence.
3. LSH. Each repetition samples some places of the embedding; a window whose sampled symbols equal the item's is a
   candidate. The number of repetitions is measured for each item, on copies edited at random as far as allowed, so that
   each reaches the target recall; windows of items that don't in `MOST_REPETITIONS` all go on.
4. Verification. The least edit distance between the item and any run of words near the window, by dynamic programming.

The benchmark is held by every task in blocks of at most `BLOCK_WORDS` words, one pass over the documents for each block.

Defined results: null or empty texts are never contaminated, null or empty items match nothing, items with the same words
match each under its own item_id; a null doc_id is treated like any other document; an empty table gives an empty table;
further columns pass through inside `doc`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caudal.llm.tables import doc_and

from caudal.llm.words import mixed, row_slices, runs_of, text_bytes, words_of

SHARE = 0.2
SAMPLED = 3  # places of the embedding in one key
RECALL = 0.95
MOST_REPETITIONS = 64
LEAST_REPETITIONS = 4
TRIES = 40  # edited copies of an item that its repetitions are measured on
TRIED_WORDS = 1 << 20  # words of copies at a time
BLOCK_WORDS = 1 << 20
SLICE = 4 << 20  # bytes of text searched at a time
PAD = np.uint64(0)
MATCHES = "array<struct<item_id:bigint,start:int,end:int,distance:int>>"


def run_length(n: int, k: int) -> int:
    """The largest q of 3, 2, 1 for which k edits leave one of the n - q + 1 runs."""
    return next((q for q in (3, 2) if n - q + 1 - q * k >= 1), 1)


def embedded_keys(symbols: np.ndarray, start: np.ndarray, size: np.ndarray, repetition: int) -> np.ndarray:
    """The sampled key of each window symbols[start : start + size] in one repetition of the CGK walk. Places are sampled
    as fractions of the length that the walk takes for `size` symbols, two steps each."""
    rng = np.random.default_rng(1000 + repetition)
    longest = int(size.max()) if len(size) else 0
    shares = rng.random(SAMPLED)  # drawn before the seeds, whose number depends on the windows at hand
    seeds = rng.integers(1, 2**63, 2 * longest + 1, dtype=np.uint64)
    places = np.sort((shares[None, :] * 1.8 * size[:, None]).astype(np.int64), axis=1)
    at, end = start.copy(), start + size
    symbols = np.append(symbols, PAD)
    keys = np.zeros(len(start), np.uint64)
    for step in range(int(places.max()) + 1 if len(start) else 0):
        symbol = np.where(at < end, symbols[np.minimum(at, end)], PAD)
        for column in range(SAMPLED):
            hit = places[:, column] == step
            keys[hit] = mixed(keys[hit] * np.uint64(3) + symbol[hit])
        at = np.minimum(at + (mixed(symbol ^ seeds[step]) & np.uint64(1)).astype(np.int64), end)
    return keys


def nearest(item: list[int], region: list[int]) -> tuple[int, int, int]:
    """(distance, start, end): the run of `region` with the least edit distance to the whole item; the first that ends."""
    before = [(i, 0) for i in range(len(item) + 1)]  # cost and start, by words of the item that are used
    best = (before[-1][0], 0, 0)
    for place, word in enumerate(region, 1):
        now = [(0, place)]
        for i, own in enumerate(item, 1):
            change = (before[i - 1][0] + (own != word), before[i - 1][1])
            now.append(min(change, (before[i][0] + 1, before[i][1]), (now[i - 1][0] + 1, now[i - 1][1]), key=lambda c: c[0]))
        before = now
        if now[-1][0] < best[0]:
            best = (now[-1][0], now[-1][1], place)
    return best


@dataclass
class Items:
    """A block of benchmark items ready for the search."""

    ids: list[int]
    symbols: np.ndarray  # word hashes of all items, one after another
    first: np.ndarray
    edits: np.ndarray
    repetitions: np.ndarray  # of each item; 0 where all windows are verified
    keys: np.ndarray  # by repetition and item
    grams: dict[int, tuple[np.ndarray, np.ndarray]]  # by run length: sorted hashes and the item of each

    @property
    def sizes(self) -> np.ndarray:
        return np.diff(self.first)


def edited(words: np.ndarray, edits: int, rng: np.random.Generator) -> np.ndarray:
    out = words.tolist()
    for _ in range(edits):
        place, kind = int(rng.integers(0, len(out) + 1)), int(rng.integers(0, 3))
        new = int(rng.integers(1, 2**63))
        if kind == 0:
            out.insert(place, new)
        elif out and kind == 1:
            out.pop(min(place, len(out) - 1))
        elif out:
            out[min(place, len(out) - 1)] = new
    return np.array(out, dtype=np.uint64)


def repetitions_for(symbols: np.ndarray, first: np.ndarray, edits: np.ndarray, recall: float) -> np.ndarray:
    """For each item the repetitions after which the target share of its copies, edited as far as allowed, has met it in one
    of them; 0 where that takes more than `MOST_REPETITIONS`."""
    rng = np.random.default_rng(5)
    sizes = np.diff(first)
    out = np.full(len(sizes), LEAST_REPETITIONS)
    tried = np.flatnonzero((edits > 0) & (sizes > 0))
    tried = tried[np.argsort(sizes[tried], kind="stable")]  # a walk is as long as the longest of its group
    part = np.cumsum(sizes[tried] * TRIES) // TRIED_WORDS
    for group in np.split(tried, np.flatnonzero(np.diff(part)) + 1):
        if len(group):
            out[group] = measured(symbols, first, edits, group, recall, rng)
    return out


def measured(symbols: np.ndarray, first: np.ndarray, edits: np.ndarray, group: np.ndarray, recall: float, rng: np.random.Generator) -> np.ndarray:
    """The repetitions of the items of one group."""
    sizes = np.diff(first)
    copies = [edited(symbols[first[i] : first[i + 1]], int(edits[i]), rng) for i in group for _ in range(TRIES)]
    lengths = np.array([len(c) for c in copies])
    size = np.repeat(sizes[group], TRIES)
    flat = np.concatenate([*copies, np.zeros(int(size.max()) + 1, np.uint64)])
    begins = np.cumsum(lengths) - lengths
    met = np.zeros((len(group), TRIES), bool)
    found = np.zeros(len(group), np.int64)
    for repetition in range(MOST_REPETITIONS):
        open_ = np.flatnonzero(found == 0)
        if len(open_) == 0:
            break
        at = (open_[:, None] * TRIES + np.arange(TRIES)).ravel()
        own = embedded_keys(symbols, first[group[open_]], sizes[group[open_]], repetition)
        met[open_] |= embedded_keys(flat, begins[at], size[at], repetition).reshape(-1, TRIES) == own[:, None]
        found[open_[met[open_].mean(axis=1) >= recall]] = max(LEAST_REPETITIONS, repetition + 1)
    return found


def prepared(ids: list[int], texts: list[str | None], share: float, recall: float) -> Items:
    data, offsets = text_bytes(pa.array(texts, pa.string()))
    words = words_of(data, offsets)
    symbols, first = words.hashes(lower=True), words.first
    sizes = np.diff(first)
    edits = np.floor(share * sizes + 1e-9).astype(np.int64)
    repetitions = repetitions_for(symbols, first, edits, recall)
    keys = np.stack([embedded_keys(symbols, first[:-1], sizes, r) for r in range(int(repetitions.max(initial=0)))] or [np.zeros(len(sizes), np.uint64)])
    grams = {}
    lengths = np.array([run_length(int(n), int(k)) if n else 0 for n, k in zip(sizes, edits, strict=True)])
    for q in (1, 2, 3):
        own = np.flatnonzero(lengths == q)
        at = np.concatenate([np.arange(first[i], first[i + 1] - q + 1) for i in own] or [np.zeros(0, np.int64)])
        item = np.repeat(own, sizes[own] - q + 1) if len(own) else np.zeros(0, np.int64)
        both = np.unique(np.stack([runs_of(symbols, q)[at], item.astype(np.uint64)], axis=1), axis=0)
        grams[q] = (both[:, 0].copy(), both[:, 1].astype(np.int64))
    return Items(ids, symbols, first, edits, repetitions, keys, grams)


def hits(items: Items, hashes: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For each run length: (q, row, item, place) of the runs that items have, sorted."""
    counts = np.diff(first)
    for q, (known, owners) in items.grams.items():
        if len(known) == 0 or len(hashes) < q:
            continue
        low = (known & np.uint64((1 << 20) - 1)).astype(np.int64)
        seen = np.zeros(1 << 20, bool)
        seen[low] = True
        grams = runs_of(hashes, q)
        at = np.flatnonzero(seen[(grams & np.uint64((1 << 20) - 1)).astype(np.int64)])
        row = np.searchsorted(first, at, side="right") - 1
        inside = at + q <= first[row + 1]
        at, row = at[inside], row[inside]
        a, b = np.searchsorted(known, grams[at], side="left"), np.searchsorted(known, grams[at], side="right")
        times = b - a
        at, row, a = np.repeat(at, times), np.repeat(row, times), np.repeat(a, times)
        item = owners[a + np.arange(len(a)) - np.repeat(np.cumsum(times) - times, times)]
        order = np.lexsort((at, item, row))
        yield q, row[order], item[order], (at - first[row])[order]


def windows(items: Items, hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, item, start) of every window that the count of shared runs allows."""
    out = []
    for q, row, item, place in hits(items, hashes, first):
        n, k = items.sizes[item], items.edits[item]
        need = n - q + 1 - q * k
        to = np.arange(len(row)) + need - 1
        fine = to < len(row)
        here, to = np.flatnonzero(fine), to[fine]
        same = (row[to] == row[here]) & (item[to] == item[here]) & (place[to] + q - place[here] <= (n + k)[here])
        here, to = here[same], to[same]
        low = np.maximum(0, place[to] + q - (n + k)[here])
        times = place[here] - low + 1
        start = np.repeat(low, times) + np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)
        out.append(np.unique(np.stack([np.repeat(row[here], times), np.repeat(item[here], times), start], axis=1), axis=0))
    found = np.concatenate(out) if out else np.zeros((0, 3), np.int64)
    return found[:, 0], found[:, 1], found[:, 2]


def matches(items: Items, hashes: np.ndarray, first: np.ndarray) -> dict[int, list[dict]]:
    """By row: the items that it holds, each with its nearest run of words."""
    row, item, start = windows(items, hashes, first)
    if len(row) == 0:
        return {}
    size = np.minimum(items.sizes[item], first[row + 1] - first[row] - start)
    met = items.repetitions[item] == 0
    for repetition, keys in enumerate(items.keys):
        at = np.flatnonzero(~met & (items.repetitions[item] > repetition))
        if len(at) == 0:
            continue
        # Short windows at the end of a text still walk as far as the item would; what is missing reads as padding.
        met[at] = window_keys(hashes, first[row[at]] + start[at], size[at], items.sizes[item[at]], repetition) == keys[item[at]]
    regions: dict[tuple[int, int], tuple[int, int]] = {}
    out: dict[int, list[dict]] = {}
    for r, i, s in zip(row[met].tolist(), item[met].tolist(), start[met].tolist(), strict=True):
        n, k = int(items.sizes[i]), int(items.edits[i])
        low, high = max(0, s - k), min(int(first[r + 1] - first[r]), s + n + k)
        have = regions.get((r, i))
        if have and low <= have[1]:
            regions[r, i] = (min(low, have[0]), max(high, have[1]))
        else:
            if have:
                judged(items, hashes, first, r, i, have, out)
            regions[r, i] = (low, high)
    for (r, i), region in regions.items():
        judged(items, hashes, first, r, i, region, out)
    return out


def window_keys(hashes: np.ndarray, start: np.ndarray, have: np.ndarray, size: np.ndarray, repetition: int) -> np.ndarray:
    """embedded_keys of windows of which only `have` words are there."""
    flat = np.zeros(int(size.sum()), np.uint64)
    begins = np.cumsum(size) - size
    within = np.arange(int(have.sum())) - np.repeat(np.cumsum(have) - have, have)
    flat[np.repeat(begins, have) + within] = hashes[np.repeat(start, have) + within]
    return embedded_keys(flat, begins, size, repetition)


def judged(items: Items, hashes: np.ndarray, first: np.ndarray, r: int, i: int, region: tuple[int, int], out: dict[int, list[dict]]) -> None:
    words = hashes[first[r] + region[0] : first[r] + region[1]].tolist()
    distance, start, end = nearest(items.symbols[items.first[i] : items.first[i + 1]].tolist(), words)
    if distance > items.edits[i]:
        return
    found = {"item_id": items.ids[i], "start": region[0] + start, "end": region[0] + end, "distance": distance}
    have = next((m for m in out.get(r, []) if m["item_id"] == found["item_id"]), None)
    if have is None:
        out.setdefault(r, []).append(found)
    elif found["distance"] < have["distance"]:
        have.update(found)


def item_blocks(benchmark: DataFrame) -> Iterator[tuple[list[int], list[str]]]:
    """The benchmark in blocks that the driver and each task can hold."""
    ids, texts, held = [], [], 0
    for row in benchmark.where(F.col("text").isNotNull()).select(F.col("item_id").cast("long").alias("item_id"), "text").orderBy("item_id", "text").toLocalIterator():
        ids.append(row["item_id"])
        texts.append(row["text"])
        held += len(row["text"].split()) + 1
        if held >= BLOCK_WORDS:
            yield ids, texts
            ids, texts, held = [], [], 0
    yield ids, texts


def search(docs: DataFrame, benchmark: DataFrame, share: float = SHARE, recall: float = RECALL) -> DataFrame:
    """`docs` (text, ...): a struct `doc` of all its columns, and `matches` (item_id, start, end in words, distance)."""
    out = docs.select(F.struct("*").alias("doc"), docs["text"].alias("text"), F.array().cast(MATCHES).alias("matches"))
    schema = doc_and(out, f"text string, matches {MATCHES}")
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("start", pa.int32()), ("end", pa.int32()), ("distance", pa.int32())]))
    for ids, texts in item_blocks(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(prepared(ids, texts, share, recall))  # BLOCK_WORDS words at most

        def look(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                data, offsets = text_bytes(batch.column(1))
                found = batch.column(2).to_pylist()
                for a, b in row_slices(offsets, SLICE):
                    words = words_of(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                    for r, more in matches(shared.value, words.hashes(lower=True), words.first).items():
                        found[a + r] = found[a + r] + more
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, kind)], ["doc", "text", "matches"])

        out = out.mapInArrow(look, schema)
    return out.select("doc", "matches")


def contaminations(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document and item that it holds: doc_id, item_id, start, end, distance."""
    return search(docs, benchmark).select(F.col("doc.doc_id").alias("doc_id"), F.explode("matches").alias("m")).select("doc_id", "m.item_id", F.col("m.start").alias("start_word"), F.col("m.end").alias("end_word"), "m.distance")


def without_benchmark(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no item, with all their columns."""
    return search(docs, benchmark).where(F.size("matches") == 0).select("doc.*")
