"""Spelling variants of words by a variable-length gram index.

Grams have `SHORTEST` to `LONGEST` code points. The dictionary holds the frequent ones: a gram that more than a threshold of
words hold is too common to tell words apart, so where it stands it is read one code point longer. The threshold follows
the number of grams, which bounds the dictionary to `DICTIONARY` grams whatever the input. A word decomposes into one gram
for each place, less those that lie inside an earlier one.

One edit changes only grams around it. How many at most is counted for every word over all its edits (left of an edit as far
as a frequent gram reaches up to it, right of it as far as the tail of a frequent gram reaches): the affected-gram bound. Two near words have all but so many grams of either in common, so the lists of the rarest bound + 1 grams of each word are
all that need merging. A word whose bound is as large as its grams are many keeps all its lists, and is entered a second time
by grams of the least length, where an edit affects at most `SHORTEST` of them; so no near pair is missed.

A list is kept by (gram, its place, length of the word, letters): code points fall into three classes, and what a word spells
in one of them is part of the list's name. A replaced code point touches two classes at most and leaves the third as it was;
an inserted one touches one, and moves what follows by one place. So lists stay short. Candidates are verified by edit
distance.

Defined results: a null text has no words, a null doc_id counts as empty; repeated rows count as often as they come; ties between forms
go to the smallest word in code-point order; an empty table gives an empty table; further columns are ignored. A word
without near words has no form and is its own root.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caudal.llm.tables import settled
from caudal.llm.words import mixed, signed

LETTERS = "A-Za-zÀ-ÿ"
LEAST_LENGTH, LEAST_COUNT = 7, 2
EVERY = 31  # one occurrence in so many loses a code point
TIMES = 10  # a form is so many times as frequent as its variant
SHORTEST, LONGEST = 2, 5
DICTIONARY = 1 << 11
LEAST_THRESHOLD = 16
CLASSES = 3
CHUNK = 1 << 20  # code points handled at once
MIX = np.uint64(0x9E3779B97F4A7C15)
_CODE = 8  # bits of a code point: all are below 256
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def counted_words(docs: DataFrame) -> DataFrame:
    """(word, n): runs of letters, one occurrence in `EVERY` with a code point less, counted over all texts."""
    # Deleting makes no run longer, so runs that are too short from the start are never read.
    runs = F.regexp_extract_all("text", F.lit(f"([{LETTERS}]{{{LEAST_LENGTH},}})"), F.lit(1))
    said = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("run")).select("id", F.translate("run", _UPPER, _UPPER.lower()).alias("run"))
    hashed = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
    length = F.char_length("run")
    at = (F.col("hash") % length).cast("int")
    damaged = F.concat(F.col("run").substr(F.lit(1), at), F.col("run").substr(at + 2, length))
    words = said.withColumn("hash", hashed).select(F.when(F.col("hash") % EVERY == 0, damaged).otherwise(F.col("run")).alias("word"))
    return words.where(F.char_length("word") >= LEAST_LENGTH).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= LEAST_COUNT)


def by_length(words: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, code points): words of one length as a matrix, a bounded number of code points at a time."""
    texts = words.to_pylist()
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    order = np.argsort(lengths, kind="stable")
    at = 0
    while at < len(order):
        length = int(lengths[order[at]])
        to = min(int(np.searchsorted(lengths[order], length, side="right")), at + max(1, CHUNK // length))
        rows = order[at:to]
        yield rows, np.frombuffer("".join(texts[i] for i in rows).encode("latin-1"), np.uint8).reshape(len(rows), length)
        at = to


def codes(letters: np.ndarray, size: int) -> np.ndarray:
    """The grams of one size at every place, as numbers that also tell the size."""
    places = max(letters.shape[1] - size + 1, 0)
    out = np.full((letters.shape[0], places), 1, dtype=np.int64)
    for k in range(size):
        out = (out << _CODE) | letters[:, k : k + places]
    return out


def count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word) to (gram, n): grams of one partition's words that could be read longer."""
    for batch in batches:
        for _, letters in by_length(batch.column(0)):
            found, n = np.unique(np.concatenate([codes(letters, q).ravel() for q in range(SHORTEST, LONGEST)]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(n.astype(np.int64))], ["gram", "n"])


def frequent_grams(words: DataFrame, threshold: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(grams, counts), sorted by gram: those that more than a threshold of places hold. At most `DICTIONARY`, for the
    threshold is at least the number of places over `DICTIONARY`."""
    if threshold is None:
        places = F.greatest(F.char_length("word") - F.lit(SHORTEST - 1), F.lit(0)) * (LONGEST - SHORTEST)
        threshold = max(LEAST_THRESHOLD, -(-(words.agg(F.sum(places).alias("n")).first()["n"] or 0) // DICTIONARY))
    counts = words.select("word").mapInArrow(count_grams, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).where(F.col("n") > threshold)
    rows = sorted((r["gram"], r["n"]) for r in counts.collect())
    return np.array([r[0] for r in rows], dtype=np.int64), np.array([r[1] for r in rows], dtype=np.int64)


def tails_of(grams: np.ndarray) -> dict[int, np.ndarray]:
    """By size: what frequent grams end with, after one code point at least. Sorted."""
    sizes = np.zeros(len(grams), dtype=np.int64)
    for q in range(SHORTEST, LONGEST):
        sizes[grams >> (_CODE * q) == 1] = q
    out = {}
    for k in range(1, LONGEST - 1):
        out[k] = np.unique((grams[sizes > k] & ((1 << (_CODE * k)) - 1)) | (1 << (_CODE * k)))
    return out


def among(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    if len(table) == 0:
        return np.zeros(values.shape, dtype=bool)
    at = np.minimum(np.searchsorted(table, values), len(table) - 1)
    return table[at] == values


def shifted(x: np.ndarray, by: int, width: int, fill) -> np.ndarray:
    """Column j of the result is column j + by of `x`, or `fill` where there is none."""
    out = np.full((x.shape[0], width), fill, dtype=x.dtype)
    low, high = max(0, -by), min(width, x.shape[1] - by)
    if high > low:
        out[:, low:high] = x[:, low + by : high + by]
    return out


def decompose(letters: np.ndarray, grams: np.ndarray, tails: dict[int, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(size of the gram at each place, whether it is kept, the affected-gram bound of each word)."""
    n, length = letters.shape
    places = length - SHORTEST + 1
    common = {q: among(codes(letters, q), grams) for q in range(SHORTEST, LONGEST)}
    size = np.full((n, places), SHORTEST, dtype=np.int64)
    for q in range(SHORTEST, LONGEST):  # still common at q, and the word goes on
        here = shifted(common[q], 0, places, False) & (size == q) & (np.arange(places) + q < length)
        size[here] += 1
    end = np.arange(places) + size - 1  # the last code point of each gram
    before = np.maximum.accumulate(end, axis=1)
    kept = np.ones((n, places), dtype=bool)
    kept[:, 1:] = end[:, 1:] > before[:, :-1]
    # reach[:, i]: the first place from which a frequent gram, or fewer code points than a gram has, ends right before i.
    edits = length + 1
    reach = np.maximum(np.arange(edits) - (SHORTEST - 1), 0)[None, :].repeat(n, axis=0)
    for q in range(SHORTEST, LONGEST):
        ends_here = shifted(common[q], -q, edits, False)  # the gram that begins at i - q
        reach = np.where(ends_here, np.arange(edits) - q, reach)
    # tail[:, j]: how many code points from j on some frequent gram can end with.
    tail = np.zeros((n, edits + 1), dtype=np.int64)
    for k in range(1, LONGEST - 1):
        tail[:, : edits + 1][shifted(among(codes(letters, k), tails[k]), 0, edits + 1, False)] = k
    at = np.arange(edits)
    changed = np.zeros((n, edits), dtype=np.int64)  # the code point i is replaced or deleted
    opened = np.zeros((n, edits), dtype=np.int64)  # one is inserted before i
    for d in range(-LONGEST, LONGEST + 1):  # the gram that begins at i + d
        held, to = shifted(kept, d, edits, False), shifted(end, d, edits, -1)
        start = at + d
        if d <= 0:
            changed += held & ((to >= at) | (start >= reach))
        else:
            changed += held & (to <= at + 1 + tail[:, 1 : edits + 1])
        if d < 0:
            opened += held & ((to >= at) | (start >= reach))
        else:
            opened += held & (to <= at + tail[:, :edits])
    return size, kept, np.maximum(changed[:, :length].max(axis=1), opened.max(axis=1))


def spelled_by_class(letters: np.ndarray) -> np.ndarray:
    """A hash of what each word spells in each class of code points: (words, CLASSES)."""
    out = np.zeros((len(letters), CLASSES), dtype=np.uint64)
    for column in letters.T:
        for k in range(CLASSES):
            here = column % CLASSES == k
            out[here, k] = mixed(out[here, k] * MIX + column[here] + np.uint64(1))
    return out


def entries(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    """(word, n) to (key, own, word, n): the lists that a word stands in (own), and those of words one code point longer that
    it looks into."""
    grams, counts, tails = shared.value
    for batch in batches:
        for rows, letters in by_length(batch.column(0)):
            n, length = letters.shape
            size, kept, bound = decompose(letters, grams, tails)
            places = size.shape[1]
            spelled = np.zeros((n, places), dtype=np.int64)
            for q in range(SHORTEST, LONGEST + 1):
                spelled = np.where(size == q, shifted(codes(letters, q), 0, places, 0), spelled)
            words, chosen, place = rarest(np.where(kept, spelled, -1), bound + 1, grams, counts)
            unbounded = np.flatnonzero(kept.sum(axis=1) <= bound)
            plain, least, where = rarest(codes(letters[unbounded], SHORTEST), np.full(len(unbounded), SHORTEST + 1), grams, counts)
            words, chosen, place = np.concatenate([words, unbounded[plain]]), np.concatenate([2 * chosen, 2 * least + 1]), np.concatenate([place, where])
            named = mixed(chosen.astype(np.uint64))
            letters_in = spelled_by_class(letters)[words]
            keys, own = [], []
            for longer, later, classes in ((0, 0, CLASSES), (1, 0, CLASSES - 1), (1, 1, CLASSES - 1)):
                at = mixed(named * MIX + (place + later).astype(np.uint64))
                for k in range(classes):  # a word that is one code point longer differs in one class only
                    keys.append(mixed(mixed(at * MIX + np.uint64((length + longer) * CLASSES + k)) ^ letters_in[:, k]))
                    own.append(np.full(len(words), longer == 0))
            taken = batch.take(pa.array(np.tile(rows[words], len(keys))))
            yield pa.RecordBatch.from_arrays([pa.array(signed(np.concatenate(keys))), pa.array(np.concatenate(own)), *taken.columns], ["key", "own", "word", "n"])


def rarest(spelled: np.ndarray, many: np.ndarray, grams: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, gram, place) of each row's rarest `many` grams; -1 is no gram. The order is the same for all words: by rarity,
    gram, place."""
    rarity = np.zeros(spelled.shape, dtype=np.int64)
    if len(grams):
        at = np.minimum(np.searchsorted(grams, spelled), len(grams) - 1)
        rarity = np.where(grams[at] == spelled, counts[at], 0)
    rarity[spelled < 0] = np.iinfo(np.int64).max
    places = np.broadcast_to(np.arange(spelled.shape[1]), spelled.shape)
    order = np.lexsort((places, spelled, rarity), axis=1)[:, : int(many.max(initial=0))]
    gram = np.take_along_axis(spelled, order, axis=1)
    row, at = np.nonzero((np.arange(gram.shape[1]) < many[:, None]) & (gram >= 0))
    return row, gram[row, at], order[row, at]


def near_pairs(words: DataFrame, threshold: int | None = None) -> DataFrame:
    """`words` (word, n), settled, to (word, n, other, other_n): each pair of near words once."""
    grams, counts = frequent_grams(words, threshold)
    shared = words.sparkSession.sparkContext.broadcast((grams, counts, tails_of(grams)))  # at most DICTIONARY grams
    listed = settled(words.select("word", "n").mapInArrow(lambda b: entries(b, shared), "key long, own boolean, word string, n long"), "gram-lists")
    # All sides that read the members are named alike, so that these are shuffled once.
    members = listed.where("own").select("key", "word", "n")
    others, firsts = members.withColumnsRenamed({"word": "other", "n": "other_n"}), members.withColumnsRenamed({"word": "first", "n": "first_n"})
    same_length = firsts.join(others, "key").where("first < other").select(F.col("first").alias("word"), F.col("first_n").alias("n"), "other", "other_n")
    one_longer = listed.where("not own").select("key", "word", "n").join(others, "key").select("word", "n", "other", "other_n")
    candidates = same_length.unionByName(one_longer)
    return candidates.where("levenshtein(word, other, 1) = 1").select("word", "n", "other", "other_n").distinct()


def roots(forms: DataFrame) -> DataFrame:
    """`forms` (word, form) to (word, root): the end of each chain. A form is `TIMES` as frequent as its variant, so chains
    end, and every round halves what is left of them."""
    state = settled(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = state.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = settled(state.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        if step.where("moved").isEmpty():
            return step.select("word", "root")
        state = step.select("word", "root")


def spelling_variants(docs: DataFrame, threshold: int | None = None) -> DataFrame:
    """(word, form, root, n, n_near, form_n): every word of `docs` (doc_id, text) that is long and frequent enough."""
    words = settled(counted_words(docs), "counted-words")
    pairs = settled(near_pairs(words, threshold), "near-words")
    both = pairs.unionByName(pairs.select(F.col("other").alias("word"), F.col("other_n").alias("n"), F.col("word").alias("other"), F.col("n").alias("other_n")))
    best = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), "other")).alias("best"))
    form_n = -F.col("best.less")
    judged = words.join(best, "word", "left").withColumn("is_form", F.coalesce(form_n >= TIMES * F.col("n"), F.lit(False)))
    named = settled(
        judged.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(F.col("is_form"), F.col("best.other")).alias("form"), F.when(F.col("is_form"), form_n).alias("form_n")), "word-forms",
    )
    ends = roots(named.where("form is not null"))
    return named.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
