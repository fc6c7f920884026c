"""BPE encoding and decoding with a segment tree over the ranks of adjacent pairs.

A word starts as its characters. The leaves of a segment tree hold the merge rank of each pair of neighbours; the root
holds the least rank and, among equal ones, the leftmost place. A merge changes the leaf of the merged pair and those of
its two neighbours, each with one update along the path to the root, until the root says that no pair can be merged. Short
words are merged many at a time, one tree per row of an array; long ones (runs of thousands of letters) one by one.

The tokenizer file (its path is a parameter) gives normalisation, splitting, vocabulary and merges: Unicode NFC, white
space to one space, lower case character by character, pieces by a pattern, bytes as printable characters, an end-of-word
suffix. Special tokens are recognised in the text as it stands. Decoding joins the token texts by spaces, since the file
names no decoder.

Defined results: null is empty and gives no tokens; whole texts are encoded, however long; an empty table gives an empty
table; further columns pass through.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caudal.llm.tables import doc_and

NONE = np.int64(2**62)
SHORT = 64  # symbols; longer words get a tree of their own
CACHED_WORDS = 200_000  # a task forgets what it has merged when it holds more

# The bytes that stand for themselves as characters.
PRINTABLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """A public vocabulary file that is installed on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_characters() -> list[str]:
    """The character for each byte: printable bytes are themselves, the others follow from 256 on."""
    others = iter(range(256, 512))
    stands = set(PRINTABLE)
    return [chr(b) if b in stands else chr(next(others)) for b in range(256)]


def merged_long(symbols: list[int], rank_of: Callable[[int, int], tuple[int, int] | None]) -> list[int]:
    """All merges of one word: rank_of gives rank and new symbol of a pair. The tree is a list, its root at 1."""
    n = len(symbols)
    size = 1
    while size < max(n - 1, 1):
        size *= 2
    none = (1 << 62, 0)
    tree = [none] * (2 * size)
    made: list[int] = [0] * n
    following, previous = list(range(1, n + 1)), list(range(-1, n - 1))

    def leaf(i: int) -> tuple[int, int]:
        j = following[i]
        found = rank_of(symbols[i], symbols[j]) if j < n else None
        if found is None:
            return none
        made[i] = found[1]
        return (found[0], i)

    for i in range(n - 1):
        tree[size + i] = leaf(i)
    for node in range(size - 1, 0, -1):
        tree[node] = min(tree[2 * node], tree[2 * node + 1])

    def update(i: int, value: tuple[int, int]) -> None:
        node = size + i
        tree[node] = value
        while node > 1:
            node >>= 1
            tree[node] = min(tree[2 * node], tree[2 * node + 1])

    while tree[1] != none:
        i = tree[1][1]
        j = following[i]
        symbols[i] = made[i]
        following[i] = k = following[j]
        if k < n:
            previous[k] = i
        if j < n - 1:
            update(j, none)
        update(i, leaf(i) if i < n - 1 else none)
        if previous[i] >= 0:
            update(previous[i], leaf(previous[i]))
    out, at = [], 0
    while at < n:
        out.append(symbols[at])
        at = following[at]
    return out


class Merges:
    """The merge table: pair of symbols to rank and merged symbol, for one pair or for arrays of them."""

    def __init__(self, pairs: list[tuple[int, int, int]]):
        self.one = {}
        for rank, (left, right, new) in enumerate(pairs):
            self.one.setdefault((left, right), (rank, new))
        items = sorted((left << 32 | right, rank, new) for (left, right), (rank, new) in self.one.items())
        self.keys = np.array([x[0] for x in items] or [-1], dtype=np.int64)
        self.ranks = np.array([x[1] for x in items] or [0], dtype=np.int64)
        self.new = np.array([x[2] for x in items] or [0], dtype=np.int64)

    def ranked(self, left: np.ndarray, right: np.ndarray, place: np.ndarray) -> np.ndarray:
        """rank << 8 | place of each pair, so that the least is the leftmost of the lowest rank; NONE where none merges."""
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (left >= 0) & (right >= 0), self.ranks[at] << 8 | place, NONE)

    def merged_rows(self, symbols: np.ndarray) -> np.ndarray:
        """All merges of many words: one row of symbols each, -1 after the end. A row of the tree has its root at 1."""
        rows, width = symbols.shape
        size = 1
        while size < width:
            size *= 2
        places = np.arange(width)
        right = np.concatenate([symbols[:, 1:], np.full((rows, 1), -1, np.int64)], axis=1)
        tree = np.full((rows, 2 * size), NONE)
        tree[:, size : size + width] = self.ranked(symbols, right, places[None, :])
        for node in range(size - 1, 0, -1):
            tree[:, node] = np.minimum(tree[:, 2 * node], tree[:, 2 * node + 1])
        following = np.broadcast_to(np.minimum(places + 1, width), symbols.shape).copy()
        previous = np.broadcast_to(places - 1, symbols.shape).copy()
        symbols = np.concatenate([symbols, np.full((rows, 1), -1, np.int64)], axis=1)  # a place past the end
        active = np.flatnonzero(tree[:, 1] < NONE)

        def update(r: np.ndarray, place: np.ndarray, value: np.ndarray) -> None:
            node = size + place
            tree[r, node] = value
            while size > 1:
                node = node >> 1
                tree[r, node] = np.minimum(tree[r, 2 * node], tree[r, 2 * node + 1])
                if node[0] == 1:
                    break

        while len(active):
            root = tree[active, 1]
            i = root & 255
            symbols[active, i] = self.new[self.by_rank[root >> 8]]
            j = following[active, i]
            k = following[active, j]
            following[active, i] = k
            symbols[active, j] = -1
            inside = k < width
            previous[active[inside], k[inside]] = i[inside]
            update(active, j, np.full(len(active), NONE))
            update(active, i, self.ranked(symbols[active, i], symbols[active, k], i))
            before = previous[active, i]
            has = before >= 0
            if has.any():
                r, p = active[has], before[has]
                update(r, p, self.ranked(symbols[r, p], symbols[r, i[has]], p))
            active = active[tree[active, 1] < NONE]
        return symbols[:, :width]

    @property
    def by_rank(self) -> np.ndarray:
        """Position in the sorted table by rank."""
        if not hasattr(self, "_by_rank"):
            self._by_rank = np.zeros(int(self.ranks.max()) + 1, dtype=np.int64)
            self._by_rank[self.ranks] = np.arange(len(self.ranks))
        return self._by_rank


class WordBpe:
    """A tokenizer file of the kind described above."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        kinds = [n["type"] for n in spec["normalizer"]["normalizers"]]
        if model["type"] != "BPE" or kinds != ["NFC", "Replace", "Lowercase"] or spec["decoder"] is not None:
            raise ValueError(f"{path} describes another kind of tokenizer")
        self.suffix = model["end_of_word_suffix"] or ""
        self.vocabulary: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token = {i: t for t, i in [*self.vocabulary.items(), *self.special.items()]}
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        ids = self.vocabulary
        self.merges = Merges([(ids[a], ids[b], ids[a + b]) for a, b in pairs])
        split = spec["pre_tokenizer"]["pretokenizers"][0]
        self.piece = regex.compile(split["pattern"]["Regex"])
        self.specials = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.characters = byte_characters()
        self.words: dict[str, tuple[str, str, int]] = {}

    def normalized(self, text: str) -> str:
        text = text if text.isascii() else unicodedata.normalize("NFC", text)
        # White space needn't be folded: no piece holds any.
        return text.replace("Σ", "σ").lower()  # the library lowers each character by itself: no final sigma

    def symbols(self, word: str) -> list[int]:
        """The characters of the word as ids, the last with the suffix; those that the vocabulary lacks give no token."""
        chars = [self.characters[b] for b in word.encode()]
        chars[-1] += self.suffix
        return [self.vocabulary[c] for c in chars if c in self.vocabulary]

    def word_ids(self, words: list[str]) -> list[list[int]]:
        """Ids of each word. Words of up to 8, 16, 32, 64 symbols are merged together."""
        starts = [self.symbols(w) for w in words]
        out: list[list[int]] = [[]] * len(words)
        classes: dict[int, list[int]] = {}
        for at, s in enumerate(starts):
            if len(s) > SHORT:
                out[at] = merged_long(s, lambda a, b: self.merges.one.get((a, b)))
            else:
                classes.setdefault(max(8, 1 << max(len(s) - 1, 0).bit_length()), []).append(at)
        for width, members in classes.items():
            rows = np.full((len(members), width), -1, dtype=np.int64)
            for row, at in enumerate(members):
                rows[row, : len(starts[at])] = starts[at]
            done = self.merges.merged_rows(rows)
            kept = done >= 0
            flat, ends = done[kept].tolist(), np.cumsum(kept.sum(axis=1)).tolist()
            begin = 0
            for at, end in zip(members, ends, strict=True):
                out[at] = flat[begin:end]
                begin = end
        return out

    def pieces(self, text: str) -> list[str]:
        """Words in order; special tokens stand among them under their own name."""
        if self.specials is None or "<|" not in text:
            return self.piece.findall(self.normalized(text))
        out: list[str] = []
        at = 0
        for found in self.specials.finditer(text):
            out += self.piece.findall(self.normalized(text[at : found.start()]))
            out.append(self.SPECIAL + found.group())
            at = found.end()
        return out + self.piece.findall(self.normalized(text[at:]))

    SPECIAL = " "  # no word begins with a space

    def learn(self, words: set[str]) -> None:
        """Merge the words that are not known yet, in one go."""
        if len(self.words) > CACHED_WORDS:
            self.words.clear()
        new = [w for w in words if w not in self.words]
        plain = [w for w in new if not w.startswith(self.SPECIAL)]
        for w, ids in zip(plain, self.word_ids(plain), strict=True):
            self.words[w] = (" ".join(map(str, ids)), self.decoded(ids), len(ids))
        for w in new:
            if w.startswith(self.SPECIAL):
                i = self.special[w[len(self.SPECIAL) :]]
                self.words[w] = (str(i), self.decoded([i]), 1)

    def encoded(self, text: str) -> list[int]:
        ids: list[int] = []
        pieces = self.pieces(text)
        self.learn(set(pieces))
        for w in pieces:
            ids += map(int, self.words[w][0].split())
        return ids

    def decoded(self, ids: list[int]) -> str:
        return " ".join([self.token[i] for i in ids if i in self.token])


_LOADED: dict[str, WordBpe] = {}


def loaded(path: str) -> WordBpe:
    if path not in _LOADED:
        _LOADED[path] = WordBpe(path)
    return _LOADED[path]


def encoded_batches(batches: Iterator[pa.RecordBatch], path: str, with_ids: bool) -> Iterator[pa.RecordBatch]:
    """Last column: text. The others pass through, followed by n_tokens, ids_sha256, decoded_sha256 and, if asked for, ids."""
    bpe = loaded(path)
    sha = hashlib.sha256
    for whole in batches:
        for at in range(0, whole.num_rows, 256):
            batch = whole.slice(at, 256)
            words = [bpe.pieces(t) if t else [] for t in batch.column(batch.num_columns - 1).to_pylist()]
            bpe.learn(set().union(*words))
            known = bpe.words
            out: list[list] = [[], [], [], []]
            for ws in words:
                found = [x for x in map(known.__getitem__, ws) if x[2]]  # a word of unknown characters has no token
                ids = " ".join([x[0] for x in found])
                out[0].append(sum([x[2] for x in found]))
                out[1].append(sha(ids.encode()).hexdigest())
                out[2].append(sha(" ".join([x[1] for x in found]).encode()).hexdigest())
                if with_ids:
                    out[3].append([int(i) for i in ids.split()])
            made = [pa.array(out[0], pa.int64()), pa.array(out[1], pa.string()), pa.array(out[2], pa.string())] + ([pa.array(out[3], pa.list_(pa.int32()))] if with_ids else [])
            names = ["n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * with_ids
            yield pa.RecordBatch.from_arrays(batch.columns[:-1] + made, batch.schema.names[:-1] + names)
    bpe.words.clear()  # the worker lives on and runs other operators


def encode(docs: DataFrame, path: str, with_ids: bool = False) -> DataFrame:
    """`docs` with column `text`: a struct `doc` of all its columns, n_tokens, ids_sha256 (of the decimal ids joined by a
    space), decoded_sha256 and, if asked for, the ids."""
    inside = docs.select(F.struct("*").alias("doc"), docs["text"].alias("text"))
    schema = doc_and(inside, "n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids)
    return inside.mapInArrow(lambda batches: encoded_batches(batches, path, with_ids), schema)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """Adds `decoded` to rows with a column `ids`."""

    @F.pandas_udf("string")
    def texts(ids):
        bpe = loaded(path)
        return ids.map(lambda x: bpe.decoded([] if x is None else list(x)))

    return encoded.withColumn("decoded", texts("ids"))
