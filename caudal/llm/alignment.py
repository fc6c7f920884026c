"""Alignment of two tokenizers of the same text, by merge-path partitioning of their token ends.

The ends of the A tokens and those of the B tokens of a document are two sorted lists over the same bytes. Merged (an A end
before an equal B end) they tell everything: where both end, a group closes; and between two neighbouring ends lies the
overlap of exactly one A and one B token, a link. Diagonals of the merge, `PIECE` ends apart, cut it into pieces of equal work:
a binary search on each diagonal tells how many of the ends before it are A's. A piece holds its own tokens and the next one
of either side, which may reach into it, so pieces are worked on independently, the pieces of one long document in many tasks.
Groups that cross pieces are stitched in order afterwards.

How often an id pair is linked is counted over the whole table, summed up in the tasks first. Links are weighed by these
counts: the most frequent pairs, `HOT` at most, are shared with the tasks; the rest of the links join the table of counts.

Defined results: a text that is null or empty, or that one of the tokenizers does not give back byte by byte, has no tokens:
zeros and an empty text of groups; a null doc_id, repeated rows and texts of any length are handled row by row; an empty table
gives an empty table; further columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caudal.llm.tables import numbered, settled
from caudal.llm.words import text_bytes

PIECE = 1 << 15  # merged ends
HOT = 1 << 18  # pairs that are shared with the tasks
SLICE = 1 << 18  # bytes of text, or tokens, handled at once
DISTINCT = 1 << 18  # pairs that a task adds up before it gives them on
FAR = 1 << 40  # beyond every byte of a text
# What separates pieces of text before merging, as byte-level BPE with `use_regex` does.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_BEYOND_LATIN = re.compile("[^\x00-ɏ]")

PIECES = "row long, doc_id long, piece int, n_pieces int, n_a int, n_b int, base_a long, base_b long, a binary, b binary"  # ids as bytes
SCORED = "row long, doc_id long, piece int, n_pieces int, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, pairs array<long>, times array<long>, groups string, parts array<string>"


# ---- tokens --------------------------------------------------------------------------------------------------------------


def byte_symbols() -> dict[str, int]:
    """The printable character that byte-level vocabularies write for each byte: itself, or one from 256 on."""
    out, spare = {}, 256
    for byte in range(256):
        if 33 <= byte <= 126 or 161 <= byte <= 172 or byte >= 174:
            out[chr(byte)] = byte
        else:
            out[chr(spare)] = byte
            spare += 1
    return out


@dataclass
class Tokenizers:
    a_path: str
    b_path: str
    a_bytes: list[bytes] = field(init=False)
    b_bytes: list[bytes] = field(init=False)

    def __post_init__(self):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the cores belong to other tasks
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(self.a_path)
        self.library.encode_special_tokens = True
        self.library.no_truncation()
        self.library.no_padding()
        symbol = byte_symbols()
        entries = sorted(self.library.get_vocab(with_added_tokens=True).items(), key=lambda e: e[1])
        self.a_bytes = [b""] * (entries[-1][1] + 1)
        for text, i in entries:
            self.a_bytes[i] = bytes(symbol[c] for c in text) if all(c in symbol for c in text) else text.encode()
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=self.b_path)
        whole = range(self.pieces.get_piece_size())
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.pieces.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, self.pieces.id_to_piece(i)) for i in whole)]
        self.a_sizes, self.b_sizes = (np.array([len(t) for t in table], dtype=np.int64) for table in (self.a_bytes, self.b_bytes))
        # The same vocabulary as ranks merges alike where ids follow the order of the merges; it is several times as fast. Its
        # tables of letters may differ from the library's for rare scripts, so it only gets Latin texts.
        added = set(self.library.get_added_tokens_decoder())
        ranks = {t: i for i, t in enumerate(self.a_bytes) if i not in added}
        self.ranked = tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}) if self.in_merge_order() else None

    def in_merge_order(self) -> bool:
        import json

        model = json.loads(self.library.to_str())
        kind, vocab, merges = model["model"], model["model"]["vocab"], model["model"]["merges"]
        byte_level = (model.get("pre_tokenizer") or {}).get("type") == "ByteLevel" and model["pre_tokenizer"].get("use_regex", True) and not model["pre_tokenizer"]["add_prefix_space"]
        plain = model.get("normalizer") is None and not kind.get("dropout") and not kind.get("ignore_merges")
        joined = [vocab["".join(m) if isinstance(m, list) else m.replace(" ", "")] for m in merges]
        return bool(byte_level and plain and joined == list(range(256, 256 + len(joined))))

    def encode_a(self, texts: list[str]) -> list[list[int]]:
        out: list = [None] * len(texts)
        slow = []
        for i, text in enumerate(texts):
            if self.ranked is not None and (text.isascii() or not _BEYOND_LATIN.search(text)):
                out[i] = self.ranked.encode_ordinary(text)
            else:
                slow.append(i)
        for i, e in zip(slow, self.library.encode_batch_fast([texts[i] for i in slow], add_special_tokens=False), strict=True):
            out[i] = e.ids
        return out

    def encode_b(self, texts: list[str]) -> list[list[int]]:
        return self.pieces.encode(texts, num_threads=1)

    def tokens(self, texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The ids of both sides of each text; none where a side does not spell the text."""
        none = np.zeros(0, np.int32)
        there = [i for i, t in enumerate(texts) if t]
        spaced = [" " + texts[i] for i in there]
        found = {}
        for i, text, a, b in zip(there, spaced, self.encode_a(spaced), self.encode_b([texts[i] for i in there]), strict=True):
            data = text.encode()
            if b"".join([self.a_bytes[x] for x in a]) == data and b"".join([self.b_bytes[x] for x in b]) == data:
                found[i] = np.array(a, dtype=np.int32), np.array(b, dtype=np.int32)
        for i in range(len(texts)):
            yield found.get(i, (none, none))


@functools.lru_cache(maxsize=2)
def tokenizers(a_path: str, b_path: str) -> Tokenizers:
    return Tokenizers(a_path, b_path)


# ---- pieces --------------------------------------------------------------------------------------------------------------


def crossings(a_ends: np.ndarray, b_ends: np.ndarray, diagonals: np.ndarray) -> np.ndarray:
    """How many of the first d merged ends are A's, for each diagonal d: a binary search along each of them."""
    low, high = np.maximum(diagonals - len(b_ends), 0), np.minimum(diagonals, len(a_ends))
    while (low < high).any():
        mid = (low + high) // 2
        open_ = low < high
        at = np.where(open_, mid, 0)
        first = np.zeros(len(diagonals), dtype=bool)
        first[open_] = a_ends[at[open_]] <= b_ends[diagonals[open_] - 1 - at[open_]]
        low, high = np.where(first, mid + 1, low), np.where(open_ & ~first, mid, high)
    return low


def cut(batches: Iterator[pa.RecordBatch], a_path: str, b_path: str, size: int) -> Iterator[pa.RecordBatch]:
    """(row, doc_id, text) to `PIECES`."""
    both = tokenizers(a_path, b_path)
    for batch in batches:
        texts = batch.column(2)
        lengths = np.concatenate([[0], np.cumsum([t.as_buffer().size if t.is_valid else 0 for t in texts.cast(pa.large_string())])])
        at = 0
        while at < len(texts):
            to = max(at + 1, int(np.searchsorted(lengths, lengths[at] + SLICE, side="right")) - 1)
            rows = []
            for k, (a, b) in enumerate(both.tokens(texts.slice(at, to - at).to_pylist()), at):
                a_ends, b_ends = np.cumsum(both.a_sizes[a]), np.cumsum(both.b_sizes[b])
                total = len(a) + len(b)
                diagonals = np.append(np.arange(0, total, size) if total else [0], total).astype(np.int64)
                from_a = crossings(a_ends, b_ends, diagonals)
                from_b = diagonals - from_a
                for p in range(len(diagonals) - 1):
                    a0, a1, b0, b1 = int(from_a[p]), int(from_a[p + 1]), int(from_b[p]), int(from_b[p + 1])
                    rows.append((k, p, len(diagonals) - 1, a1 - a0, b1 - b0, int(a_ends[a0 - 1]) if a0 else 0, int(b_ends[b0 - 1]) if b0 else 0, a[a0 : a1 + 1], b[b0 : b1 + 1]))
            of, piece, n_pieces, n_a, n_b, base_a, base_b, a, b = zip(*rows, strict=True)
            taken = batch.select([0, 1]).take(pa.array(of))
            lists = [pa.array([x.astype(w).tobytes() for x in ids], pa.binary()) for ids, w in ((a, wide(both.a_sizes)), (b, wide(both.b_sizes)))]
            numbers = [pa.array(x, pa.int32()) for x in (piece, n_pieces, n_a, n_b)] + [pa.array(x, pa.int64()) for x in (base_a, base_b)]
            yield pa.RecordBatch.from_arrays([*taken.columns, *numbers, *lists], ["row", "doc_id", "piece", "n_pieces", "n_a", "n_b", "base_a", "base_b", "a", "b"])
            at = to


@dataclass
class Merged:
    """Pieces of a batch, one after the other, in coordinates that tell them apart. For own tokens of both sides: id, end, piece;
    links as (A id, B id, piece); cuts where both sides end, with their piece."""

    batch: pa.RecordBatch
    a: np.ndarray
    b: np.ndarray
    a_end: np.ndarray
    b_end: np.ndarray
    a_of: np.ndarray
    b_of: np.ndarray
    link_a: np.ndarray
    link_b: np.ndarray
    link_of: np.ndarray
    cuts: np.ndarray
    cut_of: np.ndarray


def wide(sizes: np.ndarray) -> type:
    """What holds an id of a vocabulary."""
    return np.uint16 if len(sizes) <= 1 << 16 else np.int32


def merged(batches: Iterator[pa.RecordBatch], a_sizes: np.ndarray, b_sizes: np.ndarray) -> Iterator[Merged]:
    for whole in batches:
        widths = {"a": wide(a_sizes), "b": wide(b_sizes)}
        counts = sum(np.diff(text_bytes(whole.column(c))[1]) // np.dtype(w).itemsize for c, w in widths.items())
        total = np.concatenate([[0], np.cumsum(counts)])
        at = 0
        while at < whole.num_rows:
            to = max(at + 1, int(np.searchsorted(total, total[at] + SLICE, side="right")) - 1)
            batch = whole.slice(at, to - at)
            at = to
            sides = []
            for name, sizes in (("a", a_sizes), ("b", b_sizes)):
                column = batch.column(name)
                data, offsets = text_bytes(column)
                ids, n = np.frombuffer(data.tobytes(), widths[name]), np.diff(offsets) // np.dtype(widths[name]).itemsize
                of = np.repeat(np.arange(len(n)), n)
                own_n = batch.column(f"n_{name}").to_numpy()
                first = np.cumsum(n) - n
                own = np.arange(len(ids)) - first[of] < own_n[of]
                run = np.cumsum(sizes[ids])
                before = np.where(first > 0, run[np.maximum(first - 1, 0)], 0) if len(ids) else np.zeros(len(n), np.int64)
                end = run - before[of] + batch.column(f"base_{name}").to_numpy()[of] + of * (2 * FAR)
                end[~own] = of[~own] * (2 * FAR) + FAR  # reaches beyond the piece
                sides.append((ids, end, of, own))
            (a, a_end, a_of, a_own), (b, b_end, b_of, b_own) = sides
            b_at = np.searchsorted(b_end, a_end[a_own], side="left")
            own_end = b_end[b_own]
            a_at = np.minimum(np.searchsorted(a_end, own_end, side="left"), max(len(a_end) - 1, 0))
            base = batch.column("base_a").to_numpy() + np.arange(batch.num_rows) * (2 * FAR)
            has_before = base % (2 * FAR) > 0
            tie = (a_end[a_at] == own_end) if len(a_end) else np.zeros(0, dtype=bool)
            own_of = b_of[b_own]
            tie |= has_before[own_of] & (own_end == base[own_of])
            link_a = np.concatenate([a[a_own], a[a_at[~tie]] if len(a) else a])
            link_b = np.concatenate([b[b_at], b[b_own][~tie]])
            link_of = np.concatenate([a_of[a_own], own_of[~tie]])
            yield Merged(batch, a[a_own], b[b_own], a_end[a_own], own_end, a_of[a_own], own_of, link_a, link_b, link_of, own_end[tie], own_of[tie])


def packed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a.astype(np.int64) << 32) | b


def count_pairs(batches: Iterator[pa.RecordBatch], a_sizes: np.ndarray, b_sizes: np.ndarray) -> Iterator[pa.RecordBatch]:
    """`PIECES` to (pair, n): links of each id pair, added up as far as memory is meant to go."""
    pairs, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(counts)], ["pair", "n"])

    for m in merged(batches, a_sizes, b_sizes):
        new, n = np.unique(packed(m.link_a, m.link_b), return_counts=True)
        every, where = np.unique(np.concatenate([pairs, new]), return_inverse=True)
        counts = np.bincount(where, weights=np.concatenate([counts, n]), minlength=len(every)).astype(np.int64)
        pairs = every
        if len(pairs) > DISTINCT:
            yield out()
            pairs, counts = pairs[:0], counts[:0]
    yield out()


# ---- groups --------------------------------------------------------------------------------------------------------------


@functools.lru_cache(maxsize=2)
def spelled_ids(n_a: int, n_b: int) -> list[str]:
    """Every id with what may follow it: A ids with ',' then with '|', B ids with ',' then with ';'."""
    return [f"{i}{mark}" for n, marks in ((n_a, ",|"), (n_b, ",;")) for mark in marks for i in range(n)]


def group_texts(m: Merged, n_a: int, n_b: int) -> Iterator[tuple[str, list[str]]]:
    """For each piece: the text of its groups where it is a whole document, else its parts: how many cuts, A and B ids before
    the first cut, whole groups, A and B ids after the last cut."""
    table = spelled_ids(n_a, n_b)
    pieces = m.batch.num_rows
    # Fragments of a piece lie between its cuts; one more follows the last cut.
    shift = np.arange(pieces)
    a_part, b_part = np.searchsorted(m.cuts, m.a_end, side="left") + m.a_of, np.searchsorted(m.cuts, m.b_end, side="left") + m.b_of
    n_cuts = np.bincount(m.cut_of, minlength=pieces)
    parts = len(m.cuts) + pieces
    in_a, in_b = np.bincount(a_part, minlength=parts), np.bincount(b_part, minlength=parts)
    before_a, before_b = np.cumsum(in_a) - in_a, np.cumsum(in_b) - in_b
    a_last, b_last = np.arange(len(m.a)) == (before_a + in_a - 1)[a_part], np.arange(len(m.b)) == (before_b + in_b - 1)[b_part]
    order = np.empty(len(m.a) + len(m.b), dtype=np.int64)
    order[np.arange(len(m.a)) + before_b[a_part]] = m.a.astype(np.int64) + n_a * a_last
    order[np.arange(len(m.b)) + (before_a + in_a)[b_part]] = m.b.astype(np.int64) + 2 * n_a + n_b * b_last
    begins = np.append(before_a + before_b, len(order))
    first = np.cumsum(n_cuts) - n_cuts + shift
    whole = m.batch.column("n_pieces").to_numpy() == 1
    spell = table.__getitem__
    for k in range(pieces):
        low, cuts = int(first[k]), int(n_cuts[k])
        if whole[k]:
            yield "".join(map(spell, order[begins[low] : begins[low + cuts]].tolist()))[:-1], []
            continue

        def side(part: int) -> list[str]:
            at = int(begins[part])
            mid, to = at + int(in_a[part]), int(begins[part + 1])
            return ["".join(map(spell, order[x:y].tolist()))[:-1] for x, y in ((at, mid), (mid, to))]

        middle = "".join(map(spell, order[begins[low + 1] : begins[low + cuts]].tolist())) if cuts > 1 else ""
        yield "", [str(cuts), *side(low), middle, *(side(low + cuts) if cuts else ["", ""])]


def sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest() if text else ""


def score(batches: Iterator[pa.RecordBatch], a_sizes: np.ndarray, b_sizes: np.ndarray, shared, digest: bool) -> Iterator[pa.RecordBatch]:
    """`PIECES` to `SCORED`: sums over the links whose pair is shared, and how often each other pair is linked."""
    hot, hot_counts, hot_best = shared.value
    for m in merged(batches, a_sizes, b_sizes):
        n = m.batch.num_rows
        pairs, where = np.unique(packed(m.link_a, m.link_b), return_inverse=True)
        at = np.minimum(np.searchsorted(hot, pairs), max(len(hot) - 1, 0))
        known = hot[at] == pairs if len(hot) else np.zeros(len(pairs), dtype=bool)
        count = np.where(known, hot_counts[at], 0) if len(hot) else np.zeros(len(pairs), np.int64)
        best = known & hot_best[at] if len(hot) else known
        sums = np.zeros(n, np.int64)
        np.add.at(sums, m.link_of, count[where])
        n_best = np.bincount(m.link_of, weights=best[where], minlength=n).astype(np.int64)
        rest = ~known[where]
        cold, times = np.unique(m.link_of[rest] * max(len(pairs), 1) + where[rest], return_counts=True)
        edges = pa.array(np.searchsorted(cold // max(len(pairs), 1), np.arange(n + 1)).astype(np.int32))
        texts = list(group_texts(m, len(a_sizes), len(b_sizes)))
        numbers = [m.batch.column("n_a").cast(pa.int64()), m.batch.column("n_b").cast(pa.int64())] + [pa.array(x.astype(np.int64)) for x in (np.bincount(m.cut_of, minlength=n), np.bincount(m.link_of, minlength=n), n_best, sums)]
        lists = [pa.ListArray.from_arrays(edges, pa.array(x)) for x in (pairs[cold % max(len(pairs), 1)], times.astype(np.int64))]
        groups = [pa.array([sha256(t) if digest else t for t, _ in texts], pa.string()), pa.array([p for _, p in texts], pa.list_(pa.string()))]
        yield pa.RecordBatch.from_arrays([m.batch.column(c) for c in ("row", "doc_id", "piece", "n_pieces")] + numbers + lists + groups, [x.split()[0] for x in SCORED.split(", ")])


def stitch(batches: Iterator[pa.RecordBatch], digest: bool) -> Iterator[pa.RecordBatch]:
    """(row, piece, parts), sorted, to (row, groups): open fragments of neighbouring pieces belong to one group."""
    row, done, open_a, open_b = None, [], [], []

    def out() -> pa.RecordBatch:
        text = "".join(done)[:-1]
        return pa.RecordBatch.from_arrays([pa.array([row], pa.int64()), pa.array([sha256(text) if digest else text], pa.string())], ["row", "groups"])

    for batch in batches:
        for i, parts in zip(batch.column(0).to_pylist(), batch.column(2), strict=True):
            if i != row:
                if row is not None:
                    yield out()
                row, done, open_a, open_b = i, [], [], []
            cuts, head_a, head_b, middle, tail_a, tail_b = parts.as_py()
            open_a += [head_a] if head_a else []
            open_b += [head_b] if head_b else []
            if cuts != "0":
                done += [",".join(open_a), "|", ",".join(open_b), ";", middle]
                open_a, open_b = [tail_a] if tail_a else [], [tail_b] if tail_b else []
    if row is not None:
        yield out()


# ---- the operator --------------------------------------------------------------------------------------------------------


def shared_counts(counts: DataFrame, hot: int) -> tuple[DataFrame, F.Column, tuple]:
    """(counts with `best`, which of them are shared, these as arrays). Levels of counts bound how many are collected."""
    # As many rows as B has ids.
    highest = counts.groupBy((F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF))).alias("b")).agg(F.max("n").alias("highest"))
    level = F.floor(F.log2("n") * 8)
    judged = settled(counts.withColumn("b", F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF))).join(F.broadcast(highest), "b").select("pair", "n", (F.col("n") == F.col("highest")).alias("best"), level.alias("level")), "pair-counts")
    least, taken = 1 << 30, 0
    for r in judged.groupBy("level").count().orderBy(F.col("level").desc()).collect():  # a few hundred levels at most
        taken += r["count"]
        if taken > hot:
            break
        least = r["level"]
    is_hot = F.col("level") >= least
    chosen = judged.where(is_hot).select("pair", "n", "best").toArrow().sort_by("pair")
    arrays = tuple(chosen.column(c).to_numpy() for c in ("pair", "n", "best"))
    return judged, is_hot, arrays


def aligned(docs: DataFrame, a_path: str, b_path: str, digest: bool = False, piece: int = PIECE, hot: int = HOT) -> DataFrame:
    """One row per document of `docs` (doc_id, text): doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups. `groups` is
    the text `a1,a2|b1;a3|b2,b3`, or with `digest` its SHA-256 (empty without tokens). `a_path`: a byte-level BPE of the
    tokenizers library; `b_path`: a sentencepiece model. Both files must be where the tasks run."""
    both = tokenizers(a_path, b_path)
    a_sizes, b_sizes = both.a_sizes, both.b_sizes
    rows = numbered(docs.select("doc_id", "text")).select("row", "doc_id", "text")
    pieces = settled(rows.mapInArrow(lambda x: cut(x, a_path, b_path, piece), PIECES), "token-pieces")
    counts = pieces.mapInArrow(lambda x: count_pairs(x, a_sizes, b_sizes), "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    judged, is_hot, arrays = shared_counts(counts, hot)
    shared = docs.sparkSession.sparkContext.broadcast(arrays)  # `hot` pairs at most
    dealt = pieces.where("n_pieces = 1").unionByName(pieces.where("n_pieces > 1").repartition("row", "piece"))  # a long document's pieces go to many tasks
    scored = settled(dealt.mapInArrow(lambda x: score(x, a_sizes, b_sizes, shared, digest), SCORED), "scored-pieces")
    links = scored.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("link")).select("row", F.col("link.pairs").alias("pair"), F.col("link.times").alias("times"))
    weighed = links.join(judged.where(~is_hot), "pair").groupBy("row").agg(F.sum(F.col("times") * F.col("best").cast("long")).alias("more_best"), F.sum(F.col("times") * F.col("n")).alias("more_sum"))
    sums = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]
    single = scored.where("n_pieces = 1").select("row", "doc_id", *sums, "groups")
    texts = scored.where("n_pieces > 1").select("row", "piece", "parts").repartition("row").sortWithinPartitions("row", "piece").mapInArrow(lambda x: stitch(x, digest), "row long, groups string")
    long = scored.where("n_pieces > 1").groupBy("row", "doc_id").agg(*[F.sum(c).alias(c) for c in sums]).join(texts, "row").select("row", "doc_id", *sums, "groups")
    out = single.unionByName(long).join(weighed, "row", "left")
    more = {"n_best": "more_best", "count_sum": "more_sum"}
    return out.select("doc_id", *[(F.col(c) + F.coalesce(more[c], F.lit(0)) if c in more else F.col(c)).alias(c) for c in sums], "groups")
