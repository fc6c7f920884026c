"""N-gram Jaccard self-join by a size-aware heavy-light join.

Each text becomes a set of word shingles (64-bit hashes). Equal sets are put together first; links are sought between
different sets. All sets are ordered by one global order, rare shingles first, after a table of counts over all texts.
Two sets that reach the threshold share at least the ceiling of threshold * size elements of either, so

- light sets (up to the boundary) enumerate all subsets of `subset` elements of their first size - needed + subset
  elements: two linked light sets have one of these subsets in common;
- heavy sets scan inverted lists: two linked sets of which one is heavy share an element among the first size - needed + 1
  of each, so every set that can reach the size of a heavy partner is entered in the lists of these elements.

The boundary is where enumerating subsets begins to cost more rows than the lists have entries, as the table of counts
tells. Candidates must agree in size, and no more of the `PROFILE` cells may differ in parity than elements may differ;
both tests lose nothing. What remains is compared exactly, element by element.

Groups of near copies are not expanded into pairs. First only neighbours in a list are compared, a long list being cut into
blocks; the links found give components. Then rounds: of the members of a list that lie in different components, some
candidates for each pair of components are compared, `FIRST` at first and more in each further round; links merge components, and a
round in which no list had more candidates than it may give ends the search. So nothing is left out, and a large group costs
about as many candidates as it has members. Near copies share many lists: of lists with the same members one is compared, lists of
two are done with as neighbours, and only lists that had more candidates than they gave go into a further round. Tables that nothing
reads any more are deleted.

Defined results: a null or empty text has an empty set and is linked with nothing; fewer words than a shingle make one
element; a null doc_id is larger than every number when components are named; repeated rows are linked like copies; an
empty table gives an empty table; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caudal.llm.components import components
from caudal.llm.tables import discard, release, settled
from caudal.llm.words import KEYS, MIX, mixed, row_slices, short_runs, signed, sorted_groups, text_bytes, words_of

CELLS = 1 << 20  # of the table of counts: 8 MB, whatever the input
PART = 4096  # cells in one row while the table is added up
PROFILE = 1024  # bits of a set's profile: whether a cell has an odd number of elements (tells more than counts in fewer cells)
BLOCK = 2048  # members of a list that are compared in one group
FIRST, MORE = 8, 16  # candidates of a list for each pair of components in the first round, and how many times more in the next


@dataclass(frozen=True)
class Rule:
    shingle: int = 3
    percent: int = 90  # linked when 100 * intersection >= percent * union
    subset: int = 2

    def needed(self, size):
        """The least overlap of a set with any partner."""
        return (self.percent * size + 99) // 100


@dataclass
class Sets:
    """Distinct elements of consecutive rows, sorted inside each: elements, row of each, first element of each row."""

    elements: np.ndarray
    row: np.ndarray
    first: np.ndarray

    @property
    def sizes(self) -> np.ndarray:
        return np.diff(self.first)


def sets_of(data: np.ndarray, offsets: np.ndarray, shingle: int) -> Sets:
    words = words_of(data, offsets)
    hashes, counts = words.hashes(lower=True), np.diff(words.first)
    short = np.flatnonzero((counts > 0) & (counts < shingle))
    at = np.flatnonzero(np.arange(len(hashes)) + shingle <= np.repeat(words.first[1:], counts))
    begins = np.concatenate([at, words.first[short]])
    ends = np.concatenate([at + shingle, words.first[short + 1]])
    elements, row = short_runs(hashes, begins, ends), np.searchsorted(words.first, begins, side="right") - 1
    order, firsts = sorted_groups(row, elements)
    elements, row = elements[order][firsts], row[order][firsts]
    return Sets(elements, row, np.searchsorted(row, np.arange(len(counts) + 1)))


def set_slices(column: pa.Array, shingle: int) -> Iterator[tuple[int, int, Sets]]:
    data, offsets = text_bytes(column)
    for a, b in row_slices(offsets):
        yield a, b, sets_of(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], shingle)


def set_names(sets: Sets) -> tuple[np.ndarray, np.ndarray]:
    """128 bits for each set: two sums of its elements, each mixed anew."""
    out = []
    for key in KEYS:
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(sets.elements * MIX + key), dtype=np.uint64)])
        out.append(signed(mixed((total[sets.first[1:]] - total[sets.first[:-1]]) ^ sets.sizes.astype(np.uint64))))
    return out[0], out[1]


def cell_of(elements: np.ndarray, cells: int) -> np.ndarray:
    return (elements % np.uint64(cells)).astype(np.int64)


def name_sets(batches: Iterator[pa.RecordBatch], rule: Rule) -> Iterator[pa.RecordBatch]:
    """(doc_id, text_key, text) to (doc_id, text_key, n_shingles, set_a, set_b)."""
    for batch in batches:
        for a, b, sets in set_slices(batch.column(2), rule.shingle):
            names = set_names(sets)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(sets.sizes.astype(np.int64)), pa.array(names[0]), pa.array(names[1])], ["doc_id", "text_key", "n_shingles", "set_a", "set_b"])


def count_cells(batches: Iterator[pa.RecordBatch], rule: Rule) -> Iterator[pa.RecordBatch]:
    """One partition's counts, `PART` cells a row."""
    counts = np.zeros(CELLS, np.int64)
    for batch in batches:
        for _, _, sets in set_slices(batch.column(0), rule.shingle):
            np.add.at(counts, cell_of(sets.elements, CELLS), 1)
    parts = counts.reshape(-1, PART)
    used = np.flatnonzero(parts.any(axis=1))
    yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array([parts[i].tobytes() for i in used], pa.binary())], ["part", "counts"])


def add_up(groups):
    total = np.sum([np.frombuffer(x, np.int64) for x in groups["counts"]], axis=0)
    return groups.iloc[:1][["part"]].assign(counts=[total.tobytes()])


def count_table(texts: DataFrame, rule: Rule) -> np.ndarray:
    """How many texts hold an element of each cell: a table of fixed size over all texts. Added up in two steps, so that no
    group has a row from every partition."""
    counted = texts.select("text").mapInArrow(lambda b: count_cells(b, rule), "part int, counts binary").withColumn("salt", F.spark_partition_id() % 64)
    some = counted.groupBy("part", "salt").applyInPandas(add_up, "part int, counts binary")
    table = np.zeros((CELLS // PART, PART), np.int64)
    for row in some.groupBy("part").applyInPandas(add_up, "part int, counts binary").toLocalIterator():
        table[row["part"]] = np.frombuffer(row["counts"], np.int64)
    return table.ravel()


def chosen_boundary(table: np.ndarray, rule: Rule) -> int:
    """The largest size at which subsets are no more rows than the list entries that a heavy set would scan. The first
    elements of a set are its rarest, so a list is as long as the rarest share of the table says, beyond its mean fill."""
    counts = np.sort(table[table > 0])
    if len(counts) == 0:
        return 0
    share = (100 - rule.percent) / 100
    rare = counts[: max(1, int(np.searchsorted(np.cumsum(counts), share * counts.sum())))]
    entries = 1 + max(0.0, float(np.average(rare, weights=rare)) - counts.sum() / CELLS)
    size = 1
    while True:
        first = size + 1 - rule.needed(size + 1)
        subsets = np.prod([(first + rule.subset - i) / (i + 1) for i in range(rule.subset)])
        if subsets > (first + 1) * entries or size > 1_000_000:
            return size
        size += 1


def keys_of(sets: Sets, table: np.ndarray, rule: Rule, boundary: int) -> tuple[np.ndarray, np.ndarray]:
    """(key, row): the subsets of light sets and the list entries of the others."""
    sizes = sets.sizes
    order = np.lexsort((sets.elements, table[cell_of(sets.elements, len(table))], sets.row))
    ordered, row = sets.elements[order], sets.row[order]
    place = np.arange(len(ordered)) - sets.first[row]
    spare = (sizes - rule.needed(sizes))[row]
    listed = (place <= spare) & (sizes[row] * 100 > boundary * rule.percent)  # heavy, or able to link with a heavy set
    keys, rows = [mixed(ordered[listed])], [row[listed]]
    light = np.flatnonzero((sizes <= boundary) & (sizes >= rule.subset))
    heads = np.minimum(sizes[light], sizes[light] - rule.needed(sizes[light]) + rule.subset)
    for length in np.unique(heads).tolist():  # each subset in the global order
        some = light[heads == length]
        head = ordered[sets.first[some][:, None] + np.arange(length)]
        subsets = np.array(list(combinations(range(length), rule.subset)), dtype=np.int64).reshape(-1, rule.subset)
        key = np.zeros((len(some), len(subsets)), np.uint64)
        for i in range(rule.subset):
            key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + head[:, subsets[:, i]])
        keys.append(key.ravel())
        rows.append(np.repeat(some, len(subsets)))
    return np.concatenate(keys), np.concatenate(rows)


def list_entries(batches: Iterator[pa.RecordBatch], shared, rule: Rule, boundary: int) -> Iterator[pa.RecordBatch]:
    """(text) to (key, set_a, set_b)."""
    table = shared.value
    for batch in batches:
        for _, _, sets in set_slices(batch.column(0), rule.shingle):
            names = set_names(sets)
            key, row = keys_of(sets, table, rule, boundary)
            yield pa.RecordBatch.from_arrays([pa.array(signed(key)), pa.array(names[0][row]), pa.array(names[1][row])], ["key", "set_a", "set_b"])


def with_company(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (key, set_a, set_b) sorted by key, those whose key another row has too. One row is held until the next has come."""
    last: pa.RecordBatch | None = None  # the last row so far
    joined = False  # whether the row before it has its key
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = batch if last is None else pa.Table.from_batches([last, batch]).combine_chunks().to_batches()[0]
        keys = rows.column("key").to_numpy()
        same = keys[1:] == keys[:-1]
        keep = np.concatenate([[joined], same]) | np.concatenate([same, [False]])
        yield rows.slice(0, len(keys) - 1).filter(pa.array(keep[:-1]))
        last, joined = rows.slice(len(keys) - 1), bool(same[-1]) if len(same) else joined
    if last is not None and joined:
        yield last


def profiles(batches: Iterator[pa.RecordBatch], rule: Rule) -> Iterator[pa.RecordBatch]:
    """(set_a, set_b, text) with size and profile: which cells hold an odd number of elements."""
    for batch in batches:
        for a, b, sets in set_slices(batch.column(2), rule.shingle):
            odd = np.bincount(sets.row * PROFILE + (sets.elements >> np.uint64(54)).astype(np.int64), minlength=(b - a) * PROFILE) & 1
            bits = np.packbits(odd.astype(bool).reshape(b - a, PROFILE), axis=1)
            part = batch.slice(a, b - a)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(sets.sizes.astype(np.int32)), pa.array([x.tobytes() for x in bits], pa.binary())], ["set_a", "set_b", "text", "size", "profile"])


def candidate_pairs(batches: Iterator[pa.RecordBatch], rule: Rule, most: int | None) -> Iterator[pa.RecordBatch]:
    """Rows sorted by group: (key, block, set_a, set_b, component_a, component_b, size, profile, side) to pairs that
    may be linked. `side` 1 and 2 tell the blocks apart of which one is compared with the other; 0 is one block with itself.
    `most`: how many pairs a group gives for each pair of components (a row with nothing but its key says that it had more); None:
    neighbours only. A group is held until its last row has come; it has `BLOCK` rows of each side, about."""
    kept: pa.Table | None = None
    names = ["u_a", "u_b", "v_a", "v_b", "key"]

    def allowed(seen: dict, members: np.ndarray, component: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Which pairs are among the first `most` of their pair of components. component: a hash with the group; members: how
        many of the group are in it."""
        stays = members[i] * members[j] <= most  # so few can't be too many
        many = np.flatnonzero(~stays)
        between = mixed(np.minimum(component[i], component[j])[many] ^ mixed(np.maximum(component[i], component[j])[many]))
        order, firsts = sorted_groups(between)
        counts = np.diff(np.append(firsts, len(order)))
        names = between[order][firsts].tolist()
        before = np.array([seen.get(b, 0) for b in names], dtype=np.int64)
        rank = np.arange(len(order)) - np.repeat(firsts, counts) + np.repeat(before, counts)
        seen.update(zip(names, (before + counts).tolist(), strict=True))
        stays[many[order[rank < most]]] = True
        return stays

    def pairs(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        col = {c: rows.column(c).combine_chunks().to_numpy(zero_copy_only=False) for c in ("key", "block", "set_a", "set_b", "size", "side", "component_a", "component_b")}
        bits = np.frombuffer(b"".join(rows.column("profile").to_pylist()), np.uint64).reshape(-1, PROFILE // 64)
        new = np.concatenate([[True], (col["key"][1:] != col["key"][:-1]) | (col["block"][1:] != col["block"][:-1])])
        group = np.cumsum(new)
        at, step, n, seen, more = np.arange(len(group)), 0, len(group), {}, set()
        component = mixed(mixed(col["component_a"].view(np.uint64) ^ mixed(col["component_b"].view(np.uint64))) ^ group.astype(np.uint64))
        _, which, counts = np.unique(component, return_inverse=True, return_counts=True)
        members = counts[which]
        while len(at):
            step += 1
            at = at[at + step < n]
            at = at[group[at + step] == group[at]]
            if len(at) == 0 or (most is None and step > 1):
                break
            for piece in np.array_split(at, len(at) // 100_000 + 1):
                to = piece + step
                ok = (col["side"][piece] == 0) | (col["side"][piece] != col["side"][to])
                ok &= (col["component_a"][piece] != col["component_a"][to]) | (col["component_b"][piece] != col["component_b"][to])
                low, high = np.minimum(col["size"][piece], col["size"][to]).astype(np.int64), np.maximum(col["size"][piece], col["size"][to]).astype(np.int64)
                ok &= low * 100 >= high * rule.percent
                i, j = piece[ok], to[ok]
                differing = np.bitwise_count(bits[i] ^ bits[j]).sum(axis=1, dtype=np.int64)
                fits = differing * (100 + rule.percent) <= (100 - rule.percent) * (low[ok] + high[ok])
                i, j = i[fits], j[fits]
                if most is not None and len(i):
                    stays = allowed(seen, members, component, i, j)
                    more.update(col["key"][i[~stays]].tolist())
                    i, j = i[stays], j[stays]
                if len(i):
                    swap = (col["set_a"][i] > col["set_a"][j]) | ((col["set_a"][i] == col["set_a"][j]) & (col["set_b"][i] > col["set_b"][j]))
                    i, j = np.where(swap, j, i), np.where(swap, i, j)
                    out = np.unique(np.stack([col["set_a"][i], col["set_b"][i], col["set_a"][j], col["set_b"][j]], axis=1), axis=0)
                    yield pa.RecordBatch.from_arrays([*[pa.array(out[:, k]) for k in range(4)], pa.nulls(len(out), pa.int64())], names)
        if more:
            yield pa.RecordBatch.from_arrays([*[pa.nulls(len(more), pa.int64())] * 4, pa.array(list(more), pa.int64())], names)

    for batch in batches:
        rows = pa.Table.from_batches([batch])
        rows = rows if kept is None else pa.concat_tables([kept, rows])
        keys, blocks = rows.column("key").to_numpy(), rows.column("block").to_numpy()
        whole = np.flatnonzero((keys != keys[-1]) | (blocks != blocks[-1]))
        cut = int(whole[-1]) + 1 if len(whole) else 0
        if cut:
            yield from pairs(rows.slice(0, cut))
        kept = rows.slice(cut)
    if kept is not None and kept.num_rows:
        yield from pairs(kept)


def compare(batches: Iterator[pa.RecordBatch], rule: Rule) -> Iterator[pa.RecordBatch]:
    """(u, v, text of u, text of v): the pairs that are linked, by exact comparison."""
    for whole in batches:
        for at in range(0, whole.num_rows, 200):
            batch = whole.slice(at, 200)
            sides = []
            for c in (2, 3):
                parts = [(a, s) for a, _, s in set_slices(batch.column(c), rule.shingle)]
                sides.append((np.concatenate([s.elements for _, s in parts]), np.concatenate([s.row + a for a, s in parts])))
            sizes = [np.bincount(row, minlength=batch.num_rows) for _, row in sides]
            elements, row = np.concatenate([s[0] for s in sides]), np.concatenate([s[1] for s in sides])
            order, firsts = sorted_groups(row, elements)
            twice = np.diff(np.append(firsts, len(order))) == 2
            both = np.bincount(row[order][firsts][twice], minlength=batch.num_rows)
            linked = both * 100 >= rule.percent * (sizes[0] + sizes[1] - both)
            yield batch.select(["u", "v"]).filter(pa.array(linked))


def verified_links(pairs: DataFrame, texts: DataFrame, rule: Rule) -> DataFrame:
    """`pairs` (u_a, u_b, v_a, v_b) of sets to links (u, v), each a struct of the two halves of a name."""
    one = texts.select(F.col("set_a").alias("u_a"), F.col("set_b").alias("u_b"), F.col("text").alias("text_u"))
    two = texts.select(F.col("set_a").alias("v_a"), F.col("set_b").alias("v_b"), F.col("text").alias("text_v"))
    sought = two.join(pairs.select("v_a", "v_b").distinct(), ["v_a", "v_b"], "left_semi")  # only these texts are dealt out for the second side
    joined = pairs.join(one, ["u_a", "u_b"]).join(sought, ["v_a", "v_b"])
    name = "struct<a:bigint,b:bigint>"
    rows = joined.select(F.struct(F.col("u_a").alias("a"), F.col("u_b").alias("b")).alias("u"), F.struct(F.col("v_a").alias("a"), F.col("v_b").alias("b")).alias("v"), "text_u", "text_v")
    return rows.mapInArrow(lambda b: compare(b, rule), f"u {name}, v {name}")


def in_blocks(entries: DataFrame) -> DataFrame:
    """List entries, with the block of their list that they stand in: `BLOCK` of its `members` each, by hash."""
    blocks = F.ceil(F.col("members") / BLOCK).cast("int")
    return entries.withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("set_b", "set_a"), blocks).cast("int"))


def each_block(placed: DataFrame) -> DataFrame:
    """Every block as a group of its own."""
    return placed.withColumn("block", F.col("own").cast("long")).withColumn("side", F.lit(0))


def block_pairs(placed: DataFrame) -> DataFrame:
    """Every pair of blocks of a list as a group: each entry goes to those that its own block is part of."""
    other = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    low, high = F.least("own", "other"), F.greatest("own", "other")
    return other.withColumn("block", low.cast("long") * F.col("blocks") + high).withColumn("side", F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2))


def pairs_in(entries: DataFrame, rule: Rule, most: int | None = None) -> DataFrame:
    """Candidate pairs of entries that stand in the same group, and the keys of lists that had more. Groups are kept together by the
    shuffle and come sorted."""
    columns = ["key", "block", "set_a", "set_b", "component_a", "component_b", "size", "profile", "side"]
    sorted_rows = entries.select(columns).repartition("key", "block").sortWithinPartitions("key", "block", "size", "set_a", "set_b")
    return sorted_rows.mapInArrow(lambda b: candidate_pairs(b, rule, most), "u_a long, u_b long, v_a long, v_b long, key long").distinct()


def shared_lists(listed: DataFrame) -> DataFrame:
    """Settled (key, set_a, set_b, members) of the lists in which several sets stand, one list of each that have the same members.
    `members`: how many. The entries, the largest table of all, are shuffled once."""
    held = settled(listed.repartition("key").sortWithinPartitions("key").mapInArrow(with_company, listed.schema).distinct(), "list-entries")
    # Names of sets are 128 random bits, so their exclusive or tells lists apart like a name of one.
    lists = held.groupBy("key").agg(F.count(F.lit(1)).alias("members"), F.bit_xor("set_a").alias("mark_a"), F.bit_xor("set_b").alias("mark_b")).where("members > 1")
    unlike = settled(lists.groupBy("members", "mark_a", "mark_b").agg(F.min("key").alias("key")).select("key", "members"), "unlike-lists")
    entries = settled(held.join(unlike, "key"), "shared-entries")
    discard(held, unlike)
    return entries


def set_links(texts: DataFrame, named: DataFrame, rule: Rule, boundary: int | None = None, first: int = FIRST) -> DataFrame:
    """Links between different sets, enough of them to give the components: (u, v).
    `texts`: doc_id, text_key, text; `named`: settled doc_id, text_key, n_shingles, set_a, set_b."""
    table = count_table(texts, rule)
    boundary = chosen_boundary(table, rule) if boundary is None else boundary
    shared = texts.sparkSession.sparkContext.broadcast(table)  # CELLS numbers, whatever the input
    entries = shared_lists(texts.select("text").mapInArrow(lambda b: list_entries(b, shared, rule, boundary), "key long, set_a long, set_b long"))
    # One text for each set that stands in a list with others.
    stands = named.groupBy("set_a", "set_b").agg(F.min(F.struct(F.struct("doc_id").alias("id"), "text_key")).alias("doc")).join(entries.select("set_a", "set_b").distinct(), ["set_a", "set_b"])
    keyed = settled(stands.select("set_a", "set_b", "doc.id", "doc.text_key"), "sought-sets")
    chosen = texts.select(F.struct("doc_id").alias("id"), "text_key", "text").join(keyed, ["id", "text_key"]).dropDuplicates(["id", "text_key"]).select("set_a", "set_b", "text")  # dealt out once, by these
    profiled = settled(chosen.mapInArrow(lambda b: profiles(b, rule), "set_a long, set_b long, text string, size int, profile binary"), "set-texts")
    discard(keyed)
    held, marks = profiled.select("set_a", "set_b", "text"), profiled.drop("text")

    def marked(placed: DataFrame) -> DataFrame:
        """Profiles are joined last: a set has one, but stands in many lists."""
        return placed.join(marks, ["set_a", "set_b"])

    alone = entries.withColumn("component_a", F.col("set_a")).withColumn("component_b", F.col("set_b"))
    tested = settled(pairs_in(each_block(marked(in_blocks(alone))), rule).drop("key"), "neighbour-pairs")
    members = settled(entries.where("members > 2"), "longer-lists")  # the others had one pair
    discard(entries)
    links = settled(verified_links(tested, held, rule), "neighbour-links")
    most = first
    while True:
        labels = components(links)
        label = labels.select(F.col("node.a").alias("set_a"), F.col("node.b").alias("set_b"), F.col("component.a").alias("component_a"), F.col("component.b").alias("component_b"))
        labelled = members.join(label, ["set_a", "set_b"], "left").withColumn("component_a", F.coalesce("component_a", "set_a")).withColumn("component_b", F.coalesce("component_b", "set_b"))
        component = F.struct("component_a", "component_b")
        both = settled(labelled.groupBy("key").agg(F.min(component).alias("low"), F.max(component).alias("high")).where("low <> high").select("key"), "mixed-lists")
        # Only lists that two components share go on.
        mixed_members = settled(labelled.join(both, "key"), "mixed-members")
        discard(members, both)
        found = settled(pairs_in(block_pairs(marked(in_blocks(mixed_members))), rule, most), "further-pairs")
        fresh = settled(found.where("u_a is not null").drop("key").join(tested, ["u_a", "u_b", "v_a", "v_b"], "left_anti"), "untested-pairs")
        release(fresh)
        links = settled(labels.select(F.col("node").alias("u"), F.col("component").alias("v")).unionByName(verified_links(fresh, held, rule)), "links")
        left = found.where("u_a is null").select("key")
        if left.isEmpty():
            discard(mixed_members, profiled)
            return links
        # A list that gave all its candidates has no untested pair.
        members = settled(mixed_members.drop("component_a", "component_b").join(left, "key", "left_semi"), "lists-with-more")
        discard(mixed_members)
        tested, most = settled(tested.unionByName(fresh), "tested-pairs"), most * MORE
        release(tested)


def near_duplicates(docs: DataFrame, rule: Rule = Rule(), boundary: int | None = None, first: int = FIRST) -> DataFrame:
    """(doc_id, text_key, n_shingles, component, component_id): one row per document. `component` names its component (null
    for an empty set), component_id is the smallest doc_id that links reach."""
    texts = docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    named = settled(texts.mapInArrow(lambda b: name_sets(b, rule), "doc_id long, text_key long, n_shingles long, set_a long, set_b long"), "named-sets")
    there = named.where("n_shingles > 0")
    links = set_links(texts, there, rule, boundary, first)
    labels = components(links)
    name = F.struct(F.col("set_a").alias("a"), F.col("set_b").alias("b"))
    # Per set first, then per component: no group of copies is gathered anywhere.
    by_set = there.groupBy("set_a", "set_b").agg(F.min("doc_id").alias("least")).select(name.alias("node"), "least")
    placed = settled(by_set.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node")), "placed-sets")
    by_component = placed.groupBy("component").agg(F.min("least").alias("component_id"))
    ids = settled(placed.select("node", "component").join(by_component, "component").select(F.col("node.a").alias("set_a"), F.col("node.b").alias("set_b"), "component", "component_id"), "component-ids")
    linked = there.join(ids, ["set_a", "set_b"]).select("doc_id", "text_key", "n_shingles", "component", "component_id")
    alone = F.lit(None).cast(linked.schema["component"].dataType).alias("component")
    return linked.unionByName(named.where("n_shingles = 0").select("doc_id", "text_key", "n_shingles", alone, F.col("doc_id").alias("component_id")))


def one_of_each(docs: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """The documents without near duplicates: of each component the one with the smallest doc_id (null last) stays, as do
    all with an empty set; rows with the same doc_id and text count as one. All columns pass through."""
    groups = settled(near_duplicates(docs, rule).select(F.struct("doc_id").alias("id"), "text_key", "component"), "near-groups")
    first = groups.where("component is not null").groupBy("component").agg(F.min(F.struct(F.col("id.doc_id").isNull().alias("no_id"), "id", "text_key")).alias("stays"))
    kept = first.select("stays.id", "stays.text_key").unionByName(groups.where("component is null").select("id", "text_key").distinct())
    inside = docs.select(F.struct("*").alias("doc"), F.struct("doc_id").alias("id"), F.xxhash64("text").alias("text_key"))
    return inside.join(kept, ["id", "text_key"], "left_semi").dropDuplicates(["id", "text_key"]).select("doc.*")
