"""Exact dedup, substring dedup and the Jaccard join against plain versions."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest

from caudal.llm.components import components
from caudal.llm.exact import drop_exact_duplicates, exact_duplicates
from caudal.llm.jaccard import Rule, near_duplicates, one_of_each
from caudal.llm.substring import without_repeats
from tests.llm.conftest import sentence, texts


def words(text):
    return (text or "").encode().split()


def folded(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


@pytest.mark.parametrize("counters", [2, 1024])
def test_exact_groups(make_docs, counters):
    rows = texts() + [(500 + i, "very common") for i in range(40)]
    expected = Counter()
    groups = defaultdict(list)
    for i, t in rows:
        groups[folded(t)].append(i)
    for i, t in rows:
        ids = groups[folded(t)]
        known = [x for x in ids if x is not None]
        expected[i, min(known) if known else None, len(ids), hashlib.sha256(folded(t).encode()).hexdigest()] += 1
    got = exact_duplicates(make_docs(rows), counters).collect()
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got) == expected
    assert sum(r["kept"] for r in got) == len(groups)
    assert all(r["doc_id"] == r["keep_id"] for r in got if r["kept"])


def test_exact_drop_keeps_columns(make_docs):
    docs = make_docs(texts())
    kept = drop_exact_duplicates(docs)
    assert kept.columns == docs.columns
    left = kept.collect()
    assert Counter(folded(r["text"]) for r in left) == Counter({folded(t): 1 for _, t in texts()})
    assert drop_exact_duplicates(make_docs([])).count() == 0


def brute_removed(rows, window=50):
    least = {}
    for i, t in rows:
        w = words(t)
        for s in range(len(w) - window + 1 if i is not None else 0):
            key = tuple(w[s : s + window])
            least[key] = min(least.get(key, i), i)
    out = Counter()
    for i, t in rows:
        w = words(t)
        gone = set()
        for s in range(len(w) - window + 1 if i is not None else 0):
            if least[tuple(w[s : s + window])] < i:
                gone |= set(range(s, s + window))
        out[i, len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone).decode()] += 1
    return out


def test_substring_against_all_windows(make_docs):
    rng = random.Random(9)
    passages = [sentence(rng, n) for n in (49, 50, 51, 65, 100, 16, 20)]
    rows = texts(3)
    for i in range(60):  # passages meet, are cut short and follow each other, so that factors end at many places
        parts = []
        for _ in range(rng.randrange(1, 6)):
            p = rng.choice(passages).split()
            a = rng.randrange(0, 10)
            parts.append(" ".join(p[a if rng.random() < 0.4 else 0 :]) if rng.random() < 0.8 else sentence(rng, rng.randrange(1, 30)))
        rows.append((1000 + rng.randrange(10**6) * (1 if i % 2 else -1), "\n".join(parts)))
    rows.append((77, " ".join(["same"] * 400)))
    rows.append((78, " ".join(["same"] * 120)))
    got = without_repeats(make_docs(rows)).select("doc.doc_id", "n_words", "n_removed", "kept").collect()
    assert Counter(map(tuple, got)) == brute_removed(rows)
    assert sum(r["n_removed"] for r in got) > 1000


def test_substring_empty(make_docs):
    assert without_repeats(make_docs([])).count() == 0
    assert [tuple(r) for r in without_repeats(make_docs([(1, "a b")])).select("n_words", "n_removed", "kept").collect()] == [(2, 0, "a b")]


def brute_components(rows, rule):
    sets = []
    for _, t in rows:
        w = [bytes(c + 32 if 65 <= c <= 90 else c for c in x) for x in words(t)]
        k = rule.shingle
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set()))
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= rule.percent * len(a | b):
                parent[root(i)] = root(j)
    groups = defaultdict(list)
    for i in range(len(rows)):
        groups[root(i)].append(rows[i][0])
    out = Counter()
    for i, (doc_id, _) in enumerate(rows):
        known = [x for x in groups[root(i)] if x is not None]
        out[doc_id, len(sets[i]), (min(known) if known else None)] += 1
    return out


def family(rng, size, n, first):
    """Copies of copies, one or two words changed each time: a chain of links, not all of them between all."""
    base = [sentence(rng, n).split()]
    while len(base) < size:
        w = list(rng.choice(base))
        for _ in range(rng.randrange(0, 3)):
            w[rng.randrange(len(w))] = f"new{rng.randrange(10**6)}"
        base.append(w)
    return [(first + i, " ".join(w)) for i, w in enumerate(base)]


@pytest.mark.parametrize(("rule", "boundary"), [(Rule(), None), (Rule(), 40), (Rule(), 0), (Rule(shingle=5, percent=80), None)])
def test_jaccard_components(make_docs, rule, boundary):
    rng = random.Random(4)
    rows = texts(5) + family(rng, 40, 60, 2000) + family(rng, 25, 24, 3000) + family(rng, 25, 11, 4000) + family(rng, 12, 300, 5000)
    rng.shuffle(rows)
    got = near_duplicates(make_docs(rows), rule, boundary).select("doc_id", "n_shingles", "component_id").collect()
    assert Counter(map(tuple, got)) == brute_components(rows, rule)


def test_jaccard_long_lists_in_blocks(make_docs, monkeypatch):
    import caudal.llm.jaccard as jaccard

    monkeypatch.setattr(jaccard, "BLOCK", 7)
    rng = random.Random(8)
    rows = family(rng, 60, 40, 1)
    got = near_duplicates(make_docs(rows)).select("doc_id", "n_shingles", "component_id").collect()
    assert Counter(map(tuple, got)) == brute_components(rows, Rule())


@pytest.mark.parametrize("first", [1, 10**9])
def test_jaccard_rounds(make_docs, first):
    """Few candidates at first, more in later rounds: the same components as with all candidates at once."""
    rng = random.Random(9)
    rows = family(rng, 50, 60, 1) + family(rng, 40, 33, 500) + [(900 + i, t) for i, (_, t) in enumerate(half_alike(rng, 40))]
    rng.shuffle(rows)
    got = near_duplicates(make_docs(rows), Rule(), first=first).select("doc_id", "n_shingles", "component_id").collect()
    assert Counter(map(tuple, got)) == brute_components(rows, Rule())


def half_alike(rng, size):
    """Texts that share most words but not enough of them to be linked."""
    base = sentence(rng, 120).split()
    return [(i, " ".join(w if k % 9 else f"own{i}x{k}" for k, w in enumerate(base))) for i in range(size)]


def test_candidates_grow_with_the_group_only(make_docs, monkeypatch):
    """Candidate rows of one group of near copies, n and 5n of them: at most in proportion."""
    import caudal.llm.jaccard as jaccard

    monkeypatch.setattr(jaccard, "BLOCK", 64)
    whole, rows = jaccard.settled, []

    def counted(df, name):
        out = whole(df, name)
        if name in ("neighbour-pairs", "further-pairs"):
            rows[-1] += out.count()
        return out

    monkeypatch.setattr(jaccard, "settled", counted)
    base = sentence(random.Random(3), 200).split()
    for n in (100, 500):
        rows.append(0)
        docs = make_docs([(i, " ".join(f"new{i}" if k == i % 200 else w for k, w in enumerate(base))) for i in range(n)])
        assert near_duplicates(docs, Rule()).select("component_id").distinct().count() == 1
    assert rows[1] <= 6 * rows[0], rows


def test_one_of_each(make_docs):
    rng = random.Random(6)
    rows = family(rng, 20, 80, 100) + [(1, ""), (2, None), (3, "few words"), (3, "few words")]
    docs = make_docs(rows)
    kept = one_of_each(docs, Rule())
    assert kept.columns == docs.columns
    components_ = {c for _, n, c in brute_components(rows, Rule()) if n}
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted([*components_, 1, 2])
    assert one_of_each(make_docs([]), Rule()).count() == 0


def test_components_of_a_chain(spark):
    links = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (101, 102), (7, 7)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {101: 100, 102: 100}
