"""Spelling variants: against all pairs of words, against SQL, and with every odd case."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from caudal.llm import variants as va
from caudal.llm.queries import QUERIES, SQL
from tests.checking import connect, plain
from tests.llm.conftest import texts

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def near(a: str, b: str) -> bool:
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def by_hand(rows):
    """(word, form, root, n, n_near, form_n) by comparing all words with all."""
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(UPPER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            n[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run] += 1
    n = {w: c for w, c in n.items() if len(w) >= 7 and c >= 2}
    around = {w: [x for x in n if near(w, x)] for w in n}
    best = {w: min(xs, key=lambda x: (-n[x], x)) for w, xs in around.items() if xs}
    form = {w: x for w, x in best.items() if n[x] >= 10 * n[w]}
    out = []
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n[w], len(around[w]), n[form[w]] if w in form else None))
    return sorted(out, key=lambda r: r[0])


def found(docs, **kw):
    return sorted((tuple(r) for r in va.spelling_variants(docs, **kw).collect()), key=lambda r: r[0])


def crowded(seed, n=220):
    """Words of few letters and much alike, some far more frequent than others, in chains of forms."""
    rng = random.Random(seed)
    words = ["".join(rng.choice("abé") for _ in range(rng.randrange(7, 11))) for _ in range(40)] + ["government", "goverment", "governmemt", "govermemt", "aaaaaaa", "aaaaaaaa", "aaaaaaaaa", "Straßenbau", "StraßenBau"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(40))) for i in range(n // 4)]
    rows += [(1000 + i, "government " * 30 + "goverment " * (3 if i < 2 else 0)) for i in range(20)]
    return rows + [(5000, "govermemt x govermemt"), (5001, None), (5002, ""), (None, "nobodies nobodies"), (5003, "y" * 3000 + " " + "y" * 3000 + " " + "y" * 3001 + " " + "y" * 3001)]


@pytest.mark.parametrize("threshold", [None, 3, 40, 10**9])
def test_all_pairs(make_docs, threshold):
    rows = crowded(5)
    assert found(make_docs(rows), threshold=threshold) == by_hand(rows)


def test_odd_tables(make_docs):
    rows = texts() * 2
    assert found(make_docs(rows)) == by_hand(rows)
    assert found(make_docs([])) == [] and found(make_docs([(1, None), (2, ""), (3, "short words only")])) == []


def test_chain_reaches_the_root(make_docs):
    rows = [(1, "abcdefgh " * 400), (2, "abcdefgx " * 40), (3, "abcdefyx " * 4)]
    out = {r[0]: r for r in found(make_docs(rows))}
    assert found(make_docs(rows)) == by_hand(rows)
    assert out["abcdefyx"][1:3] == ("abcdefgx", "abcdefgh")


def test_bound_covers_every_edit():
    """No edit changes more grams, at their places or one further, than the bound of the word says."""
    rng = random.Random(8)
    words = ["".join(rng.choice("abc") for _ in range(rng.randrange(7, 14))) for _ in range(300)]
    batch = pa.RecordBatch.from_arrays([pa.array(words)], ["word"])
    counts = Counter()
    for part in va.count_grams(iter([batch])):
        counts.update(dict(zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True)))
    for threshold in (5, 30, 200):
        grams = np.array(sorted(g for g, c in counts.items() if c > threshold), dtype=np.int64)
        tails = va.tails_of(grams)

        def grams_of(word):
            letters = np.frombuffer(word.encode("latin-1"), np.uint8).reshape(1, -1)
            size, kept, bound = va.decompose(letters, grams, tails)
            return [(int(p), word[p : p + size[0, p]]) for p in np.flatnonzero(kept[0])], int(bound[0])

        for word in words[:60]:
            own, bound = grams_of(word)
            for i in range(len(word) + 1):
                edited = [(0, word[:i] + c + word[i + 1 :]) for c in "abd" if i < len(word) and c != word[i]] + [(1, word[:i] + c + word[i:]) for c in "abd"] + [(-1, word[:i] + word[i + 1 :]) for _ in range(i < len(word))]
                for shift, other in edited:
                    there = set(grams_of(other)[0])
                    lost = sum((p, g) not in there if p < i else (p + shift, g) not in there for p, g in own)
                    assert lost <= bound, (word, other)


def test_sql(spark):
    folder = "/root/testdata/sf0.001"
    con = connect(folder)
    result = con.execute(SQL["op13_spelling_variants"])
    names = [d[0] for d in result.description]
    expected = sorted((tuple(plain(v) for v in row) for row in result.fetchall()), key=repr)
    mine = sorted((tuple(plain(v) for v in row) for row in QUERIES["op13_spelling_variants"](spark, folder).select(names).collect()), key=repr)
    assert mine and mine == expected
