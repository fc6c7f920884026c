"""Hashes of words and of runs of words: equal for equal ones only, also for patterns on which polynomial hashes modulo a power of two collide."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from caudal.llm.decontaminate import contaminations
from caudal.llm.jaccard import Rule, near_duplicates
from caudal.llm.language_model import lm_scores
from caudal.llm.substring import without_repeats
from caudal.llm.words import PRIME, Rolling, runs_of, short_runs, text_bytes, times, words_of

SWAP = str.maketrans("ab", "ba")


def twin(n):
    """A word over two letters and its mirror: as polynomials with an odd base their values agree modulo 2^64 from 1,024 letters on."""
    word = "a"
    while len(word) < n:
        word += word.translate(SWAP)
    return word[:n], word[:n].translate(SWAP)


def hashed(text, key=0):
    data, offsets = text_bytes(pa.array([text]))
    return words_of(data, offsets).hashes(key=key)


@pytest.mark.parametrize("n", [512, 1024, 2048, 8192])
def test_twins_differ(n):
    one, two = twin(n)
    for key in (0, 1):
        assert hashed(one, key)[0] != hashed(two, key)[0]
    a, b = hashed(" ".join(one)), hashed(" ".join(two))
    at, to = np.zeros(1, np.int64), np.full(1, n)
    assert Rolling.over(a).run(at, to) != Rolling.over(b).run(at, to)
    assert runs_of(a, n) != runs_of(b, n)


def test_equal_runs_have_equal_hashes():
    rng = random.Random(2)
    words = ["ab", "abcdefgh", "abcdefghi", "é", "x" * 70, "B"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(0, 50))) for _ in range(120)]
    data, offsets = text_bytes(pa.array(texts))
    found = words_of(data, offsets)
    spelled = [bytes(data[a:b]) for a, b in zip(found.starts, found.ends, strict=True)]
    hashes = found.hashes()
    at = np.array([rng.randrange(len(hashes) - 12) for _ in range(3000)])
    to = at + np.array([rng.randrange(1, 12) for _ in at])
    for runs in (Rolling.over(hashes).run(at, to), short_runs(hashes, at, to), np.array([runs_of(hashes, j - i)[i] for i, j in zip(at[:400], to[:400], strict=True)])):
        seen = {}
        for i, j, h in zip(at, to, runs.tolist(), strict=False):
            seen.setdefault(tuple(spelled[i:j]), set()).add(h)
        assert all(len(h) == 1 for h in seen.values()) and len({min(h) for h in seen.values()}) == len(seen)
    assert (found.hashes(lower=True) == hashed(" ".join(w.decode().replace("B", "b") for w in spelled))).all()
    assert len(runs_of(hashes[:3], 5)) == 0 and len(runs_of(hashes[:0], 1)) == 0


def test_products_modulo_the_prime():
    rng = random.Random(1)
    a, b = ([rng.choice([0, 1, PRIME - 1, rng.randrange(PRIME)]) for _ in range(2000)] for _ in range(2))
    assert times(np.array(a, np.uint64), np.array(b, np.uint64)).tolist() == [x * y % PRIME for x, y in zip(a, b, strict=True)]


def test_operators_tell_twins_apart(make_docs, spark):
    one, two = twin(2048)
    rest = " ".join(f"w{i}" for i in range(55))
    docs = make_docs([(1, f"{one} x y"), (2, f"{two} x y"), (3, f"{one} {rest}"), (4, f"{two} {rest}"), (5, " ".join(twin(1024)[0])), (6, " ".join(twin(1024)[1]))])
    groups = {r["doc_id"]: r["component_id"] for r in near_duplicates(docs, Rule()).collect()}
    assert groups[1] == 1 and groups[2] == 2 and groups[5] == groups[6]  # 5 and 6 have the same shingles
    removed = {r["doc_id"]: r["n_removed"] for r in without_repeats(docs).select("doc.doc_id", "n_removed").collect()}
    assert removed[4] == 55
    known = lm_scores(docs).where("held_out").select("doc.doc_id", "doc.text", "n_known").collect()
    trained = {w for r in lm_scores(docs).where("not held_out").select("doc.text").collect() for w in r["text"].split()}
    assert all(r["n_known"] == sum(w in trained for w in r["text"].split()) + 1 for r in known)
    benchmark = spark.createDataFrame([(1, f"{one} p q r s t u v")], "item_id long, text string")
    near = make_docs([(1, f"aa {one} p q r s t u v bb"), (2, f"aa {two} p q r other words here bb")])
    assert [r["doc_id"] for r in contaminations(near, benchmark).where(F.lit(True)).collect() if r["item_id"] == 1] == [1]
