"""Long items among many short ones keep the recall of the decontamination."""

import random

import numpy as np
import pyarrow as pa

from caudal.llm import decontaminate as dc
from caudal.llm.words import text_bytes, words_of
from tests.llm.conftest import sentence

LONG = 8


def benchmark(rng):
    return [sentence(rng, 150) for _ in range(LONG)] + [sentence(rng, rng.randrange(5, 9)) for _ in range(400)]


def copies(rng, items, each):
    """Long items with up to 20 % of their words edited, between other words: (item, text)."""
    out = []
    for i in range(LONG):
        for _ in range(each):
            w = items[i].split()
            for _ in range(30):
                at, kind = rng.randrange(len(w) + 1), rng.randrange(3)
                w = w[:at] + ["inserted"] + w[at:] if kind == 0 else w[:at] + w[at + 1 :] if kind == 1 else w[:at] + ["replaced"] + w[at + 1 :]
            out.append((i, " ".join(["other"] * rng.randrange(9) + w + ["words"] * rng.randrange(40))))
    return out


def found(items, texts):
    words = words_of(*text_bytes(pa.array(texts, pa.string())))
    return {r: {m["item_id"] for m in own} for r, own in dc.matches(items, words.hashes(lower=True), words.first).items()}


def test_long_items_among_short_ones():
    rng = random.Random(8)
    texts = benchmark(rng)
    items = dc.prepared(list(range(len(texts))), texts, dc.SHARE, dc.RECALL)
    edited = copies(rng, texts, 10)
    got = found(items, [t for _, t in edited])
    share = np.mean([i in got.get(r, ()) for r, (i, _) in enumerate(edited)])
    assert share >= 0.9, share


def test_items_that_miss_the_target_are_verified_in_full(monkeypatch):
    monkeypatch.setattr(dc, "MOST_REPETITIONS", 1)
    rng = random.Random(9)
    texts = benchmark(rng)
    items = dc.prepared(list(range(len(texts))), texts, dc.SHARE, dc.RECALL)
    edited = copies(rng, texts, 4)
    got = found(items, [t for _, t in edited])
    assert all(i in got.get(r, ()) for r, (i, _) in enumerate(edited))
