"""Toxicity: features against a plain version, held-out accuracy, calibration, and every odd case."""

import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from caudal.llm.queries import QUERIES
from caudal.llm.toxicity import FEATURES, LEXICON, SECOND, Lexicons, dense, fit, hashes_of, learnt_lexicon, score, toxicity_scores, unmasked
from caudal.llm.words import text_bytes
from tests.llm.conftest import ODD_COLUMNS, sentence, texts

INVENTED = ["grumbach", "zottelhirn"]


def rows_of(n=900, seed=3):
    """Every fourth text is toxic: fixed and invented insults, some masked, some near the second person."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        words = sentence(rng, rng.randrange(20, 150)).split()
        toxic = i % 4 == 0
        if toxic:
            for _ in range(rng.randrange(2, 6)):
                said = rng.choice(["idiot", "scum", "1d10t", "m.o.r.o.n", "You worthless trash!!", *INVENTED, *INVENTED])
                words.insert(rng.randrange(len(words)), said)
        out.append((i, " ".join(words), int(toxic)))
    return out


def labels_of(spark, rows):
    return spark.createDataFrame([(i, t) for i, _, t in rows], "doc_id long, toxic int")


def features_of(list_of_texts, learnt=()):
    data, offsets = text_bytes(pa.array(list_of_texts, pa.string()))
    return dense(data, offsets, Lexicons(hashes_of(LEXICON), hashes_of(list(learnt)), hashes_of(SECOND)))


def test_features_by_hand():
    tests = ["You are an idiot!! Really??", "", "nothing here", "IDIOT idiot Idiot, 12 ab1cd", "a b c noooo", "é à la carte", "far " * 9 + "you scum", "scum " + "x " * 6 + "you", " ".join(["you", "xyz"] * 40 + ["moron"])]
    for text, row in zip(tests, features_of(tests, INVENTED), strict=True):
        got = dict(zip(FEATURES, row.tolist(), strict=True))
        data = text.encode()
        words = re.findall(rb"[A-Za-z\x80-\xff]+", data)
        low = [w.lower().decode() for w in words]
        hits = [k for k, w in enumerate(low) if w in LEXICON or w in INVENTED]
        second = [k for k, w in enumerate(low) if w in SECOND]
        letters = max(len(re.findall(rb"[A-Za-z\x80-\xff]", data)), 1)
        n, size = max(len(words), 1), max(len(data), 1)
        assert got["fixed_share_of_words"] == pytest.approx(sum(w in LEXICON for w in low) / n)
        assert got["near_second_person"] == pytest.approx(sum(any(abs(k - s) <= 5 for s in second) for k in hits) / n)
        assert got["second_person"] == pytest.approx(len(second) / n)
        assert got["capitals"] == pytest.approx(len(re.findall(rb"[A-Z]", data)) / letters)
        assert got["shouted_words"] == pytest.approx(sum(len(w) > 2 and re.fullmatch(rb"[A-Z]+", w) is not None for w in words) / n)
        assert got["exclamations"] == pytest.approx(data.count(b"!") / size) and got["questions"] == pytest.approx(data.count(b"?") / size)
        assert got["repeated_marks"] == pytest.approx(sum(data[k] == data[k - 1] and data[k] in b"!?" for k in range(1, len(data))) / size)
        assert got["digits"] == pytest.approx(len(re.findall(rb"[0-9]", data)) / size)
        assert got["letters_apart"] == pytest.approx(sum(len(w) == 1 for w in words) / n)
        assert got["beyond_ascii"] == pytest.approx(sum(x >= 128 for x in data) / size)
        assert got["word_length"] == pytest.approx(sum(map(len, words)) / n) and got["length"] == pytest.approx(np.log1p(len(data)))


def test_rows_do_not_mix():
    tests = ["you", "idiot", "", "1", "diot", "IDIOT!", "!", "!?"]
    together = features_of(tests)
    alone = np.concatenate([features_of([t]) for t in tests])
    assert np.allclose(together, alone)


def test_masks_come_off():
    data, offsets = text_bytes(pa.array(["you 1d10t, a m.o.r.o.n and tr@sh; 5 is 5. a.b", "$cum l0ser"]))
    out, edges = unmasked(data, offsets)
    first = bytes(out[edges[0] : edges[1]]).split()
    assert {b"idiot", b"moron", b"trash"} <= set(first) and bytes(out[edges[1] : edges[2]]).split() == [b"scum", b"loser"]
    at = FEATURES.index("obfuscated")
    assert features_of(["you 1d10t m.o.r.o.n", "plain idiot"])[:, at].tolist() == [2.0, 0.0]


def test_held_out(make_docs, spark):
    rows = rows_of()
    out = toxicity_scores(make_docs([r[:2] for r in rows]), labels_of(spark, rows)).select("doc.doc_id", "held_out", "score", "predicted").collect()
    truth = {i: t for i, _, t in rows}
    assert len(out) == len(rows)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in out)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in out)
    held = [r for r in out if r["held_out"]]
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in held]) >= 0.97
    assert sum(r["predicted"] and not truth[r["doc_id"]] for r in held) <= 2


def test_lexicon_learns_invented_words(make_docs, spark):
    rows = rows_of()
    docs = make_docs([r[:2] for r in rows]).join(labels_of(spark, rows), "doc_id").selectExpr("toxic as label", "text")
    found = learnt_lexicon(docs)
    assert set(INVENTED) <= set(found) and not {"alpha", "gamma", "you"} & (set(found) - {"you"})


def test_isotonic_scores_follow_the_margin(make_docs, spark):
    rows = rows_of()
    model = fit(make_docs([r[:2] for r in rows]), labels_of(spark, rows))
    assert model.trees is not None and model.isotonic is not None
    assert list(model.isotonic.predictions) == sorted(model.isotonic.predictions)


def test_odd_tables(make_docs, spark):
    rows = rows_of(300)
    labels = labels_of(spark, rows).unionByName(spark.createDataFrame([(None, 1), (5, None), (4, 7)], "doc_id long, toxic int"))
    odd = make_docs([(i, t) for i, t, _ in rows] + [(None if i is None else i + 10_000, t) for i, t in texts()])
    out = toxicity_scores(odd, labels)
    got = out.select("doc.doc_id", "doc.text", *[f"doc.{c}" for c in ODD_COLUMNS if c != "score"], "score", "predicted").collect()
    assert len(got) == 300 + len(texts()) and all(r["key"] == "odd" for r in got) and all(r["score"] is not None for r in got)
    by_text = {}
    for r in got:
        assert by_text.setdefault(r["text"] or "", r["score"]) == r["score"]
    assert toxicity_scores(make_docs([]), labels).count() == 0
    none = toxicity_scores(odd, labels.where("toxic = 9")).select("score", "predicted").distinct().collect()
    assert [tuple(r) for r in none] == [(0.0, 0)]
    one_sort = toxicity_scores(odd, labels.where("toxic = 1 and doc_id is not null")).select("score").distinct().collect()
    assert [r[0] for r in one_sort] == [1.0]


def test_query(spark):
    out = QUERIES["op12_toxicity"](spark, "/root/testdata/sf0.001").collect()
    assert len(out) == 200 and score.__doc__
