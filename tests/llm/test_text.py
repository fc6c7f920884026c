"""BPE, quality, personal data, decontamination and the language model against plain versions and held-out accuracy."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from caudal.llm.bpe import WordBpe, decode, encode, merged_long
from caudal.llm.decontaminate import contaminations, without_benchmark
from caudal.llm.language_model import lm_scores
from caudal.llm.pii import KINDS, pii_digests, redacted
from caudal.llm.quality import quality_scores
from tests.llm.conftest import sentence, texts

PATH = public_tokenizers.path("word_bpe_49k.json")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def fuzz(n=400):
    rng = random.Random(1)
    alphabet = "aabcdeéÉΣσß1²½ \n\t  !?'<|>日本́İǅ\U0001f600\x1c\x85_٣ⅷ"
    return ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(n)] + [
        "<|endoftext|>a<|startoftext|> b", "<|endoftext|><|endoftext|>", "ΣΑΣ", "a" * 3000, "ab" * 500 + "the" * 100, "!" * 200, "it's don't I'LL", "<|endof", " ",
    ]


def test_bpe_is_the_librarys(make_docs):
    library = Tokenizer.from_file(PATH)
    rows = texts() + list(enumerate(fuzz(), 1000))
    expected = Counter()
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        expected[i, len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))] += 1
    got = encode(make_docs(rows), PATH, with_ids=True)
    assert Counter(tuple(r) for r in got.select("doc.doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()) == expected
    assert all(sha(r["decoded"]) == r["decoded_sha256"] for r in decode(got, PATH).select("decoded", "decoded_sha256").collect())
    assert encode(make_docs([]), PATH).count() == 0


def test_bpe_trees_agree():
    bpe = WordBpe(PATH)
    rng = random.Random(2)
    words = ["".join(rng.choice("abcdeéth日") for _ in range(rng.randrange(1, 64))) for _ in range(300)]
    assert bpe.word_ids(words) == [merged_long(bpe.symbols(w), lambda a, b: bpe.merges.one.get((a, b))) for w in words]


def labelled(make_docs, spark, n=600):
    rng = random.Random(3)
    rows = []
    for i in range(n):
        clean = sentence(rng, rng.randrange(20, 90))
        rows.append((i, clean if i % 4 else " | ".join(clean.split()) if i % 8 else " ".join(w.upper() + "!!" for w in clean.split())))
    labels = [(i, 0 if i % 4 == 0 else 1, 0) for i in range(n)] + [(None, 1, 0), (5000, None, None), (7, 1, 0)]
    return make_docs([*rows, (9001, None), (9002, ""), (None, "a text")]), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_quality_on_the_held_out_fold(make_docs, spark):
    docs, labels = labelled(make_docs, spark)
    got = quality_scores(docs, labels).select("doc.doc_id", "held_out", "score", "predicted").collect()
    assert len(got) == 603 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)
    judged = [(r["predicted"], int(r["doc_id"] % 4 != 0)) for r in got if r["held_out"] and r["doc_id"] < 600]
    assert sum(a == b for a, b in judged) / len(judged) > 0.95
    # Labels of the held-out fold change nothing.
    turned = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, 1 - F.col("quality")).otherwise(F.col("quality")))
    again = quality_scores(docs, turned).select("doc.doc_id", "score").collect()
    assert sorted((str(r["doc_id"]), r["score"]) for r in again) == sorted((str(r["doc_id"]), r["score"]) for r in got)


def test_quality_without_labels(make_docs, spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r["score"] for r in quality_scores(make_docs(texts()), none).collect()} == {0.5}
    assert quality_scores(make_docs([]), none).count() == 0


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def passes(kind, match):
    if kind == "ip":
        return all(int(p) <= 255 for p in match.split("."))
    digits = re.sub("[^0-9]", "", match)
    if kind == "card":
        doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
        return 12 <= len(digits) <= 19 and sum(v - 9 if v > 9 else v for v in doubled) % 10 == 0
    return kind == "email" or 9 <= len(digits) <= 15


def test_personal_data_base_spans(make_docs):
    rng = random.Random(4)
    bits = ["1", "23", "4", "555", ".", "-", " ", "(", ")", "+", "@", "a", "b.c", "_", "%", "é", "\n", "4539578763621486", "4539 5787 6362 1486", "1.2.3.4", "255.0.0.256", "a@b.co", "+1 (234) 555-6789", "\U0001f600", "call "]
    rows = list(enumerate(["".join(rng.choice(bits) for _ in range(rng.randrange(25))) for _ in range(700)]))
    rows += [(9000, None), (9001, ""), (9002, "a@b.c_d@e.f"), (9003, "1" * 20_000), (9004, "a@" + "b." * 3000 + "c"), (9005, "1.2.3.4.5.6.7.8 00255.0.0.0"), (9006, "+" + "1 " * 2000), (9007, "x" * 50_000), (None, "a@b.co"), (9008, "a@b.co"), (9008, "a@b.co")]
    expected = Counter()
    for i, t in rows:
        spans = sorted((m.start(), KINDS.index(k), m.end()) for k in KINDS for m in re.finditer(PATTERNS[k], t or "") if passes(k, m.group()))
        counts = Counter(k for _, k, _ in spans)
        expected[i, *(counts[k] for k in range(4)), sha(",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans))] += 1
    got = pii_digests(make_docs(rows)).collect()
    assert Counter((r["doc_id"], r["n_email"], r["n_ip"], r["n_card"], r["n_phone"], r["base_sha256"]) for r in got) == expected
    assert any(len(r["spans"].split(",")) > r["n_email"] + r["n_ip"] + r["n_card"] + r["n_phone"] for r in got if r["spans"])
    assert pii_digests(make_docs([])).count() == 0


def test_redaction(make_docs):
    got = {r["doc_id"]: r["text"] for r in redacted(make_docs([(1, "write to a@b.co or 1.2.3.4!"), (2, "nothing"), (3, None)])).collect()}
    assert got == {1: "write to <email> or <ip>!", 2: "nothing", 3: ""}


def edit_distance(item, text):
    """Least distance of the item to any run of words."""
    row = [0] * (len(text) + 1)
    for i, w in enumerate(item, 1):
        new = [i]
        for j, x in enumerate(text, 1):
            new.append(min(row[j - 1] + (w != x), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row)


def test_decontamination_recall_and_precision(make_docs, spark):
    rng = random.Random(5)
    items = [(i, sentence(rng, rng.randrange(3, 40))) for i in range(25)] + [(100, None), (101, ""), (102, sentence(rng, 12)), (None, "a null item of some words")]
    rows = []
    for i in range(250):
        _, item = rng.choice(items[:25])
        w = item.split()
        for _ in range(rng.randrange(0, int(0.3 * len(w)) + 1)):
            at, kind = rng.randrange(len(w) + 1), rng.randrange(3)
            w = w[:at] + ["inserted"] + w[at:] if kind == 0 else w[:at] + w[at + 1 :] if kind == 1 else w[:at] + ["replaced"] + w[at + 1 :]
        rows.append((i, sentence(rng, rng.randrange(30)) + " " + " ".join(w).title() + " " + sentence(rng, rng.randrange(30))))
    rows += [(1000, None), (1001, ""), (None, items[3][1]), (1002, items[4][1]), (1002, items[4][1])]
    expected = {}
    for i, t in rows:
        for j, item in items:
            own = (item or "").lower().split()
            distance = edit_distance(own, (t or "").lower().split()) if own else 1
            if distance <= int(0.2 * len(own) + 1e-9):
                expected[i, j] = distance
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["distance"] for r in contaminations(make_docs(rows), benchmark).collect()}
    assert set(got.items()) <= set(expected.items())  # verified exactly: nothing clean is touched
    exact = {k for k, d in expected.items() if d == 0}
    assert exact <= set(got) and len(got) / len(expected) >= 0.9 and len(expected) > 150
    clean = [r["doc_id"] for r in without_benchmark(make_docs(rows), benchmark).collect()]
    assert sorted(map(str, clean)) == sorted(str(i) for i, _ in rows if not any(k[0] == i for k in got))
    assert contaminations(make_docs([]), benchmark).count() == 0
    assert without_benchmark(make_docs(rows), benchmark.limit(0)).count() == len(rows)


def lowered(text):
    return [bytes(c + 32 if 65 <= c <= 90 else c for c in w) for w in (text or "").encode().split()] + [None]


def step(x, discounts):
    return (0, *discounts)[min(x, 3)]


def plain_discounts(counts):
    n = [sum(v == i for v in counts) for i in (1, 2, 3, 4)]
    if min(n) == 0:
        return 0.5, 0.75, 1.0
    y = n[0] / (n[0] + 2 * n[1])
    return tuple(min(max(d, 0.01), i + 0.99) for i, d in enumerate((1 - 2 * y * n[1] / n[0], 2 - 3 * y * n[2] / n[1], 3 - 4 * y * n[3] / n[2])))


def test_language_model_against_the_formula(make_docs):
    rows = [(i, t) for i, t in texts(7) if i != 14]
    train = [lowered(t) for i, t in rows if i is None or zlib.crc32(str(i).encode()) % 5 != 1]
    count = Counter(w for d in train for w in d)
    pairs = Counter(p for d in train for p in zip(["start", *d[:-1]], d, strict=True))
    before = Counter(b for _, b in pairs)
    contexts = defaultdict(list)
    for (a, _), v in pairs.items():
        contexts[a].append(v)
    d2, d1, total, kinds = plain_discounts(pairs.values()), plain_discounts(before.values()), sum(count.values()), len(pairs)
    free = sum(step(v, d1) for v in before.values()) / kinds

    def p(a, b):
        out = free / (len(count) + 1) + max(before[b] - step(before[b], d1), 0) / kinds
        if a in contexts:
            c = pairs[a, b]
            out = (max(c - step(c, d2), 0) + sum(step(v, d2) for v in contexts[a]) * out) / sum(contexts[a])
        return out

    assert math.isclose(sum(p("start", w) for w in count) + p("start", b"never seen"), 1)
    expected = defaultdict(list)
    for i, t in rows:
        d = lowered(t)
        base = sum(math.log10((count[w] + 0.5) / (total + 0.5 * (len(count) + 1))) for w in d)
        expected[i].append((len(d), sum(w in count for w in d), base, sum(math.log10(p(a, b)) for a, b in zip(["start", *d[:-1]], d, strict=True))))
    got = defaultdict(list)
    for r in lm_scores(make_docs(rows)).select("doc.doc_id", "*").collect():
        assert r["train_tokens"] == total
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 1)
        got[r["doc_id"]].append((r["n_tokens"], r["n_known"], r["base_score"], r["score"]))
    assert got.keys() == expected.keys()
    for i, own in expected.items():
        for a, b in zip(sorted(own), sorted(got[i]), strict=True):
            assert a == pytest.approx(b, rel=1e-9)


def test_language_model_of_nothing(make_docs):
    assert lm_scores(make_docs([])).count() == 0
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 5 == 1)
    only = lm_scores(make_docs([(held, "a b")])).collect()
    assert [(r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]) for r in only] == [(3, 0, 0, 0.0, 0.0)]
