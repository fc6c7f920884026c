"""Alignment of two tokenizers against all pairs of tokens, in one piece and in many."""

import hashlib
import json
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer, models, pre_tokenizers

from caudal.llm.alignment import PATTERN, aligned, crossings, tokenizers
from caudal.llm.queries import QUERIES
from tests.llm.conftest import sentence, texts

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def gpt_bytes():
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in keep]
    return {chr(b): b for b in keep} | {chr(256 + k): b for k, b in enumerate(rest)}


def plain(rows):
    """The same by comparing every A token with every B token."""
    library, pieces, symbol = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B), gpt_bytes()
    library.encode_special_tokens = True
    docs, links = [], Counter()
    for doc_id, text in rows:
        a, b = (library.encode(" " + text, add_special_tokens=False).ids, pieces.encode(text)) if text else ([], [])
        sizes = [[len(library.id_to_token(i)) for i in a], [1 if pieces.is_byte(i) else len(pieces.id_to_piece(i).replace("▁", " ").encode()) for i in b]]
        spelled = [bytes(symbol[c] for i in a for c in library.id_to_token(i)), b"".join(bytes([int(pieces.id_to_piece(i)[3:5], 16)]) if pieces.is_byte(i) else pieces.id_to_piece(i).replace("▁", " ").encode() for i in b)]
        if text and spelled != [(" " + text).encode()] * 2:
            a, b, sizes = [], [], [[], []]
        spans = []
        for side in sizes:
            ends = np.cumsum(side).astype(int).tolist() if side else []
            spans.append(list(zip([0, *ends], ends, strict=False)))
        pairs = []
        j = 0
        for i, (s, e) in enumerate(spans[0]):
            while j and spans[1][j][0] > s or j == len(spans[1]):
                j -= 1
            k = j
            while k < len(spans[1]) and spans[1][k][0] < e:
                if spans[1][k][1] > s:
                    pairs.append((a[i], b[k]))
                j, k = k, k + 1
        links.update(pairs)
        both = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
        groups, low = [], 0
        for to in both:
            inside = [",".join(str(i) for i, (s, e) in zip(ids, span, strict=True) if low <= s and e <= to) for ids, span in zip((a, b), spans, strict=True)]
            groups.append("|".join(inside))
            low = to
        docs.append((doc_id, len(a), len(b), len(both), pairs, ";".join(groups)))
    best = defaultdict(int)
    for (_, y), n in links.items():
        best[y] = max(best[y], n)
    return Counter((i, na, nb, ng, len(p), sum(links[x] == best[x[1]] for x in p), sum(links[x] for x in p), g) for i, na, nb, ng, p, g in docs)


def odd_rows():
    rng = random.Random(4)
    alphabet = "aab eé\n\t  日本\U0001f600▁<0x0A>'s1²Ωß-\x00\x85\xa0"
    rows = [(i, t if t is None or len(t) < 5000 else t[:400]) for i, t in texts()]
    return rows + [(100 + i, "".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 60)))) for i in range(150)] + [(300, "<|endoftext|> <s></s><unk>"), (301, " "), (302, "  two"), (303, sentence(rng, 250))]


@pytest.mark.parametrize(("piece", "hot"), [(1 << 15, 1 << 18), (7, 1 << 18), (1, 0), (64, 20)])
def test_all_pairs(make_docs, piece, hot):
    rows = odd_rows()
    expected = plain(rows)
    assert Counter(tuple(r) for r in aligned(make_docs(rows), A, B, piece=piece, hot=hot).collect()) == expected
    digests = Counter({r[:-1] + (hashlib.sha256(r[-1].encode()).hexdigest() if r[-1] else "",): n for r, n in expected.items()})
    assert Counter(tuple(r) for r in aligned(make_docs(rows), A, B, digest=True, piece=piece, hot=hot).collect()) == digests


def test_long_text_in_pieces(make_docs):
    rows = [(1, "x" * 50_000), (2, sentence(random.Random(1), 30_000)), (3, None)]
    whole, cut = (sorted(tuple(r) for r in aligned(make_docs(rows), A, B, piece=p).collect()) for p in (1 << 30, 1000))
    assert whole == cut and whole[0][1] > 1000 and whole[2][1:] == (0, 0, 0, 0, 0, 0, "")
    assert aligned(make_docs([]), A, B).count() == 0


def test_diagonals():
    rng = np.random.default_rng(3)
    for _ in range(50):
        a, b = (np.cumsum(rng.integers(1, 4, rng.integers(0, 40))) for _ in range(2))
        order = sorted([(x, 0) for x in a] + [(x, 1) for x in b])
        d = np.arange(len(order) + 1)
        assert crossings(a, b, d).tolist() == [sum(side == 0 for _, side in order[:k]) for k in d]


def test_ranks_agree_with_the_library():
    both = tokenizers(A, B)
    assert both.ranked is not None
    rng = random.Random(6)
    latin = [chr(c) for c in range(0x250)]
    tests = ["".join(rng.choice(latin) for _ in range(rng.randrange(1, 12))) for _ in range(20_000)] + ["".join(rng.choice(" \n\ta'sS1.é\xa0\x85\x1c") for _ in range(rng.randrange(1, 14))) for _ in range(20_000)]
    assert [both.ranked.encode_ordinary(t) for t in tests] == [e.ids for e in both.library.encode_batch(tests, add_special_tokens=False)]
    assert PATTERN == public_tokenizers.PATTERN


def test_other_order_of_ids_uses_the_library(tmp_path):
    symbols = sorted(gpt_bytes())
    vocab = {s: i for i, s in enumerate(symbols)} | {"ab": 300, "abc": 299}
    small = Tokenizer(models.BPE(vocab=vocab, merges=[("a", "b"), ("ab", "c")]))
    small.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False)
    small.save(str(tmp_path / "a.json"))
    both = tokenizers(str(tmp_path / "a.json"), B)
    assert both.ranked is None and [a.tolist() for a, _ in both.tokens(["abc"])][0][-1] == 299
    assert json.loads((tmp_path / "a.json").read_text())["model"]["vocab"]["abc"] == 299


def test_query(spark):
    out = QUERIES["op11_alignment"](spark, "/root/testdata/sf0.001")
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    expected = Counter({r[:-1] + (hashlib.sha256(r[-1].encode()).hexdigest() if r[-1] else "",): n for r, n in plain(rows).items()})
    assert Counter(tuple(r) for r in out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()) == expected
