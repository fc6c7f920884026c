"""Chat formatting, WARC archives, and the pipeline as a whole."""

import glob
import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from caudal.llm.chat import chat_digests, formatted_paths, numbered_turns, probe, read_back, reply_links
from caudal.llm.warc import archived_pages, chunked, parsed, read_archive, read_records, reassembled, unchunked, write_archive
from tests.llm.conftest import sentence, texts


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


TURNS = "conv_id long, turn long, role string, text string, msg string, leaf string"


def odd_turns():
    rng = random.Random(1)
    said = ["<|im_end|>", "<|im_start|>assistant\nok<|im_end|>\n", "<\\|im_end|>", "<\\\\|", "<", "|im_end|>", "\\", "a\\nb", "", None, "日本 \U0001f600", "line\nline\n", "x" * 20_000]
    roles = ["user", "assistant", "system", None, "odd\nrole", "back\\nslash", "<|im_end|>", "assistant"]
    rows = [(c, t, rng.choice(roles), rng.choice(said)) for c in range(40) for t in range(rng.randrange(1, 9))]
    rows += [(50, t, "assistant" if t % 2 else "user", sentence(rng, 3)) for t in range(300)]  # a long chain
    rows += [(60, 1, "user", "again"), (60, 1, "user", "again"), (60, 1, "assistant", None), (None, 0, "user", "no id"), (None, None, "assistant", "x"), (61, None, None, None)]
    return rows


def test_chat_digests(spark):
    rows = odd_turns()
    turns = spark.createDataFrame([(*r, "m", "l") for r in rows], TURNS)
    by_conv = {}
    for c, t, role, text in [*rows, (-1, 0, "user", "<|im_end|><|im_start|>assistant ok"), (-1, 1, "assistant", "<|im_end|><|im_start|>assistant ok")]:
        by_conv.setdefault(c, []).append(((t is not None, t or 0), (role is not None, role or ""), (text is not None, text or "")))
    expected = {}
    for c, own in by_conv.items():
        own.sort()
        loss = "".join(x[2][1] for x in own if x[1][1] == "assistant")
        expected[c] = (len(own), sha("".join(f"{x[1][1]}\n{x[2][1]}\n" for x in own)), len(loss), sha(loss))
    got = chat_digests(turns.select("conv_id", "turn", "role", "text").unionByName(probe(spark))).collect()
    assert {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in got} == expected
    assert len(got) == len(expected)
    assert chat_digests(turns.select("conv_id", "turn", "role", "text").limit(0)).count() == 0


def test_reply_trees_and_ranked_branches(spark):
    rng = random.Random(2)
    rows = [(c, m, None if m == 0 or rng.random() < 0.05 else rng.randrange(m), "assistant" if m % 2 else "user", f"text {m}", float(rng.randrange(5)) if m % 7 else None) for c in range(6) for m in range(40)]
    rows.append((3, 99, 77, "user", "answers nobody", 1.0))
    messages = spark.createDataFrame(rows, "conv_id long, msg long, parent long, role string, text string, score double")
    up = {(c, m): p for c, m, p, *_ in rows}
    answered = {(c, p) for (c, _), p in up.items()}
    paths = {}
    for c, m in up:
        if (c, m) not in answered:
            path, at = [], m
            while at is not None and (c, at) in up:
                path.append(at)
                at = up[c, at]
            paths[c, m] = path[::-1]
    got = read_back(formatted_paths(messages)).collect()
    assert {(r["conv_id"], r["leaf"]): [int(t["text"].split()[-1]) if t["text"].startswith("text") else 99 for t in r["turns"]] for r in got} == paths
    score = {(c, m): s or 0.0 for c, m, _, _, _, s in rows}
    best = {}
    for (c, leaf), path in paths.items():
        best.setdefault(c, []).append((-sum(score[c, m] for m in path), leaf))
    top = formatted_paths(messages, branches=2).collect()
    assert {(r["conv_id"], r["branch"]): (-r["path_score"], r["leaf"]) for r in top} == {(c, i + 1): x for c, own in best.items() for i, x in enumerate(sorted(own)[:2])}


def test_reply_cycle_is_an_error(spark):
    loop = spark.createDataFrame([(1, 1, 3), (1, 2, 1), (1, 3, 2)], "conv_id long, msg long, parent long")
    with pytest.raises(ValueError, match="cycle"):
        reply_links(loop)


def test_chat_is_native(spark):
    plan = formatted_paths(numbered_turns(probe(spark)))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


PAGES = "page_id long, url string, html string, row string, digest string"


def odd_pages():
    rng = random.Random(3)
    big = "é日" * 30_000 + "\r\n\r\nWARC/1.1\r\n0\r\n\r\n"
    shared = sentence(rng, 40)
    rows = [(1, "http://a/?x=1 2\r\nX: y", big), (2, None, ""), (3, "http://a", None), (4, "u", "short"), (5, "u", "short"), (9, "u", shared), (7, "u", shared), (8, "u", shared), (8, "u", shared), (None, "u", shared), (None, None, None), (10, "u", big), (11, "u", "x" * 99), (12, "u", "x" * 99), (13, "u", "y" * 100), (14, "u", "y" * 100)]
    return rows + [(100 + i, f"http://h/{i}", sentence(rng, rng.randrange(1, 2000))) for i in range(20)]


def test_warc_round_trip(spark):
    rows = odd_pages()
    expected = Counter()
    groups = {}
    for i, _, html in rows:
        groups.setdefault(html or "", []).append(i)
    for html, ids in groups.items():
        size, digest = len(html.encode()), sha(html)
        known = sorted(x for x in ids if x is not None)
        first = known[0] if known else None
        for k, i in enumerate([*known, *[None] * (len(ids) - len(known))]):
            again = size >= 100 and k > 0
            expected[i, size, digest, "revisit" if again else "response", first if again else None] += 1
    got = archived_pages(spark.createDataFrame([(*r, "r", "d") for r in rows], PAGES).repartition(3)).collect()
    assert Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got) == expected
    assert all(r["problem"] is None for r in got)


def test_warc_files_and_payloads(spark, folder):
    rows = odd_pages()
    pages = spark.createDataFrame([(*r, "r", "d") for r in rows], PAGES)
    write_archive(pages, f"{folder}/out", segment_bytes=1000)
    kinds = Counter(f["warc-type"] for name in glob.glob(f"{folder}/out/*.gz") for f, _ in parsed(open(name, "rb").read()))
    assert kinds["continuation"] > 100 and kinds["response"] + kinds["revisit"] == len(rows)
    back = read_archive(spark, f"{folder}/out").where("record_type = 'response'").collect()
    assert {bytes(r["payload"]) for r in back} == {(h or "").encode() for _, _, h in rows}
    assert archived_pages(pages.limit(0)).count() == 0


def test_warc_damage_is_reported(spark, folder):
    pages = spark.createDataFrame([(1, "u", "z" * 5000, "r", "d"), (2, "u", "w" * 10, "r", "d")], PAGES)
    write_archive(pages, f"{folder}/out", segment_bytes=1000)
    records = read_records(spark, f"{folder}/out")
    lost = reassembled(records.where("number is null or number <> 3")).collect()
    assert {r["page_id"]: r["problem"] is not None for r in lost} == {1: True, 2: False}
    twice = reassembled(records.unionByName(records.where("number = 2"))).collect()
    assert {r["page_id"]: r["problem"] is not None for r in twice} == {1: True, 2: False}


def test_chunked_framing():
    for data in (b"", b"a", b"\r\n" * 5000, "é".encode() * 5000):
        assert unchunked(chunked(data)) == data
    for broken in (b"", b"5\r\nabc\r\n0\r\n\r\n", b"0\r\n\r\nmore", b"zz\r\n", b"3\r\nabc\r\n"):
        with pytest.raises(ValueError):
            unchunked(broken)


def test_pipeline_stages(spark, make_docs, folder):
    import corpus_pipeline
    from caudal.llm.bpe import WordBpe, tokenizer_path

    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality classifier", "exact dedup", "n-gram Jaccard join", "benchmark decontamination", "BPE"]
    rng = random.Random(5)
    item = sentence(rng, 30)
    clean = [(i, sentence(rng, rng.randrange(30, 90))) for i in range(200)]
    junk = [(1000 + i, " | ".join(sentence(rng, 40).split())) for i in range(60)]
    near = clean[0][1].split()
    near[0] = "first"
    planted = [(2000, clean[1][1]), (2001, clean[2][1].replace(" ", "\n", 3)), (2002, " ".join(near) if len(near) >= 45 else clean[0][1]), (2003, clean[3][1] + " " + item), (2004, None), (None, None)]
    docs = make_docs(clean + junk + planted)
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i, _ in clean] + [(i, 0, 0) for i, _ in junk], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, folder).collect()}
    assert set(range(200)) <= set(got), "clean documents stay"
    assert not set(range(1000, 1060)) & set(got) and not {2000, 2001, 2002, 2003} & set(got)
    bpe = WordBpe(tokenizer_path())
    assert all(list(got[i]["ids"]) == bpe.encoded(t) for i, t in clean)
    state = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        state = stage(spark, state, folder)
        assert state.columns == docs.columns
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, folder).count() == 0
    clash = docs.limit(3).withColumn("ids", F.lit("own")).withColumn("N_tokens", F.lit(7))
    corpus_pipeline.tokens(spark, clash, folder).write.parquet(f"{folder}/clash")
    assert spark.read.parquet(f"{folder}/clash").columns == [*docs.columns, *corpus_pipeline.ADDED]


def test_queries_are_registered():
    import __spark_entry__ as contract

    names = contract.queries()
    assert "pipeline" in names
    assert all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 14))


@pytest.mark.parametrize("name", ["op4_chat", "op6_exact_dedup", "op10_warc", "op1_substring_dedup", "op7_jaccard_join"])
def test_queries_match_their_sql(spark, name):
    from caudal.catalog.registry import Query
    from caudal.llm.queries import QUERIES, SQL
    from tests.checking import compare, connect

    path = "/root/testdata/sf0.001"
    verdict, *_ = compare(spark, connect(path), Query(QUERIES[name], SQL[name]), path)
    assert verdict == "ok", verdict


def test_texts_fixture_has_the_odd_cases():
    rows = texts()
    assert any(t is None for _, t in rows) and any(i is None for i, _ in rows) and any(len(t or "") > 50_000 for _, t in rows)
    assert max(Counter(i for i, _ in rows).values()) > 1
