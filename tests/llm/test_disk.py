"""What is no longer read is deleted: tables between steps and stages, and no profile is written once for each list."""

import os
import random

import pyarrow as pa

import corpus_pipeline
from caudal.llm import jaccard
from caudal.llm.tables import shared_path
from tests.llm.conftest import sentence


def left(spark) -> set[str]:
    folder = os.path.dirname(shared_path(spark, "any"))
    return set(os.listdir(folder)) if os.path.isdir(folder) else set()


def test_jaccard_gives_its_tables_back(spark, make_docs, monkeypatch):
    rng = random.Random(3)
    texts = [sentence(rng, 120).split() for _ in range(3)]
    rows = [(100 * k + i, " ".join([*words[:i], f"other{i}", *words[i + 1 :]])) for k, words in enumerate(texts) for i in range(12)]
    given, columns = jaccard.settled, {}

    def settled(df, name):
        columns[name] = df.columns
        return given(df, name)

    monkeypatch.setattr(jaccard, "settled", settled)
    before = left(spark)
    got = jaccard.near_duplicates(make_docs(rows), jaccard.Rule(shingle=3, percent=80), first=1).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == {i: i - i % 100 for i, _ in rows}
    assert "profile" in columns["set-texts"]
    assert not [n for n, c in columns.items() if n != "set-texts" and {"profile", "text"} & set(c)]
    kept = {n.rsplit("-", 1)[0] for n in left(spark) - before}
    assert "named-sets" in kept and not kept & {"list-entries", "long-lists", "shared-entries", "sought-sets", "set-texts", "list-lengths", "mixed-lists", "mixed-members"}


def near_rows(groups: int = 3, copies: int = 12) -> list[tuple[int, str]]:
    """Groups of texts that differ by a word each."""
    rng = random.Random(3)
    texts = [sentence(rng, 120).split() for _ in range(groups)]
    return [(100 * k + i, " ".join([*words[:i], f"other{i}", *words[i + 1 :]])) for k, words in enumerate(texts) for i in range(copies)]


def test_lists_with_the_same_members_are_compared_once(spark, make_docs, monkeypatch):
    given, lists = jaccard.settled, {}

    def settled(df, name):
        out = given(df, name)
        if name in ("list-entries", "shared-entries"):
            lists[name] = [frozenset((r["set_a"], r["set_b"]) for r in rows) for rows in by_key(out).values()]
        return out

    def by_key(df):
        out = {}
        for r in df.collect():
            out.setdefault(r["key"], []).append(r)
        return out

    monkeypatch.setattr(jaccard, "settled", settled)
    got = jaccard.near_duplicates(make_docs(near_rows()), jaccard.Rule(shingle=3, percent=80)).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == {i: i - i % 100 for i, _ in near_rows()}
    several = [x for x in lists["list-entries"] if len(x) > 1]
    assert len(set(lists["shared-entries"])) == len(lists["shared-entries"]) < len(several)
    assert set(lists["shared-entries"]) == set(several)


def test_only_lists_that_left_pairs_out_go_into_a_further_round(spark, monkeypatch):
    """One list of nine sets in two components gives two pairs and its key, one of three gives all that it has."""
    rule = jaccard.Rule(shingle=3, percent=80)
    bits = bytes(jaccard.PROFILE // 8)
    rows = [(7, 0, i, i, i % 2, 0, 50, bits, 0) for i in range(9)] + [(8, 0, 20 + i, i, min(i, 1), 0, 50, bits, 0) for i in range(3)]
    names = ["key", "block", "set_a", "set_b", "component_a", "component_b", "size", "profile", "side"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int32()]
    batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
    out = [r for b in jaccard.candidate_pairs(iter([batch]), rule, 2) for r in b.to_pylist()]
    assert [r["key"] for r in out if r["u_a"] is None] == [7]
    assert sorted((r["u_a"], r["v_a"]) for r in out if r["u_a"] is not None and r["u_a"] >= 20) == [(20, 21), (20, 22)]
    assert sum(r["u_a"] is not None and r["u_a"] < 20 for r in out) == 2


def test_rows_with_company_over_batches():
    rng = random.Random(5)
    for _ in range(200):
        keys = sorted(rng.choices(range(rng.choice([3, 12, 60])), k=rng.randrange(30)))
        rows = pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(range(len(keys)), pa.int64())], ["key", "set_a"])
        cuts = sorted([0, len(keys), *rng.choices(range(len(keys) + 1), k=5)])  # some batches are empty
        batches = [rows.slice(x, y - x) for x, y in zip(cuts, cuts[1:], strict=False)]
        got = [r["set_a"] for b in jaccard.with_company(iter(batches)) for r in b.to_pylist()]
        assert got == [i for i, k in enumerate(keys) if keys.count(k) > 1]


def test_pipeline_deletes_what_the_next_stage_has_read(spark, make_docs, folder, monkeypatch):
    make_docs([(i, f"text {i}") for i in range(20)]).write.parquet(f"{folder}/documents.parquet")
    stages = [(name, lambda spark, docs, sf_dir, k=k: docs.where(f"doc_id >= {k}")) for k, name in enumerate(["first step", "second step", "third step", "last"])]
    monkeypatch.setattr(corpus_pipeline, "STAGES", stages)
    before = left(spark)
    assert sorted(r["doc_id"] for r in corpus_pipeline.run(spark, folder).collect()) == list(range(3, 20))
    assert {n.rsplit("-", 1)[0] for n in left(spark) - before} == {"third-step"}
    assert spark.read.parquet(f"{folder}/documents.parquet").count() == 20
