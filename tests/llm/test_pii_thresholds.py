"""Thresholds of rare kinds beside a hot one, from all candidates that the trees don't see."""

from collections import defaultdict

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from caudal.llm import pii


def described(spark, counts):
    """Candidates of which half agree with a base span; one feature tells them apart, but for one in twenty."""
    rows = None
    for number, (kind, n) in enumerate(counts.items()):
        same = F.pmod(F.xxhash64("id", F.lit("same")), F.lit(2)) == 0
        odd = F.pmod(F.xxhash64("id", F.lit("odd")), F.lit(20)) == 0
        part = spark.range(number * 1_000_000, number * 1_000_000 + n).select(
            F.col("id").alias("row"), F.lit(kind).alias("kind"), F.lit(0).alias("start"), F.lit(9).alias("end"), (same != odd).cast("double").alias("f_seen"), F.lit(float(number)).alias("f_kind"), same.alias("same"), same.alias("touches")
        )
        rows = part if rows is None else rows.unionByName(part)
    return rows


def test_rare_kinds_have_thresholds_of_all_their_candidates(spark, monkeypatch):
    monkeypatch.setattr(pii, "SAMPLE", 100)
    given = described(spark, {"card": 6000, "email": 60, "ip": 300, "phone": 40}).cache()
    model, thresholds = pii.fit(given)
    assert set(thresholds) == set(pii.KINDS)
    ranked = given.withColumn("rank", F.xxhash64("row", "kind", "start", "end"))
    scored = model.transform(pii.assembled(ranked)).select("kind", "rank", F.round(vector_to_array("probability")[1], 3).alias("score"), "same").collect()
    by_kind = defaultdict(list)
    for r in scored:
        by_kind[r["kind"]].append(r)
    for kind, own in by_kind.items():
        own.sort(key=lambda r: r["rank"])
        seen = {r["rank"] for r in own[:100] if r["rank"] % 5}
        judged = [r for r in own if r["rank"] not in seen]
        assert len(judged) >= len(own) - 100
        fine = [s for s in {r["score"] for r in judged} if sum(r["same"] for r in judged if r["score"] >= s) >= pii.PRECISION * sum(r["score"] >= s for r in judged)]
        assert thresholds.get(kind) == (min(fine) if fine else None)
