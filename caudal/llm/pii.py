"""Personal data by candidate gradient boosting, with DataFrame functions only.

1. Islands. Two scans cut each text into maximal runs of the characters that addresses or numbers are made of. No match of
   any pattern below crosses the edge of an island, so all else works on short strings.
2. Base spans: the strict patterns and checks (at most 255 in an address part, Luhn, numbers of digits). They always count.
3. Candidates. High-recall generators propose spans that may overlap, of any length and format.
4. Boosted trees judge candidates by format (digits, groups, separators, brackets, edges) and context (words before). They
   learn from candidates that agree with a base span against those that touch none; the checks themselves are no features.
   The model is fitted on at most `SAMPLE` candidates of each kind, those with the least hash, a fifth of them left out.
5. Thresholds. For each kind the lowest score at which, of all candidates that training doesn't see, `PRECISION` agree
   with a base span. Candidates above it that touch no base span are redacted too.

Defined results: null is empty and has no spans; a text of any length is scanned whole; a null doc_id and repeated rows are
handled row by row; where the sample has candidates of one sort only, or none, base spans alone are redacted; an empty
table gives an empty table; further columns pass through inside `doc`.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from caudal.llm.tables import numbered, settled

SAMPLE = 20_000  # candidates of each kind that the trees may see
TREES, DEPTH = 20, 4
PRECISION = 0.9
KINDS = ["email", "ip", "card", "phone"]

# Quantifiers are possessive and starts are tied to the edge of a run where that changes no match: long runs stay linear.
LOCAL = "A-Za-z0-9._%+-"
ISLANDS = {"address": f"(?<![{LOCAL}@])[{LOCAL}]*+@[{LOCAL}@]*+", "number": r"[0-9+(][0-9+ ().-]*+"}
BASE = {
    "email": rf"(?:(?<![{LOCAL}])|\G)[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
LOOSE = {
    "email": f"[{LOCAL}]++@[{LOCAL}]*+",
    "ip": r"(?<![0-9])[0-9]{1,5}+(?:\.[0-9]{1,5}+){2,9}+",
    "card": r"[0-9](?:[ .-]{0,2}[0-9]){7,30}+",
    "phone": r"[+(]{0,2}+[0-9](?:[ ().-]{0,3}[0-9]){5,20}+",
}
PART = r"^0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{0,2})$"
CONTEXT = {"named": r"(?i)(?:mail|call|tel|phone|fax|card|visa|pay|address|host|server|ip)\W*$", "coded": r"(?i)(?:token|key|version|license|id|no|sha|hash|isbn)\W*$", "quoted": r"[\"'=#]\s*$", "worded": r"[\p{L}]\s*$"}


def found(text: F.Column, pattern: str) -> F.Column:
    """Non-overlapping matches from left to right: start (code points), match, and what lies before and after."""
    pieces, hits = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.zip_with(hits, F.slice(pieces, 1, F.size(hits)), lambda h, p: F.struct(h.alias("hit"), p.alias("before")))
    between = F.zip_with(between, F.slice(pieces, 2, F.size(hits)), lambda b, n: F.struct(b["hit"].alias("hit"), F.right(b["before"], F.lit(24)).alias("before"), F.length(b["before"]).alias("gap"), F.left(n, F.lit(8)).alias("after")))
    kind = "struct<at:int,out:array<struct<at:int,text:string,before:string,after:string>>>"
    start = F.struct(F.lit(0).alias("at"), F.array().alias("out")).cast(kind)

    def step(state, b):
        at = state["at"] + b["gap"]
        return F.struct((at + F.length(b["hit"])).alias("at"), F.array_append(state["out"], F.struct(at.alias("at"), b["hit"].alias("text"), b["before"].alias("before"), b["after"].alias("after"))).alias("out"))

    return F.aggregate(between, start, step)["out"]


def digits(text: F.Column) -> F.Column:
    return F.regexp_replace(text, "[^0-9]+", "")


def luhn(text: F.Column) -> F.Column:
    doubled = F.transform(F.filter(F.split(F.reverse(text), ""), lambda c: c != ""), lambda c, i: c.cast("int") * (1 + i % 2))
    return F.aggregate(doubled, F.lit(0), lambda a, v: a + F.when(v > 9, v - 9).otherwise(v)) % 10 == 0


def passes(kind: str, text: F.Column) -> F.Column:
    """The check on a match of the strict pattern."""
    if kind == "ip":
        return F.forall(F.split(text, r"\."), lambda p: p.rlike(PART))
    if kind == "card":
        number = digits(text)
        return F.when(F.length(number).between(12, 19), luhn(number)).otherwise(False)
    if kind == "phone":
        return F.length(digits(text)).between(9, 15)
    return F.lit(True)


def candidates(islands: DataFrame) -> DataFrame:
    """(row, island, kind, base, start, end, text, before, after) from settled (row, islands)."""
    one = islands.select("row", F.posexplode("islands").alias("number", "i")).select("row", F.col("number").alias("island"), "i.sort", "i.at", "i.text", "i.before", "i.after")

    def spans(kind: str, pattern: str, base: bool) -> F.Column:
        hits = found(F.col("text"), pattern)
        hits = F.filter(hits, lambda h: passes(kind, h["text"])) if base else hits
        return F.transform(hits, lambda h: F.struct(
            F.lit(kind).alias("kind"), F.lit(base).alias("base"), (F.col("at") + h["at"]).alias("start"), (F.col("at") + h["at"] + F.length(h["text"])).alias("end"), h["text"].alias("text"),
            F.concat(F.col("before"), h["before"]).alias("before"), F.concat(h["after"], F.col("after")).alias("after"),
        ))

    by_sort = {"address": ["email"], "number": ["ip", "card", "phone"]}
    arrays = {sort: F.concat(*[spans(k, p[k], base) for k in kinds for p, base in ((BASE, True), (LOOSE, False))]) for sort, kinds in by_sort.items()}
    found_spans = F.when(F.col("sort") == "address", arrays["address"]).otherwise(arrays["number"])
    return one.select("row", "island", F.explode(found_spans).alias("s")).select("row", "island", "s.*")


def with_features(spans: DataFrame) -> DataFrame:
    """Numbers that describe format and context, and how a candidate lies to the base spans of its island: `same` as one of
    its kind, or touching one (`touches`). The rows of an island are few and are gathered with it."""
    bases = F.collect_list(F.when(F.col("base"), F.struct("kind", "start", "end"))).over(Window.partitionBy("row", "island"))
    near = spans.withColumn("bases", bases).where("not base").dropDuplicates(["row", "island", "kind", "start", "end"])
    text = F.col("text")
    groups = F.filter(F.split(text, "[^0-9]+"), lambda g: g != "")
    sizes = F.transform(groups, lambda g: F.length(g))
    count = lambda pattern: F.length(text) - F.length(F.regexp_replace(text, pattern, ""))
    numbers = {
        "n_digits": F.length(digits(text)), "n_groups": F.size(groups), "longest": F.coalesce(F.array_max(sizes), F.lit(0)), "shortest": F.coalesce(F.array_min(sizes), F.lit(0)), "size": F.least(F.length(text), F.lit(200)),
        "spaces": count(" "), "hyphens": count("-"), "dots": count(r"\."), "brackets": count("[()]"), "pluses": count(r"\+"), "ats": count("@"), "letters": count("[A-Za-z]"),
        "domain_dots": F.size(F.split(F.substring_index(text, "@", -1), r"\.")) - 1, "last_label": F.length(F.regexp_extract(text, "[A-Za-z]*$", 0)),
        "open_left": F.col("before").rlike(r"[\p{L}\p{N}._-]$"), "open_right": F.col("after").rlike(r"^[\p{L}\p{N}@_-]"), **{name: F.col("before").rlike(p) for name, p in CONTEXT.items()},
        **{f"is_{k}": F.col("kind") == k for k in KINDS},
    }
    own = F.struct("kind", "start", "end")
    lie = {"same": F.array_contains("bases", own), "touches": F.exists("bases", lambda b: (b["start"] < F.col("end")) & (b["end"] > F.col("start")))}
    return near.select("row", "kind", "start", "end", *[F.coalesce(v.cast("double"), F.lit(0.0)).alias(f"f_{n}") for n, v in numbers.items()], *[v.alias(n) for n, v in lie.items()])


def assembled(candidates: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=[c for c in candidates.columns if c.startswith("f_")], outputCol="features").transform(candidates)


def fit(described: DataFrame) -> tuple[GBTClassificationModel, dict[str, float]] | None:
    """The trees and the threshold of each kind; None where there is nothing to tell apart."""
    usable = described.where("same or not touches").withColumn("label", F.col("same").cast("double")).withColumn("rank", F.xxhash64("row", "kind", "start", "end"))
    sample = None
    for kind in KINDS:
        part = usable.where(F.col("kind") == kind).orderBy("rank", "row", "start", "end").limit(SAMPLE)
        sample = part if sample is None else sample.unionByName(part)
    sample = settled(sample, "pii-sample")
    held_out = F.pmod("rank", F.lit(5)) == 0
    labels = sample.where(~held_out).agg(F.min("label"), F.max("label")).first()
    if labels[0] is None or labels[0] == labels[1]:
        return None
    model = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, seed=11, checkpointInterval=-1).fit(assembled(sample.where(~held_out)))
    # All other candidates are judged: the fifth, and what lies above the last hash of the sample of its kind.
    last = {r["kind"]: r["rank"] for r in sample.groupBy("kind").agg(F.max("rank").alias("rank")).collect()}
    beyond = F.col("rank") > F.create_map(*[x for k, v in last.items() for x in (F.lit(k), F.lit(v))])[F.col("kind")]
    judged = model.transform(assembled(usable.where(held_out | beyond))).select("kind", F.round(vector_to_array("probability")[1], 3).alias("score"), "label")
    at = judged.groupBy("kind", "score").agg(F.sum("label").alias("right"), F.count(F.lit(1)).alias("all"))  # a thousand scores a kind at most
    above = Window.partitionBy("kind").orderBy(F.col("score").desc())
    precise = at.withColumn("precision", F.sum("right").over(above) / F.sum("all").over(above)).where(F.col("precision") >= PRECISION)
    return model, {r["kind"]: r["score"] for r in precise.groupBy("kind").agg(F.min("score").alias("score")).collect()}


def private_spans(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, spans (kind, start, end, base), ordered by start and kind."""
    text = F.coalesce("text", F.lit(""))

    def cut_by(sort: str) -> F.Column:
        return F.transform(found(text, ISLANDS[sort]), lambda h: F.struct(F.lit(sort).alias("sort"), h["at"].alias("at"), h["text"].alias("text"), h["before"].alias("before"), h["after"].alias("after")))

    cut = F.concat(*map(cut_by, ISLANDS))
    islands = settled(numbered(docs.select("doc_id", cut.alias("islands"))), "pii-islands")
    spans = settled(candidates(islands), "pii-candidates")
    described = settled(with_features(spans), "pii-described")
    base = spans.where("base").select("row", "kind", "start", "end", F.lit(True).alias("base"))
    fitted = fit(described)
    chosen = base
    if fitted is not None:
        model, thresholds = fitted
        least = F.coalesce(F.create_map(*[x for k, t in thresholds.items() for x in (F.lit(k), F.lit(t))])[F.col("kind")], F.lit(2.0)) if thresholds else F.lit(2.0)
        added = model.transform(assembled(described.where("not touches"))).where(F.round(vector_to_array("probability")[1], 3) >= least)
        chosen = base.unionByName(added.select("row", "kind", "start", "end", F.lit(False).alias("base")))
    place = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    # A group is one document's own spans.
    grouped = chosen.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", place.alias("place"), "end", "kind", "base"))).alias("spans"))
    return islands.select("row", "doc_id").join(grouped, "row", "left").select("doc_id", F.coalesce("spans", F.array().cast(grouped.schema["spans"].dataType)).alias("spans"))


def pii_digests(docs: DataFrame) -> DataFrame:
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["base"])
    counted = lambda kind: F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == kind))).cast("long").alias(f"n_{kind}")
    counts = list(map(counted, KINDS))
    return private_spans(docs).select("doc_id", *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def redacted(docs: DataFrame) -> DataFrame:
    """doc_id, text with each span replaced by its kind in angle brackets; of overlapping spans the first counts. Documents
    must have different doc_id and text together."""
    keyed = private_spans(docs.withColumn("doc_id", F.struct("doc_id", F.xxhash64("text").alias("key"))).select("doc_id", "text")).dropDuplicates(["doc_id"])
    whole = docs.select(F.struct("doc_id", F.xxhash64("text").alias("key")).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(state, s):
        new = F.struct(s["end"].alias("at"), F.concat(state["out"], F.substring(F.col("text"), state["at"] + 1, s["start"] - state["at"]), F.lit("<"), s["kind"], F.lit(">")).alias("out"))
        return F.when(s["start"] < state["at"], F.struct(state["at"].alias("at"), state["out"].alias("out"))).otherwise(new)

    done = F.aggregate("spans", start, step)
    return whole.join(keyed, "doc_id").withColumn("done", done).select("doc_id.doc_id", F.concat("done.out", F.substring(F.col("text"), F.col("done.at") + 1, F.length("text"))).alias("text"))
