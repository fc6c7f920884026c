"""Toxicity: boosted trees over dense features of each text, with isotonic calibration.

Features are rates, so that a text of any length has the same few numbers: densities of two lexicons (the fixed one below, and
one learnt from the labels), how often they are said near the second person, capitals, punctuation, and obfuscation (hits
that show only when look-alike signs are read as letters and marks inside words are left out, letters set apart or repeated).

The labelled rows that may be learnt from are dealt by hash into three parts: one to learn the lexicon, one to grow the trees
of Spark's gradient boosting, one for the isotonic regression that turns their margin into a probability. At most `SAMPLE`
labelled rows are taken, those with the least hash of doc_id; every text is scored, in one scan. doc_id, lang, source and the
labels are no features.

Defined results: a null text counts as empty, an empty text has rates of 0 and a score like any other; rows without a label or
with a null doc_id are not learnt from; repeated rows are learnt from and scored one by one; where a part has no rows, or rows
of one label only, the trees or the calibration are left out: without trees every score is the share of toxic rows among the
labels, without calibration the trees' own probability, without any label 0; an empty table gives an empty table; further
columns pass through inside `doc`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caudal.llm.tables import doc_and, held_out, settled
from caudal.llm.words import row_slices, text_bytes, words_of

SAMPLE = 20_000
FOLDS = 3
THRESHOLD = 0.7
TREES, DEPTH, STEP, LEAST_ROWS = 30, 4, 0.2, 5
PARTS = 5  # of the labelled rows: 0 and 1 teach the lexicon, 2 and 3 the trees, 4 calibrates
LEARNT, SURE = 500, 4.0  # words of the learnt lexicon at most, and how many standard errors their share must differ by
NEAR = 5  # words between a hit and the second person

# Insults and contempt in four languages, without accents or inflection beyond the commonest.
LEXICON = """
abomination airhead asshole bastard bimbo bitch blockhead bonehead bozo brainless brat bullshit buffoon cesspool clown clowns cockroach coward crap
cretin cretins cringe damn degenerate despicable dickhead dimwit dipshit dirtbag disgrace disgusting dolt dork douchebag dumb dumbass dunce filth filthy fool
fools freak fuck fucked fucking garbage gross halfwit hateful hell hideous hypocrite idiot idiotic idiots ignoramus imbecile imbeciles inbred jackass jerk
kill lame liar loathsome loser losers lousy lowlife lunatic maggot maniac moron moronic morons nasty nitwit nutjob obnoxious parasite pathetic peasant pervert
pig pigs piss prick psycho puke rat rats repulsive retard retarded rubbish savage scum scumbag shameful shit shitty sicko sissy skank slime slimy slob slut
snowflake spineless stupid stupidity suck sucks swine thug toad trash trashy troll twat ugly useless vermin vile wanker weakling weirdo whore wimp worm worthless wretch
abschaum arschloch bloed bloedmann depp dreck dreckig dumm dummkopf ekelhaft erbaermlich feigling hurensohn idioten miststueck penner scheisse schwachkopf schwein trottel verlierer versager widerlich wertlos
abruti batard cafard connard connasse cretine debile degueulasse encule imbecile merde minable ordure pourriture pute salaud salope stupide vaurien
asco asqueroso basura cabron cobarde estupido estupida gilipollas idiota imbecil inutil mierda patetico payaso perdedor puta tonto
""".split()
SECOND = "you your yours yourself youre ya u ur du dich dir dein deine deiner euch ihr sie tu te toi vous ton ta votre ti usted ustedes vosotros eres".split()

_LETTER = np.zeros(256, dtype=bool)
_LETTER[65:91] = _LETTER[97:123] = True
_LETTER[128:] = True
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(9, 14)]] = True
_PLAIN = np.where(_LETTER, np.arange(256), 32).astype(np.uint8)  # everything but letters parts words
_PLAIN[65:91] += 32
_READ = np.arange(256).astype(np.uint8)  # signs read as the letters that they look like
_READ[65:91] += 32
_LOOKS = {"@": "a", "4": "a", "0": "o", "1": "i", "!": "i", "|": "i", "3": "e", "$": "s", "5": "s", "7": "t", "+": "t", "8": "b", "9": "g"}
_SIGN = np.zeros(256, dtype=bool)
for _sign, _letter in _LOOKS.items():
    _READ[ord(_sign)], _SIGN[ord(_sign)] = ord(_letter), True
_INSIDE = np.zeros(256, dtype=bool)  # marks that are left out between letters
_INSIDE[[ord(c) for c in ".-_*'~`^"]] = True

FEATURES = [
    "fixed_density", "fixed_share_of_words", "learnt_density", "learnt_share_of_words", "near_second_person", "second_person", "capitals", "shouted_words", "exclamations", "questions", "repeated_marks",
    "digits", "obfuscated", "signs_in_words", "letters_apart", "letters_repeated", "beyond_ascii", "length", "word_length",
]


def hashes_of(words: list[str]) -> np.ndarray:
    """Sorted hashes of words as `words_of` finds them."""
    if not words:
        return np.zeros(0, np.uint64)
    data, offsets = text_bytes(pa.array(words))
    return np.unique(words_of(data, offsets).hashes())


def among(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    if len(table) == 0:
        return np.zeros(len(values), dtype=bool)
    return table[np.minimum(np.searchsorted(table, values), len(table) - 1)] == values


def sums(marks: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """How many marks lie in each row."""
    total = np.concatenate([[0], np.cumsum(marks, dtype=np.int64)])
    return (total[begins[1:]] - total[begins[:-1]]).astype(float)


def first_bytes(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Which bytes begin a row."""
    edge = np.zeros(len(data), dtype=bool)
    edge[offsets[:-1][np.diff(offsets) > 0]] = True
    return edge


def unmasked(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The text with look-alike signs as letters where they stand beside letters, and without marks between letters."""
    letter = _LETTER[data]
    edge = first_bytes(data, offsets)
    left, right = np.zeros(len(data), dtype=bool), np.zeros(len(data), dtype=bool)
    written = letter | _SIGN[data]
    left[1:] = written[:-1] & ~edge[1:]
    right[:-1] = written[1:] & ~edge[1:]
    sign = _SIGN[data] & (left | right)
    out = np.where(letter | sign, _READ[data], 32).astype(np.uint8)
    stays = ~(_INSIDE[data] & left & right)
    kept = np.concatenate([[0], np.cumsum(stays)])
    return out[stays], kept[offsets]


@dataclass
class Lexicons:
    fixed: np.ndarray
    learnt: np.ndarray
    second: np.ndarray


def dense(data: np.ndarray, offsets: np.ndarray, lexicons: Lexicons) -> np.ndarray:
    """The features of each row, in the order of `FEATURES`."""
    n = len(offsets) - 1
    size = np.maximum(np.diff(offsets), 1)
    words = words_of(_PLAIN[data], offsets)
    hashes, counts = words.hashes(), np.maximum(np.diff(words.first), 1)
    fixed, learnt, second = (among(hashes, t) for t in (lexicons.fixed, lexicons.learnt, lexicons.second))
    hit = fixed | learnt
    # Second person near a hit: the places of all of them, moved apart by rows.
    place = np.arange(len(hashes)) + words.row * (2 * NEAR)
    marks = place[second]
    at = np.searchsorted(marks, place[hit])
    before = place[hit] - (marks[np.maximum(at - 1, 0)] if len(marks) else -(10**9))
    after = (marks[np.minimum(at, len(marks) - 1)] if len(marks) else 10**9) - place[hit]
    close = np.zeros(len(hashes), dtype=bool)
    if len(marks):
        close[np.flatnonzero(hit)] = ((at > 0) & (before <= NEAR)) | ((at < len(marks)) & (after <= NEAR))
    masked, edges = unmasked(data, offsets)
    read = words_of(masked, edges)
    read_hits = sums(among(read.hashes(), lexicons.fixed) | among(read.hashes(), lexicons.learnt), read.first)
    length = words.ends - words.starts
    capital = (data >= 65) & (data < 91)
    capitals_before = np.concatenate([[0], np.cumsum(capital)])
    shouted = (length > 2) & (capitals_before[words.ends] - capitals_before[words.starts] == length)
    sign, edge = _SIGN[data], first_bytes(data, offsets)
    beside = np.zeros(len(data), dtype=bool)
    if len(data) > 2:
        beside[1:-1] = sign[1:-1] & _LETTER[data[:-2]] & _LETTER[data[2:]] & ~edge[1:-1] & ~edge[2:]
    same = np.zeros(len(data), dtype=bool)
    if len(data) > 1:
        same[1:] = (data[1:] == data[:-1]) & ~edge[1:]
    thrice = same.copy()
    thrice[1:] &= same[:-1]
    mark = (data == 33) | (data == 63)
    letters = np.maximum(sums(_LETTER[data], offsets), 1)
    fixed_hits, learnt_hits = sums(fixed, words.first), sums(learnt, words.first)
    columns = [
        np.log1p(fixed_hits), fixed_hits / counts, np.log1p(learnt_hits), learnt_hits / counts, sums(close, words.first) / counts, sums(second, words.first) / counts,
        sums(capital, offsets) / letters, sums(shouted, words.first) / counts, sums(data == 33, offsets) / size, sums(data == 63, offsets) / size, sums(mark & same, offsets) / size,
        sums((data >= 48) & (data < 58), offsets) / size, np.maximum(read_hits - fixed_hits - sums(learnt & ~fixed, words.first), 0), sums(beside, offsets) / size, sums(length == 1, words.first) / counts,
        sums(thrice & _LETTER[data], offsets) / letters, sums(data >= 128, offsets) / size, np.log1p(np.diff(offsets).astype(float)), sums(length, words.first) / counts,
    ]
    return np.stack(columns, axis=1) if n else np.zeros((0, len(FEATURES)))


def described(batches: Iterator[pa.RecordBatch], learnt: list[str]) -> Iterator[pa.RecordBatch]:
    """(anything, text) to (anything, features)."""
    lexicons = Lexicons(hashes_of(LEXICON), hashes_of(learnt), hashes_of(SECOND))
    for batch in batches:
        data, offsets = text_bytes(batch.column(1))
        for a, b in row_slices(offsets):
            rows = dense(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], lexicons)
            lists = pa.FixedSizeListArray.from_arrays(pa.array(rows.ravel()), len(FEATURES)).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), lists], [batch.schema.names[0], "features"])


def learnt_lexicon(sample: DataFrame) -> list[str]:
    """Words whose share among toxic texts is higher than among others by `SURE` standard errors; `LEARNT` at most, the
    surest. Words are runs of letters, lower-cased, counted once a text."""
    sizes = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    if not toxic or not clean:
        return []
    words = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(r"([a-z\x{80}-\x{10FFFF}]{3,})"), F.lit(1)))
    said = sample.select("label", F.explode(words).alias("word")).groupBy("word").agg(F.sum("label").alias("toxic"), F.sum(1 - F.col("label")).alias("clean"))
    p, q = (F.col("toxic") + 0.5) / (toxic + 1), (F.col("clean") + 0.5) / (clean + 1)
    error = F.sqrt(p * (1 - p) / toxic + q * (1 - q) / clean)
    sure = said.withColumn("sure", (p - q) / error).where((F.col("sure") >= SURE) & (p >= 4 * q))
    return [r["word"] for r in sure.orderBy(F.col("sure").desc(), "word").limit(LEARNT).collect()]


@dataclass
class Model:
    lexicon: list[str]
    trees: object | None
    isotonic: object | None
    share: float


def two_sorted(rows: DataFrame) -> bool:
    low, high = rows.agg(F.min("label"), F.max("label")).first()
    return low is not None and low != high


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Lexicon, trees and calibration from `labels` (doc_id, toxic), outside the held-out fold. The sample is bounded."""
    usable = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out("doc_id", FOLDS)).select("doc_id", F.col("toxic").cast("int").alias("label"))
    chosen = usable.withColumn("rank", F.xxhash64("doc_id")).orderBy("rank", "doc_id", "label").limit(sample)
    drawn = settled(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select(F.struct("rank", "label", F.pmod("rank", F.lit(PARTS)).alias("part")).alias("row"), "text"), "toxicity-sample")
    share = drawn.agg(F.avg("row.label")).first()[0] or 0.0
    lexicon = learnt_lexicon(drawn.where("row.part < 2").select("row.label", "text"))
    rows = settled(drawn.where("row.part >= 2").mapInArrow(lambda b: described(b, lexicon), "row struct<rank:bigint,label:int,part:bigint>, features array<double>").select("row.*", array_to_vector("features").alias("features")), "toxicity-rows")
    growing = rows.where("part in (2, 3)").select("rank", F.col("label").cast("double").alias("label"), "features").orderBy("rank", "label")
    if not two_sorted(growing):
        return Model(lexicon, None, None, float(share))
    trees = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=STEP, minInstancesPerNode=LEAST_ROWS, seed=5, checkpointInterval=-1).fit(growing.coalesce(1))
    judged = trees.transform(rows.where("part = 4")).select(F.col("label").cast("double").alias("label"), vector_to_array("rawPrediction")[1].alias("margin"))
    isotonic = IsotonicRegression(featuresCol="margin").fit(judged) if two_sorted(judged) else None
    return Model(lexicon, trees, isotonic, float(share))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """`docs` (doc_id, text): a struct `doc` of all its columns, and score."""
    inside = docs.select(F.struct("*").alias("doc"), docs["text"].alias("text"))
    lexicon = model.lexicon  # `LEARNT` words at most
    if model.trees is None:
        return inside.select("doc", F.lit(model.share).alias("score"))
    rows = inside.mapInArrow(lambda b: described(b, lexicon), doc_and(inside, "features array<double>")).select("doc", array_to_vector("features").alias("features"))
    judged = model.trees.transform(rows)
    if model.isotonic is None:
        return judged.select("doc", vector_to_array("probability")[1].alias("score"))
    margin = judged.select("doc", vector_to_array("rawPrediction")[1].alias("margin"))
    return model.isotonic.transform(margin).select("doc", F.least(F.greatest(F.col("prediction"), F.lit(0.0)), F.lit(1.0)).alias("score"))


def toxicity_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc (all columns), held_out, score, predicted."""
    scored = score(docs, fit(docs, labels))
    outside = F.coalesce(F.crc32(F.col("doc.doc_id").cast("string").cast("binary")) % FOLDS == 1, F.lit(False))
    return scored.select("doc", outside.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
