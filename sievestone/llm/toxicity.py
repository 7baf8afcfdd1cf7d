"""Toxicity by a weighted lexicon matched with Aho-Corasick.

Texts are folded first: lower case, look-alike letters of other scripts to Latin, digits and signs used as letters to letters. The
lexicon holds beginnings of words and whole words with the log odds of a toxic label, learned from labelled rows; an automaton finds
all entries in one pass over the whole text. Per word only the heaviest entry counts. The sum of weights is normalised by the
length of the text, and a logistic curve fitted on labelled rows the lexicon has not seen turns it into a score.
Exception phrases (two words in a row that hold an entry but stand in clean texts) give the weight back.

Learning takes at most SAMPLE labelled rows, chosen by a hash of the id, never rows held out (crc32 of the id modulo 5 is 0). Counting
is distributed; what reaches the driver is the lexicon and one pair of numbers per calibration row.

Edge cases: null and empty texts score like a text without matches; rows without labels are scored too; null doc_id counts as not
held out; repeated labels for an id: the largest; without labels of both kinds every text scores 0.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievestone.llm.shared import map_arrow, ship, slices

SAMPLE, FOLDS = 40_000, 5
LEAST_DOCS, LEAST_ODDS, LONGEST = 4, 2.0, 10
#: Letters of other scripts that look like Latin ones, and digits and signs that stand for letters.
LOOKALIKES = {"а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ѕ": "s", "ј": "j", "ԁ": "d", "һ": "h", "ո": "n", "м": "m", "т": "t", "к": "k", "в": "b", "н": "h",
              "α": "a", "ε": "e", "ο": "o", "ρ": "p", "ι": "i", "κ": "k", "ν": "v", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ɑ": "a", "ɡ": "g", "ᴏ": "o"}
STAND_INS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "|": "l"}
_MIXED = re.compile(r"(?=[^\W_]*[013457@$!|])(?=[013457@$!|]*[^\W\d_])[\w@$!|]*[^\W_]")
_ODD = str.maketrans(LOOKALIKES)
_DIGITS = str.maketrans(STAND_INS)
_STRANGE = re.compile("[" + "".join(LOOKALIKES) + "]")
_SIGNED = re.compile(r"[^\W\d_][013457@$!|]+[^\W\d_]|(?<![^\W_])[013457@$!|]+[^\W\d_]")
_GAPS = re.compile(r"[^\w]+")


def fold(text: str | None) -> str:
    """Words of the text in folded form, with single spaces between and around them."""
    text = (text or "").lower()
    if _STRANGE.search(text):
        text = text.translate(_ODD)
    if _SIGNED.search(text):
        text = _MIXED.sub(lambda m: m[0].translate(_DIGITS), text)
    return f" {_GAPS.sub(' ', text).strip()} "


def features(word: str) -> list[str]:
    """Entries a word can meet: its beginnings of 4 letters and more, and itself as a whole."""
    return [f" {word} ", *(f" {word[:n]}" for n in range(4, min(len(word), LONGEST) + 1))]


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    toxic, clean = Counter(), Counter()
    out = lambda: pa.RecordBatch.from_arrays(
        [pa.array([*toxic, *clean]), pa.array([*toxic.values(), *[0] * len(clean)], pa.int64()), pa.array([*[0] * len(toxic), *clean.values()], pa.int64())], names=["entry", "toxic", "clean"])
    for batch in batches:
        for text, label in zip(batch.column(0), batch.column(1).to_pylist()):
            (toxic if label else clean).update({f for w in set(fold(text.as_py()).split()) for f in features(w)})
            if len(toxic) + len(clean) > 400_000:
                yield out()
                toxic.clear(), clean.clear()
    if toxic or clean:
        yield out()


def _automaton(lexicon: dict[str, float]):
    automaton = ahocorasick.Automaton()
    for entry, weight in lexicon.items():
        automaton.add_word(entry, (len(entry), weight))
    automaton.make_automaton()
    return automaton


def _signals(text: str | None, automaton, exceptions: frozenset[str]) -> tuple[float, float]:
    """(weight per square root of words, heaviest weight) of a text."""
    folded = fold(text)
    best: dict[int, float] = {}
    for end, (size, weight) in automaton.iter(folded) if len(automaton) else ():
        start = end - size + 1
        if weight > best.get(start, 0.0):
            best[start] = weight
    if exceptions:
        for start in list(best):
            if not exceptions.isdisjoint(_phrases(folded, start)):
                del best[start]
    words = folded.count(" ") - 1
    return sum(best.values()) / math.sqrt(10 + words), max(best.values(), default=0.0)


def _phrases(folded: str, start: int) -> list[str]:
    """The word that begins after the space at `start`, with its neighbour on either side."""
    end = folded.index(" ", start + 1)
    before = folded.rfind(" ", 0, start) if start else -1
    after = folded.find(" ", end + 1)
    return [folded[before + 1:end]] * (before >= 0) + [folded[start + 1:after]] * (after > 0)


def _near(shared):
    """Phrases around entries, counted by label."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, found = _automaton(shared.value), Counter()
        for batch in batches:
            for text, label in zip(batch.column(0), batch.column(1).to_pylist()):
                folded = fold(text.as_py())
                found.update({(p, label) for end, (size, _) in automaton.iter(folded) for p in _phrases(folded, end - size + 1)} if len(automaton) else ())
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in found], pa.string()), pa.array([n if y else 0 for (_, y), n in found.items()], pa.int64()),
                                          pa.array([0 if y else n for (_, y), n in found.items()], pa.int64())], names=["phrase", "toxic", "clean"])
    return run


def _points(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, exceptions = shared.value
        automaton = _automaton(lexicon)
        for batch in batches:
            x = [_signals(t.as_py(), automaton, exceptions) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in x], pa.float64()), pa.array([b for _, b in x], pa.float64()), batch.column(1)], names=["x1", "x2", "toxic"])
    return run


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> list[float]:
    """Weights of the columns of x and a constant, by Newton steps."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w.tolist()


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame) -> tuple[dict[str, float], frozenset[str], list[float]]:
    """(lexicon, exception phrases, weights of the curve) from labelled rows that are not held out."""
    spark = docs.sparkSession
    ship(spark)
    fold_of = F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS
    known = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).filter(fold_of != 0)
    total = known.count()
    picked = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(min(1.0, SAMPLE / max(total, 1)) * (1 << 20)))  # about SAMPLE rows
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").withColumn("fold", fold_of)  # at most about SAMPLE ids
    seen, rest = rows.filter("fold <> 1").select("text", "toxic"), rows.filter("fold = 1").select("text", "toxic")
    sizes = {bool(r[0]): r[1] for r in seen.groupBy(F.col("toxic") > 0).count().collect()}
    if not sizes.get(True) or not sizes.get(False):
        return {}, frozenset(), [0.0, 0.0, -30.0]
    entry = map_arrow(seen, _counts, "entry string, toxic long, clean long").groupBy("entry").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    odds = F.log((F.col("toxic") + 0.25) / (sizes[True] + 0.5)) - F.log((F.col("clean") + 0.25) / (sizes[False] + 0.5))
    lexicon = {r[0]: float(r[1]) for r in entry.withColumn("w", odds).filter((F.col("toxic") >= LEAST_DOCS) & (F.col("w") >= LEAST_ODDS)).select("entry", "w").toLocalIterator()}
    phrases = map_arrow(seen, _near(spark.sparkContext.broadcast(lexicon)), "phrase string, toxic long, clean long").groupBy("phrase").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    exceptions = frozenset(r[0] for r in phrases.filter((F.col("clean") >= LEAST_DOCS) & (odds < 0)).select("phrase").toLocalIterator())
    points = map_arrow(rest, _points(spark.sparkContext.broadcast((lexicon, exceptions))), "x1 double, x2 double, toxic int").toPandas()
    if points["toxic"].nunique() < 2:
        return lexicon, exceptions, [4.0, 0.0, -2.0]
    return lexicon, exceptions, logistic(points[["x1", "x2"]].to_numpy(), (points["toxic"] > 0).to_numpy(float))


def _scores(shared, position: int, kept: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, exceptions, (a, b, c) = shared.value
        automaton = _automaton(lexicon)
        for batch in (part for whole in batches for part in slices(whole, position)):
            x = np.array([_signals(t.as_py(), automaton, exceptions) for t in batch.column(position)]).reshape(-1, 2)
            score = 1 / (1 + np.exp(-np.clip(a * x[:, 0] + b * x[:, 1] + c, -30, 30)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:kept], pa.array(score, pa.float64())], names=[*batch.schema.names[:kept], "toxicity"])
    return run


def score_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of docs (doc_id, text); labels has (doc_id, toxic)."""
    model = learn(docs, labels)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    scored = map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), _scores(shared, 1, 1), "doc_id long, toxicity double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """`docs` without the rows predicted toxic; the text passes through the scorer with the other columns, so nothing is joined."""
    shared = docs.sparkSession.sparkContext.broadcast(learn(docs, labels))
    schema = ", ".join(f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(docs.schema)) + ", toxicity double"
    carried = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    scored = map_arrow(carried, _scores(shared, docs.columns.index("text"), len(docs.columns)), schema)
    return scored.filter("toxicity < 0.5").drop("toxicity").toDF(*docs.columns)
