"""Toxicity of texts: boosted trees over dense features, calibrated by isotonic regression."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlift.llm.common import schema_of, sliced, stored
from ledgerlift.llm.shingles import words_of

SECOND_PERSON = frozenset(
    "you your yours yourself du dich dir dein deine deinen ihr euch euer sie tu te toi ton ta tes vous votre vos "
    "tú ti tuyo tuya usted ustedes vosotros os".split()
)
FEATURES = (
    "word_density", "stem_density", "weight_density", "log_hits", "hits_near_second_person", "second_person_density",
    "capital_rate", "shouted_words", "punctuation_rate", "exclamation_rate", "obfuscated_words", "obfuscated_hits",
    "stretched_words", "log_words",
)
STEMS = (4, 6)  # letters of the word beginnings that may enter the lexicon
NEAR = 3  # words on either side of a second person
_DISGUISE = str.maketrans("013457@$!|", "oieastasil")
_LETTERS = re.compile(r"[^\W\d_]+")
_STRETCHED = re.compile(r"(.)\1{2,}")
_CACHE = 200_000


def terms_of(word: str) -> list[str]:
    """A word in lower case, and its beginnings, marked by ``*``."""
    return [word, *(f"{word[:n]}*" for n in STEMS if len(word) > n)]


def _traits(token: str, lexicon: dict[str, float]) -> tuple[float, ...]:
    """What one token adds to the sums that the features are made of."""
    letters = _LETTERS.findall(token)
    word = max(letters, key=len).lower() if letters else ""
    runs = {run.lower() for run in letters}  # learned from one by one, too
    whole = max((lexicon.get(run, 0.0) for run in runs), default=0.0)
    stem = max((lexicon.get(t, 0.0) for run in runs for t in terms_of(run)[1:]), default=0.0)
    n_letters = sum(map(len, letters))
    inside = token.strip(".,;:!?\"'()[]-…")
    disguised = bool(n_letters) and len(letters[0]) < len(inside) and not inside.isalpha()
    hidden = 0.0
    if disguised and not lexicon.get(word):
        plain = "".join(_LETTERS.findall(inside.lower().translate(_DISGUISE)))
        hidden = lexicon.get(plain, 0.0)
    capitals = sum(c.isupper() for c in token)
    return (
        float(whole > 0), float(stem > 0), max(whole, stem, hidden), float(word in SECOND_PERSON), float(capitals),
        float(n_letters), float(n_letters > 1 and capitals == n_letters), float(len(token) - n_letters),
        float(token.count("!")), float(disguised), float(hidden > 0), float(bool(_STRETCHED.search(token))),
        float(len(token)),
    )


def dense_features(texts: pa.Array, lexicon: dict[str, float], cache: dict[str, tuple]) -> np.ndarray:
    """One row of ``FEATURES`` for each text."""
    words, counts = words_of(texts)
    coded = words.dictionary_encode()
    if len(cache) > _CACHE:
        cache.clear()
    rows = []
    for token in coded.dictionary.to_pylist():
        traits = cache.get(token)
        if traits is None:
            traits = cache[token] = _traits(token, lexicon)
        rows.append(traits)
    table = np.array(rows).reshape(len(rows), -1) if rows else np.zeros((0, 13))
    n = len(counts)
    each = table[coded.indices.to_numpy(zero_copy_only=False)]
    text = np.repeat(np.arange(n), counts)
    sums = np.stack([np.bincount(text, weights=each[:, j], minlength=n) for j in range(13)], axis=1)

    # A hit is near when a second person stands within NEAR words in the same text.
    ends = np.cumsum(counts)
    running = np.concatenate([[0], np.cumsum(each[:, 3])])
    at = np.arange(len(each))
    low = np.maximum(at - NEAR, np.repeat(ends - counts, counts))
    high = np.minimum(at + NEAR + 1, np.repeat(ends, counts))
    near = (running[high] > running[low]) & (each[:, 2] > 0)
    near = np.bincount(text, weights=near, minlength=n)

    per_word, per_char = np.maximum(counts, 1), np.maximum(sums[:, 12], 1)
    hits = np.bincount(text, weights=each[:, 2] > 0, minlength=n)
    return np.stack([
        sums[:, 0] / per_word, sums[:, 1] / per_word, sums[:, 2] / per_word, np.log1p(hits), near / per_word,
        sums[:, 3] / per_word, sums[:, 4] / np.maximum(sums[:, 5], 1), sums[:, 6] / per_word, sums[:, 7] / per_char,
        sums[:, 8] / per_char, sums[:, 9] / per_word, sums[:, 10] / per_word, sums[:, 11] / per_word, np.log1p(counts),
    ], axis=1)


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts that hold each term, by label, added up for the task."""
    found = (Counter(), Counter())
    for batch in sliced(batches):
        for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
            words = {w.lower() for w in _LETTERS.findall(text or "")}
            found[toxic].update({t for w in words for t in terms_of(w)})
    terms = list(found[0].keys() | found[1].keys())
    yield pa.RecordBatch.from_arrays(
        [pa.array(terms, pa.string()), pa.array([found[1][t] for t in terms], pa.int64()),
         pa.array([found[0][t] for t in terms], pa.int64())], names=["term", "toxic", "clean"],
    )


def learn_lexicon(labelled: DataFrame, size: int, least: int = 5, odds: float = 2.0) -> dict[str, float]:
    """At most ``size`` terms that mark toxic texts, with their log odds: those held by ``least`` toxic
    texts or more, highest odds first."""
    totals = labelled.agg(F.sum("toxic"), F.sum(1 - F.col("toxic"))).first()
    toxic, clean = totals[0] or 0, totals[1] or 0
    counts = labelled.select("text", "toxic").mapInArrow(_count_terms, "term string, toxic bigint, clean bigint")
    counts = counts.groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    weight = F.log((F.col("toxic") + 0.5) / (toxic + 1)) - F.log((F.col("clean") + 0.5) / (clean + 1))
    best = counts.where(F.col("toxic") >= least).withColumn("weight", weight).where(F.col("weight") > odds)
    return {r.term: r.weight for r in best.orderBy(F.desc("weight"), "term").limit(size).collect()}


def _featured(lexicon: dict[str, float], keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, tuple] = {}
        for batch in sliced(batches):
            rows = dense_features(batch.column("text"), lexicon, cache)
            features = pa.ListArray.from_arrays(
                pa.array(np.arange(len(rows) + 1, dtype=np.int32) * len(FEATURES)), pa.array(rows.ravel())
            )
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), features], names=[*keep, "features"])
    return run


def with_features(df: DataFrame, lexicon: dict[str, float], keep: list[str], text: str = "text") -> DataFrame:
    """``row``, a struct of the columns ``keep``, and the features as a vector; the text is also a column
    of its own where it is kept."""
    row = F.struct(*(F.col(f"`{c}`") for c in keep if c != text), F.lit(True))
    rows = df.select(row.alias("row"), F.col(f"`{text}`").alias("text"))
    own = ["row", "text"] if text in keep else ["row"]
    done = rows.mapInArrow(_featured(lexicon, own), schema_of(rows, own, "features array<double>"))
    return done.withColumn("features", array_to_vector("features"))


@dataclass(frozen=True)
class ToxicityModel:
    lexicon: dict[str, float]
    trees: GBTClassificationModel | None
    calibration: IsotonicRegressionModel | None
    rate: float  # of toxic texts among the labelled

    def score(self, df: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
        """The columns ``keep``, ``score`` (0 to 1) and ``predicted`` (1 from 0.5 on, else 0), which replace
        columns of these names. Null and empty texts are scored like any other. An empty table gives no rows."""
        keep = [c for c in keep if c.lower() not in ("score", "predicted")]
        rows = with_features(df, self.lexicon, keep, text)
        own = [F.col("text").alias(c) if c == text else F.col(f"row.`{c}`") for c in keep]
        if self.trees is None:
            scored = rows.withColumn("score", F.lit(self.rate))
        else:
            scored = self.calibration.transform(_margin(self.trees.transform(rows)))
        score = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("score").cast("double")))
        return scored.select(*own, score.alias("score"), (score >= 0.5).cast("int").alias("predicted"))


def _margin(scored: DataFrame) -> DataFrame:
    return scored.withColumn("margin", vector_to_array("rawPrediction")[1])


def held_out(id: Column) -> Column:
    """Rows whose labels are never learned from."""
    return F.coalesce(F.crc32(id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit_toxicity(
    docs: DataFrame, labels: DataFrame, *, sample: int = 16_000, lexicon_size: int = 400, trees: int = 20,
    depth: int = 4, seed: int = 2, id: str = "doc_id", text: str = "text", label: str = "toxic",
) -> ToxicityModel:
    """Learn from at most ``sample`` labelled rows, the smallest by a hash of the id, that are not held out.

    Three quarters give the lexicon and the trees, the rest the isotonic calibration. The lexicon holds
    at most ``lexicon_size`` words and word beginnings. Features are densities of lexicon terms, their
    nearness to a second person, and rates of capitals, punctuation, disguised and stretched words; ids,
    labels and other columns are no inputs. Labels that are null are ignored, repeated ones count as
    toxic if any is. Without labels of both kinds the score is the share of toxic labels (0 for none).
    """
    own = labels.select(F.col(f"`{id}`").alias("label_id"), F.col(f"`{label}`").cast("int").alias("toxic"))
    own = own.where(F.col("label_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out(F.col("label_id")))
    own = own.groupBy("label_id").agg(F.max("toxic").alias("toxic"))
    own = stored(own.orderBy(F.xxhash64(F.lit(seed), "label_id"), "label_id").limit(sample), "labels")
    # At most ``sample`` ids and labels are shared with every task.
    rows = docs.select(F.col(f"`{id}`").alias("doc_id"), F.col(f"`{text}`").alias("text")).join(
        F.broadcast(own), F.col("doc_id") == F.col("label_id")
    ).select("doc_id", "text", "toxic")
    rows = stored(rows, "labelled")
    rate = rows.agg(F.avg("toxic")).first()[0] or 0.0
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1
    learning, calibrating = rows.where(~fold), rows.where(fold)
    if learning.select("toxic").distinct().count() < 2 or calibrating.isEmpty():
        return ToxicityModel({}, None, None, float(rate))
    lexicon = learn_lexicon(learning, lexicon_size)
    featured = with_features(rows, lexicon, ["doc_id", "toxic"]).select("row.doc_id", "row.toxic", "features")
    featured = stored(featured, "features")
    boosted = GBTClassifier(labelCol="toxic", maxIter=trees, maxDepth=depth, stepSize=0.2, seed=seed).fit(
        featured.where(~fold)
    )
    margins = _margin(boosted.transform(featured.where(fold))).select("margin", "toxic")
    calibration = IsotonicRegression(featuresCol="margin", labelCol="toxic", predictionCol="score").fit(margins)
    return ToxicityModel(lexicon, boosted, calibration, float(rate))
