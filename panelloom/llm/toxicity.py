"""Toxicity by compression distance with two zstandard dictionaries.

Texts are rewritten so that a compressor sees words: every word becomes fixed-width codes
of its beginnings and of itself.  One dictionary is made from ordinary training texts, one
from toxic ones: the codes common in ordinary text, which toxic text shares, and after them
those that are typical of toxic text.  Windows of a few words are compressed with either;
what the toxic dictionary saves more is the window's evidence.  A logistic curve over a
document's evidence, fitted on training texts the dictionaries have not seen, gives the
score and so the threshold.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelloom.llm.common import id_text

# The classifier is fitted on at most so many labelled texts of each kind, of at most so
# many bytes each; they are chosen by a hash of the id.
TRAIN_TOXIC, TRAIN_ORDINARY, TRAIN_BYTES = 2500, 6000, 1 << 15
WINDOW_WORDS = 12
CODE_BYTES = 10
BEGINNINGS = (4, 5, 7)
ORDINARY_CODES = 500
TOXIC_CODES = 400
# A code is typical of toxic text when its lead there is CLEAR after so many standard errors.
SURE, FAIRLY_SURE, CLEAR = 3.0, 2.0, 0.5
LEVEL = 3
CACHE_WORDS = 500_000
# ASCII letters in lower case and all bytes of other letters; everything else parts words.
LETTERS = bytes(
    b if 97 <= b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 32 for b in range(256)
)
# Fixed value: one document in five is held out.
FOLDS = 5


def split_words(text: str | None) -> list[bytes]:
    return (text or "").lower().encode("utf-8", "replace").translate(LETTERS).split()


def word_features(word: bytes) -> list[bytes]:
    """Beginnings of a word, marked as such, and the word."""
    letters = word.decode("utf-8", "replace")
    out = [letters[:n].encode() + b"-" for n in BEGINNINGS if len(letters) > n]
    return [*out, word]


def code(feature: bytes) -> bytes:
    return xxhash.xxh3_128_digest(feature)[:CODE_BYTES]


@dataclass
class Model:
    """Dictionaries (raw content) and the curve: mean, scale and weights of the evidence."""

    ordinary: bytes
    toxic: bytes
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray


class Scorer:
    """Evidence and score of texts under a model."""

    def __init__(self, model: Model):
        self.model = model
        self.codes: dict[bytes, bytes] = {}
        self.compress = []
        for content in (model.ordinary, model.toxic):
            data = zstandard.ZstdCompressionDict(
                content, dict_type=zstandard.DICT_TYPE_RAWCONTENT
            )
            data.precompute_compress(level=LEVEL)
            self.compress.append(
                zstandard.ZstdCompressor(
                    level=LEVEL, dict_data=data, write_checksum=False,
                    write_content_size=False, write_dict_id=False,
                ).compress
            )

    def windows(self, text: str | None) -> list[bytes]:
        """The whole text as windows of codes."""
        known = self.codes
        if len(known) > CACHE_WORDS:
            known.clear()
        out = []
        for word in split_words(text):
            coded = known.get(word)
            if coded is None:
                coded = known[word] = b"".join(map(code, word_features(word)))
            out.append(coded)
        return [b"".join(out[i : i + WINDOW_WORDS]) for i in range(0, len(out), WINDOW_WORDS)]

    def evidence(self, text: str | None) -> list[float]:
        """Largest saving of a window, all savings together, and per window."""
        ordinary, toxic = self.compress
        saved = [len(ordinary(w)) - len(toxic(w)) for w in self.windows(text)]
        # One or two bytes are the compressor's rounding.
        found = [s for s in saved if s > 2]
        total = sum(found)
        return [
            min(max(found, default=0), 40) / 10,
            math.log1p(total),
            10 * total / (10 + len(saved)) / 10,
        ]

    def scores(self, texts: list[str | None]) -> np.ndarray:
        rows = np.array([self.evidence(t) for t in texts]).reshape(-1, 3)
        return curve(design(rows, self.model.mean, self.model.scale), self.model.weights)


def design(rows: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    return np.column_stack([np.ones(len(rows)), (rows - mean) / scale])


def curve(x: np.ndarray, weights: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))


def train_dictionaries(ordinary: list[str], toxic: list[str]) -> tuple[bytes, bytes]:
    """Dictionary contents for ordinary and for toxic text; what matters most stands last."""

    def frequencies(texts: list[str]) -> Counter:
        out: Counter = Counter()
        for text in texts:
            out.update({f for w in set(split_words(text)) for f in word_features(w)})
        return out

    # Copies of a text are one.
    ordinary, toxic = list(dict.fromkeys(ordinary)), list(dict.fromkeys(toxic))
    plain, typical = frequencies(ordinary), frequencies(toxic)

    def lead(feature: bytes, sure: float) -> float:
        """How much likelier in toxic text (logarithm), less ``sure`` standard errors."""
        a, b = typical[feature] + 0.5, plain[feature] + 0.5
        return (
            math.log(a / (len(toxic) + 1)) - math.log(b / (len(ordinary) + 1))
            - sure * math.sqrt(1 / a + 1 / b)
        )

    # Clear leads; where texts are too few for them, those near the largest lead.
    leads = {f: lead(f, FAIRLY_SURE) for f in typical}
    near = max(0.0, max(leads.values(), default=0.0) / 2)
    chosen = [f for f in leads if leads[f] > near or lead(f, SURE) > CLEAR]
    chosen.sort(key=lambda f: (leads[f], f))
    marks = set(chosen)
    common = sorted((f for f in plain if f not in marks), key=lambda f: (-plain[f], f))
    base = b"".join(map(code, reversed(common[:ORDINARY_CODES]))) or b"\0" * CODE_BYTES
    return base, base + b"".join(map(code, chosen[-TOXIC_CODES:]))


def fit_curve(rows: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, ...]:
    """Logistic regression by Newton's method with a small ridge."""
    mean, scale = rows.mean(axis=0), rows.std(axis=0)
    scale[scale == 0] = 1.0
    x = design(rows, mean, scale)
    weights = np.zeros(x.shape[1])
    ridge = np.diag([1e-6] + [0.1] * rows.shape[1])
    for _ in range(50):
        p = curve(x, weights)
        step = np.linalg.solve(
            (x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (labels - p) - ridge @ weights
        )
        weights += step
        if np.abs(step).max() < 1e-9:
            break
    return mean, scale, weights


def fit(
    texts: list[str], labels: list[int], times: tuple[float, float] = (1.0, 1.0)
) -> Model | float:
    """A model, or the share of toxic texts where there are not enough of both kinds.

    ``times``: how many labels one ordinary and one toxic text of the sample stand for.
    Scores are those of the share of toxic labels before sampling.

    A fifth of the texts is kept from the dictionaries, in turn, and gives the evidence the
    curve is fitted on; the final dictionaries are made from all.
    """
    y = np.array(labels)
    if len(y) == 0 or min((y == 1).sum(), (y == 0).sum()) < 2:
        toxic, ordinary = times[1] * (y == 1).sum(), times[0] * (y == 0).sum()
        return float(toxic / (toxic + ordinary)) if len(y) else 0.0
    # Copies of a text fall into one fold.
    fold = np.array([xxhash.xxh3_64_intdigest(t.encode("utf-8", "replace")) % FOLDS for t in texts])
    blank = np.zeros(3)
    rows = np.zeros((len(texts), 3))
    for k in range(FOLDS):
        train = np.flatnonzero(fold != k)
        pair = [[texts[i] for i in train if y[i] == kind] for kind in (0, 1)]
        scorer = Scorer(Model(*train_dictionaries(*pair), blank, blank + 1, np.zeros(4)))
        for i in np.flatnonzero(fold == k):
            rows[i] = scorer.evidence(texts[i])
    contents = train_dictionaries(
        [t for t, v in zip(texts, y) if v == 0], [t for t, v in zip(texts, y) if v == 1]
    )
    mean, scale, weights = fit_curve(rows, y.astype(float))
    # Sampling the kinds unequally shifts the intercept of the curve and nothing else.
    weights[0] += math.log(times[1] / times[0])
    return Model(*contents, mean, scale, weights)


def remainder(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo the folds."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(FOLDS))


def train(docs: DataFrame, labels: DataFrame) -> Model | float:
    """A model from the labelled documents that are not held out.

    The sample is bounded: TRAIN_TOXIC and TRAIN_ORDINARY texts of at most TRAIN_BYTES;
    the curve is corrected for the share of each kind that is taken.
    Labels of a document that disagree, and null ones, do not count.
    """
    marks = (
        labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1))
        .where(remainder(F.col("doc_id")) != 0)
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("_most"))
        .where("toxic = _most")
        .select("doc_id", "toxic")
    )
    texts = docs.where(
        F.col("text").isNotNull() & (F.octet_length("text") <= TRAIN_BYTES)
    ).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    parts = []
    for kind, most in ((1, TRAIN_TOXIC), (0, TRAIN_ORDINARY)):
        # The labels of the sample are few enough to go to every task.
        some = (
            marks.where(F.col("toxic") == kind)
            .orderBy(F.xxhash64("doc_id"), "doc_id")
            .limit(most)
        )
        parts.append(some)
    total = {r.toxic: r["count"] for r in marks.groupBy("toxic").count().collect()}
    times = tuple(
        max(1.0, total.get(kind, 0) / most) for kind, most in ((0, TRAIN_ORDINARY), (1, TRAIN_TOXIC))
    )
    sample = parts[0].union(parts[1])
    # Of texts that share an id, always the same one.
    chosen = F.min(F.struct(F.xxhash64("text"), "text"))["text"]
    rows = (
        texts.join(F.broadcast(sample), "doc_id")
        .groupBy("doc_id", "toxic")
        .agg(chosen.alias("text"))
        .toPandas()
    )
    rows = rows.sort_values("doc_id", kind="stable")
    return fit(rows["text"].tolist(), rows["toxic"].tolist(), times)


def toxicity_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every document, by whole texts.

    Only labels of documents that are not held out are learned.  Null and empty texts get
    the score of a text without evidence; without labels of both kinds every score is the
    share of toxic labels (0 without labels).  Null ids are never held out.  Rows are
    scored each for itself; other columns are not read.
    """
    model = train(docs, labels)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(model) if isinstance(model, Model) else None
        for batch in batches:
            texts = batch["text"].tolist()
            yield pd.DataFrame(
                {
                    "doc_id": batch["doc_id"],
                    "score": scorer.scores(texts) if scorer else np.full(len(texts), model),
                }
            )

    scored = (
        docs.select(id_text("doc_id").alias("doc_id"), "text")
        .mapInPandas(score, "doc_id string, score double")
        .withColumn("doc_id", F.col("doc_id").cast("long"))
    )
    return scored.select(
        "doc_id",
        F.coalesce(remainder(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the documents whose score is 0.5 or more; all columns stay."""
    model = train(docs, labels)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Scorer(model) if isinstance(model, Model) else None
        for texts in batches:
            found = scorer.scores(texts.tolist()) if scorer else np.full(len(texts), model)
            yield pd.Series(found)

    return docs.where(score(F.col("text")) < 0.5)
