"""Quality by compression: which of two trained dictionaries shortens a text more.

One zstandard dictionary is trained on good labelled texts, one on bad ones.  Every text is
compressed in blocks with both; the difference of the sizes over their sum, the size reached and
the text's length go through a logistic calibration, fitted on labelled texts that trained no
dictionary.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .texts import held_out, map_texts

BLOCK, LEVEL, DICTIONARY_BYTES = 1024, 3, 112_640
#: The bounded sample a model is fitted on: labelled texts of each class, and bytes of each text.
SAMPLE_ROWS, SAMPLE_BYTES = 1600, 8000
REJECT_BELOW = 0.3


@dataclass(frozen=True)
class Model:
    good: bytes
    bad: bytes
    weights: tuple[float, ...]
    prior: float

    def scorer(self):
        """A function from a text (null: empty) to its probability of being good."""
        if not self.weights:
            return lambda text: self.prior
        pair = [_compressor(self.good), _compressor(self.bad)]
        w = np.array(self.weights)

        def score(text: str | None) -> float:
            z = float(np.dot(_features((text or "").encode("utf-8"), pair), w))
            return 1.0 / (1.0 + np.exp(-min(50.0, max(-50.0, z))))

        return score


def _compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    trained = zstandard.ZstdCompressionDict(dictionary)
    trained.precompute_compress(LEVEL)
    return zstandard.ZstdCompressor(
        level=LEVEL, dict_data=trained, write_checksum=False, write_content_size=False,
        write_dict_id=False,
    )


def _features(data: bytes, pair) -> list[float]:
    good = bad = 0
    for i in range(0, max(len(data), 1), BLOCK):
        block = data[i : i + BLOCK]
        good += len(pair[0].compress(block))
        bad += len(pair[1].compress(block))
    n = len(data)
    return [(bad - good) / (bad + good), (bad + good) / (2 * n + 20), (n + 1) ** -0.5, 1.0]


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weighted logistic regression by Newton steps, lightly held to zero."""
    mean, spread = x[:, :-1].mean(0), x[:, :-1].std(0) + 1e-9
    z = np.c_[(x[:, :-1] - mean) / spread, x[:, -1]]
    w = np.zeros(z.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -50, 50)))
        slope = z.T @ (weight * (p - y)) + 0.05 * w
        curve = (z * (weight * p * (1 - p))[:, None]).T @ z + 0.05 * np.eye(len(w))
        w -= np.linalg.solve(curve, slope)
    return np.r_[w[:-1] / spread, w[-1] - (w[:-1] * mean / spread).sum()]


def fit(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text: str = "text",
    label: str = "quality",
    rows: int = SAMPLE_ROWS,
) -> Model:
    """Fit on at most ``rows`` labelled texts of each class, the first in hash order of their ids.

    Rows of the held-out fifth are never read; nor are null texts, null ids or null labels.
    With too few texts of a class every text gets the share of good labels (1 without labels).
    """
    known = labels.select(F.col(id_col).alias("_id"), F.col(label).cast("int").alias("_y")).filter(
        F.col("_id").isNotNull() & F.col("_y").isin(0, 1) & ~held_out("_id")
    )
    shares = {r["_y"]: r["n"] for r in known.groupBy("_y").agg(F.count("*").alias("n")).collect()}
    prior = shares.get(1, 0) / sum(shares.values()) if shares else 1.0
    texts: dict[int, list[bytes]] = {}
    for y in (0, 1):
        few = known.filter(F.col("_y") == y).dropDuplicates(["_id"])
        few = few.orderBy(F.xxhash64("_id"), "_id").limit(rows)
        # At most ``rows`` ids: small whatever the corpus.
        found = docs.select(F.col(id_col).alias("_id"), F.col(text).alias("_t")).join(
            F.broadcast(few), "_id"
        )
        found = found.filter(F.length("_t") > 0).groupBy("_id").agg(F.min("_t").alias("_t"))
        cut = found.select("_id", F.substring(F.col("_t").cast("binary"), 1, SAMPLE_BYTES).alias("_t"))
        # Whole documents are ordered by hash again, so that the halves below mix all kinds.
        texts[y] = [bytes(r["_t"]) for r in cut.orderBy(F.xxhash64("_id"), "_id").collect()]
    if min(map(len, texts.values())) < 4:
        return Model(b"", b"", (), prior)
    dictionaries = [_dictionary(texts[y][::2]) for y in (1, 0)]
    pair = [_compressor(d) for d in dictionaries]
    held = [(t, y) for y in (0, 1) for t in texts[y][1::2]]
    x = np.array([_features(t, pair) for t, _ in held])
    y = np.array([y for _, y in held], dtype=float)
    # Each class counts as often as it occurs, not as often as it was sampled.
    weight = np.where(y == 1, prior / y.mean(), (1 - prior) / (1 - y.mean()))
    return Model(*dictionaries, tuple(_logistic(x, y, weight)), prior)


def _dictionary(texts: list[bytes]) -> bytes:
    blocks = [t[i : i + BLOCK] for t in texts for i in range(0, len(t), BLOCK)]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, blocks).as_bytes()
    except zstandard.ZstdError:  # too few blocks to train on: their text is the dictionary
        return b"".join(blocks)[-DICTIONARY_BYTES:]


def scored(
    docs: DataFrame, model: Model, keep: list[Column], text: str = "text", out: str = "score"
) -> DataFrame:
    """``keep`` and the score of each row's whole text (null: empty), 0 to 1, higher for better."""

    def make():
        score = model.scorer()
        return lambda value: (score(value),)

    return map_texts(docs, keep, text, make, f"{out} double")


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``: its id, whether it was held out, score, and 1 if score >= 0.3.

    Null and empty texts get the score of an empty text; null ids and repeated rows come back as
    they are. Other columns are not read.
    """
    model = fit(docs, labels, id_col)
    rows = scored(docs, model, [F.col(id_col), held_out(id_col).alias("held_out")])
    return rows.withColumn("predicted", (F.col("score") >= REJECT_BELOW).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, without those that the classifier rejects."""
    model = fit(docs, labels)
    rows = scored(docs, model, [F.struct("*").alias("_row")])
    return rows.filter(F.col("score") >= REJECT_BELOW).select("_row.*")
