"""Quality classifier by compression.

Two zstandard dictionaries are trained, one on good and one on bad labelled text. A text that shrinks
more with the good dictionary is more like good text: the difference of the two compressed sizes, divided
by the size of the text, is the evidence. A logistic curve, fitted on labelled texts, turns it into a score;
the curve also sees the difference relative to the smaller size, the compression ratio and the length, since
the difference weighs less in a short or a repetitive text.

The model is fitted on a bounded sample, the rest is scored where it lies: one pass, no shuffle of texts.

Bounds of the fit: ``per_class`` documents of each label (those with the least hash of their id), and for
the dictionaries ``pieces`` pieces of ``PIECE`` characters per class, cut from whole sampled texts and taken
by hash. Every text is scored in full length.

Null text counts as empty. Empty texts get a score as well. Repeated rows get equal scores. Labels that are
null, other than 0 or 1, or contradict each other are not learnt from; of sampled rows that share an id the least
text is. Without labels of both kinds every
score is 0.5 (predicted 1). Null doc_ids are scored and held out. Other columns are ignored.
"""

from functools import partial

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, functions as F

from revloom.llm.words import text_of

PER_CLASS = 3000
PIECE = 1500
PIECES = 4000
DICTIONARY_BYTES = 64 * 1024
LEVEL = 3


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows whose labels are never learnt from."""
    fold = F.crc32(F.col(doc_id).cast("string")) % 3
    return F.coalesce(fold == 1, F.lit(True))


def _rows_of_class(labels: DataFrame, value: int, per_class: int) -> DataFrame:
    return labels.filter(F.col("quality") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)


def training_texts(documents: DataFrame, labels: DataFrame, per_class: int) -> DataFrame:
    """(doc_id, text, quality) of at most ``per_class`` documents of each label; ids of at most twice
    that number are broadcast."""
    known = labels.filter(~held_out() & F.col("quality").isin(0, 1)).groupBy("doc_id").agg(
        F.min("quality").alias("quality"), F.max("quality").alias("_most")).filter(
        F.col("quality") == F.col("_most")).drop("_most")
    chosen = _rows_of_class(known, 0, per_class).union(_rows_of_class(known, 1, per_class))
    # rows that share an id are one sampled text, so repeated rows do not enlarge the sample
    return documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(
        F.min("text").alias("text"), F.min("quality").alias("quality"))


def _pieces(texts: DataFrame, value: int, pieces: int) -> list[bytes]:
    """At most ``pieces`` pieces of at most ``PIECE`` characters."""
    starts = F.sequence(F.lit(1), F.greatest(F.length("text"), F.lit(1)), F.lit(PIECE))
    cut = texts.filter((F.col("quality") == value) & (F.length("text") > 0)).select(
        "doc_id", F.explode(starts).alias("start"), "text")
    piece = cut.select("doc_id", "start", F.substring("text", F.col("start"), F.lit(PIECE)).alias("piece"))
    rows = piece.orderBy(F.xxhash64("doc_id", "start"), "doc_id", "start").limit(pieces).collect()
    return [row.piece.encode("utf-8", "surrogatepass") for row in rows]


def _dictionary(pieces: list[bytes]) -> bytes:
    """A trained dictionary; from very little text the text itself."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, pieces, k=256, d=8).as_bytes()
    except zstandard.ZstdError:
        return b"".join(pieces)[-DICTIONARY_BYTES:]


class Compressors:
    """Sizes of a text under both dictionaries."""

    def __init__(self, good: bytes, bad: bytes, level: int = LEVEL):
        self._both = []
        for raw in (good, bad):
            known = zstandard.ZstdCompressionDict(raw)
            known.precompute_compress(level=level)
            self._both.append(zstandard.ZstdCompressor(level=level, dict_data=known))

    def features(self, text: str | None) -> list[float]:
        raw = (text or "").encode("utf-8", "surrogatepass")
        good, bad = (len(c.compress(raw)) for c in self._both)
        least, size = min(good, bad), max(1, len(raw))
        per_byte, relative = (bad - good) / size, (bad - good) / least
        ratio = np.log(least / size)
        return [per_byte, relative, ratio, np.log(size), np.tanh(20 * per_byte), min(ratio + 2.0, 0.0)]


N_FEATURES = 6


def _features(batches, good: bytes, bad: bytes):
    tools = Compressors(good, bad)
    for batch in batches:
        found = [tools.features(t) for t in text_of(batch, "text")]
        table = np.array(found, dtype=float).reshape(-1, N_FEATURES)
        yield pa.RecordBatch.from_arrays(
            [batch.column("quality").cast(pa.int32()), pa.array(list(table), pa.list_(pa.float64()))],
            names=["quality", "features"])


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2,
                 steps: int = 50) -> np.ndarray:
    """Weights of a logistic regression by Newton steps."""
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (weight * (p - y)) + ridge * w
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(x.shape[1])
        step = np.linalg.solve(curve, grad)
        w -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-7:
            break
    return w


def fit(documents: DataFrame, labels: DataFrame, per_class: int = PER_CLASS,
        pieces: int = PIECES) -> dict | None:
    """The model: two dictionaries and a curve. None without labels of both kinds."""
    texts = training_texts(documents, labels, per_class).persist()
    try:
        good, bad = (_pieces(texts, value, pieces) for value in (1, 0))
        if not good or not bad:
            return None
        model = {"good": _dictionary(good), "bad": _dictionary(bad)}
        rows = texts.select("text", "quality").mapInArrow(
            partial(_features, **model), "quality int, features array<double>").collect()
    finally:
        texts.unpersist()
    x = np.array([r.features for r in rows])
    y = np.array([r.quality for r in rows], dtype=float)
    # the sample has as many good as bad texts where it can; weigh them as the labels have them
    totals = labels.filter(~held_out() & F.col("quality").isin(0, 1)).groupBy("quality").count().collect()
    share = {r["quality"]: r["count"] for r in totals}
    weight = np.where(y == 1, share.get(1, 1) / max(1, (y == 1).sum()),
                      share.get(0, 1) / max(1, (y == 0).sum()))
    weight *= len(y) / weight.sum()
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    curve = fit_logistic(np.column_stack([np.ones(len(x)), (x - mean) / scale]), y, weight)
    return model | {"mean": mean, "scale": scale, "curve": curve}


def _score(batches, model: dict | None):
    tools = Compressors(model["good"], model["bad"]) if model else None
    for batch in batches:
        if tools:
            x = np.array([tools.features(t) for t in text_of(batch, "text")]).reshape(-1, N_FEATURES)
            z = model["curve"][0] + ((x - model["mean"]) / model["scale"]) @ model["curve"][1:]
            scores = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        else:
            scores = np.full(batch.num_rows, 0.5)
        kept = [batch.column(c) for c in batch.schema.names]
        yield pa.RecordBatch.from_arrays([*kept, pa.array(scores)], names=[*batch.schema.names, "score"])


def score(documents: DataFrame, model: dict | None, keep=("doc_id",)) -> DataFrame:
    """``keep`` columns, text and score of every document."""
    columns = list(dict.fromkeys([*keep, "text"]))
    rows = documents.select(*columns)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(partial(_score, model=model), f"{kinds}, score double")


def quality_scores(documents: DataFrame, labels: DataFrame, per_class: int = PER_CLASS,
                   pieces: int = PIECES) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document; fits when called."""
    scored = score(documents, fit(documents, labels, per_class, pieces))
    return scored.select("doc_id", held_out().alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(documents: DataFrame, labels: DataFrame, per_class: int = PER_CLASS,
              pieces: int = PIECES) -> DataFrame:
    """The documents that the classifier does not reject, with their columns."""
    scored = score(documents, fit(documents, labels, per_class, pieces), keep=documents.columns)
    return scored.filter(F.col("score") >= 0.5).select(*documents.columns)
