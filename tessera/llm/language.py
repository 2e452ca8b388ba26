"""Language ID: averaged hashed subword embeddings and a linear softmax.

A text's features are its words and their character n-grams (bytes of the
lower-cased text), hashed into ``buckets`` rows of an embedding table.  The
text is the mean of its feature embeddings; a linear softmax gives the class
probabilities.  Both are trained together by stochastic gradient descent in
numpy on a bounded sample (``per_language`` documents of each language, chosen
by hash, with ``features`` features each).  A part of the sample is held back
to fit a temperature (calibration) and to report how sure a prediction is.

A softmax is sure of any text that leans to one class, also of a text in a
language it never saw.  So a text must also be likely under the predicted
language: its ``support`` is the mean log-likelihood of its features there, in
standard deviations from what is usual for held-back documents.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import cleared, short_batches
from .textkit import LOWER, mix64, pieces, word_hashes, word_spans

BUCKETS = 1 << 15
GRAMS = (2, 3, 4)
SEED = 7
SLACK = 3.0             # standard errors that a text of few features may fall short
LEAST_HELD = 30         # held-back documents from which their support tells what is usual


def feature_rows(data: np.ndarray, off: np.ndarray, buckets: int):
    """``(bucket, row)`` of every feature: each word, and each byte n-gram inside a word with its edges."""
    starts, ends, rows = word_spans(data, off)
    hashes, _ = word_hashes(data, off)
    out = [(hashes % np.uint64(buckets)).astype(np.int32)]
    at = [rows]
    low = LOWER[data].astype(np.uint64)
    inside = np.zeros(len(data) + max(GRAMS), np.int32)          # the word that a byte belongs to, 0 outside
    for edge, step in ((starts, 1), (ends, -1)):
        np.add.at(inside, edge, step)
    inside = np.cumsum(inside)
    word = np.cumsum(np.bincount(starts, minlength=len(data)))[:len(data)] if len(starts) else np.zeros(len(data), np.int64)
    for g in GRAMS:
        n = len(data) - g + 1
        if n <= 0 or not len(starts):
            continue
        ok = (inside[:n] > 0) & (inside[g - 1:n + g - 1] > 0) & (word[:n] == word[g - 1:n + g - 1])
        i = np.flatnonzero(ok)
        h = np.full(len(i), g, np.uint64)
        for k in range(g):
            h = h * np.uint64(257) + low[i + k]
        out.append((mix64(h) % np.uint64(buckets)).astype(np.int32))
        at.append(rows[word[i] - 1])
    return np.concatenate(out), np.concatenate(at)


def has_letter(text: str | None) -> bool:
    return any(c.isalpha() for c in text or "")


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


class Model:
    """Class names, per-bucket class scores (embedding times weights), bias, temperature and support."""

    def __init__(self, names, scores, bias, temperature, floor, held_out_accuracy, support=None, least_support=-np.inf):
        self.names, self.scores, self.bias = names, scores, bias
        self.temperature, self.floor, self.held_out_accuracy = temperature, floor, held_out_accuracy
        self.support, self.least_support = support, least_support

    def probabilities(self, mean: np.ndarray) -> np.ndarray:
        return softmax((mean + self.bias) / self.temperature)

    def predict(self, column: pa.Array):
        """``(class index, calibrated probability, supported)`` per row; index -1 without features."""
        best, prob, fit, k = [], [], [], len(self.names)
        for _, off, data in pieces(column):
            bucket, row = feature_rows(data, off, len(self.scores))
            n = len(off) - 1
            count = np.bincount(row, minlength=n).astype(float)
            total = np.stack([np.bincount(row, self.scores[bucket, c], n) for c in range(k)], axis=1)
            p = self.probabilities(total / np.maximum(count, 1)[:, None])
            best.append(np.where(count > 0, p.argmax(1), -1))
            prob.append(np.where(count > 0, p.max(1), 0.0))
            fit.append(np.ones(n, bool))
            if self.support is not None:
                near = np.bincount(row, self.support[bucket, p.argmax(1)[row]], n) / np.maximum(count, 1)
                fit[-1] = near + SLACK / np.sqrt(np.maximum(count, 1)) >= self.least_support
        return tuple(map(np.concatenate, (best, prob, fit))) if best else (np.zeros(0, int), np.zeros(0), np.zeros(0, bool))


def sample_features(docs: DataFrame, per_language: int, features: int, buckets: int) -> DataFrame:
    """``lang, doc_id, picks``: hashed features of a bounded, hash-chosen sample of labelled documents."""
    short_batches(docs.sparkSession)
    order = F.xxhash64("doc_id", F.lit(SEED))

    def first(rows, *by):
        """The first ``per_language`` of every group, in hash order."""
        rank = F.row_number().over(Window.partitionBy(*by).orderBy(order, "doc_id"))
        return rows.withColumn("r", rank).filter(F.col("r") <= per_language)
    # cut in 64 salted parts of a language first: what meets in one task is bounded, whatever the language's share
    labelled = docs.filter("lang IS NOT NULL AND text IS NOT NULL").select("doc_id", "lang", F.pmod(F.xxhash64("doc_id"), F.lit(64)).alias("salt"))
    ids = first(first(labelled, "lang", "salt"), "lang").select("doc_id")
    rows = docs.join(F.broadcast(ids.distinct()), "doc_id").select("doc_id", "lang", "text")

    def run(batches):
        for b in batches:
            picks = []
            for _, off, data in pieces(b.column("text")):
                bucket, row = feature_rows(data, off, buckets)
                order = np.argsort(row, kind="stable")
                bucket, cut = bucket[order], np.searchsorted(row[order], np.arange(len(off)))
                for lo, hi in zip(cut[:-1], cut[1:]):
                    mine = bucket[lo:hi]
                    if len(mine) > features:
                        mine = np.random.default_rng(SEED).choice(mine, features, replace=False)
                    picks.append(np.sort(mine).tolist())
            yield pa.record_batch([b.column("lang"), b.column("doc_id"), pa.array(picks, pa.list_(pa.int32()))],
                                  names=["lang", "doc_id", "picks"])
    return rows.mapInArrow(run, "lang string, doc_id long, picks array<int>")


def train(docs: DataFrame, per_language: int = 400, features: int = 1000, buckets: int = BUCKETS, width: int = 16,
          epochs: int = 12, steps: int = 800, rate: float = 0.5, batch: int = 16, least_precision: float = 0.99,
          most_lost: float = 0.002) -> Model:
    """Fit a model on labelled ``docs`` (doc_id, text, lang); rows without lang or text are skipped.

    The driver receives at most ``per_language * features`` integers for each
    language.  One sampled document in five is held back for calibration.
    ``floor`` is the lowest calibrated probability at which the predictions
    kept reach ``least_precision`` on the held-back part, but never so high
    that more than ``most_lost`` of the right ones there would be rejected.
    ``least_support`` lies twice as far below the usual support as the
    ``most_lost`` quantile of the right predictions there.
    """
    rows = [r for r in sample_features(docs, per_language, features, buckets).collect() if r["picks"]]
    rows.sort(key=lambda r: (r["lang"], r["doc_id"] is None, r["doc_id"] or 0, r["picks"]))
    names = sorted({r["lang"] for r in rows})
    if not names:
        return Model([], np.zeros((buckets, 0)), np.zeros(0), 1.0, 0.0, 0.0)
    y = np.array([names.index(r["lang"]) for r in rows])
    x = [np.array(r["picks"]) for r in rows]
    draw = np.random.default_rng(SEED)
    held = np.zeros(len(x), bool)
    held[draw.permutation(len(x))[:len(x) // 5]] = True
    embed = draw.normal(0, 1.0 / width, (buckets, width))
    weight, bias = np.zeros((width, len(names))), np.zeros(len(names))
    weight += draw.normal(0, 0.1, weight.shape)
    learn = np.flatnonzero(~held)
    epochs = max(epochs, -(-steps * batch // max(len(learn), 1)))
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs) + 0.02
        order = draw.permutation(learn)
        for lo in range(0, len(order), batch):
            some = order[lo:lo + batch]
            sizes = np.array([len(x[i]) for i in some])
            flat = np.concatenate([x[i] for i in some])
            mean = np.add.reduceat(embed[flat], np.r_[0, np.cumsum(sizes)[:-1]]) / sizes[:, None]
            p = softmax(mean @ weight + bias)
            p[np.arange(len(some)), y[some]] -= 1
            back = (p @ weight.T) / sizes[:, None]
            weight -= step * mean.T @ p / len(some)
            bias -= step * p.mean(0)
            np.subtract.at(embed, flat, 40 * step / len(some) * np.repeat(back, sizes, axis=0))
    scores = embed @ weight
    part = np.flatnonzero(held) if held.any() else learn
    logits = np.stack([scores[x[i]].mean(0) for i in part]) + bias
    heat = min(np.geomspace(0.05, 5, 60), key=lambda t: -np.log(softmax(logits / t)[np.arange(len(part)), y[part]] + 1e-12).mean())
    p = softmax(logits / heat)
    right = p.argmax(1) == y[part]
    top = p.max(1)
    floor = next((t for t in np.arange(0.0, 0.5, 0.02) if right[top >= t].mean() >= least_precision), 0.5)
    floor = min(floor, float(np.quantile(top[right], most_lost, method="lower")) if right.any() else 0.0)
    support, least_support = usual_support(x, y, learn, part[right] if held.any() else part[:0], buckets, len(names), most_lost)
    return Model(names, scores, bias, float(heat), float(floor), float(right.mean()), support, least_support)


def usual_support(x, y, learn, part, buckets: int, k: int, most_lost: float):
    """``(support, least)``: standardised log-likelihood of every bucket in every class, and the least mean of a text.

    Counted on the documents ``learn``; centred and bounded on the held-back
    documents ``part``.  No bound with too few of those.
    """
    if len(part) < LEAST_HELD:
        return None, -np.inf
    counts = np.stack([np.bincount(np.concatenate([x[i] for i in learn if y[i] == c] or [np.zeros(0, int)]), minlength=buckets)
                       for c in range(k)], axis=1).astype(float)
    like = np.log((counts + 0.5) / (counts.sum(0) + 0.5 * buckets))
    share = (counts + 0.5) / (counts + 0.5).sum(0)
    centre = (share * like).sum(0)
    spread = np.maximum(np.sqrt((share * (like - centre) ** 2).sum(0)), 1e-9)
    means = np.array([like[x[i], y[i]].mean() for i in part])
    for c in set(y[part]):
        centre[c] = np.median(means[y[part] == c])
    off = (means - centre[y[part]]) / spread[y[part]] + SLACK / np.sqrt([len(x[i]) for i in part])
    middle = float(np.median(off))
    least = middle - 2 * (middle - float(np.quantile(off, most_lost, method="lower")))
    return (like - centre) / spread, least


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` plus ``lang_pred``, ``score`` (calibrated probability) and ``rejected``.

    ``und`` with score 0 for a NULL text, one without a letter, or an empty
    model.  ``rejected`` is true for those, for scores below the model's
    floor, and for texts without support: in a language that was not learned,
    or in none.  Only the text column is looked at; others are carried, but a
    computed column replaces one of the same name.  Repeated rows each give a row.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vars(model))
    short_batches(docs.sparkSession)
    docs = cleared(docs, "lang_pred", "score", "rejected", "_text")
    names = docs.columns

    def run(batches):
        m = Model(**shared.value)
        for b in batches:
            text = b.column("_text")
            best, prob, fit = m.predict(text) if m.names else (np.full(len(text), -1), np.zeros(len(text)), np.zeros(len(text), bool))
            known = np.fromiter((has_letter(t.as_py()) for t in text), bool, len(text)) & (best >= 0)
            pred = [m.names[k] if ok else "und" for k, ok in zip(best, known)]
            prob = np.clip(np.where(known, prob, 0.0), 0.0, 1.0)
            yield pa.record_batch([b.column(i) for i in range(len(names))]
                                  + [pa.array(pred, pa.string()), pa.array(prob), pa.array(~known | (prob < m.floor) | ~fit)],
                                  names=[*names, "lang_pred", "score", "rejected"])
    from pyspark.sql.types import BooleanType, DoubleType, StringType, StructType
    schema = (StructType(list(docs.schema.fields)).add("lang_pred", StringType()).add("score", DoubleType())
              .add("rejected", BooleanType()))
    return docs.withColumn("_text", F.col("text")).mapInArrow(run, schema)


def held_out(doc_id) -> Column:
    """True for the documents (crc32 of the id as text, modulo 5, is 0) that training never sees."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))
