"""Operator 7, language identification: a byte convolutional network.

Texts in UTF-8, A-Z lowered, are cut into windows of a fixed length; every window of the whole text is judged. Filters of several widths
slide over the bytes of a window (a filter has a number for each byte at each of its places), the largest value of each filter is
kept, and a softmax layer turns these into probabilities. A text's language has the largest mean log probability over its
windows, weighted by their bytes; the score is the share of that mean among all languages.

The network is trained in numpy on the driver, on a bounded sample: at most ``docs_per_language`` documents a language, those with the least
hash of the id, and at most ``windows_per_doc`` windows of each, spread over the text. The weights, some 40,000 numbers, go to the executors.

Defined cases: null texts and texts without a letter are ``und`` with score 0, as is everything if there is nothing to learn from; short
windows are filled up with spaces; a null id is not held out and not learned from; equal scores go to the first language in code
point order; repeated rows get equal results; other columns pass nowhere.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import store

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 16
DOCS_PER_LANGUAGE = 600
WINDOWS_PER_DOC = 4
EPOCHS = 12
_WINDOWS_AT_ONCE = 256


def windows_of(text: bytes, length: int = WINDOW) -> np.ndarray:
    """(windows, length) of bytes; the last window is filled up with spaces."""
    body = text.lower()
    body += b" " * (-len(body) % length)
    return np.frombuffer(body, np.uint8).reshape(-1, length)


class ByteNet:
    """Tables: per width an array (place, byte, filter); the biases of the filters; the output layer."""

    def __init__(self, classes: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.tables = [rng.normal(0, 0.3 / np.sqrt(w), (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.bias = [np.zeros(FILTERS, np.float32) for _ in WIDTHS]
        self.out = rng.normal(0, 0.1, (FILTERS * len(WIDTHS), classes)).astype(np.float32)
        self.out_bias = np.zeros(classes, np.float32)

    def pooled(self, windows: np.ndarray, places: bool = False):
        """The largest value of each filter in each window, below zero cut off; with the place it stands at."""
        n, length = windows.shape
        values, at = [], []
        for table, bias in zip(self.tables, self.bias):
            span = length - len(table) + 1
            z = np.take(table[0], windows[:, :span], axis=0)
            for j in range(1, len(table)):
                z += np.take(table[j], windows[:, j : j + span], axis=0)
            if places:
                best = z.argmax(1)
                at.append(best)
                top = np.take_along_axis(z, best[:, None, :], 1)[:, 0]
            else:
                top = z.max(1)
            values.append(np.maximum(top + bias, 0))
        return np.concatenate(values, 1), at

    def log_probabilities(self, windows: np.ndarray) -> np.ndarray:
        out = []
        for start in range(0, len(windows), _WINDOWS_AT_ONCE):
            logits = self.pooled(windows[start : start + _WINDOWS_AT_ONCE])[0] @ self.out + self.out_bias
            logits -= logits.max(1, keepdims=True)
            out.append(logits - np.log(np.exp(logits).sum(1, keepdims=True)))
        return np.concatenate(out)

    def train(self, windows: np.ndarray, labels: np.ndarray, epochs: int = EPOCHS, batch: int = 64, rate: float = 3e-3, seed: int = 7) -> None:
        """Cross entropy by Adam. Only the place of a filter's largest value gets a gradient."""
        rng = np.random.default_rng(seed)
        weights = [*self.tables, *self.bias, self.out, self.out_bias]
        first = [np.zeros_like(w) for w in weights]
        second = [np.zeros_like(w) for w in weights]
        step, n_widths = 0, len(WIDTHS)
        for _ in range(epochs):
            order = rng.permutation(len(windows))
            for start in range(0, len(order), batch):
                rows = order[start : start + batch]
                x, y = windows[rows], labels[rows]
                hidden, at = self.pooled(x, places=True)
                logits = hidden @ self.out + self.out_bias
                p = np.exp(logits - logits.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                p[np.arange(len(rows)), y] -= 1
                p /= len(rows)
                back = (p @ self.out.T) * (hidden > 0)
                grads = [np.zeros_like(t) for t in self.tables]
                bias_grads = []
                for k, table in enumerate(self.tables):
                    own = back[:, k * FILTERS : (k + 1) * FILTERS]
                    bias_grads.append(own.sum(0))
                    filters = np.broadcast_to(np.arange(FILTERS), own.shape)
                    for j in range(len(table)):
                        seen = np.take_along_axis(x, at[k] + j, 1)
                        np.add.at(grads[k][j], (seen, filters), own)
                step += 1
                for w, g, m, v in zip(weights, [*grads, *bias_grads, hidden.T @ p, p.sum(0)], first, second):
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        assert len(weights) == 2 * n_widths + 2


def held_out(doc_id: Column) -> Column:
    """Whether CRC-32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _under_bound(rows: DataFrame, wanted: int) -> DataFrame:
    """(doc_id, lang, __h): the rows whose hash lies under a bound of their language, about four times as many as ``wanted``.

    Counting a language first sets its bound, so that what meets in one window grows neither with the table nor with its tasks. Where fewer than
    ``wanted`` rows lie under it (an id that repeats, say), the language has no bound; the least ``wanted`` hashes are the same either way.
    """
    hashed = rows.select("doc_id", "lang", F.xxhash64(F.col("doc_id").cast("string")).alias("__h"))
    counted = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("__rows"))
    share = F.lit(4.0 * wanted) / F.col("__rows")
    bounds = counted.select("lang", F.when(share < 1, (F.lit(2.0**64) * share - F.lit(2.0**63)).cast("bigint")).alias("__bound"))
    # both sides that hold a row a language are written first: their measured size keeps the rows from being shuffled by language
    under = hashed.join(store(bounds, "bounds"), "lang").withColumn("__in", F.col("__bound").isNull() | (F.col("__h") <= F.col("__bound")))
    enough = under.where("__in").groupBy("lang").agg((F.count(F.lit(1)) >= wanted).alias("__enough"))
    met = under.join(store(enough, "enough"), "lang", "left").where(F.col("__in") | ~F.coalesce("__enough", F.lit(False)))
    return met.select("doc_id", "lang", "__h")


def training_windows(docs: DataFrame, docs_per_language: int = DOCS_PER_LANGUAGE, windows_per_doc: int = WINDOWS_PER_DOC) -> DataFrame:
    """(lang, window) of the sample, from documents that are not held out."""
    usable = docs.where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}") & ~held_out(F.col("doc_id")))
    usable_ids = store(usable.select("doc_id", "lang"), "usable")
    least = W.partitionBy("lang").orderBy("__h", "doc_id")
    chosen = _under_bound(usable_ids, docs_per_language).withColumn("__n", F.row_number().over(least)).where(F.col("__n") <= docs_per_language)
    # written first, so that its measured size decides the join: docs_per_language rows a language, while the other side holds whole texts
    chosen = store(chosen.select("doc_id", "lang"), "chosen")
    texts = usable.join(chosen, ["doc_id", "lang"], "left_semi").select("lang", F.col("text").cast("binary").alias("text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for lang, text in zip(*[c.to_pylist() for c in batch.columns]):
                all_windows = windows_of(text)
                picked = sorted({int(i * len(all_windows) / windows_per_doc) for i in range(windows_per_doc)})
                rows += [(lang, all_windows[i].tobytes()) for i in picked]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.binary())], names=["lang", "window"])

    return texts.mapInArrow(cut, "lang string, window binary")


def learn(docs: DataFrame, **bounds: int) -> tuple[list[str], ByteNet] | None:
    """Languages and network; None if there is nothing to learn from."""
    # rows of the bounded sample, put into one order so that reruns agree
    rows = sorted((r["lang"], bytes(r["window"])) for r in training_windows(docs, **bounds).collect())
    if not rows:
        return None
    languages = sorted({lang for lang, _ in rows})
    net = ByteNet(len(languages))
    x = np.frombuffer(b"".join(w for _, w in rows), np.uint8).reshape(-1, WINDOW)
    y = np.array([languages.index(lang) for lang, _ in rows])
    net.train(x, y)
    return languages, net


def judge_texts(texts: list[bytes], net: ByteNet) -> tuple[np.ndarray, np.ndarray]:
    """Place of the language and score of each text; all texts have bytes."""
    windows = [windows_of(t) for t in texts]
    logs = net.log_probabilities(np.concatenate(windows))
    sizes = [len(w) for w in windows]
    starts = np.cumsum([0, *sizes[:-1]])
    filled = np.full(len(logs), float(WINDOW))
    filled[starts + np.array(sizes) - 1] = [len(t) - WINDOW * (k - 1) for t, k in zip(texts, sizes)]
    mean = np.add.reduceat(logs * filled[:, None], starts, axis=0) / np.add.reduceat(filled, starts)[:, None]
    share = np.exp(mean - mean.max(1, keepdims=True))
    share /= share.sum(1, keepdims=True)
    best = share.argmax(1)
    return best, share[np.arange(len(best)), best]


def identify(docs: DataFrame, model: tuple[list[str], ByteNet] | None) -> DataFrame:
    """(doc_id, held_out, lang_pred, score), one row per document."""
    letters = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    asked = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.when(letters, F.col("text").cast("binary")).alias("text"))
    if model is None:
        return asked.select("doc_id", "held_out", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    languages, net = model

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 64):
                piece = batch.slice(start, 64)
                texts = piece.column(2).to_pylist()
                named, scores = ["und"] * len(texts), [0.0] * len(texts)
                places = [i for i, t in enumerate(texts) if t]
                if places:
                    best, share = judge_texts([texts[i] for i in places], net)
                    for i, b, s in zip(places, best, share):
                        named[i], scores[i] = languages[b], float(s)
                yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(1), pa.array(named), pa.array(scores)], names=["doc_id", "held_out", "lang_pred", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return asked.mapInArrow(judge, f"doc_id {kind}, held_out boolean, lang_pred string, score double")
