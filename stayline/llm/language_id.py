"""Language identification by a byte convolutional network, trained in numpy and applied to fixed-length windows.

A window of ``WINDOW`` bytes is embedded, convolved with filters of several widths, reduced to each filter's maximum and
classified by softmax. Training (Adam on cross-entropy) sees a bounded sample: ``SAMPLE`` labelled rows, drawn evenly
over the languages by a hash of the id, two excerpts of each from hashed places. The weights are a few kilobytes. A text
is cut into windows from start to end, the last one padded; its probabilities are the windows' mean, weighted by their
bytes. As a filter is linear, its response is a sum of table rows by byte pair, which needs no products.

Results: null and empty texts, and texts without a letter, are ``und`` with score 0; equal probabilities go to the first
language in order; repeated rows are predicted alike; if no row is labelled, all texts are ``und``; existing columns
of the outputs' names are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from .shared import written

SAMPLE = 4096
EXCERPT = 240
WINDOW = 256
PAD = 256
DEPTH = 8
FILTERS = 8
WIDTHS = (2, 3, 4)
EPOCHS = 8
BATCH = 64
RATE = 0.01
AT_ONCE = 128
UNDETERMINED = "und"
LETTER = regex.compile(r"\p{L}")


@dataclass
class Network:
    languages: list[str]
    embedding: np.ndarray
    filters: dict[int, np.ndarray]  # by width: (width * depth, filters)
    shift: np.ndarray  # of the filters, all widths
    weights: np.ndarray
    bias: np.ndarray
    tables: list = field(default_factory=list, repr=False)

    def _tables(self) -> list:
        """By width: responses to each pair of neighbouring bytes, two bytes of the filter at a time."""
        if not self.tables:
            for width, kernel in self.filters.items():
                single = [self.embedding @ part for part in kernel.reshape(width, DEPTH, FILTERS)]
                pairs = []
                for at in range(0, width, 2):
                    right = single[at + 1] if at + 1 < width else np.zeros_like(single[at])
                    pairs.append((single[at][:, None, :] + right[None, :, :]).reshape(-1, FILTERS).astype(np.float32))
                self.tables.append((width, pairs))
        return self.tables

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        """Of each row of byte values (0 to 255, PAD)."""
        found = []
        for first in range(0, len(windows), AT_ONCE):
            some = windows[first : first + AT_ONCE].astype(np.int32)
            padded = np.concatenate([some, np.full((len(some), 1), PAD, np.int32)], axis=1)
            pair = padded[:, :-1] * (PAD + 1) + padded[:, 1:]
            pooled = []
            for width, tables in self._tables():
                size = WINDOW - width + 1
                response = tables[0].take(pair[:, :size], axis=0)
                for number, table in enumerate(tables[1:], 1):
                    response += table.take(pair[:, 2 * number : 2 * number + size], axis=0)
                pooled.append(response.max(axis=1))
            hidden = np.maximum(np.concatenate(pooled, axis=1) + self.shift, 0)
            found.append(_softmax(hidden @ self.weights + self.bias))
        return np.concatenate(found) if found else np.empty((0, len(self.languages)))

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """Language and score of each whole text."""
        data = [text.encode("utf-8", "surrogatepass") if text and LETTER.search(text) else b"" for text in texts]
        if not self.languages:
            return [UNDETERMINED] * len(texts), [0.0] * len(texts)
        names, scores = [UNDETERMINED] * len(texts), [0.0] * len(texts)
        known = [at for at, row in enumerate(data) if row]
        for first in range(0, len(known), 256):
            group = known[first : first + 256]
            rows = [windows_of(data[at]) for at in group]
            total = self.probabilities(np.concatenate(rows))
            starts = np.cumsum([0, *map(len, rows)])
            for at, a, b in zip(group, starts, starts[1:]):
                weight = np.full(b - a, WINDOW, dtype=np.float64)
                weight[-1] = (len(data[at]) - 1) % WINDOW + 1
                mean = weight @ total[a:b] / weight.sum()
                best = int(mean.argmax())
                names[at], scores[at] = self.languages[best], min(1.0, max(0.0, float(mean[best])))
        return names, scores


def windows_of(data: bytes) -> np.ndarray:
    """All bytes in rows of WINDOW; the last row padded."""
    rows = -(-len(data) // WINDOW)
    values = np.full(rows * WINDOW, PAD, dtype=np.int16)
    values[: len(data)] = np.frombuffer(data, np.uint8)
    return values.reshape(rows, WINDOW)


def _softmax(values: np.ndarray) -> np.ndarray:
    values = np.exp(values - values.max(axis=1, keepdims=True))
    return values / values.sum(axis=1, keepdims=True)


def trained(texts: list[str], labels: list[str], seed: int = 0) -> Network:
    """Fit a network to labelled excerpts."""
    dice = np.random.default_rng(seed)
    languages = sorted(set(labels))
    count = len(languages)
    net = Network(
        languages,
        dice.normal(0, 0.5, (PAD + 1, DEPTH)).astype(np.float32),
        {w: dice.normal(0, (w * DEPTH) ** -0.5, (w * DEPTH, FILTERS)).astype(np.float32) for w in WIDTHS},
        np.zeros(len(WIDTHS) * FILTERS, dtype=np.float32),
        dice.normal(0, 0.2, (len(WIDTHS) * FILTERS, count)).astype(np.float32),
        np.zeros(count, dtype=np.float32),
    )
    if not texts or count < 2:
        return net
    net.embedding[PAD] = 0
    rows = []
    for text in texts:
        data = text.encode("utf-8", "surrogatepass")[: int(dice.integers(16, WINDOW + 1))]  # short texts are seen, too
        rows.append(windows_of(data or b" ")[0])
    data, target = np.array(rows), np.array([languages.index(x) for x in labels])
    values = [net.embedding, *net.filters.values(), net.shift, net.weights, net.bias]
    first, second = [np.zeros_like(x) for x in values], [np.zeros_like(x) for x in values]
    step = 0
    for epoch in range(EPOCHS):
        order = dice.permutation(len(data))
        for start in range(0, len(order), BATCH):
            step += 1
            some = order[start : start + BATCH]
            for x, g, m, v in zip(values, _gradients(net, data[some], target[some]), first, second):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                rate = RATE * (1 - epoch / EPOCHS)
                x -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
            net.embedding[PAD] = 0
    return net


def _gradients(net: Network, data: np.ndarray, target: np.ndarray) -> list[np.ndarray]:
    """Of the mean cross-entropy: embedding, filters by width, shift, weights, bias."""
    size, rows = len(data), np.arange(len(data))[:, None]
    embedded = net.embedding[data]
    pooled, where = [], []
    for width, kernel in net.filters.items():
        count = WINDOW - width + 1
        response = sum(
            embedded[:, at : at + count] @ kernel[at * DEPTH : (at + 1) * DEPTH] for at in range(width)
        )
        best = response.argmax(axis=1)
        where.append(best)
        pooled.append(np.take_along_axis(response, best[:, None, :], axis=1)[:, 0])
    before = np.concatenate(pooled, axis=1) + net.shift
    hidden = np.maximum(before, 0)
    error = _softmax(hidden @ net.weights + net.bias)
    error[np.arange(size), target] -= 1
    error /= size
    back = (error @ net.weights.T) * (before > 0)
    to_embedding, to_filters = np.zeros_like(net.embedding), []
    for number, (width, kernel) in enumerate(net.filters.items()):
        own = back[:, number * FILTERS : (number + 1) * FILTERS]
        gradient = np.zeros_like(kernel).reshape(width, DEPTH, FILTERS)
        for at in range(width):
            byte = data[rows, where[number] + at]
            gradient[at] = np.einsum("nfd,nf->df", net.embedding[byte], own)
            part = kernel[at * DEPTH : (at + 1) * DEPTH]
            np.add.at(to_embedding, byte.ravel(), (own[:, :, None] * part.T[None]).reshape(-1, DEPTH))
        to_filters.append(gradient.reshape(width * DEPTH, FILTERS))
    return [to_embedding, *to_filters, back.sum(axis=0), hidden.T @ error, error.sum(axis=0)]


def sampled(labelled: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Rows draw, doc_id, lang, excerpts: about ``sample`` of them, even over the languages. Texts are cut to excerpts where
    they are read; the languages' sizes are written, so that Spark knows whether they are few enough to be broadcast."""
    usable = labelled.where("lang IS NOT NULL AND text IS NOT NULL")
    counts = written(usable.groupBy("lang").agg(F.count("*").alias("n")), "languages")
    spread = max(1, counts.count())
    places = [
        F.expr(f"substring(text, cast(1 + pmod(xxhash64(doc_id, {n}), greatest(1, length(text) - {EXCERPT} + 1)) AS int), {EXCERPT})")
        for n in (1, 2)
    ]
    draw = F.expr("pmod(xxhash64(doc_id, text, 7), 1000000007) / 1000000007D")
    narrow = usable.select(draw.alias("draw"), "doc_id", "lang", F.array(*places).alias("excerpts"))
    return narrow.join(counts, "lang").where(F.col("draw") * F.col("n") < sample / spread).drop("n")


def fit(labelled: DataFrame, sample: int = SAMPLE) -> Network:
    """Train on a bounded sample of text and lang, even over the languages. Rows: doc_id, text, lang."""
    rows = sampled(labelled, sample).orderBy("draw", "doc_id", "lang", "excerpts").limit(sample).collect()
    texts = [text for row in rows for text in row["excerpts"]]
    return trained(texts, [row["lang"] for row in rows for _ in row["excerpts"]])


def identified(df: DataFrame, network: Network, text: str = "text") -> DataFrame:
    """Add lang_pred and score of each whole text."""
    weights = Network(network.languages, network.embedding, network.filters, network.shift, network.weights, network.bias)

    @F.arrow_udf("struct<lang_pred:string,score:double>")
    def predicted(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            names, scores = weights.predict(batch.to_pylist())
            yield pa.StructArray.from_arrays(
                [pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["lang_pred", "score"]
            )

    found = predicted(F.col("`" + text.replace("`", "``") + "`"))
    return df.withColumn("lang_pred", found).withColumns(
        {"score": F.col("lang_pred.score"), "lang_pred": F.col("lang_pred.lang_pred")}
    )
