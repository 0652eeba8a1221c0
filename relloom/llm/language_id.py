"""Language identification by a byte convolutional network.

Training is numpy on the driver over a bounded sample of labelled windows; prediction is
one map over Arrow batches: whole texts are cut into windows of fixed length, windows of
many texts go through the network together, and a text takes the mean of its windows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relloom.llm.common import Batches, map_batches, steps, taken

#: Bytes in a window; the last one of a text is padded with zero bytes.
WINDOW = 256
WIDTHS = (2, 3, 4, 5)
CHANNELS = 8
FILTERS = 12
STRIDE = 1
#: Bounds of the training sample: documents in all, and windows taken of each.
SAMPLE_DOCS = 3000
SAMPLE_WINDOWS = 2
#: A window with too few bytes says little; it counts by its length.
UNKNOWN = "und"


class Network:
    """Embedding, filters of several widths, ReLU, max pooling and softmax."""

    def __init__(self, labels: list[str], seed: int = 7):
        rng = np.random.default_rng(seed)
        self.labels = labels
        self.embedding = rng.normal(0, 0.5, (256, CHANNELS)).astype(np.float32)
        self.embedding[0] = 0
        # one matrix: a filter of width w sees the first w of the widest window's places
        n, widest = FILTERS * len(WIDTHS), max(WIDTHS)
        self.mask = np.zeros((widest, CHANNELS, n), np.float32)
        for k, w in enumerate(WIDTHS):
            self.mask[:w, :, k * FILTERS : (k + 1) * FILTERS] = 1
        self.filters = (rng.normal(0, 1 / np.sqrt(widest * CHANNELS), self.mask.shape) * self.mask).astype(np.float32)
        self.bias = np.zeros(n, np.float32)
        self.out = rng.normal(0, 0.1, (n, len(labels))).astype(np.float32)
        self.out_bias = np.zeros(len(labels), np.float32)

    def places(self, windows: np.ndarray) -> np.ndarray:
        """The embeddings under the filters, a row per place (every ``STRIDE`` bytes to the last)."""
        widest = max(WIDTHS)
        windows = _ended(windows)
        lines = self.embedding[windows]
        b, c = lines.strides[0], lines.strides[1]
        shape = (len(windows), (windows.shape[1] - widest) // STRIDE + 1, widest * CHANNELS)
        view = np.lib.stride_tricks.as_strided(lines, shape, (b, c * STRIDE, lines.strides[2]), writeable=False)
        return view.reshape(-1, widest * CHANNELS)

    def pooled(self, windows: np.ndarray) -> tuple[np.ndarray, ...]:
        rows = self.places(windows)
        n = self.bias.size
        made = (rows @ self.filters.reshape(-1, n)).reshape(len(windows), -1, n)
        at = made.argmax(1)
        top = np.take_along_axis(made, at[:, None], 1)[:, 0] + self.bias
        return rows, at, np.maximum(top, 0)

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        """Softmax of each window (rows of bytes)."""
        rows = self.places(windows)
        n = self.bias.size
        top = (rows @ self.filters.reshape(-1, n)).reshape(len(windows), -1, n).max(1) + self.bias
        return _softmax(np.maximum(top, 0) @ self.out + self.out_bias)

    def fit(self, windows: np.ndarray, classes: np.ndarray, epochs: int = 5, batch: int = 64, rate: float = 0.01,
            seed: int = 7) -> Network:
        """Adam on the cross-entropy; classes weigh alike whatever their share."""
        rng, n = np.random.default_rng(seed), self.bias.size
        weight = len(classes) / np.maximum(np.bincount(classes, minlength=len(self.labels)), 1) / len(self.labels)
        params = [self.embedding, self.filters, self.bias, self.out, self.out_bias]
        moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
        step, widest = 0, max(WIDTHS)
        for _ in range(epochs):
            order = rng.permutation(len(windows))
            for start in range(0, len(order), batch):
                chosen = order[start : start + batch]
                rows, at, top = self.pooled(windows[chosen])
                error = _softmax(top @ self.out + self.out_bias)
                error[np.arange(len(chosen)), classes[chosen]] -= 1
                error *= (weight[classes[chosen]] / len(chosen))[:, None].astype(np.float32)
                to_top = (error @ self.out.T) * (top > 0)
                # each filter's gradient reaches only the place that won its pooling
                place = np.arange(len(chosen))[:, None] * (len(rows) // len(chosen)) + at
                seen = rows[place]  # window, filter, widest * channels
                to_filters = np.einsum("bf,bfk->kf", to_top, seen).reshape(self.filters.shape) * self.mask
                to_rows = to_top[:, :, None] * self.filters.reshape(-1, n).T[None]
                won = np.take_along_axis(
                    _ended(windows[chosen]), (at[:, :, None] * STRIDE + np.arange(widest)).reshape(len(chosen), -1), 1
                ).reshape(-1)
                to_embedding = np.stack(
                    [np.bincount(won, g, 256) for g in to_rows.reshape(-1, CHANNELS).T], 1
                ).astype(np.float32)
                to_embedding[0] = 0
                step += 1
                for p, (m, v), g in zip(
                    params, moments, [to_embedding, to_filters, to_top.sum(0), top.T @ error, error.sum(0)], strict=True
                ):
                    m += 0.1 * (g - m)
                    v += 0.01 * (g * g - v)
                    p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        return self


def _ended(windows: np.ndarray) -> np.ndarray:
    """Windows with zero bytes after them, so that each byte begins a place."""
    return np.pad(windows, ((0, 0), (0, max(WIDTHS) - 1)))


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def windows_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All windows of all texts, A-Z in lower case, each one's row of ``texts`` and bytes of text."""
    raw = pc.ascii_lower(pc.fill_null(texts, "")).cast(pa.large_string())
    offsets = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1]
    size = np.diff(offsets)
    count = -(-size // WINDOW)
    data = np.frombuffer(raw.buffers()[2] or b"", np.uint8)
    out = np.zeros(int(count.sum()) * WINDOW, np.uint8)
    begins = (np.cumsum(count) - count) * WINDOW
    out[taken(begins, size)] = data[offsets[0] : offsets[-1]] if len(raw) else data[:0]
    rows = np.repeat(np.arange(len(raw)), count)
    first = np.arange(len(rows)) - np.repeat(np.cumsum(count) - count, count)
    return out.reshape(-1, WINDOW), rows, np.minimum(np.repeat(size, count) - first * WINDOW, WINDOW)


def _predict(batches: Batches, network: Network | None) -> Batches:
    for batch in batches:
        for part in steps(batch):
            texts = pc.fill_null(part["text"], "")
            spoken = pc.match_substring_regex(texts, r"\p{L}").to_numpy(zero_copy_only=False)
            label = np.full(len(texts), UNKNOWN, object)
            score = np.zeros(len(texts))
            if network is not None:
                windows, rows, sizes = windows_of(texts)
                total = np.zeros((len(texts), len(network.labels)))
                for a in range(0, len(windows), 512):
                    p = network.probabilities(windows[a : a + 512])
                    np.add.at(total, rows[a : a + 512], p * sizes[a : a + 512, None])
                total /= np.maximum(total.sum(1, keepdims=True), 1e-9)
                best = total.argmax(1)
                label = np.where(spoken, np.array(network.labels, object)[best], UNKNOWN)
                score = np.where(spoken, np.clip(total.max(1), 0, 1), 0.0)
            yield pa.RecordBatch.from_arrays(
                [*(part[c] for c in part.schema.names if c != "text"), pa.array(label, pa.string()), pa.array(score)],
                names=[*(c for c in part.schema.names if c != "text"), "lang_pred", "score"],
            )


def held_out(id_col: str = "doc_id") -> Column:
    """crc32 of the identifier as text, modulo 4, is 2; a null identifier is an empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).cast("binary")), F.lit(4)) == 2


def train(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
    sample_docs: int = SAMPLE_DOCS,
) -> Network | None:
    """Network learned from documents that are not held out and have a language and letters.

    At most about ``sample_docs`` documents, spread evenly over the languages, are drawn by
    a hash of identifier and text; of each come ``SAMPLE_WINDOWS`` windows from anywhere in
    the text. ``None`` if there is nothing to learn from.
    """
    usable = docs.where(~held_out(id_col)).select(
        F.col(f"`{lang_col}`").alias("lang"), F.col(f"`{text_col}`").alias("text"),
        F.xxhash64(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")).alias("h"),
    ).where(F.col("lang").isNotNull() & (F.length("text") > 0))
    counts = usable.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(sample_docs).collect()
    if not counts:
        return None
    share = sample_docs / len(counts)
    chance = F.create_map(*[F.lit(x) for r in counts for x in (r["lang"], min(1.0, share / r["count"]))])
    drawn = usable.where(F.pmod("h", F.lit(1 << 20)) < chance[F.col("lang")] * (1 << 20))
    for k in range(SAMPLE_WINDOWS):
        room = F.greatest(F.length("text") - WINDOW, F.lit(0)) + 1
        drawn = drawn.withColumn(f"w{k}", F.substr("text", 1 + F.pmod(F.xxhash64("h", F.lit(k)), room), F.lit(WINDOW)))
    rows = drawn.select("lang", "h", *[f"w{k}" for k in range(SAMPLE_WINDOWS)]).limit(2 * sample_docs).collect()
    rows.sort(key=lambda r: (r["lang"], r["h"]))
    if not rows:
        return None
    labels = sorted({r["lang"] for r in rows})
    pieces = [(r[f"w{k}"], labels.index(r["lang"])) for r in rows for k in range(SAMPLE_WINDOWS)]
    windows, of, _ = windows_of(pa.array([p for p, _ in pieces]))
    full = np.concatenate([[True], of[1:] != of[:-1]])  # the first window of each piece
    return Network(labels).fit(windows[full], np.array([c for _, c in pieces])[of[full]])


def predict(docs: DataFrame, network: Network | None, text_col: str = "text", keep: dict[str, Column] | None = None
            ) -> DataFrame:
    """``lang_pred`` and ``score`` of every whole text beside the columns of ``keep``.

    Null texts and texts without a letter get ``und`` and 0, and so does every text if
    nothing was learned. Repeated rows repeat their result; an empty table gives no rows.
    """
    read = docs.select(*[c.alias(n) for n, c in (keep or {}).items()], F.col(f"`{text_col}`").cast("string").alias("text"))
    carried = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in read.schema if f.name != "text")
    schema = f"{carried}{', ' if carried else ''}lang_pred string, score double"
    return map_batches(read, lambda b: _predict(b, network), schema)


def language_id(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
    sample_docs: int = SAMPLE_DOCS,
) -> DataFrame:
    """Learns from the rows that are not held out and predicts every row."""
    network = train(docs, id_col, text_col, lang_col, sample_docs)
    return predict(docs, network, text_col, {"doc_id": F.col(f"`{id_col}`"), "held_out": held_out(id_col)})
