"""Language of a text by a small byte convolutional network, trained here in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import forget, private, release, stored

WINDOW = 256  # bytes; every text is cut into windows of this length, the last one padded with zeros
WIDTHS = (2, 3, 4, 5)
FILTERS = 10  # of each width
EMBEDDING = 6
#: Training bound: labelled texts in all, and windows taken of each.
SAMPLE_ROWS, SAMPLE_WINDOWS = 2000, 3
EPOCHS, BATCH, RATE = 7, 64, 0.01
_BLOCK = 128  # windows in one matrix product
UNKNOWN = "und"
OVER_CHANCE = 1.2


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def cut(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(windows, owner, length)``: all bytes of all texts in zero-padded windows."""
    counts = [-(-len(t) // WINDOW) for t in texts]
    flat = np.frombuffer(b"".join(t + bytes(-len(t) % WINDOW) for t in texts), np.uint8)
    owner = np.repeat(np.arange(len(texts)), counts)
    length = np.full(len(owner), WINDOW)
    ends = np.cumsum(counts) - 1
    for i, t in enumerate(texts):
        if t:
            length[ends[i]] = len(t) - (counts[i] - 1) * WINDOW
    return flat.reshape(-1, WINDOW), owner, length


class ByteNet:
    """Byte embedding, filters of several widths, max over positions, softmax."""

    def __init__(self, labels: list[str], seed: int = 7):
        rng = np.random.default_rng(seed)
        wide, n = max(WIDTHS), FILTERS * len(WIDTHS)
        self.labels = labels
        self.table = (rng.normal(size=(256, EMBEDDING)) * 0.5).astype(np.float32)
        self.filters = np.zeros((wide * EMBEDDING, n), np.float32)
        self.mask = np.zeros_like(self.filters)
        for i, w in enumerate(WIDTHS):  # narrow filters have zeros behind
            self.mask[: w * EMBEDDING, i * FILTERS : (i + 1) * FILTERS] = 1
        self.filters += rng.normal(size=self.filters.shape).astype(np.float32) * 0.3 * self.mask
        self.bias = np.zeros(n, np.float32)
        self.out = (rng.normal(size=(n, len(labels))) * 0.1).astype(np.float32)
        self.out_bias = np.zeros(len(labels), np.float32)

    def _patches(self, windows: np.ndarray) -> np.ndarray:
        n, wide = len(windows), max(WIDTHS)
        x = self.table[np.pad(windows, ((0, 0), (0, wide - 1)))]
        s = x.strides
        return np.lib.stride_tricks.as_strided(
            x, (n, WINDOW, wide * EMBEDDING), (s[0], s[1], s[2])).reshape(n * WINDOW, -1)

    def _pooled(self, windows: np.ndarray, places: bool = False):
        z = (self._patches(windows) @ self.filters).reshape(len(windows), WINDOW, -1)
        if not places:
            return np.maximum(z.max(axis=1) + self.bias, 0)
        at = z.argmax(axis=1)
        top = np.take_along_axis(z, at[:, None, :], 1)[:, 0, :]
        return np.maximum(top + self.bias, 0), at

    def _softmax(self, pooled: np.ndarray) -> np.ndarray:
        y = pooled @ self.out + self.out_bias
        y = np.exp(y - y.max(axis=1, keepdims=True))
        return y / y.sum(axis=1, keepdims=True)

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        parts = [self._softmax(self._pooled(windows[i : i + _BLOCK])) for i in range(0, len(windows), _BLOCK)]
        return np.concatenate(parts) if parts else np.zeros((0, len(self.labels)), np.float32)

    def train(self, windows: np.ndarray, target: np.ndarray, weight: np.ndarray, seed: int = 11) -> None:
        """Adam on the cross entropy; only the patch that won the maximum gets a gradient."""
        rng, wide = np.random.default_rng(seed), max(WIDTHS)
        names = ("table", "filters", "bias", "out", "out_bias")
        first = {k: np.zeros_like(getattr(self, k)) for k in names}
        second = {k: np.zeros_like(getattr(self, k)) for k in names}
        step = 0
        for epoch in range(EPOCHS):
            order = rng.permutation(len(windows))
            rate = RATE * (1 - epoch / EPOCHS)
            for i in range(0, len(order), BATCH):
                pick = order[i : i + BATCH]
                w, n = windows[pick], len(pick)
                pooled, at = self._pooled(w, places=True)
                d = self._softmax(pooled)
                d[np.arange(n), target[pick]] -= 1
                d *= (weight[pick] / weight[pick].sum())[:, None]
                back = (d @ self.out.T) * (pooled > 0)
                bytes_at = np.pad(w, ((0, 0), (0, wide - 1)))[
                    np.arange(n)[:, None, None], at[:, :, None] + np.arange(wide)]  # n, filter, place
                patch = self.table[bytes_at].reshape(n, -1, wide * EMBEDDING)
                grad = {
                    "out": pooled.T @ d, "out_bias": d.sum(0), "bias": back.sum(0),
                    "filters": np.einsum("nf,nfp->pf", back, patch) * self.mask,
                }
                into = (back[:, :, None] * self.filters.T[None]).reshape(-1, EMBEDDING)
                grad["table"] = np.zeros_like(self.table)
                np.add.at(grad["table"], bytes_at.reshape(-1), into)
                step += 1
                for k in names:
                    first[k] = 0.9 * first[k] + 0.1 * grad[k]
                    second[k] = 0.999 * second[k] + 0.001 * grad[k] ** 2
                    move = (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
                    setattr(self, k, (getattr(self, k) - rate * move).astype(np.float32))

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """Label and mean probability (weighted by bytes) of whole texts."""
        known = [i for i, t in enumerate(texts) if has_letter(t)] if self.labels else []
        names, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        if known:
            windows, owner, length = cut([texts[i].encode("utf-8", "replace") for i in known])
            p = self.probabilities(windows) * length[:, None]
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            total = np.add.reduceat(p, starts) / np.add.reduceat(length, starts)[:, None]
            for i, k, s in zip(known, total.argmax(1), total.max(1), strict=True):
                names[i], scores[i] = self.labels[k], float(min(1.0, s))
        return names, scores


def training_windows(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``(lang, window)``: at most ``SAMPLE_ROWS`` different texts with letters, equally many of each label.

    Copies count once. Texts are drawn by their hash, at a rate that follows from the number of different texts of the label
    and is somewhat too high, and of those the smallest hashes are taken up to the share of the label, so
    the sample does not depend on the order of the rows. Of a long text the windows are spread over it.
    """
    rows = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}")).select(
        F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), F.xxhash64(text_col).alias("h"))
    texts = stored(rows.select("lang", "h").distinct(), "labelled")
    counts = {r.lang: r["count"] for r in texts.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(SAMPLE_ROWS).collect()}
    share = SAMPLE_ROWS // max(1, len(counts))
    if not counts:
        return rows.select("lang", F.lit(b"").alias("window")).limit(0)
    rate = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, (1.5 * share + 50) / n))])
    drawn = texts.where(F.pmod("h", F.lit(1 << 20)) < rate[F.col("lang")] * (1 << 20))
    # a window over some 1.5 * SAMPLE_ROWS hashes, and 50 more of each label
    drawn = drawn.withColumn("at", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).where(F.col("at") <= share)
    drawn = rows.join(F.broadcast(drawn.select("lang", "h")), ["lang", "h"], "left_semi")

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()  # at most SAMPLE_ROWS texts
        for b in batches:
            langs, hashes, places, parts = [], [], [], []
            for text, lang, h in zip(b["text"].to_pylist(), b["lang"].to_pylist(), b["h"].to_pylist(), strict=True):
                if (lang, h) not in seen and has_letter(text):
                    seen.add((lang, h))
                    raw = text.encode("utf-8", "replace")
                    n = min(SAMPLE_WINDOWS, -(-len(raw) // WINDOW))
                    for at in {k * max(0, len(raw) - WINDOW) // max(1, n - 1) for k in range(n)}:
                        langs.append(lang)
                        hashes.append(h)
                        places.append(at)
                        parts.append(raw[at : at + WINDOW])
            yield pa.RecordBatch.from_pydict({
                "lang": pa.array(langs, pa.string()), "h": pa.array(hashes, pa.int64()), "at": pa.array(places, pa.int64()),
                "window": pa.array(parts, pa.binary())})

    # the copies of a text that lie in different tasks
    return drawn.mapInArrow(windows, "lang string, h long, at long, window binary").distinct().select("lang", "window")


def fit(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang") -> ByteNet:
    """Train on a bounded sample (see ``training_windows``); no labelled text gives a net without labels."""
    got = sorted((r.lang, bytes(r.window)) for r in training_windows(labelled, text_col, lang_col).collect())
    labels = sorted({k for k, _ in got})
    net = ByteNet(labels)
    if got:
        windows = np.frombuffer(b"".join(w.ljust(WINDOW, b"\0") for _, w in got), np.uint8).reshape(-1, WINDOW)
        target = np.array([labels.index(k) for k, _ in got])
        weight = (1 / np.bincount(target))[target].astype(np.float32)  # every label counts alike
        net.train(windows, target, weight)
    return net


def identify(docs: DataFrame, net: ByteNet, text_col: str = "text", name: str = "language") -> DataFrame:
    """``docs`` with a struct column ``name`` (label, score).

    The label is ``und`` with score 0 if the text is null or has no letter (empty texts included),
    or if there was nothing to learn from. Equal texts get equal labels. All other columns pass on.
    """
    model = docs.sparkSession.sparkContext.broadcast(net)  # some 60 kB

    @F.pandas_udf("label string, score double")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        forget()
        for texts in batches:
            label, score = model.value.predict(texts.tolist())
            yield pd.DataFrame({"label": label, "score": score})
        release()

    return docs.withColumn(name, of(F.col(text_col)))


def keep_known(docs: DataFrame, net: ByteNet, text_col: str = "text", least: float = 0.3) -> DataFrame:
    """The rows whose text has a known language with at least this score; their columns unchanged.

    With many labels the floor is ``OVER_CHANCE`` times the probability of a guess instead. If there was
    nothing to learn from, every text with a letter stays.
    """
    if not net.labels:
        return docs.where(F.col(text_col).rlike(r"\p{L}"))
    (name,), least = private(docs.columns, "_language_of_text"), min(least, OVER_CHANCE / len(net.labels))
    return identify(docs, net, text_col, name).where(F.col(name)["score"] >= least).select(*[docs[c] for c in docs.columns])
