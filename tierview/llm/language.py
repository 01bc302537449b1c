"""Language identification by a byte convolutional network, trained and run in numpy.

Bytes are embedded; filters of several widths slide over fixed-length windows, each filter keeps
its greatest response (max pooling), and a softmax layer gives the languages' probabilities. A
text's windows overlap by the widest filter less one byte, so that every byte n-gram is seen;
the text's probabilities are the mean over all its windows, weighted by bytes.

Training reads a bounded sample: at most ``docs_per_lang`` documents a language and about ``docs`` in all,
at least one of each language there is, ``windows_per_doc`` windows of each. Prediction reads every byte
of every text; windows are batched within a text only, so that equal texts get equal results to the last bit.

Defined cases: a null text or one without a letter (Unicode category L) is ``und`` with score 0; a text shorter
than a window is padded with byte 0, which carries no response; with no labelled row every text is
``und``; equal texts get equal results; other columns never matter.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table

UNDETERMINED = "und"
_LETTERLIKE = re.compile(r"[^\W\d_]")


def has_letter(text: str) -> bool:
    """Whether a character is a letter; signs such as ½ or ① are word characters but none."""
    return any(m[0].isalpha() for m in _LETTERLIKE.finditer(text))


@dataclass(frozen=True)
class Settings:
    window: int = 256
    widths: tuple[int, ...] = (2, 3, 4)
    filters: int = 12
    embedding: int = 8
    docs_per_lang: int = 800
    windows_per_doc: int = 3
    docs: int = 100_000
    epochs: int = 6
    batch: int = 64
    rate: float = 0.004
    seed: int = 7


class ByteCnn:
    """The network; ``convolve`` holds all widths as one matrix over the widest, zeros before the narrow ones."""

    def __init__(self, langs: list[str], s: Settings):
        rng = np.random.default_rng(s.seed)
        self.langs, self.s, self.wide = langs, s, max(s.widths)
        n = s.filters * len(s.widths)
        self.embed = rng.normal(0, 0.5, (256, s.embedding)).astype(np.float32)
        self.embed[0] = 0
        self.mask = np.zeros((self.wide * s.embedding, n), np.float32)
        for k, w in enumerate(s.widths):
            self.mask[: w * s.embedding, k * s.filters : (k + 1) * s.filters] = 1
        self.convolve = (rng.normal(0, 1, self.mask.shape) * self.mask / np.sqrt(self.wide * s.embedding / 2)).astype(np.float32)
        self.bias = np.zeros(n, np.float32)
        self.out = rng.normal(0, 0.2, (n, len(langs))).astype(np.float32)
        self.out_bias = np.zeros(len(langs), np.float32)

    def windows(self, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        """All windows of ``data`` and the bytes that each stands for."""
        size, step = self.s.window, self.s.window - self.wide + 1
        n = max(1, -(-max(0, len(data) - self.wide + 1) // step))
        buffer = np.zeros((n - 1) * step + size, np.uint8)
        buffer[: len(data)] = np.frombuffer(data, np.uint8)
        weights = np.full(n, step, np.float64)
        weights[-1] = max(1, len(data) - (n - 1) * step)
        return np.lib.stride_tricks.sliding_window_view(buffer, size)[::step], weights

    def columns(self, x: np.ndarray) -> np.ndarray:
        """[windows, places, wide * embedding] of windows [windows, size]."""
        e = self.embed[x].reshape(len(x), -1)
        d = self.s.embedding
        return np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(e, self.wide * d, axis=1)[:, ::d])

    def pool(self, cols: np.ndarray) -> np.ndarray:
        return (cols.reshape(-1, cols.shape[2]) @ self.convolve).reshape(len(cols), cols.shape[1], -1)

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        h = np.maximum(self.pool(self.columns(x)).max(axis=1) + self.bias, 0)
        z = h @ self.out + self.out_bias
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)

    def fit(self, x: np.ndarray, y: np.ndarray) -> None:
        """Adam on cross entropy, classes weighted alike."""
        s, rng = self.s, np.random.default_rng(self.s.seed + 1)
        weight = (len(y) / np.maximum(np.bincount(y, minlength=len(self.langs)), 1) / len(self.langs)).astype(np.float32)
        params = [self.embed, self.convolve, self.bias, self.out, self.out_bias]
        first, second, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
        d = s.embedding
        steps = s.epochs * -(-len(x) // s.batch)
        for _ in range(s.epochs):
            order = rng.permutation(len(x))
            for at in range(0, len(x), s.batch):
                i = order[at : at + s.batch]
                xb, yb = x[i], y[i]
                cols = self.columns(xb)
                raw = self.pool(cols)
                best = raw.argmax(axis=1)
                h = np.maximum(np.take_along_axis(raw, best[:, None], 1)[:, 0] + self.bias, 0)
                z = h @ self.out + self.out_bias
                z = np.exp(z - z.max(axis=1, keepdims=True))
                p = z / z.sum(axis=1, keepdims=True)
                g = p.copy()
                g[np.arange(len(i)), yb] -= 1
                g *= (weight[yb] / len(i))[:, None]
                gh = (g @ self.out.T) * (h > 0)
                picked = np.take_along_axis(cols, best[:, :, None], 1)  # windows, filters, wide * d
                g_conv = np.einsum("bf,bfk->kf", gh, picked) * self.mask
                g_cols = gh[:, :, None] * (self.convolve.T[None])
                g_embed = np.zeros_like(self.embed)
                for j in range(self.wide):
                    np.add.at(g_embed, np.take_along_axis(xb, best + j, 1), g_cols[:, :, j * d : (j + 1) * d])
                g_embed[0] = 0
                step += 1
                rate = s.rate * (1 - 0.9 * step / steps)
                for p_, m, v, gr in zip(params, first, second, (g_embed, g_conv, gh.sum(0), h.T @ g, g.sum(0))):
                    m *= 0.9
                    m += 0.1 * gr
                    v *= 0.999
                    v += 0.001 * gr * gr
                    p_ -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """Language and score of each text."""
        out: list[tuple[str, float]] = []
        for text in texts:
            if not text or not self.langs or not has_letter(text):
                out.append((UNDETERMINED, 0.0))
                continue
            x, weights = self.windows(text.encode())
            total = np.zeros(len(self.langs))
            for at in range(0, len(x), 64):
                total += weights[at : at + 64] @ self.probabilities(x[at : at + 64])
            best = int(total.argmax())
            out.append((self.langs[best], float(min(1.0, total[best] / weights.sum()))))
        return out


def train(rows: DataFrame, settings: Settings = Settings()) -> ByteCnn:
    """``rows`` (text, lang, key): a bounded sample is chosen by the key's hash and fitted on the driver."""
    s = settings
    rows = rows.where("lang is not null and text is not null").withColumn("__at", F.pmod(F.xxhash64("key"), F.lit(1_000_000)))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(counts)
    sample: list[tuple[str, bytes]] = []
    if langs:
        most = min(s.docs_per_lang, max(1, s.docs // len(langs)))
        # A little more than is wanted is drawn by hash, and the first of each language are taken.
        share = F.create_map(*[F.lit(v) for lang in langs for v in (lang, min(1_000_000, int(1.2e6 * most / counts[lang]) + 1))])
        # Pieces are cut on the executors: what comes here is docs * windows_per_doc * window bytes at most.
        cuts = [F.substring(F.col("text").cast("binary"), (F.pmod(F.xxhash64("key", F.lit(k)), F.greatest(F.octet_length("text") - s.window, F.lit(1))) + 1).cast("int"), F.lit(s.window)) for k in range(s.windows_per_doc)]
        chosen = rows.where(F.col("__at") < F.element_at(share, F.col("lang"))).select("lang", F.array(*cuts).alias("cuts"), F.xxhash64("key").alias("h"))
        taken = dict.fromkeys(langs, 0)
        for r in chosen.orderBy("h", "lang").limit(2 * most * len(langs)).collect():
            taken[r["lang"]] += 1
            if taken[r["lang"]] <= most:
                sample += [(r["lang"], bytes(c)) for c in r["cuts"]]
    net = ByteCnn(langs, s)
    if sample:
        x = np.zeros((len(sample), s.window), np.uint8)
        for i, (_, data) in enumerate(sample):
            x[i, : len(data)] = np.frombuffer(data, np.uint8)
        net.fit(x, np.array([langs.index(lang) for lang, _ in sample]))
    return net


def identify(df: DataFrame, net: ByteCnn, text: str = "text") -> DataFrame:
    """``df`` with lang_pred and score; columns of these names are replaced."""
    df = df.drop("lang_pred", "score")
    at = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = net.predict(batch.column(at).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], [*batch.schema.names, "lang_pred", "score"])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fitted(docs: DataFrame, settings: Settings = Settings()) -> ByteCnn:
    return train(docs.where(~held_out(F.col("doc_id"))).select("text", "lang", F.col("doc_id").alias("key")), settings)


def op9_byte_cnn_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = identify(docs.select("doc_id", "text"), fitted(docs))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
