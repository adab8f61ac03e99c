"""Language identification with a byte-level convolutional network, trained here in numpy.

A window of WINDOW bytes is embedded byte by byte, filters of several widths
slide over it, each keeps its largest response, and a softmax layer turns these
into language probabilities. As a byte has 256 values only, embedding and filter
collapse at prediction into one table of 256 rows for each filter tap, so a
convolution is a sum of look-ups. A document's whole text is cut into windows;
their log-probabilities are averaged, weighted by their letters.

Training reads a bounded sample of labelled texts: MAX_DOCS in all, an equal
number for each language, those with the least hashes, each text once, and of
each at most WINDOWS windows spread over the whole text. Prediction reads
the text and nothing else.

Defined cases: null text, or text without a letter, is `und` with score 0; with
no labelled text to learn from all documents are `und`; ties between languages
go to the first in order; null doc_ids are not held out and not learned from;
repeated rows get equal answers; empty tables give empty results; other columns
don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm import kernels as K
from tessella.llm import spread as S

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 16
EMBED = 10
MAX_DOCS = 2400
WINDOWS = 6
EPOCHS = 6
BATCH = 64
UND = "und"

LETTER = np.zeros(256, bool)
for _a, _b in (("A", "Z"), ("a", "z")):
    LETTER[ord(_a) : ord(_b) + 1] = True


@dataclass
class Network:
    langs: list[str]
    embed: np.ndarray  # (256, EMBED); byte 0, which pads, is 0
    filters: list[np.ndarray]  # by width: (width, EMBED, FILTERS)
    bias: np.ndarray  # (widths * FILTERS)
    out: np.ndarray  # (widths * FILTERS, languages)
    out_bias: np.ndarray

    def tables(self) -> list[list[np.ndarray]]:
        return [[(self.embed @ tap).astype(np.float32) for tap in f] for f in self.filters]

    def pooled(self, x: np.ndarray, tables: list[list[np.ndarray]], where: bool = False):
        """(windows, filters) largest responses, and their places if asked for."""
        best, places = [], []
        for taps in tables:
            width = len(taps)
            n = x.shape[1] - width + 1
            response = taps[0][x[:, :n]]
            for j in range(1, width):
                response += taps[j][x[:, j : j + n]]
            if where:
                at = response.argmax(axis=1)
                places.append(at)
                best.append(np.take_along_axis(response, at[:, None, :], axis=1)[:, 0])
            else:
                best.append(response.max(axis=1))
        return np.concatenate(best, axis=1) + self.bias, places

    def log_probabilities(self, x: np.ndarray, tables: list[list[np.ndarray]]) -> np.ndarray:
        z = np.maximum(self.pooled(x, tables)[0], 0) @ self.out + self.out_bias
        z -= z.max(axis=1, keepdims=True)
        return z - np.log(np.exp(z).sum(axis=1, keepdims=True))


def gradients(net: Network, x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
    """Of the mean loss over windows x of languages y: embedding, filters, bias, output, output bias."""
    n = len(x)
    raw, places = net.pooled(x, net.tables(), True)
    hidden = np.maximum(raw, 0)
    z = hidden @ net.out + net.out_bias
    z = np.exp(z - z.max(axis=1, keepdims=True))
    dz = z / z.sum(axis=1, keepdims=True)
    dz[np.arange(n), y] -= 1
    dz /= n
    dh = (dz @ net.out.T) * (raw > 0)
    d_embed, d_filters = np.zeros_like(net.embed), []
    for k, f in enumerate(net.filters):
        g = dh[:, k * FILTERS : (k + 1) * FILTERS]
        d = np.zeros_like(f)
        for j in range(len(f)):
            bytes_ = x[np.arange(n)[:, None], places[k] + j]  # (n, FILTERS)
            e = net.embed[bytes_]  # (n, FILTERS, EMBED)
            d[j] = np.einsum("nf,nfe->ef", g, e)
            np.add.at(d_embed, bytes_, g[:, :, None] * f[j].T[None])
        d_filters.append(d)
    d_embed[0] = 0
    return [d_embed, *d_filters, dh.sum(axis=0), hidden.T @ dz, dz.sum(axis=0)]


def train(x: np.ndarray, y: np.ndarray, langs: list[str], seed: int = 7) -> Network:
    """Softmax regression on max-pooled filters by Adam; x: (n, WINDOW) bytes, y: language numbers."""
    rng = np.random.default_rng(seed)
    net = Network(langs, rng.normal(0, 0.5, (256, EMBED)), [rng.normal(0, 1 / np.sqrt(w * EMBED), (w, EMBED, FILTERS)) for w in WIDTHS], np.zeros(len(WIDTHS) * FILTERS), rng.normal(0, 0.1, (len(WIDTHS) * FILTERS, len(langs))), np.zeros(len(langs)))
    net.embed[0] = 0
    params = [net.embed, *net.filters, net.bias, net.out, net.out_bias]
    m, v, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for _ in range(EPOCHS):
        perm = rng.permutation(len(x))
        for i in range(0, len(x), BATCH):
            grads = gradients(net, x[perm[i : i + BATCH]], y[perm[i : i + BATCH]])
            step += 1
            for p, g, a, b in zip(params, grads, m, v, strict=True):
                a *= 0.9
                a += 0.1 * g
                b *= 0.999
                b += 0.001 * g * g
                p -= 0.005 * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
    return net


def cut_windows(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """((windows, WINDOW) bytes padded with 0, document of each) over all of every text."""
    size = np.diff(off)
    n = -(-size // WINDOW)
    doc = np.repeat(np.arange(len(size)), n)
    start = (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)) * WINDOW + off[:-1][doc]
    at = start[:, None] + np.arange(WINDOW)
    x = np.where(at < off[1:][doc][:, None], data[np.minimum(at, max(len(data) - 1, 0))] if len(data) else 0, 0)
    return x.astype(np.uint8), doc


def remainder(mod: int) -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % mod


def spread_windows(data: np.ndarray) -> np.ndarray:
    """At most WINDOWS windows of one text, over its whole length."""
    x, _ = cut_windows(data, np.array([0, len(data)]))
    return x[np.unique(np.linspace(0, len(x) - 1, WINDOWS).astype(int))]


def sample(docs: DataFrame, max_docs: int) -> list[tuple[str, np.ndarray]]:
    """(language, windows): an equal number of different texts for each language, at most max_docs in all; by the hash of the text.

    Copies count once, whatever share of a language they are. Windows are cut
    where texts are read; so many bytes for each text sampled come back, no text.
    """
    labelled = docs.where("lang is not null and text is not null and text <> ''").select("lang", "text", F.xxhash64("text").alias("key"))
    counts = {r[0]: r[1] for r in labelled.groupBy("lang").agg(F.count_distinct("key")).collect()}
    if not counts:
        return []
    each = max(1, max_docs // len(counts))
    # a share of the hash range that holds about twice the number wanted of each language, then the least hashes
    share = F.lit(1.0)
    for lang, n in sorted(counts.items()):
        share = F.when(F.col("lang") == lang, F.lit(min(1.0, 2.0 * each / n + 20.0 / n))).otherwise(share)
    h = (F.pmod("key", F.lit(1 << 30)) / float(1 << 30)).alias("h")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = K.column_bytes(batch.column("text"))
            held = [spread_windows(data[a:b]).tobytes() for a, b in zip(off[:-1], off[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(held, pa.binary())], ["lang", "h", "key", "windows"])

    few = S.map_arrow(labelled.select("lang", h, "key", "text").where(F.col("h") < share), cut, "lang string, h double, key long, windows binary")
    least = Window.partitionBy("lang").orderBy("h", "key")
    rows = few.dropDuplicates(["lang", "key"]).withColumn("_r", F.row_number().over(least)).where(F.col("_r") <= each)
    return [(r["lang"], np.frombuffer(r["windows"], np.uint8).reshape(-1, WINDOW)) for r in rows.orderBy("lang", "_r").collect()]


def fit(docs: DataFrame, max_docs: int = MAX_DOCS) -> Network | None:
    """docs: what may be learned from; lang and text are read."""
    rows = sample(docs, max_docs)
    if not rows:
        return None
    langs = sorted({lang for lang, _ in rows})
    return train(np.concatenate([x for _, x in rows]), np.concatenate([np.full(len(x), langs.index(lang)) for lang, x in rows]), langs)


def has_letter(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    count = np.concatenate([[0], np.cumsum(LETTER[data], dtype=np.int64)])
    out = count[off[1:]] > count[off[:-1]]
    high = np.concatenate([[0], np.cumsum(data >= 0x80, dtype=np.int64)])
    for i in np.flatnonzero(~out & (high[off[1:]] > high[off[:-1]])):
        out[i] = any(c.isalpha() for c in data[off[i] : off[i + 1]].tobytes().decode())
    return out


def scores(net: Network, data: np.ndarray, off: np.ndarray, tables: list[list[np.ndarray]]) -> np.ndarray:
    """(documents, languages) mean log-probabilities, windows weighted by their letters (and one)."""
    total = np.zeros((len(off) - 1, len(net.langs)))
    weight = np.zeros(len(off) - 1)
    x, doc = cut_windows(data, off)
    for i in range(0, len(x), 512):
        part, of = x[i : i + 512], doc[i : i + 512]
        w = LETTER[part].sum(axis=1) + (part >= 0x80).sum(axis=1) / 2 + 1.0
        np.add.at(total, of, net.log_probabilities(part, tables) * w[:, None])
        np.add.at(weight, of, w)
    return total / np.maximum(weight, 1)[:, None]


def identify(docs: DataFrame, net: Network | None) -> DataFrame:
    """Per document: doc_id, lang_pred, score (the probability of lang_pred)."""
    x = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    if net is None:
        return x.select("doc_id", F.lit(UND).alias("lang_pred"), F.lit(0.0).alias("score"))
    model = docs.sparkSession.sparkContext.broadcast(net)  # about 50 KB

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net, tables = model.value, model.value.tables()
        for batch in batches:
            for i, j, data, off in K.pieces(batch.column(1), 1 << 19):
                p = np.exp(scores(net, data, off, tables))
                p /= p.sum(axis=1, keepdims=True)
                best = p.argmax(axis=1)
                ok = has_letter(data, off)
                langs = [net.langs[b] if k else UND for b, k in zip(best, ok, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(langs, pa.string()), pa.array(np.where(ok, p.max(axis=1), 0.0))], ["doc_id", "lang_pred", "score"])

    return S.map_arrow(x, predict, "doc_id long, lang_pred string, score double")
