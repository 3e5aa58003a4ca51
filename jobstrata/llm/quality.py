"""Quality classifier: a byte-level convolutional network in numpy.

Bytes are embedded; learned filters run over overlapping chunks (``2 * STEP``
bytes, one every ``STEP``) that cover the whole text; each filter's largest
answer in the text is kept; a logistic layer turns these into one probability.

The net is fitted on the driver on at most ``SAMPLE_ROWS`` labelled texts of
at most ``SAMPLE_BYTES`` bytes each (a documented bound); scoring is a map over
all rows with weights of some kilobytes.

Defined results: null text counts as empty; an empty text has no chunk and
gets the net's answer to all-zero maxima; no usable label at all gives 0.5
everywhere; a null doc_id is not held out; repeated rows score alike, bit for
bit, whatever stands beside them: scoring adds numbers one by one in a fixed
order and has no matrix product, whose rounding depends on how many rows it has.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import doc_rows, map_slabs, table

STEP, EMBED, FILTERS = 8, 6, 48
SAMPLE_ROWS, SAMPLE_BYTES = 3000, 32_768
EPOCHS, BATCH_DOCS, RATE, DECAY = 20, 64, 0.01, 1e-4
CUT = 0.3


def _blocks(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts on a grid of STEP bytes, each followed by one block of padding.

    Returns the symbols (0 is padding, byte + 1 else) and each text's first
    block, with one more entry past the end.
    """
    size = np.diff(offs)
    n_blocks = -(-size // STEP) + 1
    first = np.concatenate([[0], np.cumsum(n_blocks)])
    out = np.zeros(int(first[-1]) * STEP, np.uint16)
    shift = np.repeat(first[:-1] * STEP - offs[:-1], size)
    out[np.arange(len(data)) + shift] = data.astype(np.uint16) + 1
    return out, first


class ConvNet:
    """embed (257, E), two half filters (STEP * E, 2F), bias (F), out (F), b."""

    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        f = np.float32
        self.w = {
            "embed": r.normal(0, 0.5, (257, EMBED)).astype(f),
            "filters": r.normal(0, (STEP * EMBED) ** -0.5, (STEP * EMBED, 2 * FILTERS)).astype(f),
            "bias": np.zeros(FILTERS, f),
            "out": r.normal(0, 0.3, FILTERS).astype(f),
            "b": np.zeros(1, f),
        }

    def pooled(self, symbols: np.ndarray, first: np.ndarray, where: bool = False):
        """Each filter's largest answer per text; also its block if asked."""
        w = self.w
        x = w["embed"][symbols].reshape(-1, STEP * EMBED)
        y = x @ w["filters"]
        z = y[:, :FILTERS]
        z[:-1] += y[1:, FILTERS:]
        z += w["bias"]
        z[first[1:] - 1] = 0  # a text's padding block starts no chunk
        np.maximum(z, 0, out=z)
        top = np.maximum.reduceat(z, first[:-1], axis=0)
        if not where:
            return top, None, None
        at = np.empty(top.shape, np.int64)
        for i in range(len(top)):
            at[i] = first[i] + z[first[i] : first[i + 1]].argmax(0)
        return top, at, x

    def answer(self, top: np.ndarray) -> np.ndarray:
        s = np.clip(top @ self.w["out"] + self.w["b"][0], -30, 30).astype(np.float64)
        return 1 / (1 + np.exp(-s))

    def tables(self) -> np.ndarray:
        """(STEP, 257, 2F): what a symbol at each place of a block adds to each half filter."""
        w = self.w["filters"].astype(np.float64).reshape(STEP, EMBED, 2 * FILTERS)
        embed = self.w["embed"].astype(np.float64)
        out = np.zeros((STEP, len(embed), 2 * FILTERS))
        for e in range(EMBED):
            out += embed[None, :, e, None] * w[:, None, e, :]
        return out.astype(self.w["filters"].dtype)

    def scores(self, data: np.ndarray, offs: np.ndarray, tables: np.ndarray | None = None) -> np.ndarray:
        """One score for each text, which follows from the text alone."""
        tables = self.tables() if tables is None else tables
        symbols, first = _blocks(data, offs)
        grid = symbols.reshape(-1, STEP)
        y, more = (np.empty((len(grid), 2 * FILTERS), tables.dtype) for _ in range(2))
        np.take(tables[0], grid[:, 0], axis=0, out=y, mode="clip")
        for k in range(1, STEP):
            np.take(tables[k], grid[:, k], axis=0, out=more, mode="clip")
            y += more
        z = y[:, :FILTERS]
        z[:-1] += y[1:, FILTERS:]
        z += self.w["bias"]
        z[first[1:] - 1] = 0
        top = np.maximum(np.maximum.reduceat(z, first[:-1], axis=0), 0).astype(np.float64)
        total = np.full(len(top), float(self.w["b"][0]))
        for f in range(FILTERS):
            total += top[:, f] * float(self.w["out"][f])
        return np.array([1 / (1 + math.exp(-min(max(x, -30.0), 30.0))) for x in total.tolist()])

    def gradient(self, data, offs, labels) -> dict[str, np.ndarray]:
        w = self.w
        symbols, first = _blocks(data, offs)
        top, at, x = self.pooled(symbols, first, True)
        d = ((self.answer(top) - labels) / len(labels)).astype(np.float32)
        g = {"out": top.T @ d, "b": d.sum(keepdims=True)}
        dz = d[:, None] * w["out"] * (top > 0)  # only the largest answers pass it on
        g["bias"] = dz.sum(0)
        g["filters"], g["embed"] = np.zeros_like(w["filters"]), np.zeros_like(w["embed"])
        grid = symbols.reshape(-1, STEP)
        for half in (0, 1):
            rows = np.minimum(at + half, len(grid) - 1)
            cols = slice(half * FILTERS, (half + 1) * FILTERS)
            g["filters"][:, cols] = np.einsum("dfk,df->kf", x[rows], dz)
            dx = dz[:, :, None] * w["filters"][:, cols].T[None]
            np.add.at(g["embed"], grid[rows].reshape(-1), dx.reshape(-1, EMBED))
        return g

    def fit(self, texts: list[bytes], labels: np.ndarray, seed: int = 11) -> ConvNet:
        """Adam on the logistic loss; both classes weigh as they occur."""
        r = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.w.items()}
        v2 = {k: np.zeros_like(v) for k, v in self.w.items()}
        step = 0
        for epoch in range(EPOCHS):
            rate = RATE * (1 - epoch / EPOCHS)
            order = r.permutation(len(texts))
            for i in range(0, len(order), BATCH_DOCS):
                pick = order[i : i + BATCH_DOCS]
                parts = [np.frombuffer(texts[k], np.uint8) for k in pick]
                offs = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
                g = self.gradient(np.concatenate(parts), offs, labels[pick])
                step += 1
                for k in self.w:
                    gk = g[k] + DECAY * self.w[k]
                    m[k] += 0.1 * (gk - m[k])
                    v2[k] += 0.01 * (gk * gk - v2[k])
                    self.w[k] -= (rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v2[k] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
        return self


def held_out(id_col) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))


def training_sample(docs: DataFrame, labels: DataFrame, label_col: str, rows: int = SAMPLE_ROWS) -> tuple[list[bytes], np.ndarray]:
    """At most ``rows`` labelled texts that aren't held out, by id hash."""
    ids = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label"))
        .where(F.col("doc_id").isNotNull() & F.col("label").isNotNull() & ~held_out("doc_id"))
        .orderBy(F.xxhash64("doc_id"), "label")
        .limit(rows)
    )
    # the sample is bounded by `rows`, and so is the broadcast
    got = (
        doc_rows(docs)
        .where(F.octet_length("text").between(1, SAMPLE_BYTES))
        .join(F.broadcast(ids), "doc_id")
        .select("doc_id", "label", F.encode("text", "UTF-8").alias("text"))
        .collect()
    )
    got.sort(key=lambda x: (x[0], x[1], bytes(x[2])))
    return [bytes(x[2]) for x in got], np.array([x[1] for x in got], np.float32)


def trained(docs: DataFrame, labels: DataFrame, label_col: str = "quality") -> ConvNet | None:
    texts, y = training_sample(docs, labels, label_col)
    return ConvNet().fit(texts, y) if texts else None


def scored(docs: DataFrame, net: ConvNet | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score of every row."""

    tables = net.tables() if net else None

    def run(slab) -> dict:
        return {"doc_id": slab.ids, "score": net.scores(slab.data, slab.offs, tables) if net else np.full(len(slab), 0.5)}

    return map_slabs(doc_rows(docs, id_col, text_col), run, "doc_id long, score double", 1 << 18)


def op1_quality(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    net = trained(docs, table(spark, sf_dir, "labels"))
    return scored(docs, net).select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
