"""Quality classifier: a linear-chain conditional random field over lines.

Every line of a document is labelled good or bad. Its features are shares of
character classes, word lengths and repetitions of the line and of the lines
beside it; the chain's transition weights make neighbours agree. The marginal
of "good" of each line, by forward-backward, weighted by the line's length,
averages to the document's score.

The field is fitted on the driver on a bounded sample of labelled documents
(``fit_rows`` of at most ``fit_lines`` lines each), lines taking their
document's label; everything is scored in one pass over whole texts, in NumPy
batches, without a shuffle. Labels, language, source and id are no features.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textscan
from .bpe import chunks
from .common import lean, table

OWN = 14
WIDTH = 3 * OWN + 2  # own, line before, line after, at the start, at the end

_KIND = np.zeros(256, np.int64)  # 0 other
_KIND[97:123] = 1
_KIND[65:91] = 2
_KIND[48:58] = 3
_KIND[[0x20, *range(0x09, 0x0E)]] = 4
_KIND[[ord(c) for c in "!?"]] = 5
_KIND[[ord(c) for c in ".,;:'\"()-"]] = 6
_KIND[[ord(c) for c in "#$%&*@~^|<>{}[]\\/_=+`"]] = 7
_KIND[128:192] = 8  # inside a code point
_KIND[192:] = 9
KINDS = 10


def line_features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features, weights, owner) of all lines; a text without lines is one empty line."""
    raw = [t.encode() for t in texts]
    data = np.frombuffer(b"\n".join([*raw, b""]), np.uint8)
    ends = np.flatnonzero(data == 10)
    starts = np.concatenate([[0], ends[:-1] + 1]) if len(ends) else np.zeros(0, np.int64)
    owner = np.searchsorted(np.cumsum([len(r) + 1 for r in raw]), starts, side="right")
    n = len(starts)
    if not n:
        return np.zeros((0, OWN)), np.zeros(0), np.zeros(0, np.int64)
    line_of = np.cumsum(data == 10) - (data == 10)
    counts = np.bincount(line_of * KINDS + _KIND[data], minlength=n * KINDS).reshape(n, KINDS).astype(float)
    counts[:, 4] -= 1  # the line's own end
    w = textscan.words(raw)
    word_line = np.searchsorted(ends, w.starts)
    n_words = np.bincount(word_line, minlength=n)
    again = np.zeros(len(w.hashes))
    if len(again) > 1:
        again[1:] = (w.hashes[1:] == w.hashes[:-1]) & (word_line[1:] == word_line[:-1])
    repeats = np.bincount(word_line, weights=again, minlength=n)
    last = data[np.maximum(w.ends - 1, 0)]
    odd_end = np.bincount(word_line, weights=np.isin(_KIND[last], (5, 7)), minlength=n)
    alone = np.bincount(word_line, weights=(w.ends - w.starts == 1) & (_KIND[data[w.starts]] == 7), minlength=n)
    # Distinct words of a line, and lines met before in the text.
    order = np.lexsort((w.hashes, word_line))
    h, wl = w.hashes[order], word_line[order]
    new = np.ones(len(h), bool)
    if len(h) > 1:
        new[1:] = (h[1:] != h[:-1]) | (wl[1:] != wl[:-1])
    distinct = np.bincount(wl, weights=new, minlength=n)
    line_hash = textscan.piece_hashes(textscan._BYTES[data], starts, ends)
    order = np.lexsort((np.arange(n), line_hash, owner))
    seen = np.zeros(n)
    if n > 1:
        seen[order[1:]] = (line_hash[order[1:]] == line_hash[order[:-1]]) & (owner[order[1:]] == owner[order[:-1]])
    size = np.maximum(counts[:, [0, 1, 2, 3, 4, 5, 6, 7, 9]].sum(1), 1)
    letters = np.maximum(counts[:, 1] + counts[:, 2] + counts[:, 9], 1)
    some = np.maximum(n_words, 1)
    own = np.stack(
        [
            np.log1p(size),
            counts[:, 2] / letters,
            counts[:, 7] / size,
            counts[:, 5] / size,
            counts[:, 3] / size,
            counts[:, 6] / size,
            counts[:, 9] / size,
            counts[:, 0] / size,
            (ends - starts) / some / 10.0,
            repeats / some,
            distinct / some,
            odd_end / some,
            alone / some,
            seen,
        ],
        1,
    )
    return own, size, owner


def with_neighbours(own: np.ndarray, owner: np.ndarray) -> np.ndarray:
    n = len(own)
    x = np.zeros((n, WIDTH))
    if not n:
        return x
    x[:, :OWN] = own
    same = owner[1:] == owner[:-1]
    x[1:, OWN : 2 * OWN] = own[:-1] * same[:, None]
    x[:-1, 2 * OWN : 3 * OWN] = own[1:] * same[:, None]
    x[:, -2], x[:, -1] = 1, 1
    x[1:, -2] = ~same
    x[:-1, -1] = ~same
    return x


class Chains:
    """Chains of a batch, walked in step: place t of all chains that are longer than t."""

    def __init__(self, owner: np.ndarray):
        first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]])) if len(owner) else np.zeros(0, np.int64)
        size = np.diff(np.append(first, len(owner))) if len(owner) else np.zeros(0, np.int64)
        order = np.argsort(-size, kind="stable")
        self.first, self.size = first[order], size[order]
        falling = -self.size
        self.live = [int(np.searchsorted(falling, -t, side="left")) for t in range(int(self.size.max(initial=0)))]

    def marginals(self, emit: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """(marginals of good, summed marginals of neighbour pairs, log partition sum).

        emit: score of good less that of bad; move[a, b]: score of b after a.
        """
        n = len(emit)
        score = np.stack([np.zeros(n), emit], 1)
        top = np.maximum(emit, 0)[:, None]
        local = np.exp(score - top)
        step = np.exp(move - move.max())
        alpha, beta, scale = np.empty((n, 2)), np.ones((n, 2)), np.empty(n)
        for t, live in enumerate(self.live):
            at = self.first[:live] + t
            a = local[at] if not t else (alpha[at - 1] @ step) * local[at]
            scale[at] = a.sum(1)
            alpha[at] = a / scale[at][:, None]
        pair = np.zeros((2, 2))
        for t in range(len(self.live) - 2, -1, -1):
            at = self.first[: self.live[t + 1]] + t
            ahead = local[at + 1] * beta[at + 1] / scale[at + 1][:, None]
            beta[at] = ahead @ step.T
            pair += (alpha[at].T @ ahead) * step
        log_z = float(np.log(scale).sum() + top.sum() + move.max() * (n - len(self.first)))
        both = alpha * beta
        return both[:, 1] / both.sum(1), pair, log_z


@dataclass
class Model:
    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    bias: float
    move: np.ndarray
    #: score of every text when the sample held fewer than two labels
    constant: float | None = None

    def line_marginals(self, texts: list[str]):
        own, weight, owner = line_features(texts)
        x = (with_neighbours(own, owner) - self.mean) / self.spread
        good, _, _ = Chains(owner).marginals(x @ self.weights + self.bias, self.move)
        return good, weight, owner

    def score(self, texts: list[str]) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        good, weight, owner = self.line_marginals(texts)
        return np.clip(np.bincount(owner, weights=good * weight, minlength=len(texts)) / np.bincount(owner, weights=weight, minlength=len(texts)), 0, 1)


def fit(own: np.ndarray, owner: np.ndarray, label: np.ndarray, rounds: int = 120, decay: float = 1e-3) -> Model:
    """Weights of largest penalised conditional likelihood, by full-batch Adam; label: of each line."""
    if not len(label) or label.min() == label.max():
        return Model(np.zeros(WIDTH), np.ones(WIDTH), np.zeros(WIDTH), 0.0, np.zeros((2, 2)), float(label[0]) if len(label) else 1.0)
    x = with_neighbours(own, owner)
    mean, spread = x.mean(0), x.std(0) + 1e-6
    x = (x - mean) / spread
    chains = Chains(owner)
    y = label.astype(float)
    same = owner[1:] == owner[:-1]
    seen = np.zeros((2, 2))
    np.add.at(seen, (label[:-1][same], label[1:][same]), 1)
    theta, m, v = np.zeros(WIDTH + 5), np.zeros(WIDTH + 5), np.zeros(WIDTH + 5)
    for k in range(1, rounds + 1):
        w, bias, move = theta[:WIDTH], theta[WIDTH], theta[WIDTH + 1 :].reshape(2, 2)
        good, pair, _ = chains.marginals(x @ w + bias, move)
        miss = (good - y) / len(y)
        grad = np.concatenate([x.T @ miss, [miss.sum()], ((pair - seen) / len(y)).ravel()])
        grad += decay * theta
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        theta = theta - 0.08 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
    return Model(mean, spread, theta[:WIDTH], float(theta[WIDTH]), theta[WIDTH + 1 :].reshape(2, 2))


def train(docs: DataFrame, labels: DataFrame, *, fit_rows: int = 4000, fit_lines: int = 128) -> Model:
    """Fits on at most fit_rows labelled rows with crc32(doc_id) mod 4 other than 2, of at most fit_lines lines.

    The rows of smallest hash are taken, so the sample doesn't depend on how
    the tables are partitioned. Labels that are null are passed over.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    usable = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("label"))
    usable = usable.where(~held_out("doc_id"))
    chosen = usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)

    def run(batches):
        for batch in batches:
            ids, labels_ = batch.column(0), batch.column(2)
            texts = [t or "" for t in batch.column(1).to_pylist()]
            own, _, owner = line_features(texts)
            count = np.bincount(owner, minlength=len(texts))
            stop = np.cumsum(count)
            blobs = [own[s:e].astype(np.float32).tobytes() if e - s <= fit_lines else b"" for s, e in zip((stop - count).tolist(), stop.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([ids, labels_, pa.array(blobs, pa.binary())], names=["doc_id", "label", "lines"])

    rows = docs.join(F.broadcast(chosen), "doc_id").select("doc_id", "text", F.col("label").cast("int").alias("label"))
    got = rows.mapInArrow(lean(run), "doc_id long, label int, lines binary").toPandas().sort_values(["doc_id", "label"])
    got = got[got["lines"].map(len) > 0].drop_duplicates("doc_id")
    if not len(got):
        return fit(np.zeros((0, OWN)), np.zeros(0, np.int64), np.zeros(0, np.int64))
    each = [np.frombuffer(b, np.float32).reshape(-1, OWN) for b in got["lines"]]
    size = np.array([len(e) for e in each])
    label = (got["label"].to_numpy() >= 1).astype(np.int64)
    return fit(np.concatenate(each).astype(float), np.repeat(np.arange(len(each)), size), np.repeat(label, size))


def held_out(id_col: str):
    return F.crc32(F.col(id_col).cast("string")) % 4 == 2


def quality_scores(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    *,
    threshold: float = 0.7,
    fit_rows: int = 4000,
    fit_lines: int = 128,
    model: Model | None = None,
) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row.

    labels: (doc_id, quality); of unlike labels of one id the lower counts.
    Null and empty texts are scored as one empty line. Without labels of both
    kinds every score is the one label, or 1. model: one that is fitted already.
    Each row is scored for itself,
    rows of one id and rows without one too (these aren't held out). Other
    columns are ignored.
    """
    one = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    given = one.sparkSession.sparkContext.broadcast(model or train(one, labels, fit_rows=fit_rows, fit_lines=fit_lines))

    def run(batches):
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for first, part in chunks(texts, 700_000):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(part)), pa.array(given.value.score(part), pa.float64())], names=["doc_id", "score"])

    scored = one.mapInArrow(lean(run), "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(held_out("doc_id"), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def accepted(docs: DataFrame, model: Model, text_col: str = "text", *, threshold: float = 0.7) -> DataFrame:
    """Rows of docs, with all their columns, whose score reaches the threshold: scored and chosen in one pass, without a join."""
    given, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            texts = [t or "" for t in batch.column(at).to_pylist()]
            for first, part in chunks(texts, 700_000):
                yield batch.slice(first, len(part)).filter(pa.array(given.value.score(part) >= threshold))

    return docs.mapInArrow(lean(run), docs.schema)


def op4_quality_crf(spark, sf_dir):
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
