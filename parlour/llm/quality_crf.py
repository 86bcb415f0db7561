"""Operator 5: quality classifier. A linear-chain conditional random field labels every line good or bad.

A line's features are shares of byte classes, word repetition and length, its own and those of the lines
before and after it. Training gives each line its document's label and maximises the conditional likelihood
(full-batch Adam on numpy) over a bounded sample of labelled documents. Scoring runs forward-backward
on whole documents; a document's quality is the length-weighted mean of its lines' marginals of "good", calibrated to a probability on the same sample.

Scale: scoring is a map over the documents with the weights (about 50 numbers) in the closure: no shuffle.
The training sample is bounded by ``sample_docs`` documents and ``sample_lines`` lines, whatever the input.
"""

from __future__ import annotations

import math
from operator import eq
from typing import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SAMPLE_DOCS = 2500  # documents the field is fitted on, at most
SAMPLE_LINES = 200_000  # lines of them, at most
SEGMENT = 32  # training cuts longer documents into segments of so many lines

# byte classes: 0 other punctuation, 1 upper case, 2 lower case or non-ASCII, 3 digit, 4 space, 5 bar, 6 symbol, 7 exclamation
_CLASS = np.zeros(256, np.uint8)
_CLASS[65:91], _CLASS[97:123], _CLASS[128:], _CLASS[48:58] = 1, 2, 2, 3
_CLASS[[32, 9, 10, 11, 12, 13]], _CLASS[ord("|")], _CLASS[ord("!")] = 4, 5, 7
for _c in b"*&%$#@^~<>{}[]\\=+_":
    _CLASS[_c] = 6
N_CLASSES, N_OWN = 8, 15


def line_features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features of all lines, lines per text, length of each line in bytes); an empty text is one empty line."""
    data = [t.encode("utf-8", "replace") for t in texts]
    lines = [x for d in data for x in d.split(b"\n")]
    n_lines = np.fromiter((d.count(b"\n") + 1 for d in data), np.int64, len(data))
    size = np.fromiter(map(len, lines), np.int64, len(lines))
    own = np.zeros((len(lines), N_OWN), np.float32)
    if not lines:
        return np.zeros((0, 3 * N_OWN + 1), np.float32), n_lines, size
    cls = _CLASS[np.frombuffer(b"\n".join(lines) + b"\n", np.uint8)]
    starts = np.concatenate(([0], np.cumsum(size + 1)[:-1]))
    per = np.maximum(size, 1)
    for c in range(N_CLASSES):
        n = np.add.reduceat((cls == c).astype(np.uint8), starts, dtype=np.int64)
        own[:, c] = (n - (c == 4)) / per  # without the line's own end
    words = [x.split() for x in lines]
    n_words = np.fromiter(map(len, words), np.int64, len(lines))
    many = np.maximum(n_words, 1)
    own[:, 8] = np.fromiter((sum(map(eq, w, w[1:])) for w in words), np.int64, len(lines)) / many
    own[:, 9] = 1 - np.fromiter((len(set(w)) for w in words), np.int64, len(lines)) / many
    own[:, 10] = np.log1p(size) / 8
    own[:, 11] = np.minimum(size / many / 16, 4)
    own[:, 12] = n_words == 0
    first = np.zeros(len(lines), bool)
    first[np.concatenate(([0], np.cumsum(n_lines)[:-1]))] = True
    own[1:, 13] = np.fromiter(map(eq, lines[1:], lines[:-1]), bool, len(lines) - 1) & ~first[1:] & (size[1:] > 0)
    own[1:, 14] = np.fromiter((bool(a) and bool(b) and (a[-1] == b[0] or a[-1] == b[-1]) for a, b in zip(words, words[1:])), bool, len(lines) - 1) & ~first[1:]
    before, after = np.zeros_like(own), np.zeros_like(own)
    before[1:] = own[:-1]
    before[first] = 0
    after[:-1] = own[1:]
    after[:-1][first[1:]] = 0
    return np.concatenate([own, before, after, np.ones((len(lines), 1), np.float32)], 1), n_lines, size


def marginals(logit: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """P(good) of each line of one document: ``logit`` is each line's state score of good against bad,
    ``trans[i, j]`` the score of state j after i. Forward-backward on log-odds."""
    n = len(logit)
    e = np.exp(np.clip(trans, -30, 30)).tolist()
    (e00, e01), (e10, e11) = e

    def sweep(x: list[float], a: float, b: float, c: float, d: float) -> list[float]:
        out, m = [0.0] * len(x), 0.0
        for i, v in enumerate(x):
            out[i] = m
            s = m + v
            if s > 0:
                r = math.exp(-s)
                m = math.log((b * r + d) / (a * r + c))
            else:
                r = math.exp(s)
                m = math.log((b + d * r) / (a + c * r))
        return out

    x = logit.tolist()
    fwd = sweep(x, e00, e01, e10, e11)
    bwd = sweep(x[::-1], e00, e10, e01, e11)[::-1]
    return 1 / (1 + np.exp(-np.clip(np.array(fwd) + np.array(bwd) + logit, -40, 40))) if n else np.zeros(0)


def fit_crf(x: np.ndarray, n_lines: np.ndarray, good: np.ndarray, steps: int = 120, l2: float = 1e-3) -> dict:
    """Weights and transitions by conditional maximum likelihood; every line of a document has its label."""
    if len(good) == 0 or good.min() == good.max():  # nothing to learn from: the prior decides
        w = np.zeros(x.shape[1], np.float64)
        w[-1] = 0.0 if len(good) == 0 else (4.0 if good[0] else -4.0)
        return {"w": w, "trans": np.zeros((2, 2))}
    starts = np.concatenate(([0], np.cumsum(n_lines)[:-1]))
    seg = [(s + k, min(SEGMENT, n - k), y) for s, n, y in zip(starts, n_lines, good) for k in range(0, n, SEGMENT)]
    t_max = max(n for _, n, _ in seg)
    at = np.zeros((len(seg), t_max), np.int64)
    live = np.zeros((len(seg), t_max))
    for i, (s, n, _) in enumerate(seg):
        at[i, :n] = np.arange(s, s + n)
        live[i, :n] = 1
    y = np.array([g for _, _, g in seg], np.int64)
    w, tr = np.zeros(x.shape[1]), np.zeros((2, 2))
    m1, m2 = np.zeros(len(w) + 4), np.zeros(len(w) + 4)
    x64 = x.astype(np.float64)
    total = live.sum()
    for step in range(1, steps + 1):
        u = (x64 @ w)[at]
        psi = np.stack([np.zeros_like(u), u], 2)
        la, lb = np.zeros((len(seg), t_max, 2)), np.zeros((len(seg), t_max, 2))
        la[:, 0] = psi[:, 0]
        for t in range(1, t_max):
            la[:, t] = psi[:, t] + np.logaddexp(la[:, t - 1, :1] + tr[0], la[:, t - 1, 1:] + tr[1])
        for t in range(t_max - 2, -1, -1):
            nxt = psi[:, t + 1] + lb[:, t + 1]
            v = np.logaddexp(tr[:, 0] + nxt[:, :1], tr[:, 1] + nxt[:, 1:])
            lb[:, t] = np.where(live[:, t + 1, None] > 0, v, 0)
        post = la + lb
        p = 1 / (1 + np.exp(np.clip(post[:, :, 0] - post[:, :, 1], -40, 40)))
        residual = np.zeros(len(x))
        mask = live > 0
        residual[at[mask]] = (y[:, None] - p)[mask]
        g_w = x64.T @ residual / total - l2 * w
        pair = la[:, :-1, :, None] + tr + (psi + lb)[:, 1:, None, :]
        pair = np.exp(pair - np.logaddexp.reduce(pair, axis=(2, 3), keepdims=True)) * live[:, 1:, None, None]
        seen = np.zeros((2, 2))
        for k in (0, 1):
            seen[k, k] = live[y == k, 1:].sum()
        g_t = (seen - pair.sum((0, 1))) / total - l2 * tr
        g = np.concatenate([g_w, g_t.ravel()])
        m1 = 0.9 * m1 + 0.1 * g
        m2 = 0.99 * m2 + 0.01 * g * g
        move = 0.2 * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-8)
        w, tr = w + move[:-4], tr + move[-4:].reshape(2, 2)
    return {"w": w, "trans": tr}


def score_texts(texts: list[str], model: dict) -> np.ndarray:
    """Length-weighted mean of the lines' marginals, calibrated; an empty text is one empty line."""
    if len(texts) > 64:  # a few texts at a time: features of all words of a batch would be large
        return np.concatenate([score_texts(texts[i : i + 64], model) for i in range(0, len(texts), 64)])
    x, n_lines, size = line_features(texts)
    logit = x.astype(np.float64) @ model["w"]
    out = np.empty(len(texts))
    at = 0
    for i, n in enumerate(n_lines.tolist()):
        out[i] = _mean(marginals(logit[at : at + n], model["trans"]), size[at : at + n])
        at += n
    return 1 / (1 + np.exp(-np.clip(model["slope"] * _odds(out) + model["offset"], -40, 40)))


def held_out(id_col, folds: int, fold: int):
    """True where crc32 of the identifier as text, modulo ``folds``, is ``fold``; a null identifier is not held out."""
    return F.coalesce(F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(folds)) == fold, F.lit(False))


def fit_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
                sample_docs: int = SAMPLE_DOCS, sample_lines: int = SAMPLE_LINES) -> dict:
    """Fit on at most ``sample_docs`` of the labelled documents and ``sample_lines`` of their lines, taken in the order of a
    hash of their identifier; a document with over a tenth of these lines is passed over.

    Null labels and identifiers are left out. The sample (bounded, so broadcast) selects its texts; lines are counted
    in Spark, so that only line features within the bound reach the driver."""
    lab = (labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
           .groupBy(F.col(id_col).alias("lab_id")).agg(F.max(label_col).cast("int").alias("lab_y"))
           .orderBy(F.xxhash64("lab_id"), "lab_id").limit(sample_docs))
    rows = (docs.select(F.col(id_col).alias("lab_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
            .join(F.broadcast(lab), "lab_id"))
    size = rows.groupBy("lab_id").agg(F.sum(F.size(F.split("text", "\n"))).alias("lines")).filter(F.col("lines") <= sample_lines // 10)
    so_far = F.sum("lines").over(Window.orderBy(F.xxhash64("lab_id"), "lab_id"))  # of the sample: at most sample_docs rows
    rows = rows.join(F.broadcast(size.withColumn("so_far", so_far).filter(F.col("so_far") <= sample_lines).select("lab_id")), "lab_id")
    id_type = dict(rows.dtypes)["lab_id"]

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x, n, size = line_features(b["text"].tolist())
            ends = np.cumsum(n)
            yield pd.DataFrame({"lab_id": b["lab_id"], "y": b["lab_y"],
                                "x": [x[e - k : e].astype(np.float32).tobytes() for e, k in zip(ends, n)],
                                "size": [size[e - k : e].tobytes() for e, k in zip(ends, n)]})

    got = rows.mapInPandas(features, f"lab_id {id_type}, y int, x binary, size binary").toPandas().sort_values(["lab_id", "x"], ignore_index=True)
    dim = 3 * N_OWN + 1
    parts = [np.frombuffer(b, np.float32).reshape(-1, dim) for b in got["x"]]
    n = np.array([len(p) for p in parts], np.int64)
    x = np.concatenate(parts) if parts else np.zeros((0, dim), np.float32)
    return calibrated(fit_crf(x, n, got["y"].to_numpy(np.int64)), parts, got["size"], got["y"].to_numpy(float))


def calibrated(model: dict, parts: list[np.ndarray], sizes, y: np.ndarray) -> dict:
    """``model`` with a slope and offset that turn the log-odds of a document's mean marginal into the log-odds
    of its label (one-dimensional logistic regression, Newton steps, slightly regularised)."""
    z = np.array([_odds(_mean(marginals(p.astype(np.float64) @ model["w"], model["trans"]), np.frombuffer(b, np.int64))) for p, b in zip(parts, sizes)])
    ab = np.array([1.0, 0.0])
    if len(y) and 0 < y.mean() < 1:
        f = np.stack([z, np.ones_like(z)], 1)
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(f @ ab, -30, 30)))
            g = f.T @ (y - p) - 0.1 * (ab - [1, 0])
            ab = ab + np.clip(np.linalg.solve((f * (p * (1 - p))[:, None]).T @ f + 0.1 * np.eye(2), g), -2, 2)
    return model | {"slope": max(float(ab[0]), 0.1), "offset": float(ab[1])}


def _mean(p: np.ndarray, size: np.ndarray) -> float:
    return float(p @ (size + 1) / (size + 1).sum())


def _odds(v):
    v = np.clip(v, 1e-6, 1 - 1e-6)
    return np.log(v / (1 - v))


def quality_scores(docs: DataFrame, model: dict, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``docs`` with ``score`` (0 to 1) appended. A null text counts as empty; an empty text is scored as one
    empty line; repeated rows get equal scores; an empty table stays empty. Other columns pass unread."""
    out = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(score_texts(texts.tolist(), model))

    out = out.withColumn("score", score("text"))
    return out.select("row.*", F.col("score").alias(score_col))
