"""Operator 8: toxicity by class-conditional Kneser-Ney models.

Two letter models of order 6 (histories stay within a word) give each word a toxic and an ordinary
log-likelihood by interpolated Kneser-Ney: the highest order uses the class's own counts, lower orders its
continuation counts, and the lowest two orders, on which rare expressions fall back, are shared counts over
all documents. A document's score is a logistic function of its length-normalised log-likelihood ratios (per
word, per root of words, and of its three most telling words), fitted on labelled rows, each scored
without the counts of its part of the labelled rows.

Scale: a letter gram is 6 bytes packed in a long, so the counts are one combined aggregate over longs (each
task sends its distinct grams once, however frequent they are). Lower orders follow from the gram table alone.
All counts are exact and stay in Spark tables that grow with the input. Each distinct gram of a chunk of documents is
given its ratio by a join; nothing of the model is collected or broadcast but the logistic function's few weights and
the bounded sample that they are fitted on.
"""

from __future__ import annotations

import zlib
from collections import Counter
from typing import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlour.llm.bloom import may_hold, members
from parlour.llm.common import dropped, written_freed as written

ORDER = 6  # letters of a gram, the word's edges included
SHARED = 2  # orders up to this one are shared by the classes
DISCOUNT = 0.75
RATIO_UNIT = 2.0**-24  # ratios are whole numbers of it, so that sums do not depend on the order of rows
PORTION_CHARS = 2_000_000  # texts whose grams are counted together, about
CHUNK_CHARS = 16_000_000  # texts whose words are listed together, at most (but one text at least)
WORD_BYTES = 250_000  # words whose letters are looked at together: some 60 bytes of arrays for each
CALIBRATION_ROWS = 4000  # labelled rows on which the logistic function is fitted, at most
FOLDS = 4  # a calibration row is scored without the counts of its fold
TOP = 3

# letters and all non-ASCII bytes stay, everything else separates words; 1 and 2 mark a word's edges
_WORD_BYTES = bytes(b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words(text: str) -> list[bytes]:
    return text.lower().encode("utf-8", "replace").translate(_WORD_BYTES).split()


def gram_positions(ws: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every letter (and closing edge) of the words: the packed bytes that end there, at most ORDER of
    them and none from before the word's opening edge; the number of those bytes; the word's index."""
    data = np.frombuffer(b"".join(b"\x01" + w + b"\x02" for w in ws), np.uint8)
    size = np.fromiter(map(len, ws), np.int64, len(ws)) + 2
    starts = np.cumsum(size) - size
    word = np.repeat(np.arange(len(ws)), size)
    depth = np.arange(len(data)) - starts[word]  # bytes since the opening edge
    gram = data.astype(np.int64)
    for k in range(1, ORDER):
        gram[k:] |= np.where(depth[k:] >= k, data[:-k].astype(np.int64) << (8 * k), 0)
    real = depth > 0
    return gram[real], np.minimum(depth[real] + 1, ORDER), word[real]


def _word_counts(texts: list[str]) -> tuple[list[bytes], np.ndarray]:
    """The distinct words of texts and how often each occurs."""
    count: Counter = Counter()
    for t in texts:
        count.update(words(t))
    return list(count), np.fromiter(count.values(), np.int64, len(count))


def _gram_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(gram, class) counts, made of the distinct words of some texts at a time. Class -1: all texts, and the grams
    that the shared orders need."""
    for b in batches:
        for cls, part in b.groupby("cls", sort=True):
            for texts in _portions(part["text"].tolist()):
                ws, n = _word_counts(texts)
                if not ws:
                    continue
                g, _, w = gram_positions(ws)
                if cls < 0:
                    short = g >> (8 * (SHARED + 1)) == 0
                    g = np.where(short, g, g & ((1 << (8 * (SHARED + 1))) - 1))
                u, at = np.unique(g, return_inverse=True)
                yield pd.DataFrame({"cls": np.int32(cls), "gram": u, "n": np.bincount(at, n[w], len(u)).astype(np.int64)})


def _portions(texts: list, most: int = PORTION_CHARS) -> Iterator[list]:
    """Texts (or words) of ``most`` characters together, about."""
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and size < most:
            size += len(texts[end])
            end += 1
        yield texts[at:end]
        at = end


def _lower(t: DataFrame, order: int, values: list[str]) -> DataFrame:
    """Continuation counts of ``order`` from the table of ``order + 1``: a gram of full length adds one type
    to its suffix; one that begins with the word's edge has no extension to the left and keeps its count."""
    full = F.shiftright("gram", 8 * order) > 0
    suffix = F.when(full, F.col("gram").bitwiseAND(F.lit((1 << (8 * order)) - 1))).otherwise(F.col("gram"))
    return t.select(suffix.alias("gram"), *[F.when(full, F.signum(v).cast("long")).otherwise(F.col(v)).alias(v) for v in values]) \
            .groupBy("gram").agg(*[F.sum(v).alias(v) for v in values])


def _names(model: int) -> tuple[str, str]:
    return f"n0_{model}", f"n1_{model}"


def fit_counts(texts: DataFrame, labelled: DataFrame) -> dict:
    """Gram tables by order: (gram, n0_j, n1_j), the counts of both classes in model j. Model 0 counts all labelled
    rows, model f + 1 all but those of fold f. ``texts``: (text) of all documents; ``labelled``: (text, cls) and
    perhaps fold (0 to FOLDS - 1); without it there is model 0 alone."""
    folds = FOLDS if "fold" in labelled.columns else 0
    part = F.col("cls") + 2 * F.col("fold") if folds else F.col("cls")
    rows = labelled.select("text", part.cast("int").alias("cls")).mapInPandas(_gram_rows, "cls int, gram long, n long")
    fold, sums = F.floor(F.col("cls") / 2), []
    for j in range(folds + 1):
        for c, name in enumerate(_names(j)):
            sums.append(F.sum(F.when((F.col("cls") % 2 == c) & (fold != j - 1), F.col("n")).otherwise(0)).alias(name))
    values = [v for j in range(folds + 1) for v in _names(j)]
    tables = {ORDER: written(rows.groupBy("gram").agg(*sums), "op8-grams")}
    for k in range(ORDER - 1, SHARED, -1):
        tables[k] = written(_lower(tables[k + 1], k, values), "op8-grams")
    # the shared orders come from all texts: their grams of SHARED + 1 letters, cut to continuation counts
    shared = (texts.select("text", F.lit(-1).alias("cls")).mapInPandas(_gram_rows, "cls int, gram long, n long")
              .groupBy("gram").agg(F.sum("n").alias("n")))
    shared = written(shared, "op8-shared")
    for k in range(SHARED, 0, -1):
        above, shared = shared, written(_lower(shared, k, ["n"]), "op8-shared")
        if k == SHARED:
            dropped(above)
        tables[k] = shared.select("gram", *[F.col("n").alias(v) for v in values])
    return tables


def _of_length(k: int) -> Column:
    """Grams of exactly ``k`` bytes (no byte is 0)."""
    return (F.shiftright("gram", 8 * (k - 1)) > 0) & (F.shiftright("gram", 8 * k) == 0)


def gram_ratios(grams: DataFrame, tables: dict, models: list[int]) -> DataFrame:
    """(gram, r0, r1, ...) for distinct ``grams`` (gram): of each model, log P(last letter | those before it, toxic) less the same
    for ordinary, in units of RATIO_UNIT. One order after the other, each gram meets its own counts, those of its history
    and the estimate of its suffix; a history has at most 256 grams and a suffix 256 extensions, so no key is hot."""
    suffixes = [F.col("gram").bitwiseAND(F.lit((1 << (8 * k)) - 1)) for k in range(1, ORDER)]
    need = written(grams.select(F.explode(F.array("gram", *suffixes)).alias("gram")).distinct(), "op8-suffixes")
    values = [v for j in models for v in _names(j)]
    every, lower, made = None, None, [need]
    for k in range(1, ORDER + 1):
        own = tables[k].filter(_of_length(k)).select("gram", *values)
        hist = own.groupBy(F.shiftright("gram", 8).alias("hist")).agg(
            *[F.sum(v).alias(f"t{v}") for v in values], *[F.sum(F.signum(v)).alias(f"k{v}") for v in values])
        at = need.filter(_of_length(k)).withColumn("hist", F.shiftright("gram", 8)).join(own, "gram", "left").join(hist, "hist", "left")
        if lower is None:
            at = at.withColumns({f"l{v}": F.lit(1 / 256) for v in values})
        else:
            at = at.withColumn("suffix", F.col("gram").bitwiseAND(F.lit((1 << (8 * (k - 1))) - 1))).join(lower, "suffix")
        p = [F.when(F.col(f"t{v}") > 0, F.least(F.greatest(F.coalesce(v, F.lit(0)) - DISCOUNT, F.lit(0.0)) / F.col(f"t{v}"), F.lit(1.0))
                    + DISCOUNT * F.col(f"k{v}") / F.col(f"t{v}") * F.col(f"l{v}")).otherwise(F.col(f"l{v}")).alias(f"p{v}") for v in values]
        at = written(at.select("gram", *p), "op8-order")
        made.append(at)
        lower = at.select(F.col("gram").alias("suffix"), *[F.col(f"p{v}").alias(f"l{v}") for v in values])
        every = at if every is None else every.unionByName(at)
    least = lambda v: F.log(F.greatest(F.col(f"p{v}"), F.lit(1e-12)))
    ratio = [F.round((least(n1) - least(n0)) / RATIO_UNIT).cast("long") for n0, n1 in map(_names, models)]
    out = written(every.select("gram", *[r.alias(f"r{i}") for i, r in enumerate(ratio)]), "op8-ratios")
    dropped(*made)
    return out


def word_ratios(ws: list[bytes], tables: dict) -> np.ndarray:
    """The ratio of each of a few words in model 0."""
    g, _, w = gram_positions(ws)
    spark = tables[ORDER].sparkSession
    got = {r["gram"]: r["r0"] for r in gram_ratios(spark.createDataFrame([(int(x),) for x in np.unique(g)], "gram long"), tables, [0]).collect()}
    return np.bincount(w, [got[x] for x in g.tolist()], len(ws)) * RATIO_UNIT


def _counted_words(texts: list[str]) -> tuple[list[bytes], bytes]:
    """Each text's words as numbers with their counts, and the numbered words, joined by spaces; all of it deflated.

    Words of many texts have the lowest numbers, so that a text's numbers lie close together; those of about as many texts
    stand in the order of their letters."""
    number: dict = {}
    held = []
    for t in texts:
        ids = np.fromiter((number.setdefault(w, len(number)) for w in words(t)), np.uint32)
        u, n = np.unique(ids, return_counts=True)
        held.append((u, n.astype(np.uint32)))
    ws = list(number)
    in_texts = np.zeros(len(ws), np.int64)
    for u, _ in held:
        in_texts[u] += 1
    order = np.array(sorted(range(len(ws)), key=ws.__getitem__), np.int64)
    order = order[np.argsort(-np.frexp(in_texts[order])[1], kind="stable")]
    rank = np.empty(len(ws), np.uint32)
    rank[order] = np.arange(len(ws), dtype=np.uint32)
    out = []
    for u, n in held:
        at = np.argsort(rank[u])
        # bytes of equal weight side by side: mostly zeros, which compress well
        both = np.stack([np.diff(rank[u][at], prepend=np.uint32(0)), n[at]])
        out.append(zlib.compress(both.view(np.uint8).reshape(-1, 4).T.tobytes()))
    return out, zlib.compress(b" ".join(ws[i] for i in order))


def _uncounted(counts: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of a text's words, ascending, and their counts."""
    step, n = np.frombuffer(zlib.decompress(counts), np.uint8).reshape(4, -1).T.copy().view(np.uint32).reshape(2, -1)
    return np.cumsum(step, dtype=np.int64), n


def _chunked(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """For each text the chunk (a run of texts of one task), its place there and its counted words; on a chunk's first text
    the chunk's words."""
    from pyspark import TaskContext

    chunk = TaskContext.get().partitionId() << 32
    for b in batches:
        texts, at, frames = b.tolist(), 0, []
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and size < CHUNK_CHARS:
                size += len(texts[end])
                end += 1
            counts, ws = _counted_words(texts[at:end])
            frames.append(pd.DataFrame({"chunk": chunk, "place": np.arange(end - at), "counts": counts, "words": [ws] + [None] * (end - at - 1)}))
            chunk += 1
            at = end
        yield pd.concat(frames, ignore_index=True) if frames else pd.DataFrame({"chunk": [], "place": [], "counts": [], "words": []})


def _features(counts: bytes, ratios: np.ndarray) -> tuple:
    u, n = _uncounted(counts)
    total = int(n.sum())
    if not total:
        return 0.0, 0.0, 0.0, 0.0
    r = ratios[u]
    whole = float((r * n).sum())  # whole numbers: the same in any order
    last = np.argsort(r, kind="stable")[-TOP:]
    most = np.sort(np.repeat(r[last], np.minimum(n[last], TOP)))[-TOP:] * RATIO_UNIT
    return whole * RATIO_UNIT / total, whole * RATIO_UNIT / np.sqrt(total), np.clip(most, 0, 12).sum() / TOP, np.log1p(total)


def _chunk_grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(chunk, gram): the distinct grams of each chunk's words."""
    for b in batches:
        for chunk, ws in zip(b["chunk"].tolist(), b["words"]):
            some = [np.unique(gram_positions(part)[0]) for part in _portions(ws.encode("utf-8", "replace").split(b" "), WORD_BYTES)]
            yield pd.DataFrame({"chunk": chunk, "gram": np.unique(np.concatenate(some))})


def _inflated(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Chunks with their words as text; those without words are left out."""
    for b in batches:
        for chunk, ws in zip(b["chunk"].tolist(), b["words"]):
            if plain := zlib.decompress(ws).decode("utf-8", "replace"):
                yield pd.DataFrame({"chunk": [chunk], "words": [plain]})


def document_features(docs: DataFrame, tables: dict, models: list[int]) -> DataFrame:
    """(row, x): length-normalised ratios of each text of ``docs`` (row, text, at), in the model ``models[at]``: per word, per root of words, of its
    TOP words, and the logarithm of the number of words.

    A chunk's texts keep numbers for their words; numbers and words are deflated, as they are stored once and shuffled once. The distinct grams of a chunk meet the ratios in a join on the gram, to
    which a gram comes once a chunk however frequent it is; ratios and texts of a chunk then meet in one group, bounded by
    the chunk, and the features go back to the rows by chunk and place."""
    chunked = F.pandas_udf(_chunked, "struct<chunk: long, place: long, counts: binary, words: binary>").asNondeterministic()
    held = written(docs.select("row", "at", chunked("text").alias("c")).select("row", "at", "c.*"), "op8-counted")
    listed = held.filter(F.col("words").isNotNull()).select("chunk", "words")
    grams = written(listed.mapInPandas(lambda batches: _chunk_grams(_inflated(batches)), "chunk long, gram long"), "op8-chunk-grams")
    ratios = gram_ratios(grams.select("gram").distinct(), tables, models)
    names = [f"r{j}" for j in range(len(models))]

    def features(texts: pd.DataFrame, given: pd.DataFrame) -> pd.DataFrame:
        texts = texts.sort_values("place", ignore_index=True)
        ws = zlib.decompress(texts["words"][0]).split()
        ratio = np.zeros((len(names), len(ws)))
        if ws:
            given, done = given.sort_values("gram", ignore_index=True), 0
            for part in _portions(ws, WORD_BYTES):
                g, _, w = gram_positions(part)
                where = np.searchsorted(given["gram"].to_numpy(), g)
                for j, r in enumerate(names):  # whole numbers: exact in any order
                    ratio[j, done:done + len(part)] = np.bincount(w, given[r].to_numpy()[where], len(part))
                done += len(part)
        x = [_features(c, ratio[int(j)]) for c, j in zip(texts["counts"], texts["at"])]
        return pd.DataFrame({"chunk": texts["chunk"], "place": texts["place"], "x": x})

    met = (held.select("chunk", "place", "at", "counts", "words").groupBy("chunk")
           .cogroup(grams.join(ratios, "gram").groupBy("chunk")).applyInPandas(features, "chunk long, place long, x array<double>"))
    return held.select("row", "chunk", "place").join(met, ["chunk", "place"]).select("row", "x")


def fit_logistic(x: np.ndarray, y: np.ndarray, steps: int = 60) -> dict:
    """Logistic regression by Newton steps on standardised features, slightly regularised."""
    if len(y) == 0:
        return {"mean": np.zeros(4), "scale": np.ones(4), "w": np.array([0.5, 0.5, 0.5, 0, -2.0])}
    mean, scale = x.mean(0), x.std(0) + 1e-6
    z = np.concatenate([(x - mean) / scale, np.ones((len(x), 1))], 1)
    w, ridge = np.zeros(5), np.array([0.1] * 4 + [0.001])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        w += np.clip(np.linalg.solve((z * (p * (1 - p) + 1e-9)[:, None]).T @ z + np.diag(ridge), z.T @ (y - p) - ridge * w), -1, 1)
    return {"mean": mean, "scale": scale, "w": w}


def score_features(x: np.ndarray, fit: dict) -> np.ndarray:
    z = (x - fit["mean"]) / fit["scale"]
    return 1 / (1 + np.exp(-np.clip(z @ fit["w"][:4] + fit["w"][4], -40, 40)))


def fit_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
                 calibration_rows: int = CALIBRATION_ROWS) -> dict:
    """Fit on ``docs`` (all texts count for the shared orders) and ``labels`` (the training rows alone).

    Null labels and identifiers are left out; of repeated labels the largest holds. All labelled rows count. The
    logistic function is fitted on at most ``calibration_rows`` of them, each scored by the model without its fold."""
    text = F.coalesce(F.col(text_col), F.lit("")).alias("text")
    fold = F.pmod(F.xxhash64("lab_id", F.lit(11)), F.lit(FOLDS)).cast("int")
    lab = (labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
           .groupBy(F.col(id_col).alias("lab_id")).agg(F.max(label_col).cast("int").alias("cls")).withColumn("fold", fold))
    keyed = docs.select(F.col(id_col).alias("lab_id"), text)
    few = written(lab.orderBy(F.xxhash64("lab_id", F.lit(7)), "lab_id").limit(calibration_rows), "op8-calibration")
    # labels grow with the documents: the same shuffled join at every size, never a broadcast, but texts that a filter
    # of fixed size says have no label stay out of it
    labelled = may_hold(members(lab.select(F.xxhash64("lab_id").alias("h"))))
    tables = fit_counts(docs.select(text), keyed.filter(labelled(F.xxhash64("lab_id"))).join(lab.hint("merge"), "lab_id"))
    held = keyed.join(F.broadcast(few), "lab_id").select(F.struct("lab_id", F.col("cls").alias("y")).alias("row"), "text", F.col("fold").alias("at"))
    got = document_features(held, tables, list(range(1, FOLDS + 1)))
    got = got.select("row.lab_id", "row.y", *[F.col("x")[j].alias(f"x{j}") for j in range(4)]).toPandas()
    got = got.sort_values(list(got.columns), ignore_index=True)
    return {"tables": tables, "fit": fit_logistic(got[["x0", "x1", "x2", "x3"]].to_numpy(), got["y"].to_numpy(float))}


def toxicity_scores(docs: DataFrame, model: dict, text_col: str = "text", score_col: str = "score",
                    carry: list[str] | None = None) -> DataFrame:
    """``docs`` with ``score`` (0 to 1) appended. A null text counts as empty; a text without words has ratios
    of zero; repeated rows get equal scores; an empty table stays empty. Other columns pass unread, through one
    shuffle; ``carry`` names those to keep, if not all."""
    fit = model["fit"]

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield pd.Series(score_features(np.stack(b.to_list()), fit) if len(b) else np.zeros(0))

    kept = docs.columns if carry is None else carry
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return document_features(rows.withColumn("at", F.lit(0)), model["tables"], [0]).select("row.*", score("x").alias(score_col))
