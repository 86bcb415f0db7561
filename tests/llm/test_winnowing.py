"""Operator 13 against winnowing in plain Python."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from parlour.llm import winnowing as wn


def words(t):
    return [w for w in re.split(r"[\x20\x09-\x0d]+", t) if w]


def marks(grams, window):
    """Positions that winnowing keeps: the least of every window, the rightmost of equal ones."""
    if len(grams) < window:
        windows = [range(len(grams))] if grams else []
    else:
        windows = [range(i, i + window) for i in range(len(grams) - window + 1)]
    return sorted({min(w, key=lambda i: (grams[i], -i)) for w in windows})


def texts(rng, n):
    out = ["", None, "   \n\t ", "one", " one", "a b c", "é ü \n ß", "x " * 40, "y\t" * 7, "𝒳𝒴𝒵 " * 30]
    for _ in range(n):
        out.append(rng.choice(["", " "]) + rng.choice([" ", "  \n", "\t"]).join(rng.choice("abcde") * rng.randrange(1, 3) for _ in range(rng.randrange(0, 70))))
    return out


def signed34(h):
    return h >> 30


@pytest.mark.parametrize("k,window", [(5, 8), (3, 4), (1, 1), (2, 5), (7, 6)])
def test_marks_equal_plain_winnowing(spark, k, window):
    df = spark.createDataFrame([(t or "",) for t in texts(random.Random(k), 60)], "t string")
    df = df.select("t", wn.gram_hashes(F.col("t"), k).alias("g"), wn.fingerprint(F.col("t"), k, window).alias("m"))
    grams_of = {}
    for r in df.collect():
        ws = words(r["t"])
        assert len(r["g"]) == (max(len(ws) - k + 1, 1) if ws else 0), r
        for i, g in enumerate(r["g"]):
            assert grams_of.setdefault(tuple(ws[i : i + k] if len(ws) >= k else ["short", *ws]), g) == g
        h = [signed34(g) for g in r["g"]]
        assert [m["pos"] for m in r["m"]] == marks(h, window), r
        assert [m["hash"] for m in r["m"]] == [h[m["pos"]] for m in r["m"]]
    assert len(set(grams_of.values())) == len(grams_of)


def test_shared_passage_always_found(spark):
    rng = random.Random(3)
    passage = " ".join(f"w{i}" for i in range(wn.K + wn.WINDOW - 1))
    pairs = [(" ".join([*(rng.choice("abc") for _ in range(rng.randrange(20))), passage, *(rng.choice("abc") for _ in range(rng.randrange(20)))]),
              " ".join([*(rng.choice("xyz") for _ in range(rng.randrange(20))), passage, *(rng.choice("xyz") for _ in range(rng.randrange(20)))])) for _ in range(50)]
    df = spark.createDataFrame(pairs, "a string, b string").select(F.array_intersect(wn.fingerprint(F.col("a"))["hash"], wn.fingerprint(F.col("b"))["hash"]).alias("n"))
    assert all(len(r["n"]) for r in df.collect())


def plain_likeness(spark, got):
    prints = {r["t"]: [m["hash"] for m in r["m"]] for r in spark.createDataFrame(
        [(x,) for r in got for x in (r["text"], r["edited"])] or [("",)], "t string").select("t", wn.fingerprint(F.col("t")).alias("m")).collect()}

    def like(a, b):
        a, b = set(prints[a]), set(prints[b])
        return len(a & b) / len(a | b) if a | b else 1.0

    return like


def test_next_document_edited_text_and_likeness(spark, make_docs):
    rng = random.Random(9)
    ts = texts(rng, 80)
    rows = [(i * 7 % 1000, t) for i, t in enumerate(ts)]
    assert len({i for i, _ in rows}) == len(rows)
    found = wn.document_fingerprints(make_docs(rows).repartition(3))
    got = {r["doc_id"]: r for r in found.collect()}
    report = {r["doc_id"]: r for r in wn.fingerprint_report(found).collect()}
    text = {i: t or "" for i, t in rows}
    ids = sorted(text, reverse=True)
    like = plain_likeness(spark, got.values())
    assert sorted(got) == sorted(text)
    for i, j in zip(ids, [*ids[1:], ids[0]]):
        third = len(text[i]) // 3
        edited = text[i][: len(text[i]) - third] + text[j][:third]
        r = report[i]
        assert got[i]["edited"] == edited
        assert (r["n_chars"], r["edited_sha256"]) == (len(text[i]), hashlib.sha256(edited.encode()).hexdigest())
        assert r["near_edited"] == pytest.approx(like(text[i], edited))
        assert r["near_next"] == pytest.approx(like(text[i], text[j]))
        for name, t in (("fingerprint", "marks"), ("edited_fingerprint", "edited_marks")):
            assert r[name] == " ".join(f"{m['pos']}:{m['hash'] & (1 << 34) - 1:x}" for m in got[i][t])
    same = {}
    for i, r in report.items():
        assert same.setdefault(text[i], r["fingerprint"]) == r["fingerprint"]


def test_ties_nulls_single_and_empty(spark, make_docs):
    rows = [(5, "five five"), (5, "other text"), (5, "five five"), (None, "none a"), (None, None), (1, "one " * 30)]
    found = wn.document_fingerprints(make_docs(rows))
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text"], r["edited"]) for r in found.collect())
    hashes = {r["t"]: r["h"] for r in spark.createDataFrame([(t or "",) for _, t in rows], "t string").select("t", F.xxhash64("t").alias("h")).collect()}
    order = sorted(((i is not None, i or 0, hashes[t or ""], t or "") for i, t in rows), reverse=True)
    expected = []
    for a, b in zip(order, [*order[1:], order[0]]):
        third = len(a[3]) // 3
        expected.append((not a[0], a[1], a[3], a[3][: len(a[3]) - third] + b[3][:third]))
    assert got == sorted(expected)
    one = wn.fingerprint_report(wn.document_fingerprints(make_docs([(3, "alone in the table, with more than five words")]))).collect()
    assert [r["near_next"] for r in one] == [1.0]
    assert wn.fingerprint_report(wn.document_fingerprints(make_docs([]))).collect() == []


def test_long_text_without_spaces_and_string_identifiers(spark):
    docs = spark.createDataFrame([("b", "x" * 300_000), ("a", "y z " * 60_000), ("c", None)], "doc_id string, text string")
    got = {r["doc_id"]: r for r in wn.fingerprint_report(wn.document_fingerprints(docs)).collect()}
    assert got["b"]["n_chars"] == 300_000 and len(got["b"]["fingerprint"].split()) == 1
    assert got["a"]["near_edited"] > 0.3 and got["c"]["fingerprint"] == ""


def test_plan_has_no_python(spark, make_docs):
    plan = wn.fingerprint_report(wn.document_fingerprints(make_docs([(1, "a")])))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan
