"""Operator 2 against brute force over all 200-byte strings."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from parlour.llm.suffix_dedup import THRESHOLD, remove_repeats, repeat_report, repeated_intervals


def brute(texts, size=THRESHOLD):
    data = [(t or "").encode() for t in texts]
    n = Counter(t[i : i + size] for t in data for i in range(len(t) - size + 1))
    out = []
    for t in data:
        gone = np.zeros(len(t) + 2, int)
        for i in range(len(t) - size + 1):
            if n[t[i : i + size]] > 1:
                gone[i + 1 : i + size + 1] = 1
        out.append((len(t), int(gone.sum()), int((np.diff(gone) == 1).sum()), hashlib.sha256(bytes(np.frombuffer(t, np.uint8)[gone[1:-1] == 0])).hexdigest()))
    return out


def corpus():
    rnd = random.Random(11)
    prose = lambda n: "".join(rnd.choice("abcdefgh é\n") for _ in range(n))
    shared = [prose(n) for n in (199, 200, 201, 260, 700, 63, 150)]
    docs = []
    for _ in range(60):
        parts = []
        for _ in range(rnd.randint(1, 4)):
            parts += [prose(rnd.choice([0, 1, 50, 190, 300])), rnd.choice(shared)]
        docs.append("".join(parts))
    same = prose(500)
    near = [same[:k] + "X" + same[k + 1 :] for k in (100, 199, 200, 201, 300, 460)]
    return docs + near + [same, same, "", None, "ab" * 400, "x" * 199, "x" * 200, "y" * 201, "hello " * 300, prose(20000)]


@pytest.mark.parametrize("together", [20_000, 1])
def test_removed_bytes_are_those_of_brute_force(spark, make_docs, monkeypatch, together):
    monkeypatch.setattr("parlour.llm.suffix_dedup.TOGETHER", together)  # 1: all names by windows
    texts = corpus()
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeat_report(remove_repeats(make_docs(texts))).collect()}
    want = dict(enumerate(brute(texts)))
    assert got == want
    assert sum(w[1] > 0 for w in want.values()) > 30 and sum(w[1] == 0 for w in want.values()) > 5


def test_intervals_are_maximal_and_kept_bytes_are_the_rest(spark, make_docs):
    texts = corpus()[:20]
    for r in remove_repeats(make_docs(texts)).collect():
        t = texts[r.doc_id].encode()
        ends = [(x.start, x.end) for x in r.removed]
        assert all(a < b for a, b in ends) and all(p[1] < q[0] for p, q in zip(ends, ends[1:]))
        rest = b"".join(t[a:b] for a, b in zip([0] + [e for _, e in ends], [s for s, _ in ends] + [len(t)]))
        assert bytes(r.kept) == rest


def test_repeated_rows_null_identifiers_and_empty_tables(spark, make_docs):
    rnd = random.Random(2)
    long, other = ("".join(rnd.choice("abcdef") for _ in range(400)) for _ in range(2))
    rows = [(1, long), (1, long), (1, other), (None, long + "z"), (None, None)]
    got = sorted((r.n_bytes, r.n_removed) for r in repeat_report(remove_repeats(make_docs(rows))).collect())
    assert got == [(0, 0), (400, 0), (400, 400), (400, 400), (401, 400)]
    assert repeat_report(remove_repeats(make_docs([]))).count() == 0


def test_threshold_is_checked(make_docs):
    with pytest.raises(ValueError):
        repeated_intervals(make_docs(["a"], clash=False).selectExpr("doc_id as id", "1 as key", "cast(text as binary) as text"), 64)


def test_texts_without_identifier_are_told_apart(spark):
    """Two texts of one 32-bit hash and no identifier: what repeats in one is not removed from the other."""
    part = lambda k: F.sha2(F.concat(F.col("id").cast("string"), F.lit(f":{k}")), 512)
    df = spark.range(300_000).select(F.concat(*[part(k) for k in range(3)]).alias("text"))
    a, b = df.groupBy(F.hash("text")).agg(F.collect_list("text").alias("texts")).filter("size(texts) > 1").first()["texts"][:2]
    texts = [a, b, a[50:300]]
    docs = spark.createDataFrame([(None, a), (None, b), (7, texts[2])], "doc_id long, text string")
    got = sorted(tuple(r)[1:] for r in repeat_report(remove_repeats(docs)).collect())
    assert got == sorted(brute(texts)) and [n for _, n, *_ in brute(texts)] == [250, 0, 250]


def test_names_are_compared_in_portions(spark, monkeypatch):
    from parlour.llm import suffix_dedup as sd

    monkeypatch.setattr(sd, "PORTION", 3)
    texts = corpus()
    got = repeat_report(remove_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))).orderBy("doc_id").collect()
    assert [tuple(r)[1:] for r in got] == brute(texts)
