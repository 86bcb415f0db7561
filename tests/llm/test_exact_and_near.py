"""Operators 1 and 10 against brute force."""

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pandas as pd
import pytest
import xxhash

from parlour.llm.components import components
from parlour.llm.exact_dedup import exact_dedup
from parlour.llm.simhash import near_dedup, near_links, near_representatives


def lowered(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def texts():
    rnd = random.Random(5)
    out = [(i, rnd.choice(["Alpha beta", "alpha BETA", "É x", "é x", "", None, "one"])) for i in range(120)]
    return out + [(3, out[3][1]), (None, "alpha beta"), (None, "only null"), (None, "only null")]


@pytest.mark.parametrize("keep", ["min", "max"])
def test_exact_dedup_is_the_grouping_by_normalised_text(spark, make_docs, keep):
    rows = texts()
    groups = defaultdict(list)
    for i, t in rows:
        groups[lowered(t)].append(i)
    got = exact_dedup(make_docs(rows), keep=keep).collect()
    assert len(got) == len(rows)
    best = {t: (min if keep == "min" else max)((i for i in g if i is not None), default=None) for t, g in groups.items()}
    by_sha = {hashlib.sha256(t.encode()).hexdigest(): t for t in groups}
    stays = defaultdict(int)
    for r in got:
        t = by_sha[r.text_sha256]
        assert (r.keep_id, r.group_size) == (best[t], len(groups[t]))
        stays[t] += r.kept
        assert not r.kept or r.doc_id == best[t]
    assert set(stays.values()) == {1} and set(stays) == set(groups)


def test_exact_dedup_carries_all_columns_and_takes_empty_tables(spark, make_docs):
    docs = make_docs([(1, "A"), (2, "a"), (3, None)])
    out = exact_dedup(docs, carry=True, result_col="found")
    assert out.columns == docs.columns + ["found"]
    assert sorted(r.doc_id for r in out.filter("found.kept").collect()) == [1, 3]
    assert exact_dedup(make_docs([])).count() == 0


def test_a_text_that_most_rows_hold_is_split_and_counted_once(spark, make_docs):
    rows = [(i, "the same text" if i % 3 else f"text {i}") for i in range(600)]
    got = exact_dedup(make_docs(rows, clash=False), keep="max").collect()
    assert sum(r.kept for r in got) == 201
    assert {(r.keep_id, r.group_size) for r in got if r.doc_id % 3} == {(599, 400)}


def fingerprint(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", lowered(t))
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def roots(nodes, links):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def near_texts():
    rnd = random.Random(8)
    word = lambda: "".join(rnd.choice("abcdeé\u00a0") for _ in range(rnd.randint(1, 6)))
    rows = []
    for g in range(6):
        base = [word() for _ in range(250)]
        for _ in range(8):
            w = list(base)
            w[rnd.randrange(len(w))] = word()
            rows.append(" ".join(w) if rnd.random() < 0.8 else "\t ".join(w).upper())
    return [(100 - i, t) for i, t in enumerate(rows + ["", None, " \t\n", "one", "one two", "ONE\x0btwo", "a\x1cb c d e"])] + [(None, "one two"), (7, rows[0])]


def test_simhash_components_are_those_of_brute_force(spark, make_docs):
    rows = near_texts()
    fps = [fingerprint(t) for _, t in rows]
    got = near_dedup(make_docs(rows)).collect()
    assert len(got) == len(rows)
    want = roots(set(fps), [(a, b) for a in fps for b in fps if (a ^ b).bit_count() <= 3])
    smallest = {}
    for (i, _), f in zip(rows, fps):
        if i is not None:
            smallest[want[f]] = min(i, smallest.get(want[f], i))
    expect = sorted((str(i), f"{f:016x}", smallest[want[f]]) for (i, _), f in zip(rows, fps))
    assert sorted((str(r.doc_id), r.fingerprint, r.component_id) for r in got) == expect
    assert len(set(smallest.values())) < len(set(fps))  # there are near links at all


def test_links_of_random_and_clustered_fingerprints(spark):
    rnd = np.random.default_rng(3)
    base = rnd.integers(0, 1 << 64, 40, dtype=np.uint64)
    flips = [base ^ sum((np.uint64(1) << rnd.integers(0, 64, 40, dtype=np.uint64)) & np.uint64(2**64 - 1) for _ in range(k)) for k in range(1, 5)]
    flips += [base ^ (np.uint64(3) << np.uint64(2 * (k % 32))) for k in range(4)]  # two bits of one segment
    fps = np.unique(np.concatenate([base, *flips, np.array([0, 1, 2**64 - 1, 2**63], np.uint64)]))
    got = {tuple(sorted((r.a & (2**64 - 1), r.b & (2**64 - 1)))) for r in near_links(spark.createDataFrame(pd.DataFrame({"fp": fps.view(np.int64)}))).collect()}
    ints = fps.tolist()
    want = {(a, b) for k, a in enumerate(ints) for b in ints[k + 1 :] if (a ^ b).bit_count() <= 3}
    assert got == want and len(want) > 100


def test_components_of_chains_stars_and_nothing(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + k) for k in range(1, 30)] + [(7, 7), (None, 3), (200, 201), (201, 200)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 130), 100), 200: 200, 201: 200}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_one_row_of_each_near_group_stays(spark, make_docs):
    rows = near_texts() + [(7, near_texts()[0][1])]
    docs = make_docs(rows)
    kept = near_representatives(docs)
    assert kept.columns == docs.columns
    comp = {r.doc_id: r.component_id for r in near_dedup(docs).collect() if r.doc_id is not None}
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(comp.values()))
    assert near_representatives(make_docs([])).count() == 0
    assert near_dedup(make_docs([])).count() == 0
