"""Operator 12 against a trie built in memory."""

import hashlib
import random
import zlib

import pytest

from parlour.llm import ordered, prefix_trie as pt


def brute(rows):
    """Rows (conv_id, turn, role, text) without ties of conv_id and turn that differ in role or text."""
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            convs.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [r[2:] for r in sorted(v)] for c, v in convs.items()}
    rebuilt = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 9
        rebuilt[c] = turns.get(c - c % 5, [])[:h] + own[h:]
    nodes = {}
    for c, seq in rebuilt.items():
        for d in range(len(seq) + 1):
            nodes.setdefault(tuple(seq[:d]), []).append(c)
    children = {}
    for s in nodes:
        if s:
            children.setdefault(s[:-1], []).append(s)
    leaves, saved = {}, {}
    for s in sorted(nodes, key=len, reverse=True):
        kids = children.get(s, [])
        leaves[s] = sum(leaves[k] for k in kids) if kids else 1
        saved[s] = (len(nodes[s]) - 1) * (len(s[-1][1].encode()) if s else 0) + sum(saved[k] for k in kids)
    out = []
    for s, members in nodes.items():
        ends = ",".join(map(str, sorted(c for c in members if len(rebuilt[c]) == len(s))))
        out.append((min(members), len(s), min(nodes[s[:-1]]) if s else None, len(members), len(children.get(s, [])), leaves[s], saved[s],
                    hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out)


def run(spark, rows, parts=3):
    schema = "conv_id long, turn long, role string, text string, depth string, pid int, digest string"
    df = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], schema).repartition(parts)
    return sorted(tuple(r) for r in pt.prefix_trie(df).collect())


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_trie_in_memory(spark, seed):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(200), 90):
        for t in range(rng.choice([1, 2, 3, 5, 9, 14])):
            rows.append((c, t, rng.choice(["user", "assistant", None]), rng.choice(["", "a", "b", "é", None])))
    assert run(spark, rows) == brute(rows)


def test_copies_chain_and_fan(spark):
    rows = [(c, t, "user", f"same {t}") for c in range(100, 160) for t in range(4)]  # one conversation many times
    rows += [(7, t, "user", f"long {t % 3}") for t in range(400)]  # most turns in one conversation
    rows += [(c, 0, "user", f"own {c}") for c in range(1000, 1060)]  # many children of the root
    rows += [(c, t, "user", f"long {t % 3}") for c in (10, 15) for t in range(12)] + [(11, 30, "u", "x"), (16, None, "u", "z"), (16, 1, "u", "w")]
    rows += [(None, 1, "user", "nobody's"), (2001, 0, "user", "takes none of 2000")]
    assert run(spark, rows) == brute(rows)


def test_repeated_rows_turnless_and_empty(spark):
    short = next(c for c in range(1, 5000) if c % 5 and zlib.crc32(str(c).encode()) % 9 == 8)
    rows = [(short, 0, "user", "goes"), (short, 1, "user", "too")]  # its base is absent: rebuilt without turns
    assert run(spark, rows) == brute(rows) == [(short, 0, None, 1, 0, 1, 0, hashlib.sha256(str(short).encode()).hexdigest())]
    rows += [(5, 0, "user", "twice")] * 2
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == []


def test_long_runs_are_listed_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(pt, "STEP", 3)
    monkeypatch.setattr(pt, "JOINED_CHARS", 10)
    rows = [(c, t, "user", f"{t}") for c in range(0, 400, 5) for t in range(8)] + [(5, 8, "user", "more")]
    assert run(spark, rows) == brute(rows)


def test_running_sums_of_groups_over_several_ranges(spark):
    from pyspark.sql import functions as F

    rows = [(g, i) for g, n in ((1, 3), (2, 500), (3, 1), (4, 60)) for i in range(n)]
    order = [F.col("g"), F.col("i")]
    got = ordered.running(ordered.ranged(spark.createDataFrame(rows, "g long, i long"), order, "t"), "g", order[1:], s=F.col("i"), n=F.lit(1).cast("long"))
    assert got.select("pid").distinct().count() > 2
    size = {1: 3, 2: 500, 3: 1, 4: 60}
    assert sorted((r.g, r.i, r.s, r.n, r.s_all, r.n_all) for r in got.collect()) == sorted(
        (g, i, i * (i + 1) // 2, i + 1, size[g] * (size[g] - 1) // 2, size[g]) for g, i in rows)
