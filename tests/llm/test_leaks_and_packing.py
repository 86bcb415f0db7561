"""Operators 7 and 9."""

import itertools
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from parlour.llm.decontaminate import LONGEST_SHORT, MASKS, MIN_SHARE, decontaminated, seed_hashes, stretch, token_hashes
from parlour.llm.packing import CAPACITY, default_tokenizer, pack
from parlour.llm.packing_plan import best_fit, groups_of, plan
from parlour.llm.token_ids import TokenIds


def words(rnd, n):
    return ["".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 8))) for _ in range(n)]


def test_masks_ignore_their_zero_positions():
    h, n = token_hashes(["a b c d e f g h i j k l m", "a b X d e X X h i X k X m"])
    assert n.tolist() == [13, 13]
    assert seed_hashes(h[:13], 0)[0] == seed_hashes(h[13:], 0)[0] and seed_hashes(h[:13], 1)[0] != seed_hashes(h[13:], 1)[0]
    assert len(seed_hashes(h[:12], 0)) == 0
    a, _ = token_hashes(["Ärger, the-End 1st"])
    b, _ = token_hashes(["ärger THE end 1ST"])
    assert a.tolist() == b.tolist() and token_hashes([])[0].size == token_hashes(["", " . "])[0].size == 0


@pytest.mark.parametrize("n", range(8, 21))
def test_every_permitted_choice_of_substitutions_leaves_a_seed(n):
    """All choices of up to a fifth of an item's tokens."""
    lost = 0
    places = [[a + i for i, c in enumerate(m) if c == "1"] for m, least, most in MASKS if least <= n <= (most or n) for a in range(n - len(m) + 1)]
    for gone in itertools.combinations(range(n), int((1 - MIN_SHARE) * n + 1e-9)):
        lost += all(set(gone).intersection(p) for p in places)
    assert lost == 0


@pytest.mark.parametrize("n", [24, 28, LONGEST_SHORT, 40, 60])
def test_longer_items_seldom_lose_all_seeds(n):
    rnd = random.Random(n)
    places = [[a + i for i, c in enumerate(m) if c == "1"] for m, least, most in MASKS if least <= n <= (most or n) for a in range(n - len(m) + 1)]
    lost = sum(all(set(gone).intersection(p) for p in places) for gone in (rnd.sample(range(n), int((1 - MIN_SHARE) * n + 1e-9)) for _ in range(4000)))
    assert lost <= (0 if n <= LONGEST_SHORT else 40)


def test_short_items_with_substitutions_against_all_diagonals(spark, make_docs):
    rnd = random.Random(21)
    items = [words(rnd, n) for n in range(3, 21)]
    docs = []
    for w in items * 4:
        w = list(w)
        for at in rnd.sample(range(len(w)), int((1 - MIN_SHARE) * len(w) + 1e-9) if len(w) >= 8 else 0):
            w[at] = "zzzzzz"
        body = words(rnd, rnd.choice([0, 5, 200]))
        at = rnd.randint(0, len(body))
        docs.append(" ".join(body[:at] + w + body[at:]))
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")
    got = {r.doc_id: set(r.item_ids) for r in decontaminated(make_docs(docs), bench).collect()}
    for i, t in enumerate(docs):
        d = t.split(" ")
        whole = {k for k, w in enumerate(items) for a in range(len(d) - len(w) + 1)
                 if sum(x == y for x, y in zip(d[a : a + len(w)], w)) >= (MIN_SHARE if len(w) >= 8 else 1) * len(w)}
        assert whole <= got[i] and i % len(items) in got[i], (i, whole, got[i])


def test_stretch_finds_the_longest_tolerant_overlap():
    rnd = np.random.default_rng(1)
    for _ in range(300):
        item = rnd.integers(0, 50, 40).astype(np.uint64)
        doc = np.concatenate([rnd.integers(50, 99, 20), item, rnd.integers(50, 99, 20)]).astype(np.uint64)
        flip = rnd.choice(40, rnd.integers(0, 20), replace=False)
        doc[20 + flip] = 100
        at = int(rnd.integers(0, 27))
        eq, n = stretch(doc, item, 20 + at, at, 13)
        assert eq >= MIN_SHARE * n or (eq, n) == (0, 1)
        if len(flip) <= 8:
            assert n >= min(40 - at, 13 + 32) + min(at, 32) and eq >= n - 8


def test_leaks_with_substitutions_are_found_and_clean_documents_are_not(spark, make_docs):
    rnd = random.Random(9)
    items = [words(rnd, n) for n in (40, 60, 16, 13, 8, 5)]
    docs, want = [], []
    for k in range(60):
        body = words(rnd, rnd.choice([0, 30, 400]))
        which = k % 8
        if which < 5:
            w = list(items[which])
            for _ in range(len(w) // 20 if which < 2 else 0):
                w[rnd.randrange(len(w))] = "zzz"
            at = rnd.randint(0, len(body))
            body[at:at] = w
            want.append([which])
        else:
            body += items[5] if which == 5 else []  # five tokens: found word for word
            want.append([5] if which == 5 else [])
        docs.append(("; " if k % 2 else " ").join(body).title())
    bench = spark.createDataFrame([(i, " ".join(w), "x") for i, w in enumerate(items)] + [(6, None, "x"), (7, "", "x")], "item_id long, text string, window string")
    got = decontaminated(make_docs(docs + [None, ""]), bench).orderBy("doc_id").collect()
    assert [list(r.item_ids) for r in got] == want + [[], []]
    assert all(r.contaminated == bool(r.item_ids) for r in got)


def test_decontamination_of_repeated_rows_nulls_and_empty_tables(spark, make_docs):
    rnd = random.Random(3)
    item = " ".join(words(rnd, 30))
    docs = make_docs([(1, "x " + item), (1, "x " + item), (1, "clean"), (None, item), (None, "other")])
    bench = spark.createDataFrame([(5, item), (6, item)], "item_id long, text string")
    got = sorted((str(r.doc_id), tuple(r.item_ids), r.equal_tokens) for r in decontaminated(docs, bench).collect())
    assert got == [("1", (), 0), ("1", (5, 6), 30), ("1", (5, 6), 30), ("None", (), 0), ("None", (5, 6), 30)]
    assert all(not r.contaminated for r in decontaminated(docs, bench.limit(0)).collect())
    assert decontaminated(docs.limit(0), bench).count() == 0


# ---- operator 9
def test_token_ids_are_those_of_the_tokenizer():
    path = default_tokenizer()
    tok = Tokenizer.from_file(path)
    rnd = random.Random(1)
    texts = ["", " ", "a  b", " a", "a\n b", "a \nb", "\n\n a", "x <|endoftext|> y", "<|endoftext|>", " a<|endoftext|>b c", "<|endoftext|> <|endoftext|>", "a <|endoftext", "it's  'tis 's", "\0a b", "a \0b", "é b c", "a\u00a0 b", "don't can't 12 34.5\n\nNext one"]
    texts += ["".join(rnd.choice(["ab", "the", " ", "  ", "\n", "\t", ".", "'s", "é1", "漢", "\u2003", "<|endoftext|>"]) for _ in range(40)) for _ in range(1500)]
    texts += ["x" * 200_000, " " * 30_000 + "a", "a" + "\n \t" * 20_000, "a" + " " * 199 + "b", "漢" * 20_000, "1" * 5000, "-" * 5000, "'" * 3000, "ab " * 100_000, "\u3000" * 400, "\x1c\x85 \u2028x"]
    got = TokenIds(path)
    assert got.fast is not None
    for t, ids in zip(texts, got.encode(texts)):
        assert ids.tolist() == tok.encode(t, add_special_tokens=False).ids, repr(t)


@pytest.mark.parametrize("seed", range(6))
def test_plans_hold_every_length_and_fill_sequences(seed):
    rnd = random.Random(seed)
    counts = Counter({rnd.randint(1, 1023): rnd.choice([1, 2, 50, 3000]) for _ in range(rnd.choice([1, 5, 300]))})
    got = plan(counts, CAPACITY)
    used, total = Counter(), sum(k * n for k, n in counts.items())
    for times, lengths in got:
        assert times > 0 and sum(lengths) <= CAPACITY
        for length in lengths:
            used[length] += times
    assert used == counts
    n = sum(t for t, _ in got)
    assert n <= sum(t for t, _ in best_fit([], dict(counts), CAPACITY)) * 1.01 + 2
    if len(counts) > 100:
        assert n <= max(total / CAPACITY, sum(v for k, v in counts.items() if k > CAPACITY // 2)) * 1.05 + 3
    assert plan({}, CAPACITY) == []


def test_groups_have_equal_cardinality():
    groups = groups_of({500: 10, 400: 7, 300: 8}, 5)
    assert [sum(n for _, n in g) for g in groups] == [5] * 5 and groups[3] == [[400, 2], [300, 3]]


def test_pieces_and_sequences_round_trip(spark, make_docs):
    rnd = random.Random(4)
    texts = [" ".join(words(rnd, rnd.choice([1, 30, 150, 400, 1500, 6000]))) for _ in range(150)] + ["", None, "x", "x", "  two  spaces \n"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, texts[3]), (None, "no id")]
    got = pack(make_docs(rows)).collect()
    tok = Tokenizer.from_file(default_tokenizer())
    by_doc = defaultdict(list)
    for r in got:
        by_doc[r.doc_id].append(r)
    for i, t in set(rows):
        ids = tok.encode(t or "", add_special_tokens=False).ids + [2]
        pieces = sorted(by_doc[i], key=lambda r: r.piece)
        pieces = [p for k, p in enumerate(pieces) if k % (2 if i == 3 else 1) == 0]
        cuts = [0, *range((len(ids) - 1) % CAPACITY + 1, len(ids) + 1, CAPACITY)]
        assert [(p.piece, p.start, p.length) for p in pieces] == [(k, a, b - a) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
        assert all(p.ids_crc32 == zlib.crc32(np.array(ids[p.start : p.start + p.length], "<u4").tobytes()) for p in pieces)
    by_seq = defaultdict(list)
    for r in got:
        by_seq[r.sequence_id].append((r.offset, r.length))
    for places in by_seq.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= CAPACITY
    total = sum(r.length for r in got)
    assert len(by_seq) <= total / CAPACITY * 1.03 + 2
    assert pack(make_docs([])).count() == 0
