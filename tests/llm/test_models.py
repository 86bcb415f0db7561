"""Operators 5 and 8: exact parts against brute force, and held-out accuracy."""

import itertools
import math
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from parlour.llm import toxicity_kn as kn
from parlour.llm.common import table
from parlour.llm.quality_crf import fit_quality, held_out, line_features, marginals, quality_scores
from parlour.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


# ---- operator 5
def test_marginals_are_those_of_all_label_sequences():
    rnd = np.random.default_rng(4)
    for n in (1, 2, 5, 8):
        logit, trans = rnd.normal(0, 3, n), rnd.normal(0, 2, (2, 2))
        z, good = 0.0, np.zeros(n)
        for y in itertools.product((0, 1), repeat=n):
            p = math.exp(sum(v for v, k in zip(logit, y) if k) + sum(trans[a, b] for a, b in zip(y, y[1:])))
            z += p
            good += p * np.array(y)
        assert np.allclose(marginals(logit, trans), good / z)
    assert len(marginals(np.zeros(0), trans)) == 0


def test_line_features_see_the_neighbouring_lines_of_the_same_document_only():
    alone, n, _ = line_features(["good line"])
    both, m, _ = line_features(["BAD!! LINE!!", "good line", "x | y | z"])
    assert n.tolist() == [1] and m.tolist() == [1, 1, 1] and np.array_equal(alone[0], both[1])
    inside, _, _ = line_features(["BAD!! LINE!!\ngood line"])
    assert not np.array_equal(inside[1], alone[0])
    assert line_features([])[0].shape[0] == 0 and line_features(["", "\n"])[1].tolist() == [1, 2]


def test_quality_of_held_out_documents(spark):
    got = QUERIES["op5_quality_crf"](spark, SF)
    rows = got.join(table(spark, SF, "labels"), "doc_id").filter("held_out").collect()
    assert got.count() == 1000 and got.columns[:4] == ["doc_id", "held_out", "score", "predicted"]
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    good, bad = [r.score for r in rows if r.quality], [r.score for r in rows if not r.quality]
    assert np.mean([s >= 0.3 for s in good]) == 1 and np.mean([s < 0.3 for s in bad]) >= 0.8


def test_quality_takes_nulls_empty_tables_and_missing_labels(spark, make_docs):
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 0), (None, 1), (3, None)], "doc_id long, quality int")
    docs = make_docs([(1, "Fine words in a line.\nAnd more of them."), (2, "A!! B!! C!! D!!\nE!! F!!"), (3, None), (None, ""), (1, "Fine words in a line.\nAnd more of them."), (4, "word " * 30_000)])
    out = quality_scores(docs, fit_quality(docs, labels), score_col="s")
    assert out.columns == docs.columns + ["s"]
    s = {(r.doc_id, r.text): r.s for r in out.collect()}
    assert len(out.collect()) == 6 and all(0 <= v <= 1 for v in s.values()) and s[3, None] == s[None, ""]
    none = fit_quality(docs, labels.limit(0))
    assert all(0 <= r.score <= 1 for r in quality_scores(docs.drop("score"), none).collect())
    assert quality_scores(docs.drop("score").limit(0), none).count() == 0


# ---- operator 8
def brute_tables(counts_by_class, all_words):
    """Kneser-Ney tables by gram (as bytes) for each class: orders above SHARED of its own, the others shared."""

    def chain(words, top, down):
        c = Counter()
        for w, n in words.items():
            s = b"\x01" + w + b"\x02"
            for i in range(1, len(s)):
                c[s[max(0, i - top + 1) : i + 1]] += n
        out = {top: c}
        for k in range(top - 1, down - 1, -1):
            low = Counter()
            for g, n in out[k + 1].items():
                low[g[1:] if len(g) == k + 1 else g] += 1 if len(g) == k + 1 else n
            out[k] = low
        return out

    shared = chain(all_words, kn.SHARED + 1, 1)
    return [{**{k: v for k, v in chain(w, kn.ORDER, kn.SHARED + 1).items()}, **{k: shared[k] for k in range(1, kn.SHARED + 1)}} for w in counts_by_class]


def brute_log(word, tables):
    s, out = b"\x01" + word + b"\x02", 0.0
    for i in range(1, len(s)):
        p = 1 / 256
        for k in range(1, min(kn.ORDER, i + 1) + 1):
            g = s[i + 1 - k : i + 1]
            same = {x: n for x, n in tables[k].items() if x[:-1] == g[:-1]}
            t = sum(same.values())
            if t:
                p = max(same.get(g, 0) - kn.DISCOUNT, 0) / t + kn.DISCOUNT * len(same) / t * p
        out += math.log(p)
    return out


def test_word_ratios_are_those_of_kneser_ney(spark):
    toxic, fine, free = ["you idiot, IDIOT twice", "a moron idea"], ["you had an idea", "notions of a motion"], ["something else", ""]
    texts = spark.createDataFrame([(t,) for t in toxic + fine + free], "text string")
    labelled = spark.createDataFrame([(t, 1) for t in toxic] + [(t, 0) for t in fine], "text string, cls int")
    model = kn.fit_counts(texts, labelled)
    count = lambda ts: Counter(w for t in ts for w in kn.words(t))
    tables = brute_tables([count(fine), count(toxic)], count(toxic + fine + free))
    for w in (b"idiot", b"moron", b"you", b"ideas", b"notion", b"qqq", "é".encode()):
        want = brute_log(w, tables[1]) - brute_log(w, tables[0])
        assert abs(kn.word_ratios([w], model)[0] - want) < 1e-4, w
    assert kn.word_ratios([b"idiot"], model)[0] > 3 > kn.word_ratios([b"you"], model)[0]


def test_word_ratios_stay_exact_among_a_million_grams(spark):
    rnd = np.random.default_rng(3)
    fine = [bytes(w).decode() for w in rnd.integers(97, 123, (120_000, 8), np.uint8)]
    toxic = ["zqxjkv wubbly"]
    texts = [" ".join(fine[i : i + 1000]) for i in range(0, len(fine), 1000)]
    labelled = spark.createDataFrame([(t, 1) for t in toxic] + [(t, 0) for t in texts], "text string, cls int")
    model = kn.fit_counts(labelled.select("text"), labelled)
    count = lambda ts: Counter(w for t in ts for w in kn.words(t))
    tables = brute_tables([count(texts), count(toxic)], count(texts + toxic))
    got = kn.word_ratios([b"zqxjkv", b"wubbly"], model)
    for w, r in zip((b"zqxjkv", b"wubbly"), got):
        assert abs(r - (brute_log(w, tables[1]) - brute_log(w, tables[0]))) < 1e-4, w


def test_all_labelled_rows_count_and_each_fold_is_left_out_once(spark, make_docs):
    texts = [f"idiot number {'abcdefghijkl'[i]}" if i % 3 == 0 else f"plain text {'abcdefghijkl'[i]}" for i in range(12)]
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(12)], "doc_id long, toxic int")
    top = kn.fit_toxicity(make_docs(texts), labels)["tables"][kn.ORDER]
    total = top.agg(*[F.sum(c).alias(c) for c in top.columns if c != "gram"]).first().asDict()
    for c in (0, 1):
        letters = sum(len(w) + 1 for i, t in enumerate(texts) if (i % 3 == 0) == c for w in kn.words(t))
        assert total[f"n{c}_0"] == letters
        assert sum(letters - total[f"n{c}_{f + 1}"] for f in range(kn.FOLDS)) == letters


def test_toxicity_of_held_out_documents(spark):
    got = QUERIES["op8_toxicity_kneser_ney"](spark, "/root/testdata/sf0.1")
    rows = got.join(table(spark, "/root/testdata/sf0.1", "labels"), "doc_id").filter("held_out").collect()
    assert got.columns[:4] == ["doc_id", "held_out", "score", "predicted"]
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    toxic, fine = [r.predicted for r in rows if r.toxic], [r.predicted for r in rows if not r.toxic]
    # a few hundred toxic documents to learn from, with a few words each in three of the four languages
    assert np.mean(toxic) >= 0.5 and np.mean(fine) <= 0.01
    english = table(spark, "/root/testdata/sf0.1", "documents").filter("lang = 'en'").select("doc_id")
    rows = got.join(table(spark, "/root/testdata/sf0.1", "labels"), "doc_id").filter("held_out and toxic = 1").join(english, "doc_id").collect()
    assert np.mean([r.predicted for r in rows]) >= 0.85


def test_toxicity_takes_nulls_empty_tables_and_missing_labels(spark, make_docs):
    docs = make_docs([(1, "plain words"), (2, "idiot"), (3, None), (None, "12 !!"), (1, "plain words")])
    labels = spark.createDataFrame([(1, 0), (2, 1), (None, 1), (3, None), (2, 1)], "doc_id long, toxic int")
    for lab in (labels, labels.limit(0)):
        out = kn.toxicity_scores(docs, kn.fit_toxicity(docs, lab), score_col="s")
        s = [r.s for r in out.collect()]
        assert out.columns == docs.columns + ["s"] and len(s) == 5 and all(0 <= v <= 1 for v in s)
    assert kn.toxicity_scores(docs.limit(0), kn.fit_toxicity(docs.limit(0), labels), score_col="s").count() == 0


def test_held_out_is_the_crc32_of_the_identifier_as_text(spark):
    import zlib

    rows = spark.range(50).select("id", held_out(F.col("id"), 5, 0).alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 5 == 0) for r in rows)


def test_quality_of_string_identifiers_and_an_overlong_document(spark):
    """Identifiers of any type; a document beyond the bound on lines is passed over, and the others are still learnt from."""
    good, bad = "The old mill stands by the river and turns slowly.\n", "$$$ >>> 0x9f ### ||| 77 !!\n"
    rows = [(f"d{i}", (good if i % 2 else bad) * 6, i % 2) for i in range(80)] + [("long", bad * 500, 1)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id string, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id string, quality int")
    model = fit_quality(docs, labels, sample_lines=2000)
    got = {r.doc_id: r.score for r in quality_scores(docs, model).collect()}
    assert min(got[f"d{i}"] for i in range(1, 80, 2)) > 0.5 > max(got[f"d{i}"] for i in range(0, 80, 2))


def test_a_chunk_of_many_words_is_looked_at_in_portions(monkeypatch):
    import numpy as np
    import pandas as pd

    from parlour.llm import toxicity_kn as kn

    ws = sorted({f"{a}{b}{c}" * 3 for a in "abcdefghij" for b in "klmnopqrst" for c in "uvwxyz"})
    whole, most, plain = kn.gram_positions([w.encode() for w in ws])[0], [], kn.gram_positions
    monkeypatch.setattr(kn, "WORD_BYTES", 500)
    monkeypatch.setattr(kn, "gram_positions", lambda part: most.append(sum(map(len, part))) or plain(part))
    got = pd.concat(kn._chunk_grams(iter([pd.DataFrame({"chunk": [7], "words": [" ".join(ws)]})])))
    assert got["gram"].tolist() == np.unique(whole).tolist() and set(got["chunk"]) == {7}
    assert len(most) > 5 and max(most) < 600


def test_counted_words_are_stored_in_few_bytes_and_read_back():
    rnd = np.random.default_rng(5)
    vocabulary = [bytes(w).decode() for w in rnd.integers(97, 123, (20_000, 7), np.uint8)]
    texts = [" ".join(vocabulary[i] for i in rnd.zipf(1.2, 400) % len(vocabulary)) for _ in range(300)] + ["", "12 !!"]
    counts, ws = kn._counted_words(texts)
    numbered = list(kn._inflated(iter([kn.pd.DataFrame({"chunk": [3], "words": [ws]})])))[0]["words"][0].encode().split()
    for t, c in zip(texts, counts):
        u, n = kn._uncounted(c)
        assert {numbered[i]: m for i, m in zip(u, n.tolist())} == Counter(kn.words(t)) and (np.diff(u) > 0).all()
    assert sum(map(len, counts)) < 3 * sum(len(set(kn.words(t))) for t in texts)  # 8 bytes a word before


def test_a_freed_write_leaves_no_shuffle_files(spark):
    import time

    from parlour.llm.common import dropped, written_freed

    def shuffled():
        files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {files.apply(i).getName() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle_")}

    before, key = shuffled(), "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    held = spark.conf.get(key, None)
    out = written_freed(spark.range(10_000).groupBy((F.col("id") % 500).alias("k")).agg(F.sum("id").alias("n")), "test-freed")
    for _ in range(50):  # files are deleted soon after, not before the write returns
        if not shuffled() - before:
            break
        time.sleep(0.2)
    assert not shuffled() - before and out.count() == 500 and spark.conf.get(key, None) == held
    dropped(out)
