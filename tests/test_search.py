"""Pattern search by the rarest asked pair, against ILIKE on all pairs of rows and terms."""

import random

import pytest
from pyspark.sql import functions as F

from parlour.functions import joins


@pytest.mark.parametrize("seed", range(2))
def test_pattern_join_equals_ilike_on_all_pairs(spark, seed):
    rng = random.Random(seed)
    word = lambda n: "".join(rng.choice("abcABÄä1 _") for _ in range(rng.randrange(n)))
    rows = spark.createDataFrame([(i, word(9) if rng.random() < 0.9 else None, word(5)) for i in range(300)], "id long, name string, other string")
    terms = [(i, rng.choice(["%{}%", "{}%", "%{}_%", "{}"]).format(word(4))) for i in range(60)] + [(100, "%"), (101, ""), (102, None), (103, "%a\\_%"), (104, "%a\\b%"), (105, "%a%"), (106, "%a%")]
    asked = spark.createDataFrame(terms, "term_id long, pat string")
    got = sorted((r.id, r.term_id) for r in joins.pattern_join(rows, ["name", "other"], asked, "pat").collect())
    plain = asked.withColumn("pat", F.regexp_replace("pat", r"\\([^%_\\])", "$1"))
    want = rows.crossJoin(plain).where(F.coalesce(F.ilike("name", F.col("pat")), F.lit(False)) | F.coalesce(F.ilike("other", F.col("pat")), F.lit(False)))
    assert got == sorted((r.id, r.term_id) for r in want.collect())


def test_rows_multiply_only_under_the_rarest_asked_pairs(spark):
    rows = spark.createDataFrame([(i, f"abcdefghijklmnopqrstuvwxyz {i:04}") for i in range(2000)], "id long, name string")
    terms = spark.createDataFrame([(1, "%yz 0001%"), (2, "%xyz 19%")], "term_id long, pat string")
    keys = F.array_distinct(joins._grams(F.lower(F.col("name"))))
    every = rows.select(F.explode(keys)).count()
    grams = spark.createDataFrame([("01",), ("19",)], "_gram string")
    listed = joins._listed(rows, keys, grams)
    assert listed.count() < every / 50
    held = [r._gram for r in listed.select("_gram").distinct().collect()]
    assert {"01", "19"} <= set(held) and len(held) <= 4
    got = joins.pattern_join(rows, ["name"], terms, "pat").collect()
    assert sorted((r.term_id, r.id) for r in got) == [(1, 1)] + [(2, i) for i in range(1900, 2000)]


def test_a_pattern_is_searched_once_however_many_ask_for_it(spark, monkeypatch):
    from parlour.operators import staff as st

    people = spark.createDataFrame([(i, f"Ann {i % 30:02}", f"9{i:07}", "x", "SG") for i in range(90)], "cid long, name string, mobile_number string, nric_fin_passport_no string, country_code string")
    searched = []

    def recorded(rows, columns, terms, pattern):
        searched.append(terms.count())
        return joins.pattern_join(rows, columns, terms, pattern)

    monkeypatch.setattr(st, "pattern_join", recorded)
    terms = [(i, f" 0{i % 3}") for i in range(60)] + [(0, "07"), (None, "08"), (None, "08"), (99, "\\07"), (98, None)]
    got = st.search_customers({"customers": people}, spark.createDataFrame(terms, "term_id long, q string"), k=4).collect()
    want = []
    for term in {i for i, q in terms}:
        found = [(f"Ann {c % 30:02}", c) for i, q in terms if i == term and q for c in range(90) if q.strip().replace("\\", "") in f"Ann {c % 30:02}"]
        want += [(term, n + 1, *x) for n, x in enumerate(sorted(found)[:4])]
    assert sorted(((r.term_id, r.rn, r.name, r.cid) for r in got), key=repr) == sorted(want, key=repr)
    assert searched == [6]
    requests = [(i, "name", "07") for i in range(40)] + [(i, "mobile", "9000000") for i in range(40, 60)] + [(0, "cid", "5")]
    best = st.find_customer({"customers": people}, spark.createDataFrame(requests, "req_id long, by string, term string")).collect()
    assert sorted((r.req_id, r.cid) for r in best) == [(0, 5)] + [(i, 7) for i in range(1, 40)] + [(i, 0) for i in range(40, 60)]
    assert searched[1:] == [1, 1]
