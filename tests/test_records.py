"""Operators on records that SQL does not express, and their edge cases."""

from pyspark.sql import functions as F
from sparkloom.operators import records as R


def fit(terms, longest, most, chars):
    out, held = [], 0
    for w in dict.fromkeys(terms):
        if w and w.strip() and len(w) <= longest and len(out) < most and held + len(w) + bool(out) <= chars:
            held += len(w) + bool(out)
            out.append(w)
    return out


def test_bounded_terms_equal_a_plain_loop(spark):
    lists = [[], ["a", "a", "bb"], ["long" * 9, "x"], ["abc", "de", "fgh", "i"], ["", None, "q"], list("abcdefgh")]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(lists)], "id long, w array<string>")
    got = {r.id: r.t for r in df.select("id", R.bounded_terms(F.col("w"), 8, 4, 7).alias("t")).collect()}
    assert got == {i: fit(v, 8, 4, 7) for i, v in enumerate(lists)}


def test_intents_of_events_out_of_order(spark):
    rows = [(1, 2, 1), (1, 1, 2), (1, 3, 3), (2, 3, 1), (3, 1, 1), (3, 2, 2), (3, 3, 3), (4, 1, None)]
    df = spark.createDataFrame([(k, r, i) for i, (k, r, _) in enumerate(rows) if rows[i][2] is not None], "k int, r int, at int")
    got = {r.k: (r.intent, r.version) for r in R.intents(df, "k", F.col("r"), F.lit(0), F.col("at")).collect()}
    assert got == {1: (3, 2), 2: (3, 1), 3: (3, 3)}


def test_checks_report_zero(spark):
    empty = spark.createDataFrame([], "a int")
    got = {r.check: r.violations for r in R.violations(none=empty, some=spark.range(3)).collect()}
    assert got == {"none": 0, "some": 3}


def test_a_new_final_identity_raises_the_version(spark):
    rows = [(1, 1, 3, "a"), (1, 2, 3, "a"), (1, 3, 3, "b"), (1, 4, 3, "a"), (2, 1, 2, "a"), (2, 2, 3, None)]
    df = spark.createDataFrame(rows, "k int, at int, r int, who string")
    got = {r.k: (r.intent, r.version) for r in R.intents(df, "k", F.col("r"), F.col("who"), F.col("at")).collect()}
    assert got == {1: (3, 3), 2: (3, 2)}


def test_bounded_terms_are_cut_by_characters_where_they_do_not_fit(spark):
    """Longer terms and blank ones leave room for later ones, and so does one that doesn't fit."""
    lists = [["ab", "cd", "ef", "gh", "ij"], ["abcdefghi", " ", "ab", "cd", "ef"], ["abcd", "efgh", "i"], ["é" * 7], [None, None], None]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(lists)], "id long, w array<string>")
    for bounds in ((8, 4, 7), (8, 3, 8), (2, 2, 5)):
        got = {r.id: r.t for r in df.select("id", R.bounded_terms(F.col("w"), *bounds).alias("t")).collect()}
        assert got == {i: None if v is None else fit(v, *bounds) for i, v in enumerate(lists)}
