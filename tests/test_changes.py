import difflib
import random

from sparkloom.operators import changes

HUNK = "file string, side string, nth long, old_start long, old_count long, new_start long, new_count long"
FILE = "file string, old_status string, head_status string, target_status string, patch_status string, old_lines long, head_lines long, same_base boolean"


def edited(rng, n):
    """An edit script of n lines, and the new text by (old line or None)."""
    script, new = [], []
    for i in range(1, n + 1):
        removed, added = int(rng.random() < 0.25), rng.choice((0, 0, 0, 1, 2))
        script.append((i, removed, added))
        if not removed:
            new.append(i)
        new += [None] * added
    return script, new


def test_hunks_equal_those_of_the_texts(spark):
    rng = random.Random(1)
    scripts = {f"f{i}": edited(rng, rng.randrange(1, 30)) for i in range(40)}
    rows = [(f, "HEAD", *r) for f, (script, _) in scripts.items() for r in script]
    found = {}
    for r in changes.hunks_of(spark.createDataFrame(rows, "file string, side string, line int, removed int, added int")).collect():
        found.setdefault(r.file, []).append((r.old_start, r.old_count, r.new_start, r.new_count))
    for f, (script, new) in scripts.items():
        old = [r[0] for r in script]
        want = []
        for tag, a, b, c, d in difflib.SequenceMatcher(None, old, [x or -j for j, x in enumerate(new, 1)], autojunk=False).get_opcodes():
            if tag != "equal":
                want.append((a + 1 if b > a else a, b - a, c + 1 if d > c else c, d - c))
        assert sorted(found.get(f, [])) == want


def test_ranges_are_placed_through_hunks(spark):
    rng = random.Random(2)
    scripts = {f"f{i}": edited(rng, 25) for i in range(15)}
    rows = [(f, "TARGET", *r) for f, (script, _) in scripts.items() for r in script]
    hunks = changes.hunks_of(spark.createDataFrame(rows, "file string, side string, line int, removed int, added int"))
    asked = [(f, n, a, min(25, a + rng.randrange(4))) for f in scripts for n, a in enumerate(range(1, 26, 2))]
    got = {(r.file, r.nth): (r.touched, r.moved) for r in changes.placed(spark.createDataFrame(asked, "file string, nth long, start long, end long"), hunks).collect()}
    for f, n, a, b in asked:
        _, new = scripts[f]
        touched, moved = got[f, n]
        places = [new.index(i) + 1 if i in new else None for i in range(a, b + 1)]
        whole = None not in places and places == list(range(places[0], places[0] + b - a + 1))
        assert (touched == 0) == whole
        if whole:
            assert a + moved == places[0]


def test_statuses_and_coverage(spark):
    files = [
        ("a", "complete", "complete", "complete", "complete", 20, 20, False),
        ("b", "complete", "unavailable", "complete", "complete", 20, 0, True),
        ("c", "complete", "complete", "unavailable", "truncated", 20, 20, False),
        ("d", "absent", "complete", "absent", "missing", 0, 4, True),
        ("e", "complete", "complete", "absent", "complete", 5, 5, False),
    ]
    hunks = [("a", "HEAD", 1, 3, 2, 3, 2), ("a", "HEAD", 2, 10, 0, 11, 1), ("a", "HEAD", 3, 15, 1, 16, 1), ("a", "TARGET", 1, 1, 0, 2, 5), ("a", "TARGET", 2, 15, 1, 20, 1), ("b", "HEAD", 1, 1, 1, 1, 1), ("c", "HEAD", 1, 2, 1, 2, 1), ("e", "HEAD", 1, 2, 1, 2, 1), ("z", "HEAD", 1, 1, 1, 1, 1)]
    deltas, coverage = changes.analysed(spark.createDataFrame(files, FILE), spark.createDataFrame(hunks, HUNK), 2)
    assert sorted((r.file, r.nth, r.target_start, r.target_status, r.comparison, r.analysis) for r in deltas.collect()) == [
        ("a", 1, 8, "EXACT", "DIVERGED", "TEXT"),
        ("a", 2, 15, "EXACT", "DIVERGED", "TEXT"),
        ("b", 1, 1, "EXACT", "UNCHANGED_BASE", "UNSUPPORTED"),
        ("c", 1, None, "UNAVAILABLE", "UNAVAILABLE", "TEXT"),
        ("d", 1, None, "TOUCHED", "UNCHANGED_BASE", "METADATA_ONLY"),
        ("e", 1, None, "TOUCHED", "DIVERGED", "TEXT"),
    ]
    assert sorted(map(tuple, coverage.collect())) == [
        ("a", "TEXT", 2, "DELTA_LIMIT,TARGET_DIVERGED"),
        ("b", "UNSUPPORTED", 1, "CONTENT_UNAVAILABLE"),
        ("c", "TEXT", 1, "PATCH_TRUNCATED,TARGET_UNAVAILABLE"),
        ("d", "METADATA_ONLY", 1, "PATCH_MISSING"),
        ("e", "TEXT", 1, "TARGET_DIVERGED"),
    ]


def test_kinds_of_changes_by_ascii_words(spark):
    from pyspark.sql import functions as F
    from sparkloom.functions import classify

    texts = ["r\u00e9environ x", "environ", "my_environ", "a\u2028import os", "a\n\u00a0import os", "a\n import os", "\u00e9SELECT", "class\u00a0A:"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, t string")
    kind = lambda **kw: [r[0] for r in df.orderBy("id").select(classify.delta_kind(F.lit("a.py"), F.lit(""), F.col("t"), **kw)).collect()]
    assert kind(ascii_words=True) == ["CONFIGURATION", "CONFIGURATION", "OTHER", "OTHER", "OTHER", "DEPENDENCY", "DATA_ACCESS", "OTHER"]
    assert kind() == ["OTHER", "CONFIGURATION", "OTHER", "OTHER", "DEPENDENCY", "DEPENDENCY", "OTHER", "COMPONENT"]
