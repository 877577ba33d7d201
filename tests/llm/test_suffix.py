import collections
import hashlib

import numpy as np
import pytest
from sparkloom.llm import suffix


def brute(texts, length):
    count = collections.Counter()
    raw = {i: (t or "").encode() for i, t in texts.items()}
    for b in raw.values():
        count.update(b[k : k + length] for k in range(len(b) - length + 1))
    out = {}
    for i, b in raw.items():
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - length + 1):
            if count[b[k : k + length]] > 1:
                gone[k : k + length] = True
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        spans = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        out[i] = (len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())
    return out


def found(df):
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect()}


@pytest.mark.parametrize("how", [{"length": 200}, {"length": 60, "gram": 12}, {"length": 60, "gram": 12, "group": 1}])
def test_removals_equal_brute_force(docs, texts, how):
    assert found(suffix.removals(docs, **how)) == brute(texts, how["length"])


def test_texts_joined_by_shuffle(docs, texts, monkeypatch):
    monkeypatch.setattr(suffix, "BROADCAST_IDS", 0)
    assert found(suffix.removals(docs)) == brute(texts, 200)


def test_long_texts_are_cut_into_stretches(monkeypatch):
    rng = np.random.default_rng(5)
    data = rng.integers(97, 99, 5000).astype(np.uint8)
    whole = suffix._segments(data, np.array([0, 5000]), 60, 12)
    owner, first, count, h, c = whole
    assert count.sum() == 5000 - 60 + 1 and (first[1:] == first[:-1] + count[:-1]).all()


def test_suffix_array_is_sorted():
    rng = np.random.default_rng(0)
    for n, letters in ((60, 1), (300, 2), (700, 4), (300, 256)):
        for _ in range(5):
            t = rng.integers(0, letters, n).astype(np.uint8)
            b = t.tobytes()
            assert suffix.suffix_array(t, n + 1).tolist() == sorted(range(n), key=lambda i: b[i:])  # noqa: B023


def test_strip_keeps_columns_and_whole_characters(docs, texts, no_docs):
    left = suffix.strip(docs)
    assert left.schema.names == docs.schema.names
    rows = {r.doc_id: r for r in left.collect()}
    assert set(rows) == set(texts)
    want = brute(texts, 200)
    for i, t in texts.items():
        if want[i][1] == 0:
            assert rows[i].text == t and rows[i].n_chars == 1
        else:
            assert len(rows[i].text.encode()) <= want[i][0] - want[i][1] and rows[i].n_chars == len(rows[i].text)
    assert suffix.strip(no_docs).count() == 0 and suffix.removals(no_docs).count() == 0


def test_strip_leaves_columns_of_any_name(spark, docs, texts):
    more = docs.selectExpr("*", "doc_id + 1 AS _id", "'l' AS left", "'m' AS marks", "1 AS h", "2 AS c")
    left = suffix.strip(more)
    assert left.columns == more.columns
    assert all(r._id == r.doc_id + 1 and r.left == "l" for r in left.collect())


def test_rolling_hashes_tell_twins_apart():
    word = np.array([i.bit_count() % 2 for i in range(4096)], np.uint8)
    both = np.concatenate([97 + word, 98 - word])
    for n in (256, 1024, 4096):
        h = suffix.rolling_hashes(both, np.array([0, 4096]), np.array([n, 4096 + n]))
        assert h[0] != h[1]
        same = suffix.rolling_hashes(np.concatenate([both[:n], both[:n]]), np.array([0, n]), np.array([n, 2 * n]))
        assert same[0] == same[1]


def test_rows_of_one_id_are_texts_of_their_own(spark, texts):
    """Repeated rows, other texts under the same id, and rows without one."""
    rows = [(3, texts[3]), (3, texts[3]), (3, texts[4]), (3, "q" * 450), (4, texts[4] + "end"), (5, texts[5] * 3), (5, "short"), (5, None)]
    want = brute(dict(enumerate(t for _, t in rows)), 200)
    df = spark.createDataFrame([*rows, (None, texts[5] * 3)], "doc_id long, text string").repartition(3)
    got = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix.removals(df).collect()]
    assert sorted(g for g in got if g[0]) == sorted((rows[i][0], *w) for i, w in want.items() if rows[i][0] != 5) + sorted((5, *w) for i, w in brute(dict(enumerate([*(t for _, t in rows), texts[5] * 3])), 200).items() if i < len(rows) and rows[i][0] == 5)
    assert len([g for g in got if g[0] is None]) == 1 and suffix.strip(df).count() == len(rows) + 1
