"""Operators that SQL cannot express, against plain Python on small fixtures and the small tables."""

import io
import json
import random
import zipfile

import pytest
from pyspark.sql import functions as F
from sparkloom import plans
from sparkloom.functions import classify as C
from sparkloom.functions import identity as I
from sparkloom.functions import text as X
from sparkloom.operators import evidence, folds, ledger, passages, retrieval
from sparkloom.operators import graph as G
from sparkloom.sources import tables
from sparkloom.streaming import jobs

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sized(spark):
    rng = random.Random(3)
    rows = [("hot" if i % 3 else f"k{i % 5}", i, rng.choice((0, 5, 40, 90, 130))) for i in range(1500)]
    return rows, spark.createDataFrame(rows, "source string, doc_id long, tokens int").repartition(5)


def keyed(rows):
    out = {}
    for key, i, n in sorted(rows, key=lambda r: r[1]):
        out.setdefault(key, []).append((i, n))
    return out


def greedy(items, most_rows, most_size):
    batch = n = held = 0
    for i, size in items:
        if n and (n >= most_rows or held + size > most_size):
            batch, n, held = batch + 1, 0, 0
        n, held = n + 1, held + size
        yield i, batch


@pytest.mark.parametrize("bounds", [(4, 100), (1, 10), (32, 3000), (7, 0)])
def test_batches_run_over_the_whole_key(sized, bounds):
    rows, df = sized
    want = {i: b for items in keyed(rows).values() for i, b in greedy(items, *bounds)}
    got = folds.batches(df, "source", "doc_id", "tokens", *bounds).collect()
    assert {r.doc_id: r.batch for r in got} == want and len(got) == len(rows)


def test_batches_of_nothing_and_of_odd_rows(spark):
    kind = "source string, doc_id long, tokens int"
    assert folds.batches(spark.createDataFrame([], kind), "source", "doc_id", "tokens", 4, 100).count() == 0
    odd = spark.createDataFrame([(None, 1, None), (None, 2, 500), (None, 3, 1), ("", 4, 1)], kind)
    assert {(r.source, r.doc_id): r.batch for r in folds.batches(odd, "source", "doc_id", "tokens", 4, 100).collect()} == {(None, 1): 0, (None, 2): 1, (None, 3): 2, ("", 4): 0}


def test_packets_equal_a_plain_fold(spark):
    rng = random.Random(5)
    rows = [(rng.choice("pq"), rng.choice("abcde"), i, rng.choice((1, 20, 45, 60, 99, 130))) for i in range(700)]
    want = {}
    for plan in "pq":
        units = sorted((r for r in rows if r[0] == plan), key=lambda r: (r[1], r[2]))
        fit = [r for r in units if r[3] <= 100]
        groups = {}
        for r, (_, b) in zip(fit, greedy([(r[2], r[3]) for r in fit], 6, 100), strict=True):
            groups.setdefault(b, []).append(r)
        open_, held, into = {}, {}, {}
        for b, members in groups.items():
            n, cost, subjects = len(members), sum(r[3] for r in members), {r[1] for r in members}
            mine = open_.setdefault(members[0][1], []) if len(subjects) == 1 else []
            found = next((j for j in mine if held[j][0] + n <= 6 and held[j][1] + cost <= 100), None)
            if found is None:
                held[b] = [n, cost]
                if len(subjects) == 1 and n < 6 and len(mine) < 8:
                    mine.append(b)
            else:
                held[found] = [held[found][0] + n, held[found][1] + cost]
                if held[found][0] >= 6:
                    mine.remove(found)
            into[b] = b if found is None else found
        want |= {r[2]: into[b] for b, members in groups.items() for r in members}
    df = spark.createDataFrame(rows, "plan string, subject string, seq long, size int").repartition(3)
    got = {r.seq: r.packet for r in folds.packets(df, "plan", "subject", "seq", "size", 100, 6).collect()}
    assert got == {r[2]: want.get(r[2]) for r in rows}


def test_quotas(spark):
    rows = [(1, 10, 0.9, "a"), (1, 11, 0.9, "a"), (1, 12, 0.8, "a"), (1, 13, 0.7, "b"), (1, 14, 0.6, "c"), (2, 10, 0.1, "a")]
    df = spark.createDataFrame(rows, "query_id long, item long, score double, source string")
    kept = sorted((r.query_id, r.place, r.item) for r in folds.by_quota(df, "query_id", "item", {"source": 2}, 3).collect())
    assert kept == [(1, 1, 10), (1, 2, 11), (1, 3, 13), (2, 1, 10)]
    rows = [(1, 10, 0.9, ["b", "a"], "CODE"), (1, 11, 0.8, ["a"], "CODE"), (1, 12, 0.7, ["a", "b"], "CODE"), (1, 13, 0.6, ["a"], "ADR"), (1, 14, 0.5, ["c"], "CODE"), (1, 15, 0.4, ["c"], "ADR")]
    df = spark.createDataFrame(rows, "query_id long, item long, score double, seeds array<string>, kind string")
    kept = sorted((r.place, r.item, r.owner) for r in folds.by_quota(df, "query_id", "item", {}, 9, "seeds", 2, "kind", {"CODE": 3}).collect())
    assert kept == [(1, 10, "a"), (2, 11, "a"), (3, 12, "b"), (4, 15, "c")]


def test_windows_are_lossless(spark):
    docs = spark.createDataFrame([(1, "ab\ncd é漢\U0001f600\n" * 50), (2, ""), (3, None), (4, "x" * 99)], "doc_id long, text string")
    got = passages.windows(docs, most=16).orderBy("doc_id", "nth").collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    for i in (1, 4):
        mine = [r for r in got if r.doc_id == i]
        assert "".join(r.window for r in mine) == texts[i] and all(len(r.window.encode()) <= 16 for r in mine)
        assert all(texts[i].startswith(r.window, r.start) for r in mine)
    assert {r.doc_id for r in got} == {1, 4}


def test_sections_hunks_declarations(spark):
    text = "before\n# One\nbody\n## Two\nmore\n#no heading"
    assert spark.createDataFrame([(text,)], "t string").select(passages.sections(F.col("t"))).first()[0] == ["before\n", "# One\nbody\n", "## Two\nmore\n#no heading"]
    patches = ["--- a\n+++ b\n@@ -1,2 +1,3 @@\n a\n-b\n+c\n+d\n@@ -9 +10 @@\n-x\n", "@@ -1 +1 @@\n-a\n+b\n\\ No newline at end of file", "@@ -1,0 +1 @@ f\n+x", "@@@ -1 +1 @@@\n+x", "@@ -1 +1 @@\n\n-a\n+b", "words", "diff --git a b\nold mode 1", " "]
    got = [[tuple(h) for h in r.h] for r in spark.createDataFrame([(i, p) for i, p in enumerate(patches)], "i int, p string").orderBy("i").select(passages.patch_hunks(F.col("p")).alias("h")).collect()]
    assert got[0] == [(1, 2, 1, 3, "a\nb", "a\nc\nd", None), (9, 1, 10, 1, "x", "", "COUNT_MISMATCH")]
    assert got[1] == [(1, 1, 1, 1, "a", "b", None)] and got[2] == [(1, 0, 1, 1, "", "x", None)]
    assert [h[-1] for g in got[3:] for h in g] == ["UNSUPPORTED_FORMAT", "UNEXPECTED_LINE", "UNRECOGNIZED"] and got[6:] == [[], []]
    assert passages.declarations("@d\nclass A:\n    def f(self):\n        pass\n\ndef g(): pass\n") == [("class", "A", 1, 4), ("function", "A.f", 3, 4), ("function", "g", 6, 6)]
    assert passages.declarations("def (") == []


def test_line_changes_and_nested_ranges(spark):
    pairs = spark.createDataFrame([(1, "a\nb\nc", "a\nx\nc\nd"), (2, None, "")], "k long, o string, n string")
    got = [(r.k, r.tag, r.old_from, r.old_to, r.new_from, r.new_to) for r in passages.line_changes(pairs, "k", "o", "n").orderBy("k", "nth").collect()]
    assert got == [(1, "equal", 0, 1, 0, 1), (1, "replace", 1, 2, 1, 2), (1, "equal", 2, 3, 2, 3), (1, "insert", 3, 3, 3, 4)]
    ranges = spark.createDataFrame([("p", 1, 9), ("p", 2, 5), ("p", 1, 9), ("q", 2, 5)], "k string, first int, last int")
    assert sorted(map(tuple, passages.outermost(ranges, "k").collect())) == [("p", 1, 9), ("p", 1, 9), ("q", 2, 5)]


def test_documents_and_logs(spark, tmp_path):
    word = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{word}"><w:body><w:p><w:pPr><w:pStyle w:val="Heading2"/></w:pPr><w:r><w:t>Top</w:t></w:r></w:p><w:p><w:r><w:t>one </w:t></w:r><w:r><w:t>two</w:t></w:r></w:p></w:body></w:document>')
    (tmp_path / "d").mkdir()
    (tmp_path / "d/a.docx").write_bytes(raw.getvalue())
    (tmp_path / "d/bad.docx").write_bytes(b"no archive")
    (tmp_path / "d/b.md").write_bytes(b"# x\r\ny")
    (tmp_path / "d/c.bin").write_bytes(b"\0" * 10)
    (tmp_path / "d/big.md").write_bytes(b"z" * 200)
    got = {r.path.rsplit("/", 1)[1]: r.text for r in tables.documents(spark, f"file://{tmp_path}/d", most=1000).collect() if r.length != 200}
    assert got == {"a.docx": "## Top\none two", "bad.docx": None, "b.md": "# x\ny", "c.bin": None}
    lines = [{"k": "a", "seq": 1, "v": "old"}, {"k": "a", "seq": 3, "v": "new"}, {"k": "b", "seq": 2, "v": "x"}]
    (tmp_path / "log.jsonl").write_text("\n".join(map(json.dumps, lines)))
    assert sorted((r.k, r.v) for r in tables.last_records(spark, f"file://{tmp_path}/log.jsonl", "k string, seq long, v string", "k", "seq").collect()) == [("a", "new"), ("b", "x")]


def test_upserts_deletions_snapshots(spark, tmp_path):
    old = spark.createDataFrame([(1, "a", 0), (2, "b", 0)], "id long, v string, seq long")
    new = spark.createDataFrame([(2, "c", 1), (2, "d", 2), (3, "e", 1)], "id long, v string, seq long")
    assert sorted((r.id, r.v) for r in tables.upserted(old, new, ["id"]).collect()) == [(1, "a"), (2, "d"), (3, "e")]
    assert [r.id for r in tables.without(old, new, ["id"]).collect()] == [1]
    edges = spark.createDataFrame([(1, 7)], "src long, dst long")
    assert [r.id for r in tables.without_orphans(old, edges, "id", "src", "dst").collect()] == [1]
    folder = f"file://{tmp_path}/snap"
    tables.save_snapshot(old, folder, "x")
    tables.save_snapshot(new, folder, "y")
    assert tables.load_snapshot(spark, folder, "x").count() == 2
    with pytest.raises(Exception, match="(?i)exists"):
        tables.save_snapshot(new, folder, "x")
    assert sorted((r.id, r.v) for r in tables.replaced(old, new, new.select("id"), ["id"]).collect()) == [(1, "a"), (2, "c"), (2, "d"), (3, "e")]
    tables.save_audit(old, f"file://{tmp_path}/audit", "r1")
    assert spark.read.json(f"file://{tmp_path}/audit/run=r1").count() == 2
    with pytest.raises(Exception, match="(?i)exists"):
        tables.save_audit(old, f"file://{tmp_path}/audit", "r1")


def test_stream_equals_batch(spark, tmp_path):
    got = plans.queries()["stream_job_state"](spark, SMALL)
    events = spark.read.parquet(f"{SMALL}/events.parquet")
    batch = {r.user_id: (r.epoch, r.attempts, r.last_type) for r in ledger.job_states(events).collect()}
    mine = {r.user_id: (r.epoch, r.attempts, r.last_type) for r in got.collect()}
    assert set(mine) == {r.user_id for r in events.select("user_id").distinct().collect()}
    assert {k: v for k, v in mine.items() if v[0]} == batch
    doubled = events.union(events)
    doubled.repartition(3).write.parquet(f"file://{tmp_path}/e")
    once = jobs.deduplicated(spark.readStream.schema(jobs.EVENTS).parquet(f"file://{tmp_path}/e"), ["event_id"], "60 days")
    run = once.writeStream.format("memory").queryName("once").option("checkpointLocation", f"file://{tmp_path}/c").trigger(availableNow=True).start()
    run.awaitTermination()
    assert spark.table("once").count() == events.count()


def test_text_queries_cover_every_document(spark):
    n = spark.read.parquet(f"{SMALL}/documents.parquet").count()
    for name in ("token_batches", "byte_budget", "unit_packets"):
        assert plans.queries()[name](spark, SMALL).select("doc_id").distinct().count() == n
    assert plans.queries()["line_diff"](spark, SMALL).select("doc_id").distinct().count() == n // 2
    kept = plans.queries()["quota_select"](spark, SMALL)
    assert kept.groupBy("query_id").count().agg(F.max("count")).first()[0] <= 32


def test_communities_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)], "src long, dst long")
    assert {(r.node, r.community) for r in G.communities(G.undirected(edges)).collect()} == {(i, 0) for i in range(41)} | {(100, 100), (101, 100)}


def test_communities_of_a_chain_whose_ids_fall_from_both_ends(spark):
    chain = [*range(1, 100, 2), *range(100, 0, -2)]  # 1, 3, .., 99, 100, 98, .., 2
    edges = spark.createDataFrame(list(zip(chain, chain[1:], strict=False)) + [(200, 201)], "src long, dst long")
    assert {(r.node, r.community) for r in G.communities(G.undirected(edges)).collect()} == {(i, 1) for i in range(1, 101)} | {(200, 200), (201, 200)}


def test_communities_of_all_customers(spark):
    orders = spark.read.parquet(f"{SMALL}/orders.parquet").selectExpr("concat('c', o_custkey) AS node")
    found = plans.queries()["community_components"](spark, SMALL)
    assert orders.join(found, "node", "left_anti").count() == 0
    assert "collect_list" not in found._jdf.queryExecution().toString()  # no member list on a row


def test_every_fiftieth_vector_is_asked(spark):
    want = {r.vec_id for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").where("vec_id % 50 = 0").collect()}
    assert {r.query_id for r in plans.queries()["cosine_topk"](spark, SMALL).collect()} == want


def test_byte_budget_is_one_for_a_source(spark):
    rows = sorted((r.source, r.doc_id, len((r.text or "").encode())) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect())
    rows += [(s, i + 10_000 * k, n) for k in (1, 2, 3, 4) for s, i, n in rows]
    df = spark.createDataFrame(rows, "source string, doc_id long, size long")
    used, want = {}, {}
    for s, i, n in sorted(rows):
        want[i] = used.get(s, 0) + n <= 20_000
        used[s] = used.get(s, 0) + (n if want[i] else 0)
    assert not all(want.values())
    for most in (65_536, 7):
        assert {r.doc_id: r.admitted for r in folds.admitted_in_all(df, "source", "doc_id", "size", 20_000, most).collect()} == want
    assert "block" not in plans.queries()["byte_budget"](spark, SMALL).columns  # no budget of a block


def test_a_later_event_with_a_smaller_id_counts(spark, tmp_path):
    rows = [(9, "2024-01-01 00:00:01", 1, "signup"), (3, "2024-01-01 00:00:02", 1, "click"), (3, "2024-01-01 00:00:02", 1, "click"), (5, "2024-01-01 00:00:00", 2, "click")]
    later = [(2, "2024-01-02 00:00:00", 1, "click"), (9, "2024-01-01 00:00:01", 1, "signup"), (7, "2024-01-02 00:00:00", 2, "signup")]
    for name, part in (("a", rows), ("b", later)):
        df = spark.createDataFrame(part, "event_id long, ts string, user_id long, event_type string")
        df.selectExpr("event_id", "cast(ts as timestamp_ntz) AS ts", "user_id", "event_type", "1.0D AS value", "'{}' AS props").coalesce(1).write.parquet(f"file://{tmp_path}/{name}")
    got = {r.user_id: (r.epoch, r.attempts, r.last_type) for r in jobs.job_state(spark, f"file://{tmp_path}/[ab]/*.parquet", f"file://{tmp_path}/s").collect()}
    assert got == {1: (1, 2, "click"), 2: (1, 0, "signup")}


def test_folding_is_full(spark):
    words = ["Straße", "ΣΊΣΥΦΟΣ", "ſ", "ﬁ", "İ", "Ǆ", "ΰ", "ᾳ", "K", "µ", "plain", ""]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    assert [r.f for r in df.select(I.folded(F.col("w")).alias("f")).collect()] == [w.casefold() for w in words]


def test_classifications_by_hand(spark):
    rows = [("x.py", "", "@app.get('/a')", "API"), ("x.py", "Column(1)", "", "SCHEMA"), ("x.py", "db.query (1)", "", "DATA_ACCESS"), ("x.py", "g.add_edge(a)", "", "WORKFLOW"), ("a/go.mod", "", "", "DEPENDENCY"), ("x.py", "a", " import os", "DEPENDENCY"), ("x.yml", "", "", "CONFIGURATION"), ("x.py", "os.environ", "", "CONFIGURATION"), ("x.py", "", "async def f():", "COMPONENT"), ("x.py", None, "y = 1", "OTHER")]
    df = spark.createDataFrame(rows, "path string, old string, new string, want string")
    assert all(r.k == r.want for r in df.select("want", C.delta_kind(F.col("path"), F.col("old"), F.col("new")).alias("k")).collect())
    routed = df.select(C.delta_kind(F.col("path"), F.col("old"), F.col("new"), F.lit(True)).alias("k")).distinct().collect()
    assert [r.k for r in routed] == ["API"]
    quotes = spark.createDataFrame([("""a 'b' "c" 'd" "" 'b' x'y'""",)], "t string").select(X.quoted_literals(F.col("t"))).first()[0]
    assert quotes == ["b", "c", " ", "y"]


def test_places_of_spans_and_quotes(spark):
    text = "ab\ncdé\n\nf"
    lines = text.splitlines(keepends=True)
    starts = [sum(map(len, lines[:i])) for i in range(len(lines))]
    spans = [(a, b) for a in range(-1, len(text) + 1) for b in range(0, len(text) + 2)]
    rows = spark.createDataFrame([(text, a, b) for a, b in spans], "t string, a int, b int").select("a", "b", X.span_place(F.col("t"), F.col("a"), F.col("b")).alias("p")).collect()
    for r in rows:
        if not 0 <= r.a < r.b <= len(text):
            assert r.p is None
            continue
        first = max(i for i, s in enumerate(starts) if s <= r.a)
        last = max(i for i, s in enumerate(starts) if s <= r.b - 1)
        end = None if r.b - starts[last] == len(lines[last]) or text[r.b - 1] == "\n" else r.b - starts[last]
        assert tuple(r.p) == (first + 1, last + 1, r.a - starts[first], end)
    quotes = spark.createDataFrame([("aXbX", "Xb"), ("aXbX", "X"), ("aaa", "aa"), ("abc", "z"), ("abc", "")], "e string, q string").select(X.quote_place(F.col("e"), F.col("q")).alias("p")).collect()
    assert [tuple(r.p) for r in quotes] == [("FOUND", 1, 3), ("QUOTE_AMBIGUOUS", None, None), ("QUOTE_AMBIGUOUS", None, None), ("QUOTE_NOT_FOUND", None, None), ("QUOTE_NOT_FOUND", None, None)]
    change = spark.createDataFrame([(list("abcdefg"), list("abcXefg")), (list("ab"), list("ab")), ([], ["x"]), (list("aaa"), list("aa"))], "o array<string>, n array<string>").select(X.trimmed_change(F.col("o"), F.col("n"), 1).alias("c")).collect()
    assert [tuple(r.c) for r in change] == [(3, 3, list("cde"), list("cXe")), (2, 0, ["b"], ["b"]), (0, 0, [], ["x"]), (2, 0, ["a", "a"], ["a"])]


def test_paragraphs_are_packed(spark):
    texts = ["a\n\nb\n \nc", "x" * 25, "Aa bb. Cc dd ee. " * 3, "", " \n\n "]
    got = [r.p for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(passages.packed_paragraphs(F.col("t"), 10).alias("p")).collect()]
    assert got[0] == ["a\n\nb\n\nc"] and got[1] == ["x" * 10, "x" * 10, "x" * 5] and got[3] == [] and got[4] == []
    assert all(len(p) <= 10 for p in got[2]) and "".join(got[2]).replace(" ", "") == texts[2].replace(" ", "")


def test_file_names_and_answers(spark):
    names = ["a/b/0001-use_kafka.md", "README", "Mixed-Case.txt", "---.md", ".env", "UPPER CASE.docx"]
    df = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, n string").orderBy("i")
    assert [r.t for r in df.select(X.title_of(F.col("n")).alias("t")).collect()] == ["0001 Use Kafka", "Readme", "Mixed Case", "Untitled ADR", ".Env", "Upper Case"]
    assert [r.t for r in df.select(X.mime_type(C.suffix(F.col("n"))).alias("t")).collect()][:2] == ["text/markdown", "application/octet-stream"]
    answers = spark.createDataFrame([("x ```json\n{\"a\": 1}\n``` y",), (' {"b": 2} ',)], "t string").select(X.fenced_json(F.col("t")).alias("j")).collect()
    assert [r.j for r in answers] == ['{"a": 1}', '{"b": 2}']


def test_holders_equal_containment(spark):
    rng = random.Random(2)
    words = ["a", "bb", "the", "x\ny", "zz."]
    docs = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(0, 9)))) for i in range(60)] + [(99, None)]
    passages = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 5)))) for i in range(25)] + [(50, "never b said"), (51, "b t"), (52, None)]
    want = {(p, d) for p, q in passages for d, t in docs if q is not None and t is not None and q in t}
    found = retrieval.holders(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(passages, "item_id long, passage string")).collect()
    assert {tuple(r) for r in found} == want and len(found) == len(want)


def test_challenges_prefer_shared_evidence(spark):
    rows = [(1, 1, [1, 2], 40), (1, 2, [3], 70), (1, 3, [2], 50), (1, 4, [3], 40), (1, 5, [2], 500), (1, 6, [9], 20), (2, 1, [1], 10)]
    df = spark.createDataFrame(rows, "plan long, key long, evidence array<long>, size long")
    got = {(r.plan, r.key): r.bin for r in evidence.challenges(df, "plan", "key", "evidence", "size", 100, most=2).collect()}
    assert got == {(1, 1): 0, (1, 2): 1, (1, 3): 0, (1, 4): 2, (1, 5): None, (1, 6): 1, (2, 1): 0}


def test_words_are_split_where_they_stand(spark):
    """Terms leave their text without a shuffle, and the short ways through plain words give what the long one gives."""
    words = ["plain", "Plain", "x9", "Éclair", "straße", "aßB", "snake_case", "$mark", "_", "HTTPServer", "camelCase", "aİb", "ﬁne", "A", "ABC", "nﬀ"]
    texts = spark.createDataFrame([(1, " ".join(words)), (2, None), (3, "plain Plain"), (4, "1 2")], "id long, text string")
    found = retrieval.term_lists(texts, "id", X.identifiers(F.col("text")), X.search_terms)
    assert "hashpartitioning" not in found._jdf.queryExecution().executedPlan().toString()
    long = texts.select("id", F.explode(X.identifiers(F.col("text"))).alias("w")).select("id", F.array_distinct(F.concat(F.array(X.folded(F.col("w"))), X._parts(F.col("w")))).alias("terms"))
    as_rows = lambda df: sorted((r.id, tuple(r.terms)) for r in df.collect())
    assert as_rows(found.where("size(terms) > 0")) == as_rows(long)
    assert sorted(r.id for r in found.where("size(terms) = 0").collect()) == [2, 4]
    stats = retrieval.corpus_stats(found, "id").first()
    assert stats.n_docs == 4 and stats.avg_len * 4 == sum(len(r[1]) for r in as_rows(long))
