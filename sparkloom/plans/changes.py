"""Changes over three revisions. A document is the merge base; the head and the target base take and add lines of it by
their lengths, so that every document of the table has hunks of its own."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.operators import changes as X
from sparkloom.operators import passages
from sparkloom.operators.steps import materialise

from .registry import Tables, query

#: A line whose length leaves 0 goes, 1 is replaced, 2 has one added after it.
SIDES = {"HEAD": 13, "TARGET": 17}


def _script(t: Tables) -> DataFrame:
    lines = t.documents.where("text IS NOT NULL").select(F.col("doc_id").alias("file"), F.posexplode(F.split("text", "\n")).alias("at", "line"))
    sides = F.explode(F.array(*[F.struct(F.lit(s).alias("side"), F.lit(n).alias("n")) for s, n in SIDES.items()])).alias("s")
    rows = lines.select("file", (F.col("at") + 1).alias("line"), F.length("line").alias("size"), sides)
    left = F.col("size") % F.col("s.n")
    return rows.select("file", F.col("s.side").alias("side"), "line", (left < 2).cast("int").alias("removed"), left.isin(1, 2).cast("int").alias("added"))


def _files(t: Tables, hunks: DataFrame, script: DataFrame) -> DataFrame:
    own = script.where("side = 'HEAD'").groupBy("file").agg(F.count("*").alias("old_lines"), F.sum(1 - F.col("removed") + F.col("added")).alias("head_lines"))
    moved = hunks.where("side = 'TARGET'").select("file").distinct().withColumn("moved", F.lit(True))
    docs = t.documents.where("text IS NOT NULL").select(F.col("doc_id").alias("file"), F.when(F.col("source").endswith("3"), "unavailable").otherwise("complete").alias("head_status"), F.when(F.col("lang") == "de", "absent").when(F.col("lang") == "fr", "unavailable").otherwise("complete").alias("target_status"), F.when(F.col("n_chars") > 5000, "truncated").otherwise("complete").alias("patch_status"))
    rows = docs.join(own, "file").join(moved, "file", "left")
    return rows.select("*", F.lit("complete").alias("old_status"), (F.col("moved").isNull() & (F.col("target_status") == "complete")).alias("same_base")).drop("moved")


def _analysed(t: Tables) -> tuple[DataFrame, DataFrame]:
    script = materialise(_script(t), "script")
    hunks = materialise(X.hunks_of(script), "hunks")
    return X.analysed(_files(t, hunks, script), hunks, 8)


HUNKS = """l AS (SELECT doc_id AS file, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents WHERE text IS NOT NULL),
s AS (SELECT file, side, i, CASE WHEN length(line) % n < 2 THEN 1 ELSE 0 END AS r, CASE WHEN length(line) % n IN (1, 2) THEN 1 ELSE 0 END AS a FROM l CROSS JOIN (VALUES ('HEAD', 13), ('TARGET', 17)) v(side, n)),
e AS (SELECT *, CASE WHEN r = 0 OR NOT (coalesce(lag(r) OVER w, 0) = 1 OR coalesce(lag(a) OVER w, 0) = 1) THEN 1 ELSE 0 END AS fresh, coalesce(sum(a - r) OVER (PARTITION BY file, side ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS shift FROM s WINDOW w AS (PARTITION BY file, side ORDER BY i)),
c AS (SELECT *, sum(fresh) OVER (PARTITION BY file, side ORDER BY i) AS nth FROM e WHERE r = 1 OR a = 1),
g AS (SELECT file, side, nth, sum(r) AS old_count, sum(a) AS new_count, min(i) FILTER (r = 1) AS gone, min(i) AS first, arg_min(shift, i) AS shift FROM c GROUP BY ALL),
h AS (SELECT file, side, CAST(nth AS BIGINT) AS nth, CAST(coalesce(gone, first) AS BIGINT) AS old_start, CAST(old_count AS BIGINT) AS old_count, CAST(coalesce(gone, first + 1) + shift - CASE WHEN new_count = 0 THEN 1 ELSE 0 END AS BIGINT) AS new_start, CAST(new_count AS BIGINT) AS new_count FROM g),
f AS (SELECT d.doc_id AS file, source NOT LIKE '%3' AS read, coalesce(lang = 'de', false) AS absent, CASE WHEN lang = 'fr' THEN 'UNAVAILABLE' WHEN coalesce(lang = 'de', false) OR d.doc_id IN (SELECT file FROM h WHERE side = 'TARGET') THEN 'DIVERGED' ELSE 'UNCHANGED_BASE' END AS comparison, n_chars > 5000 AS cut, (SELECT count(*) FROM h WHERE h.file = d.doc_id AND side = 'HEAD') AS hunks, (SELECT count(*) FROM l WHERE l.file = d.doc_id) AS lines FROM documents d WHERE text IS NOT NULL)"""


@query(f"WITH {HUNKS} SELECT file, side, nth, old_start, old_count, new_start, new_count FROM h")
def revision_hunks(t: Tables) -> DataFrame:
    """The hunks of both revisions against the merge base."""
    return X.hunks_of(_script(t))


@query(f"""WITH {HUNKS}, d AS (SELECT file, nth, old_start, old_count, new_start, new_count FROM h WHERE side = 'HEAD' AND nth <= 8 UNION ALL SELECT file, 1, CASE WHEN lines > 0 THEN 1 ELSE 0 END, lines, CASE WHEN lines > 0 THEN 1 ELSE 0 END, lines FROM f WHERE hunks = 0),
p AS (SELECT d.*, old_start + CASE WHEN old_count > 0 THEN old_count - 1 ELSE 1 END AS last FROM d),
t AS (SELECT file, old_start AS s, old_count AS n, new_count - old_count AS shift FROM h WHERE side = 'TARGET'),
q AS (SELECT p.*, (SELECT count(*) FROM t WHERE t.file = p.file AND CASE WHEN n > 0 THEN s <= last AND s + n - 1 >= old_start ELSE s >= old_start AND s < last END) AS touched, (SELECT coalesce(sum(shift), 0) FROM t WHERE t.file = p.file AND s + greatest(n, 1) - 1 < old_start) AS moved FROM p),
r AS (SELECT q.*, comparison, CASE WHEN hunks = 0 THEN 'METADATA_ONLY' WHEN read THEN 'TEXT' ELSE 'UNSUPPORTED' END AS analysis, CASE WHEN comparison = 'UNAVAILABLE' THEN 'UNAVAILABLE' WHEN absent OR touched > 0 THEN 'TOUCHED' ELSE 'EXACT' END AS target_status FROM q JOIN f USING (file))
SELECT file, nth, old_start, old_count, new_start, new_count, CAST(CASE WHEN target_status = 'EXACT' THEN old_start + moved END AS BIGINT) AS target_start, target_status, comparison, analysis FROM r""")
def change_triples(t: Tables) -> DataFrame:
    """Every hunk of the head with its lines at merge base, head and target base."""
    return _analysed(t)[0]


@query(f"""WITH {HUNKS} SELECT file, CASE WHEN hunks = 0 THEN 'METADATA_ONLY' WHEN read THEN 'TEXT' ELSE 'UNSUPPORTED' END AS status, greatest(least(hunks, 8), 1) AS deltas, array_to_string(list_sort(list_filter([CASE WHEN NOT read THEN 'CONTENT_UNAVAILABLE' END, CASE WHEN comparison <> 'UNCHANGED_BASE' THEN 'TARGET_' || comparison END, CASE WHEN cut THEN 'PATCH_TRUNCATED' END, CASE WHEN hunks > 8 THEN 'DELTA_LIMIT' END], lambda x: x IS NOT NULL)), ',') AS reasons FROM f""")
def change_coverage(t: Tables) -> DataFrame:
    """What of each file's change is covered, and what limits it."""
    return _analysed(t)[1]


@query(f"WITH {HUNKS} SELECT file, side, old_start, old_count, new_start, new_count, CAST(NULL AS VARCHAR) AS error FROM h")
def patches_read(t: Tables) -> DataFrame:
    """The hunks of both revisions, written as unified patches of the documents' lines and read again."""
    lines = t.documents.where("text IS NOT NULL").select(F.col("doc_id").alias("file"), F.posexplode(F.split("text", "\n")).alias("at", "text"))
    script = _script(t).join(lines.select("file", (F.col("at") + 1).alias("line"), "text"), ["file", "line"])
    new = F.when(F.col("added") > 0, F.array(F.concat(F.lit("new "), "text"))).otherwise(F.array().cast("array<string>"))
    found = X.patches(script.withColumn("new", new)).select("file", "side", F.explode(passages.patch_hunks(F.col("patch"))).alias("h"))
    number = lambda c: F.col(f"h.{c}").cast("long").alias(c)
    return found.select("file", "side", *[number(c) for c in ("old_start", "old_count", "new_start", "new_count")], "h.error")


@query(f"WITH {HUNKS}, n AS (SELECT file, side, CAST(sum(new_count) AS BIGINT) AS additions, CAST(sum(old_count) AS BIGINT) AS deletions FROM h GROUP BY ALL) SELECT d.doc_id AS file, v.side, CASE WHEN text IS NULL THEN 'BINARY' WHEN n.file IS NULL THEN 'UNCHANGED' ELSE 'M' END AS status, coalesce(additions, 0) AS additions, coalesce(deletions, 0) AS deletions FROM documents d CROSS JOIN (VALUES ('HEAD'), ('TARGET')) v(side) LEFT JOIN n ON n.file = d.doc_id AND n.side = v.side")
def changed_file_stats(t: Tables) -> DataFrame:
    """Changed files with their counts of lines: the list of paths and the list of counts, joined by path."""
    counts = X.hunks_of(_script(t)).groupBy("file", "side").agg(F.sum("new_count").alias("additions"), F.sum("old_count").alias("deletions"))
    paths = t.documents.select(F.col("doc_id").alias("file"), F.explode(F.array(*map(F.lit, SIDES))).alias("side"), F.col("text").isNull().alias("binary"))
    status = F.when(F.col("binary"), "BINARY").when(F.col("additions").isNull(), "UNCHANGED").otherwise("M")
    return paths.join(counts, ["file", "side"], "left").select("file", "side", status.alias("status"), F.coalesce("additions", F.lit(0)).alias("additions"), F.coalesce("deletions", F.lit(0)).alias("deletions"))
