"""Changes over three revisions: what a head does to its merge base, and where the target base holds the same lines.

Hunks map lines of an old text to a new one: (old_start, old_count, new_start, new_count), a hunk without old lines
standing after line old_start, as in unified diffs. Two maps start at the merge base, one to the head and one to the
target base. A hunk of the first is placed on the target base through the second: lines that no hunk of the second
touches lie there moved by what the hunks before them added and took away. This is found for all hunks of all files
by running sums over sorted positions, not by comparing hunks with hunks.

Numbering runs in windows over one file each, which the file's own text bounds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .steps import materialise

#: Hunks of a file that are told one by one.
MOST_DELTAS = 64


def _in_hunks(script: DataFrame) -> DataFrame:
    """The lines of an edit script (file, side, line, removed, added) that change something, with the number of their
    hunk and by how much lines before them have moved. A line that stays parts two hunks."""
    order = Window.partitionBy("file", "side").orderBy("line")
    before = F.coalesce(F.sum(F.col("added") - F.col("removed")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    joins = F.coalesce((F.lag("removed").over(order) > 0) | (F.lag("added").over(order) > 0), F.lit(False))
    rows = script.select("*", before.alias("shift"), F.when((F.col("removed") == 0) | ~joins, 1).otherwise(0).alias("fresh")).where("removed > 0 OR added > 0")
    return rows.withColumn("nth", F.sum("fresh").over(order))


def hunks_of(script: DataFrame) -> DataFrame:
    """(file, side, nth, old_start, old_count, new_start, new_count) of an edit script (file, side, line, removed,
    added): for every line of the old text whether it goes, and how many lines come in its place or after it."""
    rows = _in_hunks(script)
    per = rows.groupBy("file", "side", "nth").agg(F.sum("removed").alias("old_count"), F.sum("added").alias("new_count"), F.min(F.when(F.col("removed") > 0, F.col("line"))).alias("gone"), F.min("line").alias("first"), F.min_by("shift", "line").alias("shift"))
    start = F.coalesce("gone", F.col("first"))
    place = F.coalesce("gone", F.col("first") + 1) + F.col("shift") - F.when(F.col("new_count") == 0, 1).otherwise(0)
    number = lambda c, name: c.cast("long").alias(name)
    return per.select("file", "side", number(F.col("nth"), "nth"), number(start, "old_start"), number(F.col("old_count"), "old_count"), number(place, "new_start"), number(F.col("new_count"), "new_count"))


def patches(script: DataFrame) -> DataFrame:
    """(file, side, patch): unified patches without context of an edit script that also has `text`, each old line, and
    `new`, the lines that come in its place or after it. A patch is as long as its file's changes."""
    heads = hunks_of(script).select("file", "side", "nth", F.lit(0).alias("turn"), F.lit(0).cast("long").alias("line"), F.lit(0).alias("at"), F.format_string("@@ -%d,%d +%d,%d @@", "old_start", "old_count", "new_start", "new_count").alias("s"))
    rows = _in_hunks(script)
    gone = rows.where("removed > 0").select("file", "side", "nth", F.lit(1).alias("turn"), F.col("line").cast("long").alias("line"), F.lit(0).alias("at"), F.concat(F.lit("-"), "text").alias("s"))
    come = rows.select("file", "side", "nth", F.lit(2).alias("turn"), F.col("line").cast("long").alias("line"), F.posexplode("new").alias("at", "s")).withColumn("s", F.concat(F.lit("+"), "s"))
    both = heads.unionByName(gone).unionByName(come)
    lines = F.array_sort(F.collect_list(F.struct("nth", "turn", "line", "at", "s")))
    return both.groupBy("file", "side").agg(F.array_join(F.transform(lines, lambda x: x["s"]), "\n").alias("patch"))


def placed(ranges: DataFrame, hunks: DataFrame) -> DataFrame:
    """ranges (file, nth, start, end) with `touched`, how many hunks (file, old_start, old_count, new_count) change a line
    of them or come between two, and `moved`, by how many lines they lie elsewhere in the new text."""
    end = F.col("old_start") + F.greatest("old_count", F.lit(1)) - 1
    begin = F.when(F.col("old_count") > 0, F.col("old_start")).otherwise(F.col("old_start") + 1)
    blank = F.lit(None).cast("long")
    edge = lambda at, turn: hunks.select("file", at.cast("long").alias("at"), F.lit(turn).alias("turn"), blank.alias("nth"), (F.col("new_count") - F.col("old_count")).cast("long").alias("shift"), F.lit(1).cast("long").alias("one"))
    ask = lambda at, turn: ranges.select("file", F.col(at).cast("long").alias("at"), F.lit(turn).alias("turn"), "nth", F.lit(0).cast("long").alias("shift"), F.lit(0).cast("long").alias("one"))
    so_far = lambda c: F.sum(c).over(Window.partitionBy("file").orderBy("at", "turn").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    # Hunks that end before the range starts; then hunks that start before it ends, or with its last line.
    ended = edge(end, 1).union(ask("start", 0)).select("file", "nth", so_far("shift").alias("moved"), so_far("one").alias("ended")).where("nth IS NOT NULL")
    begun = edge(begin, 0).union(ask("end", 1)).select("file", "nth", so_far("one").alias("begun")).where("nth IS NOT NULL")
    both = ended.join(begun, ["file", "nth"]).select("file", "nth", "moved", (F.col("begun") - F.col("ended")).alias("touched"))
    return ranges.join(both, ["file", "nth"])


def comparison(target: Column, old: Column, same: Column) -> Column:
    """What the target base is to the merge base; an absent text is an empty one, an unavailable one is unknown."""
    known = lambda c: c.isin("complete", "absent")
    return F.when(~known(target) | ~known(old), "UNAVAILABLE").when(same, "UNCHANGED_BASE").otherwise("DIVERGED")


def analysed(files: DataFrame, hunks: DataFrame, most: int = MOST_DELTAS) -> tuple[DataFrame, DataFrame]:
    """The deltas and the coverage of a change.

    files (file, old_status, head_status, target_status, patch_status, old_lines, head_lines, same_base), a status being
    complete, absent or another word; hunks (file, side, nth, old_start, old_count, new_start, new_count), the side
    being HEAD or TARGET. Deltas: (file, nth, old_start, old_count, new_start, new_count, target_start, target_status,
    comparison, analysis), one for each of a file's first `most` hunks, or one over the whole file where there are none.
    target_status is EXACT where the lines lie unchanged on the target base, TOUCHED where it changes them too,
    UNAVAILABLE where it cannot be read. Coverage: (file, status, deltas, reasons), reasons sorted, one after another."""
    known = lambda c: F.col(c).isin("complete", "absent")
    base = files.withColumn("comparison", comparison(F.col("target_status"), F.col("old_status"), F.col("same_base"))).withColumn("read", known("old_status") & known("head_status"))
    head = hunks.where("side = 'HEAD'").drop("side")
    count = head.groupBy("file").agg(F.count("*").alias("hunks"))
    base = materialise(base.join(count, "file", "left").withColumn("hunks", F.coalesce("hunks", F.lit(0))), "files")
    state = F.when(F.col("hunks") == 0, "METADATA_ONLY").when(F.col("read"), "TEXT").otherwise("UNSUPPORTED")
    number = F.row_number().over(Window.partitionBy("file").orderBy("old_start", "nth"))
    told = head.join(base.select("file"), "file", "left_semi").withColumn("nth", number.cast("long")).where(F.col("nth") <= most)
    whole = base.where("hunks = 0").select("file", F.lit(1).cast("long").alias("nth"), *[F.when(F.col(c) > 0, 1).otherwise(0).cast("long").alias(s) if k else F.col(c).cast("long").alias(s) for c, k, s in (("old_lines", 1, "old_start"), ("old_lines", 0, "old_count"), ("head_lines", 1, "new_start"), ("head_lines", 0, "new_count"))])
    deltas = materialise(told.select("file", "nth", "old_start", "old_count", "new_start", "new_count").unionByName(whole), "deltas")
    # An insertion stands between two lines: both must be as they were.
    last = F.col("old_start") + F.when(F.col("old_count") > 0, F.col("old_count") - 1).otherwise(1)
    at = placed(deltas.select("file", "nth", F.col("old_start").alias("start"), last.alias("end")), hunks.where("side = 'TARGET'"))
    out = deltas.join(at.select("file", "nth", "moved", "touched"), ["file", "nth"]).join(base.select("file", "comparison", "target_status", state.alias("analysis")), "file")
    status = F.when(F.col("comparison") == "UNAVAILABLE", "UNAVAILABLE").when((F.col("target_status") == "absent") | (F.col("touched") > 0), "TOUCHED").otherwise("EXACT")
    out = out.withColumn("status", status).select("file", "nth", "old_start", "old_count", "new_start", "new_count", F.when(F.col("status") == "EXACT", F.col("old_start") + F.col("moved")).alias("target_start"), F.col("status").alias("target_status"), "comparison", "analysis")
    reasons = F.array_compact(F.array(
        F.when(~F.col("read"), "CONTENT_UNAVAILABLE"),
        F.when(F.col("comparison") != "UNCHANGED_BASE", F.concat(F.lit("TARGET_"), "comparison")),
        F.when(F.col("patch_status") != "complete", F.concat(F.lit("PATCH_"), F.upper("patch_status"))),
        F.when(F.col("hunks") > most, "DELTA_LIMIT"),
    ))
    coverage = base.select("file", state.alias("status"), F.greatest(F.least("hunks", F.lit(most)), F.lit(1)).cast("long").alias("deltas"), F.array_join(F.array_sort(reasons), ",").alias("reasons"))
    return out, coverage
