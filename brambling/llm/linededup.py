"""Operator 10 (DataFrame functions only): line dedup by winnowing over line hashes.

A window is the shortest run of non-blank lines from a line on (or back) that holds at least
``min_words`` words. The least line hash of a window is its minimum, and the place of that line is a
fingerprint; neighbouring windows mostly share it, so a row leaves only where the minimum changes.
Equal runs hold equal windows and so equal minima: a repeated run of ``min_words`` words is bound
to share a fingerprint with its first place. Fingerprints that occur at one place only are gone after
that join of positions, and with them nearly all lines.

A place with a repeated fingerprint is extended both ways by the neighbouring lines: backward and
forward windows around it are compared by their content, and each takes the first place (by doc_id, then
line) where its content stands. A line of a repeated run lies in a forward or a backward window of
that run, so matches reach exactly to both ends of it, with work in proportion to the lines and never
to pairs of places. Lines of a match that isn't its own first place are deleted; one that overlaps its
first place does not count, so of a run repeated in one document the first stays.

Nulls and edges: null text has no lines and stays null; documents keep their row when all lines go
(text is then empty); blank lines never match by themselves and go with a run they stand in; very
long texts are rows of lines like others; ties between equal hashes in a window go to the earlier line;
repeated rows of the same doc_id and text are one document; documents of one doc_id with different
texts are told apart; a null doc_id sorts first; an empty table gives no rows; other columns are kept,
but columns named ``n_lines`` or ``n_removed`` are replaced by the operator's (names beginning with ``_ld_`` are reserved).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import salted_join, table, written

MIN_WORDS = 50
DOC = ["_ld_doc", "_ld_text"]


def _lines(docs: DataFrame, min_words: int, id_col: str, text_col: str) -> DataFrame:
    """_ld_line, _ld_h (hash) and _ld_w (words, min_words at most) of every non-blank line."""
    key = [F.col(id_col).cast("long").alias("_ld_doc"), F.xxhash64(text_col).alias("_ld_text")]
    lines = docs.filter(F.length(text_col) > 0).select(*key, F.posexplode(F.split(text_col, "\n")).alias("_ld_line", "_ld_s"))
    lines = lines.select(*DOC, "_ld_line", F.trim(F.regexp_replace("_ld_s", "\\s+", " ")).alias("_ld_s")).filter("_ld_s <> ''")
    words = F.length("_ld_s") - F.length(F.replace(F.col("_ld_s"), F.lit(" "), F.lit(""))) + 1
    lines = lines.select(*DOC, "_ld_line", F.xxhash64("_ld_s").alias("_ld_h"), F.least(words, F.lit(min_words)).cast("int").alias("_ld_w"))
    # Repeated rows go here, line by line and first within each task, so that copies of one text don't meet in one task.
    return lines.groupBy(*DOC, "_ld_line").agg(F.first("_ld_h").alias("_ld_h"), F.first("_ld_w").alias("_ld_w"))


def _frames(lines: DataFrame, min_words: int) -> tuple[DataFrame, list]:
    """Lines with the words up to them, each once, and the frames of their forward and backward window."""
    by_doc = Window.partitionBy(*DOC)
    lines = lines.withColumn("_ld_again", F.lag("_ld_line").over(by_doc.orderBy("_ld_line"))).filter("_ld_again is null or _ld_again <> _ld_line").drop("_ld_again")
    lines = lines.withColumn("_ld_to", F.sum("_ld_w").over(by_doc.orderBy("_ld_line").rowsBetween(Window.unboundedPreceding, 0)).cast("long"))
    lines = lines.withColumn("_ld_from", F.col("_ld_to") - F.col("_ld_w"))
    # Every line counts a word at least and min_words at most, so these frames hold min_words lines at most.
    return lines, [by_doc.orderBy("_ld_from").rangeBetween(0, min_words - 1), by_doc.orderBy("_ld_to").rangeBetween(-(min_words - 1), 0)]


def fingerprints(lines: DataFrame, min_words: int) -> DataFrame:
    """_ld_line and _ld_h of the minima of the full windows, a row only where the minimum changes (the two directions may both name a place)."""
    lines, frames = _frames(lines, min_words)
    least = lambda frame: F.when(F.sum("_ld_w").over(frame) >= min_words, F.min(F.struct("_ld_h", "_ld_line")).over(frame))
    rows = lines.select(*DOC, "_ld_line", least(frames[0]).alias("_ld_a"), least(frames[1]).alias("_ld_b"))
    before = Window.partitionBy(*DOC).orderBy("_ld_line")
    new = lambda c: F.when(~F.col(c).eqNullSafe(F.lag(c).over(before)), F.col(c))
    rows = rows.select(*DOC, new("_ld_a").alias("_ld_a"), new("_ld_b").alias("_ld_b")).filter("_ld_a is not null or _ld_b is not null")
    rows = rows.select(*DOC, F.explode(F.when(F.col("_ld_a").eqNullSafe(F.col("_ld_b")), F.array("_ld_a")).otherwise(F.array("_ld_a", "_ld_b"))).alias("_ld_m")).filter("_ld_m is not null")
    return rows.select(*DOC, F.col("_ld_m._ld_h").alias("_ld_h"), F.col("_ld_m._ld_line").alias("_ld_line"))


def _place(*ends: str) -> Column:
    return F.struct(*DOC, *ends)


def _repeated(rows: DataFrame, keys: list[str], *ends: str) -> DataFrame:
    """Keys that stand at several places: the first of them, and how many rows there are."""
    found = rows.groupBy(*keys).agg(F.min(_place(*ends)).alias("_ld_first"), F.max(_place(*ends)).alias("_ld_last"), F.count("*").alias("_ld_n"))
    return found.filter("_ld_first <> _ld_last").drop("_ld_last")


def line_windows(lines: DataFrame, marked: DataFrame, min_words: int) -> DataFrame:
    """Of documents with repeated fingerprints (rows of ``marked``): full windows in both directions whose minimum is one of them."""
    # A marked place becomes a row before its line, so that lines, documents and windows can look for it.
    signs = marked.select(*DOC, "_ld_line", F.lit(None).cast("long").alias("_ld_h"), F.lit(None).cast("int").alias("_ld_w"))
    by_line = Window.partitionBy(*DOC).orderBy("_ld_line", F.col("_ld_h").asc_nulls_first())
    sign = F.when(F.col("_ld_h").isNull(), F.col("_ld_line"))
    held = lines.unionByName(signs).withColumn("_ld_mark", F.lag(sign).over(by_line).eqNullSafe(F.col("_ld_line")))
    held = held.withColumn("_ld_any", F.max(sign).over(Window.partitionBy(*DOC))).filter("_ld_any is not null and _ld_h is not null").drop("_ld_any")
    held, frames = _frames(held, min_words)

    def over(frame):
        parts = F.collect_list(F.struct("_ld_h", "_ld_line", "_ld_mark")).over(frame)
        return F.struct(F.sum("_ld_w").over(frame).alias("words"), parts.alias("parts"))

    both = held.select(*DOC, over(frames[0]).alias("a"), over(frames[1]).alias("b"))
    rows = both.select(*DOC, F.explode(F.array("a", "b")).alias("w")).filter(F.col("w.words") >= min_words)
    rows = rows.select(*DOC, F.col("w.parts").alias("_ld_p")).withColumn("_ld_min", F.array_min("_ld_p")).filter("_ld_min._ld_mark")
    return rows.select(*DOC, F.array_min("_ld_p._ld_line").alias("_ld_low"), F.array_max("_ld_p._ld_line").alias("_ld_high"), F.col("_ld_min._ld_h").alias("_ld_print"), F.xxhash64("_ld_p._ld_h").alias("_ld_content"))


def repeated_lines(docs: DataFrame, min_words: int = MIN_WORDS, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For every document that has any: the lines that stand in a repeated later run, as disjoint spans (_ld_low, _ld_high) in order."""
    lines = written(_lines(docs, min_words, id_col, text_col), "lines")
    prints = written(fingerprints(lines, min_words), "prints")
    marked = salted_join(prints, written(_repeated(prints, ["_ld_h"], "_ld_line").select("_ld_h", "_ld_n"), "repeated"), ["_ld_h"], "_ld_n", DOC)
    rows = written(line_windows(lines, marked.select(*DOC, "_ld_line").distinct(), min_words), "windows")
    firsts = _repeated(rows, ["_ld_print", "_ld_content"], "_ld_low", "_ld_high")
    firsts = written(firsts.select("_ld_print", "_ld_content", "_ld_n", F.col("_ld_first._ld_doc").alias("_ld_doc_1"), F.col("_ld_first._ld_text").alias("_ld_text_1"), F.col("_ld_first._ld_high").alias("_ld_high_1")), "firsts")
    hits = salted_join(rows, firsts, ["_ld_print", "_ld_content"], "_ld_n", DOC)
    same = F.col("_ld_doc").eqNullSafe(F.col("_ld_doc_1")) & (F.col("_ld_text") == F.col("_ld_text_1"))
    hits = hits.filter(~same | (F.col("_ld_low") > F.col("_ld_high_1")))
    # Matches that overlap or touch become one, so that what a document loses is disjoint and in order.
    order = Window.partitionBy(*DOC).orderBy("_ld_low", "_ld_high")
    before = F.max("_ld_high").over(order.rowsBetween(Window.unboundedPreceding, -1))
    spans = hits.select(*DOC, "_ld_low", "_ld_high").distinct().withColumn("_ld_new", F.when(F.col("_ld_low") > before + 1, 1).otherwise(0))
    spans = spans.withColumn("_ld_run", F.sum("_ld_new").over(order)).groupBy(*DOC, "_ld_run").agg(F.min("_ld_low").alias("_ld_low"), F.max("_ld_high").alias("_ld_high"))
    return spans.groupBy(*DOC).agg(F.array_sort(F.collect_list(F.struct("_ld_low", "_ld_high"))).alias("_ld_gone"))


def _kept(lines: Column, gone: Column) -> Column:
    """The lines between the disjoint spans of ``gone``, which are in order: one slice for each gap."""
    first = lambda k: F.when(k == 0, F.lit(0)).otherwise(F.get(gone, k - 1)["_ld_high"] + 1)
    end = lambda k: F.coalesce(F.get(gone, k)["_ld_low"], F.size(lines))
    return F.flatten(F.transform(F.sequence(F.lit(0), F.size(gone)), lambda k: F.slice(lines, first(k) + 1, F.greatest(end(k) - first(k), F.lit(0)))))


def cut_lines(docs: DataFrame, min_words: int = MIN_WORDS, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the later repeated runs taken out of the text, and _ld_lines and _ld_removed added."""
    gone = repeated_lines(docs, min_words, id_col=id_col, text_col=text_col)
    a, b = docs.withColumn("_ld_key", F.xxhash64(text_col)).alias("a"), gone.alias("b")
    both = a.join(b, F.col(f"a.`{id_col}`").cast("long").eqNullSafe(F.col("b._ld_doc")) & (F.col("a._ld_key") == F.col("b._ld_text")), "left")
    lines = F.split(F.col(f"a.`{text_col}`"), "\n")
    # The array of lines is bound to a name, so that it is made once and not for every gap.
    kept = F.get(F.transform(F.array(lines), lambda x: F.array_join(_kept(x, F.col("b._ld_gone")), "\n")), F.lit(0))
    removed = F.aggregate("b._ld_gone", F.lit(0), lambda n, s: n + (s["_ld_high"] - s["_ld_low"] + 1).cast("int"))
    text = F.when(F.col("b._ld_gone").isNull(), F.col(f"a.`{text_col}`")).otherwise(kept)
    cols = [(text if c == text_col else F.col(f"a.`{c}`")).alias(c) for c in docs.columns]
    return both.select(*cols, F.coalesce(F.size(lines), F.lit(0)).alias("_ld_lines"), F.coalesce(removed, F.lit(0)).alias("_ld_removed"))


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the later repeated runs taken out of the text, and ``n_lines`` and ``n_removed`` added."""
    out = cut_lines(docs, min_words, id_col=id_col, text_col=text_col)
    return out.drop("n_lines", "n_removed").withColumnsRenamed({"_ld_lines": "n_lines", "_ld_removed": "n_removed"})


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "n_removed")
