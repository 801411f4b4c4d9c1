"""Markdown documents, edits and call logs as rows."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from brambling.functions import checks

# The forms of Markdown lines.
FENCE, HEADING, RULE, QUOTE = "^```", "^(#{1,6})\\s+(.+)$", "^\\s*([-*_])(?:\\s*\\1){2,}\\s*$", "^>\\s?"
ITEM, ROW, DIVIDER = "^\\s*([-+*]|\\d+\\.)\\s+(.+)$", "^\\|.*\\|\\s*$", "^\\|?\\s*:?-{3,}:?\\s*(\\|\\s*:?-{3,}:?\\s*)+\\|?$"


def _lines(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.posexplode(F.split(F.regexp_replace("text", "\r\n?", "\n"), "\n")).alias("line_no", "line"))


def _is(form: str) -> Column:
    return F.regexp_like(F.col("line"), F.lit(form))


def headings(docs: DataFrame) -> DataFrame:
    """doc_id, line_no, level, title of every heading outside code. Only fences and headings are shuffled."""
    rows = _lines(docs).filter(_is(FENCE) | _is(HEADING))
    fences = F.sum(_is(FENCE).cast("int")).over(Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("inside", fences % 2 == 1).filter(~F.col("inside") & _is(HEADING))
    return rows.select("doc_id", "line_no", F.length(F.regexp_extract("line", HEADING, 1)).alias("level"), F.regexp_extract("line", HEADING, 2).alias("title"))


def blocks(docs: DataFrame) -> DataFrame:
    """doc_id, line_no, kind, cells of every line that shows: heading, rule, quote, ol, ul, code, table (header or row), text.

    A table starts at a row whose next line is a divider, and takes the rows that follow without a gap.
    """
    order = Window.partitionBy("doc_id").orderBy("line_no")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    rows = _lines(docs).withColumn("fence", _is(FENCE))
    rows = rows.withColumn("code", ~F.col("fence") & (F.sum(F.col("fence").cast("int")).over(upto) % 2 == 1))
    bar = ~F.col("code") & (_is(ROW) | _is(DIVIDER))
    starts = ~F.col("code") & _is(ROW) & F.coalesce(F.regexp_like(F.lead("line").over(order), F.lit(DIVIDER)), F.lit(False))
    rows = rows.withColumns({"bar": bar, "starts": starts, "run": F.sum((~bar).cast("int")).over(upto)})
    in_run = Window.partitionBy("doc_id", "run").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    first = F.min(F.when(F.col("starts"), F.col("line_no"))).over(in_run)
    rows = rows.withColumn("first", first).filter(~F.col("fence")).filter(F.col("code") | (F.trim("line") != ""))
    table = F.col("bar") & F.col("first").isNotNull()
    rows = rows.filter(~table | (F.col("line_no") != F.col("first") + 1))
    item = F.regexp_extract("line", ITEM, 1)
    kind = (
        F.when(F.col("code"), "code").when(table & (F.col("line_no") == F.col("first")), "table_header").when(table, "table_row")
        .when(_is(HEADING), "heading").when(_is(RULE), "rule").when(_is(QUOTE), "quote").when(item.endswith("."), "ol").when(item != "", "ul").otherwise("text")
    )
    trimmed = F.trim("line")
    cells = (
        F.when(kind.startswith("table"), F.transform(F.split(F.substring(trimmed, F.lit(2), F.length(trimmed) - 2), "\\|"), lambda c: F.trim(c)))
        .when(kind == "heading", F.array(F.regexp_extract("line", HEADING, 2))).when(kind == "quote", F.array(F.regexp_replace("line", QUOTE, "")))
        .when(kind.isin("ol", "ul"), F.array(F.regexp_extract("line", ITEM, 2))).otherwise(F.array("line"))
    )
    return rows.select("doc_id", "line_no", kind.alias("kind"), cells.alias("cells"))


@F.pandas_udf(StringType())
def unified_diff(old: pd.Series, new: pd.Series) -> pd.Series:
    """The differences of two texts with three lines around, 800 characters at most."""
    return pd.Series(["\n".join(difflib.unified_diff((a or "").splitlines(), (b or "").splitlines(), lineterm="", n=3))[:800] for a, b in zip(old, new)])


def activity(events: DataFrame, key: str, name: str, seq: str, length: int = 200) -> DataFrame:
    """The distinct names of every key in order of first use, joined; one row for each name is gathered."""
    firsts = events.groupBy(key, name).agg(F.min(seq).alias("_seq"))
    listed = F.array_sort(F.collect_list(F.struct("_seq", name)))
    return firsts.groupBy(key).agg(F.left(F.array_join(F.transform(listed, lambda x: x[name]), ", "), F.lit(length)).alias("summary"))


def assemble_calls(fragments: DataFrame, keys: list[str], seq: str, stretch: int = 1000) -> DataFrame:
    """Calls from the fragments of a stream: the first ``id``, the last ``name``, and ``arguments`` joined in order.

    Fragments are joined by stretches of the sequence first, so that a key's list holds a string for each stretch only.
    """
    joined = lambda place, text: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(place.alias("p"), text.alias("a")))), lambda x: x["a"]), "")
    named = [F.min(F.when(F.col("id").isNotNull(), F.struct(seq, "id"))).alias("_i"), F.max(F.when(F.col("name").isNotNull(), F.struct(seq, "name"))).alias("_n")]
    parts = fragments.groupBy(*keys, F.floor(F.col(seq) / stretch).alias("_s")).agg(*named, joined(F.col(seq), F.coalesce("arguments", F.lit(""))).alias("_a"))
    whole = parts.groupBy(*keys).agg(F.min("_i").alias("_i"), F.max("_n").alias("_n"), joined(F.col("_s"), F.col("_a")).alias("arguments"))
    return whole.select(*keys, F.col("_i.id").alias("id"), F.col("_n.name").alias("name"), "arguments")


def namespaces(rows: DataFrame, account: str, space: str, owner: str) -> DataFrame:
    """scope and namespace of all that a row's account may use; a row with an ``owner`` has the owner's too."""
    own = lambda head, c: F.concat(F.lit(head), F.col(c).cast("string"))
    base = [F.struct(F.lit(s).alias("scope"), n.alias("namespace")) for s, n in (("personal", own("user/", account)), ("shared", own("shared/", space)), ("project", own("project/", space)))]
    more = [F.struct(F.lit(s).alias("scope"), own(h, owner).alias("namespace")) for s, h in (("owner", "owner/"), ("daily", "daily/"), ("system", "system/"))]
    every = F.when(F.col(owner).isNull(), F.array(*base)).otherwise(F.array(*base, *more))
    return rows.select("*", F.explode(every).alias("_n")).select(*rows.columns, "_n.scope", "_n.namespace")


def children(rows: DataFrame, parent: str, name: str, key: str, most: int = 250) -> DataFrame:
    """The first entries of every parent by name in lower case."""
    order = Window.partitionBy(parent).orderBy(F.lower(name), key)
    return rows.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= most)


def search_content(docs: DataFrame, pattern: str, directory: str = "/", file_types: str = "", case_sensitive: bool = False, most: int = 40, largest: int = 1_000_000) -> DataFrame:
    """path, line_no (from 1), line of the lines of files (path, content) that match a regular expression, in order of path and line.

    Only files below the directory that no rule protects and that have ``largest`` bytes at most; of the endings that are listed, which
    count with their dot and case, if any are. Lines are trimmed and cut to 120 characters; 200 of them at most.
    """
    path = F.col("path")
    files = docs.filter(checks.is_within(path, F.lit(directory)) & ~checks.is_sensitive(path) & (F.octet_length("content") <= largest))
    if endings := [t.strip() for t in file_types.split(",") if t.strip()]:
        files = files.filter(F.regexp_extract(F.element_at(F.split(path, "/"), -1), "(?<=.)(\\.[^.]+)$", 1).isin(*endings))
    lines = files.select("path", F.posexplode(F.split(F.regexp_replace("content", "\r\n?", "\n"), "\n")).alias("line_no", "line"))
    found = lines.filter(F.regexp_like("line", F.lit(pattern if case_sensitive else f"(?i){pattern}")))
    shown = F.left(F.regexp_replace("line", "^\\s+|\\s+$", ""), F.lit(120))
    return found.select("path", (F.col("line_no") + 1).alias("line_no"), shown.alias("line")).orderBy("path", "line_no").limit(max(1, min(most, 200)))
