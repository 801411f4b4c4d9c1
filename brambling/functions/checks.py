"""Predicates and small values: paths, globs, permissions, limits, budgets, dates, escaping."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Folders, names and endings that no tool may read, and commands that no grant allows.
SENSITIVE_PARTS = [".git", ".ssh", ".gnupg", "credentials", "secrets", "node_modules", ".venv", "venv", "__pycache__", "dist", "dist-electron", "release", "setup"]
SENSITIVE_SUFFIXES = [".pem", ".key", ".p12", ".pfx", ".db", ".sqlite", ".sqlite3"]
DANGEROUS = [
    r"\brm\s+-[a-z]*[rf]",
    r"\b(rmdir|rd)\s+/\s*s",
    r"\b(del|erase)\s+/[a-z]*[qs]",
    r"\bgit\s+(push|commit|reset|checkout|merge|rebase|clean|tag\s+-d|branch\s+-[dD])\b",
    r"\b(shutdown|reboot|format)\b",
    r"\breg\s+(delete|add)\b",
    r"\bnet\s+user\b",
    r"\b(sudo\s+)?(chmod|chown)\s+-?[a-z]*\s*[47]?[0-7]{3}",
    r"\bmv\s+[^\s<>]+\s+/etc/passwd",
]
# The most rows that a caller may ask of each list.
LIMITS = {"events": 500, "messages": 100, "memories": 50, "search": 10, "digest": 5, "lines": 2000}
ESCAPES = [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")]


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def is_within(path: Column, root: Column) -> Column:
    """Whether a path is the root or lies below it; ``/data2`` does not lie in ``/data``."""
    bare = F.regexp_replace(root, "(?<=.)/+$", "")
    return (path == bare) | path.startswith(F.when(bare == "/", bare).otherwise(F.concat(bare, F.lit("/"))))


def is_sensitive(path: Column) -> Column:
    parts = F.split(F.lower(path), "/")
    name = F.element_at(parts, -1)
    return F.arrays_overlap(parts, F.array(*[F.lit(p) for p in SENSITIVE_PARTS])) | (name == ".env") | name.startswith(".env.") | any_of([name.endswith(s) for s in SENSITIVE_SUFFIXES])


def is_hidden(path: Column, skipped: tuple[str, ...] = ("node_modules", "dist", "build", "__pycache__")) -> Column:
    """Whether a part of the path begins with a dot or is a folder that views leave out."""
    return F.exists(F.split(path, "/"), lambda p: p.startswith(".") & (F.length(p) > 1) | p.isin(*skipped))


def glob_pattern(glob: str) -> str:
    """The regular expression of a file-name glob: ``*``, ``?`` and ``[...]``, matched against whole names."""
    out, k = "", 0
    while k < len(glob):
        c, k = glob[k], k + 1
        end = glob.find("]", k + 1) if c == "[" else -1
        if end > 0:
            inner, k = re.sub(r"([\\\[\]&^])", r"\\\1", glob[k:end]), end + 1
            out += f"[^{inner[1:]}]" if inner[0] == "!" else f"[{inner}]"
        else:
            out += {"*": ".*", "?": "."}.get(c, re.escape(c))
    return f"^(?s:{out})$"


def matches_glob(name: Column, glob: str) -> Column:
    return name.rlike(glob_pattern(glob))


def optional(column: Column, value: object | None) -> Column:
    """A filter that None leaves out."""
    return F.lit(True) if value is None else column == value


def named_like(query: str, *columns: Column) -> Column:
    """Whether the words of a search stand in any of the columns, whatever their case."""
    return F.contains(F.lower(F.concat_ws(" ", *columns)), F.lower(F.lit(query)))


def clamp(limit: int, kind: str) -> int:
    return max(1, min(int(limit), LIMITS[kind]))


def is_dangerous(command: Column) -> Column:
    return any_of([command.rlike(f"(?i){p}") for p in DANGEROUS])


def escape_html(text: Column) -> Column:
    return reduce(lambda t, e: F.replace(t, F.lit(e[0]), F.lit(e[1])), ESCAPES, text)


def inline_markdown(text: Column) -> Column:
    """Escaped text with images, links, code, bold, italic and struck marks as HTML, one rule after the other over the whole text."""
    # Patterns of the marks and what they become, in order. A quote is escaped by then, so images with a title stay.
    rules = [
        (r'!\[([^\]]*)\]\(([^ )]+)(?:\s+"[^"]*")?\)', '<img alt="$1" src="$2">'),
        (r"\[([^\]]+)\]\(([^ )]+)\)", '<a href="$2" target="_blank" rel="noopener">$1</a>'),
        ("`([^`]+)`", "<code>$1</code>"),
        (r"\*\*([^*]+)\*\*", "<strong>$1</strong>"),
        ("__([^_]+)__", "<strong>$1</strong>"),
        (r"(?<!\*)\*([^*]+)\*(?!\*)", "<em>$1</em>"),
        ("(?<!_)_([^_]+)_(?!_)", "<em>$1</em>"),
        ("~~([^~]+)~~", "<del>$1</del>"),
    ]
    return reduce(lambda t, r: F.regexp_replace(t, r[0], r[1]), rules, escape_html(text))


def output_budget(requested: Column, configured: Column, window: Column, used: Column) -> Column:
    """Tokens that an answer may have: what is asked, set and left, never below 0."""
    return F.greatest(F.least(requested, configured, window - used), F.lit(0))


def json_has(json: Column, value: str | Column) -> Column:
    """Whether a JSON array of strings holds a value; false for anything else."""
    return F.coalesce(F.array_contains(F.from_json(json, "array<string>"), value), F.lit(False))


def valid_permissions(given: Column, allowed: list[str]) -> Column:
    """Whether a list has only known permissions, each once, and any at all."""
    known = F.array(*[F.lit(a) for a in allowed])
    return (F.size(given) > 0) & (F.size(F.array_except(given, known)) == 0) & (F.size(F.array_distinct(given)) == F.size(given))


def round_half_up(x: Column) -> Column:
    """To the nearest whole number, halves towards plus infinity."""
    return F.floor(x + 0.5)


def days_before(day: Column, days: Column | int) -> Column:
    return F.date_format(F.date_sub(day, days), "yyyy-MM-dd")


def day_text(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd")


def read_lines(text: Column, offset: int = 1, limit: int = 200) -> Column:
    """Numbered lines from ``offset`` (1-based) on, numbers padded to six, blanks at line ends cut."""
    lines = F.split(F.regexp_replace(text, "\n$", ""), "\n")
    start, many = max(1, offset), clamp(limit, "lines")
    part = F.slice(lines, start, many)
    return F.array_join(F.transform(part, lambda line, k: F.concat(F.lpad((k + start).cast("string"), 6, " "), F.lit("\t"), F.rtrim(F.regexp_replace(line, "\\s+$", "")))), "\n")
