"""Scalar expressions: hashing, identifiers, token estimates, similarity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def estimate_tokens(text: Column) -> Column:
    """A token for four ASCII characters and one for two others, each rounded up; null counts as empty."""
    t = F.coalesce(text, F.lit(""))
    other = F.length(F.regexp_replace(t, "[\\x00-\\x7F]+", ""))
    return (F.ceil((F.length(t) - other) / 4) + F.ceil(other / 2)).cast("long")


def clean_doi(doi: Column) -> Column:
    bare = F.regexp_replace(F.lower(F.coalesce(doi, F.lit(""))), "^https://doi\\.org/", "")
    return F.trim(F.regexp_replace(bare, "^doi:", ""))


def last_segment(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def canonical_id(doi: Column, arxiv: Column, source_id: Column, title: Column) -> Column:
    """The work's key: its DOI, else its arXiv number, else a digest of what names it."""
    filled = lambda c: F.coalesce(c, F.lit("")) != ""
    named = F.when(filled(source_id), source_id).otherwise(F.coalesce(title, F.lit("")))
    return F.when(filled(doi), F.concat(F.lit("doi:"), doi)).when(filled(arxiv), F.concat(F.lit("arxiv:"), arxiv)).otherwise(F.concat(F.lit("meta:"), F.sha2(named, 256)))


def similarity(d2: Column) -> Column:
    """From a squared distance of unit vectors; everything at 1 or beyond is 0."""
    return F.round(1 - F.least(d2, F.lit(1.0)), 4)


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def djb2(text: Column) -> Column:
    """h * 33 + code, from 5381, in 32 bits, over the UTF-16 units of a text (two for a character beyond the first plane)."""
    points = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))
    high = lambda p: F.shiftright(p - 0x10000, 10) + 0xD800
    codes = F.flatten(F.transform(points, lambda p: F.when(p < 0x10000, F.array(p)).otherwise(F.array(high(p), (p - 0x10000).bitwiseAND(F.lit(0x3FF)) + 0xDC00))))
    return F.aggregate(codes, F.lit(5381).cast("long"), lambda h, c: F.pmod(h * 33 + c, F.lit(1 << 32)))


def lcg(state: Column) -> Column:
    """The next state of the linear congruential generator with period 233280."""
    return F.pmod(state * 9301 + 49297, F.lit(233280))


def nth_draw(seed: Column, n: Column) -> Column:
    """The n-th draw (from 1) of the generator from a seed, without those before it.

    n steps of an affine map are one affine map again. Those of 1, 2, 4, ... steps are constants, and the
    binary digits of n choose among them; the generator starts over after as many steps as it has states.
    """
    period = 233280
    steps, state = F.pmod(n.cast("long"), F.lit(period)), F.pmod(seed, F.lit(period))
    factor, term = 9301, 49297
    for k in range(period.bit_length()):
        on = F.shiftright(steps, k).bitwiseAND(F.lit(1)) == 1
        state = F.pmod(state * F.when(on, factor).otherwise(1) + F.when(on, term).otherwise(0), F.lit(period))
        factor, term = factor * factor % period, (factor * term + term) % period
    return state / period



def sanitize_id(text: Column) -> Column:
    kept = F.regexp_replace(F.lower(text), "[^a-z0-9\\u4e00-\\u9fff]", "-")
    return F.left(F.regexp_replace(kept, "^-+|-+$", ""), F.lit(50))


def search_terms(text: Column, default: str = "待生成具体检索词") -> Column:
    """The first six words of three letters or more, without question marks; the default where there is none."""
    plain = F.trim(F.regexp_replace(text, "[?？]", ""))
    words = F.slice(F.filter(F.split(plain, "\\s+"), lambda w: F.length(w) >= 3), 1, 6)
    return F.when(F.size(words) > 0, words).otherwise(F.array(F.lit(default)))


def estimate_json_tokens(value: Column) -> Column:
    """Tokens of a value that isn't text, as compact JSON; null counts as empty."""
    return estimate_tokens(F.to_json(F.struct(value.alias("v"))).substr(F.lit(6), F.length(F.to_json(F.struct(value.alias("v")))) - 6))


def request_tokens(role: Column, content: Column, calls: Column) -> Column:
    """Tokens of one message of a request: four, and those of its role, its text and the JSON of its calls."""
    return F.lit(4) + estimate_tokens(role) + estimate_tokens(content) + estimate_tokens(calls)
