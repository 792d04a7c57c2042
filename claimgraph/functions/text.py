"""Scalar column functions: names, predicates, renderings, descriptions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that refer to something without naming it, and openings of such phrases.
PRONOUNS = [
    "he", "she", "it", "they", "them", "him", "her", "his", "hers", "its",
    "their", "theirs", "this", "that", "these", "those", "who", "which",
]
GENERIC_OPENINGS = ["the", "a", "an", "this", "that", "these", "those", "his", "her", "their", "its"]
DESCRIPTION_CAP = 600
#: Characters with a meaning in a query language; searched as blanks.
QUERY_CHARACTERS = '+-&|!(){}[]^"~*?:\\/'

#: What a strip takes off: every white-space character.
WHITE = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())


def strip(text: Column) -> Column:
    return F.trim(text, F.lit(WHITE))


def name_key(name: Column) -> Column:
    """The key of exact lookups: lower case, not trimmed."""
    return F.lower(name)


def batch_key(name: Column) -> Column:
    """The key of a batch's own duplicates: trimmed, lower case."""
    return F.lower(strip(name))


def is_unnamed(name: Column) -> Column:
    """A pronoun, or an all-lower-case phrase that a determiner opens."""
    n = strip(name)
    return F.lower(n).isin(PRONOUNS) | ((F.lower(n) == n) & n.rlike("^(" + "|".join(GENERIC_OPENINGS) + ") "))


def evaluated_name(name: Column) -> Column:
    """Entity names as evaluation compares them; everything outside a-z, 0-9 becomes a gap."""
    #: The patterns of these two functions, which decide what counts as the same.
    n = F.regexp_replace(F.lower(name), r"\([^)]*\)", " ")
    n = F.regexp_replace(F.regexp_replace(n, "[^a-z0-9 ]+", " "), r"\s+", " ")
    return F.regexp_replace(F.trim(n), "^the ", "")


def evaluated_predicate(predicate: Column) -> Column:
    p = F.regexp_replace(F.replace(predicate, F.lit("/"), F.lit(" ")), "(?<=[a-z])(?=[A-Z])", " ")
    return F.trim(F.lower(F.regexp_replace(p, r"[_\s]+", " ")))


def quotes_of(quotes: Column, quote: Column) -> Column:
    """The list of quotes, or a list of the single one, or none if that is blank."""
    single = F.when(F.coalesce(quote, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.array(quote))
    return F.coalesce(quotes, single)


def render_fact(subject: Column, predicate: Column, object_: Column, valid_from: Column, valid_to: Column) -> Column:
    """``(s) —p→ (o)``, with the window if it has any bound."""
    window = F.concat(F.lit(" [from "), F.coalesce(valid_from, F.lit("…")), F.lit(" to "), F.coalesce(valid_to, F.lit("now")), F.lit("]"))
    bounded = valid_from.isNotNull() | valid_to.isNotNull()
    return F.concat(F.lit("("), subject, F.lit(") —"), predicate, F.lit("→ ("), object_, F.lit(")"), F.when(bounded, window).otherwise(""))


def fact_text(subject: Column, predicate: Column, object_: Column, valid_from: Column, valid_to: Column, quotes: Column) -> Column:
    """The text that a fact is indexed by: what it says, its window, up to three quotes."""
    bounded = valid_from.isNotNull() | valid_to.isNotNull()
    window = F.when(bounded, F.concat(F.lit(" · "), F.coalesce(valid_from, F.lit("")), F.lit("→"), F.coalesce(valid_to, F.lit("")))).otherwise("")
    said = F.array_join(F.slice(F.coalesce(quotes, F.array().cast("array<string>")), 1, 3), " ")
    return strip(F.concat(subject, F.lit(" "), predicate, F.lit(" "), object_, window, F.lit(" "), said))


def entity_text(name: Column, description: Column) -> Column:
    return F.when(F.coalesce(description, F.lit("")) != "", F.concat(name, F.lit(" — "), description)).otherwise(name)


def merged_description(old: Column, new: Column) -> Column:
    """Null if the new text adds nothing; the new one if it covers the old; else both, the old first. At most 600 characters."""
    o, n = strip(F.coalesce(old, F.lit(""))), strip(F.coalesce(new, F.lit("")))
    joined = F.concat(F.rtrim(o, F.lit(".")), F.lit(". "), n)
    return F.when((n == "") | F.contains(F.lower(o), F.lower(n)), None).otherwise(
        F.substring(F.when(F.contains(F.lower(n), F.lower(o)), n).otherwise(joined), 1, DESCRIPTION_CAP)
    )


def searchable(query: Column) -> Column:
    return strip(F.translate(query, QUERY_CHARACTERS, " " * len(QUERY_CHARACTERS)))


def tokens(text: Column) -> Column:
    """Lower-case runs of a-z and 0-9."""
    return F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), 1)


def cosine(a: Column, b: Column) -> Column:
    """0 where either is null or zero."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.coalesce(F.when(norm > 0, dot(a, b) / norm), F.lit(0.0))


def minted(kind: str, patch_id: Column, key: Column) -> Column:
    """A stable id of what an op of a patch makes."""
    return F.concat(F.lit(f"{kind}_"), F.substring(F.sha1(F.concat_ws(":", patch_id, key).cast("binary")), 1, 16))
