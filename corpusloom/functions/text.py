"""Text primitives: decoding, whitespace, terms, chunks, JSON in free text."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Every character that ends a line for a universal-newline splitter.
_LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\x{2028}\x{2029}]"

# Every character that (?U)\s matches.
_BLANKS = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def decode_text(content: Column) -> Column:
    """Bytes to text: UTF-8 when valid, Latin-1 otherwise."""
    as_text = content.cast("string")
    return F.when(F.is_valid_utf8(as_text), as_text).otherwise(F.decode(content, "ISO-8859-1"))


def strip(text: Column) -> Column:
    """Drop leading and trailing whitespace of any kind; a long text is not searched in between."""
    return F.btrim(text, F.lit(_BLANKS))


def rstrip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)\s+$", "")


def squeeze(text: Column) -> Column:
    """Lower-cased text with each whitespace run replaced by one blank."""
    return strip(F.regexp_replace(F.lower(text), r"(?U)\s+", " "))


def words(text: Column) -> Column:
    """Whitespace-separated tokens; an empty array for blank text."""
    return F.filter(F.split(strip(text), r"(?U)\s+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(words(text))


def line_count(text: Column) -> Column:
    """Number of lines; a trailing line break does not open another line."""
    breaks = F.regexp_count(text, F.lit(_LINE_END))
    unfinished = F.when((text == "") | text.rlike(f"(?s)(?:{_LINE_END})\\z"), 0).otherwise(1)
    return breaks + unfinished


def contains_any(text: Column, needles: Iterable[str]) -> Column:
    """True when any of a fixed list of strings occurs in ``text``.

    A longer list becomes one alternation, which keeps generated code small.
    """
    wanted = list(needles)
    if len(wanted) > 4:
        return text.rlike("|".join(rf"\Q{needle}\E" for needle in wanted))
    hit = F.lit(False)
    for needle in wanted:
        hit = hit | text.contains(needle)
    return hit


def count_present(text: Column, needles: Iterable[str]) -> Column:
    """How many of a fixed list of strings occur in ``text``."""
    total = F.lit(0)
    for needle in needles:
        total = total + text.contains(needle).cast("int")
    return total


def labels_where(*pairs: tuple[Column, Column | str]) -> Column:
    """Array of the labels whose condition holds, in the given order."""
    marks = [F.when(cond, label if isinstance(label, Column) else F.lit(label)) for cond, label in pairs]
    return F.array_compact(F.array(*marks))


def intent_terms(prompt: Column) -> Column:
    """Distinct search terms of a prompt (Q2).

    Word tokens (hyphens kept inside), plus the compact form in which punctuation and
    line breaks are deleted before splitting on blanks; both at least two characters.
    """
    lower = F.lower(prompt)
    tokens = F.regexp_extract_all(lower, F.lit(r"[a-z0-9_]++(?:-[a-z0-9_]++)*+"), F.lit(0))
    compact = F.split(F.regexp_replace(lower, r"[^\p{L}\p{N}_\- ]", ""), " +")
    return F.filter(F.array_union(tokens, compact), lambda t: F.length(t) >= 2)


def query_words(query: Column, limit: int | None = None) -> Column:
    """Lower-cased words of length two or more, duplicates kept, first ``limit`` of them."""
    kept = F.filter(words(F.lower(query)), lambda w: F.length(w) >= 2)
    return kept if limit is None else F.slice(kept, 1, limit)


def text_relevance(haystack: Column, terms: Column) -> Column:
    """Share of ``terms`` that are substrings of ``haystack``; 0 without terms (Q3)."""
    low = F.lower(haystack)
    hits = F.size(F.filter(terms, lambda t: F.contains(low, t)))
    return F.when(F.size(terms) == 0, F.lit(0.0)).otherwise(hits / F.size(terms))


def chunk_text(text: Column, max_chars: int = 260) -> Column:
    """Fixed-width pieces of the stripped text; an empty array for blank text (Q27)."""
    body = strip(text)
    cut = F.regexp_extract_all(body, F.lit(f"(?s).{{1,{max_chars}}}"), F.lit(0))
    return F.when(body == "", F.array().cast("array<string>")).otherwise(cut)


def json_object(text: Column) -> Column:
    """First JSON object readable from free text, as VARIANT, else null (Q26).

    Tries the whole text without code fences, then the span from the first opening to
    the last closing brace.
    """
    body = strip(text)
    fenced = body.startswith("```")
    bare = F.when(
        fenced, strip(F.regexp_replace(F.regexp_replace(body, r"(?i)^```(?:json)?\s*", ""), r"\s*```$", ""))
    ).otherwise(body)
    span = F.regexp_extract(bare, r"(?s)\{.*\}", 0)
    return F.coalesce(_object_or_null(bare), _object_or_null(span))


def _object_or_null(text: Column) -> Column:
    parsed = F.try_parse_json(text)
    return F.when(F.schema_of_variant(parsed).startswith("OBJECT"), parsed)
