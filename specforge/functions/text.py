"""Scalar functions over text, as column expressions."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from specforge import lexicon

ACCENTED, PLAIN = "éèêëàâäùûüîïôöçñ", "eeeeaaauuuiioocn"


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value) with value computed once: a lambda's variable instead of as many copies of an expression as f has uses."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def strip(c: Column) -> Column:
    """Without white space at the ends."""
    return F.btrim(c, F.lit(" \t\n\x0b\f\r"))


def normalize(c: Column) -> Column:
    """Lower case without accents, white space collapsed (a single blank is left as it is); null becomes empty."""
    return F.regexp_replace(F.translate(strip(F.lower(F.coalesce(c, F.lit("")))), ACCENTED, PLAIN), r"\s\s+|[\t\n\x0B\f\r]", " ")


def any_of(c: Column, patterns: Iterable[str]) -> Column:
    """Whether any pattern is found: one alternation, so one pass."""
    return c.rlike("|".join(f"(?:{p})" for p in patterns))


def tokenize(c: Column) -> Column:
    """Distinct lower-case tokens of letters and digits, in order of appearance."""
    low = F.lower(F.translate(c, "'’", "  "))
    return F.array_distinct(F.regexp_extract_all(low, F.lit("([a-zàâäéèêëïîôöùûüçñ0-9]+)"), F.lit(1)))


def french_map() -> Column:
    pairs = [x for k, v in lexicon.FRENCH_ENGLISH.items() for x in (F.lit(k), F.array(*[F.lit(w) for w in v.split()]))]
    return F.create_map(*pairs)


def content_tokens(c: Column) -> Column:
    """Tokens without stop words, and the English words of French ones (which may bring stop words back)."""
    raw = F.array_except(tokenize(c), F.array(*[F.lit(w) for w in sorted(lexicon.STOP_WORDS)]))
    keys = F.array(*[F.lit(k) for k in lexicon.FRENCH_ENGLISH])
    table = french_map()
    more = F.flatten(F.transform(F.array_intersect(raw, keys), lambda t: F.element_at(table, t)))
    return F.array_distinct(F.concat(raw, more))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + F.coalesce(v, F.lit(0.0)))


def cosine(a: Column, b: Column) -> Column:
    """Cosine over the shared length; 0 for zero or empty vectors."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(F.lit(0.0))


def estimated_tokens(c: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.char_length(c) / 2)).cast("int")


def is_template_instruction(c: Column) -> Column:
    short = c.rlike(r"(?i)\b(?:TBD|XXX|TODO)\b") & (F.char_length(strip(c)) < 50)
    return c.rlike("<<[^>]*>>") | short


def is_toc_line(c: Column) -> Column:
    return c.rlike(r"\.{3,}\s*\d+\s*$") | c.rlike(r"^\s*\d+\s*$")


def upper_ratio(c: Column) -> Column:
    letters = F.char_length(F.regexp_replace(c, r"[^\p{L}]", ""))
    upper = F.char_length(F.regexp_replace(c, r"[^\p{Lu}]", ""))
    return F.when(letters > 0, upper / letters).otherwise(F.lit(0.0))


def safe_name(c: Column) -> Column:
    return F.regexp_replace(c, r"[^A-Za-z0-9._\- ]", "_")


def document_key(c: Column) -> Column:
    return F.regexp_replace(c, r"[^A-Za-z0-9_\-=]", "_")


def source_type(c: Column) -> Column:
    return F.when(F.lower(c).rlike("template|guide|writing"), "reference").otherwise("uploaded")


def search_score(raw: Column) -> Column:
    """A remote search's score, a tenth of it and 1 at most."""
    return F.least(raw / 10.0, F.lit(1.0))


def sheet_name(c: Column) -> Column:
    """A name that a sheet may have: without its forbidden signs, 31 characters at most."""
    plain = F.regexp_replace(c, r"[\[\]:*?/\\]", "")
    return F.when(plain == "", "Sheet").otherwise(F.substring(plain, 1, 31))


def compact_section(c: Column) -> Column:
    """'A > B > C' as '[A] > C'."""
    parts = F.split(c, r"\s*>\s*")
    return F.when(F.size(parts) > 1, F.concat(F.lit("["), F.element_at(parts, 1), F.lit("] > "), F.element_at(parts, -1))).otherwise(c)


def heading_name(c: Column) -> Column:
    """A heading without its trailing colon or what stands behind a dash."""
    return strip(F.regexp_replace(F.element_at(F.split(strip(c), r"\s+[-–—]\s+"), 1), r":+$", ""))


def excerpt(text: Column, pattern: str, around: int = 100) -> Column:
    """First match with its surroundings on one line, or ''."""
    found = F.regexp_extract(text, f"(?i)({pattern})", 1)
    at = F.call_function("instr", text, found)
    begin = F.greatest(at - 1 - around, F.lit(0))
    end = F.least(at - 1 + F.char_length(found) + around, F.char_length(text))
    body = strip(F.regexp_replace(F.substring(text, (begin + 1).cast("int"), (end - begin).cast("int")), "\n", " "))
    dots = lambda c: F.when(c, "...").otherwise("")
    return F.when(found == "", "").otherwise(F.concat(dots(begin > 0), body, dots(end < F.char_length(text))))


def text_line(text: Column, needle: Column) -> Column:
    """1-based line of the needle (or of its first 40 characters); null for needles under 10 characters or not found."""
    whole = F.call_function("instr", text, needle)
    part = F.call_function("instr", text, F.substring(needle, 1, 40))
    at = F.when(whole > 0, whole).otherwise(part)
    line = F.regexp_count(F.substring(text, F.lit(1), (at - 1).cast("int")), F.lit("\n")) + 1
    return F.when((F.char_length(needle) >= 10) & (at > 0), line)


def confidence_from_scores(scores: Column) -> Column:
    top = F.coalesce(F.array_max(scores), F.lit(0.0))
    support = F.size(F.filter(scores, lambda s: s >= 0.2))
    return (
        F.when(F.size(scores) <= 0, "LOW").when((top >= 0.5) & (support >= 2), "HIGH").when((top >= 0.25) | (support >= 1), "MEDIUM").otherwise("LOW")
    )


def answer_confidence(answer: Column) -> tuple[Column, Column]:
    """(level, answer without the confidence line)."""
    level = F.upper(F.regexp_extract(answer, r"(?i)Confidence:\s*(HIGH|MEDIUM|LOW)\b", 1))
    clean = F.regexp_replace(F.regexp_replace(answer, r"(?i)Confidence:\s*(?:HIGH|MEDIUM|LOW)\b", ""), r"\s*[-—:]*\s*$", "")
    return level, F.when(level == "", answer).otherwise(clean)
