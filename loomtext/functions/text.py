"""Text cleaning, tokens and vocabulary tags as column expressions.

White space and word characters are spelled out, because Java's and RE2's shorthand classes cover less
than Unicode; the same classes are used in the SQL that checks the queries.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

GAP = r"\s\x0b\x1c-\x1f\x{85}\p{Z}"
LETTER = r"\p{L}\p{N}_"
LINK = f"(?:http|www)[^{GAP}]+"
MAIL = f"[{LETTER}.%+-]+@[{LETTER}.-]+"
#: The same matches in Java's dialect, tried only where a run of address characters (or what is left of one) begins.
_MAIL = f"(?:\\G|(?<![{LETTER}.%+-]))[{LETTER}.%+-]++@[{LETTER}.-]++"
TOKEN = f"[^{GAP}]+"

# The default vocabularies.
SKILLS: tuple[str, ...] = (
    "javascript", "node.js", "aws", "kubernetes", "go lang", "ruby", "python", "sql",
    "java", "docker", "html", "management", "engineering", "marketing", "design", "sales",
    "software", "development", "communication", "leadership", "installation", "technical", "automation", "power systems",
)
DOMAINS: tuple[str, ...] = (
    "healthcare", "finance", "tech", "education", "manufacturing", "retail", "sales", "construction",
    "hospitality", "engineering", "legal", "marketing", "government",
)
#: Skills that imply a domain.
IMPLIED: Mapping[str, tuple[str, ...]] = {
    "tech": ("aws", "kubernetes", "docker"),
    "business": ("management", "leadership"),
}
CATEGORIES: Mapping[str, tuple[str, ...]] = {
    "data_science": ("data scientist", "machine learning", "nlp"),
    "software_engineer": ("software engineer", "backend", "full stack", "devops"),
    "marketing": ("seo", "content marketing", "digital ads"),
    "sales": ("sales representative", "account executive"),
}


def clean(text: Column) -> Column:
    """Lower case, links and mail addresses dropped, everything but a-z squeezed to single spaces; null is empty."""
    low = F.lower(F.coalesce(text, F.lit("")))
    for pattern, marks in ((LINK, ("http", "www")), (_MAIL, ("@",))):
        low = _without(low, pattern, marks)
    return F.trim(F.regexp_replace(low, "[^a-z]++", " "))


def _without(text: Column, pattern: str, marks: Sequence[str]) -> Column:
    """``text`` without the matches of ``pattern``, which is tried only where one of the ``marks``, that every match holds, occurs.

    The text is bound to a lambda's variable, so that it is worked out once.
    """
    return F.transform(F.array(text), lambda x: F.when(_any([F.contains(x, F.lit(m)) for m in marks]), F.regexp_replace(x, pattern, "")).otherwise(x))[0]


def words(text: Column) -> Column:
    """The runs between Unicode white space; null and empty give an empty array."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0))


def long_words(text: Column) -> Column:
    """The words of two and more characters."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"[^{GAP}]{{2,}}+"), F.lit(0))


def joined(parts: Column) -> Column:
    """An array as one string with single spaces."""
    return F.array_join(parts, " ")


def matches(tokens: Column, vocabulary: Sequence[str]) -> Column:
    """The vocabulary entries that are tokens, in the vocabulary's order; null tokens give an empty array."""
    listed = F.array(*[F.lit(v) for v in vocabulary]) if vocabulary else F.array().cast("array<string>")
    known = F.coalesce(tokens, F.array().cast("array<string>"))
    return F.array_intersect(listed, known)  # unlike a lambda, this works the tokens out once a row


def skills(text: Column, vocabulary: Sequence[str] = SKILLS, phrases: bool = False) -> Column:
    """Skills named in a cleaned text: whole tokens, or with ``phrases`` also runs of tokens."""
    if not phrases:
        return matches(words(text), vocabulary)
    padded = F.concat(F.lit(" "), joined(words(text)), F.lit(" "))
    return F.filter(F.array(*[F.lit(v) for v in vocabulary]), lambda v: F.contains(padded, F.concat(F.lit(" "), v, F.lit(" "))))


def domains(text: Column, found: Column | None = None, vocabulary: Sequence[str] = DOMAINS, implied: Mapping[str, Sequence[str]] = IMPLIED) -> Column:
    """Domains named in a cleaned text or implied by its skills, distinct and sorted."""
    none = F.array().cast("array<string>")
    own = [matches(words(text), vocabulary)]
    if found is not None:
        own += [F.when(F.arrays_overlap(F.coalesce(found, none), F.array(*[F.lit(k) for k in by])), F.array(F.lit(d))).otherwise(none) for d, by in implied.items()]
    return F.sort_array(F.array_distinct(F.concat(*own)))


def categories(title: Column, description: Column, keywords: Mapping[str, Sequence[str]] = CATEGORIES, other: str = "other") -> Column:
    """Categories with a keyword anywhere in title or description, in the table's order; ``[other]`` if there is none."""
    text = F.lower(F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(description, F.lit(""))))
    hits = F.array_compact(F.array(*[F.when(_any([F.contains(text, F.lit(k)) for k in ks]), F.lit(c)) for c, ks in keywords.items()]))
    return F.when(F.size(hits) > 0, hits).otherwise(F.array(F.lit(other)))


def _any(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out | c
    return out


def missing(value: Column, kind: str) -> Column:
    """Null, or NaN where the column is of a floating type."""
    return value.isNull() | F.isnan(value) if kind in ("float", "double") else value.isNull()


def report(text: Column) -> Column:
    """Placeholder report of a résumé: a constant, as long as no report model is plugged in."""
    return F.when(text.isNull() | text.isNotNull(), F.lit("report not available"))
