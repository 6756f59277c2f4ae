"""Scalar text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

UNK = "*unk*"
NUM = "*num*"
ROOT = "*root*"
_SPACE = r"[\s\u00a0]"


def strip(c: Column) -> Column:
    """Without leading and trailing white space, no-break spaces included."""
    return F.regexp_replace(c, f"^{_SPACE}+|{_SPACE}+$", "")


def words(line: Column) -> Column:
    """Single-space split of the stripped line: doubled spaces give empty words."""
    return F.split(strip(line), " ", -1)


def is_title(w: Column) -> Column:
    """Upper or title case only at the start or after an uncased character, lower case only after a cased one."""
    return w.rlike(r"[\p{Lu}\p{Lt}]") & ~w.rlike(r"[\p{Lu}\p{Ll}\p{Lt}][\p{Lu}\p{Lt}]") & ~w.rlike(r"(^|[^\p{Lu}\p{Ll}\p{Lt}])\p{Ll}")


def is_upper(w: Column) -> Column:
    return w.rlike(r"\p{Lu}") & ~w.rlike(r"[\p{Ll}\p{Lt}]")


def is_digit(w: Column) -> Column:
    return w.rlike(r"^\p{Nd}+$")


def is_alnum(w: Column) -> Column:
    return w.rlike(r"^[\p{L}\p{N}]+$")


def has_hyphen(w: Column) -> Column:
    return w.contains("-")


def prefixes(w: Column, longest: int = 3) -> Column:
    """Prefixes of 1 to ``longest`` letters that are shorter than the word."""
    return F.transform(F.filter(F.array(*[F.lit(k) for k in range(1, longest + 1)]), lambda k: F.length(w) > k), lambda k: F.substring(w, F.lit(1), k))


def suffixes(w: Column, longest: int = 3) -> Column:
    return F.transform(F.filter(F.array(*[F.lit(k) for k in range(1, longest + 1)]), lambda k: F.length(w) > k), lambda k: F.substring(w, -k, k))


def capital_mark(w: Column) -> Column:
    """``-`` beyond the sentence, ``C`` capitalized, ``N`` not."""
    return F.when(w.isNull(), "-").when(w.rlike(r"^\p{Lu}"), "C").otherwise("N")


def bucketed(rel: Column, listed: list[str], other: str = "OTHER") -> Column:
    return F.when(rel.isin(listed), rel).otherwise(other)


def side_of_head(idx: Column, head: Column) -> Column:
    return F.when(head > idx, "left").otherwise("right")


def number_masked(w: Column) -> Column:
    """Extension: numbers become one token."""
    return F.when(w.rlike(r"^[+-]?\p{Nd}[\p{Nd}.,:/-]*$"), NUM).otherwise(w)


def without_hash(line: Column) -> Column:
    return F.replace(line, F.lit("#"), F.lit("-"))


def tagged_parts(token: Column) -> tuple[Column, Column]:
    """Word and tag of ``word/tag``, split at the last slash; null without one."""
    return F.regexp_extract(token, r"(?s)^(.*)/[^/]*$", 1), F.regexp_extract(token, r"(?s)^.*/([^/]*)$", 1)
