"""Text clean-up, titles, company names, keys."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import vocab


def let(c: Column, body: Callable[[Column], Column]) -> Column:
    """``body(c)`` with ``c`` computed once, for costly inputs that the body names often.

    A column that is merely repeated would be written out again at every place and
    let the generated code grow with the product of all repetitions.
    """
    return F.get(F.transform(F.array(c), body), F.lit(0))


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


# fixed values: characters that count as white space
WHITE = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007"
         "\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000")


def strip(c: Column) -> Column:
    """Remove white space of any kind at both ends."""
    return F.btrim(c, F.lit(WHITE))


def clean_text(c: Column) -> Column:
    """Collapse white space; nothing left means null."""
    return blank_to_null(F.trim(F.regexp_replace(c, r"(?U)\s+", " ")))


def title_case(c: Column) -> Column:
    """Capitalise every run of letters ("ui/ux" -> "Ui/Ux", "master's" -> "Master'S")."""
    runs = F.regexp_extract_all(c, F.lit(r"(\p{L}+|\P{L}+)"), F.lit(1))
    return F.array_join(
        F.transform(runs, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substr(w, F.lit(2))))), ""
    )


def clean_title(c: Column) -> Column:
    """Drop a trailing reference number and edge punctuation, then title-case."""
    t = strip(c)
    for pattern in (vocab.TITLE_ID, vocab.TITLE_HEAD, vocab.TITLE_TAIL):
        t = F.regexp_replace(t, pattern, "")
    return F.coalesce(blank_to_null(strip(title_case(t))), c)


def clean_company(c: Column) -> Column:
    """Drop one legal suffix at the end of the name."""
    pattern = "|".join(f"({s})$" for s in vocab.LEGAL_SUFFIXES)
    return F.coalesce(blank_to_null(strip(F.regexp_replace(c, f"(?iu){pattern}", ""))), c)


def normalize_source(c: Column) -> Column:
    return title_case(strip(c))


def contains_any(c: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [c.contains(w) for w in words])


def has_word(c: Column, pattern: str) -> Column:
    r"""Case-insensitive search for ``\b(word|word|...)\b``.

    One of the words must occur as plain text first, which spares most rows the
    much slower pattern.
    """
    low = F.lower(c)
    words = pattern.removeprefix(r"\b(").removesuffix(r")\b").split("|")
    return contains_any(low, words) & low.rlike(f"(?U){pattern}")


def word_count(c: Column) -> Column:
    return F.coalesce(F.regexp_count(c, F.lit(r"(?U)\S+")), F.lit(0))


def key_of(*parts: Column) -> Column:
    """First twelve hex digits of the md5 of the joined lower-case parts."""
    joined = F.concat(*[F.lower(F.coalesce(p, F.lit(""))) for p in parts])
    return F.substring(F.md5(joined), 1, 12)


def dedup_key(existing: Column, company: Column, title: Column, city: Column) -> Column:
    return F.coalesce(blank_to_null(existing), key_of(company, title, city))


def identity_of(*parts: Column) -> Column:
    """Full digest of the lower-case parts with a separator between them."""
    return F.sha2(F.concat_ws("\x1f", *[F.lower(F.coalesce(p, F.lit(""))) for p in parts]), 256)


def identity(existing: Column, company: Column, title: Column, city: Column) -> Column:
    """What makes two rows the same posting.

    A row's own key, tagged; else the full digest of the lower-case parts with a
    separator between them.  The twelve digits of ``key_of`` are only a short name: they
    glue parts together, and different postings may share them.
    """
    own = blank_to_null(existing)
    return F.when(own.isNull() | (own == key_of(company, title, city)), identity_of(company, title, city)).otherwise(F.concat(F.lit("key:"), own))


def source_key(prefix: str, company: Column, title: Column, tail: Column) -> Column:
    """Key of one source: prefix + trimmed company + trimmed title + id or location."""
    return key_of(F.lit(prefix), strip(company), strip(title), tail)


def split_skills(c: Column) -> Column:
    """Trimmed, non-empty entries of a comma-joined list."""
    return F.filter(F.transform(F.split(c, ","), strip), lambda s: s != "")


def distinct_skills(c: Column) -> Column:
    return F.array_distinct(split_skills(c))


def extract_skills(c: Column) -> Column:
    """Known skills named as whole words, in list order, joined by ", ".

    Skills that are one plain word are found by intersecting the text's words
    with the list, in one hash pass.  The others (several words, or symbols as in
    "c++") take a substring test and, only on a hit, the word-boundary pattern.
    """
    places = {s.lower(): i for i, s in enumerate(vocab.SKILLS)}
    plain = [s for s in places if s.isalnum()]
    index = F.create_map(*[F.lit(x) for s in plain for x in (s, places[s])])
    names = F.array(*[F.lit(s) for s in vocab.SKILLS])

    def find(low: Column) -> Column:
        words = F.array_intersect(F.split(low, r"(?U)\W+"), F.array(*[F.lit(s) for s in plain]))
        single = F.transform(words, lambda w: F.try_element_at(index, w))
        other = F.array_compact(F.array(*[
            F.when(low.contains(s) & low.rlike(rf"(?U)\b{_escape(s)}\b"), F.lit(i))
            for s, i in places.items() if not s.isalnum()]))
        return F.array_join(F.transform(F.sort_array(F.concat(single, other)), lambda i: F.get(names, i)), ", ")

    return blank_to_null(let(F.lower(c), find))


def _escape(word: str) -> str:
    return "".join("\\" + ch if ch in ".+*?()[]{}|^$\\" else ch for ch in word)
