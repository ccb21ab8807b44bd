"""Column -> Column text rules, all inside the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.functions import values as V

U = "(?U)"
WORD = U + r"[^\s\x1c-\x1f]+"


def re_sub(c: Column, pattern: str, to: str) -> Column:
    return F.regexp_replace(c, F.lit(pattern), F.lit(to))


def strip(c: Column) -> Column:
    return re_sub(c, U + r"^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def words(c: Column) -> Column:
    """Number of white-space separated words."""
    return F.coalesce(F.regexp_count(c, F.lit(WORD)), F.lit(0)).cast("long")


def repair_unicode(c: Column) -> Column:
    """Rule 1."""
    for a, b in V.LIGATURES.items():
        c = F.replace(c, F.lit(a), F.lit(b))
    c = F.translate(c, V.SPACES + V.SINGLE_QUOTES + V.DOUBLE_QUOTES + "…" + V.INVISIBLE, " " * len(V.SPACES) + "'" * len(V.SINGLE_QUOTES) + '"' * len(V.DOUBLE_QUOTES) + ".")
    c = re_sub(c, V.EMOJI, "")
    c = re_sub(c, U + rf"^[\s{V.BULLETS}]+", "")
    return strip(re_sub(c, r"[ \t]+", " "))


def join_wraps(c: Column) -> Column:
    """Rule 5."""
    return strip(re_sub(c, U + r"\s*\n\s*", " "))


def is_boilerplate(c: Column) -> Column:
    """Rule 6: the cheap length test comes first."""
    return (words(c) <= 25) & F.lower(c).rlike("|".join(re.escape(p) for p in V.BOILERPLATE))


def strip_citations(c: Column, author_year: bool = False) -> Column:
    """Rule 9."""
    c = re_sub(re_sub(c, V.BRACKET_CITATION, ""), V.SUPERSCRIPTS, "")
    if author_year:
        c = re_sub(c, U + V.AUTHOR_YEAR, "")
    return strip(re_sub(c, U + r"\s+([.,;:])", "$1"))


def tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit("([a-z0-9]+)"), 1)


def ensure_terminal(c: Column) -> Column:
    """Rule 13."""
    t = strip(c)
    return F.when(t == "", t).when(F.substring(t, -1, 1).isin(*".!?:;"), t).otherwise(F.concat(t, F.lit(".")))


def expansions(c: Column) -> Column:
    """Most texts hold nothing to expand: one search tells."""
    out = c
    for pattern, to in V.EXPANSIONS:
        out = re_sub(out, U + pattern, to)
    return F.when(c.rlike(U + V.MAY_EXPAND), out).otherwise(c)


def squeeze(c: Column) -> Column:
    """Blanks and tabs in a row become one blank."""
    return F.when(c.rlike(r"\t|  "), re_sub(c, r"[ \t]+", " ")).otherwise(c)


#: An edge of a word of ASCII characters (``\b`` differs between versions of Java).
ASCII_EDGE = r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"


def links(c: Column, ascii: bool = False) -> Column:
    """Addresses of mail go, others become a word.  With ``ascii`` only ASCII letters belong to an address that isn't marked as one."""
    mail, url = (p.replace(r"\b", ASCII_EDGE) if ascii else U + p for p in (V.EMAIL, V.URL))
    c = F.when(c.contains("@"), re_sub(c, mail, "")).otherwise(c)
    return F.when(c.rlike(V.MAY_LINK), re_sub(c, url, "link")).otherwise(c)


def ends_sentence(token: Column) -> Column:
    never = sorted({a.lower() for a in V.NEVER_END})
    stop = token.endswith(".") & ~F.lower(token).isin(never) & ~token.rlike(U + r"\b[A-Z]\.$")
    return token.endswith("!") | token.endswith("?") | stop


def letters(c: Column) -> Column:
    return F.concat(F.array_join(F.filter(F.split(c, ""), lambda x: strip(x) != ""), ". "), F.lit("."))


def ordinal_word(n: Column) -> Column:
    return F.when(n.between(1, 20), F.get(F.array(*map(F.lit, V.ORDINALS)), n - 1)).otherwise(n.cast("string"))


def plausible_author(c: Column) -> Column:
    clean = strip(re_sub(c, U + r"[\s\x1c-\x1f]+", " "))
    return F.coalesce((clean != "") & (words(clean) <= 6) & ~clean.rlike(U + V.JUNK_AUTHOR), F.lit(False))


def format_duration(seconds: Column) -> Column:
    s = F.bround(seconds, 0).cast("long")
    h, m, r = F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60
    return F.when(h > 0, F.format_string("%d:%02d:%02d", h, m, r)).otherwise(F.format_string("%d:%02d", m, r))


def spelled(c: Column) -> Column:
    """Rule 12: array of (node, text, ms) with allowlisted tokens as Spell nodes."""
    names = "|".join(sorted(V.SPELL_OUT, key=lambda t: (-len(t), t)))
    pattern = U + rf"\b(?:{names})(?:'s|s)?\b"
    parts, found = F.split(c, pattern, -1), F.regexp_extract_all(c, F.lit(pattern), F.lit(0))

    def say(t):
        return node("Say", strip(t))

    def one(part, i):
        hit = F.get(found, i)
        token = F.regexp_extract(hit, rf"^({names})(?=$|s$|'s$)", 1)
        tail = F.replace(F.substring(hit, F.length(token) + 1, F.length(hit)), F.lit("'"), F.lit(""))
        return F.array(say(part), F.when(hit.isNotNull(), node("Spell", token)), F.when(tail != "", node("Say", tail)))

    return F.filter(F.flatten(F.transform(parts, one)), lambda x: x.isNotNull() & (x["text"] != ""))


def node(kind: str, text: Column) -> Column:
    return F.struct(F.lit(kind).alias("node"), text.alias("text"), F.lit(None).cast("int").alias("ms"))


def pause(ms: Column | int) -> Column:
    ms = ms if isinstance(ms, Column) else F.lit(ms)
    return F.struct(F.lit("Pause").alias("node"), F.lit(None).cast("string").alias("text"), ms.cast("int").alias("ms"))
