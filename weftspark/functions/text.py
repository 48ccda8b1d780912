"""Column functions over text: normal forms, guesses, splits and formats. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANK = " \t\n\r\x0b\x0c"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip(x: Column | str) -> Column:
    """Without white space at both ends (SQL trim only removes blanks)."""
    return F.regexp_replace(_c(x), r"^\s+|\s+$", "")


def collapse(x: Column | str) -> Column:
    """White space runs to one blank, none at the ends."""
    return strip(F.regexp_replace(_c(x), r"\s+", " "))


def clean_text(x: Column | str) -> Column:
    """CRLF and CR to LF, no blanks before line ends, at most one empty line, no blanks at the ends."""
    x = F.regexp_replace(_c(x), r"\r\n?", "\n")
    x = F.regexp_replace(x, r"[ \t]+\n", "\n")
    x = F.regexp_replace(x, r"\n{3,}", "\n\n")
    return F.regexp_replace(x, r"^[ \t]+|[ \t]+$", "")


def language_guess(x: Column | str) -> Column:
    """'ru' where Cyrillic letters outnumber other letters below U+0400, else 'en'; null gives null."""
    x = _c(x)
    cyrillic = F.length(x) - F.length(F.regexp_replace(x, r"[\u0400-\u04FF]", ""))
    other = F.length(x) - F.length(F.regexp_replace(x, r"[A-Za-z\u00AA\u00B5\u00BA\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u02AF]", ""))
    return F.when(x.isNull(), None).when(cyrillic > other, "ru").otherwise("en")


def any_cyrillic(x: Column | str) -> Column:
    return _c(x).rlike(r"[А-Яа-яЁё]")


def slug(x: Column | str) -> Column:
    """Runs of anything but letters, digits and _ become '-', none at the ends, lower case; empty gives 'document'."""
    s = F.regexp_replace(F.lower(F.regexp_replace(_c(x), r"[^\p{L}\p{N}_]+", "-")), r"^[-_]+|[-_]+$", "")
    return F.when(F.coalesce(s, F.lit("")) == "", "document").otherwise(s)


def token_estimate(x: Column | str) -> Column:
    """Four characters to a token, rounded up."""
    return F.ceil(F.length(_c(x)) / 4).cast("bigint")


def first_paragraph(x: Column | str) -> Column:
    """First paragraph that isn't blank, stripped; null if there is none."""
    return strip(F.get(F.filter(F.split(_c(x), r"\n\s*\n"), lambda p: strip(p) != ""), F.lit(0)))


def paragraphs(x: Column | str, least: int = 0) -> Column:
    """Stripped paragraphs of at least ``least`` characters."""
    return F.filter(F.transform(F.split(_c(x), r"\n\s*\n"), strip), lambda p: F.length(p) > max(0, least - 1))


def phrases(x: Column | str, most: int = 3) -> Column:
    """Distinct runs of one to ``most`` blank-separated lower-case words."""
    w = F.filter(F.split(collapse(F.lower(_c(x))), " "), lambda t: t != "")

    def runs(n: int) -> Column:
        return F.when(F.size(w) >= n, F.transform(F.sequence(F.lit(0), F.greatest(F.size(w) - n, F.lit(0))), lambda i: F.array_join(F.slice(w, i + 1, n), " "))).otherwise(F.array().cast("array<string>"))

    parts = [runs(n) for n in range(1, most + 1)]
    return F.array_distinct(F.flatten(F.array(*parts)))


def markers(x: Column | str) -> Column:
    """Ids of [[id]] markers in order."""
    return F.regexp_extract_all(_c(x), F.lit(r"\[\[([a-z0-9_\-]+)\]\]"), F.lit(1))


def alias_parts(x: Column | str) -> Column:
    """struct(main, aliases) of 'main (a, b)'."""
    x = strip(x)
    main = F.regexp_extract(x, r"^(.*?)\s*(?:\(([^()]*)\))?$", 1)
    inner = F.regexp_extract(x, r"^(.*?)\s*(?:\(([^()]*)\))?$", 2)
    return F.struct(main.alias("main"), F.filter(F.transform(F.split(inner, ","), strip), lambda a: a != "").alias("aliases"))


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine of two float arrays in double; 0 where a norm is 0, null where lengths differ or one is null."""
    a, b = _c(a), _c(b)
    add = lambda s, x: s + x
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), add)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    both = norm(a) * norm(b)
    return F.when(F.size(a) == F.size(b), F.when(both == 0, 0.0).otherwise(dot / both))
