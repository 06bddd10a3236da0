"""Text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters with diacritics and what they fold to; letters that do not decompose, such as the German sharp s, stay.
ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyy"
TOKEN = r"[\p{L}\p{N}]+"


def norm_title(x: Column) -> Column:
    """Lower case, runs of white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(F.lower(x), r"[\s\p{Z}]+", " "))


def fold(x: Column) -> Column:
    return F.translate(F.lower(x), ACCENTED, PLAIN)


def tokens(x: Column) -> Column:
    """Maximal runs of letters and digits of the folded text; everything else separates."""
    return F.regexp_extract_all(fold(F.coalesce(x, F.lit(""))), F.lit(TOKEN), F.lit(0))


def phrases(query: Column) -> Column:
    """The phrases of a query: for each blank-separated word its tokens; words without tokens are left out."""
    words = F.filter(F.split(query, r"\s+"), lambda w: w != "")
    return F.filter(F.transform(words, tokens), lambda p: F.size(p) > 0)


def parse_tags(x: Column) -> Column:
    """A comma list as trimmed tags without blank ones."""
    return F.filter(F.transform(F.split(F.coalesce(x, F.lit("")), ","), lambda t: F.trim(t)), lambda t: t != "")


def tags_to_str(x: Column) -> Column:
    return F.array_join(F.filter(F.transform(x, lambda t: F.trim(t)), lambda t: t != ""), ",")


def has_tags(have: Column, wanted: Column) -> Column:
    """Whether every wanted tag is among those there, as a whole."""
    return F.size(F.array_except(wanted, have)) == 0


def embed_text(title: Column, body: Column) -> Column:
    return F.concat_ws("\n", title, body)


def index_line(type_: Column, id_: Column, title: Column) -> Column:
    return F.format_string("[%s] #%d %s", type_, id_, title)


def excerpt(body: Column, query: Column, width: int = 500, snap: int = 40) -> Column:
    """At most ``width`` characters of a body around the first word of the query that it holds, cut at blanks where
    one is near, with an ellipsis at each cut. Short bodies, and a width of 0 or less, stay whole; without a word
    found it is the body's beginning."""
    if width <= 0:
        return body
    mark = F.lit("…")
    low = F.lower(body)
    words = F.filter(F.split(F.lower(query), r"[^\p{L}\p{N}_]+"), lambda w: F.length(w) >= 3)
    at = F.array_min(F.filter(F.transform(words, lambda w: F.instr(low, w)), lambda p: p > 0))
    n = F.length(body)
    raw_start = F.greatest(F.lit(0), at - 1 - F.lit(width // 2))
    end = F.least(n, raw_start + width)
    start = F.greatest(F.lit(0), end - width)
    # the first blank at or after the start, and the last before the end, each within the snap
    ahead = F.instr(F.substr(body, start + 1, F.lit(snap)), F.lit(" "))
    start2 = F.when((start > 0) & (ahead > 0), start + ahead).otherwise(start)
    low_end = F.greatest(start2, end - snap)
    back = F.instr(F.reverse(F.substr(body, low_end + 1, F.greatest(F.lit(0), end - low_end))), F.lit(" "))
    end2 = F.when((end < n) & (back > 0), end - back).otherwise(end)
    middle = F.trim(F.regexp_replace(F.substr(body, start2 + 1, F.greatest(F.lit(0), end2 - start2)), r"^[\s]+|[\s]+$", ""))
    around = F.concat(F.when(start2 > 0, mark).otherwise(F.lit("")), middle, F.when(end2 < n, mark).otherwise(F.lit("")))
    head = F.concat(F.regexp_replace(F.substr(body, F.lit(1), F.lit(width)), r"[\s]+$", ""), mark)
    return F.when(n <= width, body).when(at.isNull(), head).otherwise(around)
