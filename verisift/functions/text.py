"""Values as text: cleaning, transformation rules, and the keys under which equal values meet.

A rule is a list of operations ``{"op": name, "args": [...]}``; a list of rules
gives a value several canonical forms, and two values are equal if they share
one.  So alignment of values is an equi-group on keys, never a pairwise search.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_null(c: Column) -> Column:
    """Null, not a number, or nothing but white space."""
    text = c.cast("string")
    return c.isNull() | (F.trim(text) == "") | (F.lower(F.trim(text)) == "nan")


def clean_field(c: Column) -> Column:
    """Control characters to spaces, no quotes, single spaces, lower case."""
    plain = F.regexp_replace(F.regexp_replace(c, r"[\x00-\x1f\x7f]", " "), '"', "")
    return F.lower(F.trim(F.regexp_replace(plain, r"\s+", " ")))


def strip_tags(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(c, "<[^>]*>", ""), r"\s+", " "))


def key_text(c: Column, lower: bool = False) -> Column:
    out = F.trim(F.regexp_replace(F.trim(c), "^\"+|\"+$", ""))
    return F.lower(out) if lower else out


def file_name(c: Column) -> Column:
    return F.regexp_replace(F.trim(c), r"[^A-Za-z0-9._-]+", "_")


def repair_row(line: Column, columns: int, sep: str = "\t") -> Column:
    """Exactly ``columns`` fields: short rows are padded, long ones cut."""
    return F.slice(F.concat(F.split(line, sep), F.array_repeat(F.lit(""), columns)), 1, columns)


def tokens(c: Column) -> Column:
    """Name tokens: punctuation to space, lower case, one list for each of several names."""
    spaced = F.lower(F.regexp_replace(c, "[,.]", " "))
    names = F.split(spaced, r"[;\\&]| and ")
    words = F.transform(names, lambda n: F.filter(F.split(F.trim(F.regexp_replace(n, r"[^a-z0-9\s]", "")), r"\s+"), lambda w: w != ""))
    return F.filter(words, lambda w: F.size(w) > 0)


def token_key(c: Column) -> Column:
    """Equal for texts of the same set of words, whatever their order and punctuation."""
    plain = F.regexp_replace(c, r"[^a-zA-Z0-9\s]", "")
    return F.array_join(F.array_sort(F.array_distinct(F.filter(F.split(plain, r"\s+"), lambda w: w != ""))), " ")


def number_key(c: Column, keep_sign: bool = True) -> Column:
    """A formatted number to two decimals; the sign stays unless asked otherwise."""
    plain = F.regexp_replace(c, r"[^0-9.\-]" if keep_sign else r"[^0-9.]", "")
    return F.round(plain.try_cast("decimal(38,10)"), 2).cast("decimal(38,2)")


#: Formats of times as sources write them, most specific first (fixed values).
TIME_FORMATS = ["yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd h:mm a", "yyyy-MM-dd HH:mm", "M/d/yyyy h:mm a", "M/d/yyyy HH:mm", "M/d/yy h:mm a", "M/d/yy HH:mm", "yyyy-MM-dd", "MM/dd/yyyy"]
#: The same without a year; the year given is the default one.
YEARLESS = ["MMM d - h:mm a", "MMM dd - h:mm a", "h:mm a MMM d", "H:mm MMM d", "h:mm a, MMM dd"]


def clean_time(c: Column) -> Column:
    """One space, marks for noon spelled alike, zone and odd characters gone."""
    out = F.regexp_replace(F.trim(c), r"\s+", " ")
    out = F.regexp_replace(out, r"\s*\([^)]*\)$|\s+(?:[ECMP][SD]T|UTC|GMT)$", "")
    out = F.regexp_replace(out, r"(?i)(\d)\s*([ap])\.?m?\.?(?=$|[\s,])", "$1 $2M")
    return F.upper(F.trim(F.regexp_replace(out, r"[^\w\s:/,.\-+]", "")))


def _shape(fmt: str) -> str:
    """What every text of a format matches: its signs as they are, with numbers and words between them."""
    return "^" + re.sub("MMM|[A-Za-z]+", lambda m: r"\S+" if m[0] in ("MMM", "a") else r"[-+]?\d+", re.sub(r"([ /:,-])", r"[\1]", fmt)) + "$"


def parse_time(c: Column, year: int = 2011) -> Column:
    """The first format that fits. A format that a text can't have by its shape isn't tried, as a failed try costs an exception."""

    def first(text: Column) -> Column:
        full = [F.when(F.regexp_like(text, F.lit(_shape(f))), F.try_to_timestamp(text, F.lit(f))) for f in TIME_FORMATS]
        bare = [F.when(F.regexp_like(text, F.lit(_shape(f))), F.try_to_timestamp(F.concat(F.initcap(F.lower(text)), F.lit(f" {year}")), F.lit(f"{f} yyyy"))) for f in YEARLESS]
        return F.coalesce(*full, *bare)

    # every format has one of the signs; the array is so that the cleaned text is made once
    return F.when(F.regexp_like(c, F.lit("[-/:]")), F.get(F.transform(F.array(clean_time(c)), first), F.lit(0)))


def time_equal(a: Column, b: Column) -> Column:
    """Within a minute, or a second if either says seconds; dates otherwise exactly. Unparsable: false unless identical."""
    x, y = parse_time(a), parse_time(b)
    seconds = (F.regexp_count(a, F.lit(":")) >= 2) & (F.second(x) != 0) | (F.regexp_count(b, F.lit(":")) >= 2) & (F.second(y) != 0)
    clock = F.contains(a, F.lit(":")) | F.contains(b, F.lit(":")) | (F.minute(x) != 0) | (F.minute(y) != 0)
    gap = F.abs(F.unix_timestamp(x) - F.unix_timestamp(y))
    rough = F.abs(F.unix_timestamp(F.date_trunc("minute", x)) - F.unix_timestamp(F.date_trunc("minute", y)))
    near = F.when(seconds, gap <= 1).when(clock, rough <= 60).otherwise(x == y)
    return F.coalesce((a == b) | near, F.lit(False))


#: Properties whose values are times.
DATE_KINDS = ("date", "date_string")


def equality_key(c: Column, kind: str) -> Column:
    """The key under which values of a kind are equal: numbers, times to the minute, else word sets; see ``fusion.join_minutes`` for neighbouring minutes."""
    if kind in ("numeric", "numeric_string"):
        return F.coalesce(number_key(c.cast("string")).cast("string"), c.cast("string"))
    if kind in DATE_KINDS:
        return F.coalesce(F.date_format(F.date_trunc("minute", parse_time(c)), "yyyy-MM-dd HH:mm"), token_key(c))
    return token_key(c)


def format_key(c: Column) -> Column:
    """The pattern of a value: letters and digits as X, separators as they are."""
    return F.regexp_replace(c, "[a-zA-Z0-9]", "X")


def format_kind(c: Column) -> Column:
    low = F.lower(F.trim(c))
    return (
        F.when(low.isin("true", "false", "yes", "no", "t", "f", "y", "n"), "boolean")
        .when(c.try_cast("double").isNotNull(), "numeric")
        .when(parse_time(c).isNotNull(), "date")
        .otherwise("text")
    )


def _split(c, sep):
    return F.replace(c, F.lit(sep), F.lit(" "))


def _replace(c, old, new):
    return F.replace(c, F.lit(old), F.lit(new))


def _extract(c, pattern):
    return F.when(F.regexp_like(c, F.lit(pattern)), F.regexp_extract(c, pattern, 0)).otherwise(c)


def _remove_words(c, words):
    for w in words:
        c = F.regexp_replace(c, rf"\b{re.escape(w)}\b", "")
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def _abbreviate(c, words):
    parts = F.transform(F.split(c, " "), lambda w: F.when(w.isin(*words), F.concat(F.substring(w, 1, 1), F.lit("."))).otherwise(w))
    return F.array_join(parts, " ")


def _parse_date(c, fmt):
    return F.coalesce(F.date_format(F.try_to_timestamp(c, F.lit(fmt)), "yyyy-MM-dd'T'HH:mm:ss"), c)


def _reorder_words(c, order):
    parts = F.split(F.trim(c), r"\s+")
    moved = F.array_join(F.transform(F.array(*map(F.lit, order)), lambda i: F.get(parts, i)), " ")
    return F.when(F.size(parts) == len(order), moved).otherwise(c)


OPERATIONS: dict[str, Callable] = {
    "split": _split, "replace": _replace, "extract": _extract, "trim": F.trim, "remove_words": _remove_words,
    "abbreviate": _abbreviate, "parse_date": _parse_date, "reorder_words": _reorder_words,
}


def register_rule(name: str, operation: Callable[..., Column]) -> None:
    """Add an operation (Column, *args) -> Column to the rule language."""
    OPERATIONS[name] = operation


def apply_rule(c: Column, rule: list[dict]) -> Column:
    """All operations in order; a null result of one leaves the value as it was."""
    for step in rule:
        c = F.coalesce(OPERATIONS[step["op"]](c, *step.get("args", [])), c)
    return c


def canonical_forms(c: Column, rules: list[list[dict]], kind: str = "general") -> Column:
    return F.array_distinct(F.array(equality_key(c, kind), *(equality_key(apply_rule(c, r), kind) for r in rules)))


#: What sources of a kind get without any learned rule (fixed values).
DEFAULT_RULES: dict[str, list[list[dict]]] = {
    "name": [[{"op": "replace", "args": [",", " "]}, {"op": "trim"}], [{"op": "split", "args": [";"]}, {"op": "trim"}]],
    "date": [[{"op": "parse_date", "args": ["yyyy-MM-dd h:mm a"]}], [{"op": "parse_date", "args": ["M/d/yy h:mm a"]}]],
}


def dice(a: Column, b: Column) -> Column:
    """Dice coefficient of the letters of two texts, as multisets: 1 - |difference| / (|a| + |b|)."""
    letters = lambda c: F.array_sort(F.filter(F.split(c, ""), lambda x: x != ""))
    x, y = letters(a), letters(b)
    common = F.aggregate(F.array_distinct(x), F.lit(0), lambda n, l: n + F.least(F.size(F.filter(x, lambda z: z == l)), F.size(F.filter(y, lambda z: z == l))))
    return 2.0 * common / F.greatest(F.length(a) + F.length(b), F.lit(1))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets."""
    return F.size(F.array_intersect(a, b)) / F.greatest(F.size(F.array_union(a, b)), F.lit(1))


def edit_similarity(a: Column, b: Column) -> Column:
    return 1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b), F.lit(1))


def values_equal(a: Column, b: Column, kind: str = "general") -> Column:
    """Whether two answers are equal by the kind of their property: times within a minute, numbers to two decimals, else word sets."""
    if kind in DATE_KINDS:
        return time_equal(a, b)
    return F.coalesce(equality_key(a, kind) == equality_key(b, kind), F.lit(False))


def separators(c: Column) -> Column:
    """What stands between the letters and digits of a value, in order."""
    return F.array_join(F.regexp_extract_all(c, F.lit("[^a-zA-Z0-9]+"), F.lit(0)), "|")


def token_set_ratio(a: Column, b: Column) -> Column:
    """0 to 100: the best edit likeness of the shared words and each side's words, order ignored."""
    x, y = F.split(token_key(F.lower(a)), " "), F.split(token_key(F.lower(b)), " ")
    both = F.array_join(F.array_sort(F.array_intersect(x, y)), " ")
    left = F.trim(F.concat_ws(" ", both, F.array_join(F.array_sort(F.array_except(x, y)), " ")))
    right = F.trim(F.concat_ws(" ", both, F.array_join(F.array_sort(F.array_except(y, x)), " ")))
    subset = (both != "") & ((both == left) | (both == right))
    return F.when(subset, 100.0).otherwise(100 * F.greatest(edit_similarity(left, right), *(F.when(both == "", 0.0).otherwise(edit_similarity(both, s)) for s in (left, right))))
