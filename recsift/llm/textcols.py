"""Column helpers shared by the JVM-side operators: words, and places of pattern matches.

Spark's pattern functions return the matched strings, not where they stand.  The
places follow from the pieces between the matches: ``split`` and
``regexp_extract_all`` walk the same matches in the same order, so the start of
match ``i`` is the length of everything before it.  Lengths are in code points.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: matches are summed in groups of this many, so that a text with n matches costs n * GROUP, not n * n
GROUP = 128


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, every other character as it is; null reads as empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, UPPER.lower())


def lower_words(text: Column, separators: str) -> Column:
    """Words of the lower-cased text, split at ``separators`` (a class of ASCII characters).

    ``lower`` is much faster than ``translate`` and differs from it only outside
    ASCII; the one character that it turns into an ASCII letter alone (the Kelvin
    sign) is replaced by another letter first.
    """
    low = F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit("K"), F.lit("Å")))
    return F.array_remove(F.split(low, separators), "")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, however often ``body`` reads it.

    A column named in a lambda is computed again for every element; a lambda's own
    argument is not.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def _total(lens: Column) -> Column:
    return F.aggregate(lens, F.lit(0).cast("long"), lambda a, x: a + x["gap"] + x["len"])


def match_spans(text: Column, pattern: str, group: int | None = None, context: int = 0) -> Column:
    """All matches of ``pattern`` as array<struct<start, end, value, part, before, after>>, in order.

    ``part`` is capture group ``group`` (the whole match where it is None).  ``before``
    and ``after`` are up to ``context`` characters around the match, as far as the
    neighbouring matches.  The pattern must not match the empty string.  Null and
    empty texts give an empty array.
    """
    t = F.coalesce(text, F.lit(""))
    whole = F.regexp_extract_all(t, F.lit(pattern), F.lit(0))
    parts = F.regexp_extract_all(t, F.lit(pattern), F.lit(group)) if group is not None else whole

    def rows(lists):
        r = F.transform(F.arrays_zip(lists["gaps"], lists["whole"], lists["parts"], F.slice(lists["gaps"], 2, F.size(lists["gaps"]))),
                        lambda z: F.struct(
            F.char_length(z["gaps"]).cast("long").alias("gap"), F.char_length(z["whole"]).cast("long").alias("len"),
            z["whole"].alias("value"), z["parts"].alias("part"),
            F.right(z["gaps"], F.lit(context)).alias("before"), F.left(z["3"], F.lit(context)).alias("after")))
        return F.filter(r, lambda z: z["value"].isNotNull())  # the last piece has no match after it

    lists = F.struct(F.split(t, pattern).alias("gaps"), whole.alias("whole"), parts.alias("parts"))
    return let(let(lists, rows), _placed)


def _placed(rows: Column) -> Column:
    """Starts and ends from the lengths of the pieces and matches so far: group by group,
    then inside each group."""
    groups = F.transform(F.sequence(F.lit(0), F.greatest(F.size(rows) - 1, F.lit(0)), F.lit(GROUP)),
                         lambda k: F.slice(rows, k + 1, GROUP))

    def with_sums(gs):
        return let(F.transform(gs, _total), lambda sums: F.transform(gs, lambda g, k: F.struct(
            g.alias("g"), F.aggregate(F.slice(sums, 1, k), F.lit(0).cast("long"), lambda a, x: a + x).alias("base"))))

    def inside(b):
        return F.transform(b["g"], lambda x, i: let(b["base"] + x["gap"] + _total(F.slice(b["g"], 1, i)), lambda s: F.struct(
            s.alias("start"), (s + x["len"]).alias("end"), x["value"].alias("value"), x["part"].alias("part"),
            x["before"].alias("before"), x["after"].alias("after"))))

    return F.flatten(F.transform(let(groups, with_sums), inside))


def joined(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined in the order given."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
