"""Read typed values from free text: numbers, dates and booleans in the notations people use.

Everything is built from JVM-side expressions (no Python workers), in steps bound by ``let``. Plain numbers take a short path; only the rest pays for normalisation. NULL and blank text give
NULL, and so does text that states no single value of the type.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space that may stand around a value (SQL trim knows only the space).
BLANKS = " \t\n\r\f\v\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u200b\u202f\u205f\u3000\ufeff"

#: The zero of each decimal digit block of Unicode that is in common use; nine digits follow each.
ZEROS = "０٠۰०০੦૦୦௦౦೦൦๐໐༠၀០᠐"

#: Signs and separators written otherwise, and what they stand for.
SIGNS = {"．": ".", "٫": ".", "，": ",", "٬": ",", "−": "-", "－": "-", "＋": "+", "＝": "=", "／": "/", "：": ":", "×": "x"}

#: Words for true and false.
TRUE_WORDS = ["true", "t", "yes", "y", "1", "on"]
FALSE_WORDS = ["false", "f", "no", "n", "0", "off"]

#: English month names by their first three letters.
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]

PLAIN = r"^-?[0-9]+(?:[.][0-9]+)?$"
_MARKS = r"(?i)^(?:=|x(?=[ 0-9])|n *=) *|(?<=[0-9 ]) *(?:\((?:hh?|ll?|a|n)\)|hh?|ll?|\*+|!+|x|↑|↓)$"
_GAP = "[,.' \u2019\u00a0\u2009\u202f]"
_SIMPLE = r"^[-+]?(?:[0-9]+(?:[.,][0-9]*)?|[.,][0-9]+)(?:[eE][-+]?[0-9]+)?$"
_GROUPED = rf"^[-+]?[1-9][0-9]{{0,2}}(?:({_GAP})[0-9]{{3}}(?:\1[0-9]{{3}})*(?!\1)[.,][0-9]+|(?:(?![.]){_GAP})[0-9]{{3}}|({_GAP})[0-9]{{3}}(?:\2[0-9]{{3}})+)$"

#: Date notations and the order of their parts: year, month, day; a fourth part says that the day may come second.
_DATES = [
    (r"^([0-9]{4})([-/.])([0-9]{1,2})\2([0-9]{1,2})(?:[t ][0-9:.]+(?:z|[-+][0-9:]+)?)?$", "$1|$3|$4"),
    (r"^([0-9]{4})([0-9]{2})([0-9]{2})$", "$1|$2|$3"),
    (r"^([0-9]{1,2})([-/.])([0-9]{1,2})\2([0-9]{4})$", "$4|$3|$1|?"),
    (r"^([0-9]{1,2})(?:st|nd|rd|th)?[- .]+([a-z]{3,9})[- .,]+([0-9]{4})$", "$3|$2|$1"),
    (r"^([a-z]{3,9})[- .]+([0-9]{1,2})(?:st|nd|rd|th)?[- .,]+([0-9]{4})$", "$3|$1|$2"),
    (r"^([0-9]{4})[- .]+([a-z]{3,9})[- .]+([0-9]{1,2})$", "$1|$2|$3"),
]
_MONTH_NAME = r"^(?:jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sept?(?:ember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)$"


def _blank_trim(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANKS))


def trimmed(text: Column) -> Column:
    """``text`` without white space of any kind around it."""
    return _blank_trim(text)


def canonical(name: Column) -> Column:
    """The canonical form of an attribute name."""
    return F.lower(F.trim(name))


def ascii_digits(text: Column) -> Column:
    """Digits, signs and separators of other scripts in their ASCII form."""
    digits = "".join(chr(ord(z) + i) for z in ZEROS for i in range(10))
    return F.translate(text, digits + "".join(SIGNS), "0123456789" * len(ZEROS) + "".join(SIGNS.values()))


def plain_number(text: Column) -> Column:
    """The number if ``text`` is a plain number: spaces aside an optional minus, digits, optionally a point and digits."""
    s = F.trim(text)
    return F.when(s.rlike(PLAIN), s.cast("double"))


def _finite(x: Column) -> Column:
    return let(x, lambda v: F.when(v.between(-1.7976931348623157e308, 1.7976931348623157e308), v))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often ``body`` names it and wherever Catalyst moves it."""
    return F.transform(F.array(value), body)[0]


def number(text: Column, unit: Column | None = None) -> Column:
    """The one finite number stated by ``text``.

    Signs, digits of other scripts, decimal comma, digit grouping, exponents, the own ``unit``, a leading ``=``, a count mark
    ``x`` and laboratory marks (``H L (H) * !``) are read; bounds, ranges, several numbers and remarks give NULL. Three digits
    after one comma are a group (``1,250``), after one point decimals (``1.250``), as a plain number says.
    """
    # the unit travels inside the bound value: a lambda that captures an outer column hides it from predicate pushdown
    given = F.struct(trimmed(text).alias("s"), (F.lit(None).cast("string") if unit is None else unit).alias("unit"))
    return let(given, lambda x: _finite(F.when(x.s.rlike(PLAIN), x.s.try_cast("double")).when(x.s.rlike(r"\p{Nd}"), _written(x))))


def _bare(text: Column) -> Column:
    return _blank_trim(F.regexp_replace(text, _MARKS, ""))


def _written(x: Column) -> Column:
    def without_unit(t: Column) -> Column:
        at = F.length(t.s) - F.length(t.unit)
        ends = (at > 0) & (F.length(t.unit) > 0) & F.endswith(F.lower(t.s), F.lower(t.unit))
        return F.when(ends, _blank_trim(F.substr(t.s, F.lit(1), at))).otherwise(t.s)

    def grammar(t: Column) -> Column:
        grouped = F.regexp_replace(F.regexp_replace(t, f"{_GAP}(?=[0-9]{{3}}(?:[^0-9]|$))", ""), ",", ".")
        return F.when(t.rlike(_GROUPED), grouped).when(t.rlike(_SIMPLE), F.regexp_replace(t, ",", ".")).try_cast("double")

    return let(F.struct(_bare(ascii_digits(x.s)).alias("s"), x.unit.alias("unit")), lambda t: let(_bare(without_unit(t)), grammar))


def date(text: Column) -> Column:
    """The one date stated by ``text``: ISO, slashed, dotted, compact and month-name forms, day before month.

    A slashed or dotted date that is possible only with the month first is read so. Incomplete and impossible dates give NULL.
    """
    s = F.lower(ascii_digits(trimmed(text)))
    for pattern, to in _DATES:
        s = F.regexp_replace(s, pattern, to)
    return let(F.split(s, r"\|"), lambda p: F.when(F.size(p).between(3, 4), _ymd(p)))


def _ymd(p: Column) -> Column:
    named = F.array_position(F.array(*map(F.lit, MONTHS)), F.substr(p[1], F.lit(1), F.lit(3))).cast("int")
    month = F.when(p[1].rlike("^[0-9]"), p[1].try_cast("int")).when(p[1].rlike(_MONTH_NAME), named)
    parts = F.struct(p[0].try_cast("int").alias("y"), month.alias("m"), p[2].try_cast("int").alias("d"), (F.size(p) == 4).alias("either"))
    swapped = lambda x: F.when(x.either & (x.m > 12), F.struct(x.y.alias("y"), x.d.alias("m"), x.m.alias("d"))).otherwise(F.struct(x.y.alias("y"), x.m.alias("m"), x.d.alias("d")))
    return let(let(parts, swapped), lambda x: F.when(x.y.between(1, 9999) & x.m.between(1, 12) & x.d.between(1, 31), _day(x)))


def _day(x: Column) -> Column:
    return let(F.make_date(x.y, x.m, F.lit(1)), lambda first: F.when(x.d <= F.dayofmonth(F.last_day(first)), F.date_add(first, x.d - 1)))


def boolean(text: Column) -> Column:
    """True or false if ``text`` is one of the usual words or 1 or 0; any other number gives NULL."""
    word = F.create_map(*(F.lit(x) for w in TRUE_WORDS for x in (w, True)), *(F.lit(x) for w in FALSE_WORDS for x in (w, False)))
    return F.try_element_at(word, F.lower(ascii_digits(trimmed(text))))


def encoded(text: Column, data_type: Column, unit: Column) -> Column:
    """The value of a NUMERIC, BOOLEAN (1, 0) or DATE (days since 1970) text as one double; NULL if it states none."""
    return (
        F.when(data_type == "NUMERIC", number(text, unit))
        .when(data_type == "BOOLEAN", boolean(text).cast("int").cast("double"))
        .when(data_type == "DATE", F.datediff(date(text), F.lit("1970-01-01").cast("date")).cast("double"))
    )
