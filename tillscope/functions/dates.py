"""Column functions that read dates from text, always on the wall clock as written.

A cell is cut once into tokens: runs of digits, runs of letters, single marks. The date, the time of day and the zone are then
looked for among the tokens. A date is written year first, as day and month in either order with the year last, or with the
month in words; all places where one may stand are weighed before one is taken.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from tillscope.functions.text import MONTH_NAMES, let, strip, tokens

# --- fixed values -------------------------------------------------------------------------------
MIN_YEAR, MAX_YEAR = 1900, 2100
PLACEHOLDER_DAYS = ("1900-01-01", "1969-12-31", "1970-01-01")
NOT_DATES = ("now", "today")
WEEKDAYS = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")
# Written shapes a date column is described by, tried in this order.
DATE_SHAPES = (
    ("iso", r"^\d{4}-\d{1,2}-\d{1,2}$"),
    ("slash", r"^\d{1,2}/\d{1,2}/\d{2,4}$"),
    ("slash_year_first", r"^\d{4}/\d{1,2}/\d{1,2}$"),
    ("dash", r"^\d{1,2}-\d{1,2}-\d{2,4}$"),
    ("dot", r"^\d{1,2}\.\d{1,2}\.\d{2,4}$"),
    ("month_name", r"^(\d{1,2} )?[A-Za-z]{3,9},? \d{1,2}?,? ?\d{4}$"),
    ("compact", r"^\d{8}$"),
)
# What the directives of a written format mean here; an offset is cut off and stands for nothing.
DIRECTIVES = {
    "d": "d", "m": "M", "Y": "yyyy", "y": "yy", "H": "H", "I": "h", "M": "m", "S": "s", "f": "[SSSSSS][SSS]", "p": "a", "b": "MMM", "B": "MMMM",
    "j": "D", "z": "", "%": "%",
}
# -------------------------------------------------------------------------------------------------

_MONTH_WORDS = {w: i + 1 for i, name in enumerate(MONTH_NAMES) for w in (name, name[:3])} | {"sept": 9}
_WEEKDAY_WORDS = tuple(w for name in WEEKDAYS for w in (name, name[:3])) + ("tues", "thur", "thurs")
_ORDINALS = ("st", "nd", "rd", "th")
_BETWEEN = ("/", ".", "-")


def _map(words: dict[str, int]) -> Column:
    return F.create_map(*[F.lit(x) for pair in words.items() for x in pair])


def _at(array: Column, index: Column) -> Column:
    """The token at a place, null outside."""
    return F.when(index >= 0, F.get(array, index))


def _number(token: Column, longest: int) -> Column:
    return F.coalesce(token.rlike(f"^[0-9]{{1,{longest}}}$"), F.lit(False))


def _year(token: Column) -> Column:
    """Four digits of a year that may be."""
    return F.coalesce(token.rlike("^[0-9]{4}$") & token.between(str(MIN_YEAR), str(MAX_YEAR)), F.lit(False))


def _one_of(token: Column, *words: str) -> Column:
    return F.coalesce(token.isin(*words), F.lit(False))


def _places(t: Column) -> Column:
    return F.sequence(F.lit(0), F.size(t) - 1)


def _joined(array: Column, start: Column, length: Column | None = None) -> Column:
    """The text of the tokens from a place on."""
    return F.array_join(F.slice(array, start + 1, F.size(array) if length is None else F.greatest(length, F.lit(0))), "")


def _year_first(t: Column) -> Column:
    """Where a year, a month and a day stand in this order; null if nowhere."""
    def stands(i: Column) -> Column:
        return (
            F.coalesce(_at(t, i).rlike("^[0-9]{4}$"), F.lit(False)) & _one_of(_at(t, i + 1), *_BETWEEN) & _number(_at(t, i + 2), 2)
            & _one_of(_at(t, i + 3), *_BETWEEN) & _number(_at(t, i + 4), 2) & ~_one_of(_at(t, i - 1), *_BETWEEN)
        )

    return F.get(F.filter(_places(t), stands), 0)


def _month_word(t: Column) -> Column:
    return F.get(F.filter(_places(t), lambda i: _one_of(_at(t, i), *_MONTH_WORDS)), 0)


def _year_last(t: Column) -> Column:
    """Where two numbers and a year stand: a year of four digits before one of two, and what is not all dots before what is.

    Three numbers with dots may be a time. Of several such and nothing better none can be told.
    """
    def stands(i: Column) -> Column:
        year, after, then, later = (_at(t, i + k) for k in (4, 5, 6, 7))
        joined = _one_of(after, *_BETWEEN) & _number(then, 8)
        # A time may follow right behind a mark; anything else joined to the three numbers makes them part of something longer.
        clock = _number(then, 2) & (_one_of(later, ":") | (_year(year) & (_one_of(later, "h") | (_one_of(later, ".") & _number(_at(t, i + 8), 2)))))
        afternoon = _one_of(F.when(_one_of(after, " "), then).otherwise(after), "am", "pm", "a", "p") & dotted(i)
        return (
            _number(_at(t, i), 2) & _one_of(_at(t, i + 1), " ", *_BETWEEN) & _number(_at(t, i + 2), 2) & _one_of(_at(t, i + 3), " ", *_BETWEEN)
            & (_year(year) | F.coalesce(year.rlike("^[0-9]{2}$"), F.lit(False)))
            & ~_one_of(_at(t, i - 1), ":", *_BETWEEN) & ~_one_of(after, ":") & (~joined | clock) & ~afternoon
        )

    def dotted(i: Column) -> Column:
        return _one_of(_at(t, i + 1), ".") & _one_of(_at(t, i + 3), ".")

    def choose(found: Column) -> Column:
        full, plain = F.filter(found, lambda i: _year(_at(t, i + 4))), F.filter(found, lambda i: ~dotted(i))
        return F.coalesce(F.get(full, 0), F.get(plain, 0), F.when(F.size(found) == 1, F.get(found, 0)))

    return let(F.filter(_places(t), stands), choose)


def day_month_year(col: Column) -> Column:
    """Struct ``(before, first, second, year, after, written)`` of the day/month/year date in a cell.

    Null for a year-first date or a month in words.
    """
    def found(t: Column) -> Column:
        return F.when(_year_first(t).isNull() & _month_word(t).isNull(), let(_year_last(t), lambda i: parts(t, i)))

    def parts(t: Column, i: Column) -> Column:
        return F.when(i.isNotNull(), F.struct(
            _joined(t, F.lit(0), i).alias("before"), _at(t, i).cast("int").alias("first"), _at(t, i + 2).cast("int").alias("second"),
            _at(t, i + 4).alias("year"), _joined(t, i + 5).alias("after"), _joined(t, i, F.lit(5)).alias("written")))

    return let(tokens(strip(col)), found)


def _full_year(year: Column) -> Column:
    """Two digits stand for the year within fifty years of the current one."""
    now = F.year(F.current_date())
    near = (F.floor(now / 100) * 100 + year).cast("int")
    near = F.when(near >= now + 50, near - 100).when(near < now - 50, near + 100).otherwise(near)
    return F.when(year < 100, near).otherwise(year)


def _found(year: Column, month: Column, day: Column, rest: Column) -> Column:
    """A date as text, not yet checked against the calendar, and what the cell holds besides."""
    return F.struct(F.format_string("%04d-%02d-%02d", _full_year(year.cast("int")).cast("int"), month.cast("int"), day.cast("int")).alias("day"), rest.alias("rest"))


def _numeric_date(t: Column, order: Column | None) -> Column:
    """A date in digits: year first, all digits together, a year and a month, or day and month before the year."""
    def year_first(i: Column) -> Column:
        return _found(_at(t, i), _at(t, i + 2), _at(t, i + 4), F.concat_ws(" ", _joined(t, F.lit(0), i), _joined(t, i + 5)))

    def year_last(i: Column) -> Column:
        first, second = _at(t, i + 0).cast("int"), _at(t, i + 2).cast("int")
        # Without an order: month first, unless only day first is possible.
        day_first = first > 12 if order is None else F.when(order.isNull(), first > 12).otherwise(order == "day_first")
        month, day = F.when(day_first, second).otherwise(first), F.when(day_first, first).otherwise(second)
        rest = F.concat_ws(" ", _joined(t, F.lit(0), i), _joined(t, i + 5))
        return F.when(month.between(1, 12), _found(_at(t, i + 4), month, day, rest))

    head = F.get(t, 0)
    compact = F.coalesce(head.rlike("^[0-9]{8}$"), F.lit(False))
    month_only = (F.size(t) == 3) & F.coalesce(head.rlike("^[0-9]{4}$"), F.lit(False)) & _one_of(F.get(t, 1), "-", "/") & _number(F.get(t, 2), 2)
    return let(F.struct(_year_first(t).alias("a"), _year_last(t).alias("b")), lambda at: (
        F.when(at["a"].isNotNull(), year_first(at["a"]))
        .when(compact, _found(F.substring(head, 1, 4), F.substring(head, 5, 2), F.substring(head, 7, 2), _joined(t, F.lit(1))))
        .when(month_only, _found(head, F.get(t, 2), F.lit("1"), F.lit("")))
        .when(at["b"].isNotNull(), year_last(at["b"]))))


def _worded_date(t: Column) -> Column:
    """A date with the month in words: the day beside the month, the year behind either, weekdays and endings like "th" left out."""
    kept = F.filter(
        F.transform(t, lambda x, i: F.struct(i.alias("at"), x.alias("t"), _at(t, i - 1).alias("before"), _at(t, i + 1).alias("after"))),
        lambda x: x["t"].rlike(r"^[0-9\p{L}]+$") & ~_one_of(x["t"], *_WEEKDAY_WORDS) & ~(_one_of(x["t"], *_ORDINALS) & _number(x["before"], 2))
        & ~(x["before"].isin(":", "+") & _number(x["t"], 9) & x["before"].isNotNull()) & ~(_one_of(x["after"], ":") & _number(x["t"], 2)))

    def read(words: Column) -> Column:
        k = F.get(F.filter(F.sequence(F.lit(0), F.size(words) - 1), lambda i: _one_of(_at(words, i)["t"], *_MONTH_WORDS)), 0)
        return let(k, lambda at: around(words, at))

    def around(words: Column, k: Column) -> Column:
        month, left, right, third = (_at(words, k + d) for d in (0, -1, 1, 2))
        number = F.try_element_at(_map(_MONTH_WORDS), month["t"])
        some_year = lambda x: _year(x["t"]) | F.coalesce(x["t"].rlike("^[0-9]{2}$"), F.lit(False))
        full = F.get(F.filter(words, lambda x: _year(x["t"])), 0)
        day_before = _number(left["t"], 2) & F.coalesce(some_year(right), F.lit(False))
        day_after = _number(right["t"], 2) & (full.isNotNull() | F.coalesce(some_year(third), F.lit(False)))
        alone = _year(right["t"]) & left.isNull()
        return (
            F.when(day_before, result(number, left["t"], right["t"], F.array(left["at"], month["at"], right["at"])))
            .when(day_after & full.isNotNull(), result(number, right["t"], full["t"], F.array(month["at"], right["at"], full["at"])))
            .when(day_after, result(number, right["t"], third["t"], F.array(month["at"], right["at"], third["at"])))
            .when(alone, result(number, F.lit("1"), right["t"], F.array(month["at"], right["at"])))
        )

    def result(month: Column, day: Column, year: Column, used: Column) -> Column:
        # Blanks in place of what has been read; what is left should be a time.
        rest = F.transform(t, lambda x, i: F.when(F.array_contains(used, i) | _one_of(x, *_WEEKDAY_WORDS) | (_one_of(x, *_ORDINALS) & F.array_contains(used, i - 1)), " ").otherwise(x))
        return _found(year, month, day, F.array_join(rest, ""))

    return let(kept, read)


def _clock(rest: Column) -> Column:
    """A time of day as ``HH:mm:ss.ffffff``; midnight for nothing; null for text that is no time. A zone behind it is cut off."""
    def bare(text: Column) -> Column:
        text = F.regexp_replace(text, r"^[\s,./\-]*(?:t(?=[0-9]))?|[\s,./\-]+$", "")
        timed = F.contains(text, F.lit(":")) | text.rlike("^[0-9]{4,6}")
        return F.when(timed, F.trim(F.regexp_replace(text, r" ?(?:z|utc|gmt)?(?:(?<=[0-9.apmutcg ])[+-][0-9:]+)?$", ""))).otherwise(text)

    def parse(text: Column) -> Column:
        half = F.translate(F.regexp_extract(text, r"([ap]\.? ?m?\.?)$", 1), ". ", "")
        digits = F.trim(F.regexp_replace(text, r"[ap]\.? ?m?\.?$", ""))
        # Dots or an "h" between numbers where there is no colon; four or six digits together.
        colons = F.when(F.contains(digits, F.lit(":")), digits).otherwise(F.translate(digits, ".h", "::"))
        colons = F.when(colons.rlike("^(?:[0-9]{4}|[0-9]{6})$"), F.regexp_replace(colons, "([0-9]{2})(?=[0-9])", "$1:")).otherwise(colons)
        return let(F.struct(F.split(F.regexp_replace(colons, ":$", ""), ":").alias("parts"), half.alias("half")), lambda c: written(text, c["parts"], c["half"]))

    def written(text: Column, parts: Column, half: Column) -> Column:
        hour, minute = F.get(parts, 0), F.coalesce(F.get(parts, 1), F.lit("0"))
        second = F.split(F.coalesce(F.get(parts, 2), F.lit("0")), "[.,]")
        good = (
            (F.size(parts) <= 3) & ((F.size(parts) >= 2) | (half != "")) & _number(hour, 2) & _number(minute, 2) & _number(F.get(second, 0), 2)
            & (F.get(second, 1).isNull() | ((F.size(second) == 2) & _number(F.get(second, 1), 9))) & half.isin("", "a", "p", "am", "pm")
        )
        h = hour.try_cast("int")
        h = F.when(F.startswith(half, F.lit("p")) & (h < 12), h + 12).when(F.startswith(half, F.lit("a")) & (h == 12), 0).otherwise(h)
        fraction = F.rpad(F.substring(F.coalesce(F.when(_number(F.get(second, 1), 9), F.get(second, 1)), F.lit("0")), 1, 6), 6, "0")
        clock = F.format_string("%02d:%02d:%02d.%s", h, minute.try_cast("int"), F.get(second, 0).try_cast("int"), fraction)
        return F.when(text == "", "00:00:00").when(good, clock)

    return let(let(rest, bare), parse)


def has_utc_offset(col: Column) -> Column:
    """Whether a zone or an offset stands behind the time of day."""
    return F.coalesce(let(F.array_join(tokens(strip(col)), ""), lambda text: _zone_at(text) > 0), F.lit(False))


def _zone_at(text: Column) -> Column:
    """How many letters of a joined cell the zone at its end takes; 0 without one. Before it stands a time."""
    zone = F.regexp_extract(text, r"( ?(?:z|(?:utc|gmt)? ?[+-][0-9]{1,2}(?::?[0-9]{2})?|utc|gmt))$", 1)
    head = F.substring(text, F.lit(1), F.length(text) - F.length(zone))
    clock = F.regexp_extract(head, "([t0-9:.,]+)(?: ?[ap]\\.? ?m?\\.?)?$", 1)
    timed = F.contains(clock, F.lit(":")) | clock.rlike("t[0-9]{4}")
    return F.when(timed, F.length(zone)).otherwise(0)


def cut_offset(col: Column) -> Column:
    """The zone at the end of a cell cut off, never converted; a cell without one is unchanged."""
    def cut(text: Column) -> Column:
        return F.rtrim(F.substring(text, F.lit(1), F.length(text) - F.length(F.regexp_extract(text, r"(?i)(\s*(?:z|(?:utc|gmt)?\s*[+-][0-9]{1,2}(?::?[0-9]{2})?|utc|gmt))$", 1))))

    return F.when(has_utc_offset(col), cut(col)).otherwise(col)


def accepted(t: Column) -> Column:
    """A timestamp column, or null outside the accepted years or on a placeholder day."""
    return F.when(F.year(t).between(MIN_YEAR, MAX_YEAR) & ~F.to_date(t).isin(*[F.lit(d).cast("date") for d in PLACEHOLDER_DAYS]), t)


def plausible(ts: Column) -> Column:
    """``accepted`` of a value that is dear to compute, bound once."""
    return let(ts, accepted)


# A day alone, in two digits each and a year of four: most cells, read in generated code.
_ISO_DAY = r"^(?:19|20)[0-9]{2}[-/.][0-9]{2}[-/.][0-9]{2}\z"
_DAY_LAST_YEAR = r"^[0-9]{2}[-/.][0-9]{2}[-/.](?:19|20)[0-9]{2}\z"


def _day_alone(col: Column, order: Column | None) -> Column:
    """The day of a cell that ``_ISO_DAY`` or ``_DAY_LAST_YEAR`` matches; null if the calendar has none, or on a placeholder day."""
    first, second = F.substring(col, 1, 2), F.substring(col, 4, 2)
    day_first = first > "12" if order is None else F.when(order.isNull(), first > "12").otherwise(order == "day_first")
    last = F.concat_ws("-", F.substring(col, 7, 4), F.when(day_first, second).otherwise(first), F.when(day_first, first).otherwise(second))
    text = F.when(col.rlike(_ISO_DAY), F.translate(col, "/.", "--")).otherwise(last)
    return F.when(~text.isin(*PLACEHOLDER_DAYS), text.try_cast("timestamp_ntz"))


def spark_format(fmt: str) -> str:
    """A format of percent directives in Spark's letters; one without any is Spark's already. Unknown directives are refused."""
    if "%" not in fmt:
        return fmt
    out = []
    for directive, literal in re.findall("%(.)|([^%]+)", fmt):
        if directive and directive not in DIRECTIVES:
            raise ValueError(f"the date format {fmt!r} has an unknown directive %{directive}")
        out.append(DIRECTIVES[directive] if directive else re.sub("[A-Za-z]+", lambda m: f"'{m[0]}'", literal))
    return "".join(out).strip()


def read_date(col: Column, order: Column | None = None, fmt: str | None = None) -> Column:
    """Text as a wall-clock timestamp; anything that is no date is null.

    ``fmt`` is a written format, of percent directives or in Spark's letters; it decides by itself. Without it a day/month/year
    date is read in ``order`` where it is given (a cell the order cannot hold is null), and every other one as it stands.
    """
    if fmt is not None:
        return plausible(F.try_to_timestamp(cut_offset(strip(col)), F.lit(spark_format(fmt))).cast("timestamp_ntz"))

    def stamp(t: Column) -> Column:
        # A cell that begins with a time and names no year would be a time of today.
        timed = _number(F.get(t, 0), 2) & _one_of(F.get(t, 1), ":") & ~F.exists(t, lambda x: F.coalesce(x.rlike("^(?:1[89]|2[01])[0-9]{2}$"), F.lit(False)))
        date = F.when(_month_word(t).isNotNull(), _worded_date(t)).otherwise(_numeric_date(t, order))
        return F.when(~timed & ~_one_of(F.array_join(t, ""), *NOT_DATES), let(date, lambda d: F.concat(d["day"], F.lit(" "), _clock(d["rest"])).try_cast("timestamp_ntz")))

    alone = col.rlike(_ISO_DAY) | col.rlike(_DAY_LAST_YEAR)
    return F.when(alone, _day_alone(col, order)).otherwise(plausible(let(tokens(strip(col)), stamp)))


def date_shape(col: Column) -> Column:
    """How a date is written, its time of day left out; null for a cell that is no date."""
    bare = F.regexp_replace(strip(col), r"[T ]\d{1,2}:\d{2}(:\d{2})?(\.\d+)?Z?$", "")

    def label(text: Column) -> Column:
        chain = F.when(F.lit(False), "")
        for name, pattern in DATE_SHAPES:
            chain = chain.when(text.rlike(pattern), name)
        return chain.otherwise("other")

    return F.when(read_date(col).isNotNull(), let(bare, label))


def month_of(ts: Column) -> Column:
    return F.trunc(F.to_date(ts), "MM")
