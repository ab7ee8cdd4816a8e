"""Column functions for text: blank cells, identities, product names, letter case."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tillscope.session import materialize

# --- fixed values -------------------------------------------------------------------------------
# Cells that mean "missing" when a text file is read.
MISSING_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)
# Characters nobody sees in a product name.
INVISIBLE = (
    r"[\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180b-\u180f\u200b\u200e\u200f\u202a-\u202e"
    r"\u2060-\u206f\u2800\u3164\ufe00-\ufe0f\ufeff\uffa0\ufff9-\ufffb\x{1d173}-\x{1d17a}\x{e0000}-\x{e007f}]"
)
# Characters an identifier loses: they draw nothing and change nothing around them.
NOTHING_AND_MARKS = r"[\u00ad\u200b\u2060\u2061\u2062\u2063\u2064\ufeff\u200e\u200f\u061c]"
# Format characters that do draw something.
VISIBLE_FORMAT = r"\u0600-\u0605\u06dd\u070f\u0890\u0891\u08e2\x{110bd}\x{110cd}"
# White space as the reading rules see it: Unicode white space plus the four separators.
SPACE = r"[\s\x1c-\x1f]"
# -------------------------------------------------------------------------------------------------

# One visible character is enough; asked this way no pattern repeats a group over a long text.
_VISIBLE = (
    rf"(?U)[[^\s\x1c-\x1f{INVISIBLE[1:-1]}\x{{e0100}}-\x{{e01ef}}]&&[\P{{Cf}}{VISIBLE_FORMAT}]]"
)
_ENDS = rf"(?U)\A{SPACE}++|(?<!{SPACE}){SPACE}++\z"


def null_tokens(col: Column) -> Column:
    """The cell, or null where it is one of the missing-value tokens."""
    return F.when(col.isin(*MISSING_TOKENS), None).otherwise(col)


def reads_as_missing(col: Column) -> Column:
    return F.coalesce(col.isin(*MISSING_TOKENS), F.lit(False))


def is_plain(col: Column) -> Column:
    """Printable ASCII words one space apart: every reading below leaves such text as it is.

    One cheap test spares ordinary cells the Unicode rules, which cost several regexes each.
    """
    return col.rlike(r"^[!-~]++(?: [!-~]++)*+\z")


def beyond_ascii(col: Column) -> Column:
    """Whether some letter takes more than one byte; told by two lengths, which costs less than a search."""
    return F.octet_length(col) > F.char_length(col)


def let(value: Column, body) -> Column:
    """Bind ``value`` once for ``body``, so that deep readings do not copy the expressions under them."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _unless_plain(col: Column, read) -> Column:
    """Ordinary cells stay in generated code; the rest go through ``read``, evaluated apart from it so
    that the many regexes of the rare path do not outgrow one compiled stage."""
    return F.when(is_plain(col), col).otherwise(let(col, read))


def strip(col: Column) -> Column:
    """Both ends trimmed of every kind of white space (``trim`` removes plain spaces only)."""
    return _unless_plain(col, _strip)


def _strip(col: Column) -> Column:
    return F.regexp_replace(col, _ENDS, "")


def is_padded(col: Column) -> Column:
    return F.coalesce(col != strip(col), F.lit(False))


def is_blank(col: Column) -> Column:
    """Missing, or nothing in it that a reader can see."""
    return F.coalesce(~col.rlike(_VISIBLE), F.lit(True))


def fold(col: Column) -> Column:
    """Case folded: lower case, with the letters whose folding differs from lower case."""
    special = F.replace(F.replace(col, F.lit("ß"), F.lit("ss")), F.lit("ẞ"), F.lit("ss"))
    return F.lower(F.when(beyond_ascii(col) & col.rlike("[ßẞςſ]"), F.translate(special, "ςſ", "σs")).otherwise(col))


def _identifier(col: Column) -> Column:
    return _strip(F.translate(F.regexp_replace(col, NOTHING_AND_MARKS, ""), "\u00a0", " "))


def _category(col: Column) -> Column:
    return F.regexp_replace(_identifier(col), " {2,}", " ")


def _product(col: Column) -> Column:
    shown = _strip(F.regexp_replace(F.regexp_replace(col, INVISIBLE, ""), rf"(?U){SPACE}+", " "))
    return let(shown, lambda t: F.when(t.rlike(_VISIBLE), t))


def identifier_text(col: Column) -> Column:
    """A value as a reader tells it apart; case and inner runs of spaces are kept."""
    return _unless_plain(col, _identifier)


def category_text(col: Column) -> Column:
    return _unless_plain(col, _category)


def category_key(col: Column) -> Column:
    return F.lower(category_text(col))


def customer_identity(col: Column) -> Column:
    return F.lower(identifier_text(col))


def identifier_or_null(col: Column) -> Column:
    return _unless_plain(col, lambda t: F.when(t.rlike(_VISIBLE), _identifier(t)))


def customer_or_null(col: Column) -> Column:
    return F.lower(identifier_or_null(col))


def category_or_null(col: Column) -> Column:
    return _unless_plain(col, lambda t: F.when(t.rlike(_VISIBLE), _category(t)))


def product_text(col: Column) -> Column:
    """A product name or SKU as it is shown; null when nothing visible is left."""
    return _unless_plain(col, _product)


def text_identity(col: Column) -> Column:
    return fold(product_text(col))


def keyed(name: Column, sku: Column) -> Column:
    """``sku:…`` when there is a SKU, else ``name:…``; both already read with ``text_identity``."""
    return F.coalesce(F.concat(F.lit("sku:"), sku), F.concat(F.lit("name:"), name))


def label_key(col: Column) -> Column:
    """A label with case, spacing and punctuation ignored; labels of only punctuation stay apart."""
    spaced = strip(F.regexp_replace(F.regexp_replace(fold(col), r"[\p{P}\p{S}_]", " "), rf"(?U){SPACE}+", " "))
    return F.when(spaced == "", F.concat(F.lit("\u0000"), fold(col))).otherwise(spaced)


def title_case(col: Column) -> Column:
    """Every run of letters capitalised, so ``o'neil-smith`` becomes ``O'Neil-Smith``."""
    runs = F.regexp_extract_all(col, F.lit(r"(\p{L}+|[^\p{L}]+)"), 1)
    return F.array_join(
        F.transform(runs, lambda t: F.concat(F.upper(F.substring(t, 1, 1)), F.lower(F.substring(t, 2, 2147483647)))), ""
    )


# Values that look like numbers, periods or times of day, however dressed: told by what stands before, between and behind digits.
MONTH_NAMES = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
_MONTH_LIKE = (*MONTH_NAMES, *(m[:3] for m in MONTH_NAMES), "sept")
_MONEY_MARKS = "$€£¥₫₹"


def tokens(text: Column) -> Column:
    """Runs of digits, runs of letters and single marks, in small letters; blanks around a mark between digits are left out."""
    single = F.regexp_replace(F.lower(text), r"\s+", " ")
    return F.regexp_extract_all(F.regexp_replace(single, "(?<=[0-9]) ?([-/.:]) ?(?=[0-9])", "$1"), F.lit(r"([0-9]+|\p{L}+|.)"), 1)


def is_number_like(col: Column) -> Column:
    """One number with signs, a currency and a short unit around it; or any digit beside a currency sign."""
    def dressed(text: Column) -> Column:
        head, tail = F.regexp_extract(text, "^([^0-9]*)[0-9]", 1), F.regexp_extract(text, "[0-9]([^0-9]*)$", 1)
        body = F.substring(text, F.length(head) + 1, F.length(text) - F.length(head) - F.length(tail))
        before, behind = F.translate(head, f"(+-{_MONEY_MARKS} \t", ""), F.translate(tail, ".,' \t)", "")
        named = before.isin("", "Rs", "Rs.") | (before.rlike("^[A-Z]{3}$") & head.rlike(r"[A-Z]{3}\s"))
        unit = behind.isin("", "%") | behind.rlike(r"^\p{L}{1,3}$")
        return text.rlike("[0-9]") & (F.translate(body, "0123456789.,' \t", "") == "") & named & unit & (F.length(head) <= 10)

    text = F.translate(strip(col), "−", "-")
    return let(text, dressed) | (text.rlike("[0-9]") & text.rlike(r"\p{Sc}"))


def is_period_like(col: Column) -> Column:
    """A quarter, half or week, with or without its year on either side; or a month's name with or without a year."""
    def told(t: Column) -> Column:
        words, marks = F.filter(t, lambda x: x.rlike(r"^[0-9\p{L}]+$")), F.filter(t, lambda x: ~x.rlike(r"^[0-9\p{L}]+$"))
        return let(words, lambda w: F.forall(marks, lambda m: m.isin(" ", "-", "/", ".")) & (part(w, 0, marks) | part(w, 1, marks) | month(w)))

    def year(word: Column, least: int = 2) -> Column:
        return F.coalesce(word.rlike(f"^[0-9]{{{least},4}}$"), F.lit(False))

    def part(w: Column, at: int, marks: Column) -> Column:
        letter, number = F.get(w, at), F.get(w, at + 1)
        counted = ((letter == "q") & number.between("1", "4") & (F.length(number) == 1)) | ((letter == "h") & number.isin("1", "2")) | ((letter == "w") & number.rlike("^[0-9]{1,2}$"))
        rest = (F.size(w) == at + 2) | ((F.size(w) == at + 3) & year(F.get(w, at + 2)))
        return F.coalesce(counted, F.lit(False)) & rest & ~F.array_contains(marks, ".") & (year(F.get(w, 0), 4) if at else F.lit(True))

    def month(w: Column) -> Column:
        return F.coalesce(F.get(w, 0).isin(*_MONTH_LIKE), F.lit(False)) & ((F.size(w) == 1) | ((F.size(w) == 2) & year(F.get(w, 1))))

    return let(tokens(strip(col)), told)


def is_time_like(col: Column) -> Column:
    """Hours and minutes with a colon, perhaps seconds, perhaps the half of the day."""
    def told(t: Column) -> Column:
        two = lambda i: F.coalesce(F.get(t, i).rlike("^[0-9]{2}$"), F.lit(False))
        colon = lambda i: F.coalesce(F.get(t, i) == ":", F.lit(False))
        rest = lambda n: F.translate(F.array_join(F.slice(t, n + 1, 6), ""), " .", "").isin("", "am", "pm")
        hours = F.coalesce(F.get(t, 0).rlike("^[0-9]{1,2}$"), F.lit(False))
        return hours & colon(1) & two(2) & F.when(colon(3), two(4) & rest(5)).otherwise(rest(3))

    return let(tokens(strip(col)), told)


# --- Unicode composition (the one Python step) ---------------------------------------------------

# Text below U+0300 is composed as it is.
_MAY_COMPOSE = r"[\u0300-\x{10ffff}]"


@F.pandas_udf(StringType())
def _nfc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")


def nfc(col: Column) -> Column:
    """Unicode-composed text, every value through Python: for answers and other tables of a user's own size."""
    return _nfc(col)


def may_compose(*cols: Column) -> Column:
    """Whether any of the texts holds a character that composing could change."""
    return F.coalesce(F.greatest(*[F.coalesce(beyond_ascii(c) & c.rlike(_MAY_COMPOSE), F.lit(False)) for c in cols], F.lit(False)), F.lit(False))


def compose_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """Unicode-compose the named text columns, through one dictionary of their distinct texts.

    Composing comes last in a reading: a mark behind an invisible character meets its letter only when that character is gone.
    Only distinct texts beyond U+0300 reach Python, and only those that change are kept, written once and joined to the
    columns; without any the table comes back as it is. Cells that need nothing are spread over a join's partitions instead of
    meeting on one null key.
    """
    cells = F.array_compact(F.array(*[F.when(F.col(c).rlike(_MAY_COMPOSE), F.struct(F.lit(c).alias("column"), F.col(c).alias("raw"))) for c in columns]))
    texts = df.select(F.explode(cells).alias("cell")).select("cell.*").groupBy("raw").agg(F.collect_set("column").alias("columns"))
    changed = materialize(texts.withColumn("composed", _nfc("raw")).filter("raw <> composed"), "composed-texts")
    found = {r[0] for r in changed.select(F.explode("columns")).distinct().collect()}  # names of columns
    spread = F.concat(F.lit("\u0001"), F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]), F.lit(1024)).cast("string"))
    names = df.columns
    for name in (c for c in columns if c in found):
        own = changed.filter(F.array_contains("columns", name)).select(F.col("raw").alias("__raw"), F.col("composed").alias("__composed"))
        keyed_df = df.withColumn("__raw", F.when(F.col(name).rlike(_MAY_COMPOSE), F.col(name)).otherwise(spread))
        df = keyed_df.join(own, "__raw", "left").withColumn(name, F.coalesce("__composed", name)).select(*[F.col(f"`{c}`") for c in names])
    return df
