"""Quality rules whose thresholds come from the corpus: quantile sketches per language and source, then a joined filter.

Each document gives four rates in thousandths (``RATES``). A sketch is a histogram of one rate whose buckets keep the highest
``Rules.bits`` bits of a value, so a quantile read from it is off by at most 2 ** (1 - bits) of itself. Sketches merge by adding
their counts: those of (language, source) give those of the language, these that of all documents, in whatever order tasks
end. A group with fewer than ``Rules.group_rows`` documents takes the thresholds of its language, and one whose language has
fewer those of all documents.

A rate is far out beyond ``Rules.reach`` quartile ranges from its quartiles; the range counts as at least the rate's ``least``,
because most groups have no symbols and no repeats at all. Everything is whole-number arithmetic and column functions: results
do not depend on partitions.

Defined results: null and empty texts have no words, all counts 0, and fail the base rule; documents without words are in no
sketch; null languages and sources are groups like any other; repeated rows are counted and judged each; a null id is carried;
texts of any length are read whole, one at a time; columns other than the four named are ignored, and the names used inside
are dealt with before any other column is seen; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillscope.llm.common import written

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")
# Rates in thousandths: what is counted, among what, the least range that counts, and whether small values are far out too.
RATES = {
    "symbols": ("n_symbols", "n_words", 12, False),
    "dup_lines": ("n_dup_lines", "n_lines", 100, False),
    "repeats": ("n_repeat_words", "n_words", 75, False),
    "length": ("word_chars", "n_words", 250, True),
}


@dataclass(frozen=True)
class Rules:
    """Fewest words and the largest share of repeated words in hundredths (the base rule); bits of a bucket; quartile ranges that are not far out; fewest documents with thresholds of their own; slices a group is dealt over."""

    least_words: int = 50
    most_repeated: int = 50
    bits: int = 9
    reach: int = 4
    group_rows: int = 200
    slices: int = 16


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often ``body`` names it."""
    return F.transform(F.array(value), body)[0]


def _covered(windows: Column) -> Column:
    """Places covered by sorted windows of three that stand beside an equal one."""

    def same(x: Column, y: Column) -> Column:
        return (x["a"] == y["a"]) & (x["b"] == y["b"]) & (x["c"] == y["c"])

    twice = F.transform(windows, lambda x, k: F.when(same(x, F.get(windows, k - 1)) | same(x, F.get(windows, k + 1)), x["i"]))
    starts = F.sort_array(F.filter(twice, lambda p: p.isNotNull()))
    # A start covers three places, or those before the next start.
    return _let(starts, lambda s: F.aggregate(F.transform(s, lambda p, k: F.coalesce(F.least(F.get(s, k + 1) - p, F.lit(3)), F.lit(3))), F.lit(0), lambda n, x: n + x))


def repeated_words(words: Column) -> Column:
    """How many words stand in a window of three words that the text holds twice or more.

    Equal windows have equal hashes, so a text whose hashes all differ repeats nothing; of others the windows are sorted and
    compared word by word.
    """
    hashes = F.transform(words, lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)))
    windows = F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.struct(F.get(words, i).alias("a"), F.get(words, i + 1).alias("b"), F.get(words, i + 2).alias("c"), i.alias("i")))
    some = (F.size(words) > 3) & (F.size(F.array_distinct(hashes)) < F.size(words))
    return F.when(some, _let(F.sort_array(windows), _covered)).otherwise(0)


def _measures(text: Column) -> Column:
    words = F.array_remove(F.split(text, SPACE), "")
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    counts = _let(words, lambda w: F.struct(F.size(w).alias("n_words"), F.char_length(F.array_join(w, "")).alias("word_chars"), repeated_words(w).alias("n_repeat_words")))
    repeats = _let(lines, lambda x: F.struct(F.size(x).alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).alias("n_dup_lines")))
    symbols = F.char_length(text) - F.char_length(F.translate(text, SYMBOLS, ""))
    return F.struct(counts.alias("c"), repeats.alias("r"), symbols.alias("n_symbols"))


def measure(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """doc_id, lang, source and ``COUNTS`` of every document."""
    found = documents.select(F.col(doc_id).alias("doc_id"), F.col(lang).alias("lang"), F.col(source).alias("source"), _measures(F.coalesce(F.col(text), F.lit(""))).alias("m"))
    part = {"n_words": "c", "word_chars": "c", "n_repeat_words": "c", "n_lines": "r", "n_dup_lines": "r"}
    return found.select("doc_id", "lang", "source", *(F.col(f"m.{part[c]}.{c}" if c in part else f"m.{c}").cast("long").alias(c) for c in COUNTS))


def rate(name: str) -> Column:
    """One of ``RATES`` of a measured document, rounded down; null without words."""
    count, among, _, _ = RATES[name]
    return F.when(F.col(among) > 0, F.expr(f"1000L * {count} div {among}"))


def bucket(value: Column, bits: int) -> Column:
    """The least number with the same highest ``bits`` bits and the same length as a whole number from 0."""
    drop = F.greatest(F.length(F.bin(value)) - bits, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", value, drop), drop)


def sketch(measured: DataFrame, rules: Rules) -> DataFrame:
    """lang, source, rate, bucket, n: the mergeable sketches of (language, source)."""
    values = F.array(*(F.struct(F.lit(name).alias("rate"), bucket(rate(name), rules.bits).alias("bucket")) for name in RATES))
    long = measured.where("n_words > 0").select("lang", "source", F.explode(values).alias("v")).select("lang", "source", "v.rate", "v.bucket")
    return long.groupBy("lang", "source", "rate", "bucket").agg(F.count("*").alias("n"))


def merged(sketches: DataFrame, *keys: str) -> DataFrame:
    """Sketches of coarser groups."""
    return sketches.groupBy(*keys, "rate", "bucket").agg(F.sum("n").alias("n"))


def fences(sketches: DataFrame, rules: Rules, *keys: str) -> DataFrame:
    """One row per group: ``rows`` and the least and largest value of each rate that is not far out.

    A group's window holds one row per bucket, at most 2 ** bits for each doubling of the value, however many documents it has.
    """
    by = [F.col(k) for k in (*keys, "rate")]
    running = sketches.select("*", F.sum("n").over(Window.partitionBy(*by).orderBy("bucket")).alias("upto"), F.sum("n").over(Window.partitionBy(*by)).alias("rows"))
    quartile = lambda q: F.min(F.when(F.col("upto") * 4 >= F.col("rows") * q, F.col("bucket")))
    quartiles = running.groupBy(*by).agg(F.max("rows").alias("rows"), quartile(1).alias("q1"), quartile(3).alias("q3"))
    least = F.create_map(*(F.lit(x) for name, r in RATES.items() for x in (name, r[2])))
    span = F.greatest(F.col("q3") - F.col("q1"), least[F.col("rate")]) * rules.reach
    bounds = [F.max(F.when(F.col("rate") == name, F.col("q3") + span)).alias(f"{name}_most") for name in RATES]
    bounds += [F.max(F.when(F.col("rate") == name, F.col("q1") - span)).alias(f"{name}_least") for name, r in RATES.items() if r[3]]
    return quartiles.groupBy(*keys).agg(F.max("rows").alias("rows"), *bounds)


def _bounds() -> list[str]:
    return [f"{name}_most" for name in RATES] + [f"{name}_least" for name, r in RATES.items() if r[3]]


def thresholds(measured: DataFrame, rules: Rules | None = None) -> DataFrame:
    """lang, source and the bounds in force there, with ``level``: 0 its own, 1 its language's, 2 those of all documents."""
    rules = rules or Rules()
    sketches = written(sketch(measured, rules), "quality-sketch")
    by_lang = merged(sketches, "lang")
    overall = fences(merged(by_lang), rules).first()  # one row of bounds
    own, wide = fences(sketches, rules, "lang", "source"), fences(by_lang, rules, "lang")
    both = own.alias("o").join(wide.alias("w"), F.col("o.lang").eqNullSafe(F.col("w.lang")))
    enough = lambda side: F.col(f"{side}.rows") >= rules.group_rows
    level = F.when(enough("o"), 0).when(enough("w"), 1).otherwise(2)
    chosen = [F.when(level == 0, F.col(f"o.{b}")).when(level == 1, F.col(f"w.{b}")).otherwise(F.lit(overall[b] if overall else None).cast("long")).alias(b) for b in _bounds()]
    return both.select("o.lang", "o.source", level.alias("level"), *chosen)


def judge(measured: DataFrame, limits: DataFrame, rules: Rules | None = None) -> DataFrame:
    """Measured documents with base_failed, kept and ``reasons``, the rates that are far out in their group."""
    rules = rules or Rules()
    # A group may hold a third of all documents: it is dealt over slices, and its one row of bounds is copied to each.
    docs = measured.withColumn("slice", F.pmod(F.xxhash64("doc_id", *COUNTS), F.lit(rules.slices)).cast("int"))
    bounds = limits.withColumnsRenamed({"lang": "of_lang", "source": "of_source"}).withColumn("of_slice", F.explode(F.sequence(F.lit(0), F.lit(rules.slices - 1))))
    same = F.col("slice") == F.col("of_slice")
    joined = docs.join(bounds, same & F.col("lang").eqNullSafe(F.col("of_lang")) & F.col("source").eqNullSafe(F.col("of_source")), "left")
    far = [F.when((rate(n) > F.col(f"{n}_most")) | ((rate(n) < F.col(f"{n}_least")) if r[3] else F.lit(False)), F.lit(n)) for n, r in RATES.items()]
    failed = (F.col("n_words") < rules.least_words) | (100 * F.col("n_repeat_words") > rules.most_repeated * F.col("n_words"))
    out = joined.withColumn("base_failed", failed).withColumn("reasons", F.filter(F.array(*far), lambda x: x.isNotNull()))
    return out.select("doc_id", "lang", "source", *COUNTS, "base_failed", (~F.col("base_failed") & (F.size("reasons") == 0)).alias("kept"), "reasons", "level")


def assess(documents: DataFrame, rules: Rules | None = None) -> DataFrame:
    """Every document of (doc_id, text, lang, source) measured and judged. Texts are read once; their counts are written."""
    measured = written(measure(documents), "quality-counts")
    return judge(measured, thresholds(measured, rules), rules)


def verdicts(documents: DataFrame, rules: Rules | None = None) -> DataFrame:
    """doc_id, the counts of the contract, base_failed and kept."""
    return assess(documents, rules).select("doc_id", *COUNTS[:5], "base_failed", "kept")


_RATES_SQL = ", ".join(f"CASE WHEN {among} > 0 THEN 1000 * {count} // {among} END AS {name}" for name, (count, among, _, _) in RATES.items())
_LEAST_SQL = " ".join(f"WHEN '{name}' THEN {r[2]}" for name, r in RATES.items())
_FENCES_SQL = ", ".join([f"max(CASE WHEN rate = '{name}' THEN q3 + span END) AS {name}_most" for name in RATES] + [f"max(CASE WHEN rate = '{name}' THEN q1 - span END) AS {name}_least" for name, r in RATES.items() if r[3]])
_FAR_SQL = " OR ".join([f"coalesce(m.{name} > t.{name}_most, false)" for name in RATES] + [f"coalesce(m.{name} < t.{name}_least, false)" for name, r in RATES.items() if r[3]])
_CHOSEN_SQL = ", ".join(f"CASE WHEN o.rows >= 200 THEN o.{b} WHEN w.rows >= 200 THEN w.{b} ELSE a.{b} END AS {b}" for b in _bounds())


def _level_sql(keys: str) -> str:
    """Bounds of the groups of ``keys``, from the sketches."""
    some = f"{keys}, " if keys else ""
    running = f"""SELECT *, sum(n) OVER (PARTITION BY {some}rate ORDER BY bucket) AS upto, sum(n) OVER (PARTITION BY {some}rate) AS rows
      FROM (SELECT {some}rate, bucket, sum(n) AS n FROM sketch GROUP BY ALL)"""
    quartiles = f"""SELECT {some}rate, max(rows) AS rows, min(CASE WHEN upto * 4 >= rows THEN bucket END) AS q1,
      min(CASE WHEN upto * 4 >= rows * 3 THEN bucket END) AS q3 FROM ({running}) GROUP BY ALL"""
    spans = f"SELECT *, 4 * greatest(q3 - q1, CASE rate {_LEAST_SQL} END) AS span FROM ({quartiles})"
    return f"SELECT {some}max(rows) AS rows, {_FENCES_SQL} FROM ({spans}) GROUP BY {keys or 'true'}"


ORACLE = f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, lang, source, coalesce(text, '') AS t FROM documents),
w AS MATERIALIZED (SELECT r, unnest(ws) AS a, generate_subscripts(ws, 1) AS i FROM (SELECT r, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS ws FROM d)),
three AS (SELECT r, i, a, lead(a) OVER p AS b, lead(a, 2) OVER p AS c FROM w WINDOW p AS (PARTITION BY r ORDER BY i)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, a, b, c) AS n FROM three WHERE c IS NOT NULL) WHERE n > 1),
covered AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY r),
lines AS (SELECT r, count(*) AS n, count(*) - count(DISTINCT x) AS dup FROM (SELECT r, unnest(string_split(t, chr(10))) AS x FROM d)
          WHERE regexp_matches(x, '[^\\x20\\x09-\\x0D]') GROUP BY r),
words AS (SELECT r, count(*) AS n, sum(length(a)) AS chars FROM w GROUP BY r),
counted AS (SELECT doc_id, lang, source, CAST(coalesce(words.n, 0) AS BIGINT) AS n_words, CAST(coalesce(words.chars, 0) AS BIGINT) AS word_chars,
    CAST(length(t) - length(translate(t, '{SYMBOLS}', '')) AS BIGINT) AS n_symbols, CAST(coalesce(lines.dup, 0) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(covered.n, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(lines.n, 0) AS BIGINT) AS n_lines
  FROM d LEFT JOIN words USING (r) LEFT JOIN lines USING (r) LEFT JOIN covered USING (r)),
m AS MATERIALIZED (SELECT *, {_RATES_SQL} FROM counted),
sketch AS MATERIALIZED (SELECT lang, source, rate, CASE WHEN s > 0 THEN (v >> s) << s ELSE v END AS bucket, count(*) AS n
  FROM (SELECT *, CAST(length(bin(v)) - 9 AS INTEGER) AS s FROM (UNPIVOT (SELECT lang, source, {', '.join(RATES)} FROM m WHERE n_words > 0) ON {', '.join(RATES)} INTO NAME rate VALUE v)) GROUP BY ALL),
o AS ({_level_sql('lang, source')}), w1 AS ({_level_sql('lang')}), w0 AS ({_level_sql('')}),
t AS (SELECT o.lang, o.source, {_CHOSEN_SQL} FROM o JOIN w1 w ON o.lang IS NOT DISTINCT FROM w.lang JOIN w0 a ON true)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR {_FAR_SQL}) AS kept
FROM m LEFT JOIN t ON m.lang IS NOT DISTINCT FROM t.lang AND m.source IS NOT DISTINCT FROM t.source
"""
