"""Quality rules: counts and verdicts against plain Python, sketches against exact quantiles."""

import random
import re
from collections import Counter

from corpora import texts, with_clashes, words
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tillscope.llm import quality

SCHEMA = "doc_id long, text string, lang string, source string"
WORD = re.compile("[^\x20\x09-\x0d]+")


def counts(text):
    found = WORD.findall(text or "")
    windows = list(zip(found, found[1:], found[2:], strict=False))
    often = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(found), sum(map(len, found)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered), len(lines)


def bucket(v, bits):
    drop = max(v.bit_length() - bits, 0)
    return v >> drop << drop


def brute(rows, rules):
    measured = [(i, lang, source, counts(t)) for i, t, lang, source in rows]
    names = dict(zip(quality.COUNTS, range(6), strict=True))
    rates = lambda c: {r: 1000 * c[names[a]] // c[names[b]] for r, (a, b, _, _) in quality.RATES.items()}

    def fences(of):
        out = {}
        for r, (_, _, least, low) in quality.RATES.items():
            values = sorted(bucket(rates(c)[r], rules.bits) for c in of)
            q1, q3 = values[-(-len(values) // 4) - 1], values[-(-3 * len(values) // 4) - 1]
            span = rules.reach * max(q3 - q1, least)
            out[r] = (q1 - span if low else -1, q3 + span)
        return out

    groups = {}
    for _, lang, source, c in measured:
        if c[0]:
            for g in ((lang, source), (lang,), ()):
                groups.setdefault(g, []).append(c)
    limits = {g: fences(of) for g, of in groups.items()}
    out = []
    for i, lang, source, c in measured:
        failed = c[0] < rules.least_words or 100 * c[4] > rules.most_repeated * c[0]
        kept = not failed
        if kept:
            g = next(g for g in ((lang, source), (lang,), ()) if not g or len(groups[g]) >= rules.group_rows)
            kept = all(limits[g][r][0] <= v <= limits[g][r][1] for r, v in rates(c).items())
        out.append((i, *c[:5], failed, kept))
    return sorted(out, key=str)


def corpus(seed=1):
    rng = random.Random(seed)
    rows = [(i, t, "en", "s") for i, t in texts(seed)]
    for i in range(300):
        lang, source = rng.choice(["en", "de", None]), rng.choice(["s", "s", "s", "t", None, f"rare{i}"])
        text = words(rng, rng.randint(40, 160))
        if i % 11 == 0:
            text = text.replace(" ", "# ")
        if i % 13 == 0:
            text += ("\n" + words(rng, 4)) * 30
        if i % 17 == 0:
            text = "\n".join([text[:80]] * 3 + [text])
        if i % 19 == 0:
            text = text.replace(" ", "longer ")
        rows.append((1_000 + i, text, lang, source))
    return rows + [(3_000, " ".join(f"w{i}" for i in range(40_000)) + " w1 w2 w3", "en", "s"), (3_001, "x y z " * 9_000, "fr", "u"), (3_002, "a b c\x0bd\x0ce\rf　g\xa0h", "de", "t")]


def test_verdicts_equal_brute_force(spark):
    rows = corpus()
    df = with_clashes(spark.createDataFrame(rows, SCHEMA).repartition(4).withColumns({"slice": F.lit("x"), "rate": F.lit("x"), "bucket": F.lit(1), "level": F.lit("x"), "n_words": F.lit("x"), "of_lang": F.lit(1)}))
    for rules in (quality.Rules(), quality.Rules(group_rows=20), quality.Rules(group_rows=1, bits=4, reach=1, slices=2)):
        found = sorted(map(tuple, quality.verdicts(df, rules).collect()), key=str)
        assert found == brute(rows, rules)
    kept = dict(quality.verdicts(df, quality.Rules(group_rows=20)).select("doc_id", "kept").where("doc_id >= 1000").collect())
    plain = [1_000 + i for i, (_, t, _, _) in enumerate(r for r in rows if 1_000 <= (r[0] or 0) < 3_000) if all(i % k for k in (11, 13, 17, 19)) and len(t.split()) >= 50]
    assert sum(kept[i] for i in plain) >= 0.99 * len(plain)
    assert not any(kept[1_000 + i] for i in range(0, 300, 11))


def test_reasons_and_levels(spark):
    found = quality.assess(spark.createDataFrame(corpus(), SCHEMA), quality.Rules(group_rows=20))
    assert {r["level"] for r in found.collect()} == {0, 1, 2}
    assert found.where("kept and size(reasons) > 0").count() == 0
    assert "symbols" in found.where("doc_id = 1000").first()["reasons"]


def test_empty_and_wordless_tables(spark):
    df = spark.createDataFrame([(1, None, None, None), (2, "", "en", "s"), (2, " \n ", "en", "s")], SCHEMA)
    assert sorted(map(tuple, quality.verdicts(df).collect())) == [(1, 0, 0, 0, 0, 0, True, False), (2, 0, 0, 0, 0, 0, True, False), (2, 0, 0, 0, 0, 0, True, False)]
    assert quality.verdicts(df.limit(0)).count() == 0


@settings(max_examples=30, deadline=None)
@given(st.lists(st.lists(st.integers(0, 10**12), min_size=1, max_size=60), min_size=1, max_size=4))
def test_sketches_merge_and_bound_the_error(parts):
    rules = quality.Rules()
    merged = sum((Counter(bucket(v, rules.bits) for v in p) for p in parts), Counter())
    values = sorted(v for p in parts for v in p)
    assert merged == Counter(bucket(v, rules.bits) for v in values)
    for q in (1, 2, 3):
        at = -(-q * len(values) // 4) - 1
        near = sorted(merged.elements())[at]
        assert near <= values[at] <= near * (1 + 2 ** (1 - rules.bits))


def test_bucket_column(spark):
    values = [0, 1, 511, 512, 513, 1_023, 1_024, 1_027, 10**12, (1 << 62) + 12_345]
    df = spark.createDataFrame([(v,) for v in values], "v long").select(quality.bucket(F.col("v"), 9).alias("b"))
    assert [r["b"] for r in df.collect()] == [bucket(v, 9) for v in values]
