"""Products: the SKU a name is sold under, labels, suggestions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tillscope.functions import text as T
from tillscope.operators.ranking import is_small, join_same, sent, with_running_total
from tillscope.session import materialize

GAP_LABEL = "(no product name)"


def name_skus(lines: DataFrame, scope: list[str]) -> DataFrame:
    """``(scope, name_id, one_sku)``: names whose would-be sale lines carry exactly one SKU."""
    sold = lines.filter(F.col("would_sell") & F.col("sku_id").isNotNull() & F.col("name_id").isNotNull())
    found = sold.groupBy(*scope, "name_id").agg(F.min("sku_id").alias("s0"), F.max("sku_id").alias("s1"))
    return found.filter("s0 = s1").select(*scope, "name_id", F.col("s0").alias("one_sku"))


def _product_names(lines: DataFrame, group: list[str]) -> DataFrame:
    """Per product its first line, first SKU and ``label``: the commonest name of its sale lines, else of all its lines, else its SKU.

    A tie goes to the name seen last, then alphabetically. Lines are reduced to one row per product; only products of several
    names have their lines counted by name.
    """
    text = F.col("product_label_text")
    seen = lines.groupBy(*group).agg(
        F.min("line_no").alias("first_line"), F.min(F.when(F.col("sku_label_text").isNotNull(), F.struct("line_no", "sku_label_text")))["sku_label_text"].alias("sku"),
        *[f(F.when(on, text)).alias(f"{tag}{i}") for tag, on in (("sold", F.col("sale")), ("other", ~F.col("sale"))) for i, f in enumerate((F.min, F.max))])
    names = materialize(seen.select(
        *group, "first_line", "sku", F.coalesce("sold0", "other0").alias("label"), F.col("sold0").isNotNull().alias("__sold"),
        F.coalesce(F.col("sold0") != F.col("sold1"), F.col("other0") != F.col("other1"), F.lit(False)).alias("__several")), "product-names")
    one, several = names.filter(~F.col("__several")).drop("__sold", "__several"), names.filter("__several")
    if not several.isEmpty():
        theirs = join_same(lines.filter(text.isNotNull()), sent(several.select(*group, "__sold")), group).filter("sale or not __sold")
        counts = theirs.groupBy(*group, "product_label_text").agg(F.count("*").alias("n"), F.max("txn_ts").alias("last"))
        # A name with no date comes after dated ones: nulls sort first, so they are pushed behind.
        best = F.struct(-F.col("n"), F.col("last").isNull(), -F.unix_micros(F.col("last").cast("timestamp")), text.alias("name"))
        counted = materialize(counts.groupBy(*group).agg(F.min(best)["name"].alias("label")), "commonest-names")
        one = one.unionByName(join_same(several.select(*group, "first_line", "sku"), counted, group, "left"))
    return one.withColumn("label", F.coalesce("label", "sku"))


# A label that may be another's numbered label: the other's text, a number from 2 on in brackets behind it.
_NUMBERED = r"(?s)^(.*) \(([1-9][0-9]{0,17})\)$"
_SUFFIXES = r"((?: \([1-9][0-9]{0,17}\))*)$"


def _claims(rows: pd.DataFrame) -> pd.DataFrame:
    """Which numbers of one text go to products that are named so, and how many of the text's own products come before each.

    ``rows`` has the numbers and how many of the text's own products had appeared before the product named so. It gets
    its number if those, and all that are moved behind lower numbers, do not reach it; once with the bare text free and once not.
    """
    rows = rows.sort_values("__number")
    out = {"__number": rows["__number"].to_numpy()}
    for x in (0, 1):
        passed, lost, slots = 0, [], []
        for number, earlier in zip(rows["__number"], rows["__earlier"], strict=True):
            wins = earlier + x + passed <= number - 1
            slots.append(number - x - passed if wins else None)
            lost.append(not wins)
            passed += wins
        out |= {f"__lost{x}": lost, f"__slot{x}": pd.array(slots, dtype="Int64")}
    return pd.DataFrame(out)


def _appearances(labels: DataFrame, links: DataFrame, group: list[str]) -> DataFrame:
    """``labels`` and ``links`` with ``__earlier``, the products of the same text that appeared before."""
    rows = labels.withColumn("__weight", F.lit(1)).unionByName(links.withColumn("__weight", F.lit(0)), allowMissingColumns=True)
    counts = rows.groupBy(*group, "first_line").agg(F.sum("__weight").alias("__weight"))
    before = with_running_total(counts, group, "first_line", "__weight").select(*group, "first_line", "before")
    tied = W.partitionBy(*group, "first_line").orderBy("product_key").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("__tied", F.coalesce(F.sum("__weight").over(tied), F.lit(0)))
    rows = join_same(rows, before, [*group, "first_line"]).withColumn("__earlier", F.col("before") + F.col("__tied"))
    return materialize(rows.drop("before", "__tied"), "label-order")


def _numbered(labels: DataFrame, scope: list[str]) -> DataFrame:
    """Labels that still collide get ``(2)``, ``(3)`` …: in order of first appearance each product takes the lowest free number.

    Products of one text (folded) take its numbers in turn. Only a product that is itself named like a numbered label can hold
    a number before, so what a text's k-th product gets is k, plus one if the bare text is gone, plus the numbers passed over,
    and all of them are told from ranks and counts in a fixed number of jobs, however many products share a name. Whether a bare
    text is gone may hang on the text without its last number; such chains end at the first text that does not hang.
    One task only ever holds the numbered names of one text, two whole numbers each. Without collisions nothing is ranked.
    """
    group = [*scope, "__base"]
    labels = labels.withColumn("__base", T.fold(F.col("shown")))
    # The gap's own label is never given to a product.
    gap = F.col("__base") == T.fold(F.lit(GAP_LABEL))
    # Texts are told apart by a hash first, which is all that moves if none is shared.
    hashes = labels.groupBy(F.xxhash64(*group).alias("__hash")).agg(F.count("*").alias("__products"), F.bool_or(gap).alias("__gap"))
    if hashes.filter("__products > 1 or __gap").isEmpty():
        return labels.drop("__base")
    labels = materialize(labels, "labels")
    bases = materialize(labels.groupBy(*group).agg(F.count("*").alias("__products"), F.min(F.struct("first_line", "product_key")).alias("__first")), "label-texts")
    crowded = bases.filter((F.col("__products") > 1) | gap)
    if not crowded.limit(1).count():
        return labels.drop("__base")

    number = F.regexp_extract("__base", _NUMBERED, 2)
    links = bases.filter(F.col("__base").rlike(_NUMBERED)).select(
        *scope, F.regexp_extract("__base", _NUMBERED, 1).alias("__base"), number.cast("long").alias("__number"), "__first.*").filter("__number > 1")
    links = materialize(join_same(links, bases.select(*group), group), "label-links")
    ranked = join_same(labels.select(*group, "first_line", "product_key"), crowded.select(*group).unionByName(links.select(*group)).distinct(), group)
    order = _appearances(ranked, links, group)

    fields = ", ".join(f"{c} {dict(labels.dtypes)[c]}" for c in group)
    said = "__number long, __lost0 boolean, __slot0 long, __lost1 boolean, __slot1 long"

    def settle(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        found = _claims(rows)
        for name, value in zip(group, key, strict=True):
            found[name] = value
        return found[[*group, "__number", "__lost0", "__slot0", "__lost1", "__slot1"]]

    asked = order.filter("__number is not null").select(*group, "__number", "__earlier")
    claims = materialize(asked.groupBy(*group).applyInPandas(settle, f"{fields}, {said}"), "label-claims")

    # Whether a text's bare form is gone when its first product appears: known, or as it is for the text it hangs on.
    hung = claims.select(*scope, F.concat("__base", F.lit(" ("), F.col("__number").cast("string"), F.lit(")")).alias("__base"), "__lost0", "__lost1")
    known = F.when(F.col("__lost0").isNull(), gap).when(F.col("__lost0") == F.col("__lost1"), F.col("__lost0"))
    states = materialize(join_same(bases.select(*group, "__products"), hung, group, "left").select(*group, "__products", known.alias("__gone")), "label-states")
    above = states.filter("__gone is null").select(*scope, F.col("__base").alias("__text"), F.explode(F.expr(
        f"sequence(1, size(split(regexp_extract(__base, r'{_SUFFIXES}', 1), '[)]')) - 1)")).alias("__depth"))
    stripped = F.regexp_replace("__text", F.concat(F.lit(r"(?: \([1-9][0-9]{0,17}\)){"), F.col("__depth").cast("string"), F.lit("}$")), F.lit(""))
    above = join_same(above.withColumn("__base", stripped), states.filter("__gone is not null").drop("__products"), group)
    above = above.groupBy(*scope, "__text").agg(F.min_by("__gone", "__depth").alias("__above")).withColumnRenamed("__text", "__base")
    states = join_same(states, above, group, "left").select(*group, "__products", F.coalesce("__gone", "__above").cast("int").alias("__gone"))

    # Numbers passed over on the way: each stands before the product that would have taken it.
    slot = F.when(F.col("__gone") == 1, F.col("__slot1")).otherwise(F.col("__slot0"))
    slots = join_same(claims, states, group).withColumn("__slot", slot).filter("__slot <= __products").select(*group, "__slot")
    own = order.filter("__number is null").select(*group, "product_key", (F.col("__earlier") + 1).alias("__rank"))
    steps = slots.select(*group, (F.col("__slot") * 2 - 1).alias("__step"), F.lit(1).alias("__weight"))
    passing = join_same(own, slots.select(*group).distinct(), group).select(*group, (F.col("__rank") * 2).alias("__step"), F.lit(0).alias("__weight"))
    steps = steps.unionByName(passing).groupBy(*group, "__step").agg(F.sum("__weight").alias("__weight"))
    passed = with_running_total(steps, group, "__step", "__weight").filter("__step % 2 = 0").select(*group, (F.col("__step") / 2).cast("long").alias("__rank"), "before")
    own = join_same(own, passed, [*group, "__rank"], "left").select(*group, "product_key", "__rank", "before")
    named = join_same(join_same(labels, own, [*group, "product_key"], "left"), states.drop("__products"), group)
    place = F.coalesce("__rank", F.lit(1)) + F.col("__gone") + F.coalesce("before", F.lit(0))
    text = F.when(place > 1, F.concat("shown", F.lit(" ("), place.cast("string"), F.lit(")"))).otherwise(F.col("shown"))
    return materialize(named.withColumn("shown", text).drop("__base", "__rank", "before", "__gone"), "numbered-labels")


def product_labels(lines: DataFrame, scope: list[str] | None = None) -> DataFrame:
    """``(scope, product_key, product_label)``, every label different within its scope.

    The commonest name of the product's sale lines, else of all its lines, else its SKU; names two
    products share get the SKU, what still collides a number.
    """
    scope = scope or []
    group = [*scope, "product_key"]
    names = _product_names(lines.filter(F.col("product_key").isNotNull()), group)
    folded = names.withColumn("__fold", T.fold(F.col("label")))
    shared = folded.groupBy(*scope, "__fold").agg(F.count("*").alias("__products")).filter("__products > 1")
    shared = materialize(shared.select(*scope, "__fold", F.lit(True).alias("__shared")), "shared-names")
    gap = F.col("__fold") == T.fold(F.lit(GAP_LABEL))
    clash = F.col("__shared").isNotNull() | gap
    shown = (
        F.when(clash & F.col("sku").isNotNull(), F.concat("label", F.lit(" ("), F.col("sku"), F.lit(")")))
        .when(gap, F.concat("label", F.lit(" (named product)"))).otherwise(F.col("label"))
    )
    small = is_small(shared)
    named = join_same(folded, F.broadcast(shared) if small else shared, [*scope, "__fold"], "left").select(*group, "first_line", shown.alias("shown"))
    # Names that had to move to be compared are not moved a second time.
    return _numbered(named if small else materialize(named, "shown-names"), scope).select(*group, F.col("shown").alias("product_label"))


def product_suggestions(lines: DataFrame, scope: list[str] | None = None) -> DataFrame:
    """Per product the unconfirmed class its own key carries."""
    scope = scope or []
    own = lines.filter((F.col("product_key") == F.col("item_key")) & F.col("suggested_class").isNotNull())
    return own.groupBy(*scope, "product_key").agg(F.min_by("suggested_class", "line_no").alias("suggested_class"))
