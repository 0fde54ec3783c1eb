"""Numeric checks of generated insights as DataFrame plans: many answers at once, against the few numbers of a
metrics document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailweave.functions import text as tx
from trailweave.functions.scalar import round_even

SAFE_PRECISION = 0.90


def known_number(number: Column, section: Column, metrics: dict[str, list[float]]) -> Column:
    """Whether a number is verified by its section's numbers; by all of them where the section is unknown or
    'all'. ``metrics`` has some tens of numbers."""
    every = [x for values in metrics.values() for x in values]
    ok = F.when(F.lit(False), F.lit(False))
    for name, values in metrics.items():
        ok = ok.when(section == name, tx.verified(number, values))
    return ok.otherwise(tx.verified(number, every))


def precision_of(items: DataFrame, keys: list[str], metrics: dict[str, list[float]]) -> DataFrame:
    """``items``: keys, section, text. For each key the share of verified numbers (1 without numbers), rounded to 4
    digits, and how many there are and are not verified."""
    number = F.explode_outer(tx.numbers(F.col("text"))).alias("number")
    each = items.select(*keys, "section", number).withColumn("ok", known_number(F.col("number"), F.col("section"), metrics))
    found, good = F.count("number"), F.count_if(F.col("number").isNotNull() & F.col("ok"))
    out = each.groupBy(*keys).agg(found.alias("n_numbers"), (found - good).alias("n_unverified"))
    share = (F.col("n_numbers") - F.col("n_unverified")) / F.col("n_numbers")
    return out.withColumn("precision", F.when(F.col("n_numbers") == 0, 1.0).otherwise(round_even(share, 4)))


def flat_check(answers: DataFrame, keys: list[str], metrics: dict[str, list[float]]) -> DataFrame:
    """The whole answer against the whole metrics document. ``answers``: keys, text."""
    return precision_of(answers.withColumn("section", F.lit("all")), keys, metrics)


def structured_check(items: DataFrame, keys: list[str], metrics: dict[str, list[float]]) -> DataFrame:
    """Each insight against its category's section. ``items``: keys, category (null: a summary), text."""
    return precision_of(items.withColumn("section", F.coalesce(tx.context_section(F.col("category")), F.lit("all"))), keys, metrics)


def choose_strategy(scores: DataFrame, doc: str) -> DataFrame:
    """``scores``: doc, strategy, precision. The better strategy of each document; zero_shot wins ties."""
    best = F.max_by(F.struct("strategy", "precision"), F.struct("precision", F.col("strategy") == "zero_shot"))
    return scores.groupBy(doc).agg(best.alias("x")).select(doc, "x.strategy", "x.precision")


def with_fallback(items: DataFrame, chosen: DataFrame, doc: str, least: float = SAFE_PRECISION) -> DataFrame:
    """The chosen strategy's items; where its precision is short of ``least``, all numbers are removed."""
    out = items.join(chosen, [doc, "strategy"])
    text = F.when(F.col("precision") < least, tx.strip_numbers(F.col("text"))).otherwise(F.col("text"))
    return out.withColumn("text", text).withColumn("stripped", F.col("precision") < least)


def of_section(items: DataFrame, doc: str, section: str, sections: tuple[tuple[str, tuple[str, ...]], ...]) -> DataFrame:
    """The items that one section of a report shows, with all their columns."""
    wanted = tuple(x for x in sections if x[0] == section)
    return items.join(section_items(items, doc, wanted).select(doc, "item"), [doc, "item"], "left_semi")


def section_items(items: DataFrame, doc: str, sections: tuple[tuple[str, tuple[str, ...]], ...]) -> DataFrame:
    """Items of each report section: those whose category is one of its words or, if a document has none such,
    those whose category or title holds one. ``items``: doc, item, category, title. Adds ``section``."""
    c, both = F.lower("category"), F.lower(F.concat_ws(" ", "category", "title"))

    def holds(words: tuple[str, ...]) -> Column:
        found = F.lit(False)
        for w in words:
            found = found | both.contains(w)
        return found

    own = F.array_compact(F.array(*[F.when(c.isin(*words), F.lit(name)) for name, words in sections]))
    loose = F.array_compact(F.array(*[F.when(holds(words), F.lit(name)) for name, words in sections]))
    own_rows = items.select(doc, "item", F.explode(own).alias("section"))
    has = own_rows.select(doc, "section").distinct()
    rest = items.select(doc, "item", F.explode(loose).alias("section")).join(has, [doc, "section"], "left_anti")
    return own_rows.unionByName(rest)


def numeric_precision_pct(document: Column) -> Column:
    """Audit figure of an insights document (JSON text): few-shot before zero-shot, 100 if it has neither, 0 if there
    is no document."""
    few, zero = (F.get_json_object(document, f"$.hallucination_report.numeric_precision_{n}").cast("double") for n in ("few_shot", "zero_shot"))
    return F.when(document.isNull(), 0.0).otherwise(round_even(F.coalesce(few, zero, F.lit(1.0)) * 100.0, 2))
