"""Column functions on generated text: numbers, claims, bullets, urgencies."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailweave.operators.common import settle

#: What counts as a number when claims are checked, and when they are scrubbed; the white space and
#: the marks that are tidied after a number is gone; words of a category and the section it is checked against.
NUMBER = r"\b\d{1,3}(?:,\d{3})+(?:\.\d+)?\b|\b\d+(?:\.\d+)?\b"
TOKEN = r"\d+(?:[.,]\d+)?"
SPACES = r"[ \t\n\r\f\x0B]"
TIDIED_MARKS = "([.,;:%])"
SECTION_WORDS = (
    ("traffic", ("tráfego", "traffic")),
    ("funnel", ("conversão", "conversion", "funil")),
    ("dwell", ("permanência", "dwell", "zona")),
    ("anomalies", ("anomalia", "anomaly")),
)
TOLERANCE = 0.10
URGENCIES = ("imediata", "esta_semana", "proximo_mes")
DEFAULT_URGENCY = "esta_semana"


def numbers(text: Column) -> Column:
    """All numbers of a text as doubles, thousands commas dropped."""
    found = F.regexp_extract_all(text, F.lit(NUMBER), F.lit(0))
    return F.transform(found, lambda t: F.replace(t, F.lit(","), F.lit("")).cast("double"))


def verified(number: Column, values: Iterable[float]) -> Column:
    """Within a tenth of some value; zero always is."""
    ok = number == 0.0
    for v in values:
        ok = ok | (F.abs(number) <= TOLERANCE if v == 0 else F.abs(number - v) / abs(v) <= TOLERANCE)
    return ok


def is_verified(number: float, values: Iterable[float]) -> bool:
    return number == 0 or any(abs(number) <= TOLERANCE if v == 0 else abs(number - v) / abs(v) <= TOLERANCE for v in values)


def tidy(text: Column) -> Column:
    text = F.regexp_replace(text, SPACES + "{2,}", " ")
    return F.trim(F.regexp_replace(text, SPACES + "+" + TIDIED_MARKS, "$1"))


def strip_numbers(text: Column) -> Column:
    return tidy(F.regexp_replace(text, TOKEN, ""))


def sanitize(text: str, values: list[float], whole_tokens: bool = False) -> str:
    """Drops the numbers that can't be verified. ``whole_tokens``: leave digits glued to letters alone."""

    def keep(m: re.Match) -> str:
        if whole_tokens and (text[: m.start()][-1:].isalnum() or text[: m.start()][-1:] == "_"):
            return m[0]
        return m[0] if is_verified(float(m[0].replace(",", ".")), values) else ""

    return tidied(re.sub(TOKEN, keep, text))


def tidied(text: str) -> str:
    return re.sub(r"\s+" + TIDIED_MARKS, r"\1", re.sub(r"\s{2,}", " ", text)).strip()


def sanitize_column(text: Column, values: Iterable[float], whole_tokens: bool = False) -> Column:
    """``sanitize`` as built-ins: the text is split at its number tokens, those that stay go back to their places.
    Digits are ASCII digits."""
    tokens, between = F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), F.split(text, TOKEN, -1)

    def piece(token: Column, i: Column) -> Column:
        before = F.get(between, i)
        keep = verified(F.replace(token, F.lit(","), F.lit(".")).cast("double"), list(values))
        if whole_tokens:
            keep = keep | before.rlike(r"[\p{L}\p{N}_]\z")
        return F.concat(before, F.when(keep, token).otherwise(""))

    joined = F.concat(F.array_join(F.transform(tokens, piece), ""), F.get(between, F.size(tokens)))
    return F.regexp_replace(tidy(joined), f"^{SPACES}+|{SPACES}+$", "")


def first_object(text: Column) -> Column:
    """The first JSON object in an answer that parses and is not empty, as JSON text, whatever stands around it: a
    fence, chatter, braces that are none. Null if there is none."""
    starts = F.regexp_extract_all(text, F.lit(r"(?s)(?=(\{.*))"), 1)
    return F.get(F.filter(F.transform(starts, lambda x: F.get_json_object(x, "$")), lambda x: x.isNotNull() & (x != "{}")), 0)


def flat_numbers(docs: DataFrame, document: str, depth: int = 64) -> DataFrame:
    """One row (the other columns and ``number``) for each number in a JSON text, nested ones and those inside strings
    included; truth values, nulls and keys are none. Text that is no JSON gives no rows. Each step opens one
    level of all documents, so there are as many steps as the deepest has levels, at most ``depth``. What a step leaves
    closed is settled, so that no level is opened again for those below it."""
    keys = [c for c in docs.columns if c != document]
    v, found = docs.select(*keys, F.try_parse_json(document).alias("_v")).where("_v is not null"), None
    for _ in range(depth):
        v = v.withColumn("_kind", F.schema_of_variant("_v"))
        text = F.when(F.col("_kind") == "STRING", F.try_variant_get("_v", "$", "string"))
        number = F.when(F.col("_kind").rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"), F.try_variant_get("_v", "$", "double"))
        leaf = v.where(text.isNotNull() | number.isNotNull()).select(*keys, F.explode(F.coalesce(numbers(text), F.array(number))).alias("number"))
        found = leaf if found is None else found.unionByName(leaf)
        inner = settle(v.where(F.col("_kind").rlike("^(OBJECT|ARRAY)")).select(*keys, "_v"))
        if inner.isEmpty():
            return found
        v = inner.lateralJoin(docs.sparkSession.tvf.variant_explode(F.col("_v").outer())).select(*keys, F.col("value").alias("_v"))
    raise ValueError(f"documents are nested deeper than {depth} levels")


def bullets(text: Column, n: int = 3) -> Column:
    """The first n sentences, padded by empty ones."""
    parts = F.filter(F.transform(F.split(text, r"(?<=[.!?])\s+"), F.trim), lambda s: s != "")
    return F.slice(F.concat(F.coalesce(parts, F.array().cast("array<string>")), F.array_repeat(F.lit(""), n)), 1, n)


def urgency(raw: Column) -> Column:
    clean = F.lower(F.trim(raw))
    return F.when(clean.isin(*URGENCIES), clean).otherwise(DEFAULT_URGENCY)


def urgency_rank(value: Column) -> Column:
    rank = F.lit(len(URGENCIES))
    for i, u in enumerate(URGENCIES):
        rank = F.when(value == u, i).otherwise(rank)
    return rank


def confidence(raw: Column) -> Column:
    x = raw.try_cast("double")
    return F.when(x.between(0.0, 1.0), F.floor(x * 10000 + 0.5) / 10000).otherwise(0.5)


def context_section(category: Column) -> Column:
    """Which section of the metrics an insight is checked against."""
    c, section = F.lower(category), F.lit("all")
    for name, words in reversed(SECTION_WORDS):
        found = F.lit(False)
        for w in words:
            found = found | c.contains(w)
        section = F.when(found, name).otherwise(section)
    return section


def escape_pipes(text: Column) -> Column:
    return F.replace(text, F.lit("|"), F.lit("\\|"))
