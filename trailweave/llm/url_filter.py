"""URL filtering by rules, and beyond them by the ratio of two character models.

The urls that rules allow and those that rules block train one variable-order Markov model each, smoothed
by interpolation from order 0 up to ORDER (each order weighs its counts against the number of different
followers). Models read the whole url. An url outside the rules gets the difference of its log likelihoods by
character under models of all seeds; the threshold that decides is calibrated with models of four fifths of the
seeds on the fifth that they have not seen.

Models live in tables, not in memory: only tables bounded by the alphabet (contexts of 2 characters at
most) or by a share of all occurrences are broadcast.
"""

from __future__ import annotations

from math import sqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailweave.llm.common import fold_ascii, settle

ORDER = 5
#: Characters that models tell apart; any other is one more, as are the start and the end.
PLAIN = "a-z0-9./_%=&+:-"
SYMBOLS = 26 + 10 + 9 + 3
#: A gram with at least 1 in HOT of all occurrences is broadcast for scoring: at most HOT grams.
HOT = 10_000
HELD_OUT = 5

RULES = (
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
)


def parts(url: Column) -> tuple[Column, Column]:
    """Host in lower case (A-Z) and path; both empty without '://'."""
    host, path = (F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)", i), F.lit("")) for i in (1, 2))
    return fold_ascii(host), path


def by_rules(rules=RULES) -> tuple[Column, Column]:
    """Rule and its verdict for columns host and path: the longest rule that fits; else nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for says, text in sorted(rules, key=lambda r: len(r[1])):  # the longest is put on last, and so asked first
        host, slash, path = text.partition("/")
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(slash + path)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def grams(urls: DataFrame, *keep) -> DataFrame:
    """One row for each character and the end: the character behind its ORDER predecessors. One walk over the url
    finds them all, so a long url takes linear time."""
    padded = F.concat(F.lit("^" * ORDER), F.col("plain"), F.lit("$"))
    return urls.select(*keep, F.explode(F.regexp_extract_all(padded, F.lit(f"(?s)(?=(.{{{ORDER + 1}}}))"), 1)).alias("gram"))


def weighed(table: DataFrame) -> DataFrame:
    """``table``: gram, allowed, blocked (counts). Adds ``ratio``, the difference of the two log
    likelihoods in millionths, as a long so that sums don't depend on their order."""
    out = table.select("gram", "uses", F.lit(1.0 / SYMBOLS).alias("pa"), F.lit(1.0 / SYMBOLS).alias("pb"))
    out = out.withColumn("char", F.substr("gram", F.lit(ORDER + 1), F.lit(1)))
    for k in range(ORDER + 1):
        context = F.substr("gram", F.lit(ORDER + 1 - k), F.lit(k)) if k else F.lit("")
        pair = table.groupBy(context.alias("context"), F.substr("gram", F.lit(ORDER + 1), F.lit(1)).alias("char"))
        pair = pair.agg(F.sum("allowed").alias("a"), F.sum("blocked").alias("b"))
        model = pair.groupBy("context").agg(
            F.sum("a").alias("na"),
            F.sum("b").alias("nb"),
            F.count_if(F.col("a") > 0).alias("ta"),
            F.count_if(F.col("b") > 0).alias("tb"),
            F.map_from_entries(F.collect_list(F.struct("char", F.struct("a", "b")))).alias("by_char"),
        )
        model = F.broadcast(model) if k <= 2 else model
        out = out.withColumn("context", context).join(model, "context", "left")
        seen = F.try_element_at("by_char", F.col("char"))
        for p, n, t, count in (("pa", "na", "ta", seen["a"]), ("pb", "nb", "tb", seen["b"])):
            mixed = (F.coalesce(count, F.lit(0)) + F.col(t) * F.col(p)) / (F.col(n) + F.col(t))
            out = out.withColumn(p, F.when(F.col(n) > 0, mixed).otherwise(F.col(p)))
        out = out.select("gram", "uses", "char", "pa", "pb")
    return out.select("gram", "uses", F.round((F.log("pa") - F.log("pb")) * 1e6).cast("long").alias("ratio"))


def threshold(scored: DataFrame) -> int | None:
    """Where both classes are equally many standard deviations away, over seeds held out of training (over
    all seeds if a class has none held out); None if a class has no seeds at all."""
    sums = []
    for name in ("allowed", "blocked"):
        n, x = F.col(name), F.call_function("div", F.col("score"), F.lit(1000))
        for held in (F.col("held"), F.lit(True)):
            w = F.when(held, n).otherwise(0)
            sums += [F.sum(w), F.sum(w * x), F.sum(w * x * x)]
    row, found = scored.agg(*[s.alias(f"s{i}") for i, s in enumerate(sums)]).first(), []
    for i in (0, 6):
        n, s, q = row[i : i + 3] if row[i] else row[i + 3 : i + 6]
        if not n:
            return None
        found.append((s / n, sqrt(max(q / n - (s / n) ** 2, 0))))
    (ma, da), (mb, db) = found
    return round(1000 * ((ma * db + mb * da) / (da + db) if da + db else (ma + mb) / 2))


def scores(strings: DataFrame, allowed: Column, blocked: Column, of: Column | None = None) -> DataFrame:
    """(plain, score) of the strings, or those ``of`` is true for, under models of all strings with these counts."""
    counts = grams(strings, allowed.alias("allowed"), blocked.alias("blocked")).groupBy("gram").agg(
        F.sum("allowed").alias("allowed"), F.sum("blocked").alias("blocked"), F.count("*").alias("uses")
    )
    ratios = settle(weighed(settle(counts)))
    total = ratios.agg(F.sum("uses")).first()[0] or 0
    hot = F.col("uses") * HOT >= total
    each = grams(strings if of is None else strings.where(of), "plain").join(F.broadcast(ratios.where(hot).select("gram", "ratio")), "gram", "left")
    cold = each.where("ratio is null").drop("ratio").join(ratios.where(~hot).select("gram", "ratio"), "gram")
    each = each.where("ratio is not null").unionByName(cold)
    return settle(each.groupBy("plain").agg(F.call_function("div", F.sum("ratio"), F.count("*")).alias("score")))


def url_filter(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict and score (millionths of a nat by character; null under a rule).

    A null url, or one without '://', has an empty host and path and is judged by the models; null counts as an
    empty url. Without seeds of both kinds, urls outside the rules are allowed. Repeated urls count as often as
    they come but are scored once; urls of any length are read whole; null and repeated ids pass through; an
    empty table gives an empty result; other columns are ignored.
    """
    host, path = parts(F.col("url"))
    plain = F.regexp_replace(fold_ascii(F.coalesce(F.col("url"), F.lit(""))), f"[^{PLAIN}]", "*")
    urls = pages.select("page_id", host.alias("host"), path.alias("path"), plain.alias("plain"))
    rule, verdict = by_rules(rules)
    urls = urls.withColumn("rule", rule).withColumn("said", verdict)
    strings = settle(
        urls.groupBy("plain").agg(
            F.count_if(F.col("said") == "allow").alias("allowed"), F.count_if(F.col("said") == "block").alias("blocked")
        ).withColumn("held", F.crc32("plain") % HELD_OUT == 0)
    )
    train = [F.when(F.col("held"), 0).otherwise(F.col(c)) for c in ("allowed", "blocked")]
    seeds = F.col("allowed") + F.col("blocked") > 0
    cut = threshold(scores(strings, *train, of=seeds).join(strings, "plain"))
    scored = scores(strings, F.col("allowed"), F.col("blocked"))
    judged = F.lit("allow") if cut is None else F.when(F.col("score") >= cut, "allow").otherwise("block")
    return urls.join(scored, "plain").select(
        "page_id",
        "host",
        "path",
        "rule",
        F.coalesce("said", judged).alias("verdict"),
        F.when(F.col("rule").isNull(), F.col("score")).alias("score"),
    )
