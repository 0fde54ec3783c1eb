"""The corpus queries, each over its whole table with production parameters, and their SQL."""

from __future__ import annotations

from trailweave.llm.bpe import byte_bpe
from trailweave.llm.common import table
from trailweave.llm.divergence import source_divergence
from trailweave.llm.exact_dedup import exact_dedup
from trailweave.llm.license_scan import license_scan
from trailweave.llm.line_dedup import line_dedup
from trailweave.llm.minhash import minhash_dedup
from trailweave.llm.packing import pack
from trailweave.llm.quality import quality_rules
from trailweave.llm.runs import periodic_runs, planted, run_digest
from trailweave.llm.sharding import shard_rows
from trailweave.llm.simhash import simhash_dedup
from trailweave.llm.toxicity import toxicity
from trailweave.llm.url_filter import url_filter


def vocabulary(name: str) -> str:
    """Place of a public vocabulary file; imported late, so that other queries do without."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_exact_dedup(spark, sf_dir):
    return exact_dedup(table(spark, sf_dir, "documents"))


def op2_license_scan(spark, sf_dir):
    return license_scan(table(spark, sf_dir, "documents"))


def op3_simhash(spark, sf_dir):
    return simhash_dedup(table(spark, sf_dir, "documents"))


def op4_url_filter(spark, sf_dir):
    return url_filter(table(spark, sf_dir, "pages"))


def op5_quality_rules(spark, sf_dir):
    return quality_rules(table(spark, sf_dir, "documents"))


def op6_packing(spark, sf_dir):
    return pack(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op7_sharding(spark, sf_dir):
    return shard_rows(table(spark, sf_dir, "documents"))


def op8_toxicity(spark, sf_dir):
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_line_dedup(spark, sf_dir):
    return line_dedup(table(spark, sf_dir, "documents"))


def op10_byte_bpe(spark, sf_dir):
    import public_tokenizers

    return byte_bpe(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op11_minhash(spark, sf_dir):
    return minhash_dedup(table(spark, sf_dir, "documents"))


def op12_periodic_runs(spark, sf_dir):
    return run_digest(periodic_runs(planted(table(spark, sf_dir, "documents"))))


def op13_source_divergence(spark, sf_dir):
    return source_divergence(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_exact_dedup, op2_license_scan, op3_simhash, op4_url_filter, op5_quality_rules, op6_packing, op7_sharding, op8_toxicity, op9_line_dedup, op10_byte_bpe, op11_minhash, op12_periodic_runs, op13_source_divergence)}

FOLDED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLES = {
    "op1_exact_dedup": f"""
        WITH d AS (SELECT doc_id, sha256({FOLDED}) AS text_sha256 FROM documents)
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, text_sha256
        FROM d WINDOW w AS (PARTITION BY text_sha256)""",
    "op13_source_divergence": f"""
        WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all({FOLDED}, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS terms FROM documents),
        groups AS (SELECT DISTINCT lang, source FROM d),
        kept AS (SELECT lang, term FROM (SELECT lang, unnest(list_distinct(terms)) AS term FROM d) GROUP BY ALL HAVING count(*) >= 10),
        found AS (SELECT lang, source, term, count(*) AS n FROM (SELECT lang, source, unnest(terms) AS term FROM d) SEMI JOIN kept USING (lang, term) GROUP BY ALL),
        every AS (SELECT lang, source, term, coalesce(n, 0) AS n FROM groups JOIN kept USING (lang) LEFT JOIN found USING (lang, source, term)),
        shares AS (SELECT lang, source, term, n, 1 + (1000000000::HUGEINT * (n + 2)) // (sum(n) OVER (PARTITION BY lang, source) + 2 * count(*) OVER (PARTITION BY lang, source)) AS p FROM every),
        totals AS (SELECT lang, term, sum(n) AS n FROM every GROUP BY ALL),
        whole AS (SELECT lang, term, 1 + (1000000000::HUGEINT * (n + 2)) // (sum(n) OVER (PARTITION BY lang) + 2 * count(*) OVER (PARTITION BY lang)) AS q FROM totals),
        pairs AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value FROM shares a JOIN shares b USING (lang, term)
          WHERE a.source <> b.source GROUP BY ALL),
        linked AS (SELECT a.lang, a.source, b.source AS item, coalesce(value, 0) AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
          LEFT JOIN pairs ON pairs.lang = a.lang AND pairs.source = a.source AND pairs.item = b.source),
        above AS (SELECT lang, source, term AS item, ((p - q) * (p - q)) // (p + q) AS value FROM shares JOIN whole USING (lang, term) WHERE n > 0 AND p > q),
        ranked AS (SELECT 'pair' AS part, * FROM linked UNION ALL SELECT 'term', * FROM above)
        SELECT * FROM (SELECT lang, source, part, item, CAST(value AS BIGINT) AS value,
          CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM ranked) WHERE part = 'pair' OR rank <= 10""",
}
