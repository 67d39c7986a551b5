"""The registered query of each corpus operator, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skerry.llm import bpe, htmltext, interpolation, packing, quality, simhash, suffixdedup, topk, urls, warc

Query = Callable[[SparkSession, str], DataFrame]


def _read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def op4_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    judged = quality.with_metrics(_read(spark, folder, "documents").select("doc_id", "text"), into="q")
    failed = quality.base_failed("q")
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return judged.select("doc_id", *[F.col(f"q.{n}") for n in names], failed.alias("base_failed"), (~failed & quality.verdict("q")).alias("kept"))


def _vocabulary(name: str) -> str:
    """A file of the public tokenizers; they are read where they are installed, on every executor."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    docs = _read(spark, folder, "documents").select("doc_id", "text")
    return packing.pack(docs, _vocabulary("byte_bpe_50k.json"), _vocabulary("byte_bpe_50k.tiktoken"), added=True)


def op2_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    """Labels of a page are those of the document with its number: bad is of low quality or toxic."""
    bad = (F.coalesce("quality", F.lit(1)) == 0) | (F.coalesce("toxic", F.lit(0)) == 1)
    labels = _read(spark, folder, "labels").select(F.col("doc_id").alias("page"), bad.alias("bad"))
    return urls.judge_urls(_read(spark, folder, "pages"), labels).select("page_id", "host", "path", "rule", "verdict")


def op7_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    found = htmltext.extract(_read(spark, folder, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op8_warc_derivatives(spark: SparkSession, folder: str) -> DataFrame:
    found = warc.derivatives(warc.page_responses(_read(spark, folder, "pages")), key="page_id")
    return found.select("page_id", "kind", "record_id", "refers_to", "target_uri", "date", "content_type", "content_length", "block_digest", "source_payload_digest", F.sha2("record", 256).alias("record_sha256"))


def op5_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = suffixdedup.remove_repeats(_read(spark, folder, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_bytes", "n_removed", F.size("starts").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op6_simhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.near_duplicates(_read(spark, folder, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id"))


def op9_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    docs = _read(spark, folder, "documents").select("doc_id", "text")
    coded = bpe.encode(docs, _vocabulary("byte_bpe_multi_50k.tiktoken"))
    ids = (F.octet_length("ids") / 4).cast("long")
    return coded.select("doc_id", ids.alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op10_exact_top_k(spark: SparkSession, folder: str) -> DataFrame:
    return topk.exact_top_k(_read(spark, folder, "embeddings"))


def op3_lm_scoring(spark: SparkSession, folder: str) -> DataFrame:
    return interpolation.score(_read(spark, folder, "documents").select("doc_id", "text"))


_STOP = ", ".join(f"'{form}'" for form in sorted({f for g in quality.STOP_WORDS.values() for w in g for f in (w, w.capitalize())}))

OP4_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS ws,
             list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\\x20\\x09-\\x0D]')) AS ls FROM d),
win AS (SELECT doc_id, unnest(range(1, len(ws) - 1)) AS i, ws FROM w WHERE len(ws) >= 3),
tri AS (SELECT doc_id, i, ws[i] AS a, ws[i + 1] AS b, ws[i + 2] AS c FROM win),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM tri) WHERE n > 1),
cov AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM rep) GROUP BY doc_id),
m AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words, length(regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g'))::BIGINT AS word_chars,
             (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
             (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words, len(ls) AS n_lines,
             length(t) - length(replace(t, '!', '')) AS n_excl, len(list_filter(ws, lambda x: x IN ({_STOP}))) AS n_stop
      FROM w LEFT JOIN cov ON w.doc_id = cov.doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND word_chars / n_words BETWEEN 2.0 AND 14.0 AND n_symbols / n_words <= 0.30
       AND n_excl / n_words <= 0.50 AND n_stop / n_words >= 0.02 AND (n_lines = 0 OR n_dup_lines / n_lines <= 0.50) AND n_repeat_words / n_words <= 0.50 AS kept
FROM m
"""


_TWO = ", ".join(f"'{x}'" for x in urls.TWO_LABEL_SUFFIXES)
_FITS = [(r, f"((host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}'))") for r in sorted(urls.RULES, key=lambda r: -len(r.text))]
_STRENGTH = """SELECT CASE WHEN k > 1 AND nn > 0 AND v > 0 AND sc > 0 THEN CASE WHEN rho <= 0 THEN 10000.0 ELSE least(10000.0, greatest(1.0, 1 / rho - 1)) END
  ELSE 10000.0 END AS s, CASE WHEN nn > 0 THEN bb / nn ELSE 0.0 END AS mean
  FROM (SELECT *, (b2 - nn * (bb / nn) * (bb / nn) - (k - 1) * v) / nullif(sc, 0) AS rho
    FROM (SELECT *, (bb / nn) * (1 - bb / nn) AS v, (nn - n2 / nn - (k - 1)) * (bb / nn) * (1 - bb / nn) AS sc
      FROM (SELECT sum(n) AS nn, sum(b) AS bb, count(*) AS k, sum(n * n) AS n2, sum(b * b / n) AS b2 FROM {0} WHERE n > 0)))"""

OP2_SQL = f"""
WITH p AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p),
l AS (SELECT doc_id, count(*) AS n, sum((coalesce(quality, 1) = 0 OR coalesce(toxic, 0) = 1)::INT) AS b FROM labels GROUP BY doc_id),
hs AS (SELECT host, coalesce(sum(n), 0)::DOUBLE AS n, coalesce(sum(b), 0)::DOUBLE AS b FROM h LEFT JOIN l ON page_id = doc_id GROUP BY host),
w AS (SELECT *, regexp_replace(host, ':[0-9]*$', '') AS bare FROM hs),
x AS (SELECT *, string_split(bare, '.') AS parts, regexp_matches(bare, '^[0-9]+(\\.[0-9]+){{3}}$') OR starts_with(bare, '[') AS address FROM w),
y AS (SELECT *, array_to_string(parts[-2:], '.') AS two FROM x),
hosts AS (SELECT host, n, b, CASE WHEN address THEN bare WHEN two IN ({_TWO}) THEN array_to_string(parts[-3:], '.') ELSE two END AS domain,
                 CASE WHEN address THEN '' WHEN two IN ({_TWO}) THEN two ELSE parts[-1] END AS suffix FROM y),
domains AS (SELECT suffix, domain, sum(n) AS n, sum(b) AS b FROM hosts GROUP BY ALL),
suffixes AS (SELECT suffix, sum(n) AS n, sum(b) AS b FROM domains GROUP BY ALL),
s0 AS ({_STRENGTH.format('suffixes')}), s1 AS ({_STRENGTH.format('domains')}), s2 AS ({_STRENGTH.format('hosts')}),
m0 AS (SELECT suffix, (b + s * mean) / (n + s) AS m0 FROM suffixes, s0),
m1 AS (SELECT domain, suffix, (b + s * m0) / (n + s) AS m1 FROM domains JOIN m0 USING (suffix), s1),
m2 AS (SELECT host, (b + s * m1) / (n + s) AS m, n + s AS w FROM hosts JOIN m1 USING (domain, suffix), s2)
SELECT page_id, host, path, CASE {' '.join(f"WHEN {c} THEN '{r.text}'" for r, c in _FITS)} END AS rule,
       CASE {' '.join(f"WHEN {c} THEN '{r.verdict}'" for r, c in _FITS)}
            WHEN m - {urls.Z} * sqrt(greatest(m * (1 - m), 0) / (w + 1)) > {urls.THRESHOLD} THEN 'block' ELSE 'allow' END AS verdict
FROM h JOIN m2 USING (host)
"""

OP10_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS xs FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id,
             list_sum(list_transform(list_zip(q.xs, c.xs), lambda p: p[1] * p[2]))::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""


def queries() -> dict[str, Query]:
    return {
        "op1_best_fit_packing": op1_best_fit_packing,
        "op2_url_filter": op2_url_filter,
        "op3_lm_scoring": op3_lm_scoring,
        "op4_quality_rules": op4_quality_rules,
        "op5_suffix_dedup": op5_suffix_dedup,
        "op6_simhash_near_dedup": op6_simhash_near_dedup,
        "op7_html_extraction": op7_html_extraction,
        "op8_warc_derivatives": op8_warc_derivatives,
        "op9_byte_bpe": op9_byte_bpe,
        "op10_exact_top_k": op10_exact_top_k,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_url_filter": OP2_SQL, "op4_quality_rules": OP4_SQL, "op10_exact_top_k": OP10_SQL}
