"""The registered queries of the corpus operators and, where SQL can express them, their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillspan.llm.common import table


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillspan.llm.exact_dedup import exact_groups

    return exact_groups(table(spark, sf_dir, "documents"), keep="largest")


OP1_SQL = """
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
       count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
       row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) = 1 AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""

QUERIES = {"op1_exact_dedup": op1_exact_dedup}
ORACLE_SQL = {"op1_exact_dedup": OP1_SQL}


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillspan.llm.minhash import near_groups

    return near_groups(table(spark, sf_dir, "documents"), percent=85, words_per=5)


OP2_SQL = r"""
WITH RECURSIVE rows AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN CAST([] AS VARCHAR[])
         ELSE list_distinct(list_transform(range(greatest(len(w) - 4, 1)), lambda i: array_to_string(w[i + 1:i + 5], ' '))) END AS s FROM rows),
sized AS (SELECT doc_id, s, len(s) AS n FROM sets),
classes AS (SELECT min(doc_id) AS rep, n, list_sort(s) AS s FROM sized WHERE n > 0 GROUP BY n, list_sort(s)),
each AS (SELECT rep, n, unnest(s) AS x FROM classes),
pairs AS (
  SELECT a.rep AS a, b.rep AS b, a.n AS na, b.n AS nb, count(*) AS same FROM each a JOIN each b ON a.x = b.x AND a.rep <> b.rep
  GROUP BY a.rep, b.rep, a.n, b.n),
links AS (
  SELECT a, b FROM pairs WHERE 100 * same >= 85 * (na + nb - same)
  UNION SELECT c.rep, z.doc_id FROM sized z JOIN classes c ON c.n = z.n AND c.s = list_sort(z.s)
  UNION SELECT z.doc_id, c.rep FROM sized z JOIN classes c ON c.n = z.n AND c.s = list_sort(z.s)),
reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
least AS (SELECT a AS doc_id, min(b) AS m FROM reach GROUP BY a)
SELECT doc_id, n AS n_shingles, coalesce(least(doc_id, m), doc_id) AS component_id, doc_id = coalesce(least(doc_id, m), doc_id) AS kept
FROM sized LEFT JOIN least USING (doc_id)
"""

QUERIES["op2_near_dedup"] = op2_near_dedup
ORACLE_SQL["op2_near_dedup"] = OP2_SQL


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillspan.llm.suffix_dedup import repeated_spans

    return repeated_spans(table(spark, sf_dir, "documents"), length=50).drop("spans")


OP8_SQL = """
WITH d AS (SELECT doc_id, lower(hex(encode(coalesce(text, '')))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
w AS (
  SELECT doc_id, unnest(range(greatest(n - 49, 0))) AS p, unnest(list_transform(range(greatest(n - 49, 0)), lambda p: substr(h, 2 * p + 1, 100))) AS g FROM d),
early AS (SELECT g, min(doc_id) AS m FROM w GROUP BY g HAVING min(doc_id) < max(doc_id)),
hit AS (SELECT doc_id, p FROM w JOIN early USING (g) WHERE doc_id > m),
mark AS (SELECT doc_id, p, CASE WHEN p <= lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 50 THEN 0 ELSE 1 END AS new FROM hit),
run AS (SELECT doc_id, p, sum(new) OVER (PARTITION BY doc_id ORDER BY p) AS k FROM mark),
span AS (SELECT doc_id, k, min(p) AS a, max(p) + 50 AS z FROM run GROUP BY doc_id, k),
gap AS (SELECT doc_id, k, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY k), 0) AS s, a, z FROM span),
cut AS (
  SELECT doc_id, string_agg(substr(h, CAST(2 * s + 1 AS BIGINT), CAST(2 * (a - s) AS BIGINT)), '' ORDER BY k) || substr(any_value(h), CAST(2 * max(z) + 1 AS BIGINT)) AS rest,
         sum(z - a) AS gone, count(*) AS spans
  FROM gap JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans,
       sha256(unhex(coalesce(rest, h))) AS kept_sha256
FROM d LEFT JOIN cut USING (doc_id)
"""

QUERIES["op8_suffix_dedup"] = op8_suffix_dedup
ORACLE_SQL["op8_suffix_dedup"] = OP8_SQL


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillspan.llm.packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_path(), max_tokens=2048)


QUERIES["op5_best_fit_packing"] = op5_best_fit_packing


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillspan.llm import langid

    docs = table(spark, sf_dir, "documents")
    return langid.identify(docs, *langid.train(docs.filter(~langid.held_out())))


def toxicity_model(spark: SparkSession, sf_dir: str) -> dict | None:
    from quillspan.llm import toxicity
    from quillspan.llm.langid import held_out

    return toxicity.fit(toxicity.training_sample(table(spark, sf_dir, "documents").filter(~held_out()), table(spark, sf_dir, "labels").filter(~held_out())))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from quillspan.llm import toxicity
    from quillspan.llm.langid import held_out

    out = toxicity.score(table(spark, sf_dir, "documents"), toxicity_model(spark, sf_dir))
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "spans")


QUERIES |= {"op10_language_id": op10_language_id, "op9_toxicity": op9_toxicity}


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillspan.llm.line_dedup import strip_boilerplate

    return strip_boilerplate(table(spark, sf_dir, "pages"))


OP3_SQL = r"""
WITH cut AS (
  SELECT page_id, coalesce(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1), '') AS host,
         replace(replace(replace(replace(replace(replace(replace(replace(
           regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''),
             '(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->', ' ', 'g'),
             '(?i)</?(?:p|div|br|li|ul|ol|nav|header|footer|article|section|aside|main|table|tr|td|th|h[1-6]|title|head|body|html|form|pre|blockquote)(?:\s[^>]*)?/?>', chr(10), 'g'),
             '<[^>]*>', '', 'g'),
           '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&copy;', '©'), '&middot;', '·'), '&amp;', '&') AS t
  FROM pages),
rows AS (
  SELECT page_id, host, list_filter(list_transform(string_split(t, chr(10)), lambda x: trim(regexp_replace(x, '[ \t\r\x0B\f]+', ' ', 'g'))), lambda x: x <> '') AS lines
  FROM cut),
totals AS (SELECT host, count(*) AS host_pages FROM rows GROUP BY host),
seen AS (SELECT host, line, count(*) AS n FROM (SELECT host, unnest(list_distinct(lines)) AS line FROM rows) GROUP BY host, line),
often AS (SELECT host, list(line) AS often FROM seen JOIN totals USING (host) WHERE host_pages >= 4 AND n >= 2 AND n > 0.3 * host_pages GROUP BY host),
kept AS (
  SELECT page_id, host, host_pages, lines, list_filter(lines, lambda x: NOT list_contains(coalesce(often, []), x)) AS good
  FROM rows JOIN totals USING (host) LEFT JOIN often USING (host))
SELECT page_id, host, host_pages, len(lines) AS n_lines, len(lines) - len(good) AS n_dropped, array_to_string(good, chr(10)) AS text FROM kept
"""


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from quillspan.llm import quality

    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.train(docs)).withColumn("kept", F.col("score") >= 0.5)


QUERIES |= {"op3_line_dedup": op3_line_dedup, "op4_quality": op4_quality}
ORACLE_SQL["op3_line_dedup"] = OP3_SQL


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillspan.llm.decontaminate import contaminated

    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES |= {"op6_decontamination": op6_decontamination, "pipeline": pipeline}

#: For the registered query only; a real run passes a secret of its own.
SURROGATE_KEY = b"quillspan"


def op7_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillspan.llm.surrogates import with_surrogates

    return with_surrogates(table(spark, sf_dir, "documents"), SURROGATE_KEY)


QUERIES["op7_pii_surrogates"] = op7_pii_surrogates
