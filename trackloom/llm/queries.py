"""The registered queries of the training-data operators, with the production parameters, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from trackloom.llm import decontaminate, divergence, jaccard_join, line_dedup, mixing, pii, quality_rules, resampling, substring_dedup, token_output, topk, toxicity, url_filter
from trackloom.llm.common import table


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.allocate(table(spark, sf_dir, "documents"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = topk.codes(table(spark, sf_dir, "embeddings"))
    return topk.search(codes, codes.filter("id % 20 = 0"), k=10)


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.report(table(spark, sf_dir, "documents"), width=3, percent=90)


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return line_dedup.digest(line_dedup.LineStore(spark, min_docs=10).insert(docs).apply(docs))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find(table(spark, sf_dir, "documents")))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digest(substring_dedup.remove_repeats(table(spark, sf_dir, "documents")))


def op8_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output.encode_documents(spark, table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.report(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mixing": op1_mixing,
    "op2_decontaminate": op2_decontaminate,
    "op3_topk_search": op3_topk_search,
    "op4_jaccard_join": op4_jaccard_join,
    "op5_line_dedup": op5_line_dedup,
    "op6_pii": op6_pii,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_token_output": op8_token_output,
    "op9_toxicity": op9_toxicity,
    "op10_url_filter": op10_url_filter,
    "op11_resampling": op11_resampling,
    "op12_divergence": op12_divergence,
    "op13_quality_rules": op13_quality_rules,
}

# A-Z alone are lower-cased, whatever the locale
LOWER_AZ = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP5_SQL = f"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
), keyed AS (
  SELECT r, doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS k FROM docs
), lined AS (
  SELECT *, {LOWER_AZ.format("trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))")} AS key FROM keyed
), common AS (
  SELECT key FROM lined WHERE key <> '' GROUP BY key HAVING count(DISTINCT r) >= 10
), marked AS (
  SELECT l.*, c.key IS NOT NULL AS gone FROM lined l LEFT JOIN common c ON l.key = c.key
)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY k) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY r
"""

OP2_WORDS = "list_filter(string_split_regex(" + LOWER_AZ.format("coalesce(text, '')") + r", '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"

OP2_SQL = f"""
WITH b AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id, {OP2_WORDS} AS words FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, least(len(words), 13) AS n,
         array_to_string(words[i : i + least(len(words), 13) - 1], ' ') AS w
  FROM (SELECT item_id, words, unnest(range(1, len(words) - least(len(words), 13) + 2)) AS i FROM b WHERE len(words) > 0)
), sizes AS (
  SELECT DISTINCT n FROM bw
), d AS (
  SELECT row_number() OVER () AS r, doc_id, {OP2_WORDS} AS words FROM documents
), dw AS (
  SELECT r, n, i, array_to_string(words[i : i + n - 1], ' ') AS w
  FROM (SELECT r, words, n, unnest(range(1, len(words) - n + 2)) AS i FROM d, sizes WHERE len(words) >= n)
), hits AS (
  SELECT dw.r, dw.i, dw.n, bw.item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.w = bw.w
), covered AS (
  SELECT r, count(DISTINCT k) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS k FROM hits) GROUP BY r
), named AS (
  SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT r, item_id FROM hits) GROUP BY r
)
SELECT doc_id, len(words) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(words) AS contaminated
FROM d LEFT JOIN covered USING (r) LEFT JOIN named USING (r)
"""

OP1_SQL = r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, doc_id, source, coalesce('s:' || source, 'null') AS src,
         len(regexp_extract_all(coalesce(text, ''), '[^ \t\n\r]+')) AS tok, md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS h
  FROM documents
), sums AS (SELECT src, sum(tok)::DOUBLE AS tokens FROM d GROUP BY src HAVING sum(tok) > 0
), tot AS (SELECT sum(tokens) AS total, count(*) AS k FROM sums
), p AS (SELECT src, tokens, tokens / total AS p FROM sums, tot
), ent(i, lo, hi) AS (
  SELECT 0, 0.0::DOUBLE, 1.0::DOUBLE
  UNION ALL
  SELECT i + 1, CASE WHEN good THEN mid ELSE lo END, CASE WHEN good THEN hi ELSE mid END
  FROM (SELECT i, lo, hi, (lo + hi) / 2 AS mid,
               (SELECT ln(sum(pow(p, (lo + hi) / 2))) - sum(pow(p, (lo + hi) / 2) * ln(pow(p, (lo + hi) / 2))) / sum(pow(p, (lo + hi) / 2)) FROM p)
               >= 0.95 * (SELECT ln(k) FROM tot) AS good FROM ent WHERE i < 30)
), rep(i, lo, hi) AS (
  SELECT 0, 0.0::DOUBLE, 1.0::DOUBLE
  UNION ALL
  SELECT i + 1, CASE WHEN good THEN lo ELSE mid END, CASE WHEN good THEN mid ELSE hi END
  FROM (SELECT i, lo, hi, (lo + hi) / 2 AS mid,
               (SELECT max(pow(p, (lo + hi) / 2 - 1)) / sum(pow(p, (lo + hi) / 2)) FROM p) <= 4.0 AS good FROM rep WHERE i < 30)
), t AS (
  SELECT greatest((SELECT lo FROM ent WHERE i = 30), CASE WHEN (SELECT max(1 / p) / count(*) FROM p) <= 4.0 THEN 0.0 ELSE (SELECT hi FROM rep WHERE i = 30) END) AS t
), w AS (
  SELECT src, tokens, total, round(pow(p, t) / (SELECT sum(pow(p, t)) FROM p, t), 9) AS weight FROM p, t, tot
), b AS (
  SELECT src, weight, tokens::BIGINT AS tokens, floor(weight * total * 1.0)::BIGINT AS due FROM w
), b2 AS (
  SELECT src, weight, due // tokens AS passes, due - (due // tokens) * tokens AS rest FROM b
), blocks AS (
  SELECT src, substr(h, 1, 3) AS block, sum(tok) AS n FROM d GROUP BY ALL
), placed AS (
  SELECT src, block, n, coalesce(sum(n) OVER (PARTITION BY src ORDER BY md5('mix/' || src || '/' || block) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM blocks
), docs2 AS (
  SELECT d.*, b2.weight, b2.passes, n, rest - before AS remaining,
         coalesce(sum(tok) OVER (PARTITION BY d.src, block ORDER BY h, doc_id NULLS FIRST, tok, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS run
  FROM d JOIN placed ON placed.src = d.src AND placed.block = substr(d.h, 1, 3) LEFT JOIN b2 ON b2.src = d.src
)
SELECT doc_id, source, tok AS n_tokens, coalesce(weight, 0) AS weight,
       CAST(coalesce(passes, 1) + CASE WHEN remaining > 0 AND remaining >= n THEN 1 WHEN remaining > 0 AND run < remaining THEN 1 ELSE 0 END AS BIGINT) AS copies
FROM docs2
"""

OP3_SQL = """
WITH c AS (
  SELECT DISTINCT vec_id AS id, list_transform(embedding, lambda x: CAST(x > 0 AS INTEGER)) AS bits FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
), d AS (
  SELECT q.id AS query_id, c.id, list_sum(list_transform(list_zip(q.bits, c.bits), lambda z: abs(z[1] - z[2])))::BIGINT AS distance
  FROM c q, c WHERE q.id % 20 = 0 AND q.id <> c.id
), ranked AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank, id, distance FROM d
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, id, distance FROM ranked WHERE rank <= 10
"""

# n-grams of each text are told apart first, and a checksum is taken once for each different one, byte by byte
OP11_SQL = f"""
WITH crc_table AS (
  SELECT list(list_reduce([n] || range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) ORDER BY n) AS t
  FROM (SELECT unnest(range(256))::BIGINT AS n)
), texts AS (
  SELECT 'd' AS side, row_number() OVER () AS r, doc_id, {OP2_WORDS} AS ws FROM documents
  UNION ALL SELECT 'b', row_number() OVER (), NULL, {OP2_WORDS} FROM benchmark
), grams AS (
  SELECT side, r, unnest(list_concat(ws, list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]),
                                     list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]))) AS g FROM texts
), counted AS (
  SELECT side, r, g, count(*) AS n FROM grams GROUP BY ALL
), hexed AS (
  SELECT g, hex(encode(g)) AS x FROM (SELECT DISTINCT g FROM counted)
), placed AS (
  SELECT g, xor(list_reduce([4294967295] || list_transform(range(1, len(x), 2), lambda i: (16 * (instr('0123456789ABCDEF', x[i]) - 1) + instr('0123456789ABCDEF', x[i + 1]) - 1)::BIGINT),
                            lambda c, b: xor(c // 256, t[xor(c, b) % 256 + 1])), 4294967295) % 10000 AS bucket
  FROM hexed, crc_table
), hashed AS (
  SELECT side, r, bucket, sum(n)::BIGINT AS n FROM counted JOIN placed USING (g) GROUP BY ALL
), sizes AS (
  SELECT b.bucket, coalesce(sum(n) FILTER (side = 'd'), 0)::BIGINT AS s, coalesce(sum(n) FILTER (side = 'b'), 0)::BIGINT AS t
  FROM (SELECT unnest(range(10000)) AS bucket) b LEFT JOIN hashed USING (bucket) GROUP BY b.bucket
), gain AS (
  SELECT bucket, floor(1000 * ln(((t + 1)::DOUBLE * ((SELECT sum(s) FROM sizes) + 10000)::DOUBLE) / ((s + 1)::DOUBLE * ((SELECT sum(t) FROM sizes) + 10000)::DOUBLE)))::BIGINT AS gain FROM sizes
), weighed AS (
  SELECT r, sum(n)::BIGINT AS n_features, sum(n * gain)::BIGINT AS weight FROM hashed JOIN gain USING (bucket) WHERE side = 'd' GROUP BY r
), scored AS (
  SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, len(ws) >= 20 AS eligible,
         coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8))::UBIGINT::DOUBLE + 0.5) / 4294967296)))::BIGINT AS score
  FROM texts LEFT JOIN weighed USING (r) WHERE side = 'd'
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY eligible ORDER BY score DESC, doc_id NULLS LAST) AS k FROM scored
)
SELECT doc_id, n_features, weight, score, CASE WHEN eligible AND k <= 5 * (SELECT count(*) FROM scored WHERE eligible) // 100 THEN k END AS rank
FROM ranked
"""

OP12_SQL = f"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         list_filter(string_split_regex({LOWER_AZ.format("coalesce(text, '')")}, '[\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS ws FROM documents
), w AS (
  SELECT lang, source, term, r, count(*) AS n FROM (SELECT lang, source, r, unnest(ws) AS term FROM d) GROUP BY ALL
), kept AS (
  SELECT lang, term FROM w GROUP BY ALL HAVING count(*) >= 3
), counted AS (
  SELECT lang, source, term, sum(n) AS n FROM w JOIN kept USING (lang, term) GROUP BY ALL
), groups AS (
  SELECT lang, source, (SELECT coalesce(sum(n), 0) FROM counted c WHERE c.lang = g.lang AND c.source = g.source) AS total,
         (SELECT count(*) FROM kept k WHERE k.lang = g.lang) AS v FROM (SELECT DISTINCT lang, source FROM d) g
), p AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + 1000000000::HUGEINT * (coalesce(c.n, 0)::HUGEINT + 1) // (total + v)::HUGEINT AS p
  FROM groups g JOIN kept k ON k.lang = g.lang LEFT JOIN counted c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), whole AS (
  SELECT lang, sum(total) + min(v) AS size FROM groups GROUP BY lang
), q AS (
  SELECT lang, term, 1 + 1000000000::HUGEINT * (sum(n)::HUGEINT + 1) // any_value(size)::HUGEINT AS q FROM counted JOIN whole USING (lang) GROUP BY lang, term
), found AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(x.value, 0)::BIGINT AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN (
    SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
    FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
  ) x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
  UNION ALL
  SELECT p.lang, p.source, 'term', p.term, ((p - q) * (p - q) // q)::BIGINT FROM p JOIN q ON p.lang = q.lang AND p.term = q.term WHERE n > 0 AND p > q
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM found
)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 200
"""

OP13_WORDS = "list_filter(string_split_regex({}, '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '')"

OP13_SQL = f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text, {OP13_WORDS.format("coalesce(text, '')")} AS ws FROM documents
), windows AS (
  SELECT r, i, ws[i : i + 7] AS w FROM (SELECT r, ws, unnest(range(1, len(ws) - 6)) AS i FROM d WHERE len(ws) >= 8)
), repeats AS (
  SELECT r, count(DISTINCT k) AS n_repeat_words
  FROM (SELECT r, unnest(range(i, i + 8)) AS k FROM (SELECT *, count(*) OVER (PARTITION BY r, w) AS n FROM windows) WHERE n > 1) GROUP BY r
), lines AS (
  SELECT r, host, text, line, len(ws) AS n, {LOWER_AZ.format("array_to_string(ws, ' ')")} AS key
  FROM (SELECT *, {OP13_WORDS.format("line")} AS ws FROM (SELECT r, host, text, unnest(string_split(text, chr(10))) AS line FROM d)) WHERE len(ws) > 0
), doubled AS (
  SELECT r, sum(n - 1)::BIGINT AS n_dup_lines FROM (SELECT r, line, count(*) AS n FROM lines GROUP BY r, line) GROUP BY r
), hosts AS (
  SELECT host, count(DISTINCT text) AS docs FROM d GROUP BY host
), common AS (
  SELECT host, key FROM lines JOIN hosts USING (host) GROUP BY host, key HAVING count(DISTINCT text) >= 10 AND 100 * count(DISTINCT text) >= any_value(docs)
), lost AS (
  SELECT r, sum(n)::BIGINT AS n_lost FROM lines JOIN common USING (host, key) GROUP BY r
), counted AS (
  SELECT doc_id, len(ws) AS n_words, coalesce(list_sum(list_transform(ws, lambda w: length(w))), 0)::BIGINT AS word_chars,
         length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
         coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_lost, 0) AS n_lost
  FROM d LEFT JOIN repeats USING (r) LEFT JOIN doubled USING (r) LEFT JOIN lost USING (r)
)
SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND 100 * n_lost <= 70 * n_words AS kept
FROM counted
"""

ORACLES: dict[str, str] = {
    "op13_quality_rules": OP13_SQL,
    "op12_divergence": OP12_SQL,
    "op11_resampling": OP11_SQL,
    "op3_topk_search": OP3_SQL,
    "op1_mixing": OP1_SQL,
    "op2_decontaminate": OP2_SQL,
    "op5_line_dedup": OP5_SQL,
}
