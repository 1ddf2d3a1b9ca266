"""The registered queries of the corpus operators and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from tapeworks.llm import (
    exact_dedup,
    language,
    line_dedup,
    mixing,
    packing,
    pii,
    quality,
    ranked,
    sharding,
    simhash,
    substring,
    url_filter,
    vector_codes,
)

SHARDS = [f"shard-{i:03d}" for i in range(256)]


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/documents.parquet")


def op1_simhash(spark: SparkSession, sf: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf))


def op2_pii(spark: SparkSession, sf: str) -> DataFrame:
    docs = documents(spark, sf)
    return pii.detect(docs, pii.train(docs))


def op3_quality(spark: SparkSession, sf: str) -> DataFrame:
    docs = documents(spark, sf)
    return quality.assess(docs, quality.train(docs, spark.read.parquet(f"{sf}/labels.parquet")))


def op4_line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    kept = line_dedup.dedup_lines(documents(spark, sf).select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op5_exact_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return exact_dedup.exact_groups(documents(spark, sf))


def op6_packing(spark: SparkSession, sf: str) -> DataFrame:
    return packing.best_fit(documents(spark, sf))


def op7_language(spark: SparkSession, sf: str) -> DataFrame:
    docs = documents(spark, sf)
    return language.identify(docs, language.learn(docs.where(~language.held_out(F.col("doc_id")))))


def op8_substring(spark: SparkSession, sf: str) -> DataFrame:
    return substring.remove_repeats(documents(spark, sf), digest_only=True).drop("spans")


def op9_sharding(spark: SparkSession, sf: str) -> DataFrame:
    """Shard of every document; 256 shards."""
    return sharding.place(documents(spark, sf), sharding.fill(SHARDS)).select("doc_id", "slot", "shard")


def op10_mixing(spark: SparkSession, sf: str) -> DataFrame:
    """The mixed corpus: sources weigh the square root of their size."""
    docs = documents(spark, sf)
    return mixing.replicate(docs, mixing.rates(docs))


def op11_url_filter(spark: SparkSession, sf: str) -> DataFrame:
    return url_filter.judge(spark.read.parquet(f"{sf}/pages.parquet"))


def op12_ranked(spark: SparkSession, sf: str) -> DataFrame:
    return ranked.rank(documents(spark, sf), spark.read.parquet(f"{sf}/benchmark.parquet"))


def op13_vector_codes(spark: SparkSession, sf: str) -> DataFrame:
    coded, books = vector_codes.compress(spark.read.parquet(f"{sf}/embeddings.parquet"))
    return vector_codes.with_label_error(coded).select(
        "vec_id", "code", "error", "label_error", F.lit(vector_codes.digest(books)).alias("codebooks_sha256"))


WHITE_SQL = r"[\x20\x09-\x0D]"


def _op9_sql() -> str:
    owner = ",".join(map(str, sharding.fill(SHARDS)))
    return f"""
WITH lookup AS (
  SELECT generate_subscripts(list, 1) - 1 AS slot, unnest(list)::INT AS shard
  FROM (SELECT string_split('{owner}', ',') AS list)),
keyed AS (
  SELECT doc_id, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, {sharding.HASH_HEX}))::BIGINT
    % {sharding.SLOTS} AS slot FROM documents)
SELECT doc_id, slot, shard FROM keyed LEFT JOIN lookup USING (slot)"""


OP4_SQL = rf"""
WITH lines AS (
  SELECT doc_id, unnest(list) AS line, generate_subscripts(list, 1) AS nth
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS list FROM documents)),
keyed AS (
  SELECT doc_id, line, nth, translate(regexp_replace(line, '^{WHITE_SQL}+|{WHITE_SQL}+$', '', 'g'),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
frequent AS (
  SELECT k, max(doc_id) AS last FROM keyed WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
marked AS (
  SELECT doc_id, line, nth, coalesce(doc_id < last, false) AS gone FROM keyed LEFT JOIN frequent USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY nth) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id"""

OP5_SQL = rf"""
WITH norm AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
    regexp_replace(coalesce(text, ''), '{WHITE_SQL}', '', 'g') AS body FROM documents),
best AS (
  SELECT body, count(*) AS group_size, first(doc_id ORDER BY n DESC, doc_id) AS keep_id FROM norm GROUP BY body)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(body) AS text_sha256
FROM norm JOIN best USING (body)"""

OP8_SQL = rf"""
WITH words AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '{WHITE_SQL}+'), lambda w: w <> '') AS w FROM documents),
windows AS (
  SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS seq
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM words)),
firsts AS (SELECT seq, min(doc_id) AS low FROM windows GROUP BY seq HAVING count(*) > 1),
hits AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS i FROM windows JOIN firsts USING (seq) WHERE doc_id > low),
each AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM words),
marked AS (SELECT e.doc_id, e.word, e.i, h.i IS NOT NULL AS gone FROM each e LEFT JOIN hits h ON e.doc_id = h.doc_id AND e.i = h.i),
kept AS (
  SELECT doc_id, count(*) FILTER (gone) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY i) FILTER (NOT gone), '') AS body
  FROM marked GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(body, '')) AS kept_sha256
FROM words LEFT JOIN kept USING (doc_id)"""

OP10_SQL = f"""
WITH RECURSIVE counts AS (
  SELECT source, count(*) AS n, pow(count(*)::DOUBLE, 0.5) AS weight FROM documents GROUP BY source),
totals AS (SELECT sum(n)::DOUBLE AS n, sum(weight) AS w FROM counts),
rates AS (SELECT source, weight / totals.w * totals.n / counts.n AS rate FROM counts, totals),
terms AS (
  SELECT source, rate, 0 AS k, exp(-rate) AS p, exp(-rate) AS c FROM rates
  UNION ALL
  SELECT source, rate, k + 1, p * rate / (k + 1)::DOUBLE, c + p * rate / (k + 1)::DOUBLE
  FROM terms WHERE k < {mixing.TERMS}),
cdf AS (SELECT source, list(c ORDER BY k) AS cdf FROM terms GROUP BY source),
drawn AS (
  SELECT d.*, ('0x' || substr(md5('{mixing.SEED}:0:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u,
    cdf.cdf FROM documents d JOIN cdf ON d.source IS NOT DISTINCT FROM cdf.source)
SELECT doc_id, text, lang, source, n_chars, copy::INT AS copy,
  md5('order:{mixing.SEED}:' || copy || ':' || coalesce(doc_id::VARCHAR, '')) AS order_key
FROM (SELECT *, unnest(range(1, 1 + len(list_filter(cdf, lambda c: c <= u)))) AS copy FROM drawn)"""


def _op11_sql() -> str:
    rules = sorted(url_filter.RULES, key=lambda r: (-len(r[1]), r[1]))
    cases = [(f"(host = '{r.split('/', 1)[0]}' OR ends_with(host, '.{r.split('/', 1)[0]}')) "
              f"AND starts_with(path, '/{r.split('/', 1)[1]}')", r, says) for says, r in rules]
    fold = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')".format
    odds = "floor(1e6 * (ln(({b} + 1) / {B}::DOUBLE) - ln(({a} + 1) / {A}::DOUBLE)))::BIGINT".format
    letters = url_filter.LETTERS
    return f"""
WITH RECURSIVE cut AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
split AS (
  SELECT page_id, {fold("regexp_extract(rest, '^[^/?#]*')")} AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
base AS (
  SELECT *, CASE {' '.join(f"WHEN {c} THEN '{r}'" for c, r, _ in cases)} END AS rule,
    CASE {' '.join(f"WHEN {c} THEN '{s}'" for c, _, s in cases)} END AS says,
    list_transform(regexp_extract_all({fold('path')}, '\\p{{L}}+|[0-9]+'), lambda t: CASE WHEN t[1] BETWEEN '0' AND '9' THEN '#' || len(t) ELSE t END) AS tokens
  FROM split),
counts AS (
  SELECT word, count(*) AS n FROM (
    SELECT regexp_extract(token, '{url_filter.ONE_WORD}', 1) AS word FROM (
      SELECT unnest(string_split_regex({fold("regexp_replace(html, '<[^<>]*>', ' ', 'g')")}, '{WHITE_SQL}+')) AS token FROM pages))
  WHERE word <> '' GROUP BY word),
total AS (SELECT coalesce(sum(n), 1)::DOUBLE AS n FROM counts),
parts AS (
  SELECT host, unnest(list) AS piece, generate_subscripts(list, 1) AS nth
  FROM (SELECT host, regexp_extract_all(host, '{letters}|[0-9]+') AS list FROM (SELECT DISTINCT host FROM base))),
pieces AS (SELECT DISTINCT piece FROM parts WHERE NOT piece[1] BETWEEN '0' AND '9'),
spans AS (
  SELECT DISTINCT substr(piece, k, size) AS word FROM (
    SELECT piece, k, unnest(range(1, 1 + least({url_filter.LONGEST_WORD}, len(piece) - k + 1))) AS size
    FROM (SELECT piece, unnest(range(1, 1 + len(piece))) AS k FROM pieces))),
costs AS (
  SELECT map_from_entries(list({{'k': word, 'v': floor(1e6 * ln(counts.n / total.n))::BIGINT}})) AS known
  FROM counts JOIN spans USING (word), total),
unseen AS (SELECT known, floor(1e6 * ln(10 / n))::BIGINT AS unknown FROM costs, total),
walk AS (
  SELECT piece, 0 AS i, [0::BIGINT] AS best, [0::BIGINT] AS back FROM pieces
  UNION ALL
  SELECT piece, i + 1, list_append(best, hit.s), list_append(back, -hit.k) FROM (
    SELECT piece, i, best, back, list_sort(list_transform(range(greatest(0, i + 1 - {url_filter.LONGEST_WORD}), i + 1), lambda k: {{
      's': best[k + 1] + coalesce(known[substr(piece, k + 1, i + 1 - k)], unknown - {url_filter.TENTH} * (i + 1 - k)), 'k': -k}}), 'DESC')[1] AS hit
    FROM walk, unseen WHERE i < len(piece))),
trace AS (
  SELECT piece, len(piece)::BIGINT AS j, back, []::VARCHAR[] AS words FROM walk WHERE i = len(piece)
  UNION ALL
  SELECT piece, back[j + 1], back, list_prepend(substr(piece, back[j + 1] + 1, j - back[j + 1]), words) FROM trace WHERE j > 0),
hosts AS (
  SELECT host, flatten(list(coalesce(words, ['#' || len(piece)]) ORDER BY nth)) AS words
  FROM parts LEFT JOIN (SELECT piece, words FROM trace WHERE j = 0) USING (piece) GROUP BY host),
named AS (SELECT base.*, coalesce(words, []) AS words FROM base LEFT JOIN hosts USING (host)),
told AS (
  SELECT page_id, says, list_concat(list_transform(words, lambda w: 'h:' || w), list_transform(tokens, lambda w: 'p:' || w)) AS list, host, path, rule, words FROM named),
seen AS (
  SELECT token, count(*) FILTER (says = 'block') AS b, count(*) FILTER (says = 'allow') AS a
  FROM (SELECT says, unnest(list) AS token FROM told WHERE says IS NOT NULL) GROUP BY token),
size AS (SELECT coalesce(sum(b), 0) + count(*) + 1 AS all_b, coalesce(sum(a), 0) + count(*) + 1 AS all_a FROM seen),
ruled AS (SELECT count(*) FILTER (says = 'block') AS b, count(*) FILTER (says = 'allow') AS a FROM base),
model AS (
  SELECT (SELECT map_from_entries(list({{'k': token, 'v': {odds(b='b', a='a', B='all_b', A='all_a')}}})) FROM seen, size) AS weights,
    {odds(b='0', a='0', B='all_b', A='all_a')} AS unseen, {odds(b='b', a='a', B='1', A='1')} AS prior FROM size, ruled),
scored AS (
  SELECT told.*, prior + coalesce(list_sum(list_transform(list, lambda t: coalesce(weights[t], model.unseen))), 0)::BIGINT AS score
  FROM told, model)
SELECT page_id, host, path, rule, coalesce(says, CASE WHEN score > 0 THEN 'block' ELSE 'allow' END) AS verdict, score,
  array_to_string(words, ' ') AS words FROM scored"""


OP12_SQL = r"""
WITH found AS (
  SELECT doc_id, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM documents),
tf AS (SELECT doc_id, t, count(*) AS tf FROM found GROUP BY doc_id, t),
sizes AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM tf GROUP BY doc_id),
corpus AS (SELECT count(*) AS docs, sum(n)::BIGINT AS len FROM sizes),
asked AS (
  SELECT item_id, t, count(*) AS c FROM (
    SELECT item_id, unnest(regexp_extract_all(
      translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark) GROUP BY item_id, t),
weights AS (
  SELECT t, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w
  FROM tf, corpus WHERE t IN (SELECT t FROM asked) GROUP BY t, docs),
scored AS (
  SELECT item_id, doc_id, sum(c * w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * docs) // len))))::BIGINT AS score
  FROM asked JOIN weights USING (t) JOIN tf USING (t) JOIN sizes USING (doc_id), corpus GROUP BY item_id, doc_id)
SELECT item_id, rank::INT AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0)
WHERE rank <= 10"""


def _op13_sql() -> str:
    away = " + ".join(f"(x[{i}] - c[{i}]) * (x[{i}] - c[{i}])" for i in range(1, 5))
    means = ", ".join(f"floor(sum(n * x[{i}]) / sum(n))::BIGINT" for i in range(1, 5))
    rounds = "".join(f"""
a{r} AS (SELECT p, x, n, min({{'d': {away}, 'e': e}}) AS hit FROM pieces JOIN b{r} USING (p) GROUP BY p, x, n),
m{r} AS (SELECT p, hit.e AS e, [{means}] AS c FROM a{r} GROUP BY p, hit.e),
b{r + 1} AS (SELECT p, e, coalesce(m.c, b.c) AS c FROM b{r} b LEFT JOIN m{r} m USING (p, e)),""" for r in (0, 1))
    return f"""
WITH kept AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS (SELECT vec_id, label, p, v[4 * p + 1:4 * p + 4] AS x FROM kept, range(16) t(p)),
pieces AS (SELECT p, x, count(*) AS n FROM parts GROUP BY p, x),
b0 AS (
  SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, x AS c FROM parts
  WHERE vec_id IN (SELECT vec_id FROM kept ORDER BY vec_id LIMIT 64)),{rounds}
last AS (SELECT p, x, min({{'d': {away}, 'e': e}}) AS hit FROM pieces JOIN b2 USING (p) GROUP BY p, x),
coded AS (
  SELECT vec_id, label, string_agg(printf('%02x', hit.e), '' ORDER BY p) AS code, sum(hit.d)::BIGINT AS error
  FROM parts JOIN last USING (p, x) GROUP BY vec_id, label),
books AS (
  SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM b2)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256
FROM coded, books"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_simhash": op1_simhash, "op2_pii": op2_pii, "op3_quality": op3_quality,
        "op4_line_dedup": op4_line_dedup, "op5_exact_dedup": op5_exact_dedup, "op6_packing": op6_packing,
        "op7_language": op7_language, "op8_substring": op8_substring, "op9_sharding": op9_sharding,
        "op10_mixing": op10_mixing,
        "op11_url_filter": op11_url_filter, "op12_ranked": op12_ranked, "op13_vector_codes": op13_vector_codes, "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op4_line_dedup": OP4_SQL, "op5_exact_dedup": OP5_SQL, "op8_substring": OP8_SQL,
        "op9_sharding": _op9_sql(), "op10_mixing": OP10_SQL, "op11_url_filter": _op11_sql(), "op12_ranked": OP12_SQL,
        "op13_vector_codes": _op13_sql(),
    }
