"""Registered queries of the corpus operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairlens.llm import collocations, exact_dedup, license_scan, mixing, packing, pii, quality, secret_scan, sessions, simhash, topk, toxicity, url_filter
from pairlens.llm.common import table


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), added_tokens=True).select(
        "doc_id",
        "start",
        F.col("length").cast("long").alias("length"),
        F.crc32("ids").alias("ids_crc32"),
        "doc_tokens",
        "sequence_id",
        "offset",
    )


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents"))
    counts = [F.expr(f"CAST(size(filter(base, x -> x.kind = {k})) AS BIGINT)").alias(f"n_{kind}") for k, kind in enumerate(pii.KINDS)]
    every = found.withColumn("every", F.array_sort(F.concat("base", "added")))
    return every.select("doc_id", *counts, F.sha2(pii.joined("base"), 256).alias("base_sha256"), pii.joined("every").alias("spans"))


def op5_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), url_filter.rules_table(spark))


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hexadecimal(F.col("fp")).alias("fingerprint"), "component_id")


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(table(spark, sf_dir, "documents"))


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sessions.sessions(table(spark, sf_dir, "clicks"))
    return found.withColumn("path_sha256", F.sha2("path", 256)).drop("path")


def op12_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_packing": op1_packing,
    "op2_license_scan": op2_license_scan,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_pii": op4_pii,
    "op5_exact_topk": op5_exact_topk,
    "op6_url_filter": op6_url_filter,
    "op7_simhash_near_dedup": op7_simhash_near_dedup,
    "op8_secret_scan": op8_secret_scan,
    "op9_source_mixing": op9_source_mixing,
    "op10_toxicity": op10_toxicity,
    "op11_sessions": op11_sessions,
    "op12_quality": op12_quality,
    "op13_collocations": op13_collocations,
}

_EXACT_DEDUP_SQL = r"""
WITH n AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents
), g AS (
  SELECT norm, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY norm
)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id AS kept, sha256(n.norm) AS text_sha256
FROM n JOIN g USING (norm)
"""

_TOPK_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 1024)::BIGINT) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         coalesce(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])), 0)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id
  WHERE q.vec_id % 100 = 0
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""

_URL_SQL = r"""
WITH r(host, path, verdict) AS (
  VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')
), split AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), u AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path
  FROM split
)
SELECT page_id, host, path,
       (SELECT arg_max(r.host || r.path, length(r.host || r.path)) FROM r
        WHERE (u.host = r.host OR ends_with(u.host, '.' || r.host)) AND starts_with(u.path, r.path)) AS rule,
       coalesce((SELECT arg_max(r.verdict, length(r.host || r.path)) FROM r
        WHERE (u.host = r.host OR ends_with(u.host, '.' || r.host)) AND starts_with(u.path, r.path)), 'allow') AS verdict
FROM u
"""

_MIXING_SQL = r"""
WITH sizes AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         ('0x' || substr(md5(doc_id::VARCHAR), 1, 15))::BIGINT AS key
  FROM documents
), totals AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS weight
  FROM sizes GROUP BY source
), ordered AS (
  SELECT *, 3 * source_size AS most, sum(source_size) OVER () AS total,
         row_number() OVER (ORDER BY 3.0 * source_size / weight, source NULLS LAST) AS place
  FROM totals
), levels AS (
  SELECT *, (total - coalesce(sum(most) OVER (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
            / (sum(weight) OVER (ORDER BY place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level
  FROM ordered
), first_below AS (
  SELECT arg_min(level, place) AS level, min(place) AS place FROM levels WHERE most::DOUBLE / weight >= level
), targets AS (
  SELECT l.source, l.source_size,
         CASE WHEN f.place IS NULL OR l.place < f.place THEN l.most::DOUBLE ELSE f.level * l.weight END AS target
  FROM levels l CROSS JOIN first_below f
), runs AS (
  SELECT s.doc_id, s.size, t.source_size, t.target, floor(t.target)::BIGINT AS budget,
         coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.key, s.doc_id
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM sizes s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       CASE WHEN source_size = 0 THEN 0
            ELSE (budget // source_size) * size + greatest(0, least(size, budget % source_size - before)) END::BIGINT AS taken
FROM runs
"""

_SESSIONS_SQL = """
WITH RECURSIVE once AS (
  SELECT click_id, client_id, epoch_us(ts) AS at_us, coalesce(epoch_us(arrived_at) - epoch_us(ts) > 21600000000, false) AS late,
         coalesce(kind = 'error' AND value >= 60, false) AS final, coalesce(floor(100 * value + 0.5)::BIGINT, 0) AS cents
  FROM clicks WHERE click_id IS NOT NULL AND client_id IS NOT NULL AND ts IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY click_id ORDER BY ts, arrived_at NULLS FIRST, client_id, kind, value) = 1
), timely AS (
  SELECT *, lag(at_us) OVER o AS prior, lag(final) OVER o AS prior_final, row_number() OVER o AS rn
  FROM once WHERE NOT late WINDOW o AS (PARTITION BY client_id ORDER BY at_us, click_id)
), marked AS (
  SELECT *, CASE WHEN prior IS NULL THEN 'none' WHEN prior_final THEN 'end' WHEN at_us - prior >= 600000000 THEN 'gap' END AS break
  FROM timely
), breaks AS (
  SELECT *, min(CASE WHEN break IS NOT NULL THEN rn END) OVER (PARTITION BY client_id ORDER BY rn ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_break
  FROM marked
), jumps AS (
  SELECT b.client_id, b.rn, b.break, nullif(least(coalesce(b.next_break, 1000000000), coalesce(t.rn, 1000000000)), 1000000000) AS next
  FROM breaks b ASOF LEFT JOIN (SELECT client_id, at_us, min(rn) AS rn FROM timely GROUP BY ALL) t ON b.client_id = t.client_id AND b.at_us + 2400000000 < t.at_us
), starts(client_id, rn) AS (
  SELECT client_id, rn FROM jumps WHERE break IS NOT NULL
  UNION
  SELECT s.client_id, j.next FROM starts s JOIN jumps j ON s.client_id = j.client_id AND s.rn = j.rn WHERE j.next IS NOT NULL
), spans AS (
  SELECT s.client_id, s.rn, b.click_id AS session_id, b.at_us AS start_us,
         lead(s.rn) OVER c AS until, lead(b.at_us) OVER c AS next_us, coalesce(lead(b.break) OVER c, 'length') AS next_break
  FROM starts s JOIN breaks b ON s.client_id = b.client_id AND s.rn = b.rn
  WINDOW c AS (PARTITION BY s.client_id ORDER BY s.rn)
), filled AS (
  SELECT s.client_id, s.session_id, s.start_us, s.next_us, max(t.at_us) AS end_us, count(*) AS n_clicks, sum(t.cents)::BIGINT AS value_cents,
         CASE WHEN any_value(s.until) IS NOT NULL THEN any_value(s.next_break) WHEN arg_max(t.final, t.rn) THEN 'end' ELSE 'none' END AS closed_by,
         sha256(string_agg(t.click_id::VARCHAR, ',' ORDER BY t.at_us, t.click_id)) AS path_sha256
  FROM spans s JOIN timely t ON s.client_id = t.client_id AND t.rn >= s.rn AND t.rn < coalesce(s.until, 1000000000)
  GROUP BY s.client_id, s.session_id, s.start_us, s.next_us
)
SELECT f.client_id, f.session_id, f.start_us, f.end_us, f.n_clicks, f.value_cents, f.closed_by, f.path_sha256,
       (SELECT count(*) FROM once l WHERE l.late AND l.client_id = f.client_id AND l.at_us >= f.start_us AND l.at_us < coalesce(f.next_us, 9223372036854775807)) AS n_late
FROM filled f
"""

_COLLOCATIONS_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), worded AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM pieces
), totals AS (
  SELECT lang, sum(len(ws))::BIGINT AS n FROM worded GROUP BY lang
), grams AS (
  SELECT lang, words, ws[i : i + words - 1] AS ws
  FROM (SELECT lang, ws, words, unnest(range(1, len(ws) - words + 2)) AS i FROM worded, (VALUES (1), (2), (3), (4)) v(words))
), counts AS (
  SELECT lang, words, ws, array_to_string(ws, ' ') AS phrase, count(*) AS f FROM grams GROUP BY lang, words, ws HAVING count(*) >= 30
), cuts AS (
  SELECT c.lang, c.phrase, c.ws, c.f AS a, k, array_to_string(c.ws[1 : k], ' ') AS head, array_to_string(c.ws[k + 1 :], ' ') AS rest
  FROM (SELECT *, unnest(range(1, words)) AS k FROM counts WHERE words > 1) c
), weakest AS (
  SELECT u.lang, u.phrase, u.a, l.f AS l, r.f AS r, (2000000 * u.a::HUGEINT // (l.f::HUGEINT + r.f))::BIGINT AS score
  FROM cuts u JOIN counts l ON u.lang = l.lang AND u.head = l.phrase JOIN counts r ON u.lang = r.lang AND u.rest = r.phrase
  QUALIFY row_number() OVER (PARTITION BY u.lang, u.phrase ORDER BY score, u.k) = 1
), inner_ AS (
  SELECT lang, array_to_string(ws[i : i + m - 1], ' ') AS phrase, max(f) AS outer_f
  FROM (SELECT lang, ws, f, m, unnest(range(1, words - m + 2)) AS i FROM counts, (VALUES (2), (3)) v(m) WHERE m < words)
  GROUP BY ALL
), ranked AS (
  SELECT w.*, row_number() OVER (PARTITION BY w.lang ORDER BY w.score DESC, w.a DESC, w.phrase) AS rank
  FROM weakest w LEFT JOIN inner_ i ON w.lang = i.lang AND w.phrase = i.phrase
  WHERE i.outer_f IS NULL OR 100 * i.outer_f::HUGEINT < 80 * w.a::HUGEINT
)
SELECT r.lang, r.rank, r.phrase, r.a, r.l, r.r, t.n, r.score FROM ranked r JOIN totals t ON r.lang = t.lang WHERE r.rank <= 2000
"""

ORACLES: dict[str, str] = {
    "op3_exact_dedup": _EXACT_DEDUP_SQL,
    "op5_exact_topk": _TOPK_SQL,
    "op6_url_filter": _URL_SQL,
    "op9_source_mixing": _MIXING_SQL,
    "op11_sessions": _SESSIONS_SQL,
    "op13_collocations": _COLLOCATIONS_SQL,
}
