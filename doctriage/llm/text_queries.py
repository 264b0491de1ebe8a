"""Queries over vectors and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from doctriage.llm import (
    conversations,
    hard_negatives,
    language,
    mixing,
    near_duplicates,
    neighbours,
    personal_data,
    quality,
    repeats,
    templates,
    token_counts,
)
from doctriage.llm.registry import query, table


@query(
    """
WITH usable AS (
    SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
      AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), scored AS (
    SELECT q.vec_id AS query_id, c.vec_id, max(list_cosine_similarity(q.v, c.v)) AS score
    FROM usable q JOIN usable c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(c.v) = len(q.v)
    GROUP BY ALL
), ranked AS (
    SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER)
           AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""
)
def op1_nearest_vectors(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings")
    return neighbours.nearest(vectors, F.col("vec_id") % 50 == 0, 5)


PAIRWISE_WORDS = near_duplicates.Likeness(words=2)


@query()
def op2_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates.near_duplicates(table(spark, folder, "documents"), PAIRWISE_WORDS)


@query()
def op3_language(spark: SparkSession, folder: str) -> DataFrame:
    return language.identify(table(spark, folder, "documents"))


@query()
def op5_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality.score(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query()
def op7_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    found = templates.leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark"), templates.WHOLE)
    return found.drop("print").distinct()


VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"


@query()
def op8_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    pieces = token_counts.ranked_pieces(VOCABULARY)
    return token_counts.count_tokens(table(spark, folder, "documents"), pieces)


def _sql_luhn(digits: str) -> str:
    return f"""list_sum(list_transform(range(0, length({digits})), lambda j:
        CASE WHEN j % 2 = 0 THEN CAST(substr({digits}, length({digits}) - j, 1) AS INTEGER)
             WHEN CAST(substr({digits}, length({digits}) - j, 1) AS INTEGER) > 4
             THEN CAST(substr({digits}, length({digits}) - j, 1) AS INTEGER) * 2 - 9
             ELSE CAST(substr({digits}, length({digits}) - j, 1) AS INTEGER) * 2 END)) % 10 = 0"""


def _sql_mod97() -> str:
    turned = "string_split(substr(replace(m, ' ', ''), 5) || substr(replace(m, ' ', ''), 1, 4), '')"
    values = f"list_transform({turned}, lambda c: CASE WHEN ascii(c) < 58 THEN ascii(c) - 48 ELSE ascii(c) - 55 END)"
    step = "CASE WHEN v < 10 THEN (r * 10 + v) % 97 ELSE (r * 100 + v) % 97 END"
    return f"list_reduce(list_prepend(0, {values}), lambda r, v: {step}) = 1"


def _sql_personal_data() -> str:
    """Spans per kind from matches and the pieces between them, scored by their context."""
    digits = "regexp_replace(m, '[^0-9]', '', 'g')"
    valid = {
        "email": "true",
        "ip": f"regexp_matches(m, '^{personal_data.PART}([.]{personal_data.PART}){{3}}$')",
        "card": f"length({digits}) BETWEEN 12 AND 19 AND {_sql_luhn(digits)}",
        "phone": f"length({digits}) BETWEEN 9 AND 15",
        "iban": _sql_mod97(),
        "ssn": "NOT regexp_matches(m, '^(000|666|9)') AND NOT regexp_matches(m, '-00-|-0000$')",
    }
    plain = {
        "email": "[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+([.][A-Za-z0-9-]+)+",
        "ip": "[0-9]+([.][0-9]+)([.][0-9]+)([.][0-9]+)",
        "card": "[0-9]([ -]?[0-9])+",
    }
    parts = []
    for at, kind in enumerate(personal_data.KINDS):
        pattern = plain.get(kind.name, kind.pattern)
        parts.append(f"""
    SELECT doc_id, {at} AS k, '{kind.name}' AS kind, start, start + length(m) AS stop, score FROM (
        SELECT *, greatest(0, least(100, {kind.score}
                 + CASE WHEN regexp_matches(context, '{kind.near}') THEN 20 ELSE 0 END
                 - CASE WHEN regexp_matches(context, '{kind.far}') THEN 20 ELSE 0 END)) AS score FROM (
            SELECT doc_id, ms[i] AS m, lower(right(ps[i], 40) || ' ' || left(ps[i + 1], 20)) AS context,
                   CAST(list_sum(list_transform(ps[1:i], lambda x: length(x)))
                     + coalesce(list_sum(list_transform(ms[1:i-1], lambda x: length(x))), 0) AS BIGINT) AS start
            FROM (SELECT doc_id, ms, string_split_regex(t, '{pattern}') AS ps, unnest(range(1, len(ms) + 1)) AS i
                  FROM (SELECT doc_id, t, regexp_extract_all(t, '{pattern}') AS ms FROM docs)))
        WHERE {valid[kind.name]}) WHERE {str(kind.base).lower()} OR score >= {personal_data.LEAST_SCORE}""")
    counts = ", ".join(
        f"count(*) FILTER (k = {at}) AS n_{kind.name}" for at, kind in enumerate(personal_data.KINDS)
    )
    line = "kind || ':' || start || ':' || stop"
    return f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
spans AS ({" UNION ALL ".join(parts)})
SELECT d.doc_id, {counts},
       sha256(coalesce(string_agg({line}, ',' ORDER BY start, k) FILTER (k < 4), '')) AS base_sha256,
       coalesce(string_agg({line}, ',' ORDER BY start, k), '') AS spans,
       coalesce(string_agg({line} || ':' || score, ',' ORDER BY start, k), '') AS scored_spans
FROM docs d LEFT JOIN spans s ON s.doc_id = d.doc_id GROUP BY d.doc_id
"""


@query(_sql_personal_data())
def op9_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    return personal_data.find(table(spark, folder, "documents"))


MIXTURE_SHARE = (3, 5)


def mixture() -> mixing.Targets:
    """Four domains of sources; later domains, English and some sources weigh more."""
    number = F.regexp_extract("source", "[0-9]+", 0).try_cast("long")
    domain = F.substring("domain", 2, 9).try_cast("long")
    lang = F.col("lang")
    return mixing.Targets(
        domain=F.concat(F.lit("d"), number % 4),
        weights=(
            F.coalesce(domain, F.lit(0)) + 1,
            F.when(lang == "en", 4).when(lang.isin("de", "fr"), 2).otherwise(1),
            F.coalesce(number, F.lit(0)) % 3 + 1,
        ),
    )



def _sql_share_out(nodes: str, parent: str, name: str) -> str:
    """The nodes with what they are given of the budget of their parent."""
    by = f"PARTITION BY {parent}" if parent else ""
    return f"""
    SELECT *, CASE WHEN is_full THEN capacity ELSE CAST(
        rest * (every - rest_weight + weight) // every - rest * (every - rest_weight) // every AS BIGINT) END AS given
    FROM (SELECT *, max(CASE WHEN NOT is_full AND rest_weight = every THEN free END) OVER ({by}) AS rest
    FROM (SELECT *, max(CASE WHEN NOT is_full THEN rest_weight END) OVER ({by}) AS every
    FROM (SELECT *, capacity::HUGEINT * rest_weight <= free * weight AS is_full
    FROM (SELECT *, budget::HUGEINT - coalesce(sum(capacity) OVER (
                 {by} ORDER BY capacity::DOUBLE / weight, {name} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS free,
               sum(weight) OVER ({by} ORDER BY capacity::DOUBLE / weight, {name}
                 ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest_weight
    FROM ({nodes})))))"""


_SQL_LANG_WEIGHT = "CASE WHEN lang = 'en' THEN 4 WHEN lang IN ('de', 'fr') THEN 2 ELSE 1 END"


@query(
    f"""
WITH rows AS (
    SELECT doc_id, 'd' || (CAST(regexp_extract(source, '[0-9]+') AS BIGINT) % 4) AS domain, lang, source,
           CAST(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS n_tokens FROM documents
), leaves AS (
    SELECT domain, lang, source, CAST(sum(n_tokens) AS BIGINT) AS supply, CAST(sum(n_tokens) * 2 AS BIGINT) AS capacity
    FROM rows GROUP BY ALL
), top AS ({_sql_share_out('''
    SELECT domain, CAST(sum(capacity) AS BIGINT) AS capacity, CAST(substr(domain, 2) AS BIGINT) + 1 AS weight,
           (SELECT CAST(sum(supply) AS BIGINT) * 3 // 5 FROM leaves) AS budget FROM leaves GROUP BY domain''', '', 'domain')}
), middle AS ({_sql_share_out(f'''
    SELECT l.domain, lang, CAST(sum(l.capacity) AS BIGINT) AS capacity, {_SQL_LANG_WEIGHT} AS weight, any_value(t.given) AS budget
    FROM leaves l JOIN top t ON t.domain = l.domain GROUP BY l.domain, lang''', 'domain', 'lang')}
), bottom AS ({_sql_share_out('''
    SELECT l.domain, l.lang, l.source, l.supply, l.capacity, CAST(regexp_extract(l.source, '[0-9]+') AS BIGINT) % 3 + 1 AS weight,
           m.given AS budget FROM leaves l JOIN middle m ON m.domain = l.domain AND m.lang = l.lang''', 'domain, lang', 'source')}
), planned AS (
    SELECT *, CAST(given // greatest(supply, 1) AS INTEGER) AS whole, given % greatest(supply, 1) AS part FROM bottom
), queued AS (
    SELECT r.*, p.whole, p.part, coalesce(sum(n_tokens) OVER (PARTITION BY r.domain, r.lang, r.source
             ORDER BY md5('17:' || p.whole || ':' || r.doc_id), n_tokens
             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead
    FROM rows r JOIN planned p ON p.domain = r.domain AND p.lang = r.lang AND p.source = r.source
)
SELECT doc_id, whole AS epoch, domain, lang, source, n_tokens FROM queued WHERE ahead < part
UNION ALL
SELECT doc_id, CAST(unnest(range(0, whole)) AS INTEGER) AS epoch, domain, lang, source, n_tokens FROM queued
"""
)
def op10_mixture(spark: SparkSession, folder: str) -> DataFrame:
    chosen = mixing.choose(table(spark, folder, "documents"), mixture(), MIXTURE_SHARE)
    return chosen.drop("key")


@query(
    """
WITH usable AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
           list_transform(embedding, lambda x: CAST(floor(256 * x::DOUBLE) AS BIGINT)) AS v
    FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), scored AS (
    SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same,
           CAST(coalesce(list_sum(list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * c.v[i])), 0) AS BIGINT) AS score
    FROM usable a JOIN usable c ON a.vec_id % 50 = 0 AND c.vec_id <> a.vec_id AND len(c.v) = len(a.v)
), positives AS (
    SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT p.anchor_id, positive_id,
       CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
       vec_id AS negative_id, positive_score, score AS negative_score
FROM positives p JOIN scored n ON n.anchor_id = p.anchor_id AND NOT same
    AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY rank <= 3
"""
)
def op12_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(table(spark, folder, "embeddings"), F.col("vec_id") % 50 == 0, label=label)


@query(
    """
WITH texts AS (
    SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), strings AS (
    SELECT r, p, md5(substr(h, 2 * p + 1, 400)) AS m FROM (SELECT r, h, unnest(range(0, len(h) // 2 - 199)) AS p FROM texts)
), again AS (
    SELECT r, p FROM strings JOIN (SELECT m FROM strings GROUP BY m HAVING count(*) > 1) USING (m)
), numbered AS (
    SELECT r, p, sum(CASE WHEN p <= before + 200 THEN 0 ELSE 1 END) OVER (PARTITION BY r ORDER BY p) AS run
    FROM (SELECT *, lag(p) OVER (PARTITION BY r ORDER BY p) AS before FROM again)
), runs AS (
    SELECT r, min(p) AS start, max(p) + 200 AS stop FROM numbered GROUP BY r, run
), pieces AS (
    SELECT r, start, substr(h, 2 * coalesce(lag(stop) OVER (PARTITION BY r ORDER BY start), 0) + 1,
           2 * (start - coalesce(lag(stop) OVER (PARTITION BY r ORDER BY start), 0))) AS piece
    FROM runs JOIN texts USING (r)
), found AS (
    SELECT r, count(*) AS n_spans, CAST(sum(stop - start) AS BIGINT) AS n_removed, max(stop) AS last FROM runs GROUP BY r
), kept AS (
    SELECT r, string_agg(piece, '' ORDER BY start) AS front FROM pieces GROUP BY r
)
SELECT doc_id, len(h) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(coalesce(front, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM texts LEFT JOIN found USING (r) LEFT JOIN kept USING (r)
"""
)
def op13_repeats(spark: SparkSession, folder: str) -> DataFrame:
    cut = repeats.remove_repeats(table(spark, folder, "documents"))
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query()
def op11_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    turns = table(spark, folder, "conversations")
    return conversations.repair(conversations.damaged(turns), turns.select("conv_id"))
