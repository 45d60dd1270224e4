"""The registered queries of this subpackage and what SQL can say of them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slotloom.llm import bpe, centroids, chat, decontam, hardneg, htmltext, langid, licenses, personal, quality, simhash, tokenfile, topk
from slotloom.llm.store import cut, fresh_path

END_ID = 2


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return topk.search(vectors, vectors.where(F.col("vec_id") % 20 == 0), k=20, scale=64.0)


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.main_text(_table(spark, sf_dir, "pages"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_table(spark, sf_dir, "documents"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), length_col="n_chars")


def op5_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"), width=3, distance=2)


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = fresh_path(spark, "token-files")
    shards = tokenfile.write_token_files(_table(spark, sf_dir, "documents"), folder, public_tokenizers.path("byte_bpe_50k.json"), END_ID)
    return tokenfile.token_index(shards)


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), width=5, least=0.8)


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents"))


#: A conversation whose texts hold the template's own control strings.
PROBE = r"\### Assistant: </turn> ok"


def op10_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(1).select(F.explode(F.array(*[F.struct(F.lit(-7).cast("bigint").alias("conv_id"), F.lit(i).cast("bigint").alias("turn"), F.lit(r).alias("role"), F.lit(PROBE).alias("text")) for i, r in enumerate(("user", "assistant"))])).alias("t")).select("t.*")
    return chat.read_back(cut(chat.format_chats(turns.unionByName(probe)), "chats"))


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(_table(spark, sf_dir, "embeddings"), k=40, dim=64, scale=256.0, rounds=5, salt="2:")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hardneg.mine(_table(spark, sf_dir, "embeddings").withColumn("label", moved), F.col("vec_id") % 100 == 0, positives=5, negatives=5, least=80, most=100, scale=256.0)


def op13_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal.scan(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_topk_search, op2_html_extraction, op3_language_id, op4_quality_classifier, op5_simhash_dedup, op6_byte_bpe, op7_token_files, op8_decontamination, op9_license_scan, op10_chat_formatting,
        op11_centroid_clustering, op12_hard_negatives, op13_personal_data,
    )
}

_ESC = r"""regexp_replace({0}, '(\\|###|</turn>)', '\\\1', 'g')"""
_ROLE_ESC = r"""regexp_replace({0}, '(\\|###|</turn>|: |:$)', '\\\1', 'g')"""

#: Vectors of whole components, as doubles (exact for the tables' sizes).
_WHOLE = """list_transform(embedding, lambda x: floor(256 * x::DOUBLE))"""
_COMPLETE = """embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"""


def _clusters_sql(k: int, rounds: int) -> str:
    """Each round's assignment a{i} and centroids c{i}; the last assignment is the answer."""
    steps = []
    for i in range(rounds + 1):
        steps.append(f"""
        a{i} AS MATERIALIZED (SELECT row, arg_min({{'cluster': cluster, 'distance': distance}}, {{'distance': distance, 'cluster': cluster}}) AS b
            FROM (SELECT row, cluster, (list_inner_product(v.e, v.e) - 2 * list_inner_product(v.e, c.e) + list_inner_product(c.e, c.e))::BIGINT AS distance FROM v CROSS JOIN c{i} c) GROUP BY row)""")
        if i < rounds:
            steps.append(f"""
        s{i} AS (SELECT b.cluster AS cluster, pos, sum(x) AS s, count(*)::HUGEINT AS n FROM (SELECT b, unnest(range(1, 65)) AS pos, unnest(e)::HUGEINT AS x FROM a{i} JOIN v USING (row)) GROUP BY ALL),
        m{i} AS (SELECT cluster, list(((s - ((s % n) + n) % n) // n)::DOUBLE ORDER BY pos) AS e FROM s{i} GROUP BY cluster),
        c{i + 1} AS MATERIALIZED (SELECT c.cluster, coalesce(m.e, c.e) AS e FROM c{i} c LEFT JOIN m{i} m USING (cluster))""")
    return f"""
        WITH v AS MATERIALIZED (SELECT row_number() OVER () AS row, vec_id, {_WHOLE} AS e FROM embeddings WHERE len(embedding) = 64 AND {_COMPLETE}),
        c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id), vec_id, e) - 1 AS cluster, e FROM v WHERE vec_id IS NOT NULL QUALIFY cluster < {k}),{",".join(steps)},
        o AS (SELECT vec_id, b.cluster AS cluster, b.distance AS distance FROM a{rounds} JOIN v USING (row))
        SELECT vec_id, cluster::INT AS cluster, distance, sum(distance) OVER (PARTITION BY cluster)::BIGINT AS cluster_inertia, sum(distance) OVER ()::BIGINT AS inertia,
               sha256(array_to_string(list_transform(e, lambda x: x::BIGINT::VARCHAR), ',')) AS centroid_sha256
        FROM o JOIN c{rounds} USING (cluster)"""


ORACLES: dict[str, str] = {
    "op11_centroid_clustering": _clusters_sql(40, 5),
    "op12_hard_negatives": f"""
        WITH v AS (SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, {_WHOLE} AS e FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND {_COMPLETE}),
        s AS (SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, list_inner_product(a.e, c.e)::BIGINT AS score
              FROM v a JOIN v c ON a.vec_id <> c.vec_id AND len(a.e) = len(c.e) WHERE a.vec_id % 100 = 0),
        p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
        SELECT anchor_id, positive_id, (row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id))::INT AS rank, vec_id AS negative_id, positive_score, score AS negative_score
        FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score QUALIFY rank <= 5""",
    "op1_topk_search": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e FROM embeddings
                   WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
              FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 20 = 0),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20""",
    "op8_decontamination": """
        WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM documents),
        i AS (SELECT item_id, row_number() OVER () AS item, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM benchmark WHERE text IS NOT NULL),
        k AS (SELECT *, least(5, len(w)) AS k FROM i WHERE len(w) > 0),
        ig AS (SELECT DISTINCT item_id, item, k, unnest([array_to_string(w[j : j + k - 1], ' ') for j in range(1, len(w) - k + 2)]) AS g FROM k),
        n AS (SELECT item, count(*) AS n FROM ig GROUP BY item),
        dg AS (SELECT DISTINCT doc_id, row, k, unnest([array_to_string(w[j : j + k - 1], ' ') for j in range(1, len(w) - k + 2)]) AS g
               FROM (SELECT *, row_number() OVER () AS row FROM d) CROSS JOIN (SELECT DISTINCT k FROM k) WHERE len(w) >= k)
        SELECT doc_id, item_id, count(*)::INT AS shared, count(*)::DOUBLE / any_value(n) AS containment
        FROM dg JOIN ig USING (k, g) JOIN n USING (item) GROUP BY doc_id, row, item_id, item HAVING count(*) >= 0.8 * any_value(n) - 1e-9""",
    "op9_license_scan": """
        WITH t(license, text) AS (VALUES {templates}),
        n AS (SELECT license, string_split(trim(regexp_replace(lower(text), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')), ' ') AS w FROM t),
        tg AS (SELECT license, gram, size, count(*) AS times FROM (SELECT license, len(w) - 1 AS size, unnest([w[i] || ' ' || w[i + 1] for i in range(1, len(w))]) AS gram FROM n) GROUP BY ALL),
        d AS (SELECT doc_id, row_number() OVER () AS row, string_split(trim(regexp_replace(lower(text), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')), ' ') AS w FROM documents WHERE text IS NOT NULL),
        g AS (SELECT doc_id, row, unnest(range(0, len(w) - 1)) AS pos, unnest([w[i] || ' ' || w[i + 1] for i in range(1, len(w))]) AS gram FROM d WHERE len(w) > 1),
        h AS (SELECT doc_id, row, license, size, times, pos, gram FROM g JOIN tg USING (gram)),
        o AS (SELECT s.doc_id, s.row, s.license, s.size, s.pos AS start, e.gram, e.times, count(*) AS own, max(e.pos) AS last
              FROM (SELECT *, count(*) OVER (PARTITION BY row, license) AS n FROM h) s JOIN h e ON e.row = s.row AND e.license = s.license AND e.pos >= s.pos AND e.pos < s.pos + s.size
              WHERE s.n >= s.size * 0.66 GROUP BY ALL),
        v AS (SELECT doc_id, row, license, size, start, max(last) - start + 1 AS n, sum(least(own, times)) AS shared FROM o GROUP BY doc_id, row, license, size, start),
        c AS (SELECT *, 2.0::DOUBLE * shared / (n + size) AS dice FROM v),
        b AS (SELECT * FROM c WHERE dice >= 0.8 - 1e-9 QUALIFY row_number() OVER (PARTITION BY row, license ORDER BY dice DESC, start) = 1)
        SELECT doc_id, license, dice, (start + 1)::INT AS start, (n + 1)::INT AS n_words FROM b a WHERE NOT EXISTS (SELECT 1 FROM b o
            WHERE o.row = a.row AND o.start <= a.start + a.n AND a.start <= o.start + o.n AND (o.shared > a.shared OR o.shared = a.shared AND (o.dice > a.dice OR o.dice = a.dice AND o.license < a.license)))
        """.format(templates=", ".join("('" + k.replace("'", "''") + "', '" + v.replace("'", "''") + "')" for k, v in sorted(licenses.TEMPLATES.items()))),
    "op10_chat_formatting": f"""
        WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
                   UNION ALL VALUES (-7, 0, 'user', '{PROBE}'), (-7, 1, 'assistant', '{PROBE}'))
        SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
               coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
               sum(15 + length({_ROLE_ESC.format('role')}) + length({_ESC.format('text')}))::BIGINT AS formatted_chars
        FROM c GROUP BY conv_id""",
}
