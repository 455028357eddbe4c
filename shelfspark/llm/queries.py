"""The registered queries of the corpus operators, and the SQL of those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table


def op1_url_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .url_templates import judge_urls

    return judge_urls(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op4_golay_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .golay_simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix_sources

    return mix_sources(table(spark, sf_dir, "documents"))


def op7_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .piece_codec import encode_texts

    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:  # the driver's copy of the given vocabulary
        model = f.read()
    return encode_texts(table(spark, sf_dir, "documents"), model)


def op8_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .topk import top_k

    return top_k(table(spark, sf_dir, "embeddings"))


def op9_fm_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .fm_dedup import dedup_substrings

    return dedup_substrings(table(spark, sf_dir, "documents"))


def op2_audio_chroma(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No given table holds sound: each embedding is played as a melody of its numbers."""
    from .audio_chroma import align_recordings, melody

    return align_recordings(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", melody)


def op3_masked_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .masked_lm import score_documents

    return score_documents(table(spark, sf_dir, "documents"))


def op6_html_wrappers(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_wrappers import extract_main_text

    return extract_main_text(table(spark, sf_dir, "pages"))


def op10_weak_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .weak_quality import judge_quality

    return judge_quality(table(spark, sf_dir, "documents"), labels=table(spark, sf_dir, "labels"))


def op11_jaccard_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard_tiles import jaccard_join

    return jaccard_join(table(spark, sf_dir, "documents"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .hard_negatives import mine_hard_negatives

    noisy = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine_hard_negatives(table(spark, sf_dir, "embeddings").withColumn("label", noisy))


def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .fill_middle import fill_in_middle

    cut = fill_in_middle(table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_url_templates,
        op2_audio_chroma,
        op3_masked_lm,
        op4_golay_simhash,
        op5_source_mixing,
        op6_html_wrappers,
        op7_piece_codec,
        op8_exact_top_k,
        op9_fm_dedup,
        op10_weak_quality,
        op11_jaccard_tiles,
        op12_hard_negatives,
        op13_fill_middle,
    )
}

_WORDS = r"'[^\x20\x09-\x0D]+'"
ORACLES: dict[str, str] = {
    "op8_exact_top_k": """WITH v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
 WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
 s AS (SELECT a.r AS a, a.vec_id AS query_id, b.r AS b, b.vec_id, CAST(list_sum(list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * b.v[i])) AS BIGINT) AS score FROM v a JOIN v b ON a.r <> b.r WHERE a.vec_id % 20 = 0)
 SELECT query_id, CAST(place AS INTEGER) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, vec_id, b) AS place FROM s) WHERE place <= 20""",
    "op9_fm_dedup": f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), {_WORDS}) AS w FROM documents),
 x AS (SELECT r, i, array_to_string(w[i:i + 34], ' ') AS g FROM (SELECT r, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35)),
 gone AS (SELECT DISTINCT r, unnest(range(i, i + 35)) AS k FROM x WHERE g IN (SELECT g FROM x GROUP BY g HAVING count(*) > 1)),
 words AS (SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS k FROM d),
 kept AS (SELECT r, string_agg(word, ' ' ORDER BY k) AS t, count(*) AS n FROM words ANTI JOIN gone USING (r, k) GROUP BY r)
 SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (r)""",
    "op11_jaccard_tiles": f"""WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), {_WORDS}) AS w FROM documents),
 s AS (SELECT r, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS g FROM d),
 sized AS (SELECT r, doc_id, len(g) AS n, list_sort(g) AS g FROM s),
 c AS (SELECT g, min(r) AS c, any_value(n) AS n FROM sized WHERE n > 0 GROUP BY g),
 x AS (SELECT c, n, unnest(g) AS t FROM c),
 p AS (SELECT a.c AS u, b.c AS v FROM x a JOIN x b ON a.t = b.t AND a.c <> b.c GROUP BY a.c, b.c, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
 reach(u, v) AS (SELECT c, c FROM c UNION SELECT reach.u, p.v FROM reach JOIN p ON reach.v = p.u),
 members AS (SELECT c.c, sized.r, sized.doc_id FROM sized JOIN c ON sized.g = c.g),
 least AS (SELECT reach.u AS c, min(m.doc_id) AS component_id FROM reach JOIN members m ON m.c = reach.v GROUP BY reach.u)
 SELECT sized.doc_id, CAST(n AS BIGINT) AS n_shingles, CASE WHEN n > 0 THEN component_id ELSE sized.doc_id END AS component_id FROM sized LEFT JOIN members m ON m.r = sized.r LEFT JOIN least ON least.c = m.c""",
    "op12_hard_negatives": """WITH v AS (SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
 WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
 s AS (SELECT a.r AS a, a.vec_id AS anchor_id, b.r AS b, b.vec_id, a.label = b.label AS same, CAST(list_sum(list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * b.v[i])) AS BIGINT) AS score FROM v a JOIN v b ON a.r <> b.r WHERE a.vec_id % 100 = 0),
 p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, vec_id, b) AS k FROM s WHERE same) WHERE k <= 5),
 n AS (SELECT p.anchor_id, p.vec_id AS positive_id, p.score AS positive_score, s.vec_id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.score DESC, s.vec_id, s.b) AS k
  FROM p JOIN s ON p.a = s.a AND NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score)
 SELECT anchor_id, positive_id, CAST(k AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE k <= 10""",
    "op13_fill_middle": r"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS s FROM documents),
 h AS (SELECT doc_id, t, u, CAST(len(u) AS BIGINT) AS n, CAST('0x' || substr(s, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(s, 9, 8) AS BIGINT) AS h2, CAST('0x' || substr(s, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(s, 25, 8) AS BIGINT) AS h4 FROM d),
 c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b, CASE WHEN t = '' OR regexp_matches(t, '<P>|<S>|<M>') OR h3 % 100 >= 100 THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM h),
 p AS (SELECT *, coalesce(array_to_string(u[1:a], ''), '') AS x, coalesce(array_to_string(u[a + 1:b], ''), '') AS m, coalesce(array_to_string(u[b + 1:], ''), '') AS y FROM c)
 SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(x) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
 sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || x || '<S>' || y || '<M>' || m ELSE '<S>' || y || '<P>' || x || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256 FROM p""",
}
