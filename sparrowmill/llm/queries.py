"""Queries over the given tables, one for each operator of this package, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, exact_dedup, html_text, licenses, lm_scoring, mixing, near_dedup, periodic, quality, repeats, spelling, token_counts, topk
from .common import query_source

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
PIECES = "piece_bpe_32k.model"


def tokenizer_files() -> tuple[str, str]:
    """Path of the ranks and the pattern that cuts texts."""
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN


def piece_file() -> str:
    import public_tokenizers

    return public_tokenizers.path(PIECES)


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = query_source(spark, sf_dir, "documents")
    return lm_scoring.score(docs, lm_scoring.good_ids(query_source(spark, sf_dir, "labels")))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = repeats.remove_repeats(query_source(spark, sf_dir, "documents"), keep_bytes=False)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_digest(query_source(spark, sf_dir, "documents"))


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_classes(query_source(spark, sf_dir, "documents"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.classes(query_source(spark, sf_dir, "documents"))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(query_source(spark, sf_dir, "documents"), *tokenizer_files())


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = query_source(spark, sf_dir, "documents")
    return quality.judge(docs, quality.fit(docs))


def op8_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(query_source(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.plan_mix(query_source(spark, sf_dir, "documents"))


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(query_source(spark, sf_dir, "pages"))


def op11_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.digest(periodic.scan(periodic.plant(query_source(spark, sf_dir, "documents"))))


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count(query_source(spark, sf_dir, "documents"), piece_file(), 4096)


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(query_source(spark, sf_dir, "documents"))


def queries() -> dict:
    listed = (op1_lm_scoring, op2_suffix_dedup, op3_license_scan, op4_near_dedup, op5_exact_dedup, op6_byte_bpe, op7_quality, op8_topk, op9_mixing, op10_html_text, op11_runs, op12_token_counts, op13_spelling)
    return {f.__name__: f for f in listed}


def oracle_sql() -> dict[str, str]:
    words = r"[^\x20\x09-\x0D]+"
    return {
        "op5_exact_dedup": r"""
            WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS body FROM documents)
            SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, sha256(body) AS text_sha256
            FROM t WINDOW w AS (PARTITION BY body)""",
        "op8_topk": """
            WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
                       WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
            s AS (SELECT a.vec_id AS query_id, b.vec_id, CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2])) AS BIGINT) AS score
                  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
            r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM s)
            SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM r WHERE n <= 5""",
        "op9_mixing": rf"""
            WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{words}')) AS BIGINT) AS size FROM documents),
            s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
            w AS (SELECT *, list_extract([3.0, 1.0, 2.0], (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::DOUBLE AS weight FROM s),
            c AS (SELECT *, 2.0::DOUBLE * source_size AS cap, (2.0::DOUBLE * source_size) / weight AS ratio FROM w),
            l AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER o, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER o, 0)) AS level
                  FROM c WINDOW o AS (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
            f AS (SELECT min_by(level, ratio) AS level FROM l WHERE level * weight <= cap),
            t AS (SELECT source, source_size, least(cap, coalesce(f.level * weight, cap)) AS target FROM l LEFT JOIN f ON true),
            p AS (SELECT d.doc_id, d.size, t.source_size, t.target, CAST(round(t.target) AS BIGINT) AS budget,
                         CAST(coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY md5(CAST(d.doc_id AS VARCHAR) || '|1'), d.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS begin
                  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
            e AS (SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS epochs FROM p)
            SELECT doc_id, size, source_size, target, CAST(epochs * size + greatest(0, least(size, budget - epochs * source_size - begin)) AS BIGINT) AS taken FROM e""",
        "op13_spelling": r"""
            WITH RECURSIVE bits AS (SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS tab FROM range(256) r(i)),
            runs AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{00C0}-\x{00FF}]+')) AS run FROM documents),
            per AS (SELECT run, count(*) AS n, hex(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run) AS h FROM runs WHERE length(run) >= 7 GROUP BY doc_id, run),
            crc AS (SELECT run, n, xor(4294967295, list_reduce([4294967295] || list_transform(range(length(h) // 2), lambda i: CAST('0x' || substr(h, 2 * i + 1, 2) AS BIGINT)), lambda c, b: xor(c >> 8, tab[xor(c, b) % 256 + 1]))) AS c FROM per, bits),
            made AS (SELECT CASE WHEN c % 31 = 0 THEN left(run, CAST(c % length(run) AS INTEGER)) || substr(run, CAST(c % length(run) AS INTEGER) + 2) ELSE run END AS word, n FROM crc),
            w AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM made WHERE length(word) >= 7 GROUP BY 1 HAVING sum(n) >= 2),
            spot AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w),
            gap AS (SELECT word, n, left(word, i - 1) || '*' || substr(word, i + 1) AS pat, left(word, i - 1) || substr(word, i + 1) AS cut FROM spot),
            ins AS (SELECT DISTINCT g.word AS a, w.word AS b, g.n AS an, w.n AS bn FROM gap g JOIN w ON g.cut = w.word),
            near AS (SELECT a.word AS a, b.word AS b, b.n AS bn FROM gap a JOIN gap b ON a.pat = b.pat AND a.word <> b.word UNION ALL SELECT a, b, bn FROM ins UNION ALL SELECT b, a, an FROM ins),
            best AS (SELECT a, b, bn, count(*) OVER (PARTITION BY a) AS n_near, row_number() OVER (PARTITION BY a ORDER BY bn DESC, b) AS r FROM near),
            f AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN bn >= 10 * w.n THEN b END AS form, CASE WHEN bn >= 10 * w.n THEN bn END AS form_n FROM w LEFT JOIN best ON best.a = w.word AND r = 1),
            ch AS (SELECT word, form AS root FROM f WHERE form IS NOT NULL UNION ALL SELECT ch.word, f.form FROM ch JOIN f ON f.word = ch.root WHERE f.form IS NOT NULL),
            en AS (SELECT ch.word, ch.root FROM ch JOIN f ON f.word = ch.root WHERE f.form IS NULL)
            SELECT f.word, form, coalesce(en.root, f.word) AS root, n, n_near, form_n FROM f LEFT JOIN en ON en.word = f.word""",
    }
