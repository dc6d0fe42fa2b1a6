"""One query opN_<name> for each operator, over whole tables, and their SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.ngram_join import jaccard_components

    return jaccard_components(table(spark, sf_dir, "documents"), k=4, percent=85)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.substring_dedup import from_both_sides, repeated_passages

    return from_both_sides(repeated_passages(table(spark, sf_dir, "documents")))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm import toxicity as X
    from tessera.llm.language_id import held_out

    docs = table(spark, sf_dir, "documents")
    model = X.fit(docs, table(spark, sf_dir, "labels"))
    out = X.score(docs.select("doc_id", held_out("doc_id", 3, 1).alias("held_out"), "text"), "text", model)
    return out.withColumn("predicted", (F.col("score") >= 0.7).cast("int"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm import secrets as S

    found = S.find_secrets(table(spark, sf_dir, "documents"))
    every = F.array_sort(F.concat("base", "extra"))
    counts = [S.count_kind(F.col("base"), k).alias(f"n_{k}") for k in ("assign", "access", "hex")]
    return found.select("doc_id", *counts, F.sha2(S.listed(F.col("base")).cast("binary"), 256).alias("base_sha256"), S.listed(every).alias("spans"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"))


def op5_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.ann import nearest

    return nearest(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", F.col("vec_id") % 20 == 0, k=20)


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.line_dedup import dedup_lines

    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", F.length("text").alias("n_chars_kept"), F.md5("text").alias("text_md5"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm import mixing as M

    docs, text = table(spark, sf_dir, "documents").select("doc_id", "source", "text"), F.col("text")
    return M.mix(docs, "doc_id", "source", M.n_words(text), M.quality(text), F.xxhash64("text"), keep=["doc_id"]).select("doc_id", "size", "source_size", "target", "taken")


def op8_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.topk import exact_top_k

    return exact_top_k(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", F.col("vec_id") % 50 == 0, k=5)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm import language_id as L

    docs = table(spark, sf_dir, "documents")
    model = L.fit(L.learnable(docs))
    rows = docs.select("doc_id", L.held_out("doc_id", 5, 0).alias("held_out"), "text")
    return L.predict(rows, "text", model)


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.token_alignment import align

    return align(table(spark, sf_dir, "documents"))


def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.simhash import near_copies

    return near_copies(table(spark, sf_dir, "documents"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.prefix_trie import prefix_trie, rebuilt

    return prefix_trie(rebuilt(table(spark, sf_dir, "conversations")))


QUERIES = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_toxicity": op2_toxicity,
    "op3_secret_scan": op3_secret_scan,
    "op4_packing": op4_packing,
    "op5_ann": op5_ann,
    "op6_line_dedup": op6_line_dedup,
    "op7_mixing": op7_mixing,
    "op8_exact_top_k": op8_exact_top_k,
    "op9_language_id": op9_language_id,
    "op10_ngram_jaccard": op10_ngram_jaccard,
    "op11_token_alignment": op11_token_alignment,
    "op12_simhash": op12_simhash,
    "op13_prefix_trie": op13_prefix_trie,
}
#: The others rest on hashes, models or a tokenizer that SQL doesn't have; tests hold them against brute force.
ORACLE_SQL: dict[str, str] = {
    "op8_exact_top_k": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS w
            FROM embeddings
            WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
            SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.w, c.w) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
        ), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM s)
        SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM r WHERE n <= 5""",
    "op10_ngram_jaccard": r"""
        WITH RECURSIVE w AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
        ), g AS (
            SELECT DISTINCT doc_id, array_to_string(w[k:k + 3], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 2))) AS k FROM w WHERE len(w) > 0)
        ), n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
        l AS (
            SELECT a.doc_id AS x, b.doc_id AS y FROM g a JOIN g b ON a.g = b.g AND a.doc_id <> b.doc_id JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id
            GROUP BY a.doc_id, b.doc_id, na.n, nb.n HAVING 100 * count(*) >= 85 * (na.n + nb.n - count(*))
        ), r AS (SELECT doc_id, doc_id AS c FROM documents UNION SELECT l.y AS doc_id, r.c FROM r JOIN l ON l.x = r.doc_id)
        SELECT r.doc_id, coalesce(max(n), 0) AS n_shingles, min(c) AS component_id FROM r LEFT JOIN n ON n.doc_id = r.doc_id GROUP BY r.doc_id""",
    "op13_prefix_trie": r"""
        WITH own AS (
            SELECT conv_id, list({'r': coalesce(role, ''), 't': coalesce(text, '')} ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS w FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
        ), h AS (
            SELECT conv_id, w, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ord(x) AS BIGINT))),
                lambda c, b: list_reduce(list_prepend(xor(c, b), list_transform(range(8), lambda k: CAST(k AS BIGINT))), lambda x, k: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) % 6 AS h FROM own
        ), p AS (
            SELECT h.conv_id, list_concat(coalesce(f.w, [])[1:CAST(h AS INTEGER)], h.w[CAST(h AS INTEGER) + 1:]) AS w FROM h LEFT JOIN own f ON f.conv_id = h.conv_id - h.conv_id % 100
        ), m AS (SELECT conv_id, len(w) AS n, d, w[1:d] AS w FROM (SELECT conv_id, w, unnest(range(0, len(w) + 1)) AS d FROM p)),
        n AS (
            SELECT w, min(d) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (n = d), '')) AS ends_sha256 FROM m GROUP BY w
        ), c AS (SELECT w[1:depth - 1] AS w, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY ALL),
        u AS (SELECT n.*, coalesce(c.n_children, 0) AS n_children FROM n LEFT JOIN c ON c.w = n.w),
        b AS (
            SELECT w[1:e] AS w, CAST(sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_leaves, CAST(sum((n_convs - 1) * size) AS BIGINT) AS saved_tokens
            FROM (SELECT w, n_children, n_convs, CASE WHEN depth = 0 THEN 0 ELSE length(w[depth].t) END AS size, unnest(range(0, depth + 1)) AS e FROM u) GROUP BY ALL
        )
        SELECT u.conv_id, u.depth, a.conv_id AS parent_conv_id, u.n_convs, u.n_children, b.n_leaves, b.saved_tokens, u.ends_sha256
        FROM u JOIN b ON b.w = u.w LEFT JOIN n a ON u.depth > 0 AND a.w = u.w[1:u.depth - 1]""",
}
