"""The registered queries ``opN_<name>`` with their production parameters, and the SQL of those that SQL can express."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomset.llm import (
    bpe,
    chat_trees,
    collocations,
    hard_negatives,
    language_model,
    packing,
    pii,
    quality_classifier,
    quality_rules,
    simhash,
    suffix_array,
    token_files,
    topk,
)
from loomset.llm.common import is_held_out, table
from loomset.session import scratch_path


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    """The production vocabulary: the installed public file, or the folder named by LOOMSET_TOKENIZERS."""
    folder = os.environ.get("LOOMSET_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def trusted_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trusted target: documents labelled good and not toxic."""
    return table(spark, sf_dir, "labels").where("quality = 1 and toxic = 0").select("doc_id")


def op1_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_array.dedup(table(spark, sf_dir, "documents"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op3_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.score(table(spark, sf_dir, "documents"), is_held_out(7, 2))


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), k=20, modulus=20, scale=64)


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.counts(pii.mask(docs, pii.default_key(), found="found"), "found")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary_path()).drop("copy")


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    turns = turns.unionByName(chat_trees.control_conversation(spark))
    # rows without an id are one conversation; op7's trees need a key that is not null
    named = turns.withColumn("tree", F.coalesce(F.col("conv_id").cast("string"), F.lit("")))
    found = chat_trees.digest(chat_trees.format_trees(chat_trees.chain(named, "tree", "turn")))
    return found.withColumn("conv_id", F.expr("try_cast(nullif(conv_id, '') as long)"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_classifier.score(docs, quality_classifier.fit(docs, table(spark, sf_dir, "labels")))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"), trusted_documents(spark, sf_dir))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(table(spark, sf_dir, "documents"), vocabulary_path())


def op11_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_path(spark, "token-files")
    return token_files.digests(token_files.write(table(spark, sf_dir, "documents"), folder, vocabulary_path("word_bpe_49k.json"), end_id=2))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(table(spark, sf_dir, "documents"), least=100, longest=5, first=2000, factor=1000)


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = vectors.select("vec_id", moved.alias("label"), "embedding")
    return hard_negatives.mine(vectors, modulus=100, positives=5, negatives=10, low=30, high=90, scale=256)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_suffix_array": op1_suffix_array,
    "op2_simhash": op2_simhash,
    "op3_language_model": op3_language_model,
    "op4_topk": op4_topk,
    "op5_pii": op5_pii,
    "op6_packing": op6_packing,
    "op7_chat": op7_chat,
    "op8_quality_classifier": op8_quality_classifier,
    "op9_quality_rules": op9_quality_rules,
    "op10_bpe": op10_bpe,
    "op11_token_files": op11_token_files,
    "op12_collocations": op12_collocations,
    "op13_hard_negatives": op13_hard_negatives,
}

ORACLE: dict[str, str] = {
    "op1_suffix_array": """
        WITH texts AS (
            SELECT doc_id, hex(encode(coalesce(text, ''))) AS x, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
        windows AS (
            SELECT doc_id, k, substr(x, 2 * k + 1, 100) AS s
            FROM (SELECT doc_id, x, unnest(range(0, n - 49)) AS k FROM texts)),
        least AS (SELECT s, min(doc_id) AS first_id FROM windows GROUP BY s),
        hits AS (SELECT doc_id, k FROM windows JOIN least USING (s) WHERE first_id < doc_id),
        steps AS (SELECT *, CASE WHEN k <= lag(k) OVER (PARTITION BY doc_id ORDER BY k) + 50 THEN 0 ELSE 1 END AS opens FROM hits),
        numbered AS (SELECT *, sum(opens) OVER (PARTITION BY doc_id ORDER BY k) AS run FROM steps),
        runs AS (SELECT doc_id, run, min(k) AS a, max(k) + 50 AS b FROM numbered GROUP BY doc_id, run),
        gaps AS (SELECT *, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM runs),
        cut AS (
            SELECT doc_id, CAST(sum(b - a) AS BIGINT) AS n_removed, count(*) AS n_spans, max(b) AS last,
                   string_agg(substr(x, CAST(2 * before + 1 AS BIGINT), CAST(2 * (a - before) AS BIGINT)), '' ORDER BY a) AS head
            FROM gaps JOIN texts USING (doc_id) GROUP BY doc_id)
        SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
               sha256(unhex(coalesce(head, '') || substr(x, CAST(2 * coalesce(last, 0) + 1 AS BIGINT)))) AS kept_sha256
        FROM texts LEFT JOIN cut USING (doc_id)
    """,
    "op4_topk": """
        WITH whole AS (
            SELECT vec_id, CAST(list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS DOUBLE[]) AS v
            FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        scored AS (
            SELECT a.vec_id AS query_id, b.vec_id, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
            FROM whole a JOIN whole b ON a.vec_id <> b.vec_id
            WHERE a.vec_id % 20 = 0),
        ranked AS (
            SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank
            FROM scored)
        SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
    """,
    "op7_chat": r"""
        WITH turns AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text,
                   row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS place
            FROM (SELECT conv_id, turn, role, text FROM conversations
                  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
                  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]')),
        marked AS (
            SELECT *, 2 * length(role) - length(replace(role, '\', '')) + len(regexp_extract_all(role, '[<\[](/?s>|/?INST\]|ROLE\])')) AS safe_role,
                   2 * length(text) - length(replace(text, '\', '')) + len(regexp_extract_all(text, '[<\[](/?s>|/?INST\]|ROLE\])')) AS safe_text
            FROM turns)
        SELECT conv_id, count(*) AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY place)) AS turns_sha256,
               CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY place) FILTER (role = 'assistant'), '')) AS loss_sha256,
               CAST(sum(CASE WHEN role = 'assistant' THEN safe_text + 7
                             ELSE safe_role + safe_text + 19 END) AS BIGINT) AS formatted_chars
        FROM marked GROUP BY conv_id
    """,
    "op12_collocations": r"""
        WITH pieces AS (
            SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[.,;:!?\x0A-\x0D]')) AS piece
            FROM documents),
        words AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[ \t]+'), lambda x: x <> '') AS w FROM pieces),
        grams AS (
            SELECT lang, m, unnest(list_transform(range(1, len(w) - m + 2), lambda i: list_slice(w, i, i + m - 1))) AS g
            FROM words CROSS JOIN (SELECT unnest(range(1, 6)) AS m) WHERE len(w) >= m),
        f AS (SELECT lang, m, g, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= 100),
        totals AS (SELECT lang, sum(len(w)) AS n FROM words GROUP BY lang),
        cuts AS (SELECT *, unnest(range(1, m)) AS k FROM f WHERE m > 1),
        scored AS (
            SELECT c.lang, c.m, c.g, c.f AS a, c.k, x.f AS l, y.f AS r, n,
                   (1000::HUGEINT * c.f * n) // (x.f::HUGEINT * y.f) AS score
            FROM cuts c JOIN totals USING (lang)
            JOIN f x ON x.lang = c.lang AND x.g = list_slice(c.g, 1, c.k)
            JOIN f y ON y.lang = c.lang AND y.g = list_slice(c.g, c.k + 1, c.m)),
        lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
        parts AS (
            SELECT lang, f, p AS size, unnest(list_transform(range(1, m - p + 2), lambda i: list_slice(g, i, i + p - 1))) AS g
            FROM f CROSS JOIN (SELECT unnest(range(2, 5)) AS p) WHERE m > p),
        held AS (SELECT lang, g, max(f) AS most FROM parts GROUP BY lang, g),
        kept AS (
            SELECT lowest.*, array_to_string(lowest.g, ' ') AS phrase
            FROM lowest LEFT JOIN held USING (lang, g) WHERE most IS NULL OR 100 * most < 100 * a),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
        SELECT lang, CAST(rank AS BIGINT) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r,
               CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
        FROM ranked WHERE rank <= 2000
    """,
    "op13_hard_negatives": """
        WITH whole AS (
            SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                   CAST(list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS DOUBLE[]) AS v
            FROM embeddings
            WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        scored AS (
            SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
            FROM whole a JOIN whole b ON a.vec_id <> b.vec_id
            WHERE a.vec_id % 100 = 0),
        positives AS (
            SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
            QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
        ranked AS (
            SELECT anchor_id, positive_id, positive_score, n.vec_id AS negative_id, n.score AS negative_score,
                   CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY n.score DESC, n.vec_id) AS INTEGER) AS rank
            FROM positives JOIN scored n USING (anchor_id)
            WHERE NOT n.same AND 30 * positive_score <= 100 * n.score AND 100 * n.score <= 90 * positive_score)
        SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM ranked WHERE rank <= 10
    """,
}
