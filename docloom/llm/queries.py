"""The thin opN_ queries: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, language_id, secret_scan, token_files
from .decontam import find_quotes
from .jaccard import jaccard_components
from .lm import score_documents
from .packing import pack
from .storage import materialize, new_path, small_batches, table
from .token_fst import count_tokens
from .topk import top_k


def byte_bpe() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def tiktoken_vocabulary() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(secret_scan.scan_secrets(table(spark, sf_dir, "documents"), *tiktoken_vocabulary()))


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    path = new_path(spark, "token-files")
    token_files.write_tokens(table(spark, sf_dir, "documents"), path, byte_bpe())
    return token_files.digests(token_files.read_tokens(spark, path))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), byte_bpe())


def _crc_mod(n: int):
    return F.crc32(F.col("doc_id").cast("string")) % n


def learned_language_model(docs: DataFrame) -> language_id.Model:
    """From texts whose crc32(doc_id) mod 3 isn't 1; the others are held out."""
    return language_id.learn(docs.where(_crc_mod(3) != 1))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = language_id.identify(docs, learned_language_model(docs))
    return found.select("doc_id", (_crc_mod(3) == 1).alias("held_out"), "lang_pred", "score")


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    extra = spark.sql(f"SELECT -7L AS conv_id, t AS turn, r AS role, '{said}' AS text FROM VALUES (0L, 'user'), (1L, 'assistant') AS v(t, r)")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    written = materialize(chat.render(chat.fold(chat.conversations_as_events(rows))), "chats")
    return chat.digest(chat.read_back(written))


def op6_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = table(spark, sf_dir, "documents")
    scored = score_documents(docs, _crc_mod(7) != 2)
    return scored.select("doc_id", (_crc_mod(7) == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op7_benchmark_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_quotes(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"), size=3, num=90, den=100)


def op9_mixture_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), byte_bpe())


def op10_maxscore_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return top_k(vectors, vectors.where(F.col("vec_id") % 50 == 0))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secret_scan": op1_secret_scan,
    "op2_token_files": op2_token_files,
    "op3_token_counts": op3_token_counts,
    "op4_language_id": op4_language_id,
    "op5_chat_format": op5_chat_format,
    "op6_lm_scores": op6_lm_scores,
    "op7_benchmark_quotes": op7_benchmark_quotes,
    "op8_ngram_jaccard": op8_ngram_jaccard,
    "op9_mixture_packing": op9_mixture_packing,
    "op10_maxscore_topk": op10_maxscore_topk,
}

#: Words as op6 and op8 take them; only A-Z are lower-cased.
_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"

_CONTROL = "|".join("".join("\\" + c if c in "|[]<>/" else c for c in s[1:]) for s in chat.CONTROL)
_ESCAPED = f"regexp_replace(replace(coalesce(text, ''), '\\', '\\\\'), '([<\\[])({_CONTROL})', '\\1\\\\\\2', 'g')"

ORACLES: dict[str, str] = {
    "op5_chat_format": f"""
        WITH c AS (SELECT conv_id, turn, role, text FROM conversations
                   UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
             t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, {_ESCAPED} AS escaped FROM c)
        SELECT conv_id, count(*) AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
               CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
               CAST(sum(length(role) + length(escaped) + {len(chat.OPEN) + len(chat.NEXT) + len(chat.CLOSE) + 1}) AS BIGINT) AS formatted_chars
        FROM t GROUP BY conv_id
    """,
    "op8_ngram_jaccard": f"""
        WITH RECURSIVE w AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
             s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
                          ELSE list_distinct(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) END AS sh FROM w),
             n AS (SELECT doc_id, CAST(len(sh) AS BIGINT) AS n_shingles FROM s),
             e AS (SELECT doc_id, unnest(sh) AS g FROM s),
             o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM e a JOIN e b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
             l AS (SELECT o.a, o.b FROM o JOIN n x ON x.doc_id = o.a JOIN n y ON y.doc_id = o.b
                   WHERE 100 * o.c >= 90 * (x.n_shingles + y.n_shingles - o.c)),
             r AS (SELECT doc_id AS d, doc_id AS to_id FROM documents UNION SELECT r.d, l.b FROM r JOIN l ON r.to_id = l.a)
        SELECT n.doc_id, n.n_shingles, m.component_id FROM n JOIN (SELECT d, min(to_id) AS component_id FROM r GROUP BY d) m ON m.d = n.doc_id
    """,
    "op10_maxscore_topk": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
                   FROM embeddings
                   WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
             s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(CAST(q.e AS DOUBLE[]), CAST(c.e AS DOUBLE[])) AS BIGINT) AS score
                   FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
             r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
    """,
}
