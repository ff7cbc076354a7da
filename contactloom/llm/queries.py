"""The queries of this subpackage by name, and their SQL where SQL can express them."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, chat_format, embedding_dedup, html_extract, language_id, packing, quality_classifier, quality_rules, simhash, token_counts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": simhash.op1_simhash,
    "op2_packing": packing.op2_packing,
    "op3_chat_format": chat_format.op3_chat_format,
    "op4_quality_classifier": quality_classifier.op4_quality_classifier,
    "op5_token_counts": token_counts.op5_token_counts,
    "op6_quality_rules": quality_rules.op6_quality_rules,
    "op7_language_id": language_id.op7_language_id,
    "op8_embedding_dedup": embedding_dedup.op8_embedding_dedup,
    "op9_bpe": bpe.op9_bpe,
    "op10_html_extract": html_extract.op10_html_extract,
}

#: Control strings with any backslashes after their first character, as the chat template escapes them.
_CONTROL = "|".join(re.escape(c[0]) + r"\\*" + re.escape(c[1:]) for c in chat_format.CONTROL)
_MARKS = len(chat_format.TURN) + len(chat_format.TEXT) + len(chat_format.END) + 1

#: The others have no DuckDB SQL: each needs XXH64, a tokenizer, a trained model or an HTML parser.
ORACLE_SQL: dict[str, str] = {
    "op3_chat_format": f"""
        WITH c AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT * FROM (VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')) t(conv_id, turn, role, text)
        ), m AS (
            SELECT *, {_MARKS} + length(role) + length(text) + len(regexp_extract_all(role, '{_CONTROL}')) + len(regexp_extract_all(text, '{_CONTROL}')) AS chars FROM c
        )
        SELECT conv_id, count(*) AS n_turns,
            sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
            CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
            sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
            CAST(sum(chars) AS BIGINT) AS formatted_chars
        FROM m GROUP BY conv_id""",
    "op8_embedding_dedup": """
        WITH RECURSIVE v AS (
            SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
            WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
        ), links AS (
            SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
            WHERE list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) >= 0.93
        ), reached AS (SELECT x, y FROM links UNION SELECT r.x, l.y FROM reached r JOIN links l ON r.y = l.x),
        lowest AS (SELECT x, min(y) AS y FROM reached GROUP BY x), counts AS (SELECT x, count(*) AS n FROM links GROUP BY x)
        SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(y, vec_id)) AS component_id, vec_id = least(vec_id, coalesce(y, vec_id)) AS kept
        FROM embeddings LEFT JOIN lowest ON vec_id = lowest.x LEFT JOIN counts ON vec_id = counts.x""",
}
