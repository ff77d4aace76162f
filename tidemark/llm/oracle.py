"""DuckDB statements for those queries of this subpackage that SQL can express."""

from __future__ import annotations

from tidemark.llm.quality_rules import RULES, STOP_WORDS


def _rules() -> str:
    parts = []
    for measure, low, high, from_words in RULES:
        bounds = [f"{measure} >= {low}"] * (low is not None) + [f"{measure} <= {high}"] * (high is not None)
        fits = " AND ".join(bounds)
        parts.append(f"({fits} OR n_words < {from_words})" if from_words else f"({fits})")
    return " AND ".join(parts)


_STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)
_BLANK = r"\x20\x09-\x0D"

_QUALITY = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
s AS (SELECT doc_id, t, regexp_extract_all(t, '[^{_BLANK}]+') AS w,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^{_BLANK}]')) AS l FROM d),
ww AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM s),
stops AS (SELECT doc_id, count(*) AS n_stop_words FROM ww WHERE x IN ({_STOP}) GROUP BY doc_id),
win AS (SELECT doc_id, i, x, lead(x, 1) OVER o AS x1, lead(x, 2) OVER o AS x2, lead(x, 3) OVER o AS x3, lead(x, 4) OVER o AS x4
        FROM ww WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, x, x1, x2, x3, x4) AS n FROM win WHERE x4 IS NOT NULL) WHERE n > 1),
covered AS (SELECT doc_id, CAST(sum(least(5, i - coalesce(before, -5))) AS BIGINT) AS n_repeat_words
        FROM (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM twice) GROUP BY doc_id),
m AS (SELECT s.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
        CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
        CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
        len(l) AS n_lines, coalesce(n_stop_words, 0) AS n_stop_words
        FROM s LEFT JOIN covered USING (doc_id) LEFT JOIN stops USING (doc_id)),
r AS (SELECT *, n_repeat_words / greatest(n_words, 1) AS repeat_ratio, n_symbols / greatest(n_words, 1) AS symbol_ratio,
        word_chars / greatest(n_words, 1) AS mean_word_length, n_stop_words / greatest(n_words, 1) AS stop_word_ratio,
        n_dup_lines / greatest(n_lines, 1) AS dup_line_ratio, n_words / greatest(n_lines, 1) AS longest_line_words,
        (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, (NOT base_failed AND {_rules()}) AS kept FROM r
"""

ORACLE_SQL: dict[str, str] = {"op7_quality_rules": _QUALITY}
