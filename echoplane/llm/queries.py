"""The corpus queries: one opN_<name> for each operator, over whole tables.

Two have an oracle as they are: the others rest on XXH64, BPE, trained or estimated models,
greedy windows or alignments, which SQL does not express; their tests use brute force, the
tokenizers library, round trips or held-out labels. Columns of three of those that SQL
does express are queries of their own, with oracles."""

from __future__ import annotations

from . import bpe, chat_format, decontaminate, license_scan, line_dedup, quality_classifier, quality_rules, secret_scan, simhash, substring_dedup

QUERIES = {
    "op1_license_scan": license_scan.op1,
    "op2_substring_dedup": substring_dedup.op2,
    "op3_simhash": simhash.op3,
    "op4_bpe": bpe.op4,
    "op5_decontaminate": decontaminate.op5,
    "op6_quality_rules": quality_rules.op6,
    "op7_secret_scan": secret_scan.op7,
    "op8_line_dedup": line_dedup.op8,
    "op9_chat_format": chat_format.op9,
    "op10_quality_classifier": quality_classifier.op10,
    # What SQL can say of op6, op7 and op9.
    "quality_base": lambda spark, d: quality_rules.op6(spark, d).drop("kept"),
    "secret_base": lambda spark, d: secret_scan.op7(spark, d).drop("spans"),
    "chat_turns": lambda spark, d: chat_format.op9(spark, d).drop("formatted_chars"),
}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_ANY_CASE = {w: "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key")}
_SECRETS = (
    ("assign", 0, "(" + "|".join(_ANY_CASE.values()) + r""")["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", 1, "(AKIA[A-Z0-9]+)", 1, 18),
    ("hex", 2, "([0-9a-f]+)", 1, 16),
)


def _spans(kind: str, k: int, pattern: str, group: int, least: int) -> str:
    """Matches with their places: lengths of what comes before, matched or not, added up."""
    parts = f"SELECT doc_id, unnest(regexp_extract_all(t, '{pattern}')) AS m, unnest(regexp_extract_all(t, '{pattern}', {group})) AS g, unnest(string_split_regex(t, '{pattern}')) AS p, unnest(range(1, 2 + len(regexp_extract_all(t, '{pattern}')))) AS i FROM d"
    before = "OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND"
    start = f"sum(length(p)) {before} CURRENT ROW) + coalesce(sum(length(m)) {before} 1 PRECEDING), 0)"
    return f"SELECT doc_id, {k} AS k, '{kind}' AS kind, a::BIGINT AS a, (a + length(m))::BIGINT AS z FROM (SELECT *, {start} AS a FROM ({parts})) WHERE length(g) >= {least}"


ORACLE: dict[str, str] = {
    "op2_substring_dedup": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        p AS (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20),
        f AS (SELECT doc_id, i, row_number() OVER (PARTITION BY array_to_string(w[i:i + 19], ' ') ORDER BY doc_id, i) AS k FROM p),
        c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS pos FROM f WHERE k > 1),
        x AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS pos FROM d),
        r AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY pos) AS s FROM x ANTI JOIN c USING (doc_id, pos) GROUP BY doc_id)
        SELECT d.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(s, '')) AS kept_sha256 FROM d LEFT JOIN r USING (doc_id)""",
    "op8_line_dedup": f"""
        WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS pos FROM documents),
        k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{_UPPER}', '{_LOWER}') AS key FROM l),
        m AS (SELECT *, length(key) >= 10 AND doc_id <> min(doc_id) OVER (PARTITION BY key) AS gone FROM k)
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256 FROM m GROUP BY doc_id""",
    "quality_base": r"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM documents),
        x AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d),
        p AS (SELECT doc_id, i, word || ' ' || lead(word, 1) OVER o || ' ' || lead(word, 2) OVER o || ' ' || lead(word, 3) OVER o || ' ' || lead(word, 4) OVER o || ' ' || lead(word, 5) OVER o || ' ' || lead(word, 6) OVER o || ' ' || lead(word, 7) OVER o AS s FROM x WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
        f AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS k FROM p WHERE s IS NOT NULL),
        c AS (SELECT doc_id, count(DISTINCT pos) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS pos FROM f WHERE k > 1) GROUP BY doc_id),
        b AS (SELECT d.doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars, (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words FROM d LEFT JOIN c USING (doc_id))
        SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM b""",
    "secret_base": f"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
        s AS ({" UNION ALL ".join(_spans(*x) for x in _SECRETS)}),
        g AS (SELECT doc_id, count(*) FILTER (k = 0) AS n0, count(*) FILTER (k = 1) AS n1, count(*) FILTER (k = 2) AS n2, string_agg(kind || ':' || a || ':' || z, ',' ORDER BY a, k) AS x FROM s GROUP BY doc_id)
        SELECT doc_id, coalesce(n0, 0)::BIGINT AS n_assign, coalesce(n1, 0)::BIGINT AS n_access, coalesce(n2, 0)::BIGINT AS n_hex, sha256(coalesce(x, '')) AS base_sha256 FROM d LEFT JOIN g USING (doc_id)""",
    "chat_turns": """
        WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -1, turn, role, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) x(turn, role))
        SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256, coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
            sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256 FROM t GROUP BY conv_id""",
}
