"""SQL twins, for DuckDB, of the operators that SQL can express."""

from __future__ import annotations

from . import mixing, topk

WORD = r"[^\x20\x09-\x0D]+"
_WORDS = f"words AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents)"


def substring_dedup(width: int = 20) -> str:
    """Windows by hash of their words, all but the first of equals removed."""
    return f"""WITH {_WORDS}, starts AS (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - {width - 2}))) AS i FROM words),
    ranked AS (SELECT doc_id, i, row_number() OVER (PARTITION BY md5(array_to_string(w[i:i + {width - 1}], ' ')) ORDER BY doc_id, i) AS rn FROM starts),
    gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + {width})) AS p FROM ranked WHERE rn > 1),
    placed AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM words),
    kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS text FROM placed ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id),
    removed AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
    SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(text, '')) AS kept_sha256 FROM words LEFT JOIN removed USING (doc_id) LEFT JOIN kept USING (doc_id)"""


def quality_rules(least: int = 8, covered: float = 0.3, longest: int = 150) -> str:
    """Counts from windows. The longest repeat by doubling its length while it occurs twice and then by halving steps."""

    def twice(n: int) -> str:
        return f"""(SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, md5(array_to_string(w[i:i + {n - 1}], ' '))) AS n
            FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - {n - 2}))) AS i FROM words)) WHERE n > 1)"""

    def span(n: int) -> str:
        return f"(SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + {n})) AS p FROM {twice(n)}) GROUP BY doc_id)"

    def repeats(n: str) -> str:
        return f"(len(w) > {n} AND len(list_distinct(list_transform(range(1, len(w) - {n} + 2), lambda i: md5(array_to_string(w[i:i + {n} - 1], ' '))))) < len(w) - {n} + 1)"

    return f"""WITH RECURSIVE {_WORDS}, lines AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS l FROM documents),
    grown AS (SELECT doc_id, w, {least}::BIGINT AS n FROM words WHERE {repeats(str(least))} UNION ALL SELECT doc_id, w, 2 * n FROM grown WHERE {repeats("2 * n")}),
    halved AS (SELECT doc_id, w, max(n) AS n, max(n) // 2 AS step FROM grown GROUP BY doc_id, w
        UNION ALL SELECT doc_id, w, CASE WHEN {repeats("(n + step)")} THEN n + step ELSE n END, step // 2 FROM halved WHERE step > 0),
    again AS (SELECT doc_id, (count(*) - count(DISTINCT l))::BIGINT AS n FROM lines WHERE regexp_matches(l, '{WORD}') GROUP BY doc_id),
    counts AS (SELECT words.doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
        len(regexp_extract_all(coalesce(text, ''), '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(again.n, 0)::BIGINT AS n_dup_lines, coalesce(t.n, 0)::BIGINT AS n_repeat_words,
        coalesce(c.n, 0)::BIGINT AS covered_words, coalesce(x.n, 0)::BIGINT AS longest_repeat
        FROM words JOIN documents USING (doc_id) LEFT JOIN again ON again.doc_id = words.doc_id LEFT JOIN {span(3)} t ON t.doc_id = words.doc_id LEFT JOIN {span(least)} c ON c.doc_id = words.doc_id
        LEFT JOIN (SELECT doc_id, max(n) AS n FROM halved GROUP BY doc_id) x ON x.doc_id = words.doc_id)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
        NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND covered_words <= {covered} * n_words AND longest_repeat <= {longest} AS kept, covered_words, longest_repeat FROM counts"""


def near_dedup(percent: int = 85) -> str:
    """All pairs that share a shingle, and the smallest id reachable by links."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '{WORD}') AS w FROM documents),
    shingles AS (SELECT DISTINCT doc_id, md5(array_to_string(w[i:i + 4], ' ')) AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - 3))) AS i FROM words WHERE len(w) > 0)),
    sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
    shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
    linked AS (SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * shared.n >= {percent} * (x.n + y.n - shared.n)),
    both_ AS (SELECT a, b FROM linked UNION ALL SELECT b, a FROM linked),
    comp(doc_id, c) USING KEY (doc_id) AS (SELECT doc_id, doc_id FROM words UNION
        SELECT n.b, min(n.c) FROM (SELECT both_.b, comp.c FROM comp JOIN both_ ON both_.a = comp.doc_id) n JOIN recurring.comp r ON r.doc_id = n.b WHERE n.c < r.c GROUP BY n.b)
    SELECT words.doc_id, coalesce(sizes.n, 0)::BIGINT AS n_shingles, comp.c AS component_id, comp.c = words.doc_id AS kept FROM words LEFT JOIN sizes USING (doc_id) JOIN comp ON comp.doc_id = words.doc_id"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_substring_dedup": substring_dedup(),
        "op2_mixing": mixing.oracle(),
        "op4_quality_rules": quality_rules(),
        "op9_topk": topk.oracle(),
        "op10_near_dedup": near_dedup(),
    }
