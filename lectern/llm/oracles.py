"""DuckDB SQL for what the operators count; the rest can't be said in SQL and is tested otherwise."""

from __future__ import annotations

from . import p3_quality, p5_scans

ONCE = "L AS (SELECT file_id, line_no, max(line) AS line FROM doc_lines GROUP BY file_id, line_no)"


def _q(pattern: str) -> str:
    return pattern.replace("'", "''")


def _p3() -> str:
    n = lambda pattern: f"len(regexp_extract_all(t, '{_q(pattern)}'))"
    has = lambda pattern: f"regexp_matches(t, '{_q(pattern)}')::INT"
    p = p3_quality
    unspaced = "regexp_matches(lower(word), '[฀-๿぀-ヿ㐀-鿿]')"
    stats = {
        "lines": "1", "text": "(t <> '')::INT", "chars": "length(t)", "blanks": "length(t) - length(replace(t, ' ', ''))", "words": "len(w)", "word_chars": "coalesce(list_sum([length(x) FOR x IN w]), 0)",
        "common": f"len([x FOR x IN w IF list_contains(k, x)]) + CASE WHEN regexp_matches(t, '{p.UNSPACED}') AND packed <> '' THEN len(regexp_extract_all(t, packed)) ELSE 0 END", "single": "len([x FOR x IN w IF length(x) = 1])", "distinct": "len(list_distinct(w))",
        "digits": n("[0-9]"), "ended": has(p.PATTERNS["ended"]), "inner": n(p.PATTERNS["inner"]), "semis": n("[;|\\t]"), "commas": n(","), "gaps": n(" {2,}"), "marked": has(p.PATTERNS["marked"]), "url": has(p.PATTERNS["url"]), "unspaced": n(p.UNSPACED),
        "foreign": n(p.PATTERNS["foreign"]), "mixed": f"len([x FOR x IN string_split(t, ' ') IF regexp_matches(x, '{p.PATTERNS['mixed']}')])", "noise": n(p.PATTERNS["noise"]),
    }
    more = {"brief": "(words <= 3)::INT * text", "columned": "(semis + gaps >= 2)::INT", "numeric": "(digits * 2 > word_chars)::INT", "comma_lines": "(commas >= 1)::INT"}
    blank = "\\s\\x0b\\x1c-\\x1f\\x{0085}\\x{00a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}"
    return f"""WITH {ONCE}, c AS (SELECT list(DISTINCT lower(word)) FILTER (NOT {unspaced}) AS k, coalesce(string_agg(DISTINCT lower(word), '|' ORDER BY lower(word)) FILTER ({unspaced}), '') AS packed FROM common_words WHERE word <> '' AND lang IS NOT NULL),
 x AS (SELECT file_id, regexp_replace(regexp_replace(coalesce(line, ''), '^[{blank}]+|[{blank}]+$', '', 'g'), '^\\x{{FEFF}}+|\\x{{FEFF}}+$', '', 'g') AS t FROM L),
 y AS (SELECT file_id, t, [z FOR z IN [regexp_replace(v, '^[''’-]+|[''’-]+$', '', 'g') FOR v IN regexp_split_to_array(lower(t), '{_q(p.BETWEEN)}')] IF z <> ''] AS w FROM x),
 s AS (SELECT file_id, {', '.join(f'{v} AS "{k}"' for k, v in stats.items())} FROM y, c), m AS (SELECT *, {', '.join(f'{v} AS "{k}"' for k, v in more.items())} FROM s)
 SELECT file_id, {', '.join(f'sum("{k}") AS "{k}"' for k in p.LINE_STATS)} FROM m GROUP BY file_id"""


def _p5() -> str:
    return f"""WITH {ONCE}, e AS (SELECT extr_id, kind, text_lines FROM extractions QUALIFY row_number() OVER (PARTITION BY extr_id ORDER BY extracted_at DESC, kind DESC) = 1),
 x AS (SELECT line FROM L UNION ALL SELECT unnest(text_lines) FROM e WHERE kind IN ('text', 'ocr')), y AS (SELECT rtrim(unnest(regexp_split_to_array(lower(line), '{_q(p5_scans.BETWEEN)}')), '!') AS word FROM x WHERE line IS NOT NULL)
 SELECT word, count(*) AS n FROM y WHERE length(word) > 1 AND regexp_matches(word, '\\p{{L}}') GROUP BY word"""


def oracle_sql() -> dict[str, str]:
    return {"p3_counts": _p3(), "p5_lexicon": _p5()}
