"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from ..functions import headings as H
from ..operators import hyphens, notes

# the regular-expression engine of DuckDB writes code points as \x{...}
B = r"\s\x0b\x1c-\x1f\x{0085}\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
LT = r"\p{L}\p{Nl}\p{No}"
WORD = f"[{LT}]+(?:[''’][{LT}]+)*"
LINES = "L AS (SELECT DISTINCT file_id AS doc_id, line_no, coalesce(line, '') AS line FROM doc_lines)"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^[{B}]+|[{B}]+$', '', 'g')"


S = strip("line")
KEY = f"lower({strip(f"regexp_replace(regexp_replace(regexp_replace(line, '\\p{{Nd}}+', ' ', 'g'), '[^{LT}\\p{{M}}\\p{{Nd}}_{B}]', ' ', 'g'), '[{B}]+', ' ', 'g')")})"
BARE = strip(f"regexp_replace(line, '[^{LT}\\p{{M}}\\p{{Nd}}_{B}]', '', 'g')")
READ = "translate(b, 'lI|iOoDSsBZ', '11110005582')"
IS_NUMBER = f"(length(b) BETWEEN 1 AND 6 AND len(regexp_extract_all(b, '[0-9]')) * 2 >= length(b) AND regexp_full_match({READ}, '[0-9]+') AND (length(b) > 1 OR regexp_full_match(b, '[0-9]')))"
KEYED = f"""{LINES}, s0 AS (SELECT doc_id, line_no, line, {S} AS s FROM L), s1 AS (SELECT * REPLACE (s AS line) FROM s0 WHERE s <> '' AND length(s) <= 60),
 s2 AS (SELECT doc_id, line_no, s, {BARE} AS b, {KEY} AS k FROM s1), K AS (SELECT doc_id, line_no, s, CASE WHEN {IS_NUMBER} THEN '#' ELSE k END AS key FROM s2 WHERE {IS_NUMBER} OR k <> '')"""
GAPS = f"""{KEYED}, big AS (SELECT doc_id, key FROM K GROUP BY ALL HAVING count(*) >= 5), st AS (SELECT doc_id, key, line_no - lag(line_no) OVER (PARTITION BY doc_id, key ORDER BY line_no) AS gap FROM K SEMI JOIN big USING (doc_id, key)),
 G AS (SELECT doc_id, key, count(*) AS n, median(gap) AS median_gap, CASE WHEN count(gap) >= 2 AND avg(gap) <> 0 THEN round(stddev_pop(gap) / avg(gap), 6) END AS cv FROM st GROUP BY doc_id, key)"""
BLOCKS = f"{LINES}, b0 AS (SELECT doc_id, line_no, line, {S} AS s FROM L), Bk AS (SELECT *, s = '' AS blank, sum((s = '')::INT) OVER (PARTITION BY doc_id ORDER BY line_no) AS block_id FROM b0)"
PROFILE = (
    BLOCKS
    + r""", p0 AS (SELECT *, lead(s) OVER (PARTITION BY doc_id ORDER BY line_no) AS nxt FROM Bk),
 P AS (SELECT *, coalesce(NOT blank AND regexp_matches(s, '(?:[.,;:!?"''’”—]|--)$') AND nxt <> '' AND (regexp_matches(nxt, '^[^\p{L}]') OR (regexp_matches(nxt, '^\p{L}') AND left(nxt, 1) <> lower(left(nxt, 1)))), false) AS authorial FROM p0)"""
)
TAIL = f"([{LT}][{LT}\\p{{M}}\\p{{Nd}}_''’-]*)-[\\s]*$"
HEAD = f"^\\s*([{LT}][{LT}\\p{{M}}\\p{{Nd}}_''’]*)"
BREAKS = f"""{LINES}, n0 AS (SELECT doc_id, line_no, line, lead(line) OVER (PARTITION BY doc_id ORDER BY line_no) AS nxt FROM L),
 Br AS (SELECT doc_id, line_no, regexp_extract(line, '{TAIL}', 1) AS left_part, regexp_extract(nxt, '{HEAD}', 1) AS right_part FROM n0 WHERE regexp_matches(line, '{TAIL}') AND regexp_matches(nxt, '{HEAD}'))"""
VOCAB = f"v0 AS (SELECT doc_id, unnest(regexp_extract_all(replace(lower(line), 'ς', 'σ'), '[{LT}][{LT}\\p{{M}}\\p{{Nd}}_''’-]*')) AS w FROM L), V AS (SELECT doc_id, regexp_replace(w, '^-+|-+$', '', 'g') AS word, count(*) AS n FROM v0 WHERE regexp_replace(w, '^-+|-+$', '', 'g') <> '' GROUP BY ALL)"
TOKENS = f"regexp_extract_all(nfc_normalize(coalesce(text, '')), '{WORD}')"
_q = lambda x: x.replace("'", "''")
_score = lambda words: "len(list_filter([" + ", ".join(f"'{_q(w)}'" for w in words) + "], lambda p: contains(t, p)))"
_EXTRACTION_CLASS = f"WITH a AS (SELECT DISTINCT extr_id, array_to_string(coalesce(text_lines, []), chr(10)) AS t, note FROM extractions), r AS (SELECT *, CASE WHEN length(t) > 0 THEN len(regexp_extract_all(t, '[{LT}]')) / length(t) ELSE 0.0 END AS q FROM a) SELECT extr_id, length(t) AS characters, round(q, 6) AS letter_ratio, CASE WHEN length({strip('t')}) = 0 THEN 'image' WHEN length(t) >= 200 AND q < 0.35 THEN 'unmapped' WHEN coalesce(regexp_matches(lower(note), 'ocr|recogni|tesseract|abbyy|finereader'), false) THEN 'ocr' ELSE 'text' END AS kind FROM r"
RECORDS = """T0 AS (SELECT doc_id, string_split(replace(replace(regexp_replace(text, '(?m)^(@[\\p{L}\\p{Nd}_.]+) · ([0-9]+ [smhdwy])$', '\\1\n\\2', 'g'), chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10)) AS x FROM documents WHERE text IS NOT NULL),
 Ls AS (SELECT doc_id, i AS line_no, x[i] AS line FROM T0, range(1, len(x) + 1) r(i)),
 r0 AS (SELECT doc_id, line_no, STRIP AS s FROM Ls), r1 AS (SELECT *, regexp_full_match(s, '(?:\\[@?[A-Za-z0-9_.]+\\]\\(\\S+\\)|@[A-Za-z0-9_.]+)') AS h, regexp_full_match(s, '(?i)\\[?\\s*[0-9]{1,3}\\s*[smhdwy]\\s*\\]?(?:\\(\\S+\\))?') AS t FROM r0 WHERE s <> ''),
 r2 AS (SELECT *, sum(h::INT) OVER (PARTITION BY doc_id) AS nh, sum(t::INT) OVER (PARTITION BY doc_id) AS nt FROM r1), r3 AS (SELECT *, CASE WHEN nh >= 5 THEN h WHEN nt >= 5 THEN t END AS st FROM r2),
 R AS (SELECT doc_id, line_no, s, sum(st::INT) OVER (PARTITION BY doc_id ORDER BY line_no) AS record, NOT h AND NOT t AS is_body FROM r3 WHERE st IS NOT NULL QUALIFY record > 0)""".replace("STRIP", strip("line"))


def oracle_sql() -> dict[str, str]:
    divisions = H.DIVISION.replace("(?iu)", "(?i)").replace(r"(?![\p{L}\p{Nd}_])", r"(?:$|[^\p{L}\p{Nd}_])")
    return {
        "doc_stats": f"SELECT doc_id, length(coalesce(text, '')) AS characters, CASE WHEN coalesce(text, '') = '' THEN 0 ELSE len(string_split(text, chr(10))) END AS line_count, len({TOKENS}) AS word_tokens, len(list_distinct(list_transform({TOKENS}, lambda x: lower(x)))) AS word_types FROM documents",
        "lang_token_totals": f"SELECT lang, count(*) AS documents, sum(len({TOKENS})) AS word_tokens, sum(length(coalesce(text, ''))) AS characters, sum(CASE WHEN coalesce(text, '') = '' THEN 0 ELSE len(string_split(text, chr(10))) END) AS line_count FROM documents GROUP BY lang",
        "type_frequency_topk": f"SELECT lower(w) AS word, count(*) AS n FROM (SELECT unnest({TOKENS}) AS w FROM documents WHERE text IS NOT NULL) GROUP BY 1 ORDER BY n DESC, word LIMIT 100",
        "lines_exploded": "WITH t AS (SELECT doc_id, string_split(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10)) AS x FROM documents WHERE text IS NOT NULL) SELECT doc_id, i AS line_no, x[i] AS line FROM t, range(1, len(x) + 1) r(i)",
        "blocks": f"WITH {BLOCKS} SELECT doc_id, block_id, min(line_no) AS first_line, max(line_no) AS last_line, count(*) AS n_lines, max(length(s)) AS longest FROM Bk WHERE NOT blank GROUP BY doc_id, block_id",
        "newline_profile": "WITH a AS (SELECT coalesce(headers, '') AS h FROM documents), c AS (SELECT len(regexp_extract_all(h, '\\r\\n')) AS crlf, len(regexp_extract_all(h, '\\n')) AS n, len(regexp_extract_all(h, '\\r')) AS r FROM a) SELECT CASE WHEN crlf >= n - crlf AND crlf >= r - crlf THEN 'CRLF' WHEN n >= r THEN 'LF' ELSE 'CR' END AS style, count(*) AS n FROM c GROUP BY 1",
        "letter_ratio_class": f"WITH a AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), r AS (SELECT doc_id, t, CASE WHEN length(t) > 0 THEN len(regexp_extract_all(t, '[{LT}]')) / length(t) ELSE 0.0 END AS q FROM a) SELECT doc_id, length(t) AS characters, round(q, 6) AS letter_ratio, CASE WHEN length({strip('t')}) = 0 THEN 'image' WHEN length(t) >= 200 AND q < 0.35 THEN 'unmapped' ELSE 'text' END AS kind FROM r",
        "page_number_like": f"WITH {LINES}, x AS (SELECT doc_id, line_no, {BARE} AS b FROM L) SELECT doc_id, line_no, {READ}::INT AS page_no FROM x WHERE {IS_NUMBER}",
        "normalised_key_groups": f"WITH {LINES}, x AS (SELECT doc_id, {KEY} AS key FROM L) SELECT doc_id, key, count(*) AS n FROM x WHERE key <> '' GROUP BY ALL HAVING count(*) >= 2",
        "label_keys": f"WITH {LINES}, x AS (SELECT {S} AS s FROM L), y AS (SELECT regexp_replace(regexp_replace(lower(s), '\\p{{Nd}}+', '#', 'g'), '^[^{LT}\\p{{M}}\\p{{Nd}}_]+|[^{LT}\\p{{M}}\\p{{Nd}}_]+$', '', 'g') AS key FROM x WHERE s <> '' AND length(s) <= 24 AND len(regexp_split_to_array(s, '[{B}]+')) <= 4) SELECT key, count(*) AS n FROM y WHERE key <> '' GROUP BY key",
        "short_line_series": f"WITH {KEYED} SELECT doc_id, key, count(*) AS n, min(line_no) AS first_line, key = '#' AS is_numeric FROM K GROUP BY doc_id, key HAVING count(*) >= 5",
        "series_gap_stats": f"WITH {GAPS} SELECT * FROM G",
        "series_judged": f"WITH {GAPS}, pg AS (SELECT doc_id, arg_min(median_gap, (cv, -n)) AS page_length FROM G WHERE key = '#' AND cv < 0.25 GROUP BY doc_id) SELECT G.*, page_length, coalesce(page_length IS NOT NULL AND cv < 0.25 AND (abs(median_gap / page_length - 1) <= 0.25 OR abs(median_gap / page_length - 2) <= 0.25 OR abs(median_gap / page_length - 3) <= 0.25), false) AS accepted FROM G LEFT JOIN pg USING (doc_id)",
        "licence_phrase_density": f"WITH a AS (SELECT doc_id, lower(coalesce(text, '')) AS t FROM documents) SELECT doc_id, {_score(H.LICENCE)} AS score, {_score(H.SCANNING)} AS scan_score FROM a",
        "heading_lines": f"WITH {LINES}, x AS (SELECT doc_id, line_no, {S} AS s FROM L), y AS (SELECT *, {strip(f'''regexp_extract(s, '{_q(divisions)}', 3)''')} AS rest, regexp_replace(s, '[^\\p{{L}}]', '', 'g') AS letters FROM x WHERE regexp_matches(s, '{_q(divisions)}')) SELECT doc_id, line_no, lower(regexp_extract(s, '{_q(divisions)}', 1)) || ' ' || lower(regexp_extract(s, '{_q(divisions)}', 2)) AS key FROM y WHERE (length(s) <= 80 OR (length(s) <= 200 AND letters = upper(letters))) AND (rest = '' OR regexp_matches(rest, '{_q(H.TITLE_START)}'))",
        "numbered_sections": f"WITH {LINES}, x AS (SELECT doc_id, line_no, {S} AS s FROM L) SELECT doc_id, line_no, s AS title FROM x WHERE length(s) <= 80 AND regexp_matches(s, '{_q(H.SECTION)}') AND (NOT regexp_matches(s, '[.,;]$') OR length(s) - length(replace(s, ' ', '')) <= 6)",
        "extraction_class": _EXTRACTION_CLASS,
        "front_back_lines": f"WITH {LINES}, x AS (SELECT doc_id, line_no, {S} AS s FROM L), y AS (SELECT *, regexp_replace(s, '[^\\p{{L}}]', '', 'g') AS letters FROM x), z AS (SELECT doc_id, line_no, length(s) <= 80 AND (regexp_matches(s, '{_q(H.FRONT)}') OR regexp_matches(s, '{_q(H.NAMED_FRONT)}')) AS is_front, letters <> '' AND letters = upper(letters) AND regexp_matches(s, '{_q(H.BACK)}') AS is_back, length(s) <= 120 AND regexp_matches(s, '{_q(H.METADATA)}') AS is_metadata FROM y) SELECT * FROM z WHERE is_front OR is_back OR is_metadata",
        "break_profile": f"WITH {PROFILE} SELECT doc_id, line_no, block_id FROM P WHERE authorial",
        "window_break_rate": f"WITH {PROFILE} SELECT doc_id, line_no, round(avg(authorial::INT) OVER (PARTITION BY doc_id, block_id ORDER BY line_no ROWS BETWEEN 6 PRECEDING AND 6 FOLLOWING), 6) AS rate FROM P WHERE NOT blank",
        "wrapped_docs": f"WITH {LINES}, x AS (SELECT doc_id, list_sort(list(length(line))) AS l FROM L WHERE {S} <> '' GROUP BY doc_id) SELECT doc_id, len(l) AS text_lines, l[least(floor(len(l) * 0.95)::INT + 1, len(l))] AS p95, len(l) >= 10 AND l[least(floor(len(l) * 0.95)::INT + 1, len(l))] <= 200 AS is_wrapped FROM x",
        "hyphen_breaks": f"WITH {BREAKS} SELECT doc_id, line_no, left_part, right_part, left_part || right_part AS joined, left_part || '-' || right_part AS hyphenated FROM Br",
        "vocabulary_counts": f"WITH {LINES}, {VOCAB} SELECT doc_id, word, n FROM V WHERE n >= 2",
        "hyphen_decisions": f"""WITH {BREAKS}, {VOCAB}, fr AS (SELECT doc_id, w AS word, count(*) AS f FROM (SELECT doc_id, unnest([replace(lower(left_part), 'ς', 'σ'), replace(lower(right_part), 'ς', 'σ')]) AS w FROM Br) GROUP BY ALL), A AS (SELECT V.doc_id, V.word FROM V LEFT JOIN fr USING (doc_id, word) WHERE n > coalesce(f, 0)),
 D AS (SELECT Br.*, EXISTS (SELECT 1 FROM A WHERE A.doc_id = Br.doc_id AND A.word = replace(lower(left_part || right_part), 'ς', 'σ')) AS aj, EXISTS (SELECT 1 FROM A WHERE A.doc_id = Br.doc_id AND A.word = replace(lower(left_part || '-' || right_part), 'ς', 'σ')) AS ah, EXISTS (SELECT 1 FROM A WHERE A.doc_id = Br.doc_id AND A.word = replace(lower(left_part), 'ς', 'σ')) AS al, EXISTS (SELECT 1 FROM A WHERE A.doc_id = Br.doc_id AND A.word = replace(lower(right_part), 'ς', 'σ')) AS ar FROM Br)
 SELECT doc_id, line_no, left_part || right_part AS joined, left_part || '-' || right_part AS hyphenated, CASE WHEN aj THEN 'join' WHEN ah THEN 'keep' WHEN NOT al THEN 'join' WHEN ar THEN 'keep' WHEN length(right_part) <= {hyphens.SUFFIX} THEN 'join' ELSE 'unknown' END AS decision FROM D""",
        "interface_records": f"WITH {RECORDS} SELECT doc_id, line_no, record, is_body FROM R",
        **_more(),
    }


NOTES = f"""{LINES}, f0 AS (SELECT doc_id, line_no, line, {S} = '' AS blank, regexp_extract(line, '{_q(notes.BODY)}', 1) AS b1, regexp_extract(line, '{_q(notes.BODY)}', 2) AS b2, regexp_extract(line, '{_q(notes.NAMED_BODY)}', 1) AS n1, regexp_extract(line, '{_q(notes.NAMED_BODY)}', 2) AS n2, line_no <> coalesce(lag(line_no) OVER (PARTITION BY doc_id ORDER BY line_no), -1) + 1 AS jump FROM L),
 f1 AS (SELECT *, CASE WHEN b1 <> '' THEN b1[2:-2] WHEN n1 <> '' THEN n1 END AS label, CASE WHEN b2 <> '' THEN b2 ELSE n2 END AS own FROM f0),
 f2 AS (SELECT *, sum((blank OR jump OR label IS NOT NULL)::INT) OVER (PARTITION BY doc_id ORDER BY line_no) AS g FROM f1),
 f3 AS (SELECT *, first_value(label) OVER w AS head, first_value(line_no) OVER w AS start FROM f2 WINDOW w AS (PARTITION BY doc_id, g ORDER BY line_no)),
 f4 AS (SELECT doc_id, line_no, line, label, own, CASE WHEN head IS NOT NULL AND line_no - start < {notes.LONGEST} THEN start END AS first, head FROM f3),
 NB AS (SELECT doc_id, first AS first_line, max(line_no) AS last_line, NORM AS label, STRIP AS text FROM f4 WHERE first IS NOT NULL GROUP BY doc_id, first),
 m0 AS (SELECT doc_id, line_no, regexp_extract_all(line, '{_q(notes.MARKER)}') AS x FROM f4 WHERE first IS NULL AND NOT regexp_full_match({S}, '{_q(notes.OPENING)}')),
 NM AS (SELECT doc_id, line_no, (i - 1)::INT AS pos, CASE WHEN regexp_replace(lower(x[i][2:-2]), '^0+', '') = '' THEN '0' ELSE regexp_replace(lower(x[i][2:-2]), '^0+', '') END AS label FROM m0, range(1, len(x) + 1) r(i))"""
NOTES = NOTES.replace("NORM AS label", "CASE WHEN regexp_replace(lower(max(head)), '^0+', '') = '' THEN '0' ELSE regexp_replace(lower(max(head)), '^0+', '') END AS label").replace(
    "STRIP AS text", strip(f"string_agg({strip('CASE WHEN label IS NOT NULL THEN own ELSE line END')}, ' ' ORDER BY line_no)") + " AS text"
)
# bodies and markers are brackets: each body takes the last marker of its label that is still open
PAIRS = f"""{NOTES}, ev AS (SELECT doc_id, label, line_no AS line, pos, 1 AS step FROM NM UNION ALL SELECT doc_id, label, first_line, 0, -1 FROM NB),
 e1 AS (SELECT *, sum(step) OVER w AS s FROM ev WINDOW w AS (PARTITION BY doc_id, label ORDER BY line, pos)),
 e2 AS (SELECT *, least(min(s) OVER w, 0) AS low FROM e1 WINDOW w AS (PARTITION BY doc_id, label ORDER BY line, pos)),
 e3 AS (SELECT *, step < 0 AND low < coalesce(lag(low) OVER w, 0) AS lone FROM e2 WINDOW w AS (PARTITION BY doc_id, label ORDER BY line, pos)),
 e4 AS (SELECT *, CASE WHEN lone THEN 0 WHEN step < 0 THEN s - low + 1 ELSE s - low END AS level FROM e3),
 e5 AS (SELECT *, lag(line) OVER w AS before, lead(step) OVER w AS nxt FROM e4 WINDOW w AS (PARTITION BY doc_id, label, level ORDER BY line, pos)),
 NP AS (SELECT doc_id, label, CASE WHEN step > 0 THEN line WHEN level > 0 THEN before END AS marker_line, CASE WHEN step < 0 THEN line END AS body_line FROM e5 WHERE NOT (step > 0 AND coalesce(nxt, 1) < 0))"""
WRAPPED = f"wl AS (SELECT doc_id, list_sort(list(length(line))) AS l FROM L WHERE {S} <> '' GROUP BY doc_id), Wr AS (SELECT doc_id, len(l) >= 10 AND l[least(floor(len(l) * 0.95)::INT + 1, len(l))] <= 200 AS is_wrapped FROM wl)"
MODES = f"""{BLOCKS}, mt AS (SELECT doc_id, length(regexp_extract(line, '^[ \\t]*')) AS v, line_no FROM Bk WHERE NOT blank), mi AS (SELECT doc_id, v, count(*) AS c, min(line_no) AS f FROM mt GROUP BY ALL),
 r0 AS (SELECT doc_id, line_no, blank, line_no - row_number() OVER (PARTITION BY doc_id, blank ORDER BY rn) AS x, rn - row_number() OVER (PARTITION BY doc_id, blank ORDER BY rn) AS g FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS rn FROM Bk)),
 r1 AS (SELECT doc_id, g, count(*) AS v, min(line_no) AS f FROM r0 WHERE blank GROUP BY doc_id, g), mb AS (SELECT doc_id, v, count(*) AS c, min(f) AS f FROM r1 GROUP BY doc_id, v),
 Mo AS (SELECT d.doc_id, (SELECT arg_max(v, (c, -f)) FROM mi WHERE mi.doc_id = d.doc_id) AS modal_indent, (SELECT arg_max(v, (c, -f)) FROM mb WHERE mb.doc_id = d.doc_id) AS modal_blank_run FROM (SELECT DISTINCT doc_id FROM L) d)"""
SPACED = "s0 AS (SELECT *, coalesce(lag(blank) OVER w, true) AND coalesce(lead(blank) OVER w, true) AND NOT blank AS alone FROM Bk WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)), Sp AS (SELECT doc_id FROM s0 GROUP BY doc_id HAVING count(*) - sum(blank::INT) >= 10 AND sum(blank::INT) >= 0.4 * count(*) AND sum(alone::INT) >= 0.8 * (count(*) - sum(blank::INT)))"
# lines of wrapped documents; where blanks are spacing, without them but for one of each longer run
SPANS = f"""{MODES}, {SPACED}, {WRAPPED}, q0 AS (SELECT Bk.doc_id, Bk.line_no, Bk.s, Bk.blank, Bk.doc_id IN (SELECT doc_id FROM Sp) AS spaced, g FROM Bk JOIN r0 USING (doc_id, line_no) WHERE Bk.doc_id IN (SELECT doc_id FROM Wr WHERE is_wrapped)),
 q1 AS (SELECT *, count(*) OVER w AS run, min(line_no) OVER w AS head FROM q0 WINDOW w AS (PARTITION BY doc_id, blank, g)),
 q2 AS (SELECT q1.*, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS n FROM q1 JOIN Mo USING (doc_id) WHERE NOT spaced OR NOT blank OR (run > modal_blank_run AND line_no = head)),
 q3 AS (SELECT *, sum(blank::INT) OVER (PARTITION BY doc_id ORDER BY n) AS bid, lead(s) OVER (PARTITION BY doc_id ORDER BY n) AS nxt FROM q2),
 q4 AS (SELECT *, coalesce(NOT blank AND regexp_matches(s, '(?:[.,;:!?"''’”—]|--)$') AND nxt <> '' AND (regexp_matches(nxt, '^[^\\p{{L}}]') OR (regexp_matches(nxt, '^\\p{{L}}') AND left(nxt, 1) <> lower(left(nxt, 1)))), false) AS a FROM q3),
 q5 AS (SELECT *, avg(a::INT) OVER (PARTITION BY doc_id, bid ORDER BY n ROWS BETWEEN 6 PRECEDING AND 6 FOLLOWING) AS rate FROM q4 WHERE NOT blank),
 q6 AS (SELECT doc_id, bid, count(*) AS n, sum((rate >= 0.45)::INT) AS p, avg(a::INT) AS share, min(line_no) AS f, max(line_no) AS l FROM q5 GROUP BY doc_id, bid),
 q7 AS (SELECT *, p >= 3 AND p >= 0.5 * n AS strong, row_number() OVER (PARTITION BY doc_id ORDER BY bid) AS k FROM q6),
 q8 AS (SELECT *, p > 0 OR (n >= 3 AND share >= 0.225 AND (coalesce(lag(strong) OVER w, false) OR coalesce(lead(strong) OVER w, false))) AS keep FROM q7 WINDOW w AS (PARTITION BY doc_id ORDER BY bid)),
 q9 AS (SELECT *, k - row_number() OVER (PARTITION BY doc_id ORDER BY bid) AS g FROM q8 WHERE keep),
 Span AS (SELECT doc_id, min(f) AS first_line, max(l) AS last_line, max(l) - min(f) + 1 AS n_lines FROM q9 GROUP BY doc_id, g HAVING max(l) - min(f) + 1 >= 3)"""
REVIEWED = f"""{BREAKS}, {VOCAB}, fr AS (SELECT doc_id, w AS word, count(*) AS f FROM (SELECT doc_id, unnest([replace(lower(left_part), 'ς', 'σ'), replace(lower(right_part), 'ς', 'σ')]) AS w FROM Br) GROUP BY ALL), A AS (SELECT V.doc_id, V.word FROM V LEFT JOIN fr USING (doc_id, word) WHERE n > coalesce(f, 0)),
 D AS (SELECT Br.*, EXISTS (SELECT 1 FROM A WHERE A.doc_id = Br.doc_id AND A.word = replace(lower(left_part || right_part), 'ς', 'σ')) AS aj, EXISTS (SELECT 1 FROM A WHERE A.doc_id = Br.doc_id AND A.word = replace(lower(left_part || '-' || right_part), 'ς', 'σ')) AS ah, EXISTS (SELECT 1 FROM A WHERE A.doc_id = Br.doc_id AND A.word = replace(lower(left_part), 'ς', 'σ')) AS al, EXISTS (SELECT 1 FROM A WHERE A.doc_id = Br.doc_id AND A.word = replace(lower(right_part), 'ς', 'σ')) AS ar FROM Br),
 De AS (SELECT doc_id, line_no, left_part || right_part AS joined, left_part || '-' || right_part AS hyphenated, CASE WHEN aj THEN 'join' WHEN ah THEN 'keep' WHEN NOT al THEN 'join' WHEN ar THEN 'keep' WHEN length(right_part) <= {hyphens.SUFFIX} THEN 'join' ELSE 'unknown' END AS decision FROM D)"""


def _re2(pattern: str) -> str:
    """A pattern of ours for an engine without look-ahead: what must not follow is a character that is no letter, or the end."""
    return _q(pattern.replace("(?iu)", "(?i)").replace(r"(?![\p{L}])", r"(?:[^\p{L}]|$)"))


def _roman(digit: str, later: str) -> str:
    return f"list_sum([CASE WHEN ({digit}) < coalesce(list_max([({later}) FOR j IN range(i + 1, length(word) + 1)]), 0) THEN -({digit}) ELSE ({digit}) END FOR i IN range(1, length(word) + 1)])::INT"


def _more() -> dict[str, str]:
    octets = "regexp_replace(hex(raw_bytes), '(..)', '\\1 ', 'g')"
    counted = lambda what: f"len(regexp_extract_all(o, '{what}'))"
    folded = strip(f"regexp_replace(replace(line, 'ſ', 's'), '[^{LT}\\p{{M}}\\p{{Nd}}_{B}]', ' ', 'g')")
    value = {"I": 1, "V": 5, "X": 10, "L": 50, "C": 100, "D": 500, "M": 1000}
    digit = "CASE word[i] " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in value.items()) + " END"
    later = digit.replace("word[i]", "word[j]")
    return {
        "extraction_triage": f"WITH k AS ({_EXTRACTION_CLASS}) SELECT kind, count(*) AS documents, sum(characters) AS characters, CASE kind WHEN 'image' THEN 'no text layer: recognise the pages first' WHEN 'unmapped' THEN 'glyphs without letters: recognise the pages' WHEN 'ocr' THEN 'recognised text: repair before use' ELSE 'use as it is' END AS advice FROM k GROUP BY kind",
        "roman_numerals": f"WITH {LINES}, w AS (SELECT doc_id, line_no, regexp_extract_all(line, '[\\p{{L}}\\p{{M}}\\p{{Nd}}_]+') AS x FROM L), e AS (SELECT doc_id, line_no, (k - 1)::INT AS pos, x[k] AS word FROM w, range(1, len(x) + 1) r(k) WHERE regexp_full_match(x[k], '[IVXLCDM]+')) SELECT doc_id, line_no, pos, word, {_roman(digit, later)} AS value FROM e",
        "newline_bytes": f"WITH o AS (SELECT doc_id, octet_length(raw_bytes) AS source_bytes, hex(raw_bytes) AS h, {octets} AS o FROM documents WHERE raw_bytes IS NOT NULL), c AS (SELECT *, {counted('0D 0A ')} AS crlf, {counted('0A ')} AS n, {counted('0D ')} AS r FROM o) SELECT doc_id, source_bytes, CASE WHEN crlf >= n - crlf AND crlf >= r - crlf THEN 'CRLF' WHEN n >= r THEN 'LF' ELSE 'CR' END AS newline, regexp_matches(h, '^(?:EFBBBF|FFFE|FEFF)') AS had_bom FROM c",
        "folded_words": f"WITH {LINES}, w AS (SELECT doc_id, unnest(regexp_split_to_array(lower({folded}), '[{B}]+')) AS word FROM L) SELECT doc_id, replace(word, 'ς', 'σ') AS word, count(*) AS n FROM w WHERE word <> '' GROUP BY ALL",
        "encoding_detect": f"""WITH o AS (SELECT doc_id, raw_bytes, octet_length(raw_bytes) AS source_bytes, hex(raw_bytes) AS h, {octets} AS o, TRY(decode(raw_bytes)) AS u FROM documents),
 c AS (SELECT *, {counted('0D 0A ')} AS crlf, {counted('0A ')} AS n, {counted('0D ')} AS r, regexp_matches(h, '^(?:EFBBBF|FFFE|FEFF)') AS bom FROM o), e AS (SELECT *, CASE WHEN h LIKE 'EFBBBF%' THEN 'utf-8-sig' WHEN h LIKE 'FFFE%' THEN 'utf-16-le' WHEN h LIKE 'FEFF%' THEN 'utf-16-be' WHEN u IS NOT NULL THEN 'utf-8' WHEN NOT regexp_matches(o, '(?:81|8D|8F|90|9D) ') THEN 'cp1252' ELSE 'latin-1' END AS enc FROM c)
 SELECT doc_id || '.txt' AS name, CASE WHEN raw_bytes IS NOT NULL THEN enc END AS encoding, CASE WHEN raw_bytes IS NOT NULL THEN bom END AS had_bom, CASE WHEN raw_bytes IS NULL THEN NULL WHEN bom THEN 1.0 WHEN enc = 'utf-8' THEN 0.9 ELSE 0.5 END AS encoding_confidence, CASE WHEN raw_bytes IS NULL THEN NULL WHEN crlf >= n - crlf AND crlf >= r - crlf THEN 'CRLF' WHEN n >= r THEN 'LF' ELSE 'CR' END AS newline, CASE WHEN raw_bytes IS NULL THEN NULL ELSE source_bytes END AS source_bytes, CASE WHEN raw_bytes IS NULL THEN NULL WHEN enc LIKE 'utf-8%' THEN len(regexp_extract_all(u, '\\x{{FFFD}}')) ELSE 0 END AS replacement_chars FROM e""",
        "notice_lines": f"WITH {LINES}, x AS (SELECT doc_id, line_no, {S} AS s FROM L), f AS (SELECT doc_id, line_no, regexp_matches(s, '{_q(H.START_MARK)}') AS start_mark, regexp_matches(s, '{_q(H.END_MARK)}') AS end_mark, regexp_matches(s, '{_re2(H.CREDIT)}') AS credit, regexp_matches(s, '{_re2(H.CREDIT_HEADING)}') AS credit_heading, regexp_matches(s, '{_q(H.CONTENTS)}') AS contents FROM x) SELECT * FROM f WHERE start_mark OR end_mark OR credit OR credit_heading OR contents",
        "numeral_lines": f"WITH {LINES}, x AS (SELECT doc_id, line_no, regexp_extract({S}, '{_q(H.NUMERAL)}', 1) AS word FROM L), y AS (SELECT *, CASE WHEN regexp_full_match(word, '[0-9]+') THEN word::INT END AS plain FROM x WHERE word <> '') SELECT doc_id, line_no, coalesce(plain, {_roman(digit, later)}) AS value FROM y",
        "split_headings": f"WITH {LINES}, x AS (SELECT doc_id, line_no, {S} AS s FROM L), y AS (SELECT *, coalesce(lead(s, 1) OVER w, '') AS a, coalesce(lead(s, 2) OVER w, '') AS b FROM x WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)), z AS (SELECT *, CASE WHEN a <> '' THEN a ELSE b END AS number FROM y WHERE regexp_matches(s, '(?i)^(?:{_q(H._WORDS)})\\s*[.:]?$')) SELECT doc_id, line_no, lower(regexp_replace(s, '[.:\\s]+$', '') || ' ' || regexp_replace(number, '[.:\\s]+$', '')) AS key FROM z WHERE regexp_matches(number, '(?i)^{_q(H.NUMBER)}\\s*[.:]?$')",
        "notice_blocks": f"""WITH {BLOCKS}, b AS (SELECT doc_id, block_id, string_agg(s, ' ' ORDER BY line_no) AS t0, min(line_no) AS first_line, max(line_no) AS last_line FROM Bk WHERE NOT blank GROUP BY doc_id, block_id),
 c AS (SELECT *, lower(t0) AS t, len(regexp_split_to_array(t0, '\\s+')) AS words, TRY_CAST(regexp_extract(lower(t0), 'only\\s+([0-9]+(?:\\.[0-9]+)?)\\s*%\\s*accurate', 1) AS DOUBLE) AS acc FROM b), d AS (SELECT *, {_score(H.LICENCE)} AS lic, {_score(H.SCANNING)} AS scan FROM c),
 e AS (SELECT *, CASE WHEN acc < 50 THEN 'ocr_rejected' WHEN scan >= 1 THEN 'scan_apparatus' WHEN lic >= 2 AND regexp_matches(t, 'gutenberg|pglaf') AND lic * 1000.0 / words >= 5 THEN 'licence_block' END AS kind FROM d) SELECT doc_id, first_line, last_line, kind, CASE WHEN kind = 'scan_apparatus' THEN scan ELSE lic END AS score, round(lic * 1000.0 / words, 3) AS density FROM e WHERE kind IS NOT NULL""",
        "collapsed_text": "WITH t AS (SELECT doc_id, regexp_replace(text, '\\n(?:[ \\t]*\\n){2,}', chr(10) || chr(10), 'g') AS t FROM documents WHERE text IS NOT NULL) SELECT doc_id, regexp_replace(regexp_replace(t, '^\\s*\\n', ''), '\\s+$', '') || chr(10) AS text FROM t",
        "hyphen_decisions_extra": f"WITH {REVIEWED.replace('FROM V LEFT JOIN fr USING (doc_id, word) WHERE n > coalesce(f, 0))', 'FROM V LEFT JOIN fr USING (doc_id, word) WHERE n > coalesce(f, 0) UNION SELECT d.doc_id, replace(lower(c.word), chr(962), chr(963)) FROM common_words c, (SELECT DISTINCT doc_id FROM Br) d WHERE c.word IS NOT NULL)')} SELECT doc_id, line_no, hyphenated, decision FROM De",
        "review_outstanding": f"WITH {REVIEWED}, h AS (SELECT DISTINCT hyphenated FROM breaks WHERE decision IN ('join', 'keep')) SELECT 'hyphen' AS kind, hyphenated AS key, count(*) AS occurrences FROM De WHERE decision NOT IN ('join', 'keep') AND hyphenated NOT IN (SELECT hyphenated FROM h WHERE hyphenated IS NOT NULL) GROUP BY hyphenated",
        "page_shape": f"WITH {LINES}, x AS (SELECT doc_id, length({S}) AS n FROM L WHERE {S} <> '') SELECT doc_id, count(*) AS text_lines, median(n) AS median_length, round(stddev_pop(n) / avg(n), 6) AS cv, count(*) >= 20 AND median(n) >= 200 AND round(stddev_pop(n) / avg(n), 6) < 0.75 AS page_per_line FROM x GROUP BY doc_id",
        "page_edges": f"WITH x AS (SELECT extr_id AS doc_id, page_starts AS st, i AS line_no, coalesce(text_lines[i], '') AS line FROM extractions, range(1, len(text_lines) + 1) r(i) WHERE len(page_starts) >= 3), y AS (SELECT DISTINCT doc_id, line_no, {S} AS s, len(list_filter(st, lambda q: q <= line_no - 1)) AS page FROM x WHERE {S} <> ''), z AS (SELECT doc_id, page, min((line_no, s)) AS h, max((line_no, s)) AS f FROM y WHERE page >= 1 GROUP BY doc_id, page) SELECT doc_id, page, 'head' AS edge, h[1] AS line_no, h[2] AS s FROM z UNION ALL SELECT doc_id, page, 'foot', f[1], f[2] FROM z",
        "coverage": f"WITH {LINES} SELECT doc_id, count(*) AS text_lines, count(*) AS covered_once FROM L WHERE {S} <> '' GROUP BY doc_id",
        "verbatim_fidelity": f"WITH {LINES} SELECT doc_id, 'verbatim' AS variant, count(*) AS output_lines, 0 AS invented_lines FROM L WHERE trim(regexp_replace(line, '[ \\t]+$', ''), ' ') <> '' GROUP BY doc_id",
        "modal_layout": f"WITH {MODES} SELECT * FROM Mo",
        "double_spaced": f"WITH {BLOCKS}, {SPACED} SELECT doc_id FROM Sp",
        "protected_spans": f"WITH {SPANS} SELECT * FROM Span",
        "reflow_blocks": f"WITH {SPANS}, b AS (SELECT Bk.doc_id, block_id, min(Bk.line_no) AS first_line, count(*) AS n_lines, bool_or(EXISTS (SELECT 1 FROM Span WHERE Span.doc_id = Bk.doc_id AND Bk.line_no BETWEEN Span.first_line AND Span.last_line)) AS kept, string_agg(line, chr(10) ORDER BY Bk.line_no) AS whole, regexp_extract(first(line ORDER BY Bk.line_no), '^[ \\t]*') AS indent, string_agg(s, chr(31) ORDER BY Bk.line_no) AS glued FROM Bk WHERE NOT blank GROUP BY Bk.doc_id, block_id), c AS (SELECT b.*, NOT kept AND is_wrapped AND n_lines > 1 AS joined FROM b JOIN Wr USING (doc_id)) SELECT doc_id, block_id, first_line, n_lines, joined, CASE WHEN joined THEN indent || regexp_replace(replace(regexp_replace(glued, '([{LT}][{LT}\\p{{M}}\\p{{Nd}}_''’]*-)' || chr(31), '\\1', 'g'), chr(31), ' '), '[ \\t]+', ' ', 'g') ELSE whole END AS text FROM c",
        "footnote_bodies": f"WITH {NOTES} SELECT * FROM NB",
        "footnote_markers": f"WITH {NOTES} SELECT * FROM NM",
        "footnote_pairs": f"WITH {PAIRS} SELECT *, marker_line IS NOT NULL AND body_line IS NOT NULL AS paired FROM NP",
        "review_items": f"WITH {REVIEWED}, {PAIRS[len(LINES) + 2 :]}, u AS (SELECT 'hyphen' AS kind, hyphenated AS key, 'no evidence either way' AS why FROM De WHERE decision NOT IN ('join', 'keep') UNION ALL SELECT 'footnote', '[' || label || ']', 'no partner found' FROM NP WHERE marker_line IS NULL OR body_line IS NULL) SELECT kind, key, min(why) AS why, count(*) AS occurrences, '?' AS decision FROM u GROUP BY kind, key",
        "review_apply": f"WITH {REVIEWED}, h AS (SELECT hyphenated, max(decision) AS answer FROM breaks WHERE decision IN ('join', 'keep') GROUP BY hyphenated), j AS (SELECT De.*, answer, CASE WHEN De.decision IN ('join', 'keep') OR answer IS NULL THEN De.decision ELSE answer END AS final FROM De LEFT JOIN h USING (hyphenated)) SELECT doc_id, line_no, hyphenated, final AS decision, CASE final WHEN 'join' THEN joined WHEN 'keep' THEN hyphenated END AS resolved FROM j",
        "interface_label_counts": f"""WITH {RECORDS}, b AS (SELECT doc_id, record, line_no, s, length(s) <= 24 AND len(regexp_split_to_array(s, '[{B}]+')) <= 4 AS shaped FROM R WHERE is_body),
 t AS (SELECT *, min(shaped::INT) OVER (PARTITION BY doc_id, record ORDER BY line_no DESC) AS run, row_number() OVER (PARTITION BY doc_id, record ORDER BY line_no DESC) AS k, count(*) OVER (PARTITION BY doc_id, record) AS n FROM b),
 y AS (SELECT doc_id, record, regexp_replace(regexp_replace(lower(s), '\\p{{Nd}}+', '#', 'g'), '^[^{LT}\\p{{M}}\\p{{Nd}}_]+|[^{LT}\\p{{M}}\\p{{Nd}}_]+$', '', 'g') AS key FROM t WHERE run = 1 AND k < n),
 z AS (SELECT doc_id, count(DISTINCT record) AS records FROM R GROUP BY doc_id) SELECT doc_id, key, count(DISTINCT record) AS records_with, records, count(DISTINCT record) >= greatest(3, round_even(0.2 * records, 0)::INT) AS confirmed FROM y JOIN z USING (doc_id) WHERE key <> '' GROUP BY doc_id, key, records""",
        "accuracy_prf": f"""WITH x AS (SELECT DISTINCT extr_id AS doc_id, i AS line_no, coalesce(text_lines[i], '') AS line FROM extractions, range(1, len(text_lines) + 1) r(i) WHERE kind IN ('text', 'ocr')), n0 AS (SELECT *, lead(line) OVER (PARTITION BY doc_id ORDER BY line_no) AS nxt FROM x),
 p AS (SELECT DISTINCT doc_id, line_no FROM n0 WHERE regexp_matches(line, '{TAIL}') AND regexp_matches(nxt, '{HEAD}')), t AS (SELECT DISTINCT extr_id AS doc_id, line_no FROM breaks WHERE extr_id IN (SELECT extr_id FROM extractions WHERE kind IN ('text', 'ocr'))),
 c AS (SELECT (SELECT count(*) FROM t SEMI JOIN p USING (doc_id, line_no)) AS tp, (SELECT count(*) FROM p ANTI JOIN t USING (doc_id, line_no)) AS fp, (SELECT count(*) FROM t ANTI JOIN p USING (doc_id, line_no)) AS fn)
 SELECT tp, fp, fn, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END, 6) AS precision, round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END, 6) AS recall, round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0.0 END, 6) AS f1 FROM c""",
    }
