"""DuckDB SQL for the queries of ``queries``, written from the rules and not from the plans."""

from __future__ import annotations

from docstruct.functions.features import SMALL_WORDS
from docstruct.functions.rules import NUMBERED, NUMBERED_OTHER, TITLE_CAPS, TITLE_MARKS
from docstruct.functions.text import BULLETS, DOUBLE_QUOTES, GONE, SINGLE_QUOTES, SPACES
from docstruct.plans.queries import DIM, ROLE, TASK

ORACLES: dict[str, str] = {}


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def collapse(x: str) -> str:
    return strip(rf"regexp_replace({x}, '\s+', ' ', 'g')")


def uni(x: str) -> str:
    return f"translate(nfc_normalize({x}), {q(SPACES + DOUBLE_QUOTES + SINGLE_QUOTES + GONE)}, {q(' ' * len(SPACES) + chr(34) * 3 + chr(39) * 3)})"


def white(x: str) -> str:
    x = rf"regexp_replace(replace(regexp_replace({x}, ' +', ' ', 'g'), chr(9), ' '), '\n\s*\n+', chr(10) || chr(10), 'g')"
    return f"replace(replace(replace({x}, chr(10) || chr(10), chr(1)), chr(10), ' '), chr(1), chr(10) || chr(10))"


def clean(x: str) -> str:
    x = rf"regexp_replace({x}, '[^\P{{C}}\n\t]', '', 'g')"
    return rf"translate(regexp_replace(regexp_replace({x}, '([.!?]){{3,}}', '\1\1\1', 'g'), '([,-]){{2,}}', '\1', 'g'), {q(DOUBLE_QUOTES + SINGLE_QUOTES)}, {q(chr(34) * 3 + chr(39) * 3)})"


def special(x: str) -> str:
    return rf"regexp_replace(regexp_replace({x}, '(?m)(^|\s)[{BULLETS}]\s*', '\1• ', 'g'), '(?m)^(\d+)[.)]\s*', '\1. ', 'g')"


def norm(x: str) -> str:
    return strip(special(clean(white(uni(x)))))


def counted(x: str, pattern: str) -> str:
    return f"len(regexp_extract_all({x}, {q(pattern)}))"


def share(x: str, pattern: str) -> str:
    return f"CASE WHEN length({x}) > 0 THEN {counted(x, pattern)}::DOUBLE / length({x}) ELSE 0 END"


LINES = """lines AS (
  SELECT doc_id, seq::INT AS seq, text, (seq // 40 + 1)::INT AS page_number, 72::DOUBLE AS x0, (72 + 14 * (seq % 40))::DOUBLE AS y0, (72 + 5 * length(text))::DOUBLE AS x1, (84 + 14 * (seq % 40))::DOUBLE AS y1,
    CASE WHEN seq = 0 THEN 20 WHEN length(text) < 30 THEN 15 ELSE 11 END::DOUBLE AS font_size, CASE WHEN length(text) < 30 THEN 'Helvetica-Bold' ELSE 'Helvetica' END AS font_name, CASE WHEN length(text) < 30 THEN 16 ELSE 0 END AS font_flags
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, unnest(range(0, len(string_split(text, chr(10))))) AS seq FROM documents))"""
NUMBERS = LINES + """, numbered AS (SELECT * REPLACE (CASE WHEN length(text) < 60 THEN CASE seq % 6 WHEN 0 THEN '1. ' WHEN 1 THEN '1.2 ' WHEN 2 THEN '1.2.3 ' WHEN 3 THEN 'Chapter 4 ' WHEN 4 THEN '(a) ' ELSE '' END || text ELSE text END AS text) FROM lines)"""
ORDERS = """orders_ AS (
  SELECT l_orderkey AS doc_id, n AS seq, p_name AS text, ((n - 1) // 4 + 1)::INT AS page_number, l_tax * 1000 AS x0, (20 * n)::DOUBLE AS y0, l_tax * 1000 + 5 * length(p_name) AS x1, 20 * n + l_quantity AS y1,
    l_quantity AS font_size, p_brand AS font_name, CASE l_returnflag WHEN 'R' THEN 16 WHEN 'A' THEN 2 ELSE 0 END AS font_flags
  FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice)::INT AS n FROM lineitem JOIN part ON l_partkey = p_partkey))"""


def grouped(name: str, out: str, settings: str = "") -> str:
    return f"""{out} AS (
  SELECT * EXCLUDE (pp, px0, py0, px1, py1, ps, pf, pg, opens), sum(opens) OVER (PARTITION BY doc_id ORDER BY page_number, y0, x0, seq)::INT AS group_id, CASE WHEN opens = 1 THEN '' WHEN abs(y0 - py0) <= 2 THEN ' ' ELSE chr(10) END AS gap
  FROM (SELECT *, CASE WHEN pp IS NULL OR NOT (pp = page_number AND abs(font_size - ps) / greatest(font_size, ps) <= 0.1::DOUBLE AND pf = font_name AND pg = font_flags
      AND CASE WHEN abs(y0 - py0) <= 2 THEN x0 - px1 <= 10 ELSE y0 - py1 BETWEEN 0 AND 2 AND least(x1, px1) - greatest(x0, px0) > 0 END) THEN 1 ELSE 0 END AS opens
    FROM (SELECT *, lag(page_number) OVER w AS pp, lag(x0) OVER w AS px0, lag(y0) OVER w AS py0, lag(x1) OVER w AS px1, lag(y1) OVER w AS py1, lag(font_size) OVER w AS ps, lag(font_name) OVER w AS pf, lag(font_flags) OVER w AS pg
      FROM {name} WINDOW w AS (PARTITION BY doc_id ORDER BY page_number, y0, x0, seq))))"""


def merged(name: str, out: str) -> str:
    first = lambda c: f"arg_min({c}, [page_number::DOUBLE, y0, x0, seq::DOUBLE]) AS {c}"
    return f"""{out} AS (SELECT doc_id, group_id AS seq, string_agg(gap || text, '' ORDER BY page_number, y0, x0, seq) AS text, min(page_number) AS page_number, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, {first('font_size')}, {first('font_name')}, {first('font_flags')}, count(*) AS n_spans
  FROM {name} GROUP BY doc_id, group_id)"""


def featured(name: str, out: str) -> str:
    caps = r"[\p{Lu}]"
    return f"""{out} AS (SELECT *, CASE WHEN avg_size > 0 THEN font_size / avg_size ELSE 1 END AS ratio, font_flags & 16 > 0 AS bold, font_flags & 2 > 0 AS italic,
    CASE WHEN width > 0 THEN (x0 - page_left) / width ELSE 0 END AS nx, CASE WHEN height > 0 THEN (y0 - page_top) / height ELSE 0 END AS ny, length({strip('text')}) AS text_length,
    CASE WHEN {counted('text', '[' + chr(92) + 'p{Lu}' + chr(92) + 'p{Ll}' + chr(92) + 'p{Lt}]')} > 0 THEN {counted('text', caps)}::DOUBLE / {counted('text', '[' + chr(92) + 'p{Lu}' + chr(92) + 'p{Ll}' + chr(92) + 'p{Lt}]')} ELSE 0 END AS capitals
  FROM (SELECT *, page_right - page_left AS width, page_bottom - page_top AS height FROM (SELECT *, coalesce(avg(font_size) FILTER (font_size > 0) OVER d, 12) AS avg_size, coalesce(min(font_size) FILTER (font_size > 0) OVER d, 12) AS least_size, coalesce(max(font_size) FILTER (font_size > 0) OVER d, 12) AS most_size,
      min(x0) OVER p AS page_left, min(y0) OVER p AS page_top, greatest(max(x1) OVER p, 0) AS page_right, greatest(max(y1) OVER p, 0) AS page_bottom
    FROM {name} WINDOW d AS (PARTITION BY doc_id), p AS (PARTITION BY doc_id, page_number))))"""


def any_of(patterns: tuple[str, ...], flags: str = "") -> str:
    return q(f"{flags}^(?:{'|'.join(patterns)})")


def numbered(x: str) -> str:
    return f"(regexp_matches({x}, {any_of(NUMBERED, '(?i)')}) OR regexp_matches({x}, {any_of(NUMBERED_OTHER)}))"


def level(x: str) -> str:
    return rf"CASE len(string_split(regexp_extract({x}, '^(\d+(?:\.\d+)*)', 1), '.')) + CASE WHEN regexp_matches({x}, '^\d') THEN 0 ELSE 9 END WHEN 1 THEN 'h1' WHEN 2 THEN 'h2' WHEN 3 THEN 'h3' WHEN 4 THEN 'h3' WHEN 5 THEN 'h3' WHEN 6 THEN 'h3' ELSE 'h2' END"


def ruled(name: str, out: str) -> str:
    t = strip("text")
    return f"""{out} AS (SELECT *, CASE rule WHEN 1 THEN {level(t)} WHEN 2 THEN 'h1' ELSE 'text' END AS predicted_class, CASE rule WHEN 1 THEN 0.6 WHEN 2 THEN 0.7 ELSE 0.9 END::DOUBLE AS confidence
  FROM (SELECT *, CASE WHEN {numbered(t)} AND text_length > 5 AND text_length < 100 AND NOT contains({t}, chr(10)) THEN 1 WHEN ratio > 2 AND bold AND text_length > 10 AND text_length < 80 AND NOT contains({t}, chr(10)) THEN 2 ELSE 0 END AS rule FROM {name}))"""


UPPER = r"regexp_matches({x}, '\p{{Lu}}') AND NOT regexp_matches({x}, '[\p{{Ll}}\p{{Lt}}]')"


def text_only(x: str) -> tuple[str, str]:
    title, up = f"regexp_matches({x}, {any_of((TITLE_CAPS, *TITLE_MARKS), '(?i)')})", UPPER.format(x=x)
    return (f"CASE WHEN {numbered(x)} THEN {level(x)} WHEN {title} THEN 'title' WHEN {up} AND length({x}) > 3 THEN 'h1' ELSE 'text' END", f"CASE WHEN {numbered(x)} THEN 0.5 WHEN {title} THEN 0.6 WHEN {up} AND length({x}) > 3 THEN 0.4 ELSE 0.8 END::DOUBLE")


#: Numbered lines through the whole classification.
CLASSED = ", ".join((NUMBERS, f"kept AS (SELECT * REPLACE ({norm('text')} AS text) FROM numbered WHERE length({strip('text')}) >= 3 AND font_size > 0 AND page_number <= 50)", "filled AS (SELECT * FROM kept WHERE text <> '')", grouped("filled", "groups"), merged("groups", "blocks"), featured("blocks", "feats"), ruled("feats", "classed")))
HEADS = "heads AS (SELECT *, CASE predicted_class WHEN 'title' THEN 'title' WHEN 'h2' THEN 'H2' WHEN 'h3' THEN 'H3' ELSE 'H1' END AS level FROM (SELECT * REPLACE ({t} AS text) FROM {name}) WHERE predicted_class IN ('title', 'h1', 'h2', 'h3'))"
TITLES = "titles AS (SELECT doc_id, coalesce(arg_max(text, [confidence, -seq]) FILTER (level = 'title'), arg_min(text, [page_number::DOUBLE, {y}, seq::DOUBLE])) AS title FROM heads GROUP BY doc_id)"
REST = "rest AS (SELECT heads.* FROM heads LEFT JOIN titles USING (doc_id) WHERE title IS NULL OR {t} = '' OR text <> {t})".format(t=strip("title"))


def progressed(name: str, out: str) -> str:
    """The running state itself, by the last H2 or H3 that came out."""
    return f"""{out} AS (SELECT * EXCLUDE (rn, deep) REPLACE (CASE WHEN level = 'title' THEN 'title' WHEN rn = 1 OR level = 'H1' THEN 'H1' WHEN level = 'H3' AND deep > 0 THEN 'H3' ELSE 'H2' END AS level)
  FROM (SELECT *, count(*) FILTER (rn > 1 AND level IN ('H2', 'H3')) OVER (PARTITION BY doc_id, level = 'title' ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS deep
    FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, level = 'title' ORDER BY page_number, text, seq) AS rn FROM {name})))"""


OUTLINES = ", ".join((CLASSED, HEADS.format(t=strip("text"), name="classed"), TITLES.format(y="ny"), REST, progressed("rest", "prog"), """
  entries AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY page_number, text, seq) - 1 AS place, level, text, page_number AS page FROM prog WHERE level <> 'title'),
  docs AS (SELECT DISTINCT doc_id FROM classed),
  named AS (SELECT doc_id, coalesce(nullif(title, ''), 'Untitled Document') AS title FROM docs LEFT JOIN titles USING (doc_id))"""))
FAKE = ", ".join((LINES, f"""fake AS (SELECT *, CASE WHEN k = 0 THEN 'title' WHEN k < 3 THEN 'h1' WHEN k < 6 THEN 'h2' WHEN k < 9 THEN 'h3' ELSE 'text' END AS predicted_class, (k % 4)::DOUBLE / 4 AS confidence, font_size / 11 AS ratio
  FROM (SELECT *, (doc_id * 31 + seq * 7) % 11 AS k FROM lines WHERE length({strip('text')}) > 0))""", HEADS.format(t=strip("text"), name="fake"), TITLES.format(y="y0")))


def headered(name: str, out: str) -> str:
    t = strip("text")
    title = rf"regexp_matches({t}, '[\p{{Lu}}\p{{Ll}}\p{{Lt}}]') AND NOT regexp_matches({t}, '[\p{{Lu}}\p{{Ll}}\p{{Lt}}][\p{{Lu}}\p{{Lt}}]') AND NOT regexp_matches({t}, '(?:^|[^\p{{Lu}}\p{{Ll}}\p{{Lt}}])\p{{Ll}}')"
    return rf"""{out} AS (SELECT *, length({t}) >= 3 AND (font_size > median_font_size * 1.2::DOUBLE OR (regexp_matches(lower(font_name), 'bold|black|heavy') AND length(text) BETWEEN 5 AND 150) OR regexp_matches({t}, '^\d+\.?\d*\.?\s+[A-Z]')
    OR (({UPPER.format(x=t)}) AND length({t}) BETWEEN 5 AND 80) OR (({title}) AND length({t}) BETWEEN 10 AND 100)) AS is_header
  FROM (SELECT *, coalesce(median(font_size) FILTER (length(text) > 3) OVER (PARTITION BY doc_id), 12) AS median_font_size FROM {name}))"""


def sectioned(name: str, out: str) -> str:
    return f"""{out} AS (SELECT doc_id, min(seq) AS seq, coalesce(max(text) FILTER (is_header), 'Introduction') AS section_title, string_agg(text, ' ' ORDER BY seq) FILTER (NOT is_header) AS content, arg_min(page_number, seq) AS page_number, any_value(median_font_size) AS median_font_size
  FROM (SELECT *, count(*) FILTER (is_header) OVER (PARTITION BY doc_id ORDER BY seq) AS section FROM {name}) GROUP BY doc_id, section HAVING count(*) FILTER (NOT is_header) > 0)"""


SECTIONS = ", ".join((LINES, headered("lines", "headered"), sectioned("headered", "sections")))


def slots(source: str, key: str, text: str, out: str) -> str:
    """Hashed token counts of each key, of length one."""
    return f"""{out}_n AS (SELECT {key}, slot, count(*)::DOUBLE AS n FROM (SELECT {key}, ('0x' || substr(md5(token), 1, 8))::BIGINT % {DIM} AS slot
    FROM (SELECT {key}, unnest(regexp_extract_all(lower({text}), '[\\p{{L}}\\p{{N}}]+')) AS token FROM {source})) GROUP BY {key}, slot),
  {out} AS (SELECT {key}, slot, n / sqrt(sum(n * n) OVER (PARTITION BY {key})) AS weight FROM {out}_n)"""


RANKED = ", ".join((SECTIONS, """named_sections AS (SELECT d.source AS collection, 'doc' || s.doc_id AS document, s.doc_id * 1000000 + s.seq AS key, section_title, page_number, content,
    CASE WHEN length(section_title || '. ' || content) > 5000 THEN substr(section_title || '. ' || content, 1, 5000) || '...' ELSE section_title || '. ' || content END AS t FROM sections s JOIN documents d USING (doc_id))""",
    slots("named_sections", "key", "t", "sv"), f"asked AS (SELECT 0 AS one, {q(ROLE + ' ' + TASK)} AS t)", slots("asked", "one", "t", "qv"), """
  sims AS (SELECT key, sum(sv.weight * qv.weight) AS s FROM sv JOIN qv USING (slot) GROUP BY key),
  ranked AS (SELECT n.*, coalesce(s, 0) AS similarity, row_number() OVER (PARTITION BY collection ORDER BY round(coalesce(s, 0), 12) DESC, key) AS importance_rank FROM named_sections n LEFT JOIN sims USING (key))"""))
SENTENCE = rf"list_transform(list_filter(list_transform(string_split(regexp_replace({{x}}, '[.!?]+\s+([A-Z])', chr(1) || '\1', 'g'), chr(1)), lambda s: {strip('s')}), lambda s: length(s) > 10), lambda s: CASE WHEN regexp_matches(s, '[.!?]$') THEN s ELSE s || '.' END)"
TOLD = ", ".join((RANKED, f"""
  firsts AS (SELECT collection, document, section_title, page_number, arg_min(content, key) AS content FROM named_sections GROUP BY ALL),
  tops AS (SELECT r.collection, r.document, r.section_title, r.page_number, r.importance_rank, f.content FROM ranked r JOIN firsts f USING (collection, document, section_title, page_number) WHERE importance_rank <= 10),
  sents AS (SELECT *, collection || '|' || importance_rank || '|' || place AS sid FROM (SELECT collection, importance_rank, document, page_number, unnest(l[1:100]) AS sentence, unnest(range(0, len(l[1:100]))) AS place FROM (SELECT *, {SENTENCE.format(x='content')} AS l FROM tops)))""",
    slots("sents", "sid", "sentence", "nv"), """
  nsims AS (SELECT sid, sum(nv.weight * qv.weight) AS s FROM nv JOIN qv USING (slot) GROUP BY sid),
  nranked AS (SELECT sents.*, coalesce(s, 0) AS similarity, row_number() OVER (PARTITION BY collection, importance_rank ORDER BY round(coalesce(s, 0), 12) DESC, place) AS rk FROM sents LEFT JOIN nsims USING (sid)),
  told AS (SELECT collection, importance_rank, document, page_number, string_agg(sentence, ' ' ORDER BY rk) AS refined_text, count(*) AS sentence_count, avg(similarity) AS avg_similarity FROM nranked WHERE rk <= 10 GROUP BY ALL)"""))
RUNS = "runs AS (SELECT event_type AS operation, value AS duration, (user_id % 50)::DOUBLE AS b, ((user_id * 7) % 300)::DOUBLE AS a, ((user_id * 13) % 700)::DOUBLE AS p FROM events)"
PROFILE = RUNS + ", profile AS (SELECT operation, count(*) AS n, sum(duration) AS total_duration, max(duration) AS max_duration, min(duration) AS min_duration, avg(duration) AS avg_duration, sum(a - b) AS total_memory_used, avg(a - b) AS avg_memory_used, max(p) AS max_memory_peak FROM runs GROUP BY operation)"
LISTED = "listed AS (SELECT doc_id % 25 AS collection, doc_id AS place, doc_id || '.pdf' AS filename FROM documents)"
ALNUM = r"[^\p{L}\p{N}\s]"


def add(name: str, body: str, *ctes: str) -> None:
    ORACLES[name] = (f"WITH {', '.join(ctes)} " if ctes else "") + body


add("flt_valid_blocks", f"SELECT doc_id, seq, text, font_size FROM lines WHERE length({strip('text')}) >= 3 AND font_size > 0", LINES)
add("prj_repair", "SELECT doc_id, seq, page_number, round(greatest(CASE WHEN seq % 3 > 0 THEN font_size / 30 ELSE 12 END, 1), 6) AS font_size, CASE WHEN seq % 5 > 0 THEN font_name ELSE 'unknown' END AS font_name, font_flags, CASE WHEN seq % 7 > 0 THEN x0 ELSE 0 END AS x0, CASE WHEN seq % 7 > 0 THEN y0 ELSE 0 END AS y0, CASE WHEN seq % 7 > 0 THEN x1 ELSE 0 END AS x1, CASE WHEN seq % 7 > 0 THEN y1 ELSE 0 END AS y1 FROM lines WHERE page_number <= 50", LINES)
add("txt_collapse_ws", f"SELECT doc_id, coalesce({collapse(uni('text'))}, '') AS text FROM documents")
add("txt_whitespace", f"SELECT doc_id, {white('t')} AS text FROM (SELECT doc_id, replace(text, '. ', '.  ' || chr(9) || chr(10) || ' ' || chr(10)) AS t FROM documents)")
add("txt_clean", f"SELECT doc_id, {clean('t')} AS text FROM (SELECT doc_id, replace(replace(text, '.', '!!!!!'), ',', ',-,-' || chr(7)) AS t FROM documents)")
add("txt_bullets_numbers", f"SELECT doc_id, seq, {special('t')} AS text FROM (SELECT doc_id, seq, CASE seq % 3 WHEN 0 THEN seq || ')' WHEN 1 THEN '▪ ' ELSE '7.2  ' END || text AS t FROM lines)", LINES)
add("txt_normalize", f"SELECT doc_id, seq, {norm('text')} AS text FROM numbered", NUMBERS)
add("txt_sentences", f"SELECT doc_id, unnest(l[1:100]) AS sentence, unnest(range(0, len(l[1:100])))::INT AS place FROM (SELECT doc_id, {SENTENCE.format(x='text')} AS l FROM documents)")
add("txt_query_section", f"SELECT doc_id, nullif(substr({strip(chr(39) * 2 + ' || coalesce(source, ' + chr(39) * 2 + ') || ' + chr(39) + ' ' + chr(39) + ' || coalesce(nullif(lang, ' + q('en') + '), ' + chr(39) * 2 + ')')}, 1, 1000), '') AS query, CASE WHEN length(source || '. ' || text) > 5000 THEN substr(source || '. ' || text, 1, 5000) || '...' ELSE source || '. ' || text END AS section FROM documents")
add("txt_paths", r"SELECT page_id, string_split(url, '/')[-1] AS basename, regexp_extract(url, '([^/]*?)(\.[^./]*)?$', 1) AS stem FROM pages")
add("agg_doc_font_stats", "SELECT doc_id, round(avg(font_size), 6) AS avg_font_size, max(font_size) AS max_font_size, min(font_size) AS min_font_size, list_sort(list(font_size))[count(*) // 2 + 1] AS median_font_size, round(coalesce(stddev_samp(font_size), 0), 6) AS std_font_size, count(*) AS total_blocks, max(page_number) AS total_pages FROM orders_ GROUP BY doc_id", ORDERS)
add("agg_top_fonts", "SELECT doc_id, rank, font_name, n FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, seen)::INT AS rank FROM (SELECT doc_id % 500 AS doc_id, font_name, count(*) AS n, min(10 * doc_id + seq) AS seen FROM orders_ GROUP BY doc_id % 500, font_name)) WHERE rank <= 5", ORDERS)
add("agg_page_extents", "SELECT doc_id, page_number, greatest(max(x1), 0) - min(x0) AS width, greatest(max(y1), 0) - min(y0) AS height, min(x0) AS left_margin, min(y0) AS top_margin FROM lines GROUP BY ALL", LINES)
add("agg_true_median", "SELECT doc_id, coalesce(median(font_size) FILTER (length(text) > 3), 12) AS median_font_size FROM orders_ GROUP BY doc_id", ORDERS)
add("agg_level_counts", "SELECT doc_id, level, count(*) AS n FROM heads GROUP BY ALL", CLASSED, HEADS.format(t=strip("text"), name="classed"))
add("agg_structure_metadata", "SELECT doc_id, count(*) AS total_blocks, count(*) FILTER (predicted_class <> 'text') AS heading_blocks, bool_or(predicted_class = 'title') AS title_detected FROM classed GROUP BY doc_id", CLASSED)
add("fea_font", "SELECT doc_id, seq, round(ratio, 6) AS font_size_ratio, bold AS is_bold, italic AS is_italic, round(CASE WHEN most_size > least_size THEN (font_size - least_size) / (most_size - least_size) ELSE 0.5 END, 6) AS relative_font_size, round(least(CASE WHEN bold THEN ratio * 1.5 ELSE ratio END, 3), 6) AS font_weight_score, round(greatest(0::DOUBLE, least(1::DOUBLE, len(list_filter(['heading', 'title', 'header', 'bold', 'black', 'heavy'], lambda s: contains(lower(font_name), s))) * 0.3::DOUBLE - CASE WHEN italic THEN 0.1 ELSE 0 END::DOUBLE)), 6) AS font_style_score FROM feats", ORDERS, featured("orders_", "feats"))
add("fea_position", "SELECT doc_id, seq, round(nx, 6) AS position_x, round(ny, 6) AS position_y, round((1 - ny) * 0.7::DOUBLE + (1 - abs(nx)) * 0.3::DOUBLE, 6) AS page_position_score, round(greatest(1 - least(nx, 1), (1 - abs(nx - 0.5::DOUBLE) * 2) * 0.8::DOUBLE), 6) AS alignment_score, round(greatest(0, ny), 6) AS whitespace_above, round(CASE WHEN height > 0 THEN greatest(0, 1 - (y1 - page_top) / height) ELSE 0 END, 6) AS whitespace_below, round(nx, 6) AS indentation_level FROM feats", LINES, featured("lines", "feats"))
add("fea_content", rf"SELECT doc_id, seq, length(t)::INT AS text_length, (CASE WHEN t = '' THEN 0 ELSE len(string_split({collapse('t')}, ' ')) END)::INT AS word_count, {counted('t', '[.!?]+')}::INT AS sentence_count, round(CASE WHEN {counted('t', '[' + chr(92) + 'p{Lu}' + chr(92) + 'p{Ll}' + chr(92) + 'p{Lt}]')} > 0 THEN {counted('t', chr(92) + 'p{Lu}')}::DOUBLE / {counted('t', '[' + chr(92) + 'p{Lu}' + chr(92) + 'p{Ll}' + chr(92) + 'p{Lt}]')} ELSE 0 END, 6) AS capitalization_score, round({share('t', chr(92) + 's')}, 6) AS whitespace_ratio, round({share('t', '[.,;:!?()' + chr(92) + '[' + chr(92) + ']{}' + chr(34) + chr(39) + chr(92) + '-]')}, 6) AS punctuation_density, round({share('t', chr(92) + 'p{Nd}')}, 6) AS numeric_content_ratio, round({share('t', ALNUM)}, 6) AS special_char_ratio FROM (SELECT *, {strip('text')} AS t FROM numbered)", NUMBERS)
_W, _UP = "string_split(t, ' ')", "regexp_matches(w, '\\p{Lu}') AND NOT regexp_matches(w, '[\\p{Ll}\\p{Lt}]')"
add("fea_case", rf"""SELECT doc_id, seq, round(CASE WHEN t = '' OR len(list_filter({_W}, lambda w: regexp_matches(w, '^\p{{L}}+$') AND NOT ({_UP}))) = 0 THEN 0 ELSE
    len(list_filter(range(1, len({_W}) + 1), lambda i: CASE WHEN i = 1 OR NOT list_contains([{', '.join(map(q, SMALL_WORDS))}], regexp_replace(lower({_W}[i]), '[^\p{{L}}\p{{N}}_]', '', 'g')) THEN regexp_matches({_W}[i], '^\p{{Lu}}') AND regexp_matches({_W}[i], '[\p{{Ll}}\p{{Lt}}]') ELSE regexp_matches({_W}[i], '^\p{{Ll}}') END))::DOUBLE / len({_W}) END, 6) AS title_case_score,
  round(CASE WHEN t = '' THEN 0 ELSE len(list_filter({_W}, lambda w: length(w) > 1 AND {_UP}))::DOUBLE / len({_W}) END, 6) AS all_caps_score FROM (SELECT doc_id, seq, {collapse('text')} AS t FROM numbered)""", NUMBERS)
add("fea_basic", rf"SELECT doc_id, seq, round(ratio, 6) AS font_size_ratio, bold AS is_bold, italic AS is_italic, x0 AS position_x, y0 AS position_y, length(text)::INT AS text_length, round(CASE WHEN {counted('text', chr(92) + 'p{L}')} > 0 THEN {counted('text', chr(92) + 'p{Lu}')}::DOUBLE / {counted('text', chr(92) + 'p{L}')} ELSE 0 END, 6) AS capitalization_score, round({share('text', chr(92) + 's')}, 6) AS whitespace_ratio FROM feats", LINES, featured("lines", "feats"))
add("fea_hints", "SELECT doc_id, seq, concat_ws(' ', CASE WHEN ratio > 1.5::DOUBLE THEN '[LARGE_FONT]' END, CASE WHEN bold THEN '[BOLD]' END, CASE WHEN italic THEN '[ITALIC]' END, CASE WHEN ny < 0.2::DOUBLE THEN '[TOP_POSITION]' END, CASE WHEN capitals > 0.8::DOUBLE THEN '[ALL_CAPS]' END, CASE WHEN text_length < 50 THEN '[SHORT_TEXT]' END, text) AS hinted FROM feats", LINES, featured("lines", "feats"))
add("lay_sort", "SELECT doc_id, seq, row_number() OVER (PARTITION BY doc_id ORDER BY page_number, y0, x0, seq)::INT AS place FROM orders_", ORDERS)
add("lay_group", "SELECT doc_id, seq, group_id, gap FROM groups", ORDERS, grouped("orders_", "groups"))
add("lay_merge", "SELECT doc_id, seq, text, page_number, x0, y0, x1, y1, font_size, font_name, font_flags, n_spans FROM blocks", LINES, grouped("lines", "groups"), merged("groups", "blocks"))
add("cls_numbered", f"SELECT doc_id, seq, {numbered('text')} AS numbered FROM numbered", NUMBERS)
add("cls_level", f"SELECT doc_id, seq, {level('text')} AS level FROM numbered", NUMBERS)
add("cls_rules", "SELECT doc_id, seq, predicted_class, confidence FROM ruled", NUMBERS, featured("numbered", "feats"), ruled("feats", "ruled"))
add("cls_text_only", "SELECT doc_id, seq, {} AS predicted_class, {} AS confidence FROM numbered".format(*text_only(strip("text"))), NUMBERS)
add("cls_title_rule", f"SELECT doc_id, seq, regexp_matches(text, {any_of((TITLE_CAPS,))}) OR regexp_matches(text, {any_of(TITLE_MARKS, '(?i)')}) OR (NOT {numbered('text')} AND ratio > 2.2::DOUBLE AND ny < 0.15::DOUBLE AND text_length < 200 AND (capitals > 0.7::DOUBLE OR nx < 0.05::DOUBLE)) AS is_title FROM feats", LINES, featured("lines", "feats"))
_TO = text_only(strip("text"))
_UNSURE = "mc IS NULL OR mf < 0.5::DOUBLE OR (mf >= 0.99::DOUBLE AND mc = 'title')"
add("cls_cascade", f"""SELECT doc_id, seq, CASE WHEN {strip('text')} = '' THEN NULL WHEN k = 6 THEN {_TO[0]} WHEN {_UNSURE} THEN predicted_class ELSE mc END AS predicted_class, CASE WHEN {strip('text')} = '' THEN NULL WHEN k = 6 THEN {_TO[1]} WHEN {_UNSURE} THEN confidence ELSE mf END AS confidence
  FROM (SELECT *, CASE WHEN k = 0 THEN NULL WHEN k < 3 THEN 'title' WHEN k < 5 THEN 'h2' ELSE 'text' END AS mc, ([0.9, 0.995, 0.7, 0.3, 0.8, 0.5, 0.49])[k + 1]::DOUBLE AS mf FROM (SELECT *, (doc_id + seq) % 7 AS k FROM ruled))""", NUMBERS, featured("numbered", "feats"), ruled("feats", "ruled"))
_LOGITS = "list_transform([3, 4, 5, 6, 7], lambda m: (n * m) % 11 / 2::DOUBLE)"
add("cls_model", f"""SELECT doc_id, seq, mc AS model_class, round(mf, 6) AS model_confidence, n % 13 = 7 AS model_failed, CASE WHEN {strip('text')} = '' THEN NULL WHEN n % 13 = 7 THEN {_TO[0]} WHEN {_UNSURE} THEN predicted_class ELSE mc END AS predicted_class,
    round(CASE WHEN {strip('text')} = '' THEN NULL WHEN n % 13 = 7 THEN {_TO[1]} WHEN {_UNSURE} THEN confidence ELSE mf END, 6) AS confidence
  FROM (SELECT *, CASE WHEN n % 13 <> 7 THEN (['text', 'title', 'h1', 'h2', 'h3'])[list_position(z, list_max(z))] END AS mc, CASE WHEN n % 13 <> 7 THEN exp(list_max(z)) / list_sum(list_transform(z, lambda x: exp(x))) END AS mf
    FROM (SELECT *, {_LOGITS} AS z FROM (SELECT *, length(text) AS n FROM ruled)))""", NUMBERS, featured("numbered", "feats"), ruled("feats", "ruled"))
add("cls_levels", f"SELECT doc_id, seq, CASE WHEN {strip('text')} = '' THEN 'text' ELSE predicted_class END AS level FROM ruled", NUMBERS, featured("numbered", "feats"), ruled("feats", "ruled"))
add("out_title", "SELECT doc_id, title FROM titles", FAKE)
add("out_largest_font", "SELECT doc_id, arg_max(text, [ratio, -seq]) AS title FROM heads WHERE page_number = 1 GROUP BY doc_id", FAKE)
add("out_filter_title", "SELECT doc_id, seq, level, text FROM rest", FAKE, REST)
add("out_progression", "SELECT doc_id, seq, level, page_number, text FROM prog", FAKE, progressed("heads", "prog"))
add("out_outline", "SELECT n.doc_id, n.title, coalesce(e.place, -1)::INT AS place, e.level, e.text, coalesce(e.page, 0) AS page FROM named n LEFT JOIN entries e USING (doc_id)", OUTLINES)
add("out_json", "SELECT n.doc_id, n.title, count(e.place)::INT AS entries, coalesce(string_agg(e.level || '|' || e.page || '|' || e.text, ';' ORDER BY e.place), '') AS joined FROM named n LEFT JOIN entries e USING (doc_id) GROUP BY ALL", OUTLINES)
add("out_validate", f"SELECT doc_id, doc_id % 13 > 0 AND bool_and(CASE WHEN seq % 19 = 5 THEN false ELSE true END AND {strip('text')} <> '' AND CASE WHEN seq % 23 = 7 THEN false ELSE page_number >= 1 END) AS valid FROM heads WHERE level <> 'title' OR seq % 19 = 5 GROUP BY doc_id", FAKE)
add("out_salvage", "SELECT doc_id, seq, substr(text, 1, 100) AS text, page_number FROM lines WHERE seq < 10", LINES)
add("sec_header", "SELECT doc_id, seq, median_font_size, is_header FROM headered", LINES, headered("lines", "headered"))
add("sec_sections", "SELECT doc_id, seq, section_title, content, page_number, median_font_size FROM sections", SECTIONS)
_TAG = "'<(h1|p|li)[^>]*>([^<]*)'"
PAGES = f"""page_spans AS (SELECT page_id AS doc_id, seq, text, 1 AS page_number, CASE tag WHEN 'h1' THEN 24 WHEN 'p' THEN 11 ELSE 10 END::DOUBLE AS font_size, CASE tag WHEN 'h1' THEN 'Helvetica-Bold' ELSE 'Helvetica' END AS font_name
  FROM (SELECT page_id, unnest(regexp_extract_all(html, {_TAG}, 1)) AS tag, unnest(regexp_extract_all(html, {_TAG}, 2)) AS text, unnest(range(0, len(regexp_extract_all(html, {_TAG}, 1))))::INT AS seq FROM pages))"""
add("sec_pages", "SELECT doc_id, seq, section_title, content, page_number, median_font_size FROM sections", PAGES, headered("page_spans", "headered"), sectioned("headered", "sections"))
VECTORS = """firsts AS (SELECT label, arg_min(embedding, vec_id) AS query FROM embeddings GROUP BY label),
  sims AS (SELECT e.label AS collection, e.vec_id AS seq, list_cosine_similarity(query::DOUBLE[], embedding::DOUBLE[]) AS similarity FROM embeddings e JOIN firsts f ON e.label IS NOT DISTINCT FROM f.label),
  ranks AS (SELECT *, row_number() OVER (PARTITION BY collection ORDER BY round(similarity, 12) DESC, seq)::INT AS importance_rank FROM sims)"""
add("rel_cosine", "SELECT collection, seq, round(similarity, 6) AS similarity FROM sims", VECTORS)
add("rel_rank", "SELECT collection, seq, importance_rank, round(similarity, 6) AS similarity FROM ranks", VECTORS)
add("rel_topk", "SELECT collection, seq, importance_rank FROM ranks WHERE importance_rank <= 10", VECTORS)
add("rel_lookup_first", "SELECT r.key AS seq, md5(f.content) AS content_md5 FROM keyed r JOIN (SELECT c, d, section_title, page_number, arg_min(content, key) AS content FROM keyed GROUP BY ALL) f USING (c, d, section_title, page_number)", SECTIONS, "keyed AS (SELECT doc_id % 10 AS c, doc_id % 40 AS d, doc_id * 1000 + seq AS key, * FROM sections)")
add("rel_hashed_embed", "SELECT doc_id, slot::INT AS slot, round(weight, 6) AS weight FROM dv", slots("documents", "doc_id", "text", "dv"))
add("rel_sections", "SELECT collection, document, section_title, importance_rank::INT AS importance_rank, page_number, round(similarity, 6) AS similarity FROM ranked", RANKED)
add("rel_sentences", "SELECT collection, importance_rank::INT AS importance_rank, document, page_number, refined_text, sentence_count, round(avg_similarity, 6) AS avg_similarity FROM told", TOLD)
add("rel_output", f"SELECT r.collection, {q(ROLE)} AS persona, r.n::INT AS sections, t.n::INT AS analysed, r.title AS first_title, md5(t.refined) AS first_refined_md5 FROM (SELECT collection, count(*) AS n, arg_min(section_title, importance_rank) AS title FROM ranked GROUP BY collection) r LEFT JOIN (SELECT collection, count(*) AS n, arg_min(refined_text, importance_rank) AS refined FROM told GROUP BY collection) t USING (collection)", TOLD)
add("cfg_found", "SELECT collection, place, filename FROM listed WHERE place % 3 > 0 OR place % 5 = 0", LISTED)
add("cfg_missing", "SELECT collection, place, filename FROM listed WHERE NOT (place % 3 > 0 OR place % 5 = 0)", LISTED)
add("cfg_required_keys", "SELECT doc_id, array_to_string(list_filter([CASE WHEN doc_id % 2 = 0 THEN 'challenge_info' END, CASE WHEN doc_id % 3 = 0 THEN 'documents' END, CASE WHEN doc_id % 7 = 0 THEN 'job_to_be_done' END, CASE WHEN doc_id % 5 = 0 THEN 'persona' END], lambda x: x IS NOT NULL), ',') AS missing FROM documents")
add("sts_profile", "SELECT operation, n, " + ", ".join(f"round({c}, 6) AS {c}" for c in ("total_duration", "max_duration", "min_duration", "avg_duration", "total_memory_used", "avg_memory_used", "max_memory_peak")) + " FROM profile", PROFILE)
add("sts_bottlenecks", "SELECT 'time' AS kind, operation, round(d / t, 6) AS value FROM (SELECT operation, sum(duration) AS d, sum(sum(duration)) OVER () AS t FROM runs GROUP BY operation) WHERE d / t > 0.15::DOUBLE UNION ALL SELECT 'memory', operation, round(a - b, 6) FROM runs WHERE a - b > 200", RUNS)
add("sts_recommendations", "SELECT printf('Optimize ''%s'' operation (avg: %.2fs)', operation, avg_duration) AS recommendation FROM profile WHERE avg_duration > 2 UNION ALL SELECT printf('Reduce memory usage in ''%s'' (peak: %.1fMB)', operation, max_memory_peak) FROM profile WHERE max_memory_peak > 500", PROFILE)
add("sts_error_counts", "SELECT event_type || ':' || (user_id % 4) AS error, count(*) AS n FROM events GROUP BY ALL UNION ALL SELECT 'total', count(*) FROM events")
add("sts_summary", "SELECT count(*) AS total, count(*) FILTER (doc_id % 4 > 0) AS successful, count(*) FILTER (doc_id % 4 = 0) AS failed, sum(doc_id % 9)::BIGINT AS sections, sum(doc_id % 3)::BIGINT AS documents, round(sum((doc_id % 8)::DOUBLE) / sum(doc_id % 3), 6) AS seconds_per_document, CASE WHEN count(*) FILTER (doc_id % 4 > 0) = 0 THEN 1 ELSE 0 END AS exit_code FROM documents")
add("sts_error_docs", """SELECT doc_id, (['Error: Processing Failed', 'Error: Invalid Output Format', 'Error: File Write Failed', 'Untitled Document', 'Document'])[doc_id % 5 + 1] AS title, (['OSError', 'ValidationError', 'WriteError', 'NoTitleFound', 'NoHeadingsDetected'])[doc_id % 5 + 1] AS type,
  ([m, 'Generated output failed format validation', m, 'No document title could be detected', 'No headings could be detected in the document'])[doc_id % 5 + 1] AS message, (['An error occurred during document processing', 'The processed document structure could not be formatted correctly', 'Failed to write output file', 'Using default title', 'The document may not contain structured headings'])[doc_id % 5 + 1] AS details
  FROM (SELECT doc_id, 'failed ' || source AS m FROM documents)""")
add("sts_coded_errors", """SELECT doc_id, (['Error: Failed to process ' || source || '.pdf', 'Error: Model Loading Failed', 'Error: Output Generation Failed', 'Error: Processing timeout for ' || source || '.pdf', 'Error: Invalid Output Format'])[k] AS title,
  (['PDFProcessingError', 'ModelLoadingError', 'OutputGenerationError', 'TimeoutError', 'ValidationError'])[k] AS type, CASE WHEN k = 4 THEN 'Processing exceeded 10 second limit' ELSE 'broken' END AS message,
  (['Failed to process PDF: /in/' || source || '.pdf', 'Failed to load model from: /in/' || source || '.pdf', 'Failed to generate proper JSON output', 'PDF processing timed out: /in/' || source || '.pdf', 'Generated output failed format validation'])[k] AS details,
  CASE WHEN k = 4 THEN 'PROCESSING_TIMEOUT' WHEN doc_id % 2 = 0 THEN 'EMPTY_FILE' ELSE (['PDF_PROCESSING_FAILED', 'MODEL_LOADING_FAILED', 'OUTPUT_GENERATION_FAILED', '', 'VALIDATION_FAILED'])[k] END AS error_code, CASE WHEN k = 4 THEN 10 ELSE 0 END AS timeout_limit
  FROM (SELECT *, doc_id % 5 + 1 AS k FROM documents)""")
add("sts_empty_stages", "SELECT DISTINCT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'No text content found' WHEN doc_id % 5 = 0 THEN 'No content after preprocessing' ELSE 'Classification failed for all blocks' END AS message FROM documents WHERE doc_id % 7 = 0 OR doc_id % 5 = 0 OR doc_id % 3 = 0")
