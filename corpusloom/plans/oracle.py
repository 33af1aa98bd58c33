"""SQL equivalents of the registered queries, for an independent engine on the same tables.

They share only the fixed value lists with the library.  RE2 has no look-around, so word boundaries are
spelled as consuming character classes; single words are tested by token membership.
"""

from __future__ import annotations

from ..functions import classify as cl
from ..functions.text import CAPTION_MARK, HIGHLIGHT_MARK, PUNCTUATION, QUESTION_MARK
from ..operators.topics import LABELS
from . import catalog as cat
from . import views as v

SPACE = (
    r"[\x{09}-\x{0d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)
W, NW = r"[\p{L}\p{N}_]", r"[^\p{L}\p{N}_]"


# --- spelling helpers ---------------------------------------------------------------------------------


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def items(values) -> str:
    return ", ".join(q(x) for x in values)


def pick(values, index: str) -> str:
    return f"([{items(values)}])[({index}) + 1]"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{SPACE}+|{SPACE}+$', '', 'g')"


def collapse(x: str) -> str:
    return f"trim(regexp_replace(coalesce({x}, ''), '{SPACE}+', ' ', 'g'))"


def unquote(x: str) -> str:
    return f"replace({x}, '\"', '')"


def clean(x: str) -> str:
    return collapse(unquote(x))


def no_punct(x: str) -> str:
    return f"translate({x}, {q(PUNCTUATION)}, '')"


def after(x: str, marker: str) -> str:
    return f"CASE WHEN instr({x}, {q(marker)}) > 0 THEN substr({x}, instr({x}, {q(marker)}) + {len(marker)}) END"


def tokens(x: str) -> str:
    return f"regexp_extract_all(lower({x}), '{W}+')"


def has(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, {q(pattern)})"


def word(x: str, body: str) -> str:
    return has(x, f"(?i)(^|{NW})({body})({NW}|$)")


def any_token(words: str, vocabulary) -> str:
    return f"list_has_any({words}, [{items(vocabulary)}])"


def count_tokens(words: str, vocabulary) -> str:
    return f"len(list_filter({words}, lambda t: t IN ({items(vocabulary)})))"


# --- views --------------------------------------------------------------------------------------------

_SRC = pick(v.SOURCES, "conv_id % 7")
QA = f"""qa AS (
  SELECT {_SRC} AS source, conv_id * 1000 + turn AS ord,
         {pick(v.QUESTION_LEADS, 'k % 16')} || asked AS question,
         {pick(v.ANSWER_LEADS, 'k % 11')} ||
           CASE WHEN k % 11 IN (0, 1, 10) THEN told ELSE replace(told, ' ', '_') END AS answer,
         conv_id
  FROM (SELECT u.conv_id, u.turn, u.text AS asked, a.text AS told, u.conv_id * 3 + u.turn AS k
        FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
        WHERE u.role = 'user' AND a.role = 'assistant'))"""

EXAMPLES = QA + """, examples AS (
  SELECT source, ord,
    CASE WHEN source LIKE '%fetaqa%' THEN '[TLE] The Wikipedia page title of this table is Page  ' || tid
              || '. The Wikipedia section title of this table is Section "' || tid % 5 || '". '
         WHEN source LIKE '%hitab%' THEN '[TLE]  The table caption is Caption ' || tid || '. '
         ELSE '[TLE] The table caption is about topic ' || tid || '. ' END
    || CASE WHEN tid % 10 = 9 THEN '' ELSE '[TAB] col: | conv | src \\ | [SEP] | ' || tid || ' | set "'
              || tid % 7 || '" cat [TAB] col: |' END AS input_seg,
    CASE WHEN ord % 13 = 0 THEN question
         WHEN source LIKE '%fetaqa%' THEN 'cells [HIGHLIGHTED_BEGIN] 1 [HIGHLIGHTED_END] ' || question
         WHEN source LIKE '%hybridqa%' THEN 'A "passage". The question:' || question
         ELSE question END AS question,
    answer AS output
  FROM (SELECT *, (conv_id // 21) * 21 + conv_id % 7 AS tid FROM qa))"""

CLAIMS = EXAMPLES + """, claims AS (
  SELECT source, ord, input_seg,
    CASE WHEN ord % 11 = 4 THEN '' WHEN ord % 3 = 0 THEN 'statement: <' || question || '> holds' ELSE question END AS question
  FROM examples)"""

_UNWRAPPED = f"""CASE WHEN source LIKE '%fetaqa%' THEN {strip(after('question', HIGHLIGHT_MARK))}
  WHEN source LIKE '%hybridqa%' THEN {strip(after('question', QUESTION_MARK))} ELSE {strip('question')} END"""


def lead_in(lead: str) -> str:
    return clean(f"regexp_extract(input_seg, {q(f'(?is){lead}{SPACE}+(.*?)[.]')}, 1)")


_PAGE = lead_in("The Wikipedia page title of this table is")
_SECTION = lead_in("The Wikipedia section title of this table is")
_CAPTION = lead_in("The table caption is")
_RAW = "CASE WHEN instr(input_seg, '[TAB]') > 0 THEN substr(input_seg, instr(input_seg, '[TAB]')) ELSE '' END"
_PREFIXED = """CASE WHEN inner_text = '' THEN raw_table WHEN raw_table = '' THEN '[' || inner_text || '; ]'
    ELSE '[' || inner_text || '; ] ' || raw_table END"""
PARTS = EXAMPLES + f""", parts AS (
  SELECT *, {_PAGE} AS page_title, {_SECTION} AS section_title, {_CAPTION} AS caption, {_RAW} AS raw_table
  FROM examples), prefixed AS (
  SELECT *, {_PREFIXED} AS "table" FROM (
    SELECT *, CASE
      WHEN source LIKE '%fetaqa%' THEN concat_ws('; ', 'Wikipedia page title:' || nullif(page_title, ''),
                                               'Wikipedia section title:' || nullif(section_title, ''))
      WHEN source LIKE '%hitab%' THEN coalesce('Table caption:' || nullif(caption, ''), '')
      ELSE '' END AS inner_text FROM parts))"""
TQA = PARTS + f""", tqa AS (
  SELECT source, ord, question, answer, "table" FROM (
    SELECT source, ord, {clean(_UNWRAPPED)} AS question, {clean('output')} AS answer, "table" FROM prefixed)
  WHERE question <> '' AND answer <> '')"""


def segment(x: str, version: int, compat: bool) -> str:
    gap = " " if version == 1 else f"{SPACE}*"
    out = f"coalesce({x}, '')"
    steps = [
        (rf"\[TLE\]{gap}The Wikipedia page title of this table is", ""),
        ("The Wikipedia section title of this table is", ""),
        (rf"\[TLE\]{gap}The table caption is", ""),
        (r"\[TAB\]", ""),
        (rf"(^|{NW})col:({W})", r"\1\2"),
        (r"\|", ""), (r"\\", ""), (r"\[SEP\]", ""),
    ] + ([(f"[TAB]{gap}col:", "")] if compat else []) + [("col:", "")]
    for pattern, to in steps:
        out = f"regexp_replace({out}, {q(pattern)}, {q(to)}, 'gi')"
    return clean(out)


_caption_body = f"coalesce({after('input_seg', CAPTION_MARK)}, input_seg)"
_clean_caption = strip(rf"regexp_replace({_caption_body}, '\[TAB\]|\[SEP\]|\|', '', 'g')")
_claim = strip(r"CASE WHEN regexp_matches(question, '<([^\n]*?)>') "
               r"THEN regexp_extract(question, '<([^\n]*?)>', 1) ELSE question END")


# --- classification -----------------------------------------------------------------------------------

_WORDS = "|".join  # alternation


def answer_type(a: str) -> str:
    d, months = r"\p{Nd}", cl._MONTHS
    day = rf"{d}{{1,2}} ({months})"
    dates = [rf"{day} {d}{{4}}", rf"{d}{{4}}|{day}|{d}{{1,2}}/{d}{{1,2}}/{d}{{2,4}}", rf"({months}) {d}{{1,2}}"]
    arms = [f"WHEN {' OR '.join(word(a, p) for p in dates)} THEN 'Date'",
            f"WHEN {word(a, '[a-z]{2,} [a-z]{2,}')} THEN 'Person'"]
    for label in ("Location", "Group", "Event", "Artwork", "Adjective", "Common noun"):
        arms.append(f"WHEN {word(a, cl.ANSWER_WORDS[label])} THEN {q(label)}")
    arms.append(f"WHEN {has(a, d)} THEN 'Number'")
    return f"CASE {' '.join(arms)} ELSE 'Unknown' END"


def skill_list(low: str, a_type: str) -> str:
    arms = [f"CASE WHEN {has(low, _WORDS(cues))} THEN {q(s)} END" for s, cues in cl.SKILL_CUES.items()]
    arms.append(f"CASE WHEN starts_with({strip(low)}, 'how many') OR contains({low}, ' how many ') "
                f"OR contains({low}, ' number of ') THEN 'Counting' END")
    found = f"list_filter([{', '.join(arms)}], lambda s: s IS NOT NULL)"
    return (f"CASE WHEN len({found}) > 0 THEN {found}[1:3] WHEN {a_type} = 'Number' THEN ['Counting'] "
            f"WHEN {a_type} = 'Date' THEN ['Filtering time'] ELSE ['No skill'] END")


_BOTH = rf"(^|{NW})both([^\p{{L}}\p{{N}}_\n]|[^\p{{L}}\p{{N}}_\n][^\n]*[^\p{{L}}\p{{N}}_\n])and({NW}|$)"
_YEARS = "len(list_filter(words, lambda t: regexp_full_match(t, '\\p{Nd}{4}')))"
STRUCTURE = f"""CASE
  WHEN len(wh) > 0 AND ({any_token('words', cl.NESTING_WORDS)} OR {word('low', 'who has|who have')})
       AND len(words) > 10 THEN 'Composition'
  WHEN len(wh) > 0 AND contains(low, ' with ')
  THEN CASE WHEN instr(low, ' with ') - instr(low, wh[1]) > 20 THEN 'Composition' ELSE 'Simple' END
  WHEN {has('low', _BOTH)}
       OR (list_contains(words, 'and') AND {count_tokens('words', cl.CONSTRAINT_WORDS)} >= 2)
       OR ({has('low', _WORDS(cl.MAKER_CUES))} AND {has('low', _WORDS(cl.KIND_CUES))}) THEN 'Intersection'
  ELSE 'Simple' END"""


def typed_ctes(base: str, question: str = "question", answer: str = "answer") -> str:
    """CTEs adding question_type, skills (list) and answer_type to ``base(source, ord, ...)``."""
    return f"""low AS (
  SELECT *, lower({question}) AS low, {tokens(question)} AS words FROM {base}), wh AS (
  SELECT *, list_filter(words, lambda t: t IN ({items(cl.WH_WORDS)})) AS wh, {answer_type(answer)} AS answer_type
  FROM low), shaped AS (
  SELECT *, {STRUCTURE} AS shape, {skill_list('low', 'answer_type')} AS skills FROM wh), typed AS (
  SELECT * EXCLUDE (low, words, wh, shape), CASE
    WHEN shape = 'Simple'
     AND ({_YEARS} > 0)::INT + {has('low', _WORDS(cl.SPORT_CUES))}::INT + {has('low', _WORDS(cl.MATCH_CUES))}::INT >= 2
     AND (list_contains(words, 'and') OR {_YEARS} >= 2) THEN 'Intersection' ELSE shape END AS question_type
  FROM shaped)"""


TYPED = QA + ", " + typed_ctes("qa")

PHRASES = QA + f""", tk AS (SELECT ord, {tokens('question')} AS t FROM qa), hit AS (
  SELECT ord, t, list_filter(range(1, len(t) + 1), lambda i: t[i] IN ({items(cl.QUESTION_WORDS)})) AS h FROM tk),
  anchors AS (SELECT ord, t, len(h) AS n, CASE WHEN h[1] <= 3 THEN h[1] ELSE h[-1] END AS a FROM hit),
  phrases AS (SELECT ord, CASE WHEN n = 0 THEN 'other'
    WHEN a > 1 AND t[a - 1] IN ('in', 'by') THEN array_to_string(t[a - 1:a + 2], ' ')
    ELSE array_to_string(t[a:a + 2], ' ') END AS phrase FROM anchors)"""


def cross_tab(frm: str, column: str, labels, total: str, row: str = "source") -> str:
    cells = ", ".join(f"count(*) FILTER ({column} = {q(l)})::BIGINT AS \"{l}\"" for l in labels)
    return (f"SELECT {row}, {cells} FROM {frm} GROUP BY {row} "
            f"UNION ALL SELECT {q(total)} AS {row}, {cells} FROM {frm}")


# --- scores -------------------------------------------------------------------------------------------


def ranked(name: str, first: int) -> str:
    """Best labels of the half of the dimensions that begins at ``first``; each is added to the label of its place mod 14."""
    folded = ", ".join(" + ".join(f"embedding[{d}]::DOUBLE" for d in range(first + i, first + 32, 14)) for i in range(14))
    return f"""{name} AS (
  SELECT vec_id, rk, label, round(score, 4) AS score FROM (
    SELECT vec_id, ([{items(LABELS)}])[i] AS label, score,
           row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, i) AS rk
    FROM (SELECT vec_id, unnest(range(1, 15)) AS i, unnest([{folded}]) AS score FROM embeddings)) WHERE rk <= 3)"""


RANKED = ranked("ra", 1) + ", " + ranked("rb", 33)
TOPS = RANKED + """, tops AS (SELECT a.vec_id, a.label AS topic_a, b.label AS topic_b, a.score AS score_a, b.score AS score_b
  FROM ra a JOIN rb b ON a.vec_id = b.vec_id AND a.rk = 1 AND b.rk = 1)"""
SHARED = "SELECT DISTINCT a.vec_id FROM ra a JOIN rb b ON a.vec_id = b.vec_id AND a.label = b.label"
TAU = RANKED + """, names AS (SELECT vec_id, label FROM ra UNION SELECT vec_id, label FROM rb), rks AS (
  SELECT n.vec_id, n.label, coalesce(ra.rk, 4) AS x, coalesce(rb.rk, 4) AS y FROM names n
  LEFT JOIN ra ON ra.vec_id = n.vec_id AND ra.label = n.label
  LEFT JOIN rb ON rb.vec_id = n.vec_id AND rb.label = n.label), tau AS (
  SELECT p.vec_id, sum(sign(p.x - r.x) * sign(p.y - r.y))
    / nullif(sqrt(sum(abs(sign(p.x - r.x))) * sum(abs(sign(p.y - r.y)))), 0) AS tau
  FROM rks p JOIN rks r ON p.vec_id = r.vec_id AND p.label < r.label GROUP BY p.vec_id)"""
PEARSON = "corr(score_a, score_b)"
SPEARMAN = """(SELECT corr(x, y) FROM (SELECT
    rank() OVER (ORDER BY score_a) + (count(*) OVER (PARTITION BY score_a) - 1) / 2.0 AS x,
    rank() OVER (ORDER BY score_b) + (count(*) OVER (PARTITION BY score_b) - 1) / 2.0 AS y FROM tops))"""

def similar(rows: str) -> str:
    """Similarity of each vector of ``rows`` and the next one that exists."""
    return f"""sim AS (SELECT 'label' || a.label AS source, a.vec_id AS ord,
  round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[])
    / (sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[]))
     * sqrt(list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[]))), 6) AS similarity_score
  FROM (SELECT *, coalesce(lead(vec_id) OVER (ORDER BY vec_id), min(vec_id) OVER ()) AS following FROM {rows}) a
  JOIN embeddings b ON b.vec_id = a.following)"""


SIM = similar("embeddings")
LOWEST = SIM + ", lowest AS (SELECT * FROM sim ORDER BY similarity_score, source, ord LIMIT 100)"


def box(frm: str, x: str) -> str:
    return f"""qs AS (SELECT source, quantile_cont({x}, 0.25) AS q1, quantile_cont({x}, 0.5) AS median,
    quantile_cont({x}, 0.75) AS q3 FROM {frm} GROUP BY source)
  SELECT qs.source, round(any_value(q1), 6) AS q1, round(any_value(median), 6) AS median, round(any_value(q3), 6) AS q3,
    round(least(min({x}) FILTER ({x} >= q1 - 1.5 * (q3 - q1)), any_value(q1)), 6) AS whisker_low,
    round(greatest(max({x}) FILTER ({x} <= q3 + 1.5 * (q3 - q1)), any_value(q3)), 6) AS whisker_high,
    (count(*) FILTER ({x} < q1 - 1.5 * (q3 - q1) OR {x} > q3 + 1.5 * (q3 - q1)))::BIGINT AS outliers
  FROM qs JOIN {frm} f ON f.source = qs.source GROUP BY qs.source"""


def term_cosine(texts: str, key: str) -> str:
    """Similarity over ``texts(key, l, r)``."""
    return f"""terms AS (SELECT {key}, unnest({tokens('l')}) AS term, 0 AS side FROM {texts}
    UNION ALL SELECT {key}, unnest({tokens('r')}) AS term, 1 AS side FROM {texts}),
  tf AS (SELECT {key}, term, count(*) FILTER (side = 0)::DOUBLE AS a, count(*) FILTER (side = 1)::DOUBLE AS b
    FROM terms GROUP BY {key}, term),
  cosines AS (SELECT {key}, sum(a * b) / nullif(sqrt(sum(a * a)) * sqrt(sum(b * b)), 0) AS c FROM tf GROUP BY {key})
  SELECT {', '.join('t.' + k.strip() for k in key.split(','))}, round(coalesce(c, 0), 6) AS similarity_score
  FROM (SELECT DISTINCT {key} FROM {texts}) t LEFT JOIN cosines USING ({key})"""


_V1_QUESTION = collapse(f"translate({_UNWRAPPED}, '\"?', '')")
_GROUP_PIECE = f"""trim(concat_ws(' ', {collapse('question')}, {collapse('answer')}))"""
GROUPED = TQA + f""", grouped AS (
  SELECT source, "table", 0::BIGINT AS segment, count(*) AS num_pairs, string_agg({_GROUP_PIECE}, ' ' ORDER BY ord) AS qas
  FROM tqa GROUP BY source, "table")"""
CLEAN_GROUPS = EXAMPLES + f""", kept AS (
  SELECT * FROM (SELECT source, ord, {segment('input_seg', 2, False)} AS "table", {clean(_UNWRAPPED)} AS question,
         {strip('output')} AS answer FROM examples) WHERE "table" <> '' AND question <> ''), grouped AS (
  SELECT source, "table", 0::BIGINT AS segment, count(*) AS num_pairs,
    string_agg({collapse(no_punct("question || ' ' || " + collapse('answer')))}, ' ' ORDER BY ord) AS qas
  FROM kept GROUP BY source, "table")"""

SEGMENTS = TQA + f""", pieces AS (SELECT source, "table", ord, ord // {cat.SEGMENT_BLOCK} AS blk, {_GROUP_PIECE} AS piece FROM tqa),
 blocks AS (SELECT source, "table", blk, count(*) AS n, sum(strlen(piece) + 1) AS b FROM pieces GROUP BY ALL),
 placed AS (SELECT *, sum(n) OVER g AS all_n, sum(b) OVER g AS all_b,
    coalesce(sum(b) OVER (PARTITION BY source, "table" ORDER BY blk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pre
  FROM blocks WINDOW g AS (PARTITION BY source, "table"))
 SELECT p.source, p."table", CASE WHEN all_b > {cat.SEGMENT_LIMIT} THEN (pre // {cat.SEGMENT_LIMIT})::BIGINT ELSE 0 END AS segment,
   any_value(all_n)::BIGINT AS num_pairs, string_agg(piece, ' ' ORDER BY ord) AS qas
 FROM pieces p JOIN placed s USING (source, "table", blk) GROUP BY 1, 2, 3"""

_ENTITY = (
    r"list_filter(regexp_extract_all(text, '(^|[^\p{L}\p{N}_])(\p{Lu}[\p{L}\p{N}_]*(?: \p{Lu}[\p{L}\p{N}_]*)*"
    r"|\p{Nd}[\p{L}\p{N}_]*)', 2), lambda e: length(e) > 2 "
    r"AND (regexp_full_match(e, '\p{Nd}+') OR NOT regexp_matches(e, '^\p{Nd}')))"
)


def topic_ctes() -> str:
    lex = cat.PROSE_LEXICON
    vocabulary = sorted({w for ws in lex.values() for w in ws})
    shares = ", ".join(f"{count_tokens('h', ws)} / len(h)" for ws in lex.values())
    return f"""hits AS (SELECT doc_id, source, list_filter({tokens('text')}, lambda t: t IN ({items(vocabulary)})) AS h
    FROM documents), shares AS (
  SELECT doc_id, source, CASE WHEN len(h) = 0 THEN list_transform(range(14), lambda i: 0.0::DOUBLE) ELSE [{shares}] END AS s FROM hits),
  topics AS (SELECT doc_id, source, label, round(score, 4) AS score, rk FROM (
    SELECT doc_id, source, ([{items(lex)}])[i] AS label, score,
      row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, i) AS rk
    FROM (SELECT doc_id, source, unnest(range(1, 15)) AS i, unnest(s) AS score FROM shares)) WHERE rk <= 3)"""


def top_columns(alias: str) -> str:
    return ", ".join(
        f"max({alias}.label) FILTER ({alias}.rk = {i}) AS top_{i}_topic, "
        f"max({alias}.score) FILTER ({alias}.rk = {i}) AS top_{i}_score" for i in (1, 2, 3)
    )


# --- outcomes -----------------------------------------------------------------------------------------

_K = "json_extract_string(props, '$.k')"
RESULTS = f"""bodies AS (SELECT event_type AS source, event_id AS ord, CASE
    WHEN event_id % 7 = 5 THEN '<html> gone ' || {_K} || ' </html>' || chr(10)
    WHEN event_id % 7 = 6 THEN '{{"results": {{"bindings": {{"a": 1}}}}}}'
    ELSE '{{"head": {{}}, "results": {{"bindings": [' || concat_ws(', ',
      CASE WHEN event_id % 7 <> 0 THEN '{{"obj": {{"value": "w' || user_id || '"}}}}' END,
      CASE WHEN event_id % 7 <> 0 THEN '{{"obj": {{"type": "uri", "value": "v' || {_K} || '"}}}}' END,
      CASE WHEN event_id % 7 > 2 THEN '{{"obj": {{"value": "w' || user_id || '"}}}}' END,
      '{{"subj": {{"value": "x"}}}}') || ']}}}}' END AS body,
    CASE WHEN event_type = 'error' THEN 'HTTP 400: bad query ' || {_K} END AS failure FROM events),
  lists AS (SELECT *, json_valid(body) AS ok, CASE WHEN json_valid(body) THEN
      list_filter(json_extract_string(body, '$.results.bindings[*].obj.value'), lambda x: x IS NOT NULL) END AS l,
    CASE WHEN json_valid(body) THEN json_type(body, '$.results.bindings') END AS kind FROM bodies),
  results AS (SELECT source, ord, CASE WHEN error = '' THEN CASE WHEN len(l) = 0 THEN 'empty' ELSE
      array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), ';') END END AS obj_values, error
    FROM (SELECT *, CASE WHEN failure IS NOT NULL THEN failure
        WHEN NOT ok THEN 'Invalid JSON: JSONDecodeError: ' || replace({strip('body')}, chr(10), ' ')
        WHEN kind IS NOT NULL AND kind <> 'ARRAY' THEN 'Unexpected results format' ELSE '' END AS error FROM lists))"""


def _filled(text: str) -> str:
    plain = text.replace("{{", "{").replace("}}", "}")
    return f"replace(replace({q(plain)}, '{{k}}', p_partkey::VARCHAR), '{{b}}', p_brand)"


# Rules that change each broken query, in the order of ``views.BROKEN_QUERIES``.
_B, _P, _L, _S, _T = "brackets_to_braces", "map_prefixes", "local_names", "stray_characters", "quote_times"
_C, _A, _U, _R = "contains_arguments", "alias_variables", "upper_where", "repair_clauses"
_N, _E = "keywords_and_spacing", "balance_brackets"
CHANGING_RULES = (
    (_B, _L, _U, _R, _N), (_B, _P, _U, _R, _N), (_B, _U, _R, _N), (_B, _P, _U, _R, _N), (_B, _U, _R, _N),
    (_B, _S, _C, _U, _R, _N, _E), (_B, _U, _R, _N), (_B, _U, _R, _N), (_B, _S, _T, _A, _U, _R, _N),
    (_B, _U, _R, _N), (_B, _S, _U, _R, _N, _E), (_B, _U, _R, _N), (_B, _U, _N, _E), (_R, _N), (_B, _U, _R, _N),
    (_E,),
)
ALL_RULES = (_B, _P, _L, _S, _T, _C, _A, _U, _R, _N, _E)
REPAIRED = f"""repaired AS (SELECT p_brand AS source, p_partkey AS ord,
  CASE p_partkey % {len(v.BROKEN_QUERIES)} {' '.join(f'WHEN {i} THEN {_filled(a)}' for i, (a, _) in enumerate(v.BROKEN_QUERIES))} END AS before,
  CASE p_partkey % {len(v.BROKEN_QUERIES)} {' '.join(f'WHEN {i} THEN {_filled(b)}' for i, (_, b) in enumerate(v.BROKEN_QUERIES))} END AS sparql
  FROM part)"""


def one_line(text: str) -> str:
    return rf"regexp_replace({text}, '\r\n|[\n\x0B\f\r\x{{85}}\x{{2028}}\x{{2029}}]', ' ', 'g')"


def next_cosine(rows: str) -> str:
    """Term cosine of each document of ``rows`` and the next one that exists."""
    return f"""WITH texts AS (SELECT a.doc_id, a.text AS l, b.text AS r
      FROM (SELECT *, coalesce(lead(doc_id) OVER (ORDER BY doc_id), min(doc_id) OVER ()) AS following FROM {rows}) a
      JOIN documents b ON b.doc_id = a.following), {term_cosine('texts', 'doc_id')}"""


def sliced(limit: int, size: str = "strlen(text)", result: str = "SELECT source, ord, part FROM r") -> str:
    """Greedy parts of at most ``limit`` bytes, row by row."""
    return f"""WITH RECURSIVE d AS (SELECT source, doc_id AS ord, {size} AS sz,
        row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn FROM documents),
      r AS (SELECT source, ord, rn, sz, sz AS fill, 1::BIGINT AS part FROM d WHERE rn = 1
        UNION ALL SELECT d.source, d.ord, d.rn, d.sz,
          CASE WHEN r.fill + d.sz > {limit} THEN d.sz ELSE r.fill + d.sz END,
          CASE WHEN r.fill + d.sz > {limit} THEN r.part + 1 ELSE r.part END
        FROM r JOIN d ON d.source = r.source AND d.rn = r.rn + 1)
      {result}"""


ORACLES: dict[str, str] = {
    "extract_qa": f"""WITH {EXAMPLES} SELECT * FROM (SELECT source, ord, {unquote(_UNWRAPPED)} AS question,
      {unquote(strip('output'))} AS answer FROM examples) WHERE question <> '' AND answer <> ''""",
    "extract_tqa": f"WITH {TQA} SELECT * FROM tqa",
    "clean_segment_v1": f"""WITH {EXAMPLES} SELECT ord, {segment('input_seg', 1, False)} AS cleaned,
      {segment('input_seg', 1, True)} AS cleaned_compat FROM examples""",
    "clean_segment_v2": f"""WITH {EXAMPLES} SELECT ord, {segment('input_seg', 2, False)} AS cleaned,
      {segment('input_seg', 2, True)} AS cleaned_compat FROM examples""",
    "clean_caption": rf"""WITH {EXAMPLES} SELECT ord, {_clean_caption} AS caption,
      CASE WHEN regexp_matches(input_seg, '\[TLE\]([^\n]*?)\[TAB\]')
        THEN {strip(r"regexp_extract(input_seg, '\[TLE\]([^\n]*?)\[TAB\]', 1)")} ELSE 'UNKNOWN_TABLE' END AS table_key
      FROM examples""",
    "clean_claim": f"WITH {CLAIMS} SELECT ord, {_claim} AS claim FROM claims",
    "strip_punct": f"""SELECT doc_id, {no_punct('text')} AS plain, {collapse('text')} AS collapsed,
      len({tokens('text')}) AS num_tokens FROM documents""",
    "sanitize_pages": f"SELECT page_id, {clean('html')} AS clean_html FROM pages",
    "table_prefix": f"""WITH {PARTS} SELECT ord, page_title, section_title, caption, raw_table, "table" FROM prefixed""",
    "question_prompts": f"WITH {QA} SELECT ord, 'Create SPARQL Query: ' || question AS prompt FROM qa",
    "answer_shape": f"""SELECT event_id, CASE event_id % 8
        WHEN 0 THEN 'plain ' || {_K} WHEN 1 THEN 'a' || {_K} WHEN 2 THEN 'p' || {_K} WHEN 3 THEN 'first ' || {_K}
        WHEN 4 THEN '[' || {_K} || ', [2, {{"b": ' || {_K} || ', "a": "x,y: z"}}]]' WHEN 5 THEN 'True' WHEN 6 THEN {_K}
        ELSE '{{"b": ' || {_K} || ', "a": "1:2,3"}}' END AS answer
      FROM events""",
    "complete_rows": f"""SELECT * FROM (SELECT conv_id, turn, replace(text, chr(10), '') AS text
      FROM conversations) WHERE {strip('text')} <> ''""",
    "question_phrase": f"WITH {PHRASES} SELECT ord, phrase FROM phrases",
    "phrase_hierarchy": f"""WITH {PHRASES}, w AS (SELECT string_split(phrase, ' ') AS p FROM phrases),
      g AS (SELECT p[1] AS a, p[2] AS b, p[3] AS c FROM w),
      n AS (SELECT a, b, c, count(*) AS "count", grouping(b) AS gb, grouping(c) AS gc FROM g
        GROUP BY GROUPING SETS ((a), (a, b), (a, b, c)))
      SELECT CASE WHEN gb = 1 THEN a WHEN gc = 1 THEN b ELSE c END AS label, "count",
        CASE WHEN gb = 1 THEN '' WHEN gc = 1 THEN a ELSE a || '/' || b END AS parent,
        concat_ws('/', a, b, c) AS id
      FROM n WHERE (gb = 1 OR b IS NOT NULL) AND (gc = 1 OR c IS NOT NULL)""",
    "answer_type": f"WITH {QA} SELECT ord, {answer_type('answer')} AS answer_type FROM qa",
    "question_type": f"WITH {TYPED} SELECT ord, question_type FROM typed",
    "skills": f"WITH {TYPED} SELECT ord, array_to_string(skills, ';') AS skills FROM typed",
    "typed_questions": f"""WITH {TYPED} SELECT source, ord, question, answer, question_type,
      array_to_string(skills, ';') AS skills, answer_type FROM typed""",
    "document_question_types": f"""WITH {typed_ctes('documents', 'text', 'text')} SELECT doc_id, question_type,
      array_to_string(skills, ';') AS skills, answer_type FROM typed""",
    "question_type_per_source": f"WITH {TYPED} {cross_tab('typed', 'question_type', cl.QUESTION_TYPES, 'TOTAL')}",
    "answer_type_per_source": f"WITH {TYPED} {cross_tab('typed', 'answer_type', cl.ANSWER_TYPES, 'TOTAL')}",
    "skills_per_source": f"""WITH {TYPED}, one AS (SELECT source, unnest(skills) AS skill FROM typed)
      {cross_tab('one', 'skill', cl.SKILLS, 'TOTAL')}""",
    "type_overview": f"""WITH {TYPED}, one AS (SELECT unnest(skills) AS skill FROM typed), lines AS (
      {' UNION ALL '.join(
          f"SELECT {i} AS line_no, {q(sec)} AS section, {q(lab)} AS label, (SELECT count(*) FROM {src}) AS n"
          for i, (sec, lab, src) in enumerate(
              [('Question Type', t, f'typed WHERE question_type = {q(t)}') for t in cl.QUESTION_TYPES]
              + [('Skill', s, f'one WHERE skill = {q(s)}') for s in cl.SKILLS]
              + [('Skills per question', c, f'typed WHERE len(skills) = {k}')
                 for k, c in ((1, 'One skill'), (2, 'Two skills'), (3, 'Three skills'))]))})
      SELECT line_no, section, label, n, round(n * 100.0::DOUBLE / (SELECT count(*) FROM typed), 6) AS percent FROM lines""",
    "answer_overview": f"""WITH {TYPED} SELECT t AS answer_type, count(source) AS n,
        round(count(source) * 100.0::DOUBLE / (SELECT count(*) FROM typed), 6) AS percent,
        coalesce(arg_min({strip('answer')}, source || lpad(ord::VARCHAR, 20, '0'))
                 FILTER ({strip('answer')} <> ''), '') AS example
      FROM (SELECT unnest([{items(cl.ANSWER_TYPES)}]) AS t) LEFT JOIN typed ON answer_type = t GROUP BY t""",
    "skill_histogram": f"""WITH {TYPED} SELECT len(skills)::INT AS num_skills, count(*) AS n,
      round(count(*) * 100.0::DOUBLE / (SELECT count(*) FROM typed), 6) AS percent FROM typed GROUP BY 1""",
    "group_claims": f"""WITH {CLAIMS} SELECT source, {_clean_caption} AS "table", 0::BIGINT AS segment,
        count(*) AS num_claims, {_clean_caption} || ' ' || string_agg({_claim}, ' ' ORDER BY ord) AS line
      FROM claims GROUP BY source, {_clean_caption}""",
    "group_qa": f"WITH {GROUPED} SELECT * FROM grouped",
    "group_qa_segments": f"WITH {SEGMENTS}",
    "group_qa_clean": f"WITH {CLEAN_GROUPS} SELECT * FROM grouped",
    "group_size_stats": f"""WITH {TQA}, sizes AS (SELECT source, count(*) AS n FROM tqa GROUP BY source, "table")
      SELECT coalesce(source, 'ALL') AS source, count(*) AS num_tables, sum(n)::BIGINT AS total_qas, round(avg(n), 6) AS mean,
        round(median(n)::DOUBLE, 6) AS median, round(stddev_pop(n), 6) AS stdev FROM sizes GROUP BY ROLLUP (source)""",
    "label_summary": "SELECT event_type, count(*) AS n FROM events GROUP BY event_type",
    "label_shares": """SELECT event_type, count(*) AS n,
      round(count(*) * 100.0::DOUBLE / (SELECT count(*) FROM events), 6) AS percent FROM events GROUP BY event_type""",
    "label_mean_score": "SELECT event_type, round(avg(value), 6) AS mean_score FROM events GROUP BY event_type",
    "domain_pivot": cross_tab("documents", "lang", cat.LANGS, "Total"),
    "domain_pivot_display": f"""WITH p AS ({cross_tab('documents', 'lang', cat.LANGS, 'Total')})
      SELECT source, {', '.join(
          f"CASE WHEN source = 'Total' THEN {l} || ' (' || regexp_replace(round({l} / ({' + '.join(cat.LANGS)}), 4)"
          f"::DECIMAL(6,4)::VARCHAR, '(\\.\\d+?)0+$', '\\1') || ')' ELSE {l}::VARCHAR END AS {l}" for l in cat.LANGS)}
      FROM p""",
    "document_topics": f"""WITH {topic_ctes()} SELECT doc_id, source, {top_columns('t')} FROM topics t GROUP BY doc_id, source""",
    "topic_pivot": f"""WITH {topic_ctes()}, best AS (SELECT source, label FROM topics WHERE rk = 1)
      {cross_tab('best', 'label', LABELS, 'Total')}""",
    "top3_labels": f"WITH {RANKED} SELECT vec_id, {top_columns('ra')} FROM ra GROUP BY vec_id",
    "topic_agreement": f"WITH {TOPS} SELECT round(avg((topic_a = topic_b)::INT), 6) AS agreement FROM tops",
    "topic_overlap": f"""WITH {RANKED} SELECT round((SELECT count(*) FROM ({SHARED}))
      / (SELECT count(DISTINCT vec_id) FROM ra), 6) AS overlap""",
    "score_pearson": f"WITH {TOPS} SELECT round({PEARSON}, 6) AS pearson FROM tops",
    "score_spearman": f"WITH {TOPS} SELECT round({SPEARMAN}, 6) AS spearman",
    "kendall_rows": f"WITH {TAU} SELECT vec_id, round(tau, 6) AS tau FROM tau",
    "kendall_mean": f"WITH {TAU} SELECT round(avg(tau), 6) AS kendall FROM tau",
    "comparison_report": f"""WITH {TAU}, tops AS (SELECT a.label AS topic_a, b.label AS topic_b, a.score AS score_a,
        b.score AS score_b FROM ra a JOIN rb b ON a.vec_id = b.vec_id AND a.rk = 1 AND b.rk = 1)
      SELECT 1 AS line_no, 'Top 1 Topic Agreement Rate' AS metric, round(avg((topic_a = topic_b)::INT), 4) AS value FROM tops
      UNION ALL SELECT 2, 'Top 3 Topic Overlap Rate', round((SELECT count(*) FROM ({SHARED})) / (SELECT count(*) FROM tops), 4)
      UNION ALL SELECT 3, 'Pearson Correlation of Top 1 Scores', round({PEARSON}, 4) FROM tops
      UNION ALL SELECT 4, 'Spearman Correlation of Top 1 Scores', round({SPEARMAN}, 4)
      UNION ALL SELECT 5, 'Average Kendall’s Tau', round(avg(tau), 4) FROM tau""",
    "disagreements": f"""WITH {RANKED} SELECT a.vec_id, max(a.label) FILTER (a.rk = 1) AS topic_a,
        max(b.label) FILTER (a.rk = 1) AS topic_b,
        {', '.join(f'round(max(a.score - b.score) FILTER (a.rk = {i}), 6) AS score_diff_{i}' for i in (1, 2, 3))}
      FROM ra a JOIN rb b ON a.vec_id = b.vec_id AND a.rk = b.rk GROUP BY a.vec_id
      HAVING max(a.label) FILTER (a.rk = 1) <> max(b.label) FILTER (a.rk = 1)""",
    "disagreeing_vectors": f"""WITH {TOPS} SELECT vec_id, label FROM embeddings
      WHERE vec_id IN (SELECT vec_id FROM tops WHERE topic_a <> topic_b)""",
    "topic_counts": f"""WITH {RANKED} SELECT 'a' AS predictor, rk::INT AS rank, label AS topic, count(*) AS n FROM ra GROUP BY ALL
      UNION ALL SELECT 'b', rk::INT, label, count(*) FROM rb GROUP BY ALL""",
    "relatedness_vectors": f"WITH {SIM} SELECT * FROM sim",
    "relatedness_text": next_cosine("documents"),
    "relatedness_text_english": next_cosine("(SELECT * FROM documents WHERE lang = 'en')"),
    "relatedness_vectors_labels": f"WITH {similar('(SELECT * FROM embeddings WHERE label IN (1, 4, 6))')} SELECT * FROM sim",
    "relatedness_questions": f"""WITH {EXAMPLES}, texts AS (SELECT * FROM (SELECT source, ord,
        {no_punct(segment('input_seg', 1, False))} AS l, {no_punct(_V1_QUESTION)} AS r, {_V1_QUESTION} AS question
      FROM examples) WHERE question <> ''), {term_cosine('texts', 'source, ord')}""",
    "relatedness_groups": f"""WITH {CLEAN_GROUPS}, texts AS (SELECT source, "table", {no_punct('"table"')} AS l, qas AS r
      FROM grouped), {term_cosine('texts', 'source, "table"')}""",
    "similarity_summary": f"""WITH {SIM} SELECT coalesce(source, 'ALL_FILES') AS source,
        round(avg(similarity_score), 6) AS mean, round(median(similarity_score), 6) AS median,
        round(stddev_samp(similarity_score), 6) AS std, round(min(similarity_score), 6) AS min,
        round(max(similarity_score), 6) AS max, count(*) AS "count" FROM sim GROUP BY ROLLUP (source)""",
    "box_stats": f"WITH {SIM}, {box('sim', 'similarity_score')}",
    "event_value_box": f"WITH ev AS (SELECT event_type AS source, value FROM events), {box('ev', 'value')}",
    "similarity_series": f"""WITH {SIM} SELECT source, row_number() OVER (PARTITION BY source ORDER BY ord) - 1 AS idx,
      similarity_score FROM sim""",
    "lowest_100": f"WITH {LOWEST} SELECT * FROM lowest",
    "lowest_shares": f"""WITH {LOWEST} SELECT source, count(*) AS n,
      round(count(*) * 100.0::DOUBLE / (SELECT count(*) FROM lowest), 6) AS percent FROM lowest GROUP BY source""",
    "sample_50": """SELECT doc_id, lang, n_chars FROM (SELECT *, count(*) OVER (PARTITION BY lang) AS c,
        row_number() OVER (PARTITION BY lang ORDER BY md5('42:' || doc_id), doc_id) AS rn FROM documents)
      WHERE c >= 50 AND rn <= 50""",
    "quota_sample": """SELECT doc_id, source, rn > quota AS topped_up FROM (
        SELECT doc_id, source, CASE WHEN source IN ('src0', 'src1') THEN 15 ELSE 14 END AS quota,
          row_number() OVER (PARTITION BY source ORDER BY md5('42:' || doc_id), doc_id) AS rn FROM documents)
      ORDER BY rn > quota, source, rn LIMIT 300""",
    "quota_top_up": """SELECT doc_id, source, rn > quota AS topped_up FROM (
        SELECT doc_id, lang AS source, CASE WHEN lang = 'en' THEN 15 ELSE 14 END AS quota,
          row_number() OVER (PARTITION BY lang ORDER BY md5('42:' || doc_id), doc_id) AS rn FROM documents)
      ORDER BY rn > quota, source, rn LIMIT 100""",
    "slice_by_size": sliced(cat.SLICE_LIMIT),
    "slice_tight": sliced(cat.TIGHT_LIMIT),
    "slice_totals": """SELECT coalesce(source, 'ALL') AS source, count(*) AS num_rows,
        sum(strlen(json_object('ord', doc_id, 'lang', lang, 'text', text)::VARCHAR) + 5)::BIGINT AS num_bytes
      FROM documents GROUP BY ROLLUP (source)""",
    "plugged_topics": f"""WITH shares AS (SELECT doc_id, unnest(range(1, 15)) AS i, unnest([{', '.join(
          f"(length(t) - length(replace(t, '{c}', '')))::DOUBLE / greatest(length(t), 1)" for c in 'abcdefghijklmn')}]) AS score
        FROM (SELECT doc_id, lower(text) AS t FROM documents)),
      r AS (SELECT doc_id, ([{items(LABELS)}])[i] AS label, round(score, 4) AS score,
        row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, i) AS rk FROM shares)
      SELECT doc_id, {top_columns('r')} FROM r GROUP BY doc_id""",
    "relatedness_embedded": f"""WITH {QA}, e AS (SELECT source, ord, {', '.join(
          "[" + ', '.join(f"(length({x}) - length(replace({x}, '{c}', '')))::DOUBLE" for c in 'abcdefghijklmnopqrstuvwxyz')
          + f"] AS {n}" for x, n in (('question', 'a'), ('answer', 'b')))} FROM qa)
      SELECT source, ord, round(list_dot_product(a, b) / nullif(sqrt(list_dot_product(a, a)) * sqrt(list_dot_product(b, b)), 0), 6)
        AS similarity_score FROM e""",
    "similarity_sorted": f"WITH {SIM} SELECT * FROM sim",
    "document_entities": f"""SELECT doc_id, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), ', ') AS entities
      FROM (SELECT doc_id, {_ENTITY} AS l FROM documents)""",
    "entity_topics": f"""WITH RECURSIVE de AS (SELECT doc_id, list_filter(l, lambda x, i: list_position(l, x) = i) AS es FROM (
        SELECT doc_id, {_ENTITY} AS l FROM documents)),
      be AS (SELECT item_id, unnest({_ENTITY}) AS entity FROM benchmark),
      titles AS (SELECT entity, 'item ' || min(item_id) AS title FROM be GROUP BY entity),
      hits AS (SELECT doc_id, title, min(pos) AS pos FROM (
        SELECT doc_id, unnest(es) AS entity, unnest(range(len(es))) AS pos FROM de) JOIN titles USING (entity) GROUP BY ALL),
      pages AS (SELECT doc_id, string_agg(title, ', ' ORDER BY pos) AS titles, arg_min(title, pos) AS page FROM hits GROUP BY doc_id),
      {ranked('ra', 1)}, tp AS (SELECT 'item ' || vec_id AS page, {top_columns('ra')} FROM ra GROUP BY vec_id)
      SELECT doc_id, len(es) AS num_entities, titles, page, top_1_topic, top_1_score, top_2_topic, top_2_score,
        top_3_topic, top_3_score FROM de LEFT JOIN pages USING (doc_id) LEFT JOIN tp USING (page)""",
    "normalize_results": f"WITH {RESULTS} SELECT source, ord, obj_values, error FROM results",
    "outcome_summary": f"""WITH {RESULTS}, st AS (SELECT CASE WHEN obj_values IS NULL THEN 'error_nan'
        WHEN obj_values = 'empty' THEN 'empty' ELSE 'non_empty' END AS status FROM results)
      SELECT coalesce(status, 'TOTAL') AS status, count(*) AS n,
        round(count(*) * 100.0::DOUBLE / (SELECT count(*) FROM st), 6) AS percent FROM st GROUP BY ROLLUP (status)""",
    "distinct_errors": f"WITH {RESULTS} SELECT DISTINCT error FROM results WHERE error <> ''",
    "repair_queries": f"WITH {REPAIRED} SELECT source, ord, sparql FROM repaired",
    "repair_audit": f"""WITH hits AS (SELECT p_brand AS source, CASE p_partkey % {len(v.BROKEN_QUERIES)}
        {' '.join(f"WHEN {i} THEN [{items(r)}]" for i, r in enumerate(CHANGING_RULES))} END AS rules,
        p_partkey % {len(v.BROKEN_QUERIES)} = 13 AS same FROM part)
      SELECT source, count(*) AS num_rows, rule, CASE WHEN rule = 'any' THEN count(*) FILTER (NOT same)
        ELSE count(*) FILTER (list_contains(rules, rule)) END AS changed
      FROM hits, (SELECT unnest([{items(ALL_RULES)}, 'any']) AS rule) GROUP BY source, rule""",
    "changed_rows": f"""WITH {REPAIRED} SELECT source, count(*) AS num_rows, count(*) FILTER (before <> sparql) AS changed
      FROM repaired GROUP BY source""",
    "dataset_names": r"""SELECT p_partkey, regexp_replace(regexp_replace(p_name || (['-type.csv', '.grouped.json', '.txt', '.gtqa', '.jsonl', ''])[p_partkey % 6 + 1],
      '\.(?:csv|json|jsonl|txt)$', ''), '(?:-type|\.grouped|\.gtqa)$', '') AS dataset FROM part""",
    "parsed_examples": f"""WITH {EXAMPLES} SELECT source, ord, input_seg, question, {strip('output')} AS answer FROM examples WHERE ord % 17 <> 3""",
    "aligned_rows": """SELECT p_partkey AS id, p_name AS name, p_size::BIGINT AS size, 'none' AS note, NULL::VARCHAR AS topic FROM part""",
    "unquoted_csv_lines": r"""SELECT source, doc_id || ',' || lang || ',' || regexp_replace(text, '([\\,\r\n])', '\\\1', 'g') AS value FROM documents""",
    "group_lines": f"""WITH {CLAIMS} SELECT source, 0::BIGINT AS segment, regexp_replace({_clean_caption} || ' ' || string_agg({_claim}, ' ' ORDER BY ord),
        '\\r\\n|[\\n\\x0b\\x0c\\r\\x{{85}}\\x{{2028}}\\x{{2029}}]', ' ', 'g') AS value
      FROM claims GROUP BY source, {_clean_caption}""",
    "metric_report": f"""WITH {TAU}, tops AS (SELECT a.label AS topic_a, b.label AS topic_b, a.score AS score_a,
        b.score AS score_b FROM ra a JOIN rb b ON a.vec_id = b.vec_id AND a.rk = 1 AND b.rk = 1), m(line_no, metric, value) AS (
      SELECT 1, 'Top 1 Topic Agreement Rate', avg((topic_a = topic_b)::INT) FROM tops
      UNION ALL SELECT 2, 'Top 3 Topic Overlap Rate', (SELECT count(*) FROM ({SHARED})) / (SELECT count(DISTINCT vec_id) FROM ra)
      UNION ALL SELECT 3, 'Pearson Correlation of Top 1 Scores', {PEARSON} FROM tops
      UNION ALL SELECT 4, 'Spearman Correlation of Top 1 Scores', {SPEARMAN}
      UNION ALL SELECT 5, 'Average Kendall’s Tau', avg(tau) FROM tau)
      SELECT line_no, '- ' || metric || ': ' || coalesce(printf('%.4f', value::DOUBLE), 'nan') AS line FROM m""",
    "share_report": """SELECT printf('%-30s%-10d%.2f%%', event_type, count(*), count(*) * 100.0::DOUBLE / (SELECT count(*) FROM events)) AS line
      FROM events GROUP BY event_type""",
    "outcome_report": f"""WITH {RESULTS}, st AS (SELECT count(*) AS n, count(*) FILTER (obj_values <> 'empty') AS a,
        count(*) FILTER (obj_values = 'empty') AS b, count(*) FILTER (obj_values IS NULL) AS c FROM results),
      e AS (SELECT error, row_number() OVER (ORDER BY error) AS k FROM (SELECT DISTINCT error FROM results WHERE error <> ''))
      SELECT 0 AS section, 0::BIGINT AS number, '# Query Summary' AS line
      UNION ALL SELECT 1, 0, '**Total rows processed:** ' || n FROM st
      UNION ALL SELECT 2, 0, printf('- **Non-empty results:** %d (%.2f%%)', a, a * 100.0::DOUBLE / n) FROM st
      UNION ALL SELECT 2, 1, printf('- **Empty results:** %d (%.2f%%)', b, b * 100.0::DOUBLE / n) FROM st
      UNION ALL SELECT 2, 2, printf('- **Errors (NaN):** %d (%.2f%%)', c, c * 100.0::DOUBLE / n) FROM st
      UNION ALL SELECT 3, i, line FROM (VALUES (0, '## Distinct Error Types'), (1, '| # | Error Message |'), (2, '|---|---------------|')) t(i, line)
      WHERE EXISTS (SELECT * FROM e)
      UNION ALL SELECT 4, k, '| ' || k || ' | ' || replace(CASE WHEN length(error) > 180 THEN left(error, 180) || '…' ELSE error END, '|', '\\|') || ' |' FROM e""",
    "relatedness_group_rows": f"""WITH {CLEAN_GROUPS}, texts AS (SELECT source, "table", {no_punct('"table"')} AS l, qas AS r
      FROM grouped), scored AS (WITH {term_cosine('texts', 'source, "table"')}) SELECT g.*, similarity_score FROM grouped g JOIN scored USING (source, "table")""",
    "relatedness_group_summary": f"""WITH {CLEAN_GROUPS}, texts AS (SELECT source, "table", {no_punct('"table"')} AS l, qas AS r
      FROM grouped), sim AS (WITH {term_cosine('texts', 'source, "table"')}) SELECT coalesce(source, 'ALL_FILES') AS source,
        round(avg(similarity_score), 6) AS mean, round(median(similarity_score), 6) AS median,
        round(stddev_samp(similarity_score), 6) AS std, round(min(similarity_score), 6) AS min,
        round(max(similarity_score), 6) AS max, count(*) AS "count" FROM sim GROUP BY ROLLUP (source)""",
    "relatedness_group_lowest": f"""WITH {CLEAN_GROUPS}, texts AS (SELECT source, "table", {no_punct('"table"')} AS l, qas AS r
      FROM grouped), sim AS (WITH {term_cosine('texts', 'source, "table"')}) SELECT source, "table", num_pairs, similarity_score
      FROM grouped JOIN sim USING (source, "table") ORDER BY similarity_score, source, "table" LIMIT 100""",
    "alignment_audit": """SELECT vec_id, 1::BIGINT AS n_a, CASE label WHEN 3 THEN 0 WHEN 5 THEN 2 END::BIGINT AS n_b,
        CASE label WHEN 3 THEN 'only in a' WHEN 5 THEN 'repeated' END AS problem FROM embeddings WHERE label IN (3, 5)""",
    "array_examples": f"""WITH {EXAMPLES} SELECT source, row_number() OVER (PARTITION BY source ORDER BY ord) - 1 AS ord,
        input_seg, question, output FROM examples""",
    "slice_files": sliced(
        cat.SLICE_LIMIT, """(1 + strlen(CASE WHEN text IS NULL THEN to_json({'ord': doc_id}) ELSE to_json({'ord': doc_id, 'text': text}) END))::BIGINT""",
        "SELECT source, part, 1::BIGINT AS files, sum(sz)::BIGINT AS bytes FROM r GROUP BY source, part"),
    "text_lines": f"""WITH {EXAMPLES}, flat AS (SELECT {strip(one_line('question'))} AS value FROM examples)
      SELECT value, count(*) AS n FROM flat WHERE value <> '' GROUP BY value""",
    "table_rows": f"WITH {QA} SELECT ord, question, answer FROM qa",
    "fitted_topics": f"""WITH words AS (SELECT doc_id, lang, unnest({tokens('text')}) AS term FROM documents),
      labels AS (SELECT * FROM (VALUES {', '.join(f"('{name}', {i})" for i, name in enumerate(cat.LANGS))}) l(lang, i)),
      inside AS (SELECT term, lang, count(*)::DOUBLE AS n FROM words WHERE lang IN (SELECT lang FROM labels) GROUP BY ALL),
      terms AS (SELECT term, sum(n) AS n FROM inside GROUP BY term),
      sizes AS (SELECT lang, i, coalesce(sum(n), 0) AS n FROM labels LEFT JOIN inside USING (lang) GROUP BY ALL),
      whole AS (SELECT count(*)::DOUBLE AS v, sum(n) AS n FROM terms),
      weights AS (SELECT term, s.lang, i, ln((coalesce(c.n, 0) + 1) / (s.n + v)) - ln((t.n - coalesce(c.n, 0) + 1) / (whole.n - s.n + v)) AS w
        FROM terms t CROSS JOIN sizes s CROSS JOIN whole LEFT JOIN inside c USING (term, lang)),
      means AS (SELECT doc_id, weights.lang, i, avg(w) AS m FROM words JOIN weights USING (term) GROUP BY ALL),
      scored AS (SELECT d.doc_id, l.lang AS label, l.i, 1 / (1 + exp(-coalesce(m, 0))) AS score
        FROM documents d CROSS JOIN labels l LEFT JOIN means ON means.doc_id = d.doc_id AND means.i = l.i),
      r AS (SELECT doc_id, label, round(score, 6) AS score, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, i) AS rk FROM scored)
      SELECT doc_id, {', '.join(f"max(label) FILTER (rk = {k}) AS top_{k}_topic, max(score) FILTER (rk = {k}) AS top_{k}_score" for k in range(1, len(cat.LANGS) + 1))}
      FROM r GROUP BY doc_id""",
    "title_entities": rf"""WITH RECURSIVE titles AS (SELECT DISTINCT unnest({_ENTITY}) AS title FROM benchmark),
      cut AS (SELECT doc_id, text, title, string_split(text, title) AS p FROM documents JOIN titles ON contains(text, title)),
      places AS (SELECT doc_id, text, title, (list_sum(list_transform(p[1:i], lambda x: length(x))) + (i - 1) * length(title))::BIGINT AS start
        FROM (SELECT *, unnest(range(1, len(p))) AS i FROM cut)),
      framed AS (SELECT doc_id, title, start, start + length(title) AS stop FROM places
        WHERE NOT (start > 0 AND regexp_matches(substring(text, start, 1), '[\p{{L}}\p{{N}}_]'))
          AND NOT regexp_matches(substring(text, start + length(title) + 1, 1), '[\p{{L}}\p{{N}}_]')),
      chosen AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY start, stop DESC) AS rk FROM framed) WHERE rk = 1
        UNION ALL SELECT doc_id, title, start, stop, rk FROM (SELECT f.*, row_number() OVER (PARTITION BY f.doc_id ORDER BY f.start, f.stop DESC) AS rk
          FROM chosen c JOIN framed f ON f.doc_id = c.doc_id AND f.start >= c.stop) WHERE rk = 1)
      SELECT doc_id, count(title) AS num_entities, coalesce(string_agg(title, ', ' ORDER BY start), '') AS entities
      FROM documents LEFT JOIN chosen USING (doc_id) GROUP BY doc_id""",
}
