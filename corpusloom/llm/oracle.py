"""DuckDB SQL for the queries of this package that SQL can express."""

from __future__ import annotations

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _escaped(text: str) -> str:
    return rf"replace(replace(replace({text}, '\', '\\'), '##', '#\#'), '</turn>', '<\/turn>')"


def _words(text: str) -> str:
    return rf"regexp_extract_all(translate(coalesce({text}, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


ORACLES = {
    "op1_chat_format": rf"""WITH turns AS (
        SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
        UNION ALL SELECT -7, t, r, '\### Assistant: </turn> ok' FROM (VALUES (0, 'user'), (1, 'assistant')) v(t, r)),
      joined AS (SELECT conv_id, count(*) AS n_turns,
          string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS whole,
          coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS loss,
          sum(length(replace({_escaped('role')}, ':', '\:')) + length({_escaped('text')}) + 14)::BIGINT AS formatted_chars
        FROM turns GROUP BY conv_id)
      SELECT conv_id, n_turns, sha256(whole) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM joined""",
    "op4_decontamination": f"""WITH items AS (SELECT item_id, {_words('text')} AS w FROM benchmark),
      cut AS (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS pos FROM items WHERE len(w) > 0),
      windows AS (SELECT DISTINCT item_id, len(w[pos:pos + 9]) AS width, array_to_string(w[pos:pos + 9], ' ') AS win FROM cut),
      docs AS (SELECT doc_id, {_words('text')} AS w FROM documents),
      places AS (SELECT doc_id, w, s.width, unnest(range(1, len(w) - s.width + 2)) AS pos FROM docs, (SELECT DISTINCT width FROM windows) s),
      hits AS (SELECT p.doc_id, p.pos, p.width, c.item_id FROM (SELECT doc_id, pos, width, array_to_string(w[pos:pos + width - 1], ' ') AS win FROM places) p
        JOIN windows c USING (width, win)),
      hit_words AS (SELECT doc_id, count(DISTINCT word) AS n FROM (SELECT doc_id, unnest(range(pos, pos + width)) AS word FROM hits) GROUP BY doc_id),
      hit_items AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS listed
        FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits WHERE item_id IS NOT NULL) GROUP BY doc_id)
      SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(h.n, 0)::BIGINT AS n_hit, coalesce(i.n, 0)::BIGINT AS n_items,
        sha256(coalesce(i.listed, '')) AS items_sha256, coalesce(h.n, 0) > 0 AS contaminated
      FROM docs d LEFT JOIN hit_words h USING (doc_id) LEFT JOIN hit_items i USING (doc_id)""",
    "op11_hard_negatives": """WITH e AS (
        SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
          list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
        FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
          AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
      scored AS (SELECT a.vec_id AS anchor_id, e.vec_id, a.label = e.label AS same, list_inner_product(a.v, e.v)::BIGINT AS score
        FROM e a JOIN e ON e.vec_id <> a.vec_id WHERE a.vec_id % 100 = 0),
      positives AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
        QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
      SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INTEGER AS rank,
        vec_id AS negative_id, positive_score, score AS negative_score
      FROM positives JOIN scored USING (anchor_id)
      WHERE NOT same AND 100 * score BETWEEN 30 * positive_score AND 90 * positive_score
      QUALIFY rank <= 10""",
    "op12_lexical_search": f"""WITH occurrences AS (SELECT doc_id, unnest({_words('text')}) AS term FROM documents),
      tf AS (SELECT doc_id, term, count(*) AS tf FROM occurrences GROUP BY ALL),
      lengths AS (SELECT doc_id, count(*) AS n FROM occurrences GROUP BY doc_id),
      totals AS (SELECT count(*) AS docs, sum(n)::BIGINT AS tokens FROM lengths),
      df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
      wanted AS (SELECT DISTINCT item_id, unnest({_words('text')}) AS term FROM benchmark),
      weights AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w FROM df, totals),
      scored AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * docs) // tokens))))::BIGINT AS score
        FROM wanted JOIN weights USING (term) JOIN tf USING (term) JOIN lengths USING (doc_id), totals GROUP BY item_id, doc_id)
      SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score
      FROM scored WHERE score > 0 QUALIFY rank <= 50""",
}
