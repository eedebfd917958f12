"""The same results as plain SQL for another engine, where SQL can express them."""

from .licenses import NOTICES, PHRASES

LINE_DEDUP = r"""
WITH lines AS (
  SELECT doc_id, text, unnest(range(0, len(string_split(text, chr(10))))) AS i, string_split(text, chr(10)) AS l
  FROM documents WHERE text IS NOT NULL
), items AS (
  SELECT doc_id, text, i, l[i + 1] AS x, len(l) AS n, row_number() OVER w AS p,
         lead(i) OVER w AS next1, lead(i, 2) OVER w AS next2, lead(l[i + 1]) OVER w AS y
  FROM lines WHERE translate(l[i + 1], ' ' || chr(9) || chr(13), '') <> ''
  WINDOW w AS (PARTITION BY doc_id, text ORDER BY i)
), runs AS (
  SELECT *, row_number() OVER (PARTITION BY x, y ORDER BY doc_id, text, i) AS place FROM items WHERE next1 IS NOT NULL
), gone AS (
  SELECT DISTINCT doc_id, text, unnest(range(i, coalesce(next2, n))) AS i FROM runs WHERE place > 1
), kept AS (
  SELECT l.doc_id, l.text, count(*) AS n_lines, count(g.i) AS n_removed,
         coalesce(string_agg(l.l[l.i + 1], chr(10) ORDER BY l.i) FILTER (g.i IS NULL), '') AS t
  FROM lines l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.text = g.text AND l.i = g.i GROUP BY l.doc_id, l.text
)
SELECT doc_id, n_lines, n_removed, sha256(t) AS kept_sha256 FROM kept
UNION ALL SELECT doc_id, 0, 0, NULL FROM documents WHERE text IS NULL
"""

_WORDS = (r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
          r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')")

DECONTAMINATE = rf"""
WITH b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
grams AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS s, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS g
  FROM (SELECT *, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)
), d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
spans AS (SELECT DISTINCT s FROM grams),
windows AS (
  SELECT doc_id, s, i, array_to_string(w[i:i + s - 1], ' ') AS g
  FROM (SELECT doc_id, w, s, unnest(range(1, len(w) - s + 2)) AS i FROM d, spans)
), hits AS (SELECT doc_id, i, windows.s, item_id FROM windows JOIN grams USING (s, g)),
hit_words AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + s)) AS p FROM hits) GROUP BY 1),
items AS (
  SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS list
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits WHERE item_id IS NOT NULL) GROUP BY 1
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(h.n, 0) AS n_hit, coalesce(items.n, 0) AS n_items,
       sha256(coalesce(items.list, '')) AS items_sha256, coalesce(h.n, 0) > 0 AS contaminated
FROM d LEFT JOIN hit_words h ON d.doc_id = h.doc_id LEFT JOIN items ON d.doc_id = items.doc_id
"""

_ESCAPED = (r"regexp_replace(regexp_replace(replace({x}, '\', '\\'), '<(\||/?s>|<?/?SYS>>|/?s\b)', '\\l\1', 'g'), "
            r"'\[(/?INST\])', '\\b\1', 'g')")

CHAT = rf"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, t, CASE t WHEN 0 THEN 'user' ELSE 'assistant' END, '</s>[INST] ok [/INST]' FROM range(2) x(t)
), sorted AS (
  SELECT *, lag(role) OVER w AS former, row_number() OVER w AS k FROM rows
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(11 + sum(length({_ESCAPED.format(x='text')}) + CASE
         WHEN former = role THEN 10 ELSE length(replace({_ESCAPED.format(x='role')}, chr(10), '\n')) + 13
              + CASE WHEN former IS NULL THEN 0 ELSE 11 END END) AS BIGINT) AS formatted_chars
FROM sorted GROUP BY conv_id
"""

LEXICAL = rf"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, {_WORDS} AS w FROM documents),
facts AS (SELECT count(*) AS docs, CAST(sum(len(w)) AS BIGINT) AS words FROM d WHERE len(w) > 0),
q AS (SELECT row_number() OVER () AS item, item_id, list_distinct({_WORDS}) AS w FROM benchmark),
terms AS (SELECT item, item_id, unnest(w) AS term FROM q),
tf AS (
  SELECT row, doc_id, n, term, count(*) AS tf FROM (SELECT row, doc_id, len(w) AS n, unnest(w) AS term FROM d)
  WHERE term IN (SELECT term FROM terms) GROUP BY ALL
), weights AS (
  SELECT term, CAST(floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS weight FROM tf, facts GROUP BY term
), scores AS (
  SELECT item, item_id, row, doc_id,
         CAST(sum(weight * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // words)))) AS BIGINT) AS score
  FROM terms JOIN tf USING (term) JOIN weights USING (term), facts GROUP BY ALL
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM scores WHERE score > 0
)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= 10
"""

_TEMPLATES = ", ".join(f"({k}, {base}, '{label}', '{text}')" for k, (base, label, text) in enumerate(
    [("true", *p) for p in PHRASES] + [("false", *n) for n in NOTICES]))

LICENSES = rf"""
WITH t(template, base, label, text) AS (VALUES {_TEMPLATES}),
tw AS (SELECT *, string_split(text, ' ') AS x, len(string_split(text, ' ')) - 2 AS runs FROM t),
g AS (
  SELECT template, base, label, runs, pos, array_to_string(x[pos + 1:pos + 3], ' ') AS gram
  FROM (SELECT *, unnest(range(0, runs)) AS pos FROM tw)
), d AS (SELECT row_number() OVER () AS row, doc_id, {_WORDS} AS w FROM documents),
starts AS (SELECT row, i, array_to_string(w[i + 1:i + 3], ' ') AS gram FROM (SELECT row, w, unnest(range(0, len(w) - 2)) AS i FROM d)),
votes AS (SELECT row, template, base, label, runs, i - pos AS diagonal, pos, i FROM starts JOIN g USING (gram)),
diagonals AS (
  SELECT row, template, base, diagonal FROM votes GROUP BY row, template, base, runs, diagonal
  HAVING CASE WHEN base THEN count(*) = runs ELSE count(*) >= least(2, runs) END
), apart AS (
  SELECT *, CASE WHEN diagonal - lag(diagonal) OVER (PARTITION BY row, template ORDER BY diagonal) > CASE WHEN base THEN 0 ELSE 12 END
            THEN 1 ELSE 0 END AS apart FROM diagonals
), places AS (SELECT *, sum(apart) OVER (PARTITION BY row, template ORDER BY diagonal) AS place FROM apart),
spans AS (
  SELECT row, template, base, label, runs, place, count(DISTINCT pos) / runs AS share, min(i) AS first, max(i) + 3 AS past
  FROM votes JOIN places USING (row, template, base, diagonal) GROUP BY row, template, base, label, runs, place
), kept AS (SELECT * FROM spans WHERE base OR (share >= 0.7 AND past - first <= 2 * (runs + 2)))
SELECT any_value(doc_id) AS doc_id, CAST(any_value(len(w)) AS BIGINT) AS n_words, count(first) FILTER (base) AS n_base,
       min(first) FILTER (base) AS first_word, max(first) FILTER (base) AS last_word,
       coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base), '') AS base_labels,
       coalesce(string_agg(DISTINCT label, ',' ORDER BY label), '') AS labels, coalesce(max(share), 0.0)::DOUBLE AS score
FROM d LEFT JOIN kept USING (row) GROUP BY row
"""

COLLOCATIONS = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), words AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
totals AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM words GROUP BY lang),
grams AS (
  SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*) AS f
  FROM (SELECT lang, k, w, unnest(range(1, len(w) - k + 2)) AS i FROM words, range(1, 6) sizes(k)) GROUP BY ALL
), candidates AS (SELECT *, string_split(phrase, ' ') AS w FROM grams WHERE k > 1 AND f >= 100),
cuts AS (
  SELECT lang, phrase, f, c, array_to_string(w[1:c], ' ') AS head, array_to_string(w[c + 1:], ' ') AS rest
  FROM (SELECT *, unnest(range(1, k)) AS c FROM candidates)
), scored AS (
  SELECT cuts.lang, cuts.phrase, cuts.f AS a, x.f AS l, y.f AS r, n,
         CAST((1000::HUGEINT * cuts.f * n) // (x.f::HUGEINT * y.f) AS BIGINT) AS score, c
  FROM cuts JOIN grams x ON x.lang = cuts.lang AND x.phrase = head JOIN grams y ON y.lang = cuts.lang AND y.phrase = rest
  JOIN totals ON totals.lang = cuts.lang
), low AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1),
kept AS (
  SELECT * FROM low WHERE NOT EXISTS (
    SELECT 1 FROM candidates b WHERE b.lang = low.lang AND b.k > len(string_split(low.phrase, ' ')) AND 100 * b.f >= 100 * low.a
    AND contains(' ' || b.phrase || ' ', ' ' || low.phrase || ' '))
), ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, CAST(rank AS INTEGER) AS rank, phrase, a, l, r, n, score FROM ranked WHERE rank <= 2000
"""

ORACLES = {"op11_dual_tree": LEXICAL, "op12_licenses": LICENSES, "op13_phrases": COLLOCATIONS, "op2_line_dedup": LINE_DEDUP, "op5_decontaminate": DECONTAMINATE, "op9_chat": CHAT}
