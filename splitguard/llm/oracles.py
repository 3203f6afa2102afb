"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from splitguard.llm.licences import LIST_MARK, NOT_WORD, RULES, SENTENCES, VERSION, WORD, normal_words, own_number

BLANK = r"[\x20\x09-\x0D]"

op3 = """
WITH p AS (
  SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS n, sha1(coalesce(html, '')) AS d FROM pages
), g AS (SELECT d, max(page_id) AS top FROM p WHERE n >= 1000 GROUP BY d)
SELECT page_id, n AS payload_bytes, d AS payload_digest,
  CASE WHEN top IS NULL OR top = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN top <> page_id THEN top END AS refers_to
FROM p LEFT JOIN g USING (d)
"""

op4 = rf"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos
  FROM documents
), k AS (
  SELECT doc_id, pos, line,
    translate(regexp_replace(regexp_replace(line, '^{BLANK}+', ''), '{BLANK}+$', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM l
), f AS (SELECT key, min(doc_id) AS first_doc FROM k WHERE length(key) >= 10 GROUP BY key),
m AS (SELECT k.*, coalesce(first_doc <> doc_id, false) AS gone FROM k LEFT JOIN f USING (key))
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (gone) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""

op9 = rf"""
WITH n AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '{BLANK}+', ' ', 'g')) AS text_sha256,
             regexp_replace(coalesce(text, ''), '{BLANK}+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
  doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, text_sha256 FROM n
"""



def _licences() -> str:
    """The rule of ``licences`` in SQL, for known sentences that come in two parts at most."""
    known = ", ".join(f"('{normal_words(s)}', '{i}', '{own_number(s) or ''}')" for i, s in SENTENCES.items())
    steps, names = ["rest AS r0"], []
    for n, (name, run) in enumerate(RULES):
        pattern = " " + "  ".join(run) + " "
        steps.append(f"replace(r{n}, '{pattern}', ' # ') AS r{n + 1}")
        names.append(f"CASE WHEN contains(r{n}, '{pattern}') THEN '{name}' END")
    none = WORD.replace("[", "[^")
    return rf"""
WITH known(k, sentence_id, number) AS (VALUES {known}),
texts AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS u FROM documents),
lines AS (SELECT r, unnest(u) AS line, unnest(range(len(u))) AS n FROM texts),
paragraphs AS (
  SELECT r, para, string_agg(line, chr(10) ORDER BY n) AS p
  FROM (SELECT *, regexp_matches(line, '{WORD}') AS worded, count(*) FILTER (NOT regexp_matches(line, '{WORD}')) OVER (PARTITION BY r ORDER BY n) AS para FROM lines)
  WHERE worded GROUP BY r, para
), pieces AS (
  SELECT r, para, unnest(p) AS part, unnest(range(len(p))) AS n
  FROM (SELECT r, para, string_split_regex(regexp_replace(p, '\b([vV])\.', '\1 ', 'g'), '[.!?]+(?:[ \t\r]+|[ \t\r]*(?:\n|\z))|[;:][ \t\r]*\n') AS p FROM paragraphs)
), parts AS (
  SELECT r, para, row_number() OVER (PARTITION BY r ORDER BY para, n) AS pos, regexp_replace(part, '^{none}*{LIST_MARK}\)[ \t\r\n]+', '') AS part
  FROM pieces WHERE regexp_matches(part, '{WORD}') AND NOT regexp_matches(part, '^{none}*{LIST_MARK}{none}*$')
), units AS (
  SELECT r, pos, 2 AS width, 0 AS line, part || ' ' || lead(part) OVER (PARTITION BY r, para ORDER BY pos) AS unit FROM parts
  UNION ALL SELECT r, pos, 1, 0, part FROM parts
  UNION ALL SELECT r, pos, 1, unnest(range(1, len(string_split(part, chr(10))) + 1)), unnest(string_split(part, chr(10))) FROM parts WHERE contains(part, chr(10))
), worded AS (
  SELECT r, pos, width, line, trim(regexp_replace(translate(unit, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{NOT_WORD}', ' ', 'g')) AS bare FROM units
), met AS (
  SELECT r, pos, width, line, sentence_id, nullif(replace(regexp_extract(bare, '{VERSION}'), ' ', '.'), '') AS version
  FROM worded JOIN known ON regexp_replace(bare, '{VERSION}', 'v', 'g') = k AND number IN ('', replace(regexp_extract(bare, '{VERSION}'), ' ', '.'))
), found AS (
  SELECT *, lag(pos) OVER w AS last_pos, lag(width) OVER w AS last_width, lag(line) OVER w AS last_line FROM met m
  WHERE NOT EXISTS (SELECT 1 FROM met x WHERE x.r = m.r AND x.line = 0 AND x.width = 2 AND x.pos = m.pos - 1)
    AND NOT EXISTS (SELECT 1 FROM met x WHERE x.r = m.r AND x.line = 0 AND x.pos = m.pos AND (m.line > 0 OR x.width > m.width))
  WINDOW w AS (PARTITION BY r ORDER BY pos, line)
), seq AS (
  SELECT r, string_agg(sentence_id, ',' ORDER BY pos, line) AS sentences,
    ' ' || string_agg(CASE WHEN last_pos IS NULL OR (pos = last_pos + last_width AND line <= 1) OR (pos = last_pos AND line = last_line + 1) THEN '' ELSE '- ' END || sentence_id,
                      '  ' ORDER BY pos, line) || ' ' AS rest,
    string_agg(DISTINCT version, ',' ORDER BY version) AS versions
  FROM found GROUP BY 1
), ruled AS (SELECT r, sentences, versions, {', '.join(steps)}, list_sort(list_distinct([{', '.join(names)}])) AS names FROM seq)
SELECT doc_id, coalesce(sentences, '') AS sentences, coalesce(array_to_string(names, ','), '') AS licences, coalesce(versions, '') AS versions
FROM texts LEFT JOIN ruled USING (r)
"""


op1 = _licences()

# All pairs that share a shingle, and the closure of the links: for small inputs only.
op5 = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ 	-
]+') AS w
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY 1)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM c LEFT JOIN n USING (doc_id)
"""

_TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

# Every document that shares a term with an item is scored.
op11 = rf"""
WITH d AS (SELECT doc_id, {_TERMS} AS w FROM documents), n AS (SELECT doc_id, len(w) AS n FROM d WHERE len(w) > 0),
c AS (SELECT count(*) AS big_n, CAST(sum(n) AS BIGINT) AS big_l FROM n),
tf AS (SELECT doc_id, w, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS w FROM d) GROUP BY 1, 2),
df AS (SELECT w, CAST(floor(1000 * ln((2 * (SELECT big_n FROM c) + 2) / (2 * count(*) + 1))) AS BIGINT) AS weight FROM tf GROUP BY 1),
i AS (SELECT item_id, unnest(list_distinct({_TERMS})) AS w FROM benchmark),
s AS (
  SELECT item_id, doc_id, CAST(sum(weight * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * big_n) // big_l)))) AS BIGINT) AS score
  FROM i JOIN df USING (w) JOIN tf USING (w) JOIN n USING (doc_id), c GROUP BY 1, 2
)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM s WHERE score > 0 QUALIFY rank <= 10
"""

# The lines before a cut, the draws from the hash of the id, and the text put together again from the parts.
op13 = r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u, sha256('7:' || doc_id) AS h FROM documents
), d AS (
  SELECT *, len(u) AS n, [CAST('0x' || h[8 * k + 1:8 * k + 8] AS BIGINT) FOR k IN range(4)] AS r,
    t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') AS plain FROM t
), c AS (
  SELECT *, least(r[1] % (n + 1), r[2] % (n + 1)) AS a, greatest(r[1] % (n + 1), r[2] % (n + 1)) AS b,
    CASE WHEN plain OR r[3] % 100 >= 100 THEN 'plain' WHEN r[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM d
), p AS (SELECT *, array_to_string(u[1:a], '') AS x, array_to_string(u[a + 1:b], '') AS y, array_to_string(u[b + 1:n], '') AS z FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(x) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(y) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || x || '<S>' || z || '<M>' || y ELSE '<S>' || z || '<P>' || x || '<M>' || y END) AS output_sha256,
  sha256(x || y || z) AS restored_sha256 FROM p
"""

ORACLES = {"op1_license_sentences": op1, "op3_warc_chunks": op3, "op4_line_keeps": op4, "op5_lsh_forest": op5, "op9_block_names": op9, "op11_fp_tree": op11, "op13_chunk_infill": op13}
