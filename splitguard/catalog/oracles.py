"""DuckDB SQL that recomputes the registered queries independently, from first principles.

The SQL compares all pairs and ranks whole tables in one window; it is the yardstick for
small inputs, not a plan to copy.
"""

from __future__ import annotations

NORM = "trim(regexp_replace(lower({0}), '\\s+', ' ', 'g'))"
TOKENS = "list_distinct([x FOR x IN string_split({0}, ' ') IF x <> ''])"
_KEY = "CASE WHEN length(" + NORM + ") > 0 THEN md5(" + NORM + ") END"


def norm(col: str) -> str:
    return NORM.format(col)


def key(col: str) -> str:
    return _KEY.format(col)


def row_key(*cols: str) -> str:
    """Each value with its length, so that no two rows share a key by their joins."""
    return "md5(" + " || ',' || ".join(f"length(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR)" for c in cols) + ")"


def tokens(col: str) -> str:
    return TOKENS.format(norm(col))


def word_runs(col: str, width: int) -> str:
    words = f"[x FOR x IN string_split({norm(col)}, ' ') IF x <> '']"
    starts = f"range(1, greatest(len({words}) - {width - 1}, 1) + 1)"
    return f"list_distinct([array_to_string({words}[i:i + {width - 1}], ' ') FOR i IN {starts}])"


# Every base has: part, record_id, key, group_key, features, label
DOCS = f"""base AS (
  SELECT 'documents' AS part, d.doc_id AS record_id, {key('d.text')} AS key, d.source AS group_key,
         {tokens('d.text')} AS features, CAST(l.quality AS DOUBLE) AS label
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""
# The records that have a key and a label.
JUDGED = DOCS[:-1] + f" WHERE {key('d.text')} IS NOT NULL AND l.quality IS NOT NULL)"
JUDGED_CHARS = JUDGED.replace("l.quality", "d.n_chars")
# Words are split once per document, then joined into runs by position.
DOCS_RUNS = f"""words AS (
  SELECT d.doc_id, d.source, d.lang, d.text, l.quality, [x FOR x IN string_split({norm('d.text')}, ' ') IF x <> ''] AS w
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE l.quality IS NOT NULL AND {key('d.text')} IS NOT NULL),
positions AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM words),
runs AS (SELECT doc_id, list(DISTINCT array_to_string(w[i:i + 2], ' ')) AS features FROM positions GROUP BY 1),
base AS (
  SELECT 'documents' AS part, words.doc_id AS record_id, {key('words.text')} AS key, source AS group_key,
         features, CAST(quality AS DOUBLE) AS label
  FROM words JOIN runs ON words.doc_id = runs.doc_id)"""
DOCS_RUNS_LANG = DOCS_RUNS.replace("'documents' AS part", "lang AS part")
ORDERS = f"""base AS (
  SELECT 'orders' AS part, o_orderkey AS record_id,
         {row_key('o_custkey', "strftime(o_orderdate, '%Y-%m-%d')")} AS key,
         CAST(o_custkey AS VARCHAR) AS group_key, CAST(NULL AS VARCHAR[]) AS features,
         CAST(o_orderstatus = 'F' AS DOUBLE) AS label
  FROM orders)"""
TURNS = f"""base AS (
  SELECT 'conversations' AS part, conv_id || ':' || turn AS record_id, {key('text')} AS key,
         CAST(conv_id AS VARCHAR) AS group_key, {tokens('text')} AS features,
         CAST(role = 'assistant' AS DOUBLE) AS label
  FROM conversations)"""
EVENTS = """base AS (
  SELECT 'events' AS part, event_id AS record_id, CAST(event_id AS VARCHAR) AS key,
         CAST(user_id AS VARCHAR) AS group_key, CAST(NULL AS VARCHAR[]) AS features, value AS label
  FROM events)"""
HOST = "regexp_extract(lower(url), '^[a-z]+://([^/:?#]+)', 1)"
PAGES = f"""base AS (
  SELECT 'pages' AS part, page_id AS record_id, md5(html) AS key, {HOST} AS group_key,
         CAST(NULL AS VARCHAR[]) AS features, CAST(0 AS DOUBLE) AS label FROM pages)"""

MESSY = f"""raw AS (
  SELECT d.doc_id AS record_id,
         CASE d.source WHEN 'src12' THEN NULL WHEN 'src13' THEN '  ' ELSE d.text END AS text,
         CASE d.source WHEN 'src9' THEN NULL WHEN 'src10' THEN 'unknown' WHEN 'src11' THEN 'NaN'
              WHEN 'src16' THEN 'Infinity' WHEN 'src17' THEN '-Infinity'
              ELSE CAST(l.quality AS VARCHAR) END AS label,
         CASE d.source WHEN 'src0' THEN 'Train' WHEN 'src1' THEN ' VALID ' WHEN 'src2' THEN 'validation'
              WHEN 'src3' THEN 'testing' WHEN 'src4' THEN 'holdout' WHEN 'src5' THEN NULL
              WHEN 'src6' THEN 'Test' WHEN 'src7' THEN chr(9) || 'val' || chr(10) WHEN 'src8' THEN 'training'
              WHEN 'src14' THEN 'test' || chr(9) WHEN 'src15' THEN ' train' || chr(10)
              ELSE CASE WHEN d.lang = 'en' THEN 'train' ELSE 'TEST' END END AS split,
         d.source
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id),
named AS (
  SELECT *, lower(regexp_replace(split, '^\\s+|\\s+$', '', 'g')) AS name,
         CASE WHEN isfinite(TRY_CAST(label AS DOUBLE)) THEN TRY_CAST(label AS DOUBLE) END AS value,
         {key('text')} AS k
  FROM raw),
staged AS (
  SELECT *, CASE WHEN name IN ('train', 'validation', 'valid', 'val', 'training') THEN 'train'
                 WHEN name IN ('test', 'testing') THEN 'test' END AS lenient,
         CASE WHEN name IN ('train', 'test') THEN name END AS strict
  FROM named)"""


def random_part(frac: float = 0.2, seed: int = 42, base: str = "base", name: str = "f") -> str:
    return f"""{name} AS (
  SELECT * EXCLUDE (rn, total), CASE WHEN rn <= round_even({frac} * total, 0) THEN 'test' ELSE 'train' END AS split
  FROM (SELECT *, row_number() OVER (PARTITION BY part ORDER BY md5(record_id || ':{seed}'), record_id) AS rn,
               count(*) OVER (PARTITION BY part) AS total FROM {base}))"""


def group_part(frac: float = 0.2, base: str = "base", name: str = "g") -> str:
    return f"""{name}_sizes AS (SELECT part, group_key, count(*) AS size FROM {base} GROUP BY 1, 2),
{name}_running AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY part ORDER BY size DESC, group_key ASC NULLS LAST
                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS earlier,
         sum(size) OVER (PARTITION BY part) AS total FROM {name}_sizes),
{name} AS (
  SELECT b.*, CASE WHEN r.earlier < {frac} * r.total THEN 'test' ELSE 'train' END AS split
  FROM {base} b JOIN {name}_running r ON b.part = r.part AND b.group_key IS NOT DISTINCT FROM r.group_key)"""


def neighbors(f: str = "f") -> str:
    """best: one row per test record with similarity, nn_id, nn_label, measured."""
    return f"""tok AS (
  SELECT part, record_id, split, label, len(features) AS n, unnest(features) AS t FROM {f}),
pairs AS (
  SELECT q.part, q.record_id AS q, r.record_id AS r, any_value(r.label) AS r_label,
         count(*) / (any_value(q.n) + any_value(r.n) - count(*)) AS j
  FROM tok q JOIN tok r ON q.part = r.part AND q.t = r.t
  WHERE q.split = 'test' AND r.split = 'train' GROUP BY 1, 2, 3),
top AS (SELECT * FROM pairs QUALIFY row_number() OVER (PARTITION BY part, q ORDER BY j DESC, r) = 1),
firsts AS (
  SELECT part, min(record_id) AS first_id, arg_min(label, record_id) AS first_label
  FROM {f} WHERE split = 'train' GROUP BY 1),
best AS (
  SELECT x.part, x.record_id, x.label, coalesce(t.j, 0.0) AS similarity, coalesce(t.r, n.first_id) AS nn_id,
         coalesce(t.r_label, n.first_label, 0.0) AS nn_label,
         (x.features IS NOT NULL AND n.first_id IS NOT NULL) AS measured
  FROM {f} x LEFT JOIN top t ON x.part = t.part AND x.record_id = t.q LEFT JOIN firsts n ON x.part = n.part
  WHERE x.split = 'test')"""


def scores(f: str = "f") -> str:
    """score: metric_name, score, chance per part."""
    return f"""soft AS (
  SELECT part, label, CASE WHEN nn_label = 1 THEN similarity ELSE 1 - similarity END AS s FROM best),
wins AS (
  SELECT a.part, avg(CASE WHEN a.s > b.s THEN 1.0 WHEN a.s = b.s THEN 0.5 ELSE 0.0 END) AS auc
  FROM soft a JOIN soft b ON a.part = b.part WHERE a.label = 1 AND b.label <> 1 GROUP BY 1),
fit AS (
  SELECT part, CASE WHEN count(*) < 2 THEN NULL
                    WHEN min(label) = max(label) AND sum(power(label - nn_label, 2)) = 0 THEN 1.0
                    WHEN min(label) = max(label) THEN 0.0
                    ELSE 1 - sum(power(label - nn_label, 2)) / (count(*) * var_pop(label)) END AS r2
  FROM best GROUP BY 1),
kinds AS (
  SELECT part, CASE WHEN list_sort(list(DISTINCT label)) = [0.0, 1.0] THEN 'AUROC' ELSE 'R2' END AS metric_name
  FROM {f} GROUP BY 1),
score AS (
  SELECT k.part, k.metric_name, CASE WHEN k.metric_name = 'AUROC' THEN w.auc ELSE fit.r2 END AS score,
         CASE WHEN k.metric_name = 'AUROC' THEN '0.50' ELSE '0.00' END AS chance
  FROM kinds k LEFT JOIN wins w ON k.part = w.part LEFT JOIN fit ON k.part = fit.part)"""


def duplicates(f: str = "f") -> str:
    return f"""dup AS (
  SELECT part, count(*) AS n_test,
         CAST(count(*) FILTER (WHERE (part, key) IN (SELECT (part, key) FROM {f} WHERE split = 'train')) AS BIGINT) AS n_leaked
  FROM {f} WHERE split = 'test' GROUP BY 1)"""


def groups(f: str = "f") -> str:
    return f"""tg AS (SELECT DISTINCT part, group_key FROM {f} WHERE split = 'test' AND group_key IS NOT NULL),
sg AS (SELECT part, group_key FROM tg INTERSECT SELECT part, group_key FROM {f} WHERE split = 'train'),
grp AS (
  SELECT tg.part, count(*) AS n_test_groups, count(sg.group_key) AS n_shared
  FROM tg LEFT JOIN sg ON tg.part = sg.part AND tg.group_key = sg.group_key GROUP BY 1)"""


def report(f: str = "f") -> str:
    """rep: one row of checks and verdict per part."""
    return f"""{duplicates(f)},
{groups(f)},
{neighbors(f)},
{scores(f)},
sim AS (
  SELECT part, count(*) AS n_measured, avg(similarity) AS nn_mean,
         avg(CASE WHEN similarity > 0.8 THEN 1.0 ELSE 0.0 END) AS above
  FROM best WHERE measured GROUP BY 1),
cnt AS (
  SELECT part, count(*) FILTER (WHERE split = 'train') AS n_train, count(*) FILTER (WHERE split = 'test') AS n_test
  FROM {f} GROUP BY 1),
flat AS (
  SELECT cnt.part, cnt.n_train, cnt.n_test, dup.n_leaked, dup.n_leaked / dup.n_test AS dup_frac, sim.n_measured,
         sim.nn_mean, sim.above, grp.n_test_groups, grp.n_shared, grp.n_shared / grp.n_test_groups AS grp_frac,
         score.metric_name, score.score
  FROM cnt JOIN dup ON cnt.part = dup.part JOIN grp ON cnt.part = grp.part JOIN sim ON cnt.part = sim.part
  JOIN score ON cnt.part = score.part),
rep AS (
  SELECT *, least(n_train, n_test) < 50 AS low_confidence,
         CASE WHEN dup_frac > 0.05 OR coalesce(score > CASE metric_name WHEN 'R2' THEN 0.7 ELSE 0.85 END, false)
              THEN 'LEAKING'
              WHEN n_leaked = 0 AND NOT (above > 0.5 OR grp_frac > 0.5
                   OR coalesce(score > CASE metric_name WHEN 'R2' THEN 0.4 ELSE 0.65 END, false))
              THEN 'CLEAN' ELSE 'SUSPECT' END AS verdict
  FROM flat)"""


REPORT_COLUMNS = """part AS dataset, verdict, low_confidence, n_train, n_test, n_leaked,
  round(dup_frac, 6) AS fraction_leaked, n_measured, round(nn_mean, 6) AS nn_mean,
  round(above, 6) AS fraction_above_0_8, n_test_groups, n_shared, round(grp_frac, 6) AS fraction_shared,
  metric_name, round(score, 6) AS score"""


def _audit(base: str, split: str) -> str:
    return f"WITH {base},\n{split},\n{report()}\nSELECT {REPORT_COLUMNS} FROM rep"


def _nn(base: str, columns: str) -> str:
    return f"WITH {base},\n{random_part()},\n{neighbors()}\nSELECT {columns} FROM best"


def _score(base: str, split: str) -> str:
    return (
        f"WITH {base},\n{split},\n{neighbors()},\n{scores()}\n"
        "SELECT part AS dataset, metric_name, round(score, 6) AS score, chance FROM score"
    )


def _duplicates(base: str) -> str:
    return (
        f"WITH {base},\n{random_part()},\n{duplicates()}\n"
        "SELECT part AS dataset, n_test, n_leaked, round(n_leaked / n_test, 6) AS fraction_leaked FROM dup"
    )


def _groups(base: str) -> str:
    return (
        f"WITH {base},\n{random_part()},\n{groups()}\n"
        "SELECT part AS dataset, n_test_groups, n_shared, round(n_shared / n_test_groups, 6) AS fraction_shared FROM grp"
    )


def _notes(mode: str, source: str) -> str:
    return f"""WITH {MESSY}
SELECT 'messy' AS dataset, count(*) AS n_input, 'text' AS key_col, 'label' AS label_col,
  count(*) FILTER (WHERE k IS NULL) AS dropped_bad_key,
  count(*) FILTER (WHERE k IS NOT NULL AND value IS NULL) AS dropped_missing_label,
  count(*) FILTER (WHERE k IS NOT NULL AND value IS NOT NULL AND {mode} IS NULL) AS dropped_unusable_split,
  CASE WHEN list_sort(list(DISTINCT value) FILTER (WHERE k IS NOT NULL AND value IS NOT NULL AND {mode} IS NOT NULL))
            = [0.0, 1.0] THEN 'binary' ELSE 'continuous' END AS label_type,
  '{source}' AS split_source,
  count(*) FILTER (WHERE k IS NOT NULL AND value IS NOT NULL AND {mode} IS NOT NULL) AS n_kept,
  count(*) FILTER (WHERE k IS NOT NULL AND value IS NOT NULL AND {mode} = 'train') AS n_train,
  count(*) FILTER (WHERE k IS NOT NULL AND value IS NOT NULL AND {mode} = 'test') AS n_test
FROM staged"""


def _kind(name: str, column: str, relation: str) -> str:
    exact = f"list_sort(list(DISTINCT CAST({column} AS DOUBLE))) = [0.0, 1.0]"
    return (
        f"SELECT '{name}' AS label_name, CASE WHEN {exact} THEN 'binary' ELSE 'continuous' END AS label_type, "
        f"CASE WHEN {exact} THEN 'AUROC' ELSE 'R2' END AS metric_name FROM {relation}"
    )


def _pct(x: str) -> str:
    return f"printf('%.1f', round_even({x} * 100, 1))"


_DUP_TEXT = f"printf('%d of %d test records (%s%%) also occur in train under the same key.', n_leaked, n_test, {_pct('dup_frac')})"
_SIM_TEXT = (
    "printf('%s%% of test records have a train record more similar than 0.8 (mean nearest similarity %s).', "
    f"{_pct('above')}, printf('%.2f', round_even(nn_mean, 2)))"
)
_GRP_TEXT = (
    "printf('%d of %d distinct test groups (%s%%) also occur in train, so a model can lean on the group.', "
    f"n_shared, n_test_groups, {_pct('grp_frac')})"
)
_BASE_TEXT = (
    "'Copying the nearest train label scores ' || printf('%.2f', round_even(score, 2)) || ' ' || metric_name || "
    "' on test (chance = ' || CASE metric_name WHEN 'R2' THEN '0.00' ELSE '0.50' END || "
    "'); a model near this score is mostly a lookup.'"
)
_CAUTION = (
    "CASE WHEN low_confidence THEN printf('LOW CONFIDENCE: %d train and %d test rows, fewer than 50 on one side; "
    "read the verdict as a hint.', n_train, n_test) || ' ' ELSE '' END"
)
_SUMMARY = (
    f"{_CAUTION} || 'Verdict: ' || verdict || '. ' || {_DUP_TEXT} || ' ' || {_SIM_TEXT} || ' ' || {_GRP_TEXT} || ' ' || "
    f"{_BASE_TEXT} || ' These checks can show that leakage is present; CLEAN does not prove that there is none.'"
)

# Before and after the repair, kept apart in ``part``.
_BOTH = (
    f"{DOCS_RUNS},\n{random_part()},\n{group_part()},\n"
    "v AS (SELECT * REPLACE ('before' AS part) FROM f UNION ALL BY NAME SELECT * REPLACE ('after' AS part) FROM g)"
)
_FIX = f"""{_BOTH},
{neighbors('v')},
{scores('v')},
fixed AS (
  SELECT 'documents' AS dataset, b.metric_name AS metric_before, b.score AS score_before,
         a.metric_name AS metric_after, a.score AS score_after
  FROM score b, score a WHERE b.part = 'before' AND a.part = 'after')"""

_CONTROLS = f"""{DOCS_RUNS},
copies AS (
  SELECT 'copy' AS part, record_id * 2 + CASE s WHEN 'test' THEN 1 ELSE 0 END AS record_id, key, group_key, features,
         label, s AS split
  FROM base, (VALUES ('train'), ('test')) sides(s)),
one AS (
  SELECT * REPLACE ('drawn' AS part, CASE WHEN substr(md5(record_id || ':label'), 1, 1) < '8' THEN 1.0 ELSE 0.0 END AS label)
  FROM base WHERE record_id IN (SELECT min(record_id) FROM base GROUP BY key)),
{random_part(base='one', name='drawn')},
f AS (SELECT * FROM copies UNION ALL BY NAME SELECT * FROM drawn)"""

_SWEEP = f"""{DOCS_RUNS_LANG},
{random_part()},
{group_part()},
v AS (SELECT * REPLACE (part || '|random' AS part) FROM f UNION ALL BY NAME SELECT * REPLACE (part || '|group' AS part) FROM g)"""


ORACLES: dict[str, str] = {
    "duplicates": _duplicates(DOCS),
    "duplicates_orders_customer": _duplicates(ORDERS),
    "duplicates_conversations": _duplicates(TURNS),
    "duplicates_messy": f"""WITH {MESSY},
f AS (SELECT 'messy' AS part, k AS key, lenient AS split FROM staged WHERE lenient IS NOT NULL)
SELECT 'messy' AS dataset, count(*) AS n_test, CAST(count(*) FILTER (WHERE key IN (SELECT key FROM f WHERE split = 'train' AND key IS NOT NULL)) AS BIGINT) AS n_leaked,
       round(count(*) FILTER (WHERE key IN (SELECT key FROM f WHERE split = 'train' AND key IS NOT NULL)) / count(*), 6) AS fraction_leaked
FROM f WHERE split = 'test'""",
    "leaked_messy": f"""WITH {MESSY}
SELECT record_id, k AS key FROM staged WHERE lenient = 'test' AND k IN (SELECT k FROM staged WHERE lenient = 'train' AND k IS NOT NULL)""",
    "row_keys_lineitem": f"""SELECT {row_key('l_orderkey', 'l_partkey', 'l_suppkey', 'l_linenumber', 'l_returnflag', 'l_linestatus')} AS key, count(*) AS n_rows
FROM lineitem GROUP BY 1""",
    "find_key_by_content": """SELECT 0.0::DOUBLE AS share_a,
  round(avg(CASE WHEN doc_id % 4 = 0 THEN 0.0 ELSE 1.0 END), 6) AS share_b, 1.0::DOUBLE AS share_c, CASE WHEN avg(CASE WHEN doc_id % 4 = 0 THEN 0.0 ELSE 1.0 END) > 0.7 THEN 'b' ELSE 'c' END AS key_col FROM documents""",
    "leaked_documents": f"""WITH {DOCS},
{random_part()}
SELECT record_id, key FROM f WHERE split = 'test' AND key IN (SELECT key FROM f WHERE split = 'train')""",
    "prepare_notes": _notes("lenient", "provided column ''split'' (valid folded into train)"),
    "load_strict_notes": _notes("strict", "provided column ''split''"),
    "prepare_frame": f"""WITH {MESSY}
SELECT record_id, k AS key, source AS group_key, CAST(len({tokens('text')}) AS INTEGER) AS n_features, value AS label,
       lenient AS split
FROM staged WHERE k IS NOT NULL AND value IS NOT NULL AND lenient IS NOT NULL""",
    "prepare_without_split": f"""WITH {MESSY}
SELECT 'messy' AS dataset, count(*) AS n_input, 'text' AS key_col, 'label' AS label_col,
  count(*) FILTER (WHERE k IS NULL) AS dropped_bad_key,
  count(*) FILTER (WHERE k IS NOT NULL AND value IS NULL) AS dropped_missing_label,
  CAST(0 AS BIGINT) AS dropped_unusable_split,
  'binary' AS label_type,
  'no split column found: created a RANDOM 80/20 split (seed 42); this created split is what the checks judge' AS split_source,
  count(*) FILTER (WHERE k IS NOT NULL AND value IS NOT NULL) AS n_kept,
  CAST(count(*) FILTER (WHERE k IS NOT NULL AND value IS NOT NULL)
       - round_even(0.2 * count(*) FILTER (WHERE k IS NOT NULL AND value IS NOT NULL), 0) AS BIGINT) AS n_train,
  CAST(round_even(0.2 * count(*) FILTER (WHERE k IS NOT NULL AND value IS NOT NULL), 0) AS BIGINT) AS n_test
FROM staged""",
    "split_modes": f"""WITH {MESSY}
SELECT split AS raw_split, lenient, strict, count(*) AS n_rows FROM staged GROUP BY 1, 2, 3""",
    "unexpected_splits": f"""WITH {MESSY}
SELECT name AS split_value, count(*) AS n_rows FROM staged WHERE strict IS NULL GROUP BY 1""",
    "missing_sides": f"""WITH {MESSY}
SELECT source AS dataset, count(*) FILTER (WHERE strict = 'train') = 0 AS train_missing,
       count(*) FILTER (WHERE strict = 'test') = 0 AS test_missing
FROM staged WHERE k IS NOT NULL AND value IS NOT NULL AND strict IS NOT NULL GROUP BY 1""",
    "label_kind": " UNION ALL ".join(
        [
            _kind("quality", "quality", "labels"),
            _kind("toxic", "toxic", "labels"),
            _kind("n_chars", "n_chars", "documents"),
            _kind("o_totalprice", "o_totalprice", "orders"),
            _kind("embedding_label", "label", "embeddings"),
        ]
    ),
    "feature_sets": f"SELECT doc_id, {key('text')} AS key, CAST(len({tokens('text')}) AS INTEGER) AS n_tokens FROM documents",
    "folded_features": f"""WITH t AS (SELECT doc_id, unnest({tokens('text')}) AS tok FROM documents),
bits AS (SELECT DISTINCT doc_id, CAST('0x' || substr(md5(tok), 1, 8) AS BIGINT) % 2048 AS b FROM t)
SELECT d.doc_id, CAST(count(b) AS INTEGER) AS n_bits, CAST(coalesce(sum(b), 0) AS BIGINT) AS bit_sum
FROM documents d LEFT JOIN bits ON d.doc_id = bits.doc_id GROUP BY 1""",
    "shingle_sets": f"""SELECT item_id, CAST(len({word_runs('text', 3)}) AS INTEGER) AS n_word_runs,
  CAST(len(list_distinct([substr({norm('text')}, i, 5) FOR i IN range(1, greatest(length({norm('text')}) - 4, 1) + 1)]))
       AS INTEGER) AS n_char_runs FROM benchmark""",
    "group_keys": f"""SELECT page_id, {HOST} AS host,
  array_to_string(list_slice(string_split({norm('html')}, ' '), 1, 2), ' ') AS opening FROM pages""",
    "random_split": f"WITH {DOCS},\n{random_part()}\nSELECT record_id, split FROM f",
    "random_split_orders": f"WITH {ORDERS},\n{random_part()}\nSELECT record_id, split FROM f",
    "group_split": f"WITH {DOCS},\n{group_part()}\nSELECT record_id, split FROM g",
    "group_split_orders": f"WITH {ORDERS},\n{group_part()}\nSELECT record_id, split FROM g",
    "group_split_events": f"WITH {EVENTS},\n{group_part(0.3)}\nSELECT record_id, split FROM g",
    "group_split_conversations": f"WITH {TURNS},\n{group_part()}\nSELECT record_id, split FROM g",
    "group_split_disjoint": f"""WITH {DOCS}, {group_part()},
{ORDERS.replace('base AS', 'obase AS')}, {group_part(base='obase', name='og')}
SELECT 'documents' AS dataset, count(*) AS n_shared FROM
  (SELECT group_key FROM g WHERE split = 'test' INTERSECT SELECT group_key FROM g WHERE split = 'train')
UNION ALL SELECT 'orders', count(*) FROM
  (SELECT group_key FROM og WHERE split = 'test' INTERSECT SELECT group_key FROM og WHERE split = 'train')""",
    "split_sizes": f"""WITH {ORDERS},
{random_part()}
SELECT part AS dataset, count(*) FILTER (WHERE split = 'train') AS n_train,
       count(*) FILTER (WHERE split = 'test') AS n_test FROM f GROUP BY 1""",
    "group_overlap": _groups(DOCS),
    "group_overlap_orders": _groups(ORDERS),
    "group_overlap_pages": _groups(PAGES),
    "shared_groups": f"""WITH {ORDERS},
{random_part()}
SELECT group_key FROM f WHERE split = 'test' INTERSECT SELECT group_key FROM f WHERE split = 'train'""",
    "groups_only_in_test": f"""WITH {TURNS},
{random_part()}
SELECT group_key FROM f WHERE split = 'test' EXCEPT SELECT group_key FROM f WHERE split = 'train'""",
    "nn_similarity": _nn(JUDGED, "record_id, round(similarity, 6) AS similarity"),
    "nn_label_copy": _nn(JUDGED, "record_id, label, round(similarity, 6) AS similarity, nn_id, nn_label"),
    "nn_label_copy_conversations": _nn(TURNS, "record_id, label, round(similarity, 6) AS similarity, nn_id, nn_label"),
    "nn_label_copy_shingles": _nn(DOCS_RUNS, "record_id, round(similarity, 6) AS similarity, nn_id, nn_label"),
    "nn_summary": f"""WITH {JUDGED},
{random_part()},
{neighbors()}
SELECT part AS dataset, count(*) AS n_measured, round(avg(similarity), 6) AS nn_mean,
       round(avg(CASE WHEN similarity > 0.8 THEN 1.0 ELSE 0.0 END), 6) AS fraction_above_0_8
FROM best WHERE measured GROUP BY 1""",
    "nn_histogram": f"""WITH {JUDGED},
{random_part()},
{neighbors()},
filled AS (SELECT CAST(greatest(0, least(9, floor(similarity * 10))) AS INTEGER) AS bin, count(*) AS n FROM best GROUP BY 1),
grid AS (SELECT CAST(range AS INTEGER) AS bin, coalesce(n, 0) AS n_rows FROM range(10) LEFT JOIN filled ON filled.bin = range)
SELECT 'documents' AS dataset, bin, bin / 10 AS low, CAST(n_rows AS BIGINT) AS n_rows,
       CAST(floor(n_rows * 100 / (SELECT greatest(1, max(n_rows)) FROM grid) + 0.5) AS INTEGER) AS height FROM grid""",
    "baseline_auroc": _score(JUDGED, random_part()),
    "baseline_r2": _score(JUDGED_CHARS, random_part()),
    "baseline_one_class": f"""WITH {JUDGED},
{random_part(name='all_rows')},
f AS (SELECT * FROM all_rows WHERE split = 'train' OR label = 1),
{neighbors()},
{scores()}
SELECT part AS dataset, metric_name, score, score IS NULL AS inconclusive FROM score""",
    "audit": _audit(DOCS_RUNS, random_part()),
    "audit_numeric_label": _audit(JUDGED_CHARS, random_part()),
    "audit_conversations": _audit(TURNS, random_part()),
    "audit_messy": f"""WITH {MESSY},
f AS (SELECT 'messy' AS part, record_id, k AS key, source AS group_key, {tokens('text')} AS features, value AS label,
             lenient AS split
      FROM staged WHERE k IS NOT NULL AND value IS NOT NULL AND lenient IS NOT NULL),
{report()}
SELECT {REPORT_COLUMNS} FROM rep""",
    "audit_summary": f"""WITH {DOCS_RUNS},
{random_part()},
{report()}
SELECT part AS dataset, verdict, {_DUP_TEXT} AS duplicates_message, {_SIM_TEXT} AS similarity_message,
       {_GRP_TEXT} AS groups_message, {_BASE_TEXT} AS baseline_message, {_SUMMARY} AS summary FROM rep""",
    "audit_report_json": f"""WITH {DOCS_RUNS},
{random_part()},
{report()}
SELECT part AS dataset, verdict, n_leaked, n_shared, round(nn_mean, 6) AS nn_mean, round(score, 6) AS score, metric_name
FROM rep""",
    "fix_report": f"""WITH {_FIX}
SELECT dataset, metric_before, round(score_before, 6) AS score_before, metric_after, round(score_after, 6) AS score_after,
       (SELECT count(*) FROM g WHERE split = 'train') AS n_train, (SELECT count(*) FROM g WHERE split = 'test') AS n_test,
       coalesce(score_after < score_before, false) AS improved FROM fixed""",
    "fixed_rows": f"WITH {DOCS},\n{group_part()}\nSELECT record_id, key, label, split FROM g",
    "collapse_bars": f"""WITH {_FIX},
bars AS (
  SELECT dataset, 'before' AS bar, metric_before AS metric, score_before AS score FROM fixed
  UNION ALL SELECT dataset, 'after', metric_before, score_after FROM fixed),
axes AS (SELECT *, CASE metric WHEN 'R2' THEN 0.0 ELSE 0.5 END AS lo, CASE metric WHEN 'R2' THEN 0.7 ELSE 0.85 END AS hi
         FROM bars WHERE score IS NOT NULL)
SELECT dataset, bar, metric, round(score, 6) AS score,
       round(greatest(0.0, least(100.0, CAST((score - lo) / (1 - lo) * 100 AS DOUBLE))), 6) AS height,
       round(CAST((hi - lo) / (1 - lo) * 100 AS DOUBLE), 6) AS leaking_height, CAST(0.0 AS DOUBLE) AS chance_height,
       score >= hi AS hot FROM axes""",
    "sweep": f"""WITH {_SWEEP},
{report('v')}
SELECT split_part(rep.part, '|', 1) AS dataset, split_part(rep.part, '|', 2) AS method,
       CASE metric_name WHEN 'AUROC' THEN 'binary' ELSE 'continuous' END AS label_type, n_train + n_test AS n, verdict,
       metric_name, round_even(score, 3) AS score, round_even(dup_frac, 3) AS dup_fraction,
       round_even(above, 3) AS sim_above_0_8, round_even(grp_frac, 3) AS group_shared FROM rep""",
    "validation_table": f"""WITH {_CONTROLS},
{report()}
SELECT part AS dataset, CASE part WHEN 'copy' THEN 'LEAKING' ELSE 'not LEAKING' END AS expected, verdict,
       round_even(dup_frac * 100, 1) AS dup_pct, round_even(above * 100, 1) AS sim_pct,
       round_even(grp_frac * 100, 1) AS group_pct, round_even(score, 3) AS baseline FROM rep""",
}
