"""Registered queries for the further checks, and their comparison SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from splitguard.catalog.frames import document_frame, judged_documents, order_frame, split_documents, table
from splitguard.catalog.oracles import DOCS, JUDGED, ORDERS, neighbors, random_part, tokens
from splitguard.functions.numbers import percent, percent_half_up
from splitguard.functions.records import set_similarity, token_set, word_shingles
from splitguard.operators import extended
from splitguard.operators.neighbors import nearest_neighbors
from splitguard.operators.splits import random_split
from splitguard.storage import materialize

_DIGITS = 6
_NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _rounded(frame, *names):
    return frame.withColumns({n: F.round(n, _DIGITS) for n in names})


def split_orders(spark, sf_dir):
    """Orders with time and batch, split at random."""
    more = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("record_id"), F.col("o_orderdate").alias("time"), F.col("o_orderpriority").alias("batch"))
    return random_split(order_frame(spark, sf_dir).join(more, "record_id"))


def split_lines(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(
        F.concat_ws(":", "l_orderkey", "l_linenumber").alias("record_id"), *_NUMBERS, (F.col("l_returnflag") == "R").cast("double").alias("label"),
        F.datediff("l_shipdate", F.lit("1992-01-01")).alias("ship_day"), (F.col("l_returnflag") == "R").cast("double").alias("copy_of_label"),
    )
    return random_split(lines.withColumn("dataset", F.lit("lineitem")))


def record_hashes(spark, sf_dir):
    names = ("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    return table(spark, sf_dir, "orders").select("o_orderkey", extended.record_hash(*names).alias("row_hash"))


def copied_records(spark, sf_dir):
    return extended.copied_records(split_documents(spark, sf_dir)).drop("dataset")


def duplicate_severity(spark, sf_dir):
    return _rounded(extended.duplicate_severity(split_documents(spark, sf_dir)), "measured")


def group_leaks(spark, sf_dir):
    return extended.group_leaks(split_orders(spark, sf_dir)).drop("dataset")


def group_severity(spark, sf_dir):
    return _rounded(extended.group_severity(split_orders(spark, sf_dir)), "measured")


def temporal(spark, sf_dir):
    return _rounded(extended.temporal_check(split_orders(spark, sf_dir)), "measured").withColumns({c: F.date_format(c, "yyyy-MM-dd") for c in ("last_train", "first_test")})


def confound(spark, sf_dir):
    return _rounded(extended.confound_check(split_orders(spark, sf_dir)), "measured")


def feature_leaks(spark, sf_dir):
    return _rounded(extended.feature_leaks(split_lines(spark, sf_dir), [*_NUMBERS, "ship_day", "copy_of_label"]), "measured")


def moments(spark, sf_dir):
    found = extended.moment_check(materialize(split_lines(spark, sf_dir), "lines"), _NUMBERS)
    return _rounded(found, *[c for c in found.columns if c.endswith(("_all", "_test"))])


def moments_of_test_alone(spark, sf_dir):
    """Line items that are all test rows, so that test and all agree: the case the check is for."""
    lines = materialize(split_lines(spark, sf_dir), "lines").withColumn("split", F.lit("test"))
    return extended.moment_check(lines, _NUMBERS).select("dataset", "feature", "severity")


def input_problems(spark, sf_dir):
    frame = split_documents(spark, sf_dir).withColumn("split", F.when(F.col("group_key") == "src0", "holdout").otherwise(F.col("split")))
    twice = frame.filter(F.col("group_key") == "src1").withColumn("split", F.lit("train"))
    return extended.input_problems(frame.unionByName(twice), {"record_id": "bigint", "weight": "double"})


def companion_split(spark, sf_dir):
    docs = document_frame(spark, sf_dir)
    listed = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("record_id"), F.when(F.col("quality") == 1, "train").otherwise("test").alias("split"))
    again = listed.filter("record_id % 3 = 0").withColumn("split", F.lit("train"))
    return extended.with_companion_split(docs, listed.unionByName(again))[1]


def corpus_overlap(spark, sf_dir):
    """Benchmark items with most of their 8-word runs in one document."""
    found = extended.corpus_overlap(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents"), lambda t: word_shingles(t, 8), "item_id", "doc_id")
    return _rounded(found, "fullest")


def _neighbors(spark, sf_dir):
    return materialize(nearest_neighbors(random_split(judged_documents(spark, sf_dir))), "neighbors")


def near_and_far(spark, sf_dir):
    return _rounded(extended.near_and_far(_neighbors(spark, sf_dir), 0.3), "right", "mean_similarity")


def inflation(spark, sf_dir):
    return _rounded(extended.inflation(_neighbors(spark, sf_dir)), "q1", "median", "q3", "correlation", "slope")


def _found(spark, sf_dir):
    frame = materialize(split_orders(spark, sf_dir), "orders")
    return extended.findings({
        "duplicates": extended.duplicate_severity(frame), "groups": extended.group_severity(frame),
        "temporal": extended.temporal_check(frame), "confound": extended.confound_check(frame),
        "confound_constant": extended.confound_check(frame.withColumn("batch", F.lit("one"))),
    })


def findings(spark, sf_dir):
    return _rounded(_found(spark, sf_dir), "measured")


def roll_up(spark, sf_dir):
    return extended.roll_up(_found(spark, sf_dir))


def chart_percentages(spark, sf_dir):
    """Shares of the order priorities, rounded as in messages (ties to even) and as on charts (ties up)."""
    counts = table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("n"))
    total = table(spark, sf_dir, "orders").agg(F.count("*")).scalar()
    share = F.col("n") / total
    return counts.select("o_orderpriority", percent(share).alias("message_pct"), percent_half_up(share).alias("chart_pct"))


def turn_similarity(spark, sf_dir):
    """Token-set similarity of each turn with the next one of its conversation."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", token_set("text").alias("tokens"))
    following = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("tokens").alias("next_tokens"))
    return turns.join(following, ["conv_id", "turn"]).select("conv_id", "turn", F.round(set_similarity("tokens", "next_tokens"), _DIGITS).alias("similarity"))


QUERIES = {
    f.__name__: f
    for f in (
        chart_percentages, turn_similarity, record_hashes, copied_records, duplicate_severity, group_leaks, group_severity, temporal, confound, feature_leaks, moments, moments_of_test_alone,
        input_problems, companion_split, corpus_overlap, near_and_far, inflation, findings, roll_up,
    )
}

_HASHED = " || ',' || ".join(f"'{c}:' || length(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR)" for c in ("o_custkey", "o_orderkey", "o_orderpriority", "o_orderstatus"))
_OF = f"""{ORDERS},
{random_part(name='f0')},
f AS (SELECT f0.*, o_orderdate AS t, o_orderpriority AS batch FROM f0 JOIN orders ON o_orderkey = record_id)"""
_LINES = f"""lines AS (SELECT 'lineitem' AS part, l_orderkey || ':' || l_linenumber AS record_id, l_quantity, l_extendedprice, l_discount, l_tax,
  CAST(l_returnflag = 'R' AS DOUBLE) AS label, datediff('day', DATE '1992-01-01', CAST(l_shipdate AS DATE)) AS ship_day, CAST(l_returnflag = 'R' AS DOUBLE) AS copy_of_label FROM lineitem),
{random_part(base='lines')}"""
_DUP = """SELECT 'duplicates' AS "check", 'orders' AS dataset, count(*) AS n_test, CAST(count(*) FILTER (key IN (SELECT key FROM f WHERE split = 'train')) AS BIGINT) AS n_flagged,
  count(*) FILTER (key IN (SELECT key FROM f WHERE split = 'train')) / count(*) AS measured FROM f WHERE split = 'test'"""
_GROUPS = """SELECT count(*) AS n_test, CAST(count(DISTINCT group_key) FILTER (hit) AS BIGINT) AS n_flagged, count(*) FILTER (hit) / count(*) AS measured
FROM (SELECT *, group_key IN (SELECT group_key FROM f WHERE split = 'train') AS hit FROM f WHERE split = 'test')"""
_TIME = """SELECT count(*) AS n_test, CAST(count(*) FILTER (t < (SELECT max(t) FROM f WHERE split = 'train')) AS BIGINT) AS n_flagged,
  count(*) FILTER (t < (SELECT max(t) FROM f WHERE split = 'train')) / count(*) AS measured,
  CASE WHEN (SELECT max(t) FROM f WHERE split = 'train') < min(t) THEN 'PASS' ELSE 'HIGH' END AS severity,
  strftime((SELECT max(t) FROM f WHERE split = 'train'), '%Y-%m-%d') AS last_train, strftime(min(t), '%Y-%m-%d') AS first_test FROM f WHERE split = 'test'"""
_CELLS = """tr AS (SELECT batch, label FROM f WHERE split = 'train'),
pairs AS (SELECT b.batch, l.label, (SELECT count(*) FROM tr WHERE batch = b.batch) AS r, (SELECT count(*) FROM tr WHERE label = l.label) AS c,
  (SELECT count(*) FROM tr WHERE batch = b.batch AND label = l.label) AS o, (SELECT count(*) FROM tr) AS n
  FROM (SELECT DISTINCT batch FROM tr) b, (SELECT DISTINCT label FROM tr) l),
v AS (SELECT any_value(n) AS n, count(DISTINCT batch) AS k, count(DISTINCT label) AS m,
  sqrt(sum(power(o - r * c / n, 2) / (r * c / n)) / (any_value(n) * (least(count(DISTINCT batch), count(DISTINCT label)) - 1))) AS measured FROM pairs)"""
_TIER = "CASE WHEN measured > 0.7 THEN 'HIGH' WHEN measured > 0.4 THEN 'MEDIUM' WHEN measured > 0.2 THEN 'LOW' ELSE 'PASS' END"
_FINDINGS = f"""WITH {_OF},
{_CELLS},
d AS ({_DUP}), g AS ({_GROUPS}), t AS ({_TIME}),
found AS (
  SELECT 'duplicates' AS "check", measured, CASE WHEN n_flagged > 0 THEN 'CRITICAL' ELSE 'PASS' END AS severity FROM d
  UNION ALL SELECT 'groups', measured, CASE WHEN n_flagged > 0 THEN 'HIGH' ELSE 'PASS' END FROM g
  UNION ALL SELECT 'temporal', measured, severity FROM t
  UNION ALL SELECT 'confound', measured, {_TIER} FROM v
  UNION ALL SELECT 'confound_constant', NULL, 'SKIPPED')"""


def _feature(name: str) -> str:
    """AUROC from average ranks."""
    return f"""SELECT '{name}' AS feature, greatest(auc, 1 - auc) AS measured FROM (
  SELECT (sum(rk) FILTER (label = 1) - count(*) FILTER (label = 1) * (count(*) FILTER (label = 1) + 1) / 2)
         / (count(*) FILTER (label = 1) * count(*) FILTER (label <> 1)) AS auc
  FROM (SELECT label, rank() OVER (ORDER BY {name}) + (count(*) OVER (PARTITION BY {name}) - 1) / 2 AS rk FROM f WHERE split = 'train'))"""


def _figures(name: str, rows: str) -> str:
    """Mean, deviation and percentiles of one side from exact sums."""
    x = f"CAST(CAST({name} AS DECIMAL(19, 6)) - CAST((SELECT min({name}) FROM {{0}}) AS DECIMAL(19, 6)) AS DECIMAL(19, 6))".format(rows.split()[0])
    quantiles = ", ".join(f"quantile_cont({name}, {q}) AS p{p}" for p, q in ((5, 0.05), (50, 0.5), (95, 0.95)))
    return f"""(SELECT (SELECT min({name}) FROM {rows.split()[0]}) + CAST(sum({x}) AS DOUBLE) / count(*) AS mean,
    sqrt((sum(CAST({x} AS DOUBLE) * CAST({x} AS DOUBLE)) - pow(CAST(sum({x}) AS DOUBLE), 2) / count(*)) / (count(*) - 1)) AS std, {quantiles} FROM {rows})"""


def _moments(frame: str) -> str:
    """One row per feature: the figures of all rows and of test, and whether they agree."""
    figures = ("mean", "std", "p5", "p50", "p95")
    columns = ", ".join(f"round(a.{c}, 6) AS {c}_all, round(t.{c}, 6) AS {c}_test" for c in figures)
    same = " AND ".join(f"abs(a.{c} - t.{c}) <= 1e-10" for c in figures)
    return " UNION ALL ".join(
        f"SELECT 'lineitem' AS dataset, '{n}' AS feature, {columns}, CASE WHEN {same} THEN 'MEDIUM' ELSE 'PASS' END AS severity\n"
        f"FROM {_figures(n, frame)} a, {_figures(n, frame + ' WHERE split = ' + repr('test'))} t"
        for n in _NUMBERS
    )


_RUNS8 = """{0}_words AS (SELECT {1} AS id, [x FOR x IN string_split(trim(regexp_replace(lower(text), '\\s+', ' ', 'g')), ' ') IF x <> ''] AS w FROM {2}),
{0}_runs AS (SELECT DISTINCT id, array_to_string(w[i:i + 7], ' ') AS s FROM (SELECT id, w, unnest(range(1, greatest(len(w) - 7, 1) + 1)) AS i FROM {0}_words) WHERE len(w) > 0)"""

ORACLES = {
    "chart_percentages": """SELECT o_orderpriority, round_even(count(*) / (SELECT count(*) FROM orders) * 100, 1) AS message_pct,
  floor(count(*) / (SELECT count(*) FROM orders) * 1000 + 0.5) / 10 AS chart_pct FROM orders GROUP BY 1""",
    "turn_similarity": f"""WITH t AS (SELECT conv_id, turn, {tokens('text')} AS k FROM conversations)
SELECT a.conv_id, a.turn, round(CASE WHEN len(a.k) + len(b.k) = 0 THEN 0.0 ELSE
  len(list_intersect(a.k, b.k)) / (len(a.k) + len(b.k) - len(list_intersect(a.k, b.k))) END, 6) AS similarity
FROM t a JOIN t b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1""",
    "record_hashes": f"SELECT o_orderkey, sha256({_HASHED}) AS row_hash FROM orders",
    "copied_records": f"""WITH {DOCS},
{random_part()},
tr AS (SELECT key, min(record_id) AS train_id, count(*) AS n_train_copies FROM f WHERE split = 'train' AND key IS NOT NULL GROUP BY 1)
SELECT record_id AS test_id, key, train_id, n_train_copies FROM f JOIN tr USING (key) WHERE split = 'test'""",
    "duplicate_severity": f"""WITH {DOCS},
{random_part()}
SELECT dataset, n_test, n_flagged, round(measured, 6) AS measured, CASE WHEN n_flagged > 0 THEN 'CRITICAL' ELSE 'PASS' END AS severity
FROM ({_DUP.replace("'orders'", "'documents'")})""",
    "group_leaks": f"""WITH {_OF}
SELECT group_key, count(*) FILTER (split = 'train') AS n_train, count(*) FILTER (split = 'test') AS n_test FROM f GROUP BY 1 HAVING count(DISTINCT split) = 2""",
    "group_severity": f"""WITH {_OF}
SELECT 'orders' AS dataset, n_test, n_flagged, round(measured, 6) AS measured, CASE WHEN n_flagged > 0 THEN 'HIGH' ELSE 'PASS' END AS severity FROM ({_GROUPS})""",
    "temporal": f"WITH {_OF}\nSELECT 'orders' AS dataset, * REPLACE (round(measured, 6) AS measured) FROM ({_TIME})",
    "confound": f"WITH {_OF},\n{_CELLS}\nSELECT 'orders' AS dataset, n AS n_train, k AS n_batches, m AS n_labels, round(measured, 6) AS measured, {_TIER} AS severity FROM v",
    "feature_leaks": f"WITH {_LINES},\nall_ AS ({' UNION ALL '.join(_feature(n) for n in (*_NUMBERS, 'ship_day', 'copy_of_label'))})\n"
    "SELECT 'lineitem' AS dataset, feature, round(measured, 6) AS measured, CASE WHEN measured > 0.95 THEN 'HIGH' ELSE 'PASS' END AS severity FROM all_",
    "moments": f"WITH {_LINES}\n{_moments('f')}",
    "moments_of_test_alone": f"""WITH {_LINES},
g AS (SELECT * REPLACE ('test' AS split) FROM f)
SELECT dataset, feature, severity FROM ({_moments('g')})""",
    "input_problems": f"""WITH {DOCS},
{random_part()},
a AS (SELECT * REPLACE (CASE WHEN group_key = 'src0' THEN 'holdout' ELSE split END AS split) FROM f),
x AS (SELECT * FROM a UNION ALL SELECT * REPLACE ('train' AS split) FROM a WHERE group_key = 'src1'),
per AS (SELECT record_id, count(DISTINCT split) AS s, count(*) AS n FROM x GROUP BY 1)
SELECT * FROM (SELECT 'documents' AS dataset, 'label is missing' AS rule, count(*) FILTER (label IS NULL) AS n_rows FROM x
  UNION ALL SELECT 'documents', 'split is neither train nor test', count(*) FILTER (split NOT IN ('train', 'test')) FROM x
  UNION ALL SELECT 'documents', 'record on both sides', count(*) FILTER (s > 1) FROM per
  UNION ALL SELECT 'documents', 'record id repeated', count(*) FILTER (n > 1) FROM per) WHERE n_rows > 0
UNION ALL SELECT NULL, 'weight: missing column', NULL""",
    "companion_split": """WITH l AS (SELECT doc_id, CASE WHEN quality = 1 THEN 'train' ELSE 'test' END AS split FROM labels),
u AS (SELECT * FROM l UNION ALL SELECT doc_id, 'train' FROM l WHERE doc_id % 3 = 0),
per AS (SELECT doc_id, count(*) AS n, count(DISTINCT split) AS s FROM u GROUP BY 1)
SELECT count(*) AS n_rows, count(*) FILTER (n IS NULL) AS n_unassigned, count(*) FILTER (n > 1) AS n_listed_twice, count(*) FILTER (s > 1) AS n_contradictory
FROM documents LEFT JOIN per USING (doc_id)""",
    "corpus_overlap": f"""WITH {_RUNS8.format('i', 'item_id', 'benchmark')},
{_RUNS8.format('d', 'doc_id', 'documents')},
size AS (SELECT id, count(*) AS n FROM i_runs GROUP BY 1),
met AS (SELECT i.id, d.id AS doc, count(*) / any_value(n) AS share FROM i_runs i JOIN d_runs d USING (s) JOIN size ON size.id = i.id GROUP BY 1, 2)
SELECT id AS item_id, count(*) AS n_texts, round(max(share), 6) AS fullest FROM met WHERE share >= 0.8 GROUP BY 1""",
    "near_and_far": f"""WITH {JUDGED},
{random_part()},
{neighbors()}
SELECT part AS dataset, similarity > 0.3 AS near, count(*) AS n_rows, round(avg(CAST(label = nn_label AS DOUBLE)), 6) AS "right", round(avg(similarity), 6) AS mean_similarity
FROM best WHERE measured GROUP BY 1, 2""",
    "inflation": f"""WITH {JUDGED},
{random_part()},
{neighbors()},
x AS (SELECT part, 1 - similarity AS d, CAST(label = nn_label AS DOUBLE) AS r FROM best WHERE measured)
SELECT part AS dataset, round(quantile_cont(d, 0.25), 6) AS q1, round(quantile_cont(d, 0.5), 6) AS median, round(quantile_cont(d, 0.75), 6) AS q3,
  round(corr(d, r), 6) AS correlation, round(regr_slope(r, d), 6) AS slope FROM x GROUP BY 1""",
    "findings": f"""{_FINDINGS}
SELECT 'orders' AS dataset, "check", round(measured, 6) AS measured, severity, sha256("check" || ':orders') AS finding_id FROM found""",
    "roll_up": f"""{_FINDINGS}
SELECT 'orders' AS dataset, count(*) FILTER (severity NOT IN ('PASS', 'SKIPPED')) AS n_findings,
  CASE WHEN bool_or(severity = 'CRITICAL') THEN 'CRITICAL' WHEN bool_or(severity = 'HIGH') THEN 'HIGH' WHEN bool_or(severity = 'MEDIUM') THEN 'MEDIUM' WHEN bool_or(severity = 'LOW') THEN 'LOW' ELSE 'PASS' END AS worst,
  coalesce(string_agg("check", ',' ORDER BY "check") FILTER (severity = 'PASS'), '') AS passed,
  coalesce(string_agg("check", ',' ORDER BY "check") FILTER (severity NOT IN ('PASS', 'SKIPPED')), '') AS failed,
  coalesce(string_agg("check", ',' ORDER BY "check") FILTER (severity = 'SKIPPED'), '') AS skipped FROM found""",
}
