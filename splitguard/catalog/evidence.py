"""Registered queries on features that give the label away, gaps in time, an outer corpus and stored findings, and their comparison SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from splitguard.catalog.checks import _CELLS, _DUP, _GROUPS, _HASHED, _LINES, _NUMBERS, _OF, _TIER, _TIME, _feature, split_lines, split_orders
from splitguard.catalog.frames import table
from splitguard.catalog.oracles import norm, random_part
from splitguard.operators import corpus, extended, gaps, target
from splitguard.operators.splits import random_split
from splitguard.sources.evidence import append_evidence, content_hash, evidence
from splitguard.storage import materialize, shared_folder

_DIGITS = 6
FEATURES = [*_NUMBERS, "ship_day", "copy_of_label"]
GAP_DAYS = 2
SETTINGS = {"frac": 0.2, "seed": 42}


def _rounded(frame, *names):
    return frame.withColumns({n: F.round(n, _DIGITS) for n in names})


def target_leaks(spark, sf_dir):
    """Features of line items against the return flag; one of them is the flag itself."""
    found = target.target_leaks(materialize(split_lines(spark, sf_dir), "lines"), FEATURES)
    return _rounded(found, "auroc", "information").drop("dataset")


def target_information(spark, sf_dir):
    """The same features against the price, a label with very many values."""
    lines = materialize(split_lines(spark, sf_dir).withColumn("label", F.col("l_extendedprice")), "lines")
    return _rounded(target.mutual_information(lines, FEATURES), "information").drop("dataset")


def leak_evidence(spark, sf_dir):
    lines = materialize(split_lines(spark, sf_dir), "lines")
    return target.leak_evidence(lines, target.target_leaks(lines, FEATURES)).drop("dataset")


def _events(spark, sf_dir):
    return table(spark, sf_dir, "events").select(
        F.lit("events").alias("dataset"), F.col("event_id").alias("record_id"), F.col("ts").alias("time"), F.col("user_id").alias("group_key")
    )


def _windowed(spark, sf_dir):
    """A third of the users have the 10th to the 14th of each month as test."""
    inside = (F.dayofmonth("time").between(10, 14)) & (F.col("group_key") % 3 == 0)
    return _events(spark, sf_dir).withColumn("split", F.when(inside, "test").otherwise("train"))


def train_gaps(spark, sf_dir):
    found = gaps.train_gaps(random_split(_events(spark, sf_dir)), GAP_DAYS)
    return found.withColumns({c: F.date_format(c, "yyyy-MM-dd") for c in ("last_day", "next_day")}).drop("dataset")


def gap_check(spark, sf_dir):
    return _rounded(gaps.gap_check(_windowed(spark, sf_dir), GAP_DAYS), "measured")


def _hits(spark, sf_dir):
    return corpus.corpus_hits(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents"), "item_id", "doc_id")


def corpus_hits(spark, sf_dir):
    """Benchmark items found in documents, at 80 % of the words over 90 % of the item."""
    return _rounded(_hits(spark, sf_dir), "overlap", "coverage")


def corpus_contamination(spark, sf_dir):
    return _rounded(corpus.corpus_contamination(table(spark, sf_dir, "benchmark"), _hits(spark, sf_dir), "item_id"), "coverage")


def evidence_store(spark, sf_dir):
    """Findings on orders, appended to a store twice."""
    frame = materialize(split_orders(spark, sf_dir), "orders")
    checks = {
        "duplicates": (extended.duplicate_severity(frame), "share of test rows", 0.0), "groups": (extended.group_severity(frame), "share of test rows", 0.0),
        "temporal": (extended.temporal_check(frame).drop("last_train", "first_test"), "share of test rows", None), "confound": (extended.confound_check(frame), "Cramer's V", 0.2),
    }
    inputs = table(spark, sf_dir, "orders").agg(F.lit("orders").alias("dataset"), content_hash(table(spark, sf_dir, "orders"), "o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority").alias("input_hash"))
    rows = materialize(evidence(checks, inputs, extended.settings_hash(SETTINGS)), "findings")
    path = f"{shared_folder(spark).rstrip('/')}/splitguard/{uuid.uuid4().hex}/store"
    append_evidence(rows, path)
    return _rounded(append_evidence(rows, path), "measured")


QUERIES = {f.__name__: f for f in (target_leaks, target_information, leak_evidence, train_gaps, gap_check, corpus_hits, corpus_contamination, evidence_store)}


def _information(label: str) -> str:
    """mi: feature, n_rows, information; ``label`` is the class of a row of f."""
    values = " UNION ALL ".join(f"SELECT '{n}' AS feature, CAST({n} AS DOUBLE) AS v, {label} AS c FROM f WHERE split = 'train'" for n in FEATURES)
    return f"""x AS ({values}),
q AS (SELECT feature, quantile_cont(v, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS cuts FROM x GROUP BY 1),
b AS (SELECT feature, len([k FOR k IN cuts IF v > k]) AS b, c FROM x JOIN q USING (feature)),
t AS (SELECT feature, count(*) AS n FROM b GROUP BY 1),
hb AS (SELECT feature, -sum(p * ln(p)) AS h FROM (SELECT feature, count(*) / any_value(n) AS p FROM b JOIN t USING (feature) GROUP BY feature, b) GROUP BY 1),
hc AS (SELECT feature, -sum(p * ln(p)) AS h FROM (SELECT feature, count(*) / any_value(n) AS p FROM b JOIN t USING (feature) GROUP BY feature, c) GROUP BY 1),
hbc AS (SELECT feature, -sum(p * ln(p)) AS h FROM (SELECT feature, count(*) / any_value(n) AS p FROM b JOIN t USING (feature) GROUP BY feature, b, c) GROUP BY 1),
mi AS (SELECT feature, n AS n_rows, CASE WHEN hc.h > 0 THEN greatest(0.0, hb.h + hc.h - hbc.h) / hc.h END AS information FROM t JOIN hb USING (feature) JOIN hc USING (feature) JOIN hbc USING (feature))"""


_RANKED = " UNION ALL ".join(_feature(n) for n in FEATURES)
_LEAKS = f"""{_LINES},
{_information('label')},
leaks AS (SELECT feature, n_rows, measured AS auroc, information, CASE WHEN measured > 0.95 OR information > 0.8 THEN 'CRITICAL' ELSE 'PASS' END AS severity
  FROM mi JOIN ({_RANKED}) USING (feature))"""
_EVENTS = "ev AS (SELECT 'events' AS part, event_id AS record_id, CAST(ts AS DATE) AS day, user_id AS entity FROM events)"
_GAPS = f"""tr AS (SELECT DISTINCT entity, day FROM f WHERE split = 'train'),
steps AS (SELECT entity, lag(day) OVER (PARTITION BY entity ORDER BY day) AS last_day, day AS next_day FROM tr),
g AS (SELECT entity, last_day, next_day, CAST(next_day - last_day AS INTEGER) AS gap_days,
  (SELECT count(*) FROM f WHERE f.entity = steps.entity AND split = 'test' AND day > last_day AND day < next_day) AS n_test_inside
  FROM steps WHERE next_day - last_day > {GAP_DAYS})"""
_WORDS = f"SELECT {{0}} AS id, [x FOR x IN string_split({norm('text')}, ' ') IF x <> ''] AS w FROM {{1}}"
_HITS = f"""iw AS ({_WORDS.format('item_id', 'benchmark')}), dw AS ({_WORDS.format('doc_id', 'documents')}),
ir AS (SELECT id, len(w) AS n, i, array_to_string(w[i:i + 7], ' ') AS s FROM (SELECT id, w, unnest(range(1, greatest(len(w) - 7, 1) + 1)) AS i FROM iw WHERE len(w) > 0)),
dr AS (SELECT DISTINCT id, array_to_string(w[i:i + 7], ' ') AS s FROM (SELECT id, w, unnest(range(1, greatest(len(w) - 7, 1) + 1)) AS i FROM dw WHERE len(w) > 0)),
m AS (SELECT ir.id AS item_id, dr.id AS doc_id, n, i, least(8, n) AS k, i - lag(i) OVER (PARTITION BY ir.id, dr.id ORDER BY i) AS step FROM ir JOIN dr USING (s)),
st AS (SELECT *, count(*) FILTER (step IS NULL OR step > k + 8) OVER (PARTITION BY item_id, doc_id ORDER BY i) AS stretch FROM m),
covered AS (SELECT DISTINCT item_id, doc_id, stretch, n, unnest(range(i, i + k)) AS word FROM st),
sp AS (SELECT item_id, doc_id, stretch, any_value(n) AS n, min(word) AS first_word, max(word) AS last_word, count(*) AS matched FROM covered GROUP BY 1, 2, 3),
best AS (SELECT * FROM sp QUALIFY row_number() OVER (PARTITION BY item_id, doc_id ORDER BY last_word - first_word DESC, first_word) = 1),
hits AS (SELECT item_id, doc_id, CAST(first_word AS INTEGER) AS first_word, CAST(last_word AS INTEGER) AS last_word, matched / (last_word - first_word + 1) AS overlap, (last_word - first_word + 1) / n AS coverage
  FROM best WHERE overlap >= 0.8 AND coverage >= 0.9)"""

ORACLES = {
    "target_leaks": f"WITH {_LEAKS}\nSELECT feature, n_rows, round(auroc, 6) AS auroc, round(information, 6) AS information, severity FROM leaks",
    "target_information": f"""WITH {_LINES},
{_information("(SELECT len([k FOR k IN cuts IF l_extendedprice > k]) FROM (SELECT quantile_cont(l_extendedprice, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS cuts FROM f WHERE split = 'train'))")}
SELECT feature, n_rows, round(information, 6) AS information FROM mi""",
    "leak_evidence": f"""WITH {_LEAKS},
v AS ({" UNION ALL ".join(f"SELECT '{n}' AS feature, record_id, CAST({n} AS DOUBLE) AS value, label FROM f WHERE split = 'train'" for n in FEATURES)})
SELECT feature, record_id, value, label FROM v JOIN leaks USING (feature) WHERE severity = 'CRITICAL'
QUALIFY row_number() OVER (PARTITION BY feature, label ORDER BY md5(record_id), record_id) <= 3""",
    "train_gaps": f"WITH {_EVENTS},\n{random_part(base='ev')},\n{_GAPS}\nSELECT * REPLACE (strftime(last_day, '%Y-%m-%d') AS last_day, strftime(next_day, '%Y-%m-%d') AS next_day) FROM g",
    "gap_check": f"""WITH {_EVENTS},
f AS (SELECT *, CASE WHEN day(day) BETWEEN 10 AND 14 AND entity % 3 = 0 THEN 'test' ELSE 'train' END AS split FROM ev),
{_GAPS},
span AS (SELECT count(*) AS n_entities, sum(s) AS s FROM (SELECT entity, max(day) - min(day) AS s FROM tr GROUP BY 1))
SELECT 'events' AS dataset, any_value(n_entities) AS n_entities, CAST(count(entity) AS BIGINT) AS n_gaps, coalesce(max(gap_days), 0) AS longest_days, CAST(coalesce(sum(n_test_inside), 0) AS BIGINT) AS n_test_inside,
  round(coalesce(sum(gap_days), 0) / any_value(s), 6) AS measured, CASE WHEN sum(n_test_inside) > 0 THEN 'MEDIUM' WHEN count(entity) > 0 THEN 'LOW' ELSE 'PASS' END AS severity FROM span LEFT JOIN g ON true""",
    "corpus_hits": f"WITH {_HITS}\nSELECT * REPLACE (round(overlap, 6) AS overlap, round(coverage, 6) AS coverage) FROM hits",
    "corpus_contamination": f"""WITH {_HITS}
SELECT item_id, count(doc_id) AS n_texts, round(max(coverage), 6) AS coverage, CASE WHEN count(doc_id) > 0 THEN 'HIGH' ELSE 'PASS' END AS severity
FROM benchmark LEFT JOIN hits USING (item_id) GROUP BY 1""",
    "evidence_store": f"""WITH {_OF},
{_CELLS},
d AS ({_DUP}), g AS ({_GROUPS}), t AS ({_TIME}),
found AS (
  SELECT 'duplicates' AS "check", CASE WHEN n_flagged > 0 THEN 'CRITICAL' ELSE 'PASS' END AS severity, 'share of test rows' AS metric, 0.0 AS threshold, measured,
    '{{"n_test":' || n_test || ',"n_flagged":' || n_flagged || '}}' AS evidence FROM d
  UNION ALL SELECT 'groups', CASE WHEN n_flagged > 0 THEN 'HIGH' ELSE 'PASS' END, 'share of test rows', 0.0, measured, '{{"n_test":' || n_test || ',"n_flagged":' || n_flagged || '}}' FROM g
  UNION ALL SELECT 'temporal', severity, 'share of test rows', NULL, measured, '{{"n_test":' || n_test || ',"n_flagged":' || n_flagged || '}}' FROM t
  UNION ALL SELECT 'confound', {_TIER}, 'Cramer''s V', 0.2, measured, '{{"n_train":' || n || ',"n_batches":' || k || ',"n_labels":' || m || '}}' FROM v),
i AS (SELECT sha256(count(*) || ':' || sum(CAST('0x' || sha256({_HASHED})[1:15] AS BIGINT))) AS input_hash, sha256('{{"frac": 0.2, "seed": 42}}') AS settings_hash FROM orders)
SELECT 'orders' AS dataset, "check", severity, metric, CAST(threshold AS DOUBLE) AS threshold, round(measured, 6) AS measured, evidence, input_hash, settings_hash, '1' AS code_version,
  sha256("check" || ':orders:' || input_hash || ':' || settings_hash || ':1') AS finding_id FROM found, i""",
}
