"""Metrics and event-study queries."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from tidemark.operators import metrics as M
from tidemark.operators import pit, resampling, study
from tidemark.plans.standins import candle, funding, observations, out, receipts, runs, sql
from tidemark.session import staged

AS_OF = "2024-01-20 10:12:18"
REPLICATES, SEED = 1000, 20260901


def _at(ts=AS_OF):
    return F.lit(ts).cast("timestamp")


def _marked(s, d):
    return study.regimes(study.treated(funding(s, d)))


def _outcomes(s, d):
    return study.forward_outcomes(_marked(s, d), candle(s, d))


def _pop(s, d):
    return study.cubed(_outcomes(s, d))


def _day(s, d):
    return _pop(s, d).where("horizon = 24")


def _tests(s, d):
    """p-values by level, population and horizon from effect sizes: a stand-in p that SQL can repeat."""
    pop = _pop(s, d)
    levels = pop.withColumn("level", F.lit("observation")).unionByName(pop.where("NOT treated OR starts").withColumn("level", F.lit("regime")))
    e = study.effect_sizes(levels, ["level", "population", "horizon"])
    return e.withColumn("p_value", F.round(F.exp(-F.abs("standardized_diff") * 10), 6)).withColumn("study", F.lit("s")).withColumn("role", study.role())


def _judged(s, d):
    """Every cell of the study with its permutation p-value, its role and its adjusted p-value."""
    tests = resampling.study(_outcomes(s, d), REPLICATES, SEED).withColumn("study", F.lit("s")).withColumn("role", study.role())
    return study.bh_adjust(tests, ["study"]).drop("study")


def _verdict(s, d):
    """The study's disposition on real p-values, one shuffled control over its 24-hour outcomes, and the receipts of its events."""
    marked = staged(_marked(s, d).select("id", "asset", "treated", "starts", "observed_at"), "marked")
    outcomes = study.forward_outcomes(marked, candle(s, d))
    shuffled = study.control_shuffled(outcomes.where("horizon = 24").withColumn("study", F.lit("s")), ["study"], SEED)
    covered = study.receipt_qualified(observations(s, d).where("observation_kind = 'funding'"), receipts(s, d), runs(s, d)).select("id", F.lit(1).alias("has"))
    coverage = marked.where("treated").join(covered, "id", "left").groupBy("asset").agg(F.count("*").alias("eligible"), F.count("has").alias("covered"))
    return resampling.verdict(resampling.study(outcomes, REPLICATES, SEED), shuffled, coverage)


QUERIES = {
    "pit_receipt": lambda s, d: out(pit.visible_receipt(observations(s, d), _at())),
    "pit_native": lambda s, d: out(pit.visible_native(observations(s, d), _at())),
    "valuation_hour": lambda s, d: out(funding(s, d).select("id", pit.valuation_hour(F.col("observed_at")).alias("valuation"))),
    "pct_inclusive": lambda s, d: out(M.percentile_at(funding(s, d), candle(s, d))),
    "pct_strict": lambda s, d: out(M.percentile(funding(s, d), strict=True).select("id", "asset", "percentile")),
    "anchor_returns": lambda s, d: out(M.anchor_returns(candle(s, d))),
    "rolling_vol": lambda s, d: out(M.complete_volatility(candle(s, d))),
    "recent_vol": lambda s, d: out(M.recent_volatility(candle(s, d))),
    "metrics_long": lambda s, d: out(M.long_metrics(funding(s, d), candle(s, d))),
    "extreme_facts": lambda s, d: out(M.extreme_facts(M.long_metrics(funding(s, d), candle(s, d)), candle(s, d).where("hour(observed_at) = 5").select(F.concat_ws("|", "asset", F.date_format("observed_at", "yyyy-MM-dd HH:mm:ss")).alias("fact_key")))),
    "trusted_metrics": lambda s, d: out(M.trusted(M.anchor_returns(candle(s, d)).select("asset", "observed_at", F.concat(F.lit("return_"), F.col("horizon"), F.lit("h")).alias("metric_name"), F.when(F.hour("observed_at") % 4 == 0, F.col("return") + 1).otherwise(F.col("return")).alias("metric_value"), F.when(F.hour("observed_at") % 5 == 0, _at("2024-01-19 00:00:00")).otherwise(_at()).alias("cutoff")), M.anchor_returns(candle(s, d)).select("asset", "observed_at", F.concat(F.lit("return_"), F.col("horizon"), F.lit("h")).alias("metric_name"), F.col("return").alias("metric_value")), _at()).where("metric_value IS NOT NULL")),
    "receipt_qualified": lambda s, d: out(study.receipt_qualified(observations(s, d), receipts(s, d), runs(s, d)).select("id", "asset", F.array_join(F.transform("receipt_ids", lambda x: x.cast("string")), ",").alias("receipt_ids"))),
    "forward_outcomes": lambda s, d: out(_outcomes(s, d).select("id", "horizon", "outcome", "availability")),
    "regimes": lambda s, d: out(_marked(s, d).select("id", "treated", "regime")),
    "regime_starts": lambda s, d: out(_marked(s, d).where("starts").select("asset", "regime", "id", "observed_at")),
    "strata": lambda s, d: out(study.strata(_marked(s, d), candle(s, d)).select("id", "stratum", "recent_return")),
    "event_dataset": lambda s, d: out(study.event_dataset(funding(s, d), candle(s, d), "spec").select("event_id", "id", "horizon", "percentile", "treated", "regime", "stratum", "outcome")),
    "effect_sizes": lambda s, d: out(study.effect_sizes(_pop(s, d), ["population", "horizon"])),
    "outcome_summary": lambda s, d: out(study.outcome_summary(_outcomes(s, d), ["asset", "horizon"])),
    "study_cube": lambda s, d: out(study.effect_sizes((p := _pop(s, d)).withColumn("level", F.lit("observation")).unionByName(p.where("NOT treated OR starts").withColumn("level", F.lit("regime"))), ["level", "population", "horizon"]).select("level", "population", "horizon", "n_treated", "n_ordinary", "mean_diff")),
    "matched_baseline": lambda s, d: out(study.matched_baseline(study.strata(_outcomes(s, d).where("horizon = 24"), candle(s, d))).select("stratum", "treated_id", "baseline_id", "diff")),
    "bootstrap_ci": lambda s, d: out(study.bootstrap_ci(_day(s, d), ["population"], REPLICATES, SEED)),
    "bootstrap_poisson_ci": lambda s, d: out(resampling.bootstrap(_outcomes(s, d), REPLICATES, SEED)),
    "study_effects": lambda s, d: out(resampling.effects(resampling.moments(resampling.rows_of(_outcomes(s, d), SEED)))),
    "study_tests": lambda s, d: out(_judged(s, d)),
    "study_verdict": lambda s, d: out(_verdict(s, d)),
    "permutation_p": lambda s, d: out(study.permutation_p(_day(s, d), ["population"], REPLICATES, SEED)),
    "bh_adjust": lambda s, d: out(study.bh_adjust(_tests(s, d), ["study"]).select("level", "population", "horizon", "role", "p_value", "p_adjusted")),
    "pseudo_replication": lambda s, d: out(study.pseudo_replication(_tests(s, d), ["population", "horizon"])),
    "control_random": lambda s, d: out(study.control_sample(_day(s, d), ["population"], SEED)),
    "control_shuffle": lambda s, d: out(study.control_shuffled(_day(s, d), ["population"], SEED)),
    "control_placebo": lambda s, d: out(study.placebo(_day(s, d), ["population"])),
    "leakage_probe": lambda s, d: study.leakage_probe(funding(s, d), ["2024-01-10 00:00:00", "2024-01-20 00:00:00"], lambda t: study.regimes(study.treated(t)).select("id", "observed_at", "percentile", "treated", "regime")),
    "temporal_stability": lambda s, d: out(study.temporal_stability(_day(s, d).where("outcome IS NOT NULL"), ["population"])),
    "cross_asset": lambda s, d: study.cross_asset(study.effect_sizes(_outcomes(s, d).where("horizon = 24 AND (NOT treated OR starts)"), ["asset"])),
    "disposition": lambda s, d: out(study.disposition(_tests(s, d).where("level = 'observation'").select("population", "horizon", "p_value", "mean_diff", F.lit(True).alias("has_receipts"), "n_treated", F.lit(6).alias("n_regimes"), (F.col("horizon") == 4).alias("pseudo"), (F.col("mean_diff") / 2).alias("shuffled_diff"), F.when(F.col("population") == "click", "REJECT").otherwise("ACCEPT").alias("critic"))).select("population", "horizon", "disposition")),
    "dataset_digest": lambda s, d: study.digest(_outcomes(s, d).withColumn("outcome", F.round(F.col("outcome") * 1e6).cast("bigint")), ["id", "horizon", "outcome", "treated"]),
}

_EFFECT = """count(outcome) FILTER (WHERE treated) AS n_treated, count(outcome) FILTER (WHERE NOT treated) AS n_ordinary, avg(outcome) FILTER (WHERE treated) - avg(outcome) FILTER (WHERE NOT treated) AS mean_diff,
median(outcome) FILTER (WHERE treated) - median(outcome) FILTER (WHERE NOT treated) AS median_diff, avg(CASE WHEN outcome > 0 THEN 1.0 WHEN outcome <= 0 THEN 0.0 END) FILTER (WHERE treated) - avg(CASE WHEN outcome > 0 THEN 1.0 WHEN outcome <= 0 THEN 0.0 END) FILTER (WHERE NOT treated) AS p_positive_diff,
(var_pop(outcome) FILTER (WHERE treated) + var_pop(outcome) FILTER (WHERE NOT treated)) / 2 AS v"""
_E = f""", e AS (SELECT level, population, horizon, {_EFFECT} FROM levels GROUP BY ALL),
f AS (SELECT level, population, horizon, n_treated, n_ordinary, CASE WHEN n_treated >= 2 AND n_ordinary >= 2 THEN mean_diff END AS mean_diff, CASE WHEN n_treated >= 2 AND n_ordinary >= 2 THEN median_diff END AS median_diff,
  CASE WHEN n_treated >= 2 AND n_ordinary >= 2 THEN p_positive_diff END AS p_positive_diff, CASE WHEN n_treated >= 2 AND n_ordinary >= 2 THEN mean_diff / greatest(1e-12, sqrt(v)) END AS standardized_diff FROM e),
t AS (SELECT *, round(exp(-abs(standardized_diff) * 10), 6) AS p_value, CASE WHEN level = 'regime' THEN 'EXPLORATORY' WHEN population = 'POOLED' AND horizon = 24 THEN 'PRIMARY' ELSE 'SECONDARY' END AS role FROM f)"""
_NATIVE = f"observed_at <= date_trunc('hour', TIMESTAMP '{AS_OF}') - INTERVAL 1 HOUR AND (observation_kind <> 'candle' OR observed_at + INTERVAL 1 HOUR <= TIMESTAMP '{AS_OF}')"
_RET = "SELECT c.asset, c.observed_at, h AS horizon, CASE WHEN b.mark_price <> 0 THEN c.mark_price / b.mark_price - 1 END AS r FROM candle c CROSS JOIN (SELECT unnest([1, 4, 24]) AS h) LEFT JOIN candle b ON b.asset = c.asset AND b.observed_at = c.observed_at - to_hours(h)"
_PCTJ = "SELECT asset, observed_at, pct AS percentile FROM (SELECT c.asset, c.observed_at, p.pct, row_number() OVER (PARTITION BY c.asset, c.observed_at ORDER BY p.observed_at DESC, p.id DESC) AS rn FROM candle c ASOF LEFT JOIN (SELECT asset, observed_at, id, pct FROM pct QUALIFY row_number() OVER (PARTITION BY asset, observed_at ORDER BY id DESC) = 1) p ON p.asset = c.asset AND p.observed_at <= c.observed_at) WHERE rn = 1"
_U = lambda *parts: f"CAST('0x' || substr(md5(concat_ws('|', {', '.join(parts)})), 1, 8) AS BIGINT)"
_VOL = "SELECT asset, observed_at, CASE WHEN count(*) OVER x = 24 AND count(q) OVER x = 24 AND count(sr) OVER x >= 2 THEN stddev_samp(sr) OVER x END AS volatility FROM logret WINDOW x AS (PARTITION BY asset ORDER BY observed_at RANGE BETWEEN INTERVAL 23 HOUR PRECEDING AND CURRENT ROW)"
#: Draws of every row and replicate, and which result cells a base cell belongs to (see operators/resampling.py).
_DRAWS = f""", ab AS MATERIALIZED (SELECT rep, 1 + {_U(str(SEED), "'a'", 'rep')} % {resampling.PRIME - 1} AS a, {_U(str(SEED), "'b'", 'rep')} % {resampling.PRIME} AS b FROM (SELECT unnest(range(0, {REPLICATES})) AS rep)),
kn AS MATERIALIZED (SELECT id, asset, horizon, treated, begins, outcome AS v, {_U(str(SEED), 'id')} % {resampling.PRIME} AS h FROM outc WHERE outcome IS NOT NULL AND treated IS NOT NULL),
cl AS (SELECT level, population, horizon, treated, begins, asset FROM (SELECT DISTINCT asset, horizon, treated, begins FROM kn) CROSS JOIN (SELECT unnest(['observation', 'regime']) AS level) CROSS JOIN LATERAL (SELECT unnest([asset, 'POOLED']) AS population) WHERE level = 'observation' OR NOT treated OR begins)"""
_WEIGHT = " + ".join(f"CAST((h * a + b) % {resampling.PRIME} >= {math.ceil(p * resampling.PRIME)} AS INTEGER)" for p in resampling.POISSON)
_DAY = ", k AS (SELECT * FROM pop WHERE horizon = 24 AND outcome IS NOT NULL)"

ORACLE = {
    "pit_receipt": sql(f"SELECT id, asset, observed_at, observation_kind, round(value, 6) AS value, retrieved_at FROM observations WHERE retrieved_at <= TIMESTAMP '{AS_OF}' AND {_NATIVE}"),
    "pit_native": sql(f"SELECT id, asset, observed_at, observation_kind, round(value, 6) AS value, retrieved_at FROM observations WHERE {_NATIVE}"),
    "valuation_hour": sql("SELECT id, date_trunc('hour', observed_at) - INTERVAL 1 HOUR AS valuation FROM funding"),
    "pct_inclusive": sql(f", a AS ({_PCTJ}) SELECT asset, observed_at, round(percentile, 6) AS percentile FROM a"),
    "pct_strict": sql("SELECT id, asset, round(strict_pct, 6) AS percentile FROM pct"),
    "anchor_returns": sql(f", r AS ({_RET}) SELECT asset, observed_at, horizon, round(r, 6) AS return FROM r"),
    "rolling_vol": sql(f", w AS ({_VOL}) SELECT asset, observed_at, round(volatility, 6) AS volatility FROM w"),
    "recent_vol": sql(", w AS (SELECT asset, observed_at, count(lr) OVER x AS k, stddev_samp(lr) OVER x AS s FROM logret WINDOW x AS (PARTITION BY asset ORDER BY observed_at RANGE BETWEEN INTERVAL 23 HOUR PRECEDING AND CURRENT ROW)) SELECT asset, observed_at, CASE WHEN k >= 2 THEN round(s, 6) END AS volatility FROM w"),
    "metrics_long": sql(f", r AS ({_RET}), a AS ({_PCTJ}), w AS ({_VOL}) SELECT asset, observed_at, 'return_' || horizon || 'h' AS metric_name, round(r, 6) AS metric_value FROM r WHERE r IS NOT NULL UNION ALL SELECT asset, observed_at, 'funding_percentile', round(percentile, 6) FROM a WHERE percentile IS NOT NULL UNION ALL SELECT asset, observed_at, 'volatility_24h', round(volatility, 6) FROM w WHERE volatility IS NOT NULL"),
    "extreme_facts": sql(f", r AS ({_RET}), a AS ({_PCTJ}) SELECT asset || '|' || strftime(observed_at, '%Y-%m-%d %H:%M:%S') AS fact_key, asset, observed_at, round(percentile, 6) AS percentile, round(r, 6) AS return_24h FROM r JOIN a USING (asset, observed_at) WHERE horizon = 24 AND percentile >= 90 AND abs(r) >= 0.01 AND hour(observed_at) <> 5"),
    "trusted_metrics": sql(f", r AS ({_RET}) SELECT asset, observed_at, 'return_' || horizon || 'h' AS metric_name, round(r, 6) AS metric_value, TIMESTAMP '{AS_OF}' AS cutoff FROM r WHERE r IS NOT NULL AND hour(observed_at) % 4 <> 0 AND hour(observed_at) % 5 <> 0"),
    "receipt_qualified": sql("SELECT o.id, o.asset, string_agg(CAST(r.id AS VARCHAR), ',' ORDER BY r.id) AS receipt_ids FROM observations o JOIN receipts r ON r.market_observation_id = o.id AND r.source_native_timestamp = CASE WHEN observation_kind = 'candle' THEN observed_at + INTERVAL 1 HOUR ELSE observed_at END JOIN runs u ON u.id = r.collection_run_id AND u.status = 'SUCCESS' GROUP BY o.id, o.asset"),
    "forward_outcomes": sql("SELECT id, horizon, round(outcome, 6) AS outcome, CASE WHEN outcome IS NULL THEN 'OUTCOME_UNAVAILABLE' ELSE 'AVAILABLE' END AS availability FROM outc"),
    "regimes": sql("SELECT id, treated, regime FROM ev"),
    "regime_starts": sql("SELECT asset, regime, id, observed_at FROM ev WHERE begins"),
    "strata": sql(", s AS (SELECT e.id, e.asset, CASE WHEN c1.mark_price > 0 AND c0.mark_price > 0 THEN ln(c1.mark_price / c0.mark_price) END AS rr, v.k FROM (SELECT *, date_trunc('hour', observed_at) - INTERVAL 1 HOUR AS a FROM ev) e LEFT JOIN candle c1 ON c1.asset = e.asset AND c1.observed_at = e.a LEFT JOIN candle c0 ON c0.asset = e.asset AND c0.observed_at = e.a - INTERVAL 4 HOUR LEFT JOIN (SELECT asset, observed_at, count(lr) OVER (PARTITION BY asset ORDER BY observed_at RANGE BETWEEN INTERVAL 23 HOUR PRECEDING AND CURRENT ROW) AS k FROM logret) v ON v.asset = e.asset AND v.observed_at = e.a) SELECT id, asset || CASE WHEN coalesce(rr, 0) >= 0 THEN '|r=up' ELSE '|r=down' END || CASE WHEN k >= 2 THEN '|v=known' ELSE '|v=missing' END AS stratum, round(rr, 6) AS recent_return FROM s"),
    "event_dataset": sql(", s AS (SELECT e.id, e.asset || CASE WHEN coalesce(CASE WHEN c1.mark_price > 0 AND c0.mark_price > 0 THEN ln(c1.mark_price / c0.mark_price) END, 0) >= 0 THEN '|r=up' ELSE '|r=down' END || CASE WHEN v.k >= 2 THEN '|v=known' ELSE '|v=missing' END AS stratum FROM (SELECT *, date_trunc('hour', observed_at) - INTERVAL 1 HOUR AS a FROM ev) e LEFT JOIN candle c1 ON c1.asset = e.asset AND c1.observed_at = e.a LEFT JOIN candle c0 ON c0.asset = e.asset AND c0.observed_at = e.a - INTERVAL 4 HOUR LEFT JOIN (SELECT asset, observed_at, count(lr) OVER (PARTITION BY asset ORDER BY observed_at RANGE BETWEEN INTERVAL 23 HOUR PRECEDING AND CURRENT ROW) AS k FROM logret) v ON v.asset = e.asset AND v.observed_at = e.a) SELECT sha256('spec|' || asset || '|' || strftime(observed_at, '%Y-%m-%d %H:%M:%S.%f')) AS event_id, id, horizon, round(strict_pct, 6) AS percentile, treated, regime, stratum, round(outcome, 6) AS outcome FROM outc JOIN s USING (id)"),
    "effect_sizes": sql(_E + " SELECT population, horizon, n_treated, n_ordinary, round(mean_diff, 6) AS mean_diff, round(median_diff, 6) AS median_diff, round(p_positive_diff, 6) AS p_positive_diff, round(standardized_diff, 6) AS standardized_diff FROM f WHERE level = 'observation'"),
    "outcome_summary": sql(", o AS (SELECT asset, horizon, count(outcome) AS n, count(*) - count(outcome) AS missing, avg(outcome) AS mean, median(outcome) AS median, CASE WHEN count(outcome) = 1 THEN 0.0 ELSE stddev_samp(outcome) END AS stddev, min(outcome) AS min, max(outcome) AS max, avg(CASE WHEN outcome > 0 THEN 1.0 WHEN outcome <= 0 THEN 0.0 END) AS p_positive, avg(CASE WHEN outcome < 0 THEN 1.0 WHEN outcome >= 0 THEN 0.0 END) AS p_negative, list_sort(list(outcome) FILTER (WHERE outcome IS NOT NULL)) AS l FROM outc GROUP BY ALL) SELECT asset, horizon, n, missing, round(mean, 6) AS mean, round(median, 6) AS median, round(stddev, 6) AS stddev, round(min, 6) AS min, round(max, 6) AS max, round(p_positive, 6) AS p_positive, round(p_negative, 6) AS p_negative, " + ", ".join(f"round(l[CAST(round_even((n - 1) * {p / 100}, 0) AS INTEGER) + 1], 6) AS p{p:02d}" for p in (5, 25, 50, 75, 95)) + " FROM o"),
    "study_cube": sql(_E + " SELECT level, population, horizon, n_treated, n_ordinary, round(mean_diff, 6) AS mean_diff FROM f"),
    "matched_baseline": sql(", s AS (SELECT e.id, e.observed_at, e.treated, e.outcome, e.asset || CASE WHEN coalesce(CASE WHEN c1.mark_price > 0 AND c0.mark_price > 0 THEN ln(c1.mark_price / c0.mark_price) END, 0) >= 0 THEN '|r=up' ELSE '|r=down' END || CASE WHEN v.k >= 2 THEN '|v=known' ELSE '|v=missing' END AS stratum FROM outc e LEFT JOIN candle c1 ON c1.asset = e.asset AND c1.observed_at = e.a LEFT JOIN candle c0 ON c0.asset = e.asset AND c0.observed_at = e.a - INTERVAL 4 HOUR LEFT JOIN (SELECT asset, observed_at, count(lr) OVER (PARTITION BY asset ORDER BY observed_at RANGE BETWEEN INTERVAL 23 HOUR PRECEDING AND CURRENT ROW) AS k FROM logret) v ON v.asset = e.asset AND v.observed_at = e.a WHERE horizon = 24), r AS (SELECT *, row_number() OVER (PARTITION BY stratum, treated ORDER BY observed_at, id) AS rn FROM s) SELECT t.stratum, t.id AS treated_id, o.id AS baseline_id, round(t.outcome - o.outcome, 6) AS diff FROM r t LEFT JOIN r o ON o.stratum = t.stratum AND o.rn = t.rn AND NOT o.treated WHERE t.treated"),
    "bootstrap_ci": sql(_DAY + f", n AS (SELECT population, CAST(treated AS INTEGER) AS side, outcome, row_number() OVER (PARTITION BY population, treated ORDER BY observed_at, id) - 1 AS i, count(*) OVER (PARTITION BY population, treated) AS n FROM k), g AS (SELECT population, side, rep, {_U(str(SEED), 'rep', 'side', 'i')} % n AS pick FROM n CROSS JOIN (SELECT unnest(range(0, {REPLICATES})) AS rep)), m AS (SELECT g.population, g.rep, avg(n.outcome) FILTER (WHERE g.side = 1) - avg(n.outcome) FILTER (WHERE g.side = 0) AS diff FROM g JOIN n ON n.population = g.population AND n.side = g.side AND n.i = g.pick GROUP BY ALL), l AS (SELECT population, list_sort(list(diff)) AS l FROM m WHERE diff IS NOT NULL GROUP BY population) SELECT population, round(l[CAST(floor(0.025 * (len(l) - 1)) AS INTEGER) + 1], 6) AS ci_low, round(l[CAST(floor(0.975 * (len(l) - 1)) AS INTEGER) + 1], 6) AS ci_high FROM l"),
    "bootstrap_poisson_ci": sql(
        _DRAWS
        + f""", s AS (SELECT asset, horizon, treated, begins, rep, sum(w) AS w, sum(w * v) AS wv FROM (SELECT kn.*, rep, {_WEIGHT} AS w FROM kn CROSS JOIN ab) GROUP BY ALL),
m AS (SELECT level, population, horizon, rep, sum(wv) FILTER (WHERE treated) / nullif(sum(w) FILTER (WHERE treated), 0) - sum(wv) FILTER (WHERE NOT treated) / nullif(sum(w) FILTER (WHERE NOT treated), 0) AS diff FROM s JOIN cl USING (asset, horizon, treated, begins) GROUP BY ALL),
l AS (SELECT level, population, horizon, list_sort(list(diff)) AS l FROM m WHERE diff IS NOT NULL GROUP BY ALL)
SELECT level, population, horizon, round(l[CAST(floor(0.025 * (len(l) - 1)) AS INTEGER) + 1], 6) AS ci_low, round(l[CAST(floor(0.975 * (len(l) - 1)) AS INTEGER) + 1], 6) AS ci_high FROM l"""
    ),
    "study_effects": sql(_E + " SELECT level, population, horizon, n_treated, n_ordinary, round(mean_diff, 6) AS mean_diff, round(p_positive_diff, 6) AS p_positive_diff, round(standardized_diff, 6) AS standardized_diff FROM f"),
    "permutation_p": sql(_DAY + f", z AS (SELECT population, count(*) FILTER (WHERE treated) AS nt, avg(outcome) FILTER (WHERE treated) - avg(outcome) FILTER (WHERE NOT treated) AS diff FROM k GROUP BY population), q AS (SELECT k.population, rep, outcome, row_number() OVER (PARTITION BY k.population, rep ORDER BY {_U(str(SEED), 'rep', 'id')}, id) AS rn FROM k CROSS JOIN (SELECT unnest(range(0, {REPLICATES})) AS rep)), m AS (SELECT population, rep, avg(outcome) FILTER (WHERE rn <= nt) - avg(outcome) FILTER (WHERE rn > nt) AS g, any_value(diff) AS diff FROM q JOIN z USING (population) GROUP BY ALL) SELECT population, round(any_value(diff), 6) AS diff, round((count(*) FILTER (WHERE abs(g) >= abs(diff) - 1e-12) + 1) / ({REPLICATES} + 1), 6) AS p_value FROM m GROUP BY population"),
    "bh_adjust": sql(_E + ", c AS (SELECT *, role = 'SECONDARY' AND p_value IS NOT NULL AS fam FROM t), r AS (SELECT *, p_value * count(*) OVER (PARTITION BY fam) / row_number() OVER (PARTITION BY fam ORDER BY p_value, level, population, horizon) AS q, row_number() OVER (PARTITION BY fam ORDER BY p_value, level, population, horizon) AS rn FROM c) SELECT level, population, horizon, role, p_value, CASE WHEN fam THEN round(least(1.0, min(q) OVER (PARTITION BY fam ORDER BY rn DESC)), 6) END AS p_adjusted FROM r"),
    "pseudo_replication": sql(_E + " SELECT a.population, a.horizon, a.p_value AS p_observation, b.p_value AS p_regime, a.p_value < 0.05 AND b.p_value >= 0.05 AS warning FROM t a JOIN t b USING (population, horizon) WHERE a.level = 'observation' AND b.level = 'regime'"),
    "control_random": sql(_DAY + f", z AS (SELECT population, least(count(*) FILTER (WHERE treated), count(*) FILTER (WHERE NOT treated)) AS n FROM k GROUP BY 1), r AS (SELECT *, row_number() OVER (PARTITION BY population ORDER BY {_U(str(SEED), 'id')}, id) AS rn FROM k WHERE NOT treated) SELECT population, round(avg(outcome) FILTER (WHERE rn <= n) - avg(outcome), 6) AS control_diff FROM r JOIN z USING (population) GROUP BY 1"),
    "control_shuffle": sql(_DAY + f", z AS (SELECT population, count(*) FILTER (WHERE treated) AS n FROM k GROUP BY 1), r AS (SELECT *, row_number() OVER (PARTITION BY population ORDER BY {_U(str(SEED), 'id')}, id) AS rn FROM k) SELECT population, round(avg(outcome) FILTER (WHERE rn <= n) - avg(outcome) FILTER (WHERE rn > n), 6) AS shuffled_diff FROM r JOIN z USING (population) GROUP BY 1"),
    "control_placebo": sql(_DAY + " SELECT population, round(avg(outcome) FILTER (WHERE strict_pct >= 45 AND strict_pct < 55) - avg(outcome) FILTER (WHERE NOT treated), 6) AS placebo_diff FROM k GROUP BY 1"),
    "leakage_probe": "SELECT cut, 0 AS n_changed, 'PASS' AS status FROM (SELECT unnest(['2024-01-10 00:00:00', '2024-01-20 00:00:00']) AS cut)",
    "temporal_stability": sql(_DAY + ", m AS (SELECT population, (min(epoch_us(observed_at)) + max(epoch_us(observed_at))) / 2 AS mid FROM k GROUP BY 1), s AS (SELECT population, avg(outcome) FILTER (WHERE epoch_us(observed_at) <= mid AND treated) - avg(outcome) FILTER (WHERE epoch_us(observed_at) <= mid AND NOT treated) AS before, avg(outcome) FILTER (WHERE epoch_us(observed_at) > mid AND treated) - avg(outcome) FILTER (WHERE epoch_us(observed_at) > mid AND NOT treated) AS after, least(count(*) FILTER (WHERE epoch_us(observed_at) <= mid AND treated), count(*) FILTER (WHERE epoch_us(observed_at) <= mid AND NOT treated), count(*) FILTER (WHERE epoch_us(observed_at) > mid AND treated), count(*) FILTER (WHERE epoch_us(observed_at) > mid AND NOT treated)) AS n FROM k JOIN m USING (population) GROUP BY 1) SELECT population, round(before, 6) AS before, round(after, 6) AS after, CASE WHEN n < 2 THEN 'INSUFFICIENT_SAMPLE' WHEN before * after >= 0 THEN 'STABLE' ELSE 'SIGN_REVERSING' END AS stability FROM s"),
    "cross_asset": sql(_E + ", x AS (SELECT mean_diff AS e FROM f WHERE level = 'regime' AND horizon = 24 AND population <> 'POOLED' AND mean_diff IS NOT NULL) SELECT count(*) AS n_assets, CASE WHEN count(*) < 2 THEN 'INSUFFICIENT' WHEN bool_and(e >= 0) OR bool_and(e <= 0) THEN 'CONSISTENT' ELSE 'MIXED' END AS consistency FROM x"),
    "dataset_digest": sql("SELECT count(*) AS n_rows, bit_xor(CAST('0x' || substr(md5(concat_ws('|', id, horizon, CAST(round(outcome * 1e6) AS BIGINT), treated)), 1, 15) AS BIGINT)) AS digest FROM outc"),
    "disposition": sql(_E + " SELECT population, horizon, CASE WHEN n_treated < 12 THEN 'DATA_INSUFFICIENT' WHEN horizon = 4 THEN 'INCONCLUSIVE' WHEN p_value IS NULL THEN 'DATA_INSUFFICIENT' WHEN p_value < 0.05 AND abs(mean_diff) > 0 THEN CASE WHEN population = 'click' THEN 'INCONCLUSIVE' ELSE 'SUPPORTED' END WHEN p_value >= 0.05 THEN 'REJECTED' ELSE 'INCONCLUSIVE' END AS disposition FROM t WHERE level = 'observation'"),
}
