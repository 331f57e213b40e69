"""Contract, rubric, specification and artifact queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidemark.operators import contracts as C
from tidemark.operators import editorial as E
from tidemark.plans.standins import hypotheses, out, sql, table
from tidemark.session import shared_dir
from tidemark.sources import artifacts


def _academic(s, d):
    o = table(s, d, "orders")
    k = F.col("o_orderkey")
    some = F.when(k % 6 != 0, F.array(k.cast("string"))).otherwise(F.array().cast("array<string>"))
    x = F.struct(F.when(k % 5 == 0, "GUESS").otherwise("CORRELATIONAL").alias("causal_status"), F.lit("FULL_TEXT").alias("analysis_confidence"), some.alias("source_evidence_ids"), F.when(k % 2 == 0, F.col("o_orderpriority")).alias("hypothesis"), F.when(k % 7 != 0, F.lit("c")).alias("condition"), F.lit("o").alias("outcome"), F.lit("u").alias("universe"), F.lit("h").alias("horizon"), F.lit("f").alias("falsification_criterion"), some.alias("required_data"))
    return o.select("o_orderkey", C.academic(x).alias("reasons"))


def _practitioner(s, d):
    k = F.col("o_orderkey")
    x = F.struct(F.when(k % 9 == 0, "SOME").otherwise("LOW").alias("reproducibility"), F.array(k).alias("source_evidence_ids"), (k % 2 == 0).alias("original_source"), F.when(k % 3 == 0, F.col("o_custkey").cast("string")).alias("repost_of"), F.when(k % 4 == 0, F.lit("other")).otherwise(F.col("o_custkey").cast("string")).alias("independence_key"))
    return table(s, d, "orders").select("o_orderkey", C.practitioner(x).alias("reasons"))


def _market(s, d):
    k = F.col("o_orderkey")
    some = F.when(k % 6 != 0, F.array(k.cast("string"))).otherwise(F.array().cast("array<string>"))
    x = F.struct(F.when(k % 5 == 0, "CALM").otherwise("DISPERSION").alias("state_type"), some.alias("source_evidence_ids"), F.when(k % 7 != 0, F.col("o_orderpriority")).otherwise(" ").alias("baseline"), F.when(k % 11 != 0, F.col("o_orderstatus")).alias("falsification_criterion"))
    return table(s, d, "orders").select("o_orderkey", C.market(x).alias("reasons"))


def _critic(s, d):
    k = F.col("o_orderkey")
    x = F.struct(F.when(k % 5 != 0, "REJECT").alias("disposition"), F.when(k % 6 != 0, F.array("o_orderstatus")).alias("structured_reasons"))
    return table(s, d, "orders").select("o_orderkey", C.critic(x).alias("reasons"))


def _fusion(s, d):
    g = table(s, d, "lineitem").groupBy("l_orderkey").agg(F.collect_set(F.when(F.col("l_linenumber") % 2 == 0, F.col("l_suppkey"))).alias("context_ids"), F.collect_set(F.when(F.col("l_linenumber") % 2 == 1, F.col("l_suppkey"))).alias("fresh_ids"))
    x = F.struct(F.when(F.col("l_orderkey") % 10 == 0, "MAYBE").otherwise("DISTINCT").alias("semantic_equivalence"), (F.col("l_orderkey") % 8 == 0).alias("context_is_evidence"), "context_ids", "fresh_ids")
    return g.select("l_orderkey", C.fusion(x).alias("reasons"))


def _rubric(s, d):
    t = table(s, d, "conversations").groupBy("conv_id").agg(F.min_by("text", "turn").alias("a"), F.max_by("text", "turn").alias("b"))
    k = F.col("conv_id")
    x = F.struct(F.col("a").alias("core_question"), F.when(k % 4 == 0, F.lit("The sample size was 9")).otherwise(F.lit("")).alias("finding"), F.when(k % 3 != 0, F.lit("h")).alias("hypothesis"), F.lit("m").alias("mechanism"), F.col("a").alias("source_text"), F.col("b").alias("evidence"), F.when(k % 2 == 0, "FULL_TEXT").otherwise("ABSTRACT_ONLY").alias("confidence"), F.when(k % 5 == 0, "CAUSAL").otherwise("UNKNOWN").alias("causal_status"), F.when(k % 7 != 0, F.array(F.lit("l"))).alias("limitations"), F.lit("u").alias("universe"), F.lit("h").alias("horizon"), F.array(F.lit("d")).alias("required_data"), (k % 6 != 0).alias("expected_relevant"), F.lit("m").alias("market"))
    return t.select("conv_id", C.rubric(x).alias("r")).select("conv_id", "r.*")


def _routing(s, d):
    t = table(s, d, "conversations").select(F.col("role").alias("model"), F.concat_ws("|", "conv_id", "turn").alias("case_id"), F.lit("faithfulness").alias("dimension"), (F.char_length("text") > 200).cast("double").alias("score"))
    return C.routing(E.scorecard(t), "assistant", "user")


def _specs(s, d):
    """Whether each of ten families is ready for a study, by its specification's checks."""
    specs = [C.StudySpec(family=str(k), assets=("BTC",)) for k in range(1, 11)]
    h = hypotheses(s, d)
    ids = s.createDataFrame([(x.family, x.id) for x in specs], "family string, spec_id string")
    hit = h.where("analysis_mode = 'PRODUCTION' AND disposition = 'ACCEPTED'").select(F.col("fingerprint").cast("string").alias("family"), F.lit(True).alias("ready")).distinct()
    return ids.join(hit, "family", "left").select("family", F.coalesce("ready", F.lit(False)).alias("ready"))


def _sink(s, d):
    path = f"{shared_dir(s)}/tidemark/artifacts-{uuid.uuid4().hex}"
    h = hypotheses(s, d).select(F.col("channel").alias("run_id"), "id", "fingerprint")
    artifacts.write(h, path)
    artifacts.write(h.where("run_id = 'MARKET'"), path)  # a run written again replaces itself
    return artifacts.read(s, path, "id bigint, fingerprint bigint, run_id string").select("run_id", "id", "fingerprint")


QUERIES = {
    "contract_academic": _academic,
    "contract_practitioner": _practitioner,
    "contract_fusion": _fusion,
    "contract_market": _market,
    "contract_critic": _critic,
    "rubric_flags": _rubric,
    "routing_decision": _routing,
    "spec_ready": _specs,
    "artifact_sink": lambda s, d: out(_sink(s, d)),
}

_LONG = lambda c: f"list_filter(string_split_regex(lower({c}), '\\s+'), lambda w: length(trim(w, '.,;:()')) >= 5)"

ORACLE = {
    "contract_academic": "SELECT o_orderkey, concat_ws(',', CASE WHEN o_orderkey % 5 = 0 THEN 'causal_status' END, CASE WHEN o_orderkey % 6 = 0 THEN 'evidence' END, CASE WHEN o_orderkey % 2 = 0 AND (o_orderkey % 7 = 0 OR o_orderkey % 6 = 0) THEN 'incomplete_test' END) AS reasons FROM orders",
    "contract_practitioner": "SELECT o_orderkey, concat_ws(',', CASE WHEN o_orderkey % 9 = 0 THEN 'reproducibility' END, CASE WHEN o_orderkey % 2 = 1 AND o_orderkey % 3 <> 0 THEN 'lineage' END, CASE WHEN o_orderkey % 3 = 0 AND o_orderkey % 4 = 0 THEN 'independence' END) AS reasons FROM orders",
    "contract_market": "SELECT o_orderkey, concat_ws(',', CASE WHEN o_orderkey % 5 = 0 THEN 'state_type' END, CASE WHEN o_orderkey % 6 = 0 THEN 'evidence' END, CASE WHEN o_orderkey % 7 = 0 THEN 'baseline' END, CASE WHEN o_orderkey % 11 = 0 THEN 'falsification' END) AS reasons FROM orders",
    "contract_critic": "SELECT o_orderkey, concat_ws(',', CASE WHEN o_orderkey % 5 = 0 THEN 'disposition' END, CASE WHEN o_orderkey % 6 = 0 THEN 'structured_reasons' END) AS reasons FROM orders",
    "contract_fusion": "WITH g AS (SELECT l_orderkey, coalesce(list(l_suppkey) FILTER (WHERE l_linenumber % 2 = 0), []) AS a, coalesce(list(l_suppkey) FILTER (WHERE l_linenumber % 2 = 1), []) AS b FROM lineitem GROUP BY 1) SELECT l_orderkey, concat_ws(',', CASE WHEN l_orderkey % 10 = 0 THEN 'semantic_equivalence' END, CASE WHEN l_orderkey % 8 = 0 THEN 'context_as_evidence' END, CASE WHEN list_has_any(a, b) THEN 'overlap' END) AS reasons FROM g",
    "rubric_flags": f"WITH t AS (SELECT conv_id AS k, arg_min(text, turn) AS a, arg_max(text, turn) AS b FROM conversations GROUP BY 1), u AS (SELECT *, list_has_any({_LONG('a')}, {_LONG('b')}) AS att, k % 2 <> 0 AND k % 7 <> 0 AS unk, contains(lower(a), 'sample size was') OR contains(lower(a), 'effect size was') OR k % 4 = 0 AS hal FROM t) SELECT k AS conv_id, 1 AS schema_compliance, CAST(k % 6 <> 0 AS INTEGER) AS relevance, CAST(att AND k % 5 <> 0 AND (k % 2 = 0 OR unk) AS INTEGER) AS faithfulness, CAST(att AS INTEGER) AS evidence_attribution, CAST(unk AS INTEGER) AS correct_unknown, CAST(k % 3 <> 0 AS INTEGER) AS hypothesis_specificity, CAST(k % 3 <> 0 AS INTEGER) AS falsifiability, CAST(hal AS INTEGER) AS hallucination FROM u",
    "routing_decision": "WITH s AS (SELECT avg(CAST(length(text) > 200 AS DOUBLE)) FILTER (WHERE role = 'assistant') AS a, avg(CAST(length(text) > 200 AS DOUBLE)) FILTER (WHERE role = 'user') AS u FROM conversations) SELECT CASE WHEN coalesce(a, 0) >= coalesce(u, 0) + 0.2 THEN 'USE_STRONGER' ELSE 'KEEP_USUAL' END AS decision FROM s",
    "spec_ready": sql("SELECT CAST(f AS VARCHAR) AS family, f IN (SELECT fingerprint FROM hypotheses WHERE analysis_mode = 'PRODUCTION' AND disposition = 'ACCEPTED') AS ready FROM (SELECT unnest(range(1, 11)) AS f)"),
    "artifact_sink": sql("SELECT channel AS run_id, id, fingerprint FROM hypotheses"),
}
