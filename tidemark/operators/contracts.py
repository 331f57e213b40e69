"""Contracts on analyst outputs and study specifications: why a row fails, as names joined by commas (empty: it passes)."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.editorial import reasons

#: Allowed values (fixed).
CAUSAL = ["CAUSAL", "CORRELATIONAL", "UNKNOWN"]
CONFIDENCE = ["FULL_TEXT", "ABSTRACT_ONLY", "METADATA_ONLY"]
REPRODUCIBILITY = ["HIGH", "MEDIUM", "LOW", "UNKNOWN"]
STATES = ["EXTREME_STATE", "PERSISTENT_REGIME", "CHANGE", "DISPERSION", "RETURN_DIVERGENCE", "VOLATILITY_REGIME"]
VERDICTS = ["ACCEPT_FOR_EMPIRICAL_TEST", "DOWNGRADE", "REJECT", "REQUEST_DATA", "NEEDS_REFORMULATION"]
EQUIVALENCE = ["SAME_FAMILY", "DISTINCT", "CONFLICTING"]


def blank(c: Column) -> Column:
    return F.trim(F.coalesce(c, F.lit(""))) == ""


def outside(c: Column, values: list[str]) -> Column:
    return c.isNull() | ~c.isin(values)


def none_of(c: Column) -> Column:
    return F.coalesce(F.size(c), F.lit(0)) <= 0


def injected(text: Column) -> Column:
    return F.lower(F.coalesce(text, F.lit(""))).rlike("ignore previous instructions|ignore all rules")


def academic(x: Column) -> Column:
    """Enumerations, evidence, and, where a hypothesis is given, its complete test contract."""
    fields = [blank(x[c]) for c in ("condition", "outcome", "universe", "horizon", "falsification_criterion")]
    open_ = fields[0] | fields[1] | fields[2] | fields[3] | fields[4] | none_of(x["required_data"])
    return reasons(causal_status=outside(x["causal_status"], CAUSAL), analysis_confidence=outside(x["analysis_confidence"], CONFIDENCE), evidence=none_of(x["source_evidence_ids"]), incomplete_test=~blank(x["hypothesis"]) & open_, injection=injected(F.to_json(x)))


def practitioner(x: Column) -> Column:
    """Reposts name their origin, and their independence key is that origin."""
    repost = ~blank(x["repost_of"])
    return reasons(reproducibility=outside(x["reproducibility"], REPRODUCIBILITY), evidence=none_of(x["source_evidence_ids"]), lineage=~x["original_source"] & ~repost, independence=repost & (x["independence_key"] != x["repost_of"]))


def market(x: Column) -> Column:
    return reasons(state_type=outside(x["state_type"], STATES), evidence=none_of(x["source_evidence_ids"]), baseline=blank(x["baseline"]), falsification=blank(x["falsification_criterion"]))


def critic(x: Column) -> Column:
    return reasons(disposition=outside(x["disposition"], VERDICTS), structured_reasons=none_of(x["structured_reasons"]))


def fusion(x: Column) -> Column:
    """Context never counts as evidence, and no id is both."""
    return reasons(semantic_equivalence=outside(x["semantic_equivalence"], EQUIVALENCE), context_as_evidence=x["context_is_evidence"], overlap=F.arrays_overlap(x["context_ids"], x["fresh_ids"]))


def rubric(x: Column) -> Column:
    """Eight 0/1 flags of an output: schema, relevance, faithfulness, attribution, correct unknown, specificity, falsifiability, hallucination."""
    flag = lambda c, name: F.coalesce(c, F.lit(False)).cast("int").alias(name)
    text = F.lower(F.concat_ws(" ", x["core_question"], x["finding"], x["hypothesis"], x["mechanism"]))
    words = lambda c: F.filter(F.split(F.lower(c), r"\s+"), lambda w: F.char_length(F.btrim(w, F.lit(".,;:()"))) >= 5)
    attributed = F.arrays_overlap(words(F.coalesce(x["source_text"], x["evidence"])), words(x["evidence"]))
    unknown = (x["confidence"] != "FULL_TEXT") & ~none_of(x["limitations"])
    testable = ~blank(x["universe"]) & ~blank(x["horizon"]) & ~none_of(x["required_data"]) & ~blank(x["hypothesis"])
    faithful = attributed & (x["causal_status"] != "CAUSAL") & ((x["confidence"] == "FULL_TEXT") | unknown)
    return F.struct(F.lit(1).alias("schema_compliance"), flag(x["expected_relevant"] & ~blank(x["market"]), "relevance"), flag(faithful, "faithfulness"), flag(attributed, "evidence_attribution"), flag(unknown, "correct_unknown"), flag(testable, "hypothesis_specificity"), flag(testable, "falsifiability"), flag(text.contains("sample size was") | text.contains("effect size was"), "hallucination"))


def routing(scores: DataFrame, stronger: str, usual: str, dimension: str = "faithfulness", gain: float = 0.2) -> DataFrame:
    """Whether the stronger model gains enough on the dimension. scores: model, dimension, mean_score."""
    at = lambda m: F.coalesce(F.max(F.when((F.col("model") == m) & (F.col("dimension") == dimension), F.col("mean_score"))), F.lit(0.0))
    return scores.agg(F.when(at(stronger) >= at(usual) + gain, "USE_STRONGER").otherwise("KEEP_USUAL").alias("decision"))


@dataclass(frozen=True)
class StudySpec:
    """Parameters of a study; its id is the SHA-256 of their canonical JSON."""

    family: str
    assets: tuple[str, ...]
    horizons: tuple[int, ...] = (1, 4, 24)
    outcome: str = "log_return"
    start: str = ""
    end: str = ""
    known_assets: tuple[str, ...] = ()

    def __post_init__(self):
        if self.outcome != "log_return":
            raise ValueError("only log returns are supported")
        if not self.assets or self.known_assets and not set(self.assets) <= set(self.known_assets):
            raise ValueError("assets must be known")
        if not self.horizons or min(self.horizons) <= 0:
            raise ValueError("horizons must be positive")
        if self.start and self.end and self.start >= self.end:
            raise ValueError("the study must end after it starts")

    @property
    def id(self) -> str:
        return hashlib.sha256(json.dumps(asdict(self), sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def ready(hypotheses: DataFrame, spec: StudySpec, mode: str = "PRODUCTION") -> bool:
    """Whether a hypothesis of the spec's family and mode is ready for the test."""
    hit = (F.col("fingerprint").cast("string") == spec.family) & (F.col("analysis_mode") == mode) & (F.col("disposition") == "ACCEPTED")
    return not hypotheses.where(hit).limit(1).isEmpty()
