"""Gates, scores and rankings of copy and candidates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Topic terms (fixed values), whole words.
TOPIC_TERMS = ["asset pricing", "cryptocurrency", "crypto", "defi", "event study", "funding rate", "market microstructure", "market return", "order flow", "perpetual", "prediction market", "realized volatility", "return predictability"]
#: Category roots (fixed values).
CATEGORIES = ["q-fin", "econ", "stat"]
#: Pairs of substrings that must occur together (fixed values).
PAIRS = [("funding", "perpetual"), ("market", "microstructure"), ("return", "predictability"), ("realized", "volatility"), ("limit", "order book"), ("event", "study"), ("crypto", "market"), ("derivative", "liquidity")]
#: Phrases that copy must not use (fixed values).
FORBIDDEN = ["guaranteed", "guarantee", "easy alpha", "risk-free", "sure profit", "proven profit", "can't lose", "cannot lose", "buy now", "sell now", "moon"]
#: What the scrub takes out of texts, and what stands there then (fixed values).
SCRUB = [
    (r"/Users/\w+[^\s\"']*", "<PATH>"),
    (r"sqlite:////[^\s\"']+", "<DB>"),
    (r"postgresql\+?\w*://[^\s\"']+", "<DB>"),
    (r"https://discord(app)?\.com/api/webhooks/[^\s\"']+", "<WEBHOOK>"),
    (r"\b[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\b", "<UUID>"),
    (r"\b(sk-|key-|Bearer\s+)[A-Za-z0-9_-]{8,}", "<SECRET>"),
]
#: Components of the publication value (fixed names).
COMPONENTS = ["clarity", "novelty", "educational", "timeliness", "visualizable", "source_quality", "explainable", "domain_relevance", "active_topic_relevance", "user_research_relevance", "information_gain", "specific_takeaway_strength", "methodological_value", "negative_result_value", "source_depth", "topic_diversity", "public_interest", "evidence_quality", "visualizability"]
#: Policy of each category (fixed values); others are PRIVATE.
POLICY = {
    "PUBLIC": ["NEGATIVE_RESULT", "WEEKLY_NEGATIVE_RESULT", "METHODOLOGY_NOTE", "RESEARCH_PROCESS_NOTE", "PAPER_EXPLAINER"],
    "PUBLIC_WITH_LIMITATIONS": ["EMPIRICAL_RESULT", "MARKET_OBSERVATION", "WEEKLY_RESEARCH_ROUNDUP", "DATA_QUALITY_FINDING", "INCONCLUSIVE_RESULT", "REQUEST_DATA_FINDING", "HYPOTHESIS_EXPLAINER", "PRACTITIONER_EXPLAINER", "PAPER_PLUS_MARKET_CONNECTION"],
}


def any_of(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests)


def topic_gate(categories: Column, text: Column, terms: list[str] = TOPIC_TERMS, roots: list[str] = CATEGORIES) -> Column:
    """A category that is a root or below one, and a whole-word term in the text."""
    inside = "^(" + "|".join(roots) + r")(\..+)?$"
    return F.exists(categories, lambda c: c.rlike(inside)) & F.lower(text).rlike(r"\b(" + "|".join(terms) + r")\b")


def pair_gate(text: Column, pairs: list[tuple[str, str]] = PAIRS) -> Column:
    low = F.lower(text)
    return any_of([low.contains(a) & low.contains(b) for a, b in pairs])


def scrub(text: Column, patterns: list[tuple[str, str]] = SCRUB) -> Column:
    return reduce(lambda t, p: F.regexp_replace(t, *p), patterns, text)


def reasons(**tests: Column) -> Column:
    """The names of the tests that hold, in the order given, joined by commas."""
    return F.array_join(F.array_compact(F.array(*(F.when(t, name) for name, t in tests.items()))), ",")


def claim_check(text: Column, known: Column, forbidden: list[str] = FORBIDDEN) -> Column:
    """Why the copy is blocked, or null: a forbidden phrase, or a decimal number without a known one within 5e-4 * max(1, |known|)."""
    low = F.lower(text)
    phrase = F.coalesce(*[F.when(low.contains(f), F.lit(f"forbidden language: {f}")) for f in forbidden])
    numbers = F.regexp_extract_all(text, F.lit(r"(-?\d+\.\d+)"), 1)
    stray = F.exists(numbers, lambda n: ~F.exists(known, lambda r: F.abs(n.cast("double") - r) < 5e-4 * F.greatest(F.lit(1.0), F.abs(r))))
    return F.coalesce(phrase, F.when(stray & (F.size(known) > 0), "unsupported numeric claim"))


def count_terms(text: Column, terms: list[str]) -> Column:
    """How many of the terms occur."""
    return reduce(lambda a, b: a + b, [F.lower(text).contains(t).cast("int") for t in terms])


def substance(has_source: Column, content: Column, terms: list[str], least_chars: int = 80, least_terms: int = 2) -> Column:
    c = F.trim(F.coalesce(content, F.lit("")))
    return F.when(~has_source, "SOURCE_VERIFICATION_FAILED").when(F.char_length(c) < least_chars, "SOURCE_DEPTH_TOO_SHALLOW").when(count_terms(c, terms) < least_terms, "INSUFFICIENT_SUBSTANCE").otherwise("PASS")


def content_format(text: Column, gap: str = "\n\n", labels: tuple[str, ...] = ("Question:", "Method:", "Result:", "Limitation:")) -> Column:
    """SHORT_POST up to 280 characters and two paragraphs, THREAD with six paragraphs of which three are labelled, else STANDARD_POST."""
    parts = F.filter(F.split(text, gap), lambda p: F.trim(p) != "")
    labelled = F.size(F.filter(parts, lambda p: any_of([p.startswith(x) for x in labels])))
    return F.when((F.char_length(text) <= 280) & (F.size(parts) <= 2), "SHORT_POST").when((F.size(parts) >= 6) & (labelled >= 3), "THREAD").otherwise("STANDARD_POST")


def copy_quality(text: Column, useful: list[str], generic: list[str]) -> Column:
    low = F.lower(text)
    bad = (F.trim(text) == "") | any_of([low.contains(g) for g in generic]) | ~any_of([low.contains(u) for u in useful])
    return F.when(bad, "READER_USEFULNESS_FAILED").otherwise("PASS")


def evidence_depth(raw: Column, abstract: Column, excerpt: Column) -> Column:
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    return F.when(~blank(raw), "FULL_TEXT").when(~blank(abstract), "ABSTRACT").when(~blank(excerpt), "STRUCTURED_EXCERPT").otherwise("METADATA_ONLY")


def value_score(components: Column, names: list[str] = COMPONENTS) -> Column:
    """Sum of the named components of a map; those missing count 0."""
    return reduce(lambda a, b: a + b, [F.coalesce(F.try_element_at(components, F.lit(n)), F.lit(0)) for n in names])


def paper_components(text: Column, domain: list[str], active: list[str], method: list[str]) -> Column:
    d, a, m = F.least(F.lit(5), count_terms(text, domain)), F.least(F.lit(5), count_terms(text, active)), F.least(F.lit(4), count_terms(text, method))
    return F.struct(d.alias("domain"), a.alias("active"), F.least(F.lit(5), d + a).alias("user"), F.least(F.lit(4), 1 + a).alias("gain"), m.alias("method"), F.when(F.char_length(text) > 300, 4).otherwise(2).alias("takeaway"), F.least(F.lit(3), d).alias("interest"))


def policy(category: Column) -> Column:
    return F.when(category.isin(POLICY["PUBLIC"]), "PUBLIC").when(category.isin(POLICY["PUBLIC_WITH_LIMITATIONS"]), "PUBLIC_WITH_LIMITATIONS").otherwise("PRIVATE")


def publication_gate(complete: Column, published: Column, policy_col: Column, text: Column, has_claims: Column) -> Column:
    """Why a draft may not be published, or null."""
    low, limited = F.lower(text), policy_col == "PUBLIC_WITH_LIMITATIONS"
    return F.when(~complete, "run not complete").when(published, "already published").when(~policy_col.isin("PUBLIC", "PUBLIC_WITH_LIMITATIONS"), "policy does not allow posting").when(limited & ~low.contains("limitation") & ~low.contains("not a trading signal"), "limitation language missing").when(limited & ~has_claims, "claim record missing")


def hypothesis_score(components: Column, penalties: Column) -> Column:
    """Sum of the components less three for each penalty, 0 at least."""
    return F.greatest(F.lit(0), F.aggregate(F.map_values(components), F.lit(0), lambda a, x: a + x) - 3 * F.size(penalties))


def rubric(source: Column, evidence: Column, least: int = 5) -> Column:
    """Whether evidence and source share a word of `least` letters once punctuation at the ends is gone."""
    words = lambda c: F.filter(F.split(F.lower(c), " "), lambda w: F.char_length(F.btrim(w, F.lit(".,;:()"))) >= least)
    return F.arrays_overlap(words(source), words(evidence))


def horizon_endpoints(text: Column) -> Column:
    """Distinct (minutes, unit, fit) of every 'number unit' in the text."""
    pattern = r"(\d+(?:\.\d+)?)\s*(minutes?|mins?|min|hours?|hrs?|h|days?|d)\b"
    low = F.lower(F.coalesce(text, F.lit("")))
    pairs = F.arrays_zip(F.regexp_extract_all(low, F.lit(pattern), 1).alias("n"), F.regexp_extract_all(low, F.lit(pattern), 2).alias("u"))

    def endpoint(p):
        n, u = p["n"].cast("double"), F.substring(p["u"], 1, 1)
        minutes = F.when(u == "d", n * 1440).when(u == "h", n * 60).otherwise(n)
        return F.struct(minutes.alias("minutes"), F.when(u.isin("d", "h"), u).otherwise("min").alias("unit"), fit(minutes).alias("fit"))

    return F.array_distinct(F.transform(pairs, endpoint))


def fit(minutes: Column) -> Column:
    return F.when(minutes < 120, "OUT_OF_SCOPE_FOR_USER").when(minutes < 720, "LOW_FIT").when(minutes < 1440, "MEDIUM_FIT").when(minutes >= 1440, "HIGH_FIT")


def best_fit(text: Column) -> Column:
    """The fit of the longest endpoint."""
    return F.coalesce(fit(F.array_max(F.transform(horizon_endpoints(text), lambda e: e["minutes"]))), F.lit("OUT_OF_SCOPE_FOR_USER"))


def human_title(statement: Column, universe: Column, outcome: Column) -> Column:
    """What the statement quotes as described, else a statement of more than eight characters without its full stop, else universe and outcome."""
    plain = F.regexp_replace(F.trim(F.coalesce(statement, F.lit(""))), r"\.+$", "")
    quoted = F.regexp_extract(plain, r"described by '(.+?)'", 1)
    given = lambda c, default: F.coalesce(F.nullif(c, F.lit("")), F.lit(default))
    return F.when(quoted != "", F.concat(F.lit("Paper insight: "), quoted)).when(F.char_length(plain) > 8, plain).otherwise(F.concat_ws(" ", given(universe, "market"), given(outcome, "research")))


def hypothesis_complete(fields: list[Column], required_data: Column, terms: list[str] = TOPIC_TERMS) -> Column:
    """All fields have text, some data is required, and a topic term occurs in the fields or the data (as a substring)."""
    text = lambda c: F.coalesce(c, F.lit(""))
    filled = reduce(lambda a, b: a & b, [F.trim(text(c)) != "" for c in fields])
    said = F.lower(F.concat_ws(" ", *[text(c) for c in fields], F.array_join(required_data, " ")))
    return filled & (F.coalesce(F.size(required_data), F.lit(0)) > 0) & reduce(lambda a, b: a | b, [said.contains(t) for t in terms])


def triaged(retain: Column, relevance: Column, testability: Column, least: int = 60) -> Column:
    """Retained, and relevant and testable enough; nulls fail."""
    return F.coalesce(retain & (relevance >= least) & (testability >= least), F.lit(False))


#: Fields that an evidence packet must fill (fixed names).
PACKET = ["source_identity", "canonical_identity", "raw_artifact_receipt_id", "collection_run_id", "retrieved_at", "source_native_availability_at", "access_mode", "independence_key", "reviewable_summary", "analysis_mode", "availability_basis", "pit_qualifications"]


def packet_gaps(names: list[str] = PACKET) -> Column:
    """The names of the packet's empty fields, joined by commas."""
    return reasons(**{n: F.coalesce(F.col(n).cast("string"), F.lit("")) == "" for n in names})


#: Labels of a rendered report (fixed values).
LABELS = {"market_facts": "**FACT:**", "academic_claim_lines": "- **CLAIM:**", "hypotheses": "- **HYPOTHESIS:**"}


def label_counts(text: Column, labels: dict[str, str] = LABELS) -> list[Column]:
    """How often each label occurs in the text; a null text has none."""
    t = F.coalesce(text, F.lit(""))
    return [((F.char_length(t) - F.char_length(F.replace(t, F.lit(x), F.lit("")))) / len(x)).cast("bigint").alias(name) for name, x in labels.items()]


def letters_and_digits(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9 ]+", ""))


def single_spaced(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[ \t\n\r\f]+", " "))


def word_characters(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}_]+", " "))


#: Evidence depths from the least to the greatest (fixed values).
DEPTHS = ["METADATA_ONLY", "STRUCTURED_EXCERPT", "ABSTRACT", "FULL_TEXT"]


def minimum_depth(depth: Column) -> Column:
    """The least depth of a group; unknown and missing ones count as the least of all."""
    known = F.coalesce(F.array_position(F.array(*map(F.lit, DEPTHS)), depth), F.lit(0))
    return F.element_at(F.array(*map(F.lit, DEPTHS)), F.greatest(F.min(known), F.lit(1)).cast("int"))


def top_per(rows: DataFrame, keys: list[str], order: list, k: int, name: str = "rank") -> DataFrame:
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(name) <= k)


def topic_briefs(findings: DataFrame, sources: DataFrame, known: DataFrame, version: int = 1, most: int = 4) -> DataFrame:
    """Briefs of the first `most` findings of a run, with the least evidence depth of its sources; a (run, topic) that has a brief of this version gets no second.

    findings: run_id, topic_id, id; sources: run_id, depth; known: run_id, topic_id, version.
    """
    depth = sources.groupBy("run_id").agg(minimum_depth(F.col("depth")).alias("depth"))
    there = known.where(F.col("version") == version).select("run_id", "topic_id").distinct()
    new = top_per(findings.select("run_id", "topic_id", "id"), ["run_id"], ["id"], most).join(there, ["run_id", "topic_id"], "left_anti")
    return new.join(depth, "run_id", "left").select("run_id", "topic_id", "id", "rank", F.lit(version).alias("version"), F.coalesce("depth", F.lit(DEPTHS[0])).alias("depth"))


def publication_status(drafts: DataFrame, pending: str = "PENDING", published: str = "PUBLISHED", failed: str = "FAILED") -> DataFrame:
    """By channel: pending and published drafts, the time of the last failure, the last status. drafts: channel, status, created_at, id."""
    is_ = lambda x: F.col("status") == x
    return drafts.groupBy("channel").agg(F.count_if(is_(pending)).alias("pending"), F.count_if(is_(published)).alias("published"), F.max(F.when(is_(failed), F.col("created_at"))).alias("last_failure"), F.max_by("status", F.struct("created_at", "id")).alias("last_status"))


def candidate_dedup(candidates: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    rest = [c for c in candidates.columns if c not in keys]
    return candidates.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*keys, "_r.*")


def editorial_history(candidates: DataFrame, keys: list[str], order: list) -> DataFrame:
    """Every candidate with its rank and outcome: SELECTED (the first that passes), REJECTED (failed before it), NOT_REACHED."""
    ranked = candidates.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    first = ranked.groupBy(*keys).agg(F.min(F.when(F.col("passes"), F.col("rank"))).alias("_first"))
    return ranked.join(first, keys).withColumn("outcome", F.when(F.col("rank") == F.col("_first"), "SELECTED").when(F.col("_first").isNull() | (F.col("rank") < F.col("_first")), "REJECTED").otherwise("NOT_REACHED")).drop("_first")


def scorecard(scores: DataFrame, model: str = "model") -> DataFrame:
    """Mean of each rubric dimension by model; a missing score counts 0. scores: model, case_id, dimension, score."""
    cases = scores.groupBy(model).agg(F.count_distinct("case_id").alias("_n"))
    return scores.groupBy(model, "dimension").agg(F.sum(F.coalesce("score", F.lit(0.0))).alias("_s")).join(cases, model).select(model, "dimension", (F.col("_s") / F.col("_n")).alias("mean_score"))


def idempotence_key(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", *parts).cast("binary"), 256)


def logical_date(ts: Column, zone: str = "Asia/Shanghai") -> Column:
    return F.to_date(F.from_utc_timestamp(ts, zone))


def week_ending(day: Column) -> Column:
    """The Saturday that ends the day's week (a Saturday ends its own)."""
    return F.next_day(F.date_sub(day, 1), "SAT")
