"""Evidence fusion, lineage, prior context, recurrence, near duplicates, search."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.groups import components
from tidemark.operators.similar import own_numbers, similar_sets
from tidemark.session import discard, staged

#: Query expansions (fixed values): a query that equals a key is also searched by these terms.
EXPANSIONS = {
    "crowded perp longs": ["funding", "perpetual", "positioning", "crowding"],
    "mean reversion": ["reversal", "subsequent returns"],
    "short-horizon reversal": ["mean reversion", "subsequent returns"],
    "perpetual carry": ["basis", "funding", "futures basis"],
    "basis trade": ["carry", "futures basis", "funding"],
    "order flow": ["order-flow imbalance", "market microstructure"],
    "order-flow imbalance": ["order flow", "market microstructure"],
    "volatility regime": ["realized volatility", "volatility"],
}


def fuse(drafts: DataFrame) -> DataFrame:
    """One row for each fingerprint: channels, evidence in input order, independence keys, maturity. drafts: fingerprint, channel, evidence_id, independence_key, mechanism, maturity, ord.

    H3 with two channels and two independent keys, else H2 with any mechanism, else the first draft's maturity.
    """
    g = drafts.groupBy("fingerprint").agg(
        F.array_sort(F.collect_set("channel")).alias("channels"),
        F.transform(F.array_sort(F.collect_list(F.struct("ord", "evidence_id"))), lambda x: x["evidence_id"]).alias("evidence"),
        F.count_distinct("independence_key").alias("n_keys"),
        F.bool_or(F.coalesce(F.col("mechanism"), F.lit("")) != "").alias("_mechanism"),
        F.min_by("maturity", "ord").alias("_base"),
    )
    maturity = F.when((F.size("channels") >= 2) & (F.col("n_keys") >= 2), "H3").when(F.col("_mechanism"), "H2").otherwise(F.col("_base"))
    return g.select("fingerprint", "channels", "evidence", "n_keys", maturity.alias("maturity"))


def families(fused: DataFrame, known: DataFrame) -> DataFrame:
    """Families to insert: fingerprints not known yet, with a priority of 50 + 10 for each channel set on creation only."""
    return fused.join(known.select("fingerprint"), "fingerprint", "left_anti").select("fingerprint", "maturity", (F.lit(50) + 10 * F.size("channels")).cast("bigint").alias("priority"))


def latest_receipt(receipts: DataFrame, as_of: Column, key: str = "market_observation_id") -> DataFrame:
    """The newest receipt of each key retrieved by the cutoff; equal times: the larger id."""
    rest = [c for c in receipts.columns if c not in (key, "retrieved_at", "id")]
    got = receipts.where(F.col("retrieved_at") <= as_of).groupBy(key).agg(F.max(F.struct("retrieved_at", "id", *rest)).alias("_r"))
    return got.select(key, "_r.*")


def receipt_complete(hypotheses: DataFrame, archived: DataFrame) -> DataFrame:
    """Relational division: whether every listed item has an archived receipt. hypotheses: hypothesis_id, source_item_id; archived: source_item_id."""
    ok = hypotheses.select("hypothesis_id", "source_item_id").distinct().join(archived.select("source_item_id", F.lit(1).alias("_ok")).distinct(), "source_item_id", "left")
    return ok.groupBy("hypothesis_id").agg(F.count("*").alias("n_items"), F.count("_ok").alias("n_archived")).withColumn("complete", F.col("n_items") == F.col("n_archived"))


def packets(links: DataFrame) -> DataFrame:
    """Evidence packet of each hypothesis: sorted items, independence keys, channels."""
    joined = lambda c: F.array_join(F.transform(F.array_sort(F.collect_set(c)), lambda x: x.cast("string")), ",")
    return links.groupBy("hypothesis_id").agg(joined("source_item_id").alias("items"), joined("independence_key").alias("keys"), joined("channel").alias("channels"))


def novelty(hypotheses: DataFrame) -> DataFrame:
    """Novelty against strictly earlier production rows of the same fingerprint, by running aggregates over a range frame that ends before the current day.

    NEW, PREVIOUSLY_REJECTED, PERSISTENT_REGIME (market) or RECURRENT (same universe seen), else ASSET_VARIANT; and how many there were.
    """
    day = F.unix_date("as_of")
    mine = F.when(F.col("analysis_mode") == "PRODUCTION", F.lit(1))
    before = Window.partitionBy("fingerprint").orderBy(day).rangeBetween(Window.unboundedPreceding, -1)
    same = Window.partitionBy("fingerprint", "universe").orderBy(day).rangeBetween(Window.unboundedPreceding, -1)
    got = hypotheses.withColumns({"occurrences": F.count(mine).over(before), "_rejected": F.count(F.when(F.col("disposition") == "REJECTED", mine)).over(before), "_same": F.count(mine).over(same)})
    label = F.when(F.col("occurrences") == 0, "NEW").when(F.col("_rejected") > 0, "PREVIOUSLY_REJECTED").when((F.col("_same") > 0) & (F.col("channel") == "MARKET"), "PERSISTENT_REGIME").when(F.col("_same") > 0, "RECURRENT").otherwise("ASSET_VARIANT")
    return got.withColumn("novelty", label).drop("_rejected", "_same")


def prior_context(current: DataFrame, prior: DataFrame) -> DataFrame:
    """Pairs of a current row with its strictly earlier prior rows of the same fingerprint."""
    p = prior.select("fingerprint", F.col("id").alias("prior_id"), F.col("as_of").alias("prior_as_of"))
    return current.select("id", "fingerprint", "as_of").join(p, "fingerprint").where("prior_as_of < as_of")


def first_seen(hypotheses: DataFrame, family: str = "fingerprint", day: str = "as_of") -> DataFrame:
    """Rows of the first day on which their family appears."""
    return hypotheses.join(hypotheses.groupBy(family).agg(F.min(day).alias("_d")), family).where(F.col(day) == F.col("_d")).drop("_d")


def occurrences(hypotheses: DataFrame) -> DataFrame:
    w = Window.partitionBy("fingerprint").orderBy("as_of", "id")
    return hypotheses.withColumn("occurrence", F.row_number().over(w))


def latest_prior(current: DataFrame, results: DataFrame) -> DataFrame:
    """The disposition of the newest result of the family before each row's day. Running aggregate over the union, so no pair of rows is made."""
    both = current.select("fingerprint", "as_of", "id", F.lit(None).cast("string").alias("_d")).unionByName(results.select("fingerprint", "as_of", F.lit(None).cast(dict(current.dtypes)["id"]).alias("id"), F.col("disposition").alias("_d")))
    w = Window.partitionBy("fingerprint").orderBy(F.unix_date("as_of")).rangeBetween(Window.unboundedPreceding, -1)
    return both.withColumn("prior", F.max(F.when(F.col("_d").isNotNull(), F.struct("as_of", "_d"))).over(w)["_d"]).where("id IS NOT NULL").select("id", "prior")


def family_recurrence(hypotheses: DataFrame) -> DataFrame:
    return hypotheses.groupBy("fingerprint").agg(F.count("*").alias("n")).groupBy(F.when(F.col("n") == 1, "NEW").otherwise("RECURRENT").alias("kind")).agg(F.count("*").alias("families"), F.sum("n").alias("occurrences"))


def lineage(hypotheses: DataFrame, links: DataFrame, receipts: DataFrame, as_of: Column) -> DataFrame:
    """hypothesis -> links -> receipts -> runs: one row for each link, with its raw status and run, as known by the cutoff."""
    r = receipts.where(F.col("retrieved_at") <= as_of).groupBy("source_item_id").agg(F.max_by(F.struct("id", "collection_run_id"), F.struct("retrieved_at", "id")).alias("_r"))
    got = hypotheses.select(F.col("id").alias("hypothesis_id"), "fingerprint").join(links, "hypothesis_id", "left").join(r, "source_item_id", "left")
    return got.select("hypothesis_id", "fingerprint", "source_item_id", F.col("_r.id").alias("receipt_id"), F.col("_r.collection_run_id").alias("run_id"), F.when(F.col("_r").isNull(), "LEGACY_UNARCHIVED").otherwise("ARCHIVED").alias("raw_status"))


def _words(text: Column | str) -> Column:
    return F.array_distinct(F.call_function("array_remove", F.split(text, " "), F.lit("")))


def near_duplicates(texts: DataFrame, structure: list[str] | None = None, least: float = 0.45, least_structured: float = 0.25) -> DataFrame:
    """a, b (a < b), similarity (rounded to 3), shared_structure of possible duplicates: equal texts, word sets with a Jaccard similarity of `least` or more, or
    equal `structure` columns and `least_structured` or more. texts: id, text (normalised), the structure columns.

    Words are split at spaces. Texts without a word are equal to each other, with similarity 0.
    """
    also = structure or []
    sets = staged(texts.select("id", "text", *also, _words("text").alias("words")), "sets")
    seed = own_numbers(sets)
    found = similar_sets(sets, least, [], seed)
    if also:
        found = found.unionByName(similar_sets(sets, least_structured, also, seed))
    bare = sets.where(F.size("words") == 0).select("id", "text")
    found = found.unionByName(bare.select(F.col("id").alias("a"), "text").join(bare.select(F.col("id").alias("b"), "text"), "text").where("a < b").select("a", "b", F.lit(0.0).alias("_s")))
    own = lambda x: sets.select(F.col("id").alias(x), F.struct(F.lit(1).alias("one"), *also).alias(f"_{x}"))
    one = found.groupBy("a", "b").agg(F.max("_s").alias("_s"))
    return one.join(own("a"), "a").join(own("b"), "b").select("a", "b", F.round("_s", 3).alias("similarity"), (F.col("_a") == F.col("_b")).alias("shared_structure"))


def duplicate_classes(texts: DataFrame, structure: list[str] | None = None, least: float = 0.45, least_structured: float = 0.25) -> tuple[DataFrame, DataFrame]:
    """(members, links) of the duplicates that near_duplicates() would list pair by pair; texts as there.

    members: id, set_id (the smallest id with the same set of words), class_id (the smallest id that links lead to) of every text. links: a, b (a < b), similarity,
    structured (found between texts of one structure) between such smallest ids. Texts with the same words are one before anything is joined, so copies cost a row
    each, not a pair each; texts without a word and null texts are one class.
    """
    also = structure or []
    sets = staged(texts.select("id", *also, F.sort_array(_words(F.coalesce("text", F.lit("")))).alias("words")), "words")
    firsts = staged(sets.groupBy("words").agg(F.min("id").alias("set_id")), "sets")
    named = staged(sets.join(firsts, "words"), "named")
    discard(sets)
    seed = own_numbers(firsts)
    found = similar_sets(firsts.select(F.col("set_id").alias("id"), "words"), least, [], seed).withColumn("structured", F.lit(False))
    if also:  # a set takes part once for each structure it is found in
        inner = named.select(F.col("set_id").alias("_set"), *also, "words").distinct().withColumn("id", F.xxhash64("_set", *also))
        inner = staged(inner, "sets")
        near = similar_sets(inner.select("id", *also, "words"), least_structured, also, seed)
        ends = lambda x: inner.select(F.col("id").alias(x), F.col("_set").alias(f"_{x}"))
        near = near.join(ends("a"), "a").join(ends("b"), "b").where("_a <> _b")
        found = found.unionByName(near.select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b"), "_s", F.lit(True).alias("structured")))
    links = staged(found.groupBy("a", "b").agg(F.round(F.max("_s"), 3).alias("similarity"), F.bool_or("structured").alias("structured")), "links")
    groups = components(links.select("a", "b")).select(F.col("node").alias("set_id"), "component")
    members = named.select("id", "set_id").join(groups, "set_id", "left").select("id", "set_id", F.coalesce("component", "set_id").alias("class_id"))
    return members, links


def expand(query: str) -> list[str]:
    """The normalised query and its synonyms; 1 to 500 characters."""
    q = " ".join(query.lower().split())
    if not 0 < len(q) <= 500:
        raise ValueError("a query has 1 to 500 characters")
    return [q, *EXPANSIONS.get(q, [])]


def in_scope(mode: Column, scope: str) -> Column:
    """PRODUCTION or REPLAY rows alone, or ALL."""
    if scope not in ("PRODUCTION", "REPLAY", "ALL"):
        raise ValueError("scope is PRODUCTION, REPLAY or ALL")
    return F.lit(True) if scope == "ALL" else mode == scope


def search(rows: DataFrame, query: str, columns: list[str], order: list, limit: int = 100, scope: Column | None = None) -> DataFrame:
    """Rows in which a column contains the query or a synonym, newest first, `limit` (1 to 100) of them."""
    if not 1 <= limit <= 100:
        raise ValueError("limit is 1 to 100")
    hit = reduce(lambda a, b: a | b, [F.lower(F.col(c)).contains(t) for c in columns for t in expand(query)])
    return rows.where(hit if scope is None else hit & scope).orderBy(*order).limit(limit)


def independence_key(metadata: Column, external_id: Column) -> Column:
    """explicit key, doi, url, else the external id; empty strings count as missing."""
    field = lambda k: F.nullif(F.get_json_object(metadata, f"$.{k}"), F.lit(""))
    return F.coalesce(field("independence_key"), field("doi"), field("url"), external_id)


def fingerprint(semantic: Column, evidence: Column, outcome: Column, universe: Column, horizon: Column) -> Column:
    return F.lower(F.concat_ws("|", F.coalesce(F.nullif(semantic, F.lit("")), F.concat(F.lit("unfused:"), evidence)), outcome, universe, horizon))


def run_interval(market: DataFrame, daily: DataFrame, slack: str = "5 MINUTES") -> DataFrame:
    """The first market run that starts within a daily run widened by the slack. Joined by day first, so no pair beyond a day is tried."""
    step = F.expr(f"INTERVAL {slack}")
    m = market.select(F.col("id").alias("market_id"), F.col("started_at").alias("market_start"), F.to_date("started_at").alias("_d"))
    wide = daily.withColumn("_lo", F.col("started_at") - step).withColumn("_hi", F.col("ended_at") + step).withColumn("_d", F.explode(F.sequence(F.to_date("_lo"), F.to_date("_hi"))))
    hit = wide.join(m, "_d").where((F.col("market_start") >= F.col("_lo")) & (F.col("market_start") <= F.col("_hi")))
    return hit.groupBy("id").agg(F.min_by("market_id", F.struct("market_start", "market_id")).alias("market_id"))
