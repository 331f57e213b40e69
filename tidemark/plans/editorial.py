"""Editorial queries: conversation turns and documents are the copy, orders the candidates."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import editorial as E
from tidemark.sources import parsers as P
from tidemark.plans.standins import dated, dates, funding, hypotheses, items, lines, out, sql, table

WORDS = ["thatin", "inoran", "hehely", "thing", "attion", "erble"]
SCRUB = [*E.SCRUB, (r"[\w.+-]+@[\w-]+\.[\w.-]+", "<EMAIL>"), (r"token = \"[0-9a-f]{40}\"", "<TOKEN>"), (r"\b\d{3}-\d{4}\b", "<PHONE>")]
CATS = ["EMPIRICAL_RESULT", "NEGATIVE_RESULT", "PAPER_EXPLAINER", "ALPHA_CANDIDATE", "MARKET_OBSERVATION"]


def _docs(s, d):
    return table(s, d, "documents")


def _candidates(s, d):
    o = table(s, d, "orders")
    return o.select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").cast("date").alias("run"), F.element_at(F.array(*map(F.lit, CATS)), (F.col("o_custkey") % 5 + 1).cast("int")).alias("category"), F.floor(F.col("o_totalprice") / 50000).cast("bigint").alias("total"), (F.col("o_orderkey") % 4).alias("active"), (F.col("o_custkey") % 3).alias("takeaway"), F.col("o_orderpriority").alias("title"))




def _order():
    return [F.col("total").desc(), F.col("active").desc(), F.col("takeaway").desc(), F.lower("title"), "id"]


def _packets(s, d):
    i, on = items(s, d), lambda c, v: F.when(c, v.cast("string"))
    k = F.col("id")
    fields = [F.col("source_name"), F.col("external_id"), on(k % 11 != 0, k), on(k % 7 != 3, k % 7), F.col("retrieved_at"), F.col("published_at"), F.col("lang"), on(k % 13 != 0, F.col("source_name")), F.col("title"), F.col("source_type"), on(F.col("quality").isNotNull(), F.lit("RECEIPT")), on(k % 17 != 0, F.lit("native"))]
    return i.select("id", *(f.alias(n) for f, n in zip(fields, E.PACKET, strict=True)))


def _findings(s, d):
    return items(s, d).select(F.col("source_name").alias("run_id"), F.col("lang").alias("topic_id"), "id", F.element_at(F.array(*map(F.lit, E.DEPTHS)), (F.col("id") % 3 + 2).cast("int")).alias("depth"))


QUERIES = {
    "topic_gate": lambda s, d: _docs(s, d).select("doc_id", E.topic_gate(F.array(F.col("lang"), F.col("source")), F.col("text"), WORDS, ["en", "src1"]).alias("relevant")),
    "pair_gate": lambda s, d: _docs(s, d).select("doc_id", E.pair_gate(F.col("text"), [("thatin", "inoran"), ("hehely", "thing"), ("attion", "erble")]).alias("relevant")),
    "quality_gate": lambda s, d: lines(s, d).select("conv_id", "turn", E.hypothesis_complete([F.col("text"), F.col("role"), F.concat(F.lit("return "), F.col("conv_id").cast("string")), F.when(F.col("turn") % 7 == 0, " ").otherwise(F.col("role")), F.lit("24h")], F.when(F.col("conv_id") % 5 == 0, F.array().cast("array<string>")).when(F.col("conv_id") % 3 == 0, F.array(F.lit("Crypto prices"), F.lit("volumes"))).otherwise(F.array(F.lit("volumes")))).alias("complete")),
    "triage_filter": lambda s, d: hypotheses(s, d).where(E.triaged(F.col("disposition") == "ACCEPTED", F.col("fingerprint") % 101, F.col("id") % 101)).select("id"),
    "contract_check": lambda s, d: lines(s, d).select("conv_id", "turn", E.reasons(blank=F.trim("text") == "", role=~F.col("role").isin("user", "assistant"), short=F.char_length("text") < 60, injection=F.lower("text").rlike("ignore previous instructions|ignore all rules")).alias("reasons")),
    "packet_complete": lambda s, d: _packets(s, d).select("id", E.packet_gaps().alias("missing")),
    "horizon_endpoints": lambda s, d: table(s, d, "events").select("event_id", F.array_join(F.transform(E.horizon_endpoints(_horizon()), lambda e: F.concat_ws(":", e["minutes"].cast("bigint").cast("string"), e["unit"], e["fit"])), ",").alias("endpoints")),
    "horizon_fit": lambda s, d: table(s, d, "events").select("event_id", E.best_fit(_horizon()).alias("fit")),
    "text_normalize": lambda s, d: _docs(s, d).select("doc_id", *[F.sha2(f("text").cast("binary"), 256).alias(f.__name__) for f in (E.letters_and_digits, E.single_spaced, E.word_characters)]),
    "privacy_scrub": lambda s, d: _docs(s, d).select("doc_id", F.sha2(E.scrub(F.col("text"), SCRUB).cast("binary"), 256).alias("scrubbed")),
    "claim_check": lambda s, d: _docs(s, d).select("doc_id", E.claim_check(F.col("text"), F.array(F.lit(0.5), F.lit(3.14)), ["onlyed", "thatin the"]).alias("blocked")),
    "substance_check": lambda s, d: _docs(s, d).select("doc_id", E.substance(F.col("doc_id") % 19 != 0, F.col("text"), WORDS).alias("code")),
    "copy_quality": lambda s, d: _docs(s, d).select("doc_id", E.copy_quality(F.col("text"), ["thing", "erble"], ["hehely"]).alias("code"), E.content_format(F.col("text"), "\n", ("The ", "Is ", "Of ", "En ")).alias("format")),
    "topic_depth": lambda s, d: items(s, d).groupBy(F.col("source_name").alias("topic_id"), F.col("lang").alias("lang")).agg(E.minimum_depth(F.when(F.col("id") % 6 == 0, F.lit(None).cast("string")).otherwise(F.element_at(F.array(*map(F.lit, E.DEPTHS)), (F.col("id") % 3 + 2).cast("int")))).alias("depth")),
    "evidence_depth": lambda s, d: items(s, d).select("id", E.evidence_depth(F.when(F.col("id") % 2 == 0, F.col("raw_text")), F.when(F.col("id") % 3 == 0, F.col("title")), F.when(F.col("id") % 5 == 0, F.col("lang"))).alias("depth")),
    "value_score": lambda s, d: table(s, d, "orders").select("o_orderkey", E.value_score(F.create_map(F.lit("clarity"), (F.col("o_custkey") % 5).cast("int"), F.lit("novelty"), (F.col("o_orderkey") % 4).cast("int"), F.lit("other"), F.lit(9))).cast("bigint").alias("score")),
    "paper_components": lambda s, d: _docs(s, d).select("doc_id", E.paper_components(F.col("text"), WORDS, ["hehe", "ona", "sht"], ["ing", "tion", "able", "ent", "que"]).alias("c")).select("doc_id", "c.*"),
    "policy_class": lambda s, d: _candidates(s, d).select("id", E.policy(F.col("category")).alias("policy")),
    "publication_gate": lambda s, d: lines(s, d).select("conv_id", "turn", E.publication_gate(F.col("conv_id") % 11 != 0, F.col("turn") == 3, F.when(F.col("conv_id") % 3 == 0, "PUBLIC").when(F.col("conv_id") % 3 == 1, "PUBLIC_WITH_LIMITATIONS").otherwise("PRIVATE"), F.when(F.col("turn") == 1, F.concat("text", F.lit(" Limitation: small"))).otherwise(F.col("text")), F.col("conv_id") % 2 == 0).alias("reason")),
    "hypothesis_score": lambda s, d: hypotheses(s, d).select("id", E.hypothesis_score(F.create_map(F.lit("a"), (F.col("id") % 20).cast("int"), F.lit("b"), (F.col("fingerprint") % 15).cast("int")), F.split(F.col("universe"), "-")).cast("bigint").alias("score")),
    "rubric_score": lambda s, d: lines(s, d).where("turn < 2").groupBy("conv_id").agg(F.max(F.when(F.col("turn") == 0, F.col("text"))).alias("a"), F.max(F.when(F.col("turn") == 1, F.col("text"))).alias("b")).where("a IS NOT NULL AND b IS NOT NULL").select("conv_id", E.rubric(F.col("a"), F.col("b")).alias("attributed")),
    "human_title": lambda s, d: items(s, d).select("id", E.human_title(F.when(F.col("id") % 3 == 0, F.concat(F.lit(" The relationship described by '"), F.regexp_replace("title", "'", ""), F.lit("' holds."))).when(F.col("id") % 3 == 1, F.concat(F.lit(" claim "), F.col("external_id"), F.lit(". "))).otherwise(F.col("external_id")), F.when(F.col("id") % 2 == 0, F.col("lang")), F.lit("")).alias("title")),
    "logical_dates": lambda s, d: table(s, d, "events").select("event_id", E.logical_date(F.col("ts")).alias("logical_date"), E.week_ending(E.logical_date(F.col("ts"))).alias("week_ending")),
    "date_parse": lambda s, d: table(s, d, "events").select("event_id", P.parsed_date(F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("Mon, "), F.date_format("ts", "d MMM yyyy HH:mm:ss"), F.lit(" +0200"))).when(F.col("event_id") % 3 == 1, F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+02:00"))).otherwise(F.concat(F.lit("no date "), F.col("event_id").cast("string")))).cast("timestamp_ntz").alias("parsed")),
    "idempotence_key": lambda s, d: table(s, d, "orders").select("o_orderkey", E.idempotence_key(F.col("o_custkey").cast("string"), F.col("o_orderpriority"), F.col("o_orderkey").cast("string")).alias("key")),
    "label_counts": lambda s, d: _docs(s, d).select("doc_id", *E.label_counts(F.replace(F.replace(F.replace("text", F.lit(" a"), F.lit(" **FACT:**")), F.lit("\n"), F.lit("\n- **CLAIM:**")), F.lit(" s"), F.lit("- **HYPOTHESIS:**")))),
    "priorities": lambda s, d: E.top_per(_candidates(s, d), ["run"], [F.when(F.col("active") == 3, 2).when(F.col("active") == 2, 1).otherwise(0).desc(), "id"], 5).select("run", "id", "rank"),
    "recent_items": lambda s, d: items(s, d).orderBy(F.col("published_at").desc_nulls_last(), F.col("id").desc()).limit(20).where("source_name <> 'src3'").select("id"),
    "report_sections": lambda s, d: E.top_per(hypotheses(s, d).join(table(s, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("fingerprint")), "fingerprint", "left_semi"), ["channel"], [F.col("score").desc(), "id"], 3).select("channel", "id", "rank"),
    "inputs_topn": lambda s, d: out(E.top_per(funding(s, d).withColumn("day", F.to_date("observed_at")), ["asset", "day"], ["observed_at", "id"], 4).select("asset", "day", "id", "rank")),
    "editorial_pick": lambda s, d: E.top_per(_candidates(s, d).where(E.policy(F.col("category")) != "PRIVATE"), ["run"], _order(), 1).select("run", "id"),
    "editorial_history": lambda s, d: E.editorial_history(_candidates(s, d).withColumn("passes", F.col("takeaway") > 0), ["run"], _order()).select("run", "id", "rank", "outcome"),
    "candidate_dedup": lambda s, d: E.candidate_dedup(_candidates(s, d).select("run", "category", "title", "id"), ["run", "category", "title"], ["id"]),
    "scorecard": lambda s, d: out(E.scorecard(_scores(s, d))),
    "publication_status": lambda s, d: out(E.publication_status(table(s, d, "orders").select(F.col("o_orderpriority").alias("channel"), F.col("o_orderstatus").alias("status"), F.col("o_orderdate").cast("date").cast("string").alias("created_at"), F.col("o_orderkey").alias("id")), "O", "F", "P")),
    "run_status": lambda s, d: table(s, d, "orders").groupBy(F.col("o_orderdate").cast("date").alias("run")).agg(F.bool_and(F.col("o_orderstatus") == "F").alias("ready"), F.bool_or((F.col("o_orderpriority") == "1-URGENT") & (F.col("o_orderstatus") == "P")).alias("fatal")).select("run", F.when(F.col("fatal"), "FAILED").when(F.col("ready"), "SUCCESS").otherwise("PARTIAL").alias("status")),
    "topic_link": lambda s, d: items(s, d).select("id", F.lower(F.trim("title")).alias("t")).join(items(s, d).groupBy(F.lower(F.trim("title")).alias("t")).agg(F.min("id").alias("topic_id")), "t", "left").select("id", "topic_id"),
    "publication_state": lambda s, d: table(s, d, "orders").where("o_orderstatus = 'O'").join(table(s, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_anti").select("o_orderkey"),
    "missing_days": lambda s, d: (o := table(s, d, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_orderdate").cast("date").alias("day"))).agg(F.min("day").alias("a"), F.max("day").alias("b")).select(F.explode(F.sequence("a", "b")).alias("day")).join(o.distinct(), "day", "left_anti"),
    "recent_duplicates": lambda s, d: _recent(s, d),
    "weekly_top": lambda s, d: E.top_per(hypotheses(s, d).withColumn("week", F.date_trunc("week", "as_of").cast("date")), ["week"], [F.col("score").desc(), "id"], 10).select(F.col("week").cast("string").alias("week"), "id", "rank"),
    "topic_briefs": lambda s, d: E.topic_briefs(_findings(s, d), _findings(s, d).select("run_id", "depth"), _findings(s, d).where("topic_id IN ('fr', 'de')").select("run_id", "topic_id", F.when(F.col("topic_id") == "fr", 2).otherwise(1).alias("version")), version=2),
    "accepted_claims": lambda s, d: items(s, d).where(E.pair_gate(F.col("raw_text"), [("thatin", "inoran"), ("hehely", "thing")]) & (F.col("quality") == 1) & (F.trim("title") != "")).groupBy("source_name").agg(F.count("*").alias("claims"), F.min("id").alias("first_id")),
    "publication_register": lambda s, d: table(s, d, "orders").select(F.col("o_custkey").alias("draft"), F.col("o_orderpriority").alias("platform")).distinct().join(table(s, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("draft"), F.col("o_orderpriority").alias("platform")).distinct(), ["draft", "platform"], "left_anti"),
    "editorial_pool": lambda s, d: _pool(s, d),
}


def _horizon():
    return F.concat(F.get_json_object("props", "$.k"), F.lit("h and "), F.get_json_object("props", "$.k"), F.lit(" days or 90 min"))


def _scores(s, d):
    t = lines(s, d).select(F.col("role").alias("model"), F.concat_ws("|", "conv_id", "turn").alias("case_id"), F.array(F.struct(F.lit("length").alias("dimension"), (F.char_length("text") > 200).cast("double").alias("score")), F.struct(F.lit("ends").alias("dimension"), F.when(F.col("turn") % 2 == 0, F.col("text").endswith(".").cast("double")).alias("score"))).alias("x"))
    return t.select("model", "case_id", F.explode("x").alias("x")).select("model", "case_id", "x.*")


def _recent(s, d):
    """Items whose first 400 normalised characters equal those of another item published within seven days before."""
    print_ = F.sha2(F.substring(F.trim(F.regexp_replace(F.lower("raw_text"), r"\s+", " ")), 1, 400).cast("binary"), 256)
    i = items(s, d).where("published_at IS NOT NULL").select("id", F.to_date("published_at").alias("day"), print_.alias("p"))
    hit = i.join(i.select(F.col("id").alias("other"), F.col("day").alias("seen"), "p"), "p").where("other <> id AND seen <= day AND seen >= day - INTERVAL 7 DAYS")
    return hit.select("id").distinct()


def _pool(s, d):
    """Two market families and eight papers a run, newest first, and the run's process note when it has two families or more."""
    c = _candidates(s, d).withColumn("market", F.col("category") == "MARKET_OBSERVATION")
    families = E.top_per(c.where("category IN ('MARKET_OBSERVATION', 'EMPIRICAL_RESULT')"), ["run"], [F.col("market").desc(), F.col("id").desc()], 2).select("run", "id", F.lit("family").alias("kind"))
    papers = E.top_per(c.where("category = 'PAPER_EXPLAINER'"), ["run"], [F.col("id").desc()], 8).select("run", "id", F.lit("paper").alias("kind"))
    notes = c.where("category IN ('MARKET_OBSERVATION', 'EMPIRICAL_RESULT')").groupBy("run").agg(F.count("*").alias("n"), F.max("id").alias("id")).where("n >= 2").select("run", "id", F.lit("note").alias("kind"))
    return families.unionByName(papers).unionByName(notes)


_N = lambda ws: "(" + " + ".join(f"CAST(contains(lower(text), '{w}') AS INTEGER)" for w in ws) + ")"
_C = ", c AS (SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) AS run, ['EMPIRICAL_RESULT', 'NEGATIVE_RESULT', 'PAPER_EXPLAINER', 'ALPHA_CANDIDATE', 'MARKET_OBSERVATION'][o_custkey % 5 + 1] AS category, CAST(floor(o_totalprice / 50000) AS BIGINT) AS total, o_orderkey % 4 AS active, o_custkey % 3 AS takeaway, o_orderpriority AS title FROM orders)"
_ORD = "total DESC, active DESC, takeaway DESC, lower(title), id"
_HZ = ", k AS (SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events), hz AS (SELECT event_id, k, k * 60 AS a, k * 1440 AS b FROM k)"
_FIT = lambda m: f"CASE WHEN {m} < 120 THEN 'OUT_OF_SCOPE_FOR_USER' WHEN {m} < 720 THEN 'LOW_FIT' WHEN {m} < 1440 THEN 'MEDIUM_FIT' ELSE 'HIGH_FIT' END"
_SCR = "text"
for _p, _r in SCRUB:
    _SCR = f"regexp_replace({_SCR}, '{_p.replace(chr(39), chr(39) * 2)}', '{_r}', 'g')"

ORACLE = {
    "topic_gate": "SELECT doc_id, (regexp_matches(lang, '^(en|src1)(\\..+)?$') OR regexp_matches(source, '^(en|src1)(\\..+)?$')) AND regexp_matches(lower(text), '\\b(" + "|".join(WORDS) + ")\\b') AS relevant FROM documents",
    "pair_gate": "SELECT doc_id, (contains(lower(text), 'thatin') AND contains(lower(text), 'inoran')) OR (contains(lower(text), 'hehely') AND contains(lower(text), 'thing')) OR (contains(lower(text), 'attion') AND contains(lower(text), 'erble')) AS relevant FROM documents",
    "quality_gate": "SELECT conv_id, turn, trim(text) <> '' AND trim(role) <> '' AND turn % 7 <> 0 AND conv_id % 5 <> 0 AND (conv_id % 3 = 0 OR regexp_matches(lower(text || ' ' || role), 'asset pricing|crypto|defi|event study|funding rate|market microstructure|market return|order flow|perpetual|prediction market|realized volatility|return predictability')) AS complete FROM conversations",
    "triage_filter": sql("SELECT id FROM hypotheses WHERE disposition = 'ACCEPTED' AND fingerprint % 101 >= 60 AND id % 101 >= 60"),
    "contract_check": "SELECT conv_id, turn, concat_ws(',', CASE WHEN trim(text) = '' THEN 'blank' END, CASE WHEN role NOT IN ('user', 'assistant') THEN 'role' END, CASE WHEN length(text) < 60 THEN 'short' END, CASE WHEN regexp_matches(lower(text), 'ignore previous instructions|ignore all rules') THEN 'injection' END) AS reasons FROM conversations",
    "packet_complete": sql("SELECT id, concat_ws(',', CASE WHEN coalesce(source_name, '') = '' THEN 'source_identity' END, CASE WHEN id % 11 = 0 THEN 'raw_artifact_receipt_id' END, CASE WHEN id % 7 = 3 THEN 'collection_run_id' END, CASE WHEN published_at IS NULL THEN 'source_native_availability_at' END, CASE WHEN coalesce(lang, '') = '' THEN 'access_mode' END, CASE WHEN id % 13 = 0 OR coalesce(source_name, '') = '' THEN 'independence_key' END, CASE WHEN coalesce(title, '') = '' THEN 'reviewable_summary' END, CASE WHEN quality IS NULL THEN 'availability_basis' END, CASE WHEN id % 17 = 0 THEN 'pit_qualifications' END) AS missing FROM items"),
    "horizon_endpoints": sql(_HZ + f" SELECT event_id, a || ':h:' || {_FIT('a')} || ',' || b || ':d:' || {_FIT('b')} || ',90:min:OUT_OF_SCOPE_FOR_USER' AS endpoints FROM hz"),
    "horizon_fit": sql(_HZ + f" SELECT event_id, {_FIT('greatest(a, b, 90)')} AS fit FROM hz"),
    "text_normalize": r"SELECT doc_id, sha256(trim(regexp_replace(lower(text), '[^a-z0-9 ]+', '', 'g'), ' ')) AS letters_and_digits, sha256(trim(regexp_replace(lower(text), '[ \t\n\r\f]+', ' ', 'g'), ' ')) AS single_spaced, sha256(trim(regexp_replace(lower(text), '[^\p{L}\p{N}_]+', ' ', 'g'), ' ')) AS word_characters FROM documents",
    "privacy_scrub": f"SELECT doc_id, sha256({_SCR}) AS scrubbed FROM documents",
    "claim_check": "SELECT doc_id, CASE WHEN contains(lower(text), 'onlyed') THEN 'forbidden language: onlyed' WHEN contains(lower(text), 'thatin the') THEN 'forbidden language: thatin the' WHEN len(list_filter(regexp_extract_all(text, '-?\\d+\\.\\d+'), lambda n: abs(CAST(n AS DOUBLE) - 0.5) >= 5e-4 AND abs(CAST(n AS DOUBLE) - 3.14) >= 5e-4 * 3.14)) > 0 THEN 'unsupported numeric claim' END AS blocked FROM documents",
    "substance_check": f"SELECT doc_id, CASE WHEN doc_id % 19 = 0 THEN 'SOURCE_VERIFICATION_FAILED' WHEN length(trim(text)) < 80 THEN 'SOURCE_DEPTH_TOO_SHALLOW' WHEN {_N(WORDS)} < 2 THEN 'INSUFFICIENT_SUBSTANCE' ELSE 'PASS' END AS code FROM documents",
    "copy_quality": "SELECT doc_id, CASE WHEN trim(text) = '' OR contains(lower(text), 'hehely') OR NOT (contains(lower(text), 'thing') OR contains(lower(text), 'erble')) THEN 'READER_USEFULNESS_FAILED' ELSE 'PASS' END AS code, CASE WHEN length(text) <= 280 AND len(list_filter(string_split(text, chr(10)), lambda p: trim(p) <> '')) <= 2 THEN 'SHORT_POST' WHEN len(list_filter(string_split(text, chr(10)), lambda p: trim(p) <> '')) >= 6 AND len(list_filter(string_split(text, chr(10)), lambda p: starts_with(p, 'The ') OR starts_with(p, 'Is ') OR starts_with(p, 'Of ') OR starts_with(p, 'En '))) >= 3 THEN 'THREAD' ELSE 'STANDARD_POST' END AS format FROM documents",
    "topic_depth": sql("SELECT source_name AS topic_id, lang, ['METADATA_ONLY', 'STRUCTURED_EXCERPT', 'ABSTRACT', 'FULL_TEXT'][min(CASE WHEN id % 6 = 0 THEN 1 ELSE id % 3 + 2 END)] AS depth FROM items GROUP BY ALL"),
    "evidence_depth": sql("SELECT id, CASE WHEN id % 2 = 0 AND trim(raw_text) <> '' THEN 'FULL_TEXT' WHEN id % 3 = 0 AND trim(title) <> '' THEN 'ABSTRACT' WHEN id % 5 = 0 THEN 'STRUCTURED_EXCERPT' ELSE 'METADATA_ONLY' END AS depth FROM items"),
    "value_score": "SELECT o_orderkey, CAST(o_custkey % 5 + o_orderkey % 4 AS BIGINT) AS score FROM orders",
    "paper_components": f"SELECT doc_id, CAST(d AS INTEGER) AS domain, CAST(a AS INTEGER) AS active, CAST(least(5, d + a) AS INTEGER) AS user, CAST(least(4, 1 + a) AS INTEGER) AS gain, CAST(m AS INTEGER) AS method, CAST(CASE WHEN n > 300 THEN 4 ELSE 2 END AS INTEGER) AS takeaway, CAST(least(3, d) AS INTEGER) AS interest FROM (SELECT doc_id, length(text) AS n, least(5, {_N(WORDS)}) AS d, least(5, {_N(['hehe', 'ona', 'sht'])}) AS a, least(4, {_N(['ing', 'tion', 'able', 'ent', 'que'])}) AS m FROM documents)",
    "policy_class": sql(_C + " SELECT id, CASE category WHEN 'NEGATIVE_RESULT' THEN 'PUBLIC' WHEN 'PAPER_EXPLAINER' THEN 'PUBLIC' WHEN 'ALPHA_CANDIDATE' THEN 'PRIVATE' ELSE 'PUBLIC_WITH_LIMITATIONS' END AS policy FROM c"),
    "publication_gate": "SELECT conv_id, turn, CASE WHEN conv_id % 11 = 0 THEN 'run not complete' WHEN turn = 3 THEN 'already published' WHEN conv_id % 3 = 2 THEN 'policy does not allow posting' WHEN conv_id % 3 = 1 AND turn <> 1 AND NOT contains(lower(text), 'limitation') AND NOT contains(lower(text), 'not a trading signal') THEN 'limitation language missing' WHEN conv_id % 3 = 1 AND conv_id % 2 = 1 THEN 'claim record missing' END AS reason FROM conversations",
    "hypothesis_score": sql("SELECT id, CAST(greatest(0, id % 20 + fingerprint % 15 - 3 * len(string_split(universe, '-'))) AS BIGINT) AS score FROM hypotheses"),
    "rubric_score": ", ".join(["WITH t AS (SELECT conv_id, max(text) FILTER (WHERE turn = 0) AS a, max(text) FILTER (WHERE turn = 1) AS b FROM conversations GROUP BY conv_id)"]) + " SELECT conv_id, list_has_any(list_filter(string_split(lower(a), ' '), lambda w: length(trim(w, '.,;:()')) >= 5), list_filter(string_split(lower(b), ' '), lambda w: length(trim(w, '.,;:()')) >= 5)) AS attributed FROM t WHERE a IS NOT NULL AND b IS NOT NULL",
    "human_title": sql("SELECT id, CASE WHEN id % 3 = 0 AND replace(title, chr(39), '') <> '' AND NOT contains(title, chr(10)) THEN 'Paper insight: ' || replace(title, chr(39), '') WHEN id % 3 = 0 THEN 'The relationship described by ' || chr(39) || replace(title, chr(39), '') || chr(39) || ' holds' WHEN id % 3 = 1 AND length('claim ' || id) > 8 THEN 'claim ' || id WHEN id % 3 = 2 AND length(CAST(id AS VARCHAR)) > 8 THEN CAST(id AS VARCHAR) ELSE CASE WHEN id % 2 = 0 AND lang <> '' THEN lang ELSE 'market' END || ' research' END AS title FROM items"),
    "logical_dates": "SELECT event_id, CAST(ts + INTERVAL 8 HOUR AS DATE) AS logical_date, CAST(CAST(ts + INTERVAL 8 HOUR AS DATE) + CAST((6 - dayofweek(CAST(ts + INTERVAL 8 HOUR AS DATE)) + 7) % 7 AS INTEGER) AS DATE) AS week_ending FROM events",
    "date_parse": "SELECT event_id, CASE WHEN event_id % 3 < 2 THEN CAST(date_trunc('second', ts) AS TIMESTAMP) - INTERVAL 2 HOUR END AS parsed FROM events",
    "idempotence_key": "SELECT o_orderkey, sha256(o_custkey || '|' || o_orderpriority || '|' || o_orderkey) AS key FROM orders",
    "label_counts": "WITH t AS (SELECT doc_id, replace(replace(replace(text, ' a', ' **FACT:**'), chr(10), chr(10) || '- **CLAIM:**'), ' s', '- **HYPOTHESIS:**') AS x FROM documents) SELECT doc_id, CAST(coalesce(length(x) - length(replace(x, '**FACT:**', '')), 0) // 9 AS BIGINT) AS market_facts, CAST(coalesce(length(x) - length(replace(x, '- **CLAIM:**', '')), 0) // 12 AS BIGINT) AS academic_claim_lines, CAST(coalesce(length(x) - length(replace(x, '- **HYPOTHESIS:**', '')), 0) // 17 AS BIGINT) AS hypotheses FROM t",
    "priorities": sql(_C + " SELECT run, id, CAST(row_number() OVER (PARTITION BY run ORDER BY CASE active WHEN 3 THEN 2 WHEN 2 THEN 1 ELSE 0 END DESC, id) AS INTEGER) AS rank FROM c QUALIFY rank <= 5"),
    "recent_items": sql("SELECT id FROM (SELECT * FROM items ORDER BY published_at DESC NULLS LAST, id DESC LIMIT 20) WHERE source_name <> 'src3'"),
    "report_sections": sql("SELECT channel, id, CAST(row_number() OVER (PARTITION BY channel ORDER BY score DESC, id) AS INTEGER) AS rank FROM hypotheses WHERE fingerprint IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') QUALIFY rank <= 3"),
    "inputs_topn": sql("SELECT asset, CAST(observed_at AS DATE) AS day, id, CAST(row_number() OVER (PARTITION BY asset, CAST(observed_at AS DATE) ORDER BY observed_at, id) AS INTEGER) AS rank FROM funding QUALIFY rank <= 4"),
    "editorial_pick": sql(_C + f" SELECT run, id FROM c WHERE category <> 'ALPHA_CANDIDATE' QUALIFY row_number() OVER (PARTITION BY run ORDER BY {_ORD}) = 1"),
    "editorial_history": sql(_C + f", r AS (SELECT *, takeaway > 0 AS ok, row_number() OVER (PARTITION BY run ORDER BY {_ORD}) AS rank FROM c), f AS (SELECT run, min(rank) FILTER (WHERE ok) AS f FROM r GROUP BY run) SELECT run, id, CAST(rank AS INTEGER) AS rank, CASE WHEN rank = f THEN 'SELECTED' WHEN f IS NULL OR rank < f THEN 'REJECTED' ELSE 'NOT_REACHED' END AS outcome FROM r JOIN f USING (run)"),
    "candidate_dedup": sql(_C + " SELECT run, category, title, min(id) AS id FROM c GROUP BY ALL"),
    "scorecard": "WITH t AS (SELECT role AS model, CAST(length(text) > 200 AS DOUBLE) AS a, CASE WHEN turn % 2 = 0 AND ends_with(text, '.') THEN 1.0 ELSE 0.0 END AS b FROM conversations) SELECT model, 'length' AS dimension, round(avg(a), 6) AS mean_score FROM t GROUP BY model UNION ALL SELECT model, 'ends', round(avg(b), 6) FROM t GROUP BY model",
    "publication_status": "SELECT o_orderpriority AS channel, count(*) FILTER (WHERE o_orderstatus = 'O') AS pending, count(*) FILTER (WHERE o_orderstatus = 'F') AS published, CAST(max(CAST(o_orderdate AS DATE)) FILTER (WHERE o_orderstatus = 'P') AS VARCHAR) AS last_failure, arg_max(o_orderstatus, (CAST(o_orderdate AS DATE), o_orderkey)) AS last_status FROM orders GROUP BY 1",
    "run_status": "SELECT CAST(o_orderdate AS DATE) AS run, CASE WHEN bool_or(o_orderpriority = '1-URGENT' AND o_orderstatus = 'P') THEN 'FAILED' WHEN bool_and(o_orderstatus = 'F') THEN 'SUCCESS' ELSE 'PARTIAL' END AS status FROM orders GROUP BY 1",
    "topic_link": sql("SELECT id, min(id) OVER (PARTITION BY lower(trim(title))) AS topic_id FROM items"),
    "publication_state": "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')",
    "missing_days": "WITH o AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders WHERE o_orderpriority = '1-URGENT'), s AS (SELECT CAST(unnest(range(min(day), max(day) + INTERVAL 1 DAY, INTERVAL 1 DAY)) AS DATE) AS day FROM o) SELECT day FROM s WHERE day NOT IN (SELECT day FROM o)",
    "recent_duplicates": sql(", i AS (SELECT id, CAST(published_at AS DATE) AS day, substr(trim(regexp_replace(lower(raw_text), '\\s+', ' ', 'g')), 1, 400) AS p FROM items WHERE published_at IS NOT NULL) SELECT DISTINCT a.id FROM i a JOIN i b ON a.p = b.p AND a.id <> b.id AND b.day <= a.day AND b.day >= a.day - INTERVAL 7 DAY"),
    "weekly_top": sql("SELECT CAST(CAST(date_trunc('week', as_of) AS DATE) AS VARCHAR) AS week, id, CAST(row_number() OVER (PARTITION BY date_trunc('week', as_of) ORDER BY score DESC, id) AS INTEGER) AS rank FROM hypotheses QUALIFY rank <= 10"),
    "topic_briefs": sql(", f AS (SELECT *, CAST(row_number() OVER (PARTITION BY source_name ORDER BY id) AS INTEGER) AS rank FROM items), m AS (SELECT source_name, ['METADATA_ONLY', 'STRUCTURED_EXCERPT', 'ABSTRACT', 'FULL_TEXT'][min(id % 3 + 2)] AS depth FROM items GROUP BY 1) SELECT source_name AS run_id, lang AS topic_id, id, rank, 2 AS version, depth FROM f JOIN m USING (source_name) WHERE rank <= 4 AND lang <> 'fr'"),
    "accepted_claims": sql("SELECT source_name, count(*) AS claims, min(id) AS first_id FROM items WHERE quality = 1 AND trim(title) <> '' AND ((contains(lower(raw_text), 'thatin') AND contains(lower(raw_text), 'inoran')) OR (contains(lower(raw_text), 'hehely') AND contains(lower(raw_text), 'thing'))) GROUP BY 1"),
    "publication_register": "SELECT DISTINCT o_custkey AS draft, o_orderpriority AS platform FROM orders EXCEPT SELECT o_custkey, o_orderpriority FROM orders WHERE o_orderstatus = 'F'",
    "editorial_pool": sql(_C + ", f AS (SELECT * FROM c WHERE category IN ('MARKET_OBSERVATION', 'EMPIRICAL_RESULT')) SELECT run, id, 'family' AS kind FROM f QUALIFY row_number() OVER (PARTITION BY run ORDER BY category = 'MARKET_OBSERVATION' DESC, id DESC) <= 2 UNION ALL SELECT run, id, 'paper' FROM c WHERE category = 'PAPER_EXPLAINER' QUALIFY row_number() OVER (PARTITION BY run ORDER BY id DESC) <= 8 UNION ALL SELECT run, max(id), 'note' FROM f GROUP BY run HAVING count(*) >= 2"),
}

for _name, _cols in {"logical_dates": ("logical_date", "week_ending"), "priorities": ("run",), "inputs_topn": ("day",), "editorial_pick": ("run",), "editorial_history": ("run",), "candidate_dedup": ("run",), "run_status": ("run",), "missing_days": ("day",), "editorial_pool": ("run",)}.items():
    QUERIES[_name] = lambda s, d, f=QUERIES[_name]: dates(f(s, d))
    ORACLE[_name] = dated(ORACLE[_name], *_cols)
