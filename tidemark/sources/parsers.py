"""Normalisation of landed payloads: one string a row in, records out. Payloads that do not parse give no record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ATOM = "entry array<struct<id string, title string, published string, summary string, author array<struct<name string>>, category array<struct<_term string>>>>"
RSS = "channel struct<item array<struct<title string, link string, guid string, pubDate string, description string>>>"
WORKS = "results array<struct<id string, title string, doi string, publication_date string, is_oa boolean, oa_url string, landing_url string, authorships array<struct<name string>>, topics array<string>>>"
FEED = "items array<struct<id string, title string, url string, date_published string, content_text string>>"
DOI = "items array<struct<DOI string, title array<string>, author array<struct<given string, family string>>, issued struct<`date-parts` array<array<int>>>>>"


def _blank(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def rfc822(text: Column) -> Column:
    """'Mon, 1 Jan 2024 10:00:00 +0000': the weekday is dropped first."""
    return F.try_to_timestamp(F.regexp_replace(text, r"^\s*[A-Za-z]{3},\s*", ""), F.lit("d MMM yyyy HH:mm:ss Z"))


def iso8601(text: Column) -> Column:
    """'2024-01-01T10:00:00Z', with an offset or without (UTC)."""
    return F.try_to_timestamp(F.trim(text))


def parsed_date(text: Column) -> Column:
    """RFC 822 where the text begins with a weekday, else ISO 8601; null for anything else."""
    return F.when(text.rlike(r"^\s*[A-Za-z]{3},"), rfc822(text)).otherwise(iso8601(text))


def atom(payloads: DataFrame, cutoff: Column | None = None) -> DataFrame:
    """id, title, published_at, summary, authors, categories of each entry; entries without a date pass the cutoff."""
    e = payloads.select(F.explode(F.from_xml("payload", ATOM)["entry"]).alias("e")).select("e.*")
    got = e.select(_blank(F.col("id")).alias("external_id"), F.regexp_replace(F.trim("title"), r"\s+", " ").alias("title"), F.try_to_timestamp("published").alias("published_at"), F.trim("summary").alias("raw_text"), F.col("author.name").alias("authors"), F.col("category._term").alias("categories"))
    return got.where(F.col("external_id").isNotNull() & (F.lit(True) if cutoff is None else F.col("published_at").isNull() | (F.col("published_at") >= cutoff)))


def works_json(payloads: DataFrame) -> DataFrame:
    """Works that have a title and a date: tail of the id, bare DOI, URL by preference, access mode, authors, topics."""
    w = payloads.select(F.explode(F.from_json("payload", WORKS)["results"]).alias("w")).select("w.*")
    url = F.coalesce(_blank(F.col("oa_url")), _blank(F.col("landing_url")), F.col("id"))
    mode = F.when(F.col("is_oa") & _blank(F.col("oa_url")).isNotNull(), "OPEN_ACCESS").when(F.col("is_oa"), "ABSTRACT_ONLY").otherwise("METADATA_ONLY")
    return w.where(_blank(F.col("title")).isNotNull() & F.to_date("publication_date").isNotNull()).select(F.regexp_extract("id", r"([^/]+)$", 1).alias("external_id"), "title", F.regexp_replace(F.lower("doi"), r"^https?://(dx\.)?doi\.org/", "").alias("doi"), F.to_date("publication_date").alias("published_on"), url.alias("canonical_url"), mode.alias("access_mode"), F.array_join(F.col("authorships.name"), ";").alias("authors"), F.array_join("topics", ";").alias("topics"))


def inverted_text(index: Column) -> Column:
    """The text of a map word -> positions."""
    pairs = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("pos"), e["key"].alias("word")))))
    return F.concat_ws(" ", F.transform(F.array_sort(pairs), lambda x: x["word"]))


def feed(payloads: DataFrame) -> DataFrame:
    """Items of JSON feeds and of RSS feeds (told apart by a leading '<') that have an id, a title and a date; a link stands in for a missing guid."""
    text = F.ltrim("payload")
    j = payloads.where(~text.startswith("<")).select(F.explode(F.from_json("payload", FEED)["items"]).alias("i")).select(F.coalesce(_blank(F.col("i.id")), _blank(F.col("i.url"))).alias("external_id"), F.trim("i.title").alias("title"), F.try_to_timestamp("i.date_published").alias("published_at"), F.col("i.url").alias("canonical_url"), F.col("i.content_text").alias("raw_text"))
    x = payloads.where(text.startswith("<")).select(F.explode(F.from_xml("payload", RSS)["channel"]["item"]).alias("i")).select(F.coalesce(_blank(F.col("i.guid")), _blank(F.col("i.link"))).alias("external_id"), F.trim("i.title").alias("title"), rfc822(F.col("i.pubDate")).alias("published_at"), F.col("i.link").alias("canonical_url"), F.col("i.description").alias("raw_text"))
    return j.unionByName(x).where("external_id IS NOT NULL AND title <> '' AND published_at IS NOT NULL")


def undated_feed(payloads: DataFrame) -> DataFrame:
    """RSS items without dates: the link, else the guid, is the id."""
    i = payloads.select(F.explode(F.from_xml("payload", RSS)["channel"]["item"]).alias("i")).select("i.*")
    return i.select(F.coalesce(_blank(F.col("link")), _blank(F.col("guid"))).alias("external_id"), F.trim("title").alias("title"), F.col("description").alias("raw_text")).where("external_id IS NOT NULL AND title <> ''")


def relabelled(records: DataFrame, source_name: str, extra: dict[str, str]) -> DataFrame:
    """Records of another feed under a new name, metadata overridden."""
    added = F.map_from_arrays(F.array(*map(F.lit, extra)), F.array(*map(F.lit, extra.values())))
    held = F.map_filter("metadata", lambda k, v: ~k.isin(*extra))
    return records.withColumns({"source_name": F.lit(source_name), "metadata": F.map_concat(held, added)})


def doi_json(payloads: DataFrame) -> DataFrame:
    """Works by DOI: lower case, first title, date parts with 1 for what is missing, authors joined; those without DOI, title or year are left out."""
    w = payloads.select(F.explode(F.from_json("payload", DOI)["items"]).alias("w")).select("w.*")
    parts = F.col("issued")["date-parts"][0]
    at = lambda i: F.coalesce(F.try_element_at(parts, F.lit(i)), F.lit(1))
    year = F.try_element_at(parts, F.lit(1))
    got = w.select(F.lower("DOI").alias("doi"), F.try_element_at("title", F.lit(1)).alias("title"), F.when(year.isNotNull(), F.make_date(year, at(2), at(3))).alias("published_on"), F.array_join(F.transform("author", lambda a: F.concat_ws(" ", a["given"], a["family"])), "; ").alias("authors"))
    return got.where("doi IS NOT NULL AND title IS NOT NULL AND published_on IS NOT NULL")


def html_links(pages: DataFrame, limit: int = 20, label: str = "text") -> DataFrame:
    """page_id, url, label, rank of the first `limit` distinct links of each page; label 'text' or 'aria'. No date is made up."""
    pattern = r'<a\s[^>]*?href="([^"]*)"[^>]*>([^<]*)</a>' if label == "text" else r'<a\s[^>]*?href="([^"]*)"[^>]*?aria-label="([^"]*)"'
    zipped = F.arrays_zip(F.regexp_extract_all("html", F.lit(pattern), 1).alias("url"), F.regexp_extract_all("html", F.lit(pattern), 2).alias("label"))
    found = pages.select("page_id", F.posexplode(zipped).alias("pos", "x")).select("page_id", "pos", F.col("x.url").alias("url"), F.trim(F.regexp_replace(F.col("x.label"), r"\s+", " ")).alias("label"))
    one = found.groupBy("page_id", "url").agg(F.min(F.struct("pos", "label")).alias("f"))
    from pyspark.sql import Window

    return one.select("page_id", "url", F.col("f.label").alias("label"), F.row_number().over(Window.partitionBy("page_id").orderBy("f.pos")).alias("rank")).where(F.col("rank") <= limit)


def snapshot_zip(snapshots: DataFrame, names: str, contexts: str) -> tuple[DataFrame, DataFrame]:
    """(rows, quarantine): the two arrays zipped by position; snapshots whose arrays differ in length apart."""
    same = F.size(names) == F.size(contexts)
    rows = snapshots.where(same).select("id", F.posexplode(F.arrays_zip(F.col(names).alias("name"), F.col(contexts).alias("value"))).alias("position", "x")).select("id", "position", "x.name", "x.value")
    return rows, snapshots.where(~same).select("id", F.lit("LENGTH_MISMATCH").alias("reason"))
