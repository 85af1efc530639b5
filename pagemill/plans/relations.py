"""Filters, joins, windows, aggregations, recursion and streams."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagemill import scratch
from pagemill.functions import expressions as E
from pagemill.functions import udfs
from pagemill.functions.relevance import STOP
from pagemill.operators import corpus, crawl, progress, robots, sitemaps
from pagemill.plans.common import SQL_FILE, SQL_HOST, SQL_PAGES, SQL_PATH, SQL_TITLE, parsed_table, plan, simple_pages, table
from pagemill.streaming import pages as streams

HOST = "example.com"


@plan("same_site", f"SELECT page_id, url FROM pages WHERE {SQL_HOST.format(x='url')} = '{HOST}' OR {SQL_HOST.format(x='url')} LIKE '%.{HOST}'")
def same_site(spark, d):
    return sitemaps.filter_same_site(table(spark, d, "pages").select("page_id", "url"), HOST)


@plan("match_filter", "SELECT page_id, url FROM pages WHERE url LIKE '%/en/%'")
def match_filter(spark, d):
    return table(spark, d, "pages").select("page_id", "url").where(F.col("url").contains("/en/"))


@plan("looks_like_sitemap", "SELECT page_id, lower(url) LIKE '%.xml' OR contains(lower(url), 'sitemap') AS hit FROM (SELECT page_id, CASE page_id % 3 WHEN 0 THEN url || '.XML' WHEN 1 THEN url || '/SiteMap/x' ELSE url END AS url FROM pages)")
def looks_like_sitemap(spark, d):
    url = F.when(F.col("page_id") % 3 == 0, F.concat("url", F.lit(".XML"))).when(F.col("page_id") % 3 == 1, F.concat("url", F.lit("/SiteMap/x"))).otherwise(F.col("url"))
    return table(spark, d, "pages").select("page_id", E.looks_like_sitemap(url).alias("hit"))


@plan("sitemap_seeds", "SELECT DISTINCT regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) AS origin, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) || '/news.xml,' || regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) || '/sitemap.xml,' || array_to_string(list_transform(['/sitemap_index.xml', '/sitemap-index.xml', '/sitemaps.xml'], lambda p: regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) || p), ',') AS seeds FROM pages")
def sitemap_seeds(spark, d):
    origin = E.url_origin(F.col("url"))
    listed = F.array(F.concat(origin, F.lit("/news.xml")), F.concat(origin, F.lit("/sitemap.xml")))
    return table(spark, d, "pages").select(origin.alias("origin"), F.array_join(sitemaps.seeds(listed, origin), ",").alias("seeds")).distinct()


@plan("llms_probe_filter", """SELECT doc_id, status BETWEEN 200 AND 299 AND NOT contains(lower(ctype), 'text/html') AND NOT starts_with(lower(ltrim(body)), '<!doctype') AND NOT starts_with(lower(ltrim(body)), '<html') AND strlen(trim(body)) >= 10 AS usable
FROM (SELECT doc_id, 200 + (doc_id % 7) * 50 AS status, CASE WHEN doc_id % 5 = 0 THEN 'Text/HTML' ELSE 'text/plain' END AS ctype, CASE WHEN doc_id % 11 = 0 THEN '  <!DOCTYPE html>' || text ELSE text END AS body FROM documents)""")
def llms_probe_filter(spark, d):
    k = F.col("doc_id")
    body = F.when(k % 11 == 0, F.concat(F.lit("  <!DOCTYPE html>"), "text")).otherwise(F.col("text"))
    kind = F.when(k % 5 == 0, F.lit("Text/HTML")).otherwise(F.lit("text/plain"))
    return table(spark, d, "documents").select("doc_id", E.usable_llms_body((200 + (k % 7) * 50).cast("int"), kind, body).alias("usable"))


@plan("retryable_status", "SELECT event_id, s AS status, s = 429 OR s BETWEEN 500 AND 599 AS retry FROM (SELECT event_id, 400 + event_id % 250 AS s FROM events)")
def retryable_status(spark, d):
    return table(spark, d, "events").select("event_id", (400 + F.col("event_id") % 250).alias("status")).withColumn("retry", E.retryable(F.col("status")))


@plan("search_filter", f"SELECT page_id FROM pages WHERE contains(lower(url), 'the') OR coalesce(contains(lower({SQL_TITLE.format(x='html')}), 'the'), false)")
def search_filter(spark, d):
    pages = table(spark, d, "pages").select("page_id", "url", E.title(F.col("html")).alias("title"))
    return progress.search(pages, "The").select("page_id")


@plan("dedup_first", f"SELECT host, min(page_id) AS ord, arg_min(url, page_id) AS url FROM (SELECT page_id, url, {SQL_HOST.format(x='url')} AS host FROM pages) GROUP BY host")
def dedup_first(spark, d):
    rows = table(spark, d, "pages").select(E.url_host(F.col("url")).alias("host"), F.col("page_id").alias("ord"), "url")
    return sitemaps.keep_first(rows, "host", "ord")


@plan("seen_difference", f"SELECT page_id, url FROM pages p WHERE NOT EXISTS (SELECT 1 FROM (SELECT min(page_id) AS page_id FROM pages GROUP BY {SQL_HOST.format(x='url')}) s WHERE s.page_id = p.page_id)")
def seen_difference(spark, d):
    """The frontier without what was seen: the first page of every host."""
    pages = table(spark, d, "pages").select("page_id", "url")
    seen = pages.groupBy(E.url_host(F.col("url")).alias("host")).agg(F.min("page_id").alias("page_id"))
    return pages.join(seen.select("page_id"), "page_id", "left_anti")


# ---------------------------------------------------------------- corpus texts

TOTALS = "count(*)::VARCHAR AS pages, coalesce(sum(tokens), 0)::BIGINT::VARCHAR AS tokens"


@plan("corpus_totals", f"WITH {SQL_PAGES} SELECT count(*) AS pages, sum(tokens)::BIGINT AS tokens FROM p")
def corpus_totals(spark, d):
    return simple_pages(spark, d).agg(F.count("*").alias("pages"), F.sum("tokens").cast("bigint").alias("tokens"))


@plan("site_index", f"WITH {SQL_PAGES}, t AS (SELECT {TOTALS}, string_agg('- [' || coalesce(title, url) || '](' || {SQL_FILE.format(x='url')} || ') — `' || {SQL_PATH.format(x='url')} || '` *(~' || tokens || ' tokens)*' || chr(10), '' ORDER BY ix) AS body FROM p) SELECT '# Documentation Index' || chr(10) || chr(10) || '- **Total Pages:** ' || pages || chr(10) || '- **Total Estimated Tokens:** ~' || tokens || chr(10) || chr(10) || body AS text FROM t")
def site_index(spark, d):
    return corpus.index(simple_pages(spark, d))


@plan("llms_txt", f"WITH {SQL_PAGES}, t AS (SELECT {TOTALS}, string_agg('- [' || coalesce(title, url) || '](' || {SQL_FILE.format(x='url')} || '): ' || {SQL_PATH.format(x='url')} || ' (~' || tokens || ' tokens)' || chr(10), '' ORDER BY ix) AS body FROM p) SELECT '# {HOST}' || chr(10) || chr(10) || '> Total documents: ' || pages || ' (~' || tokens || ' tokens)' || chr(10) || chr(10) || '## Documentation' || chr(10) || chr(10) || body AS text FROM t")
def llms_txt(spark, d):
    return corpus.llms_txt(simple_pages(spark, d), HOST)


@plan("full_context", f"""WITH {SQL_PAGES}, t AS (SELECT {TOTALS}, string_agg('<document index="' || ix || '" url="' || url || '" title="' || replace(coalesce(title, 'Untitled'), '"', '\\"') || '" tokens="' || tokens || '">' || chr(10) || regexp_replace(markdown, '\\A\\s+|\\s+\\z', '', 'g') || chr(10) || '</document>' || chr(10) || chr(10), '' ORDER BY ix) AS body FROM p) SELECT '# Full Documentation Context' || chr(10) || chr(10) || '- Total Documents: ' || pages || chr(10) || '- Total Estimated Tokens: ~' || tokens || chr(10) || chr(10) || body AS text FROM t""")
def full_context(spark, d):
    return corpus.full_context(simple_pages(spark, d))


@plan("concatenation", f"WITH {SQL_PAGES} SELECT string_agg(CASE WHEN ix > 1 THEN chr(10) || chr(10) || '---' || chr(10) || chr(10) ELSE '' END || regexp_replace(markdown, '\\s+\\z', ''), '' ORDER BY ix) || chr(10) AS text FROM p")
def concatenation(spark, d):
    return corpus.concatenation(simple_pages(spark, d))


@plan("json_lines", f"WITH {SQL_PAGES} SELECT ix, json_object('index', ix, 'markdown', markdown, 'title', title, 'tokens', tokens, 'url', url)::VARCHAR AS line FROM p")
def json_lines(spark, d):
    return corpus.json_lines(simple_pages(spark, d))


# ---------------------------------------------------------------- BM25

#: A question with a stop word, short words, and words that stemming changes; its terms after both.
QUERY, TERMS = "The stones and la und waters", ("stone", "la", "und", "water")
STOP_LIST = ", ".join(f"'{w}'" for w in sorted(STOP))
SQL_VOWEL = "regexp_matches({x}, '[aeiouy]')"
SQL_SHORTER = "(CASE WHEN {x} LIKE '%at' OR {x} LIKE '%bl' OR {x} LIKE '%iz' THEN {x} || 'e' WHEN length({x}) > 2 AND right({x}, 1) = substr({x}, length({x}) - 1, 1) AND NOT contains('lsz', right({x}, 1)) THEN left({x}, length({x}) - 1) ELSE {x} END)"
#: Porter's first step on words of three ASCII letters or more, in three parts; other words are marked and stay.
SQL_STEMS = [
    "CASE WHEN length(w) <= 2 OR regexp_matches(w, '[^\\x00-\\x7F]') THEN chr(1) || w WHEN w LIKE '%sses' OR w LIKE '%ies' THEN left(w, length(w) - 2) WHEN w LIKE '%s' AND w NOT LIKE '%ss' THEN left(w, length(w) - 1) ELSE w END",
    f"CASE WHEN starts_with(w, chr(1)) THEN w WHEN w LIKE '%eed' THEN CASE WHEN {SQL_VOWEL.format(x='left(w, length(w) - 3)')} THEN left(w, length(w) - 1) ELSE w END WHEN w LIKE '%ed' AND {SQL_VOWEL.format(x='left(w, length(w) - 2)')} THEN {SQL_SHORTER.format(x='left(w, length(w) - 2)')} WHEN w LIKE '%ing' AND {SQL_VOWEL.format(x='left(w, length(w) - 3)')} THEN {SQL_SHORTER.format(x='left(w, length(w) - 3)')} ELSE w END",
    f"CASE WHEN starts_with(w, chr(1)) THEN substr(w, 2) WHEN w LIKE '%y' AND {SQL_VOWEL.format(x='left(w, length(w) - 1)')} THEN left(w, length(w) - 1) || 'i' ELSE w END",
]
SQL_BLOCKS = r"""b0 AS (SELECT doc_id, text, generate_subscripts(l, 1)::INT - 1 AS ix, unnest(l) AS part FROM (SELECT doc_id, text, list_filter(list_transform(string_split(text, chr(10)), lambda p: regexp_replace(p, '\A\s+|\s+\z', '', 'g')), lambda p: p <> '') AS l FROM documents)),
b1 AS (SELECT *, starts_with(part, '#') AND NOT contains(part, chr(10)) AS heading FROM b0),
b2 AS (SELECT *, lag(heading) OVER w AS after, lag(part) OVER w AS before, lead(ix) OVER w AS next FROM b1 WINDOW w AS (PARTITION BY doc_id ORDER BY ix)),
b AS (SELECT doc_id, text, row_number() OVER (PARTITION BY doc_id ORDER BY ix) - 1 AS ix, CASE WHEN NOT heading AND coalesce(after, false) THEN before || chr(10) || chr(10) || part ELSE part END AS block FROM b2 WHERE NOT heading OR next IS NULL)"""
SQL_SCORES = SQL_BLOCKS + f",\nw0 AS (SELECT *, list_filter(regexp_extract_all(lower(block), '[\\p{{L}}\\p{{N}}_]+'), lambda w: w NOT IN ({STOP_LIST})) AS terms FROM b)"
for _k, _step in enumerate(SQL_STEMS):
    SQL_SCORES += f",\nw{_k + 1} AS (SELECT * REPLACE (list_transform(terms, lambda w: {_step}) AS terms) FROM w{_k})"
SQL_SCORES += ",\ns AS (SELECT *, len(terms) AS length, " + ", ".join(f"len(list_filter(terms, lambda x: x = '{q}')) AS tf{k}" for k, q in enumerate(TERMS)) + " FROM w3),\nn AS (SELECT *, count(*) OVER d AS n, CASE WHEN sum(length) OVER d = 0 THEN 1 ELSE avg(length) OVER d END AS mean, " + ", ".join(f"sum((tf{k} > 0)::INT) OVER d AS df{k}" for k in range(len(TERMS))) + " FROM s WINDOW d AS (PARTITION BY doc_id)),\nscored AS (SELECT doc_id, text, ix, block, n, " + " + ".join(f"CASE WHEN tf{k} > 0 THEN ln(1 + (n - df{k} + 0.5::DOUBLE) / (df{k} + 0.5::DOUBLE)) * tf{k} * 2.2::DOUBLE / (tf{k} + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * length / mean)) ELSE 0.0::DOUBLE END" for k in range(len(TERMS))) + " AS score FROM n)"


def _markdown() -> Column:
    """Texts whose lines are blocks."""
    return F.replace("text", F.lit("\n"), F.lit("\n\n"))


@plan("blocks", f"WITH {SQL_BLOCKS} SELECT doc_id, ix::INT AS ix, md5(block) AS digest FROM b")
def blocks(spark, d):
    found = parsed_table(spark, d, "documents").select("doc_id", F.posexplode(udfs.md_blocks(_markdown(), F.lit(""))).alias("ix", "b"))
    return found.select("doc_id", "ix", F.md5("b.block").alias("digest"))


@plan("bm25_scores", f"WITH {SQL_SCORES} SELECT doc_id, ix::INT AS ix, round(score, 6) AS score FROM scored")
def bm25_scores(spark, d):
    found = parsed_table(spark, d, "documents").select("doc_id", F.posexplode(udfs.md_blocks(_markdown(), F.lit(QUERY))).alias("ix", "b"))
    return found.select("doc_id", "ix", F.round("b.score", 6).alias("score"))


@plan("bm25_filter", f"""WITH {SQL_SCORES}, r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(score, 9) DESC, ix) AS rank FROM scored),
k AS (SELECT doc_id, n, string_agg(block, chr(10) || chr(10) ORDER BY ix) || chr(10) AS md FROM r WHERE rank <= greatest(1, floor(n * 0.4::DOUBLE + 0.5)) GROUP BY doc_id, n)
SELECT doc_id, md5(CASE WHEN n > 1 THEN md ELSE replace(text, chr(10), chr(10) || chr(10)) END) AS digest FROM documents LEFT JOIN k USING (doc_id)""")
def bm25_filter(spark, d):
    """What a run with a question keeps of each text."""
    return parsed_table(spark, d, "documents").select("doc_id", F.md5(udfs.md_filter(_markdown(), F.lit(QUERY))).alias("digest"))


# ---------------------------------------------------------------- robots, politeness, sitemaps, crawls

ROBOTS = "User-agent: *\nDisallow: /en\nAllow: /en/1\nAllow: /en/2*5\nDisallow: /*?\nDisallow: /fr$\nCrawl-delay: 0.05\nSitemap: https://example.com/sitemap.xml"
SQL_RULES = "(VALUES (false, '/en', '^/en'), (true, '/en/1', '^/en/1'), (true, '/en/2*5', '^/en/2.*5'), (false, '/*?', '^/.*\\?'), (false, '/fr$', '^/fr$')) r(allow, pattern, re)"


@plan("robots_longest_match", f"""WITH u AS (SELECT page_id, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) AS origin, coalesce(nullif(regexp_extract(url, '^[a-z]+://[^/?#]*([^#]*)', 1), ''), '/') AS path FROM pages)
SELECT page_id, coalesce((SELECT arg_max(allow, length(pattern) * 2 + allow::INT) FROM {SQL_RULES} WHERE regexp_matches(path, re) AND starts_with(origin, 'https')), true) AS allowed FROM u""")
def robots_longest_match(spark, d):
    """Origins over https have rules; the others have no robots.txt."""
    urls = table(spark, d, "pages").select("page_id", "url")
    origins = urls.where(F.col("url").startswith("https")).select(E.url_origin(F.col("url")).alias("origin")).distinct()
    rules = robots.parsed(origins.withColumn("body", F.lit(ROBOTS)))
    return robots.allowed(urls, rules).select("page_id", "allowed")


@plan("robots_sitemaps", "SELECT 'https://example.com/sitemap.xml' AS sitemap, 0.05::DOUBLE AS delay, count(DISTINCT regexp_extract(url, '^([a-z]+://[^/?#]*)', 1)) AS origins FROM pages")
def robots_sitemaps(spark, d):
    origins = table(spark, d, "pages").select(E.url_origin(F.col("url")).alias("origin")).distinct()
    parsed = robots.parsed(origins.withColumn("body", F.lit(ROBOTS)))
    return parsed.select("origin", "delay", F.explode("sitemaps").alias("sitemap")).groupBy("sitemap", "delay").agg(F.count("*").alias("origins"))


DELAY_US = 500_000
SQL_SCHEDULE = f"""WITH e AS (SELECT event_id, user_id, epoch_us(ts) AS arrived FROM events), n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY arrived, event_id) AS k FROM e)
SELECT event_id, (max(arrived - {DELAY_US} * k) OVER (PARTITION BY user_id ORDER BY k) + {DELAY_US} * k)::BIGINT AS start_us FROM n"""


@plan("politeness_schedule", SQL_SCHEDULE)
def politeness_schedule(spark, d):
    events = table(spark, d, "events").select("event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    return robots.schedule(events, "user_id", "at", ["event_id"], DELAY_US).select("event_id", "start_us")


@plan("stream_politeness", SQL_SCHEDULE)
def stream_politeness(spark, d):
    """The same by keyed state on a stream of one batch."""
    folder = scratch.folder(spark, "stream")
    events = table(spark, d, "events").select(F.col("user_id").cast("string").alias("origin"), F.lpad(F.col("event_id").cast("string"), 19, "0").alias("url"), F.unix_micros(F.col("ts").cast("timestamp")).alias("arrival_us"))
    events.write.parquet(f"{folder}/in")
    source = spark.readStream.schema(events.schema).parquet(f"{folder}/in")
    query = streams.limited(source, DELAY_US).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(f"{folder}/out").select(F.col("url").cast("long").alias("event_id"), "start_us")


@plan("stream_event_counters", "SELECT event_type AS kind, count(*) AS n FROM events GROUP BY event_type")
def stream_event_counters(spark, d):
    folder = scratch.folder(spark, "events")
    events = table(spark, d, "events").select(F.col("event_type").alias("kind"), F.lit(None).cast("long").alias("total"), F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("error"), F.col("ts").cast("timestamp").alias("ts"))
    events.write.parquet(f"{folder}/in")
    counts = streams.event_counters(spark.readStream.schema(events.schema).parquet(f"{folder}/in"))
    query = counts.writeStream.outputMode("complete").foreachBatch(lambda batch, k: batch.write.mode("overwrite").parquet(f"{folder}/out")).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(f"{folder}/out")


@plan("crawl_event_counters", "SELECT count(*) FILTER (kind = 'page_done') AS processed, count(*) FILTER (kind = 'error') AS errors, count(*) FILTER (kind = 'started') AS started, count(*) FILTER (kind = 'finished') AS finished FROM (SELECT CASE event_id % 10 WHEN 0 THEN 'error' WHEN 1 THEN 'started' WHEN 2 THEN 'finished' ELSE 'page_done' END AS kind FROM events)")
def crawl_event_counters(spark, d):
    k = F.col("event_id") % 10
    kind = F.when(k == 0, "error").when(k == 1, "started").when(k == 2, "finished").otherwise("page_done")
    return progress.counters(table(spark, d, "events").select(kind.alias("kind")))


@plan("crawl_throughput", "SELECT user_id, round(count(*) / (greatest(epoch_ms(max(ts)) - epoch_ms(min(ts)), 1) / 1000.0::DOUBLE), 6) AS rate, round(least(count(*) / 20.0::DOUBLE, 1.0), 6) AS share FROM events GROUP BY user_id")
def crawl_throughput(spark, d):
    events = table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n"), (F.unix_millis(F.max("ts").cast("timestamp")) - F.unix_millis(F.min("ts").cast("timestamp"))).alias("ms"))
    rate, share = progress.throughput(F.col("n"), F.col("ms"), F.lit(20))
    return events.select("user_id", F.round(rate, 6).alias("rate"), F.round(share, 6).alias("share"))


def _edges(spark, d):
    """Three links of every page, to pages by arithmetic."""
    pages = table(spark, d, "pages")
    n = pages.agg(F.count("*").alias("n"))
    return pages.crossJoin(F.broadcast(n)).select(F.col("page_id").alias("src"), F.posexplode(F.transform(F.sequence(F.lit(1), F.lit(3)), lambda k: (F.col("page_id") * 7 + k * 31 + k * F.col("page_id")) % F.col("n"))).alias("pos", "dst"))


SQL_EDGES = "e AS (SELECT page_id AS src, k - 1 AS pos, (page_id * 7 + k * 31 + k * page_id) % (SELECT count(*) FROM pages) AS dst FROM pages, range(1, 4) t(k))"


@plan("bfs_levels", f"WITH RECURSIVE {SQL_EDGES}, r(root, node, depth) AS (SELECT page_id, page_id, 0 FROM pages UNION SELECT root, dst, depth + 1 FROM r JOIN e ON src = node WHERE depth < 4) SELECT root, node, min(depth)::INT AS depth FROM r GROUP BY root, node")
def bfs_levels(spark, d):
    start = table(spark, d, "pages").select(F.col("page_id").alias("root"), F.col("page_id").alias("node"))
    edges = scratch.cut(_edges(spark, d))
    return crawl.bfs(edges, start, 4, None, scratch.cut).select("root", "node", "depth")


@plan("bfs_crawl")
def bfs_crawl(spark, d):
    start = table(spark, d, "pages").select(F.col("page_id").alias("root"), F.col("page_id").alias("node"))
    return crawl.bfs(scratch.cut(_edges(spark, d)), start, 3, 10, scratch.cut)


@plan("dfs_crawl")
def dfs_crawl(spark, d):
    """A crawl of every site of ten pages; each page links to three of its site."""
    page = F.col("page_id")
    home = page - page % 10
    links = F.transform(F.sequence(F.lit(1), F.lit(3)), lambda k: home + (page * 7 + k * k) % 10)
    edges = table(spark, d, "pages").select(home.alias("root"), page.alias("src"), F.posexplode(links).alias("pos", "dst"))
    return crawl.dfs(edges, 3, 10)


@plan("sitemap_recursive", f"SELECT DISTINCT url FROM pages WHERE {SQL_HOST.format(x='url')} = '{HOST}' OR {SQL_HOST.format(x='url')} LIKE '%.{HOST}'")
def sitemap_recursive(spark, d):
    """An index, ten sitemaps below it, and all pages of the table in them; off-site pages go."""
    loc = F.concat(F.lit("<url><loc>"), F.replace(F.col("url"), F.lit("&"), F.lit("&amp;")), F.lit("</loc></url>"))
    maps = table(spark, d, "pages").select((F.col("page_id") % 10).alias("m"), "page_id", loc.alias("loc")).groupBy("m").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_id", "loc"))), lambda r: r["loc"]), "").alias("body"))
    docs = maps.select(F.concat(F.lit("https://example.com/map-"), F.col("m").cast("string"), F.lit(".xml")).alias("url"), F.concat(F.lit("<urlset>"), "body", F.lit("</urlset>")).cast("binary").alias("body"))
    listed = "".join(f"<sitemap><loc>https://example.com/map-{k}.xml</loc></sitemap>" for k in range(10))
    index = spark.createDataFrame([("https://example.com/sitemap.xml", bytearray(f"<sitemapindex>{listed}</sitemapindex>".encode()))], "url string, body binary")
    return sitemaps.collect_urls(scratch.cut(docs.unionByName(index)), ["https://example.com/sitemap.xml"], HOST).select("url")


@plan("page_language_mix", "SELECT lang, count(*) AS pages, count(DISTINCT host) AS hosts FROM (SELECT regexp_extract(html, '<html lang=\"([a-z]+)\"', 1) AS lang, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host FROM pages) GROUP BY lang")
def page_language_mix(spark, d):
    pages = table(spark, d, "pages").select(F.regexp_extract("html", '<html lang="([a-z]+)"', 1).alias("lang"), F.regexp_extract("url", r"^[a-z]+://([^/?#]*)", 1).alias("host"))
    return pages.groupBy("lang").agg(F.count("*").alias("pages"), F.countDistinct("host").alias("hosts"))
