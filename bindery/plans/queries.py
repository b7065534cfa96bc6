"""Registered queries of the publication operators on the driver's tables, each with its SQL.

The tables stand in for the logical ones: a document is an entry whose words are its forms,
pages are content documents, conversations are navigation points, and events are measured lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codecs
from ..functions import text as T
from ..operators import images, layout, metadata, navigation, terms
from ..rules import lines as line_rules

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str = ""):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def words_of(spark, sf_dir):
    """doc_id, pos, word of every whole text: runs of letters."""
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit(r"(\p{L}+)"))).alias("pos", "word"))


_WORDS = r"""words AS (SELECT doc_id, unnest(range(0, len(w))) AS pos, unnest(w) AS word
  FROM (SELECT doc_id, regexp_extract_all(text, '\p{L}+') AS w FROM documents))"""
_FOLD = f"translate(lower(%s), {quoted(T.FOLD_FROM)}, {quoted(T.FOLD_TO)})"


@query(f"WITH {_WORDS} SELECT {_FOLD % 'word'} AS fold_key, count(*) AS n, count(DISTINCT word) AS spellings, min(encode(word)) = encode(min(word)) AS byte_order FROM words GROUP BY 1")
def fold_groups(spark, sf_dir):
    w = words_of(spark, sf_dir).groupBy("word").agg(F.count(F.lit(1)).alias("c"))
    g = w.withColumn("fold_key", T.fold_latin(F.col("word"))).groupBy("fold_key")
    return g.agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("spellings"), (F.min(F.col("word").cast("binary")) == F.min("word").cast("binary")).alias("byte_order"))


_ENTRY_SQL = r"""entries AS (SELECT doc_id AS entry_ord, w[1] AS headword, w[2:] AS inflections
  FROM (SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM documents) WHERE len(w) > 0)"""


def entries_of(spark, sf_dir):
    w = table(spark, sf_dir, "documents").select("doc_id", F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)")).alias("w")).where(F.size("w") > 0)
    return w.select(F.lit("all").alias("pkg_id"), F.col("doc_id").alias("entry_ord"), F.element_at("w", 1).alias("headword"), F.expr("slice(w, 2, size(w))").alias("inflections"))


@query(f"""WITH {_ENTRY_SQL},
base AS (SELECT headword AS label, 0 AS tier, -entry_ord AS rank, 0 AS k, entry_ord FROM entries
  UNION ALL SELECT label, 1, entry_ord, k, entry_ord FROM (SELECT entry_ord, unnest(inflections) AS label, unnest(range(0, len(inflections))) AS k FROM entries) WHERE NOT regexp_matches(label, '[()\\[\\]{{}}]')),
stress AS (SELECT replace(replace(label, chr(768), ''), chr(769), '') AS label, 2 AS tier, rank, k, entry_ord, label AS was FROM base),
folded AS (SELECT lower(label) AS label, 3 AS tier, rank, k, entry_ord, label AS was FROM base),
most AS (SELECT * FROM base UNION ALL SELECT label, tier, rank, k, entry_ord FROM stress WHERE label <> was UNION ALL SELECT label, tier, rank, k, entry_ord FROM folded WHERE label <> was),
spaced AS (SELECT translate(label, {quoted(T.EXOTIC_SPACES)}, {quoted(' ' * len(T.EXOTIC_SPACES))}) AS label, 4 AS tier, rank, k, entry_ord, label AS was FROM most),
every AS (SELECT * FROM most UNION ALL SELECT label, tier, rank, k, entry_ord FROM spaced WHERE label <> was)
SELECT label, tier, entry_ord, {_FOLD % 'label'} AS fold_key FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY tier, rank, k, entry_ord) AS place FROM every WHERE label <> '') WHERE place = 1""")
def term_precedence(spark, sf_dir):
    return terms.build_terms(entries_of(spark, sf_dir)).drop("pkg_id")


@query(f"""WITH {_ENTRY_SQL}, labels AS (SELECT DISTINCT unnest(list_append(inflections, headword)) AS label FROM entries)
SELECT label, row_number() OVER (ORDER BY encode({_FOLD % 'label'}), encode(label)) - 1 AS index_ord FROM labels""")
def term_order(spark, sf_dir):
    e = entries_of(spark, sf_dir)
    labels = e.select("pkg_id", F.explode(F.concat("inflections", F.array("headword"))).alias("label")).distinct()
    return terms.ordered_terms(labels.withColumn("fold_key", T.fold_latin(F.col("label")))).select("label", "index_ord")


@query(f"""WITH {_ENTRY_SQL}, terms AS (SELECT DISTINCT unnest(list_append(inflections, headword)) AS label FROM entries),
q AS (SELECT DISTINCT unnest(regexp_extract_all(text, '\\p{{L}}+')) AS query FROM benchmark),
hits AS (SELECT query, label, row_number() OVER (PARTITION BY query ORDER BY label <> query, encode(label)) AS k FROM q JOIN terms ON {_FOLD % 'label'} = {_FOLD % 'query'})
SELECT q.query, h.label, h.label = q.query AS exact FROM q LEFT JOIN hits h ON h.query = q.query AND h.k = 1""")
def lookup_tiers(spark, sf_dir):
    e = entries_of(spark, sf_dir)
    labels = e.select("pkg_id", F.explode(F.concat("inflections", F.array("headword"))).alias("label")).distinct()
    index = labels.withColumn("fold_key", T.fold_latin(F.col("label"))).withColumn("entry_ord", F.lit(0).cast("long"))
    q = table(spark, sf_dir, "benchmark").select(F.lit("all").alias("pkg_id"), F.explode(F.regexp_extract_all("text", F.lit(r"(\p{L}+)"))).alias("query")).distinct()
    return terms.lookup(index, q).select("query", "label", (F.col("label") == F.col("query")).alias("exact"))


@query(f"""WITH {_ENTRY_SQL}, terms AS (SELECT DISTINCT unnest(list_append(inflections, headword)) AS label FROM entries),
q AS (SELECT DISTINCT unnest(regexp_extract_all(text, '\\p{{L}}+')) AS query FROM benchmark),
t AS (SELECT query, 0 AS rank, query AS label FROM q UNION ALL SELECT query, 1, lower(query) FROM q),
hits AS (SELECT query, label, row_number() OVER (PARTITION BY query ORDER BY rank) AS k FROM t JOIN terms USING (label))
SELECT q.query, h.label FROM q LEFT JOIN hits h ON h.query = q.query AND h.k = 1""")
def lookup_plain(spark, sf_dir):
    e = entries_of(spark, sf_dir)
    index = e.select("pkg_id", F.explode(F.concat("inflections", F.array("headword"))).alias("label")).distinct().withColumn("entry_ord", F.lit(0).cast("long"))
    q = table(spark, sf_dir, "benchmark").select(F.lit("all").alias("pkg_id"), F.explode(F.regexp_extract_all("text", F.lit(r"(\p{L}+)"))).alias("query")).distinct()
    return terms.lookup(index, q, "plain").select("query", "label")


@query(r"""SELECT lang AS pkg_id, sum(length(regexp_replace(text, '\P{L}', '', 'g')))::BIGINT AS letters, sum(length(regexp_replace(text, '[^A-Za-zªºÀ-ÖØ-öø-ɏ]', '', 'g')))::BIGINT AS latin,
 sum(length(regexp_replace(text, '[^Ѐ-ԯ]', '', 'g')))::BIGINT AS cyrillic, sum(length(regexp_replace(text, '[^Ͱ-Ͽἀ-῿]', '', 'g')))::BIGINT AS greek,
 2 * latin > letters AS is_latin, 2 * cyrillic > letters AS is_cyrillic FROM documents GROUP BY 1""")
def script_majority(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("lang").alias("pkg_id"), F.col("text").alias("headword"))
    return terms.script_majority(d)


@query(f"""WITH c AS (SELECT DISTINCT lang AS pkg_id, unnest(string_split(text, '')) AS char FROM documents)
SELECT pkg_id, char, unicode(char) AS code_point, {_FOLD % 'char'} AS base, dense_rank() OVER (PARTITION BY pkg_id ORDER BY encode({_FOLD % 'char'})) AS weight,
 row_number() OVER (PARTITION BY pkg_id ORDER BY unicode(char)) AS symbol_no FROM c""")
def symbol_table(spark, sf_dir):
    return terms.symbol_table(table(spark, sf_dir, "documents").select(F.col("lang").alias("pkg_id"), F.col("text").alias("label")))


_INDEX_SQL = r"""dict AS (SELECT doc_id // 500 AS pkg_id, doc_id AS entry_ord, w[1] AS headword, w[2:] AS inflections, text AS html
  FROM (SELECT doc_id, text, regexp_extract_all(text, '\p{L}+') AS w FROM documents) WHERE len(w) > 0),
keyed AS (SELECT *, encode(translate(headword, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS key FROM
  (SELECT *, row_number() OVER (PARTITION BY pkg_id, headword ORDER BY entry_ord) AS k FROM dict) WHERE k = 1),
idx AS (SELECT pkg_id, headword, inflections, key, row_number() OVER (PARTITION BY pkg_id ORDER BY key, entry_ord) - 1 AS idx, octet_length(encode(html)) AS size,
  coalesce(sum(octet_length(encode(html))) OVER (PARTITION BY pkg_id ORDER BY key, entry_ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset" FROM keyed)"""


def _dictionary(spark, sf_dir):
    """500 documents make a dictionary."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text", F.regexp_extract_all("text", F.lit(r"(\p{L}+)")).alias("w")).where(F.size("w") > 0)
    return d.select(F.expr("doc_id div 500").alias("pkg_id"), F.col("doc_id").alias("entry_ord"), F.element_at("w", 1).alias("headword"), F.expr("slice(w, 2, size(w))").alias("inflections"), F.col("text").alias("html"))


@query(f'WITH {_INDEX_SQL} SELECT pkg_id, headword, idx, size, "offset" FROM idx')
def stardict_index(spark, sf_dir):
    return terms.inverted_index(_dictionary(spark, sf_dir))[0].select("pkg_id", "headword", "idx", "size", "offset")


@query(f"""WITH {_INDEX_SQL}, forms AS (SELECT pkg_id, idx, unnest(inflections) AS form FROM idx)
SELECT DISTINCT pkg_id, form, idx FROM forms f WHERE NOT EXISTS (SELECT 1 FROM idx i WHERE i.pkg_id = f.pkg_id AND i.key = encode(translate(f.form, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')))""")
def stardict_synonyms(spark, sf_dir):
    return terms.inverted_index(_dictionary(spark, sf_dir))[1].select("pkg_id", "form", "idx")


@query(f"""WITH {_ENTRY_SQL}, f AS (SELECT entry_ord, unnest(list_prepend(headword, inflections)) AS form, unnest(range(0, 1 + len(inflections))) AS k FROM entries),
one AS (SELECT entry_ord, form, min(k) AS k FROM f GROUP BY 1, 2)
SELECT entry_ord, string_agg(form, chr(10) ORDER BY k) AS forms FROM one GROUP BY 1""")
def search_key_map(spark, sf_dir):
    return terms.search_forms(entries_of(spark, sf_dir)).select("entry_ord", F.array_join("forms", "\n").alias("forms"))


@query("""WITH d AS (SELECT doc_id, octet_length(encode(text)) AS n FROM documents)
SELECT doc_id, rec_no::INTEGER AS rec_no, rec_no * 4096 AS "begin", least(4096, n - rec_no * 4096) AS bytes FROM (SELECT doc_id, n, unnest(range(0, (n - 1) // 4096 + 1)) AS rec_no FROM d WHERE n > 0)""")
def record_ranges(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.octet_length("text").cast("long").alias("n"))
    return layout.record_ranges(d, "n").select("doc_id", "rec_no", "begin", "bytes")


@query("""SELECT doc_id // 500 AS file_id, doc_id, octet_length(encode(text))::BIGINT AS size, coalesce(sum(octet_length(encode(text))) OVER (PARTITION BY doc_id // 500 ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT
 + 78 + 8 * count(*) OVER (PARTITION BY doc_id // 500) + 2 AS "offset" FROM documents""")
def record_offsets(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.expr("doc_id div 500").alias("file_id"), F.col("doc_id").alias("rec_no"), F.octet_length("text").cast("long").alias("size"))
    return layout.record_table(d).select("file_id", F.col("rec_no").alias("doc_id"), "size", "offset")


@query("""WITH RECURSIVE d AS (SELECT doc_id // 500 AS pkg_id, doc_id, octet_length(encode(text))::BIGINT AS size, row_number() OVER (PARTITION BY doc_id // 500 ORDER BY doc_id) AS r FROM documents),
w AS (SELECT pkg_id, doc_id, size, r, 0::BIGINT AS bin, 0::BIGINT AS bin_offset FROM d WHERE r = 1
  UNION ALL SELECT d.pkg_id, d.doc_id, d.size, d.r, CASE WHEN w.bin_offset + w.size > 0 AND w.bin_offset + w.size + d.size > 64000 THEN w.bin + 1 ELSE w.bin END, CASE WHEN w.bin_offset + w.size > 0 AND w.bin_offset + w.size + d.size > 64000 THEN 0 ELSE w.bin_offset + w.size END
  FROM w JOIN d ON d.pkg_id = w.pkg_id AND d.r = w.r + 1)
SELECT pkg_id, doc_id, size, bin, bin_offset FROM w""")
def greedy_index_records(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.expr("doc_id div 500").alias("pkg_id"), "doc_id", F.octet_length("text").cast("long").alias("size"))
    return layout.greedy_pack(d, "size", "doc_id", "pkg_id")


_TURNS = """t AS (SELECT conv_id, turn, length(text) AS length, coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM conversations)"""


@query(f"""WITH {_TURNS}, total AS (SELECT conv_id, sum(length) AS n FROM t GROUP BY 1), r AS (SELECT conv_id, rec_no, rec_no * 256 AS rec_start, least(n, rec_no * 256 + 256) AS rec_end FROM (SELECT conv_id, n, unnest(range(0, ((n - 1) // 256 + 1)::BIGINT)) AS rec_no FROM total WHERE n > 0))
SELECT t.conv_id, t.turn, r.rec_no, CASE WHEN start < rec_start AND start + length > rec_end THEN 'spans' WHEN start < rec_start THEN 'ends' WHEN start + length > rec_end THEN 'starts' ELSE 'completes' END AS class
FROM t JOIN r ON t.conv_id = r.conv_id AND t.start < r.rec_end AND t.start + t.length > r.rec_start WHERE t.length > 0""")
def interval_overlap(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.length("text").cast("long").alias("length"))
    nodes = layout.running_offsets(c, "length", ["turn"], ["conv_id"]).withColumnRenamed("offset", "start")
    total = c.groupBy("conv_id").agg(F.sum("length").alias("n"))
    records = layout.record_ranges(total, "n", 256).select("conv_id", F.col("rec_no").cast("long").alias("rec_no"), F.col("begin").alias("rec_start"), (F.col("begin") + F.col("bytes")).alias("rec_end"))
    return layout.overlaps(nodes, records, "conv_id", 256).select("conv_id", "turn", "rec_no", "class")


_DEPTH = "CASE role WHEN 'system' THEN 0 WHEN 'user' THEN 1 ELSE 2 END"


@query(f"""WITH p AS (SELECT conv_id, turn AS ord, {_DEPTH} AS d, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations),
c AS (WITH RECURSIVE r AS (SELECT conv_id, ord, k, 0 AS depth FROM p WHERE k = 1 UNION ALL SELECT p.conv_id, p.ord, p.k, least(p.d, r.depth + 1) FROM r JOIN p ON p.conv_id = r.conv_id AND p.k = r.k + 1) SELECT * FROM r)
SELECT a.conv_id, a.ord, a.depth, (SELECT max(b.ord) FROM c b WHERE b.conv_id = a.conv_id AND b.ord < a.ord AND b.depth = a.depth - 1) AS parent,
 (SELECT min(b.ord) FROM c b WHERE b.conv_id = a.conv_id AND b.ord > a.ord AND b.depth <= a.depth) AS subtree_end,
 row_number() OVER (PARTITION BY a.conv_id ORDER BY a.depth, a.ord) - 1 AS bfs_no FROM c a""")
def navigation_tree(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    depth = F.when(F.col("role") == "system", 0).when(F.col("role") == "user", 1).otherwise(2)
    points = c.select("conv_id", F.col("turn").alias("ord"), depth.alias("depth"))
    return navigation.tree(navigation.clamp_depths(points, "conv_id"), "conv_id").select("conv_id", "ord", "depth", "parent", "subtree_end", "bfs_no")


@query("""WITH p AS (SELECT user_id, event_id, value, lag(value) OVER (PARTITION BY user_id ORDER BY event_id) AS previous FROM events)
SELECT user_id, event_id, value, previous FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM p WHERE value < previous) WHERE k = 1""")
def order_inversion(spark, sf_dir):
    return navigation.first_inversion(table(spark, sf_dir, "events").select("user_id", "event_id", "value"), "user_id", "event_id", "value")


@query("""WITH RECURSIVE item AS (SELECT doc_id // 50 AS pkg_id, doc_id AS id, doc_id // 50 * 50 + CASE WHEN doc_id % 7 = 0 THEN (doc_id * 31 + 5) % 50 ELSE doc_id % 50 // 2 END AS next FROM documents),
walk AS (SELECT pkg_id, id AS start, next AS at, [id] AS path FROM item UNION ALL SELECT w.pkg_id, w.start, i.next, list_append(w.path, w.at) FROM walk w JOIN item i ON i.id = w.at WHERE NOT list_contains(w.path, w.at))
SELECT i.pkg_id, i.id, coalesce(bool_or(w.at IN (SELECT doc_id FROM documents WHERE doc_id % 11 = 3) AND NOT list_contains(w.path, w.at)), false) AS reaches FROM item i LEFT JOIN walk w ON w.start = i.id GROUP BY 1, 2""")
def fallback_closure(spark, sf_dir):
    """50 documents make a package."""
    d = table(spark, sf_dir, "documents").withColumn("pkg_id", F.expr("doc_id div 50"))
    nxt = F.col("pkg_id") * 50 + F.when(F.col("doc_id") % 7 == 0, (F.col("doc_id") * 31 + 5) % 50).otherwise(F.expr("(doc_id % 50) div 2"))
    items = d.select("pkg_id", F.col("doc_id").alias("id"), nxt.alias("next"))
    return navigation.reaches(items, d.where("doc_id % 11 = 3").select("pkg_id", F.col("doc_id").alias("id"))).select("pkg_id", "id", "reaches")


@query("SELECT page_id, length(regexp_replace(html, '<[^>]*(>|$)|>', '', 'g')) AS n FROM pages")
def strip_tags_len(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.strip_tags_len(F.col("html")).alias("n"))


_LINES = r"""lines AS (SELECT page_id, unnest(range(1, len(l) + 1)) AS line, unnest(l) AS text FROM (SELECT page_id, CASE WHEN s[-1] = '' THEN s[1:len(s) - 1] ELSE s END AS l FROM
  (SELECT page_id, list_transform(string_split(html, chr(10)), lambda x: regexp_replace(x, '\r$', '')) AS s FROM pages)))"""


@query(f"""WITH {_LINES}, tags AS (SELECT unnest([{', '.join(map(quoted, line_rules.UNSUPPORTED_TAGS))}]) AS tag)
SELECT page_id, line::INTEGER AS line, tag FROM lines, tags WHERE regexp_matches(text, '(?i)<' || tag || '([\\s>/]|$)')""")
def unsupported_tag_lines(spark, sf_dir):
    return line_rules.unsupported_tags(table(spark, sf_dir, "pages"), "page_id", "html")


@query(r"""SELECT page_id, unnest(range(0, len(h))) AS ord, regexp_extract(unnest(h), '"([^"]*)"', 1) AS url, CASE WHEN url = '' THEN 'empty' WHEN regexp_matches(url, '[\s\x00-\x1F<>]') THEN 'malformed'
 WHEN starts_with(lower(url), 'data:') THEN 'data' WHEN starts_with(lower(url), 'file:') THEN 'file' WHEN regexp_matches(url, '^[A-Za-z][A-Za-z0-9+.-]*:') OR starts_with(url, '//') THEN 'external'
 WHEN starts_with(url, '#') THEN 'same_document' WHEN starts_with(url, '../') THEN 'escapes' WHEN contains(url, '?') THEN 'internal_query' ELSE 'internal' END AS class
FROM (SELECT page_id, regexp_extract_all(html, 'href="[^"]*"') AS h FROM pages)""")
def href_classes(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(r'href="([^"]*)"'))).alias("ord", "url"))
    return p.select("page_id", F.col("ord").cast("long").alias("ord"), "url", T.url_class(F.col("url")).alias("class"))


_URLS = ["a.xhtml", "a.xhtml?x=1", "../up.xhtml", "b/../c.xhtml#f", "data:image/png,x", "file:///etc", "http://example.org/a?b#c", "mailto:a@b", "", "#top", "a b.xhtml", "x/../../y", "%2e/a", "//host/p", "a#b?c"]


@query(f"""WITH v AS (SELECT unnest([{', '.join(map(quoted, _URLS))}]) AS url UNION SELECT url FROM pages UNION SELECT unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) FROM pages), f AS (SELECT url, CASE WHEN contains(url, '#') THEN url[1:strpos(url, '#') - 1] ELSE url END AS rest, CASE WHEN contains(url, '#') THEN url[strpos(url, '#') + 1:] END AS fragment FROM v)
SELECT url, CASE WHEN contains(rest, '?') THEN rest[1:strpos(rest, '?') - 1] ELSE rest END AS path, CASE WHEN contains(rest, '?') THEN rest[strpos(rest, '?') + 1:] END AS "query", fragment FROM f""")
def url_parts(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    found = p.select("url").unionByName(p.select(F.explode(F.regexp_extract_all("html", F.lit(r'href="([^"]*)"'))).alias("url")))
    v = spark.createDataFrame([(u,) for u in _URLS], "url string").unionByName(found).distinct()
    return v.select("url", T.split_url(F.col("url")).alias("s")).select("url", "s.*")


@query(r"""WITH e AS (SELECT page_id, unnest(range(0, len(m))) AS k, unnest(m) AS name FROM (SELECT page_id, regexp_extract_all(html, '&([A-Za-z][A-Za-z0-9]*);', 1) AS m FROM pages))
SELECT page_id, name FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY k) AS r FROM e WHERE name NOT IN (""" + ", ".join(map(quoted, line_rules.ALLOWED_ENTITIES)) + ")) WHERE r = 1")
def undeclared_entity(spark, sf_dir):
    return line_rules.undeclared_entities(table(spark, sf_dir, "pages"), "page_id", "html")


@query(r"""SELECT page_id, (length(html) - length(replace(lower(html), '<tr', '')[1:999999999]))  // 3 AS rows_upper, len(regexp_extract_all(html, '(?i)<p[\s>]')) AS paragraphs, len(regexp_extract_all(html, '(?i)<h[1-6][\s>]')) AS headings FROM pages""")
def tag_counts(spark, sf_dir):
    p, h = table(spark, sf_dir, "pages"), F.col("html")
    count = lambda x: F.size(F.regexp_extract_all(h, F.lit(x), F.lit(0))).cast("long")
    return p.select("page_id", F.expr("cast((length(html) - length(replace(lower(html), '<tr', ''))) div 3 as long)").alias("rows_upper"), count(r"(?i)<p[\s>]").alias("paragraphs"), count(r"(?i)<h[1-6][\s>]").alias("headings"))


@query(r"""WITH RECURSIVE t AS (SELECT page_id, regexp_extract_all(html, '(?i)<(/?p)[\s>]', 1) AS tags FROM pages),
w AS (SELECT page_id, 1 AS k, 0 AS depth, false AS nested FROM t UNION ALL SELECT w.page_id, k + 1, CASE WHEN lower(tags[k]) = 'p' THEN depth + 1 ELSE greatest(depth - 1, 0) END, lower(tags[k]) = 'p' AND depth >= 1 FROM w JOIN t USING (page_id) WHERE k <= len(tags))
SELECT page_id, bool_or(nested) AS nested, max(depth) AS deepest FROM w GROUP BY 1""")
def nested_paragraphs(spark, sf_dir):
    return line_rules.nested_paragraphs(table(spark, sf_dir, "pages"), "page_id", "html")


@query("""WITH f AS (SELECT page_id, 'link' AS section, CASE WHEN url[-1] IN ('0', '2', '4', '6', '8') THEN 3 ELSE 4 END AS level FROM pages UNION ALL SELECT page_id, 'text', CASE WHEN length(html) > 2000 THEN 3 ELSE 2 END FROM pages)
SELECT section, count(*) FILTER (level = 4) AS errors, count(*) FILTER (level = 3) AS warnings, count(*) FILTER (level = 2) AS infos FROM f GROUP BY 1""")
def severity_counts(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    even = F.substring("url", -1, 1).isin("0", "2", "4", "6", "8")
    found = p.select("page_id", F.lit("link").alias("section"), F.when(even, 3).otherwise(4).alias("level")).unionByName(p.select("page_id", F.lit("text").alias("section"), F.when(F.length("html") > 2000, 3).otherwise(2).alias("level")))
    return line_rules.severity_counts(found, "section")


@query("""WITH v AS (SELECT p_name AS name, p_partkey AS id FROM part UNION ALL SELECT upper(p_name), -p_partkey FROM part WHERE p_partkey % 10 = 0)
SELECT lower(name) AS fold, count(DISTINCT name) AS spellings, min(name) AS first_spelling, max(name) AS last_spelling FROM v GROUP BY 1 HAVING count(DISTINCT name) > 1""")
def casefold_duplicates(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    names = p.select(F.col("p_name").alias("name")).unionByName(p.where("p_partkey % 10 = 0").select(F.upper("p_name").alias("name")))
    return metadata.case_duplicates(names, "name")


@query("SELECT lower(p_name) AS href, count(*) AS n, min(p_partkey) AS first_id FROM part GROUP BY 1 HAVING count(*) > 1")
def duplicate_hrefs(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.groupBy(F.lower("p_name").alias("href")).agg(F.count(F.lit(1)).alias("n"), F.min("p_partkey").alias("first_id")).where("n > 1")


@query(r"""SELECT p_partkey, array_to_string(list_transform(regexp_extract_all(lower(p_name || ' ' || p_partkey || p_brand), '\d+|\D+'), lambda x: CASE WHEN regexp_matches(x, '^\d') THEN lpad(ltrim(x, '0'), 20, '0') ELSE x END), '|') AS key FROM part""")
def natural_key(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    name = F.concat("p_name", F.lit(" "), F.col("p_partkey").cast("string"), "p_brand")
    parts = F.transform(T.natural_key(name), lambda x: F.when(x["number"].isNotNull(), F.lpad(x["number"].cast("string"), 20, "0")).otherwise(x["text"]))
    return p.select("p_partkey", F.array_join(parts, "|").alias("key"))


_DATES = ["2024", "2024-13", "2023-02-30", "2024-02-29", "2024-02-29T24:00:00Z", "2024-02-29T23:59:59Z", "2024-02-29T23:59:59+01:00", "24", "", "2024-1", "2024-00", "2024-04-31", "2024-02-29T12:60:00Z"]


@query(f"""WITH v AS (SELECT unnest([{', '.join(map(quoted, _DATES))}]) AS value UNION ALL SELECT strftime(o_orderdate, '%Y-%m-%d') FROM orders), p AS (SELECT DISTINCT value, regexp_matches(value, {quoted(T.W3CDTF)}) AS ok, regexp_extract(value, {quoted(T.W3CDTF)}, 2) AS mo, regexp_extract(value, {quoted(T.W3CDTF)}, 3) AS d, regexp_extract(value, {quoted(T.W3CDTF)}, 4) AS hh, regexp_extract(value, {quoted(T.W3CDTF)}, 5) AS mi, regexp_extract(value, {quoted(T.W3CDTF)}, 6) AS ss FROM v)
SELECT value, CASE WHEN NOT ok THEN 'bad_syntax' WHEN (mo = '' OR try_cast(mo AS INTEGER) BETWEEN 1 AND 12) AND (d = '' OR try_cast(value[1:10] AS DATE) IS NOT NULL) AND (hh = '' OR (try_cast(hh AS INTEGER) <= 23 AND try_cast(mi AS INTEGER) <= 59 AND try_cast(ss AS INTEGER) <= 59)) THEN 'valid' ELSE 'bad_value' END AS kind FROM p""")
def w3cdtf(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("value"))
    v = spark.createDataFrame([(x,) for x in _DATES], "value string").unionByName(o).distinct()
    return v.select("value", T.w3cdtf_kind(F.col("value")).alias("kind"))


_TAGS = ["en", "en-US", "zh-Hant", "zh-HANT-TW", "EN", "e", "sr-Latn-RS", "de-419", "x-klingon", "en-us", "", "00000000-0000-1000-8000-000000000000", "00000000-0000-6000-8000-000000000000", "_a.b-c", "9a", "a:b"]


@query(f"""SELECT value, regexp_matches(value, {quoted(T.BCP47_METADATA)}) AS bcp47_metadata, regexp_matches(value, {quoted(T.BCP47_DICTIONARY)}) AS bcp47_dictionary, regexp_matches(value, {quoted(T.UUID)}) AS uuid, regexp_matches(value, {quoted(T.NCNAME)}) AS ncname FROM (SELECT unnest([{', '.join(map(quoted, _TAGS))}]) AS value UNION ALL SELECT DISTINCT lang FROM documents)""")
def identifier_shapes(spark, sf_dir):
    v = spark.createDataFrame([(x,) for x in _TAGS], "value string").unionByName(table(spark, sf_dir, "documents").select(F.col("lang").alias("value")).distinct())
    x = F.col("value")
    return v.select("value", x.rlike(T.BCP47_METADATA).alias("bcp47_metadata"), x.rlike(T.BCP47_DICTIONARY).alias("bcp47_dictionary"), x.rlike(T.UUID).alias("uuid"), x.rlike(T.NCNAME).alias("ncname"))


@query(f"""WITH l(k, v) AS (VALUES {', '.join(f"('{k}', {v})" for k, v in T.LOCALES.items())}), d AS (SELECT doc_id, lang, split_part(lower(lang), '-', 1) AS p FROM documents)
SELECT doc_id, lang, CASE WHEN p IN ('ko', 'fr') THEN coalesce(v, 1033) ELSE coalesce(v, 1033) & 1023 END AS locale FROM d LEFT JOIN l ON l.k = d.p""")
def locale_codes(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "lang", T.locale_code(F.col("lang")).alias("locale"))


@query(r"""SELECT page_id, replace(replace(replace(replace(replace(replace(html, '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&apos;', ''''), '&nbsp;', chr(160)) AS plain, md5(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&apos;')) AS escaped FROM pages""")
def entity_text(spark, sf_dir):
    h = F.col("html")
    return table(spark, sf_dir, "pages").select("page_id", T.unescape_named(h).alias("plain"), F.md5(T.xml_escape(h, True)).alias("escaped"))


@query("SELECT c_custkey, md5(c_name) AS md5, sha1(c_name) AS sha1, octet_length(encode(c_name)) AS bytes, row_number() OVER (PARTITION BY c_nationkey ORDER BY encode(lower(c_name)), c_custkey) AS place FROM customer")
def hashes_and_order(spark, sf_dir):
    from pyspark.sql import Window

    c = table(spark, sf_dir, "customer")
    place = F.row_number().over(Window.partitionBy("c_nationkey").orderBy(T.ascii_key(F.col("c_name")), "c_custkey"))
    return c.select("c_custkey", F.md5("c_name").alias("md5"), F.sha1("c_name").alias("sha1"), F.octet_length("c_name").cast("long").alias("bytes"), place.alias("place"))


@query("SELECT event_id, lpad(substr('0123456789ABCDEFGHIJKLMNOPQRSTUV', (event_id // 32768 % 32 + 1)::INTEGER, 1) || substr('0123456789ABCDEFGHIJKLMNOPQRSTUV', (event_id // 1024 % 32 + 1)::INTEGER, 1) || substr('0123456789ABCDEFGHIJKLMNOPQRSTUV', (event_id // 32 % 32 + 1)::INTEGER, 1) || substr('0123456789ABCDEFGHIJKLMNOPQRSTUV', (event_id % 32 + 1)::INTEGER, 1), 4, '0') AS code FROM events")
def base32_index(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", T.base32_index(F.col("event_id")).alias("code"))


def _fnv_sql(codes: str) -> str:
    """FNV-1a of a list of bytes: 128-bit numbers hold the product before it is cut to 64 bits."""
    return f"list_reduce(list_prepend({codecs.FNV_OFFSET}::UHUGEINT, [x::UHUGEINT FOR x IN {codes}]), lambda h, b: (xor(h, b) * {codecs.FNV_PRIME}::UHUGEINT) & 18446744073709551615::UHUGEINT)"


@query(f"""WITH c AS (SELECT c_custkey, [ascii(x) FOR x IN string_split(c_name, '')] AS b FROM customer),
h AS (SELECT c_custkey, lpad(printf('%016x', ({_fnv_sql("b")})::UBIGINT), 16, '0') AS fnv, lpad(printf('%016x', ({_fnv_sql("list_reverse(b)")})::UBIGINT), 16, '0') AS back FROM c)
SELECT c_custkey, fnv, fnv[1:8] || '-' || fnv[9:12] || '-4' || fnv[14:16] || '-' || translate(back[1:1], '0123456789abcdef', '89ab89ab89ab89ab') || back[2:4] || '-' || back[5:16] AS uuid FROM h""")
def fnv_and_uuid(spark, sf_dir):
    from ..functions.codecs import fnv1a_hex, uuid_of

    return table(spark, sf_dir, "customer").select("c_custkey", fnv1a_hex("c_name").alias("fnv"), uuid_of("c_name").alias("uuid"))


@query()
def compressed_records(spark, sf_dir):
    from ..functions.codecs import compressed

    d = table(spark, sf_dir, "documents").select("doc_id", F.col("text").cast("binary").alias("raw"), F.octet_length("text").cast("long").alias("n"))
    r = layout.record_ranges(d, "n")
    return r.select("doc_id", "rec_no", "bytes", F.octet_length(compressed(F.expr("substring(raw, cast(begin as int) + 1, 4096)"))).alias("packed"))


# --- lines of pixels: events stand in for measured rows, a user for a page ------------------


@query("""WITH m AS (SELECT user_id, event_id, value > 50 AS ink, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS y FROM events), g AS (SELECT *, y - row_number() OVER (PARTITION BY user_id, ink ORDER BY y) AS island FROM m)
SELECT user_id, min(y) AS first_y, max(y) AS last_y, count(*) AS height FROM g WHERE NOT ink GROUP BY user_id, island""")
def gutter_islands(spark, sf_dir):
    e = images.numbered(table(spark, sf_dir, "events"), "user_id", "event_id")
    return images.runs(e.withColumn("flag", F.col("value") <= 50), "user_id", "y", "flag")


@query("""WITH m AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS y FROM events)
SELECT user_id, y, round(avg(value) OVER (PARTITION BY user_id ORDER BY y ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 6) AS mean FROM m""")
def window_mean(spark, sf_dir):
    e = images.numbered(table(spark, sf_dir, "events"), "user_id", "event_id")
    return images.smoothed(e, "user_id", "y", "value").select("user_id", "y", F.round("mean", 6).alias("mean"))


@query("""WITH m AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS y FROM events), s AS (SELECT user_id, y, round(avg(value) OVER (PARTITION BY user_id ORDER BY y ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 6) AS mean FROM m)
SELECT user_id, mean AS best_mean, y AS best_y FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY mean, y) AS k FROM s) WHERE k = 1 AND mean <= 100""")
def best_gutter(spark, sf_dir):
    e = images.numbered(table(spark, sf_dir, "events"), "user_id", "event_id")
    return images.best_gutter(e, "user_id", "y", "value")


@query("""WITH h AS (SELECT l_returnflag AS page, l_quantity::INTEGER AS luma, count(*) AS n FROM lineitem GROUP BY 1, 2), c AS (SELECT *, sum(n) OVER (PARTITION BY page ORDER BY luma) AS low, sum(n) OVER (PARTITION BY page) AS total FROM h)
SELECT page, min(luma) FILTER (low * 200 >= total) AS low_clip, max(luma) FILTER ((total - low + n) * 200 >= total) AS high_clip, max(total)::BIGINT AS pixels FROM c GROUP BY 1""")
def histogram_clip(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("page"), F.col("l_quantity").cast("int").alias("luma"))  # noqa: E741
    return images.clip_points(l, "page", "luma")


@query("""WITH m AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS y FROM events), e AS (SELECT user_id, y, value, first_value(value) OVER (PARTITION BY user_id ORDER BY y) AS edge, count(*) OVER (PARTITION BY user_id) AS n FROM m)
SELECT user_id, max(n) AS n, coalesce(min(y) FILTER (abs(value - edge) > 20) - 1, 0) AS border, coalesce(min(y) FILTER (abs(value - edge) > 20) - 1, 0) * 50 >= max(n) AS cropped FROM e GROUP BY 1""")
def border_extents(spark, sf_dir):
    e = images.numbered(table(spark, sf_dir, "events"), "user_id", "event_id")
    return images.borders(e, "user_id", "y", "value")


@query("""SELECT user_id AS page, round(avg(value), 6) AS mean, round(var_pop(value), 4) AS variance, round(avg(CASE WHEN value > 50 THEN 1.0 ELSE 0.0 END), 6) AS ink FROM events GROUP BY 1""")
def line_statistics(spark, sf_dir):
    return images.line_statistics(table(spark, sf_dir, "events"), "user_id", "value").withColumnRenamed("user_id", "page")


@query("""SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY floor(value / 5), floor(event_id % 100), event_id) AS ltr, row_number() OVER (PARTITION BY user_id ORDER BY floor(value / 5), floor(event_id % 100) DESC, event_id) AS rtl FROM events""")
def reading_order(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_id", F.col("value").alias("y"), (F.col("event_id") % 100).cast("double").alias("x"))
    return images.reading_order(e, "user_id", "event_id")


_RANGES = ", ".join(f"({a}, {b}, {bit})" for a, b, bit in metadata.UNICODE_RANGES)


@query(f"""WITH c AS (SELECT DISTINCT lang, unicode(unnest(string_split(text, ''))) AS cp FROM documents), r(a, b, bit) AS (VALUES {_RANGES})
SELECT lang, bit_or(CASE WHEN bit < 32 THEN 1::BIGINT << bit ELSE 0 END) AS low_bits, bit_or(CASE WHEN bit >= 32 AND bit < 64 THEN 1::BIGINT << (bit - 32) ELSE 0 END) AS high_bits,
 bit_or(CASE WHEN bit >= 64 AND bit < 96 THEN 1::BIGINT << (bit - 64) ELSE 0 END) AS third_bits, 2147483648::BIGINT AS fourth_bits, count(bit) AS covered,
 coalesce(string_agg(printf('%04X', (cp + 1024) & 65535), '' ORDER BY (cp + 1024) & 65535) FILTER (WHERE cp > 127), '') AS shifted FROM c LEFT JOIN r ON cp BETWEEN a AND b GROUP BY 1""")
def font_signature(spark, sf_dir):
    return metadata.font_signature(table(spark, sf_dir, "documents"), "lang", "text")


@query("""WITH o AS (SELECT c_custkey AS file, c_nationkey % 5 AS type, c_name AS value FROM customer), n AS (SELECT c_custkey AS file, c_nationkey % 7 AS type, CASE WHEN c_custkey % 4 = 0 THEN NULL WHEN c_custkey % 4 = 1 THEN '' WHEN c_custkey % 4 = 2 THEN c_name ELSE upper(c_name) || '!' END AS value FROM customer)
SELECT coalesce(o.file, n.file) AS file, coalesce(o.type, n.type) AS type, o.value AS old, CASE WHEN n.value = '' THEN NULL ELSE n.value END AS new, CASE WHEN o.value IS NULL THEN 'added' WHEN n.value = '' THEN 'removed' ELSE 'replaced' END AS op
FROM o FULL JOIN n ON o.file = n.file AND o.type = n.type WHERE n.value IS NOT NULL AND NOT (o.value IS NULL AND n.value = '') AND NOT coalesce(o.value = n.value, false)""")
def metadata_diff(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    old = c.select(F.col("c_custkey").alias("file"), (F.col("c_nationkey") % 5).alias("type"), F.col("c_name").alias("value"))
    k = F.col("c_custkey") % 4
    new = c.select(F.col("c_custkey").alias("file"), (F.col("c_nationkey") % 7).alias("type"), F.when(k == 0, None).when(k == 1, "").when(k == 2, F.col("c_name")).otherwise(F.concat(F.upper("c_name"), F.lit("!"))).alias("value"))
    return metadata.plan_changes(old, new)


@query("""WITH links AS (SELECT DISTINCT regexp_extract(url, '^https?://([^/]+)', 1) AS host, page_id FROM pages), known AS (SELECT DISTINCT source FROM documents)
SELECT l.host, count(*) AS n FROM links l WHERE NOT EXISTS (SELECT 1 FROM known k WHERE contains(l.host, k.source)) AND EXISTS (SELECT 1 FROM pages p WHERE p.page_id = l.page_id) GROUP BY 1""")
def undeclared_hosts(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select(F.regexp_extract("url", "^https?://([^/]+)", 1).alias("host"), "page_id").distinct()
    known = table(spark, sf_dir, "documents").select("source").distinct()
    names = p.select("host").distinct()  # the match is by substring, so hosts meet sources once each, by the pieces between dots and dashes
    return p.join(metadata.holding(names, "host", known, "source"), "host", "left_anti").groupBy("host").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH a AS (SELECT DISTINCT lang, source FROM documents), b AS (SELECT DISTINCT lang, 'src' || (doc_id % 25) AS source FROM documents)
SELECT lang, source, 'used_only' AS side FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT lang, source, 'declared_only' FROM (SELECT * FROM b EXCEPT SELECT * FROM a)""")
def declared_and_used(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    used, declared = d.select("lang", "source").distinct(), d.select("lang", F.concat(F.lit("src"), (F.col("doc_id") % 25).cast("string")).alias("source")).distinct()
    return metadata.two_sided(used, declared)


@query("SELECT doc_id, regexp_replace(text, '[̀́]', '', 'g') = text AS no_stress, length(translate(text, " + quoted(T.EXOTIC_SPACES) + ", " + quoted(" " * len(T.EXOTIC_SPACES)) + ")) AS n FROM documents")
def space_and_stress(spark, sf_dir):
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", (T.strip_stress(t) == t).alias("no_stress"), F.length(T.plain_spaces(t)).alias("n"))
