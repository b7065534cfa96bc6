"""The validator as queries: packages are built of the driver's tables, parsed and judged; the SQL says
from the same columns what must be found.

Pages become packages with one content document and a style sheet each, parts become packages of
their own for metadata, and items of their brand's package for manifests. What a rule looks for is
put in by residues of the ids, so that every rule has packages in which it fires and others."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..rules import checks
from ..sources import packages
from .queries import query, quoted, table

HEAD = '<?xml version="1.0"?><package xmlns="http://www.idpf.org/2007/opf" version="2.0"'


def rows_of(*files: DataFrame) -> packages.Tables:
    """Tables of files given as pkg_id, path, content (text)."""
    return packages.read(reduce(DataFrame.unionByName, files).select("pkg_id", "path", F.col("content").cast("binary").alias("content")))


def counted(t: packages.Tables, rules: list[str]) -> DataFrame:
    return checks.validate(t, rules).groupBy("pkg_id", "rule_id").agg(F.count(F.lit(1)).alias("n"))


def total(parts: list[tuple[str, str]], source: str) -> str:
    """SQL: (rule, number of findings) of each row of source, which has a pkg_id."""
    return " UNION ALL ".join(f"SELECT pkg_id, '{rule}' AS rule_id, CAST({n} AS BIGINT) AS n FROM {source} WHERE {n} > 0" for rule, n in parts)


def put(x: Column, key: Column, modulus: int, replacements: dict[int, tuple[str, str]]) -> Column:
    """x with a text replaced by another in rows of the given residues."""
    for residue, (old, new) in replacements.items():
        x = F.when(key % modulus == residue, F.replace(x, F.lit(old), F.lit(new))).otherwise(x)
    return x


def replaced_sql(x: str, key: str, modulus: int, replacements: dict[int, tuple[str, str]]) -> str:
    cases = " ".join(f"WHEN {r} THEN replace({x}, {quoted(a)}, {quoted(b)})" for r, (a, b) in replacements.items())
    return f"CASE {key} % {modulus} {cases} ELSE {x} END"


PAGE_ITEMS = '<item id="a" href="text/a.xhtml" media-type="application/xhtml+xml"/><item id="b" href="text/b.xhtml" media-type="application/xhtml+xml"/><item id="c" href="c.png" media-type="image/png"/><item id="s" href="s.css" media-type="text/css"/>'
PAGE_OPF = f'{HEAD} unique-identifier="u"><metadata><title>T</title><identifier id="u">x</identifier><language>en</language></metadata><manifest>{PAGE_ITEMS}</manifest><spine><itemref idref="a"/></spine></package>'
SECOND = '<html><body><p id="and">x</p></body></html>'


def page_files(pages: DataFrame, content: Column, css: Column | None = None) -> packages.Tables:
    p = pages.withColumn("pkg_id", F.concat(F.lit("p"), F.col("page_id").cast("string")))
    file = lambda path, x: p.select("pkg_id", F.lit(path).alias("path"), x.alias("content"))
    return rows_of(file("p.opf", F.lit(PAGE_OPF)), file("text/a.xhtml", content), file("text/b.xhtml", F.lit(SECOND)), file("s.css", css if css is not None else F.lit("")))


# --- links ---------------------------------------------------------------------------------

LINKS = {1: ('href="/', 'href="../../'), 2: ('href="/', 'href="a b/'), 3: ('href="/', 'href="data:'), 4: ('href="/', 'href="file:///'), 5: ('href="/', 'href="b.xhtml?'), 6: ('href="/', 'href="a.xhtml#'), 7: ('href="/', 'href="../c.png#')}


@query(rf"""WITH p AS (SELECT 'p' || page_id AS pkg_id, {replaced_sql("html", "page_id", 8, LINKS)} AS html FROM pages),
u AS (SELECT pkg_id, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS url FROM p),
s AS (SELECT *, CASE WHEN contains(url, '#') THEN url[1:strpos(url, '#') - 1] ELSE url END AS rest, CASE WHEN contains(url, '#') THEN url[strpos(url, '#') + 1:] ELSE '' END AS fragment FROM u),
c AS (SELECT *, CASE WHEN contains(rest, '?') THEN rest[1:strpos(rest, '?') - 1] ELSE rest END AS path, contains(rest, '?') AS asked,
  CASE WHEN url = '' THEN 'empty' WHEN regexp_matches(url, '[\s\x00-\x1F<>]') THEN 'malformed' WHEN starts_with(lower(url), 'data:') THEN 'data' WHEN starts_with(lower(url), 'file:') THEN 'file'
    WHEN regexp_matches(url, '^[A-Za-z][A-Za-z0-9+.-]*:') OR starts_with(url, '//') THEN 'external' WHEN starts_with(url, '#') THEN 'same' ELSE 'relative' END AS class FROM s),
f AS (SELECT pkg_id, 'R9.6' AS rule_id FROM c WHERE class = 'malformed' UNION ALL SELECT pkg_id, 'R9.8' FROM c WHERE class = 'data' UNION ALL SELECT pkg_id, 'R9.9' FROM c WHERE class = 'file'
  UNION ALL SELECT pkg_id, 'R9.10' FROM c WHERE class = 'relative' AND asked UNION ALL SELECT pkg_id, 'R9.7' FROM c WHERE class = 'relative' AND starts_with(path, '../../')
  UNION ALL SELECT pkg_id, 'R9.2' FROM c WHERE class = 'relative' AND path = 'b.xhtml'
  UNION ALL SELECT pkg_id, 'R9.3' FROM c WHERE class IN ('relative', 'same') AND fragment <> '' AND ((path = 'b.xhtml' AND fragment <> 'and') OR ((path = 'a.xhtml' OR class = 'same') AND fragment <> 'the'))
  UNION ALL SELECT pkg_id, 'R9.4' FROM c WHERE class = 'relative' AND fragment <> '' AND path = '../c.png')
SELECT pkg_id, rule_id, count(*) AS n FROM f GROUP BY 1, 2""")
def rule_links(spark, sf_dir):
    html = F.replace(put(F.col("html"), F.col("page_id"), 8, LINKS), F.lit("<h1>"), F.lit('<h1 id="the">'))
    return counted(page_files(table(spark, sf_dir, "pages"), html), ["R9.2", "R9.3", "R9.4", "R9.6", "R9.7", "R9.8", "R9.9", "R9.10"])


# --- content and styles --------------------------------------------------------------------

HEADS = {1: '<?xml version="1.1"?>', 2: '<?xml version="1.0"?>', 3: '<?xml version="1.0" encoding="latin-1"?>', 4: '<?xml version="1.0" encoding="UTF-8"?><!ENTITY x SYSTEM "y">'}
CONTENT = [
    (3, {0: ("p{margin:0}", "p{margin:-3px}"), 1: ("<h1>", '<h1 style="text-align:left">')}),
    (4, {1: ("<!DOCTYPE html>", "<!DOCTYPE odd>"), 2: ("<html ", '<html xmlns:epub="http://bad" '), 3: ("<html ", '<html xmlns:epub="http://www.idpf.org/2007/ops" ')}),
    (2, {0: ("</p>", "</p>\n")}),
]
STYLES = [(3, '@charset "latin-1";'), (4, '@namespace x "y";'), (5, '@import "gone.css";'), (6, "a{position:fixed}"), (7, "b{background:url(no.png)}"), (8, "@font-face{font-family:f}"), (9, "@media (hover){b{color:red}}"), (10, "}"), (11, '@import "s.css";/* @namespace */')]


def _page_sql() -> str:
    x = "html"
    for modulus, changes in CONTENT:
        x = replaced_sql(x, "page_id", modulus, changes)
    heads = " ".join(f"WHEN {k} THEN {quoted(v)}" for k, v in HEADS.items())
    css = " || ".join(f"CASE WHEN page_id % {m} = 1 THEN {quoted(v)} ELSE '' END" for m, v in STYLES)
    return f"SELECT 'p' || page_id AS pkg_id, (CASE page_id % 5 {heads} ELSE '' END) || {x} || '<table>' || repeat('<tr><td>x</td></tr>', (page_id % 100)::INTEGER) || '</table>' AS t, {css} AS css FROM pages"


def _lines_with(pattern: str) -> str:
    return f"len([x FOR x IN string_split(t, chr(10)) IF regexp_matches(x, '{pattern}')])"


_CONTENT_RULES = [
    ("R6.2", _lines_with(r"(?i)(margin|padding|line-height)[a-z-]*\s*:[^;\"''}]*-\d")),
    ("R6.3", _lines_with(r"(?i)<script([\s>/]|$)")),
    ("R10.3.1", "len([x FOR x IN string_split(t, chr(10)) IF regexp_matches(regexp_extract(x, '(?i)<h[1-6]\\b([^>]*)', 1), '(?i)text-align')])"),
    ("R6.6", "CASE WHEN regexp_extract(t, '^<\\?xml[^?]*?version=\"([^\"]*)\"', 1) NOT IN ('', '1.0') THEN 1 ELSE 0 END"),
    ("R6.7", "CASE WHEN regexp_matches(t, '(?is)<!entity[^>]*\\s(system|public)') THEN 1 ELSE 0 END"),
    ("R6.8", "CASE WHEN NOT regexp_matches(t, '(?i)<!doctype html>') AND regexp_matches(t, '(?i)<!doctype') THEN 1 ELSE 0 END"),
    ("R6.9", "CASE WHEN regexp_extract(t, 'xmlns:epub=\"([^\"]*)\"', 1) NOT IN ('', 'http://www.idpf.org/2007/ops') THEN 1 ELSE 0 END"),
    ("R6.11", "CASE WHEN lower(regexp_extract(t, '^<\\?xml[^?]*?encoding=\"([^\"]*)\"', 1)) NOT IN ('', 'utf-8') THEN 1 ELSE 0 END"),
    ("R10.5.1", "len([x FOR x IN regexp_extract_all(t, '(?is)<table>.*?</table>') IF len(regexp_extract_all(x, '<tr>')) > 50])"),
    ("R6.12", "CASE WHEN regexp_extract(css, '^@charset\\s+\"([^\"]*)\"', 1) NOT IN ('', 'utf-8') THEN 1 ELSE 0 END"),
    ("R6.13", "CASE WHEN len(regexp_extract_all(css, '\\{')) <> len(regexp_extract_all(css, '\\}')) THEN 1 ELSE 0 END"),
    ("R6.14", "len(regexp_extract_all(css, '[\\s;{]position\\s*:\\s*(fixed|absolute|sticky)'))"),
    ("R6.15", "len([x FOR x IN regexp_extract_all(css, '@import\\s+\"([^\"]+)\"', 1) IF x <> 's.css'])"),
    ("R6.16", "len([x FOR x IN regexp_extract_all(css, 'url\\(([^)]*)\\)', 1) IF x <> 's.css'])"),
    ("R6.17", "len([x FOR x IN regexp_extract_all(css, '@font-face\\s*\\{([^}]*)\\}', 1) IF NOT contains(x, 'src')])"),
    ("R6.e1", "len(regexp_extract_all(regexp_replace(css, '/\\*.*?\\*/', '', 'g'), '@namespace'))"),
    ("R6.e2", "len(regexp_extract_all(css, '@media[^{;]*\\(\\s*hover'))"),
]


@query(f"WITH p AS ({_page_sql()}) {total(_CONTENT_RULES, 'p')}")
def rule_content(spark, sf_dir):
    pages, key, html = table(spark, sf_dir, "pages"), F.col("page_id"), F.col("html")
    for modulus, changes in CONTENT:
        html = put(html, key, modulus, changes)
    head = reduce(lambda c, kv: c.when(key % 5 == kv[0], kv[1]), list(HEADS.items())[1:], F.when(key % 5 == 1, HEADS[1])).otherwise("")
    rows = F.expr("repeat('<tr><td>x</td></tr>', cast(page_id % 100 as int))")
    css = F.concat(*[F.when(key % m == 1, v).otherwise("") for m, v in STYLES])
    return counted(page_files(pages, F.concat(head, html, F.lit("<table>"), rows, F.lit("</table>")), css), [r for r, _ in _CONTENT_RULES])


# --- metadata ------------------------------------------------------------------------------

_UUID_PARTS = [(1, 8), (9, 4), (13, 4), (17, 4), (21, 12)]
_META_SQL = """SELECT 'm' || p_partkey AS pkg_id, p_partkey AS k, (1990 + p_size)::VARCHAR || '-' || lpad((p_partkey % 14)::VARCHAR, 2, '0') || CASE WHEN p_partkey % 3 = 0 THEN '' WHEN p_partkey % 3 = 1 THEN '-' || lpad((p_partkey % 33)::VARCHAR, 2, '0') ELSE ' ' || p_size END AS d,
  CASE WHEN p_partkey % 2 = 0 THEN p_type ELSE lower(p_type[1:2]) || CASE WHEN p_partkey % 3 = 0 THEN '_x' ELSE '-419' END END AS lang, md5(p_name || p_partkey) AS h FROM part"""
_META_RULES = [
    ("R16.1", "CASE WHEN k % 11 <> 0 AND k % 7 = 0 THEN 1 ELSE 0 END"),
    ("R16.2", "CASE WHEN k % 11 = 0 THEN 1 ELSE 0 END"),
    ("R16.3", rf"CASE WHEN NOT regexp_matches(d, '{T.W3CDTF}') THEN 1 ELSE 0 END"),
    ("R16.4", rf"CASE WHEN regexp_matches(d, '{T.W3CDTF}') AND (try_cast(split_part(d, '-', 2) AS INTEGER) NOT BETWEEN 1 AND 12 OR (k % 3 = 1 AND try_cast(d AS DATE) IS NULL)) THEN 1 ELSE 0 END"),
    ("R16.5", "CASE WHEN k % 5 = 0 THEN 1 ELSE 0 END"),
    ("R16.6", "CASE WHEN k % 6 = 0 THEN 1 ELSE 0 END"),
    ("R16.7", f"CASE WHEN k % 4 = 1 AND NOT regexp_matches({' || chr(45) || '.join(f'h[{a}:{a + n - 1}]' for a, n in _UUID_PARTS)}, '{T.UUID}') THEN 1 ELSE 0 END"),
    ("R16.8", f"CASE WHEN NOT regexp_matches(lang, '{T.BCP47_METADATA}') THEN 1 ELSE 0 END"),
]


@query(f"WITH p AS ({_META_SQL}) {total(_META_RULES, 'p')}")
def rule_metadata(spark, sf_dir):
    p, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    day = F.when(k % 3 == 0, "").when(k % 3 == 1, F.concat(F.lit("-"), two(k % 33))).otherwise(F.concat(F.lit(" "), F.col("p_size").cast("string")))
    date = F.concat((1990 + F.col("p_size")).cast("string"), F.lit("-"), two(k % 14), day)
    lang = F.when(k % 2 == 0, F.col("p_type")).otherwise(F.concat(F.lower(F.substring("p_type", 1, 2)), F.when(k % 3 == 0, "_x").otherwise("-419")))
    h = F.md5(F.concat("p_name", k.cast("string")).cast("binary"))
    uuid = F.concat_ws("-", *[F.substring(h, a, n) for a, n in _UUID_PARTS])
    tag = lambda name, x, attrs="": F.concat(F.lit(f"<{name}{attrs}>"), x, F.lit(f"</{name}>"))
    own = F.concat(F.when(k % 7 == 0, '<identifier id="v"').otherwise('<identifier id="u"'), F.when(k % 4 == 1, ' scheme="UUID">').otherwise(">"), uuid, F.lit("</identifier>"))
    meta = F.concat(tag("title", F.when(k % 5 == 0, " ").otherwise(F.col("p_name"))), own, tag("language", lang), tag("date", date), F.when(k % 6 == 0, '<meta name="a"/>').otherwise(""))
    opf = F.concat(F.lit(HEAD), F.when(k % 11 == 0, "").otherwise(' unique-identifier="u"'), F.lit("><metadata>"), meta, F.lit("</metadata><manifest/><spine/></package>"))
    files = p.select(F.concat(F.lit("m"), k.cast("string")).alias("pkg_id"), F.lit("p.opf").alias("path"), opf.alias("content"))
    return counted(rows_of(files), [r for r, _ in _META_RULES])


# --- manifests -----------------------------------------------------------------------------

TYPES = {0: "application/xhtml+xml", 1: "image/tiff", 2: "image/jpg", 3: "text/xml", 4: "application/x-odd", 5: "image/png"}
PROPERTIES = {1: "nav", 2: "odd", 3: "9x", 4: "a:b", 5: "cover-image"}
_ITEM_SQL = f"""SELECT p_brand AS pkg_id, p_partkey AS k, 'i' || p_partkey AS id, CASE p_partkey % 6 {' '.join(f"WHEN {k} THEN {quoted(v)}" for k, v in TYPES.items())} END AS type,
  CASE p_partkey % 7 {' '.join(f"WHEN {k} THEN {quoted(v)}" for k, v in PROPERTIES.items())} ELSE '' END AS p,
  CASE WHEN p_partkey % 17 = 3 THEN '#' ELSE '' END || CASE WHEN p_partkey % 2 = 0 THEN upper(p_name) ELSE p_name END || CASE p_partkey % 13 WHEN 1 THEN '?' WHEN 2 THEN '.' WHEN 3 THEN 'é' WHEN 4 THEN '#x' ELSE '' END AS href,
  CASE WHEN p_partkey % 3 = 0 THEN 'i' || (p_partkey + 1) END AS fallback, CASE WHEN p_partkey % 8 = 0 THEN 'i' || (p_partkey + 2) END AS style, p_size FROM part"""
_ODD_KINDS = "(p = 'nav' AND type <> 'application/xhtml+xml') OR (p = 'cover-image' AND NOT starts_with(type, 'image/')) OR (p = 'cover-image' AND type = 'image/tiff')"
_MANIFEST_RULES = {
    "R7.5": "SELECT pkg_id, count(*) AS n FROM (SELECT pkg_id, id FROM refs GROUP BY ALL HAVING count(*) > 1) GROUP BY 1",
    "R7.7": "SELECT pkg_id, count(*) AS n FROM i WHERE type IN ('image/jpg', 'text/xml') GROUP BY 1",
    "R7.8": "SELECT pkg_id, count(*) AS n FROM i WHERE fallback IS NOT NULL AND NOT EXISTS (SELECT 1 FROM i j WHERE j.pkg_id = i.pkg_id AND j.id = i.fallback) GROUP BY 1",
    "R7.9": "SELECT pkg_id, count(*) AS n FROM i WHERE style IS NOT NULL AND NOT EXISTS (SELECT 1 FROM i j WHERE j.pkg_id = i.pkg_id AND j.id = i.style) GROUP BY 1",
    "R7.10": "SELECT pkg_id, count(*) AS n FROM refs WHERE type <> 'application/xhtml+xml' AND fallback IS NULL GROUP BY 1",
    "R7.12": "SELECT pkg_id, count(*) AS n FROM (SELECT pkg_id, regexp_replace(href, '#.*$', '') AS h FROM i GROUP BY ALL HAVING count(*) > 1) GROUP BY 1",
    "R8.5": f"SELECT pkg_id, count(*) AS n FROM i WHERE {_ODD_KINDS} GROUP BY 1",
    "R8.8": "SELECT pkg_id, count(*) AS n FROM i WHERE p = '9x' GROUP BY 1",
    "R8.9": "SELECT pkg_id, count(*) AS n FROM i WHERE p = 'odd' GROUP BY 1",
    "R8.10": "SELECT pkg_id, count(*) AS n FROM i WHERE p = 'a:b' GROUP BY 1",
    "R9.11": "SELECT pkg_id, count(*) AS n FROM i WHERE contains(href, '#') GROUP BY 1",
    "R9.12": "SELECT pkg_id, count(*) AS n FROM i WHERE starts_with(href, '#') GROUP BY 1",
    "R10.4.1": "SELECT pkg_id, count(*) AS n FROM i WHERE type = 'image/tiff' GROUP BY 1",
    "R13.1": "SELECT pkg_id, count(*) AS n FROM i WHERE contains(href, '?') GROUP BY 1",
    "R13.2": "SELECT pkg_id, count(*) AS n FROM i WHERE contains(href, ' ') GROUP BY 1",
    "R13.3": "SELECT pkg_id, count(*) AS n FROM i WHERE ends_with(href, '.') GROUP BY 1",
    "R13.4": "SELECT pkg_id, count(*) AS n FROM i WHERE contains(href, 'é') GROUP BY 1",
    "R13.5": "SELECT pkg_id, count(*) AS n FROM (SELECT pkg_id, lower(href) FROM i GROUP BY ALL HAVING count(DISTINCT href) > 1) GROUP BY 1",
}


@query(f"""WITH i AS ({_ITEM_SQL}), refs AS (SELECT * FROM i WHERE k % 5 = 0 UNION ALL SELECT * FROM i WHERE k % 35 = 0)
{' UNION ALL '.join(f"SELECT pkg_id, '{rule}' AS rule_id, n FROM ({sql})" for rule, sql in _MANIFEST_RULES.items())}""")
def rule_manifests(spark, sf_dir):
    k = F.col("p_partkey")
    pick = lambda m, options: reduce(lambda c, kv: c.when(k % m == kv[0], kv[1]), list(options.items())[1:], F.when(k % m == next(iter(options)), next(iter(options.values()))))
    name = F.concat(F.when(k % 17 == 3, "#").otherwise(""), F.when(k % 2 == 0, F.upper("p_name")).otherwise(F.col("p_name")), pick(13, {1: "?", 2: ".", 3: "é", 4: "#x"}).otherwise(""))
    attr = lambda n, x: F.concat(F.lit(f' {n}="'), x, F.lit('"'))
    item_id = lambda more: F.concat(F.lit("i"), (k + more).cast("string"))
    item = F.concat(F.lit("<item"), attr("id", item_id(0)), attr("href", name), attr("media-type", pick(6, TYPES)), F.coalesce(attr("properties", pick(7, PROPERTIES)), F.lit("")), F.when(k % 3 == 0, attr("fallback", item_id(1))).otherwise(""), F.when(k % 8 == 0, attr("fallback-style", item_id(2))).otherwise(""), F.lit("/>"))
    ref = F.concat(F.lit("<itemref"), attr("idref", item_id(0)), F.lit("/>"))
    refs = F.when(k % 35 == 0, F.concat(ref, ref)).when(k % 5 == 0, ref).otherwise("")
    rows = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("pkg_id")).agg(F.array_sort(F.collect_list(F.struct("p_partkey", item.alias("item"), refs.alias("refs")))).alias("rows"))
    joined = lambda f: F.array_join(F.transform("rows", f), "")
    opf = F.concat(F.lit(HEAD + ' unique-identifier="u"><metadata><title>T</title><identifier id="u">x</identifier></metadata><manifest>'), joined(lambda r: r["item"]), F.lit("</manifest><spine>"), joined(lambda r: r["refs"]), F.lit("</spine></package>"))
    return counted(rows_of(rows.select("pkg_id", F.lit("p.opf").alias("path"), opf.alias("content"))), list(_MANIFEST_RULES))
