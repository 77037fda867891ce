"""Queries of the corpus operators, each with its SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from actaloom.functions import identity as I
from actaloom.functions import text as T
from actaloom.functions.markdown import to_html
from actaloom.operators import facets, families, graph, lint, merge, paging, sampling, search, texts, tree
from actaloom.session import shared_dir, table
from actaloom.sources import readers
from actaloom.streaming import ingest

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):  # noqa: ANN201
    """Registers a query under its function's name, with its SQL if there is one."""

    def keep(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return keep


def law(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "law_catalog")


def pdf(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "pdf_catalog")


def pages(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "raw_pages")


def edges(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "connections")


# --- hashes, ids, names -------------------------------------------------------------------
@query("select rel_raw, sha256(text) as content_hash from raw_pages")
def content_hash(s, d):
    return pages(s, d).select("rel_raw", I.content_hash(F.col("text")).alias("content_hash"))


@query("select rel_raw, 'family_' || substr(sha256(text), 1, 16) as family_id from raw_pages where text is not null")
def id_prefix(s, d):
    return pages(s, d).filter("text is not null").select("rel_raw", I.family_id(F.col("text")).alias("family_id"))


SLUG = "trim(regexp_replace(lower(strip_accents({})), '[^a-z0-9]+', '-', 'g'), '-')"


@query(f"select id, csv_row, {SLUG.format('title')} || '--' || id as slug from law_catalog")
def text_slug(s, d):
    return law(s, d).select("id", "csv_row", I.page_slug(F.col("title"), F.col("id")).alias("slug"))


@query("select rel_raw, cast(length(text) as bigint) as chars, length(text) <= 500 as short from raw_pages where text is not null")
def short_text_flag(s, d):
    return pages(s, d).filter("text is not null").select("rel_raw", F.length("text").cast("bigint").alias("chars"), (F.length("text") <= 500).alias("short"))


@query("select id, csv_row, coalesce(nullif(topic_raw, ''), nullif(topic, ''), 'unknown') as topic_shown, coalesce(nullif(website, ''), 'unknown') as website_shown from law_catalog")
def falsy_default(s, d):
    return law(s, d).select("id", "csv_row", T.first_filled(F.col("topic_raw"), F.col("topic")).alias("topic_shown"), T.first_filled(F.col("website")).alias("website_shown"))


@query("select csv_row, filename, regexp_replace(filename, '\\.[^.]*$', '') as stem, lower(regexp_extract(filename, '\\.([^.]*)$', 1)) as extension from law_catalog")
def filename_stem(s, d):
    return law(s, d).select("csv_row", "filename", I.stem(F.col("filename")).alias("stem"), F.lower(F.regexp_extract("filename", r"\.([^.]*)$", 1)).alias("extension"))


@query("select rel_raw, string_split(rel_raw, '/')[3] as website_part, string_split(rel_raw, '/')[4] as year_part from raw_pages")
def path_parts(s, d):
    p = F.split("rel_raw", "/")
    return pages(s, d).select("rel_raw", F.get(p, F.lit(2)).alias("website_part"), F.get(p, F.lit(3)).alias("year_part"))


@query("select title, replace(replace(replace(title, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') as escaped, count(*) as n from law_catalog group by all")
def html_escape(s, d):
    return law(s, d).groupBy("title").agg(F.count(F.lit(1)).alias("n")).select("title", T.html_escape(F.col("title")).alias("escaped"), "n")


@query("""select pdf_path, '/pdfs/' || replace(replace(replace(replace(replace(replace(url_encode(replace(regexp_replace(pdf_path, '^raw[/\\\\]pdfs[/\\\\]', ''), '\\', '/')), '%2F', '/'), '%21', '!'), '%27', ''''), '%28', '('), '%29', ')'), '%7E', '~') as url
from (select distinct pdf_path from pdf_catalog where pdf_path is not null)""")
def pdf_url(s, d):
    return pdf(s, d).filter("pdf_path is not null").select("pdf_path").distinct().select("pdf_path", T.pdf_url(F.col("pdf_path")).alias("url"))


PAGE = "'---' || chr(10) || 'id: \"' || id || '\"' || chr(10) || 'website: \"' || coalesce(website, '') || '\"' || chr(10) || '---' || chr(10) || '# ' || filename || chr(10) || '## Full text' || chr(10) || chr(10) || text || chr(10)"


def composed(s: SparkSession, d: str) -> DataFrame:
    """raw_pages as markdown pages with frontmatter."""
    head = F.concat(F.lit('---\nid: "'), "id", F.lit('"\nwebsite: "'), F.coalesce("website", F.lit("")), F.lit('"\n---\n# '), "filename", F.lit("\n## Full text\n\n"), "text", F.lit("\n"))
    return pages(s, d).filter("text is not null and id is not null and filename is not null").select("rel_raw", head.alias("page"))


@query(f"""with p as (select rel_raw, {PAGE} as page from raw_pages where text is not null and id is not null and filename is not null)
select rel_raw, sha256(regexp_replace(page, '^---\\r?\\n[\\s\\S]*?\\r?\\n---\\r?\\n', '')) as body_hash from p""")
def strip_frontmatter(s, d):
    return composed(s, d).select("rel_raw", I.content_hash(T.strip_frontmatter(F.col("page"))).alias("body_hash"))


@query("select rel_raw, sha256(regexp_replace(regexp_replace(text, '^\\s+', ''), '\\s+$', '')) as section_hash from raw_pages where text is not null and id is not null and filename is not null")
def section_extract(s, d):
    return composed(s, d).select("rel_raw", I.content_hash(T.section(F.col("page"), "Full text", "Graph links")).alias("section_hash"))


@query("select rel_raw, id, coalesce(website, '') as website from raw_pages where text is not null and id is not null and filename is not null")
def frontmatter_parse(s, d):
    return composed(s, d).select("rel_raw", T.frontmatter_value(F.col("page"), "id").alias("id"), T.frontmatter_value(F.col("page"), "website").alias("website"))


@query("select csv_row, title || ' (' || year || ', ' || website || ', ' || topic || ')' as line from law_catalog where title is not null and year is not null and website is not null and topic is not null")
def catalog_line(s, d):
    rows = law(s, d).filter("title is not null and year is not null and website is not null and topic is not null")
    return rows.select("csv_row", T.catalog_line(*map(F.col, ("title", "year", "website", "topic"))).alias("line"))


@query("select csv_row, regexp_replace(rel_source, '\\.md$', '') as target from law_catalog where rel_source is not null and title is not null")
def link_extract(s, d):
    line = F.concat(F.lit("- [["), F.regexp_replace("rel_source", r"\.md$", ""), F.lit("|"), "title", F.lit("]]"))
    return law(s, d).filter("rel_source is not null and title is not null").select("csv_row", F.explode(T.wikilinks(line)).alias("target"))


CITED = "(Lei Orgânica|Decreto-Lei|D\\.L\\.|DL|Lei|Portaria|Regulamento \\(CE\\)) (?:n\\.º )?(\\d+(?:-[A-Z])?)/(\\d{4}|\\d{2})\\b"
_CITES = f"with c as (select rel_raw, unnest(regexp_extract_all(text, '{CITED}', 0)) as citation from raw_pages)"


@query(f"{_CITES} select rel_raw, citation, count(*) as n from c group by all")
def citation_extract(s, d):
    return pages(s, d).select("rel_raw", F.explode(T.citations(F.col("text"))).alias("citation")).groupBy("rel_raw", "citation").agg(F.count(F.lit(1)).alias("n"))


@query(f"""{_CITES}, k as (select citation, regexp_extract(citation, '{CITED}', 1) as kind, regexp_extract(citation, '{CITED}', 2) as num, regexp_extract(citation, '{CITED}', 3) as y from c)
select 'instrument:' || case when kind like 'Regulamento%' then 'eu:regulamento' when kind in ('DL', 'D.L.') then 'pt:decreto-lei' else 'pt:' || {SLUG.format('kind')} end || ':' || num || '/' ||
case when length(y) = 2 then case when cast(y as int) >= 50 then '19' else '20' end || y else y end as instrument, count(*) as n from k group by 1""")
def citation_canonical(s, d):
    found = pages(s, d).select(F.explode(T.citations(F.col("text"))).alias("citation"))
    return found.groupBy(T.canonical_citation(F.col("citation")).alias("instrument")).agg(F.count(F.lit(1)).alias("n"))


@query("""with x as (select unnest(regexp_extract_all(text, '\\b\\d{2}[/.-]\\d{2}[/.-]\\d{4}\\b', 0)) as found from raw_pages)
select found, strftime(try_strptime(replace(replace(found, '/', '-'), '.', '-'), '%d-%m-%Y'), '%Y-%m-%d') as iso, count(*) as n from x group by all""")
def date_normalise(s, d):
    found = pages(s, d).select(F.explode(F.regexp_extract_all("text", F.lit(r"\b\d{2}[/.-]\d{2}[/.-]\d{4}\b"), F.lit(0))).alias("found"))
    return found.groupBy("found").agg(F.count(F.lit(1)).alias("n")).select("found", T.iso_date(F.col("found")).alias("iso"), "n")


@query("select predicate, replace(predicate, '_', ' ') as label, count(*) as n from connections where predicate is not null group by all")
def predicate_label(s, d):
    return edges(s, d).filter("predicate is not null").groupBy("predicate").agg(F.count(F.lit(1)).alias("n")).select("predicate", T.predicate_label(F.col("predicate")).alias("label"), "n")


@query("select distinct subject, predicate, object, 'conn_' || substr(sha256(subject || ':' || predicate || ':' || object), 1, 24) as own_id from connections where subject is not null and predicate is not null and object is not null")
def assertion_key(s, d):
    rows = edges(s, d).filter("subject is not null and predicate is not null and object is not null").select("subject", "predicate", "object").distinct()
    return rows.withColumn("own_id", I.assertion_id(F.col("subject"), F.col("predicate"), F.col("object")))


@query(f"select object, {SLUG.format(chr(34) + 'rest' + chr(34))} as slug from (select distinct object, replace(replace(regexp_replace(object, '^[^:]*:', ''), ':', '-'), '/', '-') as rest from connections where object is not null)")
def hub_slug(s, d):
    return edges(s, d).filter("object is not null").select("object").distinct().withColumn("slug", I.hub_slug(F.col("object")))


@query("select website, replace(format('{:,}', sum(length(text))), ',', '.') as chars from raw_pages where website is not null and text is not null group by 1")
def number_format(s, d):
    sums = pages(s, d).filter("website is not null and text is not null").groupBy("website").agg(F.sum(F.length("text")).alias("n"))
    return sums.select("website", T.grouped_number(F.col("n")).alias("chars"))


@query("select distinct id, id as document, 'fatura' as q from law_catalog where id is not null")
def url_query_param(s, d):
    url = F.concat(F.lit("https://portal.test/map?document="), "id", F.lit("&q=fatura"))
    return law(s, d).filter("id is not null").select("id").distinct().select("id", F.parse_url(url, F.lit("QUERY"), F.lit("document")).alias("document"), F.parse_url(url, F.lit("QUERY"), F.lit("q")).alias("q"))


@query("select distinct title, strip_accents(title) as folded from law_catalog where title is not null")
def accent_fold(s, d):
    return law(s, d).filter("title is not null").select("title").distinct().withColumn("folded", T.fold_accents(F.col("title")))


# --- filters ------------------------------------------------------------------------------
@query("select id, csv_row from law_catalog where website = 'CACVERA' and year = '2022'")
def facet_filter(s, d):
    return facets.filter_facets(law(s, d), website="CACVERA", year="2022", topic="").select("id", "csv_row")


@query("select csv_row, id from law_catalog where contains(lower(concat_ws(' ', title, filename)), 'decisão')")
def contains_filter(s, d):
    return law(s, d).filter(F.lower(F.concat_ws(" ", "title", "filename")).contains("decisão")).select("csv_row", "id")


@query("select count(*) as kept from law_catalog where folder is null or not list_has_any(string_split(folder, '/'), ['Arquivo', 'Sumarios'])")
def ignore_paths(s, d):
    bad = F.arrays_overlap(F.split("folder", "/"), F.array(F.lit("Arquivo"), F.lit("Sumarios")))
    return law(s, d).filter(F.col("folder").isNull() | ~bad).agg(F.count(F.lit(1)).alias("kept"))


@query("""with p as (select id, min(text) as text from raw_pages where text is not null group by id), c as (select distinct assertion_id, substr(subject, 10) as id, evidence from connections where subject like 'document:%' and evidence <> '')
select c.assertion_id, c.evidence, contains(p.text, c.evidence) as supported from c join p using (id)""")
def evidence_contains(s, d):
    claims = edges(s, d).filter("subject like 'document:%' and evidence <> ''").select("assertion_id", F.expr("substr(subject, 10)").alias("id"), "evidence")
    return texts.supported(claims, "id", "evidence", pages(s, d), "id", "text").select("assertion_id", "evidence", "supported")


@query("select distinct id from law_catalog where 'document:' || id in (select subject from connections where predicate = 'has_outcome' and review_state = 'accepted')")
def docs_with_edge(s, d):
    wanted = edges(s, d).filter("predicate = 'has_outcome' and review_state = 'accepted'").select(F.col("subject"))
    return law(s, d).filter("id is not null").select("id").distinct().withColumn("subject", F.concat(F.lit("document:"), "id")).join(wanted, "subject", "left_semi").select("id")


# --- facets -------------------------------------------------------------------------------
@query("select coalesce(nullif(website, ''), 'unknown') as value, count(*) as n from law_catalog group by 1")
def facet_counts(s, d):
    return facets.facet_counts(law(s, d), "website")


@query("""select coalesce(t.topic_kind, 'unmapped') as topic_kind, coalesce(nullif(t.sector, ''), 'unmapped') as sector, count(*) as n
from law_catalog l left join topic_list t on t.topic = l.topic group by 1, 2""")
def facet_topic_sector(s, d):
    return facets.with_taxonomy(law(s, d).select("id", "topic"), "topic", table(s, d, "topic_list")).groupBy("topic_kind", "sector").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "sector", "topic_kind")


@query("select value, count(*) as n from (select unnest(case when coalesce(len(categories), 0) = 0 then ['unmapped'] else categories end) as value from law_catalog) group by 1")
def facet_multi(s, d):
    return facets.facet_multi(law(s, d), "categories")


@query("select count(distinct nullif(website, '')) as website, count(distinct nullif(topic, '')) as topic, count(distinct nullif(year, '')) as year, count(distinct nullif(folder, '')) as folder from law_catalog")
def facet_distinct(s, d):
    return facets.facet_distinct(law(s, d), ["website", "topic", "year", "folder"])


@query("select website, year, topic, cast(grouping(website, year, topic) as bigint) as gid, count(*) as n from law_catalog group by grouping sets ((website), (year), (topic), ())")
def facet_grouping_sets(s, d):
    return law(s, d).groupingSets([["website"], ["year"], ["topic"], []], "website", "year", "topic").agg(F.grouping_id("website", "year", "topic").cast("bigint").alias("gid"), F.count(F.lit(1)).alias("n"))


@query("select website, year, count(*) as n from law_catalog group by rollup (website, year)")
def facet_rollup(s, d):
    return law(s, d).rollup("website", "year").agg(F.count(F.lit(1)).alias("n"))


@query("select lang, source, count(*) as n from documents group by cube (lang, source)")
def facet_cube(s, d):
    return table(s, d, "documents").cube("lang", "source").agg(F.count(F.lit(1)).alias("n"))


# --- families -----------------------------------------------------------------------------
_TEXTS = "with t as (select distinct doc_id, sha256(text) as h from documents where text is not null), f as (select h, count(*) as n from t group by h having count(*) > 1)"


@query(f"{_TEXTS} select 'family_' || substr(h, 1, 16) as family_id, h as content_hash, n from f")
def dup_families(s, d):
    return families.families(table(s, d, "documents"), "doc_id", "text")


@query(f"{_TEXTS} select 'family_' || substr(t.h, 1, 16) as family_id, doc_id as member, row_number() over (partition by t.h order by doc_id) as place from t join f on f.h = t.h")
def dup_members(s, d):
    return families.family_members(table(s, d, "documents"), "doc_id", "text", "doc_id")


@query(f"{_TEXTS}, m as (select h, min(doc_id) as representative from t group by h) select doc_id, representative, n - 1 as copies from t join f on f.h = t.h join m on m.h = t.h")
def dup_of_links(s, d):
    return families.duplicate_of(table(s, d, "documents"), "doc_id", "text")


@query("""with q as (select vec_id, embedding from embeddings where vec_id % 50 = 0),
s as (select q.vec_id as query, e.vec_id as key, list_cosine_similarity(cast(q.embedding as double[]), cast(e.embedding as double[])) as cosine from q cross join embeddings e where q.vec_id <> e.vec_id)
select query, key, round(cosine, 6) as cosine, rank from (select *, row_number() over (partition by query order by round(cosine, 9) desc, key) as rank from s) where rank <= 10""")
def semantic_similar(s, d):
    rows = table(s, d, "embeddings").select("vec_id", "embedding")
    return families.nearest(rows, "vec_id", "embedding", rows.filter("vec_id % 50 = 0"))


# --- pages, batches, caps -----------------------------------------------------------------
_ROWS = "with r as (select csv_row, id, coalesce(nullif(website, ''), 'unknown') as website, coalesce(year, '') as year, coalesce(title, '') as title from law_catalog)"


def listed(s: SparkSession, d: str) -> DataFrame:
    return law(s, d).select("csv_row", "id", T.first_filled(F.col("website")).alias("website"), F.coalesce("year", F.lit("")).alias("year"), F.coalesce("title", F.lit("")).alias("title"))


@query(f"{_ROWS} select csv_row, id, website, rn, (rn - 1) // 200 + 1 as page from (select *, row_number() over (partition by website order by year, title, csv_row) as rn from r)")
def paginate(s, d):
    return paging.paginate(listed(s, d), "website", ["year", "title", "csv_row"]).select("csv_row", "id", "website", "rn", "page")


@query(f"""{_ROWS}, p as (select website, (rn - 1) // 200 + 1 as page, count(*) as links from (select *, row_number() over (partition by website order by csv_row) as rn from r) group by 1, 2)
select website, page, links, lag(page) over w as previous, lead(page) over w as next from p window w as (partition by website order by page)""")
def page_links(s, d):
    return paging.page_index(listed(s, d), "website")


@query("""select folder, csv_row, rn, n > 25 as overflow from (select folder, csv_row, row_number() over (partition by folder order by title, csv_row) as rn, count(*) over (partition by folder) as n from law_catalog where folder is not null and title is not null) where rn <= 25""")
def top_per_group(s, d):
    rows = law(s, d).filter("folder is not null and title is not null")
    return paging.top_of_group(rows.select("folder", "title", "csv_row"), "folder", ["title", "csv_row"], 25).select("folder", "csv_row", "rn", "overflow")


_PRIO = "cast(('0x' || substr(sha256('{}' || ':' || {}), 1, 15)) as bigint)"


@query(f"select id, (row_number() over (order by {_PRIO.format('batch', 'id')}, id) - 1) // 25 + 1 as batch from (select distinct id from law_catalog where id is not null)")
def batch_assign(s, d):
    return sampling.batches(law(s, d), "id", 25)


# --- folder trees -------------------------------------------------------------------------
_TREE = "with f as (select folder, title, filename, string_split(folder, '/') as parts from law_catalog where folder is not null and folder <> ''), t as (select array_to_string(parts[1:k], '/') as path, folder, title, filename from f, unnest(generate_series(1, len(parts))) as g(k))"


@query(f"{_TREE} select path, string_split(path, '/')[-1] as name, cast(len(string_split(path, '/')) as bigint) as depth, array_to_string(string_split(path, '/')[1:-2], '/') as parent, count(*) as n from t group by path")
def folder_tree(s, d):
    return tree.folder_tree(law(s, d), "folder")


@query(f"{_TREE} select distinct path from t where contains(lower(folder), 'energia') or contains(lower(concat_ws(' ', title, filename)), 'energia')")
def tree_filter(s, d):
    return tree.tree_filter(law(s, d), "folder", ["title", "filename"], "Energia")


# --- search -------------------------------------------------------------------------------
_WORDS = "with w as (select doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+', 0) as w from documents where text is not null)"


def index(s: SparkSession, d: str) -> search.Index:
    return search.indexed(table(s, d, "documents"), "doc_id", "text")


@query(f"{_WORDS} select doc_id from w where list_contains(w, 'contador') and list_contains(w, 'fatura')")
def search_match(s, d):
    return search.bm25(index(s, d), "Contador fatura").select("doc_id")


_BM25 = f"""{_WORDS}, st as (select count(*) as docs, avg(len(w)) as mean, sum(cast(list_contains(w, 'contador') as int)) as d0, sum(cast(list_contains(w, 'fatura') as int)) as d1 from w),
h as (select doc_id, len(w) as l, len(list_filter(w, lambda x: x = 'contador')) as t0, len(list_filter(w, lambda x: x = 'fatura')) as t1 from w),
s as (select doc_id, round(ln(1 + (docs - d0 + 0.5) / (d0 + 0.5)) * t0 * 2.2 / (t0 + 1.2 * (0.25 + 0.75 * l / mean)) + ln(1 + (docs - d1 + 0.5) / (d1 + 0.5)) * t1 * 2.2 / (t1 + 1.2 * (0.25 + 0.75 * l / mean)), 6) as score from h cross join st where t0 > 0 and t1 > 0)"""


@query(f"{_BM25} select doc_id, score from s")
def search_bm25(s, d):
    return search.bm25(index(s, d), "Contador fatura")


@query(f"{_BM25} select doc_id, score, (select count(*) from s) as matches from s order by score desc, doc_id limit 100")
def search_topk(s, d):
    return search.top_hits(search.bm25(index(s, d), "Contador fatura"), "doc_id")


@query(f"{_WORDS}, x as (select doc_id, unnest(w) as word from w), p as (select doc_id, word, count(*) as tf from x group by all) select word, count(*) as docs, cast(sum(tf) as bigint) as total from p group by word")
def search_index(s, d):
    return search.postings(table(s, d, "documents"), "doc_id", "text").groupBy("word").agg(F.count(F.lit(1)).alias("docs"), F.sum("tf").alias("total"))


# --- set operations and joins -------------------------------------------------------------
@query("select id, title, rel_raw, null as pdf_path, len(categories) as n_categories from law_catalog union all select id, title, rel_raw, pdf_path, null from pdf_catalog")
def catalog_union(s, d):
    a = law(s, d).select("id", "title", "rel_raw", F.when(F.col("categories").isNotNull(), F.size("categories")).cast("bigint").alias("n_categories"))
    return a.unionByName(pdf(s, d).select("id", "title", "rel_raw", "pdf_path"), allowMissingColumns=True)


@query("select id from law_catalog where id is not null except select id from raw_pages where text is not null and trim(text) <> ''")
def set_except(s, d):
    return law(s, d).filter("id is not null").select("id").distinct().join(pages(s, d).filter("text is not null and trim(text) <> ''").select("id"), "id", "left_anti")


@query("select subject from connections intersect select object from connections")
def set_intersect(s, d):
    return edges(s, d).select("subject").intersect(edges(s, d).select("object"))


@query("select distinct rel_raw from raw_pages where rel_raw is not null and rel_raw not in (select rel_raw from law_catalog where rel_raw is not null) and rel_raw not in (select rel_raw from pdf_catalog where rel_raw is not null)")
def orphans(s, d):
    known = law(s, d).select("rel_raw").union(pdf(s, d).select("rel_raw"))
    return pages(s, d).filter("rel_raw is not null").select("rel_raw").distinct().join(known, "rel_raw", "left_anti")


@query("""with c as (select distinct id from law_catalog where id is not null), p as (select distinct id from raw_pages where id is not null), e as (select distinct substr(subject, 10) as id from connections where subject like 'document:%')
select id, id in (select id from c) as catalog, id in (select id from p) as page, id in (select id from e) as edge from (select id from c union select id from p union select id from e)
where not (id in (select id from c) and id in (select id from p) and id in (select id from e))""")
def parity(s, d):
    e = edges(s, d).filter("subject like 'document:%'").select(F.expr("substr(subject, 10)").alias("id"))
    return lint.parity({"catalog": law(s, d), "page": pages(s, d), "edge": e}, "id")


@query("""with l as (select distinct subject, object from connections where predicate = 'document_of' and subject is not null and object is not null), g as (select object, min(subject) as first, count(*) as n from l group by object having count(*) > 1)
select l.subject, g.first as same_case_as, g.n - 1 as others from l join g using (object)""")
def same_case_as(s, d):
    """Each document of a shared case with the case's least document; a row a document, not a row a pair."""
    rows = edges(s, d).filter("predicate = 'document_of' and subject is not null and object is not null").select("subject", "object").distinct()
    case = rows.groupBy("object").agg(F.min("subject").alias("same_case_as"), (F.count(F.lit(1)) - 1).alias("others")).filter("others > 0")
    return rows.join(case, "object").select("subject", "same_case_as", "others")


# --- graph and review ---------------------------------------------------------------------
@query("select predicate, count(*) as n, count(distinct assertion_id) as assertions from connections group by 1")
def edges_by_predicate(s, d):
    return edges(s, d).groupBy("predicate").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("assertion_id").alias("assertions"))


@query("select predicate, count(*) filter (method = 'regex') as regex, count(*) filter (method = 'metadata') as metadata from connections where predicate is not null group by 1")
def edges_by_method(s, d):
    return edges(s, d).filter("predicate is not null").groupBy("predicate").pivot("method", ["regex", "metadata"]).agg(F.count(F.lit(1))).fillna(0)


@query("select object, count(*) as n from connections where object is not null group by 1")
def hub_degree(s, d):
    return graph.hubs(edges(s, d))


@query("""select key, sum(i) as degree_in, sum(o) as degree_out, string_split(key, ':')[1] as type from (select subject as key, 0 as i, 1 as o from connections union all select object, 1, 0 from connections) where key is not null group by key""")
def graph_nodes(s, d):
    return graph.nodes(edges(s, d))


_TOPICS = f"select 'topic:' || {SLUG.format('topic')} as key, min(topic) as label, count(*) as n from (select distinct id, topic from law_catalog where coalesce(topic, '') <> '') group by 1"


@query(_TOPICS)
def keywords(s, d):
    return graph.keywords(law(s, d))


@query(f"select 'root' as node, 'root' as type, count(*) as n from law_catalog union all select 'group:' || g, 'group', 0 from unnest(['source', 'topic', 'folder', 'website', 'year']) as x(g) union all select key, 'topic', n from ({_TOPICS})")
def graph_payload(s, d):
    return graph.payload_nodes(law(s, d))


_HOP = "with b as (select subject as a, object as b from connections where subject is not null and object is not null union select object, subject from connections where subject is not null and object is not null)"


@query(f"""{_HOP}, h0 as (select 'outcome:improcedente-total' as node), h1 as (select distinct b as node from b join h0 on a = node where b not in (select node from h0)),
h2 as (select distinct b as node from b join h1 on a = node where b not in (select node from h0) and b not in (select node from h1))
select node, 0 as hop from h0 union all select node, 1 from h1 union all select node, 2 from h2""")
def khop(s, d):
    rows = edges(s, d).filter("subject is not null and object is not null")
    return graph.khop(rows, s.range(1).select(F.lit("outcome:improcedente-total").alias("node")), 2)


@query("select lower(evidence) as label, count(distinct object) as keys from connections where evidence is not null and object is not null group by 1 having count(distinct object) > 1")
def label_clashes(s, d):
    return graph.label_clashes(edges(s, d), "evidence", "object")


@query("""with r as (select assertion_id, min(predicate) as predicate from connections where assertion_id is not null and predicate is not null group by 1), h as (select *, sha256('pilot-precision-v1:' || assertion_id) as digest from r),
k as (select *, row_number() over (partition by predicate order by digest) as rn from h) select assertion_id, predicate, digest from k order by rn > 3, digest limit 100""")
def stratified_sample(s, d):
    return sampling.precision_sample(edges(s, d), 100)


_PILOT = f"""with k as (select id, min(coalesce(website, 'unknown')) as website, min(coalesce(topic, 'unknown')) as topic, min(coalesce(year, 'unknown')) as year from law_catalog where id is not null group by id),
texts as (select distinct id, sha256(text) as h from raw_pages where text is not null and id is not null), twins as (select id from texts where h in (select h from texts group by h having count(*) > 1)),
must as (select id from k where id in (select id from raw_pages where length(text) <= 500) or id in (select id from twins)), rest as (select *, {_PRIO.format('46', 'id')} as p from k where id not in (select id from must)),
turns as (select *, row_number() over (partition by website, topic, year order by p, id) as t from rest)"""


@query(f"{_PILOT} select id, 'mandatory' as chosen from must union all select * from (select id, 'stratum' from turns order by t, p, id limit (select greatest(0, 250 - count(*)) from must))")
def pilot_selection(s, d):
    """A pilot of 250: all documents of short texts and of texts that others have, then the strata in turn."""
    short = pages(s, d).filter("length(text) <= 500").select("id")
    twins = families.duplicate_of(pages(s, d), "id", "text").select("id")
    return sampling.pilot(law(s, d).filter("id is not null"), "id", short.union(twins), 250, ["website", "topic", "year"])


# --- versions and increments --------------------------------------------------------------
@query("select assertion_id, predicate, loaded_at from (select *, row_number() over (partition by assertion_id order by loaded_at desc, recorded_at desc) as rn from connections where assertion_id is not null) where rn = 1")
def latest_record(s, d):
    return graph.latest(edges(s, d).filter("assertion_id is not null").select("assertion_id", "predicate", "loaded_at", "recorded_at"), "assertion_id", ["loaded_at", "recorded_at"]).select("assertion_id", "predicate", "loaded_at")


_SIDES = "with b as (select event_id as k, event_type as v from events where event_id % 5 <> 0), l as (select event_id as k, case when event_id % 3 = 0 then upper(event_type) else event_type end as v from events where event_id % 5 <> 1 and event_id % 7 <> 0), r as (select event_id as k, case when event_id % 4 = 0 then event_type || '+' else event_type end as v from events where event_id % 11 <> 0)"


@query(f"""{_SIDES} select k, case when l.k is not null and not (b.k is not null and l.v = b.v and r.k is not null) then l.v else r.v end as v from b full join l using (k) full join r using (k)
where (l.k is not null and (r.k is not null or b.k is null or l.v <> b.v)) or (l.k is null and r.k is not null and b.k is null)""")
def three_way_merge(s, d):
    e = table(s, d, "events").select(F.col("event_id").alias("k"), F.col("event_type").alias("v"))
    base = e.filter("k % 5 <> 0")
    local = e.filter("k % 5 <> 1 and k % 7 <> 0").withColumn("v", F.when(F.col("k") % 3 == 0, F.upper("v")).otherwise(F.col("v")))
    remote = e.filter("k % 11 <> 0").withColumn("v", F.when(F.col("k") % 4 == 0, F.concat("v", F.lit("+"))).otherwise(F.col("v")))
    return merge.three_way(base, local, remote, "k", "v")


@query("select user_id, event_type, ts from (select *, row_number() over (partition by user_id order by ts desc, mine desc, event_type desc) as rn from (select user_id, event_type, ts, 1 as mine from events where event_id % 2 = 0 union all select user_id, event_type, ts, 0 from events where event_id % 2 = 1)) where rn = 1")
def merge_records(s, d):
    e = table(s, d, "events")
    pick = lambda x: x.select("user_id", "event_type", "ts")
    return merge.merge_records(pick(e.filter("event_id % 2 = 0")), pick(e.filter("event_id % 2 = 1")), "user_id", "ts")


_HASHED = "with h as (select rel_raw, max(imported) as imported, max(sha256(coalesce(text, ''))) as h from raw_pages where rel_raw is not null group by 1), o as (select rel_raw, case when substr(h, 1, 1) = '0' then 'changed' else h end as h from h where imported < '2024-08-01'), n as (select rel_raw, h from h where substr(h, 2, 1) <> '0')"
_STATUS = "select rel_raw, case when o.rel_raw is null then 'written' when n.rel_raw is null then 'absent' when o.h = n.h then 'unchanged' else 'protected' end as status from o full join n using (rel_raw)"


def versions(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    h = pages(s, d).filter("rel_raw is not null").groupBy("rel_raw").agg(F.max("imported").alias("imported"), F.max(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("h"))
    old = h.filter("imported < '2024-08-01'").select("rel_raw", F.when(F.substring("h", 1, 1) == "0", "changed").otherwise(F.col("h")).alias("h"))
    return old, h.filter(F.substring("h", 2, 1) != "0").select("rel_raw", "h")


@query(f"{_HASHED} {_STATUS}")
def incremental_status(s, d):
    return merge.incremental_status(*versions(s, d), "rel_raw", "h")


@query(f"{_HASHED} select status, count(*) as n from ({_STATUS}) group by 1")
def import_stats(s, d):
    return merge.incremental_status(*versions(s, d), "rel_raw", "h").groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query("select distinct sha256(text) as h from raw_pages where text is not null and imported >= '2024-06-01' and sha256(text) not in (select sha256(text) from raw_pages where text is not null and imported < '2024-06-01')")
def import_dedup(s, d):
    rows = pages(s, d).filter("text is not null").select(F.sha2("text", 256).alias("h"), "imported")
    return rows.filter("imported >= '2024-06-01'").select("h").distinct().join(rows.filter("imported < '2024-06-01'").select("h"), "h", "left_anti")


# --- checks and reports -------------------------------------------------------------------
@query("""with f as (select folder || '/' || rel_raw as path, length(coalesce(text, '')) as size from raw_pages where folder is not null and rel_raw is not null)
select count(*) as files, coalesce(sum(cast(size >= 4000 as bigint)), 0) as oversized, coalesce(sum(case when list_contains(string_split(path, '/'), 'raw') and list_contains(string_split(path, '/'), 'Outros') then size else 0 end), 0) as artifact_bytes,
coalesce(sum(cast(size >= 4000 as bigint)), 0) = 0 and coalesce(sum(case when list_contains(string_split(path, '/'), 'raw') and list_contains(string_split(path, '/'), 'Outros') then size else 0 end), 0) <= 996147200 as ok
from f where not list_has_any(string_split(path, '/'), ['.git', 'node_modules', '.astro'])""")
def publication_check(s, d):
    files = pages(s, d).filter("folder is not null and rel_raw is not null").select(F.concat_ws("/", "folder", "rel_raw").alias("path"), F.length(F.coalesce("text", F.lit(""))).cast("bigint").alias("size"))
    return lint.publication_check(files, "path", "size", artifact=("raw", "Outros"), file_limit=4000)


@query("""with h as (select sha256(concat_ws('|', coalesce(cast(csv_row as varchar), 'null'), coalesce(id, 'null'), coalesce(title, 'null'), coalesce(topic_raw, 'null'))) as h from law_catalog),
p as (select k, cast(sum(cast(('0x' || substr(h, 1 + 15 * k, 15)) as hugeint)) as varchar) as s from h, unnest([0, 1, 2, 3]) as g(k) group by k) select sha256(string_agg(s, ':' order by k)) as digest from p""")
def aggregate_hash(s, d):
    return lint.aggregate_hash(law(s, d), ["csv_row", "id", "title", "topic_raw"])


@query("""with now as (select * from (select assertion_id, predicate, review_state, row_number() over (partition by assertion_id order by loaded_at desc, recorded_at desc, predicate desc, review_state desc nulls last) as rn from connections where assertion_id is not null) where rn = 1)
select 'catalog-without-page' as rule, (select count(distinct rel_raw) from law_catalog where rel_raw is not null and rel_raw not in (select rel_raw from raw_pages where rel_raw is not null)) as n
union all select 'page-without-catalog', (select count(distinct rel_raw) from raw_pages where rel_raw is not null and rel_raw not in (select rel_raw from law_catalog where rel_raw is not null union select rel_raw from pdf_catalog where rel_raw is not null))
union all select 'repeated-id', (select count(*) from (select id from law_catalog where id is not null group by id having count(*) > 1))
union all select 'accepted-without-evidence', (select count(*) from connections where review_state = 'accepted' and coalesce(evidence, '') = '')
union all select 'missing-citation', (select count(*) from connections where predicate like 'cites\\_%' escape '\\' and coalesce(evidence, '') = '')
union all select 'unverified-authority', (select count(*) from now where predicate = 'cites_authority' and coalesce(review_state, '') <> 'accepted')
union all select 'stale-as-of', (select count(*) from law_catalog where try_cast(substr(imported, 1, 4) as int) - try_cast(year as int) > 10)
union all select 'is-empty-wrong', (select count(*) from raw_pages where is_empty = 'True' and regexp_matches(text, '\\S'))""")
def lint_report(s, d):
    return lint.lint_report(law(s, d), pages(s, d), edges(s, d), pdf(s, d))


@query("""with p as (select rel_raw, min(text) as text from raw_pages where rel_raw is not null group by 1)
select l.csv_row, l.rel_raw, length(coalesce(p.text, '')) as chars from law_catalog l left join p on p.rel_raw = l.rel_raw""")
def page_join(s, d):
    return readers.page_values(law(s, d).select("csv_row", "rel_raw"), pages(s, d), F.length("text").cast("bigint"), "chars").select("csv_row", "rel_raw", "chars")


@query("""with p as (select rel_raw, min(text) as text from raw_pages where rel_raw is not null group by 1)
select l.csv_row, sha256(coalesce(p.text, '')) as h from law_catalog l left join p on p.rel_raw = l.rel_raw where l.year = '2022'""")
def page_read(s, d):
    """The texts of some records' pages; a missing page reads as ""."""
    return readers.page_text(law(s, d).filter("year = '2022'").select("csv_row", "rel_raw"), pages(s, d)).select("csv_row", F.sha2("text", 256).alias("h"))


@query("select 'documents' as stat, count(*) as n from law_catalog union all select 'pdfs', count(distinct pdf_path) from pdf_catalog union all select 'pages', count(distinct rel_raw) from raw_pages")
def build_stats(s, d):
    a = law(s, d).agg(F.count(F.lit(1)).alias("n")).select(F.lit("documents").alias("stat"), "n")
    b = pdf(s, d).agg(F.count_distinct("pdf_path").alias("n")).select(F.lit("pdfs").alias("stat"), "n")
    return a.unionAll(b).unionAll(pages(s, d).agg(F.count_distinct("rel_raw").alias("n")).select(F.lit("pages").alias("stat"), "n"))


@query("select not exists (select id from law_catalog where id is not null except select id from raw_pages) and not exists (select id from raw_pages where id is not null except select id from law_catalog) as same")
def id_sets_equal(s, d):
    a, b = (x.select("id").filter("id is not null").distinct().withColumn(n, F.lit(1)) for x, n in ((law(s, d), "a"), (pages(s, d), "b")))
    return a.join(b, "id", "full_outer").agg((F.coalesce(F.sum((F.col("a").isNull() | F.col("b").isNull()).cast("int")), F.lit(0)) == 0).alias("same"))


@query("select coalesce(review_state, 'unknown') as state, coalesce(review_state, '') <> 'accepted' as warning, count(*) as n from connections group by all")
def review_warning(s, d):
    rows = edges(s, d).groupBy(F.coalesce("review_state", F.lit("unknown")).alias("state"), (F.coalesce("review_state", F.lit("")) != "accepted").alias("warning"))
    return rows.agg(F.count(F.lit(1)).alias("n"))


@query("select rel_source from law_catalog where rel_source is not null and not starts_with(rel_source, 'raw/') and not starts_with(rel_source, 'wiki/indexes')")
def research_filter(s, d):
    return law(s, d).filter("rel_source is not null").filter(~F.col("rel_source").startswith("raw/") & ~F.col("rel_source").startswith("wiki/indexes")).select("rel_source")


@query("select distinct topic as option from law_catalog where coalesce(topic, '') <> ''")
def select_options(s, d):
    """Facet options in the order of the Portuguese collation."""
    return law(s, d).filter(F.coalesce("topic", F.lit("")) != "").select(F.col("topic").alias("option")).distinct().orderBy(F.collate("option", "pt"))


@query()
def markdown_html(s, d):
    return pages(s, d).filter("text is not null").select("rel_raw", to_html(F.col("text")).alias("html"))


@query("select h.object, coalesce(h.n, 0) as inbound, n.label from (select object, count(*) as n from connections where predicate = 'about_topic' and object is not null group by 1) h left join (select 'topic:' || " + SLUG.format("topic") + " as key, min(topic) as label from topic_list group by 1) n on n.key = h.object")
def hub_labels(s, d):
    labels = table(s, d, "topic_list").groupBy(F.concat(F.lit("topic:"), T.slugify(F.col("topic"))).alias("object")).agg(F.min("topic").alias("label"))
    return graph.hubs(edges(s, d).filter("predicate = 'about_topic'")).join(labels, "object", "left").select("object", F.col("n").alias("inbound"), "label")


# --- events -------------------------------------------------------------------------------
@query("select event_type, date_trunc('hour', ts) as hour, count(*) as n, round(sum(value), 4) as total from events group by 1, 2")
def tumbling_counts(s, d):
    return table(s, d, "events").groupBy("event_type", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("select event_id, cast(json_extract_string(props, '$.k') as bigint) as k from events")
def json_field(s, d):
    return table(s, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"))


@query("select user_id, event_id, ts, lag(event_id) over (partition by user_id order by ts, event_id) as previous from events")
def ordered_log(s, d):
    return table(s, d, "events").select("user_id", "event_id", "ts", F.lag("event_id").over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("previous"))


@query("""with w as (select date_trunc('hour', ts) as window_start, event_type, count(*) as n from events group by 1, 2)
select * from w where window_start + interval 1 hour <= (select max(ts) - interval 1 hour from events)""")
def stream_windows(s, d):
    """Hourly counts by a stream with a watermark; windows still open at the end are not appended."""
    work = f"{shared_dir(s)}/stream-{uuid.uuid4().hex}"
    out = ingest.run_windowed(s, f"{d}/events.parquet*", table(s, d, "events").schema, "ts", "event_type", f"{work}/out", f"{work}/state")
    return out.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("select distinct rel_raw, 'written' as status from raw_pages where rel_raw is not null")
def ingest_first(s, d):
    """Status of all pages on their first ingest into an empty store."""
    rows = pages(s, d).select("rel_raw", F.sha2(F.coalesce("text", F.lit("")), 256).alias("h"))
    return ingest.ingest_batch(rows, f"{shared_dir(s)}/store-{uuid.uuid4().hex}", "rel_raw", "h")
