"""Queries of sources, sinks and merges: tables are written to the run's folder and read back, each with its SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as ST

from actaloom.functions import identity as I
from actaloom.functions import text as T
from actaloom.operators import merge
from actaloom.operators.texts import one_text
from actaloom.plans.corpus import PAGE, law, pages, pdf, query
from actaloom.session import run_dir, table
from actaloom.sources import readers, sinks

TEXTS = ST.StructType([ST.StructField(n, ST.StringType()) for n in ("id", "title", "filename", "folder", "year", "website", "topic", "topic_raw", "rel_raw", "rel_source")])


def folder(s: SparkSession, name: str) -> str:
    """A new folder below the run's own, as a path that tasks can open as well."""
    return f"{run_dir(s)}/{name}-{uuid.uuid4().hex}".removeprefix("file://").removeprefix("file:")


def whole_pages(s: SparkSession, d: str) -> DataFrame:
    """(rel_raw, page): one markdown page for each key of raw_pages that has a text, an id and a file name."""
    rows = pages(s, d).filter("text is not null and id is not null and filename is not null")
    head = F.concat(F.lit('---\nid: "'), "id", F.lit('"\nwebsite: "'), F.coalesce("website", F.lit("")), F.lit('"\n---\n# '), "filename", F.lit("\n## Full text\n\n"), "text", F.lit("\n"))
    return one_text(rows.select("rel_raw", head.alias("page")), "rel_raw", "page").dropDuplicates(["rel"]).select(F.col("rel").alias("rel_raw"), F.col("text").alias("page"))


_PAGES = f"w as (select rel_raw, min({PAGE}) as page from raw_pages where rel_raw is not null and text is not null and id is not null and filename is not null group by rel_raw)"


def written(s: SparkSession, d: str) -> str:
    root = folder(s, "pages")
    sinks.write_pages(whole_pages(s, d).select(F.concat("rel_raw", F.lit(".md")).alias("path"), F.col("page").alias("content")), root)
    return root


@query(f"with {_PAGES} select rel_raw || '.md' as path, cast(strlen(page) as bigint) as size from w")
def file_sizes(s, d):
    return readers.file_sizes(s, written(s, d))


@query(f"with {_PAGES} select rel_raw || '.md' as path, cast(strlen(page) as bigint) as size, sha256(page) as sha256 from w")
def input_fingerprint(s, d):
    root = written(s, d)
    return readers.input_fingerprint(s, root).select(I.relative_path(F.col("path"), root).alias("path"), "size", "sha256")


_TRIM = "regexp_replace(regexp_replace({}, '^\\s+', ''), '\\s+$', '')"


@query(f"""with {_PAGES}, b as (select *, regexp_replace(page, '^---\\n[\\s\\S]*?\\n---\\n', '') as body from w)
select rel_raw || '.md' as path, regexp_extract(page, 'id: "([^"]*)"', 1) as id, regexp_extract(page, 'website: "([^"]*)"', 1) as website,
sha256(coalesce(nullif({_TRIM.format("split_part(body, '## Full text', 2) || case when strpos(body[strpos(body, '## Full text') + 12:], '## Full text') > 0 then body[strpos(body, '## Full text') + 12 + length(split_part(body, '## Full text', 2)):] else '' end")}, ''), body)) as h from b""")
def page_scan(s, d):
    """Markdown pages read back: keys of the frontmatter and the full text."""
    root = written(s, d)
    rows = readers.read_pages(s, root, ("id", "website"))
    return rows.select(I.relative_path(F.col("path"), root).alias("path"), "id", "website", F.sha2("text", 256).alias("h"))


@query(f"with {_PAGES} select rel_raw || '.md' as path, cast(strlen(page) as bigint) as size from w")
def copied_files(s, d):
    """A folder copied from a manifest."""
    root, target = written(s, d), folder(s, "public")
    sinks.copy_files(readers.file_sizes(s, root).select(F.col("path").alias("rel")), root, target)
    return readers.file_sizes(s, target)


@query(f"with {_PAGES} select rel_raw, sha256(page || chr(10) || chr(10) || '<!-- GRAPH:BEGIN -->' || chr(10) || 'two' || chr(10) || '<!-- GRAPH:END -->') as h from w")
def managed_block(s, d):
    """A block that is put into a page and then replaced."""
    once = whole_pages(s, d).select("rel_raw", sinks.replace_block(F.col("page"), F.lit("one")).alias("page"))
    return once.select("rel_raw", F.sha2(sinks.replace_block(F.col("page"), F.lit("two")), 256).alias("h"))


@query(f"""with {_PAGES} select rel_raw, sha256(replace(page, chr(10) || '---' || chr(10) || '# ', chr(10) || '# GRAPH:BEGIN' || chr(10) || 'enrichment_state: graph-reviewed' || chr(10) || '# GRAPH:END' || chr(10) || '---' || chr(10) || '# ')) as h
from w where length(page) - length(replace(page, chr(10) || '---' || chr(10) || '# ', '')) = 7""")
def managed_head(s, d):
    """The managed lines of a frontmatter, put in and then replaced."""
    sep = "\n---\n# "
    rows = whole_pages(s, d).filter(F.length("page") - F.length(F.replace("page", F.lit(sep), F.lit(""))) == len(sep))
    once = rows.select("rel_raw", sinks.replace_head_block(F.col("page"), F.lit("enrichment_state: none")).alias("page"))
    return once.select("rel_raw", F.sha2(sinks.replace_head_block(F.col("page"), F.lit("enrichment_state: graph-reviewed")), 256).alias("h"))


@query("select rel_raw, sha256(case when text like '%## %' then text else text end) as h from raw_pages where text is not null and not contains(text, '## ') and not starts_with(text, '---')")
def fallback_text(s, d):
    """The full text of a page without sections is its body."""
    rows = pages(s, d).filter(F.col("text").isNotNull() & ~F.col("text").contains("## ") & ~F.col("text").startswith("---"))
    return rows.select("rel_raw", F.sha2(T.full_text(F.col("text")), 256).alias("h"))


@query("select rel_raw, regexp_replace(rel_raw, '^raw/', '') as path from (select distinct rel_raw from raw_pages where rel_raw is not null)")
def relative_paths(s, d):
    rows = pages(s, d).filter("rel_raw is not null").select("rel_raw").distinct()
    return rows.select("rel_raw", I.relative_path(F.concat(F.lit("file:/data/corpus/"), F.regexp_replace("rel_raw", "^raw/", "")), "/data/corpus").alias("path"))


_COLUMNS = ", ".join(TEXTS.names)


@query(f"select {', '.join(f'nullif({c}, {chr(39) * 2}) as {c}' for c in TEXTS.names)} from law_catalog")
def csv_import(s, d):
    """The catalog written as CSV and imported again; quotes and line ends survive, empty cells are null."""
    path = folder(s, "csv")
    law(s, d).select(*TEXTS.names).write.csv(path, header=True, quote='"', escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return readers.read_csv(s, path, TEXTS)


@query(f"select {_COLUMNS}, categories, null::varchar as pdf_path from law_catalog union all select {_COLUMNS}, null, pdf_path from pdf_catalog")
def jsonl_scan(s, d):
    """Both catalogs as JSON lines, appended to one store and read by one schema."""
    path = folder(s, "jsonl")
    sinks.write_json_lines(law(s, d).select(*TEXTS.names, "categories"), path)
    sinks.append_log(pdf(s, d).select(*TEXTS.names, "pdf_path"), path)
    return readers.read_jsonl(s, path, readers.CATALOG).select(*TEXTS.names, "categories", "pdf_path")


@query("select csv_row, id, title from law_catalog where csv_row is not null")
def json_artifact(s, d):
    """A published JSON document read back line by line."""
    path = folder(s, "artifact")
    sinks.write_json_document(law(s, d).filter("csv_row is not null").select("csv_row", "id", "title"), path)
    lines = s.read.text(path).filter("value like '%}%' and value <> ']}'").select(F.regexp_replace("value", "^,", "").alias("v"))
    return lines.select(F.from_json("v", "csv_row bigint, id string, title string").alias("r")).select("r.*")


@query("select event_id, event_type from events union all select event_id, event_type from events where event_id % 10 = 0")
def log_append(s, d):
    """A log that is appended to twice."""
    path, e = folder(s, "log"), table(s, d, "events").select("event_id", "event_type")
    sinks.append_log(e, path)
    sinks.append_log(e.filter("event_id % 10 = 0"), path)
    return readers.read_jsonl(s, path, ST.StructType([ST.StructField("event_id", ST.LongType()), ST.StructField("event_type", ST.StringType())]))


@query("select id, min(coalesce(nullif(website, ''), 'unknown')) as website, min(coalesce(nullif(year, ''), 'unknown')) as year from law_catalog where id is not null group by id")
def raw_store(s, d):
    """The partitioned store after two writes, the second of which repeats the first and adds the rest."""
    path = folder(s, "store")
    rows = law(s, d).filter("id is not null").groupBy("id").agg(F.min(T.first_filled(F.col("website"))).alias("website"), F.min(T.first_filled(F.col("year"))).alias("year"))
    sinks.write_raw_store(rows.filter(F.crc32("id") % 2 == 0), path)
    sinks.write_raw_store(rows, path)
    return s.read.schema("id string, website string, year string").parquet(path)


_PDFS = "p as (select distinct regexp_replace(replace(pdf_path, '\\', '/'), '^raw/pdfs/', '') as pdf_path from pdf_catalog where pdf_path is not null), f as (select * from p where pdf_path like '%/%.pdf' and pdf_path not like '%//%')"
_PDF_STATE = "left(sha256('one:' || pdf_path), 1) < '4' as changes"


def pdf_files(s: SparkSession, d: str) -> DataFrame:
    """(path, content): a small file for each path of the pdf catalog."""
    unified = F.regexp_replace(F.replace("pdf_path", F.lit("\\"), F.lit("/")), "^raw/pdfs/", "")
    rows = pdf(s, d).filter("pdf_path is not null").select(unified.alias("path")).distinct().filter("path like '%/%.pdf' and path not like '%//%'")
    return rows.select("path", F.concat(F.lit("%PDF "), "path").alias("content"))


def pdf_runs(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Two imports of the same files; the second reads another text from a quarter of them."""
    import hashlib

    root, store = folder(s, "pdfs"), folder(s, "imported")
    sinks.write_pages(pdf_files(s, d), root)

    def second(content: bytes) -> str:
        text = content.decode()
        return text + " again" if hashlib.sha256(f"one:{text[5:]}".encode()).hexdigest()[0] < "4" else text

    readers.import_pdfs(s, root, store, lambda content: content.decode())
    return readers.import_pdfs(s, root, store, second)


@query(f"""with {_PDFS} select pdf_path, string_split(pdf_path, '/')[1] as website, case when len(string_split(pdf_path, '/')) > 2 then string_split(pdf_path, '/')[2] else 'unknown' end as year,
regexp_replace(string_split(pdf_path, '/')[-1], '\\.[^.]*$', '') as title, '%PDF ' || pdf_path as text from f""")
def pdf_import(s, d):
    """The catalog of imported files: a second import adds nothing and changes nothing."""
    return pdf_runs(s, d)[0].select("pdf_path", "website", "year", "title", "text")


@query(f"with {_PDFS} select 'pdfs' as stat, count(*) as n from f union all select 'protected', count(*) from f where left(sha256('one:' || pdf_path), 1) < '4'")
def pdf_import_stats(s, d):
    rows, protected = pdf_runs(s, d)
    return rows.agg(F.count(F.lit(1)).alias("n")).select(F.lit("pdfs").alias("stat"), "n").unionAll(protected.agg(F.count(F.lit(1)).alias("n")).select(F.lit("protected").alias("stat"), "n"))


# --- merged documents ---------------------------------------------------------------------
_ITEMS = "i as (select l_orderkey as doc, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity) as n, l_quantity as q from lineitem)"


def items(s: SparkSession, d: str) -> DataFrame:
    """(doc, n, q): the lines of each order."""
    from pyspark.sql import Window

    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    return table(s, d, "lineitem").select(F.col("l_orderkey").alias("doc"), F.row_number().over(w).alias("n"), F.col("l_quantity").cast("int").alias("q"))


def side(rows: DataFrame, at: F.Column, q: F.Column, note: str) -> DataFrame:
    """Documents (doc, field, value): the records `items`, a plain field that both sides know and one of this side."""
    record = F.to_json(F.struct(F.concat(F.lit("n"), "n").alias("id"), at.cast("string").alias("updatedAt"), q.alias("q")))
    docs = rows.withColumn("r", F.struct("n", record.alias("r"))).groupBy("doc").agg(F.concat(F.lit("["), F.array_join(F.transform(F.sort_array(F.collect_list("r")), lambda x: x["r"]), ","), F.lit("]")).alias("items"))
    named = {"items": F.col("items"), "app": F.lit(f'"{note}"'), note: F.lit("1")}
    return docs.select("doc", F.explode(F.map_from_arrays(F.array(*map(F.lit, named)), F.array(*named.values()))).alias("field", "value"))


_MERGED = f"""{_ITEMS}, b as (select doc, n, q, 1 as at from i where n % 4 <> 0), l as (select doc, n, case when n % 3 = 0 then q + 100 else q end as q, case when n % 3 = 0 then 2 + n % 2 else 1 end as at from i where n % 4 <> 1),
r as (select doc, n, case when n % 2 = 0 then q + 500 else q end as q, case when n % 2 = 0 then 3 - n % 5 else 1 end as at from i where n % 5 <> 0)"""


@query(f"""with {_MERGED}, m as (select coalesce(l.doc, r.doc) as doc, coalesce(l.n, r.n) as n, case when l.n is not null and (r.n is null or not l.at < r.at) then l.q else r.q end as q, case when r.n is null then 1 else 0 end as fresh
from b full join l on l.doc = b.doc and l.n = b.n full join r on r.doc = coalesce(l.doc, b.doc) and r.n = coalesce(l.n, b.n)
where (l.n is not null and (r.n is not null or b.n is null or l.q <> b.q or l.at <> b.at)) or (l.n is null and r.n is not null and b.n is null))
select doc, 'n' || n as id, cast(q as bigint) as q, row_number() over (partition by doc order by fresh, n) as place from m""")
def document_merge(s, d):
    """Records of merged documents with their place: orders as documents, their lines as records."""
    return merged(s, d).filter("field = 'items'").select("doc", F.posexplode(F.from_json("value", "array<struct<id: string, updatedAt: string, q: bigint>>")).alias("pos", "r")).select("doc", "r.id", "r.q", (F.col("pos") + 1).cast("bigint").alias("place"))


def merged(s: SparkSession, d: str) -> DataFrame:
    i, n, q = items(s, d), F.col("n"), F.col("q")
    base = side(i.filter("n % 4 <> 0"), F.lit(1), q, "base")
    local = side(i.filter("n % 4 <> 1"), F.when(n % 3 == 0, 2 + n % 2).otherwise(1), F.when(n % 3 == 0, q + 100).otherwise(q), "local")
    remote = side(i.filter("n % 5 <> 0"), F.when(n % 2 == 0, 3 - n % 5).otherwise(1), F.when(n % 2 == 0, q + 500).otherwise(q), "remote")
    return merge.merge_documents(base, local, remote, "doc", "field", "value")


@query(f"""with {_ITEMS}, l as (select distinct doc from i where n % 4 <> 1), r as (select distinct doc from i where n % 5 <> 0), b as (select distinct doc from i where n % 4 <> 0)
select doc, 'app' as field, case when l.doc is not null then '"local"' else '"remote"' end as value from r full join l using (doc) left join b using (doc) where l.doc is not null or b.doc is null
union all select doc, 'local', '1' from l union all select doc, 'remote', '1' from r""")
def document_fields(s, d):
    """Plain fields of merged documents: fields that one side does not know survive."""
    return merged(s, d).filter("field <> 'items'")
