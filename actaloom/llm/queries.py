"""Queries of the training-data problems, each over its whole tables and whole texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from actaloom.llm import bpe, ledger, mapping, near_sets, packing, personal, quota, scans, sentences, site_lines
from actaloom.session import cut, table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return site_lines.repeated_lines(table(spark, d, "law_catalog"), "website", "rel_raw", table(spark, d, "raw_pages"), "rel_raw", "text")


def p1_clean(spark: SparkSession, d: str) -> DataFrame:
    """(rel_raw, text): the pages that law_catalog reaches, without their site's lines."""
    return site_lines.without_lines(law_pages(spark, d), "rel_raw", "text", p1_found(spark, d))


def p1_templates(spark: SparkSession, d: str) -> DataFrame:
    """(website, template, pages, forms): the sites' templates, with wildcards where their lines differ."""
    return site_lines.site_templates(table(spark, d, "law_catalog"), "website", "rel_raw", table(spark, d, "raw_pages"), "rel_raw", "text")


def law_pages(spark: SparkSession, d: str) -> DataFrame:
    """The raw pages that law_catalog reaches."""
    owners = table(spark, d, "law_catalog").select("rel_raw").filter("rel_raw is not null").distinct()
    return table(spark, d, "raw_pages").select("rel_raw", "text").join(owners, "rel_raw", "left_semi")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Candidates and statistics come from all raw pages; the rows are those of pages that law_catalog reaches."""
    owners = table(spark, d, "law_catalog").select("rel_raw").filter("rel_raw is not null").distinct()
    return personal.personal_information(table(spark, d, "raw_pages"), "rel_raw", "text").join(owners, "rel_raw", "left_semi")


def p2_clean(spark: SparkSession, d: str) -> DataFrame:
    """(rel_raw, text): the pages that law_catalog reaches, with typed placeholders."""
    return personal.redact(law_pages(spark, d), "rel_raw", "text", personal.mentions(table(spark, d, "raw_pages"), "rel_raw", "text"))


def _scans(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    pages = table(spark, d, "raw_pages").select(F.col("rel_raw").alias("rel"), "text").filter("rel is not null")
    scanned = table(spark, d, "pdf_catalog").select(F.col("rel_raw").alias("rel")).filter("rel is not null").distinct()
    return pages, scanned, *scans.scan_noise(pages, scanned)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _scans(spark, d)[2]


def p3_clean(spark: SparkSession, d: str) -> DataFrame:
    """(rel_raw, text): the scanned pages as continuous paragraphs."""
    pages, scanned, cases, repairs = _scans(spark, d)
    return scans.clean_text(pages.join(scanned, "rel", "left_semi"), cases, repairs)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return near_sets.similar_records(table(spark, d, "law_catalog"), "id", "rel_raw", table(spark, d, "raw_pages"), "rel_raw", "text")


def p4_groups(spark: SparkSession, d: str) -> DataFrame:
    return near_sets.similar_groups(table(spark, d, "law_catalog"), "id", "rel_raw", table(spark, d, "raw_pages"), "rel_raw", "text")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """(id, topic): records whose topic_raw is not a topic letter for letter."""
    rows, topics = table(spark, d, "law_catalog"), table(spark, d, "topic_list")
    typed = rows.select("id", F.col("topic_raw").alias("value")).filter(F.col("id").isNotNull() & F.col("value").isNotNull()).distinct()
    typed = typed.join(F.broadcast(topics.select(F.col("topic").alias("value")).distinct()), "value", "left_anti")  # a list of fixed size
    mapped = cut(mapping.map_values(typed, "value", topics, "topic", "aliases"))
    return typed.join(mapped, "value").select("id", F.col("entry").alias("topic")).distinct()


def p5_unmatched(spark: SparkSession, d: str) -> DataFrame:
    """(topic_raw, records): typed values without an entry, with the number of their rows."""
    rows, topics = table(spark, d, "law_catalog"), table(spark, d, "topic_list")
    lost = mapping.map_values(rows, "topic_raw", topics, "topic", "aliases").filter(F.col("entry") == mapping.UNMAPPED)
    return rows.join(lost.withColumnRenamed("value", "topic_raw"), "topic_raw").groupBy("topic_raw").agg(F.count(F.lit(1)).alias("records"))


def p6_sample(spark: SparkSession, d: str) -> DataFrame:
    """(id, step): a tenth of the distinct ids, by the ledger of this folder's catalog."""
    rows = table(spark, d, "law_catalog")
    kept = ledger.grow(rows, "id", "imported", 0.1, ledger.ledger_path(spark, d, "law_catalog", "id", 0.1))
    return ledger.present(kept, rows, "id").select(F.col("sample_key").alias("id"), "step")


def p7_sample(spark: SparkSession, d: str) -> DataFrame:
    sample, _ = quota.quota_sample(table(spark, d, "connections"), "assertion_id", "predicate", table(spark, d, "sample_targets").withColumnRenamed("predicate", "category"))
    return sample.select(F.col("rec_key").alias("assertion_id"), F.col("signature").alias("predicate"))


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    _, report = quota.quota_sample(table(spark, d, "connections"), "assertion_id", "predicate", table(spark, d, "sample_targets").withColumnRenamed("predicate", "category"))
    return report.withColumnRenamed("category", "predicate")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return p7_report(spark, d).filter(~F.col("attainable")).select("predicate").distinct()


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return bpe.encode_corpus(table(spark, d, "documents"), "doc_id", "text")


def p8_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, same): whether decoding the ids gives the text again."""
    ids = p8_ids(spark, d)
    back = bpe.decode_corpus(ids, "doc_id", "ids").withColumnRenamed("text", "back")
    return table(spark, d, "documents").select("doc_id", "text").join(back, "doc_id").select("doc_id", (F.coalesce("text", F.lit("")) == F.col("back")).alias("same"))


def p9_pack(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "pack_sizes"))


def p9_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill_report(p9_pack(spark, d), table(spark, d, "pack_sizes"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return sentences.split_sentences(table(spark, d, "documents"), "doc_id", "text")


def near_dup_documents(spark: SparkSession, d: str) -> DataFrame:
    """(id, group_id, links): five words, a similarity of 0.8 or more; a row for each document with a text."""
    docs = table(spark, d, "documents")
    return near_sets.similar_groups(docs, "doc_id", "doc_id", docs, "doc_id", "text", width=5, threshold=0.8)


QUERIES = {f.__name__: f for f in (near_dup_documents, p1_found, p1_clean, p1_templates, p2_found, p2_clean, p3_found, p3_clean, p4_found, p4_groups, p5_found, p5_unmatched, p6_sample, p7_found, p7_sample, p7_report, p8_ids, p8_roundtrip, p9_pack, p9_fill, p10_found)}

_P1 = """
with pages as (
  select rel_raw, min(text) as text from raw_pages where rel_raw is not null and text is not null and regexp_matches(text, '[^\\s\\x{00A0}\\x{3000}]') group by rel_raw),
owners as (select distinct website, rel_raw from law_catalog where website is not null and regexp_matches(website, '[^\\s\\x{00A0}]') and rel_raw is not null),
sizes as (select website, count(*) as pages from owners join pages using (rel_raw) group by website),
split as (select rel_raw, unnest(string_split(text, chr(10))) as line, unnest(generate_series(1, len(string_split(text, chr(10))))) as line_no from pages),
lines as (select website, rel_raw, line_no, lower(regexp_replace(line, '\\P{L}', '', 'g')) as letters from split join owners using (rel_raw)),
frequent as (
  select l.website, l.letters from lines l join sizes s on s.website = l.website where l.letters <> ''
  group by l.website, l.letters, s.pages having count(distinct l.rel_raw) >= 10 and count(distinct l.rel_raw) >= 0.08 * s.pages)
"""

_AVAILABLE = """
with ids as (select distinct assertion_id, predicate from connections where assertion_id is not null and predicate is not null),
size as (select count(distinct assertion_id) // 10 as n from ids),
have as (select predicate, count(distinct assertion_id) as available from ids group by predicate),
goal as (select t.predicate, coalesce(h.available, 0) as available, greatest(t.min_rows, cast(floor(t.target_share * size.n) as bigint)) as wanted
  from sample_targets t cross join size left join have h on h.predicate = t.predicate where t.predicate is not null)
"""

#: Sets of n consecutive words of each text, and the pairs of texts with their similarity.
_SETS = """
w as (select k, regexp_extract_all(lower(t), '[\\p{{L}}\\p{{N}}_]+', 0) as w from texts),
s as (select distinct k, unnest(case when len(w) < {n} then [array_to_string(w, ' ')] else list_transform(generate_series(1, len(w) - {n} + 1), lambda i: array_to_string(w[i:i + {n} - 1], ' ')) end) as x from w),
n as (select k, count(*) as n from s group by k),
near as (select a.k as a, b.k as b, count(*) as c from s a join s b on a.x = b.x and a.k < b.k group by 1, 2),
alike as (select a, b from near join n x on x.k = a join n y on y.k = b where c / (x.n + y.n - c) >= {least})
"""

_P4 = "with texts as (select rel_raw as k, min(text) as t from raw_pages where rel_raw in (select rel_raw from law_catalog where id is not null) and text is not null and regexp_matches(text, '[^\\s\\x{00A0}\\x{2007}\\x{202F}\\x{3000}]') group by 1)," + _SETS.format(n=3, least=0.5) + """,
own as (select distinct id, rel_raw as k from law_catalog where id is not null and rel_raw in (select k from texts)),
met as (select x.id as i, y.id as j from alike join own x on x.k = a join own y on y.k = b union all select x.id, y.id from own x join own y on x.k = y.k)"""

#: One row a record: its group, named by the least record that similar texts connect, and its class's links to other classes.
_GROUPS = """,
cls as (select k, md5(string_agg(x, chr(1) order by x)) as c from s group by k),
link as (select distinct x.c as c, y.c as d from (select a, b from alike union all select b, a from alike) e join cls x on x.k = e.a join cls y on y.k = e.b where x.c <> y.c),
many as (select c, count(*) as links from link group by c),
walk as (select c, c as o from cls union select w.c, l.d from walk w join link l on l.c = w.o),
root as (select c, min(o) as r from walk group by c),
member as (select distinct own.id, cls.c, root.r from own join cls on cls.k = own.k join root on root.c = cls.c),
name as (select r, min(id) as group_id from member group by r)
select m.id, min(n.group_id) as group_id, cast(max(coalesce(y.links, 0)) as bigint) as links from member m join name n on n.r = m.r left join many y on y.c = m.c group by m.id
"""
_NEAR = "with recursive texts as (select cast(doc_id as varchar) as k, text as t from documents where text is not null and regexp_matches(text, '[^\\s\\x{00A0}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}\\x{0085}]'))," + _SETS.format(n=5, least=0.8) + ", own as (select k as id, k from texts)" + _GROUPS

_P6 = """
with k as (select id, coalesce(min(try_strptime(substr(imported, 1, 10), '%Y-%m-%d')), timestamp '0001-01-01') as day from law_catalog where id is not null group by id),
d as (select day, count(*) as n from k group by day), c as (select day, sum(n) over (order by day) as seen, n, row_number() over (order by day) - 1 as step from d),
q as (select day, step, ceil(round(0.1 * seen, 6)) - ceil(round(0.1 * (seen - n), 6)) as take from c),
r as (select k.id, q.step, q.take, row_number() over (partition by k.day order by cast(('0x' || substr(sha256('ledger-v1:' || k.id), 1, 15)) as bigint), k.id) as place from k join q on q.day = k.day)
"""

ORACLE = {
    "p4_found": _P4 + " select distinct least(i, j) as id_a, greatest(i, j) as id_b from met where i <> j",
    "p4_groups": _P4.replace("with texts", "with recursive texts", 1).split(",\nmet as")[0] + _GROUPS,
    "near_dup_documents": _NEAR,
    "p6_sample": _P6 + "select id, cast(step as bigint) as step from r where place <= take",
    "p7_found": _AVAILABLE + "select distinct predicate from goal where available < wanted",
    "p1_found": _P1 + "select distinct l.rel_raw, cast(l.line_no as bigint) as line_no from lines l join frequent f on f.website = l.website and f.letters = l.letters",
    "p1_clean": _P1.rstrip() + """,
found as (select distinct l.rel_raw, l.line_no from lines l join frequent f on f.website = l.website and f.letters = l.letters),
own as (select rel_raw, min(text) as text from raw_pages where rel_raw in (select rel_raw from law_catalog) group by rel_raw),
cut as (select o.rel_raw, coalesce(string_agg(s.line, chr(10) order by s.line_no) filter (d.line_no is null), '') as text
  from own o join split s on s.rel_raw = o.rel_raw left join found d on d.rel_raw = s.rel_raw and d.line_no = s.line_no
  where o.rel_raw in (select rel_raw from found) group by o.rel_raw)
select o.rel_raw, case when c.rel_raw is null then o.text else c.text end as text from own o left join cut c on c.rel_raw = o.rel_raw
""",
    "p8_roundtrip": "select doc_id, true as same from documents",
}
