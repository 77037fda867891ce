"""Queries of the graph's blocks and payload, and of the review of assertions, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from actaloom.functions import text as T
from actaloom.operators import facets, graph, paging, review, sampling, texts, tree
from actaloom.plans.corpus import _TOPICS, SLUG, edges, law, pages, query
from actaloom.session import table

SLUG_OF = SLUG.format
CONN = "'conn_' || substr(sha256(subject || ':' || predicate || ':' || object), 1, 24)"


def topics(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "topic_list")


# --- edges, blocks, payload ---------------------------------------------------------------
_DUPLICATES = "t as (select distinct id, sha256(text) as h from raw_pages where text is not null and id is not null), m as (select h, min(id) as first from t group by h having count(*) > 1)"


@query(f"""with {_DUPLICATES}, e as (
select 'document:' || id as subject, 'about_topic' as predicate, 'topic:' || {SLUG_OF('topic')} as object from law_catalog where id is not null and coalesce(topic, '') <> ''
union select 'document:' || id, 'published_by', 'organization:' || {SLUG_OF('website')} from law_catalog where id is not null and coalesce(website, '') <> ''
union select 'document:' || l.id, 'about_sector', 'sector:' || {SLUG_OF('k.sector')} from law_catalog l join topic_list k on k.topic = l.topic where l.id is not null and coalesce(l.topic, '') <> '' and k.sector <> ''
union select 'document:' || t.id, 'exact_duplicate_of', 'document:' || m.first from t join m on m.h = t.h where t.id <> m.first) select *, {CONN} as assertion_id from e""")
def metadata_edges(s, d):
    return graph.metadata_edges(law(s, d), topics(s, d), pages(s, d))


_TITLES = "title as (select id, min(title) as title from law_catalog where id is not null group by id)"
_DOCUMENT = "subject like 'document:%' and object is not null and predicate is not null"


@query(f"""with e as (select distinct object, substr(subject, 10) as id, predicate from connections where {_DOCUMENT}), {_TITLES}
select e.object, row_number() over (partition by e.object order by e.id, e.predicate) as place, e.id, title.title, replace(e.predicate, '_', ' ') as label from e left join title on title.id = e.id""")
def hub_block(s, d):
    return graph.hub_block(edges(s, d), law(s, d))


@query(f"""with e as (select distinct subject, predicate, object from connections where {_DOCUMENT}), names as (select 'topic:' || {SLUG_OF('topic')} as object, min(topic) as label from topic_list group by 1)
select e.subject, row_number() over (partition by e.subject order by e.predicate, e.object) as place, replace(e.predicate, '_', ' ') as label, e.object, coalesce(n.label, regexp_replace(e.object, '^[^:]*:', '')) as shown from e left join names n on n.object = e.object""")
def source_block(s, d):
    names = topics(s, d).groupBy(F.concat(F.lit("topic:"), T.slugify(F.col("topic"))).alias("object")).agg(F.min("topic").alias("label"))
    return graph.source_block(edges(s, d), names)


_LINKS = "l as (select distinct subject as source, object as target, replace(predicate, '_', ' ') as label from connections where object is not null and predicate is not null and subject in (select 'document:' || id from law_catalog where id is not null))"


@query(f"with {_LINKS} select * from l")
def payload_links(s, d):
    return graph.payload_links(law(s, d), edges(s, d))


@query(f"""with {_LINKS}, k as ({_TOPICS}), ends as (select node, count(*) as n from (select source as node from l union all select target from l) group by node)
select 'root' as node, 'root' as type, count(*) as n from law_catalog union all select 'group:' || g, 'group', 0 from unnest(['source', 'topic', 'folder', 'website', 'year']) as x(g) union all select key, 'topic', n from k
union all select node, string_split(node, ':')[1], n from ends where node not in (select key from k)""")
def payload_nodes(s, d):
    return graph.payload_nodes(law(s, d), edges(s, d))


_SAME = "('exact_duplicate_of', 'template_sibling_of', 'semantically_similar_to')"


@query(f"""with recursive e as (select subject as a, object as b from connections where predicate in {_SAME} and subject is not null and object is not null union select object, subject from connections where predicate in {_SAME} and subject is not null and object is not null),
r as (select a as node, a as other from e union select r.node, e.b from r join e on e.a = r.other) select node, min(other) as component from r group by node""")
def duplicate_components(s, d):
    """Documents that edges of likeness connect, named by the least of them."""
    rows = edges(s, d).filter(f"predicate in {_SAME} and subject is not null and object is not null")
    return graph.components(rows, "subject", "object")


@query("select distinct object, regexp_replace(object, ':(\\d+)$', ':art-\\1') as provision from connections where predicate = 'cites_provision' and object is not null")
def provision_canonical(s, d):
    rows = edges(s, d).filter("predicate = 'cites_provision' and object is not null").select("object").distinct()
    return rows.withColumn("provision", T.canonical_provision(F.col("object")))


@query("select l.csv_row, coalesce(t.topic_kind, 'unmapped') as topic_kind, coalesce(array_to_string(t.categories, '|'), '') as categories from law_catalog l left join topic_list t on t.topic = l.topic")
def taxonomy_join(s, d):
    rows = facets.with_taxonomy(law(s, d).select("csv_row", "topic"), "topic", topics(s, d))
    return rows.select("csv_row", "topic_kind", F.array_join("topic_categories", "|").alias("categories"))


_CHILDREN = "with f as (select string_split(folder, '/') as parts from law_catalog where folder is not null and folder <> ''), t as (select array_to_string(parts[1:k], '/') as path from f, unnest(generate_series(1, len(parts))) as g(k)), c as (select path, string_split(path, '/')[-1] as name, array_to_string(string_split(path, '/')[1:-2], '/') as parent, count(*) as n from t group by path)"


@query(f"{_CHILDREN} select parent, row_number() over (partition by parent order by name) as place, name, n from c")
def folder_children(s, d):
    """The folders of each folder by name."""
    return paging.ranked(tree.folder_tree(law(s, d), "folder").select("parent", "name", "n"), "parent", ["name"], "place").select("parent", "place", "name", "n")


@query("""with t as (select distinct doc_id, sha256(text) as h from documents where text is not null), f as (select h, count(*) as n from t group by h having count(*) > 1)
select row_number() over (order by 'family_' || substr(h, 1, 16), h) as place, 'family_' || substr(h, 1, 16) as family_id, n from f""")
def family_index(s, d):
    """Families in the order of their ids."""
    from actaloom.operators import families

    rows = families.families(table(s, d, "documents"), "doc_id", "text").withColumn("_all", F.lit(0))
    return paging.ranked(rows, "_all", ["family_id", "content_hash"], "place").select("place", "family_id", "n")


# --- review -------------------------------------------------------------------------------
_STATE = "case review_state when 'accepted' then 'accept' when 'rejected' then 'reject' end"
_VERDICTS = f"""o as (select assertion_id, {_STATE} as v, review_state, loaded_at, recorded_at, row_number() over (partition by assertion_id order by loaded_at, recorded_at, review_state nulls first) as up,
  row_number() over (partition by assertion_id order by loaded_at desc, recorded_at desc, review_state desc nulls last) as down, count(*) over (partition by assertion_id) as n from connections where assertion_id is not null),
v as (select assertion_id, max(v) filter (up = 1) as first, max(v) filter (down = 1 and n > 1) as second from o group by assertion_id)"""
_SUPPORT = """page as (select id, min(text) as text from raw_pages where text is not null group by id),
c as (select distinct assertion_id, substr(subject, 10) as id, evidence from connections where subject like 'document:%' and evidence <> '' and assertion_id is not null),
s as (select c.assertion_id, bool_or(contains(page.text, c.evidence)) as supported from c join page using (id) group by 1)"""
_GATE = f"""{_VERDICTS}, {_SUPPORT}, g as (select v.*, case when first is null or second is null then 'unreviewed' when first <> second then 'disputed' when first = 'accept' and coalesce(s.supported, false) then 'accepted' else 'rejected' end as gate from v left join s using (assertion_id))"""


def verdicts(s: SparkSession, d: str) -> DataFrame:
    return review.reviewers(edges(s, d), "assertion_id", "review_state", ["loaded_at", "recorded_at"])


def support(s: SparkSession, d: str) -> DataFrame:
    """(assertion_id, supported): whether the page of the subject holds the evidence itself."""
    claims = edges(s, d).filter("subject like 'document:%' and evidence <> '' and assertion_id is not null").select("assertion_id", F.expr("substr(subject, 10)").alias("id"), "evidence")
    return texts.supported(claims, "id", "evidence", pages(s, d), "id", "text").groupBy("assertion_id").agg(F.max("supported").alias("supported"))


@query(f"with {_VERDICTS} select * from v")
def reviewer_verdicts(s, d):
    """The verdicts of an assertion's first and last record."""
    return verdicts(s, d)


def gated(s: SparkSession, d: str) -> DataFrame:
    rows = verdicts(s, d).join(support(s, d), "assertion_id", "left")
    return rows.select("assertion_id", "first", "second", review.gate(F.col("first"), F.col("second"), F.col("supported")).alias("gate"))


@query(f"with {_GATE} select assertion_id, first, second, gate from g")
def review_gate(s, d):
    return gated(s, d)


@query(f"with {_VERDICTS} select count(*) as reviewed, count(*) filter (first = second) as agreed, round(100.0 * count(*) filter (first = second) / count(*), 1) as percent from v where first is not null and second is not null")
def agreement_rate(s, d):
    return review.agreement(verdicts(s, d), "first", "second")


_LATEST = "now as (select * from (select assertion_id, predicate, review_state, method, row_number() over (partition by assertion_id order by loaded_at desc, recorded_at desc, predicate desc, review_state desc nulls last, method desc) as rn from connections where assertion_id is not null) where rn = 1)"
_SAMPLE = f"""{_LATEST}, h as (select assertion_id, predicate, sha256('pilot-precision-v1:' || assertion_id) as digest from now where review_state = 'accepted' and predicate is not null),
k as (select *, row_number() over (partition by predicate order by digest) as rn from h), picked as (select assertion_id, predicate from k order by rn > 3, digest limit 50)"""


def current(s: SparkSession, d: str) -> DataFrame:
    rows = edges(s, d).filter("assertion_id is not null").select("assertion_id", "predicate", "review_state", "method", "loaded_at", "recorded_at")
    return graph.latest(rows, "assertion_id", ["loaded_at", "recorded_at"])


def checked(s: SparkSession, d: str) -> DataFrame:
    return sampling.precision_sample(current(s, d).filter("review_state = 'accepted'"), 50)


@query(f"with {_SAMPLE}, {_SUPPORT} select count(*) as sample, count(*) filter (coalesce(s.supported, false)) as correct, round(100.0 * count(*) filter (coalesce(s.supported, false)) / count(*), 1) as percent from picked left join s using (assertion_id)")
def precision_metric(s, d):
    """Precision over a sample of accepted assertions: correct is what the page itself supports."""
    return review.precision(checked(s, d), support(s, d), "assertion_id", "supported")


@query(f"with {_LATEST} select count(*) as candidates, count(distinct predicate) as predicates, count(*) filter (review_state = 'accepted') as accepted, count(*) filter (coalesce(review_state, '') <> 'accepted') as queue, count(*) filter (method = 'regex') as by_regex from now")
def pilot_report(s, d):
    yes = F.col("review_state") == "accepted"
    return current(s, d).agg(F.count(F.lit(1)).alias("candidates"), F.count_distinct("predicate").alias("predicates"), F.count_if(yes).alias("accepted"), F.count_if(~F.coalesce(yes, F.lit(False))).alias("queue"), F.count_if(F.col("method") == "regex").alias("by_regex"))


@query(f"""with {_GATE}, {_SAMPLE}
select 'predicates' as gate, count(distinct predicate) >= 10 as ok from now union all select 'evidence', count(*) = 0 from now join s using (assertion_id) where now.review_state = 'accepted' and not s.supported
union all select 'agreement', coalesce(sum(cast(first = second as int)) >= 0.8 * count(*), false) from v where first is not null and second is not null
union all select 'precision', coalesce(sum(cast(coalesce(s.supported, false) as int)) >= 0.9 * count(*), false) from picked left join s using (assertion_id)
union all select 'disputed', coalesce(sum(cast(gate = 'disputed' as int)) <= 0.2 * count(*), false) from g where gate <> 'unreviewed'
union all select 'parity', not exists (select 1 from law_catalog where id is not null and id not in (select id from raw_pages where id is not null))""")
def quality_gates(s, d):
    """The gates of a pilot, each a row."""
    now, held, both = current(s, d), support(s, d), verdicts(s, d).filter("first is not null and second is not null")
    share = lambda good, least: F.coalesce(F.sum(good.cast("int")) >= least * F.count(F.lit(1)), F.lit(False)).alias("ok")
    lost = law(s, d).filter("id is not null").select("id").distinct().join(pages(s, d).select("id"), "id", "left_anti")
    gates = {
        "predicates": now.agg((F.count_distinct("predicate") >= 10).alias("ok")),
        "evidence": now.filter("review_state = 'accepted'").join(held.filter("not supported"), "assertion_id").agg((F.count(F.lit(1)) == 0).alias("ok")),
        "agreement": both.agg(share(F.col("first") == F.col("second"), 0.8)),
        "precision": checked(s, d).join(held, "assertion_id", "left").agg(share(F.coalesce("supported", F.lit(False)), 0.9)),
        "disputed": gated(s, d).filter("gate <> 'unreviewed'").agg(F.coalesce(F.sum((F.col("gate") == "disputed").cast("int")) <= 0.2 * F.count(F.lit(1)), F.lit(False)).alias("ok")),
        "parity": lost.agg((F.count(F.lit(1)) == 0).alias("ok")),
    }
    out = None
    for name, df in gates.items():
        one = df.select(F.lit(name).alias("gate"), "ok")
        out = one if out is None else out.unionAll(one)
    return out


@query(f"""with {_SUPPORT}, {_TITLES}, t as (select c.assertion_id, bool_or(contains(title.title, c.evidence)) as in_title from c join title using (id) where title.title is not null group by 1)
select c.assertion_id, coalesce(bool_or(t.in_title), false) and not coalesce(bool_or(s.supported), false) as summary_only from c left join s using (assertion_id) left join t using (assertion_id) group by 1""")
def summary_only(s, d):
    """Claims that a record's short form (its title) alone supports; they never become hard edges."""
    claims = edges(s, d).filter("subject like 'document:%' and evidence <> '' and assertion_id is not null").select("assertion_id", F.expr("substr(subject, 10)").alias("id"), "evidence").distinct()
    short = claims.join(graph.titles(law(s, d)), "id").groupBy("assertion_id").agg(F.max(F.col("title").contains(F.col("evidence"))).alias("in_title"))
    rows = claims.select("assertion_id").distinct().join(support(s, d), "assertion_id", "left").join(short, "assertion_id", "left")
    return review.hard_edges(rows, "supported", "in_title").select("assertion_id", "summary_only")


@query("""with a as (select distinct substr(subject, 10) as id from connections where subject like 'document:%' and review_state = 'accepted'), i as (select distinct id from law_catalog where id is not null), p as (select id from raw_pages where id is not null union select id from i)
select id, case when id in (select id from a) then 'graph-reviewed' when id in (select id from i) then 'imported-unverified' else 'manual-unverified' end as state, 'unverified' as verification from p""")
def enrichment_states(s, d):
    """The state of every page; acceptance of an edge never raises `verification`."""
    flag = lambda df, name: df.filter("id is not null").select("id").distinct().withColumn(name, F.lit(True))
    accepted = edges(s, d).filter("subject like 'document:%' and review_state = 'accepted'").select(F.expr("substr(subject, 10)").alias("id"))
    every = pages(s, d).select("id").union(law(s, d).select("id")).filter("id is not null").distinct()
    rows = every.join(flag(law(s, d), "imported"), "id", "left").join(flag(accepted, "accepted"), "id", "left")
    return rows.select("id", review.enrichment_state(F.coalesce("imported", F.lit(False)), F.coalesce("accepted", F.lit(False))).alias("state"), F.lit("unverified").alias("verification"))
