"""Assertion graph: edges, nodes, hubs, neighbourhoods, review."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from actaloom.functions.identity import assertion_id
from actaloom.functions.text import predicate_label, slugify
from actaloom.operators import families
from actaloom.operators.paging import ranked
from actaloom.session import cut

#: Node groups of the payload's top level.
GROUPS = ("source", "topic", "folder", "website", "year")


def latest(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last row of each key by `order`, by aggregation (no sort of a hot key's rows)."""
    rest = [c for c in df.columns if c != key]
    best = df.groupBy(key).agg(F.max(F.struct(*order, F.struct(*rest).alias("_row"))).alias("_m"))
    return best.select(key, *(F.col(f"_m._row.{c}").alias(c) for c in rest))


def document(key: str) -> Column:
    return F.concat(F.lit("document:"), F.col(key).cast("string"))


def edge(rows: DataFrame, subject: Column, predicate: str, target: Column) -> DataFrame:
    return rows.select(subject.alias("subject"), F.lit(predicate).alias("predicate"), target.alias("object"))


def metadata_edges(catalog: DataFrame, taxonomy: DataFrame, pages: DataFrame) -> DataFrame:
    """Edges that follow from the tables alone, with their ids: about_topic, published_by, about_sector, exact_duplicate_of.

    taxonomy: (topic, sector), a reference list. pages: (id, text); a document is a duplicate
    of the least document of the same text.
    """
    rows = catalog.filter(F.col("id").isNotNull()).select("id", "website", "topic").distinct()
    filled = lambda c: rows.filter(F.coalesce(c, F.lit("")) != "")
    topic = edge(filled("topic"), document("id"), "about_topic", F.concat(F.lit("topic:"), slugify(F.col("topic"))))
    site = edge(filled("website"), document("id"), "published_by", F.concat(F.lit("organization:"), slugify(F.col("website"))))
    sector = edge(filled("topic").join(taxonomy.filter("sector <> ''").select("topic", "sector"), "topic"), document("id"), "about_sector", F.concat(F.lit("sector:"), slugify(F.col("sector"))))
    same = families.duplicate_of(pages, "id", "text").filter(F.col("id") != F.col("representative"))
    copy = edge(same, document("id"), "exact_duplicate_of", document("representative"))
    return topic.union(site).union(sector).union(copy).distinct().withColumn("assertion_id", assertion_id(F.col("subject"), F.col("predicate"), F.col("object")))


def titles(catalog: DataFrame) -> DataFrame:
    """(id, title): the least title of each document."""
    return catalog.filter("id is not null").groupBy("id").agg(F.min("title").alias("title"))


def hub_block(edges: DataFrame, catalog: DataFrame) -> DataFrame:
    """(object, place, id, title, label): the documents that point to each hub, by id; documents outside the catalog have no title.

    A hub of a third of all edges is ranked by many tasks, see paging.ranked.
    """
    rows = edges.filter("subject like 'document:%' and object is not null and predicate is not null").select("object", F.expr("substr(subject, 10)").alias("id"), "predicate").distinct()
    placed = ranked(rows, "object", ["id", "predicate"], "place")
    return placed.join(titles(catalog), "id", "left").select("object", "place", "id", "title", predicate_label(F.col("predicate")).alias("label"))


def source_block(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """(subject, place, label, object, shown): what each document points to, by predicate and object.

    labels: (object, label), names of hubs; hubs without one are shown by the rest of their key.
    """
    rows = edges.filter("subject like 'document:%' and object is not null and predicate is not null").select("subject", "predicate", "object").distinct()
    placed = ranked(rows, "subject", ["predicate", "object"], "place")
    shown = F.coalesce("label", F.regexp_replace("object", "^[^:]*:", ""))
    return placed.join(labels, "object", "left").select("subject", "place", predicate_label(F.col("predicate")).alias("label"), "object", shown.alias("shown"))


def nodes(edges: DataFrame) -> DataFrame:
    """(key, type, degree_in, degree_out) of all subjects and objects."""
    ends = edges.select(F.col("subject").alias("key"), F.lit(0).alias("i"), F.lit(1).alias("o")).unionAll(edges.select(F.col("object"), F.lit(1), F.lit(0)))
    return ends.filter(F.col("key").isNotNull()).groupBy("key").agg(F.sum("i").alias("degree_in"), F.sum("o").alias("degree_out")).withColumn("type", F.split("key", ":")[0])


def hubs(edges: DataFrame) -> DataFrame:
    """(object, n): inbound edges of each hub; the hot object is pre-aggregated before the shuffle."""
    return edges.filter(F.col("object").isNotNull()).groupBy("object").agg(F.count(F.lit(1)).alias("n"))


def keywords(catalog: DataFrame) -> DataFrame:
    """(key, label, n): topics as keywords keyed by topic:slug; categories are none."""
    rows = catalog.filter(F.coalesce("topic", F.lit("")) != "").select("id", F.col("topic").alias("label")).distinct()
    return rows.groupBy(F.concat(F.lit("topic:"), slugify(F.col("label"))).alias("key")).agg(F.min("label").alias("label"), F.count(F.lit(1)).alias("n"))


def payload_nodes(catalog: DataFrame, edges: DataFrame | None = None) -> DataFrame:
    """(node, type, n): the root with the number of documents, the groups, topic nodes, and the ends of the edges of the catalog's documents.

    Topics of the catalog count their documents, other ends their edges.
    """
    docs = catalog.agg(F.count(F.lit(1)).alias("n")).select(F.lit("root").alias("node"), F.lit("root").alias("type"), "n")
    spark = catalog.sparkSession
    groups = spark.createDataFrame([(f"group:{g}", "group") for g in GROUPS], "node string, type string").withColumn("n", F.lit(0).cast("bigint"))
    topics = keywords(catalog).select(F.col("key").alias("node"), F.lit("topic").alias("type"), "n")
    out = docs.unionByName(groups).unionByName(topics)
    if edges is None:
        return out
    links = payload_links(catalog, edges)
    ends = links.select(F.col("source").alias("node")).unionAll(links.select("target")).groupBy("node").agg(F.count(F.lit(1)).alias("n"))
    return out.unionByName(ends.join(topics.select("node"), "node", "left_anti").select("node", F.split("node", ":")[0].alias("type"), "n"))


def payload_links(catalog: DataFrame, edges: DataFrame) -> DataFrame:
    """(source, target, label): distinct edges of the catalog's documents."""
    own = catalog.filter("id is not null").select(document("id").alias("subject")).distinct()
    rows = edges.filter("object is not null and predicate is not null").select("subject", "object", "predicate").distinct().join(own, "subject", "left_semi")
    return rows.select(F.col("subject").alias("source"), F.col("object").alias("target"), predicate_label(F.col("predicate")).alias("label"))


def khop(edges: DataFrame, start: DataFrame, hops: int) -> DataFrame:
    """(node, hop): nodes reached from start (node), with the least number of edges in either direction."""
    both = edges.select(F.col("subject").alias("a"), F.col("object").alias("b")).union(edges.select("object", "subject")).distinct()
    seen = start.select("node").distinct().withColumn("hop", F.lit(0))
    edge = seen
    for k in range(1, hops + 1):
        edge = edge.join(both, F.col("node") == F.col("a")).select(F.col("b").alias("node")).distinct().join(seen.select("node"), "node", "left_anti").withColumn("hop", F.lit(k))
        seen = seen.unionByName(edge)
    return seen


def label_clashes(df: DataFrame, label: str, key: str) -> DataFrame:
    """(label, keys): labels, case aside, that stand for more than one key."""
    rows = df.filter(F.col(label).isNotNull() & F.col(key).isNotNull()).select(F.lower(label).alias("label"), F.col(key).alias("k")).distinct()
    return rows.groupBy("label").agg(F.count(F.lit(1)).alias("keys")).filter("keys > 1")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): connected components of the edges, named by their least node.

    Large-star/small-star label passing with pointer jumping: each round joins the labels
    of neighbours and of labels; the lineage is cut after every round, and the rounds grow
    with the logarithm of the longest path.
    """
    both = cut(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).union(edges.select(F.col(b), F.col(a))).distinct())
    label = cut(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("label")))
    while True:
        near = both.join(label.select(F.col("node").alias("v"), "label"), "v").groupBy("u").agg(F.min("label").alias("near"))
        step = label.join(near.withColumnRenamed("u", "node"), "node").select("node", F.least("label", "near").alias("label"), F.col("label").alias("old"))
        jump = step.join(label.select(F.col("node").alias("label"), F.col("label").alias("up")), "label", "left").select("node", F.least("label", F.coalesce("up", "label")).alias("label"), "old")
        jump = cut(jump)
        label = jump.select("node", "label")
        if jump.filter(F.col("label") != F.col("old")).isEmpty():
            return label.withColumnRenamed("label", "component")
