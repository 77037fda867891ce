"""Lines repeated across the documents of one site.

Method: lines are parsed into templates by token trees of fixed depth with wildcard slots;
the trees of all partitions are merged, and templates that cover many documents of a site
are removed. The tokens of a line are the four-letter pieces of its letters, lower-cased and
joined, so that numbers, signs, case and spacing play no part. The levels of the tree are
the number of letters and five tokens from the first to the last; a leaf holds templates,
in which a slot whose tokens differ is a wildcard.

Steps, each over all rows:
1. one narrow pass counts, for each site, the pages of every node of the tree; nodes below
   the coverage are cut off, for a template cannot cover more pages than its node;
2. a second pass keeps the lines under the remaining nodes, and each partition grows its
   own leaves; the leaves of all partitions are merged node by node;
3. templates that cover enough pages of a site stay, and an exact check on the joined
   letters decides which of their lines are repeated enough. The templates themselves, with
   wildcards where a site's lines differ, are the result of site_templates.

At least a share of a site's pages must pass a node, so at most (lines a page / share) nodes
of a site remain; they are broadcast while they are fewer than `MAX_NODES`, else joined.

Defined cases: null, blank and repeated pages, lines without letters, rows without a site
or page key are no cases; of several texts of one page the least counts; a page of two sites counts for
both; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from actaloom.operators.texts import one_text
from actaloom.session import spread, stored

#: Least pages and least share of a site's pages.
PAGES, SHARE = 10, 0.08
#: Share of equal slots for a line to join a template.
SIMILAR = 0.6
MAX_NODES = 2_000_000
TOKEN = 4
GAPS = re.compile(r"[^\w\n]+|[\d_]+")


def line_letters(text: str) -> list[str]:
    """For each line its letters, lower-cased and joined."""
    return [x if x.isalpha() or not x else "".join(filter(str.isalpha, x)) for x in GAPS.sub("", text).lower().split("\n")]


def node(letters: str) -> int:
    """The leaf of the tree: number of letters, first and last token and three between."""
    n = len(letters)
    a, b, c = n >> 2, n >> 1, n * 3 >> 2
    return xxhash.xxh3_64_intdigest(f"{n} {letters[:TOKEN]} {letters[a : a + TOKEN]} {letters[b : b + TOKEN]} {letters[c : c + TOKEN]} {letters[-TOKEN:]}") - (1 << 63)


def tokens(letters: str) -> list[str]:
    return [letters[i : i + TOKEN] for i in range(0, len(letters), TOKEN)]


def fits(template: list[str], line: list[str]) -> bool:
    """Wildcards ("") fit anything, but only fixed slots count as equal."""
    return sum(x == y for x, y in zip(template, line)) >= SIMILAR * len(line)


def grow(leaf: list[list[str]], line: list[str]) -> None:
    """Puts a line or another leaf's template into a leaf."""
    for template in leaf:
        if fits(template, line):
            for k, (x, y) in enumerate(zip(template, line)):
                if x != y:
                    template[k] = ""
            return
    leaf.append(list(line))


def page_nodes(pages: DataFrame, rel: str, text: str) -> DataFrame:
    """(rel, nodes): the distinct nodes of each page that is not blank."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, found = [], []
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if k is not None and t is not None and t.strip():
                    keys.append(k)
                    found.append(list({node(x) for x in line_letters(t) if x}))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(found, pa.list_(pa.int64()))], names=["rel", "nodes"])

    return spread(pages.select(F.col(rel).cast("string"), F.col(text).cast("string"))).mapInArrow(run, "rel string, nodes array<bigint>")


def kept_lines(pages: DataFrame, rel: str, text: str, nodes: np.ndarray | None) -> DataFrame:
    """(rel, line_no, node, letters) of the lines under the given nodes, or of all lines."""
    shared = None if nodes is None else pages.sparkSession.sparkContext.broadcast(np.sort(nodes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = None if shared is None else set(shared.value.tolist())
        for b in batches:
            out: list[tuple[str, int, int, str]] = []
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if k is None or t is None or not t.strip():
                    continue
                for n, x in enumerate(line_letters(t), 1):
                    if x and (keep is None or node(x) in keep):
                        out.append((k, n, node(x), x))
            cols = list(zip(*out)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, f) for c, f in zip(cols, (pa.string(), pa.int64(), pa.int64(), pa.string()))], names=["rel", "line_no", "node", "letters"])

    return spread(pages.select(F.col(rel).cast("string"), F.col(text).cast("string"))).mapInArrow(run, "rel string, line_no bigint, node bigint, letters string")


def merged_templates(lines: DataFrame) -> DataFrame:
    """(node, templates): the merged leaves; a template is its slots joined by "|"."""

    def local(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tree: dict[int, list[list[str]]] = {}
        for b in batches:
            for n, x in zip(b["node"], b["letters"]):
                grow(tree.setdefault(n, []), tokens(x))
        yield pd.DataFrame([(n, "|".join(t)) for n, leaf in tree.items() for t in leaf], columns=["node", "template"])

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        leaf: list[list[str]] = []
        for t in sorted(pdf["template"], key=lambda t: (t.count("||"), t)):
            grow(leaf, t.split("|"))
        return pd.DataFrame({"node": [pdf["node"].iloc[0]], "templates": [["|".join(t) for t in leaf]]})

    found = lines.select("node", "letters").mapInPandas(local, "node bigint, template string").distinct()
    return found.groupBy("node").applyInPandas(merge, "node bigint, templates array<string>")


def template_hits(catalog: DataFrame, site: str, rel: str, pages: DataFrame, page_rel: str, text: str, least_pages: int, least_share: float) -> tuple[DataFrame, DataFrame]:
    """(hits, leaves). hits: (site, rel, line_no, node, template, letters, least), the lines of each site under nodes that cover enough of its pages; leaves: (node, templates)."""
    name, key = F.col(site).cast("string"), F.col(rel).cast("string")
    owners = catalog.select(name.alias("site"), key.alias("rel")).filter(F.col("site").rlike(r"[^\s\p{Z}]") & F.col("rel").isNotNull()).distinct()
    pages = one_text(pages, page_rel, text)
    nodes = page_nodes(pages, "rel", "text").dropDuplicates(["rel"])
    of_site = stored(owners.join(nodes, "rel").select("site", "rel", "nodes"), "site-nodes")
    sizes = of_site.groupBy("site").agg(F.count(F.lit(1)).alias("pages")).withColumn("least", F.greatest(F.lit(float(least_pages)), F.col("pages") * F.lit(float(least_share))))
    covered = of_site.select("site", F.explode("nodes").alias("node")).groupBy("site", "node").agg(F.count(F.lit(1)).alias("n"))
    left = stored(covered.join(sizes.hint("shuffle_hash"), "site").filter(F.col("n") >= F.col("least")).select("site", "node", "least"), "nodes")
    distinct = left.select("node").distinct()
    if (few := distinct.count()) <= MAX_NODES:
        lines = kept_lines(pages, "rel", "text", distinct.toPandas()["node"].to_numpy(np.int64) if few else np.array([], np.int64))
    else:
        lines = kept_lines(pages, "rel", "text", None).join(distinct, "node", "left_semi")
    lines = stored(lines.dropDuplicates(["rel", "line_no"]), "lines")

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            which = []
            for x, templates in zip(b["letters"], b["templates"]):
                t = tokens(x)
                which.append(next((k for k, s in enumerate(templates) if fits_merged(s.split("|"), t)), -1))
            yield pd.DataFrame({"node": b["node"], "letters": b["letters"], "template": which})

    leaves = stored(merged_templates(lines), "templates")
    keys = lines.select("node", "letters").distinct().join(leaves, "node")
    assigned = keys.mapInPandas(assign, "node bigint, letters string, template int")
    hits = of_site.select("site", "rel").join(lines, "rel").join(left, ["site", "node"]).join(assigned, ["node", "letters"])
    return stored(hits.select("site", "rel", "line_no", "node", "template", "letters", "least"), "hits"), leaves


def repeated_lines(catalog: DataFrame, site: str, rel: str, pages: DataFrame, page_rel: str, text: str, least_pages: int = PAGES, least_share: float = SHARE) -> DataFrame:
    """(rel_raw, line_no): every line that its site repeats on enough pages."""
    hits, _ = template_hits(catalog, site, rel, pages, page_rel, text, least_pages, least_share)
    templates = hits.groupBy("site", "node", "template", "least").agg(F.count_distinct("rel").alias("n")).filter(F.col("n") >= F.col("least")).select("site", "node", "template")
    covering = hits.join(templates, ["site", "node", "template"], "left_semi")
    exact = covering.groupBy("site", "letters", "least").agg(F.count_distinct("rel").alias("n")).filter(F.col("n") >= F.col("least")).select("site", "letters")
    return covering.join(exact, ["site", "letters"], "left_semi").select(F.col("rel").alias("rel_raw"), "line_no").distinct()


def site_templates(catalog: DataFrame, site: str, rel: str, pages: DataFrame, page_rel: str, text: str, least_pages: int = PAGES, least_share: float = SHARE) -> DataFrame:
    """(website, template, pages, forms): the templates that cover enough pages of a site, "*" for each wildcard.

    forms is the number of different lines of the site that the template stands for; none of
    them needs to be frequent itself, which is what wildcards find beyond repeated_lines.
    """
    hits, leaves = template_hits(catalog, site, rel, pages, page_rel, text, least_pages, least_share)
    found = hits.filter("template >= 0").groupBy("site", "node", "template", "least").agg(F.count_distinct("rel").alias("pages"), F.count_distinct("letters").alias("forms")).filter(F.col("pages") >= F.col("least"))
    slots = F.split(F.col("templates")[F.col("template")], r"\|", -1)
    shown = F.array_join(F.transform(slots, lambda x: F.when(x == "", "*").otherwise(x)), "")
    return found.join(leaves, "node").select(F.col("site").alias("website"), shown.alias("template"), "pages", "forms")


def fits_merged(template: list[str], line: list[str]) -> bool:
    """A line belongs to a merged template if every fixed slot agrees."""
    return len(template) == len(line) and all(not x or x == y for x, y in zip(template, line))


def without_lines(pages: DataFrame, page_rel: str, text: str, found: DataFrame) -> DataFrame:
    """(rel_raw, text): each page once, its found lines left out; pages without one stay as they are."""
    drop = found.groupBy("rel_raw").agg(F.collect_list("line_no").alias("_drop"))
    rows = one_text(pages, page_rel, text).withColumnRenamed("rel", "rel_raw").dropDuplicates(["rel_raw"])
    kept = F.filter(F.split("text", "\n"), lambda x, i: ~F.array_contains("_drop", (i + 1).cast("bigint")))
    return rows.join(drop, "rel_raw", "left").select("rel_raw", F.when(F.col("_drop").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")).alias("text"))
