from __future__ import annotations

import json

from pyspark.sql import functions as F

from actaloom.functions import identity as I
from actaloom.functions import markdown
from actaloom.functions import text as T
from actaloom.sources import readers, sinks


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).first()["y"]


def test_section(spark):
    page = "---\na: 1\n---\n# T\n## Summary\n\nshort \n## Full text\n\nlong\n"
    assert one(spark, page, lambda x: T.section(x, "Summary", "Full text")) == "short"
    assert one(spark, page, lambda x: T.section(x, "Full text", "None")) == "long"
    assert one(spark, page, lambda x: T.section(x, "Absent", "None")) == ""
    assert one(spark, page, lambda x: T.section(x, "Full", "None")) == "text\n\nlong"  # a prefix of a name matches
    assert one(spark, "no sections", T.full_text) == "no sections"


def test_scalars(spark):
    assert one(spark, "Absolvição  do Pedido!", T.slugify) == "absolvicao-do-pedido"
    assert one(spark, "!!", T.slugify) == ""
    assert one(spark, "raw\\pdfs\\A b\\c(é).pdf", T.pdf_url) == "/pdfs/A%20b/c(%C3%A9).pdf"
    assert one(spark, "a<b>&", T.html_escape) == "a&lt;b&gt;&amp;"
    assert one(spark, "31/12/2020", T.iso_date) == "2020-12-31"
    assert one(spark, "31.02.2020", T.iso_date) is None
    assert one(spark, "DL 24/96", T.canonical_citation) == "instrument:pt:decreto-lei:24/1996"
    assert one(spark, "Regulamento (CE) n.º 261/2004", T.canonical_citation) == "instrument:eu:regulamento:261/2004"
    assert one(spark, "a [[x/y|L]] b [[z]]", T.wikilinks) == ["x/y", "z"]
    assert one(spark, "a.b.pdf", I.stem) == "a.b"
    assert one(spark, "case:pt:5576/2024.9tbx", I.hub_slug) == "pt-5576-2024-9tbx"
    assert one(spark, "a\ngenerated_fingerprint: x\nb", I.fingerprint) == one(spark, "a\ngenerated_fingerprint: yy\nb", I.fingerprint)
    assert one(spark, None, lambda x: T.first_filled(x, F.lit(""))) == "unknown"


def test_managed_block(spark):
    page = f"head\n{sinks.BEGIN}\nold\n{sinks.END}\ntail"
    assert one(spark, page, lambda x: sinks.replace_block(x, F.lit("new"))) == f"head\n{sinks.BEGIN}\nnew\n{sinks.END}\ntail"
    assert one(spark, "head", lambda x: sinks.replace_block(x, F.lit("new"))).endswith(sinks.END)


def test_readers_and_sinks(spark, tmp_path):
    page = '---\nid: "law_1"\nwebsite: "W"\nyear: 2020\n---\n# t\n## Full text\n\nbody\n'
    (tmp_path / "raw/W/2020").mkdir(parents=True)
    (tmp_path / "raw/W/2020/a.md").write_text(page)
    got = readers.read_pages(spark, str(tmp_path / "raw")).first()
    assert (got["id"], got["website"], got["year"], got["text"]) == ("law_1", "W", "2020", "body")
    sizes = readers.file_sizes(spark, str(tmp_path / "raw")).first()
    assert (sizes["path"], sizes["size"]) == ("W/2020/a.md", len(page))
    (tmp_path / "pdfs/W/2021/sub").mkdir(parents=True)
    (tmp_path / "pdfs/W/2021/sub/C.pdf").write_bytes(b"%PDF-test")
    row = readers.read_pdfs(spark, str(tmp_path / "pdfs"), lambda b: b.decode()).first()
    assert (row["website"], row["year"], row["title"], row["text"]) == ("W", "2021", "C", "%PDF-test")
    (tmp_path / "c.csv").write_text('id,title\n1,"a ""b""\nc"\n')
    from pyspark.sql import types as ST

    schema = ST.StructType([ST.StructField("id", ST.StringType()), ST.StructField("title", ST.StringType())])
    assert readers.read_csv(spark, str(tmp_path / "c.csv"), schema).first()["title"] == 'a "b"\nc'
    docs = spark.createDataFrame([("1", "W", "2020"), ("2", "W", "2021")], "id string, website string, year string")
    sinks.write_raw_store(docs, str(tmp_path / "store"))
    sinks.write_raw_store(docs, str(tmp_path / "store"))
    assert spark.read.parquet(str(tmp_path / "store")).count() == 2
    sinks.write_json_lines(docs, str(tmp_path / "j"))
    assert readers.read_jsonl(spark, str(tmp_path / "j"), readers.CATALOG).filter("website = 'W'").count() == 2
    sinks.write_json_document(docs, str(tmp_path / "doc"))
    whole = "".join(p.read_text() for p in sorted((tmp_path / "doc").glob("part-*")))
    assert [d["id"] for d in json.loads(whole)["documents"]] == ["1", "2"]
    sinks.write_json_document(docs.limit(0), str(tmp_path / "none"))
    assert json.loads("".join(p.read_text() for p in sorted((tmp_path / "none").glob("part-*")))) == {"documents": []}
    manifest = spark.createDataFrame([("W/2020/a.md",)], "rel string")
    assert sinks.copy_files(manifest, str(tmp_path / "raw"), str(tmp_path / "public")) == 1
    assert (tmp_path / "public/W/2020/a.md").read_text() == page
    assert readers.input_fingerprint(spark, str(tmp_path / "c.csv")).first()["size"] == 23


def test_pdf_import_is_idempotent_and_protects(spark, tmp_path):
    (tmp_path / "pdfs/Fornecidos/2026").mkdir(parents=True)
    (tmp_path / "pdfs/Fornecidos/2026/Contrato.pdf").write_bytes(b"%PDF-test")
    for text, protected in (("Primeira", 0), ("Primeira", 0), ("Outra", 1)):
        rows, kept = readers.import_pdfs(spark, str(tmp_path / "pdfs"), str(tmp_path / "store"), lambda _, text=text: text)
        assert [(r["website"], r["year"], r["text"]) for r in rows.collect()] == [("Fornecidos", "2026", "Primeira")] and kept.count() == protected


def test_frontmatter_lists_and_blocks(spark):
    page = '---\nid: "x"\ntags: ["a b", "c"]\naliases: [d, \'e f\']\nsectors: []\n---\nbody'
    assert one(spark, page, lambda x: T.frontmatter_list(x, "tags")) == ["a b", "c"]
    assert one(spark, page, lambda x: T.frontmatter_list(x, "aliases")) == ["d", "e f"]
    assert one(spark, page, lambda x: T.frontmatter_list(x, "sectors")) == one(spark, page, lambda x: T.frontmatter_list(x, "absent")) == []
    assert one(spark, "---\nno end", T.strip_frontmatter) == "---\nno end" and one(spark, page, T.strip_frontmatter) == "body"
    assert one(spark, "---\r\na: 1\r\n---\r\nx\r\n", T.strip_frontmatter) == "x\r\n"
    first = one(spark, page, lambda x: sinks.replace_head_block(x, F.lit("state: r")))
    assert first == page.replace("\n---\nbody", f"\n{sinks.HEAD_BEGIN}\nstate: r\n{sinks.HEAD_END}\n---\nbody")
    assert one(spark, first, lambda x: sinks.replace_head_block(x, F.lit("state: s"))) == first.replace("state: r", "state: s")
    assert one(spark, "plain", lambda x: sinks.replace_head_block(x, F.lit("s"))) == "plain"


def test_provisions(spark):
    forms = {
        "provision:pt:codigo-civil:402": "provision:pt:codigo-civil:art-402", "pt-codigo-civil:art-342-1": "pt-codigo-civil:art-342-n1", "pt:lei:23/1996:art-10-n1": "pt:lei:23/1996:art-10-n1",
        "pt:lei:24/1996:art-9b-12-n1": "pt:lei:24/1996:art-9b-12-n1", "topic:gas": "topic:gas", "pt-lei-23-1996-art-10": "pt-lei-23-1996:art-10",
    }
    got = {k: one(spark, k, T.canonical_provision) for k in forms}
    assert got == forms


def test_markdown():
    text = "# A <b>\n\nTexto *um*\ne **dois**.\n\n- a\n  - b\n  - c `x`\n- d\n  segue\n\n3. x\n4. y\n\n---\n\n| p | q |\n|---|:-:|\n| 1 | 2 |\n| 3 |\n\n> cita\n> mais\n\n```\n<i>\n```\nhttps://a.test/x"
    assert markdown.render(text) == "\n".join([
        "<h1>A &lt;b&gt;</h1>", "<p>Texto <em>um</em> e <strong>dois</strong>.</p>", "<ul><li>a<ul><li>b</li><li>c <code>x</code></li></ul></li><li>d segue</li></ul>", '<ol start="3"><li>x</li><li>y</li></ol>', "<hr>",
        "<table><thead><tr><th>p</th><th>q</th></tr></thead><tbody><tr><td>1</td><td>2</td></tr><tr><td>3</td><td></td></tr></tbody></table>", "<blockquote><p>cita mais</p></blockquote>", "<pre><code>&lt;i&gt;</code></pre>", '<p><a href="https://a.test/x">https://a.test/x</a></p>',
    ])
    assert markdown.render(None) is None and markdown.render("") == "" and markdown.render("1. a\n- b") == "<ol><li>a</li></ol><ul><li>b</li></ul>"
