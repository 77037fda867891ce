"""Markdown to HTML without raw HTML; the one scalar that needs Python (Arrow batches)."""

from __future__ import annotations

import html
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_INLINE = [
    (re.compile(r"\[([^\]]+)\]\((https?://[^)\s]+)\)"), r'<a href="\2">\1</a>'),
    (re.compile(r'(?<!["=>])\b(https?://[^\s<)]+)'), r'<a href="\1">\1</a>'),
    (re.compile(r"\*\*(.+?)\*\*"), r"<strong>\1</strong>"),
    (re.compile(r"(?<!\*)\*([^*\s][^*]*)\*(?!\*)"), r"<em>\1</em>"),
    (re.compile(r"`([^`]+)`"), r"<code>\1</code>"),
]


def inline(text: str) -> str:
    out = html.escape(text, quote=False)
    for pattern, to in _INLINE:
        out = pattern.sub(to, out)
    return out


ITEM = re.compile(r"( *)([-*+]|\d+[.)]) +(.*)")
RULE = re.compile(r" {0,3}([-*_])(?: *\1){2,} *$")


def cells(line: str) -> list[str]:
    return [c.strip() for c in line.strip().strip("|").split("|")]


def list_html(items: list[tuple[int, str, str]]) -> str:
    """Items (indent, mark, text) as lists; an item that is indented further than the one before lies in it."""
    out: list[str] = []
    stack: list[tuple[int, str]] = []
    for indent, mark, text in items:
        kind = "ol" if mark[0].isdigit() else "ul"
        while stack and indent < stack[-1][0]:
            out.append(f"</li></{stack.pop()[1]}>")
        if stack and indent < stack[-1][0] + 2 and kind == stack[-1][1]:
            out.append("</li>")
        else:
            if stack and indent < stack[-1][0] + 2:  # another kind of list at the same place
                out.append(f"</li></{stack.pop()[1]}>")
            number = int(re.match(r"\d+", mark).group()) if kind == "ol" else 1
            out.append(f'<{kind} start="{number}">' if number != 1 else f"<{kind}>")
            stack.append((indent, kind))
        out.append(f"<li>{inline(text)}")
    while stack:
        out.append(f"</li></{stack.pop()[1]}>")
    return "".join(out)


def table_html(rows: list[list[str]]) -> str:
    head, *body = rows
    line = lambda row, tag: "<tr>" + "".join(f"<{tag}>{inline(c)}</{tag}>" for c in row) + "</tr>"
    filled = ((row + [""] * len(head))[: len(head)] for row in body)
    return f"<table><thead>{line(head, 'th')}</thead><tbody>{''.join(line(row, 'td') for row in filled)}</tbody></table>"


def render(text: str | None) -> str | None:
    """Headings, nested and numbered lists, quotes, rules, tables, code fences and paragraphs; anything else is a paragraph. Null stays null."""
    if text is None:
        return None
    out: list[str] = []
    block: list[str] = []
    items: list[tuple[int, str, str]] = []
    rows: list[list[str]] = []
    kind = ""

    def close() -> None:
        nonlocal kind
        if items:
            out.append(list_html(items))
        elif rows:
            out.append(table_html(rows))
        elif kind == "quote":
            out.append(f"<blockquote><p>{inline(' '.join(block))}</p></blockquote>")
        elif kind == "code":
            out.append("<pre><code>" + html.escape("\n".join(block), quote=False) + "</code></pre>")
        elif block:
            out.append(f"<p>{inline(' '.join(block))}</p>")
        for held in (block, items, rows):
            held.clear()
        kind = ""

    lines = text.replace("\r\n", "\n").split("\n")
    for n, line in enumerate(lines):
        after = lines[n + 1] if n + 1 < len(lines) else ""
        if line.startswith("```"):
            was = kind
            close()
            kind = "" if was == "code" else "code"
        elif kind == "code":
            block.append(line)
        elif not line.strip():
            close()
        elif m := re.match(r"(#{1,6}) +(.*)", line):
            close()
            out.append(f"<h{len(m[1])}>{inline(m[2].strip())}</h{len(m[1])}>")
        elif RULE.match(line):
            close()
            out.append("<hr>")
        elif kind == "table":
            if "|" in line:
                if not re.fullmatch(r"[\s|:-]+", line):
                    rows.append(cells(line))
            else:
                close()
                kind = "p"
                block.append(line.strip())
        elif "|" in line and re.fullmatch(r"\s*\|?\s*:?-+:?\s*(?:\|\s*:?-+:?\s*)*\|?\s*", after) and "|" in after:
            close()
            kind = "table"
            rows.append(cells(line))
        elif m := ITEM.match(line):
            if kind != "list":
                close()
                kind = "list"
            items.append((len(m[1]), m[2], m[3].strip()))
        elif kind == "list" and line.startswith(" "):  # goes on with its item
            items[-1] = (*items[-1][:2], f"{items[-1][2]} {line.strip()}")
        else:
            now = "quote" if line.startswith(">") else "p"
            if now != kind:
                close()
                kind = now
            block.append(re.sub(r"^> ?", "", line).strip() if now == "quote" else line.strip())
    close()
    return "\n".join(out)


def to_html(x: Column) -> Column:
    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(render, na_action="ignore")

    return run(x)
