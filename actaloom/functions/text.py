"""Column functions on text; each takes and gives columns and stays inside the JVM."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


def _fold_pairs() -> tuple[str, str]:
    """Latin letters with marks and their plain letters, from Unicode's decompositions."""
    pairs = [(chr(c), b) for c in range(0xC0, 0x250) if (b := unicodedata.normalize("NFKD", chr(c))[0]) != chr(c) and b.isascii() and b.isalpha()]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


_MARKED, _PLAIN = _fold_pairs()


def fold_accents(x: Column) -> Column:
    """x without accents: composed Latin letters are replaced, combining marks dropped."""
    return F.regexp_replace(F.translate(x, _MARKED, _PLAIN), r"\p{M}", "")


def slugify(x: Column) -> Column:
    """Lower-case ASCII words joined by hyphens; "" if nothing is left."""
    return F.regexp_replace(F.regexp_replace(F.lower(fold_accents(x)), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def first_filled(*cols: Column, default: str = "unknown") -> Column:
    """The first column that is neither null nor empty, else the default."""
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in cols), F.lit(default))


def _lines(x: Column) -> Column:
    """The lines of a text; a carriage return at a line's end stays with it."""
    return F.split(x, "\n", -1)


def _fence(lines: Column) -> Column:
    """Number, from 1, of the line that closes a frontmatter block; 0 if the text does not begin with one."""
    marks = F.transform(lines, lambda s: F.regexp_replace(s, r"\r$", "") == "---")
    rest = F.array_position(F.slice(marks, 2, F.greatest(F.size(lines) - 1, F.lit(0))), True)
    return F.when(F.element_at(marks, 1) & (rest > 1) & (rest + 1 < F.size(lines)), rest + 1).otherwise(F.lit(0)).cast("int")


def strip_frontmatter(x: Column) -> Column:
    """The text after its frontmatter: a first line "---" up to the next such line, at least one line between."""
    lines = _lines(x)
    fence = _fence(lines)
    return F.when(fence == 0, x).otherwise(F.array_join(F.slice(lines, fence + 1, F.greatest(F.size(lines) - fence, F.lit(0))), "\n"))


def section(x: Column, name: str, following: str) -> Column:
    """The text between the first "## name" and the next "## following" (else the end), trimmed; "" if absent."""
    body = strip_frontmatter(x)
    start = F.instr(body, f"## {name}")
    rest = F.substr(body, start + F.lit(len(name) + 3), F.length(body))
    stop = F.instr(rest, f"## {following}")
    return F.when(start == 0, F.lit("")).otherwise(F.regexp_replace(F.when(stop > 0, F.substr(rest, F.lit(1), stop - 1)).otherwise(rest), r"^\s+|\s+$", ""))


def full_text(x: Column) -> Column:
    """Section "Full text", else the body."""
    return F.coalesce(F.nullif(section(x, "Full text", "\x00"), F.lit("")), strip_frontmatter(x))


def frontmatter_value(x: Column, key: str) -> Column:
    """The value of a frontmatter line, JSON quotes left out; "" if absent."""
    lines = _lines(x)
    head = F.transform(F.slice(lines, 2, F.greatest(_fence(lines) - 2, F.lit(0))), lambda s: F.regexp_replace(s, r"\r$", ""))
    found = F.get(F.filter(head, lambda s: s.startswith(f"{key}:")), F.lit(0))
    return F.coalesce(F.regexp_replace(F.regexp_replace(found, rf"^{key}: ?", ""), '^"|"$', ""), F.lit(""))


def frontmatter_list(x: Column, key: str) -> Column:
    """The values of a frontmatter line that holds a list, in JSON ["a", "b"] or bare [a, b]; empty if absent."""
    raw = F.trim(frontmatter_value(x, key))
    bare = F.transform(F.split(F.regexp_replace(raw, r"^\[|\]$", ""), ","), lambda v: F.regexp_replace(F.trim(v), "^[\"']|[\"']$", ""))
    return F.when(~raw.startswith("["), F.array().cast("array<string>")).otherwise(F.coalesce(F.from_json(raw, "array<string>"), F.filter(bare, lambda v: v != "")))


def html_escape(x: Column) -> Column:
    return F.replace(F.replace(F.replace(x, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def encode_component(x: Column) -> Column:
    """Percent-encoding of one path segment; marks that stay bare in a URI component are put back."""
    out = F.replace(F.url_encode(x), F.lit("+"), F.lit("%20"))
    for code, sign in (("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        out = F.replace(out, F.lit(code), F.lit(sign))
    return out


#: Folder of the pdf files, which their public address leaves out. Fixed value.
PDF_ROOT = "raw/pdfs/"


def pdf_url(path: Column) -> Column:
    """The public address of a pdf path: root folder left out, separators unified, segments encoded."""
    unified = F.replace(path, F.lit("\\"), F.lit("/"))
    rest = F.when(F.startswith(unified, F.lit(PDF_ROOT)), F.substr(unified, F.lit(len(PDF_ROOT) + 1))).otherwise(unified)
    return F.concat(F.lit("/pdfs/"), F.array_join(F.transform(F.split(rest, "/"), encode_component), "/"))


def wikilinks(x: Column) -> Column:
    """The targets of all [[target|label]] links."""
    return F.regexp_extract_all(x, F.lit(r"\[\[([^\]|#]+)"), F.lit(1))


def catalog_line(title: Column, year: Column, website: Column, topic: Column) -> Column:
    return F.format_string("%s (%s, %s, %s)", title, year, website, topic)


def predicate_label(x: Column) -> Column:
    return F.replace(x, F.lit("_"), F.lit(" "))


def grouped_number(x: Column) -> Column:
    """An integer with full stops between thousands."""
    return F.replace(F.format_number(x, 0), F.lit(","), F.lit("."))


def iso_date(x: Column) -> Column:
    """dd/mm/yyyy, dd.mm.yyyy or dd-mm-yyyy as yyyy-mm-dd; null if it is no date."""
    return F.date_format(F.try_to_timestamp(F.regexp_replace(x, "[./]", "-"), F.lit("dd-MM-yyyy")), "yyyy-MM-dd")


CITATION = r"(Lei Orgânica|Decreto-Lei|D\.L\.|DL|Lei|Portaria|Regulamento \(CE\)) (?:n\.º )?(\d+(?:-[A-Z])?)/(\d{4}|\d{2})\b"


def citations(x: Column) -> Column:
    """All citations of acts as they stand in the text."""
    return F.regexp_extract_all(x, F.lit(f"({CITATION})"), F.lit(1))


def canonical_citation(x: Column) -> Column:
    """A citation as instrument:<place>:<kind>:<number>/<year>; years of two digits from 50 on are of the 20th century."""
    kind = F.regexp_extract(x, CITATION, 1)
    slug = F.when(kind.isin("DL", "D.L."), F.lit("decreto-lei")).when(kind.startswith("Regulamento"), F.lit("regulamento")).otherwise(slugify(kind))
    year = F.regexp_extract(x, CITATION, 3)
    full = F.when(F.length(year) == 2, F.concat(F.when(year.cast("int") >= 50, F.lit("19")).otherwise(F.lit("20")), year)).otherwise(year)
    place = F.when(kind.startswith("Regulamento"), F.lit("eu")).otherwise(F.lit("pt"))
    return F.concat(F.lit("instrument:"), place, F.lit(":"), slug, F.lit(":"), F.regexp_extract(x, CITATION, 2), F.lit("/"), full)


def canonical_provision(key: Column) -> Column:
    """A provision's key as <act>:art-<number>[-n<paragraph>], in whichever of its spellings it comes.

    The article stands after "art" or at the end of the key; a number after it is the paragraph,
    with or without its n. Keys without an article stay as they are.
    """
    marked = r"^(.*?)[:-]art[.-]?(\d+[a-z]?(?:-[a-z](?![a-z0-9]))?)(?:-n?(\d+))?$"
    bare = r"^(.*?):(\d+[a-z]?)(?:-n?(\d+))?$"
    out = key
    for form in (bare, marked):
        number = F.regexp_extract(key, form, 3)
        full = F.concat(F.regexp_extract(key, form, 1), F.lit(":art-"), F.regexp_extract(key, form, 2), F.when(number != "", F.concat(F.lit("-n"), number)).otherwise(F.lit("")))
        out = F.when(F.regexp_extract(key, form, 2) != "", full).otherwise(out)
    return out
