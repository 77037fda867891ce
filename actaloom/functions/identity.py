"""Stable identifiers: hashes, prefixed ids, names and paths."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from actaloom.functions.text import slugify


def content_hash(x: Column) -> Column:
    return F.sha2(x, 256)


def prefixed_id(prefix: str, x: Column, digits: int = 16) -> Column:
    """prefix and the first hexadecimal digits of the hash of x."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(x, 256), 1, digits))


def family_id(text: Column) -> Column:
    return prefixed_id("family_", text)


def assertion_id(subject: Column, predicate: Column, target: Column) -> Column:
    return prefixed_id("conn_", F.concat_ws(":", subject, predicate, target), 24)


def stem(filename: Column) -> Column:
    """A file name without its last extension."""
    return F.regexp_replace(filename, r"\.[^.]*$", "")


def page_slug(title: Column, key: Column) -> Column:
    return F.concat(slugify(title), F.lit("--"), key)


def hub_slug(key: Column) -> Column:
    """A node key without its type, as a page name."""
    return slugify(F.regexp_replace(F.regexp_replace(key, "^[^:]*:", ""), "[:/]", "-"))


def relative_path(path: Column, root: str) -> Column:
    return F.regexp_replace(path, f"^(?:file:)?/*{re.escape(root.strip('/'))}/+", "")


def fingerprint(page: Column, line: str = "generated_fingerprint") -> Column:
    """Hash of a page with its own fingerprint line blanked."""
    return F.sha2(F.regexp_replace(page, rf"(?m)^{line}: .*$", f"{line}: "), 256)
