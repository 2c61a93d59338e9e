"""Links, directory listings and tables of HTML pages."""

from __future__ import annotations

from html.parser import HTMLParser
from urllib.parse import urljoin

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

ANCHOR = r'(?is)<a\s[^>]*?href\s*=\s*["\']([^"\']*)["\'][^>]*>'


def hrefs(html: Column) -> Column:
    """Link targets in order, from quoted href attributes."""
    return F.regexp_extract_all(html, F.lit(ANCHOR), F.lit(1))


#: an anchor with a quoted href, and what stands in it
ANCHOR_TEXT = ANCHOR + r"(.*?)</a\s*>"


def anchors(html: Column) -> Column:
    """(href, text) of every closed anchor in order; text without tags, blanks around it trimmed."""
    hits = F.arrays_zip(F.regexp_extract_all(html, F.lit(ANCHOR_TEXT), F.lit(1)).alias("href"), F.regexp_extract_all(html, F.lit(ANCHOR_TEXT), F.lit(2)).alias("text"))
    return F.transform(hits, lambda x: F.struct(x["href"].alias("href"), F.trim(F.regexp_replace(x["text"], "<[^>]*>", "")).alias("text")))


def directory_entry(href: Column, text: Column) -> Column:
    """A file or directory of an open listing: (name, is_dir), the name being the last part of the path; null for sort links, fragments,
    absolute links and the parent, by its href or its text."""
    skip = (href == "") | href.rlike(r"^[?#]") | href.rlike(r"^https?://") | href.isin("../", "..", "/") | F.lower(text).isin("parent directory", "..")
    last = F.substring_index(F.regexp_replace(href, "/+$", ""), "/", -1)
    return F.when(~skip, F.struct(F.try_url_decode(F.regexp_replace(last, r"\+", "%2B")).alias("name"), F.endswith(href, F.lit("/")).alias("is_dir")))


def url_join(base: Column, href: Column) -> Column:
    """The absolute form of a link without dot segments: with a scheme as it is, with two slashes under the base's scheme, with one under
    its host, else beside its last path part."""
    origin = F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)", 1)
    folder = F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*(?:/[^?#]*/|/)?)", 1)
    folder = F.when(F.endswith(folder, F.lit("/")), folder).otherwise(F.concat(folder, F.lit("/")))
    return (
        F.when(href.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:"), href).when(href.startswith("//"), F.concat(F.substring_index(base, "//", 1), href)).when(href.startswith("/"), F.concat(origin, href))
        .when(href == "", base).otherwise(F.concat(folder, href))
    )


class _Rows(HTMLParser):
    def __init__(self) -> None:
        super().__init__()
        self.rows: list[list[dict]] = []
        self.cell: dict | None = None

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "tr":
            self.rows.append([])
        elif tag in ("td", "th"):
            self.cell = {"text": "", "href": None}
            (self.rows or self.rows.append([]) or self.rows)[-1].append(self.cell)
        elif tag == "a" and self.cell is not None and self.cell["href"] is None:
            self.cell["href"] = dict(attrs).get("href")

    def handle_endtag(self, tag: str) -> None:
        if tag in ("td", "th", "tr"):
            self.cell = None

    def handle_data(self, data: str) -> None:
        if self.cell is not None:
            self.cell["text"] += data


def listing_rows(html: str | None, base_url: str) -> list[tuple[str, str, list[str]]]:
    """(title, url, other cells) of table rows whose first linked cell has text."""
    p = _Rows()
    p.feed(html or "")
    out = []
    for row in p.rows:
        cells = [(" ".join(c["text"].split()), c["href"]) for c in row]
        at = next((k for k, (_, h) in enumerate(cells) if h), None)
        if at is not None and cells[at][0]:
            out.append((cells[at][0], urljoin(base_url, cells[at][1]), [t for k, (t, _) in enumerate(cells) if k != at and t]))
    return out


LISTING = T.ArrayType(T.StructType([T.StructField("title", T.StringType()), T.StructField("url", T.StringType()), T.StructField("cells", T.ArrayType(T.StringType()))]))


def parse_listings(df, html: str, base_url: str, key: str):
    """(key, title, url, cells) of every listing row; parsed in Arrow batches."""
    import pyarrow as pa

    def run(batches):
        for b in batches:
            rows = [(k, *r) for k, h, u in zip(*[c.to_pylist() for c in b.columns], strict=True) for r in listing_rows(h, u or "")]
            cols = list(zip(*rows, strict=True)) if rows else [[], [], [], []]
            types = [b.schema.field(0).type, pa.string(), pa.string(), pa.list_(pa.string())]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, types, strict=True)], names=["k", "title", "url", "cells"])

    schema = T.StructType([T.StructField("k", df.schema[key].dataType), *LISTING.elementType.fields])
    return df.select(key, html, base_url).mapInArrow(run, schema).withColumnRenamed("k", key)

