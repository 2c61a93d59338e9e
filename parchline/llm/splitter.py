"""Oversized texts cut at natural boundaries by structure-tree packing.

A text is parsed into a tree: pages (form feeds), sections under headings of several levels, blocks (paragraphs, list
items, table rows), lines, sentences, words. A node that fits becomes a piece as it is; only nodes that do not fit
are descended into, and the pieces of siblings are then merged from left to right as long as they fit. A piece
is cut inside a word only where the word alone exceeds the limit.

Every piece but the first of a page repeats the ``overlap`` tokens before it (fewer where fewer precede it on the page, or
where these are longer than a quarter of the character limit); limits hold with the overlap included. The pieces
without their overlaps, put together, are the text.

Whether a text is oversized is decided in the JVM, so only such texts reach Python. Tokens are what Unicode white space
separates, characters are code points. Defined results: null, empty and fitting texts give no pieces; repeated rows give
repeated pieces; extra columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: white space as the tokens understand it, for a Java character class
BLANKS = r"\x09-\x0d\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"

_HEAD = re.compile(r"(#{1,6})\s+\S|(\d+(?:\.\d+)*)[.)]?\s+[A-ZÀ-Þ]|((?:chapter|section|part|kapitel|chapitre|cap[ií]tulo|capitolo|hoofdstuk)\s+\w+)", re.I)
_ITEM = re.compile(r"\s*(?:[-*•–>]\s|\(?\d{1,3}[.)]\s|\(?[a-z]\)\s)")
_STOP = re.compile(r"[.!?][\"'’”»)\]]*\s+|[。！？]")
_TOKEN = re.compile(r"\S+")

SCHEMA = T.StructType(
    [
        T.StructField("piece_no", T.IntegerType()), T.StructField("start", T.IntegerType()), T.StructField("stop", T.IntegerType()), T.StructField("core_start", T.IntegerType()),
        T.StructField("n_tokens", T.IntegerType()), T.StructField("text", T.StringType()),
    ]
)


def token_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(f"[^{BLANKS}]+"))


def oversized(text: Column, max_tokens: int, max_chars: int) -> Column:
    """More tokens or code points than allowed. A text needs two code points per token, so short ones are not counted."""
    return (F.length(text) > max_chars) | ((F.length(text) > 2 * max_tokens) & (token_count(text) > max_tokens))


class Splitter:
    def __init__(self, text: str, max_tokens: int, max_chars: int, overlap: int):
        self.text, self.max_tokens, self.max_chars, self.overlap = text, max_tokens, max_chars, overlap
        spans = [m.span() for m in _TOKEN.finditer(text)]
        self.starts, self.ends = [a for a, _ in spans], [b for _, b in spans]
        self.page_start = 0

    def lead(self, start: int) -> int:
        """Where the overlap of a piece that starts at ``start`` begins."""
        k = bisect_left(self.starts, start)
        first = max(bisect_left(self.starts, self.page_start), k - self.overlap)
        while first < k and start - self.starts[first] > self.max_chars // 4:
            first += 1
        if first < k:
            return min(start, self.starts[first])
        return max(self.page_start, start - self.max_chars // 8) if k and self.overlap else start

    def count(self, start: int, stop: int) -> int:
        return max(0, bisect_left(self.starts, stop) - bisect_right(self.ends, start))

    def fits(self, start: int, stop: int) -> bool:
        lead = self.lead(start)
        return stop - lead <= self.max_chars and self.count(lead, stop) <= self.max_tokens

    # the tree: each level gives the children of a node as spans that cover it

    def _cuts(self, start: int, stop: int, cuts: list[int]) -> list[tuple[int, int]]:
        edges = [start, *sorted({c for c in cuts if start < c < stop}), stop]
        return list(zip(edges, edges[1:], strict=False))

    def _lines(self, start: int, stop: int) -> list[tuple[int, int]]:
        return self._cuts(start, stop, [start + m.end() for m in re.finditer("\n", self.text[start:stop])])

    def _heading(self, a: int, b: int, blank_before: bool) -> int:
        """The level of the heading in a line, 0 if it is none."""
        line = self.text[a:b].strip()
        if not line or len(line) > 100 or line[-1] in ".,;:!?":
            return 0
        m = _HEAD.match(line)
        if m:
            return len(m.group(1)) if m.group(1) else 2 + m.group(2).count(".") if m.group(2) and blank_before else 1 if m.group(3) else 0
        return 1 if line.isupper() and blank_before and len(line) > 3 else 0

    def sections(self, start: int, stop: int) -> list[tuple[int, int]]:
        """Subtrees under the highest heading level within a span."""
        heads, blank = [], True
        for a, b in self._lines(start, stop):
            level = self._heading(a, b, blank)
            if level:
                heads.append((level, a))
            blank = not self.text[a:b].strip()
        inner = [h for h in heads if h[1] > start]
        if not inner:
            return [(start, stop)]
        top = min(level for level, _ in inner)
        return self._cuts(start, stop, [a for level, a in inner if level == top])

    def blocks(self, start: int, stop: int) -> list[tuple[int, int]]:
        cuts, blank = [], False
        for a, b in self._lines(start, stop):
            line = self.text[a:b]
            if not line.strip():
                blank = True
                continue
            if blank or _ITEM.match(line):
                cuts.append(a)
            blank = False
        return self._cuts(start, stop, cuts)

    def lines(self, start: int, stop: int) -> list[tuple[int, int]]:
        return self._lines(start, stop)

    def sentences(self, start: int, stop: int) -> list[tuple[int, int]]:
        return self._cuts(start, stop, [start + m.end() for m in _STOP.finditer(self.text[start:stop])])

    def words(self, start: int, stop: int) -> list[tuple[int, int]]:
        lo, hi = bisect_left(self.starts, start), bisect_left(self.starts, stop)
        return self._cuts(start, stop, self.starts[lo:hi])

    def letters(self, start: int, stop: int) -> list[tuple[int, int]]:
        out = []
        while start < stop:
            end = min(stop, self.lead(start) + self.max_chars)
            out.append((start, end))
            start = end
        return out

    def pack(self, start: int, stop: int, level: int = 0) -> list[tuple[int, int]]:
        if self.fits(start, stop):
            return [(start, stop)]
        levels = [self.sections, self.blocks, self.lines, self.sentences, self.words, self.letters]
        while True:
            children = levels[level](start, stop)
            if len(children) > 1 or level == len(levels) - 1:
                break
            level += 1
        if levels[level] in (self.words, self.letters):
            parts = children
        else:
            # a section may hold sections of a lower level
            below = level if levels[level] == self.sections else level + 1
            parts = [p for a, b in children for p in self.pack(a, b, below)]
        merged: list[tuple[int, int]] = []
        for a, b in parts:
            if merged and self.fits(merged[-1][0], b):
                merged[-1] = (merged[-1][0], b)
            elif levels[level] == self.words and not self.fits(a, b):
                merged.extend(self.letters(a, b))
            else:
                merged.append((a, b))
        return merged

    def pieces(self) -> list[tuple[int, int, int, int]]:
        """(start with overlap, stop, start without overlap, tokens)."""
        out = []
        for a, b in self._cuts(0, len(self.text), [m.end() for m in re.finditer("\f", self.text)]):
            if a == b:
                continue
            self.page_start = a
            for s, e in self.pack(a, b):
                lead = self.lead(s)
                out.append((lead, e, s, self.count(lead, e)))
        return out


def split_oversized(df: DataFrame, key: list[str], text: str, max_tokens: int = 800, max_chars: int = 8000, overlap: int = 100) -> DataFrame:
    """Pieces (key, piece_no from 0, start, stop, core_start, n_tokens, text) of the rows whose text is oversized. Offsets
    are code points of the text; the overlap is what lies between start and core_start."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pick, cols = [], [[] for _ in SCHEMA]
            for i, t in enumerate(b.column(len(key)).to_pylist()):
                for no, (lead, stop, core, n) in enumerate(Splitter(t, max_tokens, max_chars, overlap).pieces()):
                    pick.append(i)
                    for col, v in zip(cols, (no, lead, stop, core, n, t[lead:stop]), strict=True):
                        col.append(v)
            at = pa.array(pick, pa.int64())
            keys = [b.column(k).take(at) for k in range(len(key))]
            types = [pa.int32()] * 5 + [pa.string()]
            yield pa.RecordBatch.from_arrays([*keys, *[pa.array(c, t) for c, t in zip(cols, types, strict=True)]], names=[f"k{i}" for i in range(len(key))] + SCHEMA.names)

    rows = df.where(oversized(F.col(text), max_tokens, max_chars)).select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(key)], F.col(text).alias("t"))
    schema = T.StructType([*[T.StructField(f"k{i}", df.schema[c].dataType) for i, c in enumerate(key)], *SCHEMA.fields])
    return rows.mapInArrow(run, schema).withColumnsRenamed({f"k{i}": c for i, c in enumerate(key)})
