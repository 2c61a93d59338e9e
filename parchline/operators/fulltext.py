"""Full-text search over postings.

The index is a table (term, id, tf, positions), sorted by term when it is written, so a query reads only the row groups and pages
that hold its own terms (``plans.index``). A query is parsed on the driver into a tree. Its leaves (terms, prefixes, phrases, NEAR groups)
are read once each, brought together by document in one aggregate, and the tree becomes a condition over the leaves that a
document has. Phrases and NEAR compare positions. Lists of common terms can be as long as the corpus, so the joins of a
phrase are shuffle joins that Spark narrows to broadcasts by measured size.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parchline.functions.text import folding, search_terms
from parchline.model.constants import BM25_B, BM25_K1, IDF_FLOOR


def postings(df: DataFrame, key: str, text: str) -> DataFrame:
    """(term, key, tf, positions) of every document; positions count from 0."""
    at = df.select(key, F.posexplode(search_terms(F.col(text))).alias("pos", "term"))
    return at.groupBy("term", key).agg(F.count("*").alias("tf"), F.sort_array(F.collect_list("pos")).alias("positions"))


@dataclass(frozen=True)
class Term:
    text: str
    prefix: bool = False


@dataclass(frozen=True)
class Phrase:
    terms: tuple[str, ...]


@dataclass(frozen=True)
class Near:
    terms: tuple[str, ...]
    distance: int


@dataclass(frozen=True)
class Bool:
    op: str
    parts: tuple


_LEX = re.compile(r'\s*(?:("(?:[^"]|"")*")|(NEAR\()|([(),])|([^\s"(),]+))')
_TERM = re.compile(r"[\w\-/.]+")


def analyse(text: str) -> list[str]:
    """The terms of a query string, as the index has them."""
    table = str.maketrans(*folding())
    return re.findall(r"[^\W_\-/.]*(?:[\-/.]|[^\W_])+", text.translate(table).lower())


def parse(query: str, columns: tuple[str, ...] = ("text",)):
    """The query tree. A query that the grammar does not know is taken as one phrase. ``column:`` before a term or phrase names one of
    ``columns``; as an index has one column of text, it restricts nothing."""
    try:
        items, at = [], 0
        query = re.sub(rf"(?<![^\s(])(?:{'|'.join(map(re.escape, columns))})\s*:\s*(?=[\w\"(])", "", query)
        query = query.rstrip()
        while at < len(query):
            m = _LEX.match(query, at)
            if not m:
                raise ValueError(query)
            items.append(m.group().strip())
            at = m.end()
        tree, rest = _either(items)
        if rest or tree is None:
            raise ValueError(query)
        return tree
    except (ValueError, IndexError):
        return Phrase(tuple(analyse(query)))


def _either(items):
    left, items = _both(items)
    parts = [left]
    while items and items[0] == "OR":
        right, items = _both(items[1:])
        parts.append(right)
    return (parts[0] if len(parts) == 1 else Bool("or", tuple(parts))), items


def _both(items):
    left, items = _one(items)
    parts, without = [left], []
    while items and items[0] not in ("OR", ")"):
        if items[0] == "NOT":
            right, items = _one(items[1:])
            without.append(right)
            continue
        right, items = _one(items[1:] if items[0] == "AND" else items)
        parts.append(right)
    tree = parts[0] if len(parts) == 1 else Bool("and", tuple(parts))
    for w in without:
        tree = Bool("not", (tree, w))
    return tree, items


def _one(items):
    head, rest = items[0], items[1:]
    if head in ("AND", "OR", "NOT", ")", ","):
        raise ValueError(head)
    if head == "(":
        tree, rest = _either(rest)
        if rest[0] != ")":
            raise ValueError(head)
        return tree, rest[1:]
    if head == "NEAR(":
        terms, gap = [], 10
        while rest[0] != ")":
            if rest[0] == ",":
                gap, rest = int(rest[1]), rest[2:]
                continue
            terms.extend(analyse(rest[0]))
            rest = rest[1:]
        return Near(tuple(terms), gap), rest[1:]
    if head[0] == '"':
        return Phrase(tuple(analyse(head[1:-1].replace('""', " ")))), rest
    if head.endswith("*"):
        return Term(analyse(head[:-1])[0], True), rest
    if re.search(r"[^\w]", head):
        raise ValueError(head)
    return Term(analyse(head)[0]), rest


class Index:
    """Postings, lengths and corpus statistics of one corpus. Statistics cover every row given, also inactive ones."""

    def __init__(self, key: str, postings: DataFrame, lengths: DataFrame, n_docs: int, avg_len: float):
        self.key, self.postings, self.lengths, self.n_docs, self.avg_len = key, postings, lengths, n_docs, avg_len

    @classmethod
    def build(cls, df: DataFrame, key: str, text: str, path: str) -> "Index":
        """Writes the index to ``path``, sorted by term, so a query's terms are found by the statistics of row groups and pages."""
        told = df.where(F.col(text).isNotNull())
        spread = postings(told, key, text).repartitionByRange("term", key).sortWithinPartitions("term", key)
        spread.write.mode("overwrite").parquet(f"{path}/postings")
        lengths = df.sparkSession.read.parquet(f"{path}/postings").groupBy(key).agg(F.sum("tf").alias("len"))
        lengths.write.mode("overwrite").parquet(f"{path}/lengths")
        told.agg(F.count("*").alias("n_docs")).coalesce(1).write.mode("overwrite").parquet(f"{path}/stats")
        return cls.open(df.sparkSession, key, path)

    @classmethod
    def open(cls, spark: SparkSession, key: str, path: str) -> "Index":
        """An index that was written before."""
        lengths, n = spark.read.parquet(f"{path}/lengths"), spark.read.parquet(f"{path}/stats").first()[0]
        return cls(key, spark.read.parquet(f"{path}/postings"), lengths, n, (lengths.agg(F.sum("len")).first()[0] or 0) / max(n, 1) or 1.0)

    def _list(self, term: str, prefix: bool = False) -> DataFrame:
        """(key, tf) of one term, or of all terms with a prefix together. A term has one row per key already."""
        if not prefix:
            return self.postings.where(F.col("term") == term).select(self.key, "tf")
        return self.postings.where(F.startswith("term", F.lit(term))).groupBy(self.key).agg(F.sum("tf").alias("tf"))

    def _places(self, terms: tuple[str, ...]) -> DataFrame:
        """Starts of the terms in a row."""
        k = self.key
        back = lambda i: F.transform("positions", lambda p: p - i)
        lists = [self.postings.where(F.col("term") == t).select(k, back(i).alias(f"p{i}")) for i, t in enumerate(terms)]
        all_of = reduce(lambda a, b: a.join(b, k), lists)
        starts = reduce(F.array_intersect, [F.col(f"p{i}") for i in range(len(terms))])
        return all_of.select(k, F.size(starts).cast("bigint").alias("tf")).where("tf > 0")

    def _near(self, terms: tuple[str, ...], distance: int) -> DataFrame:
        """Documents with a group of all terms in which no more than ``distance`` other tokens lie between first and last."""
        k = self.key
        hit = self.postings.where(F.col("term").isin(list(terms))).select(k, "term", F.explode("positions").alias("pos"))
        w = Window.partitionBy(k).orderBy("pos")
        last = [F.max(F.when(F.col("term") == t, F.col("pos"))).over(w.rowsBetween(Window.unboundedPreceding, 0)) for t in terms]
        span = F.col("pos") - (F.least(*last) if len(last) > 1 else last[0]) - len(terms) + 1
        full = reduce(lambda a, b: a & b, [x.isNotNull() for x in last])
        return hit.select(k, F.when(full, span).alias("gap")).where(F.col("gap") <= distance).groupBy(k).agg(F.count("*").alias("tf"))

    def _leaves(self, tree, positive: bool = False) -> list:
        """The leaves of a tree in order; ``positive``: of the parts that a match has."""
        if isinstance(tree, Bool):
            parts = tree.parts[:1] if tree.op == "not" and positive else tree.parts
            return list(dict.fromkeys(x for p in parts for x in self._leaves(p, positive)))
        return [tree]

    def _docs(self, leaf) -> DataFrame:
        if isinstance(leaf, Term):
            return self._list(leaf.text, leaf.prefix)
        if isinstance(leaf, Near):
            return self._near(leaf.terms, leaf.distance)
        if not leaf.terms:
            return self.postings.where("false").select(self.key, "tf")
        return self._places(leaf.terms) if len(leaf.terms) != 1 else self._list(leaf.terms[0])

    def _met(self, tree) -> tuple[list, DataFrame, DataFrame]:
        """The leaves, (leaf, df), and (key, f0, f1, ...) with the frequency of each leaf in every document that matches."""
        leaves = self._leaves(tree)
        lists = reduce(DataFrame.unionAll, [self._docs(x).select(F.lit(n).alias("leaf"), self.key, "tf") for n, x in enumerate(leaves)])
        if len(leaves) == 1:
            by_doc = lists.select(self.key, F.col("tf").alias("f0"))
        else:
            by_doc = lists.groupBy(self.key).agg(*[F.sum(F.when(F.col("leaf") == n, F.col("tf"))).alias(f"f{n}") for n in range(len(leaves))])

        def holds(t) -> Column:
            if not isinstance(t, Bool):
                return F.col(f"f{leaves.index(t)}").isNotNull()
            parts = [holds(p) for p in t.parts]
            return reduce(lambda a, b: a & b, parts) if t.op == "and" else reduce(lambda a, b: a | b, parts) if t.op == "or" else parts[0] & ~parts[1]

        return leaves, lists.groupBy("leaf").agg(F.count("*").alias("df")), by_doc.where(holds(tree))

    def matching(self, tree) -> DataFrame:
        """Keys that satisfy the tree."""
        return self._met(tree)[2].select(self.key)

    def scored(self, query: str) -> DataFrame:
        """(key, score) of every match; lower is better. Scores of the query's positive parts add up."""
        tree = parse(query) if isinstance(query, str) else query
        leaves, df, met = self._met(tree)
        counts = dict.fromkeys(range(len(leaves)), 0) | {r["leaf"]: r["df"] for r in df.collect()}  # a row per leaf of the query
        mine = [n for n, x in enumerate(leaves) if x in self._leaves(tree, positive=True)]
        parts = [F.when(F.col(f"f{n}").isNotNull(), bm25(F.col(f"f{n}"), counts[n], self.n_docs, F.col("len"), self.avg_len)).otherwise(0.0) for n in mine]
        return met.join(self.lengths, self.key).select(self.key, reduce(lambda a, b: a + b, parts).alias("score"))


def bm25(tf: Column, df: int, n_docs: int, length: Column, avg_len: float) -> Column:
    idf = math.log((n_docs - df + 0.5) / (df + 0.5))
    norm = F.lit(BM25_K1) * (F.lit(1 - BM25_B) + F.lit(BM25_B) * length / F.lit(avg_len))
    return -F.lit(idf if idf > 0 else IDF_FLOOR) * tf * F.lit(BM25_K1 + 1) / (tf + norm)


def top_hits(hits: DataFrame, key: str, limit: int) -> DataFrame:
    """The first ``limit`` by score, ties by key."""
    return hits.orderBy("score", key).limit(limit)


def snippet(text, terms: list[str], size: int = 12):
    """``size`` tokens around the first hit, hits in brackets, cut ends marked."""
    toks = F.filter(F.split(text, r"\s+"), lambda x: x != "")
    wanted = F.array(*[F.lit(t) for t in terms])
    hit = F.transform(toks, lambda x: F.arrays_overlap(search_terms(x), wanted))
    first = F.coalesce(F.when(F.array_position(hit, True) > 0, F.array_position(hit, True)), F.lit(1)).cast("int")
    start = F.greatest(F.lit(1), first - size // 2)
    marked = F.transform(F.slice(toks, start, size), lambda x: F.when(F.arrays_overlap(search_terms(x), wanted), F.concat(F.lit("["), x, F.lit("]"))).otherwise(x))
    return F.concat(F.when(start > 1, "... ").otherwise(""), F.array_join(marked, " "), F.when(F.size(toks) >= start + size, " ...").otherwise(""))
