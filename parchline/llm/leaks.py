"""Evaluation passages inside a training corpus, by a stored positional inverted index.

1. Index: texts are folded (case, accents) and cut into words, and every posting (term, document, position) of the corpus is
   stored, in shards by document: a shard is one row whose lists are sorted by term, with each term's document frequency. The index
   is a written table that any number of searches can use (``build_index``, ``open_index``).
2. A search reads the document frequencies of the items' terms. The seeds of an item are the pairs of its adjacent words, without
   the sixth of them whose rarer term is the most frequent.
3. Per shard the lists of a pair's terms are intersected, the rarer one first, after adjusting the offset: what is left are the places
   of the exact phrase. All pairs of all items are met at once; where their lists together are longer than the
   shard, one pass over its tokens does the same. Phrases of an item that stand in one document no further from their due distance than
   an interruption may be long are a candidate, if they are at least a twelfth of its words.
4. Candidates are aligned exactly: matching blocks in order, where a single replaced or misread word inside a
   block counts as held and a small interruption between blocks does no harm. Blocks shorter than four words
   are what any two texts in one language share and do not count.

A passage that holds half of an item's words is a candidate unless more than every fourth word in it is replaced or misread: it then has
a quarter of the item's pairs at least, of which at most a sixth is no seed.

No posting leaves its shard, so nothing is shuffled but the document frequencies. The items go to the executors in
blocks of ``items_per_pass`` items and ``bytes_per_pass`` bytes at most (or one longer item), which bounds what is sent whatever the data are.

Defined results: null and empty texts and items match nothing; items of fewer than ``min_words`` words are found only whole, single words not at all;
a document that holds an item several times is reported once with its best place; equal items are reported each;
repeated documents are reported each.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parchline.llm.units import bytes_of
from parchline.session import Scratch

_MARKS = re.compile("[\u0300-\u036f]+")
_WIDE = re.compile("([\u3040-\u30ff\u3400-\u9fff\uac00-\ud7af])")
_WORD = np.zeros(256, dtype=bool)
_WORD[np.r_[48:58, 97:123, 128:256]] = True
_PRIME, _ONE = np.uint64(0x100000001B3), np.uint64(1)
MIN_BLOCK = 4
GAP = 30


def fold(text: str | None) -> str:
    """Case, accents and width folded; general punctuation is blank; ideographs stand alone."""
    if not text:
        return ""
    if text.isascii():
        return text.lower()
    out = _MARKS.sub("", unicodedata.normalize("NFKD", text)).lower()
    return _WIDE.sub(r" \1 ", re.sub("[\u2000-\u206f\u3000-\u303f]", " ", out))


def words_of(folded: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, position in the row and hash of every word of a list of folded texts."""
    raw, off = bytes_of(pa.array([f + "\n" for f in folded], pa.large_string()))
    word = _WORD[raw]
    edge = np.flatnonzero(word[1:] != word[:-1]) + 1
    if len(raw) and word[0]:
        edge = np.r_[0, edge]
    start, size = edge[0::2], edge[1::2] - edge[0::2]  # every row ends in a line feed
    h = np.zeros(len(start), dtype=np.uint64)
    live, at = np.arange(len(start)), start
    for k in range(int(size.max(initial=0))):  # letter by letter, over ever fewer words
        if k:
            more = size[live] > k
            live = live[more]
            at = start[live] + k
        h[live] = h[live] * _PRIME + raw[at] + _ONE
    h ^= h >> np.uint64(29)
    h *= np.uint64(0x9E3779B97F4A7C15)
    first = np.searchsorted(start, off)
    row = np.repeat(np.arange(len(folded)), np.diff(first))
    return row, np.arange(len(start)) - first[row], h


INDEX = ("docs", "start", "term", "df", "count", "place")


def _shards(size: int):
    """Batches of (key, text) to index shards of about ``size`` characters, one row each: the documents' keys, the place of each one's
    first word, the sorted terms with their numbers of documents and of places, and the places by term."""

    def one(keys: list, folded: list[str], kind: pa.DataType) -> pa.RecordBatch:
        row, _, h = words_of(folded)
        term, of = np.unique(h, return_inverse=True)
        place = np.argsort(of, kind="stable")
        count = np.bincount(of, minlength=len(term))
        by, doc = of[place], row[place]
        new = np.append(True, (by[1:] != by[:-1]) | (doc[1:] != doc[:-1])) if len(by) else np.zeros(0, dtype=bool)
        df = np.bincount(by[new], minlength=len(term))
        start = np.searchsorted(row, np.arange(len(keys)))
        blobs = [x.tobytes() for x in (start.astype(np.int32), term.astype(np.uint64), df.astype(np.int32), count.astype(np.int32), place.astype(np.int32))]
        return pa.RecordBatch.from_arrays([pa.array([keys], pa.list_(kind)), *[pa.array([x], pa.binary()) for x in blobs]], names=list(INDEX))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, folded, have = [], [], 0
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                keys.append(k)
                folded.append(fold(t))
                have += len(folded[-1])
                if have >= size:
                    yield one(keys, folded, b.column(0).type)
                    keys, folded, have = [], [], 0
            if keys:
                yield one(keys, folded, b.column(0).type)

    return run


def build_index(corpus: DataFrame, key: str, text: str, path: str, shard_chars: int = 2_000_000) -> DataFrame:
    """Writes the token index of a corpus to ``path`` and opens it."""
    schema = T.StructType([T.StructField("docs", T.ArrayType(corpus.schema[key].dataType)), *[T.StructField(c, T.BinaryType()) for c in INDEX[1:]]])
    corpus.where(F.col(text).isNotNull()).select(key, text).mapInArrow(_shards(shard_chars), schema).write.mode("overwrite").parquet(path)
    return corpus.sparkSession.read.schema(schema).parquet(path)


def open_index(spark: SparkSession, path: str) -> DataFrame:
    """An index that was built before."""
    return spark.read.parquet(path)


class Items:
    """Test items as sequences of numbers of terms, their seeds among the pairs of adjacent words, and the pairs' items and places."""

    def __init__(self, ids: list[int], texts: list[str | None]):
        row, _, h = words_of([fold(t) for t in texts])
        self.terms, coded = np.unique(h, return_inverse=True)
        self.ids = ids
        start = np.searchsorted(row, np.arange(len(ids) + 1))
        self.words = [coded[x:y].tolist() for x, y in zip(start, start[1:], strict=False)]
        self.size = np.diff(start)
        self.need = np.maximum(np.minimum(2, self.size - 1), -(-self.size // 12))

    def choose(self, df: np.ndarray) -> None:
        """The seeds, by the document frequencies of ``terms``. Pairs are numbered; ``item`` and ``place`` of pair k are those from
        ``first[k]`` up to ``first[k + 1]``."""
        base = len(self.terms) + 1
        pair, item, place = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
        for i, words in enumerate(self.words):
            w = np.array(words, dtype=np.int64)
            if len(w) < 2:
                continue
            rarer = np.minimum(df[w[:-1]], df[w[1:]])
            at = np.sort(np.argsort(rarer, kind="stable")[: len(rarer) - len(rarer) // 6])
            pair.append(w[at] * base + w[at + 1])
            item.append(np.full(len(at), i))
            place.append(at)
        pairs, item, place = np.concatenate(pair), np.concatenate(item), np.concatenate(place)
        order = np.argsort(pairs, kind="stable")
        self.item, self.place = item[order], place[order]
        self.pairs, counts = np.unique(pairs, return_counts=True)
        self.left, self.right = self.pairs // base, self.pairs % base
        self.first = np.append(0, np.cumsum(counts))


def _spans(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[k], start[k] + 1, ... of ``size[k]`` each, one after the other."""
    return np.repeat(start - np.cumsum(size) + size, size) + np.arange(int(size.sum()))


class Shard:
    """One row of the index, as seen by a block of items."""

    def __init__(self, docs: pa.Array, blobs: list[bytes], items: Items):
        start, term, _, count, place = (np.frombuffer(x, dtype=t) for x, t in zip(blobs, (np.int32, np.uint64, np.int32, np.int32, np.int32), strict=True))
        self.docs, self.start, self.items, self.tokens = docs, start.astype(np.int64), items, place.astype(np.int64)
        at = np.minimum(np.searchsorted(term, items.terms), max(len(term) - 1, 0))
        there = term[at] == items.terms if len(term) else np.zeros(len(items.terms), dtype=bool)
        first = np.cumsum(count, dtype=np.int64) - count
        self.count = np.where(there, count[at], 0) if len(term) else np.zeros(len(items.terms), dtype=np.int64)
        self.first = np.where(there, first[at], 0) if len(term) else np.zeros(len(items.terms), dtype=np.int64)
        own = np.full(len(term), -1, dtype=np.int64)
        own[at[there]] = np.flatnonzero(there)
        self.at = np.empty(len(place), dtype=np.int64)  # the item term at every place, -1 for others
        self.at[self.tokens] = np.repeat(own, count)
        self.end = np.append(self.start[1:], len(place))

    def phrases(self) -> tuple[np.ndarray, np.ndarray]:
        """(pair, place): where the words of a pair follow one another in a document."""
        it = self.items
        fewer = np.minimum(self.count[it.left], self.count[it.right])
        if fewer.sum() <= len(self.at):
            on = np.flatnonzero(fewer)
            right = self.count[it.right[on]] < self.count[it.left[on]]
            rare = np.where(right, it.right[on], it.left[on])
            pair = np.repeat(on, fewer[on])
            place = self.tokens[_spans(self.first[rare], fewer[on])] - np.repeat(right, fewer[on])
            fits = (place >= 0) & (place + 1 < len(self.at))
            pair, place = pair[fits], place[fits]
            fits = (self.at[place] == it.left[pair]) & (self.at[place + 1] == it.right[pair])
            pair, place = pair[fits], place[fits]
        else:
            place = np.flatnonzero((self.at[:-1] >= 0) & (self.at[1:] >= 0))
            code = self.at[place] * (len(it.terms) + 1) + self.at[place + 1]
            pair = np.minimum(np.searchsorted(it.pairs, code), max(len(it.pairs) - 1, 0))
            fits = it.pairs[pair] == code if len(it.pairs) else np.zeros(len(code), dtype=bool)
            pair, place = pair[fits], place[fits]
        doc = np.searchsorted(self.start, place, side="right") - 1
        inside = place + 1 < self.end[doc]
        return pair[inside], place[inside]

    def candidates(self, most: int = 4_000_000) -> Iterator[tuple[int, int, int, int]]:
        """(item, document, from, to): where enough seeds of an item stand at their due distances. At most ``most`` meetings of a phrase
        and an item at once, or those of one item."""
        it = self.items
        pair, place = self.phrases()
        size = it.first[pair + 1] - it.first[pair]
        by_item = np.bincount(it.item[_spans(it.first[:-1], np.diff(it.first))], weights=np.repeat(np.bincount(pair, minlength=len(it.pairs)), np.diff(it.first)), minlength=len(it.ids))
        block = (np.cumsum(by_item) // most).astype(np.int64)
        for k in np.unique(block[by_item >= it.need]) if len(pair) else []:
            at = _spans(it.first[pair], size)
            item, where = it.item[at], np.repeat(place, size)
            on = (block[item] == k) & (by_item[item] >= it.need[item])
            item, where, due = item[on], where[on], it.place[at[on]]
            doc = np.searchsorted(self.start, where, side="right") - 1
            offset = where - due
            order = np.lexsort((offset, doc, item))
            item, doc, where, due, offset = item[order], doc[order], where[order], due[order], offset[order]
            apart = np.append(True, (item[1:] != item[:-1]) | (doc[1:] != doc[:-1]) | (offset[1:] - offset[:-1] > GAP + 2))
            run = np.cumsum(apart) - 1
            many = np.bincount(run)[run] >= it.need[item]
            item, doc, where, due, run = item[many], doc[many], where[many], due[many], run[many]
            if not len(run):
                continue
            _, lead = np.unique(run, return_index=True)
            different = np.bincount(np.unique(run * (int(due.max()) + 1) + due) // (int(due.max()) + 1))[run[lead]]
            low, high = np.minimum.reduceat(where, lead), np.maximum.reduceat(where, lead)
            for n in np.flatnonzero(different >= it.need[item[lead]]).tolist():
                i, d = int(item[lead[n]]), int(doc[lead[n]])
                room = int(it.size[i]) + GAP
                yield i, d, max(int(low[n]) - room, int(self.start[d])), min(int(high[n]) + room, int(self.end[d]))

    def found(self, share: float, min_words: int) -> Iterator[tuple]:
        """(document, item, share held) of what is held in full measure."""
        best: dict[tuple[int, int], int] = {}
        for i, d, low, high in self.candidates():
            words = self.items.words[i]
            # a longer stretch than any one place needs goes in pieces that overlap by more than a place
            size = 4 * len(words) + 4 * GAP
            for at in range(low, max(low + 1, high - size // 2), size // 2) if high - low > size else [low]:
                piece = self.at[at : min(high, at + size)] if high - low > size else self.at[low:high]
                if best.get((i, d), 0) == len(words):
                    break
                other = np.flatnonzero(piece < 0)
                window = piece.copy()
                window[other] = -1 - np.arange(len(other))
                best[i, d] = max(best.get((i, d), 0), held(words, window.tolist()))
        for (i, d), n in best.items():
            size = len(self.items.words[i])
            if n >= (share if size >= min_words else 1.0) * size:
                yield self.docs[d].as_py(), self.items.ids[i], n / size


def held(item: list[int], window: list[int]) -> int:
    """How many of the item's words the window holds in order, in blocks."""
    blocks = [list(b) for b in SequenceMatcher(None, item, window, autojunk=False).get_matching_blocks() if b.size]
    merged: list[list[int]] = []  # item from, item to, window from, window to, size of the last exact run
    for a, b, n in blocks:
        if merged:
            last = merged[-1]
            one_each = a - last[1] == 1 and b - last[3] == 1 and last[4] >= 2 and n >= 2
            if one_each or (a == last[1] and b - last[3] <= 2 and n >= 2):
                last[1], last[3], last[4] = a + n, b + n, n
                continue
        merged.append([a, a + n, b, b + n, n])
    kept = [m for m in merged if m[1] - m[0] >= min(MIN_BLOCK, len(item))]
    best = total = 0
    edge = None
    for m in kept:  # one place: blocks further apart than an interruption start again
        total = total + m[1] - m[0] if edge is not None and m[2] - edge <= GAP else m[1] - m[0]
        edge = m[3]
        best = max(best, total)
    return best


def _each(items, work, types: dict[str, pa.DataType]):
    """Index rows to the rows that ``work`` gives for a shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                rows = list(work(items.value, b, r))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t or b.column(0).type.value_type) for c, t in zip(zip(*rows, strict=True), types.values(), strict=True)], names=list(types))

    return run


def _frequencies(items: Items, b: pa.RecordBatch, r: int) -> Iterator[tuple[int, int]]:
    term, df = np.frombuffer(b.column(0)[r].as_py(), dtype=np.uint64), np.frombuffer(b.column(1)[r].as_py(), dtype=np.int32)
    if len(term):
        at = np.minimum(np.searchsorted(term, items.terms), len(term) - 1)
        on = np.flatnonzero(term[at] == items.terms)
        yield from zip(on.tolist(), df[at[on]].tolist(), strict=True)


def leaked_items(
    spark: SparkSession, corpus: DataFrame | None, key: str, text: str, tests: DataFrame, test_key: str, test_text: str,
    share: float = 0.5, min_words: int = 8, shard_chars: int = 2_000_000, items_per_pass: int = 20_000, bytes_per_pass: int = 50_000_000, index: DataFrame | None = None,
) -> DataFrame:
    """(key, test_key, share): documents that hold at least ``share`` of a test item's words in one place. ``index`` is one that was
    built before; without it one is built for this call."""
    if index is None:
        index = build_index(corpus, key, text, f"{Scratch(spark, 'leaks').base}/index", shard_chars)
    kind = index.schema["docs"].dataType.elementType
    schema = T.StructType([T.StructField("doc", kind), T.StructField("item", T.LongType()), T.StructField("share", T.DoubleType())])
    told = tests.where(F.col(test_text).isNotNull()).select(F.col(test_key).cast("bigint").alias("i"), F.col(test_text).alias("t")).distinct()
    n, size = told.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()
    passes = max(1, -(-n // items_per_pass), -(-2 * size // bytes_per_pass))
    out = None
    for k in range(passes):
        rows = told.where(F.pmod(F.xxhash64("i"), F.lit(passes)) == k).orderBy("i", "t").toArrow()
        items = Items(rows.column(0).to_pylist(), rows.column(1).to_pylist())
        sent = spark.sparkContext.broadcast(items)
        df = np.zeros(len(items.terms), dtype=np.int64)
        seen = index.select("term", "df").mapInArrow(_each(sent, _frequencies, {"term": pa.int32(), "n": pa.int64()}), "term int, n bigint").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
        df[seen.column(0).to_numpy()] = seen.column(1).to_numpy()
        items.choose(df)
        seeded = spark.sparkContext.broadcast(items)
        look = lambda it, b, r: Shard(b.column(0)[r].values, [b.column(c)[r].as_py() for c in range(1, len(INDEX))], it).found(share, min_words)
        one = index.select(*INDEX).mapInArrow(_each(seeded, look, {"doc": None, "item": pa.int64(), "share": pa.float64()}), schema)
        out = one if out is None else out.unionAll(one)
    return out.groupBy("doc", "item").agg(F.max("share").alias("share")).select(F.col("doc").alias(key), F.col("item").alias(test_key), "share")
