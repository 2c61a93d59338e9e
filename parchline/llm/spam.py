"""Pages made of keywords, links or product tags.

A page is cut into units at line feeds and stops, after its links, anchors and tags are taken out. Lines of numbers, codes or
dot leaders are data. Over the word tokens of all other units the page's suffix automaton is built, on every page. A state of it
is the set of places where some substrings end; sorting all prefixes of a unit from their ends backwards brings the places
of every state together, so a state is a run in that order, its length is the least common length in the run, its occurrences
are the size of the run, and the words before and after it are what the run's places are told apart by. The pages of a
batch are sorted at once, in as many rounds as the logarithm of the longest unit.

The automaton decides twice:

1. Clauses. A unit that is built like a sentence is a clause, unless it is stuffed: half of its words lie in states that occur
   twice in the unit, or in free phrases of the page: states of two to four words that stand between at least three
   different words on either side, and one more for each hundred sentences. Words that only repeat with the whole
   sentence around them, as in manuals, are not free; a sentence that comes again as a whole is judged once.
2. Coverage. Where clause structure is missing, the characters covered by repeated maximal substrings of at least two words
   count, and those of links and tags. A page is spam if these make up more than half of its visible characters.

Defined results: null, empty and blank texts are no spam and have a share of 0; repeated rows are judged each.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parchline.llm.units import parts

_ANCHOR = re.compile(r"<a\s[^>]*>.*?(?:</a>|$)|<[a-z/][^>]*>", re.I | re.S)
_LINK = re.compile(r"(?:https?://|ftp://|www\.)\S+", re.I)
_TAG = re.compile(r"(?:(?<=\s)|^)[#＃]\w+")

_PLANES = range(0x20000)  # what lies above is ideographs
_ALNUM = np.fromiter((chr(c).isalnum() for c in _PLANES), dtype=bool, count=len(_PLANES))
_SPACE = np.fromiter((chr(c).isspace() for c in _PLANES), dtype=bool, count=len(_PLANES))
_DIGIT = np.fromiter((chr(c).isdigit() for c in _PLANES), dtype=bool, count=len(_PLANES))
_STOPS, _JOINS = [ord(c) for c in ".!?。"], [ord(c) for c in "-'’"]
_PRIME = np.uint64(0x100000001B3)
_BACK = np.uint64(pow(0x100000001B3, -1, 1 << 64))

SHARES = ("clause_share", "data_share", "cover_share", "link_share", "repeat_share", "spam_share")
SCHEMA = T.StructType([T.StructField(n, T.DoubleType()) for n in SHARES] + [T.StructField("is_spam", T.BooleanType())])


def _bare(text: str) -> tuple[str, int]:
    """The text in lower case with a mark for each link, anchor and tag, and the visible characters of these."""
    links = 0

    def take(m: re.Match) -> str:
        nonlocal links
        links += len("".join(m.group().split()))
        return "\x00"

    if "<" in text:
        text = _ANCHOR.sub(take, text)
    if "://" in text or "www." in text.lower():
        text = _LINK.sub(take, text)
    if "#" in text or "＃" in text:
        text = _TAG.sub(take, text)
    return text.lower(), links


def _hashes(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Polynomial hash of each stretch of ``values``, modulo 2^64."""
    n = len(values)
    power = np.full(n + 1, _PRIME, dtype=np.uint64)
    power[0] = 1
    np.cumprod(power, out=power)
    run = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((values.astype(np.uint64) + np.uint64(1)) * power[:-1], out=run[1:])
    power[1:] = _BACK
    np.cumprod(power, out=power)
    h = (run[end] - run[start]) * power[start]
    h ^= h >> np.uint64(29)
    return h * np.uint64(0x9E3779B97F4A7C15)


@dataclass
class Cut:
    """Units of the pages of a batch. ``page``, ``size`` (visible characters), ``words``, ``data`` and ``sentence`` are per unit;
    ``unit``, ``length`` and ``word`` (a hash) are per word token, in order."""

    page: np.ndarray
    size: np.ndarray
    words: np.ndarray
    data: np.ndarray
    sentence: np.ndarray
    unit: np.ndarray
    length: np.ndarray
    word: np.ndarray


def cut(texts: list[str]) -> Cut:
    """Bare texts to units, by array operations over the code points of the whole batch."""
    c = np.frombuffer("".join(t + "\n" for t in texts).encode("utf-32-le"), dtype=np.uint32)
    flat = np.minimum(c, 0x1FFFF)
    high = c > 0x1FFFF
    alnum, space = _ALNUM[flat] | high, _SPACE[flat]
    join = (c == _JOINS[0]) | (c == _JOINS[1]) | (c == _JOINS[2])
    join[1:-1] &= alnum[:-2] & alnum[2:]
    join[[0, -1]] = False
    inside = alnum | join
    stop = (c == _STOPS[0]) | (c == _STOPS[1]) | (c == _STOPS[2]) | (c == _STOPS[3])
    after = np.append(space[1:], True)
    ends = (c == 10) | (stop & after) | (c == _STOPS[3])
    unit_of = np.cumsum(ends) - ends
    n = int(unit_of[-1]) + 1
    first = np.flatnonzero(np.append(True, ends[:-1]))
    per = lambda flags: np.add.reduceat(flags, first, dtype=np.int64)
    size, wide = per(~space & (c != 0)), per((c >= 0x3040) & (c <= 0x9FFF))
    dot = c == 46
    leader = per(np.append(dot[:-3] & dot[1:-2] & dot[2:-1] & dot[3:], [False] * 3) if len(c) > 3 else np.zeros(len(c), dtype=bool)) > 0
    last = np.maximum.accumulate(np.where(space, -1, np.arange(len(c))))[np.append(first[1:], len(c)) - 1]
    stopped = (last >= first) & stop[np.maximum(last, 0)]
    edge = np.flatnonzero(np.diff(inside.astype(np.int8), prepend=np.int8(0)))  # the batch ends in a line feed
    start, end = edge[0::2], edge[1::2]
    unit = unit_of[start]
    digits = np.append(0, np.cumsum(_DIGIT[flat]))
    words = np.bincount(unit, minlength=n)
    codes = np.bincount(unit, weights=digits[end] > digits[start], minlength=n)
    length = np.array([len(t) + 1 for t in texts], dtype=np.int64)
    page = np.repeat(np.arange(len(texts)), length)[first]
    data = leader | (codes * 4 > words) | (words == 0)
    return Cut(page, size, words, data, ~data & stopped & ((words >= 4) | (wide >= 6)), unit, end - start, _hashes(c, start, end))


class Automaton:
    """The suffix automata of the pages of a batch over (page, unit, word) tokens: ``order`` is the tokens' places sorted by page and
    then by the words of their unit that end there, read backwards."""

    def __init__(self, page: np.ndarray, unit: np.ndarray, word: np.ndarray):
        n = len(word)
        lead = np.append(True, unit[1:] != unit[:-1]) if n else np.zeros(0, dtype=bool)
        at = np.arange(n)
        self.depth = at - np.maximum.accumulate(np.where(lead, at, 0)) + 1  # words from the unit's start to here
        self.code = np.unique(word, return_inverse=True)[1].astype(np.int64)
        _, rank = np.unique(page * (int(self.code.max(initial=0)) + 1) + self.code, return_inverse=True)
        self.rank = [rank.astype(np.int64)]
        step, most = 1, int(self.depth.max(initial=0))
        while step < most:  # 0 where the unit does not reach back so far
            last = self.rank[-1]
            before = np.where(self.depth > step, last[np.maximum(at - step, 0)] + 1, 0)
            self.rank.append(np.unique(last * (n + 1) + before, return_inverse=True)[1].astype(np.int64))
            step *= 2
        self.order = np.argsort(self.rank[-1], kind="stable")

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many words before and at the places ``a`` and ``b`` are alike, within their units."""
        most = np.minimum(self.depth[a], self.depth[b])
        out = np.zeros(len(a), dtype=np.int64)
        for k in range(len(self.rank) - 1, -1, -1):
            fits = out + (1 << k) <= most
            r = self.rank[k]
            out += np.where(fits & (r[np.maximum(a - out, 0)] == r[np.maximum(b - out, 0)]), 1 << k, 0)
        return out

    def longest(self, among: np.ndarray) -> np.ndarray:
        """For every place of the mask ``among`` the length of the longest substring that ends there and at another such place."""
        out = np.zeros(len(self.depth), dtype=np.int64)
        on = self.order[among[self.order]]
        if len(on) > 1:
            shared = self.common(on[:-1], on[1:])
            out[on[:-1]] = shared
            out[on[1:]] = np.maximum(out[on[1:]], shared)
        return out

    def covered(self, among: np.ndarray, least: int = 2) -> np.ndarray:
        """Which tokens lie in a substring of at least ``least`` words that ends at two of the places ``among``."""
        size = self.longest(among)
        at = np.flatnonzero(size >= least)
        return _marked(len(size), at - size[at] + 1, size[at])

    def phrases(self, among: np.ndarray, unit: np.ndarray, need: np.ndarray, sizes: tuple[int, ...] = (2, 3, 4)) -> np.ndarray:
        """Which tokens lie in a pair of words that their unit has twice, or in a state of one of ``sizes`` words with at least
        ``need`` (of its places) different words on either side; only places of the mask ``among`` are looked at."""
        n = len(self.depth)
        hit = np.zeros(n, dtype=bool)
        on = self.order[among[self.order]]
        if not len(on):
            return hit
        shared = np.append(0, self.common(on[:-1], on[1:]))
        follows = np.append(np.where(unit[1:] == unit[:-1], self.code[1:] + 1, 0), 0)  # 0: the unit's end
        for size in sizes:
            state = np.cumsum(shared < size)  # a run for each substring of this length
            fits = self.depth[on] >= size
            here, run = on[fits], state[fits]
            if not len(here):
                break
            if size == 2:  # any longer repeat within a unit consists of repeated pairs
                _, own, times = np.unique(run * (int(unit.max()) + 1) + unit[here], return_inverse=True, return_counts=True)
                twice = here[times[own] > 1]
                hit |= _marked(n, twice - 1, np.full(len(twice), 2))
            # the places of a run that have the same word before stand together, first those at a unit's start
            ahead = self.depth[here] > size
            lead = np.append(True, (run[1:] != run[:-1]) | ((shared[fits][1:] <= size) & ahead[1:]))
            tops = state[-1] + 1
            before = np.bincount(run[lead], minlength=tops)
            sides = np.unique(run * (int(self.code.max()) + 2) + follows[here])
            behind = np.bincount(sides // (int(self.code.max()) + 2), minlength=tops)
            free = here[(before[run] >= need[here]) & (behind[run] >= need[here])]
            hit |= _marked(n, free - size + 1, np.full(len(free), size))
        return hit


def _marked(n: int, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    step = np.bincount(start, minlength=n + 1) - np.bincount(start + size, minlength=n + 1)
    return np.cumsum(step[:n]) > 0


def score(column: pa.Array, limit: float = 0.5) -> list[pa.Array]:
    """The columns of ``SCHEMA`` for a batch of texts."""
    n = len(column)
    bare = [_bare(t or "") for t in column.to_pylist()]
    links = np.array([b[1] for b in bare], dtype=float)
    u = cut([b[0] for b in bare]) if n else None
    shares = np.zeros((n, len(SHARES)))
    if n:
        total = np.bincount(u.page, weights=u.size, minlength=n) + links
        # every different unit of a page once, without data
        live = ~u.data[u.unit]
        unit, word, length = u.unit[live], u.word[live], u.length[live]
        lead = np.flatnonzero(np.append(True, unit[1:] != unit[:-1])) if len(unit) else np.zeros(0, dtype=np.int64)
        key = _hashes(word ^ (word >> np.uint64(32)), lead, np.append(lead[1:], len(unit))) if len(unit) else np.zeros(0, dtype=np.uint64)
        units = unit[lead]
        key = (key ^ u.page[units].astype(np.uint64)) * _PRIME + u.page[units].astype(np.uint64) * np.uint64(2) + u.sentence[units]
        _, first, same, times = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
        own = np.zeros(len(units), dtype=bool)
        own[first] = True
        size = np.diff(np.append(lead, len(unit)))
        pick = np.repeat(own, size)
        t_unit, t_word, t_length = unit[pick], word[pick], length[pick].astype(float)
        t_page, t_sentence = u.page[t_unit], u.sentence[t_unit]
        sa = Automaton(t_page, t_unit, t_word)
        need = (3 + np.bincount(u.page[units[own & u.sentence[units]]], minlength=n) // 100)[t_page]
        hit = sa.phrases(t_sentence, t_unit, need)
        stuffed = np.bincount(t_unit, weights=hit, minlength=len(u.page)) * 2 >= np.maximum(u.words, 1)
        clause = u.sentence & ~stuffed
        # the copies of a unit are what the first one is
        judge = np.zeros(len(u.page), dtype=bool)
        judge[units] = clause[units[first][same]]
        # marks between words count with the last one
        tail = np.append(t_unit[1:] != t_unit[:-1], True) if len(t_unit) else np.zeros(0, dtype=bool)
        t_length[tail] += (u.size[t_unit] - np.bincount(t_unit, weights=t_length, minlength=len(u.page))[t_unit])[tail]
        again = np.zeros(len(u.page), dtype=np.int64)
        again[units] = times[same]

        def characters(covered: np.ndarray, among: np.ndarray) -> np.ndarray:
            """Per page, of the units ``among``: all characters of those that come again, else the covered ones."""
            part = np.zeros(len(u.page))
            part[units] = np.bincount(t_unit, weights=t_length * covered, minlength=len(u.page))[units[first][same]]
            part = np.where((again > 1) & (u.words >= 2), u.size, part)
            return np.bincount(u.page[among], weights=part[among], minlength=n)

        loose = ~u.data & ~judge & (u.words > 0)
        repeat = characters(sa.covered(loose[t_unit]), loose)
        cover = characters(sa.covered(np.ones(len(t_unit), dtype=bool)), ~u.data & (u.words > 0))
        count = lambda mask: np.bincount(u.page[mask], weights=u.size[mask], minlength=n)
        shares = np.stack([count(judge), count(u.data), cover, links, repeat, links + repeat], axis=1) / np.maximum(total, 1)[:, None]
    return [*[pa.array(shares[:, k]) for k in range(len(SHARES))], pa.array(shares[:, -1] > limit)]


def keyword_pages(df: DataFrame, key: str, text: str, limit: float = 0.5) -> DataFrame:
    """(key, clause_share, data_share, cover_share, link_share, repeat_share, spam_share, is_spam) of every row. ``cover_share`` is
    what repeated substrings cover of the whole page, ``repeat_share`` what they cover outside clauses."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (x for whole in batches for x in parts(whole, 1, 1 << 20)):
            yield pa.RecordBatch.from_arrays([b.column(0), *score(b.column(1), limit)], names=["key", *SCHEMA.names])

    schema = T.StructType([T.StructField("key", df.schema[key].dataType), *SCHEMA.fields])
    return df.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, schema).withColumnRenamed("key", key)
