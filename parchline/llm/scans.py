"""Text of scanned pages repaired into paragraphs.

Every line is labelled header, body, footer or break by a hidden Markov model: header, body and footer can only follow one
another from the top of a page to its bottom, breaks (blank lines) stand within and between them. The emissions are
layout features: shape of the line, width, distance from the edges, and whether the line comes back on other pages of the copy or
its number runs with the pages. Shapes and recurrence have a table for lines near an edge and one for the others. The emissions start
from a written table and are refitted by Viterbi training on a bounded sample of pages. Pages of a batch are labelled at once.

Words come from a lexicon of all pages. A line that ends in a hyphen goes on in the next body line, if need be of the
next page; the hyphen stays if the hyphenated form is the one that occurs within lines. A word is misread if undoing one or
two letter confusions gives a word that is many times as frequent. Paragraphs that go on on the next page are put together, over any
number of pages.

Pages meet only by (copy, page) and (copy, line), never by copy, so a copy with a third of the pages is no hot key;
what is broadcast is the model and the ``known_words`` most frequent words; rarer words, as misread forms and as targets, are joined.

Defined results: null and empty texts have no lines; texts whose lines are not broken at a page width are not scans, whatever
``text_origin`` says, and are left as they are; repeated pages count once; a last hyphen without a next page counts as divided.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parchline.session import Scratch

HYPHENS = "-\u2010\u00ad\u00ac"
_DIVIDED = re.compile(rf"(?<!\S)\S*\w[{HYPHENS}][ \t]*\n\s*\S*")
_WORD = re.compile(r"[\w@]+(?:[-'’][\w@]+)*")
_TAIL = re.compile(rf"([\w@]+(?:[-'’][\w@]+)*)[{HYPHENS}]\s*$")
_FIRST = re.compile(r"\s*[^\w@\s]?([\w@]+(?:[-'’][\w@]+)*)")

# fixed values: letter shapes that recognition mistakes, as read -> as printed
CONFUSED = [
    ("0", "o"), ("1", "l"), ("1", "i"), ("5", "s"), ("9", "g"), ("8", "b"), ("6", "b"), ("@", "a"), ("l", "i"), ("i", "l"), ("c", "e"), ("e", "c"), ("f", "t"), ("b", "h"), ("h", "b"), ("y", "v"),
    ("rn", "m"), ("m", "rn"), ("ri", "n"), ("n", "ri"), ("ii", "u"), ("u", "ii"), ("cl", "d"), ("d", "cl"), ("vv", "w"), ("w", "vv"), ("li", "h"), ("h", "li"),
]

SHAPES = ["number", "paged", "form", "chapter", "title", "heading", "row", "text"]
_NUMBER = re.compile(r"[-–—(\[\s]*(?:\d{1,5}|[ivxlc]{1,6})[-–—)\]\s]*$|\d{1,4}\s*(?:/|-|–|of|von|de|di|van)\s*\d{1,5}$")
_PAGED = re.compile(r"[^\W\d_]{1,8}\.?\s+\d{1,5}(?:\s*(?:/|of|von|sur|de|di|van)\s*\d{1,5})?$")
_FORM = re.compile(r"[^\d|·]{3,50}\s[|·•–—-]\s[^\d|·]{1,20}\s?\d[\w./-]*$")
_CHAPTER = re.compile(r"[^\W\d_]{3,12}\s+(?:\d{1,3}|[IVXLC]{1,6})(?:\s{2,}|:\s|\s[–—-]\s)\S")
_HEADING = re.compile(r"\d+(?:\.\d+)+\.?\s+\S")
_ROW = re.compile(r"\t|\S\s{3,}\S")
_PAGE_ENDS = re.compile(r"^\d{1,5}\s{2,}|\s{2,}\d{1,5}$")

HEAD, BODY, FOOT, BREAK = 0, 1, 2, 3
#: lines with fewer others between them and an edge of the page have tables of their own
NEAR = 3
#: refitted; counts of a written guess, shape by state
_GUESS = {
    HEAD: {"title": 8, "chapter": 8, "number": 1, "paged": 1, "form": 1, "row": 0.05, "heading": 0.05, "text": 0.02},
    BODY: {"title": 0.15, "chapter": 0.05, "number": 0.2, "paged": 0.1, "form": 0.02, "row": 2, "heading": 1, "text": 16},
    FOOT: {"title": 0.3, "chapter": 0.1, "number": 8, "paged": 6, "form": 6, "row": 0.02, "heading": 0.02, "text": 0.01},
}


def shape_of(line: str, width: int) -> str:
    s = line.strip()
    if _NUMBER.match(s):
        return "number"
    if len(s) <= 70:
        bare = _PAGE_ENDS.sub("", s)
        if _CHAPTER.match(s) and s[-1] not in ".,;:":
            return "chapter"
        if _HEADING.match(s):
            return "heading"
        if _FORM.match(s):
            return "form"
        if _PAGED.match(s):
            return "paged"
        words = re.findall(r"[^\W\d_][\w@'’-]*", bare)
        if 2 <= len(words) <= 9 and bare[-1] not in ".,;:!?-‐" and not _ROW.search(bare) and sum(map(len, words)) * 1.2 >= len(bare.replace(" ", "")):
            upper = sum(w[0].isupper() for w in words)
            if upper >= 0.75 * len(words) or (words[0][0].isupper() and upper >= 2 and len(bare) <= 0.75 * width and len(words) <= 6):
                return "title"
    return "row" if _ROW.search(s) else "text"


def is_scan(lines: list[str], widest: int = 110) -> bool:
    """Lines broken at a page width: most of the text stands in lines that are not longer."""
    long = sum(len(x) for x in lines if len(x) > widest)
    return 2 * long < sum(map(len, lines))


def _skeleton(line: str) -> str:
    return re.sub(r"\d+", "#", re.sub(r"[\W_]+", " ", line.lower())).strip()


def _line_key(line: str, shape: str, index: int, upper: bool) -> int:
    """What would come back on other pages of the copy, in the same half of the page: a line that looks like furniture without its
    numbers, any other with them (rows of one table are alike without); of page numbers the distance from the page's index."""
    number = re.search(r"\d+", line) if shape in ("number", "paged") else None
    same = line if shape in ("row", "heading", "text") else _skeleton(line)
    key = f"{'^' if upper else '_'}{same}" + (f":{int(number.group()) - index}" if number else "")
    return int.from_bytes(hashlib.blake2b(key.encode(), digest_size=8).digest(), "little", signed=True)


_WORDS_AT = T.ArrayType(T.StructType([T.StructField("line", T.IntegerType()), T.StructField("word", T.StringType())]))
#: ``line``, ``feature``, ``key`` and ``first`` (the first word) have an entry for each line with text
PAGE = T.StructType(
    [
        T.StructField("page_id", T.StringType()), T.StructField("copy_id", T.StringType()), T.StructField("pdf_index", T.IntegerType()),
        T.StructField("line", T.ArrayType(T.IntegerType())), T.StructField("feature", T.ArrayType(T.IntegerType())), T.StructField("key", T.ArrayType(T.LongType())),
        T.StructField("first", T.ArrayType(T.StringType())), T.StructField("tails", _WORDS_AT), T.StructField("rare", _WORDS_AT),
    ]
)


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: Counter[str] = Counter()
    for b in batches:
        for t in b.column(0).to_pylist():
            seen.update(_WORD.findall(_DIVIDED.sub(" ", t).lower()))
    rows = [(w, n) for w, n in seen.items() if not w.isdigit()]
    for at in range(0, len(rows), 100_000):
        w, n = zip(*rows[at : at + 100_000], strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(w, pa.string()), pa.array(n, pa.int64())], names=["word", "n"])


def lexicon(pages: DataFrame, text: str) -> DataFrame:
    """(word, n): words that stand within lines, in lower case."""
    return pages.select(text).mapInArrow(_count_words, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


TIMES, LEAST = 20, 5


def _undo(word: str) -> set[str]:
    """The word with one confusion undone."""
    out = set()
    for read, printed in CONFUSED:
        at = word.find(read)
        while at >= 0:
            out.add(word[:at] + printed + word[at + len(read) :])
            at = word.find(read, at + 1)
    return out


def _undone(word: str) -> tuple[set[str], set[str]]:
    """The forms that ``word`` may be a misreading of, by one and by two confusions."""
    digits = sum(map(str.isdigit, word))
    if len(word) < 3 or 2 * digits >= len(word):
        return set(), set()
    once = _undo(word)
    return once, {c for w in once for c in _undo(w) if c != word} if len(word) > 5 else set()


def correction(word: str, n: int, known: dict[str, int], times: int = TIMES) -> str | None:
    """The word that ``word`` is a misreading of, by one or else two confusions: the most frequent one, at least
    ``times`` as frequent as the word itself, however frequent that is."""
    for forms in _undone(word):
        best = max(((known[c], c) for c in forms if c in known), default=None)
        if best:
            return best[1] if best[0] >= times * n and best[0] >= LEAST else None
    return None


def _corrections(known: dict[str, int], floor: int = -1):
    """``floor`` from 0: only the words that have a form with one confusion undone above that count in ``known``."""
    mine = lambda w: floor < 0 or any(known.get(c, 0) > floor for c in _undone(w)[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(w, c) for w, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) if (c := correction(w, n, known)) and mine(w)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.string()) for k in (0, 1)], names=["word", "correct"])

    return run


def _open_forms(known: dict[str, int]):
    """(word, n, confusions, form) of the words that the lexicon's head ``known`` doesn't decide: none of its words above the
    cut is one confusion away."""
    floor = min(known.values(), default=0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for w, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                once, twice = _undone(w)
                if not any(known.get(c, 0) > floor for c in once):
                    rows += [(w, n, 1, c) for c in once] + [(w, n, 2, c) for c in twice]
            types = [pa.string(), pa.int64(), pa.int32(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=["word", "n", "confusions", "form"])

    return run


def corrections(seen: DataFrame, known: dict[str, int], whole: bool) -> DataFrame:
    """(word, correct) of a lexicon. ``known`` is its head; if that isn't the whole of the words with n >= LEAST, the forms of
    the words that it doesn't decide are joined with all of them."""
    if whole:
        return seen.mapInArrow(_corrections(known), "word string, correct string")
    forms = seen.mapInArrow(_open_forms(known), "word string, n bigint, confusions int, form string")
    target = seen.where(F.col("n") >= LEAST).select(F.col("word").alias("form"), F.col("n").alias("m"))
    best = forms.join(target, "form").groupBy("word", "n").agg(F.max(F.struct(F.negative("confusions").alias("near"), "m", "form")).alias("b"))
    joined = best.where(F.col("b.m") >= TIMES * F.col("n")).select("word", F.col("b.form").alias("correct"))
    return seen.mapInArrow(_corrections(known, min(known.values(), default=0)), "word string, correct string").unionByName(joined)


def _page_rows(good: frozenset[str]):
    """Texts to ``PAGE``: the features of lines and the words that matter, without the text."""

    def one(key: str, copy: str, index: int | None, text: str) -> tuple | None:
        lines = text.split("\n")
        if not is_scan(lines):
            return None
        full = [i for i, x in enumerate(lines) if x.strip()]
        if not full:
            return None
        width = max(len(lines[i].rstrip()) for i in full)
        n = len(full)
        feature, keys, firsts, tails, rare = [], [], [], [], []
        after_tail = False
        for k, i in enumerate(full):
            line = lines[i]
            shape = shape_of(line, width)
            feature.append(SHAPES.index(shape) * 2 + (len(line.rstrip()) < 0.75 * width))
            keys.append(_line_key(line.strip(), shape, index or 0, 2 * k < n))
            tail = _TAIL.search(line) if line.rstrip()[-1] in HYPHENS else None
            if tail and not tail.group(1)[-1].isdigit():
                tails.append({"line": i + 1, "word": tail.group(1)})
            first = _FIRST.match(line)
            firsts.append(first.group(1) if first else None)
            words = _WORD.findall(line.lower())
            if tail:
                words = words[:-1]
            if after_tail:
                words = words[1:]
            rare.extend({"line": i + 1, "word": w} for w in sorted({w for w in words if w not in good and len(w) > 2 and not w.isdigit()}))
            after_tail = bool(tail)
        return key, copy, index, [i + 1 for i in full], feature, keys, firsts, tails, rare

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = pa.list_(pa.struct([("line", pa.int32()), ("word", pa.string())]))
        types = [pa.string(), pa.string(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.string()), pair, pair]
        for b in batches:
            rows = [r for x in zip(*[c.to_pylist() for c in b.columns], strict=True) if (r := one(*x)) is not None]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=PAGE.names)

    return run


class LineModel:
    """The hidden Markov model. A line's observation is its (shape, short), its distance from either edge (0, 1, further), and
    whether it comes back in the copy; a blank line is observed as such and is a break."""

    STAY, NEXT, SKIP = 0.0, -0.7, -4.0

    def __init__(self) -> None:
        shape = np.zeros((3, 2 * len(SHAPES)))
        for state, row in _GUESS.items():
            for s, v in row.items():
                shape[state, 2 * SHAPES.index(s)] = v * (0.2 if state != BODY else 0.8)
                shape[state, 2 * SHAPES.index(s) + 1] = v * (0.8 if state != BODY else 0.2)
        # P(distance from the top, from the bottom | state) and P(comes back | state)
        self.top = np.array([[0.9, 0.09, 0.01], [0.05, 0.06, 0.89], [0.01, 0.02, 0.97]])
        self.bottom = np.array([[0.01, 0.02, 0.97], [0.05, 0.06, 0.89], [0.9, 0.09, 0.01]])
        self.shape = np.stack([shape, shape])  # near an edge, and not
        self.again = np.stack([np.array([[0.4, 0.6], [0.98, 0.02], [0.4, 0.6]])] * 2)
        self._norm()

    def _norm(self) -> None:
        self.shape = (self.shape + 1e-3) / (self.shape + 1e-3).sum(axis=2, keepdims=True)
        self.again = self.again / self.again.sum(axis=2, keepdims=True)
        self.log = [np.log(x) for x in (self.shape, self.top, self.bottom, self.again)]

    @staticmethod
    def places(size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of pages of ``size`` lines with text: each line's number from the top and from the bottom, and whether it is far from both."""
        start = np.cumsum(size) - size
        up = np.arange(int(size.sum())) - np.repeat(start, size)
        down = np.repeat(size, size) - 1 - up
        return up, down, (np.minimum(up, down) >= NEAR).astype(np.int64)

    def label(self, size: np.ndarray, feature: np.ndarray, again: np.ndarray) -> np.ndarray:
        """Viterbi over all lines with text of many pages at once: pages of ``size`` lines after one another. States may stay or go on
        from header to body to footer, at a line or over a break alike, so breaks take no step of their own."""
        if not len(feature):
            return np.zeros(0, dtype=np.int8)
        up, down, far = self.places(size)
        emit = self.log[0][far, :, feature] + self.log[3][far, :, again]
        few = np.repeat(size, size) <= 2  # with one or two lines the edges say nothing
        emit += np.where(few[:, None], 0, self.log[1][:, np.minimum(up, 2)].T + self.log[2][:, np.minimum(down, 2)].T)
        order = np.argsort(-size, kind="stable")
        start, length = (np.cumsum(size) - size)[order], size[order]
        back = np.zeros((len(feature), 3), dtype=np.int8)
        score = np.array([0.0, -0.5, -6.0]) + emit[start]
        for t in range(1, int(length[0])):
            on = int(np.searchsorted(-length, -t, side="left"))  # pages that reach so far
            at, s = start[:on] + t, score[:on]
            body = np.stack([s[:, 0] + self.NEXT, s[:, 1] + self.STAY], axis=1)
            foot = np.stack([s[:, 0] + self.SKIP, s[:, 1] + self.NEXT, s[:, 2] + self.STAY], axis=1)
            back[at, 1], back[at, 2] = body.argmax(axis=1), foot.argmax(axis=1)
            score[:on] = np.stack([s[:, 0] + self.STAY, body.max(axis=1), foot.max(axis=1)], axis=1) + emit[at]
        out = np.zeros(len(feature), dtype=np.int8)
        state = score.argmax(axis=1)
        for t in range(int(length[0]) - 1, -1, -1):
            on = int(np.searchsorted(-length, -t, side="left"))
            at = start[:on] + t
            out[at] = state[:on]
            if t:
                state[:on] = back[at, state[:on]]
        return out

    def refit(self, size: np.ndarray, feature: np.ndarray, again: np.ndarray, rounds: int = 2, prior: float = 20.0) -> "LineModel":
        """Viterbi training: the emissions become those of all lines as they are labelled, with the guess as a prior."""
        _, _, far = self.places(size)
        for _ in range(rounds):
            shape, back = self.shape * prior, self.again * prior
            state = self.label(size, feature, again)
            np.add.at(shape, (far, state, feature), 1)
            np.add.at(back, (far, state, again), 1)
            self.shape, self.again = shape, back
            self._norm()
        return self


def _observed(lines: list[list[int]], features: list[list[int]], back: list[list[int] | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(size, feature, again) of pages whose lines at the places ``back`` come back in the copy."""
    size = np.array([len(x) for x in lines], dtype=np.int64)
    feature = np.array([v for f in features for v in f], dtype=np.int64)
    again = np.zeros(len(feature), dtype=np.int64)
    for start, at in zip((np.cumsum(size) - size).tolist(), back, strict=True):
        if at:
            again[np.array(at) + start] = 1
    return size, feature, again


LABELLED = T.StructType(
    [
        T.StructField("page_id", T.StringType()), T.StructField("copy_id", T.StringType()), T.StructField("pdf_index", T.IntegerType()), T.StructField("furniture", T.ArrayType(T.IntegerType())),
        T.StructField("tails", T.ArrayType(T.StructType([T.StructField("line", T.IntegerType()), T.StructField("left", T.StringType()), T.StructField("right", T.StringType())]))),
        T.StructField("head", T.StringType()), T.StructField("rare", _WORDS_AT),
    ]
)


def _label_rows(model: LineModel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = pa.list_(pa.struct([("line", pa.int32()), ("word", pa.string())]))
        trio = pa.list_(pa.struct([("line", pa.int32()), ("left", pa.string()), ("right", pa.string())]))
        for b in batches:
            out: list[list] = [[] for _ in LABELLED]
            rows = b.to_pylist()
            size, feature, again = _observed([r["line"] for r in rows], [r["feature"] for r in rows], [r["back"] for r in rows])
            state = model.label(size, feature, again).tolist()
            at = 0
            for r in rows:
                lines, states = r["line"], state[at : at + len(r["line"])]
                at += len(lines)
                body = [k for k, s in enumerate(states) if s == BODY]
                off = {x for x, s in zip(lines, states, strict=True) if s != BODY}
                follow = {lines[a]: r["first"][z] for a, z in zip(body, body[1:], strict=False)}
                tails = [{"line": t["line"], "left": t["word"], "right": follow.get(t["line"])} for t in r["tails"] if t["line"] not in off]
                row = (r["page_id"], r["copy_id"], r["pdf_index"], sorted(off), tails, r["first"][body[0]] if body else None, [w for w in r["rare"] if w["line"] not in off] if off else r["rare"])
                for col, v in zip(out, row, strict=True):
                    col.append(v)
            types = [pa.string(), pa.string(), pa.int32(), pa.list_(pa.int32()), trio, pa.string(), pair]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names=LABELLED.names)

    return run


def line_states(model: LineModel, text: str, index: int = 0, back: list[int] | None = None) -> list[int]:
    """The states of all lines of one page, breaks among them."""
    lines = text.split("\n")
    full = [i for i, x in enumerate(lines) if x.strip()]
    width = max((len(lines[i].rstrip()) for i in full), default=0)
    feature = [SHAPES.index(shape_of(lines[i], width)) * 2 + (len(lines[i].rstrip()) < 0.75 * width) for i in full]
    out = [BREAK] * len(lines)
    for i, s in zip(full, model.label(*_observed([full], [feature], [back])).tolist(), strict=True):
        out[i] = s
    return out


class ScanRepair:
    """Frames: ``labelled`` (per page: furniture lines, divided line ends, rare words), ``words`` (word, correct), ``hyphens``
    (page_id, line_no, left, right)."""

    def __init__(self, spark: SparkSession, pages: DataFrame, key: str, copy: str, index: str, text: str, known_words: int = 200_000, sample_pages: int = 2000):
        self.scratch = Scratch(spark, "scans")
        texts = pages.where(F.col(text).isNotNull() & (F.trim(text) != "")).select(F.col(key).alias("page_id"), F.col(copy).alias("copy_id"), F.col(index).cast("int").alias("pdf_index"), F.col(text).alias("text"))
        texts = self.texts = self.scratch.save(texts.distinct(), "texts")  # repeated deliveries once, for every count below
        self.words_seen = self.scratch.save(lexicon(texts, "text"), "lexicon")
        common = self.words_seen.where(F.col("n") >= LEAST)
        top = common.orderBy(F.desc("n"), "word").limit(known_words).toArrow()
        known = dict(zip(top.column(0).to_pylist(), top.column(1).to_pylist(), strict=True))
        self.words = self.scratch.save(corrections(self.words_seen, known, common.count() <= len(known)), "words")
        wrong = {r[0] for r in self.words.join(spark.createDataFrame([(w,) for w in known] or [("",)], "word string"), "word", "left_semi").select("word").collect()}
        rows = self.scratch.save(texts.mapInArrow(_page_rows(frozenset(known) - wrong), PAGE), "pages")
        seen_at = rows.select("page_id", "copy_id", F.posexplode("key").alias("k", "key"))
        often = seen_at.groupBy("copy_id", "key").agg(F.min("page_id").alias("least"), F.max("page_id").alias("most")).where("least < most").select("copy_id", "key")
        back = seen_at.join(often, ["copy_id", "key"], "left_semi").groupBy("page_id").agg(F.collect_set("k").alias("back"))
        flagged = rows.drop("key").join(back, "page_id", "left")
        n = rows.count()
        share = max(1, int(1_000_000 * min(1.0, sample_pages / max(n, 1))))
        few = flagged.where(F.pmod(F.xxhash64("page_id"), F.lit(1_000_000)) < share).select("line", "feature", "back").toArrow().to_pydict()
        model = LineModel().refit(*_observed(few["line"], few["feature"], few["back"]))
        self.labelled = self.scratch.save(flagged.mapInArrow(_label_rows(model), LABELLED), "labelled")

    def hyphens(self) -> DataFrame:
        """(page_id, line_no, left, right): line ends inside a word whose whole form has no hyphen there."""
        tails = self.labelled.select("page_id", "copy_id", "pdf_index", F.explode("tails").alias("t")).select("page_id", "copy_id", "pdf_index", F.col("t.line").alias("line_no"), "t.left", "t.right")
        heads = self.labelled.where("head IS NOT NULL").groupBy("copy_id", (F.col("pdf_index") - 1).alias("pdf_index")).agg(F.min("head").alias("head"))
        open_ends = tails.where("right IS NULL").join(heads, ["copy_id", "pdf_index"], "left").withColumn("right", F.col("head")).drop("head")
        ends = tails.where("right IS NOT NULL").select("page_id", "line_no", "left", "right").unionByName(open_ends.select("page_id", "line_no", "left", "right"))
        ends = ends.withColumn("joined", F.lower(F.concat("left", "right"))).withColumn("kept", F.lower(F.concat("left", F.lit("-"), "right")))
        pairs = ends.select("joined", "kept").where("joined IS NOT NULL").distinct()
        seen = self.words_seen
        counted = pairs.join(seen.select(F.col("word").alias("joined"), F.col("n").alias("n_joined")), "joined", "left").join(seen.select(F.col("word").alias("kept"), F.col("n").alias("n_kept")), "kept", "left")
        out = ends.join(counted, ["joined", "kept"], "left")
        # an end without a next page: a part that is known before hyphens is taken for one
        part = F.substring_index("word", "-", 1)
        fronts = seen.where("word LIKE '%-%'").groupBy(part.alias("front")).agg(F.sum("n").alias("n_front"))
        last = out.where("right IS NULL").join(fronts, F.lower("left") == F.col("front"), "left_anti")
        out = out.where("right IS NOT NULL").unionByName(last)
        whole = F.coalesce("n_joined", F.lit(0)) >= F.coalesce("n_kept", F.lit(0))
        letters = F.coalesce(F.col("right"), F.lit("a")).rlike(r"^[\p{Ll}@\d]") & ~F.coalesce(F.col("right"), F.lit("a")).rlike(r"^\d+$")
        return out.where(whole & (letters | (F.col("n_joined") > 0))).select("page_id", "line_no", "left", "right").distinct()

    def lines(self) -> DataFrame:
        """(page_id, line_no, kind) with kind furniture, hyphen or misread."""
        furniture = self.labelled.select("page_id", F.explode("furniture").alias("line_no"), F.lit("furniture").alias("kind"))
        divided = self.hyphens().select("page_id", "line_no", F.lit("hyphen").alias("kind"))
        odd = self.labelled.select("page_id", F.explode("rare").alias("r")).select("page_id", F.col("r.line").alias("line_no"), F.col("r.word").alias("word"))
        misread = odd.join(self.words, "word").select("page_id", "line_no", F.lit("misread").alias("kind"))
        return furniture.unionByName(divided).unionByName(misread).distinct()

    def _fragments(self) -> DataFrame:
        """The paragraphs of every page by itself: (page_id, copy_id, pdf_index, scan, number, text, begins, goes_on, glued): how surely it
        goes on from the page before, how open it is at the page's end (0 to 2 both, linked from 3 together), and whether within a word."""
        odd = self.labelled.select("page_id", F.explode("rare").alias("r")).select("page_id", F.col("r.line").alias("line"), F.col("r.word").alias("word")).join(self.words, "word")
        fixes = odd.groupBy("page_id").agg(F.collect_set(F.struct("line", "word", "correct")).alias("fixes"))
        closed = self.hyphens().groupBy("page_id").agg(F.collect_set("line_no").alias("closed"))
        plan = self.labelled.groupBy("page_id").agg(F.first("furniture").alias("furniture"))
        once = self.texts.groupBy("page_id").agg(F.min_by(F.struct("copy_id", "pdf_index", "text"), F.struct("text", "copy_id", "pdf_index")).alias("p")).select("page_id", "p.*")
        rows = once.join(plan, "page_id", "left").join(fixes, "page_id", "left").join(closed, "page_id", "left")
        schema = "page_id string, copy_id string, pdf_index int, scan boolean, number int, text string, begins int, goes_on int, glued boolean"

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            types = [pa.string(), pa.string(), pa.int32(), pa.bool_(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.bool_()]
            for b in batches:
                out: list[tuple] = []
                for r in b.to_pylist():
                    scan = r["furniture"] is not None
                    parts, begins, goes_on, glued = _reassemble(r["text"], set(r["furniture"] or []), r["fixes"] or [], set(r["closed"] or []))
                    n = len(parts)
                    out += [(r["page_id"], r["copy_id"], r["pdf_index"], scan, k + 1, p, begins if scan and not k else 0, goes_on if scan and k == n - 1 else 0, scan and k == n - 1 and glued) for k, p in enumerate(parts)]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(types)], names=[x.split()[0] for x in schema.split(", ")])

        return rows.mapInArrow(run, schema)

    def paragraphs(self) -> DataFrame:
        """(page_id, paragraph_no from 1, text, pages): scans in running paragraphs, other pages by their blank lines. A paragraph that
        goes on on the next page of its copy belongs to the page where it begins, and ``pages`` counts the pages that it is on."""
        parts = self.scratch.save(self._fragments(), "fragments")
        # of several rows for one page of a copy the one with the least id stands for it
        lead = parts.where("scan AND number = 1 AND copy_id IS NOT NULL AND pdf_index IS NOT NULL").groupBy("copy_id", "pdf_index").agg(F.min("page_id").alias("page_id"))
        ends = parts.where("goes_on > 0").join(lead, ["copy_id", "pdf_index", "page_id"]).select("copy_id", (F.col("pdf_index") + 1).alias("pdf_index"), F.col("page_id").alias("up"), F.col("number").alias("up_no"), "goes_on", F.col("glued").alias("inside"))
        starts = parts.where("number = 1").join(lead, ["copy_id", "pdf_index", "page_id"]).select("copy_id", "pdf_index", "page_id", "begins")
        links = starts.join(ends, ["copy_id", "pdf_index"]).where("begins > 0 AND begins + goes_on >= 3 OR inside")
        links = self.scratch.save(links.select("page_id", "up", "up_no", F.lit(1).alias("far"), "inside"), "links")
        # pointer jumping: over pages that are wholly within the paragraph
        active, done = links.drop("inside"), []
        known = active
        while True:
            look = known.select(F.col("page_id").alias("via"), F.col("up").alias("up2"), F.col("up_no").alias("no2"), F.col("far").alias("more"))
            # only a page's first paragraph can have come from the page before
            step = active.join(look, (F.col("up") == F.col("via")) & (F.col("up_no") == 1), "left").select(
                "page_id", F.coalesce("up2", "up").alias("up"), F.coalesce("no2", "up_no").alias("up_no"), (F.col("far") + F.coalesce("more", F.lit(0))).alias("far"), F.col("up2").isNotNull().alias("open")
            )
            step = self.scratch.save(step, "jump")
            done.append(step.where("NOT open").drop("open"))
            active = step.where("open").drop("open")
            if not active.head(1):
                break
            known = active
            for x in done:
                known = known.unionByName(x)
        heads = done[0]
        for x in done[1:]:
            heads = heads.unionByName(x)
        heads = heads.join(links.select("page_id", "inside"), "page_id")
        onward = links.select(F.col("up").alias("page_id"), F.col("up_no").alias("number"), F.lit(True).alias("linked"))
        moved = parts.join(heads, "page_id", "left").join(onward, ["page_id", "number"], "left")
        first = (F.col("number") == 1) & F.col("up").isNotNull()
        whole = F.concat("text", F.when(F.col("glued") & F.col("linked").isNull() & ~F.col("text").rlike(f"[{HYPHENS}]$"), "-").otherwise(""))
        placed = self.scratch.save(
            moved.select(
                F.when(first, F.col("up")).otherwise(F.col("page_id")).alias("page_id"),
                # a paragraph that went to the page before leaves its number to the next one
                F.when(first, F.col("up_no")).otherwise(F.col("number")).alias("no"), F.when(first, F.col("far")).otherwise(0).alias("far"),
                F.when(first, F.col("inside")).otherwise(False).alias("inside"), whole.alias("text"), (F.col("up").isNotNull() & ~first).alias("after"), (first | F.col("linked").isNotNull()).alias("several"),
            ),
            "placed",
        )
        several = placed.where("several").groupBy("page_id", "no").agg(F.array_sort(F.collect_list(F.struct("far", "inside", "text"))).alias("p"), F.bool_or("after").alias("after"))
        glue = F.aggregate("p", F.lit(""), lambda a, x: F.concat(a, F.when((x["far"] == 0) | x["inside"], "").otherwise(" "), x["text"]))
        out = placed.where("NOT several").select("page_id", "no", "after", "text", F.lit(1).alias("pages")).unionByName(several.select("page_id", "no", "after", glue.alias("text"), F.size("p").alias("pages")))
        return out.select("page_id", (F.col("no") - F.col("after").cast("int")).alias("paragraph_no"), "text", "pages")


@lru_cache(maxsize=4096)
def _whole_word(word: str) -> re.Pattern:
    return re.compile(rf"(?<![\w@]){re.escape(word)}(?![\w@])", re.I)


def _cased(found: str, correct: str) -> str:
    return correct.upper() if found.isupper() and len(found) > 1 else correct.capitalize() if found[:1].isupper() else correct


def _reassemble(text: str, furniture: set[int], fixes: list[dict], closed: set[int]) -> tuple[list[str], int, int, bool]:
    """The paragraphs of a page; how surely the first goes on from the page before (2 with a small letter, 1 with another running line);
    how open the last is (2 after a full line, 1 after a short one without a stop), and whether within a word."""
    lines = text.split("\n")
    for f in fixes:
        k = f["line"] - 1
        lines[k] = _whole_word(f["word"]).sub(lambda m, f=f: _cased(m.group(), f["correct"]), lines[k])
    width = max((len(x.rstrip()) for k, x in enumerate(lines, 1) if k not in furniture), default=0)
    parts: list[str] = []
    glue, fresh, begins, goes_on = "", True, 0, 0
    for k, line in enumerate(lines, 1):
        if k in furniture:
            continue
        s = line.strip()
        if not s:
            fresh = True
            continue
        indented = line[:2] == "  " and parts and parts[-1][-1:] in ".!?:。"
        row = bool(_ROW.search(s)) or bool(_HEADING.match(s))
        if not parts:
            begins = 0 if row or line[:2] == "  " else 2 if s[0].islower() or s[0] > "\u3040" else int(shape_of(line, width) == "text")
        if fresh and not glue or indented or row:
            parts.append(s)
        else:
            parts[-1] = parts[-1] + (glue if glue else " ") + s if glue != "\0" else parts[-1] + s
        goes_on = 0 if row or s[-1] in ".!?:。" else 1 + (len(line.rstrip()) >= 0.75 * width)
        fresh, glue = row, ""
        if k in closed:
            parts[-1] = parts[-1].rstrip().rstrip(HYPHENS)
            glue, goes_on = "\0", 2
        elif s[-1] in HYPHENS and _TAIL.search(s):  # the hyphen stays, and no blank comes after it
            glue, goes_on = "\0", 2
    return parts, begins, goes_on, glue == "\0"
