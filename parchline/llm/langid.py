"""Languages of documents by multilingual mixture inference.

A document is a mixture of languages. Hashed byte 4-gram models, fitted on a bounded sample of labelled rows,
give the log-likelihood of each of its sentences under each language; expectation-maximisation estimates
the document's language proportions from them; a language stays in the set only if leaving it out costs more
log-likelihood than a penalty. Sentences then go to the language with the highest posterior.

The model is refitted once on the sentences that it assigns itself, so that wrong labels in the sample fade.
Everything runs on whole Arrow batches; the model (a table of 65,536 rows) is all that is sent to the executors.

Defined results: null and empty texts and texts without running sentences have no language; a text with one
sentence has one language; repeated rows are judged each; ties go to the first language in ``LANGS``.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parchline.llm.units import Units, parts, units_of

LANGS = ["eng", "fra", "deu", "spa", "ita", "por", "nld", "jpn"]

# fixed values: ISO 639 codes and names of the languages
NAMES = {
    "eng": ["en", "eng", "english"],
    "fra": ["fr", "fra", "fre", "french", "français", "francais"],
    "deu": ["de", "deu", "ger", "german", "deutsch"],
    "spa": ["es", "spa", "spanish", "español", "espanol", "castilian"],
    "ita": ["it", "ita", "italian", "italiano"],
    "por": ["pt", "por", "portuguese", "português", "portugues"],
    "nld": ["nl", "nld", "dut", "dutch", "nederlands"],
    "jpn": ["ja", "jpn", "japanese", "日本語"],
}
SILENT = ["", "und", "unknown", "n/a", "na", "none", "null", "mul", "zxx", "mis", "?", "-"]

BITS = 16
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[np.r_[0:65, 91:97, 123:128]] = 32

SCHEMA = T.StructType(
    [
        T.StructField("language", T.StringType()),
        T.StructField("confidence", T.DoubleType()),
        T.StructField("sentences", T.IntegerType()),
        T.StructField(
            "languages",
            T.ArrayType(T.StructType([T.StructField("lang", T.StringType()), T.StructField("share", T.DoubleType()), T.StructField("confidence", T.DoubleType()), T.StructField("longest_run", T.IntegerType())])),
        ),
        T.StructField(
            "stretches",
            T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("stop", T.IntegerType()), T.StructField("lang", T.StringType()), T.StructField("confidence", T.DoubleType())])),
        ),
    ]
)


def label_language(label: Column) -> Column:
    """The language that a label names; '' if it says nothing; the label itself if it names another one."""
    raw = F.lower(F.trim(label))
    base = F.regexp_replace(raw, r"[-_].*$", "")
    known = F.lit(None).cast("string")
    for code, names in NAMES.items():
        known = F.when(base.isin(names), code).otherwise(known)
    return F.when(raw.isNull() | raw.isin(SILENT), "").otherwise(F.coalesce(known, raw))


def grams(data: np.ndarray) -> np.ndarray:
    """The hashed 4-gram that starts at every byte (the last three see blanks)."""
    b = np.concatenate([_FOLD[data], np.full(3, 32, dtype=np.uint8)]).astype(np.uint32)
    h = (b[:-3] << np.uint32(24)) | (b[1:-2] << np.uint32(16)) | (b[2:-1] << np.uint32(8)) | b[3:]
    return ((h * np.uint32(2654435761)) >> np.uint32(32 - BITS)).astype(np.uint16)


def likelihoods(u: Units, table: np.ndarray, pick: np.ndarray) -> np.ndarray:
    """Log-likelihood of each picked unit under each language, a quarter per byte as 4-grams overlap."""
    if not len(pick):
        return np.zeros((0, table.shape[1]), dtype=np.float32)
    out = np.empty((len(pick), table.shape[1]), dtype=np.float32)
    at, step = 0, 1 << 18
    size = u.end[pick] - u.start[pick]
    ends = np.cumsum(size)
    while at < len(pick):  # in pieces that stay in the cache
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + step, side="right")))
        lo, hi = u.start[pick[at]], u.end[pick[to - 1]]
        idx = grams(u.data[lo : min(hi + 3, len(u.data))])[: hi - lo]
        s, e = u.start[pick[at:to]] - lo, u.end[pick[at:to]] - lo
        rows = table[idx]
        marks = np.empty(2 * (to - at), dtype=np.int64)
        marks[0::2], marks[1::2] = s, np.minimum(e, len(idx))
        if marks[-1] >= len(idx):
            sums = np.add.reduceat(rows, marks[:-1], axis=0)
        else:
            sums = np.add.reduceat(rows, marks, axis=0)
        out[at:to] = sums[0::2]
        at = to
    return out / 4


def mixtures(ll: np.ndarray, doc: np.ndarray, n_docs: int, penalty: float, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """EM over all documents of a batch at once. Returns each sentence's posteriors and each document's set of
    languages. ``doc`` is sorted."""
    k = ll.shape[1]
    first = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
    own = doc[first]
    top = ll.max(axis=1, keepdims=True)
    like = np.exp(np.maximum(ll - top, -80))
    share = np.full((n_docs, k), 1 / k)
    count = np.add.reduceat(np.ones(len(doc)), first)
    for _ in range(rounds):
        post = like * share[doc]
        post /= post.sum(axis=1, keepdims=True)
        share[own] = (np.add.reduceat(post, first, axis=0) + 1e-6) / (count[:, None] + k * 1e-6)
    kept = np.zeros((n_docs, k), dtype=bool)
    kept[own] = True
    for _ in range(k - 1):  # leave out, document by document, the language that is missed least
        mix = np.where(kept[doc], like * share[doc], 0) + 1e-300
        whole = mix.sum(axis=1)
        loss = np.log(whole)[:, None] - np.log(np.maximum(whole[:, None] - mix, 1e-280))
        loss = np.add.reduceat(loss, first, axis=0)
        loss[~kept[own]] = np.inf
        least = loss.argmin(axis=1)
        drop = (loss[np.arange(len(own)), least] < penalty) & (kept[own].sum(axis=1) > 1)
        if not drop.any():
            break
        kept[own[drop], least[drop]] = False
    post = np.where(kept[doc], like * share[doc], 0) + 1e-300
    return post / post.sum(axis=1, keepdims=True), kept


class Model:
    def __init__(self, table: np.ndarray, common: list[frozenset[bytes]]):
        self.table, self.common = table, common

    @classmethod
    def fit(cls, texts: list[str], labels: list[str], refits: int = 1, weigh_bytes: int = 3000, floor: float = 0.05) -> "Model":
        """From labelled texts; then again from the sentences as the first fit assigns them. A text of more than ``weigh_bytes``
        counts as so many, or one long text with a wrong label could stand for a rare language."""
        col = pa.array(texts, pa.large_string())
        u = units_of(col)
        pick = np.flatnonzero(u.sentences())
        of = np.array([LANGS.index(x) if x in LANGS else -1 for x in labels])[u.doc[pick]]
        pick, of = pick[of >= 0], of[of >= 0]
        idx = grams(u.data)
        size = np.bincount(u.doc, weights=u.end - u.start, minlength=len(texts))
        weight = np.minimum(1.0, weigh_bytes / np.maximum(size, 1))
        for fit in range(refits + 1):
            counts = np.zeros((len(LANGS), 1 << BITS))
            for lang in range(len(LANGS)):
                mine = pick[of == lang]
                first, second = (np.zeros(1 << BITS) for _ in range(2))
                for doc in np.split(mine, np.flatnonzero(np.diff(u.doc[mine])) + 1) if len(mine) else []:
                    seen = np.bincount(np.concatenate([idx[u.start[p] : u.end[p]] for p in doc]), minlength=1 << BITS) * weight[u.doc[doc[0]]]
                    counts[lang] += seen
                    second = np.maximum(second, np.minimum(first, seen))
                    first = np.maximum(first, seen)
                # without the two texts that have most of a gram: what only a wrongly labelled text and a copy of it say, counts for nothing
                counts[lang] = np.maximum(counts[lang] - first - second, 0) if len(np.unique(u.doc[mine])) > 4 else counts[lang]
            # the same floor for all: with added counts, a language of few texts would be the likeliest for whatever is new
            seen = counts / np.maximum(counts.sum(axis=1, keepdims=True), 1e-9)
            table = np.log((1 - floor) * seen + floor / (1 << BITS)).T.astype(np.float32).copy()
            if fit < refits:
                of = likelihoods(u, table, pick).argmax(axis=1)
        common = []
        raw = u.data.tobytes()
        for lang in range(len(LANGS)):
            said = b" ".join(raw[u.start[p] : u.end[p]] for p in pick[of == lang]).lower()
            seen = Counter(w for w in re.findall(rb"[a-z\x80-\xff]+", said) if len(w) <= 5)
            common.append(frozenset(w for w, _ in sorted(seen.items(), key=lambda x: (-x[1], x[0]))[:30]))
        return cls(table, common)

    def unstopped(self, u: Units, pick: np.ndarray, min_words: int = 8, least: float = 0.25) -> np.ndarray:
        """Of long units without a full stop those that read like sentences: enough common short words."""
        ok = np.zeros(len(pick), dtype=bool)
        for i, p in enumerate(pick):
            words = re.findall(rb"[a-z\x80-\xff]+", u.data[u.start[p] : u.end[p]].tobytes().lower())
            ok[i] = len(words) >= min_words and max(sum(w in c for w in words) for c in self.common) >= least * len(words)
        return ok

    def running(self, u: Units, min_words: int = 4) -> np.ndarray:
        good = u.sentences(min_words)
        odd = np.flatnonzero(~u.stopped & (u.words >= 8) & (u.codes * 4 <= u.words) & (u.links == 0))
        good[odd] = self.unstopped(u, odd)
        return np.flatnonzero(good)


def fit_model(df: DataFrame, text: str, label: str, key: str, sample_rows: int = 3000, sample_bytes: int = 64 << 20) -> Model:
    """The model from about ``sample_rows`` labelled rows or ``sample_bytes`` of text, whichever is less, chosen by a hash of their key."""
    labelled = df.where(label_language(F.col(label)).isin(LANGS))
    n, size = labelled.agg(F.count("*"), F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()
    million = 1_000_000
    share = min(sample_rows / max(n, 1), sample_bytes / max(size, 1))
    few = labelled if share >= 1 else labelled.where(F.pmod(F.xxhash64(F.col(key)), F.lit(million)) < max(1, int(million * share)))
    rows = few.where(F.col(text).isNotNull()).select(text, label_language(F.col(label)).alias("l")).toArrow()
    return Model.fit(rows.column(0).to_pylist(), rows.column(1).to_pylist())


def _chars(data: np.ndarray, lo: int, hi: int) -> int:
    return int(((data[lo:hi] & 0xC0) != 0x80).sum())


def detect(column: pa.Array, model: Model, penalty: float = 12.0) -> list[pa.Array]:
    """The columns of ``SCHEMA`` for a batch of texts."""
    n = len(column)
    u = units_of(column)
    pick = model.running(u)
    ll = likelihoods(u, model.table, pick)
    doc = u.doc[pick]
    main, conf, langs, spans = np.full(n, -1), np.zeros(n), [None] * n, [None] * n
    if len(pick):
        post, kept = mixtures(ll.astype(np.float64), doc, n, penalty)
        best = post.argmax(axis=1)
        size = (u.end - u.start)[pick].astype(float)
        weight = np.zeros((n, len(LANGS)))
        np.add.at(weight, (doc, best), size)
        sure = np.zeros((n, len(LANGS)))
        np.add.at(sure, (doc, best), size * post[np.arange(len(best)), best])
        here = weight.sum(axis=1) > 0
        main[here] = weight[here].argmax(axis=1)
        change = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (best[1:] != best[:-1])])
        run = np.diff(np.r_[change, len(best)])
        longest = np.zeros((n, len(LANGS)), dtype=int)
        np.maximum.at(longest, (doc[change], best[change]), run)
        rate = np.divide(sure, weight, out=np.zeros_like(sure), where=weight > 0)
        total = weight.sum(axis=1)
        conf[here] = rate[here, main[here]]
        row_start = np.zeros(n, dtype=np.int64)
        lead = np.flatnonzero(np.r_[True, u.doc[1:] != u.doc[:-1]])
        row_start[u.doc[lead]] = u.start[lead]
        for i in np.flatnonzero(here):
            m = main[i]
            langs[i] = [(LANGS[m], float(weight[i, m] / total[i]), float(rate[i, m]), int(longest[i, m]))]
        for i in np.flatnonzero((weight > 0).sum(axis=1) > 1):
            order = np.argsort(-weight[i], kind="stable")
            langs[i] = [(LANGS[j], float(weight[i, j] / total[i]), float(rate[i, j]), int(longest[i, j])) for j in order if weight[i, j] > 0]
            spans[i] = []
        mixed = np.array([s is not None for s in spans])
        for c, r in zip(change, run, strict=True):
            i = doc[c]
            if mixed[i] and best[c] != main[i]:
                a, b = u.start[pick[c]], u.end[pick[c + r - 1]]
                lo = _chars(u.data, row_start[i], a)
                p = float(post[c : c + r, best[c]].mean())
                spans[i].append((lo, lo + _chars(u.data, a, b), LANGS[best[c]], p))
    count = np.bincount(doc, minlength=n) if len(pick) else np.zeros(n, dtype=int)
    item = pa.struct([("lang", pa.string()), ("share", pa.float64()), ("confidence", pa.float64()), ("longest_run", pa.int32())])
    span = pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("lang", pa.string()), ("confidence", pa.float64())])
    name = lambda rows, names: [None if r is None else [dict(zip(names, x, strict=True)) for x in r] for r in rows]
    return [
        pa.array([LANGS[m] if m >= 0 else None for m in main], pa.string()),
        pa.array([float(c) if m >= 0 else None for m, c in zip(main, conf, strict=True)], pa.float64()),
        pa.array(count.astype(np.int32)),
        pa.array(name(langs, ["lang", "share", "confidence", "longest_run"]), pa.list_(item)),
        pa.array(name(spans, ["start", "stop", "lang", "confidence"]), pa.list_(span)),
    ]


def label_languages(df: DataFrame, key: str, text: str, label: str, sample_rows: int = 3000, penalty: float = 12.0) -> DataFrame:
    """(key, label_lang) and the columns of ``SCHEMA``: the main language with its confidence, the number of running
    sentences, every language of the document, and its stretches in other languages as code-point offsets."""
    model = fit_model(df, text, label, key, sample_rows)
    sent = df.sparkSession.sparkContext.broadcast((model.table, model.common))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*sent.value)
        for b in (x for whole in batches for x in parts(whole, 2)):
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *detect(b.column(2), own, penalty)], names=["key", "label_lang", *SCHEMA.names])

    rows = df.select(F.col(key).alias("key"), label_language(F.col(label)).alias("label_lang"), F.col(text).alias("text"))
    schema = T.StructType([T.StructField("key", df.schema[key].dataType), T.StructField("label_lang", T.StringType()), *SCHEMA.fields])
    return rows.mapInArrow(run, schema).withColumnRenamed("key", key)


def wrong_labels(found: DataFrame, key: str, min_run: int = 2) -> DataFrame:
    """(key, lang) of the documents whose label is missing, silent, wrong, or only part of the truth: one row for the
    main language and for every other one that holds at least ``min_run`` sentences in succession."""
    held = F.filter("languages", lambda x: (x["lang"] == F.col("language")) | (x["longest_run"] >= min_run))
    case = (F.col("label_lang") != F.col("language")) | (F.size("held") > 1)
    return found.where("sentences > 0").withColumn("held", held).where(case).select(key, F.explode("held.lang").alias("lang"))
