import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from parchline.llm import langid as L
from parchline.llm.units import parts, units_of

DEU = "Die Leuchte wird nach der Einstellung wieder geschlossen. Der gelbe Draht darf den Rahmen nicht berühren. "
ENG = "The marquee lamp must be closed after the adjustment. The yellow wire must not touch the metal frame. "


@pytest.fixture(scope="module")
def found(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text", "lang")
    more = spark.createDataFrame(
        [
            (9001, DEU * 4, "eng"), (9002, ENG * 4, "en-GB"), (9003, ENG * 4 + DEU, "English"), (9004, ENG * 4 + DEU.split(".")[0] + ".", "eng"), (9005, ENG, None), (9006, ENG, " und "), (9007, "J3-7 red 18\n" * 40, "deu"),
            (9008, None, "eng"), (9009, "", None), (9010, "   \n", None), (9011, ENG * 3000, "n/a"), (9012, "通常は、調整が終わったら電源基板を閉じて点検してください。", "jpn_vert"), (9013, "Marble Lantern", "fra"), (9001, DEU * 4, "eng"), (9014, ENG, "klingon"),
        ],
        "doc_id bigint, text string, lang string",
    )
    return L.label_languages(docs.unionByName(more).withColumn("key", F.lit(1)), "doc_id", "text", "lang").persist()


def test_cases(found):
    got = {}
    for r in L.wrong_labels(found, "doc_id").where("doc_id > 9000").collect():
        got.setdefault(r["doc_id"], set()).add(r["lang"])
    assert got == {9001: {"deu"}, 9003: {"eng", "deu"}, 9005: {"eng"}, 9006: {"eng"}, 9011: {"eng"}, 9014: {"eng"}}


def test_stretches(found):
    r = found.where("doc_id = 9003").first()
    text = ENG * 4 + DEU
    (s,) = r["stretches"]
    assert text[s["start"] : s["stop"]].strip() == DEU.strip() and s["lang"] == "deu" and r["confidence"] > 0.99


def test_held_out_accuracy(spark, data):
    """Fitted on half of the labelled texts, right on the other half: labels are noisy, so the model must agree with nine in ten."""
    rows = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text", L.label_language(F.col("lang")).alias("l")).where("length(text) > 200").collect()
    rows = [r for r in rows if r["l"] in L.LANGS]
    m = L.Model.fit([r["text"] for r in rows if r["doc_id"] % 2], [r["l"] for r in rows if r["doc_id"] % 2])
    test = [r for r in rows if r["doc_id"] % 2 == 0]
    main = L.detect(pa.array([r["text"] for r in test]), m)[0].to_pylist()
    pairs = [(a, r["l"]) for a, r in zip(main, test, strict=True) if a]
    assert sum(a == b for a, b in pairs) >= 0.85 * len(pairs)


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string, lang string")
    assert L.label_languages(df, "doc_id", "text", "lang").count() == 0


def test_units():
    u = units_of(pa.array([None, "", "One two three four. Five\nSIX\nseven eight nine. \n", "a.b c"]))
    parts = [(int(d), u.data[s:e].tobytes().decode().strip()) for d, s, e in zip(u.doc, u.start, u.end, strict=True)]
    assert parts == [(2, "One two three four."), (2, "Five"), (2, "SIX\nseven eight nine."), (2, ""), (3, "a.b c")] or [p for p in parts if p[1]] == [(2, "One two three four."), (2, "Five"), (2, "SIX\nseven eight nine."), (3, "a.b c")]


def test_parts_keep_all_rows():
    texts = [None, "", "x" * 50, "y" * 5, None, "z" * 500, "a", "b"]
    b = pa.RecordBatch.from_arrays([pa.array(range(8)), pa.array(texts)], names=["k", "t"])
    got = list(parts(b, 1, 60))
    assert [r for p in got for r in p.column(1).to_pylist()] == texts and len(got) == 3
    assert list(parts(b.slice(0, 0), 1)) == []
