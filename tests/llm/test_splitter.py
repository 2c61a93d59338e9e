from hypothesis import given, settings
from hypothesis import strategies as st

from parchline.llm.splitter import Splitter, split_oversized


def check(text, tokens, chars, overlap):
    ps = Splitter(text, tokens, chars, overlap).pieces()
    assert "".join(text[s:e] for _, e, s, _ in ps) == text
    for k, (lead, stop, core, n) in enumerate(ps):
        assert lead <= core < stop and stop - lead <= chars and n <= tokens and n == len(text[lead:stop].split())
        if k and "\f" not in text and len(text[:core].split()) >= overlap and max(map(len, text.split()), default=0) * overlap < chars // 8:
            assert len(text[lead:core].split()) == overlap
    return ps


WORD = st.text(alphabet="abc.\n #1)\f　-", min_size=0, max_size=400)


@settings(max_examples=150, deadline=None)
@given(WORD, st.integers(5, 30), st.integers(0, 3))
def test_round_trip(text, tokens, overlap):
    check(text, tokens, 120, overlap)


def test_natural_boundaries():
    text = "# One\n" + "alpha beta. " * 60 + "\n\n# Two\n" + "gamma delta. " * 60 + "\n\n## Sub\n" + "eps zeta. " * 30
    starts = [text[s : s + 5] for _, _, s, _ in check(text, 150, 5000, 10)]
    assert starts[0] == "# One" and "# Two" in starts
    para = "\n\n".join("word " * 90 + f"end{i}." for i in range(5))
    assert all(text_.startswith("word") for text_ in (para[s:] for _, _, s, _ in check(para, 200, 5000, 20)))


def test_extremes():
    check("x" * 30_000, 800, 8000, 100)
    check("a " * 5000, 800, 8000, 100)
    check("一二三四。" * 4000, 800, 8000, 100)
    pages = check("p one " * 300 + "\f" + "p two " * 300, 400, 8000, 50)
    assert not any("\f" in ("p one " * 300 + "\f" + "p two " * 300)[lead:stop][:-1] for lead, stop, _, _ in pages)


def test_frame(spark):
    rows = [("a", 1, "w " * 900, "t"), ("b", 1, None, "t"), ("c", 1, "", "t"), ("d", 2, "w" * 8001, "t"), ("e", 2, "w " * 800, "t"), ("f", 3, "x" * 8000, "t"), ("g", 3, "w " * 801, "t"), ("a", 1, "w " * 900, "t")]
    df = spark.createDataFrame(rows, "k string, n int, text string, piece_no string")
    got = split_oversized(df, ["k", "n"], "text").collect()
    assert {r["k"] for r in got} == {"a", "d", "g"} and all(len(r["text"]) <= 8000 and len(r["text"].split()) <= 800 for r in got)
    assert split_oversized(spark.createDataFrame([], df.schema), ["k", "n"], "text").count() == 0
