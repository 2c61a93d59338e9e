import random

import numpy as np
import pyarrow as pa

from parchline.llm.spam import Automaton, keyword_pages, score

CLEAN = "Clean the control panel with alcohol and let it dry for some minutes. "


def brute(t, least=2):
    out = [False] * len(t)
    for n in range(least, len(t)):
        seen = {}
        for i in range(len(t) - n + 1):
            seen.setdefault(tuple(t[i : i + n]), []).append(i)
        for v in seen.values():
            for i in v if len(v) > 1 else []:
                out[i : i + n] = [True] * n
    return out


def automaton(pages):
    """Of pages as lists of units as lists of numbers, and the tokens' pages and units."""
    units = [(p, u) for p, page in enumerate(pages) for u in page]
    page = np.array([p for p, u in units for _ in u], dtype=np.int64)
    unit = np.array([k for k, (_, u) in enumerate(units) for _ in u], dtype=np.int64)
    word = np.array([w for _, u in units for w in u], dtype=np.uint64)
    return Automaton(page, unit, word), page, unit


def test_coverage_against_brute_force():
    rng = random.Random(2)
    for _ in range(60):
        pages = [[[rng.randrange(4) for _ in range(rng.randrange(1, 9))] for _ in range(rng.randrange(1, 4))] for _ in range(3)]
        sa, _, _ = automaton(pages)
        want = []
        for page in pages:  # a mark of its own before each unit keeps repeats within units
            flat = [x for k, u in enumerate(page) for x in (-1 - k, *u)]
            want += [c for c, x in zip(brute(flat), flat) if x >= 0]
        assert list(sa.covered(np.ones(len(want), dtype=bool))) == want, pages


def test_longest_repeat_at_every_place():
    sa, _, _ = automaton([[[1, 2, 1, 2, 1]], [[1, 2]]])
    assert list(sa.longest(np.ones(7, dtype=bool))) == [1, 2, 3, 2, 3, 0, 0]


def test_free_phrases_against_brute_force():
    rng = random.Random(3)
    for _ in range(40):
        page = [[rng.randrange(5) for _ in range(rng.randrange(2, 12))] for _ in range(12)]
        sa, _, unit = automaton([page])
        got = sa.phrases(np.ones(len(unit), dtype=bool), unit, np.full(len(unit), 3))
        left, right, want = {}, {}, []
        for u in page:
            for n in (2, 3, 4):
                for i in range(len(u) - n + 1):
                    g = tuple(u[i : i + n])
                    left.setdefault(g, set()).add(u[i - 1] if i else None)
                    right.setdefault(g, set()).add(u[i + n] if i + n < len(u) else None)
        for u in page:
            on = [False] * len(u)
            pairs = [tuple(u[i : i + 2]) for i in range(len(u) - 1)]
            for n in (2, 3, 4):
                for i in range(len(u) - n + 1):
                    g = tuple(u[i : i + n])
                    if len(left[g]) >= 3 <= len(right[g]) or n == 2 and pairs.count(g) > 1:
                        on[i : i + n] = [True] * n
            want += on
        assert list(got) == want, page


SPAM = ["used cabinet cheap parts " * 30, "http://a.example/x/1\nhttp://b.example/y/2\n" * 9, CLEAN + "#neonsign #coindoor #lamps " * 20, '<a href="http://a.example/1">coin door</a> ' * 9,
        ", ".join(f"{a} {b}" for a in ("free manual", "buy lamps", "coin lock") for b in ("marble pylon", "lemon glacier", "hollow harbor"))]
GOOD = [None, "", " \n ", CLEAN * 30, "J3-7  white  18 AWG  AUDIO\n" * 40, "1\t001-74882\tvoltage regulator\t9\n" * 20, "1.1 Fuse block ......... 6\n" * 20, CLEAN * 5 + "http://a.example/1\n#tag #two", "Marble Lantern", CLEAN * 20000]


def test_pages():
    assert score(pa.array(SPAM))[-1].to_pylist() == [True] * len(SPAM)
    assert score(pa.array(GOOD))[-1].to_pylist() == [False] * len(GOOD)


def test_long_spam():
    assert score(pa.array(["neon sign game room deals " * 20_000]))[-1].to_pylist() == [True]


def test_frame(spark):
    df = spark.createDataFrame([(1, SPAM[0], "x"), (1, SPAM[0], "x"), (2, None, "x"), (None, GOOD[3], "x")], "key int, t string, text string")
    assert sorted(r["is_spam"] for r in keyword_pages(df, "key", "t").collect()) == [False, False, True, True]
    assert keyword_pages(spark.createDataFrame([], df.schema), "key", "t").count() == 0


FILL = [f"{a} {b}" for a in ("Paper", "Thunder", "Cobalt", "Lemon") for b in ("Lantern", "Compass", "Pylon", "Glacier", "Harbor")]
STOPPED = [
    " ".join(f"Joystick sale for {f} joystick sale, the joystick sale you want." for f in FILL),
    "Joystick sale for Paper Lantern joystick sale, the joystick sale you want.\n" * 30,
    " ".join(f"{v} used coin door lock {w} {f}." for f in FILL for v, w in (("Best", "at"), ("New", "near"), ("Top", "with"))),
]
MANUAL = [
    " ".join(f"Record the serial number of the {f.lower()} in the maintenance log before returning it to the distributor." for f in FILL),
    CLEAN * 3 + "Turn the coin door lock before you lift the coin door lock. " + CLEAN,
    "".join(f"Sheet {w} shows how the {f.lower()} is held. " for f in FILL for w in ("one", "two")),
]


def test_keywords_in_stopped_sentences():
    assert score(pa.array(SPAM + STOPPED))[-1].to_pylist() == [True] * len(SPAM + STOPPED)
    assert score(pa.array(GOOD + MANUAL))[-1].to_pylist() == [False] * len(GOOD + MANUAL)


def test_one_definition_of_clauses():
    lines = "\n".join(f"{w} cheap used cabinet parts" for w in ("buy", "get", "find", "order") * 10) + " today."
    links = "\n".join(f"Visit our shop at https://shop.example/{'a' * 60}{i} now." for i in range(20))
    got = [x.to_pylist() for x in score(pa.array([lines, links]))]
    assert got[-1] == [True, True] and max(got[0]) < 0.4
