import numpy as np

from parchline.llm import scans as S

BODY = [
    "Replace the transformer when the measured resistance is high",
    "and record the voltage of the back-door interlock before the",
    "technician returns to the workshop and closes the cabinet up.",
]


def pages(spark, rows):
    return spark.createDataFrame(rows, "id string, copy string, idx int, text string, word string, line int")


def repair(spark, rows):
    return S.ScanRepair(spark, pages(spark, rows), "id", "copy", "idx", "text")


def build():
    rows = []
    for i in range(24):
        text = "\n".join(["GRANITE WALRUS SERVICE MANUAL", "", *BODY, *BODY[::-1], "", str(i + 1)])
        rows.append((f"p{i}", "c", i, text, "w", 1))
    rows.append(("hy", "d", 0, "\n".join(["Replace the measured resis-", "tance of the back-", "door interlock and the transfor‐", "", "- 7 -"]), "w", 1))
    rows.append(("hz", "d", 1, "\n".join(["GRANITE WALRUS SERVICE MANUAL", "mer when the volt-", "age is high.", "- 8 -"]), "w", 1))
    rows.append(("mis", "e", 0, "\n".join(["Replace the transf0rmer when the", "rneasured resistance is hlgh and", "record the voltage."]), "w", 1))
    rows.append(("native", "f", 0, "Replace the measured resis- tance of the transformer. " * 12 + "\n12", "w", 1))
    rows += [("nul", "g", 0, None, "w", 1), ("emp", "g", 1, "", "w", 1), ("bl", "g", 2, " \n \n", "w", 1), ("hy", "d", 0, rows[24][3], "again", 2)]
    rows.append(("long", "h", 0, "x" * 30_000 + "-\n" + "y" * 10, "w", 1))
    return rows


def test_lines(spark):
    got = {tuple(r) for r in repair(spark, build()).lines().collect()}
    assert {(p, n) for p, n, k in got if k == "furniture"} == {(f"p{i}", n) for i in range(24) for n in (1, 10)} | {("hy", 5), ("hz", 1), ("hz", 4)}
    assert {(p, n) for p, n, k in got if k == "hyphen" and p != "long"} == {("hy", 1), ("hy", 3), ("hz", 2)}
    assert {(p, n) for p, n, k in got if k == "misread"} == {("mis", 1), ("mis", 2)}


def paragraphs(r):
    got = {}
    for x in r.paragraphs().collect():
        got.setdefault(x["page_id"], {})[x["paragraph_no"]] = (x["text"], x["pages"])
    return got


def test_paragraphs(spark):
    got = paragraphs(repair(spark, build()))
    assert got["hy"] == {1: ("Replace the measured resistance of the back-door interlock and the transformer when the voltage is high.", 2)}
    assert "hz" not in got
    assert got["mis"][1] == ("Replace the transformer when the measured resistance is high and record the voltage.", 1)
    # these end in a full line without a stop, so each goes on on the next page
    assert got["p0"][1][0].startswith(BODY[0]) and "WALRUS" not in got["p0"][1][0] and got["p0"][1][1] == 24
    assert got["long"][1] == ("x" * 30_000 + "-" + "y" * 10, 1)  # no scan


def test_paragraphs_over_many_pages(spark):
    n = 9
    rows = [(f"q{i}", "c", i, "\n".join(["GRANITE WALRUS SERVICE MANUAL", "", *([f"and part {w} of the cabinet is checked by the technician"] * 2), f"before the {w} trans-" if i % 2 else f"before the {w} lamp and", "", str(i + 1)]), "w", 1)
            for i, w in enumerate("one two three four five six seven eight nine".split())]
    rows[0] = ("q0", "c", 0, rows[0][3].replace("and part one", "First heading.\n\nAnd part one", 1), "w", 1)
    rows[-1] = ("q8", "c", 8, "\n".join(["GRANITE WALRUS SERVICE MANUAL", "", "former is replaced.", "", "Another paragraph is here.", "", "9"]), "w", 1)
    rows += [("words", "d", 0, "the transand the transformer and\nthe transformer is here.", "w", 1), ("z-again", "c", 3, rows[3][3], "late", 2)]
    got = paragraphs(repair(spark, rows))
    assert got["q0"][1] == ("First heading.", 1)
    text, pages = got["q0"][2]
    assert pages == n and text.startswith("And part one") and text.endswith("before the eight transformer is replaced.") and "WALRUS" not in text
    assert got["q8"] == {1: ("Another paragraph is here.", 1)} and all(f"q{i}" not in got for i in range(1, 8))


def test_header_of_five_lines(spark):
    head = ["Granite Walrus Service Manual", "Lemon Glacier Division", "North Harbor Works", "Cobalt Lantern Series", "Section Seven Overview"]
    rows = [(f"p{i}", "c", i, "\n".join([*head, "", *BODY, *BODY[::-1], f"record {i} is kept by the technician in the workshop.", "", str(i + 1)]), "w", 1) for i in range(30)]
    r = repair(spark, rows)
    assert {tuple(x) for x in r.lines().collect()} == {(f"p{i}", n, "furniture") for i in range(30) for n in (1, 2, 3, 4, 5, 15)}


def test_breaks_are_states():
    text = "\n".join(["GRANITE WALRUS SERVICE MANUAL", "", *BODY, "", *BODY, "", "- 7 -"])
    assert S.line_states(S.LineModel(), text) == [S.HEAD, S.BREAK, *[S.BODY] * 3, S.BREAK, *[S.BODY] * 3, S.BREAK, S.FOOT]
    assert S.line_states(S.LineModel(), "") == [S.BREAK]


def test_pages_in_a_batch_are_labelled_as_alone():
    rng = np.random.default_rng(1)
    size = rng.integers(1, 40, 50)
    feature, again = rng.integers(0, 2 * len(S.SHAPES), size.sum()), rng.integers(0, 2, size.sum())
    model, start = S.LineModel(), np.cumsum(size) - size
    alone = [model.label(size[k : k + 1], feature[s : s + size[k]], again[s : s + size[k]]) for k, s in enumerate(start)]
    assert (np.concatenate(alone) == model.label(size, feature, again)).all()


def test_empty_table(spark):
    r = repair(spark, [])
    assert r.lines().count() == 0 and r.paragraphs().count() == 0


def test_correction_needs_a_much_commoner_word():
    known = {"voltage": 500, "modern": 60, "modem": 40}
    assert S.correction("vo1tage", 1, known) == "voltage" and S.correction("yoltagc", 1, known) == "voltage"
    assert S.correction("modem", 40, known) is None and S.correction("k290", 1, known) is None and S.correction("", 1, known) is None


def test_shapes():
    for line, want in (("- 12 -", "number"), ("iv", "number"), ("3 / 18", "number"), ("Seite 7", "paged"), ("Druvane Electric · Form 8516", "form"), ("Chapter 1  Walrus wiring", "chapter"), ("5.1 Pelican removal", "heading"),
                       ("Lemon Ferret installation guide", "title"), ("4    Lemon Compass Service Manual", "title"), ("W63   2SC1815   167 V", "row"), ("moves until it rests.", "text")):
        assert S.shape_of(line, 60) == want, line


def test_two_confusions_at_any_size():
    small, large = {"voltage": 40}, {"voltage": 400, "yoltagc": 20}
    assert S.correction("yoltagc", 2, small) == S.correction("yoltagc", 20, large) == "voltage"
    assert S.correction("yoltagc", 21, large) is None


def test_words_below_the_head_are_targets_too(spark):
    counts = {"the": 900, "and": 900, "voltage": 400, "yoltage": 3, "yoltagc": 2, "regulator": 100, "regu1ator": 4, "re9u1ator": 5, "modem": 100, "modern": 90, "rnodern": 1, "mode": 7}
    seen = spark.createDataFrame(list(counts.items()), "word string, n bigint")
    rows = lambda known, whole: sorted(map(tuple, S.corrections(seen, known, whole).collect()))
    common = {w: n for w, n in counts.items() if n >= 5}
    want = rows(common, True)
    assert ("regu1ator", "regulator") in want and ("yoltagc", "voltage") in want
    for size in (0, 1, 2, 3, 4, 5):
        head = dict(sorted(common.items(), key=lambda x: (-x[1], x[0]))[:size])
        assert rows(head, False) == want, size


def test_repeated_deliveries_count_once(spark):
    text = {k: "\n".join(v) for k, v in {"a": BODY, "b": ["the rneasured resistance of the", "transformer is high and the", "cabinet is closed."]}.items()}
    once = [(f"p{i}", "c", i, text["a"], "w", 1) for i in range(40)] + [("odd", "e", 0, text["b"], "w", 1)]
    often = once + [once[-1]] * 50
    want, got = (sorted(map(tuple, repair(spark, rows).words.collect())) for rows in (once, often))
    assert want == got and ("rneasured", "measured") in want
