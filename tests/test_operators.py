"""Unit anchors of the core operators."""

import datetime as dt
import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from parchline.functions import pixels
from parchline.functions import text as X
from parchline.operators import access, authority, fulltext, fusion, html, ledger, quality
from parchline.operators.fulltext import Index
from parchline.sources import files
from parchline.streaming import flows


def one(spark, col, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return df.select(col.alias("x")).first()[0]


def test_chunks_of_801_tokens(spark):
    text = " ".join(f"w{i}" for i in range(801))
    got = one(spark, X.chunk_windows(F.col("t")), t=text)
    assert [len(c.split()) for c in got] == [800, 101] and got[1].split()[0] == "w700"
    assert one(spark, X.chunk_windows(F.col("t")), t="   ") == []
    assert one(spark, X.tokens(F.col("t")), t="a b　c") == ["a", "b", "c"]


@settings(max_examples=15, deadline=None)
@given(st.integers(0, 2300))
def test_chunks_cover_everything(spark, n):
    toks = [f"w{i}" for i in range(n)]
    got = [c.split() for c in one(spark, X.chunk_windows(F.col("t")), t=" ".join(toks))]
    joined = [w for k, c in enumerate(got) for w in (c if not k else c[100:])]
    assert joined == toks and all(len(c) <= 800 for c in got)


def test_plausible_and_garble(spark):
    lex = ["qrst"]
    assert one(spark, X.garble_fraction(F.col("t")), t="through length brightens wrngs first") == pytest.approx(0.2)  # of the fixed words "through" has its place
    for word, want in (("qrst", True), ("of", True), ("xkcdvb", False), ("rhythm", True), ("strengthsk", False), ("a" * 21, False), ("ab1", None)):
        assert one(spark, X.plausible(F.col("w"), lex), w=word) is want, word
    assert one(spark, X.garble_fraction(F.col("t"), lex), t="one two") is None
    assert one(spark, X.garble_fraction(F.col("t"), lex), t="alpha beta gamma xkcdvb delta") == pytest.approx(0.2)


def test_refdes_and_phi(spark):
    for token, want in (("R12", True), ("IC3a,", True), ("2N3904", True), ("ABCDE", False), ("hello", False)):
        assert one(spark, X.is_refdes(F.col("t")), t=token) is want, token
    for text, want in (("MRN 12", "phi-strong-indicator:mrn"), ("impatient outpatient", None), ("the patient", "phi-uncertain:patient"), ("patient, clinical", "phi-multiple-weak-indicators")):
        assert one(spark, X.phi_verdict(F.col("t")), t=text) == want, text


def test_language_vote(spark):
    v = X.language_votes(F.col("t"))
    assert one(spark, v, t="The dog, and THE cat").asDict() == {"eng": 3, "fra": 0, "deu": 0, "spa": 0, "ita": 0, "n": 5}
    assert one(spark, X.vote_winner(v), t="der Hund und die Katze sind nicht im Haus bei dem Baum") == "deu"
    assert one(spark, X.vote_winner(v), t="the dog") is None


def test_access(spark):
    rows = [("archive", ["x"], "internal", True), ("archive", None, "restricted", False), ("x", ["archive"], "open", True), (None, None, "open", False), ("archive", [], "Internal", False), ("archive", [], None, False)]
    df = spark.createDataFrame(rows, "primary_domain string, additional_domains array<string>, sensitivity string, want boolean")
    for r in df.withColumn("v", access.visible({"archive": "internal"}, F.col("primary_domain"), F.col("additional_domains"), F.col("sensitivity"))).collect():
        assert r["v"] is r["want"], r
    assert access.filter_visible(df, {"archive": "internal"}, active=False).count() == 0
    with pytest.raises(PermissionError):
        access.require_verb(["read"], "search")


def test_query_grammar():
    p = fulltext.parse
    assert p("fuse") == fulltext.Term("fuse")
    assert p("a AND b") == p("a b")
    assert p("café*") == fulltext.Term("cafe", True)
    assert p("a OR b NOT c") == fulltext.Bool("or", (fulltext.Term("a"), fulltext.Bool("not", (fulltext.Term("b"), fulltext.Term("c")))))
    assert p('"x ""y"" z"') == fulltext.Phrase(("x", "y", "z"))
    assert p("NEAR(a b, 3)") == fulltext.Near(("a", "b"), 3)
    assert p("A-1.2") == fulltext.Phrase(("a-1.2",))
    assert p("AND NOT (((") == fulltext.Phrase(("and", "not"))


def test_search(spark, tmp_path):
    docs = [(1, "Café fuse F3. fuse"), (2, "fuse and cafe"), (3, None), (4, ""), (5, "relay snake_case 2N3904/R12"), (6, "a cafe"), (7, "b c d e")]
    df = spark.createDataFrame(docs, "k int, t string")
    index = Index.build(df, "k", "t", str(tmp_path / "ix"))
    keys = lambda q, ix=index: sorted(r[0] for r in ix.scored(q).collect())
    assert keys("cafe") == [1, 2, 6] and keys("fuse cafe") == [1, 2] and keys("fuse OR relay") == [1, 2, 5] and keys("cafe NOT fuse") == [6]
    assert keys('"cafe fuse"') == [1] and keys("2n3904*") == [5] and keys("snake") == [5] and keys("f3") == [] and keys("NEAR(fuse cafe, 1)") == [1, 2]
    n, avg = 6, index.avg_len
    tf, length = 2, 4
    idf = np.log((n - 2 + 0.5) / 2.5)
    want = -idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / avg))
    assert {r[0]: r[1] for r in index.scored("fuse").collect()}[1] == pytest.approx(want)

    assert keys("fuse cafe", Index.open(spark, "k", str(tmp_path / "ix"))) == [1, 2]
    assert one(spark, fulltext.snippet(F.col("t"), ["fuse"], 3), t="a b c fuse d e") == "... c [fuse] d ..."


def test_scores(spark):
    lit = F.lit
    d = quality.image_deductions(lit(100.0), lit(None).cast("double"), lit(float("nan")), lit(2.0), lit(True), lit("schematic"))
    got = one(spark, d)
    assert [x["code"] for x in got] == ["dpi_below_target", "dpi_very_low", "skew", "onebit_schematic"]
    assert one(spark, quality.score(d)) == pytest.approx(100 - 40 * 200 / 300 - 10 - 6 - 12)
    t = quality.text_deductions(lit(80.0), lit(0.15), lit(69.0), lit(None).cast("double"), lit(0.01))
    assert one(spark, quality.score(t)) == 90.0
    assert [one(spark, quality.grade(lit(x))) for x in (88.0, 77.9, 55.0, 54.9)] == ["A", "C", "D", "F"]


def test_roll_up_keeps_unknown(spark):
    rows = [("a", "blank", True, None, None), ("b", "mixed", True, 80.0, None), ("b", "text", True, 60.0, 90.0), ("b", "text", False, 0.0, 0.0)]
    r = {x["c"]: x for x in quality.roll_up(spark.createDataFrame(rows, "c string, content_class string, assessed boolean, if_score double, tq_score double"), "c").collect()}
    assert r["a"]["image_adequate"] is None and r["b"]["if_text"] == 70.0 and r["b"]["if_schem"] == 80.0 and r["b"]["image_adequate"] is False and r["b"]["text_adequate"] is True


@pytest.mark.parametrize("n,want", [(0, []), (3, [0, 1, 2]), (16, list(range(16))), (40, sorted({round(i * 39 / 15) for i in range(16)}))])
def test_sample(spark, n, want):
    assert one(spark, quality.screening_sample(F.col("n")), n=n) == want


def test_authority(spark):
    rows = [
        ("1", 1, "svc-b", "revision", "r", "draft", "2024-05-01", None), ("2", 2, "svc-c", "revision", "r", "approved-for-use", "2024-04-01", None),
        ("3", 1, "svc-b", "revision", "q", "draft", None, None), ("4", 2, "svc-b", "revision", "q", "retired", "2024-01-01", " 3 "), ("5", 1, "owner", "revision", "o", "draft", None, None), ("6", 2, "svc-b", "revision", "o", "retired", "2024-01-01", None),
        # what another object's record names stays; an object whose records supersede one another has neither winner nor conflict
        ("7", 3, "svc-b", "revision", "z", "draft", None, "6"), ("8", 3, "svc-b", "revision", "w", "draft", None, "9"), ("9", 3, "svc-b", "revision", "w", "draft", None, "8"),
    ]
    rows = [(*r[:7], dt.datetime(2024, 1, r[1]), r[7]) for r in rows]
    df = spark.createDataFrame(rows, "id string, arrival int, principal string, object_kind string, object_id string, status string, effective_date string, recorded_at timestamp_ntz, supersedes string")
    got = {r["object_id"]: (r["winner"], r["conflict"]) for r in authority.resolve(df, ["owner"], []).collect()}
    assert got == {"r": (None, True), "q": ("4", False), "o": ("5", False), "z": ("7", False), "w": (None, False)}
    assert [r["id"] for r in authority.active_records(df).where("object_id = 'o'").orderBy("id").collect()] == ["5", "6"]


def test_audit_chain(spark):
    lines = spark.createDataFrame([(i, f"event {i}") for i in range(1, 40)], "line_no bigint, body string")
    chain = ledger.chain_hashes(lines, ["line_no"], "body")
    assert ledger.verify_chain(chain).count() == 0
    prev = ""
    for r in chain.orderBy("line_no").collect():
        assert r["prev"] == prev
        prev = hashlib.sha256((prev + r["body"]).encode()).hexdigest()
        assert r["hash"] == prev
    edited = chain.withColumn("body", F.when(F.col("line_no") == 7, "x").otherwise(F.col("body")))
    assert [tuple(r) for r in ledger.verify_chain(edited).collect()] == [(7, "tampered")]
    assert [tuple(r) for r in ledger.verify_chain(chain.where("line_no <> 9")).collect()] == [(10, "prev mismatch")]


def test_versions_and_replays(spark):
    rows = [("a", 1, 1, "k1"), ("a", 2, 1, None), ("a", 3, 2, "k1"), ("a", 4, None, None), ("b", 1, 2, None)]
    got = ledger.fold_versions(spark.createDataFrame(rows, "object_id string, seq int, expected_version bigint, idempotency_key string"))
    assert {(r[0], r[1]): (r["outcome"], r["version"]) for r in got.collect()} == {("a", 1): ("applied", 2), ("a", 2): ("conflict", 2), ("a", 3): ("replay", 2), ("a", 4): ("applied", 3), ("b", 1): ("conflict", 1)}


def test_stale_with_loop(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("a", "c"), ("x", "y"), (None, "z")], "source string, dependent string")
    got = ledger.stale(e, spark.createDataFrame([("a",)], "node string"))
    assert {tuple(r) for r in got.collect()} == {("b", 1), ("c", 1)}
    assert ledger.stale(e, spark.createDataFrame([("q",)], "node string")).count() == 0


def test_stale_against_brute_force(spark):
    import random

    rng = random.Random(11)
    for n, more in ((40, 0), (40, 12), (30, 30)):
        edges = {(f"n{rng.randrange(max(i - 4, 0), i)}", f"n{i}") for i in range(1, n)} | {(f"n{rng.randrange(n)}", f"n{rng.randrange(n)}") for _ in range(more)}
        changed = {f"n{rng.randrange(n)}" for _ in range(3)}
        dist, at = dict.fromkeys(changed, 0), list(changed)
        while at:
            nxt = []
            for s, t in sorted(edges):
                if s in at and t not in dist:
                    dist[t] = dist[s] + 1
                    nxt.append(t)
            at = nxt
        e = spark.createDataFrame(sorted(edges), "source string, dependent string")
        got = {r[0]: r[1] for r in ledger.stale(e, spark.createDataFrame([(c,) for c in changed], "node string")).collect()}
        assert got == {k: v for k, v in dist.items() if v}
        assert {r[0] for r in ledger.stale(e, spark.createDataFrame([(c,) for c in changed], "node string"), 1).collect()} == {k for k, v in dist.items() if v == 1}


def test_html():
    page = """<table><tr><th>Name</th></tr><tr><td><a href="m/1.pdf"> Big
     Manual </a></td><td>3 MB</td><td></td></tr><tr><td><a href="x"><img></a></td></tr></table>"""
    assert html.listing_rows(page, "http://h/d/") == [("Big Manual", "http://h/d/m/1.pdf", ["3 MB"])]
    assert html.listing_rows(None, "") == []


def test_directory_entries(spark):
    for href, want in (("a%20b.pdf", ("a b.pdf", False)), ("sub/", ("sub", True)), ("?C=N", None), ("../", None), ("http://x/", None), ("#a", None), ("", None), ("a+b", ("a+b", False)), ("/", None), ("/pub/manuals/x.pdf", ("x.pdf", False)), ("/pub/sub/", ("sub", True)), ("..", None)):
        got = one(spark, html.directory_entry(F.col("h"), F.lit("x")), h=href)
        assert (got and tuple(got)) == want, href
    assert one(spark, html.directory_entry(F.col("h"), F.lit("Parent Directory")), h="/pub/") is None
    page = '<A HREF="a/"><b>First</b> one </A><a name="x">no</a><a href="/pub/">Parent Directory</a>'
    assert [tuple(x) for x in one(spark, html.anchors(F.col("t")), t=page)] == [("a/", "First one"), ("/pub/", "Parent Directory")]


def test_url_join(spark):
    from urllib.parse import urljoin

    for base in ("http://h/d/e.html", "http://h/d/", "http://h", "https://h/x?y=/z"):
        for href in ("a.pdf", "s/a.pdf", "/r/a", "//o/p", "ftp://q/r", ""):
            assert one(spark, html.url_join(F.col("b"), F.col("h")), b=base, h=href) == urljoin(base, href), (base, href)


def test_fusion(spark):
    a = spark.createDataFrame([("x", 1), ("y", 2)], "k string, rank int")
    b = spark.createDataFrame([("y", 1)], "k string, rank int")
    got = {r[0]: r[1] for r in fusion.reciprocal_rank([a, b], "k").collect()}
    assert got["y"] == pytest.approx(1 / 62 + 1 / 61) and got["x"] == pytest.approx(1 / 61)


def test_nearest_of_each_query(spark):
    rng = np.random.default_rng(3)
    m = rng.normal(size=(300, 8))
    m[7] = m[40] = m[260]  # ties go to the lesser key
    rows = [(i, v.tolist()) for i, v in enumerate(m)] + [(300, None), (301, [0.0] * 8)]
    df = spark.createDataFrame(rows, "id int, v array<double>").repartition(5)
    got = {}
    for r in fusion.nearest_each(df, df.where("id % 20 = 0"), "id", "v", 4).collect():
        got.setdefault(r["query_id"], []).append((-r["cosine"], r["id"]))
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    want = {q: sorted(zip((-np.round(u @ u[q], 12)).tolist(), range(300)))[:4] for q in range(0, 300, 20)}
    assert {q: [i for _, i in sorted(x)] for q, x in got.items()} == {q: [i for _, i in x] for q, x in want.items()}
    assert [i for _, i in sorted(got[40])][:3] == [7, 40, 260]


def test_pixels(spark):
    flat = np.full((40, 40), 255, np.uint8)
    dots = flat.copy()
    dots[5, 5] = dots[20:22, 20] = dots[30:38, 30:38] = 0
    assert pixels.components(dots < 128).tolist().count(1) == 1 and sorted(pixels.components(dots < 128)) == [1, 2, 64]
    ring = np.zeros((5, 5), bool)
    ring[0] = ring[-1] = ring[:, 0] = ring[:, -1] = True
    assert pixels.components(ring).tolist() == [16]
    df = spark.createDataFrame([(1, bytearray(dots.tobytes()), 40, 40), (2, None, 40, 40), (3, bytearray(b"x"), 2, 2)], "k int, c binary, h int, w int")
    got = {r["k"]: r for r in pixels.measure_images(df, "k", "c", "h", "w").collect()}
    assert got[1]["sharpness"] > 0 and got[1]["ink_fraction"] == pytest.approx(67 / 1600) and got[2]["sharpness"] is None and got[3]["ink_fraction"] is None
    assert pixels.measure(flat)[0] == 0.0 and pixels.measure(flat)[-1] is None


def drawn(h=400, w=300):
    return np.full((h, w), 255, np.uint8)


def test_lines_and_tables():
    rng = np.random.default_rng(1)
    mask = rng.random((30, 40)) < 0.7
    for n in (1, 3, 6):
        want = np.zeros_like(mask)
        for y in range(30):
            for x in range(40 - n + 1):
                if mask[y, x : x + n].all():
                    want[y, x : x + n] = True
        assert (pixels.opened(mask, n) == want).all()
    g = drawn()
    g[50, 20:280] = 0  # a line across
    g[100:110, 20:40] = 0  # a blot is no line
    assert pixels.line_score(g < 160) == pytest.approx(260 / 300)
    assert pixels.table_regions(g < 160) == []
    for y in (200, 240, 280):
        g[y, 40:260] = 0
    for x in (40, 150, 259):
        g[200:281, x] = 0
    assert pixels.table_regions(g < 160) == [(40, 200, 220, 81)]


def test_skew():
    for slope in (0.0, 0.03, -0.05):
        g = drawn(600, 800)
        for row in range(60, 540, 40):
            for x in range(60, 740):
                if x % 9 < 6:  # letters
                    y = row + round(slope * x)
                    g[y : y + 6, x] = 0
        assert pixels.skew(g < 160) == pytest.approx(abs(np.degrees(np.arctan(slope))), abs=0.15), slope
    assert pixels.skew(drawn() < 160) is None


def test_page_rules(spark):
    from parchline.operators import pages

    lit = lambda v: F.lit(v).cast("string")
    arr = lambda *v: F.array(*[lit(x) for x in v])
    german = "der Hund und die Katze sind nicht im Haus bei dem Baum und sie werden es auch nicht sein"

    latin = "Bxtq Wopl 1234 Sedkjh Ramln"
    cases = [  # override, text, votes, scripts, identity; ties of scripts go to the least name, which is none we know
        ("fra", german, [], [], None, ("fra", None, False, "operator override")), (None, german, [], [], None, ("deu", None, False, "embedded text")),
        (None, latin, ["deu"], [], "jpn", ("jpn", "jpn", True, "identity field")), (None, latin, [], [], None, ("eng", "eng", True, "ambiguous latin")),
        (None, None, [None, "eng"], ["Han"], None, ("eng", "eng", True, "wordlist vote")), (None, None, [], ["Japanese", "Latin", "Japanese"], None, ("jpn", "jpn", True, "script majority")),
        (None, None, [], ["Latin", "Klingon"], None, (None, None, False, "unknown")), (None, None, [None], [None], None, (None, None, False, "unknown")),
    ]
    c = X.letter_counts(F.col("t"))
    df = spark.createDataFrame([(i, *x[:5]) for i, x in enumerate(cases)], "i int, o string, t string, v array<string>, s array<string>, d string").withColumn("w", X.language_votes(F.col("t")))
    df = df.select("*", X.vote_winner(F.col("w")).alias("vote"), *[c[k].alias(k) for k in c])
    df = df.withColumn("own", X.text_language(F.col("kana"), F.col("han"), F.col("latin"), F.col("vote")))
    told = df.select("i", pages.document_language(F.col("o"), F.col("own"), F.col("vote"), F.col("v"), F.col("s"), F.col("d"), ["eng", "deu", "jpn"], ["eng", "jpn"]).alias("l"))
    assert {r["i"]: tuple(r["l"]) for r in told.collect()} == {i: x[5] for i, x in enumerate(cases)}
    assert one(spark, pages.majority(arr("b", "a", None))) == "a" and one(spark, pages.majority(arr(None))) is None
    for text, want in (("[/FlateDecode/DCTDecode]", ["FlateDecode", "DCTDecode"]), ("/JBIG2Decode", ["JBIG2Decode"]), ("", []), ("null", ["null"])):
        assert one(spark, pages.filters(F.col("t")), t=text) == want
    assert pages.settings({"a": 1, "b": (1, 2)}, '{"b": [3]}') == {"a": 1, "b": (3,)} and pages.settings({"a": 1}, None) == {"a": 1}
    with pytest.raises(KeyError):
        pages.settings({"a": 1}, '{"c": 1}')


def test_requests(spark):
    from parchline.operators import requests

    t0 = dt.datetime(2024, 1, 1)
    ops = [("claim", "x", 0, "unknown"), ("enqueue", "x", 0, "ok"), ("enqueue", "x", 0, "replay"), ("claim", "x", 0, "ok"), ("claim", "y", 200, "refused"), ("heartbeat", "x", 250, "ok"), ("claim", "y", 500, "refused"), ("claim", "y", 551, "ok"),
           ("complete", "x", 552, "refused"), ("fail", "y", 553, "ok"), ("claim", "x", 554, "ok"), ("fail", "x", 555, "ok"), ("claim", "x", 556, "refused")]
    df = spark.createDataFrame([("j", i, o, w, t0 + dt.timedelta(seconds=s)) for i, (o, w, s, _) in enumerate(ops)], "job_id string, seq int, op string, worker string, at timestamp_ntz")
    got = requests.lease_queue(df, max_attempts=3).orderBy("seq").collect()
    assert [r["outcome"] for r in got] == [x[3] for x in ops] and got[-1]["status"] == "dead" and got[-1]["attempts"] == 3
    rows = [("o", 1, 1, "k", "a", "1"), ("o", 2, 1, "k", "a", "9"), ("o", 3, 1, None, "a", "2"), ("o", 4, 2, None, "a", "2"), ("p", 5, None, "k", "a", None)]
    done, ledger_rows, audit = requests.mutate(spark.createDataFrame([(*r, "me") for r in rows], "object_id string, seq int, expected_version bigint, idempotency_key string, field string, value string, actor string"), requests.replace_field)
    assert [(r["outcome"], r["version"], r["result"]) for r in done.orderBy("seq").collect()] == [("applied", 2, ""), ("replay", 2, ""), ("conflict", 2, None), ("applied", 3, "1"), ("applied", 2, "")]
    assert ledger_rows.count() == audit.count() == 3
    before = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id int, v string")
    assert {tuple(r) for r in requests.violations(before, spark.createDataFrame([(1, "a"), (2, "x"), (4, "d")], "id int, v string"), "id").collect()} == {(2, "changed"), (3, "deleted")}


def test_canonical_json(spark):
    import json

    from parchline.functions import ids

    for title in ("plain", "Café \u65e5 \U0001f600 \"q\"", "", None):
        got = one(spark, ids.canonical_json({"b": F.lit(title).cast("string"), "a": F.lit(1)}))
        assert got == json.dumps({"a": 1, "b": title}, sort_keys=True, separators=(",", ":")), got


def test_badges(spark):
    from parchline.operators import search

    arr = lambda *v: F.array(*[F.lit(x) for x in v]).cast("array<string>")
    own = search.badges(F.lit("screening"), F.lit(False), F.lit(True), F.lit(False), F.lit(None).cast("boolean"), arr("risk"), arr("INCOMPLETE", "risk"))
    assert one(spark, own) == ["provisional", "superseded", "image-inadequate", "risk", "INCOMPLETE"]
    pin = lambda pinned, conflict: one(spark, search.pin_badges(arr("superseded"), F.lit("r1"), F.lit(pinned).cast("string"), F.lit(conflict)))
    assert pin(None, False) == ["superseded"] and pin("r1", True) == ["pinned", "superseded", "authority-conflict"] and pin("r2", False) == ["superseded", "superseded-revision"]


def test_audit_files(spark, tmp_path):
    lines = spark.createDataFrame([(i, f'{{"n":{i}}}') for i in range(1, 300)], "line_no bigint, body string")
    ledger.write_audit(ledger.chain_hashes(lines, ["line_no"], "body"), str(tmp_path / "audit"), 8000)
    back = spark.read.text(str(tmp_path / "audit")).select(F.get_json_object("value", "$.body.n").cast("bigint").alias("line_no"), F.col("value").alias("line"))
    assert back.count() == 299 and ledger.verify_lines(back).count() == 0 and len(list((tmp_path / "audit").glob("segment=*"))) > 3


def test_release(spark):
    from parchline import session

    s = session.Scratch(spark, "x")
    df = s.save(spark.range(3).toDF("a"), "t")
    assert df.count() == 3
    session.release()
    with pytest.raises(Exception):  # noqa: B017
        df.count()


def test_pdf_structure(spark, tmp_path):
    import zlib

    from parchline.operators import pages
    from parchline.sources import pdf

    packed = b"7 0 8 40 <</Type /Page /Parent 2 0 R>>            <</Subtype/Image/Width 90/Height 20/Filter/JBIG2Decode>>"
    stream = zlib.compress(packed)
    data = b"%PDF-1.7\n1 0 obj\n<</Type/Catalog/Pages 2 0 R>>\nendobj\n2 0 obj <</Type/Pages/Kids[3 0 R]/MediaBox [0 0 612 792]>> endobj\n3 0 obj <</Type /Page /Parent 2 0 R>> endobj\n"
    data += b"4 0 obj <</Subtype /Image /Width 800 /Height 600 /BitsPerComponent 8 /Filter [/FlateDecode /DCTDecode] /Length 5 >> stream\nabcde\nendstream endobj\n"
    data += b"5 0 obj <</Type/ObjStm/N 2/First 9/Filter/FlateDecode/Length %d>> stream\n" % len(stream) + stream + b"\nendstream endobj\n6 0 obj <</Type/ObjStm/N 1/First 4/Filter/FlateDecode>> stream\nbroken\nendstream endobj\n"
    n, wide, high, images, errors = pdf.scan(data)
    assert (n, wide, high) == (2, 612.0, 792.0) and len(errors) == 1 and sorted(i["width_px"] for i in images) == [90, 800]
    assert pdf.scan(b"GIF89a")[0] is None and pdf.scan(None)[0] is None and pdf.scan(b"%PDF-1.4\n")[4] == ["no page objects"]
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "a.pdf").write_bytes(data)
    (tmp_path / "p" / "b.pdf").write_bytes(b"nothing")
    got = pdf.pdf_files(spark, str(tmp_path / "p"))
    assert sorted((r["n_pages"] or 0) for r in got.collect()) == [0, 2]
    found = pages.structure(got.select("path", F.explode("images.filter").alias("filter")), "path").first()
    assert found["filters"] == ["DCTDecode", "FlateDecode", "JBIG2Decode"] and found["risk_flags"] == ["jbig2_unknown_history"]


def test_versions(spark, tmp_path):
    from parchline.sources.versions import StaleVersion, VersionedTable

    t = VersionedTable(spark, f"file://{tmp_path}/table")
    assert t.current() == 0 and t.versions() == []
    assert [t.write(spark.range(n).toDF("a")) for n in (1, 2, 3)] == [1, 2, 3] and t.read().count() == 3
    with pytest.raises(StaleVersion):
        t.write(spark.range(9).toDF("a"), expected=2)
    assert t.write(spark.range(4).toDF("a"), expected=3) == 4 and t.versions() == [1, 2, 3, 4]
    t.restore(2)
    assert t.read().count() == 2 and t.retain(1) == [1, 3] and t.versions() == [2, 4]
    with pytest.raises(FileNotFoundError):
        t.restore(3)


def test_captures_and_mounts(spark, tmp_path):
    tiff = lambda c: b"II*\0\x08\0\0\0\x01\0" + (259).to_bytes(2, "little") + (3).to_bytes(2, "little") + (1).to_bytes(4, "little") + c.to_bytes(4, "little")
    df = spark.createDataFrame([(1, bytearray(tiff(5))), (2, bytearray(tiff(1))), (3, bytearray(tiff(7))), (4, bytearray(b"\x89PNG\r\n\x1a\n")), (5, bytearray(b"\xff\xd8\xff")), (6, None)], "k int, c binary")
    assert [r[1] for r in files.capture_verdicts(df, "k", "c").orderBy("k").collect()] == ["tiff LZW", "refused: tiff uncompressed", "refused: tiff compression 7", "png", "refused: jpeg", "refused: unknown"]
    files.assert_local("/data/x", ["/net"])
    with pytest.raises(ValueError):
        files.assert_local("/net/x", ["/net"])
    (tmp_path / "MOUNT-ID").write_text("m1\n")
    files.verify_mount(spark, f"file://{tmp_path}", "m1")
    for root, name in ((tmp_path, "m2"), (tmp_path / "none", "m1")):
        with pytest.raises(OSError):
            files.verify_mount(spark, f"file://{root}", name)


def test_sources(spark, tmp_path):
    (tmp_path / "w.tsv").write_text("level\tpage_num\tblock_num\tpar_num\tline_num\tword_num\tleft\ttop\twidth\theight\tconf\ttext\n5\t1\t1\t1\t1\t1\t1\t2\t3\t4\t91.5\t\"hi\n5\t1\t1\t1\t1\t2\t1\t2\t3\t4\t-1\tno\n4\t1\t1\t1\t1\t2\t1\t2\t3\t4\t9\tno\n")
    assert [r["text"] for r in files.ocr_words(spark, str(tmp_path / "w.tsv")).collect()] == ['"hi']
    assert one(spark, files.script_name(F.col("o")), o="Page: 1\nScript: Japanese\n") == "Japanese"
    assert one(spark, files.capture_verdict(F.unhex(F.lit("FFD8FFE0")))) == "refused: jpeg"
    tiff = b"II*\x00\x08\x00\x00\x00\x01\x00\x03\x01\x03\x00\x01\x00\x00\x00\x07\x00\x00\x00"
    assert files.tiff_compression(tiff) == 7 and files.tiff_compression(b"nope") is None
    df = spark.createDataFrame([("master", bytearray(b"a")), ("cache", bytearray(b"a")), ("master", bytearray(b"b"))], "role string, content binary")
    for _ in range(2):
        files.write_content_store(df, str(tmp_path / "store"))
    assert spark.read.parquet(str(tmp_path / "store")).count() == 2
    good, bad = files.split_valid(df, {"role": F.col("role") == "master"})
    assert (good.count(), [r["broken_rules"] for r in bad.collect()]) == (2, [["role"]])
    assert files.copy_verified(df, str(tmp_path / "copy"))[0] == 3


def _stream(spark, df, path):
    df.write.parquet(path)
    return spark.readStream.schema(df.schema).parquet(path)


def test_stream_equals_batch(spark, data, tmp_path):
    e = spark.read.parquet(f"{data}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    s = flows.demand(_stream(spark, e, str(tmp_path / "e")), late="3650 days")
    q = s.writeStream.format("memory").queryName("demand").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    want = e.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").count()
    assert sorted(map(tuple, spark.table("demand").collect())) == sorted((r["w"]["start"], r["event_type"], r["count"]) for r in want.collect())


def test_dispatch(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (4, "?")], "id int, kind string")
    seen = []
    q = flows.dispatch(_stream(spark, rows, str(tmp_path / "o")), {"a": lambda df, n: seen.extend(("a", r["id"]) for r in df.collect()), "b": lambda df, n: seen.extend(("b", r["id"]) for r in df.collect())}, str(tmp_path / "k"))
    q.awaitTermination(120)
    assert sorted(seen) == [("a", 1), ("a", 3), ("b", 2)]


def test_once_per_key(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    rows = spark.createDataFrame([("k", t0), ("k", t0), ("j", t0)], "key string, ts timestamp")
    s = flows.once_per_key(_stream(spark, rows, str(tmp_path / "r")), "key", "ts")
    q = s.writeStream.format("memory").queryName("once").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(r["key"] for r in spark.table("once").collect()) == ["j", "k"]


def test_ext_merge(spark):
    from parchline.operators.catalogue import merge_keys

    df = spark.createDataFrame([({"a": "1", "ext.b": "2"}, {"ext.b": None, "ext.c": "3"}), ({}, {"x": "1"})], "old map<string,string>, new map<string,string>")
    assert [r[0] for r in df.select(merge_keys(F.col("old"), F.col("new"))).collect()] == [{"a": "1", "ext.c": "3"}, None]
