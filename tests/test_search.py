"""The search over chunks, generations and tokens on small fixtures."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from parchline.operators import access, authority, generations, requests, search
from parchline.operators.fulltext import Index

GRANTS = {"archive": "internal"}


@pytest.fixture(scope="module")
def world(spark, tmp_path_factory):
    make = spark.createDataFrame
    chunks = make(
        [
            ("c1", "d1", " R1-Old ", "k1", "p1", 1, 1, "the fuse of the monitor is blown"), ("c2", "d1", "r1-new", "k2", "p2", 4, 1, "replace the monitor fuse F3. before the next test of the fuse"), ("c3", "d1", "r1-new", "k2", "p2", 4, 0, "fuse of an older generation"),
            ("c4", "d2", "r2", "k3", "p3", 2, 0, "a secret fuse"), ("c5", "d3", "r3", "k4", "p4", 1, 0, "a coin door without one"), ("c6", "d3", "r3", "k4", "p5", 2, 0, "the fuse of the coin door"), ("c7", "d9", "r9", "k9", "p9", 1, 0, "fuse of nobody"), ("c8", "d3", "r3", "gone", "p5", 2, 0, "fuse of a copy that is gone"),
        ],
        "id string, document_id string, revision_id string, copy_id string, page_id string, page_number int, generation int, text string",
    )
    index = Index.build(chunks, "id", "text", str(tmp_path_factory.mktemp("ix") / "i"))
    copies = make([("k1", ["superseded"]), ("k2", []), ("k3", []), ("k4", ["provisional"])], "id string, badges array<string>")
    revisions = make([("r1-old", "A"), ("r1-new", "B"), ("r2", None), ("r3", "C")], "id string, label string")
    documents = make([("d1", "Monitor", "archive", None, "open"), ("d2", "Secret", "archive", ["starcade"], "restricted"), ("d3", "Door", "personal", ["archive"], "internal")], "document_id string, title string, primary_domain string, additional_domains array<string>, sensitivity string")
    pointers = make([("d1", 1), ("d2", 0), ("d3", 0), ("d9", 0)], "document_id string, active_generation int")
    pins = make([("d1", "R1-new", False), ("d3", None, True)], "document_id string, pinned string, conflict boolean")
    return index, chunks, pointers, copies, revisions, documents, pins


def hits(world, query, grants=GRANTS, verbs=("search",), limit=20, **k):
    index, *rest = world
    return search.search_chunks(index, query, *rest, grants, list(verbs), limit, **k).orderBy("tier", "score", "chunk_id").collect()


def test_hits_tiers_and_badges(world):
    got = hits(world, "fuse")
    assert [r["chunk_id"] for r in got][-1] == "c1" and {r["chunk_id"] for r in got} == {"c1", "c2", "c6"}
    by = {r["chunk_id"]: r for r in got}
    assert by["c2"]["badges"] == ["pinned"] and by["c2"]["tier"] == 0 and by["c1"]["badges"] == ["superseded", "superseded-revision"] and by["c1"]["tier"] == 1
    assert by["c6"]["badges"] == ["provisional", "authority-conflict"] and by["c6"]["tier"] == 0
    assert by["c2"]["citation"].asDict(True) == {"document": "d1", "revision": "r1-new", "representation": "k2", "locator": {"type": "page", "page": 4}}
    assert by["c2"]["snippet"].count("[fuse]") == 2 and by["c2"]["revision_label"] == "B"


def test_access_verbs_and_limits(world):
    assert {r["chunk_id"] for r in hits(world, "fuse", {"archive": "restricted"})} == {"c1", "c2", "c4", "c6"}
    assert hits(world, "fuse", {}) == [] and hits(world, "fuse", active=True, overfetch=True)[0]["tier"] == 0
    assert len(hits(world, "fuse", limit=2)) == 2
    for bad in ({"verbs": ["read"]}, {"active": False}):
        with pytest.raises(PermissionError):
            hits(world, "fuse", **bad)


def test_grammar_reaches_the_index(world):
    assert {r["chunk_id"] for r in hits(world, "text:fuse NOT coin")} == {"c1", "c2"} and {r["chunk_id"] for r in hits(world, '"coin door"')} == {"c5", "c6"}
    # a full stop belongs to the token, and what the grammar does not know is a phrase
    assert hits(world, "F3") == [] and [r["chunk_id"] for r in hits(world, "fuse F3.")] == ["c2"]


def test_fetch_time_check_tells_nothing(spark, world):
    documents = world[5]
    asked = spark.createDataFrame([("d1",), ("d2",), ("nowhere",)], "document_id string")
    assert [r["document_id"] for r in access.check_documents(asked, documents, GRANTS, ["read"]).collect()] == ["d1"]
    with pytest.raises(PermissionError):
        access.check_documents(asked, documents, GRANTS, ["search"])


def test_activation(spark, world):
    pointers = spark.createDataFrame([("d1", 2), ("d2", 0)], "document_id string, active_generation int")
    asked = spark.createDataFrame([("d1", 3), ("d1", 2), ("d1", 4), ("d2", 1), ("new", 1)], "document_id string, generation int")
    got = generations.activate(pointers, asked)
    assert {(r["document_id"], r["generation"], r["outcome"]) for r in got.collect()} == {("d1", 3, "activated"), ("d1", 2, "stale"), ("d1", 4, "stale"), ("d2", 1, "activated"), ("new", 1, "activated")}
    assert {tuple(r) for r in generations.moved_pointers(pointers, got).collect()} == {("d1", 3), ("d2", 1), ("new", 1)}
    spot = {(r["document_id"], r["generation"]): (r["token"], r["spot_retrieval"]) for r in generations.spot_check(world[1], world[0].postings.select("id", "term")).collect()}
    assert spot[("d1", 1)] == ("fuse", True) and spot[("d3", 0)] == ("coin", True)
    assert not generations.spot_check(world[1], world[0].postings.where("term <> 'coin'").select("id", "term")).where("document_id = 'd3'").first()["spot_retrieval"]


def test_tokens(spark):
    t = lambda n: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=n)
    issued = requests.issue_tokens(spark.createDataFrame([("a", "ann", t(0)), ("b", "ann", t(0)), ("c", "bob", t(0))], "token_id string, principal string, at timestamp_ntz"))
    tokens = requests.revoke_tokens(issued, spark.createDataFrame([("b", t(9)), ("b", t(5))], "token_id string, at timestamp_ntz"))
    people = spark.createDataFrame([("ann", True), ("bob", False)], "principal string, active boolean")
    asked = spark.createDataFrame([("a", t(60)), ("a", t(61)), ("b", t(4)), ("b", t(5)), ("c", t(1)), ("x", t(1))], "token_id string, at timestamp_ntz")
    got = requests.token_checks(asked, tokens, people).select("token_id", F.minute("at"), "verdict")
    assert {tuple(r) for r in got.collect()} == {("a", 0, "valid"), ("a", 1, "expired"), ("b", 4, "valid"), ("b", 5, "revoked"), ("c", 1, "inactive"), ("x", 1, "unknown")}


def test_object_documents_and_conflicts(spark):
    cols = "id string, arrival int, principal string, object_kind string, object_id string, status string, effective_date string, recorded_at timestamp_ntz, supersedes string"
    row = lambda i, who, eff, day: (i, int(i), who, "revision", "r", "draft", eff, dt.datetime(2024, 1, day), None)
    old = spark.createDataFrame([row("1", "svc-a", "2024-05-01", 1)], cols)
    both = old.unionByName(spark.createDataFrame([row("2", "svc-b", "2024-04-01", 2)], cols))
    jobs = requests.review_jobs(authority.resolve(old, ["owner"], []), authority.resolve(both, ["owner"], [])).collect()
    assert [tuple(j) for j in jobs] == [("revision", "r", "review:revision:r")]
