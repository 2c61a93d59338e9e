"""Queries of state-changing requests, identifiers and the audit stream, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parchline.functions import ids
from parchline.operators import authority, ledger, requests
from parchline.oracle_core import _RESOLVE
from parchline.queries_core import OWNERS, PRECEDENCE, _outbox, _records, t

AS_OF = "1998-07-01"


def _job_events(spark, d) -> DataFrame:
    """The events of a queue: jobs with operations of several workers in time."""
    e = t(spark, d, "events")
    op = F.element_at(F.array(*[F.lit(x) for x in ("enqueue", "claim", "heartbeat", "fail", "claim", "complete", "fail")]), (F.col("event_id") % 7 + 1).cast("int"))
    job = (F.col("user_id") % 40).cast("bigint")
    return e.select(job.alias("job_id"), F.col("event_id").alias("seq"), op.alias("op"), F.concat(F.lit("w"), (F.col("event_id") % 2).cast("string")).alias("worker"), F.date_trunc("second", "ts").cast("timestamp_ntz").alias("at"))


def lease_queue(spark, d):
    return requests.lease_queue(_job_events(spark, d)).select("job_id", "seq", "outcome", "status", "attempts", F.date_format("lease_until", "yyyy-MM-dd HH:mm:ss").alias("lease_until"))


def _requests(spark, d) -> DataFrame:
    return t(spark, d, "events").select(
        F.col("event_id").alias("seq"), (F.col("user_id") % 50).alias("object_id"), F.when(F.col("event_id") % 3 == 0, F.floor("value")).cast("bigint").alias("expected_version"),
        F.when(F.col("event_id") % 5 == 0, F.concat(F.lit("k"), (F.col("event_id") % 400).cast("string"))).alias("idempotency_key"),
        F.col("event_type").alias("field"), F.when(F.col("event_id") % 4 > 0, F.col("props")).alias("value"), F.concat(F.lit("svc-"), (F.col("event_id") % 3).cast("string")).alias("actor"),
    )


def mutation_results(spark, d):
    done, _, _ = requests.mutate(_requests(spark, d), requests.replace_field)
    return done.select("seq", "object_id", "outcome", "version")


def mutation_ledger(spark, d):
    """Of the ledger and of the audit events as many rows as requests were applied, per actor."""
    _, rows, events = requests.mutate(_requests(spark, d), requests.replace_field)
    told = events.select(F.get_json_object("body", "$.actor").alias("actor")).groupBy("actor").agg(F.count("*").alias("events"))
    return rows.groupBy("actor").agg(F.count("*").alias("rows")).join(told, "actor", "left").select("actor", "rows", "events")


def _tokens(spark, d) -> DataFrame:
    o = t(spark, d, "orders")
    issued = requests.issue_tokens(o.select(F.col("o_orderkey").alias("token_id"), F.col("o_custkey").alias("principal"), F.col("o_orderdate").alias("at")), 90 * 86400)
    revoked = o.where("o_orderstatus = 'F' AND o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("token_id"), (F.col("o_orderdate") + F.expr("INTERVAL 5 DAYS")).alias("at"))
    return requests.revoke_tokens(issued, revoked)


def token_checks(spark, d):
    asked = t(spark, d, "lineitem").select(F.when(F.col("l_linenumber") == 7, -1 - F.col("l_orderkey")).otherwise(F.col("l_orderkey")).alias("token_id"), F.col("l_shipdate").alias("at"))
    principals = t(spark, d, "customer").select(F.col("c_custkey").alias("principal"), (F.col("c_acctbal") >= 0).alias("active"))
    return requests.token_checks(asked, _tokens(spark, d), principals).groupBy("verdict").agg(F.count("*").alias("n"), F.count_distinct("principal").alias("principals"))


def access_changes(spark, d):
    """Every document set to the access of the next one, by callers of all kinds."""
    docs = t(spark, d, "documents").select("doc_id", "sensitivity", "primary_domain", F.coalesce("additional_domains", F.array().cast("array<string>")).alias("more"))
    own = docs.select("doc_id", F.col("sensitivity").alias("old_level"), F.array_compact(F.concat(F.array("primary_domain"), "more")).alias("old_domains"))
    nxt = docs.select((F.col("doc_id") - 1).alias("doc_id"), F.col("sensitivity").alias("new_level"), F.array_compact(F.concat(F.array("primary_domain"), "more")).alias("new_domains"))
    c = own.join(nxt, "doc_id").withColumns({"is_admin": F.col("doc_id") % 3 == 0, "confirmed": F.col("doc_id") % 2 == 0})
    return requests.access_changes(c).select("doc_id", "outcome", "event")


def legal_holds(spark, d):
    r = t(spark, d, "events").where("event_type <> 'view'").select((F.col("user_id") % 200).alias("object_id"), F.col("event_id").alias("seq"), (F.col("event_id") % 2 == 0).alias("hold"), (F.col("event_id") % 3 < 2).alias("is_admin"))
    return requests.legal_holds(r).select("seq", "outcome", "event", "held")


def capacity_tasks(spark, d):
    volumes = t(spark, d, "supplier").select(F.col("s_suppkey").alias("volume"), (F.col("s_suppkey") * 37 % 100).cast("double").alias("used"), F.lit(100.0).alias("total"))
    known = volumes.where("volume % 10 = 3").select(F.concat(F.lit("capacity:"), F.col("volume").cast("string")).alias("key"))
    return requests.capacity_tasks(volumes, known).select("volume", F.round("used_share", 6).alias("used_share"), "key")


def authority_append(spark, d):
    """The later half of the records appended to the earlier: the objects that this brings into conflict, one review each."""
    r = _records(spark, d)
    before = authority.resolve(r.where("arrival % 2 = 0"), OWNERS, PRECEDENCE)
    return requests.review_jobs(before, authority.resolve(r, OWNERS, PRECEDENCE))


def insert_or_ignore(spark, d):
    """Applicability rows put beside those that are there: no key twice, the rows that are there stay."""
    links = t(spark, d, "copy_assets")
    old = links.where("relation = 'primary'").select("id", "relation")
    return requests.not_there(links.select("id", "relation"), old, ["id"])


def append_only(spark, d):
    """What a table that only grows must not show: every 97th record taken out, every 89th with another status."""
    r = t(spark, d, "authority_records").select("id", "arrival", "status").distinct()
    after = r.where("arrival % 97 <> 0").withColumn("status", F.when(F.col("arrival") % 89 == 0, "other").otherwise(F.col("status")))
    return requests.violations(r, after, "id")


def scalar_ids(spark, d):
    """Canonical JSON, configuration hashes, time identifiers, URL-safe base64 and UTC stamps of every document."""
    docs = t(spark, d, "documents").where("title IS NOT NULL AND recorded_at IS NOT NULL")
    body = ids.canonical_json({"title": F.col("title"), "issuer": F.col("issuer"), "doc_id": F.col("doc_id")})
    seconds = F.unix_seconds(F.col("recorded_at").cast("timestamp"))
    return docs.select(
        "doc_id", body.alias("body"), ids.config_hash("v1", body).alias("hash"), ids.time_id("doc", F.col("recorded_at"), F.col("document_id")).alias("id"),
        ids.base64url(F.encode(F.col("title"), "UTF-8")).alias("b64"), ids.iso_utc(F.timestamp_seconds(seconds)).alias("at"),
    )


def probes(spark, d):
    """Existence and maximum probes over the catalogue: whether each table has rows, and the greatest version."""
    names = ["revisions", "copies", "file_assets", "chunks", "authority_records"]
    some = [t(spark, d, n).limit(1).agg(F.lit(n).alias("probe"), F.count("*").alias("value")) for n in names]
    some.append(t(spark, d, "copies").agg(F.lit("row_version").alias("probe"), F.max("row_version").cast("bigint").alias("value")))
    out = some[0]
    for x in some[1:]:
        out = out.unionByName(x)
    return out


def direct_dependents(spark, d):
    """The one-step dependents of every deleted file, in order; what replayed requests answer is told by a flag."""
    files = t(spark, d, "file_assets")
    edges = files.select(F.lower(F.trim("parent_asset_id")).alias("source"), F.col("id").alias("dependent"))
    gone = files.where("deleted_at IS NOT NULL").select(F.col("id").alias("node"))
    return ledger.stale(edges, gone, 1).select("node", "hops").orderBy("node")


def replay_answers(spark, d):
    """Every request's answer: the stored result of its key, with a flag where it is a repetition."""
    r = t(spark, d, "authority_records").distinct().select("idempotency_key", "id", "arrival", "status")
    return ledger.answers(r, "idempotency_key", ["arrival", "id"], "status").select("id", "status", "replayed")


def audit_segments(spark, d):
    """The audit stream as lines of text in segments of a size: lines, bytes and the numbers of each segment's first and last line."""
    e = t(spark, d, "events").select((F.col("event_id") + 1).alias("line_no"), F.col("event_type").alias("event"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("actor"))
    lines = e.select("line_no", ids.canonical_json({"event": F.col("event"), "actor": F.col("actor"), "n": F.col("line_no")}).alias("line"))
    return ledger.segments(lines, "line_no", "line", 64 * 1024).groupBy("segment").agg(F.count("*").alias("lines"), F.sum(F.octet_length("line") + 1).alias("bytes"), F.min("line_no").alias("first"), F.max("line_no").alias("last"))


def audit_lines_verify(spark, d):
    """A stored stream with lines that were broken, altered or taken out: the lines that do not hold and why."""
    lines = ledger.chain_hashes(t(spark, d, "events").where("event_id < 3000").select((F.col("event_id") + 1).alias("line_no"), ids.canonical_json({"event": F.col("event_type"), "n": F.col("event_id")}).alias("body")), ["line_no"], "body")
    stored = ledger.audit_lines(lines).where("line_no % 1000 <> 500")
    damaged = stored.withColumn("line", F.when(F.col("line_no") % 700 == 0, F.substring("line", 1, 20)).when(F.col("line_no") % 900 == 0, F.replace("line", F.lit('"n":'), F.lit('"m":'))).otherwise(F.col("line")))
    return ledger.verify_lines(damaged)


_NAMES = """lease_queue mutation_results mutation_ledger token_checks access_changes legal_holds capacity_tasks authority_append insert_or_ignore append_only scalar_ids
probes direct_dependents replay_answers audit_segments audit_lines_verify""".split()
QUERIES = {n: globals()[n] for n in _NAMES}

_JOBS = """ev AS (SELECT user_id % 40 AS job_id, event_id AS seq, ['enqueue', 'claim', 'heartbeat', 'fail', 'claim', 'complete', 'fail'][event_id % 7 + 1] AS op, 'w' || (event_id % 2) AS worker, date_trunc('second', ts) AS seen FROM events),
ord AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY seq) AS k FROM ev)"""
_REQ = """req AS (SELECT event_id AS seq, user_id % 50 AS object_id, CASE WHEN event_id % 3 = 0 THEN CAST(floor(value) AS BIGINT) END AS want, CASE WHEN event_id % 5 = 0 THEN 'k' || (event_id % 400) END AS key, 'svc-' || (event_id % 3) AS actor FROM events),
ord AS (SELECT *, row_number() OVER (PARTITION BY object_id ORDER BY seq) AS k FROM req),
fold AS (
  SELECT object_id, 0::BIGINT AS k, 0::BIGINT AS seq, '' AS outcome, 1::BIGINT AS version, 1::BIGINT AS told, []::VARCHAR[] AS keys, []::BIGINT[] AS versions FROM (SELECT DISTINCT object_id FROM req)
  UNION ALL SELECT o.object_id, o.k, o.seq, CASE WHEN list_contains(f.keys, o.key) THEN 'replay' WHEN o.want <> f.version THEN 'conflict' ELSE 'applied' END,
    CASE WHEN list_contains(f.keys, o.key) OR o.want <> f.version THEN f.version ELSE f.version + 1 END,
    CASE WHEN list_contains(f.keys, o.key) THEN f.versions[list_position(f.keys, o.key)] WHEN o.want <> f.version THEN f.version ELSE f.version + 1 END,
    CASE WHEN o.key IS NULL OR list_contains(f.keys, o.key) OR o.want <> f.version THEN f.keys ELSE list_append(f.keys, o.key) END,
    CASE WHEN o.key IS NULL OR list_contains(f.keys, o.key) OR o.want <> f.version THEN f.versions ELSE list_append(f.versions, f.version + 1) END
  FROM fold f JOIN ord o ON o.object_id = f.object_id AND o.k = f.k + 1)"""
_SOME = lambda a, b: f"list_filter(list_concat([{a}], coalesce({b}, []::VARCHAR[])), lambda x: x IS NOT NULL)"
_LV = "CASE {0} WHEN 'open' THEN 0 WHEN 'internal' THEN 1 WHEN 'confidential' THEN 2 WHEN 'restricted' THEN 3 END"
#: JSON text with what lies beyond ASCII escaped
_ESC = lambda c: f"array_to_string(list_transform(string_split({c}, ''), lambda x: CASE WHEN unicode(x) > 127 THEN printf('\\u%04x', unicode(x)) ELSE x END), '')"
_BODY = _ESC("""'{"doc_id":' || doc_id || ',"issuer":' || coalesce(CAST(to_json(issuer) AS VARCHAR), 'null') || ',"title":' || CAST(to_json(title) AS VARCHAR) || '}'""")

ORACLE = {
    "lease_queue": f"""WITH RECURSIVE {_JOBS}, fold AS (
        SELECT job_id, 0::BIGINT AS k, 0::BIGINT AS seq, '' AS outcome, NULL::VARCHAR AS status, NULL::VARCHAR AS holder, NULL::TIMESTAMP AS until, 0 AS attempts FROM (SELECT DISTINCT job_id FROM ev)
        UNION ALL SELECT o.job_id, o.k, o.seq,
          CASE WHEN op = 'enqueue' THEN CASE WHEN status IS NULL THEN 'ok' ELSE 'replay' END WHEN status IS NULL THEN 'unknown' WHEN op = 'claim' THEN CASE WHEN status = 'queued' OR (status = 'running' AND until < seen) THEN 'ok' ELSE 'refused' END
            WHEN status = 'running' AND holder = worker THEN 'ok' ELSE 'refused' END,
          CASE WHEN op = 'enqueue' THEN coalesce(status, 'queued') WHEN op = 'claim' AND (status = 'queued' OR (status = 'running' AND until < seen)) THEN 'running'
            WHEN op IN ('complete', 'fail') AND status = 'running' AND holder = worker THEN CASE WHEN op = 'complete' THEN 'done' WHEN attempts >= 5 THEN 'dead' ELSE 'queued' END ELSE status END,
          CASE WHEN op = 'claim' AND (status = 'queued' OR (status = 'running' AND until < seen)) THEN worker WHEN op = 'fail' AND status = 'running' AND holder = worker THEN NULL ELSE holder END,
          CASE WHEN op = 'claim' AND (status = 'queued' OR (status = 'running' AND until < seen)) THEN seen + INTERVAL 300 SECOND WHEN op = 'heartbeat' AND status = 'running' AND holder = worker THEN seen + INTERVAL 300 SECOND
            WHEN op = 'fail' AND status = 'running' AND holder = worker THEN NULL ELSE until END,
          CASE WHEN op = 'claim' AND (status = 'queued' OR (status = 'running' AND until < seen)) THEN attempts + 1 ELSE attempts END
        FROM fold f JOIN ord o ON o.job_id = f.job_id AND o.k = f.k + 1)
        SELECT job_id, seq, outcome, status, CAST(attempts AS INTEGER) AS attempts, strftime(until, '%Y-%m-%d %H:%M:%S') AS lease_until FROM fold WHERE k > 0""",
    "mutation_results": f"WITH RECURSIVE {_REQ} SELECT seq, object_id, outcome, told AS version FROM fold WHERE k > 0",
    "mutation_ledger": f"WITH RECURSIVE {_REQ} SELECT actor, count(*) AS rows, count(*) AS events FROM fold JOIN req USING (object_id, seq) WHERE fold.k > 0 AND outcome = 'applied' GROUP BY 1",
    "token_checks": """WITH tok AS (SELECT o_orderkey AS token_id, o_custkey AS principal, o_orderdate + INTERVAL 90 DAY AS expires_at, CASE WHEN o_orderstatus = 'F' AND o_orderkey % 3 = 0 THEN o_orderdate + INTERVAL 5 DAY END AS revoked_at FROM orders),
        q AS (SELECT CASE WHEN l_linenumber = 7 THEN -1 - l_orderkey ELSE l_orderkey END AS token_id, l_shipdate AS seen FROM lineitem)
        SELECT CASE WHEN tok.token_id IS NULL THEN 'unknown' WHEN expires_at < seen THEN 'expired' WHEN revoked_at <= seen THEN 'revoked' WHEN NOT coalesce(c_acctbal >= 0, false) THEN 'inactive' ELSE 'valid' END AS verdict, count(*) AS n, count(DISTINCT principal) AS principals
        FROM q LEFT JOIN tok USING (token_id) LEFT JOIN customer ON c_custkey = principal GROUP BY 1""",
    "access_changes": f"""WITH d AS (SELECT doc_id, {_LV.format('sensitivity')} AS lv, {_SOME('primary_domain', 'additional_domains')} AS dom FROM documents),
        c AS (SELECT a.doc_id, coalesce(b.lv < a.lv, false) OR len(list_filter(b.dom, lambda x: NOT list_contains(a.dom, x))) > 0 AS wide FROM d a JOIN d b ON b.doc_id = a.doc_id + 1)
        SELECT doc_id, CASE WHEN NOT wide OR doc_id % 6 = 0 THEN 'applied' ELSE 'refused' END AS outcome, CASE WHEN NOT wide THEN 'access-changed' WHEN doc_id % 6 = 0 THEN 'access-widened' ELSE 'access-widening-refused' END AS event FROM c""",
    "legal_holds": """WITH r AS (SELECT user_id % 200 AS object_id, event_id AS seq, event_id % 2 = 0 AS hold, event_id % 3 < 2 AS ok FROM events WHERE event_type <> 'view')
        SELECT seq, CASE WHEN ok THEN 'applied' ELSE 'refused' END AS outcome, CASE WHEN NOT ok THEN 'legal-hold-blocked' WHEN hold THEN 'legal-hold-set' ELSE 'legal-hold-lifted' END AS event,
          coalesce(last_value(CASE WHEN ok THEN hold END IGNORE NULLS) OVER (PARTITION BY object_id ORDER BY seq ROWS UNBOUNDED PRECEDING), false) AS held FROM r""",
    "capacity_tasks": "SELECT s_suppkey AS volume, round(s_suppkey * 37 % 100 / 100.0::DOUBLE, 6) AS used_share, 'capacity:' || s_suppkey AS key FROM supplier WHERE s_suppkey * 37 % 100 >= 80 AND s_suppkey % 10 <> 3",
    "authority_append": f"""WITH a AS ({_RESOLVE} SELECT * FROM resolved), b AS ({_RESOLVE.replace('FROM authority_records', 'FROM authority_records WHERE arrival % 2 = 0')} SELECT * FROM resolved)
        SELECT object_kind, object_id, 'review:' || object_kind || ':' || object_id AS key FROM a WHERE conflict AND (object_kind, object_id) NOT IN (SELECT (object_kind, object_id) FROM b WHERE conflict)""",
    "insert_or_ignore": "SELECT id, min(relation) AS relation FROM copy_assets WHERE id NOT IN (SELECT id FROM copy_assets WHERE relation = 'primary') GROUP BY 1",
    "append_only": "SELECT DISTINCT id, CASE WHEN arrival % 97 = 0 THEN 'deleted' ELSE 'changed' END AS change FROM authority_records WHERE arrival % 97 = 0 OR arrival % 89 = 0",
    "scalar_ids": f"""WITH b AS (SELECT *, {_BODY} AS body FROM documents WHERE title IS NOT NULL AND recorded_at IS NOT NULL)
        SELECT doc_id, body, sha256('v1' || chr(10) || body) AS hash, 'doc_' || lower(to_base(epoch_ms(recorded_at), 36)) || substring(sha256(document_id), 1, 12) AS id,
          rtrim(translate(base64(encode(title)), '+/', '-_'), '=') AS b64, strftime(recorded_at, '%Y-%m-%dT%H:%M:%SZ') AS at FROM b""",
    "probes": " UNION ALL ".join(f"SELECT '{n}' AS probe, (SELECT count(*) FROM (SELECT 1 FROM {n} LIMIT 1)) AS value" for n in ("revisions", "copies", "file_assets", "chunks", "authority_records"))
    + " UNION ALL SELECT 'row_version', CAST(max(row_version) AS BIGINT) FROM copies",
    "direct_dependents": """WITH g AS (SELECT DISTINCT id FROM file_assets WHERE deleted_at IS NOT NULL) SELECT DISTINCT id AS node, 1 AS hops FROM file_assets WHERE lower(trim(parent_asset_id)) IN (SELECT id FROM g) AND id NOT IN (SELECT id FROM g)""",
    "replay_answers": """WITH r AS (SELECT DISTINCT * FROM authority_records)
        SELECT id, CASE WHEN idempotency_key IS NULL THEN status ELSE first_value(status) OVER w END AS status, idempotency_key IS NOT NULL AND row_number() OVER w > 1 AS replayed FROM r WINDOW w AS (PARTITION BY idempotency_key ORDER BY arrival, id)""",
    "audit_segments": """WITH l AS (SELECT event_id + 1 AS line_no, '{"actor":"u' || user_id || '","event":"' || event_type || '","n":' || (event_id + 1) || '}' AS line FROM events),
        s AS (SELECT line_no, strlen(line) + 1 AS size, sum(strlen(line) + 1) OVER (ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS run FROM l)
        SELECT CAST((run - size) // 65536 AS BIGINT) AS segment, count(*) AS lines, CAST(sum(size) AS BIGINT) AS bytes, min(line_no) AS first, max(line_no) AS last FROM s GROUP BY 1""",
    "audit_lines_verify": """WITH l AS (SELECT event_id + 1 AS line_no FROM events WHERE event_id < 3000)
        SELECT line_no, CASE WHEN line_no % 700 = 0 THEN 'unparseable' WHEN line_no % 900 = 0 THEN 'tampered' ELSE 'prev mismatch' END AS reason FROM l
        WHERE line_no % 1000 <> 500 AND (line_no % 700 = 0 OR line_no % 900 = 0 OR (line_no - 1) % 700 = 0 AND line_no > 1 OR (line_no - 1) % 1000 = 500)""",
}
