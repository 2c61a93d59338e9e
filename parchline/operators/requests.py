"""Requests that change state: leases of a job queue, guarded mutations, tokens, access changes, holds, capacity.

Each object's requests are one stream in order, as the order is the result; rows are sorted within partitions and folded as they pass, so
nothing is gathered. What one request leaves for the next is a few values per object. Different objects run in parallel."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parchline.functions.ids import canonical_json
from parchline.operators.access import widening


def fold(rows: DataFrame, key: str, order: list[str], inputs: list[str], begin: Callable[[], dict], step: Callable[..., tuple], outputs: dict[str, T.DataType]) -> DataFrame:
    """Adds ``outputs``: ``step(state, *inputs)`` for every row of a key in order, the state being what ``begin`` gives. A null key is a key."""
    names = list(outputs)
    arrow = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "timestamp_ntz": pa.timestamp("us")}
    types = [arrow[t.simpleString()] for t in outputs.values()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state = object(), {}
        for b in batches:
            at = lambda c: b.column(b.schema.get_field_index(c)).to_pylist()
            out = []
            for k, *values in zip(at(key), *map(at, inputs), strict=True):
                if k != current:
                    current, state = k, begin()
                out.append(step(state, *values))
            made = [pa.array([r[i] for r in out], t) for i, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([*b.columns, *made], names=[*b.schema.names, *names])

    schema = T.StructType([*rows.schema.fields, *[T.StructField(n, t) for n, t in outputs.items()]])
    return rows.repartition(key).sortWithinPartitions(key, *order).mapInArrow(run, schema)


def lease_queue(events: DataFrame, lease_seconds: int = 300, max_attempts: int = 5) -> DataFrame:
    """(job_id, seq, op, worker, at, outcome, status, attempts, lease_until): events of jobs folded. ``enqueue`` makes a job, again it changes
    nothing; ``claim`` takes one that is queued or whose lease has run out, whatever its attempts; ``heartbeat``, ``complete`` and ``fail`` need
    the worker that holds it; ``fail`` queues it again, or ends it as ``dead`` at ``max_attempts``. Outcomes: ok, replay, refused, unknown."""
    import datetime

    lease = datetime.timedelta(seconds=lease_seconds)

    def step(s: dict, op: str, worker: str, at) -> tuple:
        out = "refused"
        if op == "enqueue":
            out = "replay" if s["status"] else "ok"
            s["status"] = s["status"] or "queued"
        elif not s["status"]:
            out = "unknown"
        elif op == "claim":
            if s["status"] == "queued" or s["status"] == "running" and s["until"] < at:
                s.update(status="running", worker=worker, until=at + lease, attempts=s["attempts"] + 1)
                out = "ok"
        elif s["status"] == "running" and s["worker"] == worker:
            out = "ok"
            if op == "heartbeat":
                s["until"] = at + lease
            elif op == "complete":
                s["status"] = "done"
            else:
                s.update(status="dead" if s["attempts"] >= max_attempts else "queued", worker=None, until=None)
        return out, s["status"], s["attempts"], s["until"]

    begin = lambda: {"status": None, "worker": None, "until": None, "attempts": 0}
    return fold(events, "job_id", ["seq"], ["op", "worker", "at"], begin, step, {"outcome": T.StringType(), "status": T.StringType(), "attempts": T.IntegerType(), "lease_until": T.TimestampNTZType()})


def mutate(requests: DataFrame, apply: Callable[[dict, str, str], str], actor: str = "actor") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Guarded mutations of objects: (results, ledger, audit). A request (object_id, seq, expected_version, idempotency_key, field, value, actor)
    whose key was seen before gets the stored result; one that expects another version than the object has is a conflict that carries the
    current one; else ``apply`` changes the object's fields and names the result, and the version goes up. Applied requests give one
    ledger row and one audit event each, others neither."""

    def step(s: dict, expected: int | None, key: str | None, field: str, value: str) -> tuple:
        if key is not None and key in s["seen"]:
            return ("replay", *s["seen"][key])
        if expected is not None and expected != s["version"]:
            return "conflict", s["version"], None
        result = apply(s["fields"], field, value)
        s["version"] += 1
        if key is not None:
            s["seen"][key] = (s["version"], result)
        return "applied", s["version"], result

    begin = lambda: {"version": 1, "fields": {}, "seen": {}}
    done = fold(requests, "object_id", ["seq"], ["expected_version", "idempotency_key", "field", "value"], begin, step, {"outcome": T.StringType(), "version": T.LongType(), "result": T.StringType()})
    applied = done.where("outcome = 'applied'")
    ledger = applied.select("object_id", F.col("version").alias("new_version"), "idempotency_key", F.col(actor).alias("actor"), "result")
    event = {"event": F.lit("mutation"), "actor": F.col(actor), "object": F.col("object_id").cast("string"), "new_version": F.col("version"), "idempotency_key": F.col("idempotency_key")}
    return done, ledger, applied.select("object_id", "seq", canonical_json(event).alias("body"))


def replace_field(fields: dict, name: str, value: str) -> str:
    """Sets one field of an object; no value removes it. The result is what stood there."""
    old = fields.pop(name, None)
    if value is not None:
        fields[name] = value
    return old or ""


def issue_tokens(requests: DataFrame, ttl_seconds: int = 3600) -> DataFrame:
    """(token_id, principal, issued_at, expires_at) of requests (token_id, principal, at)."""
    return requests.select("token_id", "principal", F.col("at").alias("issued_at"), (F.col("at") + F.expr(f"INTERVAL {ttl_seconds} SECONDS")).alias("expires_at"))


def revoke_tokens(tokens: DataFrame, revocations: DataFrame) -> DataFrame:
    """Tokens with ``revoked_at``, the first revocation (token_id, at); later ones change nothing."""
    first = revocations.groupBy("token_id").agg(F.min("at").alias("revoked_at"))
    return tokens.join(first, "token_id", "left")


def token_checks(asked: DataFrame, tokens: DataFrame, principals: DataFrame) -> DataFrame:
    """``asked`` (token_id, at) with (principal, verdict): expired, unknown, revoked, inactive or valid, the first that holds; signatures are
    checked where tokens come in, not here."""
    p = principals.select("principal", "active")
    met = asked.join(tokens.select("token_id", "principal", "expires_at", "revoked_at", F.lit(True).alias("known")), "token_id", "left").join(p, "principal", "left")
    verdict = (
        F.when(F.col("known").isNull(), "unknown").when(F.col("expires_at") < F.col("at"), "expired").when(F.col("revoked_at") <= F.col("at"), "revoked")
        .when(~F.coalesce("active", F.lit(False)), "inactive").otherwise("valid")
    )
    return met.select("token_id", "at", "principal", verdict.alias("verdict"))


def access_changes(changes: DataFrame) -> DataFrame:
    """Changes (old_level, new_level, old_domains, new_domains, is_admin, confirmed) with (outcome, event): narrowing is free, widening needs
    an administrator's confirmation; the audit tells them apart."""
    wide = widening(F.col("old_level"), F.col("new_level"), F.col("old_domains"), F.col("new_domains"))
    ok = ~wide | (F.col("is_admin") & F.col("confirmed"))
    return changes.withColumns({"outcome": F.when(ok, "applied").otherwise("refused"), "event": F.when(~ok, "access-widening-refused").when(wide, "access-widened").otherwise("access-changed")})


def legal_holds(requests: DataFrame) -> DataFrame:
    """Requests (object_id, seq, hold, is_admin) with (outcome, event, held): only administrators set or lift a hold, other attempts are
    recorded; ``held`` is the state after the request."""
    from pyspark.sql import Window

    ok = F.col("is_admin")
    w = Window.partitionBy("object_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    held = F.coalesce(F.last(F.when(ok, F.col("hold")), ignorenulls=True).over(w), F.lit(False))
    return requests.withColumns({"outcome": F.when(ok, "applied").otherwise("refused"), "event": F.when(ok & F.col("hold"), "legal-hold-set").when(ok, "legal-hold-lifted").otherwise("legal-hold-blocked"), "held": held})


def capacity_tasks(volumes: DataFrame, open_tasks: DataFrame, threshold: Column | float = 0.8) -> DataFrame:
    """(volume, used_share, key): one task for every volume that is used to ``threshold`` or more and has no task of that key yet."""
    share = F.when(F.col("total") > 0, F.col("used") / F.col("total"))
    due = volumes.select("volume", share.alias("used_share"), F.concat(F.lit("capacity:"), F.col("volume").cast("string")).alias("key")).where(F.col("used_share") >= threshold)
    return due.join(open_tasks.select("key"), "key", "left_anti").select("volume", "used_share", "key")


def review_jobs(before: DataFrame, after: DataFrame) -> DataFrame:
    """(object_kind, object_id, key) of the objects that appended records brought into conflict: one review each, by its key."""
    keys = ["object_kind", "object_id"]
    was = before.where("conflict").select(*keys)
    return after.where("conflict").select(*keys).join(was, keys, "left_anti").withColumn("key", F.concat_ws(":", F.lit("review"), *keys))


def not_there(new: DataFrame, old: DataFrame, keys: list[str]) -> DataFrame:
    """Insert-or-ignore: rows of ``new`` whose key neither ``old`` has nor an earlier one of ``new`` (by all columns)."""
    cols = [c for c in new.columns if c not in keys]
    once = new.groupBy(*keys).agg(F.min(F.struct(*cols)).alias("__r")).select(*keys, "__r.*") if cols else new.distinct()
    return once.join(old.select(*keys), keys, "left_anti")


def violations(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """(key, change) of what an append-only table must not show between two snapshots: rows ``deleted`` or ``changed``."""
    cols = [c for c in before.columns if c != key]
    seal = F.xxhash64(*[F.col(f"`{c}`") for c in cols])
    a, b = before.select(key, seal.alias("a")).distinct(), after.select(key, seal.alias("b"), F.lit(True).alias("there")).distinct()
    met = a.join(b, key, "left").groupBy(key, "a").agg(F.max("there").alias("there"), F.max((F.col("a") == F.col("b")).cast("int")).alias("same"))
    return met.select(key, F.when(F.col("there").isNull(), "deleted").when(F.col("same") == 0, "changed").alias("change")).where("change IS NOT NULL")
