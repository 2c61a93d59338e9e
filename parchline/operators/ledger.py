"""Append-only ledgers: idempotent requests, outbox, hash-chained audit, dependants."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parchline.session import Scratch


def first_by_key(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Of each idempotency key the first request; later ones are replays. Rows without a key are requests of their own."""
    cols = [c for c in df.columns if c != key]
    at = F.struct(*order)
    keyed = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.min_by(F.struct(*cols), at).alias("r"), F.count("*").alias("seen"))
    keyed = keyed.select(key, "r.*", (F.col("seen") - 1).alias("replays"))
    return keyed.unionByName(df.where(F.col(key).isNull()).withColumn("replays", F.lit(0).cast("bigint")))


def answers(df: DataFrame, key: str, order: list[str], result: str) -> DataFrame:
    """Every request with the answer it gets: the result of the first one of its key, and whether that is a replay. Rows without a key are
    answered each by itself. A key with very many requests is one row of the first answers, which all of them are joined with."""
    at = F.struct(*order)
    first = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.min_by(F.struct(result), at).alias("__r"), F.min(at).alias("__at"))
    met = df.join(first, key, "left")
    again = F.col("__at").isNotNull() & (at != F.col("__at"))
    return met.withColumns({result: F.when(F.col("__at").isNotNull(), F.col("__r")[result]).otherwise(F.col(result)), "replayed": F.coalesce(again, F.lit(False))}).drop("__r", "__at")


def fold_versions(requests: DataFrame, obj: str = "object_id", order: str = "seq", expected: str = "expected_version", key: str = "idempotency_key") -> DataFrame:
    """Optimistic versions: requests of an object in order; one is applied if it expects the version the object then has,
    else it is a conflict; a key seen before is a replay. Adds (outcome, version). The order of one object's requests is the
    result, so this is a sorted stream per object: rows are sorted within partitions and folded as they pass."""
    names = [obj, order, expected, key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, version, seen = None, 1, {}
        for b in batches:
            cols = [b.column(b.schema.get_field_index(n)).to_pylist() for n in names]
            out, vs = [], []
            for o, _, want, k in zip(*cols, strict=True):
                if o != current:
                    current, version, seen = o, 1, {}
                if k is not None and k in seen:
                    res, v = "replay", seen[k]
                elif want is not None and want != version:
                    res, v = "conflict", version
                else:
                    version += 1
                    res, v = "applied", version
                    if k is not None:
                        seen[k] = v
                out.append(res)
                vs.append(v)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.string()), pa.array(vs, pa.int64())], names=[*b.schema.names, "outcome", "version"])

    from pyspark.sql import types as T

    schema = T.StructType([*requests.schema.fields, T.StructField("outcome", T.StringType()), T.StructField("version", T.LongType())])
    return requests.repartition(obj).sortWithinPartitions(obj, order).mapInArrow(run, schema)


def outbox_status(outbox: DataFrame, by: list[str]) -> DataFrame:
    """(by, total, pending, failing) of rows with applied_at and attempts."""
    waiting = F.col("applied_at").isNull()
    return outbox.groupBy(*by).agg(F.count("*").alias("total"), F.count_if(waiting).alias("pending"), F.count_if(waiting & (F.col("attempts") > 0)).alias("failing"))


def pending(outbox: DataFrame, limit: int = 100) -> DataFrame:
    return outbox.where("applied_at IS NULL").orderBy("id").limit(limit)


def next_jobs(jobs: DataFrame, as_of: str, by: list[str], n: int = 1) -> DataFrame:
    """Of each queue the next runnable jobs: queued, or running on a lease that has run out; priority, then age."""
    runnable = (F.col("state") == "queued") | ((F.col("state") == "running") & (F.col("lease_until") < F.lit(as_of).cast("timestamp_ntz")))
    w = Window.partitionBy(*by).orderBy(F.desc("priority"), F.asc("created_at"), F.asc("id"))
    return jobs.where(runnable).withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)


def chain_hashes(events: DataFrame, order: list[str], body: str, start: str = "") -> DataFrame:
    """The audit chain: hash_n = sha256(hash_(n-1) || body_n), which is sequential by definition. Rows pass in global order;
    each partition of the sort is folded after the one before it, so the chain never sits in one task."""
    import hashlib

    spark = events.sparkSession
    scratch = Scratch(spark, "chain")
    by_place = events.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__part", F.spark_partition_id())
    ordered = scratch.save(by_place, "ordered")
    last, done = start, None
    for part in [r[0] for r in ordered.select("__part").distinct().orderBy("__part").collect()]:

        def run(batches: Iterator[pa.RecordBatch], head: str = last) -> Iterator[pa.RecordBatch]:
            for b in batches:
                prev, own = [], []
                for t in b.column(b.schema.get_field_index(body)).to_pylist():
                    prev.append(head)
                    head = hashlib.sha256((head + (t or "")).encode()).hexdigest()
                    own.append(head)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(prev, pa.string()), pa.array(own, pa.string())], names=[*b.schema.names, "prev", "hash"])

        from pyspark.sql import types as T

        schema = T.StructType([*events.schema.fields, T.StructField("prev", T.StringType()), T.StructField("hash", T.StringType())])
        rows = ordered.where(F.col("__part") == part).drop("__part").coalesce(1).sortWithinPartitions(*order)
        link = scratch.save(rows.mapInArrow(run, schema), "link")
        tail = link.orderBy(*[F.desc(c) for c in order]).select("hash").first()
        last = tail[0] if tail else last
        done = link if done is None else done.unionByName(link)
    return done


def verify_chain(lines: DataFrame, number: str = "line_no", body: str = "body", start: str = "") -> DataFrame:
    """(line_no, reason) of lines that break the chain: ``tampered`` if the line's own hash is wrong, ``prev mismatch`` if it does
    not name the line before. Every line is checked against its neighbour by number, so the check needs no order."""
    before = lines.select((F.col(number) + 1).alias(number), F.col("hash").alias("__before"))
    joined = lines.join(before, number, "left")
    expect = F.coalesce("__before", F.when(F.col(number) == 1, F.lit(start)))
    reason = F.when(~F.col("prev").eqNullSafe(expect), "prev mismatch").when(F.sha2(F.concat("prev", F.coalesce(body, F.lit(""))), 256) != F.col("hash"), "tampered")
    return joined.withColumn("reason", reason).where("reason IS NOT NULL").select(number, "reason")


def stale(edges: DataFrame, changed: DataFrame, max_hops: int | None = None) -> DataFrame:
    """(node, hops) of everything that depends on ``changed`` (node) over edges (source, dependent), by the nearest one.

    Nodes with one source form chains: by pointer jumping each learns, in as many rounds as the logarithm of the longest chain, its nearest
    changed node along the chain and the chain's top. Nodes with several sources meet through these chains, and only they
    are settled round by round, which takes as many rounds as the most of them on one shortest way. Loops end: a round that brings
    nothing nearer is the last. Every round is a written table."""
    scratch = Scratch(edges.sparkSession, "stale")
    e = scratch.save(edges.select("source", "dependent").where("source IS NOT NULL AND dependent IS NOT NULL").distinct(), "edges")
    gone = scratch.save(changed.select("node").where("node IS NOT NULL").distinct(), "changed")
    hit = gone.select(F.col("node").alias("source"), F.lit(1).alias("near"))
    if max_hops == 1:
        near = e.join(hit, "source").select(F.col("dependent").alias("node"), F.lit(1).alias("hops")).distinct()
        return near.join(gone, "node", "left_anti")
    count = e.groupBy("dependent").agg(F.count("*").alias("n"), F.min("source").alias("source"))
    single = count.where("n = 1").select(F.col("dependent").alias("node"), "source")
    # (node, up, far, near): up is far steps above, near the steps to the nearest changed node among them
    rows = scratch.save(single.join(hit, "source", "left").select("node", F.col("source").alias("up"), F.lit(1).alias("far"), "near"), "chain")
    before = None
    while True:
        look = rows.select(F.col("node").alias("up"), F.col("up").alias("up2"), F.col("far").alias("far2"), F.col("near").alias("near2"))
        step = rows.join(look, "up", "left").select(
            "node", F.coalesce("up2", "up").alias("up"), (F.col("far") + F.coalesce("far2", F.lit(0))).alias("far"), F.least("near", F.col("far") + F.col("near2")).alias("near"), F.col("up2").isNotNull().alias("open")
        )
        step = scratch.save(step, "chain")
        now = step.agg(F.count_if("open"), F.count("near"), F.sum("near")).first()
        scratch.drop(rows)
        rows = step.drop("open")
        rows._parchline_path = step._parchline_path
        # the farther of two steps is seen only when all nearer ones are: what brings nothing new will bring nothing later
        if not now[0] or now == before:
            break
        before = now
    several = scratch.save(count.where("n > 1").select(F.col("dependent").alias("node")), "several")
    met = e.join(several, e["dependent"] == several["node"], "left_semi").join(rows.withColumnRenamed("node", "source"), "source", "left").join(hit.withColumnRenamed("near", "own"), "source", "left")
    # ways into a node with several sources: from a changed node, or from the top of a source's chain, or the source itself
    direct = met.select(F.col("dependent").alias("node"), F.least("own", F.col("near") + 1).alias("hops")).where("hops IS NOT NULL")
    ways = met.select("dependent", F.coalesce("up", "source").alias("top"), (F.coalesce("far", F.lit(0)) + 1).alias("step"))
    ways = scratch.save(ways.join(several.withColumnRenamed("node", "top"), "top", "left_semi").groupBy("dependent", "top").agg(F.min("step").alias("step")), "ways")
    settled = scratch.save(direct.groupBy("node").agg(F.min("hops").alias("hops")), "settled")
    news = settled
    while ways.head(1):
        found = ways.join(news.withColumnRenamed("node", "top"), "top").groupBy(F.col("dependent").alias("node")).agg(F.min(F.col("hops") + F.col("step")).alias("hops"))
        news = scratch.save(found.join(settled.withColumnRenamed("hops", "had"), "node", "left").where("had IS NULL OR hops < had").select("node", "hops"), "news")
        if not news.head(1):
            break
        settled = scratch.save(settled.unionByName(news).groupBy("node").agg(F.min("hops").alias("hops")), "settled")
    chained = rows.join(settled.withColumnRenamed("node", "up").withColumnRenamed("hops", "above"), "up", "left").select("node", F.least("near", F.col("far") + F.col("above")).alias("hops"))
    out = chained.where("hops IS NOT NULL").unionByName(settled).join(gone, "node", "left_anti")
    return out if max_hops is None else out.where(F.col("hops") <= max_hops)


def segments(lines: DataFrame, number: str, line: str, most: int = 64 << 20) -> DataFrame:
    """Lines with the ``segment`` (from 0) of the stream that they go to: a new one where ``most`` bytes have been written before a line.
    Running sizes come from a global sort: sums per partition, then within partitions."""
    size = F.octet_length(line) + 1
    placed = Scratch(lines.sparkSession, "segments").save(lines.repartitionByRange(number).withColumn("__part", F.spark_partition_id()), "placed")
    # a row per partition of the sort
    sums = placed.groupBy("__part").agg(F.sum(size).alias("__sum"))
    before = F.coalesce(F.sum("__sum").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sums.select("__part", before.alias("__before"))
    inside = F.coalesce(F.sum(size).over(Window.partitionBy("__part").orderBy(number).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    out = placed.join(F.broadcast(offsets), "__part").withColumn("segment", F.floor((F.col("__before") + inside) / most).cast("bigint"))
    return out.drop("__part", "__before")


def audit_lines(chain: DataFrame, number: str = "line_no", body: str = "body") -> DataFrame:
    """(line_no, line): the stored form of a hashed chain: one JSON object a line with body, prev and hash."""
    line = F.concat(F.lit('{"body":'), body, F.lit(',"hash":"'), "hash", F.lit('","prev":"'), "prev", F.lit('"}'))
    return chain.select(F.col(number).alias("line_no"), line.alias("line"))


def write_audit(chain: DataFrame, path: str, most: int = 64 << 20) -> None:
    """Appends the lines of a hashed chain to text files below ``path``, a folder for each segment; lines are in order within a file, and
    the files of a segment by name."""
    rows = segments(audit_lines(chain), "line_no", "line", most)
    rows.repartitionByRange("segment", "line_no").sortWithinPartitions("segment", "line_no").select("segment", "line").write.mode("append").partitionBy("segment").text(path)


def verify_lines(lines: DataFrame, start: str = "") -> DataFrame:
    """(line_no, reason) of stored lines (line_no, line) that do not hold: ``unparseable``, ``prev mismatch`` if a line does not name the one
    before it (also where that one is missing or unreadable), ``tampered`` if its own hash is wrong."""
    parsed = lines.select("line_no", F.from_json("line", "hash string, prev string").alias("j"), F.regexp_extract("line", r'^\{"body":(.*),"hash":"[0-9a-f]*","prev":"[0-9a-f]*"\}$', 1).alias("body"))
    fit = F.col("j.hash").isNotNull() & F.col("j.prev").isNotNull() & (F.col("body") != "")
    good = parsed.where(fit).select("line_no", F.col("j.hash").alias("hash"), F.col("j.prev").alias("prev"), "body")
    broken = parsed.where(~F.coalesce(fit, F.lit(False))).select("line_no", F.lit("unparseable").alias("reason"))
    return broken.unionByName(verify_chain(good, start=start))
