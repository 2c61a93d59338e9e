"""Canonical JSON, hashes and identifiers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ascii_json(json: Column) -> Column:
    """JSON text with every UTF-16 unit beyond ASCII written as an escape."""
    units = F.regexp_extract_all(F.hex(F.encode(json, "UTF-16BE")), F.lit("[0-9A-F]{4}"), F.lit(0))
    plain = lambda u: F.chr(F.conv(u, 16, 10).cast("int"))
    return F.when(json.rlike(r"[^\x00-\x7f]"), F.array_join(F.transform(units, lambda u: F.when(u < "0080", plain(u)).otherwise(F.concat(F.lit("\\u"), F.lower(u)))), "")).otherwise(json)


def canonical_json(fields: dict[str, Column]) -> Column:
    """An object with its keys in order, without blanks, in ASCII; nulls are written."""
    return ascii_json(F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]), {"ignoreNullFields": "false"}))


def config_hash(version: str, settings: Column) -> Column:
    return F.sha2(F.concat(F.lit(version + "\n"), settings), 256)


def time_id(prefix: str, at: Column, *of: Column) -> Column:
    """An identifier that sorts by time: milliseconds to base 36, and twelve hex digits that the values ``of`` determine."""
    return F.concat(F.lit(prefix + "_"), F.lower(F.conv(F.unix_millis(at.cast("timestamp")).cast("string"), 10, 36)), F.substring(F.sha2(F.concat_ws("\x1f", *of), 256), 1, 12))


def base64url(data: Column) -> Column:
    """URL-safe, without padding."""
    return F.rtrim(F.translate(F.base64(data), "+/", "-_"), F.lit("="))


def iso_utc(at: Column) -> Column:
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'")
