"""Row-level access: a document is visible to a principal that holds, in one of the document's domains, a ceiling not
below the document's sensitivity. Missing or misspelt facts make a document invisible. The predicate is one
expression, so it is pushed below joins and aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parchline.model.constants import SENSITIVITY


def rank(level: Column) -> Column:
    """Place of a sensitivity level; null for an unknown one."""
    at = F.array_position(F.array(*[F.lit(s) for s in SENSITIVITY]), level)
    return F.when(at > 0, at - 1)


def domains(primary: Column, additional: Column) -> Column:
    """Primary and additional domains without nulls and repeats."""
    return F.array_distinct(F.array_compact(F.concat(F.array(primary), F.coalesce(additional, F.array().cast("array<string>")))))


def visible(grants: dict[str, str], primary: Column, additional: Column, sensitivity: Column, active: bool = True) -> Column:
    if not active or not grants:
        return F.lit(False)
    ceiling = F.create_map(*[x for d, s in sorted(grants.items()) for x in (F.lit(d), F.lit(s))])
    need = rank(sensitivity)
    return F.coalesce(F.exists(domains(primary, additional), lambda d: F.coalesce(rank(ceiling[d]) >= need, F.lit(False))), F.lit(False))


def filter_visible(df: DataFrame, grants: dict[str, str], active: bool = True) -> DataFrame:
    return df.where(visible(grants, F.col("primary_domain"), F.col("additional_domains"), F.col("sensitivity"), active))


def decode_domains(facts: Column) -> Column:
    """Domains that came as a JSON list of text; null where it is no list."""
    return F.from_json(facts, "array<string>")


def check_documents(asked: DataFrame, documents: DataFrame, grants: dict[str, str], verbs: list[str], verb: str = "read", active: bool = True) -> DataFrame:
    """The rows of ``documents`` for the ids in ``asked`` (document_id) that the caller may see. Absent and forbidden ones are both just
    not there, so asking tells nothing."""
    require_verb(verbs if active else [], verb)
    return filter_visible(documents, grants, active).join(asked.select("document_id").distinct(), "document_id", "left_semi")


def require_verb(verbs: list[str], verb: str) -> None:
    if verb not in verbs:
        raise PermissionError(verb)


def widening(old_level: Column, new_level: Column, old_domains: Column, new_domains: Column) -> Column:
    """A lower sensitivity or a domain that was not there."""
    return F.coalesce(rank(new_level) < rank(old_level), F.lit(False)) | (F.size(F.array_except(new_domains, old_domains)) > 0)
