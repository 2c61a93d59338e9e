"""Text expressions: everything here is a built-in column expression that stays in generated code."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from parchline.model.constants import CHUNK_OVERLAP, CHUNK_TOKENS, COMMON_WORDS, PHI_STRONG, PHI_WEAK, STOP_WORDS

#: Unicode white space for a Java character class; plain \s misses the no-break space
BLANKS = r"\x09-\x0d\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
# fixed values: reference designators and part numbers
REFDES = r"^(?:[RCLQDJKWFY]|CR|IC|U|VR|TP|XT)\d{1,4}[A-Za-z]?$"
PART_NUMBER = r"^[A-Z0-9][A-Z0-9-]{3,}$"


def folding() -> tuple[str, str]:
    """Latin letters with marks and their base letters, built from the Unicode decompositions."""
    marked, plain = [], []
    for code in range(0xC0, 0x250):
        base = unicodedata.normalize("NFD", chr(code))[0]
        if base != chr(code) and base.isascii():
            marked.append(chr(code))
            plain.append(base)
    return "".join(marked), "".join(plain)


def fold(text: Column) -> Column:
    """Lower case without diacritics."""
    return F.lower(F.translate(text, *folding()))


def search_terms(text: Column) -> Column:
    """Terms of the index: letters, digits and - / . in a row."""
    return F.regexp_extract_all(fold(text), F.lit(r"[\p{L}\p{N}\p{Co}\-/.]+"), F.lit(0))


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), lambda v: body(v)), F.lit(0))


def tokens(text: Column) -> Column:
    """What Unicode white space separates."""
    return F.filter(F.split(text, f"[{BLANKS}]+"), lambda x: x != "")


def chunk_windows(text: Column, size: int = CHUNK_TOKENS, overlap: int = CHUNK_OVERLAP) -> Column:
    """Windows of ``size`` tokens that start ``size - overlap`` apart; one window if all fit, none without tokens; null for null."""

    def cut(t: Column) -> Column:
        n = F.size(t)
        starts = F.when(n <= size, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.greatest(n - overlap - 1, F.lit(0)), F.lit(size - overlap)))
        return F.when(n == 0, F.array().cast("array<string>")).otherwise(F.transform(starts, lambda s: F.array_join(F.slice(t, s + 1, size), " ")))

    return F.when(text.isNotNull(), let(tokens(text), cut))


def words(text: Column) -> Column:
    """Tokens in lower case without punctuation around them, empty ones left out."""
    bare = F.transform(tokens(text), lambda x: F.lower(F.btrim(x, F.lit(".,;:()[]\"'!?"))))
    return F.filter(bare, lambda x: x != "")


def plausible(word: Column, lexicon: list[str] = COMMON_WORDS) -> Column:
    """Whether a bare word could be one; null for what is not plain letters. ``lexicon`` are known words."""
    return (
        F.when(~word.rlike("^[a-z]+$"), F.lit(None).cast("boolean"))
        .when(word.isin(lexicon) | (F.length(word) <= 2), True)
        .when((F.length(word) > 20) | ~word.rlike("[aeiouy]") | word.rlike("[^aeiouy]{5,}"), False)
        .otherwise(True)
    )


def garble_fraction(text: Column, lexicon: list[str] = COMMON_WORDS) -> Column:
    """Share of implausible words; null with fewer than five that count."""
    judged = F.filter(F.transform(words(text), lambda w: plausible(w, lexicon)), lambda p: p.isNotNull())
    return let(judged, lambda j: F.when(F.size(j) >= 5, F.size(F.filter(j, lambda p: ~p)) / F.size(j)))


def is_refdes(token: Column) -> Column:
    """A reference designator or part number."""
    t = F.btrim(token, F.lit(".,;:()[]"))
    return t.rlike(REFDES) | (t.rlike(PART_NUMBER) & t.rlike("[0-9]") & t.rlike("[A-Z]"))


def language_votes(text: Column) -> Column:
    """A struct of the stop words of each language among the bare tokens, and the number n of these."""
    bare = F.filter(F.transform(tokens(text), lambda x: F.lower(F.btrim(x, F.lit(".,;:()[]\"'!?®™")))), lambda x: x != "")

    def count(b: Column) -> Column:
        # a lambda with a default would be taken for one with an index
        among = lambda w: F.size(F.filter(b, lambda x: x.isin(w)))
        return F.struct(*[among(w).alias(lang) for lang, w in STOP_WORDS.items()], F.size(b).alias("n"))

    return let(bare, count)


def vote_winner(votes: Column) -> Column:
    """The language with the most votes, if it has three and half as many again as the next; ties go to none."""

    def choose(v: Column) -> Column:
        def best(c: Column) -> Column:
            name = F.lit(None).cast("string")
            for lang in reversed(list(STOP_WORDS)):
                name = F.when(v[lang] == c[0], lang).otherwise(name)
            return F.when((v["n"] >= 10) & (c[0] >= 3) & (c[0] >= 1.5 * c[1]), name)

        return let(F.sort_array(F.array(*[v[k] for k in STOP_WORDS]), asc=False), best)

    return let(votes, choose)


def letter_counts(text: Column) -> dict[str, Column]:
    count = lambda p: F.regexp_count(text, F.lit(p))
    return {"kana": count(r"[\x{3040}-\x{30ff}]"), "han": count(r"[\x{4e00}-\x{9fff}]"), "latin": count("[A-Za-z]")}


def text_language(kana: Column, han: Column, latin: Column, vote: Column) -> Column:
    """Script shares first, the vote for Latin script, English if the vote is open."""
    n = kana + han + latin
    return F.when(n < 10, F.lit(None).cast("string")).when(kana / n > 0.05, "jpn").when(han / n > 0.5, F.lit(None).cast("string")).when(latin / n > 0.8, F.coalesce(vote, F.lit("eng")))


def term_pattern(term: str) -> str:
    """A term that no ASCII letter touches."""
    return rf"(?<![a-z])\Q{term}\E(?![a-z])"


def phi_verdict(text: Column, strong: list[str] = PHI_STRONG, weak: list[str] = PHI_WEAK) -> Column:
    """Refusal reason of the first strong term, of several weak ones or of one; null if the text passes."""
    low = F.lower(text)
    out = F.lit(None).cast("string")
    hits = F.filter(F.array(*[F.when(low.rlike(term_pattern(t)), F.lit(t)) for t in weak]), lambda x: x.isNotNull())
    out = F.when(F.size(hits) >= 2, "phi-multiple-weak-indicators").when(F.size(hits) == 1, F.concat(F.lit("phi-uncertain:"), hits[0]))
    first = F.lit(None).cast("string")
    for t in reversed(strong):
        first = F.when(low.rlike(term_pattern(t)), "phi-strong-indicator:" + t.replace(" ", "-")).otherwise(first)
    return F.coalesce(first, out)
