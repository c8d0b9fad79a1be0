"""Text functions: words, lexemes, trigrams, hashes, citations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What stands between two words of the ``simple`` configuration.
BREAK = r"[^\p{L}\p{N}]+"

#: English words that carry no meaning of their own.
STOP_WORDS = (
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself "
    "they them their theirs themselves what which who whom this that these those am is are was were be been being have has had having "
    "do does did doing a an the and but if or because as until while of at by for with about against between into through during before "
    "after above below to from up down in out on off over under again further then once here there when where why how all any both each "
    "few more most other some such no nor not only own same so than too very s t can will just don should now"
).split()


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def simple_tokens(text: Column | str) -> Column:
    """Lowered runs of letters and digits, in order; null has none."""
    return F.filter(F.split(F.lower(F.coalesce(_c(text), F.lit(""))), BREAK), lambda w: w != "")


def token_count(text: Column | str) -> Column:
    """Words between white space."""
    return F.size(F.filter(F.split(F.coalesce(_c(text), F.lit("")), r"\s+"), lambda w: w != ""))


def content_hash(content: Column | str) -> Column:
    """SHA-256 of the bytes, lower-case hex."""
    return F.sha2(_c(content), 256)


def trigrams(name: Column | str) -> Column:
    """Distinct trigrams of the lowered name with two spaces put on both sides."""
    p = F.concat(F.lit("  "), F.lower(_c(name)), F.lit("  "))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(p) - 2), lambda i: F.substring(p, i, F.lit(3))))


def word_trigrams(name: Column | str) -> Column:
    """Distinct trigrams of each alphanumeric word, two spaces before and one after it."""
    def of(w: Column) -> Column:
        p = F.concat(F.lit("  "), w, F.lit(" "))
        return F.transform(F.sequence(F.lit(1), F.length(p) - 2), lambda i: F.substring(p, i, F.lit(3)))

    return F.array_distinct(F.flatten(F.transform(simple_tokens(name), of)))


def jaccard(a: Column | str, b: Column | str) -> Column:
    """Overlap of two arrays of distinct values; two empty ones are alike."""
    a, b = _c(a), _c(b)
    both = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - both
    return F.when(union == 0, F.lit(1.0)).otherwise(both / union)


def trigram_similarity(a: Column | str, b: Column | str) -> Column:
    return jaccard(trigrams(a), trigrams(b))


def word_trigram_similarity(a: Column | str, b: Column | str) -> Column:
    """As ``trigram_similarity``, but deaf to punctuation and the order of words."""
    return jaccard(word_trigrams(a), word_trigrams(b))


def citations(answer: Column | str, n: Column | str | int) -> Column:
    """Numbers cited as [k] with 1 <= k <= n, each once, by first appearance."""
    n = F.lit(n) if isinstance(n, int) else _c(n)
    found = F.transform(F.regexp_extract_all(F.coalesce(_c(answer), F.lit("")), F.lit(r"\[(\d{1,9})\]"), 1), lambda x: x.cast("int"))
    return F.array_distinct(F.filter(found, lambda k: (k >= 1) & (k <= n)))


def stable_uuid(*parts: Column | str) -> Column:
    """A UUID-shaped id from the parts' digest, with version and variant bits set."""
    h = F.sha2(F.concat_ws("\x1f", *[F.coalesce(_c(p).cast("string"), F.lit("\x00")) for p in parts]), 256)
    variant = F.substring(F.lit("89ab"), (F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4 + 1), F.lit(1))
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-4"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))


def payload_kind(payload: Column | str) -> Column:
    """path (no payload), text (valid UTF-8) or bytes."""
    p = _c(payload)
    return F.when(p.isNull(), "path").when(F.is_valid_utf8(p.cast("string")), "text").otherwise("bytes")
