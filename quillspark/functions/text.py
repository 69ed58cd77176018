"""Column functions over text: normalisation, tokens, hashes, names."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

MEANINGFUL = r"[\p{L}\p{N}]"
#: RFC 4122's URL namespace.
URL_NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"


def collapse(x: Column) -> Column:
    """Any Unicode white space run as one space, none at the ends."""
    return F.trim(F.regexp_replace(x, r"(?U)\s+", " "))


def normalized_lines(x: Column) -> Column:
    """Collapsed lines, those without a letter or digit dropped."""
    return F.filter(F.transform(F.split(x, r"\r?\n"), collapse), lambda y: y.rlike(MEANINGFUL))


def normalize_body(x: Column) -> Column:
    return F.array_join(normalized_lines(x), "\n\n")


def meaningful(x: Column) -> Column:
    """At least two letters or digits."""
    return F.length(F.regexp_replace(x, r"[^\p{L}\p{N}]", "")) >= 2


def record_hash(title: Column, summary: Column, body: Column, uri: Column, metadata: Column) -> Column:
    return F.sha2(F.concat_ws("\n", title, F.coalesce(summary, F.lit("")), body, uri, metadata), 256)


def uuid5_url(name: Column) -> Column:
    """UUIDv5 of a name in the URL namespace."""
    h = F.sha1(F.concat(F.unhex(F.lit(URL_NAMESPACE)), F.encode(name, "UTF-8")))
    variant = F.substring(F.lit("89ab"), F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4 + 1, F.lit(1))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def query_terms(x: str) -> list[str]:
    """Lower-case terms of a search phrase, split at white space and ASCII punctuation."""
    import re
    import string

    return [t for t in re.split(rf"[\s{re.escape(string.punctuation)}]+", x.lower()) if t]


def code_tokens(phrase: str) -> list[str]:
    """Distinct code tokens of a phrase."""
    import re

    return list(dict.fromkeys(t for t in re.split(r"[^\w$:./-]+", phrase.lower()) if t))


def safe_filename(title: Column, extension: str) -> Column:
    """Reserved characters become underscores, control characters spaces; the extension is set once."""
    name = F.trim(F.regexp_replace(F.regexp_replace(title, r'[<>:"/\\|?*]', "_"), r"[\x00-\x1f\x7f]", " "))
    stem = F.regexp_replace(name, rf"(?i)\.{extension}$", "")
    return F.concat(F.when(stem == "", F.lit("document")).otherwise(stem), F.lit(f".{extension}"))


def retry_seconds(attempt: Column) -> Column:
    """5, 10, 20 ... seconds, 300 at most."""
    return F.least(F.lit(300), (F.lit(5) * F.pow(F.lit(2.0), F.least(attempt, F.lit(30)) - 1)).cast("long"))


def error_class(message: Column, rules: dict[str, str], other: str = "other") -> Column:
    """The first class whose pattern the message has, in any case."""
    out = F.lit(other)
    for name, pattern in reversed(rules.items()):
        out = F.when(F.lower(message).rlike(pattern), name).otherwise(out)
    return out


def one_line(x: Column, most: int = 512) -> Column:
    """Control characters and white space as single spaces, at most so many characters."""
    return F.substring(F.trim(F.regexp_replace(x, r"[\s\x00-\x1f\x7f]+", " ")), 1, most)


def fingerprint(*parts: Column) -> Column:
    """sha256 over the parts, each behind its length in bytes, so that no two lists of parts look alike; a null part differs from an empty one."""
    framed = [F.coalesce(F.concat(F.octet_length(p).cast("string"), F.lit(":"), p), F.lit("-:")) for p in parts]
    return F.sha2(F.concat(*framed), 256)


def instant(x: Column, latest: str = "3000-01-01T00:00:00Z") -> Column:
    """The instant of an RFC 3339 text, held between the epoch and ``latest``; null for other texts."""
    bound = lambda t: F.lit(t).cast("timestamp")
    known = F.when(x.rlike(r"^\d{4}-\d\d-\d\d[Tt ]\d\d:\d\d:\d\d(\.\d+)?([Zz]|[+-]\d\d:\d\d)$"), F.upper(x).try_cast("timestamp"))
    return F.when(known.isNotNull(), F.least(F.greatest(known, bound("1970-01-01T00:00:00Z")), bound(latest)))
