"""The locale of a text by its script and its commonest words."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

LEAST_CONFIDENCE = 0.65
#: Frequent words that the other languages here lack, by code.
COMMON_WORDS = {
    "en": "the and of to is that it was with on this are from".split(),
    "fra": "le les des et une est pour dans qui sur au avec".split(),
    "deu": "der die das und ist von mit ein eine nicht zu auf".split(),
    "spa": "el los las y una por con para del como pero más".split(),
}


def detect_locale(text: Column) -> Column:
    """en, fra, deu, spa or zh, if that one has LEAST_CONFIDENCE of the common words and Han characters found; else null."""
    words = F.split(F.lower(text), r"[^\p{L}]+")
    among = lambda own: F.size(F.filter(words, lambda w: w.isin(*own)))
    found = {code: among(own) for code, own in COMMON_WORDS.items()}
    found["zh"] = F.length(F.regexp_replace(text, r"[^\p{IsHan}]", ""))
    total = sum(found.values(), F.lit(0))
    out = F.lit(None).cast("string")
    for code, n in found.items():
        out = F.when((total > 0) & (n >= LEAST_CONFIDENCE * total), code).otherwise(out)
    return out
