"""Keyed hashes as columns, of built-in functions alone."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, functions as F

BLOCK = 64


def hmac_sha256(body: Column, key: bytes) -> Column:
    """HMAC-SHA256 in lowercase hex. The padded keys are prepared here; a null body has none."""
    own = (hashlib.sha256(key).digest() if len(key) > BLOCK else key).ljust(BLOCK, b"\0")
    pad = lambda x: F.unhex(F.lit(bytes(b ^ x for b in own).hex()))
    inner = F.unhex(F.sha2(F.concat(pad(0x36), body.cast("binary")), 256))
    return F.sha2(F.concat(pad(0x5C), inner), 256)


def signed(body: Column, key: bytes, raw: Column | None = None, hub: Column | None = None) -> Column:
    """Whether every signature that is there (raw hex; hub with ``sha256=`` before it) is well formed and the body's, and one is there at all."""
    want, out, some = hmac_sha256(body, key), F.lit(True), F.lit(False)
    for given, prefix in ((raw, ""), (hub, "sha256=")):
        if given is not None:
            fits = given.rlike(rf"\A{prefix}[0-9A-Fa-f]{{64}}\z") & (F.lower(F.right(given, F.lit(64))) == want)
            out &= given.isNull() | fits
            some |= given.isNotNull()
    return F.coalesce(out & some, F.lit(False))
