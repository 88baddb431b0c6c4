"""Stable identifiers built from SHA-256."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .variants import let


#: Stands for a NULL part of an identifier: no text part contains it, so a NULL never equals or shifts another part.
ABSENT = "\0"


def canonical_json(doc: Column) -> Column:
    """JSON text with the keys sorted at every depth. ``doc`` is JSON text."""
    return F.to_json(F.try_parse_json(doc))


def record_id(doc: Column) -> Column:
    """``sha256:`` and the hash of the canonical document."""
    return F.concat(F.lit("sha256:"), F.sha2(canonical_json(doc), 256))


def measured(part: Column) -> Column:
    """A part of a joined text after its length, so that no two lists of parts join to the same text."""
    return F.coalesce(F.concat(F.length(part).cast("string"), F.lit(":"), part), F.lit(ABSENT))


def event_id(tenant: Column, kind: Column, when: Column, payload: Column, plain: bool = False) -> Column:
    """First eight bytes (16 hex digits) of the hash over tenant, type, time and payload.

    ``plain`` joins the parts without their lengths, for ids that must equal older ones; there ``a|b`` and ``c`` equal ``a`` and ``b|c``.
    """
    parts = [F.trim(tenant), F.trim(kind), when, F.coalesce(payload, F.lit("null"))]
    seed = F.concat_ws("|", *[F.coalesce(p, F.lit(ABSENT)) if plain else measured(p) for p in parts])
    return F.substring(F.sha2(seed, 256), 1, 16)


def _key(tenant: Column, scope: Column, digest: Column) -> Column:
    owner = F.regexp_replace(F.lower(F.trim(tenant)), "[^a-z0-9_-]", "")
    area = F.lower(F.trim(scope))
    owner = F.coalesce(F.nullif(owner, F.lit("")), F.lit("local"))
    return F.when(area.rlike(r"\A[a-z0-9_-]+\z"), F.concat_ws(":", F.lit("v1"), owner, area, digest))


def idempotency_key(tenant: Column, scope: Column, parts: Sequence[Column]) -> Column:
    """``v1:tenant:scope:hash``; every part is measured so that joined parts cannot collide.

    The tenant keeps its lower-case letters, digits, ``_`` and ``-``, and is ``local`` without any; a scope with other
    characters, or none, gives NULL.
    """
    return _key(tenant, scope, F.sha2(F.concat_ws("|", *[measured(p) for p in parts]), 256))


def idempotency_key_of_map(tenant: Column, scope: Column, named: Column) -> Column:
    """``idempotency_key`` of a map of texts: names in lower case and sorted, each before its value; blank names are left out."""
    tidy = F.transform(F.map_entries(named), lambda e: F.struct(F.lower(F.trim(e["key"])).alias("key"), e["value"].alias("value")))
    entries = F.sort_array(F.filter(tidy, lambda e: e["key"] != ""))
    parts = F.flatten(F.transform(entries, lambda e: F.array(measured(e["key"]), measured(e["value"]))))
    return _key(tenant, scope, F.sha2(F.coalesce(F.array_join(parts, "|"), F.lit("")), 256))


# fixed values: offset and prime of the 64-bit FNV-1a hash
FNV_OFFSET, FNV_PRIME = 14695981039346656037, 1099511628211
#: The low 32 bits.
HALF = (1 << 32) - 1


def fnv1a_64(text: Column) -> Column:
    """The unsigned 64-bit FNV-1a hash of the text's bytes, as a decimal.

    The hash is kept as two longs of 32 bits. The prime is 2**40 + 435: its high part moves the low half by eight bits into the
    high one, and no product with 435 exceeds 41 bits.
    """
    halves = F.struct(F.lit(FNV_OFFSET >> 32).alias("high"), F.lit(FNV_OFFSET & HALF).alias("low"))
    decimal = lambda c: c.cast("decimal(20,0)")

    def step(h: Column, b: Column) -> Column:
        def times_prime(low: Column) -> Column:
            high = h["high"] * 435 + F.shiftright(low * 435, 32) + F.shiftleft(low, 8)
            return F.struct(high.bitwiseAND(F.lit(HALF)).alias("high"), (low * 435).bitwiseAND(F.lit(HALF)).alias("low"))

        return let(h["low"].bitwiseXOR(b), times_prime)

    number = lambda h: (decimal(h["high"]) * F.lit(str(1 << 32)).cast("decimal(10,0)") + decimal(h["low"])).cast("decimal(38,0)")
    hashed = F.aggregate(_bytes(text), halves, step, number)
    return F.when(F.octet_length(text) > 0, hashed).otherwise(F.lit(str(FNV_OFFSET)).cast("decimal(38,0)"))


def _bytes(text: Column) -> Column:
    """The bytes of a text as longs."""
    digit = lambda h, i: F.instr(F.lit("0123456789ABCDEF"), F.substring(h, i, F.lit(1))).cast("bigint") - 1
    return let(F.hex(text), lambda h: F.transform(F.sequence(F.lit(1), F.length(h), F.lit(2)), lambda i: digit(h, i) * 16 + digit(h, i + 1)))


def shard_for(tenant: Column, job: Column, shards: int) -> Column:
    """Shard of a job: FNV-1a over the trimmed lower-case tenant and job; a NULL part counts as empty."""
    tidy = [F.coalesce(F.lower(F.trim(c)), F.lit("")) for c in (tenant, job)]
    return (fnv1a_64(F.concat_ws("|", *tidy)) % F.lit(shards)).cast("bigint")


def hmac_sha256(secret: bytes, message: Column) -> Column:
    """HMAC-SHA256 in hex, from two SHA-256 calls over the padded key."""
    key = hashlib.sha256(secret).digest() if len(secret) > 64 else secret
    key = key.ljust(64, b"\0")
    inner = F.unhex(F.lit(bytes(b ^ 0x36 for b in key).hex()))
    outer = F.unhex(F.lit(bytes(b ^ 0x5C for b in key).hex()))
    digest = F.unhex(F.sha2(F.concat(inner, F.encode(message, "UTF-8")), 256))
    return F.sha2(F.concat(outer, digest), 256)
