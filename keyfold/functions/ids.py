"""Id helpers (H5 uuid_valid, H6 batch_key)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# fixed value: the nil UUID
NIL_UUID = "00000000-0000-0000-0000-000000000000"
# Object key prefix of stored batches: a deployment setting (the service
# uses its own name here); pass yours to ``batch_key``.
BATCH_KEY_PREFIX = "anchor/batch/"


# fixed values: the spellings that the service's id decoder takes
_UUID_FORMS = (r"\A(?:(?:(?i:urn:uuid:))?[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"
               r"|\{[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\}"
               r"|[0-9a-fA-F]{32})\z")

_CANONICAL = r"\A[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\z"


def canonical_uuid(c: Column) -> Column:
    """The lower-case dashed form of any accepted spelling (dashed, with a
    ``urn:uuid:`` prefix, in braces, or 32 plain digits); null for other text.
    The whole text counts, a line break at its end included."""
    digits = F.right(F.translate(F.lower(c), "{}-", ""), F.lit(32))
    dashed = F.regexp_replace(digits, "(.{8})(.{4})(.{4})(.{4})(.{12})", "$1-$2-$3-$4-$5")
    return F.when(c.rlike(_CANONICAL), c).when(c.rlike(_UUID_FORMS), dashed)


def uuid_valid(c: Column) -> Column:
    """H5: an accepted spelling of an id other than the nil UUID (null is not
    valid): the rule by which messages are decoded."""
    return F.coalesce(canonical_uuid(c) != F.lit(NIL_UUID), F.lit(False))


def deterministic_batch_id(*parts: Column) -> Column:
    """H6: batch id as a UUID-shaped digest of the batch's identity, so a
    retried write produces the same id (the service draws a random one)."""
    h = F.sha2(F.concat_ws("|", *[p.cast("string") for p in parts]), 256)
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4),
                       F.substring(h, 13, 4), F.substring(h, 17, 4),
                       F.substring(h, 21, 12))


def batch_key(bid: Column, prefix: str = BATCH_KEY_PREFIX) -> Column:
    """H6: object key of a stored batch: ``prefix + bid``."""
    return F.concat(F.lit(prefix), bid)
