"""Identifiers: bucket signatures, name-based and time-based UUIDs, permission strings, stage addresses."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, functions as F

# fixed values: signature layout
_PART_LENGTH = 16
_SUFFIX_START = 21  # 1-based start of the last 12 of 32 hex digits
_SUFFIX_LENGTH = 12

# fixed value: 100 ns ticks between 1582-10-15 and 1970-01-01
_UUID_EPOCH_TICKS = 122192928000000000


def name_uuid(text: Column) -> Column:
    """Version 3 UUID of the UTF-8 bytes of ``text``."""
    digest = F.md5(text.cast("binary"))
    variant = F.lower(F.hex((F.conv(F.substring(digest, 17, 2), 16, 10).cast("int").bitwiseAND(F.lit(0x3F))).bitwiseOR(F.lit(0x80))))
    return F.concat_ws(
        "-",
        F.substring(digest, 1, 8),
        F.substring(digest, 9, 4),
        F.concat(F.lit("3"), F.substring(digest, 14, 3)),
        F.concat(variant, F.substring(digest, 19, 2)),
        F.substring(digest, 21, 12),
    )


def random_uuid() -> Column:
    return F.uuid()


def time_uuid(millis: Column, node: Column | None = None) -> Column:
    """Version 1 UUID carrying ``millis``; ``node`` is a 12-digit hex column (zeros by default)."""
    ticks = millis.cast("bigint") * 10000 + F.lit(_UUID_EPOCH_TICKS)
    digits = F.lpad(F.lower(F.hex(ticks)), 16, "0")
    return F.concat_ws(
        "-",
        F.substring(digits, 9, 8),
        F.substring(digits, 5, 4),
        F.concat(F.lit("1"), F.substring(digits, 2, 3)),
        F.lit("8000"),
        node if node is not None else F.lit("000000000000"),
    )


def unique_time_uuid(millis: Column, identity: Column) -> Column:
    """Version 1 UUID carrying ``millis`` and, in its clock sequence and node, a digest of ``identity``: rows of one millisecond that
    differ in their identity differ in their id, and a row computed again gets its id again."""
    digest = F.md5(identity.cast("string"))
    plain = time_uuid(millis, F.substring(digest, 1, 12))
    return F.concat(F.substring(plain, 1, 19), F.lit("8"), F.substring(digest, 13, 3), F.substring(plain, 24, 13))


def time_uuid_millis(uuid: Column) -> Column:
    """Epoch milliseconds carried by a version 1 UUID."""
    digits = F.concat(F.substring(uuid, 16, 3), F.substring(uuid, 10, 4), F.substring(uuid, 1, 8))
    return F.floor((F.conv(digits, 16, 10).cast("bigint") - F.lit(_UUID_EPOCH_TICKS)) / F.lit(10000)).cast("bigint")


def bucket_signature(path: Column, sub: Column | None = None) -> Column:
    """Readable unique name of a bucket path: first and last two parts, cleaned, plus a digest of the whole path."""
    trimmed = F.regexp_replace(path, "^/", "")
    parts = F.split(F.regexp_replace(trimmed, "/+$", ""), "/")
    count = F.size(parts)

    def cut(part: Column) -> Column:
        return F.substring(part, 1, _PART_LENGTH)

    first = cut(F.get(parts, F.lit(0)))
    last = cut(F.get(parts, count - 1))
    readable = (
        F.when(count == 1, first)
        .when(count == 2, F.concat_ws("_", first, last))
        .otherwise(F.concat_ws("_", first, cut(F.get(parts, count - 2)), last))
    )
    if sub is not None:
        readable = F.concat_ws("_", readable, cut(sub))
    clean = F.regexp_replace(F.regexp_replace(F.lower(readable), "[^a-z0-9_]", "_"), "__+", "_")
    clean = F.regexp_replace(clean, "_$", "")
    return F.concat(clean, F.lit("__"), F.substring(F.md5(path.cast("binary")), _SUFFIX_START, _SUFFIX_LENGTH))


def permission(root: str, action: Column | str | None, path: Column) -> Column:
    """``Root:action:a:b`` for the path ``/a/b``; a missing action is the wildcard."""
    verb = F.lit("*") if action is None else (F.lit(action) if isinstance(action, str) else F.coalesce(action, F.lit("*")))
    colons = F.regexp_replace(F.translate(path, "/", ":"), "^:", "")
    return F.concat_ws(":", F.lit(root), verb, colons)


def stage_address(address: Column, own_bucket: str) -> Column:
    """(bucket, stage) of ``/b``, ``/b:``, ``/b:stage`` or ``stage``; the default ends are ``$end`` and ``$start``."""
    bucket = F.split_part(address, F.lit(":"), F.lit(1))
    stage = F.split_part(address, F.lit(":"), F.lit(2))
    absolute = address.startswith("/")
    return F.struct(
        F.when(absolute, bucket).otherwise(F.lit(own_bucket)).alias("bucket"),
        F.when(~absolute, address)
        .when(~address.contains(":"), F.lit("$end"))
        .when(stage == "", F.lit("$start"))
        .otherwise(stage)
        .alias("stage"),
    )


@dataclass(frozen=True)
class ReservedNames:
    """Path prefixes set aside for test copies, log buckets and sources outside the catalog."""

    testing: str = "/_testing/"
    logging: str = "/_logging"
    external: str = "/_external/"
    buckets: str = "/buckets"

    def is_test(self, path: Column) -> Column:
        return path.startswith(self.testing)

    def is_log(self, path: Column) -> Column:
        return path.startswith(self.logging)

    def is_external(self, path: Column) -> Column:
        return path.startswith(self.external)

    def to_test(self, path: Column, user: Column | str) -> Column:
        name = F.lit(user) if isinstance(user, str) else user
        return F.concat(F.lit(self.testing), name, path)

    def to_log(self, path: Column) -> Column:
        return F.concat(F.lit(self.logging + self.buckets), path)
