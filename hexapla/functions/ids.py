"""Deterministic identifiers as Column expressions."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, functions as F

NAMESPACE = uuid.uuid5(uuid.NAMESPACE_URL, "hexapla")


def uuid5(name: Column, namespace: uuid.UUID = NAMESPACE) -> Column:
    """The name-based UUID of version 5, as the standard has it."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace.hex)), F.encode(name, "UTF-8")))
    variant = F.substr(F.lit("89ab"), F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4 + 1, F.lit(1))
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))


def trace_id() -> Column:
    """Random; materialise once before use."""
    return F.replace(F.uuid(), F.lit("-"), F.lit(""))
