"""Identities and keys as Column functions."""

from __future__ import annotations

import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F

from evispark.functions.encoding import json_number, json_object, json_text

#: Our own namespace for name-based identities.
NAMESPACE = uuid.uuid5(uuid.NAMESPACE_URL, "urn:evispark")


def stable_id(kind: str, key: Column, namespace: uuid.UUID = NAMESPACE) -> Column:
    """The name-based UUID (version 5) of ``kind:key``."""
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace.hex)), F.encode(F.concat(F.lit(f"{kind}:"), key), "utf-8")))
    variant = F.lower(F.hex((F.conv(F.substring(digest, 17, 1), 16, 10).cast("int").bitwiseAND(3)).bitwiseOR(8)))
    return F.concat_ws("-", F.substring(digest, 1, 8), F.substring(digest, 9, 4), F.concat(F.lit("5"), F.substring(digest, 14, 3)), F.concat(variant, F.substring(digest, 18, 3)), F.substring(digest, 21, 12))


def text_key(model: Column, text: Column) -> Column:
    """24 hex digits of the SHA-256 of model and text."""
    return F.substring(F.sha2(F.concat_ws("\n", model, text), 256), 1, 24)


def request_key(*parts: Column) -> Column:
    """SHA-256 of the parts of a request, nulls as empty, joined by a unit separator."""
    return F.sha2(F.concat_ws("\x1f", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)


def call_key(model: Column, kind: Column, prompt_version: Column, temperature: Column, instructions: Column, text: Column) -> Column:
    """SHA-256 of the canonical JSON of a call's six fields; a file's name takes the first 24 digits."""
    fields = {"model": json_text(model), "text_format": json_text(kind), "prompt_version": json_text(prompt_version), "temperature": json_number(temperature), "instructions": json_text(instructions), "input_text": json_text(text)}
    return F.sha2(json_object(fields), 256)


def agent_key(model: Column, messages: Column, tools: Column) -> Column:
    """SHA-256 of the canonical JSON of an agent's turn; ``messages`` and ``tools`` are JSON text."""
    return F.sha2(json_object({"model": json_text(model), "messages": messages, "tools": tools}), 256)


def claim_ids(key: Column, claims: Column) -> Column:
    """The identities of the claims of a chunk by their places: ``stable_id("claim", key:index)``, from 0."""
    return F.transform(claims, lambda _, i: stable_id("claim", F.concat(key, F.lit(":"), i.cast("string"))))


def paper_key(number: Column) -> Column:
    return F.format_string("P%03d", number)
