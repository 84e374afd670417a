"""The masking functions under SQL names, as SQL functions of the session."""

from __future__ import annotations

from pyspark.sql import SparkSession

from .text import KEY, UNIT


def register(spark: SparkSession, key: bytes = KEY) -> None:
    """Defines clean_category, mask_token, mask_text, wildcard_match and cell_status.

    mask_text(database, category, pattern, text) puts a token in the place of
    each match of a pattern.

    They are SQL expressions, so the optimizer puts them into the plan where
    they are called; no Python runs. ``key`` has 64 bytes at most.
    """
    if len(key) > 64:
        raise ValueError("key: 64 bytes at most")
    inner, outer = (bytes(b ^ p for b in key.ljust(64, b"\0")).hex() for p in (0x36, 0x5C))
    clean = "substr(upper(regexp_replace(raw, '[^A-Za-z0-9_]', '')), 1, 32)"
    message = f"encode(concat_ws(decode(X'{UNIT.encode().hex()}', 'UTF-8'), database, clean_category(category), value), 'UTF-8')"
    digest = f"sha2(concat(X'{outer}', unhex(sha2(concat(X'{inner}', {message}), 256))), 256)"
    # a function can't call another one within a lambda, so the token is spelled out
    kind = f"coalesce(nullif({clean.replace('raw', 'category')}, ''), 'DATA')"
    of_match = f"concat('[MASK:v1:', {kind}, ':', translate(base64(unhex(substr({digest.replace('clean_category(category)', kind).replace(', value)', ', m)')}, 1, 48))), '+/', '-_'), ']')"
    bodies = {
        "clean_category(raw STRING) RETURNS STRING": f"coalesce(nullif({clean}, ''), 'DATA')",
        "mask_token(database STRING, category STRING, value STRING) RETURNS STRING": f"concat('[MASK:v1:', clean_category(category), ':', translate(base64(unhex(substr({digest}, 1, 48))), '+/', '-_'), ']')",
        "mask_text(database STRING, category STRING, pattern STRING, text STRING) RETURNS STRING": f"array_join(zip_with(split(text, pattern), array_append(transform(regexp_extract_all(text, concat('(', pattern, ')'), 1), m -> {of_match}), ''), (a, b) -> concat(a, b)), '')",
        "wildcard_match(pattern STRING, value STRING) RETURNS BOOLEAN": "CASE WHEN pattern = '*' THEN true WHEN length(pattern) > 1 AND startswith(pattern, '*') AND endswith(pattern, '*') THEN contains(lower(value), lower(substr(pattern, 2, length(pattern) - 2))) ELSE lower(pattern) = lower(value) END",
        "cell_status(value STRING) RETURNS STRING": "CASE WHEN contains(value, '[SECRET_REMOVED]') THEN 'secret' WHEN contains(value, '[MASK:v1:') THEN 'masked' ELSE 'open' END",
    }
    for head, body in bodies.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
