"""Column builders for names, patterns, secrets and tokens."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Markers, patterns and formats that policies and stored results rely on.
REMOVED = "[SECRET_REMOVED]"
SECRET_NAME = r"(^|[_\-.])(password|passwd|passphrase|секретнаяфраза|secret|access.?token|refresh.?token|token|api.?key|ключapi|ключапи|private.?key|приватныйключ|access.?key|refresh.?key|authorization|авторизац|парол|токен|секрет|ключ)([_\-.]|$)"
SECRET_VALUE = r"(bearer\s+[a-z0-9._~+/=-]{8,}|authorization\s*[:=]\s*\S+|-----BEGIN (?:RSA |EC |OPENSSH )?PRIVATE KEY-----)"
SECRET_ASSIGNMENT = r"""(password|passwd|passphrase|секретнаяфраза|secret|token|api.?key|private.?key|access.?token|refresh.?token|authorization|парол\w*|токен\w*|секрет\w*|ключ\w*)\s*[:=]\s*(?:"[^"]*"|'[^']*'|[^\s,;)]+)"""
COMPACT_MARKERS = ("password", "passwd", "passphrase", "пароль", "секретнаяфраза", "secret", "секрет", "token", "токен", "apikey", "ключapi", "ключапи", "privatekey", "приватныйключ", "accesskey", "refreshkey", "authorization", "авторизац")
PERSON_NAME = r"(^|[_\-.])(фио|full.?name|person.?name|employee.?name|контрагент|физлицо)([_\-.]|$)"
PERSON_VALUE = r"(?<![\p{L}\p{N}_])[А-ЯЁ][а-яё]{2,}(?:\s+[А-ЯЁ][а-яё]{2,}){1,2}(?![\p{L}\p{N}_])"
TOKEN = r"\[MASK:v1:[A-Z0-9_]{1,32}:[A-Za-z0-9_-]{32}\]"

KEY = b"local test key"
UNIT = "\x1f"
#: Put around matches where texts are split at them.
MARK = "\x1e"


def _any(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, columns)


def wildcard_match(pattern: Column, value: Column) -> Column:
    """``*`` matches all, ``*x*`` what contains x, else equal; in any case."""
    p, v = F.lower(pattern), F.lower(value)
    inner = F.substring(p, F.lit(2), F.length(p) - 2)
    return F.when(p == "*", True).when((F.length(p) > 1) & p.startswith("*") & p.endswith("*"), F.contains(v, inner)).otherwise(p == v)


def pattern_valid(pattern: Column) -> Column:
    """Exact text, ``*``, or ``*x*`` without another star."""
    return pattern.rlike(r"(?s)^(\*|\*[^*]+\*|[^*]+)$")


def covers(a: Column, b: Column) -> Column:
    """Whether all that ``b`` matches is provably matched by ``a``."""
    is_part = lambda p: (F.length(p) > 2) & p.startswith("*") & p.endswith("*")
    bare = lambda p: F.lower(F.substring(p, F.lit(2), F.length(p) - 2))
    of_b = F.when(is_part(b), bare(b)).when(b == "*", None).otherwise(F.lower(b))
    return (a == b) | (a == "*") | F.coalesce(is_part(a) & F.contains(of_b, bare(a)), F.lit(False))


def secret_name(name: Column) -> Column:
    return name.rlike(f"(?iu){SECRET_NAME}")


def compact_secret_name(name: Column) -> Column:
    compact = F.regexp_replace(F.lower(name), r"[^\p{L}\p{N}]", "")
    return _any([F.contains(compact, F.lit(m)) for m in COMPACT_MARKERS])


def cut_secret_values(text: Column) -> Column:
    return F.regexp_replace(text, f"(?i){SECRET_VALUE}", REMOVED)


def cut_assignments(text: Column) -> Column:
    """Texts without ``:`` and ``=`` have no assignment and aren't scanned."""
    return F.when(F.contains(text, F.lit("=")) | F.contains(text, F.lit(":")), F.regexp_replace(text, f"(?iu){SECRET_ASSIGNMENT}", REMOVED)).otherwise(text)


def pointer_escape(segment: Column) -> Column:
    return F.replace(F.replace(segment, F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1"))


def category(raw: Column) -> Column:
    """ASCII letters, digits and ``_``, upper case, 32 at most, else DATA."""
    clean = F.substring(F.upper(F.regexp_replace(raw, "[^A-Za-z0-9_]", "")), 1, 32)
    return F.coalesce(F.nullif(clean, F.lit("")), F.lit("DATA"))


def hmac_sha256(message: Column, key: bytes = KEY) -> Column:
    """Hex HMAC-SHA-256 by two rounds of the built-in digest."""
    import hashlib

    block = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = (bytes(x ^ pad for x in block) for pad in (0x36, 0x5C))
    digest = F.sha2(F.concat(F.lit(bytearray(inner)), F.encode(message, "UTF-8")), 256)
    return F.sha2(F.concat(F.lit(bytearray(outer)), F.unhex(digest)), 256)


def mask_token(kind: Column, value: Column, database: Column | str = "db", key: bytes = KEY) -> Column:
    """Typed token of a value: the same value of a database always has the
    same one, and only the key's holder can derive it."""
    kind = category(kind)
    database = F.lit(database) if isinstance(database, str) else database
    digest = hmac_sha256(F.concat_ws(UNIT, database, kind, value), key)
    body = F.translate(F.base64(F.unhex(F.substring(digest, 1, 48))), "+/", "-_")
    return F.concat(F.lit("[MASK:v1:"), kind, F.lit(":"), body, F.lit("]"))


def replace_matches(text: Column, pattern: str, make) -> Column:
    """Each match of ``pattern`` replaced by ``make(match)``.

    The text is split at its matches and put together again, so nothing that
    is put in can match once more. One scan marks the matches; texts that hold
    the mark themselves are scanned for matches and for what is between.
    """
    pieces = F.split(F.regexp_replace(text, pattern, f"{MARK}$0{MARK}"), MARK, -1)
    marked = F.array_join(F.transform(pieces, lambda x, i: F.when(i % 2 == 1, make(x)).otherwise(x)), "")
    found = F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))
    between = F.split(text, pattern, -1)
    plain = F.array_join(F.zip_with(between, F.array_append(F.transform(found, make), F.lit("")), lambda a, b: F.concat(a, b)), "")
    return F.when(F.contains(text, F.lit(MARK)), plain).otherwise(marked)


def mask_matches(text: Column, pattern: str, kind: str, holds: str | None = None) -> Column:
    """Each match of ``pattern`` replaced by its token of category ``kind``.
    ``holds``: what every match contains; texts without it aren't scanned."""
    made = replace_matches(text, pattern, lambda m: mask_token(F.lit(kind), m))
    return made if holds is None else F.when(F.contains(text, F.lit(holds)), made).otherwise(text)


def action_rank(action: Column) -> Column:
    return F.when(action == "secret", 3).when(action == "mask", 2).when(action == "keep", 1).otherwise(0)


def ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def text_of(value: Column) -> Column:
    return F.coalesce(value, F.lit(""))
