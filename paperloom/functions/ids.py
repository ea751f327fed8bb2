"""Identity expressions: byte-exact digests and UUIDs, all inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the URL namespace of RFC 4122.
URL_NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"
#: Fixed value: what the names of catalog ids begin with.
CATALOG_PREFIX = "rag-pipeline-v2:"


def uuid5_hex(name: Column, namespace: str = URL_NAMESPACE) -> Column:
    """Version-5 UUID of ``name`` as 32 hex digits."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace)), F.encode(name, "UTF-8")))
    variant = F.lower(F.hex((F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(F.lit(3))).bitwiseOR(F.lit(8))))
    return F.concat(F.substring(h, 1, 12), F.lit("5"), F.substring(h, 14, 3), variant, F.substring(h, 18, 15))


def catalog_id(relative_path: Column, sha256: Column) -> Column:
    return F.concat(F.lit("cat-"), uuid5_hex(F.concat(F.lit(CATALOG_PREFIX), F.lower(relative_path), F.lit(":"), sha256)))


def prefixed_uuid(prefix: str, *parts: Column) -> Column:
    """``prefix-`` and the UUID of the parts joined by a bar; null parts are empty."""
    return F.concat(F.lit(f"{prefix}-"), uuid5_hex(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])))


def digest_id(prefix: str, *parts: Column, separator: str = "|") -> Column:
    """``prefix-`` and 24 hex digits of SHA-256 of the parts; a null part is the text None."""
    return F.concat(F.lit(f"{prefix}-"), F.substring(F.sha2(F.concat_ws(separator, *[F.coalesce(p.cast("string"), F.lit("None")) for p in parts]), 256), 1, 24))


def version_label(number: Column) -> Column:
    return F.format_string("v%03d", number.cast("int"))


def version_id(family: Column, number: Column, sha256: Column) -> Column:
    return F.concat_ws("-", family, version_label(number), F.substring(sha256, 1, 12))


#: The same in DuckDB; {n} is the name's expression.
def uuid5_sql(n: str) -> str:
    # sha1 of raw bytes: the namespace's 16 bytes are written as escapes.
    raw = "".join(f"\\x{URL_NAMESPACE[k : k + 2].upper()}" for k in range(0, 32, 2))
    h = f"sha1('{raw}'::BLOB || encode({n}))"
    return f"(substr({h}, 1, 12) || '5' || substr({h}, 14, 3) || substr('89ab', 1 + (('0x' || substr({h}, 17, 1))::INT & 3), 1) || substr({h}, 18, 15))"
