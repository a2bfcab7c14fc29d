"""Hash addresses: `hash://algorithm/hex`, in full and shortened."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Prefix lengths that address a file, each usable with digests of at least half as many bytes.
SHORT_FORMS = (64, 48, 24)
#: Hash algorithms by name: digest length in bytes and an expression over the content. Callers may pass their own table.
ALGORITHMS: dict[str, tuple[int, Callable[[Column], Column]]] = {
    "sha1": (20, F.sha1),
    "sha256": (32, lambda c: F.sha2(c, 256)),
    "sha512": (64, lambda c: F.sha2(c, 512)),
}
URI = r"(?i)^hash://([0-9a-z.-]+)/([0-9a-z%_-]+)/?(?:\?([^#]*))?(?:#(.*))?$"


def format_hash_uri(algorithm: Column | str, digest: Column) -> Column:
    return F.concat(F.lit("hash://"), F.lit(algorithm) if isinstance(algorithm, str) else algorithm, F.lit("/"), digest)


def internal_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def digests(content: Column, algorithms: dict = ALGORITHMS) -> Column:
    """A struct of the content's digests, binary, by the names of the algorithms: all its addresses follow from it, in a seventh of their bytes."""
    return F.struct(*(F.unhex(digest(content)).alias(name) for name, (_, digest) in algorithms.items()))


def forms(name: Column | str, digest: Column) -> Column:
    """Addresses by one algorithm: the short forms that its digest is long enough for, and the full one."""
    hexed = F.lower(F.hex(digest))
    short = F.filter(F.array(*map(F.lit, SHORT_FORMS)), lambda n: n <= F.length(hexed))
    return F.concat(F.transform(short, lambda n: format_hash_uri(name, F.substring(hexed, F.lit(1), n))), F.array(format_hash_uri(name, hexed)))


def short_form(name: Column | str, digest: Column) -> Column:
    """The shortest address by one algorithm: all its others start with it."""
    return format_hash_uri(name, F.substring(F.lower(F.hex(digest)), 1, min(SHORT_FORMS)))


def uris_of(held: Column, names: list[str]) -> Column:
    """All distinct addresses of a content by its digests()."""
    return F.array_distinct(F.concat(*(forms(name, held[name]) for name in names)))


def hash_uris(content: Column, algorithms: dict = ALGORITHMS) -> Column:
    """All distinct addresses of a content."""
    return uris_of(digests(content, algorithms), list(algorithms))


def parse_hash_uri(uri: Column) -> Column:
    """struct(algo, hash, query, fragment), or null for anything but an address of at most 511 characters."""
    part = lambda n: F.regexp_extract(uri, URI, n)
    optional = lambda n: F.when(part(n) != "", part(n))
    ok = uri.rlike(URI) & (F.length(uri) <= 511)
    return F.when(ok, F.struct(part(1).alias("algo"), part(2).alias("hash"), optional(3).alias("query"), optional(4).alias("fragment")))


def short_uri(uri: Column, digits: int = 24) -> Column:
    parsed = parse_hash_uri(uri)
    return format_hash_uri(parsed.algo, F.substring(parsed.hash, 1, digits))


#: Addresses that packed() makes shorter.
PACKED = r"^hash://([0-9a-z.-]{1,99})/((?:[0-9a-f]{2}){1,128})\z"


def packed(uri: Column) -> Column:
    """An address in binary, a byte for two digits, behind its algorithm and that name's length; any other string whole, behind a zero."""
    name, hexed = F.regexp_extract(uri, PACKED, 1), F.regexp_extract(uri, PACKED, 2)
    size = F.unhex(F.lpad(F.hex(F.length(name)), 2, "0"))
    return F.when(uri.rlike(PACKED), F.concat(size, name.cast("binary"), F.unhex(hexed))).otherwise(F.concat(F.unhex(F.lit("00")), uri.cast("binary")))


def unpacked(held: Column) -> Column:
    size = F.conv(F.hex(F.substring(held, 1, 1)), 16, 10).cast("int")
    part = lambda at, n: F.substring(held, at, n)
    address = format_hash_uri(part(F.lit(2), size).cast("string"), F.lower(F.hex(part(size + 2, F.length(held)))))
    return F.when(size == 0, part(F.lit(2), F.length(held)).cast("string")).otherwise(address)


def storage_prefix(digest: Column) -> Column:
    return F.substring(digest, 1, 2)
