"""Identifiers: a prefix and the first 16 hex digits of a SHA-256 over joined parts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def digest(text: Column, size: int = 16) -> Column:
    return F.substring(F.sha2(text.cast("binary"), 256), 1, size)


def make_id(prefix: str, *parts: Column | str) -> Column:
    return F.concat(F.lit(prefix + "_"), digest(F.concat_ws(":", *(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))))


def fixed(x: Column, digits: int) -> Column:
    """x with that many digits after the point, 7 at most, as C and Python print it: the double's exact value decides, and
    of two equally near the even one. (SQL's own formats round the shortest decimal form, half up.) For |x| below 2**53 / 10**digits.
    """
    scale = float(10**digits)
    a = F.abs(x)
    p = a * scale
    # Dekker's product: p + err is a * scale to the last bit
    c = a * 134217729.0
    high = c - (c - a)
    err = (high * scale - p) + (a - high) * scale
    below = F.floor(p)
    over = (p - below - 0.5) + err
    n = below + F.when((over > 0) | ((over == 0) & (below % 2 == 1)), 1).otherwise(0)
    whole, rest = F.floor(n / 10**digits), n % 10**digits
    body = F.concat(whole.cast("string"), F.lit("."), F.lpad(rest.cast("string"), digits, "0"))
    return F.concat(F.when(x.cast("string").startswith("-"), "-").otherwise(""), body)


def doc_id(project: Column, space: str = "seed:project") -> Column:
    return make_id("doc", space, project)


def revision_id(doc: Column, index: Column) -> Column:
    return make_id("rev", doc, index)


def injection_id(doc: Column, revision: Column, ordinal: Column) -> Column:
    return make_id("inj", doc, revision, ordinal)


def author_id(name: Column) -> Column:
    return make_id("author", name)


def causal_id(doc: Column, revision: Column, locality: Column, coupling: Column) -> Column:
    return make_id("inj", doc, revision, fixed(locality, 2), fixed(coupling, 2))


def cache_key(*parts: Column) -> Column:
    return digest(F.concat_ws(":", *(p.cast("string") for p in parts)), 32)


def md5_mod(text: Column, n: int) -> Column:
    """The 128-bit MD5 as a number, modulo n below 2**31: Horner's rule over chunks of eight hex digits."""
    h = F.md5(text.cast("binary"))
    out = F.lit(0).cast("long")
    shift = (1 << 32) % n
    for k in range(4):
        chunk = F.conv(F.substring(h, 8 * k + 1, 8), 16, 10).cast("long")
        out = (out * shift + chunk) % n
    return out


def hash_uniform(seed: int, *keys: Column) -> Column:
    """A number in [0, 1) that depends on the keys and the seed alone, for sampling that a task can repeat."""
    text = F.concat_ws(":", F.lit(str(seed)), *(k.cast("string") for k in keys))
    return F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 12), 16, 10).cast("double") / float(1 << 48)
