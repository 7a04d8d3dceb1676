"""Column functions: calendars, trust, versions, text normalisation, urls and markup."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Trust labels from the strongest to the weakest.
TRUST = ("OFFICIAL", "AUTOMATED", "COMMUNITY_VERIFIED", "ESTIMATE", "COMMUNITY", "DISPUTED", "UNKNOWN")
#: Properties for which a newer automated value beats an official one.
VERSION_PROPERTIES = ("version", "latest_version", "stable_version", "driver_version", "build")
DAY_MS = 86_400_000
KST_MS = 9 * 3_600_000
#: A version: up to twelve characters without digits, numbers joined by dots or underscores, a rest.
VERSION = r"^[^\d]{0,12}?(\d+(?:[._]\d+)*)(.*)$"


def millis(ts: Column) -> Column:
    """Epoch milliseconds of a timestamp without time zone, read as UTC."""
    return F.unix_millis(ts.cast("timestamp"))


def kst_day(ms: Column) -> Column:
    """Number of the +9 hour calendar day."""
    return F.floor((ms + KST_MS) / DAY_MS)


def new_day(before: Column, now: Column) -> Column:
    """Whether the day changed in either calendar, UTC or +9 hours."""
    return (F.floor(before / DAY_MS) != F.floor(now / DAY_MS)) | (kst_day(before) != kst_day(now))


def rank_in(c: Column, order: tuple[str, ...]) -> Column:
    """Place of a value in a fixed order, from 0; the length of the order for values outside of it and null."""
    place = F.array_position(F.array(*map(F.lit, order)), c).cast("int")
    return F.when(place > 0, place - 1).otherwise(len(order))


def may_override(new: Column, old: Column) -> Column:
    """A label may override one of its own trust or less."""
    return rank_in(new, TRUST) <= rank_in(old, TRUST)


def version_parts(v: Column) -> Column:
    """The numbers of a version, or null if it has none or is longer than 64 characters."""
    digits = F.regexp_extract(v, VERSION, 1)
    return F.when((F.length(v) <= 64) & (digits != ""), F.transform(F.split(digits, "[._]"), lambda x: x.try_cast("bigint")))


def version_compare(a: Column, b: Column) -> Column:
    """-1, 0 or 1; null if either has no numbers, or the numbers are equal and the rests differ. Missing numbers count as 0."""
    x, y = version_parts(a), version_parts(b)
    n = F.greatest(F.size(x), F.size(y))
    pad = lambda p: F.concat(p, F.array_repeat(F.lit(0).cast("bigint"), n - F.size(p)))
    signs = F.filter(F.zip_with(pad(x), pad(y), lambda p, q: F.sign(p - q).cast("int")), lambda d: d != 0)
    same = F.when(F.regexp_extract(a, VERSION, 2) == F.regexp_extract(b, VERSION, 2), F.lit(0))
    return F.when(x.isNotNull() & y.isNotNull(), F.coalesce(F.try_element_at(signs, F.lit(1)), same))


def supersedes(prop: Column, new_label: Column, old_label: Column, new_version: Column, old_version: Column) -> Column:
    """May override, or an automated, strictly newer version against an official one."""
    newer = F.coalesce(version_compare(new_version, old_version) > 0, F.lit(False))
    return may_override(new_label, old_label) | (prop.isin(*VERSION_PROPERTIES) & (new_label == "AUTOMATED") & (old_label == "OFFICIAL") & newer)


def version_sort_key(v: Column) -> Column:
    """Sortable array of the numbers in a dotted version."""
    return F.transform(F.split(v, "\\."), lambda x: x.try_cast("int"))


def floor_p90(values: Column, default: float, low: float, high: float, least: int = 20) -> Column:
    """The value at zero-based index floor(0.9 n) of the sorted values, clamped; a default for fewer than ``least``.

    values: an array. This is not percentile_disc, which picks one place lower for some n.
    """
    at = F.floor(F.size(values) * F.lit(0.9)).cast("int") + 1
    return F.when(F.size(values) < least, F.lit(default)).otherwise(F.greatest(F.lit(low), F.least(F.lit(high), F.element_at(F.sort_array(values), at))))


def both_or_null(f, a: Column, b: Column) -> Column:
    """greatest or least of two values that is null if either is."""
    return F.when(a.isNotNull() & b.isNotNull(), f(a, b))


def search_norm(c: Column) -> Column:
    """Lower-cased, without white space, punctuation and symbols (no compatibility folding; see ``nfkc``)."""
    return F.regexp_replace(F.lower(c), r"[\s\p{P}\p{S}]+", "")


def collapse_spaces(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"[ \t\r\n]+", " "))


def text_hash(c: Column, prefix: str = "text:") -> Column:
    """First 32 hex digits of the sha256 of a prefixed, lower-cased, space-collapsed text."""
    return F.left(F.sha2(F.concat(F.lit(prefix), F.lower(collapse_spaces(c))).cast("binary"), 256), F.lit(32))


def strip_html(c: Column) -> Column:
    """Text of markup: scripts, styles and comments dropped, tags as spaces, the five basic references decoded, spaces collapsed."""
    c = F.regexp_replace(c, r"(?is)<(script|style)\b[^>]*>.*?</(script|style)>", " ")
    c = F.regexp_replace(c, r"(?s)<!--.*?-->", " ")
    c = F.regexp_replace(c, r"<[^>]*>", " ")
    for ref, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        c = F.replace(c, F.lit(ref), F.lit(char))
    return collapse_spaces(c)


def env_key(m: Column) -> Column:
    """k=v of a map, sorted by key, joined by semicolons."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(m)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")


def slug(c: Column) -> Column:
    """Lower-case letters and digits, joined by hyphens."""
    return F.regexp_replace(F.regexp_replace(F.lower(c), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")


def excerpt(c: Column, n: int) -> Column:
    """Text without Markdown marks, cut to n characters with an ellipsis."""
    c = F.regexp_replace(c, r"\[([^\]]*)\]\([^)]*\)", "$1")
    c = collapse_spaces(F.regexp_replace(c, r"[`*_>#|]+", " "))
    return F.when(F.length(c) > n, F.concat(F.rtrim(F.substring(c, 1, n - 1)), F.lit("…"))).otherwise(c)


def price(c: Column, decimal_comma: Column) -> Column:
    """A price with grouped digits, by whether the country writes a decimal comma; null if it is not one price."""
    text = F.regexp_replace(c, r"[^\d.,-]", "")
    plain = F.when(decimal_comma, F.replace(F.replace(text, F.lit("."), F.lit("")), F.lit(","), F.lit("."))).otherwise(F.replace(text, F.lit(","), F.lit("")))
    grouped = F.when(decimal_comma, text.rlike(r"^\d{1,3}(\.\d{3})*(,\d{1,2})?$|^\d+(,\d{1,2})?$")).otherwise(text.rlike(r"^\d{1,3}(,\d{3})*(\.\d{1,2})?$|^\d+(\.\d{1,2})?$"))
    return F.when(grouped, plain.try_cast("double"))


def network(ip: Column) -> Column:
    """The /24 of an IPv4 address, the first three groups of an IPv6 one."""
    return F.when(ip.contains(":"), F.concat(F.substring_index(ip, ":", 3), F.lit("::/48"))).otherwise(F.concat(F.substring_index(ip, ".", 3), F.lit(".0/24")))


def hangul_parts(code: Column) -> Column:
    """struct(initial, medial, final) of a composed syllable's code point, by position in the standard's tables; null for others."""
    at = code - 0xAC00
    parts = F.struct(F.floor(at / 588).cast("int").alias("initial"), F.floor(F.pmod(at, F.lit(588)) / 28).cast("int").alias("medial"), F.pmod(at, F.lit(28)).cast("int").alias("final"))
    return F.when(code.between(0xAC00, 0xD7A3), parts)
