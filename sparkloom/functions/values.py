"""JSON values, templates and text as columns. JSON stays text: variants can't be grouped or compared."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkloom.plans.result import KeyRedactor, shape_json

#: Keys that hold secrets, and what stands in their place.
SECRET_KEYS = ("token", "password", "secret", "authorization", "api_key", "apikey", "access_key")
REDACTED = "[redacted]"
PREVIEW = 512


def pick(json: Column, path: str, kind: str = "string") -> Column:
    """The value at a dotted path (empty segments don't count), null where there is none."""
    steps = "".join(f"[{p}]" if p.isdigit() else f"['{p}']" for p in path.split(".") if p)
    return F.try_variant_get(F.try_parse_json(json), "$" + steps, kind)


def has_path(json: Column, path: str) -> Column:
    """Is there a value, null included, at the path? Tells a missing path from a null."""
    *outer, last = [p for p in path.split(".") if p]
    holder = pick(json, ".".join(outer), "variant") if outer else F.try_parse_json(json)
    return F.coalesce(F.array_contains(F.json_object_keys(F.to_json(holder)), last), F.lit(False))


def canonical_json(json: Column) -> Column:
    """Keys sorted at every depth, no white space; numbers are normalised (2.0 as 2)."""
    return F.to_json(F.try_parse_json(json))


def truthy(json: Column) -> Column:
    """All but null and false."""
    return ~F.coalesce(canonical_json(json), F.lit("null")).isin("null", "false")


def equals(json: Column, literal: str) -> Column:
    return canonical_json(json).eqNullSafe(F.to_json(F.parse_json(F.lit(literal))))


def merge_maps(*maps: Column) -> Column:
    """Shallow merge, the rightmost wins, whatever the session's policy for repeated keys."""
    whole = F.map_from_entries(F.array().cast("array<struct<key:string,value:string>>"))
    for m in maps:
        whole = F.map_concat(F.map_filter(whole, _absent_from(m)), m)
    return whole


def _absent_from(m: Column) -> Callable[[Column, Column], Column]:
    return lambda k, v: ~F.map_contains_key(m, k)


def template(text: str, values: Mapping[str, Column]) -> tuple[Column, Column]:
    """(rendered text, whether all holes were filled); if one is null or unknown the template stays as it is."""
    parts, known = [], F.lit(True)
    for k, part in enumerate(re.split(r"\{([^{}]*)\}", text)):
        column = F.lit(part) if k % 2 == 0 else values.get(part, F.lit(None)).cast("string")
        parts.append(column)
        known = known & column.isNotNull()
    return F.when(known, F.concat(*parts)).otherwise(F.lit(text)), known


def escape_segment(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("~"), F.lit("~0")), F.lit("."), F.lit("~1"))


def unescape_segment(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("~1"), F.lit(".")), F.lit("~0"), F.lit("~"))


def valid_node_id(c: Column) -> Column:
    return c.isNotNull() & (F.length(c) > 0) & ~F.contains(c, F.lit("."))


def redact_map(m: Column, needles: Sequence[str] = SECRET_KEYS) -> Column:
    """Values of keys that contain a needle, in any case, masked."""
    return F.transform_values(m, lambda k, v: F.when(F.lower(k).rlike("|".join(map(re.escape, needles))), F.lit(REDACTED)).otherwise(v))


def redact_json(json: Column) -> Column:
    """As redact_map, at any depth of JSON text."""
    redactor = KeyRedactor()

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda t: shape_json(t, redactor, None), na_action="ignore")

    return run(json)


def truncated(json: Column, most: int) -> Column:
    """JSON text, or where it has more than `most` bytes {"$truncated":true,"bytes":n,"preview":its first characters}."""
    size = F.octet_length(json)
    short = F.to_json(F.struct(F.lit(True).alias("$truncated"), size.alias("bytes"), F.left(json, F.lit(min(most, PREVIEW))).alias("preview")))
    return F.when(size > most, short).otherwise(json)


def backoff_ms(attempt: Column, base: Column | None = None, cap: int = 5000) -> Column:
    """The wait after a failed attempt (1, 2, ...), without its jitter."""
    first = F.coalesce(base, F.lit(100)) if base is not None else F.lit(100)
    power = F.pow(F.lit(2.0), F.least(attempt - 1, F.lit(16))).cast("bigint")
    return F.least(first.cast("bigint") * power, F.lit(cap).cast("bigint"))


def retry_attempts(idempotent: Column, pure: Column, declared: Column) -> Column:
    return F.when((idempotent | pure) & declared.isNotNull(), F.greatest(declared, F.lit(1))).otherwise(F.lit(1))


def is_retryable(verdict: Column, code: Column, message: Column, errors: Column) -> Column:
    """The adapter's verdict; else whether the list is empty or names the code or a part of the message."""
    named = F.exists(errors, lambda x: F.coalesce(x == code, F.lit(False)) | F.contains(message, x))
    return F.coalesce(verdict, (F.size(errors) == 0) | named)


def dispatch_ms(fixed: Column, per_call: Column, calls: Column) -> Column:
    return F.coalesce(fixed, F.lit(0)) + F.coalesce(per_call, F.lit(0)) * calls


def resolution_code(has_node: Column, has_value: Column) -> Column:
    return F.when(~has_node, "missing_node_output").when(~has_value, "missing_path")


def protocol_version_ok(c: Column) -> Column:
    return (F.length(c) == 10) & (F.length(F.replace(c, F.lit("-"), F.lit(""))) == 8)


def join_url(base: Column, url: Column) -> Column:
    return F.when(url.startswith("http://") | url.startswith("https://"), url).otherwise(F.concat(F.rtrim(base, F.lit("/")), F.lit("/"), F.ltrim(url, F.lit("/"))))


def capped_text(data: Column, most: int) -> Column:
    """The first `most` bytes of a binary column as text, cut back to a whole character; bytes that aren't UTF-8 become the
    replacement character."""
    text = lambda b: F.make_valid_utf8(b.cast("string"))
    inside = lambda at: F.hex(F.substring(data, at + 1, 1)).between("80", "BF")  # noqa: E731  a character goes on there
    cut = text(F.substring(data, 1, max(0, most - 3)))
    for back in range(min(most, 3) - 1, -1, -1):
        cut = F.when(inside(most - back), cut).otherwise(text(F.substring(data, 1, most - back)))
    return F.when(F.octet_length(data) <= most, text(data)).otherwise(cut)


def glob_like(pattern: str) -> str:
    """A glob (`*` and `?` within a folder, `**` across) as a regular expression."""
    out = re.escape(pattern).replace(r"\*\*/", "(.*/)?").replace(r"\*\*", ".*").replace(r"\*", "[^/]*").replace(r"\?", "[^/]")
    return f"^{out}$"
