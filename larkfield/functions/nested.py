"""Nested metadata: values at a path inside a variant column, compared as normalised text."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from decimal import Decimal

from pyspark.sql import Column, functions as F

from larkfield.functions.text import normalize, normalize_text

#: fixed values: paths that also hold a key's values, as copies of a text keep where else it was seen
ALSO: Mapping[str, tuple[str, ...]] = {"dataset": ("also_seen_in.dataset",)}


def parsed(text: Column) -> Column:
    """JSON text as a variant; text that is no JSON, like null, holds nothing."""
    return F.try_parse_json(text)


def _member(name: str) -> Callable[[Column], Column]:
    if "'" in name or not name:
        raise ValueError(f"no usable name in a path: {name!r}")
    return lambda x: F.try_variant_get(x, f"$['{name}']", "variant")


def values(meta: Column, path: str) -> Column:
    """The scalars at a dotted path, as an array of normalised text.

    Lists are entered on the way and at the end, as often as they are nested up to two levels. Missing names, JSON
    nulls and objects at the end give nothing, and so do blanks. Numbers are compared by value: 1.0 is ``1``.
    """
    own = lambda x: F.coalesce(F.try_variant_get(x, "$", "array<variant>"), F.array(x))
    flat = lambda xs: F.flatten(F.transform(xs, own))
    held = flat(F.array(meta))
    for name in path.split("."):
        held = flat(flat(F.transform(held, _member(name))))
    is_object = lambda x: F.startswith(F.schema_of_variant(x), F.lit("OBJECT"))
    scalars = F.filter(held, lambda x: x.isNotNull() & ~is_object(x))
    texts = F.transform(scalars, lambda x: normalize(F.try_variant_get(x, "$", "string")))
    return F.array_distinct(F.filter(texts, lambda x: x.isNotNull() & (x != "")))


def wanted_text(value: object) -> str:
    """A wanted value as text that compares with ``values``: numbers by value, true and false as JSON writes them."""
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, (int, float, Decimal)):
        number = Decimal(str(value)).normalize()
        return format(number, "f") if number else "0"
    return normalize_text(str(value))


def holds(meta: Column, path: str, wanted: Iterable | str | float | bool, also: Mapping[str, tuple[str, ...]] = ALSO) -> Column:
    """Whether a path, or one that stands for it, holds any wanted value. Never null; an empty list is never held."""
    many = wanted if isinstance(wanted, (list, tuple, set, frozenset)) else [wanted]
    asked = sorted({wanted_text(v) for v in many if v is not None})
    if not asked:
        return F.lit(False)
    held = F.concat(*[F.coalesce(values(meta, p), F.array().cast("array<string>")) for p in (path, *also.get(path, ()))])
    return F.coalesce(F.arrays_overlap(held, F.array(*map(F.lit, asked))), F.lit(False))
