"""Ordered word-rule classifiers and the groups built from them."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, functions as F

from lettings import rules
from lettings.functions.clean import ColumnLike, as_col


def like(text: Column, pattern: str) -> Column:
    """LIKE on literal patterns, as the plain substring test where that is enough."""
    core = pattern.strip("%")
    if "%" in core or "_" in core:
        return text.like(pattern)
    if pattern == f"%{core}%":
        return text.contains(core)
    if pattern == f"{core}%":
        return text.startswith(core)
    if pattern == f"%{core}":
        return text.endswith(core)
    return text == core


def any_of(tests: Iterable[Column]) -> Column:
    result = None
    for test in tests:
        result = test if result is None else result | test
    return result


def first_match(text: Column, branches: Iterable[rules.Rule], default: Column | None = None) -> Column:
    """Label of the first branch that holds, else ``default`` (NULL when absent)."""
    chain = None
    for branch in branches:
        tests = [like(text, p) for p in branch.like]
        tests += [like(text, p) & ~like(text, guard) for p, guard in branch.guarded]
        if branch.exact:
            tests.append(text.isin(*branch.exact))
        chain = (F if chain is None else chain).when(any_of(tests), F.lit(branch.label))
    return chain if default is None else chain.otherwise(default)


def poi_group(category: ColumnLike) -> Column:
    """Group of a point of interest; NULL for categories off the lists."""
    return first_match(as_col(category), rules.POI_RULES)


def amenity_group(text: ColumnLike) -> Column:
    return first_match(F.lower(as_col(text)), rules.AMENITY_RULES, F.lit(rules.OTHER_AMENITY_GROUP))


def amenity_label(text: ColumnLike) -> Column:
    """Short label of an amenity; a text without a rule stays as it is."""
    return first_match(F.lower(as_col(text)), rules.AMENITY_LABELS, as_col(text))


def is_transport(category: ColumnLike) -> Column:
    text = F.lower(as_col(category))
    return any_of(like(text, p) for p in rules.POI_TRANSPORT_LIKE)


def is_dining(group: ColumnLike) -> Column:
    return like(F.lower(as_col(group)), rules.POI_DINING_LIKE)


def _member_label(text: Column, groups: dict[str, tuple[str, ...]]) -> Column:
    return first_match(text, [rules.Rule(label, exact=members) for label, members in groups.items()])


def property_group(property_type: ColumnLike) -> Column:
    return F.coalesce(
        _member_label(as_col(property_type), rules.PROPERTY_GROUPS),
        F.lit(rules.OTHER_PROPERTY_GROUP),
    )


def property_class(property_type: ColumnLike) -> Column:
    return _member_label(as_col(property_type), rules.PROPERTY_CLASSES)


def mentions(text: ColumnLike, keywords: Iterable[str]) -> Column:
    """Case-folded substring test, so ``key`` also finds "monkey"."""
    folded = F.lower(as_col(text))
    return any_of(folded.contains(word) for word in keywords)


def first_argmax(parts: Iterable[tuple[ColumnLike, str]]) -> Column:
    """Label of the largest column; the earliest part wins a tie."""
    parts = [(as_col(c), label) for c, label in parts]
    top = F.greatest(*[c for c, _ in parts])
    chain = None
    for c, label in parts:
        chain = (F if chain is None else chain).when(c == top, F.lit(label))
    return chain
