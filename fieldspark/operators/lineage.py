"""Which columns of a frame come from which source columns, read off its analysed plan.

A renamed or computed column keeps its origin here, which its name does not tell. Lineage ends
where the data were written and read again: a stage table's columns are sources under their own
names. Rows picked by a column (filters, join conditions, sort orders) carry nothing of it.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame

Origins = dict[int, frozenset[str]]


def each(items) -> Iterator:
    """The items of a JVM collection."""
    it = items.iterator()
    while it.hasNext():
        yield it.next()


def number(attribute) -> int:
    return attribute.exprId().id()


def origins_of(plan, wanted: dict[str, str], seen: Origins) -> Origins:
    """Adds the attributes that ``plan`` makes out of wanted columns to ``seen``."""
    children = list(each(plan.children()))
    for child in children:
        origins_of(child, wanted, seen)
    inner = [x for sub in each(plan.subqueries()) for x in [origins_of(sub, wanted, seen)] and each(sub.output())]
    below = frozenset().union(*(seen.get(number(a), frozenset()) for a in inner)) if inner else frozenset()

    def read(node) -> frozenset[str]:
        return below.union(*(seen.get(number(a), frozenset()) for a in each(node.references())))

    known = {number(a) for child in children for a in each(child.output())}
    for e in each(plan.expressions()):
        if e.nodeName() == "Alias":
            seen[number(e)] = seen.get(number(e), frozenset()) | read(e)
            known.add(number(e))
    output = list(each(plan.output()))
    for a in output:
        if number(a) not in known:      # a source's column, or what a generator or a Python function returns
            seen[number(a)] = seen.get(number(a), frozenset()) | (read(plan) if children else frozenset())
        name = wanted.get(a.name().lower())
        if name:
            seen[number(a)] = seen.get(number(a), frozenset()) | {name}
    if plan.nodeName() in ("Union", "Intersect", "Except"):
        for place in zip(output, *[each(child.output()) for child in children]):
            seen[number(place[0])] = frozenset().union(*(seen.get(number(a), frozenset()) for a in place))
    return seen


def derived_from(df: DataFrame, names: Sequence[str]) -> dict[str, list[int]]:
    """For each name the places of the columns of ``df`` that hold it or anything computed from it.

    Names compare without regard to case. A column that is given a wanted name counts as well,
    whatever it was made of.
    """
    plan = df._jdf.queryExecution().analyzed()
    seen = origins_of(plan, {n.lower(): n for n in names}, {})
    output = [seen.get(number(a), frozenset()) for a in each(plan.output())]
    return {n: [i for i, found in enumerate(output) if n in found] for n in names}
