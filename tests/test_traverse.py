"""Whole traversals of a provider that shows only so many results, with all that may go wrong."""

import sys
from datetime import date, timedelta

import pytest
from pyspark import cloudpickle

from quillgraph.sources import traverse as V

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers cannot import tests

START = date(2015, 1, 1)


def day_of(i):
    """Ids over some years: a tenth on one day, the rest evenly."""
    return date(2018, 7, 9) if i % 10 == 0 else START + timedelta(days=i * 7919 % 3000)


class Provider:
    """10**5 ids by day; shows as many of a query as asked for, pages in order of ids."""

    def __init__(self, n=100_000, lost=(), extra=()):
        self.n, self.lost, self.extra = n, frozenset(lost), tuple(extra)

    def ids(self, part):
        by_day = self.__dict__.setdefault("by_day", {})
        if not by_day:
            for i in range(self.n):
                by_day.setdefault(day_of(i), []).append(i)
        out, d = [], part["first"]
        while d <= part["last"]:
            out += by_day.get(d, [])
            d += timedelta(days=1)
        return sorted(out)

    def count(self, part):
        return len(self.ids(part))

    def page(self, part, offset, size):
        return [str(i) for i in self.ids(part)[offset : offset + size]]

    def fetch(self, ids):
        return [(i, f"record {i}") for i in ids if int(i) not in self.lost] + list(self.extra)


def years(spark):
    rows = [(date(y, 1, 1), date(y, 12, 31)) for y in range(2014, 2025)]
    return spark.createDataFrame([(date(1900, 1, 1), date(2013, 12, 31)), *rows], "first date, last date")


def test_a_hundred_thousand_ids(spark):
    provider = Provider()
    parts = V.partitioned(years(spark), V.asked(provider.count), V.days, most=1000)
    leaves, large = parts.leaves.collect(), parts.too_large.collect()
    assert [(r.first, r.last, r.n) for r in large] == [(date(2018, 7, 9), date(2018, 7, 9), provider.count({"first": date(2018, 7, 9), "last": date(2018, 7, 9)}))]
    assert all(0 < r.n <= 1000 for r in leaves) and parts.torn.isEmpty() and sum(r.n for r in leaves) + large[0].n == 100_000
    spans = sorted((r.first, r.last) for r in leaves)
    assert all(a[1] < b[0] for a, b in zip(spans, spans[1:], strict=False))
    ids = V.written(V.listed(parts.leaves, provider.page, size=300), "ids")
    found = V.written(V.fetched(ids, provider.fetch), "found")
    assert {int(r.id) for r in ids.collect()} == {i for i in range(100_000) if day_of(i) != date(2018, 7, 9)}
    a = V.audit(parts, ids, found, ["first", "last"]).first()
    assert (a.n_partitions, a.n_ids, a.n_records, a.n_missing, a.n_unexpected, a.n_mismatched, a.n_too_large, a.n_torn, a.complete) == (len(leaves), 100_000 - large[0].n, 100_000 - large[0].n, 0, 0, 0, 1, 0, False)
    assert max(found.groupBy("batch").count().collect(), key=lambda r: r["count"])["count"] == 200


def test_a_complete_traversal_and_what_fetching_loses(spark):
    for provider, want in ((Provider(3000), (0, 0, True)), (Provider(3000, lost=[5, 17]), (2, 0, False)), (Provider(3000, extra=[("x", "unasked"), (None, "no id")]), (0, 1, False))):
        parts = V.partitioned(years(spark), V.asked(provider.count), V.days, most=400)
        ids = V.written(V.listed(parts.leaves, provider.page, size=100), "ids")
        found = V.written(V.fetched(ids, provider.fetch, size=50), "found")
        a = V.audit(parts, ids, found, ["first", "last"]).first()
        assert (a.n_missing, a.n_unexpected, a.complete) == want and a.n_counted == a.n_ids == 3000
        assert {r.id for r in V.id_differences(ids, found).collect()} == {str(i) for i in provider.lost} | {i for i, _ in provider.extra if i}


def test_pages_that_give_less_than_was_counted(spark):
    provider = Provider(500)
    short = lambda part, offset, size: [] if offset else provider.page(part, offset, size)
    parts = V.partitioned(years(spark), V.asked(provider.count), V.days, most=400)
    ids = V.written(V.listed(parts.leaves, short, size=50), "ids")
    assert all(r.n_listed == 50 < r.n for r in V.mismatches(ids, ["first", "last"]).collect()) and not V.mismatches(ids, ["first", "last"]).isEmpty()
    assert not V.audit(parts, ids, V.fetched(ids, provider.fetch), ["first", "last"]).first().complete


def test_prefixes_that_do_not_add_up(spark):
    names = [f"{i:04d}" for i in range(0, 3000, 3)] + ["x1"]
    count = lambda part: sum(n.startswith(part["prefix"]) for n in names)
    parts = V.partitioned(spark.createDataFrame([("",)], "prefix string"), V.asked(count), V.prefixes("0123456789", 4), most=40)
    assert [(r.prefix, r.n, r.of_parts) for r in parts.torn.collect()] == [("", 1001, 1000)]
    leaves = [r.prefix for r in parts.leaves.collect()]
    assert sorted(n for n in names if n != "x1") == sorted(n for n in names for p in leaves if n.startswith(p))
    stuck = V.partitioned(spark.createDataFrame([("",)], "prefix string"), V.asked(count), V.prefixes("0123456789", 1), most=40)
    assert {r.prefix for r in stuck.too_large.collect()} == {"0", "1", "2"} and stuck.leaves.isEmpty()


def test_nothing_to_traverse(spark):
    none = V.partitioned(years(spark).limit(0), V.asked(lambda part: 1), V.days)
    assert none.leaves.isEmpty() and none.too_large.isEmpty() and none.torn.isEmpty()
    empty = V.partitioned(years(spark), V.asked(lambda part: 0), V.days)
    ids = V.listed(empty.leaves, lambda *a: [])
    assert not V.audit(empty, ids, V.fetched(ids, lambda ids: []), ["first", "last"]).first().complete
    with pytest.raises(ValueError, match="after 2 rounds"):
        V.partitioned(years(spark), V.asked(lambda part: 10), V.days, most=5, rounds=2)
