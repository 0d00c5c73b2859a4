"""Paged providers: queries are dealt over tasks, and each follows its pages. The fetch function is the caller's."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from datetime import date, timedelta

import pandas as pd
from pyspark.sql import DataFrame

#: fetch(query, token) gives (payloads as JSON text, next token or None).
Fetch = Callable[[str, str | None], tuple[list[str], str | None]]


def follow_pages(queries: DataFrame, fetch: Fetch, query_col: str = "query", most_pages: int = 100_000) -> DataFrame:
    """(query, page, token, next_token, position, payload): all pages of every query, each query in one task.

    A token that a query has seen before ends it; more than most_pages pages are an error. A page without payloads has
    one row with a null payload, so audits see it.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for query in pdf[query_col]:
                token, seen = None, set()
                for page in range(most_pages + 1):
                    if page == most_pages:
                        raise ValueError(f"{query}: over {most_pages} pages")
                    payloads, following = fetch(query, token)
                    rows = payloads or [None]
                    yield pd.DataFrame({"query": query, "page": page, "token": token, "next_token": following, "position": range(len(rows)), "payload": rows})
                    seen.add(token)
                    if following is None or following in seen:
                        break
                    token = following

    return queries.select(query_col).mapInPandas(run, "query string, page int, token string, next_token string, position int, payload string")


def term_batches(terms: Iterable[str], most_chars: int, most_terms: int | None = None) -> list[list[str]]:
    """Terms in order, in groups whose quoted OR query stays within the bounds; a single longer term is an error."""
    out: list[list[str]] = []
    held = 0
    for term in terms:
        size = len(term) + 2
        if size > most_chars:
            raise ValueError(f"a term of {size} characters does not fit")
        joined = held + size + 4
        if not out or joined > most_chars or (most_terms and len(out[-1]) == most_terms):
            out.append([])
            joined = size
        out[-1].append(term)
        held = joined
    return out


def split_ranges(first: date, last: date, count: Callable[[date, date], int], most: int) -> list[tuple[date, date, int]]:
    """Date ranges that have at most `most` items each (a single day may have more), in order.

    Ranges of years are halved at a year's end, then at a month's end, then at any day.
    """
    pending, out = [(first, last)], []
    while pending:
        a, b = pending.pop()
        n = count(a, b)
        if n <= most or a == b:
            out.append((a, b, n))
            continue
        if a.year < b.year:
            middle = date((a.year + b.year) // 2, 12, 31)
        elif a.month < b.month:
            middle = date(a.year, (a.month + b.month) // 2 + 1, 1) - timedelta(days=1)
        else:
            middle = a + (b - a) // 2
        pending += [(middle + timedelta(days=1), b), (a, middle)]
    return out


def split_prefixes(count: Callable[[str], int], most: int, alphabet: str = "0123456789", prefix: str = "") -> list[tuple[str, int]]:
    """Disjoint prefixes of ids that have at most `most` items each, in order, with their counts; empty ones are left out.

    A prefix whose parts do not add up to it is an error: items would be missing or ids repeat.
    """
    n = count(prefix)
    if n <= most:
        return [(prefix, n)] if n else []
    out = [part for letter in alphabet for part in split_prefixes(count, most, alphabet, prefix + letter)]
    if sum(k for _, k in out) != n:
        raise ValueError(f"the parts of {prefix!r} have {sum(k for _, k in out)} items, not {n}")
    return out


class Refused(ValueError):
    """Raised by a fetch function for a query that a provider finds too long or too complicated."""


def fetch_batches(batches: DataFrame, fetch: Callable[[list[str]], list[str]], terms_col: str = "terms") -> DataFrame:
    """(terms, position, payload, error): what fetch gives for each batch of terms (an array), each batch in one task.

    A refused batch is halved until its parts are answered; a single refused term, and any other failure of a part, is a
    row with the error. A batch without payloads has one row with neither, so audits see it.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for terms in pdf[terms_col]:
                pending = [list(terms)]
                while pending:
                    some, error = pending.pop(), None
                    try:
                        payloads = fetch(some)
                    except Refused as e:
                        if len(some) > 1:
                            pending += [some[len(some) // 2 :], some[: len(some) // 2]]
                            continue
                        payloads, error = [], str(e)
                    except OSError as e:
                        payloads, error = [], str(e)
                    rows = payloads or [None]
                    yield pd.DataFrame({"terms": [some] * len(rows), "position": range(len(rows)), "payload": rows, "error": error})

    return batches.select(terms_col).mapInPandas(run, "terms array<string>, position int, payload string, error string")
