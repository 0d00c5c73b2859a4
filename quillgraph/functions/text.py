"""Column functions on strings, addresses, dates and numbers."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str


def _col(x: ColumnOrName) -> Column:
    return F.col(x) if isinstance(x, str) else x


def squeezed(x: ColumnOrName) -> Column:
    """White space of any kind collapsed to single spaces, none at the ends."""
    return F.trim(F.regexp_replace(_col(x), r"(?U)\s+", " "))


def blank(x: ColumnOrName) -> Column:
    """Null, empty or nothing but white space."""
    return F.coalesce(squeezed(x) == "", F.lit(True))


def slug(x: ColumnOrName, mark: str = "-") -> Column:
    """Lower case, every run of other characters than a-z and 0-9 one mark, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(_col(x)), "[^a-z0-9]+", mark), f"^{mark}|{mark}$", "")


def mentions(text: ColumnOrName, term: str) -> Column:
    """Whether a text has a term that no word character touches, in any case of letters."""
    return F.lower(_col(text)).rlike(rf"(?U)(?<!\w)\Q{term.lower()}\E(?!\w)")


def all_matches(text: ColumnOrName, pattern: str, group: int = 0) -> Column:
    """Sorted distinct matches of a pattern."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(_col(text), F.lit(pattern), F.lit(group))))


# The one-letter codes of the amino acids.
RESIDUES = {
    "Ala": "A", "Arg": "R", "Asn": "N", "Asp": "D", "Cys": "C", "Gln": "Q", "Glu": "E", "Gly": "G", "His": "H", "Ile": "I",
    "Leu": "L", "Lys": "K", "Met": "M", "Phe": "F", "Pro": "P", "Ser": "S", "Thr": "T", "Trp": "W", "Tyr": "Y", "Val": "V",
}


def residue_code(name: ColumnOrName) -> Column:
    """The one-letter code of a residue, whatever the case of its letters; a name that has none stays as it is."""
    codes = F.create_map(*[F.lit(x) for pair in RESIDUES.items() for x in pair])
    return F.coalesce(codes[F.initcap(_col(name))], _col(name))


def short_residues(text: ColumnOrName) -> Column:
    """The text with three-letter codes of residues, spelled with one capital, as one-letter codes, and without `p.` before
    it. Other capitals with two small letters stay, and what follows one is not read with it."""
    codes = F.create_map(*[F.lit(x) for pair in RESIDUES.items() for x in pair])
    parts = F.regexp_extract_all(F.regexp_replace(_col(text), r"^p\.", ""), F.lit("(?s)[A-Z][a-z]{2}|."), F.lit(0))
    return F.array_join(F.transform(parts, lambda x: F.coalesce(codes[x], x)), "")


# The pattern's form and its one- and three-letter codes are fixed values, as texts write substitutions.
def substitutions(text: ColumnOrName) -> Column:
    """Sorted distinct protein substitutions (X123Y) that a text writes with one-letter or three-letter codes, in any case."""
    three, one = "|".join(RESIDUES), "".join(RESIDUES.values())
    pattern = rf"(?i)(?<![A-Za-z0-9])(?:p\.)?(?:({three})(\d+)({three})|([{one}])(\d+)([{one}]))(?![A-Za-z0-9])"
    part = lambda x, long, short: F.when(F.regexp_extract(x, pattern, long) != "", residue_code(F.regexp_extract(x, pattern, long))).otherwise(F.upper(F.regexp_extract(x, pattern, short)))
    found = F.transform(F.regexp_extract_all(_col(text), F.lit(pattern), F.lit(0)), lambda x: F.concat(part(x, 1, 4), F.greatest(F.regexp_extract(x, pattern, 2), F.regexp_extract(x, pattern, 5)), part(x, 3, 6)))
    return F.array_sort(F.array_distinct(found))


# Spellings of a gene family before the letter of a member, and the name that members are given.
FAMILY, MEMBER_OF = r"(?i)\b(?:GRIN2|GluN2)([AB])\b", "GRIN2"


def gene_mentions(text: ColumnOrName) -> Column:
    """Sorted distinct members of the gene family that a text names, in any spelling."""
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(_col(text), F.lit(FAMILY), F.lit(1)), lambda m: F.concat(F.lit(MEMBER_OF), F.upper(m)))))


def decimal_text(x: ColumnOrName) -> Column:
    """Whether a string is a decimal number with or without an exponent; true for null."""
    return F.coalesce(_col(x).rlike(r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$"), _col(x).isNull())


def leading_number(x: ColumnOrName) -> Column:
    """The number that a text starts with (thousands commas allowed), else null."""
    found = F.regexp_extract(_col(x), r"^\s*([+-]?\d[\d,]*(?:\.\d+)?)", 1)
    return F.replace(found, F.lit(","), F.lit("")).try_cast("double")


def micro_sign(x: ColumnOrName) -> Column:
    """The Greek letter mu written as the micro sign."""
    return F.translate(_col(x), "μ", "µ")


def split_list(x: ColumnOrName, pattern: str = r"[|;,\s]+") -> Column:
    """The non-empty parts of a list in a string."""
    return F.filter(F.split(_col(x), pattern), lambda p: p != "")


def tokens_overlap(x: ColumnOrName, wanted: Sequence[str], pattern: str = r"[|;,\s]+") -> Column:
    return F.arrays_overlap(split_list(x, pattern), F.array(*[F.lit(w) for w in wanted]))


def first_label(*columns: ColumnOrName) -> Column:
    """The first value that is neither null nor empty."""
    return F.coalesce(*[F.nullif(_col(c), F.lit("")) for c in columns])


def quoted_or(terms: ColumnOrName) -> Column:
    """A query that asks for any of an array's phrases, in quotes and without quotes inside."""
    return F.array_join(F.transform(_col(terms), lambda t: F.concat(F.lit('"'), F.replace(t, F.lit('"'), F.lit("")), F.lit('"'))), " OR ")


# Characters that queries of conditions do not take.
UNTAKEN = r"[()\[\]{}\"\\]"


def condition_query(terms: ColumnOrName) -> Column:
    """A query that asks for any of an array's phrases, in quotes, with brackets, quotes and backslashes as spaces and single
    spaces between words. Phrases of which nothing is left are left out."""
    clean = F.transform(_col(terms), lambda t: F.trim(F.regexp_replace(F.regexp_replace(t, UNTAKEN, " "), r"\s+", " ")))
    return F.array_join(F.transform(F.filter(clean, lambda t: t != ""), lambda t: F.concat(F.lit('"'), t, F.lit('"'))), " OR ")


def required_section(text: ColumnOrName, start: str, *ends: str) -> Column:
    """What stands between the first `start` and the nearest of the markers `ends` behind it, or the text's end if it has
    none of them; a text without `start` is an error when the plan runs. Null stays null."""
    t = _col(text)
    at = F.locate(start, t)
    rest = F.substring(t, at + len(start), F.length(t))
    found = [F.when(F.locate(e, rest) > 0, F.locate(e, rest)) for e in ends]
    until = F.array_min(F.array(*found)) if found else F.lit(None)
    there = F.when(at > 0, F.lit(True)).otherwise(F.raise_error(F.lit(f"missing marker: {start}")).cast("boolean"))
    return F.when(t.isNotNull() & there, F.coalesce(F.substring(rest, F.lit(1), until - 1), rest))


def section_tokens(text: ColumnOrName, pattern: str, start: str, *ends: str) -> Column:
    """The matches of a pattern in a required section, in order, each time it stands there."""
    return F.regexp_extract_all(required_section(text, start, *ends), F.lit(pattern), F.lit(0))


def between_markers(text: ColumnOrName, start: str, end: str) -> Column:
    """What stands between the first `start` and the next `end`, else null."""
    t = _col(text)
    at = F.locate(start, t)
    rest = F.substring(t, at + len(start), F.length(t))
    until = F.locate(end, rest)
    return F.when((at > 0) & (until > 0), F.substring(rest, F.lit(1), until - 1))


# Addresses and identifiers


def url_part(url: ColumnOrName, part: str) -> Column:
    return F.try_parse_url(_col(url), F.lit(part))


def public_url(url: ColumnOrName) -> Column:
    """Whether it is an absolute http(s) address with a host; false for null."""
    return F.coalesce(F.lower(url_part(url, "PROTOCOL")).isin("http", "https") & (url_part(url, "HOST") != ""), F.lit(False))


def host_within(url: ColumnOrName, domain: str) -> Column:
    """Whether the host is the domain or one below it."""
    host = F.lower(url_part(url, "HOST"))
    return F.coalesce((host == domain) | host.endswith("." + domain), F.lit(False))


# Parameters whose values are secret.
SECRET = "api_key|apikey|key|token|access_token"


def redacted_url(url: ColumnOrName) -> Column:
    """The address without fragment and with the values of secret parameters replaced."""
    return F.regexp_replace(F.regexp_replace(_col(url), "#.*$", ""), f"(?i)([?&](?:{SECRET})=)[^&#]*", "$1REDACTED")


def without_credentials(url: ColumnOrName) -> Column:
    """Whether it is a public address that names no user and, if a port, one from 1 to 65535."""
    authority = url_part(url, "AUTHORITY")
    port = F.regexp_extract(authority, r":(\d+)$", 1).try_cast("int")
    return public_url(url) & url_part(url, "USERINFO").isNull() & (~authority.rlike(r":\d*$") | port.between(1, 65535))


def canonical_uuid(x: ColumnOrName) -> Column:
    return F.coalesce(_col(x).rlike("^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"), F.lit(False))


def doi(x: ColumnOrName) -> Column:
    """A DOI in lower case without what may stand before it."""
    return F.regexp_replace(F.lower(F.trim(_col(x))), r"^(?:https?://(?:dx\.)?doi\.org/|doi:\s*)", "")


def pmcid(x: ColumnOrName) -> Column:
    """PMC and digits; digits alone get the prefix."""
    t = F.upper(F.trim(_col(x)))
    return F.when(t.rlike("^[0-9]+$"), F.concat(F.lit("PMC"), t)).otherwise(t)


def content_id(x: ColumnOrName, digits: int = 64) -> Column:
    return F.left(F.sha2(_col(x), 256), F.lit(digits))


def canonical_json(x: ColumnOrName) -> Column:
    """JSON text with sorted keys and no spaces; null if it is not valid JSON."""
    return F.to_json(F.try_parse_json(_col(x)))


# Dates


def iso_date(x: ColumnOrName) -> Column:
    """Whether it is a date written YYYY-MM-DD; null for null."""
    return _col(x).rlike(r"^\d{4}-\d{2}-\d{2}$") & F.coalesce(F.date_format(F.try_to_date(_col(x), "yyyy-MM-dd"), "yyyy-MM-dd") == _col(x), F.lit(False))


def months(start: ColumnOrName, end: ColumnOrName) -> Column:
    """The calendar months from start to end as (first, last), clipped to both."""
    first = F.sequence(F.trunc(_col(start), "MM"), _col(end), F.expr("interval 1 month"))
    return F.transform(first, lambda m: F.struct(F.greatest(m.cast("date"), _col(start)).alias("first"), F.least(F.last_day(m), _col(end)).alias("last")))


# Numbers


def decimal(x: ColumnOrName) -> Column:
    return _col(x).try_cast("decimal(38,18)")


def same_number(a: ColumnOrName, b: ColumnOrName) -> Column:
    """Equality of numbers in strings without regard to how they are written; other strings as they are."""
    x, y = decimal(a), decimal(b)
    return F.when(x.isNotNull() & y.isNotNull(), x == y).otherwise(squeezed(micro_sign(a)).eqNullSafe(squeezed(micro_sign(b))))


def index_percentile(values: ColumnOrName, p: float) -> Column:
    """The element at int(p * (n - 1)) of the sorted values; no interpolation."""
    v = F.array_sort(_col(values))
    return F.try_element_at(v, F.floor(F.lit(p) * (F.size(v) - 1)).cast("int") + 1)


def ratio(a: ColumnOrName, b: ColumnOrName) -> Column:
    """a / b, null where b is 0 or either is null."""
    return F.try_divide(_col(a).cast("double"), _col(b).cast("double"))


def descriptive_ratio(variant: Column, control: Column, inverted: Column) -> Column:
    """variant / control of a measure, control / variant where it is `inverted` (potencies); null unless control > 0
    and variant >= 0."""
    good = (control > 0) & (variant >= 0)
    return F.when(good, F.when(inverted, ratio(control, variant)).otherwise(ratio(variant, control)))


def casefold(x: ColumnOrName) -> Column:
    """Full case folding (ß as ss), which no built-in function does; Arrow batches."""

    @F.pandas_udf("string")
    def fold(values: pd.Series) -> pd.Series:
        return values.str.casefold()

    return fold(_col(x))


def has_keys(x: ColumnOrName, names: Sequence[str]) -> Column:
    """Whether a JSON object has just these keys."""
    return F.coalesce(F.array_sort(F.json_object_keys(_col(x))) == F.array(*[F.lit(n) for n in sorted(names)]), F.lit(False))
