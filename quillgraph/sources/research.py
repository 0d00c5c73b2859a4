"""Records of the literature: citations, article pages and bodies, ontologies, caches and manifests."""

from __future__ import annotations

import json
from collections.abc import Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import blank, pmcid
from .markup import _flat, _node

CITATION = "pmid string, title string, abstract string, journal string, year string, authors array<string>, mesh array<string>, doi string, pmcid string"


def _text(element: ElementTree.Element | None) -> str | None:
    return None if element is None else " ".join("".join(element.itertext()).split()) or None


def citations(batches: DataFrame, id_col: str, xml_col: str) -> DataFrame:
    """(id, position, CITATION): the citations of fetched batches, one XML set a row.

    Text inside inline tags stays in its sentence. Identifiers are those of the article itself, not of its references.
    """

    def expand(xml: str) -> Iterator[tuple]:
        for article in ElementTree.fromstring(xml).iter("PubmedArticle"):
            ids = {i.get("IdType"): _text(i) for i in article.findall("PubmedData/ArticleIdList/ArticleId")}
            names = [" ".join(filter(None, (_text(a.find("ForeName")), _text(a.find("LastName"))))) or _text(a.find("CollectiveName")) for a in article.iter("Author")]
            year = article.find(".//JournalIssue/PubDate/Year")
            yield (
                _text(article.find("MedlineCitation/PMID")), _text(article.find(".//ArticleTitle")),
                "\n".join(filter(None, map(_text, article.findall(".//Abstract/AbstractText")))) or None, _text(article.find(".//Journal/Title")), _text(year),
                [n for n in names if n], [t for t in map(_text, article.findall(".//MeshHeading/DescriptorName")) if t], ids.get("doi"), ids.get("pmc"),
            )

    return _flat(batches, id_col, [xml_col], expand, CITATION)


def latest_citations(found: DataFrame, order: str) -> DataFrame:
    """One row for each pmid: that of the last write in the order."""
    return found.where(F.col("pmid").isNotNull()).groupBy("pmid").agg(F.max_by(F.struct(*[c for c in found.columns if c != "pmid"]), order).alias("r")).select("pmid", "r.*")


def root_records(files: DataFrame, id_col: str, xml_col: str) -> DataFrame:
    """(id, position, json): the direct children of an RDF document's root, each as a tree."""
    return _flat(files, id_col, [xml_col], lambda xml: [(json.dumps(_node(child), ensure_ascii=False),) for child in ElementTree.fromstring(xml)], "json string")


class _Page(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.meta: dict[str, str] = {}
        self.depth = self.skip = self.paragraphs = 0
        self.words: list[str] = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        found = dict(attrs)
        if tag == "meta" and found.get("name"):
            self.meta.setdefault(found["name"].lower(), found.get("content") or "")
        elif tag in ("main", "article"):
            self.depth += 1
        elif tag in ("script", "style"):
            self.skip += 1
        elif tag == "p" and self.depth:
            self.paragraphs += 1

    def handle_endtag(self, tag: str) -> None:
        if tag in ("main", "article"):
            self.depth = max(0, self.depth - 1)
        elif tag in ("script", "style"):
            self.skip = max(0, self.skip - 1)

    def handle_data(self, data: str) -> None:
        if self.depth and not self.skip:
            self.words.append(data)


def article_pages(pages: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """(id, position, identity, text, paragraphs): what a page says it is (citation_pmcid or citation_doi), the text
    of its main part or article, and how many paragraphs that has."""

    def expand(html: str) -> list[tuple]:
        reader = _Page()
        reader.feed(html)
        return [(reader.meta.get("citation_pmcid") or reader.meta.get("citation_doi") or None, " ".join("".join(reader.words).split()), reader.paragraphs)]

    return _flat(pages, id_col, [html_col], expand, "identity string, text string, paragraphs int")


# What pages say that want a visitor to prove or name themselves.
CHALLENGES = ("captcha", "verify you are human", "checking your browser", "access denied", "robot check", "sign in to continue", "log in to continue", "temporarily blocked")


def page_verdict(expected: str, least_chars: int = 500, least_paragraphs: int = 3) -> Column:
    """The first rule that an article page breaks: challenge, other_article, too_short, too_few_paragraphs; else ok."""
    low = F.lower(F.coalesce("text", F.lit("")))
    challenge = low.rlike("|".join(CHALLENGES)) & (F.col("paragraphs") < least_paragraphs)
    other = ~pmcid("identity").eqNullSafe(pmcid(expected))
    return F.when(challenge, "challenge").when(other, "other_article").when(F.length("text") < least_chars, "too_short").when(F.col("paragraphs") < least_paragraphs, "too_few_paragraphs").otherwise("ok")


def body_verdict(xml: str, expected: str) -> Column:
    """Whether a JATS record is the article expected and has a body: other_article, no_body or ok."""
    found = F.xpath_string(xml, F.lit("//article-id[@pub-id-type='pmc' or @pub-id-type='pmcid']"))
    return F.when(~pmcid(found).eqNullSafe(pmcid(expected)), "other_article").when(blank(F.xpath_string(xml, F.lit("//body"))), "no_body").otherwise("ok")


def rights_queue(licence_status: Column, has_body: Column) -> Column:
    """Where an article goes: ready, abstract_only (restricted), review (unknown rights) or failed (no body)."""
    return F.when(~has_body, "failed").when(licence_status == "open", "ready").when(licence_status == "restricted", "abstract_only").otherwise("review")


def reusable(cache: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (url, method, body) with `cached`: whether the cache has it under the same url, method and body, with a
    digest that is that of its content."""
    good = cache.where(F.sha2("content", 256) == F.col("sha256")).select("url", "method", F.coalesce("body", F.lit("")).alias("__body"), F.lit(True).alias("cached")).distinct()
    return wanted.withColumn("__body", F.coalesce("body", F.lit(""))).join(good, ["url", "method", "__body"], "left").select(*wanted.columns, F.coalesce("cached", F.lit(False)).alias("cached"))


def manifest_row(name: str, rows: DataFrame, files: DataFrame) -> DataFrame:
    """(dataset, records, bytes, sha256): a dataset's entry in a manifest; no records are an error when it runs.

    files: records.file_digests of what was written; the digest is that of the files' digests in order of their paths.
    """
    n = rows.agg(F.count("*").alias("records"))
    total = files.agg(F.sum("bytes").alias("bytes"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path", "sha256"))), lambda f: f.sha256), "\n"), 256).alias("sha256"))
    joined = n.join(F.broadcast(total))
    return joined.select(F.lit(name).alias("dataset"), F.when(F.col("records") > 0, F.col("records")).otherwise(F.raise_error(F.lit(f"{name} has no records")).cast("long")).alias("records"), "bytes", "sha256")


def catalogue(catalog: DataFrame, manifests: DataFrame) -> DataFrame:
    """The catalog's sources with their datasets' records and whether they have any; sources without data stay."""
    sums = manifests.groupBy("source").agg(F.count("*").alias("n_datasets"), F.sum("records").alias("records"))
    return catalog.join(sums, "source", "left").withColumns({"n_datasets": F.coalesce("n_datasets", F.lit(0).cast("long")), "records": F.coalesce("records", F.lit(0).cast("long"))}).withColumn("harvested", F.col("records") > 0)
