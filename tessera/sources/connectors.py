"""Connectors as Spark data sources: ``spark.read.format("landed_pages")`` and the like.

A connector reads pages that a crawler has landed as files; every file is one partition, so reading is
parallel and a lost task reads one file again.  ``register_connectors`` makes the formats known.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from glob import glob

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

FIELDS = ("id", "title", "authors", "year", "language", "source", "url", "abstract")
SCHEMA = "id string, title string, authors array<string>, year int, language string, source string, url string, abstract string"


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, options, parse: Callable[[str], Iterator[tuple]]):
        self.pattern = options.get("path")
        self.limit = int(options["limit"]) if "limit" in options else None
        self.parse = parse
        if not self.pattern:
            raise ValueError("option path is needed")

    def partitions(self):
        return [_File(p) for p in sorted(glob(self.pattern))] or [_File("")]

    def read(self, partition):
        if not partition.path:
            return
        with open(partition.path, encoding="utf-8") as f:
            for i, row in enumerate(self.parse(f.read())):
                if self.limit is not None and i >= self.limit:
                    return
                yield row


def _year(text: str | None) -> int | None:
    found = re.search(r"\b(1[5-9]\d\d|20\d\d)\b", text or "")
    return int(found.group()) if found else None


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def parse_atom(xml: str, source: str) -> Iterator[tuple]:
    """Entries of an Atom page: authors from author names and dc:creator, each once; the year from the
    publication date, else the published date."""
    from xml.etree import ElementTree

    try:
        root = ElementTree.fromstring(xml)
    except ElementTree.ParseError:
        return
    for entry in (e for e in root.iter() if _local(e.tag) == "entry"):
        values: dict[str, list[str]] = {}
        for e in entry.iter():
            if (e.text or "").strip():
                values.setdefault(_local(e.tag), []).append(e.text.strip())
        link = next((e.get("href") for e in entry.iter() if _local(e.tag) == "link" and e.get("href")), None)
        first = lambda *names: next((values[n][0] for n in names if n in values), None)  # noqa: E731, B023
        authors = list(dict.fromkeys([*values.get("name", []), *values.get("creator", [])]))
        if source == "jstage":
            authors = [a.strip() for name in authors for a in name.split(";") if a.strip()]
        date = first("publicationDate", "pubyear", "published", "updated")
        yield (first("id", "identifier") or link, first("title", "article_title"), authors, _year(date[:4] if date else None), first("language"), source, link, first("summary", "description", "abstract"))


def parse_listing(html: str, source: str) -> Iterator[tuple]:
    """Items of a listing page: anchors of class title or citation with the text beside them."""
    for m in re.finditer(r'(?is)<(?:li|div|tr)[^>]*class="[^"]*(?:entry|item|citation)[^"]*"[^>]*>(.*?)</(?:li|div|tr)>', html):
        block = m.group(1)
        link = re.search(r'(?is)<a[^>]*href="([^"]+)"[^>]*>(.*?)</a>', block)
        if not link:
            continue
        strip = lambda s: " ".join(re.sub(r"<[^>]+>", " ", s).split())
        names = re.search(r'(?is)<span[^>]*class="[^"]*(?:name|author)[^"]*"[^>]*>(.*?)</span>', block)
        authors = [a.strip() for a in re.split(r"[,;&]", strip(names.group(1)))] if names else []
        yield (link.group(1), strip(link.group(2)), [a for a in authors if a], _year(strip(block)), None, source, link.group(1), None)


def _connector(kind: str, parse: Callable[[str, str], Iterator[tuple]]) -> type[DataSource]:
    class Connector(DataSource):
        @classmethod
        def name(cls):
            return kind

        def schema(self):
            return SCHEMA

        def reader(self, schema):
            source = self.options.get("source", kind)
            return _Reader(self.options, lambda page: parse(page, source))

    return Connector


def register_connectors(spark: SparkSession) -> None:
    """Make the formats landed_feed (Atom pages) and landed_pages (HTML listings) known."""
    spark.dataSource.register(_connector("landed_feed", parse_atom))
    spark.dataSource.register(_connector("landed_pages", parse_listing))
