"""arXiv: ids, feed entries and source archives; the client is injected."""

from __future__ import annotations

import gzip
import io
import tarfile
import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.sources.sinks import fetch

ATOM = "{http://www.w3.org/2005/Atom}"


def arxiv_id(text: Column) -> Column:
    """The id in an id or address, without its version; null without one."""
    found = F.regexp_extract(text, r"(?:^|/|:)([0-9]{4}\.[0-9]{4,5}|[a-z-]+(?:\.[A-Z]{2})?/[0-9]{7})(?:v[0-9]+)?(?:\.pdf)?$", 1)
    return F.nullif(found, F.lit(""))


def entry(feed: bytes) -> tuple[str, str, str]:
    """Title, abstract and authors of a feed's first entry."""
    e = ET.fromstring(feed).find(f"{ATOM}entry")
    if e is None:
        raise ValueError("no entry")
    one = lambda tag: " ".join((e.findtext(f"{ATOM}{tag}") or "").split())
    return one("title"), one("summary"), ", ".join(" ".join((a.findtext(f"{ATOM}name") or "").split()) for a in e.findall(f"{ATOM}author"))


def tex_of(content: bytes) -> str:
    """TeX of a source archive: all ``.tex`` members by name, or the one packed file."""
    try:
        with tarfile.open(fileobj=io.BytesIO(content)) as t:
            names = sorted(m.name for m in t.getmembers() if m.isfile() and m.name.lower().endswith(".tex"))
            return "\n\n".join(t.extractfile(n).read().decode("utf-8", "replace") for n in names)
    except tarfile.ReadError:
        return gzip.decompress(content).decode("utf-8", "replace")


def papers(ids: DataFrame, get: Callable[[str], bytes], source: Callable[[str], bytes] | None = None) -> DataFrame:
    """Papers of ids (id): id, title, abstract, authors, tex, error. ``get`` fetches the feed of an id, ``source`` its archive, if wanted."""
    rows = fetch(ids.sparkSession, ids, get).withColumnRenamed("content", "feed")
    found = fetch(ids.sparkSession, ids, source).select("id", F.col("content").alias("archive"), F.col("error").alias("source_error")) if source else ids.select("id", F.lit(None).cast("binary").alias("archive"), F.lit(None).cast("string").alias("source_error"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for r in b.itertuples():
                title, abstract, authors, tex, error = None, None, None, None, r.error or r.source_error
                try:
                    if r.feed is not None:
                        title, abstract, authors = entry(r.feed)
                    tex = tex_of(r.archive) if r.archive is not None else None
                except Exception as e:  # noqa: BLE001  what can't be read is a row with its error
                    error = f"{type(e).__name__}: {e}"[:200]
                out.append((r.id, title, abstract, authors, tex, error))
            yield pd.DataFrame(out, columns=["id", "title", "abstract", "authors", "tex", "error"])

    return rows.join(found, "id").select("id", "feed", "archive", "error", "source_error").mapInPandas(run, "id string, title string, abstract string, authors string, tex string, error string")
