"""Bounded network sources. Every function takes its opener, so tests and offline runs need no network."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable
from datetime import datetime, timezone
from urllib.parse import quote, urlencode, urljoin, urlsplit
from urllib.request import urlopen

from assaykit.sources.formats import FormatError, from_jats

SEARCH = "https://www.ebi.ac.uk/europepmc/webservices/rest/search"
FULL_TEXT = "https://www.ebi.ac.uk/europepmc/webservices/rest/{}/fullTextXML"


class SourceError(ValueError):
    """A remote source is refused, too large, or not what was asked for."""


def _get(url: str, limit: int, opener: Callable) -> tuple[bytes, str]:
    if urlsplit(url).scheme not in ("http", "https"):
        raise SourceError("only http and https addresses are fetched")
    with opener(url) as answer:
        data = answer.read(limit + 1)
        final = answer.geturl() if hasattr(answer, "geturl") else url
    if len(data) > limit:
        raise SourceError(f"more than {limit} bytes")
    return data, final


def search(query: str, page_size: int = 25, opener: Callable = urlopen) -> list[dict]:
    """Open literature by query; hits without a PMC id are left out."""
    if not query.strip() or not 1 <= page_size <= 100:
        raise SourceError("a query, and a page size of 1 to 100")
    data, _ = _get(f"{SEARCH}?{urlencode({'query': query, 'format': 'json', 'pageSize': page_size})}", 10 << 20, opener)
    hits = json.loads(data).get("resultList", {}).get("result", [])
    return [{"pmcid": h["pmcid"], "title": h.get("title", ""), "year": h.get("pubYear"), "doi": h.get("doi"), "pmid": h.get("pmid"), "license": h.get("license"), "open_access": str(h.get("isOpenAccess", "")).upper() in ("Y", "TRUE")} for h in hits if h.get("pmcid")]


def record(data: bytes, url: str, method: str, supplied: dict | None = None) -> dict:
    """Provenance of fetched bytes; what is known for certain overrides what was supplied."""
    digest = hashlib.sha256(data).hexdigest()
    found = (supplied or {}) | {"source_hash": digest, "content_size_bytes": len(data), "source_url": url, "retrieval_method": method, "retrieved_at": datetime.now(timezone.utc).isoformat()}
    return found | {"source_version": found.get("source_version") or digest}


def full_text(pmcid: str, opener: Callable = urlopen, limit: int = 50 << 20) -> tuple[bytes, dict]:
    if not re.fullmatch(r"PMC\d+", pmcid):
        raise SourceError(f"not a PMC id: {pmcid}")
    data, url = _get(FULL_TEXT.format(quote(pmcid)), limit, opener)
    if b"<article" not in data or b"license" not in data:
        raise SourceError("no article with a license")
    return data, record(data, url, "europepmc_full_text", {"pmcid": pmcid})


def fetch(url: str, supplied: dict | None = None, opener: Callable = urlopen, limit: int = 100 << 20) -> tuple[bytes, dict]:
    """Any file by address; the header of an article is read where the bytes are one."""
    data, final = _get(url, limit, opener)
    known = dict(supplied or {})
    if b"<article" in data[:4096]:
        try:
            article = from_jats(data, final, {})
            known = {k: article[k] for k in ("doc_id", "title", "year", "license") if article.get(k)} | article["metadata"] | known
        except FormatError:
            pass
    return data, record(data, final, "http", known)


def fetch_supplement(href: str, base_url: str, opener: Callable = urlopen, limit: int = 50 << 20) -> tuple[bytes, dict]:
    data, final = _get(urljoin(base_url, href), limit, opener)
    return data, record(data, final, "supplement_http", {"href": href})
