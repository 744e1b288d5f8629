"""Urls as column expressions. Everything but ``resolve_url`` and ``join_link``'s slow path stays in the JVM."""

from __future__ import annotations

from urllib.parse import urljoin, urlsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .arrow import arrow_function

# Endpoints of the federated sources, the query percent-encoded at the end.
ENDPOINTS = {
    "brave": "https://search.brave.com/search?q=",
    "brave news": "https://search.brave.com/news?q=",
    "mwmbl": "https://mwmbl.org/app/home/?q=",
    "britannica": "https://www.britannica.com/search?query=",
    "apnews": "https://apnews.com/search?q=",
    "wiby": "https://wiby.me/json/?q=",
    "marginalia": "https://api.marginalia.nu/public/search/",
    "searchmysite": "https://searchmysite.net/search/?q=",
    "reddit": "https://old.reddit.com/search.json?limit=25&q=",
    "images": "https://search.brave.com/images?q=",
}


def url_host(url: Column) -> Column:
    """Host of a url for block lists: no scheme, path, query or port, no lower-case ``www.``, then lower case.

    User info stays, and so does a fragment that no ``/`` or ``?`` precedes.
    """
    s = F.regexp_replace(url, r"^(?s).*?://", "")
    s = F.regexp_replace(s, r"(?s)[/?].*\z", "")
    s = F.regexp_replace(s, r":[0-9]*\z", "")
    return F.lower(F.regexp_replace(s, r"^www\.", ""))


def dedup_key(url: Column) -> Column:
    """Key under which results of several sources are one page: no scheme, ``www.`` or closing slashes, lower case."""
    s = F.replace(url, F.lit("old.reddit.com"), F.lit("www.reddit.com"))
    s = F.regexp_replace(s, r"^https?://", "")
    s = F.regexp_replace(s, r"^www\.", "")
    return F.lower(F.regexp_replace(s, r"/+\z", ""))


def netloc(url: Column) -> Column:
    """Network location as it stands: user info, port and case kept; empty without scheme."""
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)


def pattern_host(url: Column, cut_query: bool = True) -> Column:
    """Host by pattern, case and port kept; empty unless http(s). ``cut_query`` also ends it at ``?``."""
    return F.regexp_extract(url, r"^https?://([^/?]+)" if cut_query else r"^https?://([^/]+)", 1)


def field_host(text: Column) -> Column:
    """Host of a url or of a bare host with a path: the third field between slashes after http(s), else the first."""
    parts = F.split(text, "/")
    return F.when(parts[0].isin("http:", "https:"), F.coalesce(F.get(parts, F.lit(2)), F.lit(""))).otherwise(parts[0])


def visit_host(href: Column) -> Column:
    """Host in a redirect link of the visit service; empty for other links."""
    return F.regexp_extract(href, r"^https://api.smallweb.cc/db/visit/([^/]+)", 1)


def text_urls(text: Column) -> Column:
    """Scheme and host of every url in running text."""
    return F.regexp_extract_all(text, F.lit(r"https?://[^/ )]+"), F.lit(0))


def suffixes(host: Column) -> Column:
    """A host and all its parent domains, most specific first."""
    labels = F.split(host, "[.]")
    n = F.size(labels)
    return F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(labels, i, n), "."))


def encode_query(q: Column) -> Column:
    """Percent-encode all but unreserved characters."""
    s = F.replace(F.url_encode(q), F.lit("+"), F.lit("%20"))
    return F.replace(F.replace(s, F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def request_url(source: Column, q: Column) -> Column:
    """The request of a source for a query; null for an unknown source."""
    table = F.create_map(*[F.lit(x) for kv in ENDPOINTS.items() for x in kv])
    return F.concat(F.try_element_at(table, source), encode_query(q))


def seed_url(line: Column) -> Column:
    """Start url of a line of a domain list; null where no host can be read (blank lines, spaces inside)."""
    host = F.regexp_replace(line, r"(?U)^\s+|\s+$", "")
    return F.when(host.rlike(r"^[^\s/?#:@\[\]<>^|%\\]+(?::[0-9]*)?(?:[/?#].*)?$"), F.concat(F.lit("https://"), host))


def absolute(url: Column) -> Column:
    """Whether a link is absolute http(s)."""
    return url.rlike("^https?://")


def excluded(url: Column, prefixes: list[str]) -> Column:
    """Whether a url starts with any of the prefixes."""
    out = F.lit(False)
    for p in prefixes:
        out = out | F.startswith(url, F.lit(p))
    return out


def _join(base: str | None, href: str | None) -> str | None:
    if base is None or href is None:
        return None
    try:
        return urljoin(base, href).split("#")[0]
    except ValueError:
        return None


@arrow_function("string")
def _join_udf(base: pd.Series, href: pd.Series) -> pd.Series:
    return pd.Series([_join(b, h) for b, h in zip(base, href, strict=True)], dtype=object)


def join_link(base: Column, href: Column) -> Column:
    """A link resolved against its page, without fragment. Plain absolute and root-relative links stay in the JVM."""
    plain = r"^https?://[^/?#]+(?:/(?!\.)[^?#./]*)*(?:\.[^?#./]+)?(?:\?[^#]*)?(?:#.*)?$"
    rooted = r"^/[^/?#.][^?#.]*(?:\.[^?#./]+)?(?:\?[^#]*)?(?:#.*)?$"
    cut = F.split_part(href, F.lit("#"), F.lit(1))
    root = F.regexp_extract(base, r"^(https?://[^/?#]+)", 1)
    return F.when(href.rlike(plain), cut).when(href.rlike(rooted) & (root != ""), F.concat(root, cut)).otherwise(_join_udf(base, href))


def _without_dots(path: str) -> str:
    """A path with its ``.`` and ``..`` segments carried out."""
    if "/." not in path:
        return path
    kept: list[str] = []
    parts = path.split("/")[1:]
    for p in parts:
        if p.lower() in ("..", "%2e%2e", ".%2e", "%2e."):
            kept = kept[:-1]
        elif p.lower() not in (".", "%2e"):
            kept.append(p)
    if parts[-1].lower() in (".", "..", "%2e", "%2e%2e"):
        kept.append("")
    return "/" + "/".join(kept)


_PORTS = {"http": 80, "https": 443, "ftp": 21, "ws": 80, "wss": 443}


def resolved(base: str | None, canonical: str | None) -> str | None:
    """A page's url: the canonical one joined to the base if there is one, normalised, one closing slash less off the root.

    Scheme and host in lower case, default port dropped, dot segments resolved, an empty path made
    ``/``, an international host in its ASCII form. None if either cannot be parsed.
    """
    if base is None:
        return None
    try:
        parts = urlsplit(base.strip())
        if not parts.scheme or not parts.hostname:
            return None
        joined = urljoin(base.strip(), canonical.strip()) if canonical is not None else urljoin(base.strip(), base.strip())
        p = urlsplit(joined)
        if not p.scheme or not p.hostname:
            return None
        host = p.hostname
        if not host.isascii():
            host = host.encode("idna").decode()
        if ":" in host:
            host = f"[{host}]"
        port = p.port
        user = p.netloc.rpartition("@")[0]
        where = (user + "@" if user else "") + host.lower() + (f":{port}" if port is not None and port != _PORTS.get(p.scheme) else "")
        path = _without_dots(p.path or "/").replace(" ", "%20")
        out = f"{p.scheme}://{where}{path}"
        if p.query or "?" in joined.split("#")[0]:
            out += f"?{p.query}".replace(" ", "%20")
        if p.fragment or joined.endswith("#"):
            out += f"#{p.fragment}"
        return out[:-1] if out.endswith("/") and len(path) > 1 else out
    except (ValueError, UnicodeError):
        return None


@arrow_function("string")
def _resolve_udf(base: pd.Series, canonical: pd.Series) -> pd.Series:
    return pd.Series([resolved(b, c) for b, c in zip(base, canonical, strict=True)], dtype=object)


def resolve_url(base: Column, canonical: Column) -> Column:
    """``resolved`` as a column; urls already in normal form without a canonical one stay in the JVM."""
    normal = r"^https?://[a-z0-9-]+(?:\.[a-z0-9-]+)+/(?:[A-Za-z0-9_~-]+(?:/[A-Za-z0-9_~-]+)*)?$"
    return F.when(canonical.isNull() & base.rlike(normal), base).otherwise(_resolve_udf(base, canonical))
