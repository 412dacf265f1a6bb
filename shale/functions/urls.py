"""Column functions over URLs, by the generic URI pattern; they never fail on a broken URL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shale.functions.text import filled

URI = r"^(?:([^:/?#]+):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?"


def part(url: Column, which: int) -> Column:
    """1 scheme, 2 authority, 3 path, 4 query, 5 fragment; '' where missing."""
    return F.regexp_extract(url, URI, which)


def normalize_url(x: Column) -> Column:
    """Trimmed, with a scheme; '' stays empty."""
    t = F.replace(F.trim(F.coalesce(x, F.lit(""))), F.lit("；"), F.lit(";"))
    return F.when(t == "", t).when(t.startswith("www."), F.concat(F.lit("https://"), t)).when(t.rlike("(?i)^https?://"), t).otherwise(F.concat(F.lit("http://"), t))


def split_urls(x: Column) -> Column:
    """URLs split at ';' or a comma between blanks, each normalised."""
    parts = F.split(F.trim(F.coalesce(x, F.lit(""))), r"\s*;\s*|\s+,\s+")
    return F.transform(F.filter(F.transform(parts, lambda p: F.trim(p)), lambda p: p != ""), normalize_url)


def union_urls(*columns: Column) -> Column:
    return F.array_distinct(F.concat(*[split_urls(c) for c in columns]))


def host_key(url: Column) -> Column:
    """Authority in lower case, without any 'www.'."""
    return F.replace(F.lower(part(url, 2)), F.lit("www."), F.lit(""))


def canonical_url_key(url: Column) -> Column:
    """//host/path?query: no scheme, leading 'www.' or fragment."""
    query = part(url, 4)
    key = F.concat(F.lit("//"), F.regexp_replace(F.lower(part(url, 2)), r"^www\.", ""), F.coalesce(filled(part(url, 3)), F.lit("/")), F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))
    return F.when(F.coalesce(url, F.lit("")) == "", "").otherwise(key)


def origin_key(url: Column) -> Column:
    """scheme://host, without a leading 'www.'."""
    return F.concat(F.coalesce(filled(part(url, 1)), F.lit("http")), F.lit("://"), F.regexp_replace(F.lower(part(url, 2)), r"^www\.", ""))


def defragmented(url: Column) -> Column:
    return F.regexp_replace(url, "#.*$", "")


def base_endpoint(url: Column) -> Column:
    return F.regexp_replace(url, r"[?#].*$", "")


def url_hash(url: Column) -> Column:
    return F.sha2(url, 256)


def params(url: Column) -> Column:
    """map<string, array<string>> of the query, percent and plus decoded; names keep their order, blank values stay."""
    pairs = F.filter(F.split(part(url, 4), "&"), lambda p: p != "")
    decoded = lambda s: F.coalesce(F.try_url_decode(s), s)
    pairs = F.transform(pairs, lambda p: F.struct(decoded(F.regexp_extract(p, "^([^=]*)", 1)).alias("k"), decoded(F.regexp_extract(p, "(?s)^[^=]*=(.*)", 1)).alias("v")))
    names = F.array_distinct(F.transform(pairs, lambda p: p["k"]))
    return F.map_from_arrays(names, F.transform(names, lambda n: F.transform(F.filter(pairs, lambda p: p["k"] == n), lambda p: p["v"])))


def has_name(names: Column, known: tuple[str, ...], prefix: str = "", fold: bool = True) -> Column:
    """Whether a name is known, or starts with the prefix."""
    test = lambda n: (F.lower(n) if fold else n).isin(*known)
    return F.exists(names, lambda n: test(n) | n.startswith(prefix) if prefix else test(n))


def _resolved(segments: Column) -> Column:
    """A path of these segments, without dot segments."""
    none = F.array().cast("array<string>")

    def step(done: Column, x: Column) -> Column:
        back = F.when(F.size(done) > 0, F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(done)
        return F.when(x == "..", back).when(x == ".", done).otherwise(F.concat(done, F.array(x)))

    path = F.array_join(F.aggregate(segments, none, step), "/")
    path = F.when(F.element_at(segments, -1).isin(".", ".."), F.concat(path, F.lit("/"))).otherwise(path)
    return F.when(path.startswith("/"), path).otherwise(F.concat(F.lit("/"), path))


def absolute(base: Column, href: Column) -> Column:
    """href against base: full, protocol-relative, rooted, query, fragment and relative references.

    Dot segments of rooted and relative paths are resolved, however many there are; what names a host stays as it is.
    """
    origin = F.concat(part(base, 1), F.lit("://"), part(base, 2))
    own, rest = part(href, 3), F.regexp_extract(href, r"^[^?#]*(.*)$", 1)
    folder = F.split(F.regexp_replace(part(base, 3), "[^/]*$", ""), "/")
    segments = F.when(own.startswith("/"), F.split(own, "/")).otherwise(
        F.concat(F.array(F.lit("")), F.filter(F.concat(folder, F.slice(F.split(own, "/"), F.lit(1), F.size(F.split(own, "/")) - 1)), lambda x: x != ""), F.array(F.element_at(F.split(own, "/"), -1)))
    )
    return (
        F.when(href == "", base)
        .when(href.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), href)
        .when(href.startswith("//"), F.concat(part(base, 1), F.lit(":"), href))
        .when(href.startswith("?"), F.concat(base_endpoint(base), href))
        .when(href.startswith("#"), F.concat(defragmented(base), href))
        .otherwise(F.concat(origin, _resolved(segments), rest))
    )


def list_url(endpoint: str, category: Column, page: Column, limit: int = 70) -> Column:
    return F.concat(F.lit(f"{endpoint}?cate_code="), F.url_encode(category), F.lit(f"&limit={limit}&page="), page.cast("string"))


def compact_detail_url(base: Column, url: Column, endpoint: Column) -> Column:
    """endpoint?pid=… if the URL has a pid, else the whole URL."""
    full = absolute(base, url)
    pid = F.get(F.try_element_at(params(full), F.lit("pid")), F.lit(0))
    return F.when(F.coalesce(pid, F.lit("")) != "", F.concat(endpoint, F.lit("?pid="), F.url_encode(pid))).otherwise(full)
