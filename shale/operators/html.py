"""Structure of captured HTML pages: one vectorised parse per page, everything else on Columns."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shale.functions import text as tx
from shale.functions import urls
from shale.functions.batches import slices

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: What a click opens. Fixed value.
CLICK = r"(?:location\.href|window\.location(?:\.href)?)\s*=\s*['\"]([^'\"]+)['\"]"
HIDDEN = frozenset(("script", "style", "noscript"))
PAGE = """struct<
  title:string, og_title:string, canonical:string, text:string,
  links:array<struct<href:string,label:string>>,
  targets:array<struct<element:int,kind:string,target:string,label:string>>,
  forms:array<struct<index:int,method:string,action:string,fields:array<struct<name:string,tag:string,type:string,value:string,options:array<struct<value:string,text:string>>>>,text:string>>,
  scripts:array<struct<src:string,body:string>>,
  rows:array<struct<table_no:int,head:array<string>,cells:array<string>,kinds:array<string>,first_marks:string,href:string>>,
  comment:string, right_cells:array<string>, product_title:string>""".replace("\n", "")


def squeezed(parts: list[str]) -> str:
    return re.sub(r"\s+", " ", " ".join(p.strip() for p in parts if p.strip())).strip()


class _Page(HTMLParser):
    """Collects a page in one pass. An element's text is what has come since it began: open ones keep no text of their own, however many they are."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out = {"title": None, "og_title": None, "canonical": None, "links": [], "targets": [], "forms": [], "scripts": [], "rows": [], "comment": None, "right_cells": [], "product_title": None}
        self.stack: list[dict] = []
        self.open: Counter[str] = Counter()
        self.data: list[str] = []
        self.text: list[str] = []
        self.tables = self.elements = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        a = {k: v or "" for k, v in attrs}
        self.elements += 1
        node = {"tag": tag, "attrs": a, "from": len(self.data), "row": None, "element": self.elements}
        if tag == "table":
            self.tables += 1
            node["no"], node["head"] = self.tables, []
        elif tag == "tr":
            self._close_to({"tr"}, {"table"})
            node["cells"], node["kinds"], node["marks"], node["href"] = [], [], [], None
        elif tag in ("td", "th"):
            self._close_to({"td", "th"}, {"tr", "table"})
        elif tag == "option":
            self._close_to({"option"}, {"select"})
        elif tag == "form":
            node["fields"], node["index"] = [], sum(n["tag"] == "form" for n in self.stack) + len(self.out["forms"]) + 1
        elif tag == "select":
            node["options"] = []
        elif tag == "meta" and a.get("property") == "og:title" and self.out["og_title"] is None:
            self.out["og_title"] = a.get("content") or None
        elif tag == "link" and "canonical" in a.get("rel", "").split() and self.out["canonical"] is None:
            self.out["canonical"] = a.get("href") or None
        elif tag == "img" and (cell := self._open({"td", "th"})) is not None:
            cell.setdefault("marks", []).extend([a.get("src", ""), a.get("alt", "")])
        if tag in ("input", "textarea", "button") and a.get("name") and (form := self._open({"form"})) is not None:
            form["fields"].append({"name": a["name"], "tag": tag, "type": a.get("type", ""), "value": a.get("value", ""), "options": []})
        if tag not in VOID:
            self.stack.append(node)
            self.open[tag] += 1
        else:
            self._targets(node)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if self.open[tag]:
            while self._close(self.stack.pop()) != tag:
                pass

    def handle_data(self, data: str) -> None:
        if not any(self.open[tag] for tag in HIDDEN):
            self.text.append(data)
        self.data.append(data)

    def _open(self, tags: set[str]) -> dict | None:
        return next((n for n in reversed(self.stack) if n["tag"] in tags), None)

    def _close_to(self, tags: set[str], stop: set[str]) -> None:
        """An element of these tags that is open is closed, unless one of stop stands in between."""
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i]["tag"] in stop:
                return
            if self.stack[i]["tag"] in tags:
                while len(self.stack) > i:
                    self._close(self.stack.pop())
                return

    def _label(self, n: dict) -> str:
        return squeezed(self.data[n["from"] :])

    def _targets(self, n: dict) -> None:
        """Where an element leads: its reference, then what a click on it opens."""
        found = [("a", n["attrs"]["href"])] if n["tag"] == "a" and n["attrs"].get("href") else []
        found += [("click", x) for x in re.findall(CLICK, n["attrs"].get("onclick", ""))]
        self.out["targets"] += [{"element": n["element"], "kind": kind, "target": x, "label": self._label(n)} for kind, x in found]

    def _close(self, n: dict) -> str:
        tag, a = n["tag"], n["attrs"]
        self.open[tag] -= 1
        if tag == "title" and self.out["title"] is None:
            self.out["title"] = "".join(self.data[n["from"] :])
        elif tag == "a" and "href" in a:
            self.out["links"].append({"href": a["href"], "label": self._label(n), "element": n["element"]})
            row = self._open({"tr"})
            if row is not None and row["href"] is None and "sub8_1_vvv.html?pid=" in a["href"]:
                row["href"] = a["href"]
        elif tag == "option" and (select := self._open({"select"})) is not None:
            select["options"].append({"value": a.get("value", ""), "text": self._label(n)})
        elif tag == "select" and a.get("name") and (form := self._open({"form"})) is not None:
            form["fields"].append({"name": a["name"], "tag": tag, "type": a.get("type", ""), "value": a.get("value", ""), "options": n["options"][:12]})
        elif tag == "form":
            self.out["forms"].append({"index": n["index"], "method": (a.get("method") or "GET").upper(), "action": a.get("action", ""), "fields": n["fields"], "text": self._label(n)[:200]})
        elif tag == "script":
            self.out["scripts"].append({"src": a.get("src") or None, "body": "".join(self.data[n["from"] :])})
        elif tag in ("td", "th"):
            row, table, label = self._open({"tr"}), self._open({"table"}), self._label(n)
            if row is not None:
                if not row["cells"]:
                    row["marks"] = [*n.get("marks", []), label]
                row["cells"].append(label)
                row["kinds"].append(tag)
            if tag == "th" and table is not None:
                table["head"].append(label)
            if tag == "td" and "ar" in a.get("class", "").split():
                self.out["right_cells"].append(label)
        elif tag == "tr" and (table := self._open({"table"})) is not None:
            self.out["rows"].append({"table_no": table["no"], "head": table["head"], "cells": n["cells"], "kinds": n["kinds"], "first_marks": " ".join(n["marks"]).lower(), "href": n["href"]})
        elif tag == "strong" and self.out["product_title"] is None and any(x["tag"] == "td" and "al" in x["attrs"].get("class", "").split() for x in self.stack) and any(x["tag"] == "table" and "shop_table" in x["attrs"].get("class", "").split() for x in self.stack):
            self.out["product_title"] = self._label(n)
        if "product_comment" in a.get("class", "").split() and self.out["comment"] is None:
            self.out["comment"] = self._label(n)
        self._targets(n)
        return tag

    def finish(self) -> dict:
        while self.stack:
            self._close(self.stack.pop())
        self.out["forms"].sort(key=lambda f: f["index"])
        for kind in ("links", "targets"):  # elements end in another order than they begin
            self.out[kind].sort(key=lambda x: x["element"])
        self.out["links"] = [{k: x[k] for k in ("href", "label")} for x in self.out["links"]]
        return self.out | {"text": squeezed(self.text)}


def parse_page(html: str | None) -> dict:
    page = _Page()
    page.feed(html or "")
    page.close()
    return page.finish()


#: Bytes of HTML that are parsed at a time: a page in Python takes many times what its HTML does.
PARSED_BYTES = 1 << 20


def _struct(**fields: pa.DataType) -> pa.DataType:
    return pa.struct(list(fields.items()))


_TEXT = pa.string()
_TEXTS = pa.list_(_TEXT)
_FIELD = _struct(name=_TEXT, tag=_TEXT, type=_TEXT, value=_TEXT, options=pa.list_(_struct(value=_TEXT, text=_TEXT)))
#: :data:`PAGE` as Arrow has it.
ARROW_PAGE = _struct(
    title=_TEXT, og_title=_TEXT, canonical=_TEXT, text=_TEXT,
    links=pa.list_(_struct(href=_TEXT, label=_TEXT)),
    targets=pa.list_(_struct(element=pa.int32(), kind=_TEXT, target=_TEXT, label=_TEXT)),
    forms=pa.list_(_struct(index=pa.int32(), method=_TEXT, action=_TEXT, fields=pa.list_(_FIELD), text=_TEXT)),
    scripts=pa.list_(_struct(src=_TEXT, body=_TEXT)),
    rows=pa.list_(_struct(table_no=pa.int32(), head=_TEXTS, cells=_TEXTS, kinds=_TEXTS, first_marks=_TEXT, href=_TEXT)),
    comment=_TEXT, right_cells=_TEXTS, product_title=_TEXT,
)


def _parse(html: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in html:
        for own in slices(batch, PARSED_BYTES):
            yield pa.array([parse_page(x) for x in own.to_pylist()], type=ARROW_PAGE)


def page(html: Column) -> Column:
    """The parsed page, in slices of :data:`PARSED_BYTES`. Null counts as an empty page."""
    # Declared as not deterministic, so that a filter on a part of the page isn't pushed below it and parses it once more.
    return F.arrow_udf(_parse, PAGE).asNondeterministic()(html)


def with_page(pages: DataFrame, html: str = "html") -> DataFrame:
    """pages with the struct column page."""
    return pages.withColumn("page", page(F.col(html)))


def title(p: Column) -> Column:
    """<title>, else og:title, 120 characters at most; '' if there is none. A title of blanks is none, but og:title isn't taken for it."""
    own = F.trim(F.regexp_replace(F.nullif(p["title"], F.lit("")), r"(?U)\s+", " "))
    return F.coalesce(F.substr(own, F.lit(1), F.lit(120)), F.substr(p["og_title"], F.lit(1), F.lit(120)), F.lit(""))


#: Strings in scripts that look like endpoints. Fixed values.
ENDPOINTS = (
    r"(?i)(?:fetch|axios\.(?:get|post)|\$\.(?:ajax|get|post))\s*\(\s*['\"]([^'\"]+)",
    r"(?i)url\s*:\s*['\"]([^'\"]+)",
    r"(?i)['\"]([^'\"]*(?:ajax|api|json|load|search|list|get|post)[^'\"]*)['\"]",
)


def inline_scripts(p: Column) -> Column:
    """The scripts with a text of their own."""
    return F.transform(F.filter(p["scripts"], lambda s: s["src"].isNull() & (s["body"] != "")), lambda s: s["body"])


def script_sources(p: Column, url: Column) -> Column:
    """Where the page's other scripts lie."""
    return F.transform(F.filter(p["scripts"], lambda s: s["src"].isNotNull()), lambda s: urls.absolute(url, tx.stripped(s["src"])))


def endpoint_hints(p: Column, url: Column) -> Column:
    """Distinct URL-like strings of inline scripts, against the page's URL, sorted, 80 at most."""
    inline = F.array_join(inline_scripts(p), "\n")
    found = F.filter(F.concat(*[F.regexp_extract_all(inline, F.lit(r), F.lit(1)) for r in ENDPOINTS]), lambda x: F.length(x) <= 220)
    return F.slice(F.array_sort(F.array_distinct(F.transform(found, lambda x: urls.absolute(url, x)))), 1, 80)


def forms(p: Column, url: Column) -> Column:
    """The page's forms, their actions against its URL; a form without one leads to the page."""
    return F.transform(p["forms"], lambda f: f.withField("action", F.when(f["action"] == "", url).otherwise(urls.absolute(url, tx.stripped(f["action"])))))


def has_next_page(p: Column, number: Column) -> Column:
    pattern = F.concat(F.lit("[?&]page="), number.cast("string"), F.lit("(&|#|$)"))
    return F.exists(p["links"], lambda a: F.regexp_like(a["href"], pattern))


def key_values(p: Column) -> Column:
    """map of th -> following td over all rows; a later label overwrites."""
    pairs = F.flatten(F.transform(p["rows"], lambda r: F.filter(F.transform(F.sequence(F.lit(0), F.size(r["cells"])), lambda i: F.struct(F.get(r["cells"], i).alias("key"), F.get(r["cells"], i + 1).alias("value"), (F.get(r["kinds"], i) == "th").alias("is_key"), (F.get(r["kinds"], i + 1) == "td").alias("is_value"))), lambda x: x["is_key"] & x["is_value"] & (x["key"] != "") & (x["value"] != ""))))
    names = F.array_distinct(F.transform(pairs, lambda x: x["key"]))
    return F.map_from_arrays(names, F.transform(names, lambda k: F.element_at(F.filter(pairs, lambda x: x["key"] == k), -1)["value"]))


#: Bodies may be in these encodings; the first that decodes is taken. Fixed values.
CHARSETS = ("utf-8", "cp949", "euc-kr", "latin-1")


@F.pandas_udf(T.StringType())
def decode_body(body: pd.Series, charset: pd.Series) -> pd.Series:
    """Bytes as text: the declared charset first, then :data:`CHARSETS`."""

    def one(raw: bytes | None, declared: str | None) -> str | None:
        if raw is None:
            return None
        for name in [declared, *CHARSETS] if declared else CHARSETS:
            try:
                return bytes(raw).decode(name)
            except (UnicodeDecodeError, LookupError):
                continue
        return None

    return pd.Series([one(b, c) for b, c in zip(body, charset, strict=True)], dtype=object)
