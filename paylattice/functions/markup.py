"""Tags of a page, numbered once with their extent; selectors are lookups on that list.

Every element is an interval of character offsets: where its opening tag starts
(``first``), where its content starts (``inner``) and ends (``last``).  An element stands
inside another one if its ``first`` lies in the other's content.  Matching each
closing tag to its opening one needs a running stack, which no built-in function
has; so one Arrow batch function makes the list and everything else is column expressions.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: parts of a page that hold no elements, and tags that hold nothing ---
HIDDEN = r"(?is)<(script|style)\b.*?</\1>|<!--.*?-->"
EMPTY = frozenset("area base br col embed hr img input link meta param source track wbr".split())
ATTRIBUTES = ["id", "class", "data-test", "data-testid", "href"]

_TAG = re.compile(r"""<!--.*?-->|<(?:(script)|style)\b.*?</(?(1)script|style)>|<(/?)([a-z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+|[^>]*+)>""",
                  re.DOTALL | re.IGNORECASE)
_ATTRIBUTE = re.compile(r"""(?:^|(?<=[\s"']))(id|class|data-test|data-testid|href)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
_CLOSES_ITSELF = re.compile(r"""(?:^|[\s"'])/$""")
NODE = "struct<tag:string, " + ", ".join(f"`{a}`:string" for a in ATTRIBUTES) + ", first:int, inner:int, last:int>"


def intervals(html: str | None) -> list[dict]:
    """Elements of one page in document order.

    A closing tag ends the nearest open element of its name and whatever is open in it; one that
    matches nothing is ignored.  Elements never closed end with the text.
    """
    nodes: list[dict] = []
    stack: list[dict] = []
    opened: dict[str, int] = {}
    for m in _TAG.finditer(html or ""):
        _, closing, name, rest = m.groups()
        if name is None:
            continue
        name = name.lower()
        if closing:
            while opened.get(name):
                node = stack.pop()
                node["last"] = m.start()
                opened[node["tag"]] -= 1
                if node["tag"] == name:
                    break
            continue
        node = {"tag": name, **dict.fromkeys(ATTRIBUTES), "first": m.start(), "inner": m.end(), "last": m.end()}
        for key, *values in _ATTRIBUTE.findall(rest):
            if node[key.lower()] is None:
                node[key.lower()] = next((v for v in values if v), "")
        nodes.append(node)
        if name not in EMPTY and not _CLOSES_ITSELF.search(rest):
            stack.append(node)
            opened[name] = opened.get(name, 0) + 1
    for node in stack:
        node["last"] = len(html)
    return nodes


def elements(html: Column) -> Column:
    """All elements of a page as an array of intervals; none for a null page."""

    @F.pandas_udf(f"array<{NODE}>")
    def numbered(pages: pd.Series) -> pd.Series:
        return pages.map(intervals)

    return numbered(html)


# ---------------------------------------------------------------- selectors: node -> condition

Selector = Callable[[Column], Column]


def tag(*names: str) -> Selector:
    return lambda n: n["tag"].isin(*names)


def part(attribute: str, text: str, *tags: str) -> Selector:
    """Elements whose attribute contains a text, of some tags only if given."""
    def test(n: Column) -> Column:
        found = F.coalesce(n[attribute].contains(text), F.lit(False))
        return found & n["tag"].isin(*tags) if tags else found
    return test


def has_class(name: str, *tags: str) -> Selector:
    def test(n: Column) -> Column:
        found = F.coalesce(F.array_contains(F.split(n["class"], r"\s+"), name), F.lit(False))
        return found & n["tag"].isin(*tags) if tags else found
    return test


def named(name: str) -> Selector:
    """Elements that carry a name as id, class or test mark."""
    return lambda n: has_class(name)(n) | F.coalesce(n["id"] == name, F.lit(False)) | F.coalesce(n["data-test"] == name, F.lit(False))


def link(n: Column) -> Column:
    return (n["tag"] == "a") & n["href"].isNotNull()


def every(nodes: Column, *selectors: Selector) -> Column:
    """Elements that one of the selectors takes, in document order."""
    def test(n: Column) -> Column:
        out = selectors[0](n)
        for s in selectors[1:]:
            out = out | s(n)
        return out
    return F.filter(nodes, test)


def first(nodes: Column, *selectors: Selector) -> Column:
    return F.get(every(nodes, *selectors), F.lit(0))


def within(nodes: Column, outer: Column) -> Column:
    """Elements inside another one."""
    return F.filter(nodes, lambda n: (n["first"] >= outer["inner"]) & (n["first"] < outer["last"]))


def outermost(nodes: Column) -> Column:
    """Without those that stand inside another one of a different class; one in another of its own class counts."""
    def apart(n: Column) -> Column:
        return ~F.exists(nodes, lambda o: (n["first"] >= o["inner"]) & (n["first"] < o["last"]) & ~n["class"].eqNullSafe(o["class"]))
    return F.filter(nodes, apart)


def inner_html(html: Column, node: Column) -> Column:
    return F.substring(html, node["inner"] + 1, node["last"] - node["inner"])
