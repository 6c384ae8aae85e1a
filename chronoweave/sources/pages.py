"""Raw pages: infobox JSON of any depth and values in HTML made into nested rows."""

from __future__ import annotations

import html.parser
import json
import re
from collections.abc import Iterator
from functools import lru_cache, reduce
from operator import or_

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class _Value(html.parser.HTMLParser):
    """Lines of text and links of one value; footnotes are left out."""

    def __init__(self, base: str):
        super().__init__()
        self.base, self.text, self.links, self.skip, self.href, self.said = base, [], [], 0, None, []

    def handle_starttag(self, tag, attrs):
        if tag == "sup":
            self.skip += 1
        elif tag in ("br", "li"):
            self.text.append("\n")
        elif tag == "a" and not self.skip:
            self.href, self.said = dict(attrs).get("href"), []

    def handle_endtag(self, tag):
        if tag == "sup":
            self.skip = max(0, self.skip - 1)
        elif tag == "a" and self.href:
            href = self.base + self.href if self.href.startswith("/wiki/") else self.href
            self.links.append((_trim("".join(self.said)), href))
            self.href = None

    def handle_data(self, data):
        if not self.skip:
            self.text.append(data)
            self.said.append(data)


def _trim(text: str) -> str:
    return text.strip("'\" ,.:-\t\r\n")


def parse_value(text: str | None, base: str = "") -> tuple[list[str], list[tuple[str, str]]]:
    """Distinct values, one for each line, and distinct links to wiki pages."""
    reader = _Value(base)
    reader.feed(text or "")
    values = dict.fromkeys(v for v in map(_trim, "".join(reader.text).split("\n")) if v)
    links = dict.fromkeys((c, h) for c, h in reader.links if "/wiki/" in h)
    return list(values), list(links)


@lru_cache(1 << 12)
def _known(text: str | None, base: str) -> tuple[list[str], list[tuple[str, str]]]:
    """parse_value() of what repeats, such as labels; what it gives must not be changed."""
    return parse_value(text, base)


def parse_infobox(text: str | None, base: str = "") -> dict | None:
    """Template, ImageUrl and Data of an infobox's JSON, whatever groups its items are nested in; None if broken."""
    try:
        root = json.loads(text) if text else None
    except ValueError:
        return None
    if root is None:
        return None
    box = {"Template": None, "ImageUrl": None, "Data": []}

    def walk(item) -> None:
        if isinstance(item, list):
            for x in item:
                walk(x)
            return
        if not isinstance(item, dict):
            return
        data = item.get("data")
        kind = item.get("type")
        if kind == "data" and isinstance(data, dict):
            values, links = parse_value(data.get("value"), base)
            label, _ = parse_value(data.get("label"), base)
            if label:
                box["Data"].append({"Label": label[0], "Values": values, "Links": [{"Content": c, "Href": h} for c, h in links]})
        elif kind == "title" and isinstance(data, dict):
            values, links = parse_value(data.get("value"), base)
            box["Data"].append({"Label": "Titles", "Values": values, "Links": [{"Content": c, "Href": h} for c, h in links]})
        elif kind == "image" and isinstance(data, list) and data and not box["ImageUrl"]:
            box["ImageUrl"] = data[0].get("url") if isinstance(data[0], dict) else None
        elif kind == "navigation" and isinstance(data, dict):
            found = re.search(r"/wiki/(Template:[^\"?#]+)", data.get("value") or "")
            box["Template"] = box["Template"] or (found[1] if found else None)
        elif kind in ("group", "section", "panel") or kind is None:
            walk(data.get("value") if isinstance(data, dict) else data)

    walk(root)
    return box


def infoboxes(pages: DataFrame, id_col: str, json_col: str, base: str = "") -> DataFrame:
    """pageId and infobox (null where the JSON is broken or missing). No shuffle."""
    from ..operators.build import INFOBOX

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"pageId": f["pageId"], "infobox": [parse_infobox(x, base) for x in f["json"]]})

    rows = pages.select(F.col(id_col).cast("long").alias("pageId"), F.col(json_col).alias("json"))
    return rows.mapInPandas(run, f"pageId long, infobox {INFOBOX}")


#: Levels of groups that infobox_rows() follows in the JVM; deeper pages are parsed one by one.
DEPTH = 10
#: Values of at most so many characters are remembered when they have been read.
SHORT = 100
_GROUPS, _LEAVES = ("group", "section", "panel"), ("data", "title", "image", "navigation")


def infobox_rows(pages: DataFrame, id_col: str, json_col: str, base: str = "", depth: int = DEPTH) -> DataFrame:
    """The same as infoboxes(), with the JSON walked as variants: each level of nesting is one explode in the JVM, and Python
    sees the HTML of values only. Pages that variants can't hold (such as repeated keys) or that are nested beyond ``depth`` go
    through parse_infobox(), so the result is whole. Pages are dealt by id first, as a file may hold them in one stretch; all that
    follows stays where they are, and each is walked once. Ids must be distinct and not null."""
    from ..operators.build import INFOBOX

    spark = pages.sparkSession
    get = lambda v, path, kind: F.try_variant_get(v, path, kind)
    is_object = lambda v: get(v, "$", "map<string,variant>").isNotNull()
    none, step = F.lit(None).cast("variant"), "array<struct<path:array<int>,v:variant,kind:string,data:variant>>"
    rows = pages.select(F.col(id_col).cast("long").alias("pageId"), F.col(json_col).alias("json")).repartition(2 * spark.sparkContext.defaultParallelism, "pageId")
    items = rows.select("pageId", F.array().cast("array<int>").alias("path"), F.try_parse_json("json").alias("v"), F.lit(None).cast("string").alias("kind"), none.alias("data")).where("v IS NOT NULL")
    for _ in range(2 * depth + 1):  # a group and its list are two steps; leaves that are found go along as they are
        v, path = F.col("v"), F.col("path")
        kind, data, list_ = get(v, "$.type", "string"), get(v, "$.data", "variant"), get(v, "$", "array<variant>")
        inner = F.when(is_object(data), get(data, "$.value", "variant")).otherwise(data)
        one = lambda path, v, kind, data: F.array(F.struct(path.alias("path"), v.alias("v"), kind.alias("kind"), data.alias("data"))).cast(step)
        below = (
            F.when(F.col("kind").isNotNull(), one(path, none, F.col("kind"), F.col("data")))
            .when(list_.isNotNull(), F.transform(list_, lambda x, i: F.struct(F.concat(F.col("path"), F.array(i)).alias("path"), x.alias("v"), F.lit(None).cast("string").alias("kind"), F.lit(None).cast("variant").alias("data"))).cast(step))
            .when(is_object(v) & kind.isin(*_LEAVES), one(path, none, kind, data))
            .when(is_object(v) & (kind.isNull() | kind.isin(*_GROUPS)), one(F.concat(path, F.array(F.lit(0))), inner, F.lit(None).cast("string"), none))
        )
        items = items.select("pageId", F.inline(below))

    @F.pandas_udf("struct<values:array<string>,links:array<struct<Content:string,Href:string>>,label:string>")
    def read(value: pd.Series, label: pd.Series) -> pd.DataFrame:
        out = []
        for v, text in zip(value, label, strict=True):
            values, links = parse_value(v, base) if v and len(v) > SHORT else _known(v, base)
            named, _ = parse_value(text, base) if text and len(text) > SHORT else _known(text, base)
            out.append((values, [{"Content": c, "Href": h} for c, h in links], named[0] if named else None))
        return pd.DataFrame(out, columns=["values", "links", "label"])

    @F.pandas_udf(f"struct<box:{INFOBOX}>")
    def whole_page(text: pd.Series) -> pd.DataFrame:
        return pd.DataFrame({"box": [parse_infobox(x, base) for x in text]})

    kind, data = F.col("kind"), F.col("data")
    valued, pictures = kind.isin("data", "title") & is_object(data), get(data, "$", "array<variant>")
    told = items.select(
        "*",
        valued.alias("valued"),
        read(F.when(valued, get(data, "$.value", "string")), F.when(valued & (kind == "data"), get(data, "$.label", "string"))).alias("r"),
        ((kind == "image") & (F.size(pictures) > 0)).alias("pictured"),
        get(data, "$[0].url", "string").alias("url"),
        F.regexp_extract(get(data, "$.value", "string"), r"/wiki/(Template:[^\"?#]+)", 1).alias("template"),
        (kind.isNull() & (get(F.col("v"), "$", "array<variant>").isNotNull() | is_object(F.col("v")))).alias("deeper"),
    )
    entry = F.struct("path", F.struct(F.when(kind == "title", "Titles").otherwise(F.col("r.label")).alias("Label"), F.col("r.values").alias("Values"), F.col("r.links").alias("Links")).alias("x"))
    found = told.groupBy("pageId").agg(
        F.array_sort(F.collect_list(F.when(F.col("valued") & ((kind == "title") | F.col("r.label").isNotNull()), entry))).alias("entries"),
        F.min(F.when(F.col("pictured") & (F.col("url") != ""), F.struct("path", "url"))).alias("first"),
        F.max(F.when(F.col("pictured"), F.struct("path", "url"))).alias("last"),
        F.min(F.when((kind == "navigation") & (F.col("template") != ""), F.struct("path", "template"))).alias("place"),
        F.max("deeper").alias("deeper"),
    )
    # of images the first with a url, else what the last one has
    made = rows.select("pageId", "json", (F.try_parse_json("json").isNull() | F.is_variant_null(F.try_parse_json("json"))).alias("odd")).join(found.hint("shuffle_merge"), "pageId", "left")
    box = F.struct(F.col("place.template").alias("Template"), F.coalesce("first.url", "last.url").alias("ImageUrl"), F.coalesce(F.transform("entries", lambda e: e.x), F.array()).alias("Data"))
    told = made.select("pageId", box.cast(INFOBOX).alias("walked"), (~F.col("odd") & ~F.coalesce("deeper", F.lit(False))).alias("whole"), "json")
    told = told.select("pageId", "walked", "whole", whole_page(F.when(~F.col("whole"), F.col("json"))).alias("parsed"))  # nulls but for the others
    return told.select("pageId", F.when(F.col("whole"), F.col("walked")).otherwise(F.col("parsed.box")).alias("infobox"))


#: Parts of categories, in any case, that mark pages about the real world. A wiki's own go in ``more``.
REAL_MARKS = ("Real-world", "Out-of-universe", "Behind the scenes", "Publishing eras", "Canceled", "Hoax articles", "webcomic")
#: Fixed value: categories of a year's works.
REAL_YEARS = r"\b\d{4}\s+(articles\s+and\s+stories|releases|miscellaneous\s+releases)\b"


def realm(categories, made_up: str = "Fiction", more: tuple[str, ...] = ()):
    """Real if any category has a mark or is a list of a year's works, else the made-up realm."""
    marks = [F.lit(m.lower()) for m in (*REAL_MARKS, *more)]
    fits = lambda c: reduce(or_, [F.contains(F.lower(c), m) for m in marks], F.lower(c).rlike(REAL_YEARS))
    return F.when(F.coalesce(F.exists(categories, fits), F.lit(False)), "Real").otherwise(made_up)


def continuity(title, categories):
    """Legends by category, else by title, else Canon by category, else Unknown."""
    has = lambda word: F.coalesce(F.exists(categories, lambda c: F.contains(F.lower(c), F.lit(word))), F.lit(False))
    return F.when(has("legends"), "Legends").when(F.contains(title, F.lit("/Legends")), "Legends").when(has("canon"), "Canon").otherwise("Unknown")
