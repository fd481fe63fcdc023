"""Readers of landed files and tables: manifests, announcements, candidates, checkpoints, pages, conversations."""

from __future__ import annotations

import html
import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.values import shanghai_date

MANIFEST = "url string, title string, publisher string, published_at string, source_role string"
ANNOUNCEMENT = "secCode string, orgId string, adjunctUrl string, announcementId string, announcementTime long, announcementTitle string, secName string"
#: Fixed pattern of a disclosure's path: date and id.
PDF_PATH = r"^(?i)finalpage/(20\d\d-\d\d-\d\d)/(\d+)\.pdf$"


def read_json(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """S01."""
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def text_pages(spark: SparkSession, path: str) -> DataFrame:
    """Text files split at form feeds; a blank last page is dropped."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("doc_id"), F.split("value", "\f").alias("pages"))
    full = F.when(F.trim(F.element_at("pages", -1)) == "", F.slice("pages", F.lit(1), F.size("pages") - 1)).otherwise(F.col("pages"))
    return files.select("doc_id", F.posexplode(full).alias("i", "text")).select("doc_id", (F.col("i") + 1).alias("page"), "text")


def checked_manifest(rows: DataFrame, as_of: str) -> DataFrame:
    """Manifest rows; one bad row fails the read, as a manifest is trusted whole."""
    bad = F.lit(False)
    for c in ("url", "title", "publisher", "published_at"):
        bad = bad | F.coalesce(F.trim(c) == "", F.lit(True))
    day, dated = F.try_to_date("published_at", "yyyy-MM-dd"), F.regexp_extract(F.coalesce("url", F.lit("")), r"/(20\d\d-\d\d-\d\d)/", 1)
    bad = bad | day.isNull() | ((dated != "") & (dated != F.col("published_at"))) | (day > F.lit(as_of).cast("date"))
    url = F.when(F.coalesce(bad, F.lit(True)), F.raise_error(F.concat(F.lit("bad manifest row: "), F.coalesce("url", F.lit("?"))))).otherwise(F.col("url"))
    return rows.select(url.alias("url"), "title", "publisher", "published_at", *[c for c in ("source_role",) if c in rows.columns])


def announcement_reasons(rows: DataFrame, code: Column, org: Column, first: Column, last: Column, by: list[str] | None = None) -> DataFrame:
    """Rows with url and the first reason to reject them (null: usable); a url counts once (for each of `by`), the earliest by seq."""
    path = F.coalesce("adjunctUrl", F.lit(""))
    day = F.regexp_extract(path, PDF_PATH, 1)
    told = F.when(F.col("announcementTime").isNotNull(), shanghai_date("announcementTime"))
    reason = (
        F.when(~(F.col("secCode").eqNullSafe(code) & F.col("orgId").eqNullSafe(org)), "identity_mismatch")
        .when(~path.rlike(PDF_PATH), "unsupported_pdf_path")
        .when(~F.col("announcementId").eqNullSafe(F.regexp_extract(path, PDF_PATH, 2)), "announcement_id_mismatch")
        .when(told.isNull(), "invalid_publication_time")
        .when((told.cast("string") != day) | ~told.between(first, last), "publication_date_mismatch")
    )
    marked = rows.select("*", path.alias("url"), reason.alias("reason"))
    titled = F.coalesce(F.col("announcementTitle"), F.lit("")) != ""
    fine = F.col("reason").isNull()
    turn = F.row_number().over(Window.partitionBy(*(by or []), F.when(fine & titled, F.col("url")).otherwise(F.concat(F.lit("#"), F.col("seq").cast("string")))).orderBy("seq"))
    return marked.withColumn("reason", F.when(fine & ~titled, "missing_title").otherwise(F.col("reason"))).withColumn("n", turn).where((F.col("n") == 1) | F.col("reason").isNotNull()).drop("n")


def unique_match(rows: DataFrame, code: Column) -> DataFrame:
    """Rows of a directory; an error unless exactly one matches."""
    found = rows.where(code)
    n = found.agg(F.count(F.lit(1)).alias("n"))
    return found.join(F.broadcast(n)).withColumn("n", F.assert_true(F.col("n") == 1, F.lit("not exactly one match"))).drop("n")


def candidates(files: DataFrame, kind: str) -> DataFrame:
    """Candidates of a kind from rows (candidates array of structs); local_id falls back on candidate_id."""
    rows = files.select(F.explode("candidates").alias("c")).select("c.*").where(F.col("kind") == kind)
    return rows.withColumn("local_id", F.coalesce("local_id", "candidate_id"))


def reusable(checkpoints: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Checkpoints that answer what is wanted in full, and what is wanted without any.

    Both have model and digest; if wanted has source_ids (an array), a checkpoint must be for the same ones in the same order.
    """
    keys = ["model", "digest", *(c for c in ("source_ids",) if c in wanted.columns)]
    good = checkpoints.where("finish_reason = 'stop'").join(wanted.select(*keys), keys, "left_semi")
    return good, wanted.join(good.select(*keys), keys, "left_anti")


def complete(answers: DataFrame) -> DataFrame:
    """Fresh answers (digest, finish_reason, ...); reading them fails if one was cut off, as a graph of it would lack parts."""
    cut = F.concat(F.lit("answer was cut off, the graph would be incomplete: "), F.coalesce("digest", F.lit("?")))
    return answers.withColumn("digest", F.when(F.col("finish_reason") == "stop", F.col("digest")).otherwise(F.raise_error(cut)))


def recovered_json(x: Column) -> Column:
    """The JSON text in an answer: without fences, else its outermost object; null if neither parses."""
    bare = F.trim(F.regexp_replace(x, r"(?s)^\s*```[a-zA-Z]*\s*|\s*```\s*$", ""))
    outer = F.regexp_extract(x, r"(?s)\{.*\}", 0)
    return F.when(F.try_parse_json(bare).isNotNull(), bare).when(F.try_parse_json(outer).isNotNull(), outer)


def search_hits(rows: DataFrame) -> DataFrame:
    """Landed web-search hits (query, place, url or link, title, ...): one url column; hits without any go."""
    has = [F.nullif(F.trim(c), F.lit("")) for c in ("url", "link") if c in rows.columns]
    return rows.withColumn("url", F.coalesce(*has, F.lit(None).cast("string"))).drop("link").where("url is not null")


# Elements whose text is hidden, elements that begin a line, properties that date a page.
HIDDEN = "script style nav footer".split()
LINE_STARTS = "p div h1 h2 h3 li tr br".split()
DATED_BY = ("article:published_time", "article:modified_time")
_PIECE = re.compile(r"(?is)<!--.*?(?:-->|\Z)|<(script|style)\b[^>]*>.*?(?:</\1\s*>|\Z)|<(?P<end>/?)(?P<tag>[a-z][\w:-]*)(?P<rest>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>|(?P<text>[^<]+|<)")
_VALUE = re.compile(r"""(?i)\b(property|content|datetime)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""")


def readable(page: str) -> tuple[str, str | None]:
    """The lines of a page without hidden subtrees, and the earliest valid day among those it is dated by."""
    out, days, hidden = [], [], 0
    for m in _PIECE.finditer(page):
        tag = (m["tag"] or "").lower()
        if m["text"] is not None:
            out.append("" if hidden else html.unescape(m["text"]))
        elif tag in HIDDEN:
            hidden = max(0, hidden + (-1 if m["end"] else 1))
        elif tag in LINE_STARTS and not m["end"]:
            out.append("\n")
        if tag in ("meta", "time"):
            has = {k.lower(): "".join(v) for k, *v in _VALUE.findall(m["rest"])}
            days.append(has.get("datetime" if tag == "time" else "content" if has.get("property") in DATED_BY else "", "")[:10])
    lines = filter(None, (" ".join(line.split()) for line in "".join(out).split("\n")))
    return "\n".join(lines), min((d for d in days if re.fullmatch(r"\d{4}-\d\d-\d\d", d)), default=None)


def page_text(pages: DataFrame) -> DataFrame:
    """page_id, text and published (the earliest valid date) of pages (page_id, html)."""

    def read(frames):
        for pdf in frames:
            texts, days = zip(*map(readable, pdf.html.fillna("")), strict=True) if len(pdf) else ((), ())
            yield pd.DataFrame({"page_id": pdf.page_id, "text": texts, "published": days})

    return pages.select("page_id", "html").mapInPandas(read, "page_id long, text string, published string")


#: Fixed form of the line that stands for an image.
IMAGE_LINE = "[Image attachment: {}]"


def _part(part) -> str:
    match part:
        case str():
            return part
        case {"text": str(text)}:
            return text
        case {"content_type": "image_asset_pointer"}:
            return IMAGE_LINE.format(part.get("asset_pointer", "attachment"))
    return ""


def content_text(content) -> str:
    """A plain string, {text}, or {parts}, whose strings, texts and image pointers stand apart by a blank line."""
    match content:
        case str():
            return content
        case {"parts": list(parts)}:
            return "\n\n".join(filter(None, map(_part, parts))).strip()
        case {"text": str(text)}:
            return text
    return ""


#: Negative references of a flattened array that stand for values: fixed.
SENTINELS = {-1: None, -2: None, -3: float("nan"), -4: float("inf"), -5: None, -6: -0.0}


def hydrate(flat: list) -> list:
    """The values at all places of a flattened array whose numbers refer to places; shared and cyclic ones stay shared.

    Containers are made empty first and then filled, so that no reference is followed twice and none too early.
    """
    made = [type(x)() if isinstance(x, (list, dict)) else x for x in flat]

    def at(i):
        if isinstance(i, bool) or not isinstance(i, int) or i >= len(made):
            return i
        return SENTINELS.get(i) if i < 0 else made[i]

    for x, source in zip(made, flat, strict=True):
        if isinstance(source, list):
            x.extend(map(at, source))
        elif isinstance(source, dict):
            x.update((str(made[int(k[1:])]) if re.fullmatch(r"_\d+", k) and int(k[1:]) < len(made) else k, at(j)) for k, j in source.items())
    return made


def conversation(root) -> list:
    """The turns of the first dict that holds a linear conversation, depth first from the root; none if there is no such dict."""
    todo, seen = [root], set()
    while todo:
        x = todo.pop()
        if not isinstance(x, (dict, list)) or id(x) in seen:
            continue
        seen.add(id(x))
        if isinstance(x, dict) and isinstance(x.get("linear_conversation"), list):
            return x["linear_conversation"]
        todo.extend(reversed(list(x.values()) if isinstance(x, dict) else x))
    return []


def shared_messages(pages: DataFrame) -> DataFrame:
    """page_id, place, id, role, create_time, text of the messages in shared conversation pages (page_id, html).

    A page's flattened array is read from its first value, the root.
    """
    chunk = re.compile(r'enqueue\("((?:[^"\\]|\\.)*)"\)')

    def messages(page: str):
        for m in chunk.finditer(page or ""):
            try:
                flat = json.loads(json.loads(f'"{m[1]}"'))
            except ValueError:
                continue
            if isinstance(flat, list) and flat:
                for node in conversation(hydrate(flat)[0]):
                    match node:
                        case {"message": dict(msg)} if text := content_text(msg.get("content")):
                            author = msg.get("author")
                            yield msg.get("id") or node.get("id"), author.get("role", "unknown") if isinstance(author, dict) else "unknown", msg.get("create_time"), text
                return

    def read(frames):
        for pdf in frames:
            rows = [(i, n, *m) for i, page in zip(pdf.page_id, pdf.html, strict=True) for n, m in enumerate(messages(page))]
            yield pd.DataFrame(rows, columns=["page_id", "place", "id", "role", "create_time", "text"])

    return pages.select("page_id", "html").mapInPandas(read, "page_id long, place long, id string, role string, create_time double, text string")
