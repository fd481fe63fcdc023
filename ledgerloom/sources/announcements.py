"""Announcement searches: landed pages of responses as a Python Data Source, and the checks that hold across pages.

A landed file has a line of JSON for each page that was fetched: the request's form and the response's body. Every file is a
partition, read with pyarrow's file systems, so it may be in any store that those know; nothing of a page is held but its
line. What a page alone can't tell (a total that changed, a page that is missing, where the search ends) is one window over
a search's pages.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from datetime import date
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .landed import announcement_reasons

#: Fixed values of the service: hits of a page, categories, base address, forms of a security's code.
PAGE_SIZE = 30
#: Pages that a worker turns into a batch at once: Spark itself would gather 10,000 rows of Python objects.
BATCH = 128
CATEGORIES = {
    "annual_report": "category_ndbg_szsh",
    "half_year_report": "category_bndbg_szsh",
    "first_quarter_report": "category_yjdbg_szsh",
    "third_quarter_report": "category_sjdbg_szsh",
    "earnings_forecast": "category_yjygjxz_szsh",
    "daily_operations": "category_rcjy_szsh",
    "governance": "category_gszl_szsh",
    "risk_notice": "category_fxts_szsh",
    "correction": "category_bcgz_szsh",
}
DOCUMENT_BASE = "https://static.cninfo.com.cn/"
PUBLISHER, DATE_BASIS, ROLE = "巨潮资讯网（公司原始披露）", "cninfo_api_announcementTime_and_pdf_path", "issuer_disclosure"
CODE = re.compile(r"(?i)\d{6}(\.(SH|SZ|BJ))?")

_HIT = {"secCode": "string", "orgId": "string", "adjunctUrl": "string", "announcementId": "string", "announcementTime": "long", "announcementTitle": "string", "secName": "string"}
SCHEMA = f"search string, code string, org string, first string, last string, page int, total long, hits array<struct<{','.join(f'{c}:{t}' for c, t in _HIT.items())}>>, problem string"
#: Problems of one page, and of a search.
NO_OBJECT, NO_TOTAL, BAD_SHAPE = "response is no object", "total is missing or invalid", "announcements have an unexpected shape"
CHANGED, MISSING = "total changed between pages", "page was not landed"


def request(ticker: str, org: str, first: str, last: str, page: int, keyword: str = "", category: str = "", max_pages: int = 3) -> dict:
    """The form of one page's request; an error for a search that must not be made."""
    if not CODE.fullmatch(ticker):
        raise ValueError("a search needs a security's six-digit code")
    if not isinstance(keyword, str) or len(keyword) > 100:
        raise ValueError("a keyword has 100 characters at most")
    if category and category not in CATEGORIES:
        raise ValueError(f"unknown category: {category}")
    if date.fromisoformat(first) > date.fromisoformat(last) or not 1 <= page <= max_pages:
        raise ValueError("the window is empty or the page is beyond the limit")
    return {"pageNum": str(page), "pageSize": str(PAGE_SIZE), "stock": f"{ticker[:6]},{org}", "searchkey": keyword, "category": CATEGORIES.get(category, ""), "seDate": f"{first}~{last}"}


def _text(x) -> str | None:
    return None if x is None else str(x)


def _time(x) -> int | None:
    return int(x) if isinstance(x, (int, float)) and not isinstance(x, bool) and abs(x) < 1 << 53 else None


def _hit(x) -> tuple:
    """A hit's fields as the checks read them; what is no object has none."""
    x = x if isinstance(x, dict) else {}
    return tuple(_time(x.get(c)) if t == "long" else _text(x.get(c)) for c, t in _HIT.items())


def page_row(line: str) -> tuple:
    """SCHEMA's row of one landed line. The search is told apart by the form without its page number."""
    landed = json.loads(line)
    form, body = landed["request"], landed.get("response")
    code, _, org = form["stock"].partition(",")
    first, _, last = form["seDate"].partition("~")
    search = json.dumps({k: v for k, v in form.items() if k != "pageNum"}, sort_keys=True, ensure_ascii=False)
    head = (search, code, org, first, last, int(form["pageNum"]))
    if not isinstance(body, dict):
        return (*head, None, None, NO_OBJECT)
    try:
        total = int(body["totalAnnouncement"])
    except (KeyError, TypeError, ValueError):
        return (*head, None, None, NO_TOTAL)
    hits = body.get("announcements")
    hits = [] if hits is None and total == 0 else hits
    if not isinstance(hits, list) or total < 0:
        return (*head, total, None, BAD_SHAPE)
    return (*head, total, [_hit(x) for x in hits], None)


class File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class PageReader(DataSourceReader):
    def __init__(self, path: str, schema: StructType):
        self.path, self.schema = path, to_arrow_schema(schema)

    def partitions(self) -> list[File]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(self.path)
        found = store.get_file_info(fs.FileSelector(root, recursive=True))
        return [File(f.path) for f in found if f.is_file and not f.base_name.startswith(("_", "."))]

    def read(self, partition: File) -> Iterator[pa.RecordBatch]:
        rows = self._rows(partition)
        while some := list(islice(rows, BATCH)):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*some, strict=True), self.schema, strict=True)], schema=self.schema)

    def _rows(self, partition: File) -> Iterator[tuple]:
        from pyarrow import fs

        store, _ = fs.FileSystem.from_uri(self.path)
        with store.open_input_stream(partition.path, compression="detect") as stream:
            rest = b""
            while block := stream.read(1 << 20):
                *lines, rest = (rest + block).split(b"\n")
                yield from (page_row(x.decode()) for x in lines if x.strip())
            if rest.strip():
                yield page_row(rest.decode())


class LandedPages(DataSource):
    """spark.read.format("landed_announcements").load(folder): a row for each landed page, SCHEMA its columns."""

    @classmethod
    def name(cls) -> str:
        return "landed_announcements"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> PageReader:
        path = self.options.get("path")
        if not path:
            raise ValueError("landed_announcements needs a path")
        return PageReader(path if "://" in path else path.replace("file:", "", 1) if path.startswith("file:") else path, schema)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """The landed pages below a folder."""
    spark.dataSource.register(LandedPages)
    return spark.read.format("landed_announcements").load(path)


def scan(pages: DataFrame, max_pages: int = 3) -> tuple[DataFrame, DataFrame]:
    """Pages (SCHEMA) as what searches find: (searches, hits).

    A search reads its pages in order up to max_pages, and ends at the first that is full to the total or has no hits;
    pages landed beyond that aren't read, of a page landed twice the first row counts. searches: search, total_hits,
    pages_read, truncated (there is more than was read) and error, the first that a page read gives: its own problem, a
    page that is missing, a total other than the first page's. hits: search, page, place, the hit's fields, url, and reason,
    the first to reject it (null: usable); a usable url counts once in a search. A search with an error has no hits. The
    pages of one search are one group: PAGE_SIZE hits each and max_pages of them at most once they are limited.
    """
    if max_pages < 1:
        raise ValueError("a scan reads a page at least")
    by = Window.partitionBy("search").orderBy("page")
    own = pages.where(F.col("page") <= max_pages).dropDuplicates(["search", "page"])
    total = F.first("total").over(by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    ends = (F.col("page") * PAGE_SIZE >= F.col("stated")) | (F.size("hits") == 0)
    before = F.max(F.coalesce(ends, F.lit(False))).over(by.rowsBetween(Window.unboundedPreceding, -1))
    marked = own.withColumn("stated", total).withColumn("n", F.row_number().over(by)).withColumn("over", F.coalesce(before, F.lit(False))).where("not over")
    error = F.when(F.col("page") != F.col("n"), F.lit(MISSING)).when(F.col("problem").isNotNull(), F.col("problem")).when(~F.col("total").eqNullSafe(F.col("stated")), F.lit(CHANGED))
    read = marked.withColumn("error", error).withColumn("ends", F.coalesce(ends, F.lit(False)))
    last = F.max_by(F.struct("page", "ends"), "page").alias("last")
    per = read.groupBy("search").agg(F.min_by("error", F.when(F.col("error").isNotNull(), F.col("page"))).alias("error"), F.first("stated").alias("total_hits"), F.count(F.lit(1)).alias("pages_read"), last)
    short = ~F.col("last.ends") & (F.col("last.page") < max_pages)  # the next page was wanted, and none is there
    searches = per.select("search", F.coalesce("error", F.when(short, F.lit(MISSING))).alias("error"), "total_hits", "pages_read")
    fine = F.col("error").isNull()
    searches = searches.select("search", F.when(fine, F.col("total_hits")).alias("total_hits"), F.when(fine, F.col("pages_read")).alias("pages_read"), F.when(fine, F.col("pages_read") * PAGE_SIZE < F.col("total_hits")).alias("truncated"), "error")

    good = read.join(searches.where(fine).select("search"), "search", "left_semi")
    rows = good.select("search", "code", "org", F.try_to_date("first").alias("first"), F.try_to_date("last").alias("last"), "page", F.posexplode("hits").alias("place", "hit"))
    rows = rows.select("search", "code", "org", "first", "last", "page", "place", (F.col("page") * PAGE_SIZE + F.col("place")).alias("seq"), "hit.*")
    found = announcement_reasons(rows, F.col("code"), F.col("org"), F.col("first"), F.col("last"), by=["search"])
    return searches, found


def strict(searches: DataFrame) -> DataFrame:
    """The same searches; reading them fails at the first one with an error."""
    told = F.concat(F.lit("search failed: "), F.col("error"), F.lit(" in "), F.col("search"))
    return searches.withColumn("search", F.when(F.col("error").isNull(), F.col("search")).otherwise(F.raise_error(told)))


def sources(found: DataFrame) -> DataFrame:
    """Manifest rows of the usable hits."""
    day = F.regexp_extract("adjunctUrl", r"(20\d\d-\d\d-\d\d)", 1)
    fixed = lambda v, c: F.lit(v).alias(c)
    return found.where("reason is null").select("search", F.concat(F.lit(DOCUMENT_BASE), "adjunctUrl").alias("url"), F.col("announcementTitle").alias("title"), fixed(PUBLISHER, "publisher"), F.col("code").alias("security_code"), F.coalesce("secName", F.lit("")).alias("security_name"), F.col("org").alias("organization_id"), day.alias("published_at"), fixed(DATE_BASIS, "date_basis"), fixed(ROLE, "source_role"), F.col("announcementId").alias("announcement_id"))


def unusable(found: DataFrame) -> DataFrame:
    """search, reason and n of the rejected hits."""
    return found.where("reason is not null").groupBy("search", "reason").agg(F.count(F.lit(1)).alias("n"))


def landed_line(form: Column, body: Column) -> Column:
    """The line that lands for a page, from the JSON of its request and of its response (null: none came)."""
    return F.concat(F.lit('{"request":'), form, F.lit(',"response":'), F.coalesce(body, F.lit("null")), F.lit("}"))
