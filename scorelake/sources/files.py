"""Sources of cases: files, text, JDBC, HTTP, generators; each a lazy DataFrame with a map column input_item."""

from __future__ import annotations

import json
import re
import zipfile
from collections.abc import Callable, Iterator
from datetime import datetime, timedelta
from io import BytesIO
from itertools import count, islice
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from scorelake.functions.http import request
from scorelake.model import jdbc_connection, scratch
from scorelake.operators.rows import filter_all, reindexed, shuffled, sliced


def as_items(df: DataFrame) -> DataFrame:
    """All columns as strings in the map input_item; order_key keeps the source's order."""
    pairs = [x for c in df.columns for x in (F.lit(c), F.col(f"`{c}`").cast("string"))]
    item = F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")
    return df.select(F.monotonically_increasing_id().alias("order_key"), item.alias("input_item"))


def load(source: DataFrame, predicates: list[Column] | None = None, offset: int = 0, limit: int = -1, shuffle_seed: int | None = None) -> DataFrame:
    """shuffle, filter, slice, index from 0: items (data_index, input_item, extra). Raises if there are none at all."""
    if source.isEmpty():
        raise ValueError("the source is empty")
    rows = shuffled(source.drop("order_key") if "order_key" in source.columns else source, shuffle_seed) if shuffle_seed is not None else source
    rows = sliced(filter_all(rows, predicates or []), ["order_key"], offset, limit)
    rows = reindexed(rows, ["order_key"]).drop("order_key")
    return rows.select("data_index", "input_item", F.create_map().cast("map<string,string>").alias("extra"))


def csv(spark: SparkSession, path: str, delimiter: str = ",", header: bool = True) -> DataFrame:
    """All cells are strings, missing ones empty; without a header columns are named 0, 1, ..."""
    df = spark.read.option("header", header).option("sep", delimiter).option("multiLine", True).option("escape", '"').option("mode", "PERMISSIVE").csv(resolved(spark, path))
    if not df.columns:
        raise ValueError(f"empty file: {path}")
    names = df.columns if header else [str(k) for k in range(len(df.columns))]
    return as_items(df.select(*(F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(n) for c, n in zip(df.columns, names, strict=True))))


def _json_rows(texts: DataFrame, path: str) -> DataFrame:
    """A row per element of the list at the path, or one for an object; the root must be an object."""
    root = F.when(F.trim("value").startswith("{"), F.col("value")).otherwise(F.raise_error(F.lit("the JSON text must be an object")))
    found = F.trim(F.get_json_object(root, path)) if path != "$" else F.trim(root)
    # an element's values as strings: those of strings as they are, others as JSON
    one = F.when(found.startswith("["), F.from_json(found, "array<map<string,string>>")).when(found.startswith("{"), F.array(F.from_json(found, "map<string,string>")))
    rows = one.isNotNull()
    items = F.when(rows, one).otherwise(F.raise_error(F.concat(F.lit(f"neither a list nor an object at {path}: "), F.coalesce(found, F.lit("nothing")))))
    return texts.select(F.posexplode(items).alias("order_key", "input_item")).select(F.col("order_key").cast("bigint"), "input_item")


def json_file(spark: SparkSession, path: str, json_path: str = "$") -> DataFrame:
    return _json_rows(spark.read.text(resolved(spark, path), wholetext=True), json_path)


def json_text(spark: SparkSession, text: str, json_path: str = "$") -> DataFrame:
    return _json_rows(spark.createDataFrame([(text,)], "value string"), json_path)


def json_lines(spark: SparkSession, path: str) -> DataFrame:
    """A row per line: the form for large inputs, which can be split."""
    rows = spark.read.text(resolved(spark, path)).select(F.from_json("value", "map<string,string>").alias("input_item"))
    return rows.select(F.monotonically_increasing_id().alias("order_key"), "input_item")


def jdbc(spark: SparkSession, url: str, sql: str, driver: str | None = None, **options: str) -> DataFrame:
    """A row per row of the query; add partitionColumn, lowerBound, upperBound and numPartitions with dbtable to read in parallel."""
    reader = spark.read.format("jdbc").option("url", url)
    reader = reader.options(**options) if "dbtable" in options else reader.option("query", sql).options(**options)
    return as_items((reader.option("driver", driver) if driver else reader).load())


def jdbc_by_driver(spark: SparkSession, url: str, sql: str, batch: int = 1000, **properties: str) -> DataFrame:
    """A row per row of the query to a database that only the driver reaches, as one embedded in its process: read by the
    driver a batch at a time into a file that all executors share. Values are strings as the database gives them."""
    path = scratch(spark, "rows") + "/rows.json"
    target, connection = spark._jvm.org.apache.hadoop.fs.Path(path), jdbc_connection(spark, url, properties)
    out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target, True)
    try:
        rows = connection.createStatement().executeQuery(sql)
        about = rows.getMetaData()
        names = [about.getColumnLabel(k) for k in range(1, about.getColumnCount() + 1)]

        def lines() -> Iterator[str]:
            for n in count():
                if not rows.next():
                    return
                yield json.dumps({"order_key": n, "input_item": {name: rows.getString(k) for k, name in enumerate(names, 1)}}) + "\n"

        left = lines()
        while some := "".join(islice(left, batch)):
            out.write(bytearray(some.encode()))
    finally:
        out.close()
        connection.close()
    return spark.read.schema("order_key bigint, input_item map<string,string>").json(path)


def http_json(url: str, method: str = "GET", params: dict | None = None, headers: dict | None = None, body: object = None, timeout: float = 120, encoding: str = "json", connect_timeout: float = 10) -> str:
    """Text of an answer; certificates are verified, a status from 400 on is an error."""
    answer = request(url, method, params, headers, body, encoding, connect_timeout, timeout)
    if answer.status >= 400:
        raise OSError(f"status {answer.status} from {url}")
    return answer.text


def fetched(spark: SparkSession, url: str, **call) -> str:
    """A file behind http(s):// as a path that Spark can read: fetched once by the driver, sent to all executors."""
    data = request(url, **call)
    if data.status >= 400:
        raise OSError(f"status {data.status} from {url}")
    name = url.split("?")[0].rstrip("/").rpartition("/")[2] or "file"
    path = scratch(spark, "fetched") + "/" + name
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target, True)
    try:
        out.write(bytearray(data.data))
    finally:
        out.close()
    return path


def resolved(spark: SparkSession, path: str) -> str:
    """A path of any of Spark's file systems as it is; a URL fetched."""
    return fetched(spark, path) if path.startswith(("http://", "https://")) else path


def api(spark: SparkSession, url: str, json_path: str = "$", transport: Callable[..., str] = http_json, **call) -> DataFrame:
    """Rows at the path of one HTTP answer."""
    return json_text(spark, transport(url, **call), json_path)


# --- spreadsheets ------------------------------------------------------------------------

_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def _column(ref: str) -> int:
    n = 0
    for c in re.match("[A-Z]+", ref)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


#: Numbers of the format's own date and time formats.
_DATE_FORMATS = {*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)}
_ESCAPED = re.compile("_x([0-9A-Fa-f]{4})_")


def _plain(text: str) -> str:
    return _ESCAPED.sub(lambda m: chr(int(m[1], 16)), text) if "_x" in text else text


def _date_styles(z: zipfile.ZipFile) -> dict[int, tuple[bool, bool]]:
    """Styles of dates and times by number: whether they show a date, and a time."""
    if "xl/styles.xml" not in z.namelist():
        return {}
    root = ElementTree.fromstring(z.read("xl/styles.xml"))
    codes = {int(f.get("numFmtId")): f.get("formatCode", "") for f in root.iter(f"{{{_NS['m']}}}numFmt")}
    out = {}
    for k, x in enumerate(root.findall("m:cellXfs/m:xf", _NS)):
        number = int(x.get("numFmtId") or 0)
        if number in codes:
            # letters outside of quotes and brackets; elapsed times are in brackets
            code = re.sub(r'"[^"]*"|\\.|\[[^\]hms]*\]|_.|\*.', "", codes[number].split(";")[0]).lower()
            if code.strip() == "general":
                continue
            date, time = bool(re.search("[yd]", code)) or ("m" in code and not re.search("[hs]", code)), bool(re.search("[hs]", code))
        else:
            date, time = number in _DATE_FORMATS and not 18 <= number <= 21 and not 45 <= number <= 47, number in (18, 19, 20, 21, 22, 45, 46, 47)
        if date or time:
            out[k] = date, time
    return out


def _date_text(number: float, date: bool, time: bool, base: datetime) -> str:
    """A day number as text: the date, the time, or both where the format shows both or the number has a part of a day."""
    whole = base + timedelta(seconds=round(number * 86_400))
    if time and not date:
        return whole.strftime("%H:%M:%S")
    return whole.strftime("%Y-%m-%d" if not time and number == int(number) else "%Y-%m-%d %H:%M:%S")


def read_xlsx(data: bytes, sheet: int | None = 0) -> Iterator[list[str]]:
    """Rows of a sheet by number, or of all sheets one after the other for None; read as a stream of events.

    Cells are text: whole numbers without a fraction, formulas by their value, dates and times as YYYY-MM-DD and HH:MM:SS.
    """
    main = f"{{{_NS['m']}}}"
    with zipfile.ZipFile(BytesIO(data)) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            for _, x in ElementTree.iterparse(z.open("xl/sharedStrings.xml")):
                if x.tag == f"{main}si":
                    shared.append("".join(t.text or "" for t in x.iter(f"{main}t")))
                    x.clear()
        book, links = ElementTree.fromstring(z.read("xl/workbook.xml")), ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))
        settings = book.find("m:workbookPr", _NS)
        # days count from 1899-12-30, for the format takes 1900 for a leap year, or from 1904
        base = datetime(1904, 1, 1) if settings is not None and settings.get("date1904") in ("1", "true") else datetime(1899, 12, 30)
        targets, dates = {x.get("Id"): x.get("Target") for x in links}, _date_styles(z)
        sheets = [*book.find("m:sheets", _NS)]
        for one in sheets if sheet is None else [sheets[sheet]]:
            target = targets[one.get(_REL)]
            parent = None
            for event, row in ElementTree.iterparse(z.open(target.lstrip("/") if target.startswith("/") else f"xl/{target}"), ("start", "end")):
                if row.tag == f"{main}sheetData" and event == "start":
                    parent = row
                if row.tag != f"{main}row" or event == "start":
                    continue
                yield [*_cells(row, shared, dates, base)]
                parent.clear()


def _cells(row, shared: list[str], dates: dict[int, tuple[bool, bool]], base: datetime) -> list[str]:
    cells: list[str] = []
    for k, c in enumerate(row):
        at = _column(c.get("r")) if c.get("r") else k
        v, kind = c.find("m:v", _NS), c.get("t")
        if kind == "inlineStr":
            value = _plain("".join(t.text or "" for t in c.iter(f"{{{_NS['m']}}}t")))
        elif v is None or v.text is None:
            value = ""
        elif kind == "s":
            value = _plain(shared[int(v.text)])
        elif kind == "b":
            value = "true" if v.text == "1" else "false"
        elif kind in ("str", "e", "d"):
            value = _plain(v.text)
        else:
            number, style = float(v.text), int(c.get("s") or 0)
            value = _date_text(number, *dates[style], base) if style in dates and 0 <= number < 2_958_466 else str(int(number)) if number.is_integer() else repr(number)
        cells += [""] * (at + 1 - len(cells))
        cells[at] = value
    return cells


#: Rows of spreadsheets that a task hands over at a time.
SHEET_BATCH = 2000


def sheet_rows(books: DataFrame, sheet: int | None = 0) -> DataFrame:
    """Cases (order_key, input_item) of spreadsheets in rows (book, content), in the order of book, a bigint below 2^39; read by executors.

    The first row of each sheet names the columns; those with a blank name and rows without text are left out. With sheet None
    all sheets count. A task holds a book and some of its rows, and a book has 1,048,576 rows to a sheet at most.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for book, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                # a sheet at a time, for each has names of its own
                data, nth = content.as_py(), 0
                for k in range(_sheets(data)) if sheet is None else [sheet]:
                    lines = read_xlsx(data, k)
                    names = [(j, n) for j, n in enumerate(next(lines, [])) if n.strip()]
                    while some := list(islice(lines, SHEET_BATCH)):
                        items = [{n: r[j] if j < len(r) else "" for j, n in names} for r in some if any(r)]
                        keys = range(nth, nth + len(items))
                        nth += len(items)
                        yield pa.RecordBatch.from_arrays([pa.array([(book << 24) + x for x in keys], pa.int64()), pa.array([[*x.items()] for x in items], pa.map_(pa.string(), pa.string()))], ["order_key", "input_item"])

    return books.select(F.col("book").cast("bigint"), "content").mapInArrow(read, "order_key bigint, input_item map<string,string>")


def _sheets(data: bytes) -> int:
    with zipfile.ZipFile(BytesIO(data)) as z:
        return len(ElementTree.fromstring(z.read("xl/workbook.xml")).find("m:sheets", _NS))


def xlsx(spark: SparkSession, path: str, sheet: int | None = 0) -> DataFrame:
    """Rows of one sheet, or of all for None; see sheet_rows. Files are read as binary by Spark, from any of its file systems, and parsed on executors."""
    found = spark.read.format("binaryFile").load(resolved(spark, path))
    # files in the order of their paths: a row for each file, without its content
    order = reindexed(found.select("path"), ["path"], "book")
    return sheet_rows(found.select("path", "content").join(F.broadcast(order), "path"), sheet)


class PagedSource(DataSource):
    """Spark data source over a function of pages: option pages gives their number; each is read by a task.

    Subclasses implement fetch(page, options), which gives dicts of strings.
    """

    @classmethod
    def name(cls) -> str:
        return "scorelake_pages"

    def schema(self) -> str:
        return "order_key bigint, input_item map<string,string>"

    def fetch(self, page: int, options: dict) -> list[dict[str, str]]:
        text = http_json(options["url"], params={options.get("page_param", "page"): page})
        return [{k: v if isinstance(v, str) else json.dumps(v) for k, v in row.items()} for row in json.loads(text)]

    def reader(self, schema: StructType) -> DataSourceReader:
        source, options = self, dict(self.options)

        class Reader(DataSourceReader):
            def partitions(self) -> list[InputPartition]:
                return [InputPartition(k) for k in range(int(options.get("pages", "1")))]

            def read(self, partition: InputPartition):
                for k, row in enumerate(source.fetch(partition.value, options)):
                    yield (partition.value << 32 | k, row)

        return Reader()


# --- generators --------------------------------------------------------------------------


def generated(spark: SparkSession, count: int, columns: dict[str, Column]) -> DataFrame:
    """count rows made by expressions over id; null values become empty."""
    pairs = [x for k, c in columns.items() for x in (F.lit(k), F.coalesce(c.cast("string"), F.lit("")))]
    return spark.range(count).select(F.col("id").alias("order_key"), F.create_map(*pairs).alias("input_item"))


def with_context(rounds: DataFrame, session: str = "sessionId", order: str = "round", query: str = "query") -> DataFrame:
    """contextDependency: numbered queries of the rounds before, a line each; empty in the first round."""
    from pyspark.sql import Window

    before = Window.partitionBy(session).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    line = F.concat(F.col(order).cast("string"), F.lit(": "), F.col(query), F.lit("\n"))
    return rounds.withColumn("contextDependency", F.array_join(F.collect_list(line).over(before), ""))


def sessions(spark: SparkSession, count: int, rounds: int, random_rounds: bool = False, seed: int = 0, query: Column | None = None, **columns: Column) -> DataFrame:
    """Generated sessions: sessionId, round from 1, query, groundTruth, intent, contextDependency, extra.

    With random_rounds a session has 1 to ``rounds`` rounds. Ids depend on the seed only.
    """
    from scorelake.functions.text import uuid3

    n = F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(rounds)) + 1 if random_rounds else F.lit(rounds).cast("bigint")
    rows = spark.range(count).select(uuid3(F.concat_ws("-", F.lit(str(seed)), F.col("id").cast("string"))).alias("sessionId"), F.explode(F.sequence(F.lit(1), n.cast("int"))).alias("round"))
    text = query if query is not None else F.concat(F.lit("query "), F.col("round").cast("string"))
    rows = rows.select("*", text.alias("query"), *(columns.get(c, F.lit("")).alias(c) for c in ("groundTruth", "intent", "extra")))
    return with_context(rows).select("sessionId", "round", "query", "groundTruth", "intent", "contextDependency", "extra")


def from_template(spark: SparkSession, template: str, count: int, seed: int = 0, engine=None) -> DataFrame:
    """count texts of one template with mock rules."""
    from scorelake.operators.mock import Engine, mock_text

    return generated(spark, count, {"query": mock_text(F.lit(template), F.col("id"), seed, engine or Engine)})


def from_replies(replies: DataFrame, name: str = "query") -> DataFrame:
    """A case per line of a model's replies (reply) that isn't blank."""
    from scorelake.operators.external import reply_lines

    return as_items(replies.select(F.explode(reply_lines(F.col("reply"))).alias(name)))


def saved_report(spark: SparkSession, path: str, offset: int = 0, limit: int = -1, keep_verdicts: bool = True) -> DataFrame:
    """Cases of a saved JSON report {dataItems: [...]}: columns as JSON text, paged by offset and limit."""
    rows = json_file(spark, path, "$.dataItems")
    rows = rows.orderBy("order_key").offset(offset)
    rows = rows.limit(limit) if limit >= 0 else rows
    return rows if keep_verdicts else rows.withColumn("input_item", F.map_filter("input_item", lambda k, v: k != "evalResult"))
