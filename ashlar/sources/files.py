"""File sources and sinks: JSON lines, chat logs, images, page documents."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

#: The loader of pages that reads text files.
LOADER = "ashlar.sources.files:text_page"

INDEX_SCHEMA = (
    "id string, namespace string, text string, source_pdf string, vehicle_model string, doc_type string, page int, section string, chunk_type string, "
    "image_paths array<string>, image_titles array<string>, char_count int"
)


def read_jsonl(spark: SparkSession, paths: list[str], schema: str = INDEX_SCHEMA, root: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Records and rejected lines (with their file) of JSON-lines files; repeated paths count once."""
    reader = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jsonl")
    lines = reader.text(list(dict.fromkeys([*paths, *([root] if root else [])]))).select(F.col("_metadata.file_path").alias("file"), "value").where("trim(value) <> ''")
    parsed = lines.select("file", "value", F.from_json("value", f"{schema}, _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}).alias("r"))
    good = parsed.where("r._corrupt is null").select("r.*").drop("_corrupt")
    return good, parsed.where("r._corrupt is not null").select("file", "value")


def write_jsonl(records: DataFrame, path: str) -> None:
    """One JSON object a line; missing fields are omitted."""
    records.write.mode("overwrite").option("ignoreNullFields", "true").json(path)


def read_chat_logs(spark: SparkSession, path: str, last: int | None = None) -> DataFrame:
    """file, turn, question and answer of text logs whose blocks are divided by lines of ``═``."""
    files = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    blocks = files.select("file", F.posexplode(F.split("value", r"(?m)^═+\s*$")).alias("turn", "block"))
    pairs = blocks.select("file", "turn", F.trim(F.regexp_extract("block", r"(?s)Q:\s*(.*?)\s*\n\s*A:", 1)).alias("question"), F.trim(F.regexp_replace(F.regexp_extract("block", r"(?s)\n\s*A:\s*(.*)$", 1), r"\s+$", "")).alias("answer")).where("question <> ''")
    if last is None:
        return pairs
    return pairs.selectExpr("*", "row_number() over (partition by file order by turn desc) as _n").where(F.col("_n") <= last).drop("_n")


def append_chat_log(turns: DataFrame, path: str) -> None:
    """Appends (user, question, answer) turns as blocks of text that ``read_chat_logs`` reads, one folder for each user."""
    block = F.concat(F.lit("Q: "), "question", F.lit("\n\nA: "), "answer", F.lit("\n" + "═" * 40))
    turns.select("user", block.alias("value")).write.mode("append").partitionBy("user").text(path)


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """path, length and content of the images below a folder; content is read only where it is used."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.where(F.lower("path").rlike(r"\.(?:png|jpe?g|gif|webp|bmp)$")).select("path", "length", "content")


def resumable(pages: DataFrame, written: DataFrame | None) -> DataFrame:
    """Pages that are not written yet."""
    return pages if written is None else pages.join(written.select("source", "page").distinct(), ["source", "page"], "left_anti")


class PageRange(InputPartition):
    def __init__(self, path: str, first: int, last: int):
        self.path, self.first, self.last = path, first, last


def ranges(path: str, first: int, last: int, step: int) -> list[PageRange]:
    """Pages of a document, cut at multiples of ``step``."""
    return [PageRange(path, max(first, a), min(a + step, last)) for a in range(first // step * step, last, step)]


def read_pages(part: PageRange, loader: str):
    """A row for each page of a range; a page that fails gives a stub."""
    from importlib import import_module

    module, name = loader.split(":")
    load = getattr(import_module(module), name)
    for page in range(part.first, part.last):
        try:
            method, text = load(part.path, page)
        except Exception:  # one bad page must not stop the document  # noqa: BLE001
            method, text = "error", ""
        yield part.path, page + 1, method, len(text), text


class PageReader(DataSourceReader):
    """Reads ranges of a document's pages by a loader ``f(path, page) -> (method, text)``."""

    def __init__(self, options: dict[str, str]):
        self.path, self.pages, self.step = options["path"], int(options["pages"]), int(options.get("pagesPerTask", "16"))
        self.loader = options.get("loader", LOADER)

    def partitions(self) -> list[PageRange]:
        return ranges(self.path, 0, self.pages, self.step)

    def read(self, partition: PageRange):
        return read_pages(partition, self.loader)


class PageStreamReader(DataSourceStreamReader):
    """Reads the pages of documents as a list of them grows.

    The list is a text file, in a folder that driver and executors share, with a line
    ``path<tab>pages`` for each document; it is only ever added to, and a line counts
    once it has ended. An offset is a number of pages in the list's order, so that
    what the checkpoint says was read stays read, whatever is added; a task reads a
    part of one document, and a batch as many tasks as the list has grown by.
    """

    def __init__(self, options: dict[str, str]):
        self.path, self.step = options["path"], int(options.get("pagesPerTask", "16"))
        self.loader = options.get("loader", LOADER)

    def listed(self) -> list[tuple[str, int]]:
        with open(self.path, encoding="utf-8", newline="") as file:
            lines = file.read().split("\n")[:-1]  # what stands behind the last end of line is not written yet
        rows = (line.rstrip("\r").rsplit("\t", 1) for line in lines if line.strip())
        return [(path, int(pages)) for path, pages in rows]

    def initialOffset(self) -> dict[str, int]:
        return {"page": 0}

    def latestOffset(self) -> dict[str, int]:
        return {"page": sum(pages for _, pages in self.listed())}

    def partitions(self, start: dict[str, int], end: dict[str, int]) -> list[PageRange]:
        parts, before = [], 0
        for path, pages in self.listed():
            parts += ranges(path, max(start["page"] - before, 0), min(end["page"] - before, pages), self.step)
            before += pages
        return parts

    def read(self, partition: PageRange):
        return read_pages(partition, self.loader)


class PageSource(DataSource):
    """``spark.read.format("pages")``, ``spark.readStream.format("pages")``: one row a page, one task for each range of pages; the page loader is a plug-in."""

    @classmethod
    def name(cls) -> str:
        return "pages"

    def schema(self) -> str:
        return "source string, page int, method string, char_count int, text string"

    def reader(self, schema) -> PageReader:
        return PageReader(self.options)

    def streamReader(self, schema) -> PageStreamReader:
        return PageStreamReader(self.options)


@lru_cache(maxsize=1)
def _text_pages(path: str) -> list[str]:
    """The pages of the file that a task reads, read once for all its pages."""
    with open(path, encoding="utf-8") as file:
        return file.read().split("\f")


def text_page(path: str, page: int) -> tuple[str, str]:
    """The stand-in loader: pages of a text file are divided by form feeds."""
    text = _text_pages(path)[page]
    return ("text" if text.strip() else "blank"), text
