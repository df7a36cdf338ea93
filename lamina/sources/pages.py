"""Where pages come from: tables of the driver, text files, PDFs; and their validation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.functions.text import strip


def conversation_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document for each conversation, a page for each turn."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return rows.select(F.col("conv_id").cast("string").alias("document_id"), (F.col("turn") + 1).cast("int").alias("page_number"), F.coalesce("text", F.lit("")).alias("text"))


def document_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A one-page document for each row of ``documents``."""
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return rows.select(F.col("doc_id").cast("string").alias("document_id"), F.lit(1).alias("page_number"), F.coalesce("text", F.lit("")).alias("text"))


def extracted_documents(pages: DataFrame, reject_blank: bool = True) -> DataFrame:
    """document_id, page_count, full_text: pages joined by blank lines; documents of blank pages only are left out."""
    ordered = F.array_sort(F.collect_list(F.struct("page_number", "text")))
    docs = pages.groupBy("document_id").agg(F.count(F.lit(1)).cast("int").alias("page_count"), F.array_join(F.transform(ordered, lambda p: p["text"]), "\n\n").alias("full_text"))
    return docs.where(strip(F.col("full_text")) != "") if reject_blank else docs


#: Elements that begin a line of their own; fixed values of HTML.
_BLOCK_TAGS = "address|article|aside|blockquote|br|dd|div|dl|dt|figcaption|figure|footer|form|h[1-6]|header|hr|li|main|nav|ol|p|pre|section|table|td|th|tr|ul"


def html_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A one-page document for each row of ``pages``: a line for each block of the markup, tags, scripts and styles left out."""
    rows = spark.read.parquet(f"{sf_dir}/pages.parquet")
    text = F.coalesce("html", F.lit(""))
    for pattern, by in ((r"(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->", ""), (rf"(?i)</?(?:{_BLOCK_TAGS})\b[^>]*>", "\n"), ("<[^>]*>", ""), ("[ \t]*\n\\s*", "\n")):
        text = F.regexp_replace(text, pattern, by)
    return rows.select(F.col("page_id").cast("string").alias("document_id"), F.lit(1).alias("page_number"), text.alias("text"))


def check_input(spark: SparkSession, path: str, suffix: str = ".pdf") -> None:
    """Raise ValueError unless ``path`` names an existing, non-empty file with the suffix, in any store that Spark reads."""
    if not path.strip():
        raise ValueError("path must be provided")
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = place.getFileSystem(spark._jsc.hadoopConfiguration())
    if not store.exists(place):
        raise ValueError(f"path does not exist: {path}")
    status = store.getFileStatus(place)
    if not status.isFile():
        raise ValueError(f"path is not a file: {path}")
    if not path.lower().endswith(suffix):
        raise ValueError(f"path must point to a {suffix} file: {path}")
    if status.getLen() == 0:
        raise ValueError(f"file is empty: {path}")


def _empty_files(spark: SparkSession, path: str) -> list[str]:
    """The names of files without a byte, which Spark's readers leave out."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = place.getFileSystem(spark._jsc.hadoopConfiguration())
    found = []
    for top in store.globStatus(place) or []:
        files = store.listFiles(top.getPath(), True)
        while files.hasNext():
            file = files.next()
            if file.getLen() == 0:
                found.append(file.getPath().toString())
    return found


def pdf_manifest(spark: SparkSession, path: str) -> DataFrame:
    """path, document_id and the first reason a file can't be read as a PDF (null if it can).

    File contents are not read for this: only names and sizes are.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "length")
    files = files.unionByName(spark.createDataFrame([(p, 0) for p in _empty_files(spark, path)], "path string, length long"))
    name = F.element_at(F.split("path", "/"), -1)
    status = F.when(~F.lower("path").endswith(".pdf"), "not a pdf").when(F.col("length") == 0, "empty file")
    return files.select("path", F.regexp_replace(name, r"\.[^.]*$", "").alias("document_id"), status.alias("problem"))


def read_pdf(content: bytes, password: str = "", layout: bool = True, open_pdf=None) -> tuple[list[str], str | None]:
    """(page texts, None) of one PDF, or ([], why it can't be read).

    ``open_pdf`` makes a reader of a binary file; by default the one of the optional pypdf
    package.  Blank pages stay; a document without any text is refused.
    """
    import io

    if open_pdf is None:
        from pypdf import PdfReader as open_pdf  # noqa: N813
    try:
        reader = open_pdf(io.BytesIO(content))
        locked = reader.is_encrypted and not reader.decrypt(password)
        count = 0 if locked else len(reader.pages)
    except NotImplementedError:
        return [], "unsupported encryption method"
    except Exception as e:  # a broken file is a row that says so, not a failed job
        return [], f"corrupted or not a valid PDF ({type(e).__name__})"
    if locked:
        return [], "encrypted and could not be decrypted"
    if not count:
        return [], "no pages"
    texts = []
    for number, page in enumerate(reader.pages, 1):
        try:
            texts.append(_page_text(page, layout))
        except Exception as e:
            return [], f"failed to extract text from page {number} ({type(e).__name__}: {e})"
    return (texts, None) if any(t.strip() for t in texts) else ([], "no extractable text")


def _page_text(page, layout: bool) -> str:
    if layout:
        try:
            return page.extract_text(extraction_mode="layout", layout_mode_space_vertically=False) or ""
        except TypeError as e:
            if "unexpected keyword argument" not in str(e):
                raise
    return page.extract_text() or ""


def pdf_pages(spark: SparkSession, path: str, password: str = "", layout: bool = True, open_pdf=None) -> DataFrame:
    """Pages of PDF files: document_id, page_number, text; a file that can't be read is one row with its ``problem``."""
    manifest = pdf_manifest(spark, path)
    contents = spark.read.format("binaryFile").load(path).select("path", "content")
    files = manifest.join(contents, "path", "left").select("document_id", "content", F.col("problem").alias("known"))

    def read(batches):
        import pandas as pd

        for pdf in batches:
            for name, content, known in zip(pdf["document_id"], pdf["content"], pdf["known"], strict=True):
                texts, problem = ([], known) if known else read_pdf(content, password, layout, open_pdf)
                rows = [(name, i, t, None) for i, t in enumerate(texts, 1)] or [(name, None, None, problem)]
                yield pd.DataFrame(rows, columns=["document_id", "page_number", "text", "problem"]).astype({"page_number": "Int32"})

    return files.mapInPandas(read, "document_id string, page_number int, text string, problem string")
