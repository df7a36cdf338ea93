"""Input checks, PDF pages through a stub reader, and the commands."""

import pytest

from lamina import cli
from lamina.sources.pages import check_input, pdf_pages, read_pdf


class Page:
    def __init__(self, text, plain=False):
        self.text, self.plain = text, plain

    def extract_text(self, **how):
        if self.plain and how:
            raise TypeError("extract_text() got an unexpected keyword argument")
        if self.text is None:
            raise RuntimeError("no fonts")
        return self.text


class Reader:
    def __init__(self, pages, password=None):
        self.pages, self.password, self.is_encrypted = pages, password, password is not None

    def decrypt(self, password):
        return int(password == self.password)


def reading(reader):
    return lambda _: reader


def test_pdf_pages_are_read_in_order():
    assert read_pdf(b"x", open_pdf=reading(Reader([Page("a"), Page(""), Page("c", plain=True)]))) == (["a", "", "c"], None)
    assert read_pdf(b"x", "key", open_pdf=reading(Reader([Page("a")], "key"))) == (["a"], None)


@pytest.mark.parametrize(("reader", "problem"), [
    (Reader([]), "no pages"), (Reader([Page(" "), Page("")]), "no extractable text"), (Reader([Page("a")], "key"), "encrypted and could not be decrypted"),
    (Reader([Page("a"), Page(None)]), "failed to extract text from page 2"),
])
def test_unreadable_pdfs_say_why(reader, problem):
    texts, found = read_pdf(b"x", "wrong", open_pdf=reading(reader))
    assert texts == [] and found.startswith(problem)


def test_broken_pdfs_say_so():
    def broken(_):
        raise ValueError("EOF marker not found")

    def locked(_):
        raise NotImplementedError

    assert read_pdf(b"x", open_pdf=broken)[1].startswith("corrupted") and read_pdf(b"x", open_pdf=locked)[1].startswith("unsupported")


def test_pdf_files(spark, tmp_path):
    for name, content in (("good.pdf", b"1"), ("empty.pdf", b""), ("note.txt", b"1")):
        (tmp_path / name).write_bytes(content)

    class Two:
        is_encrypted = False
        pages = [type("P", (), {"extract_text": lambda self, **_: "text"})()] * 2

    got = sorted((r["document_id"], r["page_number"], r["text"], r["problem"]) for r in pdf_pages(spark, str(tmp_path), open_pdf=lambda _: Two()).collect())
    assert sorted(got, key=str) == sorted([("good", 1, "text", None), ("good", 2, "text", None), ("empty", None, None, "empty file"), ("note", None, None, "not a pdf")], key=str)


@pytest.mark.parametrize(("name", "why"), [("", "must be provided"), ("none.pdf", "does not exist"), ("folder", "not a file"), ("note.txt", "must point to a .pdf"), ("empty.pdf", "is empty")])
def test_input_is_checked(spark, tmp_path, name, why):
    (tmp_path / "folder").mkdir()
    (tmp_path / "note.txt").write_text("x")
    (tmp_path / "empty.pdf").write_text("")
    with pytest.raises(ValueError, match=why):
        check_input(spark, f"{tmp_path}/{name}" if name else name)


def test_commands(spark, tmp_path):
    path = tmp_path / "minutes.txt"
    path.write_text("Section 1\nFirst words of the minutes. " + "More of them follow here. " * 60 + "\fSecond page.\n• one\n• two")
    pages, said = cli.document_of(spark, str(path)), []
    assert cli.report(spark, pages, "v2.2", said.append)
    assert said[0].startswith("Strategy v2.2") and "Chunks are valid." in said and any(x.startswith("--- Chunk 0") for x in said)
    assert "[context]\nSection 1" in said
    said.clear()
    cli.compare(spark, pages, said.append)
    assert said[0].split("\n")[0].split() == ["Metric", "V1", "V2.1", "V2.2"] and len(said[0].split("\n")) >= 10
    with pytest.raises(ValueError, match="does not exist"):
        cli.document_of(spark, f"{tmp_path}/none.txt")
