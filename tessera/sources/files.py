"""Files to text: type detection, parsers for common formats, archives.

A file that cannot be read becomes a row with an error, never a failed job. Formats whose
libraries are optional (PDF, old Excel) and model-backed ones (images, audio, video)
go through ``plugins``: a mapping of type to a function of (filename, bytes).
"""

from __future__ import annotations

import csv
import io
import json
import re
import zipfile
from collections.abc import Callable, Iterator, Mapping
from html.parser import HTMLParser
from pathlib import PurePosixPath
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Extension to type, and the types of MIME prefixes tried when the extension is unknown (fixed values).
EXTENSIONS = {
    "txt": "text", "md": "text", "rst": "text", "log": "text", "csv": "csv", "tsv": "tsv", "json": "json", "jsonl": "jsonl", "yaml": "yaml", "yml": "yaml", "xml": "xml", "html": "html", "htm": "html",
    "pdf": "pdf", "docx": "docx", "epub": "epub", "xlsx": "xlsx", "xls": "xls", "ods": "ods", "pptx": "pptx", "odp": "odp", "vtt": "vtt", "srt": "srt", "zip": "archive",
    "png": "image", "jpg": "image", "jpeg": "image", "webp": "image", "gif": "image", "mp3": "audio", "wav": "audio", "m4a": "audio", "mp4": "video", "mov": "video", "webm": "video",
}
MIME = (("text/html", "html"), ("text/csv", "csv"), ("text/", "text"), ("application/pdf", "pdf"), ("application/json", "json"), ("application/zip", "archive"), ("image/", "image"), ("audio/", "audio"), ("video/", "video"))
MAX_FILES, MAX_BYTES, MAX_DEPTH = 100, 52_428_800, 2


def detect(filename: Column, mime: Column) -> Column:
    """Type by extension, else by MIME type, else ``unsupported``."""
    ext = F.lower(F.regexp_extract(filename, r"\.([A-Za-z0-9]+)$", 1))
    known = F.create_map(*(F.lit(x) for pair in EXTENSIONS.items() for x in pair))
    by_mime = F
    for prefix, kind in MIME:
        by_mime = by_mime.when(F.startswith(F.lower(mime), F.lit(prefix)), kind)
    return F.coalesce(F.try_element_at(known, F.nullif(ext, F.lit(""))), by_mime, F.lit("unsupported"))


def decode(data: bytes) -> str:
    """UTF-8, else UTF-16, else Latin-1."""
    for name in ("utf-8", "utf-16"):
        try:
            return data.decode(name)
        except UnicodeError:
            pass
    return data.decode("latin-1")


def rows_text(data: bytes, delimiter: str) -> str:
    """A line a record, cells trimmed and joined by a comma and a space."""
    return "\n".join(", ".join(c.strip() for c in r) for r in csv.reader(io.StringIO(decode(data)), delimiter=delimiter))


def json_lines(data: bytes) -> str:
    """Each line in compact form; a bad line stays as it is."""
    out = []
    for line in decode(data).splitlines():
        try:
            out.append(json.dumps(json.loads(line), ensure_ascii=False) if line.strip() else "")
        except ValueError:
            out.append(line)
    return "\n".join(x for x in out if x)


def yaml_text(data: bytes) -> str:
    try:
        import yaml

        return json.dumps(yaml.safe_load(decode(data)), ensure_ascii=False, indent=2, default=str)
    except Exception:  # noqa: BLE001  any parser failure leaves the raw text, by definition
        return decode(data)


def xml_text(data: bytes) -> str:
    return "\n".join(t.strip() for t in ElementTree.fromstring(data).itertext() if t.strip())


class _Text(HTMLParser):
    def __init__(self):
        super().__init__()
        self.out, self.hidden = [], 0

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in ("script", "style")

    def handle_endtag(self, tag):
        self.hidden -= tag in ("script", "style") and self.hidden > 0

    def handle_data(self, data):
        if not self.hidden and data.strip():
            self.out.append(data.strip())


def html_text(data: bytes) -> str:
    """Text nodes outside scripts and styles, a line each."""
    p = _Text()
    p.feed(decode(data))
    return "\n".join(p.out)


def _tags(xml: bytes, name: str) -> Iterator[ElementTree.Element]:
    return (e for e in ElementTree.fromstring(xml).iter() if e.tag.rpartition("}")[2] == name)


def docx_text(data: bytes) -> str:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        return "\n".join(t for p in _tags(z.read("word/document.xml"), "p") if (t := "".join(p.itertext()).strip()))


def epub_text(data: bytes) -> str:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        return "\n\n".join(html_text(z.read(n)) for n in sorted(z.namelist()) if n.lower().endswith((".xhtml", ".html", ".htm")))


def xlsx_text(data: bytes) -> str:
    """``# Sheet: name``, then the non-empty cells of each row."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = z.namelist()
        shared = ["".join(s.itertext()) for s in _tags(z.read("xl/sharedStrings.xml"), "si")] if "xl/sharedStrings.xml" in names else []
        titles = [s.get("name") for s in _tags(z.read("xl/workbook.xml"), "sheet")]
        out = []
        for title, n in zip(titles, sorted((n for n in names if re.match(r"xl/worksheets/sheet\d+\.xml$", n)), key=lambda n: int(re.sub(r"\D", "", n)))):
            out.append(f"# Sheet: {title}")
            for row in _tags(z.read(n), "row"):
                cells = []
                for c in row:
                    v = "".join(t for e in c for t in e.itertext()).strip()
                    cells.append(shared[int(v)] if c.get("t") == "s" and v else v)
                if any(cells):
                    out.append(", ".join(x for x in cells if x))
        return "\n".join(out)


def open_document_text(data: bytes, part: str, label: str) -> str:
    """Sheets of a spreadsheet or slides of a presentation in OpenDocument form."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        out = []
        for i, page in enumerate(_tags(z.read("content.xml"), part), 1):
            name = next((v for k, v in page.attrib.items() if k.endswith("}name")), str(i))
            out.append(f"# {label}: {name}" if label == "Sheet" else f"# Slide {i}")
            if label == "Sheet":
                for row in (e for e in page.iter() if e.tag.endswith("}table-row")):
                    cells = [t for c in row if (t := "".join(c.itertext()).strip())]
                    if cells:
                        out.append(", ".join(cells))
            else:
                out += [t for p in page.iter() if p.tag.endswith("}p") and (t := "".join(p.itertext()).strip())]
        return "\n".join(out)


def pptx_text(data: bytes) -> str:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        out = []
        for i, n in enumerate(sorted((n for n in z.namelist() if re.match(r"ppt/slides/slide\d+\.xml$", n)), key=lambda n: int(re.sub(r"\D", "", n))), 1):
            out += [f"# Slide {i}", *(t for p in _tags(z.read(n), "p") if (t := "".join(p.itertext()).strip()))]
        return "\n".join(out)


def srt_text(data: bytes) -> str:
    """Subtitle text without numbers, times and blank lines."""
    return "\n".join(x.strip() for x in decode(data).splitlines() if x.strip() and not x.strip().isdigit() and "-->" not in x)


def vtt_text(data: bytes) -> str:
    return "\n".join(x for x in srt_text(data).splitlines() if not x.startswith("WEBVTT"))


PARSERS: dict[str, Callable[[bytes], str]] = {
    "text": decode, "csv": lambda d: rows_text(d, ","), "tsv": lambda d: rows_text(d, "\t"), "json": lambda d: json.dumps(json.loads(decode(d)), ensure_ascii=False, indent=2), "jsonl": json_lines,
    "yaml": yaml_text, "xml": xml_text, "html": html_text, "docx": docx_text, "epub": epub_text, "xlsx": xlsx_text, "ods": lambda d: open_document_text(d, "table", "Sheet"),
    "odp": lambda d: open_document_text(d, "page", "Slide"), "pptx": pptx_text, "srt": srt_text, "vtt": vtt_text,
}
PAYLOAD = "filename string, member string, type string, title string, text string, status string, error string"


def kind(filename: str) -> str:
    return EXTENSIONS.get(PurePosixPath(filename).suffix.lstrip(".").lower(), "unsupported")


def payloads(filename: str, data: bytes, plugins: Mapping[str, Callable[[str, bytes], str]], depth: int = 0) -> Iterator[tuple[str, str, str | None, str | None]]:
    """(member, type, text, error) of a file, and of each supported member of an archive up to the caps."""
    t = kind(filename)
    try:
        if t == "archive":
            if depth >= MAX_DEPTH:
                raise ValueError("archives are nested too deep")
            with zipfile.ZipFile(io.BytesIO(data)) as z:
                n = size = 0
                for m in z.infolist():
                    if m.is_dir() or not m.file_size or kind(m.filename) in ("unsupported", "archive"):
                        continue
                    n, size = n + 1, size + m.file_size
                    if n > MAX_FILES or size > MAX_BYTES:
                        yield m.filename, t, None, "archive exceeds its caps"
                        return
                    yield from payloads(m.filename, z.read(m), plugins, depth + 1)
            return
        if t in PARSERS:
            yield filename, t, PARSERS[t](data).replace("\x00", ""), None
        elif t in plugins:
            yield filename, t, plugins[t](filename, data), None
        else:
            yield filename, t, None, f"no parser for {t}"
    except Exception as e:  # noqa: BLE001  a bad file is a row with its error
        yield filename, t, None, f"{type(e).__name__}: {e}"[:200]


def parse(files: DataFrame, plugins: Mapping[str, Callable[[str, bytes], str]] | None = None) -> DataFrame:
    """Texts of ``files`` (path, content), such as the ``binaryFile`` source gives; one row for each payload."""
    plugins = dict(plugins or {})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for path, content in zip(b["path"], b["content"]):
                name = path.rsplit("/", 1)[-1]
                for member, t, text, error in payloads(name, bytes(content or b""), plugins):
                    out.append((name, member, t, PurePosixPath(member).stem[:200], text, "error" if error else "success", error))
            yield pd.DataFrame(out, columns=["filename", "member", "type", "title", "text", "status", "error"])

    return files.select("path", "content").mapInPandas(run, PAYLOAD)
