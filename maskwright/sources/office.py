"""Files to Markdown: text, CSV, DOCX, XLSX and PPTX with the standard library; PDF and images through plug-ins.

``binaryFile`` lists and reads the files; one Arrow-batched function turns
bytes into text or a typed error, so a broken file is a row and not a failure.
"""

from __future__ import annotations

import csv
import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
P = "{http://schemas.openxmlformats.org/presentationml/2006/main}"
S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
FORMATS = ("bmp", "csv", "docx", "jpeg", "jpg", "md", "pdf", "png", "pptx", "tif", "tiff", "txt", "xlsx")
IMAGES = ("bmp", "jpeg", "jpg", "png", "tif", "tiff")


class UnsupportedFormat(ValueError):
    pass


def format_of(path: str) -> str:
    suffix = path.rsplit("/", 1)[-1].rpartition(".")[2].lower() if "." in path.rsplit("/", 1)[-1] else ""
    if suffix not in FORMATS:
        raise UnsupportedFormat(f"unsupported format {suffix!r}; supported: {', '.join(FORMATS)}")
    return suffix


def cell(value) -> str:
    return ("" if value is None else str(value)).strip().replace("|", "\\|").replace("\r\n", "\n").replace("\n", "<br>")


def markdown_table(rows: list[list]) -> str:
    if not rows:
        return ""
    width = max(map(len, rows))
    lines = ["| " + " | ".join([*map(cell, r), *[""] * (width - len(r))]) + " |" for r in rows]
    return "\n".join([lines[0], "| " + " | ".join(["---"] * width) + " |", *lines[1:]])


def metadata_section(values: list[tuple[str, str | None]]) -> list[str]:
    kept = [(k, " ".join(str(v).split("\n")).replace("\r", " ").strip()) for k, v in values if v and str(v).strip()]
    return ["## Document metadata", "\n".join(f"- {k}: {v}" for k, v in kept)] if kept else []


def _xml(z: zipfile.ZipFile, name: str):
    return ElementTree.fromstring(z.read(name)) if name in z.namelist() else None


def _core(z: zipfile.ZipFile) -> list[str]:
    root = _xml(z, "docProps/core.xml")
    return metadata_section([(re.sub(r"\{.*\}", "", e.tag), e.text) for e in root] if root is not None else [])


def _relations(z: zipfile.ZipFile, part: str) -> dict[str, tuple[str, str]]:
    folder, _, name = part.rpartition("/")
    root = _xml(z, f"{folder}/_rels/{name}.rels")
    found = {}
    for e in root if root is not None else ():
        if e.get("TargetMode") != "External":
            target = e.get("Target", "")
            full = target.lstrip("/") if target.startswith("/") else f"{folder}/{target}"
            while "/../" in full:
                full = re.sub(r"[^/]+/\.\./", "", full, count=1)
            found[e.get("Id")] = (e.get("Type", "").rpartition("/")[2], full)
    return found


def csv_text(data: bytes) -> str:
    rows = list(csv.reader(io.StringIO(data.decode("utf-8-sig"), newline="")))
    return markdown_table(rows) if rows else "_Empty CSV file._"


def _run_text(element, deleted: bool = False) -> str:
    out = []
    for e in element:
        if e.tag == W + "del" and not deleted:
            continue
        if e.tag in (W + "t", W + "delText"):
            out.append(e.text or "")
        elif e.tag == W + "tab":
            out.append("\t")
        elif e.tag in (W + "br", W + "cr"):
            out.append("\n")
        elif e.tag in (W + "footnoteReference", W + "endnoteReference"):
            out.append(f"[{e.tag[len(W):-len('Reference')]}:{e.get(W + 'id')}]")
        else:
            out.append(_run_text(e, deleted))
    return "".join(out)


def _blocks(parent, styles: dict[str, str]) -> list[str]:
    out = []
    for e in parent:
        if e.tag == W + "p":
            text = _run_text(e).strip()
            style = e.find(f"{W}pPr/{W}pStyle")
            name = styles.get(style.get(W + "val"), style.get(W + "val")) if style is not None else ""
            if text:
                if name.lower().startswith("heading"):
                    level = re.search(r"\d+", name)
                    text = "#" * (min(6, max(1, int(level[0]))) if level else 2) + " " + text
                elif name.lower().startswith("list"):
                    text = "- " + text
                out.append(text)
        elif e.tag == W + "tbl":
            out.append(markdown_table([[" ".join(_cell_blocks(c, styles)) for c in row.findall(W + "tc")] for row in e.findall(W + "tr")]))
        elif e.tag in (W + "sdt", W + "sdtContent", W + "ins", W + "smartTag"):
            out += _blocks(e, styles)
    return out


def _cell_blocks(tc, styles) -> list[str]:
    out = []
    for e in tc:
        if e.tag == W + "tbl":
            out += [" | ".join(" ".join(_cell_blocks(c, styles)) for c in row.findall(W + "tc")) for row in e.findall(W + "tr")]
        elif e.tag == W + "p" and (t := _run_text(e).strip()):
            out.append(t)
        elif e.tag in (W + "sdt", W + "sdtContent"):
            out += _cell_blocks(e, styles)
    return out


def docx_text(data: bytes) -> str:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        root, style_root = _xml(z, "word/document.xml"), _xml(z, "word/styles.xml")
        styles = {s.get(W + "styleId"): (n.get(W + "val") if (n := s.find(W + "name")) is not None else "") for s in (style_root.iter(W + "style") if style_root is not None else ())}
        body = root.find(W + "body")
        out = [*_core(z), "## Document content", *_blocks(body, styles)]
        changes = []
        for kind, tag in (("Insertion", "ins"), ("Deletion", "del")):
            changes += [f"- {kind}; {e.get(W + 'author') or 'unknown'}: {t}" for e in root.iter(W + tag) if (t := _run_text(e, True).strip())]
        if changes:
            out += ["## Tracked changes", "\n".join(changes)]
        comments = _xml(z, "word/comments.xml")
        if comments is not None and len(comments):
            out += ["## Review comments", "\n".join(f"- {c.get(W + 'author') or 'unknown'} ({c.get(W + 'initials') or ''}): {' '.join(_run_text(p).strip() for p in c.iter(W + 'p'))}" for c in comments)]
        relations, seen = _relations(z, "word/document.xml"), set()
        for n, section in enumerate(body.iter(W + "sectPr"), 1):
            for e in section:
                if e.tag in (W + "headerReference", W + "footerReference"):
                    part = relations[e.get(R + "id")][1]
                    if part in seen:
                        continue
                    seen.add(part)
                    which = {"first": "First page ", "even": "Even page "}.get(e.get(W + "type"), "")
                    text = _blocks(_xml(z, part), styles)
                    if text:
                        kind = "Header" if e.tag == W + "headerReference" else "Footer"
                        out += [f"## {which}{kind} (section {n})" if which else f"## {kind} (section {n})", *text]
        for tag, title in (("footnote", "Footnotes"), ("endnote", "Endnotes")):
            wanted = list(dict.fromkeys(e.get(W + "id") for e in body.iter(f"{W}{tag}Reference")))
            if wanted:
                notes = _xml(z, f"word/{tag}s.xml")
                by_id = {e.get(W + "id"): e for e in notes} if notes is not None else {}
                missing = [i for i in wanted if i not in by_id]
                if missing:
                    raise ValueError(f"{tag} {missing[0]} is referenced but missing")
                out += [f"## {title}", "\n".join(f"[{tag}:{i}] " + " ".join(_run_text(p).strip() for p in by_id[i].iter(W + "p")) for i in wanted)]
        return "\n\n".join(x for x in out if x)


def xlsx_text(data: bytes) -> str:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        book, strings = _xml(z, "xl/workbook.xml"), _xml(z, "xl/sharedStrings.xml")
        shared = ["".join(t.text or "" for t in e.iter(S + "t")) for e in strings] if strings is not None else []
        relations = _relations(z, "xl/workbook.xml")
        out = _core(z)
        for sheet in book.iter(S + "sheet"):
            part = relations[sheet.get(R + "id")][1]
            rows, formulas = {}, []
            for c in _xml(z, part).iter(S + "c"):
                letters, row = re.fullmatch(r"([A-Z]+)(\d+)", c.get("r")).groups()
                column = 0
                for ch in letters:
                    column = column * 26 + ord(ch) - 64
                value, formula, kind = c.find(S + "v"), c.find(S + "f"), c.get("t")
                text = "".join(t.text or "" for t in c.iter(S + "t")) if kind == "inlineStr" else (value.text or "") if value is not None else None
                if kind == "s" and text is not None:
                    text = shared[int(text)]
                elif kind == "b" and text is not None:
                    text = "TRUE" if text == "1" else "FALSE"
                if formula is not None:
                    if text is None:
                        raise ValueError(f"{sheet.get('name')}!{c.get('r')}: the formula has no cached value")
                    formulas.append(f"- {c.get('r')}: ={formula.text or ''}")
                if text is not None:
                    rows.setdefault(int(row), {})[column] = text
            filled = [[r.get(i, "") for i in range(1, max(r) + 1)] for _, r in sorted(rows.items()) if any(v.strip() for v in r.values())]
            out += [f"## Sheet: {sheet.get('name')}", markdown_table(filled) or "_Empty sheet._"]
            if formulas:
                out += ["### Formulas", "\n".join(formulas)]
            for kind, target in _relations(z, part).values():
                if kind == "comments":
                    out += ["### Comments", "\n".join(f"- {c.get('ref')}: {''.join(t.text or '' for t in c.iter(S + 't'))}" for c in _xml(z, target).iter(S + "comment"))]
        return "\n\n".join(x for x in out if x)


def pptx_text(data: bytes) -> str:
    lines = lambda body: "\n".join(t for p in body.iter(A + "p") if (t := "".join("\n" if e.tag == A + "br" else e.text or "" for e in p.iter() if e.tag in (A + "t", A + "br")).strip()))
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        deck, relations = _xml(z, "ppt/presentation.xml"), _relations(z, "ppt/presentation.xml")
        out = _core(z)
        for n, ref in enumerate(deck.iter(P + "sldId"), 1):
            part = relations[ref.get(R + "id")][1]
            title, body = "", []

            def walk(parent):
                nonlocal title
                for shape in parent:
                    if shape.tag == P + "grpSp":
                        walk(shape)
                    elif shape.tag == P + "sp" and (text := shape.find(P + "txBody")) is not None:
                        kind = shape.find(f"{P}nvSpPr/{P}nvPr/{P}ph")
                        if kind is not None and kind.get("type") in ("title", "ctrTitle") and not title:
                            title = " ".join(lines(text).split())
                        elif t := lines(text):
                            body.append(t)
                    elif shape.tag == P + "graphicFrame":
                        body.extend(markdown_table([[lines(c) for c in row.iter(A + "tc")] for row in table.iter(A + "tr")]) for table in shape.iter(A + "tbl"))

            walk(_xml(z, part).find(f"{P}cSld/{P}spTree"))
            out += [f"## Slide {n}: {title}" if title else f"## Slide {n}", *body]
            for kind, target in _relations(z, part).values():
                if kind == "notesSlide":
                    notes = [lines(t) for sp in _xml(z, target).iter(P + "sp") if (ph := sp.find(f"{P}nvSpPr/{P}nvPr/{P}ph")) is not None and ph.get("type") == "body" and (t := sp.find(P + "txBody")) is not None]
                    if any(notes):
                        out += ["### Speaker notes", "\n".join(filter(None, notes))]
        return "\n\n".join(x for x in out if x)


TEXT = {"txt": lambda b: b.decode("utf-8-sig"), "md": lambda b: b.decode("utf-8-sig"), "csv": csv_text, "docx": docx_text, "xlsx": xlsx_text, "pptx": pptx_text}


def extract(path: str, data: bytes, readers: dict | None = None, language: str = "eng") -> tuple[str | None, str | None]:
    """(text, error) of one file. ``readers``: plug-ins by ``pdf`` and ``image``."""
    try:
        kind = format_of(path)
        if kind in TEXT:
            return TEXT[kind](data), None
        name = "image" if kind in IMAGES else kind
        if not readers or name not in readers:
            raise UnsupportedFormat(f"{kind} files need the plug-in {name!r}")
        return readers[name]().read(data, language), None
    except Exception as e:  # any broken file is a row with its error
        return None, f"{type(e).__name__}: {e}"


def extract_files(files: DataFrame, readers: dict | None = None, language: str = "eng") -> DataFrame:
    """(path, format, length, text, error) of files (path, length, content), as ``binaryFile`` reads them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):  # a file at a time keeps memory to one file
                p = batch.column(0)[i].as_py()
                text, error = extract(p, batch.column(2)[i].as_py(), readers, language)
                yield pa.RecordBatch.from_arrays([pa.array([p]), pa.array([p.rpartition(".")[2].lower()]), pa.array([batch.column(1)[i].as_py()], pa.int64()), pa.array([text], pa.string()), pa.array([error], pa.string())], ["path", "format", "length", "text", "error"])

    return files.select("path", "length", "content").mapInArrow(run, "path string, format string, length long, text string, error string")


def read_files(spark: SparkSession, path: str, readers: dict | None = None, language: str = "eng") -> DataFrame:
    """The texts of all files under a path, as ``extract_files`` gives them.

    Spark lists no empty files: join with a manifest to keep those.
    """
    return extract_files(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path), readers, language)


def require_all(files: DataFrame) -> DataFrame:
    """The files; the query fails on the first that could not be read."""
    return files.filter(F.assert_true(F.col("error").isNull(), F.concat(F.lit("extraction failed: "), "path", F.lit(": "), F.coalesce("error", F.lit("")))).isNull())
