"""Text functions, files, loaders, sinks, tagging, generators, plug-ins and streaming."""

import io
import json
import random
import re
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from maskwright import plugins
from maskwright.functions import text as T
from maskwright.functions import unicode as U
from maskwright.operators import detect as D
from maskwright.operators import generate, ordered, pipeline, sections, study, tagging
from maskwright.sources import loaders, office, sinks
from maskwright.streaming.redaction import redact_stream


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "t string").select(column(F.col("t")).alias("x")).first().x


def test_normalize_markdown(spark):
    def want(t):
        t = "\n".join(x if x.strip() else "" for x in t.replace("\r\n", "\n").replace("\r", "\n").split("\n"))
        t = re.sub(r"\n{3,}", "\n\n", t).strip("\n")
        return t + "\n" if t else ""

    rng = random.Random(1)
    texts = ["".join(rng.choices(["a", " ", "\n", "\r", "\r\n", "\t", " ", " ", "\x85", "\x1c", "😀"], k=rng.randint(0, 20))) for _ in range(500)]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.normalize_markdown(F.col("t")).alias("n")).collect()
    assert all(r.n == want(r.t) for r in got)


def test_windows(spark):
    text = "one two three\nfour five six seven eight nine ten " * 3
    for column, mark in ((T.word_windows(F.col("t"), 20, 5), 0), (T.line_windows(F.col("t"), 20, 4), 1)):
        got = spark.createDataFrame([(text,), ("",), (None,)], "t string").select(column.alias("w")).collect()
        assert all(text[w.offset : w.offset + len(w.piece)] == w.piece for w in got[0].w) and got[0].w[-1].offset + len(got[0].w[-1].piece) == len(text)
        assert got[1].w == got[2].w == [] and (not mark or got[0].w[0].piece.endswith("\n"))
    got = one(spark, text, lambda c: T.pieces(c, 20, 5))
    assert [(w.offset, w.piece) for w in got] == [(i, text[i : i + 20]) for i in range(0, len(text) - 5, 15)]


def test_small_functions(spark):
    assert one(spark, "a/b c.d-é", T.safe_name) == "a_b_c.d-é"
    assert [one(spark, k, T.label_type) for k in ("FI_EMAIL2", "PERSONAL_ID", "NAME")] == ["EMAIL", "PERSONAL_ID", "NAME"]
    assert one(spark, "first line\nsecond line", lambda c: T.truncate_at_line(c, 15, "…")) == "first line…" and one(spark, "short", lambda c: T.truncate_at_line(c, 15, "…")) == "short"
    assert one(spark, " a\na  b\n\na", T.distinct_lines) == ["a", "a b"]
    assert one(spark, "One. Two here; three", lambda c: T.clause(c, F.lit(9), F.lit(13))).asDict() == {"left": 4, "right": 13}
    assert one(spark, "1234567", T.business_check_digit) in {None, *range(10)} and one(spark, "http://127.0.0.1:80/v1", T.is_loopback_endpoint) and not one(spark, "http://u@127.0.0.1/v1", T.is_loopback_endpoint)
    assert one(spark, "A | b\nc", lambda c: T.rows_to_markdown(F.array(F.array(c, c), F.array(c)))).split("\n")[1:] == ["| --- | --- |", "| A \\| b<br>c |  |"]
    df = spark.createDataFrame([(" Å <br>x\\|  y ", "Straße. ")], "a string, b string")
    r = df.select(U.normalize_layout("a").alias("a"), U.normalize_answer("b").alias("b"), U.source_ranges("a", F.lit("x|")).alias("s")).first()
    assert (r.a, r.b, [(x.start, x.end) for x in r.s]) == ("Å x| y", "strasse", [(7, 10)])


def test_metadata_sections(spark):
    text = "# A\nx\n## Document metadata\nsecret\n### deeper\ns\n## Next\n```\n# not a heading\n## Document metadata\n```\nkept\n"
    assert one(spark, text, U.remove_document_metadata) == "# A\nx\n## Next\n```\n# not a heading\n## Document metadata\n```\nkept\n"
    df = spark.createDataFrame([(1, "pre\n## Sheet: Secret\nx\n## Header (section 1)\ny\n### Speaker notes\nz", ["Secret"])], "doc_id long, text string, hidden array<string>")
    assert [(r.location, r.start) for r in sections.locations(df, hidden_col="hidden").orderBy("start").collect()] == [("body", 0), ("hidden_sheet", 4), ("header", 23), ("notes", 47)]
    assert [r.title for r in sections.split_sections(df).orderBy("n").collect()] == ["(start)", "Sheet: Secret", "Header (section 1)", "Speaker notes"]


def package(**parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, xml in parts.items():
            z.writestr(name.replace("__", "/").replace("_rels_", "_rels"), xml)
    return out.getvalue()


W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
S = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
REL = '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="x/worksheet" Target="worksheets/s.xml"/></Relationships>'


def docx(body, **more):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {W}><w:body>{body}</w:body></w:document>")
        for name, xml in more.items():
            z.writestr(f"word/{name}.xml", xml)
    return out.getvalue()


def xlsx(cells):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {S}><sheets><sheet name="One" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", REL)
        z.writestr("xl/worksheets/s.xml", f"<worksheet {S}><sheetData><row>{cells}</row></sheetData></worksheet>")
    return out.getvalue()


def test_files(spark, tmp_path):
    p = lambda t, style="": f'<w:p>{f"<w:pPr><w:pStyle w:val=\"{style}\"/></w:pPr>" if style else ""}<w:r><w:t>{t}</w:t></w:r></w:p>'
    table = f"<w:tbl><w:tr><w:tc>{p('a')}</w:tc><w:tc>{p('b|c')}</w:tc></w:tr></w:tbl>"
    changed = '<w:p><w:del w:author="Ann"><w:r><w:delText>gone</w:delText></w:r></w:del><w:ins w:author="Bo"><w:r><w:t>new</w:t></w:r></w:ins></w:p>'
    note = '<w:p><w:r><w:t>see</w:t><w:footnoteReference w:id="7"/></w:r></w:p>'
    notes = f'<w:footnotes {W}><w:footnote w:id="7">{p("the note")}</w:footnote><w:footnote w:id="8">{p("unused")}</w:footnote></w:footnotes>'
    text = office.docx_text(docx(p("Title", "Heading1") + table + changed + note, footnotes=notes))
    assert "# Title" in text and "| a | b\\|c |" in text and "- Insertion; Bo: new" in text and "- Deletion; Ann: gone" in text and "see[footnote:7]" in text and "[footnote:7] the note" in text and "unused" not in text
    assert office.xlsx_text(xlsx('<c r="A1" t="inlineStr"><is><t>x</t></is></c><c r="C1"><f>1+1</f><v>2</v></c>')).split("\n\n")[1] == "| x |  | 2 |\n| --- | --- | --- |"
    for name, data in {"a.docx": docx(note), "b.xlsx": xlsx('<c r="A1"><f>1</f></c>'), "c.csv": b"\xef\xbb\xbfa,b\n1\n", "d.txt": "ABC-123 é\r\n".encode(), "e.pdf": b"%PDF", "f.zip": b"x"}.items():
        (tmp_path / name).write_bytes(data)
    rows = {r.path.rsplit("/", 1)[1]: r for r in office.read_files(spark, str(tmp_path)).collect()}
    assert rows["c.csv"].text == "| a | b |\n| --- | --- |\n| 1 |  |" and office.csv_text(b"") == "_Empty CSV file._" and "missing" in rows["a.docx"].error and "One!A1" in rows["b.xlsx"].error and "plug-in" in rows["e.pdf"].error and "UnsupportedFormat" in rows["f.zip"].error
    cleaned, found, failed = pipeline.clean(office.read_files(spark, str(tmp_path)), D.pattern_spans)
    assert {r.text for r in cleaned.filter(F.endswith("path", F.lit("d.txt"))).collect()} == {"[PLATE] é\n"} and found.count() == 1 and failed.count() == 4


def test_loaders_and_sinks(spark, tmp_path):
    (tmp_path / "labels").mkdir()
    (tmp_path / "index.csv").write_text("file,language,format,entities,hidden,quality\na.md,en,md,1,0,\n")
    (tmp_path / "labels/a.json").write_text(json.dumps({"file": "a.md", "language": "en", "format": "md", "entities": [{"type": "EMAIL", "value": "x"}]}))
    (tmp_path / "labels/stale.json").write_text(json.dumps({"file": "z.md", "language": "en", "format": "md", "entities": []}))
    assert [(r.file, r.quality, r.location) for r in loaders.manifest_labels(spark, str(tmp_path)).collect()] == [("a.md", "standard", "body")]
    (tmp_path / "index.csv").write_text("file,language,format,entities,hidden,quality\na.md,en,md,2,0,\n")
    with pytest.raises(Exception, match="differ"):
        loaders.manifest_labels(spark, str(tmp_path)).collect()
    mention = lambda s, e, t, i: {"start_offset": s, "end_offset": e, "entity_type": t, "identifier_type": i}
    records = [{"doc_id": str(i), "text": "abcdef", "annotations": {"b": {"entity_mentions": []}, "a": {"entity_mentions": [mention(0, 2, "ORG", "QUASI"), mention(0, 2, "PERSON", "DIRECT"), mention(3, 4, "LOC", "NO_MASK")]}}} for i in range(7)]
    (tmp_path / "court.json").write_text(json.dumps(records))
    court = loaders.court(spark.read.schema(loaders.COURT).option("multiLine", True).json(str(tmp_path / "court.json")), 2).collect()
    assert sorted(r.doc_id for r in court) == ["0", "3"] and [m.type for m in court[0].mentions] == ["PERSON"] and len(court[0].annotated) == 2
    ner = spark.createDataFrame([(i, "s one\ns two\n", "T1\tPER 0 1\ts\nT2\tPRO 2 3\to\n") for i in range(5)], "doc_id long, text string, ann string")
    got = loaders.standoff(ner, 3).collect()
    assert len(got) == 2 and [m.type for m in got[0].mentions] == ["PERSON"] and len(got[0].annotated) == 2
    names = sinks.output_names(spark.createDataFrame([("x/a.md",), ("y/a.md",), ("b.md",)], "path string"), spark.createDataFrame([("a.md_anonymized.md",)], "output string"))
    assert {r.output for r in names.collect()} == {"a.md_anonymized_2.md", "a.md_anonymized_3.md", "b.md_anonymized.md"}
    with pytest.raises(Exception, match="exist"):
        for _ in range(2):
            sinks.write_new(names, str(tmp_path / "out"))
    assert sinks.markdown_report(spark.createDataFrame([(1, None)], "a int, b double")).endswith("| 1 | – |")


def test_order_and_study(spark):
    df = spark.range(1000).withColumn("k", F.col("id") % 7).repartition(5)
    assert sorted(r.id for r in ordered.every_nth(df, ["id"]).collect()) == list(range(0, 1000, 3))
    assert {r.id: r.n for r in ordered.row_numbers(df, ["id"]).collect()} == {i: i + 1 for i in range(1000)}
    prints = {ordered.fingerprint(df.filter(f), "id", "k").first()[0] for f in ("true", "id < 999", "id <> 5")}
    assert len(prints) == 3 and ordered.fingerprint(df.repartition(3), "id", "k").first()[0] in prints
    docs = spark.createDataFrame([("d1", "t")], "document_id string, text string")
    questions = spark.createDataFrame([("d1", "q1", "who", ["ann"]), ("d1", "q2", "where", ["here"])], "document_id string, question_id string, question string, ground_truth array<string>")
    plan = study.require_plan(study.plan(docs, questions))
    ids = {(r.question_id, r.variant): r.request_id for r in plan.collect()}
    assert sorted(ids.values()) == [f"request-{i:05d}" for i in range(1, 7)]
    answers = spark.createDataFrame([(ids["q1", "raw"], "ann", False, "m"), (ids["q1", "redacted"], "", True, "m"), (ids["q2", "raw"], "x", False, "m")], "request_id string, answer string, refused boolean, model string")
    assert {(r.question_id, r.variant): r.score for r in study.score_recorded(plan, answers).collect()} == {("q1", "raw"): "correct", ("q1", "redacted"): "refused", ("q1", "pseudonymized"): "unanswered", ("q2", "raw"): "wrong", ("q2", "redacted"): "unanswered", ("q2", "pseudonymized"): "unanswered"}
    with pytest.raises(Exception, match="unknown or repeated"):
        study.score_recorded(plan, answers.union(answers)).collect()


def test_tagging_and_plugins(spark):
    tags = ["O", "B-A", "I-A", "E-A", "S-A"]
    logits = np.log(np.array([[0.1, 0.2, 0.6, 0.05, 0.05], [0.2, 0.05, 0.05, 0.6, 0.1], [0.8, 0.05, 0.05, 0.05, 0.05]]))
    got = tagging.decode(logits, tags, [(0, 3), (3, 8), (8, 9)], "Ann Berg.")
    assert [(s, e, k) for s, e, k, _ in got] == [(0, 8, "A")] and abs(got[0][3] - 0.2) < 1e-9
    docs = spark.createDataFrame([(1, "en", "hello Ann " * 100)], "doc_id long, language string, text string")
    with pytest.raises(plugins.MissingPlugin):
        plugins.model_spans(docs, "none")

    def factory():
        class Stub:
            def detect(self, text, language):
                return [{"start": m.start(), "end": m.end(), "entity_type": "PERSON", "score": 0.5} for m in re.finditer("Ann", text)]

        return Stub()

    plugins.provide("stub", factory)
    assert sorted(r.start for r in plugins.model_spans(docs, "stub", lambda c: T.word_windows(c, 70, 15)).collect()) == [10 * i + 6 for i in range(100)]


def test_generated_corpus_and_stream(spark, tmp_path):
    rows = generate.records(spark, 50)
    made = generate.render(rows, "Name {{PERSON}}, id {{PERSONAL_ID}} mail {{EMAIL}}.")
    assert generate.problems(made).count() == 0 and made.filter(F.col("text").rlike(generate.personal_id_shape())).count() == 50
    bad = made.withColumn("text", F.concat(F.lit("x"), "text"))
    assert bad.count() == generate.problems(bad).filter("problem = 'offsets'").count()
    assert generate.split_dev(made.withColumn("g", F.col("id") % 2), 3, "g").filter("split = 'dev'").count() == 6
    folder = tmp_path / "in"
    spark.createDataFrame([("ABC-123 and INV-12345",), ("none",)], "text string").write.json(str(folder))
    stream = redact_stream(spark.readStream.schema("text string").json(str(folder)))
    q = stream.writeStream.format("memory").queryName("cleaned").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert {r.text for r in spark.table("cleaned").collect()} == {"[PLATE] and [INVOICE]", "none"}
