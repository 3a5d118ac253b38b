import io
import json
import zipfile

from pyspark.sql import functions as F

from vellum.operators import views
from vellum.sources import files, office


def test_notes_and_frontmatter(spark, tmp_path):
    for path, text in {
        "70 Decisions/a.md": "---\ntype: decision\nsources: ['[[S]]']\nconfidence: 0.5\n---\nBody", "70 Decisions/b.md": "no frontmatter", "70 Decisions/c.md": "---\ntype: x\n", "70 Decisions/d.md": "---\n: : [\n---\nx",
        "70 Decisions/e.md": "---\n- a\n---\nx", ".git/f.md": "x", "20 Companies/_archive/g.md": "x", "70 Decisions/folder.md": "x", "90 System/h.md": "x", "70 Decisions/i.txt": "x",
    }.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(text)
    notes = files.notes(spark, str(tmp_path))
    assert sorted(r.basename for r in notes.collect()) == ["a", "b", "c", "d", "e", "h"]
    assert {r.zone for r in files.notes(spark, str(tmp_path), files.TYPED_ZONES).collect()} == {"70 Decisions"}
    got = {r.basename: r.fm for r in notes.select("basename", files.frontmatter(F.col("text")).alias("fm")).collect()}
    assert got["a"].fields == {"type": "decision", "sources": '["[[S]]"]', "confidence": "0.5"} and got["a"].body == "Body"
    assert [got[k].error for k in "bcde"] == [None, "unterminated_frontmatter", "yaml_error", "frontmatter_not_mapping"]
    assert files.notes(spark, str(tmp_path), head=3).select(F.max(F.length("text"))).first()[0] == 3
    shown = files.rendered(notes.where("basename = 'a'").select(F.create_map(F.lit("b"), F.lit("2"), F.lit("a"), F.lit("1")).alias("fields"), F.lit("text").alias("body"), F.lit("o.pdf").alias("source_file"))).first().rendered
    assert shown == "---\na: 1\nb: 2\n---\n\n[Open original](o.pdf)\n\ntext"


def test_manifest_vectors_bases_corpus(spark, tmp_path):
    (tmp_path / "m.jsonl").write_text('{"run_id": "r", "status": "intent", "supersedes": ["a"]}\nbroken\n')
    rows = files.manifest(spark, str(tmp_path / "m.jsonl")).cache()
    assert rows.count() == 2 and rows.where("corrupt is not null").count() == 1
    entry = {"path": "n.md", "embeddings": {"m": {"vec": [1.0, 2.0]}}}
    (tmp_path / "v.ajson").write_text(f'"smart_sources:n.md": {json.dumps(entry)},\n"smart_blocks:n.md#h": {json.dumps(entry)},\n')
    got = files.vectors(spark, str(tmp_path / "v.ajson"), "m", 2).collect()
    assert [(r.path, list(r.vector)) for r in got] == [("n.md", [1.0, 2.0])]
    assert files.vectors(spark, str(tmp_path / "v.ajson"), "m", 3).count() == 0
    (tmp_path / "Meetings.base").write_text('filters:\n  and:\n    - type == "meeting"\nviews:\n  - type: table\n    name: all\n    order:\n      - property: document_date\n        direction: DESC\n')
    base = files.bases(spark, str(tmp_path))["Meetings"]
    assert views.is_primary(base["filters"]) and views.required_keys(base) == ["document_date"]
    (tmp_path / "t.txt").write_text("---\na: 1\n---\nprose")
    assert "prose" in {r.text for r in files.corpus(spark, str(tmp_path)).collect()}


def archive(**parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name.replace("__", "/"), text)
    return out.getvalue()


W = 'xmlns:w="w" xmlns:r="r" xmlns:a="a" xmlns:p="p"'


def test_office(spark):
    doc = (
        f'<w:document {W}><w:body><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Title</w:t></w:r></w:p><w:p><w:r><w:rPr><w:b/></w:rPr><w:t>bold</w:t></w:r><w:r><w:t> text</w:t><w:footnoteReference w:id="2"/></w:r></w:p>'
        '<w:p><w:pPr><w:numPr><w:ilvl w:val="1"/></w:numPr></w:pPr><w:r><w:t>item</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>h|1</w:t></w:r></w:p></w:tc></w:tr><w:tr><w:tc><w:p><w:r><w:t>c</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>'
    )
    notes = f'<w:footnotes {W}><w:footnote w:id="0" w:type="separator"/><w:footnote w:id="2"><w:p><w:r><w:t>note</w:t></w:r></w:p></w:footnote></w:footnotes>'
    comments = f'<w:comments {W}><w:comment w:author="A"><w:p><w:r><w:t>why</w:t></w:r></w:p></w:comment></w:comments>'
    docx = archive(**{"word__document.xml": doc, "word__footnotes.xml": notes, "word__comments.xml": comments})
    sheet = '<worksheet><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c></row><row><c r="A2"><v>5</v></c><c r="B2"><f>A2*2</f><v>10</v></c></row></sheetData><mergeCells><mergeCell ref="A1:B1"/></mergeCells></worksheet>'
    xlsx = archive(**{"xl__workbook.xml": f'<workbook {W}><sheets><sheet name="S" r:id="x1"/></sheets></workbook>', "xl___rels/workbook.xml.rels": '<R><Relationship Id="x1" Target="worksheets/sheet1.xml"/></R>', "xl__worksheets__sheet1.xml": sheet, "xl__sharedStrings.xml": "<sst><si><t>n</t></si><si><t>twice</t></si></sst>"})
    shape = lambda x, y, t, kind="": f'<p:sp>{kind}<a:off x="{x}" y="{y}"/><a:p><a:r><a:t>{t}</a:t></a:r></a:p></p:sp>'
    pptx = archive(**{"ppt__slides__slide1.xml": f"<p:sld {W}>" + shape(9, 1_600_000, "right") + shape(1, 1_700_000, "left") + shape(0, 0, "Head", '<p:ph type="title"/>') + "</p:sld>"})
    rows = spark.createDataFrame([("a.docx", docx), ("b.xlsx", xlsx), ("c.pptx", pptx), ("d.pdf", b"x"), ("e.docx", b"broken"), ("f.zzz", b"")], "path string, content binary")
    got = {r.path: r for r in office.extract(rows).collect()}
    assert got["a.docx"].markdown == "# Title\n\n**bold** text[^2]\n\n  - item\n\n| h\\|1 |\n| --- |\n| c |\n\n[^2]: note\n\n## Comments\n\n- A: why"
    assert (got["a.docx"].n_tables, got["a.docx"].n_footnotes, got["a.docx"].n_comments) == (1, 1, 1)
    assert got["b.xlsx"].markdown == "## S\n\n| n | twice |\n| --- | --- |\n| 5 | 10 |\n\nMerged: A1:B1\n\nFormulas: B2: =A2*2"
    assert got["c.pptx"].markdown == "## Slide 1 - Head\n\nleft\n\nright"
    assert got["d.pdf"].warning == "no_provider" and got["f.zzz"].warning == "unsupported_file_type" and got["e.docx"].warning.startswith("unreadable")
    assert office.extract(rows, {"pdf": lambda b: {"markdown": "given"}}).where("path = 'd.pdf'").first().markdown == "given"
    assert [office.letters(n) for n in (1, 26, 27, 703)] == ["A", "Z", "AA", "AAA"]
