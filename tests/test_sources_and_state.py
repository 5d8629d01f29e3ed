import io
import zipfile
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from marginalia.operators import payload, state, structure
from marginalia.sources import docx, urls
from marginalia.streaming.limits import stream_rate_limited

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def paragraph(text, style="", outline=None):
    level = f'<w:outlineLvl w:val="{outline}"/>' if outline is not None else ""
    properties = f'<w:pPr><w:pStyle w:val="{style}"/>{level}</w:pPr>' if style or level else ""
    return f"<w:p>{properties}<w:r><w:t>{text}</w:t></w:r></w:p>"


def docx_bytes(body, styles="", notes=""):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {W}><w:body>{body}</w:body></w:document>")
        z.writestr("word/styles.xml", f"<w:styles {W}>{styles}</w:styles>")
        z.writestr("word/footnotes.xml", f"<w:footnotes {W}>{notes}</w:footnotes>")
    return out.getvalue()


def test_docx(spark, tmp_path):
    table = f"<w:tbl><w:tr><w:tc>{paragraph('a')}</w:tc><w:tc>{paragraph('b')}</w:tc></w:tr></w:tbl>"
    content = f"<w:sdt><w:sdtContent>{paragraph('目次')}</w:sdtContent></w:sdt>"
    body = paragraph("題", "Title") + content + paragraph("序論", "1") + paragraph("本文<!-- -->です") + table + paragraph("図", outline=1) + "<w:p><w:r><w:drawing/></w:r></w:p>"
    styles = '<w:style w:styleId="1"><w:name w:val="heading 2"/></w:style><w:style w:styleId="Title"><w:name w:val="Title"/></w:style>'
    notes = f'<w:footnote w:type="separator" w:id="0">{paragraph("x")}</w:footnote><w:footnote w:id="7">{paragraph("注")}</w:footnote>'
    (tmp_path / "a.docx").write_bytes(docx_bytes(body, styles, notes))
    (tmp_path / "b.docx").write_bytes(b"no zip")
    (tmp_path / "c.txt").write_bytes(b"no")
    blocks = docx.read_blocks(spark, str(tmp_path))
    found = docx.paragraphs(blocks).orderBy("idx").collect()
    assert [(p.text, p.is_heading, p.heading_level) for p in found] == [("題", False, None), ("目次", False, None), ("序論", True, 2), ("本文です", False, None), ("図", True, 2), ("", False, None)]
    assert docx.tables(blocks).first().text == "a | b"
    assert [(n.fn_id, n.text) for n in docx.footnotes(blocks).collect()] == [("7", "注")]
    assert docx.figure_counts(blocks).first().figures == 1
    assert blocks.where("kind = 'error'").count() == 1


def test_url_gate(spark):
    given = {
        "https://example.com/a": True, "http://example.com:80/": True, "https://example.com:8443/": False, "ftp://example.com/": False, "https://u:p@example.com/": False,
        "https://localhost/": False, "https://a.test/": False, "nonsense": False,
    }
    found = spark.createDataFrame([(u,) for u in given], "u string").select("u", urls.admissible(F.col("u")).alias("ok")).collect()
    assert {r.u: r.ok for r in found} == given


def test_source_format(spark):
    rows = [(b"%PDF-1.7", "", "https://e.com/x", "pdf"), (b"<!DOCTYPE html>", "", "https://e.com/x", "html"), (b"x", "image/png", "https://e.com/x", "unsupported_format"), (b"x" * (urls.HTML_BYTES + 1), "text/html", "https://e.com/x", "too_large")]
    found = spark.createDataFrame(rows, "c binary, t string, u string, wanted string").select(urls.source_format(F.col("c"), F.col("t"), F.col("u")).alias("got"), "wanted").collect()
    assert all(r.got == r.wanted for r in found)


def requests(spark, *seconds, client="a"):
    start = datetime(2024, 1, 1)
    return spark.createDataFrame([(i, client, start + timedelta(seconds=s)) for i, s in enumerate(seconds)], "id bigint, client string, ts timestamp")


def test_rejected_requests_do_not_count(spark):
    found = state.rate_limited(requests(spark, 0, 10, 20, 59.999, 60, 70), "client", "ts", "id", 3).orderBy("id").collect()
    assert [r.rejected for r in found] == [False, False, False, True, False, False]


def test_cache(spark):
    lookups = requests(spark, 0, 10, 599, 600, 601).withColumn("failed", F.col("id") == 0)
    assert [r.hit for r in state.cache_hits(lookups, "client", "ts", "id").orderBy("id").collect()] == [False, True, True, False, True]
    assert [r.hit for r in state.cache_hits(lookups, "client", "ts", "id", failed="failed").orderBy("id").collect()] == [False, False, True, True, True]


def test_guard_and_origins(spark):
    both = requests(spark, 0, 1, 2, 3)
    found = state.guarded(both, "client", "ts", "id", 3, 2).orderBy("id").collect()
    assert [r.outcome for r in found] == ["passed", "passed", "globally_limited", "client_limited"]
    asked = spark.createDataFrame([("https://example.com.evil.test", None), (None, "https://example.com/check"), (None, None)], "origin string, referer string")
    allowed = spark.createDataFrame([("https://example.com",)], "origin string")
    assert [r.referer for r in state.admitted(asked, allowed).collect()] == ["https://example.com/check"]


def test_stream(spark, tmp_path):
    requests(spark, 0, 10, 20, 59.999, 60, 70).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id bigint, client string, ts timestamp").parquet(str(tmp_path / "in"))
    query = stream_rate_limited(stream, "client", "ts", "id", 3).writeStream.format("memory").queryName("limited").outputMode("append").trigger(availableNow=True)
    query = query.option("checkpointLocation", str(tmp_path / "cp")).start()
    query.awaitTermination(120)
    assert [r.rejected for r in spark.table("limited").orderBy("ts").collect()] == [False, False, False, True, False, False]


def test_payloads(spark):
    rows = [(1, "p1", 1, "連絡先 a@example.com", "", "", False, None)]
    paragraphs = spark.createDataFrame(rows, "doc_id bigint, p_id string, idx int, text string, style_id string, style_name string, is_heading boolean, heading_level int")
    references = spark.createDataFrame([(1, "ref1", "山田 b@example.com")], "doc_id bigint, ref_id string, text string")
    with_refs = payload.ai_payloads(paragraphs, references, ("citations",)).first()
    without = payload.ai_payloads(paragraphs, references, ("writing",)).first()
    assert "example.com" not in with_refs.payload and '"ref1"' in with_refs.payload and with_refs.fits
    assert '"references":[]' in without.payload
    assert structure.sections(paragraphs).first().n_paragraphs == 1
