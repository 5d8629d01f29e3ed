"""A small corpus of theses and references, for rules that plain Latin texts never meet."""

from __future__ import annotations

import io
import zipfile
from xml.sax.saxutils import escape, quoteattr

from pyspark.sql import DataFrame, SparkSession

from marginalia.schema import PARAGRAPHS

_B, _H1, _H2, _H3, _H4 = (("", "", False, None), *(("Heading", f"heading {n}", True, n) for n in (1, 2, 3, 4)))

_LONG = "調査の対象となった店舗では、" + "利用者が商品を選ぶまでの過程を観察し、その理由を聞き取り、" * 6 + "しかし結論を急がず、また一方で比較を続けた。"

#: doc_id -> (style, text) in order.
_DOCUMENTS: dict[int, list[tuple]] = {
    1: [
        (_B, "経済学部 卒業論文"), (_H1, "はじめに"), (_B, "本研究の目的は、地域の店舗で行なう調査を通して購買の理由を明らかにすることである。"),
        (_H3, "先行研究の整理"), (_B, "先行研究では,顧客の経験が重視される。筆者は参加者の姿を見て正しいと感じる。"), (_H1, "方法"),
        (_B, "アンケートを行う。サーバーとサーバの両方を使い、４つの項目を4回測った。"), (_B, _LONG), (_H4, "詳細"),
        (_B, "・一つ目の項目"), (_B, "・二つ目の項目"), (_B, "・三つ目の項目"), (_B, "図1 概念モデル"), (_B, "出典：筆者作成"), (_B, "図3 結果の分布"),
        (_B, "表2 回答者の内訳を示す"), (_B, "説明をを加える。"), (_B, "連絡先は taro@example.com と 03-1234-5678 である。"),
        (_H1, "参考文献"), (_B, "山田（2020）「店舗の経験」『商学』, 12, 1-9."), (_B, ""), (_B, "鈴木「顧客の声」 https://example.com/a (2024年1月14日確認)"), (_B, "謝辞"), (_B, "多くの方に感謝します。"),
    ],
    2: [
        (_B, "この文章は丁寧に書きます。次の文も丁寧に書きました。三つ目の文も丁寧です。"), (_B, "この文は断定の形である。次の文も断定の形とされた。最後の文も同じ形を示した。四つ目の文も断定である。"),
        (_B, "参加者は「重要だと思う」と回答した。私の経験では違った。"), (_B, "私は全体として正しいと思う。"), (_B, "学籍番号 20250101 の調査日は 20250101 である。"), (_B, "図1-2 図3 の結果を示す。"),
    ],
    3: [(_B, "短い文。"), (_B, "価格は,高い(Brakus, 2008)。A, 日本、A, B。"), (_B, "結果を述べる。。"), (_B, "表１ 表３ 表4 を見る。"), (_B, "及びと、および。")],
    4: [(_H1, "序論"), (_B, ""), (_H2, "背景"), (_B, "実験の結果をまとめる。"), (_H4, "細目"), (_B, "appendix の話"), (_H1, "References"), (_B, "Smith, J. (2019). A study of things. Journal of Things, 4(2), 10-20."), (_B, "付録A 調査票"), (_B, "質問の一覧")],
}

#: ref_id, text
REFERENCES: list[tuple[str, str]] = [
    ("r01", "林・西岡（2020）「山間地域の図書室における学習支援の試みと利用者への新たな「場づくり」」『架空大学教養論叢』, 74, 109-117."),
    ("r02", "別人（2020）「山間地域の図書室における学習支援の試みと利用者への新たな「場づくり」」『架空大学教養論叢』, 74, 109-117."),
    ("r03", "林・西岡（2019）「山間地域の図書室における学習支援の試みと利用者への新たな「場づくり」」『架空大学教養論叢』, 74, 109-117."),
    ("r04", "Author (2020) Article of record. https://doi.org/10.1234/test"),
    ("r05", "企業HP（n.d.）「事業紹介」 https://example.com/2016 (2026年1月14日確認)"),
    ("r06", "企業HP（2016b）「事業紹介」 (2026年確認)"),
    ("r07", "Smith, J. (2019). A study of many things. Journal of Things, 4(2), 10-20."),
    ("r08", "Doe, A. (2001). Another vs. other matters. Some Publisher."),
    ("r09", "佐藤（2018）『経営の考え方』中央出版."),
    ("r10", "環境局（2021）「環境白書」 https://example.org/report.pdf 閲覧"),
]

#: cand_id, provider, doi, title, authors, journal, year, year_candidates, url
CANDIDATES: list[tuple] = [
    (1, "CiNii Research", None, "山間地域の図書室における学習支援の試みと利用者への新たな「場づくり」", "林 亜紀, 西岡 透", "架空大學教養論叢 = The Imaginary University", "2020", ["2020"], None),
    (2, "Crossref", "10.1234/TEST", "Article of record", "Author Ann", "Records", "2020", ["2020", "2021"], None),
    (3, "Crossref", None, "A study of many things: with a subtitle", "Smith John", "Journal of Things", "2019", ["2019"], None),
    (4, "CiNii Research", None, "A study of many things", "Smith John", "Journal of Things", "2019", ["2019"], None),
    (5, "Crossref", None, "Another matter", "Roe", "Other", "2001", ["2001"], None),
    (6, "CiNii Research", None, "経営の考え方", "佐藤 一郎", None, "2017", ["2017"], None),
]


def rows() -> list[tuple]:
    return [(d, f"p{i}", i, text, s[0], s[1], s[2], s[3]) for d, ps in _DOCUMENTS.items() for i, (s, text) in enumerate(ps, 1)]


def paragraphs(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(rows(), PARAGRAPHS)


_W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def _word_file(paragraphs_of: list[tuple]) -> bytes:
    """A Word file with these (style, text); tabs and line ends become the elements that stand for them."""

    def run(text: str) -> str:
        inner = escape(text).replace("\t", "</w:t><w:tab/><w:t>").replace("\n", "</w:t><w:br/><w:t>")
        return f'<w:r><w:t xml:space="preserve">{inner}</w:t></w:r>'

    body = "".join(f"<w:p>{f'<w:pPr><w:pStyle w:val={quoteattr(s[1])}/></w:pPr>' if s[1] else ''}{run(text)}</w:p>" for s, text in paragraphs_of)
    styles = "".join(f"<w:style w:styleId={quoteattr(n)}><w:name w:val={quoteattr(n)}/></w:style>" for n in sorted({s[1] for s, _ in paragraphs_of if s[1]}))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        table = f"<w:tbl><w:tr><w:tc><w:p>{run('左')}</w:p></w:tc><w:tc><w:p>{run('右')}</w:p></w:tc></w:tr></w:tbl>"
        z.writestr("word/document.xml", f"<w:document {_W}><w:body>{body}{table}<w:sectPr/></w:body></w:document>")
        z.writestr("word/styles.xml", f"<w:styles {_W}>{styles}</w:styles>")
        z.writestr("word/footnotes.xml", f'<w:footnotes {_W}><w:footnote w:type="separator" w:id="0"/><w:footnote w:id="3"><w:p>{run("注記")}</w:p></w:footnote></w:footnotes>')
    return out.getvalue()


def word_files(spark: SparkSession) -> DataFrame:
    """The documents as Word files, each with a table and a footnote, and a file that is none."""
    files = [(f"{d}.docx", bytearray(_word_file(ps))) for d, ps in _DOCUMENTS.items()]
    return spark.createDataFrame([*files, ("broken.docx", bytearray(b"no zip"))], "path string, content binary")


def references(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(REFERENCES, "ref_id string, text string")


def candidates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CANDIDATES, "cand_id bigint, provider string, doi string, title string, authors string, journal string, year string, year_candidates array<string>, url string")


def _literal(x) -> str:
    if x is None:
        return "NULL"
    if isinstance(x, bool):
        return str(x).lower()
    if isinstance(x, list):
        return "[" + ", ".join(map(_literal, x)) + "]"
    return str(x) if isinstance(x, (int, float)) else "'" + x.replace("'", "''") + "'"


def values_sql(name: str, columns: str, values: list[tuple]) -> str:
    """A common table expression with these rows."""
    return f"{name}({columns}) AS (VALUES " + ", ".join("(" + ", ".join(map(_literal, r)) + ")" for r in values) + ")"


def corpus_sql() -> str:
    return values_sql("corpus", "doc_id, p_id, idx, text, style_id, style_name, is_heading, heading_level", rows())
