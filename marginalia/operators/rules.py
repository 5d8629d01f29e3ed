"""The document rules, as declarations that are compiled into a few passes.

A rule on paragraphs says what it finds in one paragraph: an array of hits. The hits of all
chosen rules are one expression, exploded once; a rank over paragraph order keeps the first n
of a rule in a document. A rule on whole documents reads counts and flags that one grouped
pass makes; rules on paragraphs may ask them too. All of it is partitioned by document once.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.functions.pii import pii_spans, possible
from marginalia.functions.references import reference_date
from marginalia.functions.text import JAPANESE, SPACE, composed, half_width_number, has_japanese, sentences, without_quotes
from marginalia.operators.structure import BODY, with_sections
from marginalia.schema import CATEGORIES, FINDING, RANGES

# The rules' patterns.
_S = f"[{SPACE}]"
SUBJECTIVE = "(私は|自分は|筆者は).{0,20}(思う|感じる)"
THINK = "と思う|と思います"
DOUBLED = r"([のにをがへで])\1(?![ぁ-ん])|、、|。。"
FULL_WIDTH = "[０-９Ａ-Ｚａ-ｚ]"
BULLET = rf"^{_S}*[・●■◆\-－]"
CAPTION_STYLE = "(?i)caption|キャプション|図表番号"
POLITE = r"(です|ます|でした|ました|ません|でしょう)(?:ね|よ)?[。！？!?」）)]*\z"
PLAIN = r"(だ|である|だった|であった|ではない|する|した|される|された|となる|となった|といえる|示す|示した|認められる|考えられる)[。！？!?」）)]*\z"
STATISTICAL = rf"(?i)尺度|適合度|信頼性係数|妥当性|因子負荷|相関係数|回帰係数|平均値|標準偏差|媒介分析|間接効果|信頼区間|RMSEA|CFI|TLI|SRMR|AIC|BIC|Cronbach|χ[²2]?|カイ二乗|CI|p{_S}*[<=>]|[bβrtrF]{_S}*(?:\([^)]*\))?{_S}*=|α{_S}*="
SCALES = "(?i)調査に用いる変数|用いる変数|採用した|尺度|下位尺度|構成概念|因子モデル|ブランド経験|ブランド態度|ロイヤルティ|適合度"
NUMERIC = rf"(?i)(?:[0-9]+(?:\.[0-9]+)?%?|[αβχ²]|b|r|p|CI|RMSEA|CFI|TLI|SRMR){_S}*[=<>]?{_S}*-?[0-9]*(?:\.[0-9]+)?"
IN_BRACKETS = "[（(][A-Za-z][^）)]{1,40}[）)]"
YEAR = "(?:19|20)[0-9]{2}"
PAUSES = "[、，,；;]"
CONNECTIVES = "ため|ので|しかし|一方|また|さらに|および|ならびに|ことから|ことにより"
PURPOSE = "目的|研究課題|研究の問い|リサーチクエスチョン|本稿の狙い|本研究の狙い|ねらい"
CONCLUSION = "結論|まとめ|おわりに|考察|終章|総合的検討|総括"
REVIEW = "先行研究|既存研究|既往研究|関連研究|レビュー|理論|概念|定義"
SURVEY = "調査|アンケート|インタビュー|質問紙|実験|観察|フィールドワーク|内容分析|ケーススタディ"
DESIGN = "(?i)調査対象|対象者|調査日|調査期間|選定理由|質問項目|分析方法|分析ソフト|使用ソフト|ソフト名|バージョン|サンプル|回答者|手続き|有効回答|回収|尺度|因子分析|回帰分析|相関分析|共分散|SPSS|Excel|R|Python|AMOS|KH Coder|jamovi|SmartPLS"
RESULT = "結果|分析結果|調査結果|検証結果"
DISCUSSION = "考察|示唆|解釈|要因|理由|比較|明らかになった|と考えられる|総合的検討|結論|まとめ"
REFLEXIVE = "オートエスノグラフィ|自己民族誌|当事者研究|ナラティブ研究|参与観察"
PERSONAL = "自分の経験|私の経験|個人的な経験|体験談|私自身|自分自身"
SOURCE_NOTE = rf"(出典|出所|筆者作成|著者作成|自作)|\((?:[^()]*,{_S}*)?(?:19|20)[0-9]{{2}}\)"
CAPTION = rf"^{_S}*(?:図|表){_S}*[0-9０-９]+"
UNDATED = rf"(?i)(?:明治|大正|昭和|平成|令和){_S}*[0-9]+年?|in press|forthcoming|印刷中|刊行予定"
VARIANTS = (
    ("行う", "行なう"), ("表す", "表わす"), ("現れる", "現われる"), ("サーバー", "サーバ"), ("コンピューター", "コンピュータ"),
    ("ユーザー", "ユーザ"), ("ブラウザー", "ブラウザ"), ("インタビュー", "インタヴュー"), ("問い合わせ", "問合せ"), ("取り組み", "取組み"),
    ("および", "及び"), ("ならびに", "並びに"), ("さらに", "更に"), ("ただし", "但し"), ("すなわち", "即ち"),
)


@dataclass(frozen=True)
class DocTables:
    """What rules read: paragraphs with their part (body or reference), and the texts of tables, if any."""

    rows: DataFrame
    tables: DataFrame | None = None

    @staticmethod
    def of(paragraphs: DataFrame, references: DataFrame | None = None, tables: DataFrame | None = None) -> DocTables:
        """From body paragraphs, lines of reference lists (doc_id, ref_id, text) and tables (doc_id, text)."""
        if "heading" not in paragraphs.columns:
            paragraphs = with_sections(paragraphs)
        rows = paragraphs.select(*_ROW, F.lit("body").alias("part"), F.lit(None).cast("string").alias("ref_id"))
        if references is not None:
            blank = {"style_id": "string", "style_name": "string", "is_heading": "boolean", "heading_level": "int", "heading": "string"}
            number = F.regexp_extract("ref_id", r"(\d+)", 1).cast("int").alias("idx")
            lines = references.select("doc_id", number, "text", *(F.lit(None).cast(kind).alias(n) for n, kind in blank.items()), F.lit("reference").alias("part"), "ref_id")
            rows = rows.unionByName(lines)
        return DocTables(rows, tables)

    @staticmethod
    def of_parts(placed: DataFrame, tables: DataFrame | None = None) -> DocTables:
        """From paragraphs with sections and parts (``structure``), read once: lines of reference lists are numbered where they lie."""
        line = (F.col("part") == "reference") & (F.trim("text") != "")
        before = Window.partitionBy("doc_id").orderBy("idx").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        numbered = placed.withColumn("ref_id", F.when(line, F.concat(F.lit("ref"), F.count_if(line).over(before))))
        return DocTables(numbered.where((F.col("part") == "body") | line).select(*_ROW, "part", "ref_id"), tables)


_ROW = ("doc_id", "idx", "text", "style_id", "style_name", "is_heading", "heading_level", "heading")
_HIT = f"struct<seq:bigint,original:string,detail:string,ranges:{RANGES}>"


@dataclass(frozen=True)
class Rule:
    """A rule of a check: ``hits`` is an array of hits, from the columns of a paragraph or, for a rule on documents, of flags.

    ``first``: how many of a document's hits count, in order of paragraphs. ``needs``: the
    flags of the document that are asked; ``asks``: what must hold of them for a hit of a
    paragraph to count. ``detail`` replaces a hit's own once they are known.
    """

    name: str
    check: str
    severity: str
    hits: Callable[[], Column]
    of_document: bool = False
    first: int | None = None
    needs: tuple[str, ...] = ()
    asks: Callable[[], Column] | None = None
    detail: Callable[[], Column] | None = None

    def __call__(self, t: DocTables) -> DataFrame:
        return compiled(t, [(0, self)]).drop("emit_order")

    @property
    def __name__(self) -> str:
        return self.name


def _hit(seq: Column | None = None, original: Column | None = None, detail: Column | None = None, ranges: Column | None = None) -> Column:
    values = {"seq": F.col("idx") if seq is None else seq, "original": F.lit(None) if original is None else original, "detail": F.lit(None) if detail is None else detail, "ranges": F.lit(None) if ranges is None else ranges}
    return F.struct(*(v.alias(n) for n, v in values.items())).cast(_HIT)


def _one(where: Column, **values: Column) -> Column:
    """A hit in the paragraph's text where the condition holds."""
    return F.when(where, F.array(_hit(**({"original": F.col("text")} | values))))


def _each(where: Column, values: Column, hit: Callable[[Column, Column], Column]) -> Column:
    """A hit for each value of an array, given with its place; values are made only where the condition holds."""
    return F.transform(F.when(where, values), hit)


def _first(rows: DataFrame, n: int, *order: str) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy(*order))
    return rows.withColumn("_rank", rank).where(F.col("_rank") <= n).drop("_rank")


def _body() -> Column:
    return (F.col("part") == "body") & (F.col("text") != "")


def _prose() -> Column:
    return _body() & ~F.col("is_heading")


def _ranges(starts: Column, width: int = 1) -> Column:
    return F.transform(starts, lambda s: F.struct(s.cast("int").alias("start"), (s + width).cast("int").alias("end")))


# -- paragraphs --------------------------------------------------------------------------


def _heading_jump() -> Column:
    levels = F.concat_ws(">", F.col("level_before").cast("string"), F.col("level").cast("string"))
    return _one(_body() & F.col("is_heading") & (F.col("level") - F.col("level_before") >= 2), detail=levels)


def _doubled() -> Column:
    hit = F.regexp_extract("text", DOUBLED, 0)
    start = F.regexp_instr("text", F.lit(DOUBLED)) - 1
    return _one(_prose() & F.col("text").rlike(DOUBLED), detail=hit, ranges=F.array(F.struct(start.cast("int").alias("start"), (start + F.length(hit)).cast("int").alias("end"))))


def _full_width() -> Column:
    places = F.filter(F.sequence(F.lit(0), F.length("text") - 1), lambda i: F.substring("text", i + 1, F.lit(1)).rlike(FULL_WIDTH))
    signs = F.array_join(F.array_distinct(F.regexp_extract_all("text", F.lit(FULL_WIDTH), F.lit(0))), "・")
    return _one(_prose() & F.col("text").rlike(FULL_WIDTH) & F.col("text").rlike("[0-9A-Za-z]"), detail=signs, ranges=_ranges(places))


def comma_places(text: Column) -> Column:
    """Starts of ASCII commas outside brackets with a Japanese character before, or after one space at most."""
    japanese = f"[{JAPANESE}ー々]"

    def sign(i: Column) -> Column:
        return F.when(i >= 1, F.substring(text, i, F.lit(1))).otherwise("")

    def step(acc: Column, i: Column) -> Column:
        here, after = sign(i), sign(i + 1)
        depth = F.when(here.isin("(", "（"), acc["depth"] + 1).when(here.isin(")", "）"), F.greatest(acc["depth"] - 1, F.lit(0))).otherwise(acc["depth"])
        follows = F.when(after == " ", sign(i + 2)).otherwise(after)
        hit = (here == ",") & (acc["depth"] == 0) & (sign(i - 1).rlike(japanese) | follows.rlike(japanese))
        return F.struct(depth.alias("depth"), F.when(hit, F.array_append(acc["hits"], i - 1)).otherwise(acc["hits"]).alias("hits"))

    start = F.struct(F.lit(0).alias("depth"), F.array().cast("array<int>").alias("hits"))
    return F.aggregate(F.sequence(F.lit(1), F.length(text)), start, step, lambda acc: acc["hits"])


def _ascii_comma() -> Column:
    likely = _prose() & F.col("text").contains(",") & F.col("text").rlike(f"[{JAPANESE}ー々]")
    found = F.filter(F.array(F.when(likely, comma_places(F.col("text")))), lambda at: F.size(at) > 0)
    return F.transform(found, lambda at: _hit(original=F.col("text"), detail=F.size(at).cast("string"), ranges=_ranges(at)))


def effective(sentence: Column) -> Column:
    """A sentence without quotations, citations with a year, and white space."""
    out = F.regexp_replace(F.regexp_replace(sentence, "「[^」]*」", ""), "『[^』]*』", "")
    out = F.regexp_replace(F.regexp_replace(out, f"（[^）]*{YEAR}[^）]*）", ""), rf"\([^)]*{YEAR}[^)]*\)", "")
    return F.regexp_replace(out, f"{_S}+", "")


def is_long(sentence: Column, core: Column) -> Column:
    """core: ``effective(sentence)``. Reports of statistics and descriptions of scales are never long."""

    def count(text: Column, pattern: str) -> Column:
        return F.regexp_count(text, F.lit(pattern))

    n, numbers, pauses = F.length(core), count(core, NUMERIC), count(core, PAUSES)
    long = (n >= 180) | ((n >= 145) & (pauses >= 4)) | ((n >= 135) & (pauses >= 3) & (count(core, CONNECTIVES) >= 2))
    statistics = core.rlike(STATISTICAL) & (numbers >= 3)
    scales = sentence.rlike(SCALES) & ((count(sentence, IN_BRACKETS) >= 2) | (count(sentence, YEAR) >= 2) | (numbers >= 2))
    return (n >= 135) & long & ~statistics & ~scales


def _in_order(at: Column) -> Column:
    return F.col("idx").cast("bigint") * 1_000_000 + at


def _long_sentence() -> Column:
    each = F.transform(sentences(F.col("text")), lambda s, at: F.struct(at.alias("at"), s.alias("text"), effective(s).alias("core")))
    long = F.filter(each, lambda x: is_long(x["text"], x["core"]))
    return _each(_prose() & (F.length("text") >= 135), long, lambda x: _hit(seq=_in_order(x["at"]), original=x["text"], detail=F.length(x["core"]).cast("string")))


def _styled() -> Column:
    """The sentences of a paragraph that end politely or plainly: at, text, kind. Either ending has hiragana."""
    style = F.concat_ws(" ", F.coalesce("style_id", F.lit("")), F.coalesce("style_name", F.lit("")))
    where = _prose() & F.col("text").rlike("[ぁ-ん]") & ~style.rlike(CAPTION_STYLE) & ~F.col("text").rlike(BULLET)

    def kind(s: Column) -> Column:
        return F.when(F.length(s) < 8, None).when(s.rlike(POLITE), "polite").when(s.rlike(PLAIN), "plain")

    each = F.transform(sentences(without_quotes(F.col("text"))), lambda s, at: F.struct(at.alias("at"), s.alias("text"), kind(s).alias("kind")))
    return F.when(where, F.filter(each, lambda x: x["kind"].isNotNull()))


def _style_mixture() -> Column:
    return F.transform("styled", lambda x: _hit(seq=_in_order(x["at"]), original=x["text"], detail=x["kind"]))


def _personal_data() -> Column:
    def hit(x: Column, at: Column) -> Column:
        return _hit(seq=_in_order(at), original=F.col("text"), detail=F.concat_ws(":", x["type"], x["value"]), ranges=F.array(F.struct(x["start"].alias("start"), x["end"].alias("end"))))

    spans = pii_spans(F.when((F.col("part") == "body"), F.col("text")))
    return _each((F.col("part") == "body") & possible(F.col("text")), spans, hit)


def _undated() -> Column:
    line = F.when(F.col("part") == "reference", F.col("text"))
    prefix = F.split(composed(line), "(?i)[「『“\"]|https?://").getItem(0)
    number = F.regexp_extract("ref_id", r"(\d+)", 1).cast("bigint")
    return _one((F.col("part") == "reference") & ~prefix.rlike(UNDATED) & (reference_date(line)["date_state"] == "missing"), seq=number)


#: Columns that rules on paragraphs ask for besides those of a row.
_COLUMNS: dict[str, Callable[[], Column]] = {
    "level": lambda: F.when(_body() & F.col("is_heading"), F.coalesce("heading_level", F.lit(1))),
    "level_before": lambda: F.last("level", ignorenulls=True).over(Window.partitionBy("doc_id", "part").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)),
    "near": lambda: F.array_join(F.collect_list(F.when(F.col("part") == "body", F.col("text"))).over(Window.partitionBy("doc_id", "part").orderBy("idx").rowsBetween(-1, 2)), "\n"),
    "styled": _styled,
}

# -- documents ---------------------------------------------------------------------------


def _occurrences(word: str, other: str) -> Column:
    """Not where the other spelling goes on."""
    return F.regexp_count("text", F.lit(f"{word}(?!{other[len(word)]})" if other.startswith(word) else word))


def _has(pattern: str, of_body: bool = False) -> Callable[[], Column]:
    """Terms may also stand in tables."""

    def flag() -> Column:
        found = F.col("text").rlike(pattern) & (F.col("part").isin("body") if of_body else F.col("part").isin("body", "table"))
        return F.coalesce(F.bool_or(found), F.lit(False))

    return flag


def _captions() -> Column:
    without = (F.col("part") == "body") & F.col("text").rlike(CAPTION) & ~F.col("near").rlike(SOURCE_NOTE)
    return F.slice(F.array_sort(F.collect_list(F.when(without, F.struct("idx", "text")))), 1, 3)


_TABLE_IDX = 1 << 30


def _marks() -> Column:
    """What numbers of figures and tables can stand in, by place: a number may follow its sign on the next line, or after empty ones."""
    may = F.col("part").isin("body", "table") & F.col("text").rlike(rf"図|表|^{_S}*(?:[-－.．0-9０-９]|\z)")
    return F.array_sort(F.collect_list(F.when(may, F.struct("idx", "text"))))


def _kind_count(kind: str) -> Callable[[], Column]:
    return lambda: F.coalesce(F.sum(F.size(F.filter(F.coalesce("styled", F.array().cast("array<struct<at:int,text:string,kind:string>>")), lambda x: x["kind"] == kind))), F.lit(0))


_FLAGS: dict[str, Callable[[], Column]] = {
    "n_body": lambda: F.count_if(F.col("part") == "body"),
    "n_filled": lambda: F.count_if(_body()),
    "n_headings": lambda: F.count_if(_body() & F.coalesce("is_heading", F.lit(False))),
    "n_bullets": lambda: F.count_if(_prose() & F.col("text").rlike(BULLET)),
    "n_references": lambda: F.count_if(F.col("part") == "reference"),
    "purpose": _has(PURPOSE, True),
    "conclusion": _has(CONCLUSION, True),
    "survey": _has(SURVEY),
    "review": _has(REVIEW),
    "design": _has(DESIGN),
    "result": _has(RESULT),
    "discussion": _has(DISCUSSION),
    "reflexive": _has(REFLEXIVE),
    "captions": _captions,
    "marks": _marks,
    "marked": _has("図|表"),
    "last_idx": lambda: F.max(F.when(F.col("part") == "body", F.col("idx"))),
    "polite": _kind_count("polite"),
    "plain": _kind_count("plain"),
    "spellings": lambda: F.array(
        *(
            F.struct(F.sum(F.when(own, _occurrences(a, b))).alias("n"), F.sum(F.when(own, _occurrences(b, a))).alias("m"))
            for own in ((F.col("part") == "body") & has_japanese(F.col("text")),)
            for a, b in VARIANTS
        )
    ),
}
#: Columns of paragraphs that flags read.
_READ = {"captions": ("near",), "polite": ("styled",), "plain": ("styled",)}


def _of_document(condition: str, detail: str = "null") -> Callable[[], Column]:
    return lambda: F.when(F.expr(condition), F.array(_hit(seq=F.lit(0), detail=F.expr(f"cast({detail} as string)"))))


def _spelling_variant() -> Column:
    pairs = F.arrays_zip(F.array(*(F.struct(F.lit(i).alias("at"), F.lit(a).alias("a"), F.lit(b).alias("b")) for i, (a, b) in enumerate(VARIANTS))).alias("w"), F.col("spellings").alias("c"))
    both = F.slice(F.filter(pairs, lambda p: (p["c"]["n"] > 0) & (p["c"]["m"] > 0)), 1, 5)
    return F.transform(both, lambda p: _hit(seq=p["w"]["at"], detail=F.format_string("%s:%d %s:%d", p["w"]["a"], p["c"]["n"], p["w"]["b"], p["c"]["m"])))


def _caption_source() -> Column:
    text = F.array_join(F.transform("captions", lambda x: x["text"]), "\n")
    return F.when(F.size("captions") > 0, F.array(_hit(seq=F.lit(0), original=text)))


def _gap_hit(at: int, kind: str) -> Callable[[Column], Column]:
    return lambda gaps: _hit(seq=F.lit(at), detail=F.concat(F.lit(kind), F.array_join(gaps.cast("array<string>"), ",")))


def _missing_number() -> Column:
    place = F.transform("marks", lambda x: F.when(x["idx"] == _TABLE_IDX, F.coalesce("last_idx", F.lit(0)) + 1).otherwise(x["idx"]))
    text = F.array_join(F.transform("marks", lambda x, i: F.when((i > 0) & (F.get(place, i) - F.get(place, i - 1) > 1), F.concat(F.lit("\0\n"), x["text"])).otherwise(x["text"])), "\n")
    out = []
    for at, kind in enumerate("図表"):
        numbers = F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(f"{kind}{_S}*([0-9０-９]+)"), F.lit(1)), half_width_number))
        plain = F.col("marked") & ~text.rlike(f"{kind}{_S}*[0-9０-９]+{_S}*[-－.．][0-9０-９]")
        some = F.filter(F.array(F.when(plain, numbers)), lambda n: F.size(n) >= 2)
        gaps = F.filter(F.transform(some, lambda n: F.array_except(F.sequence(F.lit(1), F.array_max(n)), n)), lambda g: F.size(g).between(1, 5))
        out.append(F.transform(gaps, _gap_hit(at, kind)))
    return F.concat(*out)


# -- declarations ------------------------------------------------------------------------

no_headings = Rule("no_headings", "format", "important", _of_document("n_filled >= 5 and n_headings = 0", "n_filled"), True, needs=("n_filled", "n_headings"))
heading_jumps = Rule("heading_jump", "format", "warning", _heading_jump, first=3)
subjective = Rule("subjective", "writing", "warning", lambda: _one(_prose() & without_quotes(F.col("text")).rlike(SUBJECTIVE)))
thinking = Rule("thinking", "writing", "warning", lambda: _one(_prose() & without_quotes(F.col("text")).rlike(THINK)))
doubled = Rule("doubled", "writing", "warning", _doubled, first=5)
full_width = Rule("full_width", "writing", "info", _full_width, first=3)
ascii_commas = Rule("ascii_comma", "writing", "info", _ascii_comma, first=3)
long_sentences = Rule("long_sentence", "writing", "warning", _long_sentence)
style_mixture = Rule(
    "style_mixture", "writing", "warning", _style_mixture, first=5, needs=("polite", "plain"),
    asks=lambda: (F.col("polite") >= 3) & (F.col("plain") >= 3) & (F.col("h.detail") == F.when(F.col("polite") <= F.col("plain"), "polite").otherwise("plain")),
    detail=lambda: F.concat_ws("/", F.col("polite").cast("string"), F.col("plain").cast("string")),
)
spelling_variants = Rule("spelling_variant", "writing", "info", _spelling_variant, True, needs=("spellings",))
no_purpose = Rule("no_purpose", "logic", "important", _of_document("n_body > 0 and not purpose"), True, needs=("n_body", "purpose"))
no_conclusion = Rule("no_conclusion", "logic", "warning", _of_document("n_body > 0 and not conclusion"), True, needs=("n_body", "conclusion"))
caption_sources = Rule("caption_source", "figures", "info", _caption_source, True, needs=("captions",))
missing_numbers = Rule("missing_number", "figures", "warning", _missing_number, True, needs=("marks", "marked", "last_idx"))
no_references = Rule("no_references", "citations", "important", _of_document("n_body > 0 and n_references = 0"), True, needs=("n_body", "n_references"))
undated_references = Rule("undated_reference", "citations", "warning", _undated)
personal_data = Rule("personal_data", "ethics", "important", _personal_data)
no_prior_research = Rule("no_prior_research", "completion", "info", _of_document("survey and not review"), True, needs=("survey", "review"))
# the terms of a design hold a bare letter r, as they always did: any Latin r satisfies them
no_design = Rule("no_design", "completion", "info", _of_document("survey and not design"), True, needs=("survey", "design"))
bullets = Rule("bullets", "completion", "info", _of_document("n_bullets >= 3", "n_bullets"), True, needs=("n_bullets",))
personal_experience = Rule("personal_experience", "completion", "info", lambda: _one(_prose() & F.col("text").rlike(PERSONAL)), first=1, needs=("reflexive",), asks=lambda: ~F.col("reflexive"))
no_discussion = Rule("no_discussion", "completion", "info", _of_document("result and not discussion"), True, needs=("result", "discussion"))

#: The checks, in the order in which they are offered, and their rules: declared ones, or functions from tables to findings.
CHECKS: dict[str, tuple[Rule | Callable[[DocTables], DataFrame], ...]] = {
    "format": (no_headings, heading_jumps),
    "writing": (subjective, thinking, doubled, full_width, ascii_commas, long_sentences, style_mixture, spelling_variants),
    "logic": (no_purpose, no_conclusion),
    "figures": (caption_sources, missing_numbers),
    "citations": (no_references, undated_references),
    "ethics": (personal_data,),
    "completion": (no_prior_research, no_design, bullets, personal_experience, no_discussion),
}
_DECLARED = {rule.name: rule for of_check in CHECKS.values() for rule in of_check}


def register(check: str, rule: Rule | Callable[[DocTables], DataFrame]) -> None:
    """Adds a rule of one's own to a check, or a check with its first rule."""
    CHECKS[check] = (*CHECKS.get(check, ()), rule)
    CATEGORIES.setdefault(check, check)


# -- compiling ---------------------------------------------------------------------------


def _with_columns(rows: DataFrame, names: set[str]) -> DataFrame:
    if "level_before" in names:
        names = names | {"level"}
    for name, column in _COLUMNS.items():
        if name in names:
            rows = rows.withColumn(name, column())
    return rows


def document_flags(t: DocTables, names: set[str]) -> DataFrame:
    """doc_id and the named flags, from one pass over paragraphs and tables."""
    rows = _with_columns(t.rows, {c for n in names for c in _READ.get(n, ())})
    if t.tables is not None:
        rows = rows.unionByName(t.tables.select("doc_id", "text", F.lit("table").alias("part"), F.lit(_TABLE_IDX).alias("idx")), allowMissingColumns=True)
    return rows.groupBy("doc_id").agg(*(_FLAGS[n]().alias(n) for n in sorted(names)))


def _numbered(chosen: list[tuple[int, Rule]]) -> Column:
    """The hits of all rules as one array, each with its rule's number."""
    none = F.array().cast(f"array<struct<no:int,h:{_HIT}>>")

    def numbered(at: int) -> Callable[[Column], Column]:
        return lambda h: F.struct(F.lit(at).alias("no"), h.alias("h"))

    return F.concat(none, *(F.coalesce(F.transform(rule.hits(), numbered(at)), none) for at, rule in chosen))


def _told(hits: DataFrame, chosen: list[tuple[int, Rule]], local: bool) -> DataFrame:
    """Findings from hits (doc_id, no, h and, for paragraphs, part, idx, heading, ref_id)."""
    names = {at: {"rule": rule.name, "category": CATEGORIES[rule.check], "severity": rule.severity} for at, rule in chosen}

    def said(column: str) -> Column:
        return F.element_at(F.create_map(*(F.lit(x) for at, values in names.items() for x in (at, values[column]))), F.col("no"))

    place = F.concat(F.lit("本文 "), F.col("idx"), F.lit("段落")) if local else F.lit("文書全体")
    if local:
        place = F.when(F.col("part") == "reference", F.col("ref_id")).when(F.col("heading") == BODY, place).otherwise(F.concat(F.col("heading"), F.lit(" ＞ "), place))
    paragraph = F.when(F.col("part") == "body", F.col("idx")) if local else F.lit(None).cast("int")
    values = {c: said(c) for c in ("rule", "category", "severity")} | {"p_idx": paragraph, "location": place, "original": F.col("h.original"), "detail": F.col("h.detail"), "ranges": F.col("h.ranges"), "seq": F.col("h.seq")}
    return hits.select("doc_id", *(values[c].alias(c) for c in FINDING[1:]), F.col("no").alias("emit_order"))


def compiled(t: DocTables, chosen: list[tuple[int, Rule]]) -> DataFrame:
    """Findings of declared rules, each given with its emit_order."""
    of_paragraphs = [(at, rule) for at, rule in chosen if not rule.of_document]
    of_documents = [(at, rule) for at, rule in chosen if rule.of_document]
    out = []
    if of_paragraphs:
        asked = {"level_before"} if heading_jumps in [r for _, r in of_paragraphs] else set()
        asked |= {"styled"} if style_mixture in [r for _, r in of_paragraphs] else set()
        found = _with_columns(t.rows, asked).withColumn("f", F.explode(_numbered(of_paragraphs)))
        found = found.select("doc_id", "part", "idx", "heading", "ref_id", "f.no", "f.h")
        if needs := {n for _, rule in of_paragraphs for n in rule.needs}:
            found = found.join(document_flags(t, needs), "doc_id")
        for at, rule in of_paragraphs:
            if rule.asks is not None:
                found = found.where((F.col("no") != at) | rule.asks())
            if rule.detail is not None:
                found = found.withColumn("h", F.when(F.col("no") == at, F.col("h").withField("detail", rule.detail())).otherwise(F.col("h")))
        limits = {at: rule.first for at, rule in of_paragraphs if rule.first}
        if limits:
            most = reduce(lambda rest, x: F.when(F.col("no") == x[0], x[1]).otherwise(rest), limits.items(), F.lit(None).cast("int"))
            rank = F.row_number().over(Window.partitionBy("doc_id", "no").orderBy("h.seq"))
            found = found.withColumn("_rank", rank).where(F.coalesce(F.col("_rank") <= most, F.lit(True)))
        out.append(_told(found, of_paragraphs, True))
    if of_documents:
        flags = document_flags(t, {n for _, rule in of_documents for n in rule.needs})
        out.append(_told(flags.select("doc_id", F.explode(_numbered(of_documents)).alias("f")).select("doc_id", "f.no", "f.h"), of_documents, False))
    return reduce(DataFrame.unionByName, out)


def document_findings(t: DocTables, chosen: dict[str, int]) -> DataFrame:
    """Findings of the named rules with the emit_order that is given for each."""
    return compiled(t, [(at, _DECLARED[name]) for name, at in chosen.items()])


def run_checks(t: DocTables, checks: list[str] | None = None) -> DataFrame:
    """Findings of the chosen checks; unknown names give none. finding_id is a hash, emit_order follows the choice."""
    chosen = [rule for name in (list(CHECKS) if checks is None else checks) for rule in CHECKS.get(name, ())]
    declared = [(at, rule) for at, rule in enumerate(chosen) if isinstance(rule, Rule)]
    parts = [compiled(t, declared)] if declared else []
    parts += [rule(t).withColumn("emit_order", F.lit(at)) for at, rule in enumerate(chosen) if not isinstance(rule, Rule)]
    if not parts:
        parts = [compiled(t, [(0, no_purpose)]).where("false")]
    key = F.sha2(F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("doc_id", "rule", "p_idx", "seq", "detail", "original"))), 256)
    return reduce(DataFrame.unionByName, parts).withColumn("finding_id", key)
