"""What findings tell the writer: titles, suggestions and reasons, by rule or by the status of a lookup.

The texts are a small dictionary that is joined by broadcast; numbered places in them take
the parts of a finding's detail.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.schema import CATEGORIES

# Rule, title, original where the finding has none, suggestion, reason.
RULE_TEXTS = (
    ("no_headings", "見出しスタイルが見つかりません", "見出し1・見出し2として認識された段落がありません。", "章・節タイトルにWordの見出しスタイルを設定してください。", "見出しスタイルは目次生成や文書構造の確認に必要です。"),
    ("heading_jump", "見出しレベルの飛び（見出し{0} → 見出し{1}）", None, "直前の見出しレベル{0}から見出し{1}へ飛んでいます。間のレベルを使うか、見出しスタイルの設定を確認してください。", "見出しレベルが飛ぶと、目次の階層や章・節の構造が崩れて見えます。"),
    ("subjective", "主観的な表現", None, "根拠から導かれる客観的な表現へ変更してください。", "論文では個人的な感想ではなく、資料や分析結果に基づいて記述します。"),
    ("thinking", "「思う」の使用", None, "「考えられる」「示唆される」など、根拠に応じた表現を検討してください。", "「思う」は感想として読まれやすい表現です。"),
    ("doubled", "助詞・句読点の重複の可能性（「{0}」）", None, "「{0}」の前後を読み直し、書き損じであれば削除してください。", "編集の途中で助詞や句読点が二重に残ることがよくあります。意図的な表記であれば無視してください。"),
    ("full_width", "全角英数字を確認（「{0}」を赤色で表示）", None, "赤く表示した全角英数字を確認してください。日本語の語句として意図的に全角数字を使っている場合は、そのままで問題ありません。", "同じ段落内に半角英数字もある場合だけ表示しています。全角・半角の混在自体を誤りと断定する指摘ではありません。"),
    ("ascii_comma", "日本語文中の半角カンマを確認（{0}か所・赤色で表示）", None, "日本語の文章中の読点は、全角の「，」または「、」へ統一してください（どちらにするかは研究室・提出先の指定に従ってください）。（ ）内の出典表記（例：(Brakus, 2008)）やURL内の半角カンマはそのままで問題ありません。", "赤く表示した箇所が該当する半角カンマです。（ ）内の出典表記は検出対象から除外しています。教員コメントでは、日本語本文中のカンマを全角に統一する指摘が複数見られました。"),
    ("long_sentence", "一文の構造が複雑な可能性", None, "引用表記や直接引用は保ったまま、主張・根拠・補足を分けられるか確認してください。", "引用部分と（筆者，年）の表記を除いた長さに加え、読点や接続表現が多い文だけを抽出しています。尺度説明や適合度指標など、数値・統計記号を伴う報告文は原則として除外します。長いこと自体が誤りではありません。"),
    ("style_mixture", "文体の混在（です・ます／である）", None, "文書内で「です・ます調」{0}文と「である調」{1}文が混在しています。研究室の指定に合わせてどちらかへ統一してください。", "少数派の{2}の文を最大5件表示しています。どちらかに統一されている場合、この指摘は表示されません。"),
    ("spelling_variant", "表記ゆれ：「{0}」と「{2}」", "「{0}」{1}回、「{2}」{3}回が同じ文書内で使われています。", "どちらかの表記に統一してください。WordのCtrl+Hですべて置換できます。", "同じ語の表記が揺れていると、推敲不足の印象を与えます。どちらが正しいかは研究室の指定に従ってください。"),
    ("no_purpose", "研究目的を確認できません", "「目的」「研究課題」などの記述が検出されませんでした。", "序論で研究目的または研究上の問いを明確にしてください。", "研究目的は分析・考察・結論を結び付ける基準になります。"),
    ("no_conclusion", "結論・考察の構成を要確認", "結論や考察に該当する語を検出できませんでした。", "研究目的への回答を示す章・節があるか確認してください。", "研究目的と結論の対応を学生自身が確認する必要があります。"),
    ("no_prior_research", "先行研究から調査へつながっているか確認", "調査・分析に関する語は見つかりましたが、先行研究や概念整理の語が少ない可能性があります。", "調査に入る前に、既存研究で何が分かっていて、何が不足しているため自分の調査が必要なのかを説明してください。", "教員コメントでは、レビューを踏まえて調査目的や方法を位置づける修正が多く見られました。"),
    ("no_design", "調査設計の具体性を確認", "調査や分析への言及があります。", "調査対象、選定理由、調査日・期間、質問項目、分析方法、使用ソフトなどを方法の章で説明しているか確認してください。", "初稿へのコメントでは、結果だけでなく調査設計を具体的に書くよう求める指摘が目立ちました。"),
    ("bullets", "箇条書きの使い方を確認", "箇条書きのような段落を{0}件検出しました。", "方法、結果、考察の本文では、必要に応じて箇条書きを文章に直し、前後の説明を補ってください。チェックリストや質問項目として必要な箇条書きは残してかまいません。", "教員コメントでは、メモ的な箇条書きを論文本文の説明文へ整える指摘が繰り返し見られました。"),
    ("personal_experience", "個人的経験が根拠になっていないか確認", None, "個人的な経験は研究動機として整理し、主張の根拠には資料・データ・先行研究・調査結果を示してください。", "教員コメントでは、個人的エピソードを根拠として使わず、確認できる資料へ置き換える指摘がありました。"),
    ("no_discussion", "結果を解釈・考察まで進めているか確認", "結果や分析結果への言及があります。", "結果を示すだけで終わらず、なぜその結果になったのか、先行研究と比べて何が言えるのか、研究目的にどう答えるのかを書いてください。", "教員コメントでは、結果の説明から考察・示唆へつなげる修正が複数見られました。"),
    ("missing_number", "{0}番号に欠番の可能性（{1}）", None, "{1}が本文で参照されていません。番号の振り直し忘れ、または{0}の削除に伴う参照の消し忘れがないか確認してください。", "{0}番号は1から順に連続させるのが原則です。意図的な構成であれば無視してください。"),
    ("caption_source", "図表の出典・自作表記を確認", None, "表示した図表について、出典、自作・筆者作成、加工の有無をキャプション付近に示しているか確認してください。", "図表番号で始まる段落と、その前後の段落だけを確認しています。図中に出典を記載している場合は無視してください。"),
    ("no_references", "参考文献一覧を認識できません", "「参考文献」などの見出し以降に文献情報が見つかりませんでした。", "参考文献一覧の見出しと記載位置を確認してください。", "本文中の引用と参考文献一覧を照合するために必要です。"),
    ("undated_reference", "発行年が不足している可能性", None, "発行年、不明の場合は指定形式の「n.d.」が必要か確認してください。", "文献の特定と引用形式の統一に必要です。"),
    ("personal_data", "{0}の可能性", None, "匿名化、削除、または掲載同意の有無を確認してください。", "AIへ送信する場合、この値は自動的にマスクする対象です。"),
)
POLITE_LABEL, PLAIN_LABEL = "です・ます調", "である調"

# Outcome of a lookup, severity, title, suggestion, reason.
LOOKUP_TEXTS = (
    ("source_verified", "info", "{source}の書誌情報が一致しました", "題名・作成者／発行元・公開／発行年の3項目を原典と照合しました。{advice}", "{compared}"),
    ("source_partial", "info", "{source}の書誌情報を一部確認しました", "取得できた項目を下に表示しています。「要確認」の項目を原典で確認してください。{advice}", "{compared}"),
    ("source_mismatch", "warning", "{source}の書誌情報に差異があります", "下の比較で「差異あり」の項目を原典で確認してください。{advice}", "{compared}"),
    ("source_unavailable", "info", "{source}の原典を自動取得できませんでした", "「原典を開く」から、題名・作成者（団体）・公開／発行年を確認してください。", "{error}資料が存在しないという判定ではありません。"),
    ("manual_report", "info", "Web上の報告書・PDFは原典で確認してください", "「原典を開く」から、資料名・作成者（団体）・公開年・URL・閲覧日を確認してください。閲覧年と公開年は区別して記載してください。", "企業サイトやWeb上の報告書は、論文データベースの照合対象と区別しています。リンクの接続や内容の一致を自動確認した結果ではありません。"),
    ("manual_web", "info", "Web資料は原典サイトで確認してください", "「原典を開く」から、資料名・作成者（団体）・公開年・URL・閲覧日を確認してください。閲覧年と公開年は区別して記載してください。", "企業サイトやWeb上の報告書は、論文データベースの照合対象と区別しています。リンクの接続や内容の一致を自動確認した結果ではありません。"),
    ("lookup_incomplete", "info", "書誌データベースの照合を一部または全部実行できませんでした", "時間をおいて再実行するか、原典や検索リンクで確認してください。", "{providers}への照会が完了していません。文献が見つからないという判定ではありません。"),
    ("mismatch", "warning", "書誌情報に差異があります", "{differences}", "{provider}の候補と照合しました。記載順は判定せず、値が異なる項目だけを表示しています。データベース側が別の版・別の文献の可能性もあるため、「原典候補」リンクの内容も確認してください。"),
    ("doi_unconfirmed", "warning", "DOIを確認できませんでした", "DOIの文字列に入力ミスがないか確認し、DOIリンクまたは原典ページを開いてください。", "記載されたDOIと完全一致する文献をCrossrefまたはCiNii Researchで確認できませんでした。データベース側の一時的な問題もあるため、誤りとは断定しません。"),
    ("forbidden", "info", "この入口からの書誌照合は許可されていません", "照合サービスの許可設定を管理者に確認してください。ほかのチェックの結果はそのまま利用できます。", "照合の要求が許可されなかったため、文献の有無は判定していません。"),
    ("unreachable", "info", "書誌データベースへ接続できませんでした", "時間をおいて再実行するか、CiNii Researchで手動確認してください。", "通信が完了しなかったため、文献の有無は判定していません。"),
    ("book", "info", "書籍の書誌情報を確定できませんでした", "書籍はCiNiiの横断検索でも書誌情報を確定できない場合があります。出版社ページや図書館の蔵書検索で確認してください。", "文献が存在しない、または記載が誤っているという判定ではありません。書籍と判定した文献は照合結果を警告として表示しません。"),
    ("unsettled", "info", "自動照合で一致候補を確定できませんでした", "表記の誤りがないか確認し、CiNii ResearchまたはGoogle Scholarの検索結果を手動で確認してください。検索語を短くすると見つかる場合があります。", "CrossrefとCiNii Researchの候補からは十分に確実な一致を選べませんでした。文献が存在しないという判定ではありません。"),
)
SOURCE_ERRORS = {
    "blocked_url": "自動取得できる公開URLの条件を満たしていません。",
    "timeout": "原典の取得に時間がかかり、通信を終了しました。",
    "too_large": "自動取得のサイズ上限を超えています。",
    "unsupported_format": "HTML・PDFとして読み取れない形式でした。",
    "redirect_failed": "転送先の取得を完了できませんでした。",
    "parse_failed": "資料の文字情報を読み取れませんでした。",
    "access_restricted": "原典サイトの自動取得制限により、ページ情報を確認できませんでした。",
    "http_404": "記載されたURLではページが見つかりませんでした（404）。",
    "http_403": "原典サイトが自動取得を拒否しました（403）。",
    "http_401": "原典サイトの認証が必要です（401）。",
}
OTHER_ERROR = "原典への接続または読み取りを完了できませんでした。"
NO_YEAR = "公開・発行年は取得できませんでした。原典に年の記載がない場合は n.d. とし、閲覧日は別に記載してください。著作権年や閲覧年を公開年に置き換えないでください。"
NO_DATE = "原典の公開／発行年の記載を参考文献に反映してください。閲覧日は別に記載してください。"
DATED = "閲覧日と引用形式は、提出先の指定に合わせて確認してください。"
COMPARED = "記載URLの原典から取得した情報との比較です。内容の正しさや引用の妥当性は判定していません。"
REPORT_SOURCE, WEB_SOURCE = "報告書・PDF", "Web資料"
PROVIDED, LOOKED_UP, NOTHING = "記載", "照合先", "なし"
UNAVAILABLE = (
    "参考文献一覧", "この公開環境では書誌照合を利用できません", "{0}件の参考文献を読み取りました。",
    "照合サービスが見つからないため、照合を中止しました。照合サービスのある環境で再実行するか、CiNii ResearchやGoogle Scholarで手動確認してください。",
    "照合サービスのない環境では書誌照合を利用できません。基本チェックの結果には影響しません。",
)

LOOKUP_RESULT = (
    "ref_id string, text string, status string, reference_type string, source_error string, date_state string, source_year string, "
    "comparisons array<struct<field:string,state:string>>, notes array<string>, provider string, provider_errors array<string>, "
    "differences array<struct<field:string,provided:string,database:string>>, book_like boolean"
)


def _filled(text: Column, values: dict[str, Column]) -> Column:
    for name, value in values.items():
        text = F.replace(text, F.lit(f"{{{name}}}"), F.coalesce(value, F.lit("")))
    return text


def _detail_parts() -> Column:
    """The parts of a finding's detail that its texts name by number."""
    d, rule = F.coalesce("detail", F.lit("")), F.col("rule")
    counts = F.split(d, "/")
    minority = F.when(F.get(counts, F.lit(0)).try_cast("int") <= F.get(counts, F.lit(1)).try_cast("int"), POLITE_LABEL).otherwise(PLAIN_LABEL)
    kind = F.left(d, F.lit(1))
    numbers = F.array_join(F.transform(F.split(F.substring(d, F.lit(2), F.length(d)), ","), lambda n: F.concat(kind, n)), "・")
    return (
        F.when(rule == "heading_jump", F.split(d, ">"))
        .when(rule == "style_mixture", F.array_append(counts, minority))
        .when(rule == "spelling_variant", F.split(d, "[: ]"))
        .when(rule == "missing_number", F.array(kind, numbers))
        .when(rule == "personal_data", F.split(d, ":", 2))
        .otherwise(F.array(d))
    )


def with_texts(findings: DataFrame) -> DataFrame:
    """Adds title, suggestion and reason; original is filled where the rule has a text for it. Rules without texts keep nulls."""
    spark = findings.sparkSession
    texts = spark.createDataFrame(list(RULE_TEXTS), "rule string, title string, _original string, suggestion string, reason string")
    joined = findings.join(F.broadcast(texts), "rule", "left").withColumn("_parts", _detail_parts())  # one row for each rule
    parts = {str(i): F.get("_parts", F.lit(i)) for i in range(4)}
    value = F.substring_index(F.col("detail"), ":", -1)
    original = F.when(F.col("rule") == "personal_data", value).otherwise(F.coalesce("original", _filled(F.col("_original"), parts)))
    filled = {n: _filled(F.col(n), parts) for n in ("title", "suggestion", "reason")}
    return joined.withColumns({**filled, "original": original}).drop("_parts", "_original").select(*findings.columns, *filled)


def difference_text(differences: Column) -> Column:
    """Each differing field with what the reference and what the database has."""

    def of(value: Column) -> Column:
        return F.coalesce(F.nullif(value, F.lit("")), F.lit(NOTHING))

    rows = F.transform(differences, lambda d: F.concat(d["field"], F.lit(f"\n{PROVIDED}："), of(d["provided"]), F.lit(f"\n{LOOKED_UP}："), of(d["database"])))
    return F.array_join(rows, "\n\n")


def lookup_findings(results: DataFrame) -> DataFrame:
    """Findings from what looking references up gave; a verified reference gives none.

    results: see ``LOOKUP_RESULT``; any of its columns may be null. Other columns go along.
    Adds outcome, category, severity, location, title, original, suggestion and reason.
    """
    spark = results.sparkSession
    texts = spark.createDataFrame(list(LOOKUP_TEXTS), "outcome string, severity string, title string, suggestion string, reason string")
    report = F.coalesce(F.col("reference_type") == "report", F.lit(False))
    known = F.array(*(F.lit(x[0]) for x in LOOKUP_TEXTS))
    outcome = (
        F.when(F.col("status") == "manual_source", F.when(report, "manual_report").otherwise("manual_web"))
        .when(F.array_contains(known, F.col("status")), F.col("status"))
        .when(F.col("book_like"), "book")
        .otherwise("unsettled")
    )
    errors = F.create_map(*(F.lit(x) for pair in SOURCE_ERRORS.items() for x in pair))
    unknown_year = F.coalesce(F.exists("comparisons", lambda c: c["field"].endswith("年") & (c["state"] == "unknown")), F.lit(False)) & F.col("source_year").isNull()
    values = {
        "source": F.when(report, REPORT_SOURCE).otherwise(WEB_SOURCE),
        "advice": F.when(unknown_year, NO_YEAR).when(F.col("date_state") == "missing", NO_DATE).otherwise(DATED),
        "compared": F.concat(F.lit(COMPARED), F.array_join(F.coalesce("notes", F.array().cast("array<string>")), " ")),
        "error": F.coalesce(F.try_element_at(errors, F.coalesce("source_error", F.lit(""))), F.lit(OTHER_ERROR)),
        "providers": F.array_join(F.coalesce("provider_errors", F.array().cast("array<string>")), "・"),
        "provider": F.col("provider"),
        "differences": difference_text(F.col("differences")),
    }
    open_ones = results.where(~F.col("status").eqNullSafe("verified")).withColumn("outcome", outcome)
    joined = open_ones.join(F.broadcast(texts), "outcome")  # one row for each outcome
    location = F.concat(F.lit("参考文献 "), F.replace("ref_id", F.lit("ref"), F.lit("")))
    filled = {n: _filled(F.col(n), values) for n in ("title", "suggestion", "reason")}
    out = joined.withColumns({**filled, "category": F.lit(CATEGORIES["citations"]), "location": location, "original": F.col("text")})
    return out.select(*results.columns, "outcome", "category", "severity", "location", "title", "original", "suggestion", "reason")


def unavailable_finding(references: DataFrame) -> DataFrame:
    """One finding for each document whose references can't be looked up at all."""
    location, title, original, suggestion, reason = UNAVAILABLE
    counts = references.groupBy("doc_id").agg(F.count(F.lit(1)).cast("string").alias("_n"))
    texts = {"category": CATEGORIES["citations"], "severity": "info", "location": location, "title": title, "suggestion": suggestion, "reason": reason}
    return counts.select("doc_id", *(F.lit(v).alias(k) for k, v in texts.items()), _filled(F.lit(original), {"0": F.col("_n")}).alias("original"))


def highlighted(text: Column, ranges: Column) -> Column:
    """The ranges that can be shown: in order, within the text, each from the end of the one before or later."""

    def step(acc: Column, r: Column) -> Column:
        fits = F.coalesce((r["start"] >= acc["upto"]) & (r["end"] <= F.length(text)), F.lit(False))
        return F.struct(F.when(fits, r["end"]).otherwise(acc["upto"]).alias("upto"), F.when(fits, F.array_append(acc["kept"], r)).otherwise(acc["kept"]).alias("kept"))

    nothing = F.array().cast("array<struct<start:int,end:int>>")
    start = F.struct(F.lit(0).alias("upto"), nothing.alias("kept"))
    return F.aggregate(F.coalesce(ranges, nothing), start, step, lambda acc: acc["kept"])
