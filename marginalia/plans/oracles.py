"""SQL that gives the rows of the queries, for DuckDB."""

from __future__ import annotations

from marginalia.operators import guidance, rules
from marginalia.plans import corpus, derived_sql, matching_sql, state_sql

_LINES = """lines AS (
    SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS text, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS idx FROM documents
)"""
_EMAIL = r"[\w.+-]+@[\w.-]+\.[A-Za-z]{2,}"
_PHONE = r"(?:0(?:[789]0)[0-9]{8}|0[0-9]{1,4}[-－][0-9]{1,4}[-－][0-9]{3,4})"
_HITS = f"""hits AS (
    SELECT doc_id, idx, text, 'メールアドレス' AS kind, unnest(regexp_extract_all(text, '{_EMAIL}')) AS value FROM lines
    UNION ALL SELECT doc_id, idx, text, '電話番号', unnest(regexp_extract_all(text, '{_PHONE}')) FROM lines
)"""
_MIXED = f"""mixed AS (
    SELECT doc_id, '研究倫理・個人情報' AS category, 'important' AS severity FROM hits
    UNION ALL SELECT doc_id, '書式・提出形式', 'important' FROM lines GROUP BY doc_id HAVING count(*) FILTER (text <> '') >= 5
    UNION ALL SELECT doc_id, '構成・論理展開', 'important' FROM lines GROUP BY doc_id HAVING NOT bool_or(regexp_matches(text, '{rules.PURPOSE}'))
    UNION ALL SELECT doc_id, '構成・論理展開', 'warning' FROM lines GROUP BY doc_id HAVING NOT bool_or(regexp_matches(text, '{rules.CONCLUSION}'))
    UNION ALL SELECT DISTINCT doc_id, '引用・参考文献', 'important' FROM lines
)"""
#: Body paragraphs of the corpus: before and after the reference list, whose first line is lost.
_PARTS = r"""marks AS (
    SELECT c.*, min(CASE WHEN regexp_matches(lower(text), '^\s*(参考・引用文献|参考文献|引用文献|文献一覧|参考資料|references|bibliography)\s*$') THEN idx END) OVER (PARTITION BY doc_id) AS a FROM corpus c
), closed AS (
    SELECT *, min(CASE WHEN idx > a AND regexp_matches(text, '^\s*(付録|補遺|謝辞|あとがき|索引|用語集|appendix|acknowledg(e)?ments?)') AND NOT regexp_matches(text, '(19|20)[0-9]{2}|https?:|doi')
                   THEN idx END) OVER (PARTITION BY doc_id) AS z FROM marks
), parts AS (
    SELECT *, CASE WHEN idx = a THEN 'heading' WHEN idx > a AND (z IS NULL OR idx < z) THEN 'reference' ELSE 'body' END AS part FROM closed
), body AS (SELECT * FROM parts WHERE part = 'body'), prose AS (SELECT * FROM body WHERE text <> '' AND NOT is_heading)"""


#: Lines of documents, four of five of which go on with the paragraphs of a document of the small corpus.
_ANNOTATED = f"""{corpus.values_sql("passages", "doc_id, p_id, idx, text, style_id, style_name, is_heading, heading_level", corpus.rows())}, {_LINES},
ends AS (SELECT doc_id, max(idx) AS n FROM lines GROUP BY doc_id),
corpus AS MATERIALIZED (
    SELECT doc_id, 'p' || idx AS p_id, idx::INT AS idx, text, '' AS style_id, '' AS style_name, false AS is_heading, NULL::INT AS heading_level FROM lines
    UNION ALL SELECT ends.doc_id, 'p' || (n + idx), (n + idx)::INT, text, style_id, style_name, is_heading, heading_level FROM ends JOIN passages ON ends.doc_id % 5 + 1 = passages.doc_id
)"""


def _corpus(sql: str) -> str:
    return f"WITH {_ANNOTATED}, {_PARTS} {sql}"


def _expected(columns: str, rows: list[tuple]) -> str:
    """Rows worked out by hand."""
    return f"WITH {corpus.values_sql('expected', columns, rows)} SELECT * FROM expected"


_NO_QUOTES = "regexp_replace(regexp_replace(regexp_replace(text, '「[^」]*」', '', 'g'), '『[^』]*』', '', 'g'), '[“\"][^”\"]*[”\"]', '', 'g')"
_VARIANTS = ", ".join(f"({i}, '{a}', '{b}')" for i, (a, b) in enumerate(rules.VARIANTS))
_FOLDED = r"regexp_replace(lower({}), '[\s\x{{3000}}\x22''“”‘’「」『』（）()\[\]{{}}.,，。、:：;；・\-–—]', '', 'g')"

ORACLE_SQL: dict[str, str] = {
    "doc_stats": f"""WITH {_LINES} SELECT doc_id, sum(length(text))::BIGINT AS characters, count(*) FILTER (text <> '') AS paragraphs, 0::BIGINT AS headings FROM lines GROUP BY doc_id""",
    "paragraph_explode": f"""WITH {_LINES} SELECT doc_id, 'p' || idx AS p_id, idx::INT AS idx, length(text)::INT AS n_chars, md5(text) AS text_md5 FROM lines""",
    "pii_hits": f"""WITH {_LINES}, {_HITS} SELECT doc_id, idx::INT AS p_idx, kind, value, (instr(text, value) - 1)::INT AS start_at FROM hits""",
    "pii_rollup": f"""WITH {_LINES}, {_HITS}, f AS (SELECT '研究倫理・個人情報' AS category, 'important' AS severity FROM hits)
        SELECT category, severity, count(*) AS n FROM f GROUP BY ROLLUP (category, severity)""",
    "masked_documents": f"""SELECT doc_id, md5(regexp_replace(regexp_replace(text, '{_EMAIL}', '[メールアドレス]', 'g'), '{_PHONE}', '[電話番号]', 'g')) AS masked_md5 FROM documents""",
    "effective_lengths": f"""WITH {_LINES}, e AS (
            SELECT doc_id, idx, regexp_replace(regexp_replace(text, '\\([^)]*(19|20)[0-9]{{2}}[^)]*\\)', '', 'g'), '\\s+', '', 'g') AS core FROM lines
        ) SELECT doc_id, idx::INT AS idx, length(core)::INT AS n, len(regexp_extract_all(core, '[、，,；;]'))::INT AS pauses FROM e WHERE length(core) >= 180""",
    "capped_findings": f"""WITH {_LINES}, r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY idx) AS k FROM lines WHERE length(text) >= 180)
        SELECT doc_id, 'long_line' AS rule, 'writing' AS category, CASE WHEN length(text) >= 1000 THEN 'warning' ELSE 'info' END AS severity, idx::INT AS idx FROM r WHERE k <= 3""",
    "finding_rollup": f"""WITH {_LINES}, {_HITS}, {_MIXED} SELECT category, severity, count(*) AS n FROM mixed GROUP BY ROLLUP (category, severity)""",
    "top_categories": f"""WITH {_LINES}, {_HITS}, {_MIXED}
        SELECT category, count(*) FILTER (severity = 'important') AS n_important, count(*) AS n FROM mixed WHERE severity <> 'info' GROUP BY category
        ORDER BY n_important DESC, n DESC, category LIMIT 3""",
    "shown_findings": f"""WITH {_LINES}, {_HITS}, {_MIXED}, c AS (SELECT 'category' AS filter, * FROM mixed WHERE category = '構成・論理展開' UNION ALL SELECT 'important', * FROM mixed WHERE severity = 'important'
            UNION ALL SELECT 'both', * FROM mixed WHERE category = '構成・論理展開' AND severity = 'important')
        SELECT filter, doc_id, category, severity, count(*) AS n FROM c GROUP BY ALL""",
    "ai_payload": f"""WITH {_LINES}, m AS (
            SELECT doc_id, idx, regexp_replace(regexp_replace(text, '{_EMAIL}', '[メールアドレス]', 'g'), '{_PHONE}', '[電話番号]', 'g') AS text FROM lines WHERE text <> ''
        ), p AS (
            SELECT doc_id, string_agg('{{"id":"p' || idx || '","text":' || to_json(text) || '}}', ',' ORDER BY idx) AS ps FROM m GROUP BY doc_id
        ), j AS (
            SELECT doc_id, '{{"checks":["writing"],"sections":[{{"heading":"本文","paragraphs":[' || ps || ']}}],"references":[]}}' AS payload FROM p
        ) SELECT doc_id, length(payload) <= 120000 AS fits, md5(payload) AS payload_md5 FROM j""",
    "dice_similarity": f"""WITH {_LINES}, a AS (SELECT doc_id, idx, {_FOLDED.format("text")} AS t FROM lines),
        b AS (SELECT item_id, unnest(string_split(text, chr(10))) AS item FROM benchmark), i AS (SELECT DISTINCT item_id, item, {_FOLDED.format("item")} AS t FROM b),
        ag AS (SELECT *, CASE WHEN length(t) = 1 THEN [t] ELSE list_distinct(list_transform(range(1, length(t)), lambda k: substr(t, k, 2))) END AS g FROM a WHERE t <> ''),
        ig AS (SELECT *, CASE WHEN length(t) = 1 THEN [t] ELSE list_distinct(list_transform(range(1, length(t)), lambda k: substr(t, k, 2))) END AS g FROM i WHERE t <> ''),
        s AS (SELECT ag.doc_id, ag.idx, ig.item_id, ig.item, 2.0 * len(list_intersect(ag.g, ig.g)) / (len(ag.g) + len(ig.g)) AS d FROM ag JOIN ig
              ON 2 * least(len(ag.g), len(ig.g)) >= 0.82 * (len(ag.g) + len(ig.g)))
        SELECT DISTINCT doc_id, idx::INT AS idx, item_id, md5(item) AS item_md5, round(d::DOUBLE, 4) AS dice FROM s WHERE d >= 0.82""",
    "finding_texts": f"""WITH {_LINES}, {_HITS} SELECT doc_id, idx::INT AS p_idx, kind || 'の可能性' AS title, value AS original,
        '匿名化、削除、または掲載同意の有無を確認してください。' AS suggestion, 'AIへ送信する場合、この値は自動的にマスクする対象です。' AS reason FROM hits""",
    "lookup_findings": f"""WITH {corpus.values_sql("texts", "outcome, severity, title, suggestion, reason", list(guidance.LOOKUP_TEXTS))}, {corpus.values_sql("errors", "code, said", list(guidance.SOURCE_ERRORS.items()))},
        d AS (SELECT *, list_extract(['verified','source_verified','source_partial','source_mismatch','source_unavailable','manual_source','lookup_incomplete','mismatch','doi_unconfirmed','not_found','unconfirmed','forbidden','unreachable'], (doc_id % 13 + 1)::INT) AS status,
                list_extract([{", ".join(f"'{x}'" for x in (*guidance.SOURCE_ERRORS, "unheard_of"))}], (doc_id // 13 % 13 + 1)::INT) AS code FROM documents),
        o AS (SELECT *, CASE WHEN status = 'manual_source' THEN CASE WHEN doc_id % 2 = 0 THEN 'manual_report' ELSE 'manual_web' END
                WHEN status IN ('not_found', 'unconfirmed') THEN CASE WHEN doc_id % 17 = 0 THEN 'book' ELSE 'unsettled' END ELSE status END AS outcome FROM d WHERE status <> 'verified'),
        v AS (SELECT o.*, CASE WHEN doc_id % 2 = 0 THEN '{guidance.REPORT_SOURCE}' ELSE '{guidance.WEB_SOURCE}' END AS source_name, coalesce(said, '{guidance.OTHER_ERROR}') AS error,
                CASE WHEN doc_id % 7 < 3 AND doc_id % 5 = 0 THEN '{guidance.NO_YEAR}' WHEN doc_id % 3 = 0 THEN '{guidance.NO_DATE}' ELSE '{guidance.DATED}' END AS advice,
                '{guidance.COMPARED}' || CASE WHEN doc_id % 4 = 0 THEN '備考一 備考二' ELSE '' END AS compared,
                '発行年' || chr(10) || '記載：2020' || chr(10) || '照合先：なし' || chr(10) || chr(10) || '題名' || chr(10) || '記載：' || coalesce(nullif(lang, ''), 'なし') || chr(10) || '照合先：別題' AS differences
            FROM o LEFT JOIN errors USING (code))
        SELECT 'ref' || doc_id AS ref_id, outcome, severity, '参考文献 ' || doc_id AS location, replace(title, '{{source}}', source_name) AS title, source AS original,
            replace(replace(suggestion, '{{advice}}', advice), '{{differences}}', differences) AS suggestion,
            replace(replace(replace(replace(reason, '{{compared}}', compared), '{{error}}', error), '{{providers}}', 'Crossref・CiNii Research'), '{{provider}}', 'CiNii') AS reason
        FROM v JOIN texts USING (outcome)""",
    "unavailable_lookups": f"""WITH {_LINES} SELECT doc_id, 'info' AS severity, '参考文献一覧' AS location, count(*) || '件の参考文献を読み取りました。' AS original FROM lines GROUP BY doc_id""",
    "highlight_spans": """WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n, doc_id % 3 AS a1, doc_id % 3 + 2 AS b1, doc_id % 5 AS a2, doc_id % 5 + 4 AS b2, 4 AS a3, doc_id % 7 + 6 AS b3, 8 AS a4, doc_id % 50 * 40 AS b4 FROM documents),
        u1 AS (SELECT *, b1 <= n AS k1, CASE WHEN b1 <= n THEN b1 ELSE 0 END AS c1 FROM d), u2 AS (SELECT *, a2 >= c1 AND b2 <= n AS k2, CASE WHEN a2 >= c1 AND b2 <= n THEN b2 ELSE c1 END AS c2 FROM u1),
        u3 AS (SELECT *, a3 >= c2 AND b3 <= n AS k3, CASE WHEN a3 >= c2 AND b3 <= n THEN b3 ELSE c2 END AS c3 FROM u2), u4 AS (SELECT *, a4 >= c3 AND b4 <= n AS k4 FROM u3)
        SELECT doc_id, concat_ws(',', CASE WHEN k1 THEN a1 || '-' || b1 END, CASE WHEN k2 THEN a2 || '-' || b2 END, CASE WHEN k3 THEN a3 || '-' || b3 END, CASE WHEN k4 THEN a4 || '-' || b4 END) AS spans FROM u4""",
    "word_files": f"""WITH {corpus.corpus_sql()}, files AS (SELECT DISTINCT doc_id || '.docx' AS path FROM corpus)
        SELECT doc_id || '.docx' AS path, 'paragraph' AS kind, idx, text, is_heading, heading_level FROM corpus
        UNION ALL SELECT path, 'table', 1, '左 | 右', NULL, NULL FROM files UNION ALL SELECT path, 'footnote', 3, '注記', NULL, NULL FROM files UNION ALL SELECT 'broken.docx', 'error', NULL, NULL, NULL, NULL""",
    "sections_ffill": f"""WITH {_ANNOTATED}, o AS (SELECT *, is_heading AND text <> '' AS opens FROM corpus)
        SELECT doc_id, idx, (sum(opens::INT) OVER w + 1)::INT AS section_no, coalesce(last_value(CASE WHEN opens THEN text END IGNORE NULLS) OVER w, '本文') AS heading
        FROM o WINDOW w AS (PARTITION BY doc_id ORDER BY idx ROWS UNBOUNDED PRECEDING)""",
    "document_sections": f"""WITH {_ANNOTATED}, o AS (SELECT *, is_heading AND text <> '' AS opens FROM corpus), s AS (
            SELECT *, sum(opens::INT) OVER w + 1 AS section_no, coalesce(last_value(CASE WHEN opens THEN text END IGNORE NULLS) OVER w, '本文') AS heading,
                   coalesce(last_value(CASE WHEN opens THEN heading_level END IGNORE NULLS) OVER w, 0) AS lvl
            FROM o WINDOW w AS (PARTITION BY doc_id ORDER BY idx ROWS UNBOUNDED PRECEDING)
        ) SELECT doc_id, section_no::INT AS section_no, s.heading, lvl::INT AS level, count(*) FILTER (NOT is_heading AND text <> '') AS n_paragraphs
        FROM s WHERE text <> '' OR is_heading GROUP BY 1, 2, 3, lvl HAVING lvl > 0 OR count(*) FILTER (NOT is_heading AND text <> '') > 0""",
    "reference_split": _corpus("SELECT doc_id, idx, part FROM parts"),
    "reference_lines": _corpus("SELECT doc_id, 'ref' || row_number() OVER (PARTITION BY doc_id ORDER BY idx) AS ref_id, p_id, text FROM parts WHERE part = 'reference' AND trim(text) <> ''"),
    "heading_jumps": _corpus(
        """, l AS (SELECT *, lag(heading_level) OVER (PARTITION BY doc_id ORDER BY idx) AS b FROM body WHERE is_heading AND text <> ''),
        r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY idx) AS k FROM l WHERE heading_level - b >= 2)
        SELECT doc_id, 'heading_jump' AS rule, 'warning' AS severity, idx AS p_idx, b || '>' || heading_level AS detail, '' AS spans FROM r WHERE k <= 3"""
    ),
    "no_headings": _corpus(
        """SELECT doc_id, 'no_headings' AS rule, 'important' AS severity, NULL::INT AS p_idx, (count(*) FILTER (text <> ''))::VARCHAR AS detail, '' AS spans FROM body
        GROUP BY doc_id HAVING count(*) FILTER (text <> '') >= 5 AND count(*) FILTER (is_heading AND text <> '') = 0"""
    ),
    "subjective_wording": _corpus(
        f"""SELECT doc_id, 'subjective' AS rule, 'warning' AS severity, idx AS p_idx, NULL::VARCHAR AS detail, '' AS spans FROM prose WHERE regexp_matches({_NO_QUOTES}, '{rules.SUBJECTIVE}')
        UNION ALL SELECT doc_id, 'thinking', 'warning', idx, NULL, '' FROM prose WHERE regexp_matches({_NO_QUOTES}, '{rules.THINK}')"""
    ),
    "doubled_particles": _corpus(
        """, m AS (SELECT *, regexp_extract(text, '(のの|にに|をを|がが|へへ|でで)([^ぁ-ん]|$)|、、|。。') AS h FROM prose), n AS (SELECT *, substr(h, 1, 2) AS hit FROM m WHERE h <> ''),
        r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY idx) AS k FROM n)
        SELECT doc_id, 'doubled' AS rule, 'warning' AS severity, idx AS p_idx, hit AS detail, (instr(text, hit) - 1) || '-' || (instr(text, hit) + 1) AS spans FROM r WHERE k <= 5"""
    ),
    "fullwidth_mix": _corpus(
        """, m AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY idx) AS k FROM prose WHERE regexp_matches(text, '[０-９Ａ-Ｚａ-ｚ]') AND regexp_matches(text, '[0-9A-Za-z]')),
        c AS (SELECT *, unnest(range(0, length(text))) AS pos FROM m WHERE k <= 3), f AS (SELECT *, substr(text, pos + 1, 1) AS s FROM c WHERE regexp_matches(substr(text, pos + 1, 1), '[０-９Ａ-Ｚａ-ｚ]')),
        d AS (SELECT doc_id, idx, s, min(pos) AS first_at FROM f GROUP BY ALL), g AS (SELECT doc_id, idx, string_agg(s, '・' ORDER BY first_at) AS detail FROM d GROUP BY ALL)
        SELECT f.doc_id, 'full_width' AS rule, 'info' AS severity, f.idx AS p_idx, g.detail, string_agg(pos || '-' || (pos + 1), ',' ORDER BY pos) AS spans
        FROM f JOIN g ON f.doc_id = g.doc_id AND f.idx = g.idx GROUP BY f.doc_id, f.idx, g.detail"""
    ),
    "ascii_commas": _corpus(
        r""", m AS (SELECT * FROM prose WHERE contains(text, ',') AND regexp_matches(text, '[\p{Han}\p{Hiragana}\p{Katakana}ー々]')),
        c AS (SELECT *, unnest(range(0, length(text))) AS pos FROM m), s AS (SELECT *, substr(text, pos + 1, 1) AS x FROM c),
        o AS (SELECT *, sum(CASE WHEN x IN ('(', '（') THEN 1 WHEN x IN (')', '）') THEN -1 ELSE 0 END) OVER (PARTITION BY doc_id, idx ORDER BY pos) AS open FROM s),
        d AS (SELECT *, open - least(0, min(open) OVER (PARTITION BY doc_id, idx ORDER BY pos)) AS depth FROM o),
        h AS (SELECT doc_id, idx, pos FROM d WHERE x = ',' AND depth = 0 AND (regexp_matches(CASE WHEN pos > 0 THEN substr(text, pos, 1) ELSE '' END, '[\p{Han}\p{Hiragana}\p{Katakana}ー々]')
            OR regexp_matches(CASE WHEN substr(text, pos + 2, 1) = ' ' THEN substr(text, pos + 3, 1) ELSE substr(text, pos + 2, 1) END, '[\p{Han}\p{Hiragana}\p{Katakana}ー々]'))),
        g AS (SELECT doc_id, idx, count(*)::VARCHAR AS detail, string_agg(pos || '-' || (pos + 1), ',' ORDER BY pos) AS spans FROM h GROUP BY doc_id, idx),
        r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY idx) AS k FROM g)
        SELECT doc_id, 'ascii_comma' AS rule, 'info' AS severity, idx AS p_idx, detail, spans FROM r WHERE k <= 3"""
    ),
    "long_sentences": _corpus(
        r""", s AS (SELECT doc_id, idx, trim(unnest(regexp_extract_all(text, '[^。！？!?]+[。！？!?]?')), ' ' || chr(9) || chr(13) || chr(12288)) AS t FROM prose),
        e AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(t, '「[^」]*」|『[^』]*』', '', 'g'), '（[^）]*(19|20)[0-9]{2}[^）]*）|\([^)]*(19|20)[0-9]{2}[^)]*\)', '', 'g'), '[\s\x{3000}]+', '', 'g') AS c FROM s),
        k AS (SELECT *, length(c) AS n, len(regexp_extract_all(c, '[、，,；;]')) AS pauses, len(regexp_extract_all(c, 'ため|ので|しかし|一方|また|さらに|および|ならびに|ことから|ことにより')) AS links,
                len(regexp_extract_all(c, '(?i)([0-9]+(\.[0-9]+)?%?|[αβχ²]|b|r|p|CI|RMSEA|CFI|TLI|SRMR)\s*[=<>]?\s*-?[0-9]*(\.[0-9]+)?')) AS numbers,
                regexp_matches(c, '(?i)尺度|適合度|信頼性係数|妥当性|因子負荷|相関係数|回帰係数|平均値|標準偏差|媒介分析|間接効果|信頼区間|RMSEA|CFI|TLI|SRMR|AIC|BIC|Cronbach|χ[²2]?|カイ二乗|CI|p\s*[<=>]|[bβrtrF]\s*(\([^)]*\))?\s*=|α\s*=') AS statistical,
                regexp_matches(t, '(?i)調査に用いる変数|用いる変数|採用した|尺度|下位尺度|構成概念|因子モデル|ブランド経験|ブランド態度|ロイヤルティ|適合度') AS scales,
                len(regexp_extract_all(t, '[（(][A-Za-z][^）)]{1,40}[）)]')) AS brackets, len(regexp_extract_all(t, '(19|20)[0-9]{2}')) AS years FROM e)
        SELECT doc_id, 'long_sentence' AS rule, 'warning' AS severity, idx AS p_idx, n::VARCHAR AS detail, '' AS spans FROM k
        WHERE (n >= 180 OR (n >= 145 AND pauses >= 4) OR (n >= 135 AND pauses >= 3 AND links >= 2)) AND NOT (statistical AND numbers >= 3) AND NOT (scales AND (brackets >= 2 OR years >= 2 OR numbers >= 2))"""
    ),
    "style_mixture": _corpus(
        f""", q AS (SELECT doc_id, idx, {_NO_QUOTES} AS t FROM prose WHERE NOT regexp_matches(text, '^\\s*[・●■◆\\-－]')),
        s AS (SELECT doc_id, idx, unnest(regexp_extract_all(t, '[^。！？!?]+[。！？!?]?')) AS t, generate_subscripts(regexp_extract_all(t, '[^。！？!?]+[。！？!?]?'), 1) AS pos FROM q),
        k AS (SELECT *, CASE WHEN regexp_matches(t, '(です|ます|でした|ました|ません|でしょう)(ね|よ)?[。！？!?」）)]*$') THEN 'polite'
              WHEN regexp_matches(t, '(だ|である|だった|であった|ではない|する|した|される|された|となる|となった|といえる|示す|示した|認められる|考えられる)[。！？!?」）)]*$') THEN 'plain' END AS kind FROM s WHERE length(trim(t)) >= 8),
        n AS (SELECT *, count(*) FILTER (kind = 'polite') OVER (PARTITION BY doc_id) AS a, count(*) FILTER (kind = 'plain') OVER (PARTITION BY doc_id) AS b FROM k WHERE kind IS NOT NULL),
        r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY idx, pos) AS o FROM n WHERE a >= 3 AND b >= 3 AND kind = CASE WHEN a <= b THEN 'polite' ELSE 'plain' END)
        SELECT doc_id, 'style_mixture' AS rule, 'warning' AS severity, idx AS p_idx, a || '/' || b AS detail, '' AS spans FROM r WHERE o <= 5"""
    ),
    "variant_spelling": _corpus(
        f""", v(i, a, b) AS (VALUES {_VARIANTS}), t AS (SELECT doc_id, string_agg(text, chr(10) ORDER BY idx) AS t FROM body GROUP BY doc_id),
        n AS (SELECT doc_id, i, a, b, (length(t) - length(replace(t, a, ''))) // length(a) AS na, (length(t) - length(replace(t, b, ''))) // length(b) AS nb FROM t, v),
        c AS (SELECT *, CASE WHEN starts_with(b, a) THEN na - nb ELSE na END AS ca, CASE WHEN starts_with(a, b) THEN nb - na ELSE nb END AS cb FROM n),
        r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k FROM c WHERE ca > 0 AND cb > 0)
        SELECT doc_id, 'spelling_variant' AS rule, 'info' AS severity, NULL::INT AS p_idx, a || ':' || ca || ' ' || b || ':' || cb AS detail, '' AS spans FROM r WHERE k <= 5"""
    ),
    "keyword_rules": _corpus(
        f""", t AS (SELECT doc_id, bool_or(regexp_matches(text, '{rules.PURPOSE}')) AS p, bool_or(regexp_matches(text, '{rules.CONCLUSION}')) AS c, bool_or(regexp_matches(text, '{rules.SURVEY}')) AS s,
            bool_or(regexp_matches(text, '{rules.REVIEW}')) AS r, bool_or(regexp_matches(text, '{rules.DESIGN}')) AS d, bool_or(regexp_matches(text, '{rules.RESULT}')) AS u, bool_or(regexp_matches(text, '{rules.DISCUSSION}')) AS x
            FROM body GROUP BY doc_id)
        SELECT doc_id, 'no_purpose' AS rule, 'important' AS severity FROM t WHERE NOT p UNION ALL SELECT doc_id, 'no_conclusion', 'warning' FROM t WHERE NOT c
        UNION ALL SELECT doc_id, 'no_prior_research', 'info' FROM t WHERE s AND NOT r UNION ALL SELECT doc_id, 'no_design', 'info' FROM t WHERE s AND NOT d
        UNION ALL SELECT doc_id, 'no_discussion', 'info' FROM t WHERE u AND NOT x"""
    ),
    "bullet_paragraphs": _corpus(
        """SELECT doc_id, 'bullets' AS rule, 'info' AS severity, NULL::INT AS p_idx, count(*)::VARCHAR AS detail, '' AS spans FROM prose WHERE regexp_matches(text, '^\\s*[・●■◆\\-－]') GROUP BY doc_id HAVING count(*) >= 3"""
    ),
    "personal_experience": _corpus(
        f"""SELECT doc_id, 'personal_experience' AS rule, 'info' AS severity, min(idx) AS p_idx, NULL::VARCHAR AS detail, '' AS spans FROM prose p WHERE regexp_matches(text, '{rules.PERSONAL}')
        AND doc_id NOT IN (SELECT doc_id FROM body WHERE regexp_matches(text, '{rules.REFLEXIVE}')) GROUP BY doc_id"""
    ),
    "caption_source": _corpus(
        r""", w AS (SELECT *, string_agg(text, chr(10)) OVER (PARTITION BY doc_id ORDER BY idx ROWS BETWEEN 1 PRECEDING AND 2 FOLLOWING) AS near FROM body),
        r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY idx) AS k FROM w WHERE regexp_matches(text, '^\s*(図|表)\s*[0-9０-９]+') AND NOT regexp_matches(near, '(出典|出所|筆者作成|著者作成|自作)|\(([^()]*,\s*)?(19|20)[0-9]{2}\)'))
        SELECT doc_id, 'caption_source' AS rule, string_agg(text, chr(10) ORDER BY idx) AS original FROM r WHERE k <= 3 GROUP BY doc_id"""
    ),
    "missing_numbers": _corpus(
        r""", t AS (SELECT doc_id, string_agg(text, chr(10) ORDER BY idx) AS t FROM body GROUP BY doc_id), k(kind) AS (VALUES ('図'), ('表')),
        u AS (SELECT doc_id, kind, t FROM t, k WHERE NOT regexp_matches(t, kind || '\s*[0-9０-９]+\s*[-－.．][0-9０-９]')),
        n AS (SELECT DISTINCT doc_id, kind, translate(unnest(regexp_extract_all(t, kind || '\s*([0-9０-９]+)', 1)), '０１２３４５６７８９', '0123456789')::INT AS n FROM u),
        m AS (SELECT doc_id, kind, max(n) AS top FROM n GROUP BY ALL HAVING count(*) >= 2), g AS (SELECT doc_id, kind, unnest(range(1, top + 1)) AS n FROM m),
        x AS (SELECT doc_id, kind, string_agg(n::VARCHAR, ',' ORDER BY n) AS gaps, count(*) AS c FROM (SELECT * FROM g EXCEPT SELECT * FROM n) GROUP BY ALL)
        SELECT doc_id, 'missing_number' AS rule, 'warning' AS severity, NULL::INT AS p_idx, kind || gaps AS detail, '' AS spans FROM x WHERE c <= 5"""
    ),
    "citation_rules": _corpus(
        r""", f AS (SELECT doc_id, 'ref' || row_number() OVER (PARTITION BY doc_id ORDER BY idx) AS ref_id, text FROM parts WHERE part = 'reference' AND trim(text) <> '')
        SELECT DISTINCT doc_id, 'no_references' AS rule, 'important' AS severity, '文書全体' AS location FROM body WHERE doc_id NOT IN (SELECT doc_id FROM f)
        UNION ALL SELECT doc_id, 'undated_reference', 'warning', ref_id FROM f WHERE NOT regexp_matches(regexp_extract(text, '^(.*?)([「『“\x22]|https?://|$)', 1), '(18|19|20)[0-9]{2}|n\s*\.\s*d\s*\.|(明治|大正|昭和|平成|令和)\s*[0-9]+|in press|forthcoming|印刷中|刊行予定')"""
    ),
    "personal_data_corpus": _corpus(
        rf""", h AS (SELECT doc_id, idx, text, 'メールアドレス' AS kind, unnest(regexp_extract_all(text, '{_EMAIL}')) AS v FROM body UNION ALL SELECT doc_id, idx, text, '電話番号', unnest(regexp_extract_all(text, '{_PHONE}')) FROM body
            UNION ALL SELECT doc_id, idx, text, '学籍番号候補', regexp_extract(text, '学籍番号\s*([0-9]{{7,10}})', 1) FROM body WHERE regexp_matches(text, '学籍番号\s*[0-9]{{7,10}}'))
        SELECT doc_id, 'personal_data' AS rule, 'important' AS severity, idx AS p_idx, kind || ':' || v AS detail, (instr(text, v) - 1) || '-' || (instr(text, v) - 1 + length(v)) AS spans FROM h"""
    ),
    "page_titles": r"""SELECT page_id, replace(replace(replace(regexp_replace(trim(regexp_replace(
            coalesce(nullif(regexp_extract(html, '<h1[^>]*>(.*?)</h1>', 1), ''), regexp_extract(html, '<title>(.*?)</title>', 1)), '<[^>]+>', '', 'g')), '\s+', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&') AS title, NULL::VARCHAR AS year FROM pages""",
    "url_gate": r"""WITH h AS (SELECT page_id, url, lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#:@]+)', 1)) AS host FROM pages)
        SELECT page_id, regexp_matches(url, '^https?://[^/?#:@]+([/?#]|$)') AND NOT regexp_matches(host, '(^|\.)(localhost|local|internal|invalid|test)$') AS admissible, regexp_replace(url, '#.*$', '') AS address, host FROM h""",
    "rate_limited": """WITH RECURSIVE o AS MATERIALIZED (SELECT event_id, user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
        f AS (SELECT event_id, user_id, k, ts AS last, false AS rejected FROM o WHERE k = 1
            UNION ALL SELECT o.event_id, o.user_id, o.k, CASE WHEN o.ts - f.last >= INTERVAL 1 HOUR THEN o.ts ELSE f.last END, o.ts - f.last < INTERVAL 1 HOUR FROM f JOIN o ON o.user_id = f.user_id AND o.k = f.k + 1)
        SELECT event_id, user_id, rejected FROM f""",
    "cache_hits": """WITH RECURSIVE o AS MATERIALIZED (SELECT event_id, user_id || '|' || event_type AS key, ts, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS k FROM events),
        f AS (SELECT event_id, key, k, ts AS made, false AS hit FROM o WHERE k = 1
            UNION ALL SELECT o.event_id, o.key, o.k, CASE WHEN o.ts - f.made < INTERVAL 10 HOUR THEN f.made ELSE o.ts END, o.ts - f.made < INTERVAL 10 HOUR FROM f JOIN o ON o.key = f.key AND o.k = f.k + 1)
        SELECT event_id, key, hit FROM f""",
    "html_metadata": _expected(
        "url, titles, publishers, year, error",
        [("https://example.com/a", "市場の報告/市場の報告 | 例示研究所", "例示研究所", "2021", None), ("https://example.com/b", "事業紹介/事業紹介 | 企業", "企業", "2020", None), ("https://example.com/c", "", "", None, "access_restricted"), ("https://example.com/d", "一覧", "", None, None), ("https://example.com/e", "ＡＢＣ市場の調査/ＡＢＣ市場の調査 | 例示研究所", "例示研究所", "2021", None)],
    ),
    "source_comparison": _expected(
        "url, status, states",
        [("https://example.com/a", "source_verified", "題名=match,作成者・発行元=match,公開年=match"), ("https://example.com/b", "source_mismatch", "題名=match,作成者・発行元=match,公開年=different"), ("https://example.com/d", "source_partial", "題名=unknown,作成者・発行元=unknown,公開年=unknown"), ("https://example.com/e", "source_verified", "題名=match,作成者・発行元=match,公開年=match")],
    ),
    "pdf_metadata": _expected("doc_id, publishers, year, notes", [(1, "株式会社例示研究所", "2013", ""), (2, "", None, "no_text")]),
}
ORACLE_SQL |= matching_sql.ORACLE_SQL | state_sql.ORACLE_SQL | derived_sql.ORACLE_SQL

# Which category the findings of each rule belong to.
_CATEGORY = {
    "書式・提出形式": ("no_headings", "heading_jump"),
    "誤字脱字・文章表現": ("subjective", "thinking", "doubled", "full_width", "ascii_comma", "long_sentence", "style_mixture", "spelling_variant"),
    "構成・論理展開": ("no_purpose", "no_conclusion"),
    "図表": ("caption_source", "missing_number"),
    "引用・参考文献": ("no_references", "undated_reference"),
    "研究倫理・個人情報": ("personal_data",),
    "研究内容・妥当性": ("no_prior_research", "no_design", "bullets", "personal_experience", "no_discussion"),
}
_RULES = ("heading_jumps", "no_headings", "subjective_wording", "doubled_particles", "fullwidth_mix", "ascii_commas", "long_sentences", "style_mixture", "variant_spelling", "bullet_paragraphs", "personal_experience", "missing_numbers", "personal_data_corpus", "keyword_rules", "citation_rules")
_CATEGORY_OF = corpus.values_sql("categories", "rule, category", [(rule, name) for name, rules_of in _CATEGORY.items() for rule in rules_of])
_SHOWN = {"no_headings": 0, "heading_jump": 1, "no_purpose": 2, "no_conclusion": 3, "no_references": 4, "undated_reference": 5, "no_prior_research": 6, "no_design": 7, "bullets": 8, "personal_experience": 9, "no_discussion": 10}

ORACLE_SQL["all_findings"] = f"""WITH {_CATEGORY_OF}, found AS (
    {" UNION ALL ".join(f"SELECT rule, severity FROM ({ORACLE_SQL[name]})" for name in _RULES)} UNION ALL SELECT rule, 'info' FROM ({ORACLE_SQL["caption_source"]})
) SELECT category, severity, rule, count(*) AS n FROM found JOIN categories USING (rule) GROUP BY ALL"""
ORACLE_SQL["most_severe"] = f"""WITH {corpus.values_sql("shown", "rule, place", list(_SHOWN.items()))}, found AS (
    {" UNION ALL ".join(f"SELECT rule, severity, doc_id, p_idx, coalesce(p_idx, 0) AS seq FROM ({ORACLE_SQL[name]})" for name in ("heading_jumps", "no_headings", "bullet_paragraphs", "personal_experience"))}
    UNION ALL SELECT rule, severity, doc_id, NULL, 0 FROM ({ORACLE_SQL["keyword_rules"]})
    UNION ALL SELECT rule, severity, doc_id, NULL, coalesce(try_cast(substr(location, 4) AS INT), 0) FROM ({ORACLE_SQL["citation_rules"]})
), placed AS (
    SELECT row_number() OVER (ORDER BY list_position(['important', 'warning', 'info'], severity), place, doc_id, seq) AS pos, severity, rule, doc_id, p_idx FROM found JOIN shown USING (rule)
) SELECT * FROM placed WHERE severity <> 'info'"""
