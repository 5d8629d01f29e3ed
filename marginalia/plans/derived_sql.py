"""SQL that gives the rows of the queries whose inputs are made from the given tables: references, records, answers, addresses."""

from __future__ import annotations

from marginalia.plans import corpus
from marginalia.plans.matching_sql import LINES

_CITED = f"""{LINES}, pieces AS (SELECT doc_id, idx, text, unnest(range(0, (length(text) + 399) // 400)) AS piece FROM lines WHERE text <> ''),
cited AS (SELECT 'line/' || doc_id || '/' || idx || '/' || piece AS ref_id, (2000 + doc_id % 2)::VARCHAR AS year, substr(text, piece * 400 + 1, 400) AS title FROM pieces)"""
_OWN_DATES = [(f"r{i:02}", y, "provided" if y else "nd") for i, y in enumerate(("2020", "2020", "2019", "2020", None, "2016", "2019", "2001", "2018", "2021"), 1)]
_TITLE = corpus.CANDIDATES[0][3]
_OWN_FIELDS = [
    *((r, None, _TITLE, "架空大学教養論叢", False, "article", None) for r in ("r01", "r02", "r03")),
    ("r04", "10.1234/test", "Article of record", None, False, "article", "https://doi.org/10.1234/test"),
    ("r05", None, "事業紹介", None, False, "web", "https://example.com/2016"), ("r06", None, "事業紹介", None, False, "article", None),
    ("r07", None, "A study of many things", "Journal of Things", False, "article", None), ("r08", None, "Another vs. other matters", None, True, "book", None),
    ("r09", None, "経営の考え方", None, True, "book", None), ("r10", None, "環境白書", None, False, "report", "https://example.org/report.pdf"),
]
_ITEMS = "i AS (SELECT item_id AS id, string_split(text, chr(10))[1] AS line FROM benchmark)"
_V4 = "[0, 8, 10, 93, 100, 127, 169, 172, 192, 198, 224, 240][(event_id % 12 + 1)::INT]"
_ADDRESSES = ("0.0.0.0", "10.0.0.1", "100.64.0.1", "127.0.0.1", "169.254.169.254", "172.16.0.1", "192.168.1.1", "198.18.0.1", "::1", "fc00::1", "fe80::1", "::ffff:127.0.0.1", "8.8.8.8", "2606:4700::1111", "nonsense")
_SPECIAL = [(-1 - i, x, x in ("8.8.8.8", "2606:4700::1111")) for i, x in enumerate(_ADDRESSES)]
_JAPANESE = r"[\p{Han}\p{Hiragana}\p{Katakana}ー々]"

_OVERLAP_FOLDED = r"regexp_replace(lower(trim(regexp_replace({}, '[\s\x{{00a0}}\x{{3000}}\x{{feff}}\x{{200b}}]+', ' ', 'g'))), '[\s\x{{3000}}\x22''“”「」『』（）()\[\]{{}}.,，。、:：;；・\-–—]', '', 'g')"
_PAIRS_AND_TAIL = "list_distinct(list_transform(range(1, length({0}) + 1), lambda k: substr({0}, k, 2)))"

ORACLE_SQL = {
    "search_terms": rf"""WITH {corpus.values_sql("own", "cand_id, title", [(c[0], c[3]) for c in corpus.CANDIDATES])},
        b AS (SELECT item_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM benchmark),
        g AS (SELECT -1 - item_id * 1000 - pos AS cand_id, line || CASE item_id % 3 WHEN 0 THEN '：副題' WHEN 1 THEN ' （補足の注） ' ELSE '「引用」' END AS title FROM b UNION ALL SELECT * FROM own),
        s AS (SELECT cand_id, trim(title) AS s, regexp_replace(trim(title), '[「」『』“”"'']', '', 'g') AS bare FROM g),
        l AS (SELECT cand_id, [s, bare, CASE WHEN regexp_matches(s, '{_JAPANESE}') AND length(bare) > 20 THEN left(bare, 16) END, trim(regexp_replace(s, '[（(][^）)]{{2,}}[）)]', ' ', 'g')),
            trim(regexp_split_to_array(s, '[：:－\-―–]')[1]), CASE WHEN length(array_to_string(regexp_extract_all(s, '{_JAPANESE}+'), ' ')) >= 6 THEN array_to_string(regexp_extract_all(s, '{_JAPANESE}+'), ' ') END] AS l FROM s),
        f AS (SELECT cand_id, list_filter(l, lambda x, i: x IS NOT NULL AND length(x) >= 4 AND list_position(l, x) = i) AS l FROM l)
        SELECT cand_id, unnest(l) AS term, (generate_subscripts(l, 1) - 1)::INT AS pos FROM f""",
    "cinii_candidates": f"""WITH {_ITEMS} SELECT id, CASE id % 3 WHEN 0 THEN '10.5/' || id WHEN 1 THEN '10.6/' || id END AS doi, line AS title, CASE id % 3 WHEN 0 THEN '林 亜紀, HAYASHI Aki' WHEN 1 THEN '山田 太郎' ELSE '' END AS authors,
        '教養論叢' AS journal, CASE WHEN id % 3 <> 1 THEN (2000 + id % 20)::VARCHAR END AS year, 'https://records.example/' || id || CASE WHEN id % 3 = 0 THEN '/page' ELSE '' END AS url FROM i""",
    "crossref_candidates": f"""WITH {_ITEMS} SELECT id, '10.1/' || id AS doi, line || ' & more' || CASE WHEN id % 2 = 0 THEN ': A <view>' ELSE '' END AS title, 'Smith Jo, Org ' || id AS authors, 'J é T' AS journal,
        (2000 + id % 20 + (id % 3 = 0)::INT)::VARCHAR AS year, CASE WHEN id % 3 = 0 THEN (2001 + id % 20) || ',' ELSE '' END || (2000 + id % 20) AS years,
        CASE WHEN id % 5 = 0 THEN 'https://records.example/' || id ELSE 'https://doi.org/10.1/' || id END AS url FROM i""",
    "answer_envelopes": """SELECT doc_id, md5(CASE WHEN doc_id % 4 = 0 THEN coalesce(nullif(text, ''), 'later') WHEN doc_id % 4 = 1 THEN coalesce(text, '') ELSE '' END) AS answer_md5 FROM documents""",
    "ai_findings_sanitized": r"""WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '^[\s\x{3000}]+|[\s\x{3000}]+$', '', 'g') AS said FROM documents WHERE doc_id % 3 = 0)
        SELECT doc_id, 0 AS pos, 'AI詳細チェック' AS category, CASE WHEN doc_id % 2 = 0 THEN 'warning' ELSE 'info' END AS severity, 'a' AS title, md5(said) AS suggestion_md5, md5('') AS original_md5 FROM d WHERE said <> ''
        UNION ALL SELECT doc_id, 3, '図表', 'info', 'c', md5('d'), md5(said) FROM d""",
    "public_addresses": f"""WITH e AS (SELECT event_id, {_V4} AS a, event_id // 12 % 256 AS b, event_id * 31 % 256 AS c, event_id % 200 + 1 AS d FROM events),
        f AS (SELECT *, a || '.' || b || '.' || c || '.' || d AS v4, NOT (a IN (0, 10, 127) OR a >= 224 OR (a = 100 AND b BETWEEN 64 AND 127) OR (a = 169 AND b = 254) OR (a = 172 AND b BETWEEN 16 AND 31)
                OR (a = 192 AND b = 168) OR (a = 192 AND b = 0 AND c = 0 AND d NOT IN (9, 10)) OR (a = 192 AND b = 0 AND c = 2) OR (a = 198 AND b IN (18, 19)) OR (a = 198 AND b = 51 AND c = 100)) AS free FROM e),
        {corpus.values_sql("own", "event_id, address, is_public", _SPECIAL)}
        SELECT event_id, CASE event_id % 7 WHEN 0 THEN '::ffff:' || v4 WHEN 1 THEN 'fd00::' || printf('%x', event_id % 65536) WHEN 2 THEN '2606:4700::' || printf('%x', event_id % 65536) ELSE v4 END AS address,
            CASE event_id % 7 WHEN 1 THEN false WHEN 2 THEN true ELSE free END AS is_public FROM f UNION ALL SELECT * FROM own""",
    "reference_dates": f"""WITH {_CITED}, {corpus.values_sql("own", "ref_id, year, date_state", _OWN_DATES)}
        SELECT ref_id, year, 'provided' AS date_state FROM cited UNION ALL SELECT 'wrong/' || item_id, '1999', 'provided' FROM benchmark
        UNION ALL SELECT 'right/' || item_id, (2000 + item_id % 2)::VARCHAR, 'provided' FROM benchmark UNION ALL SELECT * FROM own""",
    "reference_fields": f"""WITH {_CITED}, {corpus.values_sql("own", "ref_id, doi, title, journal, is_book, reference_type, source_url", _OWN_FIELDS)}
        SELECT ref_id, NULL AS doi, CASE WHEN length(title) < 3 THEN 'Annals' ELSE title END AS title, CASE WHEN length(title) >= 3 THEN 'Annals' END AS journal, length(title) < 3 AS is_book,
            CASE WHEN length(title) < 3 THEN 'book' ELSE 'article' END AS reference_type, NULL AS source_url FROM cited
        UNION ALL SELECT 'wrong/' || item_id, '10.1234/item' || item_id, 'Unrelated words entirely', NULL, false, 'article', 'https://doi.org/10.1234/item' || item_id FROM benchmark UNION ALL SELECT * FROM own""",
    "overlap_scores": f"""WITH {LINES}, p AS (SELECT doc_id, idx, text, lag(text) OVER (PARTITION BY doc_id ORDER BY idx) AS before FROM lines),
        t AS (SELECT doc_id, idx, {_OVERLAP_FOLDED.format("text")} AS a, {_OVERLAP_FOLDED.format("before")} AS b FROM p WHERE before IS NOT NULL),
        g AS (SELECT doc_id, idx, a, b, {_PAIRS_AND_TAIL.format("a")} AS x, {_PAIRS_AND_TAIL.format("b")} AS y FROM t)
        SELECT doc_id, idx::INT AS idx, CASE WHEN a = '' OR b = '' THEN 0.0 ELSE round(2.0::DOUBLE * len(list_intersect(x, y)) / (len(x) + len(y)), 6) END AS overlap FROM g""",
    "client_identities": """SELECT event_id, CASE WHEN event_id % 4 = 0 THEN '10.0.0.' || event_id % 250 WHEN event_id % 3 <> 0 THEN '192.0.2.' || event_id % 250 ELSE 'unknown' END AS client FROM events""",
}
