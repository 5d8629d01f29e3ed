"""SQL that gives the rows of the queries on matching references with records."""

from __future__ import annotations

from marginalia.plans import corpus

LINES = """lines AS (
    SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS text, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS idx FROM documents
)"""
_GRAMS = "CASE WHEN length(t) = 1 THEN [t] WHEN t = '' THEN [] ELSE list_distinct(list_transform(range(1, length(t)), lambda k: substr(t, k, 2))) END"
_FOLDED = r"regexp_replace(lower({}), '[\s\x{{3000}}\x22''“”‘’「」『』（）()\[\]{{}}.,，。、:：;；・\-–—]', '', 'g')"
_TITLE = corpus.CANDIDATES[0][3]
_LEFT = "'%21', '!'", "'%2A', '*'", "'%27', ''''", "'%28', '('", "'%29', ')'"


def _component(text: str) -> str:
    """A text as part of an address."""
    out = f"url_encode({text})"
    for pair in _LEFT:
        out = f"replace({out}, {pair})"
    return out


_SEARCH = "https://cir.nii.ac.jp/all?q="
_OWN_STATUS = [
    ("r01", "mismatch", 1, 0.88, "題名,著者,発行年,掲載誌", "掲載誌"), ("r04", "verified", 2, 1.0, "題名,著者,発行年,DOI", ""), ("r07", "verified", 4, 0.95, "題名,著者,発行年,掲載誌", ""),
    *((f"r{i:02}", "not_found", None, None, "", "") for i in (2, 3, 5, 6, 8, 9, 10)),
]
_NO_MATCH, _BOTH = (None, None, "[]", "[]"), '["Crossref","CiNii Research"]'
_DIFFERENCE = '[{"field":"掲載誌","provided":"架空大学教養論叢","database":"架空大學教養論叢 = The Imaginary University"}]'
_TITLES = {"r02": _TITLE, "r03": _TITLE, "r05": "事業紹介", "r06": "事業紹介", "r08": "Another vs. other matters", "r09": "経営の考え方", "r10": "環境白書"}
_OWN_JSON = [
    ("r01", "mismatch", None, None, "CiNii Research", _TITLE, _DIFFERENCE, '["題名","著者","発行年","掲載誌"]', '["CiNii Research"]', None, None, _TITLE),
    ("r02", "lookup_incomplete", '["CiNii Research","Crossref"]', "false", *_NO_MATCH, _BOTH, None, None, _TITLE), ("r03", "lookup_incomplete", '["Crossref"]', "false", *_NO_MATCH, _BOTH, None, None, _TITLE),
    ("r04", "verified", None, None, "Crossref", "Article of record", "[]", '["題名","著者","発行年","DOI"]', '["Crossref"]', None, "https://doi.org/10.1234/test", "Article of record"),
    ("r07", "verified", None, None, "CiNii Research", "A study of many things", "[]", '["題名","著者","発行年","掲載誌"]', '["CiNii Research","Crossref"]', None, None, "A study of many things"),
    *((r, "not_found", "[]", str(r in ("r08", "r09")).lower(), *_NO_MATCH, _BOTH, None, None, _TITLES[r]) for r in ("r05", "r06", "r08", "r09", "r10")),
]

#: References that cite lines (refs), with the candidates that match reliably (r), the best first.
_MATCHED = f"""WITH {LINES}, pieces AS (
            SELECT doc_id, idx, text, unnest(range(0, (length(text) + 399) // 400)) AS piece FROM lines WHERE text <> ''
        ), refs AS (
            SELECT 'line/' || doc_id || '/' || idx || '/' || piece AS ref_id, NULL AS doi, 2000 + doc_id % 2 AS year, CASE WHEN doc_id % 3 = 0 THEN 0.0 ELSE 8.0 / 13 END::DOUBLE AS author,
                CASE WHEN length(substr(text, piece * 400 + 1, 400)) < 3 THEN 'Annals' ELSE substr(text, piece * 400 + 1, 400) END AS title FROM pieces
            UNION ALL SELECT 'wrong/' || item_id, '10.1234/item' || item_id, 1999, 8.0 / 13, 'Unrelated words entirely' FROM benchmark
            UNION ALL SELECT 'right/' || item_id, '10.1234/item' || item_id, 2000 + item_id % 2, 8.0 / 13, string_split(text, chr(10))[1] FROM benchmark
        ), b AS (SELECT item_id, unnest(string_split(text, chr(10))) AS title, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM benchmark),
        cands AS (SELECT item_id * 1000 + pos AS cand_id, pos % 2 AS rk, CASE WHEN pos = 0 THEN '10.1234/item' || item_id END AS doi, 2000 + item_id % 2 AS year, title FROM b),
        rt AS (SELECT *, {_FOLDED.format("title")} AS t FROM refs), ct AS (SELECT *, {_FOLDED.format("title")} AS t FROM cands),
        rg AS MATERIALIZED (SELECT *, {_GRAMS} AS g FROM rt), cg AS MATERIALIZED (SELECT *, {_GRAMS} AS g FROM ct),
        pairs AS (
            SELECT rg.*, cg.cand_id, cg.rk, cg.year AS c_year, cg.t AS c_t, cg.g AS c_g FROM rg JOIN cg ON rg.doi = cg.doi
            UNION ALL SELECT rg.*, cg.cand_id, cg.rk, cg.year, cg.t, cg.g FROM rg JOIN cg ON 2 * least(len(rg.g), len(cg.g)) >= 0.82 * (len(rg.g) + len(cg.g)) OR starts_with(rg.t, cg.t) OR starts_with(cg.t, rg.t) WHERE rg.doi IS NULL
        ), p AS (SELECT ref_id, doi IS NOT NULL AS has_doi, author, (year = c_year)::INT AS y, t AS a, c_t AS b, cand_id, rk,
                CASE WHEN len(g) = 0 OR len(c_g) = 0 THEN 0.0 ELSE 2.0 * len(list_intersect(g, c_g)) / (len(g) + len(c_g)) END::DOUBLE AS d FROM pairs),
        m AS (SELECT *, d >= 0.86 OR (least(length(a), length(b)) >= 12 AND (starts_with(a, b) OR starts_with(b, a))) AS titles,
                floor((d * 0.5::DOUBLE + y * 0.25::DOUBLE + author * 0.15::DOUBLE + (CASE WHEN has_doi THEN 1.0 ELSE 0.5 END)::DOUBLE * 0.1::DOUBLE) * 100 + 0.5) / 100 AS confidence FROM p),
        r AS (SELECT *, row_number() OVER (PARTITION BY ref_id ORDER BY confidence DESC, 1 - rk, cand_id) AS k FROM m
            WHERE has_doi OR ((d >= 0.82 OR titles) AND author >= 0.48 AND y <> 0 AND confidence >= 0.58)),"""

ORACLE_SQL = {
    "match_json": f"""WITH i AS (SELECT item_id, string_split(text, chr(10))[1] AS title FROM benchmark),
        {corpus.values_sql("own", "ref_id, status, errors, book_like, provider, title, differences, checked, providers, source_link, doi_link, search_md5", _OWN_JSON)}
        SELECT 'wrong/' || item_id AS ref_id, CASE WHEN item_id % 5 = 0 THEN 'lookup_incomplete' ELSE 'doi_unconfirmed' END AS status, CASE WHEN item_id % 5 = 0 THEN '["Crossref"]' ELSE '[]' END AS errors, 'false' AS book_like,
            NULL AS provider, NULL AS title, '[]' AS differences, '[]' AS checked, '{_BOTH}' AS providers, NULL AS source_link, 'https://doi.org/10.1234/item' || item_id AS doi_link,
            md5('{_SEARCH}Unrelated%20words%20entirely') AS search_md5 FROM i
        UNION ALL SELECT 'right/' || item_id, 'verified', NULL, NULL, 'CiNii Research', title, '[]', '["題名","著者","発行年","DOI"]', '["CiNii Research"]', 'https://records.example/' || item_id, 'https://doi.org/10.1234/item' || item_id,
            md5('{_SEARCH}' || {_component("title")}) FROM i
        UNION ALL SELECT * REPLACE (md5('{_SEARCH}' || {_component("search_md5")}) AS search_md5) FROM own""",
    "match_status": f"""{_MATCHED}
        f AS (SELECT ref_id, has_doi, y, titles, cand_id, confidence FROM r WHERE k = 1 AND confidence >= 0.43),
        {corpus.values_sql("own", "ref_id, status, cand_id, confidence, checked, different", _OWN_STATUS)}
        SELECT ref_id, CASE WHEN cand_id IS NULL THEN CASE WHEN doi IS NULL THEN 'not_found' ELSE 'doi_unconfirmed' END WHEN NOT titles AND NOT has_doi THEN 'unconfirmed' WHEN NOT titles OR y = 0 THEN 'mismatch' ELSE 'verified' END AS status,
            cand_id, confidence, CASE WHEN cand_id IS NULL THEN '' ELSE '題名,著者,発行年' || CASE WHEN has_doi THEN ',DOI' ELSE '' END END AS checked,
            CASE WHEN NOT titles AND has_doi THEN '題名' ELSE '' END || CASE WHEN y = 0 THEN ',発行年' ELSE '' END AS different FROM refs LEFT JOIN f USING (ref_id)
        UNION ALL SELECT ref_id, status, cand_id, confidence::DOUBLE, checked, different FROM own""",
    "best_match": f"""{_MATCHED}
        {corpus.values_sql("own", "ref_id, cand_id, confidence", [("r01", 1, 0.88), ("r04", 2, 1.0), ("r07", 4, 0.95)])}
        SELECT ref_id, cand_id, confidence FROM r WHERE k = 1 UNION ALL SELECT ref_id, cand_id, confidence::DOUBLE FROM own""",
}
