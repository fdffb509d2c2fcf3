"""DuckDB SQL for each registered query, written independently of the Spark plans.

The regex classes are the same text as in ``spendcode.functions.text``; RE2 reads them
the same way Java does.  Views for the driver tables are registered by the caller.
"""

from __future__ import annotations

from spendcode.functions.text import (DIGIT, LEADING_ARTICLES, NA_TOKENS, NON_ENGLISH_CLASS,
                                      TRAILING_COMPANY, WORD, WS)
from spendcode.sources.fixtures import RAW_CODE_SQL, RAW_DESCRIPTION_SQL


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


NA_LIST = ", ".join(q(t) for t in NA_TOKENS)


def strip_sql(e: str) -> str:
    return f"regexp_replace({e}, '\\A[{WS}]+|[{WS}]+\\z', '', 'g')"


def collapse_sql(e: str) -> str:
    return f"trim(regexp_replace({e}, '[{WS}]+', ' ', 'g'))"


def clean_sql(e: str) -> str:
    t = f"regexp_replace(lower({e}), '[^{WORD}{WS}]', ' ', 'g')"
    t = collapse_sql(t)
    t = f"regexp_replace({t}, '\\A({'|'.join(LEADING_ARTICLES)}) ', '')"
    t = f"regexp_replace({t}, ' ({'|'.join(TRAILING_COMPANY)})\\z', '')"
    return f"coalesce({t}, '')"


def code_sql(e: str) -> str:
    n = f"try_cast(replace({e}, '.0', '') AS DOUBLE)"
    return f"CASE WHEN isnan({n}) THEN NULL ELSE {n} END"


RAW_CATALOGUE = f"""raw AS (
  SELECT p_partkey AS ordinal,
         CASE WHEN ({RAW_CODE_SQL}) IN ({NA_LIST}) THEN NULL ELSE ({RAW_CODE_SQL}) END AS code,
         {RAW_DESCRIPTION_SQL} AS description
  FROM part)"""

CLEANED = f"""{RAW_CATALOGUE},
cleaned AS (SELECT ordinal, {code_sql('code')} AS code, {clean_sql('description')} AS description FROM raw)"""

DEDUPED = f"""{CLEANED},
deduped AS (
  SELECT ordinal, code, description FROM (
    SELECT *, row_number() OVER (PARTITION BY description ORDER BY ordinal) AS rn FROM cleaned)
  WHERE rn = 1)"""

ORACLE = {
    "catalog_code": f"""WITH {RAW_CATALOGUE}
SELECT ordinal, code AS code_raw, {code_sql('code')} AS code FROM raw""",
    "clean_description": f"""WITH {RAW_CATALOGUE}
SELECT ordinal, description AS description_raw, {clean_sql('description')} AS description FROM raw""",
    "catalog_dedupe": f"WITH {DEDUPED} SELECT ordinal, code, description FROM deduped",
    "catalog_stats": f"""WITH {CLEANED}
SELECT count(*) AS rows_in, count(DISTINCT description) AS rows_out,
       count(DISTINCT description) AS distinct_descriptions FROM cleaned""",
    "catalog_preview": f"WITH {DEDUPED} SELECT ordinal, code, description FROM deduped ORDER BY ordinal LIMIT 5",
    "embed_text": f"""WITH {RAW_CATALOGUE}
SELECT ordinal, replace(code, '.0', '') AS code, description,
       replace(code, '.0', '') || ' - ' || description AS text
FROM raw WHERE code IS NOT NULL AND description IS NOT NULL""",
}


# --- text scalars -------------------------------------------------------------------------

def is_english_sql(e: str) -> str:
    return f"coalesce(NOT regexp_matches(lower({e}), {q(NON_ENGLISH_CLASS)}), false)"


def strip_digits_sql(e: str) -> str:
    return collapse_sql(f"regexp_replace({e}, '[{DIGIT}]+', '', 'g')")


def valid_code_sql(e: str) -> str:
    return f"coalesce(regexp_matches({e}, '\\A[0-9]{{2,6}}\\n?\\z'), false)"


def blank_sql(e: str) -> str:
    return f"({e} IS NULL OR NOT regexp_matches({e}, '[^{WS}]'))"


def elapsed_sql(e: str) -> str:
    s = f"CAST(trunc({e}) AS BIGINT)"
    days = f"CAST(floor({s} / 86400.0) AS BIGINT)"
    rem = f"({s} - {days} * 86400)"
    hms = f"printf('%d:%02d:%02d', {rem} // 3600, ({rem} % 3600) // 60, {rem} % 60)"
    return (f"CASE WHEN {days} = 0 THEN {hms} ELSE CAST({days} AS VARCHAR) || "
            f"CASE WHEN abs({days}) = 1 THEN ' day, ' ELSE ' days, ' END || {hms} END")


# --- parsers --------------------------------------------------------------------------------

def _re(p: str) -> str:
    return p.replace("(?d)", "")


def extract_sql(e: str, pat: str) -> str:
    pat = q(_re(pat))
    return f"(CASE WHEN regexp_matches({e}, {pat}) THEN regexp_extract({e}, {pat}, 1) END)"


def _lab(p: str, label: str) -> str:
    return p.replace("{L}", label)


def parse_p1_sql(e: str, label: str, validate: bool, six: bool = False) -> dict:
    from spendcode.functions import parsers as P
    t = strip_sql(e)
    code = extract_sql(t, _lab(P.P1_CODE_6 if six else P.P1_CODE_ANY, label))
    desc = strip_sql(extract_sql(t, _lab(P.P1_DESCRIPTION, label)))
    conf = f"coalesce(try_cast({extract_sql(t, P.P1_CONFIDENCE)} AS INTEGER), 0)"
    ok = valid_code_sql(code) if validate else f"({t} IS NOT NULL)"
    return {"code": f"CASE WHEN {ok} THEN {code} END",
            "description": f"CASE WHEN {ok} THEN {desc} END",
            "confidence": f"CASE WHEN {ok} THEN {conf} ELSE 0 END"}


def parse_p2_sql(e: str, label: str) -> dict:
    from spendcode.functions import parsers as P
    t = strip_sql(e)
    code = extract_sql(t, P.P2_NAICS_CODE if label == "NAICS" else P.P2_UNSPSC_CODE)
    desc = extract_sql(t, P.P2_DESCRIPTION)
    conf = extract_sql(t, P.P2_CONFIDENCE)
    ok = f"({code} IS NOT NULL AND {desc} IS NOT NULL AND {conf} IS NOT NULL)"
    if label == "NAICS":
        ok = f"({ok} AND {valid_code_sql(code)})"
    return {"code": f"CASE WHEN {ok} THEN {code} END",
            "description": f"CASE WHEN {ok} THEN {strip_sql(desc)} END",
            "confidence": f"CASE WHEN {ok} THEN coalesce(try_cast({conf} AS INTEGER), 0) ELSE 0 END"}


def generic_sql(e: str) -> dict:
    from spendcode.functions import parsers as P
    return {"code": extract_sql(e, _lab(P.P1_CODE_ANY, "UNSPSC")),
            "description": strip_sql(extract_sql(e, _lab(P.P1_DESCRIPTION, "UNSPSC"))),
            "confidence": extract_sql(e, P.P1_CONFIDENCE)}


def describe_sql(e: str) -> str:
    from spendcode.functions import parsers as P
    return extract_sql(strip_sql(e), P.DESCRIBE_ONLY)


def cols(d: dict, prefix: str = "") -> str:
    return ", ".join(f"{v} AS {prefix}{k}" for k, v in d.items())


def gate_sql(d: dict, t: int, prefix: str) -> str:
    ok = f"({d['confidence']}) >= {t}"
    return (f"CASE WHEN {ok} THEN {d['code']} ELSE '' END AS {prefix}_code, "
            f"CASE WHEN {ok} THEN {d['description']} ELSE '' END AS {prefix}_description, "
            f"CASE WHEN {ok} THEN {d['confidence']} ELSE 0 END AS {prefix}_confidence")


def _init_text_queries():
    from spendcode.sources.fixtures import (CODE_CANDIDATE_SQL, NAICS_ANSWER_SQL, RAW_ACCOUNT_SQL,
                                            UNSPSC_ANSWER_SQL)
    answers = f"answers AS (SELECT p_partkey, p_type, {NAICS_ANSWER_SQL} AS na, {UNSPSC_ANSWER_SQL} AS ua FROM part)"
    n1 = parse_p1_sql("na", "NAICS", True)
    u1 = parse_p1_sql("ua", "UNSPSC", False, six=True)
    acct = f"({RAW_ACCOUNT_SQL})"
    cand = f"({CODE_CANDIDATE_SQL})"
    span = "(epoch_us(max(ts)) - epoch_us(min(ts))) / 1000000.0"
    ORACLE.update({
        "is_english": f"SELECT doc_id, lang, {is_english_sql('text')} AS is_english FROM documents",
        "lang_confusion": f"""SELECT lang, {is_english_sql('text')} AS is_english, count(*) AS n
            FROM documents GROUP BY ALL""",
        "account_strip": f"SELECT c_custkey, {acct} AS account, {strip_digits_sql(acct)} AS account_text FROM customer",
        "input_text": f"SELECT doc_id, text || ' ' || {strip_digits_sql('source')} AS input_text FROM documents",
        "validate_code": f"""SELECT p_type,
            count(*) FILTER (WHERE {valid_code_sql(cand)}) AS n_valid,
            count(*) FILTER (WHERE NOT {valid_code_sql(cand)} AND NOT {blank_sql(cand)}) AS n_invalid,
            count(*) FILTER (WHERE {blank_sql(cand)}) AS n_blank
            FROM part GROUP BY p_type""",
        "elapsed_text": f"""SELECT user_id, event_type, seconds, {elapsed_sql('seconds')} AS elapsed,
            {elapsed_sql('-seconds')} AS elapsed_reversed
            FROM (SELECT user_id, event_type, {span} AS seconds FROM events GROUP BY ALL)""",
        "naics_parse": f"WITH {answers} SELECT p_partkey, {cols(n1)} FROM answers",
        "naics_parse_strict": f"WITH {answers} SELECT p_partkey, {cols(parse_p2_sql('na', 'NAICS'))} FROM answers",
        "unspsc_parse": f"WITH {answers} SELECT p_partkey, {cols(u1)} FROM answers",
        "unspsc_parse_strict": f"WITH {answers} SELECT p_partkey, {cols(parse_p2_sql('ua', 'UNSPSC'))} FROM answers",
        "unspsc_parse_generic": f"WITH {answers} SELECT p_partkey, {cols(generic_sql('ua'))} FROM answers",
        "unspsc_describe_parse": f"WITH {answers} SELECT p_partkey, {describe_sql('ua')} AS description FROM answers",
        "threshold_gate": f"""WITH {answers} SELECT p_partkey,
            {gate_sql(n1, 0, 'naics_t0')}, {gate_sql(u1, 0, 'unspsc_t0')},
            {gate_sql(n1, 85, 'naics_t85')}, {gate_sql(u1, 85, 'unspsc_t85')} FROM answers""",
        "confidence_histogram": f"""WITH {answers},
            conf AS (SELECT {n1['confidence']} AS nc, {u1['confidence']} AS uc FROM answers),
            bins AS (SELECT CAST(range AS INTEGER) AS bin FROM range(21)),
            h AS (SELECT 'naics' AS column_name, least(floor(nc / 5), 20) AS bin, count(*) AS n FROM conf GROUP BY ALL
                  UNION ALL
                  SELECT 'unspsc', least(floor(uc / 5), 20), count(*) FROM conf GROUP BY ALL),
            names AS (SELECT * FROM (VALUES ('naics'), ('unspsc')) v(column_name))
            SELECT b.bin, b.bin * 5 AS lo, CASE WHEN b.bin < 20 THEN (b.bin + 1) * 5 END AS hi, coalesce(h.n, 0) AS n, names.column_name
            FROM names JOIN bins b ON true LEFT JOIN h ON h.bin = b.bin AND h.column_name = names.column_name""",
        "hierarchy_rollup": f"""WITH {answers}, u AS (SELECT {u1['code']} AS code FROM answers)
            SELECT substr(code, 1, 2) AS segment, substr(code, 1, 4) AS family, substr(code, 1, 6) AS class_code,
                   count(*) AS n
            FROM u WHERE code IS NOT NULL GROUP BY ROLLUP (segment, family, class_code)""",
    })


_init_text_queries()


def _init_parse_report():
    from spendcode.sources.fixtures import NAICS_ANSWER_SQL, UNSPSC_ANSWER_SQL
    answers = f"answers AS (SELECT {NAICS_ANSWER_SQL} AS na, {UNSPSC_ANSWER_SQL} AS ua FROM part)"
    parts = []
    for parser, col, d in (("naics_p1", "na", parse_p1_sql("na", "NAICS", True)),
                           ("naics_p2", "na", parse_p2_sql("na", "NAICS")),
                           ("unspsc_p1", "ua", parse_p1_sql("ua", "UNSPSC", False, six=True)),
                           ("unspsc_p2", "ua", parse_p2_sql("ua", "UNSPSC"))):
        status = (f"CASE WHEN {col} IS NULL THEN 'no_answer' WHEN ({d['code']}) IS NULL THEN 'no_code' "
                  f"WHEN ({d['description']}) IS NULL OR ({d['confidence']}) = 0 THEN 'incomplete' ELSE 'ok' END")
        parts.append(f"SELECT '{parser}' AS parser, {status} AS parse_status, count(*) AS n FROM answers GROUP BY ALL")
    ORACLE["parse_report"] = f"WITH {answers} " + " UNION ALL ".join(parts)
    from spendcode.functions import parsers as P
    outcomes = []
    for parser, col, label, code in (("naics_p1", "na", "NAICS", P.P1_CODE_ANY), ("naics_p2", "na", "NAICS", P.P2_NAICS_CODE),
                                     ("unspsc_p1", "ua", "UNSPSC", P.P1_CODE_6), ("unspsc_p2", "ua", "UNSPSC", P.P2_UNSPSC_CODE)):
        p1, t = parser.endswith("p1"), strip_sql(col)
        get = lambda pattern: extract_sql(t, pattern.replace("{L}", label))  # noqa: E731, B023
        taken = f"coalesce({valid_code_sql(get(code))}, false)" if label == "NAICS" else f"({get(code)}) IS NOT NULL"
        conf = get(P.P1_CONFIDENCE if p1 else P.P2_CONFIDENCE)
        given = f"regexp_matches({t}, {q(P.CODE_GIVEN.replace('{L}', label))})"
        outcomes.append(f"""SELECT '{parser}' AS parser, CASE WHEN {col} IS NULL THEN 'no_answer' WHEN NOT {given} THEN 'no_code'
            WHEN NOT {taken} THEN 'bad_code' WHEN ({get(P.P1_DESCRIPTION if p1 else P.P2_DESCRIPTION)}) IS NULL OR ({conf}) IS NULL THEN 'incomplete'
            WHEN CAST(({conf}) AS HUGEINT) > 100 THEN 'confidence_out_of_range' ELSE 'ok' END AS outcome, count(*) AS n FROM answers GROUP BY ALL""")
    ORACLE["parse_outcomes"] = f"WITH {answers} " + " UNION ALL ".join(outcomes)


_init_parse_report()


# --- model stages -------------------------------------------------------------------------

def _pipeline_sql(dialect: str) -> dict:
    """CTE chain of the application (p1) or modular (p2) pipeline over ``documents``."""
    from spendcode.functions import prompts as PR
    from spendcode.operators.replay import FAILURE_TEXT, answer_sql, failed_sql

    m = PR.DEFAULT_MODEL

    def key(stage, **slots):
        frame = PR.USER[(dialect, stage)]
        pieces = [slots[p[1:-1]] if p.startswith("{") and p.endswith("}") else q(p)
                  for p in PR.split_frame(frame)]
        user = " || ".join(pieces)
        name = f"{stage}_{dialect}"
        return (f"sha256(concat_ws(chr(1), '{name}', '{m}', '{PR.TEMPERATURE[(dialect, stage)]}', "
                f"{q(PR.SYSTEM[(dialect, stage)])}, {user}))")

    def answer(stage, k, payload="NULL"):
        name = f"{stage}_{dialect}"
        a = answer_sql(name, "duckdb", key=k, payload=payload)
        f = failed_sql("duckdb", key=k)
        return (f"CASE WHEN {f} THEN NULL ELSE {a} END", f"CASE WHEN {f} THEN '{FAILURE_TEXT}' END")

    yes = PR.P1_ENGLISH_ANSWER if dialect == "p1" else PR.P2_ENGLISH_ANSWER
    c1, c2 = ("procurement_description", "account") if dialect == "p1" else ("description", "account")
    o1, o2 = (f"{c1}_en", "account_en") if dialect == "p1" else ("description_en", "account_en")
    dr, de = answer("detect", "dk", "t")
    tr_r, tr_e = answer("translate", "tk", "t")
    nl = "chr(10)"
    ctes = [
        f"lines AS (SELECT doc_id AS ordinal, text AS {c1}, source AS account FROM documents)",
        f"""texts AS (SELECT DISTINCT t FROM (SELECT coalesce({c1}, 'nan') AS t FROM lines
                UNION ALL SELECT coalesce(account, 'nan') FROM lines))""",
        f"det AS (SELECT t, dk, {dr} AS response, {de} AS error FROM (SELECT t, {key('detect', text='t')} AS dk FROM texts))",
        f"""det2 AS (SELECT dk, t, coalesce(lower({strip_sql('response')}) = '{yes}', false) AS is_english,
                response IS NULL AS detect_failed, error AS detect_error FROM det)""",
        f"""tr AS (SELECT dk, tk, {tr_r} AS response, {tr_e} AS error FROM (
                SELECT dk, t, {key('translate', text='t')} AS tk FROM det2 WHERE NOT detect_failed AND NOT is_english))""",
        f"""trans AS (SELECT det2.dk, CASE WHEN detect_failed OR is_english THEN det2.t
                WHEN tr.response IS NULL THEN det2.t ELSE {strip_sql('tr.response')} END AS text_en,
                detect_error, tr.error AS translate_error
                FROM det2 LEFT JOIN tr ON tr.dk = det2.dk)""",
        f"""l1 AS (SELECT lines.*, a.dk AS k1, b.dk AS k2, a.text_en AS {o1}, b.text_en AS {o2},
                a.detect_error AS e1, a.translate_error AS e2, b.detect_error AS e3, b.translate_error AS e4
                FROM lines
                LEFT JOIN trans a ON a.dk = {key('detect', text=f"coalesce({c1}, 'nan')")}
                LEFT JOIN trans b ON b.dk = {key('detect', text="coalesce(account, 'nan')")})""",
    ]
    if dialect == "p2":
        ctes[-1] = ctes[-1].replace(
            f"a.text_en AS {o1}, b.text_en AS {o2},",
            f"CASE WHEN {c1} IS NULL AND NOT (a.dk IN (SELECT dk FROM tr WHERE response IS NOT NULL)) THEN NULL "
            f"ELSE a.text_en END AS {o1}, CASE WHEN account IS NULL AND NOT (b.dk IN (SELECT dk FROM tr "
            f"WHERE response IS NOT NULL)) THEN NULL ELSE b.text_en END AS {o2},")
    if dialect == "p1":
        ctes.append(f"l2 AS (SELECT *, {o1} || ' ' || {strip_digits_sql(o2)} AS input_text FROM l1)")
        ctes.append(f"""l3 AS (SELECT *, CASE WHEN NOT {blank_sql('input_text')} THEN {key('naics', text='input_text')} END AS nk
                FROM l2)""")
        nr, ne = answer("naics", "nk")
        ctes.append(f"l4 AS (SELECT *, CASE WHEN nk IS NOT NULL THEN {nr} END AS nresp, CASE WHEN nk IS NOT NULL THEN {ne} END AS e5 FROM l3)")
        n1 = parse_p1_sql("nresp", "NAICS", True)
        ctes.append(f"l5 AS (SELECT *, {gate_sql(n1, PR.DEFAULT_THRESHOLD, 'naics')} FROM l4)")
        uk = key("unspsc", description="input_text", naics="coalesce(naics_description, 'None')")
        ctes.append(f"l6 AS (SELECT *, CASE WHEN NOT {blank_sql('input_text')} THEN {uk} END AS uk FROM l5)")
        ur, ue = answer("unspsc", "uk")
        ctes.append(f"l7 AS (SELECT *, CASE WHEN uk IS NOT NULL THEN {ur} END AS uresp, CASE WHEN uk IS NOT NULL THEN {ue} END AS e6 FROM l6)")
        u1 = parse_p1_sql("uresp", "UNSPSC", False, six=True)
        ctes.append(f"final AS (SELECT *, {gate_sql(u1, PR.DEFAULT_THRESHOLD, 'unspsc')} FROM l7)")
        out = (f"ordinal, {c1}, account, {o1}, {o2}, input_text, naics_code, naics_description, naics_confidence, "
               "unspsc_code, unspsc_description, unspsc_confidence")
    else:
        ctes.append(f"l3 AS (SELECT *, {key('naics', text=f'coalesce({o1}, ' + chr(39) + 'nan' + chr(39) + ')')} AS nk FROM l1)")
        nr, ne = answer("naics", "nk")
        ctes.append(f"l4 AS (SELECT *, {nr} AS nresp, {ne} AS e5 FROM l3)")
        ctes.append(f"l5 AS (SELECT *, {cols(parse_p2_sql('nresp', 'NAICS'), 'naics_')} FROM l4)")
        uk = key("unspsc", description=f"coalesce({o1}, 'nan')", naics="coalesce(naics_description, 'None')")
        ctes.append(f"l6 AS (SELECT *, {uk} AS uk FROM l5)")
        ur, ue = answer("unspsc", "uk")
        ctes.append(f"l7 AS (SELECT *, {ur} AS uresp, {ue} AS e6 FROM l6)")
        ctes.append(f"final AS (SELECT *, {cols(parse_p2_sql('uresp', 'UNSPSC'), 'unspsc_')} FROM l7)")
        out = (f"ordinal, {c1}, account, {o1}, {o2}, naics_code, naics_description, naics_confidence, "
               "unspsc_code, unspsc_description, unspsc_confidence")
    return {"ctes": "WITH " + ",\n".join(ctes), "out": out, "o1": o1, "o2": o2,
            "key": key}


def _init_pipeline_queries():
    from spendcode.functions import prompts as PR

    p1 = _pipeline_sql("p1")
    p2 = _pipeline_sql("p2")
    o1, o2 = p1["o1"], p1["o2"]
    err_cols = [(f"detect_p1:{o1}", "e1"), (f"translate_p1:{o1}", "e2"), (f"detect_p1:{o2}", "e3"),
                (f"translate_p1:{o2}", "e4"), ("naics_p1", "e5"), ("unspsc_p1", "e6")]
    quarantine = " UNION ALL ".join(
        f"SELECT ordinal, '{s}' AS stage, {c} AS error FROM final WHERE {c} IS NOT NULL" for s, c in err_cols)
    n_in = "(SELECT count(*) FROM final)"
    tr_in = ("(SELECT count(*) FILTER (WHERE ta) + count(*) FILTER (WHERE tb) FROM (SELECT a.dk IN (SELECT dk FROM tr) AS ta, "
             "b.dk IN (SELECT dk FROM tr) AS tb FROM final f JOIN trans a ON a.dk = f.k1 JOIN trans b ON b.dk = f.k2))")
    metrics = f"""
        SELECT 'detect_p1' AS stage, 2 * {n_in} AS rows_in, count(*) AS requests, count(response) AS answered,
               count(error) AS failed, CAST(NULL AS BIGINT) AS accepted FROM det
        UNION ALL SELECT 'translate_p1', {tr_in}, count(*), count(response), count(error), NULL FROM tr
        UNION ALL SELECT 'naics_p1', (SELECT count(nk) FROM final), count(*), count(nresp), count(e5),
               (SELECT count(*) FILTER (WHERE naics_confidence >= {PR.DEFAULT_THRESHOLD}) FROM final)
               FROM (SELECT DISTINCT nk, nresp, e5 FROM final WHERE nk IS NOT NULL)
        UNION ALL SELECT 'unspsc_p1', (SELECT count(uk) FROM final), count(*), count(uresp), count(e6),
               (SELECT count(*) FILTER (WHERE unspsc_confidence >= {PR.DEFAULT_THRESHOLD}) FROM final)
               FROM (SELECT DISTINCT uk, uresp, e6 FROM final WHERE uk IS NOT NULL)"""
    key = p1["key"]
    plan = f"""SELECT stage, request_key, count(*) AS n_lines FROM (
        SELECT 'detect_p1' AS stage, {key('detect', text="coalesce(text, 'nan')")} AS request_key FROM documents
        UNION ALL SELECT 'detect_p1', {key('detect', text="coalesce(source, 'nan')")} FROM documents
        UNION ALL SELECT 'describe_p1', {key('describe', text="coalesce(text, 'nan')")} FROM documents)
        GROUP BY stage, request_key"""
    ORACLE.update({
        "enrich": f"{p1['ctes']}\nSELECT {p1['out']} FROM final",
        "process": f"{p2['ctes']}\nSELECT {p2['out']} FROM final",
        "translate_gate": f"{p1['ctes']}\nSELECT ordinal, {o1}, {o2} FROM l1",
        "quarantine": f"{p1['ctes']}\n{quarantine}",
        "stage_metrics": f"{p1['ctes']}\n{metrics}",
        "stored_responses": f"""{p1['ctes']}
            SELECT stage, requests AS first_asked, requests, answered, failed AS again_asked, requests AS again_requests,
            answered AS again_answered FROM ({metrics}) m""",
        "request_plan": plan,
    })
    del PR


_init_pipeline_queries()


# --- fuzzy ----------------------------------------------------------------------------------

def _dp_lcs(a: str, b: str) -> str:
    """LCS length by dynamic programming: one DP row per character of ``b``; each new row
    is the prefix maximum of max(prev[j], prev[j-1] + match)."""
    return (f"list_reduce(str_split({b}, ''), lambda lcs_prev, lcs_ch: [0] || list_transform("
            f"range(1, length({a}) + 1), lambda lcs_j: list_max(list_transform(range(1, lcs_j + 1), "
            f"lambda lcs_i: greatest(lcs_prev[lcs_i + 1], "
            f"lcs_prev[lcs_i] + CASE WHEN {a}[lcs_i] = lcs_ch THEN 1 ELSE 0 END)))), "
            f"list_transform(range(0, length({a}) + 1), lambda lcs_z: 0))[length({a}) + 1]")


def _ends_lcs(a: str, b: str) -> str:
    """LCS length from the least ends: after each character of ``b``, entry ``l`` is the first place of
    ``a`` by which a common subsequence of ``l`` characters is complete.  Suits a long ``a``."""
    rest, ch = f"substr({a}, lcs_t[lcs_l] + 1)", f"{b}[lcs_j[1]]"
    return (f"(len(list_reduce(list_concat([[0]], list_transform(range(1, length({b}) + 1), lambda lcs_j: [lcs_j])), "
            f"lambda lcs_t, lcs_j: list_filter(list_concat([0], list_transform(range(1, len(lcs_t) + 1), lambda lcs_l: "
            f"least(coalesce(lcs_t[lcs_l + 1], 2147483647), CASE WHEN contains({rest}, {ch}) "
            f"THEN lcs_t[lcs_l] + instr({rest}, {ch}) ELSE 2147483647 END))), lambda lcs_x: lcs_x < 2147483647))) - 1)")


def _bits_lcs(a: str, b: str, masks: str) -> str:
    """LCS length over bits of ``a`` (62 characters at most), whose characters' places are in the map ``masks``."""
    full = f"((1::BIGINT << length({a})) - 1)"
    return (f"(length({a}) - bit_count(list_reduce(list_prepend({full}, list_transform(str_split({b}, ''), lambda lcs_c: "
            f"coalesce({masks}[lcs_c], 0))), lambda lcs_v, lcs_m: ((lcs_v + (lcs_v & lcs_m)) | (lcs_v & ~lcs_m)) & {full})))")


def ratio_sql(a: str, b: str, lcs: str | None = None) -> str:
    lcs = lcs or f"(CASE WHEN length({a}) <= length({b}) THEN {_dp_lcs(a, b)} ELSE {_dp_lcs(b, a)} END)"
    tot = f"(length({a}) + length({b}))"
    r = f"(CAST({tot} - ({tot} - 2 * {lcs}) AS DOUBLE) / {tot})"
    return (f"(CASE WHEN {a} = {b} THEN 100 WHEN length({a}) = 0 OR length({b}) = 0 THEN 0 "
            f"ELSE CAST(round_even(CAST(100 AS DOUBLE) * {r}, 0) AS INTEGER) END)")


def token_key_sql(e: str) -> str:
    t = f"regexp_replace({e}, '[\\x{{80}}-\\x{{FF}}]', '', 'g')"
    t = f"lower(regexp_replace({t}, '[^{WORD}]', ' ', 'g'))"
    return f"array_to_string(list_sort(list_filter(string_split_regex({t}, ' +'), lambda tok: tok <> '')), ' ')"


def best_match_sql(texts: str, text_col: str, id_col: str, scorer: str, floor: int,
                   catalogue: str = "SELECT p_partkey AS ordinal, CAST(p_partkey AS VARCHAR) AS code, "
                                    "p_name AS description FROM part", lcs: str | None = None, extra: str = "") -> str:
    """CTEs ``mk`` (id, k) and ``best`` (k, code, description, score) for a text table."""
    key = (lambda e: token_key_sql(f"lower({e})")) if scorer == "token_sort" else (lambda e: f"lower({e})")
    return f"""mk AS (SELECT {id_col}, CASE WHEN NOT {blank_sql(text_col)} THEN {key(text_col)} END AS k FROM ({texts})),
    mkeys AS (SELECT DISTINCT k FROM mk WHERE k IS NOT NULL),
    cat0 AS (SELECT {key('description')} AS ck, ordinal, code, description FROM ({catalogue}) WHERE description IS NOT NULL),
    cat1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ck ORDER BY ordinal) AS rn FROM cat0) WHERE rn = 1),
    cat2 AS (SELECT *{extra} FROM cat1),
    scored AS (SELECT k, ordinal, code, description, {ratio_sql('k', 'ck', lcs)} AS score FROM mkeys CROSS JOIN cat2),
    best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY score DESC, ordinal) AS rn
             FROM scored WHERE score >= {floor}) WHERE rn = 1)"""


def _init_fuzzy_queries():
    from spendcode.functions import prompts as PR
    from spendcode.sources.fixtures import PROBE_SQL

    pairs = f"""pairs AS (SELECT p.p_partkey, lower(p.p_name) AS a, lower(n.b_raw) AS b FROM part p
        LEFT JOIN (SELECT p_partkey - 1 AS p_partkey, {PROBE_SQL} AS b_raw FROM part) n ON n.p_partkey = p.p_partkey)"""
    probes = f"SELECT p_partkey, {PROBE_SQL} AS probe FROM part"
    out = """SELECT mk.p_partkey, best.code AS match_code, best.description AS match_description,
        coalesce(best.score, 0) AS match_score FROM mk LEFT JOIN best ON best.k = mk.k"""
    ORACLE.update({
        "fuzzy_ratio": f"WITH {pairs} SELECT p_partkey, {ratio_sql('a', 'b')} AS score FROM pairs",
        "fuzzy_token_sort": f"""WITH {pairs}, keyed AS (SELECT p_partkey, {token_key_sql('a')} AS ka,
            {token_key_sql('b')} AS kb FROM pairs) SELECT p_partkey, {ratio_sql('ka', 'kb')} AS score FROM keyed""",
        "fuzzy_best": f"WITH {best_match_sql(probes, 'probe', 'p_partkey', 'token_sort', 1)} {out}",
        "fuzzy_best_cutoff": f"WITH {best_match_sql(probes, 'probe', 'p_partkey', 'ratio', 70)} {out}",
    })

    from spendcode.sources.fixtures import LONG_COPY_SQL, PURCHASE_SQL, WIDE_DESCRIPTION_SQL
    ORACLE["fuzzy_best_documents"] = f"""WITH {best_match_sql('SELECT doc_id, text FROM documents', 'text', 'doc_id', 'token_sort', 1, lcs=_ends_lcs('k', 'ck'))}
        SELECT mk.doc_id, best.code AS match_code, best.description AS match_description,
        coalesce(best.score, 0) AS match_score FROM mk LEFT JOIN best ON best.k = mk.k"""
    scores = ", ".join(f"CASE WHEN {y} IS NOT NULL THEN {ratio_sql(x, y, _ends_lcs(x, y))} END AS {n}" for x, y, n in (
        ("a", "b", "plain_ab"), ("ka", "kb", "sorted_ab"), ("a", "c", "plain_ac"), ("ka", "kc", "sorted_ac")))
    ORACLE["fuzzy_ratio_long"] = f"""WITH p AS (SELECT t.item_id, lower(t.text) AS a, lower(t.copy) AS b, lower(n.text) AS c
        FROM (SELECT *, {LONG_COPY_SQL} AS copy FROM benchmark) t LEFT JOIN benchmark n ON n.item_id = t.item_id + 1),
        q AS (SELECT *, {token_key_sql('a')} AS ka, {token_key_sql('b')} AS kb, {token_key_sql('c')} AS kc FROM p)
        SELECT item_id, {scores} FROM q"""
    wide = f"SELECT p_partkey AS ordinal, 'c' || CAST(p_partkey AS VARCHAR) AS code, {WIDE_DESCRIPTION_SQL} AS description FROM part"
    texts = f"SELECT s_suppkey, {PURCHASE_SQL} AS purchase FROM supplier LEFT JOIN part ON p_partkey = s_suppkey"
    places = ", map_from_entries(list_transform(list_distinct(str_split(ck, '')), lambda c: {'key': c, 'value': " \
             "CAST(list_sum(list_transform(range(1, length(ck) + 1), lambda i: CASE WHEN ck[i] = c THEN 1::BIGINT << (i - 1) ELSE 0 END)) AS BIGINT)})) AS places"
    for name, scorer, least in (("fuzzy_best_wide", "token_sort", 1), ("fuzzy_best_wide_cutoff", "ratio", 70)):
        best = best_match_sql(texts, "purchase", "s_suppkey", scorer, least, catalogue=wide, lcs=_bits_lcs("ck", "k", "places"), extra=places)
        ORACLE[name] = f"WITH {best} {out.replace('p_partkey', 's_suppkey')}"

    # Catalogue-matching enrich: industry from the model (gated), product = best catalogue
    # match of the model's product description, filled only when the industry passes.
    p1 = _pipeline_sql("p1")
    key = p1["key"]
    from spendcode.operators.replay import FAILURE_TEXT, answer_sql, failed_sql

    def ans(stage, k):
        a = answer_sql(f"{stage}_p1", "duckdb", key=k, payload="NULL")
        f = failed_sql("duckdb", key=k)
        return f"CASE WHEN {k} IS NULL OR {f} THEN NULL ELSE {a} END"

    txt = "coalesce(text, 'nan')"
    n1 = parse_p1_sql("nresp", "NAICS", True)

    def lines_sql(source):
        return f"""f1 AS (SELECT *,
            CASE WHEN NOT {blank_sql('text')} THEN {key('naics', text=txt)} END AS nk,
            CASE WHEN NOT {blank_sql('text')} THEN {key('describe', text=txt)} END AS dk FROM ({source})),
        f2 AS (SELECT *, {ans('naics', 'nk')} AS nresp, {ans('describe', 'dk')} AS dresp FROM f1),
        f3 AS (SELECT * EXCLUDE (text, nk, dk, nresp, dresp), {gate_sql(n1, PR.DEFAULT_THRESHOLD, 'naics')}, {describe_sql('dresp')} AS product_text FROM f2)"""

    def coded_sql(lines, english=""):
        return f"""{lines},
        {best_match_sql('SELECT ordinal, product_text FROM f3', 'product_text', 'ordinal', 'token_sort', 1)}
        SELECT f3.ordinal, {english} naics_code, naics_description, naics_confidence,
            CASE WHEN naics_confidence >= {PR.DEFAULT_THRESHOLD} THEN best.code ELSE '' END AS unspsc_code,
            CASE WHEN naics_confidence >= {PR.DEFAULT_THRESHOLD} THEN best.description ELSE '' END AS unspsc_description,
            CASE WHEN naics_confidence >= {PR.DEFAULT_THRESHOLD} THEN coalesce(best.score, 0) ELSE 0 END AS unspsc_confidence
        FROM f3 JOIN mk ON mk.ordinal = f3.ordinal LEFT JOIN best ON best.k = mk.k"""

    plain = lines_sql("SELECT doc_id AS ordinal, text FROM documents")
    o1, o2 = p1["o1"], p1["o2"]
    both = lines_sql(f"SELECT ordinal, {o1} AS text, {o1}, {o2} FROM l1")
    ORACLE["describe_stage"] = f"""WITH {plain} SELECT ordinal, product_text AS unspsc_description FROM f3"""
    ORACLE["fuzzy_enrich"] = f"WITH {coded_sql(plain)}"
    ORACLE["fuzzy_enrich_translated"] = f"{p1['ctes']},\n{coded_sql(both, f'{o1}, {o2},')}"
    del FAILURE_TEXT


_init_fuzzy_queries()


# --- vectors --------------------------------------------------------------------------------

def _init_vector_queries():
    from spendcode.functions.vectors import DIMENSION, TOKEN_PATTERN
    ORACLE.update({
        "hash_embed": f"""WITH {RAW_CATALOGUE},
            rec AS (SELECT ordinal, replace(code, '.0', '') || ' - ' || description AS text FROM raw
                    WHERE code IS NOT NULL AND description IS NOT NULL),
            tok AS (SELECT ordinal, unnest(regexp_extract_all(lower(text), '{TOKEN_PATTERN}')) AS t FROM rec),
            cnt AS (SELECT ordinal, CAST(('0x' || substr(md5(t), 1, 7)) AS BIGINT) % {DIMENSION} AS bucket,
                    CAST(count(*) AS DOUBLE) AS c FROM tok GROUP BY ALL)
            SELECT ordinal, CAST(bucket AS INTEGER) AS bucket,
                   round(c / sqrt(sum(c * c) OVER (PARTITION BY ordinal)), 6) AS weight FROM cnt""",
        "embed_job": f"""WITH {RAW_CATALOGUE},
            rec AS (SELECT replace(code, '.0', '') AS id, max_by(replace(code, '.0', '') || ' - ' || description, ordinal) AS text,
                    max_by(description, ordinal) AS description FROM raw WHERE code IS NOT NULL AND description IS NOT NULL GROUP BY ALL),
            tok AS (SELECT id, unnest(regexp_extract_all(lower(text), '{TOKEN_PATTERN}')) AS t FROM rec),
            cnt AS (SELECT id, CAST(('0x' || substr(md5(t), 1, 7)) AS BIGINT) % {DIMENSION} AS bucket, CAST(count(*) AS DOUBLE) AS c FROM tok GROUP BY ALL),
            wgt AS (SELECT id, CAST(CAST(c / sqrt(sum(c * c) OVER (PARTITION BY id)) AS FLOAT) AS DOUBLE) AS w FROM cnt)
            SELECT id, {DIMENSION} AS dim, round(sum(w), 5) AS vsum, any_value(description) AS description FROM rec JOIN wgt USING (id) GROUP BY id""",
        "clean_job": f"WITH {DEDUPED} SELECT code, description FROM deduped",
        "clean_job_csv": f"WITH {DEDUPED} SELECT code, description FROM deduped",
        "vector_table": """SELECT CAST(vec_id AS VARCHAR) AS id, vec_id AS seq, CAST(len(embedding) AS INTEGER) AS dim,
                round(list_sum(CAST(embedding AS DOUBLE[])), 6) AS vsum, CASE WHEN label = 1 THEN 'second' ELSE 'first' END AS description FROM embeddings
            UNION ALL SELECT CAST(-vec_id - 1 AS VARCHAR), vec_id, CAST(len(embedding) AS INTEGER),
                round(list_sum(CAST(embedding AS DOUBLE[])), 6), 'second' FROM embeddings WHERE label = 1""",
        "cosine_similarity": """SELECT a.vec_id, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]),
                CAST(b.embedding AS DOUBLE[])), 6) AS similarity
            FROM embeddings a LEFT JOIN embeddings b ON b.vec_id = a.vec_id + 1""",
        "cosine_topk": """WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
            s AS (SELECT a.vec_id AS probe_id, b.vec_id AS id, list_cosine_similarity(a.v, b.v) AS sim
                  FROM e a CROSS JOIN e b),
            r AS (SELECT *, row_number() OVER (PARTITION BY probe_id ORDER BY sim DESC, id) AS rank FROM s)
            SELECT probe_id, CAST(rank AS INTEGER) AS rank, id, round(sim, 6) AS similarity FROM r WHERE rank <= 5""",
        "vector_upsert": """WITH rec AS (SELECT CAST(vec_id // 3 AS VARCHAR) AS id, vec_id AS seq, embedding, label
                FROM embeddings),
            old AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq DESC) AS rn
                    FROM rec WHERE label = 0) WHERE rn = 1),
            new AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq DESC) AS rn
                    FROM rec WHERE label <> 0) WHERE rn = 1),
            m AS (SELECT * FROM old WHERE id NOT IN (SELECT id FROM new) UNION ALL SELECT * FROM new)
            SELECT id, seq, CAST(len(embedding) AS INTEGER) AS dim, round(list_sum(CAST(embedding AS DOUBLE[])), 6) AS vsum,
                   'label ' || CAST(label AS VARCHAR) AS description FROM m""",
    })


_init_vector_queries()


def _init_csv_queries():
    p1 = _pipeline_sql("p1")
    cols = [("ordinal", "line_no")] + [(c.strip(), c.strip()) for c in p1["out"].split(",")[1:]]

    def txt(e):
        v = f"CAST({e} AS VARCHAR)"
        return f"CASE WHEN {v} IN ({NA_LIST}) THEN NULL ELSE {v} END"

    sel = ", ".join(f"{txt(src)} AS {dst}" for src, dst in cols)
    ORACLE["csv_roundtrip"] = f"{p1['ctes']}\nSELECT {sel} FROM final"


_init_csv_queries()
