"""SQL equivalents of the workload queries, for an engine with RE2 regular expressions."""

from __future__ import annotations

from folia import profiles as P

WS = r"\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
SEP = "chr(31)"
NL = "chr(10)"


def strip(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '^[{WS}]+', ''), '[{WS}]+$', '')"


def collapse(x: str) -> str:
    return strip(f"regexp_replace({x}, '[{WS}]+', ' ', 'g')")


def norm(x: str) -> str:
    return rf"lower(regexp_replace({x}, '[^0-9A-Za-z\x{{4e00}}-\x{{9fff}}]+', '', 'g'))"


def tokens(x: str) -> str:
    return rf"regexp_extract_all({x}, '[{WS}]+|[\x{{4e00}}-\x{{9fff}}]|[A-Za-z0-9_]+|[^{WS}]')"


def terms(x: str) -> str:
    stop = ", ".join(f"'{w}'" for w in P.STOPWORDS)
    return (
        rf"list_filter(regexp_extract_all(lower({x}), '[\p{{L}}\p{{N}}_-]+'), "
        f"lambda w: length(w) > 2 AND NOT list_contains([{stop}], w))"
    )


def distinct(x: str) -> str:
    """Ordered distinct of a list expression."""
    return f"list_filter({x}, lambda v, i: list_position({x}, v) = i)"


def keywords(x: str, cap: int = 40) -> str:
    found = rf"regexp_extract_all({x}, '[A-Za-z0-9\x{{4e00}}-\x{{9fff}}]{{2,}}')"
    return f"list_slice({distinct(found)}, 1, {cap})"


def truncate(x: str, n: int) -> str:
    flat = collapse(x)
    return f"CASE WHEN length({flat}) <= {n} THEN {flat} ELSE rtrim(left({flat}, {n})) || '...' END"


def joined(x: str) -> str:
    return f"array_to_string({x}, {SEP})"


def any_of(x: str, words) -> str:
    return "(" + " OR ".join(f"contains({x}, '{w}')" for w in words) + ")"


def grams(x: str, sizes=(2, 3, 4)) -> str:
    """Distinct character n-grams; the text is split into characters once."""
    per_size = [
        f"list_transform(range(1, len(c) - {n - 2}), lambda i: {' || '.join(f'c[i + {d}]' for d in range(n))})" for n in sizes
    ]
    return f"list_transform([string_split({x}, '')], lambda c: list_distinct(list_concat({', '.join(per_size)})))[1]"


# --- derived tables ----------------------------------------------------------------------
PAGES = r"""
pf AS (
  SELECT page_id, url,
    regexp_extract(url, '^https?://[^/]+/([a-z]+)/', 1) AS lang,
    regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS title,
    regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1) AS h1,
    list_filter(list_transform(regexp_extract_all(html, '(?s)<p>(.*?)</p>', 1),
      lambda p: trim(regexp_replace(p, '<[^>]+>', ' ', 'g'))), lambda p: p <> '') AS paragraphs,
    regexp_extract_all(html, 'href="/([^"]+)"', 1) AS links
  FROM pages)
"""
BODY = """
md AS (
  SELECT page_id, url, lang || '/' || lpad(CAST(page_id AS VARCHAR), 8, '0') || '.md' AS path, lang, title, h1, links, paragraphs,
    '# ' || title || chr(10) || chr(10) || '# ' || h1 || chr(10) || chr(10)
    || array_to_string(paragraphs, chr(10) || chr(10)) || chr(10) || chr(10)
    || array_to_string(list_transform(links, lambda a: '[link](/' || a || ')'), ' ') AS body
  FROM pf)
"""
MD = f"{PAGES}, {BODY}"
TITLE_Q = "tq AS (SELECT page_id AS query_id, title AS question FROM pf)"

HEADING_RE = rf"(?m)^#{{1,6}}[{WS}]+(.+?)[{WS}]*$"


def lexical(questions: str, texts: str, boost: float, k: int, *, ties: str = "doc_id", extra: str = "0.0") -> str:
    """CTEs and final select of a lexical ranking.

    ``questions``: SELECT query_id, q_norm; ``texts``: SELECT doc_id, h_norm.
    """
    return f"""
    q AS ({questions}), h AS ({texts}),
    qg AS (SELECT query_id, unnest({grams("q_norm")}) AS g FROM q),
    qn AS (SELECT query_id, count(*) AS n FROM qg GROUP BY 1),
    vocabulary AS (SELECT DISTINCT g FROM qg),
    hg AS (SELECT doc_id, g FROM (SELECT doc_id, unnest({grams("h_norm")}) AS g FROM h) SEMI JOIN vocabulary USING (g)),
    shared AS (SELECT query_id, doc_id, count(*) AS c FROM qg JOIN hg USING (g) GROUP BY ALL),
    scored AS (
      SELECT s.query_id, s.doc_id, round_even(
        CASE WHEN contains(h.h_norm, q.q_norm) THEN {boost} ELSE 0.0 END + CAST(c AS DOUBLE) / n * 60.0 + {extra}, 4) AS score
      FROM shared s JOIN qn USING (query_id) JOIN q USING (query_id) JOIN h USING (doc_id)),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, {ties}) AS rank FROM scored)
    """


DOC_Q = f"SELECT item_id AS query_id, {norm('text')} AS q_norm FROM benchmark"
DOC_H = f"SELECT doc_id, {norm('text')} AS h_norm FROM documents"
LEX10 = f"""
  {lexical(DOC_Q, DOC_H, 90.0, 10)},
  hits AS (SELECT r.query_id, r.rank AS ord, d.source || '/' || CAST(d.doc_id AS VARCHAR) AS path, d.text,
           r.score / 100.0 AS retrieval_score, r.doc_id FROM ranked r JOIN documents d USING (doc_id) WHERE rank <= 10)
"""


def type_case(x: str) -> str:
    t = f"replace({x}, ' ', '')"
    return f"""CASE WHEN {any_of(t, P.COMPARE_MARKERS)} THEN 'comparison'
      WHEN regexp_matches({t}, '{P.CATALOG_COUNT}') THEN 'catalog'
      WHEN {any_of(t, P.FORMULA_TYPE_MARKERS)} THEN 'formula' WHEN {any_of(t, P.VERSION_MARKERS)} THEN 'version'
      WHEN {any_of(t, P.COMPLIANCE_MARKERS)} THEN 'compliance' WHEN {any_of(t, P.SUMMARY_MARKERS)} THEN 'summary'
      WHEN regexp_matches({x}, '{P.RULE_NO}|{P.ATTACHMENT_NO}') THEN 'locate' ELSE 'analysis' END"""


def strategy_case(x: str) -> str:
    t = f"replace({x}, ' ', '')"
    d, s = any_of(t, P.DOCUMENT_QUERY_MARKERS), any_of(t, P.SECTION_QUERY_MARKERS)
    return f"""CASE WHEN {any_of(t, P.HYBRID_QUERY_MARKERS)} THEN 'hybrid' WHEN {d} AND NOT {s} THEN 'document'
      WHEN {s} AND NOT {d} THEN 'section' ELSE 'hybrid' END"""


def followup(x: str) -> str:
    t = f"lower({strip(x)})"
    prefixes = " OR ".join(f"starts_with({t}, '{p}')" for p in P.FOLLOWUP_PREFIXES)
    words = "|".join(P.FOLLOWUP_WORDS)
    boundary = r"(?:^|[^\p{L}\p{N}_])"
    after = r"(?:$|[^\p{L}\p{N}_])"
    return f"""({t} <> '' AND (({prefixes}) OR (NOT regexp_matches({t}, '{P.RULE_NO}|{P.ATTACHMENT_NO}|第\\d+号')
      AND ({any_of(t, P.FOLLOWUP_TERMS)} OR regexp_matches({t}, '{boundary}(?:{words}){after}')))))"""


def steps_case(kind: str) -> str:
    parts = ["'titles'"] + [
        f"CASE WHEN {kind} IN ({', '.join(repr(t) for t in types)}) THEN ',{step}' ELSE '' END"
        for step, types in P.EVIDENCE_STEPS.items()
    ]
    return f"CASE WHEN {kind} = 'catalog' THEN 'catalog' ELSE {' || '.join(parts)} END"


def plan_case(kind: str) -> str:
    return "CASE " + kind + " " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in P.PLAN_STRATEGIES.items()) + " END"


def domain_terms(x: str) -> str:
    """Ordered priority terms of a question."""
    t = terms(x)
    parts = []
    for r in P.DOMAIN_RULES:
        keys = ", ".join(f"'{k}'" for k in r["keywords"])
        prio = ", ".join(f"'{k}'" for k in r["priority_terms"])
        parts.append(f"CASE WHEN list_has_any({t}, [{keys}]) THEN [{prio}] ELSE CAST([] AS VARCHAR[]) END")
    return distinct(f"list_concat({', '.join(parts)}, list_slice({t}, 1, 8))")


def hint_case(x: str, name: str, default: str) -> str:
    t = terms(x)
    parts = []
    for r in P.DOMAIN_RULES:
        keys = ", ".join(f"'{k}'" for k in r["keywords"])
        parts.append(f"CASE WHEN list_has_any({t}, [{keys}]) THEN '{r[name]}' END")
    return f"coalesce(nullif(concat_ws(' ', {', '.join(parts)}), ''), '{default}')"


def rerank(hits: str, questions: str, by: str = "query_id", name: str = "rr") -> str:
    """CTEs over a hit CTE; the last, ``name``, adds rerank_score and rank."""
    return f"""
    {name}q AS (SELECT query_id, lower(question) AS q_lower, list_distinct({terms("question")}) AS q_terms,
              {domain_terms("question")} AS prio FROM ({questions})),
    {name}0 AS (SELECT h.*, a.q_lower, a.q_terms, a.prio, lower(path || ' ' || text) AS joint,
              {terms("path || ' ' || text")} AS doc_terms, {terms("replace(path, '/', ' ')")} AS path_terms,
              min(retrieval_score) OVER (PARTITION BY {by}) AS lo, max(retrieval_score) OVER (PARTITION BY {by}) AS hi,
              count(*) OVER (PARTITION BY {by}) AS n_hits
            FROM {hits} h JOIN {name}q a USING (query_id)),
    {name}1 AS (SELECT *, CASE WHEN n_hits > 1 THEN retrieval_score
              + 0.35 * (CAST(len(list_filter(q_terms, lambda t: list_contains(doc_terms, t))) AS DOUBLE) / greatest(1, len(q_terms)))
              + 0.15 * (CAST(len(list_filter(q_terms, lambda t: list_contains(path_terms, t))) AS DOUBLE) / greatest(1, len(q_terms)))
              + 0.20 * (CAST(len(list_filter(prio, lambda t: list_contains(doc_terms, t))) AS DOUBLE) / greatest(1, len(prio)))
              + 0.10 * (CASE WHEN contains(joint, q_lower) THEN 1.0 ELSE 0.0 END)
              + 0.10 * (CASE WHEN hi = lo THEN 1.0 ELSE (retrieval_score - lo) / (hi - lo) END) END AS rerank_score,
              list_sort(list_filter(prio, lambda t: list_contains(doc_terms, t))) AS matched
            FROM {name}0),
    {name} AS (SELECT * EXCLUDE (q_lower, q_terms, prio, joint, doc_terms, path_terms, lo, hi, n_hits), row_number() OVER (PARTITION BY {by} ORDER BY rerank_score DESC NULLS LAST, retrieval_score DESC, ord) AS rank FROM {name}1)
    """


# --- one entry per query -----------------------------------------------------------------
ORACLES: dict[str, str] = {}


def add(name: str, sql: str) -> None:
    ORACLES[name] = sql


NON_PRINTABLE = rf"regexp_replace(regexp_replace(text, '[{WS}]', ' ', 'g'), '\p{{C}}', '', 'g')"
REASON = f"""CASE WHEN {strip("text")} = '' THEN 'empty or only whitespace'
  WHEN length({strip("text")}) < 10 THEN 'too short (less than 10 characters)'
  WHEN CAST(length({NON_PRINTABLE}) AS DOUBLE) / length(text) < 0.8
  THEN 'corrupted or binary (only ' || printf('%.1f', CAST(length({NON_PRINTABLE}) AS DOUBLE) / length(text) * 100) || '% printable)'
  ELSE '' END"""
add("validity_report", f"SELECT doc_id, reason = '' AS is_valid, reason FROM (SELECT doc_id, {REASON} AS reason FROM documents)")
add(
    "validity_counts",
    f"""SELECT CASE WHEN reason = '' THEN 'ok' ELSE 'rejected' END AS status, lang AS engine, count(*) AS files
        FROM (SELECT lang, {REASON} AS reason FROM documents) GROUP BY ALL""",
)
add("normalized_text", f"SELECT doc_id, md5({norm('text')}) AS norm_md5, length({norm('text')}) AS norm_chars FROM documents")
add(
    "text_snippets",
    f"""SELECT doc_id, {truncate("text", 180)} AS flat,
        CASE WHEN length({strip("text")}) <= 700 THEN {strip("text")}
        ELSE regexp_replace(left({strip("text")}, 700), '[{WS}]+$', '') || '...' END AS snippet FROM documents""",
)
add(
    "char_gram_counts",
    f"""SELECT conv_id, turn, len(g) AS n_grams, md5(array_to_string(list_sort(g), ',')) AS grams_md5
        FROM (SELECT conv_id, turn, {grams("n")} AS g FROM (SELECT conv_id, turn, {norm("text")} AS n FROM conversations))""",
)
add(
    "content_terms",
    f"SELECT doc_id, len(t) AS n_terms, md5(array_to_string(t, ' ')) AS terms_md5 FROM (SELECT doc_id, {terms('text')} AS t FROM documents)",
)
KW = rf"regexp_extract_all(text, '[A-Za-z0-9\x{{4e00}}-\x{{9fff}}]{{2,}}')"
add(
    "keywords_first40",
    f"""WITH w AS (SELECT doc_id, unnest({KW}) AS k, generate_subscripts({KW}, 1) AS pos FROM documents),
        f AS (SELECT doc_id, k, min(pos) AS pos FROM w GROUP BY 1, 2),
        r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS rn FROM f)
        SELECT d.doc_id, coalesce(string_agg(k, {SEP} ORDER BY pos), '') AS keywords
        FROM documents d LEFT JOIN r ON d.doc_id = r.doc_id AND rn <= 40 GROUP BY d.doc_id""",
)
add("token_counts", f"SELECT doc_id, len({tokens('text')}) AS n_tokens FROM documents")
add(
    "token_windows",
    f"""WITH t AS (SELECT doc_id, {tokens("text")} AS toks FROM documents),
        w AS (SELECT doc_id, toks, unnest(range(0, len(toks), 160)) AS s FROM t)
        SELECT doc_id, s // 160 AS window_no, array_to_string(list_slice(toks, s + 1, s + 200), '') AS window_text
        FROM w WHERE {strip("array_to_string(list_slice(toks, s + 1, s + 200), '')")} <> ''""",
)
add(
    "embedding_texts",
    f"""WITH {MD}, e AS (SELECT path AS doc_id, 'Path: corpus/' || path || chr(10) || 'Title: ' || {strip("title")} || chr(10) || 'Headings: '
          || array_to_string(list_transform(regexp_extract_all(body, '{HEADING_RE}', 1), lambda h: {collapse("h")}), ' | ')
          || chr(10) || chr(10) || {strip("body")} AS x FROM md)
        SELECT doc_id, md5(array_to_string(list_slice({tokens("x")}, 1, 300), '')) AS embed_md5 FROM e""",
)
FORMULA_RE = rf"(?is)```math[{WS}]*(.*?)```|\$\$(.*?)\$\$"
add(
    "content_types",
    f"""WITH {MD}, f AS (SELECT path, body || chr(10) AS body, regexp_matches(body, '{FORMULA_RE}') AS has_formula,
          regexp_matches(body, '(?m)^[{WS}]*\\|.+\\|[{WS}]*$') AS has_table FROM md)
        SELECT path, has_formula, has_table, CASE WHEN has_formula THEN 'formula' WHEN has_table THEN 'table'
          WHEN {any_of("body", P.THRESHOLD_MARKERS)} AND regexp_matches(body, '\\d') THEN 'threshold'
          WHEN {any_of("body", P.OBLIGATION_MARKERS)} THEN 'obligation' ELSE 'semantic' END AS content_type,
          nullif(regexp_extract(body, '{P.ARTICLE_AT_START}'), '') AS article_no,
          nullif(regexp_extract(body, '{P.CLAUSE_AT_START}'), '') AS clause_no FROM f""",
)
add(
    "source_urls",
    f"""WITH {PAGES} SELECT page_id, 'https://host.example/blob/main/' || lang || '/'
        || replace(url_encode(title), '+', '%20') || '.md' AS url FROM pf""",
)
add("canonical_ids", "SELECT doc_id, source || '/' || CAST(doc_id AS VARCHAR) AS canonical_id FROM documents")
add("json_recovery", "SELECT event_id, props AS payload FROM events")
add(
    "message_texts",
    f"""SELECT conv_id, turn, {strip("concat_ws(chr(10), nullif(" + strip("text") + ", ''), '[tool:' || role || ']')")} AS message
        FROM conversations""",
)
NO_TITLE = f"""'# ' || title || chr(10) || chr(10) || ltrim(array_to_string(paragraphs, chr(10) || chr(10)) || chr(10) || chr(10)
  || array_to_string(list_transform(links, lambda a: '[link](/' || a || ')'), ' '), chr(10))"""
LINE_TABLE = f"""
  l AS (SELECT path, unnest(string_split(body, chr(10))) AS line, generate_subscripts(string_split(body, chr(10)), 1) AS pos FROM md),
  ink AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY pos) AS ink_no FROM l WHERE {strip("line")} <> ''),
  prev AS (SELECT *, lag(line) OVER (PARTITION BY path ORDER BY ink_no) AS before,
                  lag(pos) OVER (PARTITION BY path ORDER BY ink_no) AS before_pos FROM ink),
  gone AS (SELECT path, before_pos, pos FROM prev
           WHERE regexp_matches(line, '^[{WS}]*#{{1,6}}[{WS}]+[^{WS}]') AND {strip("line")} = {strip("before")})
"""
KEPT = """
  kept AS (SELECT l.* FROM l ANTI JOIN gone g ON l.path = g.path AND l.pos > g.before_pos AND l.pos <= g.pos)
"""
add(
    "heading_dedupe",
    f"""WITH {MD}, {LINE_TABLE}, {KEPT}
        SELECT path, string_agg(line, chr(10) ORDER BY pos) AS body FROM kept GROUP BY path""",
)
add(
    "leading_title",
    f"""WITH {MD} SELECT path, CASE WHEN {strip("title")} = {strip("h1")} THEN {NO_TITLE} ELSE body END || chr(10) AS body FROM md""",
)
add(
    "corpus_manifest",
    f"""WITH {MD} SELECT path, {strip("title")} AS title, '' AS category, '.html' AS source_type, '' AS source_file,
        url AS source_url, '' AS publish_date, '' AS converted_engine FROM md""",
)
add(
    "latex_repair",
    r"""SELECT p_partkey, '\mathrm{' || p_name || '}_{\text{' || p_type || '}} = \min(' || p_brand || ')' AS latex FROM part""",
)
add(
    "html_title",
    f"""WITH {PAGES} SELECT page_id, {strip("html_unescape(title)")} AS title, '' AS publish_date, '' AS content_source FROM pf""".replace(
        "html_unescape(title)", "regexp_replace(regexp_replace(regexp_replace(regexp_replace(title, '&lt;?', '<', 'g'), '&gt;?', '>', 'g'), '&quot;?', '\"', 'g'), '&amp;?', '&', 'g')"
    ),
)
add(
    "asset_references",
    rf"""WITH {PAGES}, t AS (SELECT page_id AS path, array_to_string(list_transform(links, lambda a: '![x](' || a || '_images/1.png)'), ' ') AS text FROM pf)
        SELECT DISTINCT path, unnest(regexp_extract_all(text, '\(([^)]+?_images)/[^)]+\)', 1)) AS asset_dir FROM t""",
)
add(
    "dangling_assets",
    f"""WITH {PAGES}, a AS (SELECT DISTINCT page_id AS path, unnest(links) AS a FROM pf)
        SELECT path, a || '_images' AS asset_dir FROM a x
        WHERE NOT EXISTS (SELECT 1 FROM a y WHERE y.path = x.path AND lower(y.a) = x.a)""",
)
add(
    "source_jobs",
    f"""WITH {PAGES}
        SELECT p AS input_path, p AS source_path, e AS source_type, CAST(p_partkey AS VARCHAR) AS title, '' AS source_url,
          '' AS publish_date, '' AS content_source, CASE e WHEN '.pdf' THEN 'opendataloader,mistral' ELSE 'local' END AS preferred_engines
        FROM (SELECT *, p_type || '/' || CAST(p_partkey AS VARCHAR) || e AS p
              FROM (SELECT *, CASE WHEN p_size > 25 THEN '.pdf' ELSE '.xlsx' END AS e FROM part))
        UNION ALL
        SELECT lang || '/' || CAST(page_id AS VARCHAR) || '.html', lang || '/' || CAST(page_id AS VARCHAR) || '.html', '.mhtml', title, url, '', '', 'html_local'
        FROM pf""",
)
# Paragraphs of the page Markdown: blank-line blocks without heading and table lines.
PARA = f"""
  lines AS (SELECT path, {strip("unnest(string_split(body, chr(10)))")} AS line, generate_subscripts(string_split(body, chr(10)), 1) AS pos FROM md),
  marked AS (SELECT *, line = '' OR starts_with(line, '|') OR starts_with(line, '#') AS stops FROM lines),
  grouped AS (SELECT *, sum(CASE WHEN stops THEN 1 ELSE 0 END) OVER (PARTITION BY path ORDER BY pos) AS island FROM marked),
  paras AS (SELECT path, island, string_agg(line, ' ' ORDER BY pos) AS para FROM grouped WHERE NOT stops GROUP BY 1, 2),
  ranked_paras AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY island) AS n FROM paras),
  intro AS (SELECT m.path, coalesce(list(para ORDER BY n) FILTER (n <= 8), []) AS paragraphs
            FROM md m LEFT JOIN ranked_paras r USING (path) GROUP BY 1)
"""
add(
    "intro_paragraphs",
    f"""WITH {MD}, {PARA} SELECT path, coalesce({joined("paragraphs")}, '') AS paragraphs FROM intro""",
)
NOISE = rf"""({norm("p")} = '' OR {norm("p")} = title_norm OR regexp_full_match(p, '{P.ATTACHMENT_NO}') OR length(p) < 8
  OR regexp_matches(p, '^(?:!\[[^\]]*\]\([^)]+\)[{WS}]*)+$')
  OR regexp_matches(p, '^(?:(?:\[[^\]]+\]\([^)]+\))|(?:https?://[^{WS}]+))(?:[{WS}]+(?:(?:\[[^\]]+\]\([^)]+\))|(?:https?://[^{WS}]+)))*$')
  OR regexp_matches(p, '^[A-Za-z\x{{4e00}}-\x{{9fff}}]{{1,12}}〔?\d{{4}}〕?\d+号$') OR regexp_matches(p, '{P.RECIPIENT_LINE}')
  OR regexp_matches(p, '^(?:{"|".join(P.SUMMARY_METADATA_LABELS)})[：:]'))"""
HEADINGS = f"list_filter(list_transform(regexp_extract_all(body, '{HEADING_RE}', 1), lambda h: {collapse('h')}), lambda h: h <> '')"
CATALOG_TAIL = f"""{PARA},
  base AS (SELECT m.path AS doc_id, 'corpus/' || m.path AS path, {strip("title")} AS title, lang AS category, body,
             list_slice({HEADINGS}, 1, 8) AS headings, i.paragraphs AS paras, {norm("title")} AS title_norm,
             split_part(split_part(m.path, '/', 2), '.', 1) AS stem
           FROM md m JOIN intro i ON m.path = i.path),
  cand AS (SELECT b.*, list_filter(paras, lambda p: NOT {NOISE}) AS cands FROM base b),
  picked AS (SELECT *, CASE WHEN len(cands) > 0 THEN cands ELSE paras END AS chosen,
               list_filter([title, stem], lambda a: {norm("a")} <> '') AS aliases FROM cand),
  cat AS (SELECT *, {keywords("array_to_string(list_concat([title], headings, aliases, list_slice(chosen, 1, 2)), chr(10))")} AS keywords FROM picked)
"""
CATALOG = f"{MD}, {CATALOG_TAIL}"
STRUCTURED = f"""concat_ws(chr(10), '标题：' || title,
  CASE WHEN len(headings) > 0 THEN '重点章节：' || array_to_string(list_slice(headings, 1, 4), '；') END,
  CASE WHEN len(chosen) > 0 THEN '内容摘要：' || array_to_string(list_transform(list_slice(chosen, 1, 2), lambda p: {truncate("p", 120)}), ' ') END)"""
add(
    "catalog_build",
    f"""WITH {CATALOG} SELECT doc_id, path, title, category, '.html' AS source_type, '' AS publish_date,
        coalesce({truncate("chosen[1]", 180)}, title) AS summary_short, {STRUCTURED} AS summary_structured,
        coalesce({joined("headings")}, '') AS headings, {joined("aliases")} AS aliases, {joined("keywords")} AS keywords,
        {joined("list_slice(" + distinct("list_concat(headings, keywords)") + ", 1, 5)")} AS focus_points FROM cat""",
)
add(
    "title_aliases",
    f"""WITH {CATALOG}, a AS (SELECT title AS alias, doc_id, title, category, 'title' AS alias_type FROM cat WHERE title_norm <> ''
          UNION ALL SELECT stem, doc_id, title, category, 'stem' FROM cat)
        SELECT alias, {norm("alias")} AS normalized_alias, doc_id, title, category, alias_type FROM a""",
)
add(
    "catalog_fallback",
    f"""WITH {CATALOG} SELECT doc_id, title, category, coalesce({truncate("fp[1]", 140)}, title) AS summary_short,
        coalesce({joined("list_slice(headings, 1, 6)")}, '') AS headings, {joined("fk")} AS keywords
        FROM (SELECT *, list_slice(paras, 1, 3) AS fp,
              {keywords("array_to_string(list_concat([title], list_slice(headings, 1, 6), aliases), chr(10))", 30)} AS fk FROM cat)""",
)
BLOCKS = f"""
  raw AS (SELECT path, unnest(string_split(body, chr(10))) AS line, generate_subscripts(string_split(body, chr(10)), 1) AS pos FROM md),
  kinds AS (SELECT *, CASE WHEN {strip("line")} = '' THEN 'blank' WHEN regexp_matches(line, '^#{{1,6}}[{WS}]+.') THEN 'heading'
              WHEN regexp_matches(line, '^[{WS}]*\\|.+\\|[{WS}]*$') THEN 'table' ELSE 'paragraph' END AS kind FROM raw),
  edges AS (SELECT *, CASE WHEN kind IN ('heading', 'blank') OR kind <> coalesce(lag(kind) OVER (PARTITION BY path ORDER BY pos), '') THEN 1 ELSE 0 END AS starts FROM kinds),
  runs AS (SELECT *, sum(starts) OVER (PARTITION BY path ORDER BY pos) AS run FROM edges),
  blocks AS (SELECT path, run, any_value(kind) AS kind, string_agg(line, chr(10) ORDER BY pos) AS t FROM runs WHERE kind <> 'blank' GROUP BY 1, 2)
"""
add(
    "line_blocks",
    f"""WITH {MD}, {BLOCKS}
        SELECT path, row_number() OVER (PARTITION BY path ORDER BY run) - 1 AS block_no, kind,
          CASE WHEN kind = 'heading' THEN length(regexp_extract(t, '^(#+)', 1)) ELSE 0 END AS level,
          CASE WHEN kind = 'heading' THEN {collapse("regexp_replace(t, '^#+', '')")} ELSE {strip("t")} END AS text FROM blocks""",
)

# --- graph -------------------------------------------------------------------------------
LINKS_TAIL = f"""
  target AS (SELECT regexp_extract(title, '^(\\S+)', 1) AS no, max(path) AS target FROM md WHERE regexp_matches(title, '^\\S+') GROUP BY 1),
  ment AS (SELECT path AS source, body, unnest({distinct("m")}) AS no, generate_subscripts({distinct("m")}, 1) AS pos
           FROM (SELECT path, body, regexp_extract_all(body, '\\]\\(/([^)\\s]+)\\)', 1) AS m FROM md)),
  res AS (SELECT m.*, t.target FROM ment m JOIN target t USING (no) WHERE source <> target),
  typed AS (SELECT *, 'mentions_rule' AS relation, 0 AS rr FROM res UNION ALL
            SELECT *, 'applies_to_rule', 1 FROM res WHERE {any_of("replace(body, ' ', '')", P.WEB.apply_markers)}),
  edge AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source, target, relation ORDER BY pos) AS rn FROM typed) WHERE rn = 1)
"""
LINKS = f"{MD}, {LINKS_TAIL}"
add(
    "mention_edges",
    f"""WITH {LINKS} SELECT source, target, relation, '/' || no AS label, source || '#section-1' AS evidence_section_id,
        {truncate("body", 260)} AS evidence_text_preview, '' AS effective_date,
        CAST(CASE WHEN relation = 'mentions_rule' THEN 0.55 ELSE 0.72 END AS DOUBLE) AS confidence FROM edge""",
)
add(
    "related_ids",
    f"""WITH {LINKS}, f AS (SELECT source, target, min(pos) AS pos FROM edge GROUP BY 1, 2)
        SELECT source AS doc_id, string_agg(target, {SEP} ORDER BY pos) AS related_doc_ids FROM f GROUP BY 1""",
)
PLACES = """
  cat AS (SELECT 'nation/' || n_nationkey AS doc_id, n_name AS title, 'rules' AS category FROM nation
          UNION ALL SELECT 'region/' || r_regionkey, r_name, 'rules' FROM region
          UNION ALL SELECT 'supplier/' || s_suppkey, s_name, 'notices' FROM supplier
          UNION ALL SELECT 'customer/' || c_custkey, c_name, 'attachments' FROM customer),
  edge AS (SELECT 'customer/' || c_custkey AS source, 'nation/' || c_nationkey AS target, 'mentions_rule' AS relation FROM customer
           UNION ALL SELECT 'supplier/' || s_suppkey, 'nation/' || s_nationkey, 'adjusts_rule' FROM supplier
           UNION ALL SELECT 'nation/' || n_nationkey, 'region/' || n_regionkey, 'applies_to_rule' FROM nation)
"""
add(
    "enriched_edges",
    f"""WITH {PLACES} SELECT source, target, relation, coalesce(s.title, '') AS source_title, coalesce(t.title, '') AS target_title,
        'corpus/' || source AS source_path, 'corpus/' || target AS target_path
        FROM edge LEFT JOIN cat s ON s.doc_id = source LEFT JOIN cat t ON t.doc_id = target""",
)


def trace(condition: str, scope: str) -> str:
    return f"""WITH {PLACES}, scope AS ({scope}),
      m AS (SELECT DISTINCT query_id, source, target, relation FROM edge JOIN scope ON {condition}),
      r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY source || '|' || target, source, target, relation) AS edge_rank FROM m)
      SELECT * FROM r WHERE edge_rank <= 20"""


NATIONS = "SELECT n_nationkey AS query_id, 'nation/' || n_nationkey AS doc_id FROM nation"
add("relations_in_out", trace("doc_id = source OR doc_id = target", NATIONS))
add("notice_traces", trace("doc_id = target AND source IN (SELECT doc_id FROM cat WHERE category = 'notices')", NATIONS))
add(
    "adjustment_traces",
    trace(
        f"doc_id = source AND relation IN ({', '.join(repr(r) for r in (*P.SEMANTIC_RELATIONS, 'mentions_rule'))})",
        "SELECT s_nationkey AS query_id, 'supplier/' || s_suppkey AS doc_id FROM supplier",
    ),
)
# --- retrieval ---------------------------------------------------------------------------
add("lexical_topk", f"WITH {lexical(DOC_Q, DOC_H, 90.0, 5)} SELECT query_id, rank, doc_id, score FROM ranked WHERE rank <= 5")
add(
    "scoped_search",
    f"""WITH {lexical(DOC_Q, DOC_H + " SEMI JOIN (SELECT doc_id FROM labels WHERE quality = 1) USING (doc_id)", 90.0, 5, extra="35.0")}
        SELECT query_id, rank, doc_id, score FROM ranked WHERE rank <= 5""",
)
add(
    "keyword_search",
    f"""WITH {PAGES}, {TITLE_Q},
        kw AS (SELECT page_id AS doc_id, unnest(list_distinct({keywords("title")})) AS k FROM pf),
        {lexical(f"SELECT query_id, {norm('question')} AS q_norm FROM tq", f"SELECT page_id AS doc_id, {norm('title')} AS h_norm FROM pf", 90.0, 5)},
        kwhit AS (SELECT query_id, doc_id, least(count(*), 5) AS n FROM kw JOIN q ON contains(q_norm, {norm("k")}) GROUP BY ALL),
        both_ AS (SELECT query_id, doc_id, round_even(
              CASE WHEN contains(h.h_norm, q.q_norm) AND q_norm <> '' THEN 90.0 ELSE 0.0 END + coalesce(CAST(c AS DOUBLE) / qn.n, 0.0) * 60.0
              + least(40.0, 8.0 * coalesce(k.n, 0)), 4) AS score
            FROM (SELECT query_id, doc_id FROM shared UNION SELECT query_id, doc_id FROM kwhit)
            JOIN q USING (query_id) JOIN h USING (doc_id) LEFT JOIN qn USING (query_id) LEFT JOIN shared USING (query_id, doc_id)
            LEFT JOIN kwhit k USING (query_id, doc_id)),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM both_ WHERE score <> 0)
        SELECT query_id, rank, doc_id, score FROM r WHERE rank <= 5""",
)
add(
    "question_scope_search",
    f"""WITH turns AS (SELECT conv_id AS query_id, arg_max(text, turn) AS question FROM conversations WHERE role = 'user' GROUP BY 1),
        p AS (SELECT t.query_id, d.doc_id, {norm("question")} AS q_norm, {norm("d.text")} AS h_norm
              FROM turns t JOIN labels l ON l.doc_id = t.query_id JOIN documents d ON d.doc_id = l.doc_id),
        g AS (SELECT *, {grams("q_norm")} AS gs FROM p),
        s AS (SELECT *, len(list_filter(gs, lambda x: contains(h_norm, x))) AS c, contains(h_norm, q_norm) AND q_norm <> '' AND h_norm <> '' AS inside FROM g)
        SELECT query_id, doc_id, round_even(CASE WHEN inside THEN 90.0 ELSE 0.0 END
          + CASE WHEN len(gs) > 0 AND h_norm <> '' THEN CAST(c AS DOUBLE) / len(gs) ELSE 0.0 END * 60.0 + 35.0, 4) AS score,
          concat_ws('；', CASE WHEN inside THEN '{P.REASON_CONTAINED}' END, CASE WHEN c > 0 THEN '{P.REASON_GRAMS}' END, '{P.REASON_SCOPED}') AS reason FROM s""",
)
LADDER = f"""{CATALOG}, {TITLE_Q},
  c AS (SELECT doc_id, title, title_norm AS t_norm, {norm("stem")} AS s_norm, stem, keywords FROM cat),
  qq AS (SELECT query_id, question, {norm("question")} AS q_norm FROM tq),
  focus AS (SELECT doc_id, unnest(list_filter(list_transform(list_slice(list_filter(list_transform(regexp_split_to_array(title, '[：:]'), lambda s: {strip("s")}), lambda s: s <> ''), 2, 1000),
              lambda s: s), lambda s: length(s) >= 2 AND {norm("s")} <> '')) AS f FROM c),
  fhit AS (SELECT query_id, doc_id, count(*) AS n, min(f) AS f FROM focus JOIN qq ON contains(q_norm, {norm("f")}) AND q_norm <> '' GROUP BY 1, 2),
  pairs AS (SELECT qq.*, c.* FROM qq JOIN c ON q_norm <> ''),
  lad AS (SELECT p.query_id, p.doc_id, p.title, len(list_filter(keywords, lambda k: contains(question, k))) AS n_kw,
     CASE WHEN q_norm = t_norm THEN 200.0 WHEN q_norm = s_norm THEN 180.0 WHEN contains(t_norm, q_norm) THEN 150.0
       WHEN (t_norm <> '' AND contains(q_norm, t_norm)) OR contains(s_norm, q_norm) OR contains(q_norm, s_norm) THEN 120.0
       WHEN f.n IS NOT NULL THEN 90.0 END AS s,
     CASE WHEN q_norm = t_norm THEN '精确命中文档标题' WHEN q_norm = s_norm THEN '精确命中别名：' || stem WHEN contains(t_norm, q_norm) THEN '标题包含查询'
       WHEN t_norm <> '' AND contains(q_norm, t_norm) THEN '别名相关：' || p.title
       WHEN contains(s_norm, q_norm) OR contains(q_norm, s_norm) THEN '别名相关：' || stem
       WHEN f.n IS NOT NULL THEN '标题主题命中：' || f.f END AS why
     FROM pairs p LEFT JOIN fhit f USING (query_id, doc_id)),
  fin AS (SELECT query_id, doc_id, title, CAST(coalesce(s, n_kw * 10.0) AS DOUBLE) AS score, coalesce(why, '标题关键词相关') AS reason FROM lad WHERE s IS NOT NULL OR n_kw > 0),
  tr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, title DESC, doc_id) AS rank FROM fin)
"""
add("title_ladder", f"WITH {LADDER} SELECT query_id, rank, doc_id, title, score, reason FROM tr WHERE rank <= 5")
SCOPE = f"""{LADDER}, sc AS (
  SELECT query_id, max(doc_id) FILTER (rank = 1) AS top, max(score) FILTER (rank = 1) AS s1, coalesce(max(score) FILTER (rank = 2), 0.0) AS s2
  FROM tr GROUP BY 1)"""
add(
    "scope_resolution",
    f"""WITH {SCOPE} SELECT t.query_id, '' AS exact, CASE WHEN s1 >= 60 AND s1 >= s2 + 20 THEN top ELSE '' END AS scoped
        FROM tq t LEFT JOIN sc USING (query_id)""",
)
add(
    "alias_resolution",
    f"""WITH {PLACES},
        q AS (SELECT s_suppkey AS query_id, {norm("'about ' || s_name")} AS q_norm FROM supplier),
        h AS (SELECT doc_id, {norm("concat_ws(chr(10), title, title, category)")} AS h_norm, {norm("title")} AS alias FROM cat),
        qg AS (SELECT query_id, unnest({grams("q_norm")}) AS g FROM q), qn AS (SELECT query_id, count(*) AS n FROM qg GROUP BY 1),
        hg AS (SELECT doc_id, unnest({grams("h_norm")}) AS g FROM h),
        shared AS (SELECT query_id, doc_id, count(*) AS c FROM qg JOIN hg USING (g) GROUP BY ALL),
        s AS (SELECT query_id, doc_id, round_even(CASE WHEN contains(h_norm, q_norm) THEN 80.0 ELSE 0.0 END + CAST(c AS DOUBLE) / n * 60.0, 4) AS lex,
               CASE WHEN alias = q_norm THEN 200.0 WHEN contains(q_norm, alias) OR contains(alias, q_norm) THEN 120.0 ELSE 0.0 END AS al
             FROM shared JOIN q USING (query_id) JOIN qn USING (query_id) JOIN h USING (doc_id)),
        r AS (SELECT *, greatest(lex, al) AS score, row_number() OVER (PARTITION BY query_id ORDER BY greatest(lex, al) DESC, (al >= lex) DESC, doc_id) AS rank FROM s)
        SELECT query_id, rank, doc_id, score FROM r WHERE rank <= 5""",
)
add(
    "vector_topk",
    """WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
       u AS (SELECT vec_id, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) AS e FROM v),
       s AS (SELECT a.vec_id AS query_id, b.vec_id, list_dot_product(a.e, b.e) AS score FROM u a JOIN u b ON TRUE),
       r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s WHERE score >= 0)
       SELECT query_id, rank, vec_id, round(score, 4) AS score FROM r WHERE rank <= 5""",
)
add(
    "unit_vectors",
    """WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)
       SELECT vec_id, round(list_max(list_transform(e, lambda x: x / sqrt(list_dot_product(e, e)))), 6) AS largest, CAST(1.0 AS DOUBLE) AS norm FROM v""",
)
add("vector_dimensions", "SELECT len(embedding) = 64 AS usable, count(*) AS vectors FROM embeddings GROUP BY 1")
add("merge_hits", f"WITH {LEX10} SELECT query_id, path, min(ord) AS ord, max(retrieval_score) AS retrieval_score FROM hits GROUP BY query_id, path, text")
BENCH_Q = "SELECT item_id AS query_id, text AS question FROM benchmark"
add(
    "reranked_hits",
    f"""WITH {LEX10}, {rerank("hits", BENCH_Q)}
        SELECT query_id, rank, doc_id, round(rerank_score, 6) AS rerank_score, coalesce(array_to_string(matched, ','), '') AS domain_terms_matched FROM rr WHERE rank <= 5""",
)
add(
    "domain_contexts",
    f"""SELECT conv_id, turn, {hint_case("text", "planner_hint", P.DEFAULT_PLANNER_HINT)} AS planner_hint,
        {hint_case("text", "reflector_hint", P.DEFAULT_REFLECTOR_HINT)} AS reflector_hint,
        coalesce(array_to_string({domain_terms("text")}, ','), '') AS priority_terms FROM conversations WHERE role = 'user'""",
)
TURN_HITS = f"""th AS (SELECT conv_id AS query_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rank,
  'conv/' || turn || '.md' AS path, text, len({tokens("text")}) AS n FROM conversations WHERE role = 'assistant')"""
TURN_FOLD = """
        fold AS (SELECT query_id, turn, rank, n AS total, 1 AS picked, TRUE AS taken, (n >= 400 OR 1 >= 3) AS done FROM th WHERE rank = 1
          UNION ALL
          SELECT t.query_id, t.turn, t.rank, CASE WHEN ok THEN f.total + t.n ELSE f.total END, CASE WHEN ok THEN f.picked + 1 ELSE f.picked END, ok,
            f.done OR (ok AND (f.total + t.n >= 400 OR f.picked + 1 >= 3))
          FROM fold f JOIN (SELECT * FROM th) t ON t.query_id = f.query_id AND t.rank = f.rank + 1,
          LATERAL (SELECT NOT f.done AND f.total + t.n <= 400 AS ok))"""
add(
    "context_budget",
    f"""WITH RECURSIVE {TURN_HITS}, {TURN_FOLD} SELECT query_id, turn, rank FROM fold WHERE taken""",
)
add(
    "rendered_context",
    f"""WITH RECURSIVE {TURN_HITS}, {TURN_FOLD},
        kept AS (SELECT th.*, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS n_kept FROM th SEMI JOIN (SELECT * FROM fold WHERE taken) f USING (query_id, rank))
        SELECT query_id, string_agg('[' || n_kept || '] ' || path || chr(10) || text, chr(10) || chr(10) ORDER BY n_kept) AS context FROM kept GROUP BY 1""",
)
add(
    "answer_sources",
    f"""WITH {TURN_HITS} SELECT query_id, rank AS index, path, 'https://host.example/blob/main/' || path AS url,
        CASE WHEN length({strip("text")}) <= 700 THEN {strip("text")}
        ELSE regexp_replace(left({strip("text")}, 700), '[{WS}]+$', '') || '...' END AS snippet, path AS heading FROM th""",
)
SUBS = f"""
  s0 AS (SELECT item_id AS question_id, text AS q, 0 AS o FROM benchmark UNION ALL SELECT item_id, split_part(text, '.', 1), 1 FROM benchmark),
  s1 AS (SELECT question_id, o, {strip("trim(" + strip("q") + ", '-')")} AS query FROM s0),
  subs AS (SELECT question_id, query, row_number() OVER (PARTITION BY question_id ORDER BY o) - 1 AS query_ord
           FROM (SELECT *, row_number() OVER (PARTITION BY question_id, lower(query) ORDER BY o) AS dup FROM s1 WHERE query <> '') WHERE dup = 1)
"""
add(
    "multi_query",
    f"""WITH {SUBS}, {lexical(f"SELECT question_id * 10 + query_ord AS query_id, {norm('query')} AS q_norm FROM subs", DOC_H, 90.0, 4)},
        hit AS (SELECT query_id // 10 AS question_id, query_id % 10 AS query_ord, rank, r.doc_id, d.text FROM ranked r JOIN documents d USING (doc_id) WHERE rank <= 4),
        first_ AS (SELECT question_id, query_ord, rank, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY question_id, doc_id, text ORDER BY query_ord, rank) AS f FROM hit) WHERE f = 1)
        SELECT s.question_id, s.query_ord, s.query, count(doc_id) AS new_hits, coalesce(string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY rank), '') AS paths
        FROM subs s LEFT JOIN first_ f ON s.question_id = f.question_id AND s.query_ord = f.query_ord GROUP BY 1, 2, 3""",
)
add(
    "multi_query_hits",
    f"""WITH {SUBS}, {lexical(f"SELECT question_id * 10 + query_ord AS query_id, {norm('query')} AS q_norm FROM subs", DOC_H, 90.0, 4)},
        hit AS (SELECT query_id // 10 AS question_id, query_id % 10 AS query_ord, rank, r.doc_id, d.text, r.score / 100.0 AS retrieval_score
                FROM ranked r JOIN documents d USING (doc_id) WHERE rank <= 4),
        first_ AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question_id, doc_id, text ORDER BY query_ord, rank) AS f FROM hit) WHERE f = 1),
        pool AS (SELECT question_id AS query_id, row_number() OVER (PARTITION BY question_id ORDER BY query_ord, rank) AS ord,
                 CAST(doc_id AS VARCHAR) AS path, text, retrieval_score FROM first_),
        {rerank("pool", BENCH_Q, "query_id", "rr")}
        SELECT query_id, rank, path, round(rerank_score, 6) AS rerank_score FROM rr WHERE rank <= 8""",
)
add("json_lines_scan", "SELECT conv_id, turn, role, text FROM conversations")
add(
    "stored_vectors",
    """SELECT vec_id, len(embedding) AS dimension, CASE WHEN norm > 0 THEN 1.0 ELSE 0.0 END AS norm,
        round(CAST(list_max(embedding) AS DOUBLE) / CASE WHEN norm > 0 THEN norm ELSE 1.0 END, 4) AS largest
        FROM (SELECT *, sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))) AS norm FROM embeddings)""",
)
# --- routing and conversations -----------------------------------------------------------
add(
    "question_routing",
    f"""SELECT conv_id, turn, question_type, strategy, is_count, needs_history, {plan_case("question_type")} AS plan_strategy,
        {steps_case("question_type")} AS steps FROM (SELECT conv_id, turn, {type_case("text")} AS question_type, {strategy_case("text")} AS strategy,
        {any_of("text", P.COUNT_QUERY_MARKERS)} AND {any_of("text", P.COUNT_SCOPE_MARKERS)} AS is_count, {followup("text")} AS needs_history
        FROM conversations WHERE role = 'user')""",
)
ROUTED = """['规则第{}号和规则第2号的区别', '监管规则一共有多少号规定？', '最低资本的计算公式是什么', '优化监管标准的通知修订了什么',
  '保险公司是否需要报送', '规则第{}号的主要内容', '附件{}在哪里', 'why is it so', '那它的定义呢', '偿付能力充足率的定义']"""
CONTENTS = """['第三条 资本为 $$x_{}$$ 。', '第四条 见表' || chr(10) || '| a | b |' || chr(10) || '| 1 | {} |', '第五条 保险公司的职责。',
  '其中' || chr(10) || '$$' || chr(10) || 'y_{}' || chr(10) || '$$', '| a | {} |' || chr(10) || '| c | d |',
  '比例上限为 {}%', '公司应当提交报告', '一般说明', '（一）本款说明 {}', '第{}条']"""


def form(forms: str) -> str:
    return f"replace(({forms})[p_partkey % 10 + 1], '{{}}', CAST(p_size AS VARCHAR))"


add(
    "routing_branches",
    f"""SELECT p_partkey, question_type, strategy, is_count, needs_history, {plan_case("question_type")} AS plan_strategy, {steps_case("question_type")} AS steps
        FROM (SELECT p_partkey, {type_case("said")} AS question_type, {strategy_case("said")} AS strategy,
        {any_of("said", P.COUNT_QUERY_MARKERS)} AND {any_of("said", P.COUNT_SCOPE_MARKERS)} AS is_count, {followup("said")} AS needs_history
        FROM (SELECT p_partkey, {form(ROUTED)} AS said FROM part))""",
)
add(
    "content_branches",
    f"""WITH f AS (SELECT p_partkey, body, regexp_matches(body, '{FORMULA_RE}') AS has_formula,
          regexp_matches(body, '(?m)^[{WS}]*\\|.+\\|[{WS}]*$') AS has_table FROM (SELECT p_partkey, {form(CONTENTS)} AS body FROM part))
        SELECT p_partkey, has_formula, has_table, CASE WHEN regexp_matches({strip("body")}, '{P.ARTICLE_AT_START}')
            THEN CASE WHEN has_formula THEN 'article_formula' WHEN has_table THEN 'article_table' ELSE 'article' END
          WHEN has_formula THEN 'formula' WHEN has_table THEN 'table'
          WHEN {any_of("body", P.THRESHOLD_MARKERS)} AND regexp_matches(body, '\\d') THEN 'threshold'
          WHEN {any_of("body", P.OBLIGATION_MARKERS)} THEN 'obligation' ELSE 'semantic' END AS content_type,
          nullif(regexp_extract({strip("body")}, '{P.ARTICLE_AT_START}'), '') AS article_no,
          nullif(regexp_extract({strip("body")}, '{P.CLAUSE_AT_START}'), '') AS clause_no FROM f""",
)
REPAIRED = r"""['a &lt; {}', 'x $$a < {}$$', '\[ a > {} \]', '$$' || chr(10) || 'x_{\text{市场}_1} + y^{\text{信用}} + {}' || chr(10) || '$$', '$$0.148\%$$ {}',
  '$$x = -1.5$$ {}', '```math' || chr(10) || 'f=\begin{cases}' || chr(10) || '1 & a \\' || chr(10) || '{} & b' || chr(10) || '\end{cases}' || chr(10) || '```',
  '用 `ρ_ij` 表示 {}', '用 `k_1 = 0.5` 表示 {}', '用 $\frac{a}{b}$ 表示 {}']"""
add("math_branches", f"SELECT p_partkey, {form(REPAIRED)} AS text FROM part")


def header(values: dict[str, str]) -> str:
    """Header lines in their fixed order; a value with a sign of its own meaning is quoted."""
    def scalar(x: str) -> str:
        return f"CASE WHEN regexp_matches({x}, '[:#\\n\"]') OR starts_with({x}, ' ') OR ends_with({x}, ' ') THEN CAST(to_json({x}) AS VARCHAR) ELSE {x} END"

    return " || chr(10) || ".join(f"'{key}: ' || {scalar(values.get(key, chr(39) * 2))}" for key in P.FRONT_MATTER_KEYS)


add(
    "front_matter_render",
    f"""WITH {PAGES} SELECT page_id, md5('---' || chr(10) || {header({"title": "title", "category": "lang", "source_url": "url"})} || chr(10) || '---' || chr(10)
        || chr(10) || {strip("array_to_string(paragraphs, chr(10) || chr(10))")} || chr(10)) AS text_md5 FROM pf""",
)
add(
    "filename_hints",
    f"""SELECT p_partkey, '规则第' || p_size || '号,附件' || p_partkey || '-1' AS hints, {type_case("said")} AS question_type,
        {strategy_case("said")} AS strategy, {followup("said")} AS needs_history
        FROM (SELECT *, '规则第' || p_size || '号和附件' || p_partkey || '-1的关系' AS said FROM part)""",
)
SAID = f"""said AS (SELECT conv_id, turn, role, {strip("text")} AS text FROM conversations WHERE role IN ('user', 'assistant') AND {strip("text")} <> ''),
  back AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS b FROM said)"""
add(
    "history_window",
    f"""WITH {SAID}, e AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM back WHERE b BETWEEN 2 AND 13),
        h AS (SELECT conv_id, string_agg('Turn ' || i || chr(10) || 'Role: ' || role || chr(10) || 'Text: ' || text, chr(10) || chr(10) ORDER BY i) AS history FROM e GROUP BY 1)
        SELECT b.conv_id, b.text AS question, right(coalesce(history, ''), 12000) AS history FROM back b LEFT JOIN h USING (conv_id) WHERE b = 1 AND role = 'user'""".replace(
        "WHERE b = 1 AND role", "WHERE b.b = 1 AND b.role"
    ),
)
add(
    "rejected_conversations",
    f"""WITH {SAID} SELECT DISTINCT conv_id FROM conversations WHERE conv_id NOT IN (SELECT conv_id FROM back WHERE b = 1 AND role = 'user')""",
)
add(
    "citation_audit",
    r"""WITH a AS (SELECT conv_id, turn, regexp_extract_all(text, '\[(\d+)\]', 1) AS inner_ FROM conversations WHERE role = 'assistant'),
       c AS (SELECT DISTINCT conv_id, turn, unnest(list_concat(list_transform(inner_, lambda x: CAST(x AS BIGINT)), [turn, 0])) AS index FROM a)
       SELECT conv_id || ':' || turn AS answer_id, index FROM c
       WHERE NOT EXISTS (SELECT 1 FROM conversations u WHERE u.role = 'user' AND u.conv_id = c.conv_id AND u.turn = c.index)""",
)
add(
    "linked_citations",
    r"""SELECT conv_id, turn, text || ' [1](https://host.example/' || conv_id || ') [2] $x_{[1]}$ [1](u)' AS answer FROM conversations WHERE role = 'assistant'""",
)
PARTS = """m AS (SELECT p_partkey AS no, 'rules/' || p_partkey || '.md' AS path,
  CASE WHEN p_size > 5 THEN '规则第' || p_partkey || '号：' || p_name ELSE p_name END AS title, p_type = 'ECONOMY' AS is_rule, p_size > 5 AS numbered FROM part)"""
add(
    "catalog_count",
    f"""WITH {PARTS}, f AS (SELECT count(*) AS n, min(no) AS lo, max(no) AS hi, arg_min(title, no) AS t1, arg_min(path, no) AS p1,
          arg_max(title, no) AS t2, arg_max(path, no) AS p2 FROM m WHERE is_rule AND numbered)
        SELECT n_nationkey AS query_id, '根据当前知识库清单，偿二代二期监管规则共收录 ' || n || ' 项，编号从第' || lo || '号到第' || hi || '号。 [1] Knowledge_Base_MarkDown/manifest.json' AS answer,
          '当前 manifest 共收录 ' || n || ' 份 `rules` 类文件。' || chr(10) || '规则编号范围：第' || lo || '号至第' || hi || '号。' || chr(10)
          || '- ' || t1 || ' (' || p1 || ')' || chr(10) || '- ' || t2 || ' (' || p2 || ')' AS text FROM nation JOIN f ON n > 0""",
)
add("catalog_evidence", f"WITH {PARTS} SELECT 'manifest 共收录 ' || count_if(is_rule) || ' 份 rules 类文件，可用于回答监管规则数量问题。' AS text, CAST(1.0 AS DOUBLE) AS score FROM m")
# --- quality -----------------------------------------------------------------------------
add(
    "artifact_counts",
    "SELECT " + ", ".join(f"(SELECT count(*) FROM {t}) AS {t}" for t in ("documents", "benchmark", "labels", "pages", "conversations", "embeddings")),
)
add(
    "field_validation",
    """SELECT 'doc_catalog' AS artifact, 'title' AS missing, count(*) AS rows, lpad(CAST(min(p_partkey) AS VARCHAR), 8, '0') AS first_key FROM part WHERE p_size <= 10
       UNION ALL SELECT 'doc_catalog', 'aliases', count(*), lpad(CAST(min(p_partkey) AS VARCHAR), 8, '0') FROM part""",
)
add("index_metadata", "SELECT 'document' AS artifact, 'title' AS missing, count(*) AS rows FROM documents")
add(
    "eval_hit_rate",
    f"""WITH {LADDER}, e AS (SELECT m.lang AS category, m.path IN (SELECT doc_id FROM tr WHERE tr.query_id = m.page_id AND rank <= 5) AS ok FROM md m)
        SELECT category, count(*) AS case_count, count_if(ok) AS passed, count(*) - count_if(ok) AS failed, round_even(CAST(count_if(ok) AS DOUBLE) / count(*), 4) AS pass_rate FROM e GROUP BY 1""",
)
add("hit_previews", f"WITH {TURN_HITS} SELECT query_id, rank, path, left({strip('text')}, 240) AS text_preview FROM th WHERE rank <= 2")


# --- sections ----------------------------------------------------------------------------
# Blocks are packed in order: a recursive scan carries the section number and the tokens held.
# The pages have level-one headings only, so the heading path is the last heading.
BUDGET = 1200


def n_tokens(x: str) -> str:
    return f"len({tokens(x)})"


SECTIONS = f"""
  {BLOCKS},
  ordered AS (SELECT path, row_number() OVER (PARTITION BY path ORDER BY run) AS i, kind,
      CASE WHEN kind = 'heading' THEN {collapse("regexp_replace(t, '^#+', '')")} ELSE {strip("t")} END AS b FROM blocks),
  costed AS (SELECT o.*, {n_tokens("b")} AS cost, last_value(CASE WHEN kind = 'heading' THEN b END IGNORE NULLS) OVER (PARTITION BY o.path ORDER BY i) AS heading,
      {strip("title")} AS title FROM ordered o JOIN md USING (path)),
  overhead AS (SELECT *, {n_tokens("'Document: ' || title || chr(10) || chr(10) || coalesce('Section: ' || heading || chr(10) || chr(10), '')")} AS extra FROM costed),
  packed AS (
    SELECT path, i, kind, b, cost, heading, title, CASE WHEN kind = 'heading' THEN 0 ELSE 1 END AS sec,
      CASE WHEN kind = 'heading' OR cost > {BUDGET} THEN 0 ELSE cost END AS used FROM overhead WHERE i = 1
    UNION ALL
    SELECT o.path, o.i, o.kind, o.b, o.cost, o.heading, o.title,
      CASE WHEN o.kind = 'heading' THEN p.sec
           WHEN p.used = 0 OR o.cost > {BUDGET} OR o.extra + p.used + 1 + o.cost > {BUDGET} THEN p.sec + 1 ELSE p.sec END,
      CASE WHEN o.kind = 'heading' OR o.cost > {BUDGET} THEN 0
           WHEN p.used = 0 OR o.extra + p.used + 1 + o.cost > {BUDGET} THEN o.cost ELSE p.used + 1 + o.cost END
    FROM packed p JOIN overhead o ON o.path = p.path AND o.i = p.i + 1),
  whole AS (SELECT path, sec, any_value(heading) AS heading, any_value(title) AS title, max(cost) AS cost,
      string_agg(b, chr(10) || chr(10) ORDER BY i) AS body FROM packed WHERE kind <> 'heading' GROUP BY 1, 2),
  split AS (SELECT path, sec, {strip("body")} AS body,
      list_filter(list_transform(string_split(regexp_replace(replace({strip("body")}, chr(10), ' '), '([。！？；.!?;])[{WS}]+', '\\1' || chr(1), 'g'), chr(1)),
        lambda x: {strip("x")}), lambda x: x <> '') AS ss,
      list_filter(list_transform(string_split({strip("body")}, chr(10)), lambda x: {strip("x")}), lambda x: x <> '') AS ls FROM whole WHERE cost > {BUDGET}),
  pieces AS (SELECT path, sec, CASE WHEN len(ss) > 1 THEN ss WHEN len(ls) > 1 THEN ls ELSE [body] END AS ps FROM split),
  sentences AS (SELECT path, sec, unnest(ps) AS s, generate_subscripts(ps, 1) AS j FROM pieces),
  sized AS (SELECT *, {n_tokens("s")} AS cost FROM sentences),
  joined AS (
    SELECT path, sec, s, j, cost, 1 AS piece, CASE WHEN cost > {BUDGET} THEN 0 ELSE cost END AS used FROM sized WHERE j = 1
    UNION ALL
    SELECT z.path, z.sec, z.s, z.j, z.cost, CASE WHEN p.used = 0 OR z.cost > {BUDGET} OR p.used + 1 + z.cost > {BUDGET} THEN p.piece + 1 ELSE p.piece END,
      CASE WHEN z.cost > {BUDGET} THEN 0 WHEN p.used = 0 OR p.used + 1 + z.cost > {BUDGET} THEN z.cost ELSE p.used + 1 + z.cost END
    FROM joined p JOIN sized z ON z.path = p.path AND z.sec = p.sec AND z.j = p.j + 1),
  long AS (SELECT path, sec, piece, {tokens("s")} AS found FROM joined WHERE cost > {BUDGET}),
  windows AS (SELECT path, sec, piece, w, {strip(f"array_to_string(found[w * {BUDGET} + 1 : (w + 1) * {BUDGET}], '')")} AS body
    FROM (SELECT *, unnest(range((len(found) + {BUDGET} - 1) // {BUDGET})) AS w FROM long)),
  cutup AS (
    SELECT path, sec, piece, 0 AS w, string_agg(s, ' ' ORDER BY j) AS body FROM joined WHERE cost <= {BUDGET} GROUP BY 1, 2, 3
    UNION ALL SELECT path, sec, piece, w, body FROM windows WHERE body <> ''),
  bodies AS (
    SELECT path, sec, 0 AS piece, 0 AS w, heading, title, body FROM whole WHERE cost <= {BUDGET}
    UNION ALL SELECT c.path, c.sec, c.piece, c.w, w.heading, w.title, c.body FROM cutup c JOIN whole w USING (path, sec)),
  sections AS (SELECT path, row_number() OVER (PARTITION BY path ORDER BY sec, piece, w) AS idx, coalesce(heading, title) AS heading,
      title, {strip("body")} AS text FROM bodies WHERE length(body) >= 10)
"""
SECTION_KEYWORDS = keywords(
    "array_to_string(list_concat([c.title], list_filter(list_transform(string_split(s.heading, '>'), lambda h: "
    + strip("h")
    + "), lambda h: h <> ''), c.aliases, [s.text]), chr(10))"
)
SECTION_ROWS = f"""
  {SECTIONS},
  srows AS (SELECT s.path || '#section-' || s.idx AS section_id, s.path AS doc_id, s.idx, s.heading AS section_heading,
      array_to_string(list_filter(list_transform(string_split(s.heading, '>'), lambda h: {strip("h")}), lambda h: h <> ''), {SEP}) AS heading_path,
      c.title, s.text, regexp_matches(s.text, '{FORMULA_RE}') AS has_formula, regexp_matches(s.text, '(?m)^[{WS}]*\\|.+\\|[{WS}]*$') AS has_table,
      {distinct("regexp_extract_all(s.text, '\\]\\(/([^)\\s]+)\\)', 1)")} AS mentions, {SECTION_KEYWORDS} AS keywords, {n_tokens("s.text")} AS token_count
    FROM sections s JOIN cat c ON c.doc_id = s.path),
  typed_rows AS (SELECT *, CASE WHEN has_formula THEN 'formula' WHEN has_table THEN 'table'
      WHEN {any_of("text", P.THRESHOLD_MARKERS)} AND regexp_matches(text, '\\d') THEN 'threshold'
      WHEN {any_of("text", P.OBLIGATION_MARKERS)} THEN 'obligation' ELSE 'semantic' END AS content_type FROM srows)
"""
add(
    "structured_sections",
    f"""WITH RECURSIVE {MD}, {CATALOG_TAIL}, {SECTION_ROWS}
        SELECT section_id, doc_id, section_heading, heading_path, content_type, token_count, has_formula, has_table,
          coalesce(array_to_string(list_transform(mentions, lambda m: '/' || m), {SEP}), '') AS mentions_rules, {joined("keywords")} AS keywords, text
        FROM typed_rows""",
)
VARIABLES = f"""list_filter(regexp_extract_all(regexp_replace(regexp_replace(f, '```math|```|\\$\\$', '', 'g'), '[{{}}_^]', ' ', 'g'), '[\\p{{L}}\\p{{N}}_]+'),
    lambda v: regexp_full_match(v, '[A-Za-z][A-Za-z0-9]{{0,30}}') AND NOT list_contains([{", ".join(repr(w) for w in P.LATEX_CONTROL_WORDS)}], lower(v))
      AND NOT list_contains([{", ".join(repr(w) for w in P.SINGLE_LETTER_NOISE)}], v))"""
CARDS = f"""
  {SECTION_ROWS},
  found AS (SELECT doc_id, idx, title, section_heading, unnest(fs) AS f, generate_subscripts(fs, 1) AS pos
    FROM (SELECT *, list_filter(list_transform(regexp_extract_all(text, '{FORMULA_RE}', 0), lambda x: {strip("x")}), lambda x: x <> '') AS fs FROM srows)),
  named AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY idx, pos) AS no, {VARIABLES} AS raw FROM found),
  cards AS (SELECT doc_id || '#formula-' || no AS formula_id, no, doc_id, title, section_heading, f,
      list_slice(list_filter(raw, lambda v, i: list_position(list_transform(raw, lambda x: lower(x)), lower(v)) = i), 1, 16) AS vars FROM named)
"""
add(
    "formula_cards",
    f"""WITH RECURSIVE {MD}, {CATALOG_TAIL}, {CARDS}
        SELECT formula_id, doc_id, section_heading, f AS formula_text, coalesce({joined("vars")}, '') AS variables FROM cards""",
)
add(
    "section_embedding_inputs",
    f"""WITH RECURSIVE {MD}, {CATALOG_TAIL}, {SECTION_ROWS},
        e AS (SELECT doc_id, idx, title, section_heading, 'Document: ' || title || chr(10) || chr(10) || 'Section: ' || section_heading || chr(10) || chr(10) || text AS x FROM srows)
        SELECT doc_id, idx AS section_index, {n_tokens("x")} AS token_count,
          md5(array_to_string(list_slice({tokens("'Path: corpus/' || doc_id || chr(10) || 'Title: ' || title || chr(10) || 'Headings: ' || section_heading || chr(10) || 'Section type: semantic' || chr(10) || chr(10) || x")}, 1, 1800), '')) AS embed_md5
        FROM e""",
)
add(
    "formula_section_match",
    f"""WITH RECURSIVE {MD}, {CATALOG_TAIL}, {CARDS},
        spot AS (SELECT doc_id, section_heading, min(idx) AS idx FROM srows WHERE has_formula GROUP BY 1, 2)
        SELECT formula_id, c.doc_id || '#section-' || idx AS section_id FROM cards c JOIN spot s ON s.doc_id = c.doc_id AND s.section_heading = c.section_heading""",
)


def keyword_ranking(texts: str, boost: float, order: str, k: int, extra: str = "0.0", extra_reason: str = "NULL") -> str:
    """CTEs that rank ``texts`` (key, hay, kws, tie columns) for the title questions with keyword hits and reasons."""
    return f"""
    txt AS ({texts}), q AS (SELECT query_id, {norm("question")} AS q_norm FROM tq), h AS (SELECT *, {norm("hay")} AS h_norm FROM txt),
    qg AS (SELECT query_id, unnest({grams("q_norm")}) AS g FROM q), qn AS (SELECT query_id, count(*) AS n FROM qg GROUP BY 1),
    vocabulary AS (SELECT DISTINCT g FROM qg),
    hg AS (SELECT key, g FROM (SELECT key, unnest({grams("h_norm")}) AS g FROM h) SEMI JOIN vocabulary USING (g)),
    shared AS (SELECT query_id, key, count(*) AS c FROM qg JOIN hg USING (g) GROUP BY ALL),
    kw AS (SELECT key, unnest(kws) AS k, generate_subscripts(kws, 1) AS pos FROM txt),
    kwh AS (SELECT query_id, key, k, row_number() OVER (PARTITION BY query_id, key ORDER BY pos) AS rn FROM kw JOIN q ON {norm("k")} <> '' AND contains(q_norm, {norm("k")})),
    kwn AS (SELECT query_id, key, count(*) AS hits, string_agg(k, '、' ORDER BY rn) FILTER (rn <= 3) AS names FROM kwh WHERE rn <= 5 GROUP BY ALL),
    sc AS (SELECT query_id, h.*, round_even(CASE WHEN contains(h_norm, q_norm) AND q_norm <> '' THEN {boost} ELSE 0.0 END
          + coalesce(CAST(c AS DOUBLE) / n, 0.0) * 60.0 + least(40.0, 8.0 * coalesce(hits, 0)) + {extra}, 4) AS score,
        concat_ws('；', CASE WHEN contains(h_norm, q_norm) AND q_norm <> '' THEN '{P.REASON_CONTAINED}' END, CASE WHEN c > 0 THEN '{P.REASON_GRAMS}' END,
          CASE WHEN hits > 0 THEN '{P.REASON_KEYWORDS}' || names END, {extra_reason}) AS reason
      FROM (SELECT query_id, key FROM shared UNION SELECT query_id, key FROM kwn) JOIN q USING (query_id) JOIN h USING (key)
      LEFT JOIN qn USING (query_id) LEFT JOIN shared USING (query_id, key) LEFT JOIN kwn USING (query_id, key)),
    top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, {order}) AS rank FROM sc WHERE score <> 0)
    """


SECTION_HAY = """concat_ws(chr(10), title, section_heading, 'None', 'None', content_type, text, array_to_string(keywords, ' '),
  array_to_string(list_transform(mentions, lambda m: '/' || m), ' '), '')"""
add(
    "section_search",
    f"""WITH RECURSIVE {MD}, {TITLE_Q}, {CATALOG_TAIL}, {SECTION_ROWS},
        {keyword_ranking(f"SELECT section_id AS key, doc_id, idx, has_formula, token_count, keywords AS kws, {SECTION_HAY} AS hay FROM typed_rows", 95.0, "has_formula DESC, token_count, doc_id, idx", 5)}
        SELECT query_id, rank, key AS section_id, score, reason FROM top WHERE rank <= 5""",
)
CARD_KEYWORDS = keywords(
    "array_to_string(list_concat([title], list_filter(list_transform(string_split(section_heading, '>'), lambda h: "
    + strip("h")
    + "), lambda h: h <> ''), vars, [f]), chr(10))"
)
add(
    "formula_search",
    f"""WITH RECURSIVE {MD}, {TITLE_Q}, {CATALOG_TAIL}, {CARDS}, ck AS (SELECT *, {CARD_KEYWORDS} AS kw FROM cards),
        {keyword_ranking("SELECT formula_id AS key, no, list_concat(vars, kw) AS kws, concat_ws(chr(10), title, section_heading, 'None', f, array_to_string(vars, ' '), array_to_string(kw, ' ')) AS hay FROM ck", 80.0, "no, key", 5)}
        SELECT query_id, rank, key AS formula_id, score, reason FROM top WHERE rank <= 5""",
)
add(
    "summary_search",
    f"""WITH {MD}, {TITLE_Q}, {CATALOG_TAIL}, {LINKS_TAIL},
        rel AS (SELECT source, string_agg(target, ' ' ORDER BY pos) AS related FROM (SELECT source, target, min(pos) AS pos FROM edge GROUP BY 1, 2) GROUP BY 1),
        summ AS (SELECT *, list_slice({distinct("list_concat(headings, keywords)")}, 1, 5) AS focus, coalesce({truncate("chosen[1]", 180)}, title) AS short, {STRUCTURED} AS structured
          FROM cat LEFT JOIN rel ON rel.source = cat.doc_id),
        {keyword_ranking("SELECT doc_id AS key, title, focus AS kws, concat_ws(chr(10), title, short, structured, array_to_string(focus, ' '), coalesce(related, '')) AS hay FROM summ", 90.0, "title DESC, key", 5)}
        SELECT query_id, rank, key AS doc_id, score, reason FROM top WHERE rank <= 5""",
)
add(
    "filename_matches",
    f"""WITH {PAGES}, {TITLE_Q},
        docs AS (SELECT page_id, lang || '/' || replace(title, '/', '_') || '.md' AS path, {norm("replace(title, '/', '_')")} AS s_norm FROM pf),
        paths AS (SELECT path, any_value(s_norm) AS s_norm, min(page_id) AS seen FROM docs GROUP BY 1),
        q AS (SELECT query_id, {norm("question")} AS q_norm FROM tq),
        sg AS (SELECT path, i, substring(s_norm, i, 4) AS g FROM (SELECT *, unnest(range(1, length(s_norm) - 2)) AS i FROM paths)),
        qg AS (SELECT query_id, j, substring(q_norm, j, 4) AS g FROM (SELECT *, unnest(range(1, length(q_norm) - 2)) AS j FROM q)),
        m AS (SELECT query_id, path, i - j AS diagonal, i - row_number() OVER (PARTITION BY query_id, path, i - j ORDER BY i) AS island FROM sg JOIN qg USING (g)),
        runs AS (SELECT query_id, path, max(n) + 3 AS lcs FROM (SELECT query_id, path, diagonal, island, count(*) AS n FROM m GROUP BY ALL) GROUP BY 1, 2),
        inside AS (SELECT query_id, path, CASE WHEN contains(s_norm, q_norm) THEN length(q_norm) ELSE length(s_norm) END AS n
          FROM q JOIN paths ON s_norm <> '' AND q_norm <> '' AND (contains(s_norm, q_norm) OR contains(q_norm, s_norm))),
        sc AS (SELECT query_id, path, CAST(coalesce(n, lcs) AS DOUBLE) AS score FROM runs FULL JOIN inside USING (query_id, path)),
        rk AS (SELECT query_id, path, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, seen, path) AS pr FROM sc JOIN paths USING (path)),
        ch AS (SELECT query_id, path, page_id, score, row_number() OVER (PARTITION BY query_id, path ORDER BY page_id) AS cr FROM rk JOIN docs USING (path) WHERE pr <= 3)
        SELECT query_id, path, page_id, round(1.5 + score / 100.0, 4) AS retrieval_score FROM ch WHERE cr <= 2""",
)
add(
    "answer_context",
    f"""WITH RECURSIVE {lexical(DOC_Q, DOC_H, 90.0, 8)},
        both_sides AS (
          SELECT r.query_id, r.rank AS ord, 'document' AS source_kind, d.source || '/' || CAST(d.doc_id AS VARCHAR) AS path, d.text, r.score / 100.0 AS retrieval_score, d.doc_id
          FROM ranked r JOIN documents d USING (doc_id) WHERE rank <= 8
          UNION ALL
          SELECT r.query_id, r.rank * 100000 + s - 1, 'section', d.source || '/' || CAST(d.doc_id AS VARCHAR), d.lines[s], r.score / 100.0, d.doc_id
          FROM ranked r JOIN (SELECT *, string_split(text, chr(10)) AS lines FROM documents) d USING (doc_id), unnest(range(1, len(d.lines) + 1)) AS t(s)
          WHERE rank <= 8 AND d.lines[s] <> ''),
        {rerank("both_sides", BENCH_Q, "query_id, source_kind", "side")},
        cost AS (SELECT query_id, source_kind, rank, {n_tokens("text")} AS n, CASE source_kind WHEN 'section' THEN 500 ELSE 3000 END AS budget,
                 CASE source_kind WHEN 'section' THEN 6 ELSE 3 END AS cap FROM side),
        fold AS (
          SELECT query_id, source_kind, rank, n AS total, 1 AS picked, TRUE AS taken, (n >= budget OR 1 >= cap) AS done FROM cost WHERE rank = 1
          UNION ALL
          SELECT c.query_id, c.source_kind, c.rank, CASE WHEN ok THEN f.total + c.n ELSE f.total END, CASE WHEN ok THEN f.picked + 1 ELSE f.picked END, ok,
            f.done OR (ok AND (f.total + c.n >= c.budget OR f.picked + 1 >= c.cap))
          FROM fold f JOIN cost c ON c.query_id = f.query_id AND c.source_kind = f.source_kind AND c.rank = f.rank + 1,
          LATERAL (SELECT NOT f.done AND f.total + c.n <= c.budget AS ok)),
        chosen AS (SELECT s.query_id, row_number() OVER (PARTITION BY s.query_id ORDER BY s.source_kind, s.rank) AS ord, s.source_kind, s.path, s.text, s.retrieval_score, s.doc_id
          FROM side s SEMI JOIN (SELECT * FROM fold WHERE taken) f ON s.query_id = f.query_id AND s.source_kind = f.source_kind AND s.rank = f.rank),
        {rerank("chosen", BENCH_Q, "query_id", "joint")}
        SELECT query_id, rank, source_kind, doc_id, round(rerank_score, 6) AS rerank_score FROM joint""",
)
