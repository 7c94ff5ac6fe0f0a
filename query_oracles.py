"""SQL twins of the registered queries, over the same tables."""

from __future__ import annotations

_WHITE = r"\t\n\x0B\f\r \x{85}\x{A0}\p{Z}"
_PAIRED = "''[^'']*''|\"[^\"]*\"|`[^`]*`"


def _list(column: str, han: bool = False) -> str:
    """Token list of a column; NULL gives an empty list."""
    c = rf"[^{_WHITE}\p{{P}}''\"`{chr(92) + 'p{Han}' if han else ''}]"
    word = rf"{c}(?:(?:[.\-:]|{c})*{c})?"
    pattern = f"{_PAIRED}|" + (r"\p{Han}|" if han else "") + word
    strip = r"\A[''\"`][.\-:]*|[.\-:]*[''\"`]\z"
    return (
        f"list_filter(list_transform(regexp_extract_all(coalesce({column}, ''), '{pattern}'), "
        f"lambda t: CASE WHEN substr(t, 1, 1) IN ('''', '\"', '`') THEN regexp_replace(t, '{strip}', '', 'g') ELSE t END), "
        f"lambda t: t <> '')"
    )


def _corpus(table: str, key: str, fields: list[tuple[str, str]]) -> str:
    """CTEs src, occ, post, lens, corpus, dfs of a table with the given text fields."""
    lists = ", ".join(f"{_list(f, mode == 'zh')} AS t{i}" for i, (f, mode) in enumerate(fields))
    occ, start = [], "0"
    for i, (f, _) in enumerate(fields):
        at = f"{start} + generate_subscripts(t{i}, 1) - 1"
        occ.append(f"SELECT docid, '' AS scope, unnest(t{i}) AS token, {at} AS pos FROM src")
        occ.append(f"SELECT docid, '{f}' AS scope, unnest(t{i}) AS token, {at} + len(t{i}) AS pos FROM src")
        start += f" + CASE WHEN len(t{i}) > 0 THEN 2 * len(t{i}) + 10 ELSE 0 END"
    total = " + ".join(f"len(t{i})" for i in range(len(fields)))
    return f"""
    src AS (SELECT CAST({key} AS VARCHAR) AS docid, {lists} FROM {table}),
    occ AS ({' UNION ALL '.join(occ)}),
    post AS (SELECT docid, scope, token, count(*) AS tf, list_sort(list(pos)) AS poslist FROM occ GROUP BY docid, scope, token),
    lens AS (SELECT docid, {total} AS dl FROM src),
    corpus AS (SELECT count(*) AS n, avg(dl) AS a FROM lens),
    dfs AS (SELECT scope, token, count(*) AS df FROM post GROUP BY scope, token)"""


_DOCS = _corpus("documents", "doc_id", [("text", "space")])
_PARTS = _corpus("part", "p_partkey", [("p_name", "space"), ("p_brand", "zh"), ("p_type", "space")])

_HITS = """
    qs AS (SELECT qid, scope, token, bool_or(occur = 'should') AS s, bool_or(occur = 'must') AS m,
                  bool_or(occur = 'must_not') AS x FROM qt GROUP BY qid, scope, token),
    qn AS (SELECT qid, count(*) FILTER (m) AS n_must, count(*) FILTER (s OR m) AS n_pos FROM qs GROUP BY qid),
    ev AS (SELECT qid, docid, count(*) FILTER (s) AS hs, count(*) FILTER (m) AS hm, count(*) FILTER (x) AS hx,
                  round(coalesce(sum(CASE WHEN s OR m THEN ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2
                        / (tf + 1.2 * (0.25 + 0.75 * dl / a)) END), 0), 9) AS score
           FROM qs JOIN post USING (scope, token) JOIN dfs USING (scope, token) JOIN lens USING (docid), corpus
           GROUP BY qid, docid),
    hit AS (SELECT ev.qid, docid, score FROM ev JOIN qn USING (qid)
            WHERE n_pos > 0 AND hx = 0 AND hm = n_must AND (n_must > 0 OR hs > 0)),
    gone AS (SELECT ev.qid, docid FROM ev JOIN qn USING (qid) WHERE n_pos = 0 AND hx > 0)"""


_HAN_DOCS = _corpus(
    "(SELECT doc_id, translate(text, 'aeiou', '这是测试中') AS text FROM documents)", "doc_id", [("text", "zh")]
)
# The strings of the benchmark texts, taken apart by hand.
_TYPED = "qt AS (SELECT DISTINCT qid, scope, token, occur FROM (" + " UNION ALL ".join(
    f"SELECT item_id AS qid, '{scope}' AS scope, unnest({_list(piece, not scope)}) AS token, '{occur}' AS occur "
    "FROM (SELECT item_id, string_split(text, ' ') AS w FROM benchmark)"
    for piece, scope, occur in (
        ("w[1]", "", "must"), ("w[2]", "", "must_not"), ("'\"' || w[3] || '\"'", "", "should"), ("'\"' || w[4] || ' ' || w[5] || '\"'", "", "should"),
        ("w[6]", "", "should"), ("w[7]", "text", "should"), 
        # A comma ends the in-field part, so what follows has no field and says nothing.
        ("CASE WHEN regexp_matches(w[7], '[,;]') THEN '' ELSE w[8] END", "text", "must_not"), ("array_to_string(w[9:], ' ')", "", "should"),
    )
) + "))"
_KEYS = """keys AS (SELECT CAST(event_id AS VARCHAR) AS docid, event_id, event_type = 'click' AS click,
    CASE WHEN event_id % 4 <> 0 THEN floor(value) END AS amount, CASE WHEN event_id % 3 <> 0 THEN event_id % 7 END AS third FROM events)"""


def _sorted_keys(**orders: str) -> str:
    return f"WITH {_KEYS} " + " UNION ALL ".join(
        f"SELECT '{kind.replace('_', ' ')}' AS kind, rank, docid FROM (SELECT docid, row_number() OVER (ORDER BY {order}) AS rank FROM keys) "
        "WHERE rank <= 60 OR rank BETWEEN 8901 AND 9000"
        for kind, order in orders.items()
    )


def _fixed(*tokens: tuple[str, str]) -> str:
    rows = ", ".join(f"(1::BIGINT, '', '{t}', '{o}')" for t, o in tokens)
    return f"qt AS (SELECT * FROM (VALUES {rows}) v(qid, scope, token, occur))"


def _benchmark(occur: str) -> str:
    return f"qt AS (SELECT DISTINCT item_id AS qid, '' AS scope, unnest({_list('text', True)}) AS token, '{occur}' AS occur FROM benchmark)"


def _matches(*tokens: tuple[str, str]) -> str:
    return f"WITH {_DOCS}, {_fixed(*tokens)}, {_HITS} SELECT qid, docid, round(score, 5) AS score FROM hit"


def _survivors(qt: str, low: int, high: int) -> str:
    return f"""WITH {_DOCS}, {qt}, {_HITS},
    kept AS (SELECT q.qid, CAST(doc_id AS VARCHAR) AS docid,
                    row_number() OVER (PARTITION BY q.qid ORDER BY doc_id, CAST(doc_id AS VARCHAR)) AS rank,
                    count(*) OVER (PARTITION BY q.qid) AS total
             FROM documents, (SELECT DISTINCT qid FROM qt) q
             WHERE NOT EXISTS (SELECT 1 FROM gone WHERE gone.qid = q.qid AND gone.docid = CAST(doc_id AS VARCHAR)))
    SELECT qid, rank, docid, total FROM kept WHERE rank BETWEEN {low} AND {high}"""


def _ranked(source: str, columns: str, order: str, low: int, high: int, where: str = "true") -> str:
    return (
        f"SELECT rank, {columns} FROM (SELECT *, row_number() OVER (ORDER BY {order}) AS rank FROM {source} WHERE {where}) "
        f"WHERE rank BETWEEN {low} AND {high}"
    )


_ORDER_COLUMNS = "o_orderkey, o_orderstatus, o_orderpriority, o_totalprice"

# The odd events: the same rules as the raw texts of the catalog.
_RAW = """
    raw AS (SELECT event_id, event_id % 97 <> 0 AS has_key,
                   CASE WHEN event_id % 11 = 0 THEN '' ELSE CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) END AS small,
                   CAST(floor(value * 100) AS BIGINT) AS unsigned_,
                   CASE WHEN event_id % 13 = 0 THEN '1.5e3' WHEN event_id % 17 = 0 THEN ' 2 ' ELSE '-.5' END AS real_,
                   event_id % 3 = 0 AS flag,
                   strftime(ts, '%Y-%m-%d') AS day_,
                   CASE WHEN event_id % 19 = 0 THEN 'no date' ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS at_,
                   strftime(ts, '%H:%M:%S') AS clock_,
                   CASE WHEN event_id % 5 <> 0 THEN event_type END AS word,
                   user_id AS seconds, ts FROM events),
    conv AS (SELECT *, CASE WHEN small = '' THEN 0 ELSE try_cast(small AS TINYINT) END AS small_v,
                    CASE WHEN unsigned_ BETWEEN 0 AND 65535 THEN CAST(unsigned_ AS INTEGER) END AS unsigned_v,
                    CASE WHEN real_ = '1.5e3' THEN 1500.0::DOUBLE WHEN real_ = '-.5' THEN (-0.5)::DOUBLE END AS real_v FROM raw),
    judged AS (SELECT *, CASE WHEN small_v IS NULL THEN 'field small: can not convert ' || small || ' to i8'
                             WHEN unsigned_v IS NULL THEN 'field unsigned: can not convert ' || unsigned_ || ' to u16'
                             WHEN real_v IS NULL THEN 'field real: can not convert ' || real_ || ' to f64'
                             WHEN at_ = 'no date' THEN 'field at: can not convert no date to datetime'
                             WHEN NOT has_key THEN 'a key field has no value' END AS error FROM conv)"""

_ORDERS_READ = """SELECT CAST(o_orderkey AS VARCHAR) AS docid, o_custkey, o_orderstatus, o_totalprice,
    strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS o_orderdate, {priority} AS o_orderpriority, CAST(NULL AS VARCHAR) AS error FROM orders"""

_LATEST_EVENTS = """SELECT CAST(user_id AS VARCHAR) AS docid, event_id, event_type, value FROM events
    QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1"""

ORACLES: dict[str, str] = {
    "tokenize_space": f"SELECT doc_id, CAST(len(t) AS INTEGER) AS n_tokens, array_to_string(t, '|') AS tokens "
    f"FROM (SELECT doc_id, {_list('text')} AS t FROM documents)",
    "tokenize_han": f"SELECT page_id, CAST(len(t) AS INTEGER) AS n_tokens, array_to_string(t, '|') AS tokens "
    f"FROM (SELECT page_id, {_list('html', True)} AS t FROM pages)",
    "postings_global": f"WITH {_DOCS} SELECT docid, token, CAST(tf AS INTEGER) AS tf, array_to_string(poslist, ',') AS positions, "
    "CAST(dl AS INTEGER) AS dl FROM post JOIN lens USING (docid) WHERE scope = ''",
    "postings_by_field": f"WITH {_PARTS} SELECT docid, scope, token, CAST(tf AS INTEGER) AS tf, "
    "array_to_string(poslist, ',') AS positions, CAST(dl AS INTEGER) AS dl FROM post JOIN lens USING (docid)",
    "postings_json_field": "SELECT CAST(event_id AS VARCHAR) AS docid, 'payload' AS scope, event_type AS token, "
    "1 AS tf, '1' AS positions FROM events WHERE event_id % 2 = 0",
    "corpus_stats": f"WITH {_DOCS} SELECT n AS n_docs, round(a, 6) AS avg_dl FROM corpus",
    "token_document_frequency": f"WITH {_DOCS} SELECT token, df FROM dfs WHERE scope = ''",
    "search_should": _matches(("the", "should"), ("thre", "should"), ("und", "should")),
    "search_must": _matches(("the", "must"), ("of", "must")),
    "search_mixed": _matches(("the", "must"), ("thre", "should"), ("in", "should"), ("tion", "must_not"), ("le", "must_not")),
    "search_not_only": _survivors(_fixed(("the", "must_not"), ("der", "must_not")), 51, 100),
    "search_not_only_batch": _survivors(_benchmark("must_not"), 1, 10),
    "search_match_all": "SELECT 1::BIGINT AS qid, rank, docid, total FROM (SELECT CAST(doc_id AS VARCHAR) AS docid, "
    "row_number() OVER (ORDER BY doc_id) AS rank, count(*) OVER () AS total FROM documents) WHERE rank BETWEEN 81 AND 120",
    "search_field": f"""WITH {_PARTS},
    qt AS (SELECT p_type AS qid, 'p_type' AS scope, unnest({_list('p_type')}) AS token, 'should' AS occur FROM (SELECT DISTINCT p_type FROM part)
           UNION ALL SELECT DISTINCT p_type, '', 'red', 'should' FROM part
           UNION ALL SELECT DISTINCT p_type, 'p_brand', '7', 'must_not' FROM part), {_HITS}
    SELECT qid, docid, round(score, 5) AS score FROM hit""",
    "bm25_topk_batch": f"""WITH {_DOCS}, {_benchmark('should')}, {_HITS}
    SELECT qid, rank, docid, round(score, 5) AS score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, docid) AS rank FROM hit)
    WHERE rank <= 10""",
    "search_query_strings": f"""WITH {_DOCS}, {_TYPED}, {_HITS}
    SELECT qid, rank, docid, round(score, 5) AS score FROM (
      SELECT qid, docid, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank
      FROM hit JOIN documents ON docid = CAST(doc_id AS VARCHAR) WHERE lang IN ('en', 'fr') AND n_chars >= 300)
    WHERE rank <= 20""",
    "search_han": f"""WITH {_HAN_DOCS},
    qt AS (SELECT DISTINCT item_id AS qid, '' AS scope,
             unnest({_list("translate(text, 'aeiou', '这是测试中')", True)}) AS token,
             'should' AS occur FROM benchmark), {_HITS}
    SELECT qid, rank, docid, round(score, 5) AS score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, docid) AS rank FROM hit)
    WHERE rank <= 5""",
    "sort_bool_json_missing": _sorted_keys(
        bool="click DESC NULLS LAST, event_id", json="amount ASC NULLS LAST, event_id DESC", json_last="amount DESC NULLS LAST, event_id",
        missing="third DESC NULLS LAST, click, event_id",
    ),
    "read_csv_bad_rows": """SELECT CASE WHEN o_orderkey % 50 NOT IN (1, 2) THEN CAST(o_orderkey AS VARCHAR) END AS docid,
    CASE WHEN o_orderkey % 50 NOT IN (1, 2) THEN o_custkey END AS o_custkey, CASE WHEN o_orderkey % 50 NOT IN (1, 2) THEN 2.5::DOUBLE END AS o_totalprice,
    CASE o_orderkey % 50 WHEN 1 THEN 'wrong number of cells: ' || o_orderkey || ',' || o_custkey
         WHEN 2 THEN 'wrong number of cells: ' || o_orderkey || ',' || o_custkey || ',P,1,' || repeat('long ', 100) END AS error,
    CASE WHEN o_orderkey % 50 IN (1, 2) THEN 'read' END AS stage FROM orders""",
    "batch_numbers": "SELECT CAST(o_orderkey AS VARCHAR) AS docid, o_custkey, o_orderstatus, o_totalprice FROM orders",
    "search_filtered_topk": f"""WITH {_DOCS}, {_fixed(('the', 'must'), ('thre', 'should'))}, {_HITS}
    SELECT rank, doc_id, lang, source, n_chars, round(score, 5) AS score FROM
      (SELECT *, row_number() OVER (ORDER BY score DESC, docid) AS rank FROM hit JOIN documents ON docid = CAST(doc_id AS VARCHAR)
       WHERE lang = 'en' AND n_chars >= 500) WHERE rank <= 10""",
    "pagination_summary": f"""WITH {_DOCS}, {_benchmark('must')}, {_HITS},
    t AS (SELECT item_id AS qid, (SELECT count(*) FROM hit WHERE hit.qid = item_id) AS total FROM benchmark)
    SELECT qid, total, CAST(ceil(total / 7.0) AS BIGINT) AS pages, 7::BIGINT AS page_size, 1::BIGINT AS curr_page,
           least(total, 7) AS page_count FROM t""",
    "proximity_spread": f"""WITH {_DOCS},
    two AS (SELECT * FROM (VALUES (1::BIGINT, 'of', 'the'), (2::BIGINT, 'la', 'le')) v(qid, t1, t2)),
    g AS (SELECT docid, token, pos FROM occ WHERE scope = '' AND token IN ('of', 'the', 'la', 'le', 'in', 'and'))
    SELECT qid, g1.docid, min(abs(g2.pos - g1.pos - 1)) AS proximity FROM two JOIN g g1 ON g1.token = t1
      JOIN g g2 ON g2.token = t2 AND g2.docid = g1.docid GROUP BY qid, g1.docid
    UNION ALL
    SELECT 3::BIGINT AS qid, docid, min(c + abs(p3 - p2 - 1)) AS proximity FROM
      (SELECT g2.docid, g2.pos AS p2, min(abs(g2.pos - g1.pos - 1)) AS c FROM g g1 JOIN g g2 ON g2.docid = g1.docid
       WHERE g1.token = 'in' AND g2.token = 'the' GROUP BY g2.docid, g2.pos) x
      JOIN (SELECT docid, pos AS p3 FROM g WHERE token = 'and') g3 USING (docid) GROUP BY docid""",
    "search_proximity": f"""WITH {_DOCS}, {_fixed(('of', 'must'), ('the', 'must'))}, {_HITS},
    near AS (SELECT o1.docid FROM occ o1 JOIN occ o2 USING (docid) WHERE o1.scope = '' AND o2.scope = '' AND o1.token = 'of'
             AND o2.token = 'the' GROUP BY o1.docid HAVING min(abs(o2.pos - o1.pos - 1)) <= 2)
    SELECT qid, docid, round(score, 5) AS score FROM hit JOIN near USING (docid)""",
    "filter_numeric_or_range": f"SELECT {_ORDER_COLUMNS} FROM orders WHERE (o_totalprice <= 5000 OR o_totalprice BETWEEN 100000 AND 150000.5) "
    f"AND o_custkey = 12 UNION ALL SELECT {_ORDER_COLUMNS} FROM orders WHERE o_totalprice BETWEEN 1000 AND 20000",
    "filter_values_and_ranges": f"SELECT {_ORDER_COLUMNS}, 'and' AS mode FROM orders WHERE o_custkey IN (5, 7, 11, 700) AND o_custkey BETWEEN 6 AND 20 "
    f"UNION ALL SELECT {_ORDER_COLUMNS}, 'or' FROM orders WHERE o_custkey IN (5, 7, 11, 700) OR o_custkey BETWEEN 6 AND 20",
    "filter_string_by_tokenizer": f"SELECT 'space' AS kind, CAST(p_partkey AS VARCHAR) AS docid FROM part WHERE list_has_any({_list('p_name')}, ['red', 'ring']) "
    "UNION ALL SELECT 'zh', CAST(p_partkey AS VARCHAR) FROM part WHERE contains(p_brand, '#1') "
    "UNION ALL SELECT 'none', CAST(o_orderkey AS VARCHAR) FROM orders WHERE o_orderstatus = 'F'",
    "filter_text_token": f"SELECT CAST(doc_id AS VARCHAR) AS docid FROM documents WHERE list_contains({_list('text')}, 'thre') AND lang BETWEEN 'en' AND 'es'",
    "filter_time_range": "SELECT 'exact' AS kind, CAST(o_orderkey AS VARCHAR) AS docid FROM orders WHERE o_orderdate = TIMESTAMP '1996-02-29' "
    "UNION ALL SELECT 'range', CAST(o_orderkey AS VARCHAR) FROM orders WHERE o_orderdate BETWEEN TIMESTAMP '1995-06-01' AND TIMESTAMP '1996-06-30' "
    "OR o_orderdate >= TIMESTAMP '2001-01-01'",
    "filter_bool_and_json": "SELECT 'bool' AS kind, CAST(event_id AS VARCHAR) AS docid FROM events WHERE value > 10 "
    "UNION ALL SELECT 'json text', CAST(event_id AS VARCHAR) FROM events WHERE event_type = 'click' "
    "UNION ALL SELECT 'json text range', CAST(event_id AS VARCHAR) FROM events WHERE event_type BETWEEN 'd' AND 'q'",
    "sort_multi": _ranked("customer", "c_nationkey, c_acctbal, c_custkey", "c_nationkey, c_acctbal DESC, CAST(c_custkey AS VARCHAR)", 101, 200),
    "sort_negative_ascending": _ranked("customer", "c_acctbal, c_custkey", "c_acctbal, CAST(c_custkey AS VARCHAR)", 1, 100),
    "sort_by_text": _ranked("part", "p_name, p_partkey", "p_name COLLATE \"binary\", p_partkey DESC", 1, 100),
    "sort_default": _ranked(
        "(SELECT strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS o_orderdate, CAST(o_orderkey AS VARCHAR) AS docid FROM orders)",
        "o_orderdate, docid", "o_orderdate DESC, docid", 21, 40,
    ),
    "sort_string_by_relevance": f"""WITH {_DOCS}, {_fixed(('the', 'should'), ('thre', 'should'))}, {_HITS}
    SELECT rank, doc_id, n_chars FROM (SELECT *, row_number() OVER (ORDER BY floor(score) DESC, n_chars, docid) AS rank
      FROM hit JOIN documents ON docid = CAST(doc_id AS VARCHAR)) WHERE rank <= 50""",
    "page_window": _ranked(
        "(SELECT l_orderkey || '_' || l_linenumber AS docid, strftime(l_shipdate, '%Y-%m-%d') AS l_shipdate, CAST(l_quantity AS INTEGER) AS l_quantity FROM lineitem "
        "QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey * 100000 + l_suppkey DESC) = 1)",
        "docid, l_shipdate, l_quantity", "l_shipdate, docid", 401, 420, "l_quantity BETWEEN 10 AND 12",
    ),
    "deep_page_per_query": "SELECT qid, rank, docid FROM (SELECT o_orderstatus AS qid, CAST(o_orderkey AS VARCHAR) AS docid, "
    "row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice DESC, CAST(o_orderkey AS VARCHAR)) AS rank FROM orders) WHERE rank BETWEEN 1151 AND 1200",
    "coerce_types": f"""WITH {_RAW} SELECT CAST(event_id AS VARCHAR) AS docid, CAST(small_v AS INTEGER) AS small, unsigned_v AS unsigned,
    real_v AS real, flag, day_ AS day, at_ AS at, (hour(ts) * 3600 + minute(ts) * 60 + second(ts)) * 1000000000 AS clock, clock_ AS clock_shown,
    word, seconds FROM judged WHERE error IS NULL""",
    "ingest_report": f"WITH {_RAW} SELECT event_id AS pos, CASE WHEN error IS NULL THEN CAST(event_id AS VARCHAR) END AS docid, error FROM judged",
    "ingest_summary": f"WITH {_RAW} SELECT 'coerced' AS index, count(*) FILTER (error IS NULL) AS docs, 0::BIGINT AS unreadable, "
    "count(error) AS failed, CASE WHEN count(error) > 0 THEN 500 ELSE 200 END AS code, "
    "CASE WHEN count(error) > 0 THEN 'some documents were rejected' ELSE 'OK' END AS msg FROM judged",
    "coerce_table": """SELECT true AS has_seq, CASE WHEN error IS NULL THEN CAST(c_custkey AS VARCHAR) END AS docid,
    CASE WHEN error IS NULL THEN c_name END AS c_name, CASE WHEN error IS NULL THEN c_nationkey <> 0 END AS c_nationkey,
    CASE WHEN error IS NULL THEN CAST(trunc(c_acctbal) AS INTEGER) END AS c_acctbal, CASE WHEN error IS NULL THEN 0.25::DOUBLE END AS c_mktsegment, error
    FROM (SELECT *, CASE WHEN c_acctbal <= -1 OR c_acctbal >= 65536 THEN 'field c_acctbal: can not convert ' ||
            CASE WHEN c_acctbal = trunc(c_acctbal) THEN CAST(CAST(c_acctbal AS BIGINT) AS VARCHAR) ELSE CAST(c_acctbal AS VARCHAR) END || ' to u16'
          WHEN c_custkey % 4 = 0 THEN 'field c_mktsegment: can not convert ' || c_mktsegment || ' to f32' END AS error FROM customer)""",
    "docid_compound": "SELECT l_orderkey || '_' || l_linenumber AS docid, l_orderkey, l_linenumber FROM lineitem",
    "read_csv_headers": """SELECT doc_id::BIGINT AS doc_id, coalesce(lang, '') AS lang, coalesce(text, '') AS text,
      CASE WHEN doc_id % 2 <> 0 THEN coalesce(source, '') END AS source, NULL::VARCHAR AS error FROM documents""",
    "read_csv": _ORDERS_READ.format(priority="CASE WHEN o_orderkey % 10 <> 0 THEN o_orderpriority ELSE '' END"),
    "read_json_array": _ORDERS_READ.format(priority="CASE WHEN o_orderkey % 10 <> 0 THEN o_orderpriority END"),
    "read_json_lines": _ORDERS_READ.format(priority="CASE WHEN o_orderkey % 10 <> 0 THEN o_orderpriority END")
    + " WHERE o_orderkey % 100 <> 0 UNION ALL SELECT NULL, NULL, NULL, NULL, NULL, NULL, 'not JSON: {broken ' || o_orderkey FROM orders WHERE o_orderkey % 100 = 0",
    "upsert_latest": _LATEST_EVENTS,
    "partial_update": "SELECT CAST(doc_id AS VARCHAR) AS docid, lang, n_chars, quality, toxic = 1 AS toxic, CAST(length(text) AS INTEGER) AS text_chars "
    "FROM documents JOIN labels USING (doc_id)",
    "update_unmatched": "SELECT CAST(l_partkey * 3 AS VARCHAR) AS docid, 'document to update not found' AS error FROM lineitem "
    "WHERE l_partkey * 3 NOT IN (SELECT p_partkey FROM part)",
    "delete_many": "SELECT CAST(doc_id AS VARCHAR) AS docid, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)",
    "mixed_operations": """WITH e AS (SELECT event_id AS seq, user_id % (SELECT count(*) FROM documents) AS doc_id, event_type,
      (event_id * 7 + event_id // 5) % 10 AS k FROM events),
    ops AS (SELECT -1::BIGINT AS seq, doc_id, 'U' AS op, lang, n_chars, NULL AS kind FROM documents WHERE doc_id % 2 = 0
      UNION ALL SELECT seq, doc_id, CASE WHEN k < 2 THEN 'D' WHEN k < 4 THEN 'U' ELSE 'P' END, NULL, CASE WHEN k % 2 = 1 THEN seq END,
      CASE WHEN k % 3 <> 1 THEN event_type END FROM e),
    reset AS (SELECT doc_id, max(seq) AS at, arg_max(op, seq) AS op FROM ops WHERE op <> 'P' GROUP BY doc_id)
    SELECT CAST(doc_id AS VARCHAR) AS docid, any_value(o.lang) AS lang, arg_max(o.n_chars, seq) AS n_chars, arg_max(o.kind, seq) AS kind
    FROM ops o JOIN reset r USING (doc_id) WHERE r.op = 'U' AND seq >= r.at GROUP BY doc_id""",
    "lookup_by_key": "SELECT conv_id || '_' || turn AS docid, role FROM conversations JOIN labels ON doc_id = conv_id WHERE turn = 1",
    "docid_collisions": "SELECT p_partkey || '_' || p_size || '_' || p_type AS docid FROM part WHERE p_size < 10",
    "collection_cycle": f"""WITH {_corpus("(SELECT documents.* FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1))", "doc_id", [("text", "space")])},
    {_fixed(('the', 'must'), ('thre', 'should'))}, {_HITS}
    SELECT docid, round(score, 5) AS score FROM hit WHERE docid IN (SELECT CAST(doc_id AS VARCHAR) FROM labels WHERE quality = 1)""",
    "stream_upsert": _LATEST_EVENTS,
    "stream_summary": "SELECT 'orders' AS index, 200 AS code, count(*) FILTER (o_orderkey % 100 <> 0) AS docs, "
    "count(*) FILTER (o_orderkey % 100 = 0) AS unreadable, 0::BIGINT AS failed FROM orders",
    "time_format": "SELECT o_orderkey, strftime(o_orderdate, '%d/%m/%Y') AS o_orderdate, strftime(o_orderdate + INTERVAL 3661 SECOND, '%Y%m%d %H%M%S') AS at FROM orders",
    "json_output": "SELECT CAST(n_nationkey AS VARCHAR) AS docid, '{' || CASE WHEN n_nationkey % 3 <> 0 THEN '\"n_name\":\"' || n_name || '\",' ELSE '' END "
    "|| '\"n_nationkey\":' || n_nationkey || ',\"n_regionkey\":' || n_regionkey || '}' AS json FROM nation",
    "output_fields": "SELECT c_acctbal, c_custkey FROM customer",
}
