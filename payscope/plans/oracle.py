"""The same results in plain SQL over the given tables (run by another engine as the check)."""

from __future__ import annotations

from payscope.schemas import CATEGORY_FIELDS, NAME_FIELDS

# Views by name, each with the views it reads.
_VIEWS: dict[str, tuple[tuple[str, ...], str]] = {}


def _view(name: str, needs: tuple[str, ...], sql: str) -> None:
    _VIEWS[name] = (needs, sql.strip())


def query(body: str, *needs: str) -> str:
    """`body` with the views it needs in front of it."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        if name in ordered:
            return
        for below in _VIEWS[name][0]:
            visit(below)
        ordered.append(name)

    for name in needs:
        visit(name)
    if not ordered:
        return body.strip()
    ctes = ",\n".join(f"{n} AS (\n{_VIEWS[n][1]}\n)" for n in ordered)
    return f"WITH {ctes}\n{body.strip()}"


_view(
    "fx_filings",
    (),
    """
SELECT o_orderkey || '-' || chunk AS record_id,
       CAST(year(o_orderdate) AS VARCHAR) AS program_year,
       CASE WHEN o_orderkey % 97 = 0 THEN ''
            WHEN o_orderkey % 101 = 0 THEN 'n/a'
            WHEN o_orderkey % 2 = 0 THEN strftime(o_orderdate, '%Y-%m-%d')
            ELSE month(o_orderdate) || '/' || day(o_orderdate) || '/' || year(o_orderdate)
       END AS payment_date,
       CAST(o_custkey AS VARCHAR) AS physician_id,
       CASE WHEN o_custkey % 13 = 0 THEN '' ELSE c_mktsegment END AS physician_specialty,
       n_name AS physician_state,
       CASE WHEN o_orderkey % 89 = 0 THEN '' ELSE s_name END AS manufacturer,
       o_orderpriority AS nature_of_payment,
       CASE WHEN o_orderkey % 83 = 0 THEN 'abc'
            ELSE CAST(CAST(o_totalprice AS DECIMAL(14,2)) AS VARCHAR) END AS amount_usd,
       names, categories
FROM (
    SELECT l_orderkey, chunk,
           max(CASE WHEN slot = 1 THEN l_suppkey END) AS first_suppkey,
           list(name ORDER BY slot) AS names,
           list(category ORDER BY slot) AS categories
    FROM (
        SELECT l_orderkey, l_suppkey, place // 5 AS chunk, place % 5 + 1 AS slot,
               CASE l_returnflag WHEN 'R' THEN '' WHEN 'A' THEN upper(p_name) ELSE p_name END AS name,
               CASE l_returnflag WHEN 'R' THEN p_type || ' ' || p_name ELSE p_type END AS category
        FROM (
            SELECT *, row_number() OVER (
                       PARTITION BY l_orderkey
                       ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice
                   ) - 1 AS place
            FROM lineitem
        ) JOIN part ON l_partkey = p_partkey
    )
    GROUP BY l_orderkey, chunk
)
JOIN orders ON l_orderkey = o_orderkey
JOIN customer ON o_custkey = c_custkey
JOIN nation ON c_nationkey = n_nationkey
JOIN supplier ON first_suppkey = s_suppkey
""",
)

_view(
    "fx_terms",
    (),
    """
SELECT * FROM (VALUES
    (1, 'red ring', 'red ring'), (2, 'hot gizmo', 'hot gizmo'), (3, 'cold anvil', 'red ring'),
    (4, 'old bolt', 'red ring'), (5, 'new gear', 'red ring'), (6, 'blue rod', 'hot gizmo'),
    (7, 'small plate', 'hot gizmo')) AS t(pos, term, generic)
""",
)

_CELLS = "\nUNION ALL\n".join(
    f"SELECT record_id, {slot} AS slot, '{field}' AS field, trim({column}[{slot}]) AS text "
    f"FROM fx_filings"
    for column, fields in (("names", NAME_FIELDS), ("categories", CATEGORY_FIELDS))
    for slot, field in enumerate(fields, start=1)
)

_view(
    "fx_matches",
    ("fx_filings", "fx_terms"),
    f"""
SELECT record_id, slot, field, arg_min(term, pos) AS term
FROM ({_CELLS}) JOIN fx_terms ON contains(lower(text), term)
GROUP BY record_id, slot, field
""",
)

_view(
    "fx_landed",
    ("fx_matches",),
    """
SELECT f.record_id, program_year, payment_date,
       CASE WHEN d IS NOT NULL THEN year(d) || 'Q' || quarter(d) END AS quarter,
       nullif(physician_id, '') AS physician_id,
       nullif(physician_specialty, '') AS physician_specialty,
       nullif(physician_state, '') AS physician_state,
       manufacturer,
       CASE WHEN trim(coalesce(names[slot], '')) <> '' THEN trim(names[slot]) ELSE term END AS product,
       generic AS product_generic,
       nature_of_payment, amount_usd, field AS matched_field,
       matched_slot_count, 'set-' || program_year AS source_year_dataset,
       CAST(d AS DATE) AS day
FROM (
    SELECT *, coalesce(try_strptime(payment_date, '%Y-%m-%d'),
                       try_strptime(payment_date, '%m/%d/%Y')) AS d
    FROM fx_filings
) f
JOIN (
    SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY slot, field) AS nth,
           count(*) OVER (PARTITION BY record_id) AS matched_slot_count
    FROM fx_matches
) m ON m.record_id = f.record_id AND nth = 1
JOIN fx_terms USING (term)
""",
)

_view(
    "fx_typed",
    ("fx_landed",),
    """
SELECT *, TRY_CAST(amount_usd AS DECIMAL(14,2)) AS usd,
       CASE WHEN amount_usd = 'abc' THEN 'record ' || record_id || ': amount_usd is not numeric'
            WHEN manufacturer = '' THEN 'record ' || record_id || ': manufacturer is missing'
       END AS reject_reason
FROM fx_landed
""",
)

_view(
    "fx_payments",
    ("fx_typed",),
    """
SELECT record_id, CAST(program_year AS INTEGER) AS program_year, day AS payment_date, quarter,
       physician_id, physician_specialty, physician_state, manufacturer, product, product_generic,
       nature_of_payment, usd AS amount_usd, matched_field, source_year_dataset
FROM fx_typed WHERE reject_reason IS NULL
""",
)

_view(
    "fx_lines",
    (),
    """
SELECT l_orderkey || '-' || l_linenumber AS record_id, year(l_shipdate) AS program_year,
       CAST(l_shipdate AS DATE) AS payment_date,
       year(l_shipdate) || 'Q' || quarter(l_shipdate) AS quarter,
       l_returnflag AS physician_specialty, l_linestatus AS physician_state,
       'maker ' || l_suppkey AS manufacturer, 'part ' || l_partkey AS product,
       CAST(l_extendedprice AS DECIMAL(14,2)) AS amount_usd,
       l_shipdate AS seq_d, l_partkey AS seq_p, l_suppkey AS seq_s, l_extendedprice AS seq_x
FROM lineitem
""",
)

_view(
    "fx_latest",
    ("fx_lines",),
    """
SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY record_id
                                 ORDER BY seq_d DESC, seq_p DESC, seq_s DESC, seq_x DESC) AS nth
    FROM fx_lines
) WHERE nth = 1
""",
)

_view(
    "fx_years",
    (),
    """
SELECT year(o_orderdate) AS year, sum(length(o_orderpriority)) AS bytes
FROM orders GROUP BY ALL
""",
)

_view(
    "fx_order_payments",
    (),
    """
SELECT year(o_orderdate) || 'Q' || quarter(o_orderdate) AS quarter,
       CASE WHEN o_custkey % 13 <> 0 THEN c_mktsegment ELSE '(unknown)' END AS specialty,
       CAST(o_totalprice AS DECIMAL(14,2)) AS usd
FROM orders JOIN customer ON o_custkey = c_custkey
""",
)

_view(
    "fx_fine",
    (),
    """
SELECT CASE WHEN grouping(g) = 1 THEN 'national' ELSE 'specialty:' || g END AS series_key, quarter,
       CAST(sum(usd) AS DOUBLE) AS value,
       CAST(quarter[1:4] AS BIGINT) * 4 + CAST(quarter[6:6] AS BIGINT) - 1 AS q
FROM (
    SELECT year(o_orderdate) || 'Q' || quarter(o_orderdate) AS quarter,
           c_nationkey || ' ' || c_mktsegment || ' ' || o_orderpriority AS g,
           CAST(o_totalprice AS DECIMAL(14,2)) AS usd
    FROM orders JOIN customer ON o_custkey = c_custkey
)
GROUP BY GROUPING SETS ((quarter), (g, quarter))
""",
)

_view(
    "fx_naive",
    ("fx_fine",),
    """
SELECT series_key, n, last_q, spread, last_season
FROM (
    SELECT series_key, count(*) AS n, max(q) AS last_q,
           coalesce(stddev_samp(change), 0) AS spread,
           list(value ORDER BY q) FILTER (WHERE back <= 4) AS last_season
    FROM (
        SELECT *, value - lag(value, 4) OVER (PARTITION BY series_key ORDER BY q) AS change,
               row_number() OVER (PARTITION BY series_key ORDER BY q DESC) AS back
        FROM fx_fine
    ) GROUP BY series_key
) WHERE n >= 4
""",
)

_END = 2000 * 4 + 2

_view(
    "fx_skips",
    ("fx_fine",),
    f"""
SELECT series_key, n, n_train, CASE
    WHEN n < 8 THEN 'only ' || n || ' quarters of data, need at least 8'
    WHEN n_train = 0 THEN 'no training data at or before 2000Q3'
    WHEN len(missing) > 0 THEN 'missing actuals for ' || array_to_string(missing, ', ')
    WHEN n_train < 4 THEN 'seasonal_naive needs at least 4 observations'
END AS naive_reason,
CASE WHEN n_train < 8 THEN 'ets needs at least 8 observations' END AS ets_reason
FROM (
    SELECT series_key, count(*) AS n, count(*) FILTER (WHERE q <= {_END}) AS n_train,
           list_filter(['2000Q4', '2001Q1', '2001Q2', '2001Q3'],
                       lambda x: NOT list_contains(list(quarter), x)) AS missing
    FROM fx_fine GROUP BY series_key
)
""",
)

_view(
    "fx_exact",
    (),
    """
SELECT series_key, first_q, last_q, q, q // 4 || 'Q' || (q % 4 + 1) AS quarter,
       CAST(n * 1000 + n % 3 * 10 * (q - first_q) + [0, 7, 3, 11][q % 4 + 1] * (1 + n % 5) AS DOUBLE) AS value,
       n % 3 AS trend
FROM (
    SELECT c_nationkey || ' ' || c_mktsegment || ' ' || o_orderpriority AS series_key, count(*) AS n,
           min(year(o_orderdate) * 4 + quarter(o_orderdate) - 1) AS first_q,
           max(year(o_orderdate) * 4 + quarter(o_orderdate) - 1) AS last_q
    FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1
), unnest(range(first_q, last_q + 5)) AS r(q)
""",
)

_view(
    "fx_naive_scores",
    ("fx_fine",),
    f"""
SELECT f.series_key, max(f.n) AS n_train, count(*) AS n_test,
       round(sum(abs(a.value - point)) / count(*), 4) AS mae
FROM (
    SELECT series_key, n, {_END} + h AS q, last_season[h] AS point
    FROM (
        SELECT series_key, count(*) AS n, list(value ORDER BY q) FILTER (WHERE back <= 4) AS last_season
        FROM (
            SELECT *, row_number() OVER (PARTITION BY series_key ORDER BY q DESC) AS back
            FROM fx_fine WHERE q <= {_END}
        ) GROUP BY series_key
    ), unnest(range(1, 5)) AS r(h)
) f
JOIN fx_fine a ON a.series_key = f.series_key AND a.q = f.q
GROUP BY f.series_key
""",
)

_view(
    "fx_windows",
    ("fx_fine",),
    f"""
SELECT series_key, count(*) AS n_quarters, min(quarter) AS first_quarter, max(quarter) AS last_quarter,
       count(*) FILTER (WHERE q <= {_END}) AS n_train
FROM fx_fine GROUP BY 1
""",
)

_view(
    "fx_groups",
    (),
    """
SELECT *, CASE WHEN quarter < event_quarter THEN 'before' ELSE 'after' END AS period
FROM (
    SELECT *, list(quarter ORDER BY quarter) OVER () AS qs,
           (list(quarter ORDER BY quarter) OVER (ROWS BETWEEN UNBOUNDED PRECEDING
               AND UNBOUNDED FOLLOWING))[count(*) OVER () // 2 + 1] AS event_quarter
    FROM (
        SELECT year(o_orderdate) || 'Q' || quarter(o_orderdate) AS quarter,
               sum(CAST(l_extendedprice AS DECIMAL(14,2))) FILTER (WHERE l_suppkey % 10 = 0)
                   AS treated,
               sum(CAST(l_extendedprice AS DECIMAL(14,2))) FILTER (WHERE l_suppkey % 10 <> 0)
                   AS control
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1
    )
)
""",
)

_view(
    "fx_makers",
    (),
    """
SELECT k, CAST(sales AS DECIMAL(18,2)) AS sales, CAST(returned AS DECIMAL(18,2)) AS returned, n_lines,
       raw_share, CAST(round(raw_share, 6) AS DECIMAL(10,6)) AS share,
       CAST(round(raw_share * 100, 2) AS DECIMAL(7,2)) AS pct,
       CAST(sales AS DOUBLE) * CASE WHEN k % 10 = 9 THEN 2 ELSE 1 END AS stated
FROM (
    SELECT *, CAST(returned AS DOUBLE) / CAST(sales AS DOUBLE) AS raw_share
    FROM (
        SELECT l_suppkey AS k, sum(CAST(l_extendedprice AS DECIMAL(14,2))) AS sales,
               sum(CASE WHEN l_returnflag = 'R' THEN CAST(l_extendedprice AS DECIMAL(14,2))
                        ELSE 0 END) AS returned,
               count(*) AS n_lines
        FROM lineitem GROUP BY 1
    )
)
""",
)

_view(
    "fx_answers",
    ("fx_makers",),
    """
SELECT *, 'a_' || k AS answer_id, CASE
    WHEN k % 6 = 0 THEN 'In 2001 the GLP-1 maker sold $' || money || gap || '[q_' || k || '].'
    WHEN k % 6 = 1 THEN 'It sold $' || format('{:,.0f}', stated) || gap || '[q_' || k || '] in 2001.'
    WHEN k % 6 = 2 THEN pct || '% of what was sold came back to this GLP-1 maker by 2001 [q_' || k || '].'
    WHEN k % 6 = 3 THEN 'It sold $' || money || ' in 2001, GLP-1 goods were 12% of it.'
    WHEN k % 6 = 4 THEN 'It sold $' || money || gap || '[q_none_' || k || '] in 2001.'
    WHEN k % 12 = 5 THEN n_lines || ' lines and $' || money || ' come from one query [q_' || k || ']'
    ELSE n_lines || ' lines sold for $' || money || gap || '[q_' || k || '] by 2001.'
END AS answer_text
FROM (
    SELECT *, format('{:,.2f}', stated) AS money,
           CASE WHEN (k // 6) % 2 = 0 THEN ' ' ELSE '' END AS gap
    FROM fx_makers
)
""",
)

# The other engine's patterns have no look-behind. Instead a letter or hyphen in front of a digit
# is part of the token: with a grouped or decimal number it is cut off, alone it makes a token of
# one digit that counts as text.
_TOKEN = (
    r"\[[A-Za-z0-9_-]+\]|\$\d[\d,]*(?:\.\d+)?|[A-Za-z-]?\d{1,3}(?:,\d{3})+(?:\.\d+)?%?"
    r"|[A-Za-z-]?\d+\.\d+%?|[A-Za-z-]\d|\d+%?"
)


def _tokens(source: str, year: str = r"(?:19|20)\d\d%?") -> str:
    return f"""
SELECT *, lead(kind) OVER w AS next_kind,
       coalesce(count(*) FILTER (WHERE kind = 'marker') OVER (
           PARTITION BY answer_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING
       ), 0) AS seg,
       kind = 'number' AND NOT regexp_full_match(raw, '{year}') AS counted
FROM (
    SELECT answer_id, pos, toks[pos] AS tok, gaps[pos] AS before_gap, gaps[pos + 1] AS after_gap,
           CASE WHEN toks[pos] LIKE '[%' THEN 'marker'
                WHEN regexp_full_match(toks[pos], '[A-Za-z-]\\d') THEN 'text' ELSE 'number' END AS kind,
           regexp_replace(toks[pos], '^[A-Za-z-]', '') AS raw
    FROM (
        SELECT answer_id, regexp_extract_all(answer_text, '{_TOKEN}') AS toks,
               regexp_split_to_array(answer_text, '{_TOKEN}') AS gaps
        FROM ({source})
    ), unnest(range(1, len(toks) + 1)) AS r(pos)
)
WINDOW w AS (PARTITION BY answer_id ORDER BY pos)
"""


def _cited(mode: str) -> str:
    year = r"0*(?:19|20)\d\d" if mode == "strict" else r"(?:19|20)\d\d%?"
    owns = {
        "as_written": "CASE WHEN adj THEN marker WHEN seg_touch THEN NULL "
        "WHEN seg_adj THEN CASE WHEN n = 2 THEN marker END WHEN n = 1 THEN marker END",
        "claim_once": "CASE WHEN adj THEN marker WHEN seg_adj THEN NULL WHEN n = 1 THEN marker END",
        "strict": "CASE WHEN touch THEN marker WHEN seg_touch THEN NULL WHEN n = 1 THEN marker END",
    }[mode]
    return f"""
SELECT answer_id, seg, pos, raw, CAST(regexp_replace(raw, '[$,%]', '', 'g') AS DOUBLE) AS value,
       length(regexp_extract(raw, '\\.(\\d+)', 1)) AS decimals, raw LIKE '%\\%' ESCAPE '\\' AS percent,
       {owns} AS cited_id
FROM (
    SELECT *, count(*) FILTER (WHERE counted) OVER s AS n, bool_or(adj) OVER s AS seg_adj,
           bool_or(touch) OVER s AS seg_touch,
           max(CASE WHEN kind = 'marker' THEN tok[2:-2] END) OVER s AS marker
    FROM (
        SELECT *, counted AND coalesce(next_kind = 'marker', false) AND trim(after_gap) = '' AS adj,
               counted AND coalesce(next_kind = 'marker', false) AND after_gap = '' AS touch
        FROM ({_tokens("SELECT answer_id, answer_text FROM fx_answers", year)})
    )
    WINDOW s AS (PARTITION BY answer_id, seg)
)
WHERE counted
"""


_view("fx_cited", ("fx_answers",), _cited("as_written"))
_view("fx_cited_once", ("fx_answers",), _cited("claim_once"))
_view("fx_cited_strict", ("fx_answers",), _cited("strict"))


def _near(leaf: str) -> str:
    unit = "pow(10.0, -decimals)"
    return f"""({leaf} = value
        OR abs({leaf} - value) <= 0.005 * CASE WHEN {leaf} <> 0 THEN abs({leaf})
                                               WHEN value <> 0 THEN abs(value) ELSE 1 END
        OR abs({leaf} - value) < {unit} * 0.5
        OR (abs({leaf} - value) = {unit} * 0.5 AND round(value / {unit}) % 2 = 0))"""


def _near_strict(leaf: str) -> str:
    return f"""({leaf} = value
        OR abs({leaf} - value) <= 0.005 * greatest(abs({leaf}), abs(value)))"""


def _evidence_verdict(cited: str, near, leaves: str) -> str:
    tests = " OR ".join(
        f"{near('x')} OR (percent AND ({near('(x * 100)')} OR {near('(x / 100)')}))" for _ in (0,)
    )
    return f"""
SELECT answer_id, seg, pos, raw, cited_id, reason, reason = 'matches evidence' AS passed
FROM (
    SELECT c.*, CASE
        WHEN cited_id IS NULL THEN 'no marker'
        WHEN cited_id <> 'q_' || k THEN 'unknown id'
        WHEN EXISTS (SELECT 1 FROM unnest({leaves}) AS l(x) WHERE {tests}) THEN 'matches evidence'
        ELSE 'not in evidence' END AS reason
    FROM {cited} c JOIN fx_makers m ON c.answer_id = 'a_' || m.k
)
"""


_LEAVES = "[CAST(sales AS DOUBLE), CAST(share AS DOUBLE), CAST(n_lines AS DOUBLE), 7.5, 5000.0]"
_STRICT_LEAVES = "[CAST(sales AS DOUBLE), CAST(share AS DOUBLE), CAST(n_lines AS DOUBLE), 5000.0]"

_view("fx_verdicts", ("fx_cited", "fx_makers"), _evidence_verdict("fx_cited", _near, _LEAVES))

_view(
    "fx_recorded",
    ("fx_answers",),
    """
SELECT *, CASE WHEN k % 19 = 0 THEN NULL
               WHEN k % 11 = 0 OR k % 17 = 0
               THEN 'No matching data is AVAILABLE: not available yet for GLP-1 records.'
               ELSE answer_text END AS answer,
       CASE WHEN k % 5 = 0 THEN NULL
            WHEN k % 5 = 1 THEN 'SELECT sum(AMOUNT_USD) FROM Payments'
            ELSE 'SELECT manufacturer, sum(amount_usd) FROM payments GROUP BY 1' END AS sql,
       (k * 37 % 1000) / 4.0 * 2 + 3 AS latency
FROM fx_answers
""",
)

_SCORED = r"\$?-?\d[\d,]*(?:\.\d+)?%?"


def _has_phrase(text: str) -> str:
    low = f"lower({text})"
    return (
        f"coalesce(contains({low}, 'no matching data') OR contains({low}, 'no data available') "
        f"OR contains({low}, 'not available yet'), false)"
    )


_view(
    "fx_scores",
    ("fx_recorded",),
    f"""
SELECT *, CASE WHEN found THEN (correct AND retrieval_ok) OR (abstained AND expect_abstain) END AS passed
FROM (
    SELECT 'c_' || k AS id, k % 11 = 0 AS expect_abstain, found, found AND k % 4 <> 0 AS accepted,
           CASE WHEN NOT found THEN 'no trace' END AS error,
           CASE WHEN found THEN k % 100 * 2 + 3 ELSE 0 END AS input_tokens,
           CASE WHEN found THEN k % 10 * 2 + 3 ELSE 0 END AS output_tokens,
           CASE WHEN found THEN latency ELSE 0.0 END AS latency_ms,
           CASE WHEN found THEN 2 ELSE 0 END AS calls,
           CASE WHEN NOT found OR k % 7 = 0 THEN NULL
                WHEN answer IS NULL THEN false
                ELSE len(list_filter(numbers, lambda v: abs(v - CAST(sales AS DOUBLE)) <=
                     CASE WHEN k % 3 = 0 THEN CAST(sales AS DOUBLE) * 0.005 ELSE 1e-9 END)) > 0
           END AS correct,
           CASE WHEN NOT found OR (k % 7 = 0 AND k % 3 <> 0) THEN NULL
                WHEN answer IS NULL THEN false
                ELSE (k % 7 = 0 OR len(numbers) > 0)
                     AND (k % 3 <> 0 OR contains(lower(answer), 'sold')) END AS complete,
           CASE WHEN found AND k % 29 <> 0 AND sql IS NOT NULL
                THEN contains(lower(sql), 'payments') AND contains(lower(sql), 'amount_usd')
                     AND contains(lower(sql), 'manufacturer') END AS retrieval_ok,
           found AND {_has_phrase("answer")} AS abstained
    FROM (
        SELECT *, k % 13 <> 0 AS found,
               list_transform(regexp_extract_all(answer, '{_SCORED}'),
                   lambda n: CAST(regexp_replace(n, '[$,%]', '', 'g') AS DOUBLE)) AS numbers
        FROM fx_recorded
    )
)
""",
)

# No look-behind here either: digits behind a letter or hyphen are consumed as text, and so are
# hyphenated digits behind a number.
_CANARY = r"-?\d[\d,]*(?:\.\d+)?(?:-+\d+)*|[A-Za-z-]-?\d+"

_view(
    "fx_canary_numbers",
    ("fx_recorded",),
    rf"""
SELECT *, list_transform(list_filter(list_transform(list_filter(
        regexp_extract_all(coalesce(answer, ''), '{_CANARY}'),
        lambda t: regexp_matches(t, '^-?\d')),
        lambda t: replace(regexp_extract(t, '^-?\d[\d,]*(?:\.\d+)?'), ',', '')),
        lambda t: NOT regexp_full_match(t, '(?:19|20)\d\d')), lambda t: CAST(t AS DOUBLE)) AS numbers
FROM fx_recorded
""",
)

_view(
    "fx_canary",
    ("fx_canary_numbers",),
    f"""
SELECT *, CASE WHEN failed THEN 'ERR' WHEN correct THEN 'OK' ELSE 'MISS' END AS status
FROM (
    SELECT *, CASE WHEN failed THEN false WHEN NOT has_gold THEN abstained
                   ELSE len(numbers) > 0 AND cited AND len(list_filter(numbers, lambda n:
                       NOT (abs(n - CAST(sales AS DOUBLE)) <= CAST(sales AS DOUBLE) * 0.005 + 1e-9
                            OR abs(n - n_lines) <= n_lines * 0.005 + 1e-9))) = 0 END AS correct
    FROM (
        SELECT s_nationkey AS run_id, 'c_' || k AS id, k % 23 = 0 AS failed, k % 7 <> 0 AS has_gold,
               k % 23 <> 0 AND {_has_phrase("answer")} AS abstained,
               CASE WHEN k % 23 <> 0 AND k % 7 <> 0 THEN k % 4 <> 0 AND k % 8 <> 1 END AS cited,
               CASE WHEN sql IS NOT NULL THEN contains(lower(sql), 'manufacturer') END AS retrieval_ok,
               numbers, sales, n_lines
        FROM fx_canary_numbers JOIN supplier ON s_suppkey = k
    )
)
""",
)


def _sql_literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _query_log() -> str:
    from payscope.plans.testbed import SQL_TEXTS

    texts = ", ".join(_sql_literal(t) for t in SQL_TEXTS)
    return f"""
SELECT conv_id, turn, CASE WHEN place = {len(SQL_TEXTS)} THEN text ELSE ([{texts}])[place + 1] END AS sql
FROM (SELECT *, (conv_id * 7 + turn) % {len(SQL_TEXTS) + 1} AS place FROM conversations)
"""


_view("fx_query_log", (), _query_log())

_PAYMENT_COLUMNS = (
    "record_id, program_year, payment_date, quarter, physician_specialty, physician_state, "
    "manufacturer, product, CAST(amount_usd AS DOUBLE) AS amount_usd"
)
_TOTAL = "CAST(sum(amount_usd) AS DOUBLE) AS total_usd"


def _did(event: str) -> str:
    def mean(group: str, period: str) -> str:
        condition = f"WHERE {group} IS NOT NULL AND quarter {'<' if period == 'before' else '>='} ev"
        return (
            f"CAST(sum({group}) FILTER ({condition}) AS DOUBLE) "
            f"/ nullif(count(*) FILTER ({condition}), 0) AS {group[0]}{period[0]}"
        )

    means = ", ".join(mean(g, p) for g in ("treated", "control") for p in ("before", "after"))
    names = {"tb": "treated_before", "ta": "treated_after", "cb": "control_before", "ca": "control_after"}
    empty = ", ".join(f"CASE WHEN {c} IS NULL THEN '{n}' END" for c, n in names.items())
    return f"""
SELECT reason IS NULL AS ok, reason, event_quarter, n_before, n_after,
       tb AS treated_mean_before_usd, ta AS treated_mean_after_usd,
       cb AS control_mean_before_usd, ca AS control_mean_after_usd,
       CASE WHEN reason IS NULL THEN ta - tb END AS treated_delta_usd,
       CASE WHEN reason IS NULL THEN ca - cb END AS control_delta_usd,
       CASE WHEN reason IS NULL THEN (ta - tb) - (ca - cb) END AS diff_in_diff_usd
FROM (
    SELECT *, CASE WHEN tb IS NULL OR ta IS NULL OR cb IS NULL OR ca IS NULL
                   THEN 'insufficient data for: ' || concat_ws(', ', {empty}) END AS reason
    FROM (
        SELECT max(ev) AS event_quarter, count(*) FILTER (WHERE quarter < ev) AS n_before,
               count(*) FILTER (WHERE quarter >= ev) AS n_after, {means}
        FROM (SELECT *, {event} AS ev FROM fx_groups)
    )
)
"""


def _position_sum(last: str) -> str:
    return f"sum(length(before_gap) + length(tok)) OVER (PARTITION BY answer_id ORDER BY pos) {last}"


_ALL_TEXTS = (
    "SELECT 'doc_' || doc_id AS answer_id, text AS answer_text FROM documents "
    "UNION ALL SELECT answer_id, answer_text FROM fx_answers"
)

_LANDED = (
    "record_id, program_year, payment_date, quarter, physician_id, physician_specialty, "
    "physician_state, manufacturer, product, product_generic, nature_of_payment, amount_usd, "
    "matched_field, matched_slot_count, source_year_dataset"
)

_PAYER = "coalesce(nullif(manufacturer, ''), '(unknown)')"
_IS_OTHER = f"lower({_PAYER}) NOT IN ('supplier#000000007', 'supplier#000000011')"

_QUARTERS = {
    "q_by_specialty": "physician_specialty",
    "q_by_state": "physician_state",
    "q_totals": "product, manufacturer",
}
for _name, _dims in _QUARTERS.items():
    _view(
        f"v_{_name}",
        ("fx_payments",),
        f"SELECT quarter, {_dims}, {_TOTAL}, count(*) AS payment_count FROM fx_payments GROUP BY ALL",
    )

ORACLE: dict[str, str] = {
    "filings_match": query("SELECT * FROM fx_matches", "fx_matches"),
    "filings_match_table": query(
        f"""
SELECT record_id, slot, field, min(term) AS term
FROM ({_CELLS}) JOIN (SELECT DISTINCT lower(term) AS term
                      FROM (SELECT p_name AS term FROM part UNION ALL SELECT p_type FROM part)
                      WHERE length(term) > 0) ON contains(lower(text), term)
GROUP BY record_id, slot, field
""",
        "fx_filings",
    ),
    "filings_canonical": query(f"SELECT {_LANDED} FROM fx_landed", "fx_landed"),
    "filings_dates": query(
        """
SELECT record_id, CAST(d AS DATE) AS payment_date, year(d) || 'Q' || quarter(d) AS quarter,
       year(d) * 4 + quarter(d) - 1 AS quarter_ordinal,
       year(d + INTERVAL 3 MONTH) || 'Q' || quarter(d + INTERVAL 3 MONTH) AS next_quarter
FROM (SELECT record_id, coalesce(try_strptime(payment_date, '%Y-%m-%d'),
                                 try_strptime(payment_date, '%m/%d/%Y')) AS d FROM fx_filings)
""",
        "fx_filings",
    ),
    "coerce_good": query(
        "SELECT * REPLACE (CAST(amount_usd AS DOUBLE) AS amount_usd) FROM fx_payments", "fx_payments"
    ),
    "csv_filings": query(
        "SELECT record_id, program_year, quarter, nullif(manufacturer, '') AS manufacturer, product, "
        "amount_usd FROM fx_landed",
        "fx_landed",
    ),
    "landed_json": query(
        "SELECT * REPLACE (CAST(amount_usd AS DOUBLE) AS amount_usd) FROM fx_payments", "fx_payments"
    ),
    "landing_gate": query(
        "SELECT record_id, program_year, product FROM fx_landed "
        "WHERE CAST(program_year AS INTEGER) % 3 <> 0",
        "fx_landed",
    ),
    "coerce_rejects": query(
        "SELECT record_id, amount_usd, manufacturer, reject_reason FROM fx_typed "
        "WHERE reject_reason IS NOT NULL",
        "fx_typed",
    ),
    "load_statistics": query(
        "SELECT CAST(program_year AS INTEGER) AS program_year, count(*) AS rows_seen, "
        "count(*) FILTER (WHERE reject_reason IS NULL) AS rows_upserted, "
        "count(*) FILTER (WHERE reject_reason IS NOT NULL) AS rows_rejected "
        "FROM fx_typed GROUP BY 1",
        "fx_typed",
    ),
    "completeness_gate": query(
        "SELECT record_id, program_year, product FROM fx_landed "
        "WHERE CAST(program_year AS INTEGER) % 3 <> 0",
        "fx_landed",
    ),
    "resume_years": query(
        "SELECT year FROM (SELECT year FROM fx_years UNION SELECT year + 2 FROM fx_years) "
        "WHERE NOT (year % 3 <> 0 AND year IN (SELECT year FROM fx_years))",
        "fx_years",
    ),
    "upsert_latest": query(f"SELECT {_PAYMENT_COLUMNS} FROM fx_latest", "fx_latest"),
    "csv_mixed": query(
        """
SELECT record_id, program_year, quarter,
       CASE WHEN CAST(program_year AS INTEGER) % 3 <> 2 THEN physician_id END AS physician_id, product, amount_usd,
       nature_of_payment || CASE WHEN CAST(program_year AS INTEGER) % 3 = 2
                                 THEN chr(10) || '"second", line' ELSE '' END AS nature_of_payment
FROM fx_landed
""",
        "fx_landed",
    ),
    "csv_quarantine": query(
        """
SELECT program_year AS year, count(*) FILTER (WHERE k % 7 <> 0) AS n_good,
       count(*) FILTER (WHERE k % 7 = 0) AS n_broken
FROM (SELECT program_year, CAST(split_part(record_id, '-', 1) AS BIGINT) AS k FROM fx_filings)
GROUP BY 1
""",
        "fx_filings",
    ),
    "upsert_stamped": query(
        """
SELECT record_id, CAST(program_year AS INTEGER) AS program_year, day AS payment_date, quarter,
       physician_specialty, CASE WHEN fixed THEN 'ZZ' ELSE physician_state END AS physician_state,
       manufacturer, product, CASE WHEN fixed THEN 7.5 ELSE CAST(usd AS DOUBLE) END AS amount_usd
FROM (SELECT *, CAST(split_part(record_id, '-', 1) AS BIGINT) % 4 = 0 AS fixed FROM fx_typed)
WHERE manufacturer <> '' AND (fixed OR reject_reason IS NULL)
""",
        "fx_typed",
    ),
    "upsert_merge": query(f"SELECT {_PAYMENT_COLUMNS} FROM fx_latest", "fx_latest"),
    "manifest_counts": query(
        f"""
SELECT CAST(program_year AS INTEGER) AS year, 'product' AS kind, product AS name,
       count(*) AS rows_matched FROM fx_landed GROUP BY ALL
UNION ALL
SELECT CAST(program_year AS INTEGER), 'manufacturer', {_PAYER} AS payer, count(*)
FROM fx_landed GROUP BY ALL
""",
        "fx_landed",
    ),
    "manifest_failures": query(
        """
SELECT CAST(coalesce(s.year, f.year) AS INTEGER) AS year, coalesce(rows_scanned, 0) AS rows_scanned,
       coalesce(rows_matched, 0) AS rows_matched, f.year IS NULL AS complete,
       CASE WHEN f.year IS NOT NULL THEN 'source went away' END AS error
FROM (
    SELECT CAST(f.program_year AS INTEGER) AS year, count(*) AS rows_scanned, count(l.record_id) AS rows_matched
    FROM fx_filings f LEFT JOIN fx_landed l USING (record_id) GROUP BY 1
) s
FULL JOIN (
    SELECT DISTINCT year + plus AS year FROM fx_years, unnest([0, 2]) AS p(plus) WHERE (year + plus) % 3 = 0
) f ON s.year = f.year
""",
        "fx_landed",
        "fx_years",
    ),
    "manifest_rows": query(
        f"""
SELECT CAST(f.program_year AS INTEGER) AS year, count(*) AS rows_scanned,
       count(l.record_id) AS rows_matched,
       coalesce(round(100.0 * CAST(count(l.record_id) FILTER (WHERE other) AS DOUBLE)
             / nullif(count(l.record_id), 0), 2), 0.0) AS non_manufacturer_of_record_share_pct,
       true AS complete
FROM fx_filings f
LEFT JOIN (SELECT record_id, {_IS_OTHER} AS other FROM fx_landed) l USING (record_id)
GROUP BY 1
""",
        "fx_filings",
        "fx_landed",
    ),
    "non_record_share": query(
        f"""
SELECT *, other_share_pct > 5.0 AS over_threshold FROM (
    SELECT CAST(program_year AS INTEGER) AS year, count(*) AS rows_matched,
           round(CAST(100.0 AS DOUBLE) * count(*) FILTER (WHERE {_IS_OTHER}) / count(*), 2) AS other_share_pct
    FROM fx_landed GROUP BY 1)
""",
        "fx_landed",
    ),
    "top_other_payers": query(
        f"""
SELECT year, manufacturer, rows_matched, nth FROM (
    SELECT *, row_number() OVER (PARTITION BY year ORDER BY rows_matched DESC, manufacturer) AS nth
    FROM (SELECT CAST(program_year AS INTEGER) AS year, {_PAYER} AS manufacturer,
                 count(*) AS rows_matched FROM fx_landed WHERE {_IS_OTHER} GROUP BY ALL)
) WHERE nth <= 3 AND year IN (
    SELECT CAST(program_year AS INTEGER) FROM fx_landed GROUP BY 1
    HAVING count(*) FILTER (WHERE {_IS_OTHER}) * 100.0 / count(*) > 5)
""",
        "fx_landed",
    ),
    "catalog_gate": query(
        """
SELECT year, year || ' General Payment Data' AS title,
       CASE WHEN known THEN 'set-' || year END AS identifier,
       CASE WHEN known AND year % 5 <> 0 THEN 'set/' || year END AS download_url,
       CASE WHEN known THEN '2026-01-01' END AS modified,
       CASE WHEN NOT known THEN 'missing' WHEN year % 5 = 0 THEN 'no download url' ELSE 'ok' END AS status
FROM (SELECT year, year % 4 <> 0 AND year IN (SELECT year FROM fx_years) AS known
      FROM (SELECT year FROM fx_years UNION SELECT year + 2 FROM fx_years))
""",
        "fx_years",
    ),
    "size_check": query(
        """
SELECT year, 'raw/' || year || '.csv' AS key, CAST(bytes AS BIGINT) AS stated_bytes,
       CASE WHEN year % 7 <> 0 THEN CAST(bytes + CASE WHEN year % 3 = 0 THEN 1 ELSE 0 END AS BIGINT) END
           AS stored_bytes,
       CASE WHEN year % 7 <> 0 AND year % 3 <> 0 THEN 'PASS' ELSE 'WARN' END AS status
FROM fx_years WHERE year % 5 <> 0
""",
        "fx_years",
    ),
    "q_totals": query("SELECT * FROM v_q_totals", "v_q_totals"),
    "q_by_specialty": query("SELECT * FROM v_q_by_specialty", "v_q_by_specialty"),
    "q_by_state": query("SELECT * FROM v_q_by_state", "v_q_by_state"),
    "fact_total": query(
        f"SELECT {_TOTAL} FROM fx_payments WHERE program_year BETWEEN 1995 AND 1999", "fx_payments"
    ),
    "fact_total_all": query(f"SELECT {_TOTAL} FROM fx_payments", "fx_payments"),
    "fact_one_quarter": query(
        f"SELECT {_TOTAL} FROM fx_payments WHERE quarter = '1997Q1'", "fx_payments"
    ),
    "fact_top_specialty": query(
        f"SELECT physician_specialty, {_TOTAL} FROM fx_payments WHERE physician_specialty IS NOT NULL "
        "GROUP BY 1 ORDER BY total_usd DESC, 1 LIMIT 1",
        "fx_payments",
    ),
    "fact_top_state": query(
        f"SELECT physician_state, {_TOTAL} FROM fx_payments WHERE physician_state IS NOT NULL "
        "GROUP BY 1 ORDER BY total_usd DESC, 1 LIMIT 1",
        "fx_payments",
    ),
    "fact_quarters": query(
        f"SELECT quarter, {_TOTAL} FROM fx_payments WHERE quarter IS NOT NULL GROUP BY 1 ORDER BY 1",
        "fx_payments",
    ),
    "fact_first_quarters": query(
        f"SELECT quarter, {_TOTAL} FROM fx_payments WHERE quarter IS NOT NULL GROUP BY 1 ORDER BY 1 LIMIT 4",
        "fx_payments",
    ),
    "fact_share": query(
        "SELECT round(100.0 * CAST(sum(amount_usd) FILTER (WHERE nature_of_payment = '1-URGENT') AS DOUBLE)"
        " / nullif(CAST(sum(amount_usd) AS DOUBLE), 0), 2) AS urgent_share_pct FROM fx_payments",
        "fx_payments",
    ),
    "fact_share_empty": query(
        "SELECT round(100.0 * CAST(sum(amount_usd) FILTER (WHERE nature_of_payment = 'no such nature')"
        " AS DOUBLE) / nullif(CAST(sum(amount_usd) AS DOUBLE), 0), 2) AS none_share_pct FROM fx_payments",
        "fx_payments",
    ),
    "generic_compare": query(
        f"SELECT product_generic, {_TOTAL} FROM fx_payments "
        "WHERE product_generic IN ('red ring', 'hot gizmo') GROUP BY 1",
        "fx_payments",
    ),
    "other_maker_share": query(
        "SELECT round(100.0 * CAST(sum(amount_usd) FILTER (WHERE manufacturer NOT ILIKE "
        "'%SUPPLIER#00000000%' AND manufacturer NOT ILIKE '%#00000001%') AS DOUBLE)"
        " / nullif(CAST(sum(amount_usd) AS DOUBLE), 0), 2) AS pct FROM fx_payments",
        "fx_payments",
    ),
    "year_count": query(
        "SELECT count(*) AS row_count FROM fx_payments WHERE program_year = 1998", "fx_payments"
    ),
    "user_select_cte": query(
        """
SELECT product_generic, program_year, n,
       round(100.0 * CAST(urgent AS DOUBLE) / nullif(CAST(usd AS DOUBLE), 0), 2) AS urgent_pct,
       round((SELECT sum(total_usd) FROM v_q_by_state q WHERE q.quarter[1:4] = CAST(program_year AS VARCHAR)
              AND q.physician_state IS NOT NULL), 2) AS state_usd,
       month(first_day) AS first_month
FROM (SELECT product_generic, program_year, sum(amount_usd) AS usd,
             sum(amount_usd) FILTER (WHERE nature_of_payment = '1-URGENT') AS urgent,
             count(*) AS n, min(payment_date) AS first_day
      FROM fx_payments WHERE quarter IS NOT NULL GROUP BY ALL)
""",
        "fx_payments",
        "v_q_by_state",
    ),
    "user_union": query(
        "SELECT physician_state AS name, payment_count FROM v_q_by_state WHERE quarter = '1997Q1' "
        "UNION ALL SELECT physician_specialty, payment_count FROM v_q_by_specialty "
        "WHERE quarter = '1997Q1' UNION SELECT quarter, payment_count FROM v_q_by_state",
        "v_q_by_state",
        "v_q_by_specialty",
    ),
    "capped_select": query(
        "SELECT record_id, CAST(amount_usd AS DOUBLE) AS amount_usd FROM fx_payments "
        "ORDER BY amount_usd DESC, record_id LIMIT 5000",
        "fx_payments",
    ),
    "querylog_screen": query(
        r"""
SELECT conv_id, turn, reason IS NULL AS accepted, reason,
       CASE WHEN reason IS NULL THEN body || CASE WHEN regexp_matches(body, '(?i)\bLIMIT\s+\d+')
            THEN '' ELSE ' LIMIT 5000' END END AS normalized
FROM (
    SELECT *, CASE WHEN t = '' THEN 'empty query'
        WHEN contains(body, ';') THEN 'multiple statements'
        WHEN NOT regexp_matches(body, '^(?i)SELECT\b') THEN 'not a single SELECT'
        WHEN regexp_matches(body, '(?i)\b(?:INSERT|UPDATE|DELETE|DROP|ALTER|TRUNCATE|GRANT|REVOKE|CREATE|CALL|EXECUTE|COPY|MERGE)\b')
            THEN 'write keyword'
        WHEN contains(body, '--') OR contains(body, '/*') THEN 'comment'
        WHEN len(targets) = 0 THEN 'no FROM clause'
        WHEN len(bad) > 0 THEN 'table not allowed: ' || bad[1] END AS reason
    FROM (
        SELECT *, list_filter(targets, lambda x: x NOT IN ('payments', 'q_totals', 'q_by_specialty', 'q_by_state')) AS bad
        FROM (
            SELECT *, list_transform(regexp_extract_all(body,
                       '(?i)\b(?:FROM|JOIN)\s+([A-Za-z_][A-Za-z0-9_]*)', 1), lambda x: lower(x)) AS targets
            FROM (SELECT *, CASE WHEN t LIKE '%;' THEN trim(t[:-2], E' \n\t\r') ELSE t END AS body
                  FROM (SELECT *, trim(sql, E' \n\t\r') AS t FROM fx_query_log))
        )
    )
)
""",
        "fx_query_log",
    ),
    "evidence_ids": query(
        "SELECT conv_id, turn, 'q_' || sha256(sql)[1:8] AS evidence_id FROM fx_query_log", "fx_query_log"
    ),
    "series_ids": query(
        """
SELECT k AS series_key, 'f_' || replace(replace(k, ':', '_'), ' ', '_') AS evidence_id
FROM (SELECT 'national' AS k UNION ALL
      SELECT 'specialty:' || specialty FROM (SELECT DISTINCT specialty FROM fx_order_payments))
""",
        "fx_order_payments",
    ),
    "series_national": query(
        "SELECT 'national' AS series_key, quarter, CAST(sum(usd) AS DOUBLE) AS value "
        "FROM fx_order_payments GROUP BY quarter",
        "fx_order_payments",
    ),
}

_TOP3 = "(SELECT specialty FROM fx_order_payments GROUP BY 1 ORDER BY sum(usd) DESC, 1 LIMIT 3)"
_SPECIALTY = (
    "SELECT 'specialty:' || specialty AS series_key, quarter, CAST(sum(usd) AS DOUBLE) AS value "
    f"FROM fx_order_payments WHERE specialty IN {_TOP3} GROUP BY ALL"
)

ORACLE |= {
    "series_top_specialty": query(_SPECIALTY, "fx_order_payments"),
    "series_grouping_sets": query(
        "SELECT 'national' AS series_key, quarter, CAST(sum(usd) AS DOUBLE) AS value "
        f"FROM fx_order_payments GROUP BY quarter UNION ALL {_SPECIALTY}",
        "fx_order_payments",
    ),
    "series_windows": query(
        f"""
SELECT series_key, min(quarter) AS first_quarter, max(quarter) AS last_quarter, count(*) AS n_quarters,
       count(*) FILTER (WHERE q <= {_END}) AS n_train,
       count(*) FILTER (WHERE q > {_END} AND q <= {_END + 4}) AS n_test,
       max(q) - min(q) + 1 <> count(*) AS has_gaps
FROM fx_fine GROUP BY 1
""",
        "fx_fine",
    ),
    "seasonal_change": query(
        "SELECT series_key, quarter, round(value - lag(value, 4) OVER (PARTITION BY series_key "
        "ORDER BY q), 2) AS change FROM fx_fine",
        "fx_fine",
    ),
    "naive_forecast": query(
        """
SELECT series_key, h, (last_q + h) // 4 || 'Q' || ((last_q + h) % 4 + 1) AS quarter,
       last_season[(h - 1) % 4 + 1] AS point
FROM fx_naive, unnest(range(1, 7)) AS r(h)
""",
        "fx_naive",
    ),
    "naive_interval": query(
        """
SELECT series_key, (last_q + h) // 4 || 'Q' || ((last_q + h) % 4 + 1) AS quarter,
       round(last_season[h] - 1.2816 * spread, 3) AS lower_80,
       round(last_season[h] + 1.2816 * spread, 3) AS upper_80
FROM fx_naive, unnest(range(1, 5)) AS r(h)
""",
        "fx_naive",
    ),
    "naive_holdout": query(
        f"""
SELECT f.series_key, 'seasonal_naive' AS model, max(f.n) AS n_train, count(*) AS n_test,
       round(sum(abs(a.value - point)) / count(*), 4) AS mae,
       avg(CASE WHEN a.value BETWEEN point - 1.2816 * spread AND point + 1.2816 * spread
                THEN 1.0 ELSE 0.0 END) AS coverage_80
FROM (
    SELECT series_key, n, spread, {_END} + h AS q, last_season[h] AS point
    FROM (
        SELECT series_key, count(*) AS n, coalesce(stddev_samp(change), 0) AS spread,
               list(value ORDER BY q) FILTER (WHERE back <= 4) AS last_season
        FROM (
            SELECT *, value - lag(value, 4) OVER (PARTITION BY series_key ORDER BY q) AS change,
                   row_number() OVER (PARTITION BY series_key ORDER BY q DESC) AS back
            FROM fx_fine WHERE q <= {_END}
        ) GROUP BY series_key
    ), unnest(range(1, 5)) AS r(h)
) f
JOIN fx_fine a ON a.series_key = f.series_key AND a.q = f.q
JOIN fx_skips s ON s.series_key = f.series_key AND naive_reason IS NULL
GROUP BY f.series_key
""",
        "fx_fine",
        "fx_skips",
    ),
    "series_skips": query(
        "SELECT series_key, coalesce(naive_reason, ets_reason) AS reason FROM fx_skips "
        "WHERE coalesce(naive_reason, ets_reason) IS NOT NULL",
        "fx_skips",
    ),
    # A series that follows the model exactly is continued exactly.
    "hw_forecast": query(
        f"""
SELECT series_key, quarter, {_END} - first_q + 1 AS n_train, value AS actual, value AS point,
       value AS lower_80, value AS upper_80
FROM fx_exact
WHERE q > {_END} AND q <= {_END} + 4 AND first_q <= {_END} - 7 AND last_q >= {_END} + 4
""",
        "fx_exact",
    ),
    # Without a trend both models are exact and the first one stays; with one only Holt-Winters is.
    "model_choice": query(
        f"""
SELECT series_key, CASE WHEN trend = 0 THEN 'seasonal_naive' ELSE 'ets' END AS model,
       last_q - first_q + 1 AS n_history, q - last_q AS h, quarter, value AS point
FROM fx_exact
WHERE q > last_q AND first_q <= {_END} - 7 AND last_q >= {_END} + 4
""",
        "fx_exact",
    ),
    "forecast_run": query(
        f"""
SELECT series_key, n_quarters, first_quarter, last_quarter, CASE WHEN reason IS NULL THEN t.n_train END AS n_train,
       CASE WHEN reason IS NULL THEN 1 END AS models,
       CASE WHEN reason IS NULL THEN 4 END AS steps, CASE WHEN reason IS NULL THEN mae END AS naive_mae,
       CASE WHEN reason IS NULL THEN TRUE END AS chose_least,
       CASE WHEN reason IS NULL THEN t.actuals END AS actuals,
       CASE WHEN reason IS NULL THEN t.actuals END AS ets_actuals, reason
FROM (SELECT *, coalesce(naive_reason, ets_reason) AS reason FROM fx_skips)
JOIN fx_windows USING (series_key) LEFT JOIN fx_naive_scores USING (series_key)
LEFT JOIN (SELECT series_key, count(*) FILTER (WHERE q <= {_END}) AS n_train,
                  round(sum(value) FILTER (WHERE q > {_END} AND q <= {_END} + 4), 2) AS actuals
           FROM fx_fine GROUP BY 1) t USING (series_key)
""",
        "fx_fine",
        "fx_skips",
        "fx_windows",
        "fx_naive_scores",
    ),
    "own_model": query(
        """
SELECT series_key, 'season_mean' AS model, CASE WHEN n >= 4 THEN h END AS h,
       round(CASE WHEN n >= 4 THEN list_sum(last4) / 4 END, 4) AS point,
       CASE WHEN n < 4 THEN 'needs 4 values' END AS error
FROM (SELECT series_key, count(*) AS n, list(value ORDER BY q) FILTER (WHERE back <= 4) AS last4
      FROM (SELECT *, row_number() OVER (PARTITION BY series_key ORDER BY q DESC) AS back FROM fx_fine)
      GROUP BY 1), unnest(range(1, 3)) AS r(h)
WHERE n >= 4 OR h = 1
""",
        "fx_fine",
    ),
    "forecast_lookup": query(
        """
SELECT request_id, status, CASE WHEN h IS NOT NULL THEN 'seasonal_naive' END AS model, h,
       CASE WHEN h IS NOT NULL THEN (last_q + h) // 4 || 'Q' || ((last_q + h) % 4 + 1) END AS quarter,
       last_season[h] AS point, CASE WHEN h IS NOT NULL THEN first_quarter END AS first_quarter,
       CASE WHEN h IS NOT NULL THEN last_quarter END AS last_quarter,
       CASE WHEN h IS NOT NULL THEN n_train END AS n_train, CASE WHEN h IS NOT NULL THEN mae END AS mae
FROM (
    SELECT r.*, n.last_q, n.last_season, w.first_quarter, w.last_quarter, w.n_train, m.mae, CASE
        WHEN r.series_key = '' THEN 'series is required'
        WHEN naive_reason IS NOT NULL THEN 'no forecast: ' || naive_reason
        WHEN n.series_key IS NULL THEN 'unknown series'
        WHEN horizon > 4 THEN 'horizon too long' ELSE 'ok' END AS status,
        unnest(CASE WHEN status = 'ok' THEN range(1, horizon + 1) ELSE [NULL] END) AS h
    FROM (
        SELECT c_custkey AS request_id, c_custkey % 6 + 1 AS horizon, CASE c_custkey % 10
            WHEN 0 THEN 'national' WHEN 1 THEN '' WHEN 2 THEN 'specialty:none'
            ELSE 'specialty:' || c_nationkey || ' ' || c_mktsegment || ' '
                 || ['1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW'][c_custkey % 5 + 1]
            END AS series_key
        FROM customer
    ) r
    LEFT JOIN fx_naive n USING (series_key) LEFT JOIN fx_skips s USING (series_key)
    LEFT JOIN fx_windows w USING (series_key) LEFT JOIN fx_naive_scores m USING (series_key)
)
""",
        "fx_windows",
        "fx_naive_scores",
        "fx_naive",
        "fx_skips",
    ),
    "did_series": query(
        "SELECT quarter, period, CAST(treated AS DOUBLE) AS treated_usd, "
        "CAST(control AS DOUBLE) AS control_usd FROM fx_groups",
        "fx_groups",
    ),
    "did_event": query("SELECT DISTINCT event_quarter FROM fx_groups", "fx_groups"),
    "did_estimate": query(_did("event_quarter"), "fx_groups"),
    "did_insufficient": query(_did("'1990Q1'"), "fx_groups"),
    "claims_numbers": query(
        f"""
SELECT answer_id, raw, CAST("end" - length(raw) AS BIGINT) AS "start", CAST("end" AS BIGINT) AS "end",
       CAST(regexp_replace(raw, '[$,%]', '', 'g') AS DOUBLE) AS value
FROM (SELECT *, {_position_sum('AS "end"')} FROM ({_tokens(_ALL_TEXTS)}))
WHERE counted
""",
        "fx_answers",
    ),
    "claims_markers": query(
        f"""
SELECT answer_id, tok AS raw, CAST("end" - length(tok) AS BIGINT) AS "start", CAST("end" AS BIGINT) AS "end"
FROM (SELECT *, {_position_sum('AS "end"')}
      FROM ({_tokens("SELECT answer_id, answer_text FROM fx_answers")}))
WHERE kind = 'marker'
""",
        "fx_answers",
    ),
    "claims_leaves": query(
        """
SELECT answer_id, evidence_id, position, unnest([sales, share, lines, 7.5, 5000.0]) AS leaf
FROM (
    SELECT 'a_' || k AS answer_id, 'q_' || k AS evidence_id, 2 AS position, CAST(sales AS DOUBLE) AS sales,
           CAST(share AS DOUBLE) AS share, CAST(n_lines AS DOUBLE) AS lines FROM fx_makers
    UNION ALL
    SELECT 'a_' || k, 'q_' || k, 1, 1.0, CAST(share AS DOUBLE), CAST(n_lines AS DOUBLE)
    FROM fx_makers WHERE k % 5 = 0
)
""",
        "fx_makers",
    ),
    "claims_verdicts": query(
        "SELECT answer_id, raw, cited_id, passed, reason FROM fx_verdicts", "fx_verdicts"
    ),
    "claims_strict": query(
        "SELECT answer_id, raw, cited_id, passed, reason FROM "
        f"({_evidence_verdict('fx_cited_strict', _near_strict, _STRICT_LEAVES)})",
        "fx_cited_strict",
        "fx_makers",
    ),
    "claims_answers": query(
        """
SELECT a.answer_id, count(v.raw) AS n_numbers, coalesce(bool_and(v.passed), true) AS accepted,
       coalesce(string_agg(v.raw, ' | ' ORDER BY v.pos) FILTER (WHERE NOT v.passed), '') AS unverified
FROM fx_answers a LEFT JOIN fx_verdicts v USING (answer_id) GROUP BY 1
""",
        "fx_answers",
        "fx_verdicts",
    ),
    "claims_derivations": query(
        f"""
SELECT answer_id, raw, cited_id, reason, reason = 'matches derivation' AS passed
FROM (
    SELECT 'a_' || k AS answer_id, pct || '%' AS raw, 'd_' || k AS cited_id, CASE
        WHEN k % 9 = 8 THEN 'derivation invalid'
        WHEN abs(raw_share * 100 - result) > 1e-6 * greatest(abs(result), 1e-9)
            THEN 'derivation recomputes differently'
        WHEN {_near("result")} THEN 'matches derivation'
        ELSE 'derivation gives another number' END AS reason
    FROM (SELECT *, 2 AS decimals, CAST(pct AS DOUBLE) AS value,
                 CASE WHEN k % 4 = 3 THEN 30.5 ELSE raw_share * 100 END AS result FROM fx_makers)
)
""",
        "fx_makers",
    ),
    "eval_abstain": query(
        f"SELECT 'c_' || k AS case_id, {_has_phrase('answer')} AS abstained FROM fx_recorded WHERE k % 13 <> 0",
        "fx_recorded",
    ),
    "eval_numbers": query(
        f"""
SELECT case_id, i - 1 AS nth, CAST(regexp_replace(found[i], '[$,%]', '', 'g') AS DOUBLE) AS value
FROM (SELECT 'c_' || k AS case_id, regexp_extract_all(answer, '{_SCORED}') AS found
      FROM fx_recorded WHERE k % 13 <> 0), unnest(range(1, len(found) + 1)) AS r(i)
""",
        "fx_recorded",
    ),
    "eval_scores": query(
        "SELECT id, expect_abstain, accepted, error, input_tokens, output_tokens, latency_ms, "
        "CAST(calls AS BIGINT) AS calls, correct, complete, retrieval_ok, abstained, passed FROM fx_scores",
        "fx_scores",
    ),
    "eval_summary": query(
        """
SELECT count(*) FILTER (WHERE passed) AS passed, count(*) FILTER (WHERE NOT passed) AS failed,
       count(*) FILTER (WHERE passed IS NULL) AS not_scored, count(*) AS total,
       CAST(sum(input_tokens) AS BIGINT) AS total_input_tokens,
       CAST(sum(output_tokens) AS BIGINT) AS total_output_tokens,
       sum(latency_ms) AS total_latency_ms
FROM fx_scores
""",
        "fx_scores",
    ),
    "eval_cost": query(
        "SELECT count(*) AS total, round((sum(input_tokens) * CAST(0.06 AS DOUBLE) + "
        "sum(output_tokens) * CAST(0.24 AS DOUBLE)) / 1000000.0, 6) AS total_cost_usd FROM fx_scores",
        "fx_scores",
    ),
    "trace_calls": query(
        "SELECT 'c_' || k AS case_id, CAST(2 AS BIGINT) AS calls, k % 100 * 2 + 3 AS input_tokens, "
        "k % 10 * 2 + 3 AS output_tokens, CAST(latency AS DOUBLE) AS latency_ms FROM fx_recorded WHERE k % 13 <> 0",
        "fx_recorded",
    ),
    "trace_read": query(
        "SELECT id, passed, CAST(latency_ms AS DOUBLE) AS latency_ms, CAST(calls AS BIGINT) AS calls FROM fx_scores",
        "fx_scores",
    ),
    "canary_numbers": query(
        "SELECT 'c_' || k AS id, i - 1 AS nth, numbers[i] AS value "
        "FROM fx_canary_numbers, unnest(range(1, len(numbers) + 1)) AS r(i)",
        "fx_canary_numbers",
    ),
    "canary_gold": query(
        "SELECT coalesce(quarter, '?') || ' ' || physician_state AS id, unnest([0, 1]) AS nth, "
        "unnest([total_usd, CAST(payment_count AS DOUBLE)]) AS value FROM v_q_by_state",
        "v_q_by_state",
    ),
    "canary_scores": query(
        "SELECT CAST(run_id AS BIGINT) AS run_id, id, abstained, cited, correct, retrieval_ok, status "
        "FROM fx_canary",
        "fx_canary",
    ),
    "canary_rollup": query(
        """
SELECT CAST(run_id AS BIGINT) AS run_id, count(*) AS n, CAST(count(*) FILTER (WHERE correct) AS DOUBLE) AS observed,
       CAST(1.0 AS DOUBLE) AS recorded, count(*) FILTER (WHERE status = 'ERR') AS errors,
       count(*) FILTER (WHERE correct) = 1 AS match
FROM fx_canary GROUP BY 1
""",
        "fx_canary",
    ),
    "canary_record": query(
        """
SELECT CAST(run_id AS BIGINT) AS run_id, len(vs) AS n, observed, CAST(1.0 AS DOUBLE) AS recorded, errors,
       observed = 1 AS match, list_sum(vs) AS duration_ms, vs[len(vs) // 2 + 1] AS p50_ms,
       vs[CAST(least(len(vs) - 1, greatest(0, round_even(len(vs) * CAST(0.95 AS DOUBLE) - 0.5, 0))) AS BIGINT) + 1] AS p95_ms
FROM (
    SELECT run_id, CAST(count(*) FILTER (WHERE correct) AS DOUBLE) AS observed,
           count(*) FILTER (WHERE status = 'ERR') AS errors, list(ms ORDER BY ms) AS vs
    FROM (SELECT *, CAST(CAST(id[3:] AS BIGINT) * 37 % 1000 AS DOUBLE) / 4.0 - 20 AS ms FROM fx_canary)
    GROUP BY 1
)
""",
        "fx_canary",
    ),
    "canary_details": query(
        "SELECT CAST(run_id AS BIGINT) AS run_id, id, cited, retrieval_ok, abstained, status = 'ERR' AS failed, "
        "CAST(round_even(CAST(CAST(id[3:] AS BIGINT) * 37 % 1000 AS DOUBLE) / 4.0 - 20, 0) AS BIGINT) AS latency_ms "
        "FROM fx_canary",
        "fx_canary",
    ),
    "canary_report": query("SELECT id, id || ' ' || status AS line FROM fx_canary", "fx_canary"),
    "canary_latency": query(
        """
SELECT event_type, vs[len(vs) // 2 + 1] AS p50_ms,
       vs[CAST(least(len(vs) - 1, round_even(len(vs) * CAST(0.95 AS DOUBLE) - 0.5, 0)) AS BIGINT) + 1] AS p95_ms
FROM (SELECT event_type, list(value ORDER BY value) AS vs FROM events WHERE value IS NOT NULL GROUP BY 1)
"""
    ),
    "case_cover": query(
        """
SELECT 'c_' || k AS id, CASE WHEN k % 13 = 1 THEN 'canary only' ELSE 'cases only' END AS side
FROM fx_makers WHERE (k % 13 = 1) <> (k % 17 = 2)
""",
        "fx_makers",
    ),
    "ledger_latest": query(
        """
SELECT CAST(run_id AS BIGINT) AS run_id, count(*) AS n, CAST(count(*) FILTER (WHERE correct) AS DOUBLE) AS observed,
       CAST(1.0 AS DOUBLE) AS recorded, count(*) FILTER (WHERE status = 'ERR') AS errors,
       count(*) FILTER (WHERE correct) = 1 AS match,
       CASE WHEN run_id % 2 = 0 THEN '2026-02-01' ELSE '2026-01-01' END AS ts
FROM fx_canary GROUP BY run_id
""",
        "fx_canary",
    ),
    "stream_upsert": query(f"SELECT {_PAYMENT_COLUMNS} FROM fx_latest", "fx_latest"),
    "stream_filings": query(f"SELECT {_PAYMENT_COLUMNS} FROM fx_payments", "fx_payments"),
    "stream_quarter_totals": query(
        f"SELECT quarter, {_TOTAL}, count(*) AS payment_count FROM fx_latest GROUP BY 1", "fx_latest"
    ),
    "kept_specialty_view": query(
        f"SELECT quarter, physician_specialty, {_TOTAL}, count(*) AS payment_count FROM fx_latest GROUP BY 1, 2",
        "fx_latest",
    ),
}
for _mode, _source in (("", "fx_cited"), ("_once", "fx_cited_once"), ("_strict", "fx_cited_strict")):
    ORACLE[f"claims_attribution{_mode}"] = query(
        f"SELECT answer_id, raw, value, cited_id FROM {_source}", _source
    )

ORACLE |= {
    "land_years": query(
        f"""
SELECT CAST(f.program_year AS INTEGER) AS year, true AS complete,
       CASE WHEN CAST(f.program_year AS INTEGER) % 3 = 0 THEN 2 ELSE 1 END AS run, count(*) AS rows_scanned,
       0 AS rows_broken, count(l.record_id) AS rows_matched,
       count(l.record_id) FILTER (WHERE reject_reason IS NULL) AS rows_loadable,
       count(l.record_id) FILTER (WHERE reject_reason IS NOT NULL) AS rows_rejected,
       coalesce(round(100.0 * CAST(count(l.record_id) FILTER (WHERE other) AS DOUBLE)
             / nullif(count(l.record_id), 0), 2), 0.0) AS non_manufacturer_of_record_share_pct
FROM fx_filings f
LEFT JOIN (SELECT record_id, {_IS_OTHER} AS other FROM fx_landed) l USING (record_id)
LEFT JOIN (SELECT record_id, reject_reason FROM fx_typed) t USING (record_id)
GROUP BY ALL
""",
        "fx_filings",
        "fx_landed",
        "fx_typed",
    ),
    "load_landed_years": query(f"SELECT {_PAYMENT_COLUMNS} FROM fx_payments", "fx_payments"),
    "stream_load_statistics": query(
        "SELECT count(*) AS rows_seen, count(*) FILTER (WHERE reject_reason IS NULL) AS rows_upserted, "
        "count(*) FILTER (WHERE reject_reason IS NOT NULL) AS rows_rejected FROM fx_typed",
        "fx_typed",
    ),
    "manifest_files": query(
        """
SELECT CAST(f.program_year AS INTEGER) AS year, count(*) AS rows_scanned, count(l.record_id) AS rows_matched,
       true AS complete
FROM fx_filings f LEFT JOIN fx_landed l USING (record_id) GROUP BY 1
""",
        "fx_landed",
    ),
    "catalog_file": ORACLE["catalog_gate"],
    "size_files": query("SELECT CAST(year AS INTEGER) AS year, CAST(bytes + 1 AS BIGINT) AS stored_bytes FROM fx_years", "fx_years"),
    "dictionary_file": query("SELECT record_id, product, product_generic FROM fx_landed", "fx_landed"),
    "user_functions": query(
        """
SELECT CAST(date_trunc('year', payment_date) AS DATE) AS first_day, upper(nature_of_payment) AS nature,
       round(avg(CAST(amount_usd AS DOUBLE)), 2) AS avg_usd, CAST(max(amount_usd) AS DOUBLE) AS max_usd,
       CAST(abs(min(amount_usd) - max(amount_usd)) AS DOUBLE) AS span_usd
FROM fx_payments WHERE payment_date IS NOT NULL GROUP BY 1, 2
""",
        "fx_payments",
    ),
    "case_files": ORACLE["trace_read"],
    "canary_questions": query(
        """
SELECT id, CAST(len(g) AS BIGINT) AS n_gold, round(g[1], 2) AS gold, id NOT IN ('all', 'state') AS correct,
       CASE WHEN id IN ('all', 'state') THEN 'MISS' ELSE 'OK' END AS status
FROM (
    SELECT unnest([
        {'id': 'years', 'g': [sum(usd) FILTER (WHERE program_year BETWEEN 1995 AND 1999)]},
        {'id': 'all', 'g': [sum(usd)]},
        {'id': 'quarter', 'g': [sum(usd) FILTER (WHERE quarter = '1997Q1')]},
        {'id': 'specialty', 'g': [(SELECT sum(CAST(amount_usd AS DOUBLE)) AS t FROM fx_payments WHERE physician_specialty IS NOT NULL
                                   GROUP BY physician_specialty ORDER BY t DESC LIMIT 1)]},
        {'id': 'state', 'g': [(SELECT sum(CAST(amount_usd AS DOUBLE)) AS t FROM fx_payments WHERE physician_state IS NOT NULL
                               GROUP BY physician_state ORDER BY t DESC LIMIT 1)]},
        {'id': 'share', 'g': [round(100.0 * sum(usd) FILTER (WHERE nature_of_payment = '1-URGENT') / sum(usd), 2)]},
        {'id': 'count', 'g': [CAST(count(*) FILTER (WHERE program_year = 1998) AS DOUBLE)]},
        {'id': 'generics', 'g': list_sort([sum(usd) FILTER (WHERE product_generic = 'red ring'),
                                           sum(usd) FILTER (WHERE product_generic = 'hot gizmo')])}
    ], recursive := true)
    FROM (SELECT *, CAST(amount_usd AS DOUBLE) AS usd FROM fx_payments)
)
""",
        "fx_payments",
    ),
}
