"""DuckDB SQL of the derived views; quire.sources.views has the same in Spark."""

from __future__ import annotations

import re

VIEWS = {
    "doc_lines": "SELECT doc_id, unnest(range(len(l))) AS line_no, unnest(l) AS line FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)",
    "doc_pages": "SELECT doc_id, line_no // 5 + 1 AS page_no, string_agg(line, chr(10) ORDER BY line_no) AS markdown, list(line ORDER BY line_no) AS lines FROM doc_lines GROUP BY ALL",
    "page_tokens": """SELECT doc_id, page_no, markdown, length(markdown) // 4 AS token_count, trim(lines[-1], ' ' || chr(9) || chr(13)) AS last_line FROM doc_pages""",
    "page_ends": """SELECT *, NOT (contains(last_line, '|') AND length(last_line) - length(replace(last_line, '|', '')) < 3) AND NOT ends_with(last_line, ',') AS clean FROM page_tokens""",
    "l1_fold": """SELECT doc_id, page_no, 0 AS chunk, token_count AS t, clean FROM page_ends WHERE page_no = 1
        UNION ALL
        SELECT p.doc_id, p.page_no,
               f.chunk + CASE WHEN (f.t >= 1200 AND f.clean) OR f.t + p.token_count > 2000 THEN 1 ELSE 0 END,
               CASE WHEN (f.t >= 1200 AND f.clean) OR f.t + p.token_count > 2000 THEN 0 ELSE f.t END + p.token_count, p.clean
        FROM l1_fold f JOIN page_ends p ON p.doc_id = f.doc_id AND p.page_no = f.page_no + 1""",
    "l1_chunks": """SELECT f.doc_id, f.chunk, min(f.page_no) AS start_page, max(f.page_no) AS end_page, sum(p.token_count)::BIGINT AS token_count,
        string_agg(chr(10) || '--- PAGE ' || f.page_no || ' ---' || chr(10) || p.markdown || chr(10), '' ORDER BY f.page_no) AS text
        FROM l1_fold f JOIN page_tokens p ON p.doc_id = f.doc_id AND p.page_no = f.page_no GROUP BY f.doc_id, f.chunk""",
    "l1_words": "SELECT doc_id, chunk, start_page, end_page, list_filter(string_split_regex(text, '[ \\t\\n\\r\\f\\v]+'), lambda x: x <> '') AS w FROM l1_chunks",
    "l2_windows": "SELECT *, unnest(range(CASE WHEN len(w) <= 512 THEN 1 ELSE 1 + CAST(ceil((len(w) - 512) / 432.0) AS BIGINT) END)) AS window_index FROM l1_words",
    "l2_chunks": """SELECT doc_id, chunk, window_index, window_index * 432 AS offset_start, least(window_index * 432 + 512, len(w)) - 1 AS offset_end,
        array_to_string(w[window_index * 432 + 1 : window_index * 432 + 512], ' ') AS text, start_page, end_page FROM l2_windows""",
    "files": """SELECT doc_id AS file_id, doc_id % 20 AS user_id,
        'doc_' || doc_id || CASE doc_id % 6 WHEN 0 THEN '.pdf' WHEN 1 THEN '.docx' WHEN 2 THEN '.DOC' WHEN 3 THEN '.txt' WHEN 4 THEN '.exe' ELSE '' END AS name,
        coalesce(text, '') AS content, doc_id AS arrival, CASE WHEN doc_id % 17 = 0 THEN 'failed' ELSE 'ok' END AS status FROM documents""",
    "usage_logs": """SELECT event_id, user_id, event_type AS operation_type, 'model-' || (event_id % 5) AS model,
        CAST(floor(value * 1000) AS BIGINT) AS input_tokens, CAST(floor(value * 100) AS BIGINT) AS output_tokens, ts FROM events""",
    "costs": """SELECT l.*, CAST((l.input_tokens * coalesce(p.p_in, 10) + l.output_tokens * coalesce(p.p_out, 40) + 50) // 100 AS DECIMAL(18, 0)) * CAST(0.000001 AS DECIMAL(7, 6)) AS cost
        FROM usage_logs l LEFT JOIN (VALUES ('model-0', 10, 40), ('model-1', 15, 60), ('model-2', 125, 1000), ('model-3', 30, 250)) p(model, p_in, p_out) USING (model)""",
    "quotas": "SELECT DISTINCT user_id, CASE WHEN user_id % 50 = 0 THEN 0.00 ELSE 15.00 END AS monthly_limit, CASE user_id % 3 WHEN 0 THEN 'free' WHEN 1 THEN 'pro' ELSE 'premium' END AS plan FROM events",
    "timings": "SELECT event_id, event_type AS operation, value / 1000 AS duration_s, ts FROM events",
    "sessions": """SELECT event_id AS session_id, user_id, ts AS ended_at, event_type <> 'error' AND event_id % 11 <> 0 AS success,
        CAST(event_id % 40 AS DOUBLE) AS upload, value / 100 AS validation, value / 150 AS classification, value / 10 AS content_extraction,
        CAST(event_id % 7 AS DOUBLE) AS l1_chunking, CAST(event_id % 13 AS DOUBLE) AS l2_chunking, CAST(event_id % 3 AS DOUBLE) AS vector_storage,
        value / 5 AS llm_processing, CAST(0 AS DOUBLE) AS pdf_generation, (event_id % 100 + 1) * 100000 AS size_bytes FROM events""",
    "steps": """SELECT session_id, success, ended_at, u.k AS step, u.v AS secs FROM (SELECT *, unnest([{'k':'upload','v':upload},{'k':'validation','v':validation},{'k':'classification','v':classification},
        {'k':'content_extraction','v':content_extraction},{'k':'l1_chunking','v':l1_chunking},{'k':'l2_chunking','v':l2_chunking},{'k':'vector_storage','v':vector_storage},{'k':'llm_processing','v':llm_processing},{'k':'pdf_generation','v':pdf_generation}]) AS u FROM sessions)""",
    "emails": """SELECT conv_id * 100 + turn AS email_id, conv_id, turn, ' User' || (conv_id % 50) || '@Example.COM ' AS sender, ['other@example.org', 'U' || (conv_id % 40) || '@in.example.com'] AS recipients,
        CASE WHEN conv_id % 9 = 0 THEN 'm' || conv_id ELSE 'm' || conv_id || '-' || turn END AS message_id,
        text || CASE turn % 4 WHEN 0 THEN '' WHEN 1 THEN '' WHEN 2 THEN chr(10) || '---------- Forwarded message ---------' || chr(10) || text ELSE chr(10) || 'BEGIN forwarded message:' || chr(10) || text END AS body,
        TIMESTAMP '2024-01-01 00:00:00' + to_minutes(conv_id * 37 + turn) AS received_at FROM conversations WHERE role = 'user'""",
    "endpoints": "SELECT c_custkey AS user_id, 'u' || c_custkey || '@in.example.com' AS alias, c_custkey % 7 <> 0 AS is_active, CASE WHEN c_custkey % 11 <> 0 THEN 'agent-' || (c_custkey % 5) END AS default_agent FROM customer",
    "senders": """SELECT c_custkey AS user_id, 'user' || (c_custkey % 50) || '@example.com' AS email, CASE WHEN c_custkey % 3 = 0 THEN 'pending' ELSE 'verified' END AS status, 'tok' || c_custkey AS token,
        CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE TIMESTAMP '2001-07-01 00:00:00' + to_days(CAST(c_custkey % 60 AS INTEGER)) END AS expires_at FROM customer""",
    "decisions": """SELECT e.email_id, e.received_at, CASE WHEN e.n > 1 THEN 'duplicate' WHEN p.user_id IS NULL THEN 'unknown_alias' WHEN p.default_agent IS NULL THEN 'invalid_endpoint' WHEN NOT p.is_active THEN 'inactive_alias'
        WHEN s.user_id IS NULL THEN 'unverified_sender' WHEN p.user_id % 13 = 0 THEN 'credit_limited' WHEN length(e.body) < 40 THEN 'discarded' ELSE 'accepted' END AS decision
        FROM (SELECT *, lower(trim(sender)) AS who, row_number() OVER (PARTITION BY message_id ORDER BY received_at, email_id) AS n FROM emails) e
        LEFT JOIN endpoints p ON p.alias IN (lower(e.recipients[1]), lower(e.recipients[2])) LEFT JOIN senders s ON s.user_id = p.user_id AND s.email = e.who AND s.status = 'verified'""",
    "users": "SELECT c_custkey AS user_id, CASE WHEN c_custkey % 19 = 0 THEN 'blocked' ELSE 'active' END AS status, c_name AS name FROM customer",
    "orgs": "SELECT n_nationkey AS org_id, n_name AS name, CASE WHEN n_nationkey % 12 = 5 THEN 'blocked' ELSE 'active' END AS status FROM nation",
    "members": "SELECT c_nationkey AS org_id, c_custkey AS user_id, CASE WHEN c_custkey % 10 = 0 THEN 'admin' ELSE 'user' END AS role, CASE WHEN c_custkey % 23 = 0 THEN 'blocked' ELSE 'active' END AS status FROM customer WHERE c_custkey % 4 <> 0",
    "logins": """SELECT c_custkey AS session_id, c_custkey AS user_id, CASE WHEN c_custkey % 5 = 0 THEN DATE '2001-07-15' END AS revoked_at, DATE '2001-06-01' + CAST(c_custkey % 120 AS INTEGER) AS expires_at FROM customer""",
    "agents": "SELECT p_partkey AS agent_id, p_partkey % 3 <> 0 AS is_custom, p_partkey % 1500 AS owner_id, CASE WHEN p_partkey % 5 <> 0 THEN p_partkey % 25 END AS org_id FROM part",
    "email_jobs": """SELECT o_orderkey AS job_id, o_custkey AS user_id, CAST(o_orderdate AS TIMESTAMP) AS created_at,
        CASE WHEN o_orderkey % 10 = 0 THEN 'discarded' WHEN o_orderstatus = 'P' THEN 'pending' WHEN o_orderstatus = 'O' THEN 'processing' ELSE 'completed' END AS status FROM orders""",
}


def with_views(sql: str) -> str:
    """sql with the views that it names, and those that they name, as a WITH clause."""
    need: list[str] = []

    def add(text: str, above: str = "") -> None:
        for v, body in VIEWS.items():
            if v != above and re.search(rf"\b{v}\b", text):
                if v not in need:
                    add(body, v)
                    if v not in need:
                        need.append(v)

    add(sql)
    more = ""
    if need and sql.startswith("WITH "):
        sql, more = "", ", " + sql.removeprefix("WITH ").removeprefix("RECURSIVE ")
    return ("WITH RECURSIVE " + ", ".join(f"{v} AS ({VIEWS[v]})" for v in need) + more + "\n" + sql) if need else sql
