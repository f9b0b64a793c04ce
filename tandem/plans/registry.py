"""The registry of queries, and the logical inputs in SQL for their oracles."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}

#: The adapters of ``tandem.sources.tables`` in SQL; each may use those before it.
INPUTS = {
    "items": """SELECT concat(label + 1, '/', vec_id + 1) AS id, CAST(label + 1 AS INTEGER) AS archive, CAST(vec_id + 1 AS INTEGER) AS sequence,
        CASE WHEN vec_id % 2 = 0 THEN 'v' ELSE 'h' END AS orient,
        CAST(greatest(0, least(255, round((vec[1] + 1) * 127.5))) AS INTEGER) AS r, CAST(greatest(0, least(255, round((vec[2] + 1) * 127.5))) AS INTEGER) AS g,
        CAST(greatest(0, least(255, round((vec[3] + 1) * 127.5))) AS INTEGER) AS b,
        CAST(round((vec[4] + 1) * 50) AS INTEGER) AS ll, CAST(round(vec[5] * 100) AS INTEGER) AS aa, CAST(round(vec[6] * 100) AS INTEGER) AS bb,
        vec_id % 3 = 0 AS people, vec_id % 7 = 0 AS face, CAST(vec_id * 7919 % 1000 AS BIGINT) AS sum_d0,
        vec, vec[1:32] AS vec_l, vec[33:64] AS vec_r, list_transform(vec, lambda x: abs(x)) AS histo
        FROM (SELECT *, CAST(embedding AS DOUBLE[]) AS vec FROM embeddings)""",
    "canon": """SELECT a.id AS id1, b.id AS id2, a.orient, a.sequence AS seq1, b.sequence AS seq2 FROM items a JOIN items b ON a.orient = b.orient AND a.sequence < b.sequence""",
    "pairs": """SELECT a.id AS id1, b.id AS id2, a.orient, a.sequence AS seq1, b.sequence AS seq2,
        CAST(floor((1 + list_inner_product(a.vec_l, b.vec_r)) * 1e6) AS BIGINT) AS d012, CAST(floor((1 + list_inner_product(b.vec_l, a.vec_r)) * 1e6) AS BIGINT) AS d021
        FROM items a JOIN items b ON a.orient = b.orient AND a.sequence < b.sequence""",
    "sides": """SELECT id1 AS id, id2 AS other, d012 AS value, 1 AS position FROM pairs UNION ALL SELECT id2, id1, d021, 2 FROM pairs""",
    "hashed": "SELECT *, ((seq1 * 31 + seq2 * 17) // 2) % 10 AS h FROM canon",
    "labels_": """SELECT TIMESTAMP '2024-01-01' + to_seconds(seq1 * 7 + seq2) AS create_time, CAST(seq1 % 50 AS BIGINT) AS browser_id,
        CASE WHEN seq1 % 3 = 0 THEN 'ab' ELSE 'AB' END AS curator, id1, id2, seq1, seq2,
        CASE WHEN h <= 2 THEN 1 WHEN h <= 5 THEN 2 ELSE 0 END AS status, orient = 'v' AS vertical FROM hashed WHERE h <= 6""",
    "seen": "SELECT id1, id2 FROM hashed WHERE h <= 7 UNION ALL SELECT id2, id1 FROM hashed WHERE h = 8",
    "matrix": """SELECT CAST(m.model AS INTEGER) AS model, a.vec_id AS i, b.vec_id AS j,
        CASE m.model WHEN 3 THEN 0.5 WHEN 4 THEN 0.99 ELSE CAST((a.vec_id * 31 + b.vec_id * 17 + m.model * 7) % 1000 AS DOUBLE) / 999.0 END::DOUBLE AS p
        FROM embeddings a, embeddings b, (SELECT unnest(range(5)) AS model) m""",
    "tokens": "SELECT DISTINCT p_partkey AS id, 'm' AS coder, unnest(string_split(lower(p_name), ' ')) AS word FROM part",
    "log": """SELECT e.event_id AS id, e.ts AS create_time, e.user_id AS browser_id, a.id AS id1, b.id AS id2, e.event_type AS sel_method,
        CAST(floor(e.value * 10) AS INTEGER) AS user_time, CAST(list_position(['click', 'error', 'purchase', 'signup', 'view'], e.event_type) AS INTEGER) AS rating,
        a.sequence % 2 = 1 AS vertical
        FROM events e, (SELECT count(*) AS n FROM embeddings) c, items a, items b
        WHERE a.sequence - 1 = e.event_id % c.n AND b.sequence - 1 = (e.event_id * 7 + 2) % c.n AND a.id <> b.id""",
    "lists": """SELECT * FROM (SELECT id AS qid, CAST(row_number() OVER (PARTITION BY id ORDER BY value DESC, other) - 1 AS INTEGER) AS rank, other AS id, value FROM sides) WHERE rank < 60""",
    "lists2": """SELECT * FROM (SELECT other AS qid, CAST(row_number() OVER (PARTITION BY other ORDER BY value, id) - 1 AS INTEGER) AS rank, id, value FROM sides) WHERE rank < 60""",
    "numbered": "SELECT 0 AS list_no, * FROM lists UNION ALL SELECT 1, * FROM lists2",
    "training": """SELECT id1, id2, CASE WHEN pos THEN 1 ELSE 0 END AS label, CASE WHEN pos THEN 'approved' ELSE 'rejected' END AS source
        FROM (SELECT id1, id2, bool_or(status = 1) AS pos, bool_or(status = 2) AS neg FROM labels_ GROUP BY ALL) WHERE pos <> neg
        UNION ALL SELECT DISTINCT id1, id2, 0, 'seen' FROM seen s WHERE NOT EXISTS (SELECT 1 FROM labels_ l WHERE l.id1 = s.id1 AND l.id2 = s.id2 AND l.status IN (1, 2))""",
}
NEEDS = {
    "canon": ["items"], "pairs": ["items"], "sides": ["pairs"], "hashed": ["canon"], "labels_": ["hashed"], "seen": ["hashed"],
    "log": ["items"], "lists": ["sides"], "lists2": ["sides"], "numbered": ["lists", "lists2"], "training": ["labels_", "seen"],
}


def with_inputs(names: str, sql: str) -> str:
    """``sql`` with the inputs it names, and those they need, as common tables."""
    wanted: list[str] = []

    def add(name: str) -> None:
        for other in NEEDS.get(name, []):
            add(other)
        if name not in wanted:
            wanted.append(name)

    for name in names.split():
        add(name)
    sql = sql.strip()
    recursive = "RECURSIVE " if sql.upper().startswith("WITH RECURSIVE ") else ""
    head = f"WITH {recursive}" + ", ".join(f"{n} AS MATERIALIZED ({INPUTS[n]})" for n in wanted) if wanted else ""
    if head and sql.upper().startswith("WITH "):
        return head + ", " + sql[5 + len(recursive) :]
    return f"{head} {sql}"


def query(sql: str | None = None, inputs: str = ""):
    """Register a query under its function's name, with its oracle unless SQL cannot state it."""

    def wrap(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = with_inputs(inputs, sql)
        return f

    return wrap
