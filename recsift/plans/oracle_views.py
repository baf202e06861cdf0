"""DuckDB SQL twins of the views and derived tables in :mod:`recsift.plans.context`.

Each entry is a named CTE body; :func:`with_views` emits the CTEs a query needs,
dependencies first.  Only the driver's raw tables are referenced.
"""

from __future__ import annotations

IMG = "https://img.example.com"

VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "items": ((), f"""
        SELECT p_partkey::BIGINT AS item_id, p_type AS category, p_brand AS brand,
               p_size::BIGINT AS size_id, CAST(p_retailprice AS DECIMAL(10,2)) AS price,
               (p_partkey % 5 + 1)::BIGINT AS condition_id,
               CAST(DATE '1995-01-01' + CAST(p_partkey % 365 AS INTEGER) AS TIMESTAMP) AS created_at,
               (p_partkey % 10 <> 9) AS is_active,
               CASE WHEN p_partkey % 7 = 0 THEN NULL
                    WHEN p_partkey % 7 = 1 THEN ''
                    WHEN p_partkey % 7 = 2 THEN '["{IMG}/' || p_partkey || '/0.jpg", "{IMG}/' || p_partkey || '/1.jpg"]'
                    ELSE '["{IMG}/' || p_partkey || '/0.jpg"]' END AS image_urls
        FROM part"""),
    "items_c": (("items",), """
        SELECT * FROM items
        WHERE item_id IS NOT NULL AND category IS NOT NULL AND price IS NOT NULL AND price >= 0
        QUALIFY row_number() OVER (PARTITION BY item_id
                                   ORDER BY created_at DESC NULLS LAST, category, brand) = 1"""),
    "ue": ((), """
        SELECT (l_orderkey * 10 + l_linenumber)::BIGINT AS event_id, o_custkey::BIGINT AS user_id,
               l_partkey::BIGINT AS item_id,
               CASE l_returnflag WHEN 'N' THEN 'save' WHEN 'A' THEN 'cart' WHEN 'R' THEN 'order' END AS event,
               CAST(o_orderdate AS TIMESTAMP) AS ts
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey"""),
    "ev": (("ue", "items_c"), """
        SELECT * FROM ue e
        WHERE e.event IN ('save', 'cart', 'order') AND e.user_id IS NOT NULL AND e.item_id IS NOT NULL
          AND EXISTS (SELECT 1 FROM items_c i WHERE i.item_id = e.item_id)"""),
    "inter": (("ev",), """
        SELECT user_id, item_id,
               max(CASE event WHEN 'save' THEN 1.0 WHEN 'cart' THEN 3.0 WHEN 'order' THEN 5.0 END)::DOUBLE AS weight,
               max(ts) AS ts
        FROM ev GROUP BY user_id, item_id"""),
    "asof_t": (("ev",), "SELECT max(ts) AS as_of FROM ev"),
    "split": (("inter",), """
        SELECT *, CASE WHEN pos <= floor(n * (1 - 0.2::DOUBLE - 0.1::DOUBLE)) THEN 'train'
                       WHEN pos <= floor(n * (1 - 0.2::DOUBLE)) THEN 'val' ELSE 'test' END AS split
        FROM (SELECT *, row_number() OVER (ORDER BY ts, user_id, item_id) AS pos,
                     count(*) OVER () AS n FROM inter)"""),
    "train": (("split",), "SELECT user_id, item_id, weight, ts FROM split WHERE split = 'train'"),
    "test": (("split",), "SELECT user_id, item_id, weight, ts FROM split WHERE split = 'test'"),
    "truth": (("test",), "SELECT DISTINCT user_id, item_id FROM test"),
    "train_users": (("train",), "SELECT DISTINCT user_id FROM train"),
    "pop_ranked": (("train", "items_c"), """
        SELECT item_id, score, row_number() OVER (ORDER BY score DESC, item_id) AS prank
        FROM (SELECT t.item_id, sum(t.weight) AS score FROM train t
              WHERE EXISTS (SELECT 1 FROM items_c i WHERE i.item_id = t.item_id AND i.is_active)
              GROUP BY t.item_id)"""),
    "pop_recs": (("pop_ranked", "train_users", "train"), """
        SELECT user_id, rank, item_id, score FROM (
          SELECT u.user_id, p.item_id, p.score::DOUBLE AS score,
                 row_number() OVER (PARTITION BY u.user_id ORDER BY p.prank) AS rank
          FROM train_users u CROSS JOIN pop_ranked p
          WHERE NOT EXISTS (SELECT 1 FROM train t WHERE t.user_id = u.user_id AND t.item_id = p.item_id))
        WHERE rank <= 20"""),
    "recent_ranked": (("train", "items_c"), """
        SELECT item_id, score, row_number() OVER (ORDER BY score DESC, item_id) AS prank
        FROM (SELECT t.item_id, sum(t.weight) AS score FROM train t
              WHERE EXISTS (SELECT 1 FROM items_c i WHERE i.item_id = t.item_id AND i.is_active)
                AND t.ts > (SELECT max(ts) FROM train) - INTERVAL 365 DAYS
              GROUP BY t.item_id)"""),
    "recent_recs": (("recent_ranked", "train_users", "train"), """
        SELECT user_id, rank, item_id, score FROM (
          SELECT u.user_id, p.item_id, p.score::DOUBLE AS score,
                 row_number() OVER (PARTITION BY u.user_id ORDER BY p.prank) AS rank
          FROM train_users u CROSS JOIN recent_ranked p
          WHERE NOT EXISTS (SELECT 1 FROM train t WHERE t.user_id = u.user_id AND t.item_id = p.item_id))
        WHERE rank <= 20"""),
    "vec": ((), """
        SELECT vec_id::BIGINT AS item_id, CAST(embedding AS DOUBLE[]) AS v, label::BIGINT AS category
        FROM embeddings"""),
    "uvec": (("vec",), """
        SELECT item_id, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS v, category
        FROM vec WHERE list_bool_or(list_transform(v, lambda x: x <> 0))"""),
    "user_vec": (("train", "vec"), """
        SELECT user_id, list(x ORDER BY pos) AS v FROM (
          SELECT user_id, pos, avg(x) AS x FROM (
            SELECT t.user_id, unnest(v.v) AS x, generate_subscripts(v.v, 1) AS pos
            FROM train t JOIN vec v ON t.item_id = v.item_id)
          GROUP BY user_id, pos)
        GROUP BY user_id"""),
    "sev": ((), """
        SELECT event_id::BIGINT AS event_id, CAST(ts AS TIMESTAMP) AS ts, user_id::BIGINT AS user_id,
               CAST(json_extract_string(props, '$.k') AS BIGINT) AS item_id,
               CASE event_type WHEN 'view' THEN 'save' WHEN 'click' THEN 'cart'
                               WHEN 'purchase' THEN 'order' ELSE event_type END AS event
        FROM events"""),
}


def _order(names) -> list[str]:
    out: list[str] = []

    def visit(n):
        if n in out:
            return
        for d in VIEWS[n][0]:
            visit(d)
        out.append(n)
    for n in names:
        visit(n)
    return out


def with_views(body: str, *names: str, extra: dict[str, str] | None = None) -> str:
    """``WITH`` the named views (and their dependencies), then extra CTEs, then body."""
    parts = [f"{n} AS ({VIEWS[n][1]})" for n in _order(names)]
    for n, sql in (extra or {}).items():
        parts.append(f"{n} AS ({sql})")
    return ("WITH " + ",\n".join(parts) + "\n" + body) if parts else body

