"""SQL twins of the evaluation operators, parameterised by CTE names."""

from __future__ import annotations


METRICS = ("precision", "recall", "ndcg", "mrr", "hit_rate", "map")


def per_user_ctes(recs: str, truth: str, users: str, ks=(5, 10, 20), prefix: str = "m") -> dict[str, str]:
    """CTEs computing ``{prefix}_per`` (user_id, k, six metrics) for binary relevance."""
    kmax = max(ks)
    ks_list = ", ".join(str(k) for k in ks)
    p = prefix
    return {
        f"{p}_ks": f"SELECT unnest([{ks_list}]) AS k",
        f"{p}_tsize": f"SELECT user_id, count(*) AS n_truth FROM {truth} GROUP BY user_id",
        f"{p}_pref": f"""SELECT i, sum(1.0 / log2(i + 1)) OVER (ORDER BY i) AS s
                          FROM range(1, {kmax + 1}) t(i)""",
        f"{p}_r": f"""
            SELECT r.user_id, r.rank, r.item_id, (t.item_id IS NOT NULL) AS hit, ks.k,
                   sum(CASE WHEN t.item_id IS NOT NULL THEN 1 ELSE 0 END) OVER (
                       PARTITION BY r.user_id, ks.k ORDER BY r.rank
                       ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run_hits
            FROM {recs} r JOIN {p}_ks ks ON r.rank <= ks.k
            LEFT JOIN {truth} t ON t.user_id = r.user_id AND t.item_id = r.item_id""",
        f"{p}_agg": f"""
            SELECT user_id, k,
                   count(DISTINCT CASE WHEN hit THEN item_id END) AS hits,
                   sum(CASE WHEN hit THEN 1.0 / log2(rank + 1) END) AS dcg,
                   min(CASE WHEN hit THEN rank END) AS first_hit,
                   sum(CASE WHEN hit THEN run_hits / rank END) AS ap_sum
            FROM {p}_r GROUP BY user_id, k""",
        f"{p}_per": f"""
            SELECT u.user_id, ks.k::INTEGER AS k,
                   coalesce(a.hits, 0) / ks.k AS precision,
                   CASE WHEN coalesce(ts.n_truth, 0) > 0 THEN coalesce(a.hits, 0) / ts.n_truth ELSE 0.0 END AS recall,
                   CASE WHEN coalesce(ts.n_truth, 0) > 0 THEN coalesce(a.dcg, 0.0) / pf.s ELSE 0.0 END AS ndcg,
                   coalesce(1.0 / a.first_hit, 0.0) AS mrr,
                   CASE WHEN coalesce(a.hits, 0) > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS hit_rate,
                   CASE WHEN coalesce(ts.n_truth, 0) > 0
                        THEN coalesce(a.ap_sum, 0.0) / least(ks.k, ts.n_truth) ELSE 0.0 END AS map
            FROM (SELECT DISTINCT user_id FROM {users}) u CROSS JOIN {p}_ks ks
            LEFT JOIN {p}_agg a ON a.user_id = u.user_id AND a.k = ks.k
            LEFT JOIN {p}_tsize ts ON ts.user_id = u.user_id
            LEFT JOIN {p}_pref pf ON pf.i = least(ks.k, ts.n_truth)""",
    }


def long_means(per: str, keys: str = "") -> str:
    """Average each metric per k: rows (keys..., metric, k, value)."""
    kcols = f"{keys}, " if keys else ""
    union = " UNION ALL ".join(
        f"SELECT {kcols}'{m}' AS metric, k, avg({m}) AS value FROM {per} GROUP BY {kcols}k" for m in METRICS)
    return union
