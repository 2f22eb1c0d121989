"""What the SQL of all star queries starts from."""

#: Integers of every quarter.
BASE = """
q AS (SELECT n_name AS entity, c_nationkey AS nk, year(l_shipdate) AS y, quarter(l_shipdate) AS q, sum(a)::BIGINT AS v2, sum(CASE WHEN l_returnflag <> 'R' THEN a ELSE 0 END)::BIGINT AS v1
      FROM (SELECT *, round(l_extendedprice * 100)::BIGINT * (100 - round(l_discount * 100)::BIGINT) AS a FROM lineitem) l
      JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL),
b AS (SELECT *, 'FY' || y || '-Q' || q AS period, (nk * 31 + y * 4 + q)::BIGINT AS k, y * 4 + q - 1 AS t FROM q)"""
#: Each quarter with the amount ``back`` quarters before.
PAIRS = "p AS (SELECT b.*, w.v2 AS was FROM b JOIN b w ON w.entity = b.entity AND w.t = b.t - {back})"
#: The key of quarter number ``t``.
KEY = "'FY' || (({t}) // 4) || '-Q' || (({t}) % 4 + 1)"


def million(x: str) -> str:
    """An amount to the nearest hundredth of a million, half up."""
    return f"((({x}) + 50000000) // 100000000 * 100000000)"


def facts(where: str = "true") -> str:
    """The facts of all metrics, as a table ``f`` made from the quarters that ``where`` holds for."""
    one = "SELECT entity, nk, {t} AS t, '{m}' AS metric, {x} AS amount, '{d}' AS as_of, {s} AS seq FROM b WHERE ({w})"
    rows = [("t", "total_revenue", "v1", "2002-01-01", 0, where), ("t", "total_revenue", "v2", "2002-06-01", 1, where), ("t", "kept_revenue", "v1", "2002-01-01", 2, where), ("t", "returned_revenue", "v2 - v1", "2002-01-01", 3, where), ("t", "return_level", "(v2 - v1) * 1000000 // v2", "2002-01-01", 4, where), ("t", "adjusted_revenue", "v2 + CASE WHEN k % 5 = 0 THEN 10000 ELSE 0 END", "2002-01-01", 5, where), ("t + 1", "revenue_guidance", "v2", "2002-01-01", 6, f"({where}) AND nk % 5 = 0")]
    body = " UNION ALL ".join(one.format(t=t, m=m, x=x, d=d, s=s, w=w) for t, m, x, d, s, w in rows)
    return f"f AS (SELECT *, {KEY.format(t='t')} AS period FROM ({body}))"
