"""Parts of DuckDB SQL that several oracles share."""

from __future__ import annotations


def bigram_sql(pairs: str) -> str:
    """CTEs that end in sim(a, b, score): the 2-gram similarity of the rows (a, b) of a query, to be put after WITH RECURSIVE."""
    return f"""
pairs AS (SELECT DISTINCT a, b FROM ({pairs})),
dp AS (
  SELECT a, b, 0 AS j, 0::DOUBLE AS before, list_transform(range(0, length(a) + 1), lambda i: i::DOUBLE) AS r
  FROM pairs WHERE a <> b AND length(a) >= 2 AND length(b) >= 2
  UNION ALL
  SELECT a, b, j + 1, r[-1], list_reduce(
    list_prepend(
      [least(before + 1, r[1] + 1, r[-1] + CASE WHEN j > 0 AND substr(a, length(a), 1) = substr(b, j, 1) THEN 0.5 ELSE 1 END)::DOUBLE],
      list_transform(range(1, length(a) + 1), lambda i: [i::DOUBLE])),
    lambda done, x: list_append(done, least(done[-1] + 1, r[x[1]::INT + 1] + 1, r[x[1]::INT] + CASE
      WHEN x[1] = 1 AND j = 0 THEN (substr(a, 1, 1) <> substr(b, 1, 1))::INT
      ELSE 0.5 * (substr(a, x[1]::INT, 1) <> substr(b, j + 1, 1))::INT
         + 0.5 * CASE WHEN x[1] > 1 AND j > 0 THEN (substr(a, x[1]::INT - 1, 1) <> substr(b, j, 1))::INT ELSE 1 END END)))
  FROM dp WHERE j < length(b)),
sim AS (
  SELECT a, b, 1 - r[-1] / greatest(length(a), length(b)) AS score FROM dp WHERE j = length(b)
  UNION ALL
  SELECT a, b, CASE WHEN a = b THEN 1 WHEN a = '' OR b = '' THEN 0 ELSE 1 - (substr(a, 1, 1) = substr(b, 1, 1))::INT / greatest(length(a), length(b))::DOUBLE END
  FROM pairs WHERE a = b OR length(a) < 2 OR length(b) < 2)"""


def profile_sql(table: str, columns: list[str]) -> str:
    """dataset, attr, value, cnt of a table."""
    return " UNION ALL ".join(f"SELECT '{table}' AS dataset, '{c}' AS attr, {c}::VARCHAR AS value, count(*) AS cnt FROM {table} WHERE {c} IS NOT NULL GROUP BY ALL" for c in columns)
