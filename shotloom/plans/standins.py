"""The domain's tables over the driver's: line items as shots, orders as matches, customers as players.

The SQL text of each stand-in runs in Spark and elsewhere alike, with the tables' names filled in.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SQL = {
    "shots": """
SELECT CAST(l.l_orderkey * 10 + l.l_linenumber AS BIGINT) AS event_id, l.l_orderkey AS match_id, CAST(l.l_linenumber AS BIGINT) AS idx,
  o.o_custkey AS player_id, c.c_name AS player, CAST(c.c_nationkey AS BIGINT) AS team_id, concat('Team ', CAST(c.c_nationkey AS STRING)) AS team,
  60 + l.l_quantity * 1.2 AS x, l.l_extendedprice % 90 - 5 AS y, l.l_quantity AS quantity, l.l_extendedprice AS price,
  CAST(l.l_suppkey % 95 AS BIGINT) AS minute, CAST(1 + l.l_linenumber % 4 AS BIGINT) AS period, l.l_discount AS statsbomb_xg,
  l.l_returnflag = 'R' AS is_goal, l.l_linestatus = 'F' AND l.l_quantity >= 48 AS is_shootout, l.l_returnflag AS outcome,
  CASE WHEN l.l_linenumber <= 3 THEN 'Open Play' WHEN l.l_linenumber = 4 THEN 'Penalty' ELSE 'Free Kick' END AS shot_type,
  o.o_orderpriority AS body_part, c.c_mktsegment AS stage, l.l_linestatus AS technique, l.l_tax > 0.04 AS under_pressure, l.l_quantity > 25 AS first_time,
  l.l_linenumber = 1 AS one_on_one, l.l_suppkey AS supplier, CAST(year(o.o_orderdate) AS BIGINT) AS season_id
FROM {lineitem} l JOIN {orders} o ON l.l_orderkey = o.o_orderkey JOIN {customer} c ON o.o_custkey = c.c_custkey
""",
    "matches": """
SELECT o.o_orderkey AS match_id, CAST(n.n_regionkey AS BIGINT) AS competition_id, CAST(year(o.o_orderdate) AS BIGINT) AS season_id,
  concat('Cup ', CAST(n.n_regionkey AS STRING)) AS competition_name, CAST(year(o.o_orderdate) AS STRING) AS season_name,
  CAST(o.o_orderdate AS DATE) AS match_date, c.c_mktsegment AS stage, CAST(c.c_nationkey AS BIGINT) AS home_team_id, concat('Team ', CAST(c.c_nationkey AS STRING)) AS home_team,
  CAST(o.o_orderkey % 25 AS BIGINT) AS away_team_id, concat('Team ', CAST(o.o_orderkey % 25 AS STRING)) AS away_team,
  CAST(o.o_orderkey % 4 + o.o_orderkey % 3 AS BIGINT) AS total_goals, CASE WHEN o.o_orderstatus = 'P' THEN NULL ELSE o.o_orderstatus END AS shot_fidelity_version, o.o_orderstatus AS xy_fidelity_version
FROM {orders} o JOIN {customer} c ON o.o_custkey = c.c_custkey JOIN {nation} n ON c.c_nationkey = n.n_nationkey
""",
    "players": """
SELECT c.c_custkey AS player_id, c.c_name AS display_name, concat('Team ', CAST(c.c_nationkey AS STRING)) AS team, CAST(c.c_nationkey AS BIGINT) AS team_id, CAST(1 + c.c_custkey % 9 AS BIGINT) AS squad_listings FROM {customer} c
""",
}
SOURCES = ("lineitem", "orders", "customer", "nation")


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A stand-in, or one of the driver's tables."""
    if name in SQL:
        tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in SOURCES if "{" + t + "}" in SQL[name]}
        return spark.sql(SQL[name], **tables)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def oracle(body: str) -> str:
    """A query over the stand-ins that it names, as one statement."""
    used = [n for n in SQL if n in body]
    parts = [f"{n} AS ({SQL[n].format(**{t: t for t in SOURCES}).strip()})" for n in used]
    body = body.strip()
    if body.upper().startswith("WITH "):
        return "WITH " + ", ".join([*parts, body[5:]])
    return f"WITH {', '.join(parts)} {body}" if parts else body
