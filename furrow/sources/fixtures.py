"""Tables of the engine's shapes, derived by SQL from the generic star schema.

The same statements run in Spark (through `fixture`) and in any ANSI engine (through
`with_views`), so a query and its SQL twin start from equal rows.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents labels".split()

VIEWS: dict[str, str] = {
    "lst_obs": "SELECT user_id AS pixel, event_id AS seq, ts, 260 + value/10 AS lst, event_id % 4 AS bayes, (event_id*7919) % 40000 AS confidence, event_id % 60 AS vza, event_id % 360 AS vaa FROM events",
    "met_hourly": "SELECT date_trunc('hour', ts) AS hour, 255 + avg(value)/10 AS t2m, sum(value)*1000 AS ssrd, avg(value)/50 AS u100, avg(value)/60 AS v100 FROM events GROUP BY 1",
    "scene_catalog": "SELECT o_orderkey AS scene_id, o_orderdate AS datetime, 5 + (o_custkey % 100)/10.0 AS x0, 47 + (o_orderkey % 80)/10.0 AS y0, 6 + (o_custkey % 100)/10.0 AS x1, 47.7 + (o_orderkey % 80)/10.0 AS y1 FROM orders",
    "pixels": "SELECT l_orderkey % 40 AS r, l_partkey % 40 AS c, concat('X', CAST(CAST(floor((l_orderkey % 40)/10) AS BIGINT) AS VARCHAR(9)), '_Y', CAST(CAST(floor((l_partkey % 40)/10) AS BIGINT) AS VARCHAR(9))) AS tile, avg(l_quantity)*40 AS red, avg(l_extendedprice)/40 AS bnr, avg(l_discount)*10 AS extent, avg(l_tax)*10 AS boundary FROM lineitem GROUP BY 1,2,3",
    "et_daily": "SELECT user_id AS pixel, CAST(ts AS DATE) AS d, avg(value)/20 - 1 AS et FROM events GROUP BY 1,2",
    "labels2": "SELECT r, c, CASE WHEN extent < 0.45 THEN 0 ELSE 1 + CAST(floor(r/5) AS BIGINT)*8 + CAST(floor(c/5) AS BIGINT) END AS ref, CASE WHEN boundary < 0.37 THEN 0 ELSE 1 + CAST(floor(r/4) AS BIGINT)*10 + CAST(floor(c/4) AS BIGINT) END AS pred FROM pixels",
    "parcels": "SELECT p_partkey AS field_id, p_type AS category, (p_partkey % 50)*40.0 AS x0, floor(p_partkey/50)*40.0 AS y0, (p_partkey % 50)*40.0 + p_size*0.7 AS x1, floor(p_partkey/50)*40.0 + p_size*0.7 AS y1, p_size*p_size*0.49/10000 AS area_ha FROM part",
    "chips": "SELECT r_name AS state, l_linenumber AS band, l_orderkey % 16 AS chip_r, l_partkey % 16 AS chip_c, sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS pixel_count FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1,2,3,4",
    "class_pred": "SELECT doc_id, quality AS label, CASE WHEN n_chars > 500 THEN 1 ELSE 0 END AS pred FROM labels JOIN documents USING (doc_id)",
    "station": "SELECT event_id AS id, 2024 AS year, CAST(extract(doy FROM ts) AS INT) AS doy, extract(hour FROM ts) + extract(minute FROM ts)/60.0 AS hr, 285 + value/20 AS t_r1, 283 + (event_id % 15) AS t_a1, 1 + (event_id % 6) AS u, 8 + (event_id % 10) AS ea, 100 + value*1.5 AS s_dn, (event_id % 40)/10.0 AS lai, 0.1 + (event_id % 20)/20.0 AS h_c, event_id % 45 AS vza FROM events",
}


def _uses(sql: str) -> set[str]:
    """Tables and views that sql reads (extract(... FROM column) names none of them)."""
    return set(re.findall(r"(?:FROM|JOIN)\s+(\w+)", sql)) & {*TABLES, *VIEWS}


def views_below(name: str) -> list[str]:
    """name and the views it reads, in the order they must be declared."""
    out: list[str] = []
    for used in sorted(_uses(VIEWS[name])):
        if used in VIEWS:
            out += [v for v in views_below(used) if v not in out]
    return [*out, name]


def with_views(sql: str, *names: str) -> str:
    """sql under a WITH clause that declares the named views; a WITH of its own is merged."""
    order: list[str] = []
    for name in names:
        order += [v for v in views_below(name) if v not in order]
    head = ", ".join(f"{v} AS ({VIEWS[v]})" for v in order)
    body = sql.strip()
    if body.upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {head}, {body[14:].strip()}"
    if body.upper().startswith("WITH"):
        return f"WITH {head}, {body[4:].strip()}"
    return f"WITH {head} {body}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The view `name` over the tables in sf_dir."""
    order = views_below(name)
    used = set().union(*(_uses(VIEWS[v]) for v in order)) - set(order)
    sql = f"WITH {', '.join(f'{v} AS ({VIEWS[v]})' for v in order)} SELECT * FROM {name}"
    for t in used:
        sql = re.sub(rf"((?:FROM|JOIN)\s+){t}\b", rf"\1{{{t}}}", sql)
    return spark.sql(sql, **{t: table(spark, sf_dir, t) for t in used})
