"""The input views over the driver tables, as SQL text that Spark and the checking engine both read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

_PIXEL_COLS = """vec_id AS image_id, CAST(floor(vec_id/2) AS BIGINT) AS subject,
       CASE WHEN vec_id % 2 = 0 THEN 'L' ELSE 'R' END AS foot, CASE WHEN label >= 5 THEN 1 ELSE 0 END AS y,
       CAST(floor(i/8) AS INT) AS row_no, CAST(i % 8 AS INT) AS col_no"""

# name: (table, spark text, text for the checking engine or None when the same)
VIEWS: dict[str, tuple[str, str, str | None]] = {
    "pixels": (
        "embeddings",
        f"""SELECT {_PIXEL_COLS},
       CAST(greatest(0, least(255, floor((CAST(e AS DOUBLE)+0.5)*256))) AS INT) AS v
FROM (SELECT vec_id, label, posexplode(embedding) AS (i, e) FROM {{embeddings}})""",
        f"""SELECT {_PIXEL_COLS},
       CAST(greatest(0, least(255, floor((CAST(embedding[i+1] AS DOUBLE)+0.5)*256))) AS INT) AS v
FROM embeddings, (SELECT unnest(range(0,64)) AS i)""",
    ),
    "rgb_pixels": (
        "embeddings",
        "SELECT image_id, row_no, col_no, " + ", ".join(
            f"CAST(greatest(0, least(255, floor((CAST(e{k} AS DOUBLE)+0.5)*256))) AS INT) AS {c}" for k, c in enumerate("rgb"))
        + """ FROM (SELECT vec_id AS image_id, CAST(floor(i/8) AS INT) AS row_no, CAST(i % 8 AS INT) AS col_no, embedding[i] AS e0,
        embedding[(i+1)%64] AS e1, embedding[(i+2)%64] AS e2 FROM (SELECT vec_id, embedding, explode(sequence(0,63)) AS i FROM {embeddings}))""",
        "SELECT image_id, row_no, col_no, " + ", ".join(
            f"CAST(greatest(0, least(255, floor((CAST(e{k} AS DOUBLE)+0.5)*256))) AS INT) AS {c}" for k, c in enumerate("rgb"))
        + """ FROM (SELECT vec_id AS image_id, CAST(i//8 AS INT) AS row_no, CAST(i % 8 AS INT) AS col_no, embedding[i+1] AS e0,
        embedding[(i+1)%64+1] AS e1, embedding[(i+2)%64+1] AS e2 FROM embeddings, (SELECT unnest(range(0,64)) AS i))""",
    ),
    "activations": (
        "embeddings",
        """SELECT vec_id AS image_id, CAST(floor(i/16) AS INT) AS ch, CAST(floor(i%16/4) AS INT) AS h, CAST(i%4 AS INT) AS w,
       CAST(e AS DOUBLE) AS act FROM (SELECT vec_id, posexplode(embedding) AS (i, e) FROM {embeddings})""",
        """SELECT vec_id AS image_id, CAST(floor(i/16) AS INT) AS ch, CAST(floor(i%16/4) AS INT) AS h, CAST(i%4 AS INT) AS w,
       CAST(embedding[i+1] AS DOUBLE) AS act FROM embeddings, (SELECT unnest(range(0,64)) AS i)""",
    ),
    "zone_temps": (
        "lineitem",
        """SELECT l_partkey AS image_id, CAST(floor(l_partkey/2) AS BIGINT) AS subject,
       CASE WHEN l_partkey % 2 = 0 THEN 'L' ELSE 'R' END AS foot,
       CASE l_linenumber % 5 WHEN 0 THEN 'LPA' WHEN 1 THEN 'MPA' WHEN 2 THEN 'LCA' WHEN 3 THEN 'MCA' ELSE 'FullFoot' END AS zone,
       CASE WHEN l_suppkey % 7 = 0 THEN 0.0E0 ELSE (200 + 3*l_quantity)/10.0E0 END AS temp
FROM {lineitem}""",
        None,
    ),
    "preds": (
        "lineitem",
        """SELECT l_orderkey*10 + l_linenumber AS sample_id, l_orderkey AS group_id, l_orderkey % 5 + 1 AS fold,
       (l_orderkey*7 + l_linenumber) % 48 AS run_no,
       max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS y,
       max(round(l_discount*100))/10.0E0 AS p_a, max(l_quantity)/50.0E0 AS p_b
FROM {lineitem} GROUP BY l_orderkey, l_linenumber""",
        None,
    ),
    "forms": (
        "customer",
        """SELECT c_custkey AS pid_no, s.side AS side,
       CASE (c_custkey*7 + s.k) % 4 WHEN 0 THEN 'y' WHEN 1 THEN 'n' WHEN 2 THEN 'y' END AS mf1,
       CASE (c_custkey*5 + s.k) % 4 WHEN 0 THEN 'n' WHEN 1 THEN 'y' WHEN 2 THEN 'n' END AS mf2,
       CASE (c_custkey*3 + s.k) % 5 WHEN 0 THEN 'y' WHEN 1 THEN 'n' WHEN 2 THEN '' WHEN 3 THEN 'n' END AS mf3,
       CASE (c_custkey + s.k) % 5 WHEN 0 THEN 'normal' WHEN 1 THEN 'pad' WHEN 2 THEN 'calcified' WHEN 3 THEN 'other' END AS abi,
       CASE (c_custkey + 2*s.k) % 3 WHEN 0 THEN 'pad' WHEN 1 THEN 'normal' END AS tbi,
       (c_custkey + s.k) % 6 = 0 AS def_hammer, (c_custkey + s.k) % 11 = 0 AS def_charcot,
       CASE c_custkey % 7 WHEN 0 THEN 'yes' WHEN 6 THEN '' ELSE 'no' END AS ulcer,
       CASE c_custkey % 13 WHEN 0 THEN 'yes' ELSE 'no' END AS amp,
       CASE WHEN c_custkey % 17 = 0 THEN 'yes' WHEN c_custkey % 19 = 0 THEN NULL ELSE 'no' END AS ckd,
       c_mktsegment AS nurse, c_acctbal AS age_like
FROM {customer} LATERAL VIEW explode(array(named_struct('side','L','k',0), named_struct('side','R','k',1))) x AS s""",
        """SELECT c_custkey AS pid_no, s.side AS side,
       CASE (c_custkey*7 + s.k) % 4 WHEN 0 THEN 'y' WHEN 1 THEN 'n' WHEN 2 THEN 'y' END AS mf1,
       CASE (c_custkey*5 + s.k) % 4 WHEN 0 THEN 'n' WHEN 1 THEN 'y' WHEN 2 THEN 'n' END AS mf2,
       CASE (c_custkey*3 + s.k) % 5 WHEN 0 THEN 'y' WHEN 1 THEN 'n' WHEN 2 THEN '' WHEN 3 THEN 'n' END AS mf3,
       CASE (c_custkey + s.k) % 5 WHEN 0 THEN 'normal' WHEN 1 THEN 'pad' WHEN 2 THEN 'calcified' WHEN 3 THEN 'other' END AS abi,
       CASE (c_custkey + 2*s.k) % 3 WHEN 0 THEN 'pad' WHEN 1 THEN 'normal' END AS tbi,
       (c_custkey + s.k) % 6 = 0 AS def_hammer, (c_custkey + s.k) % 11 = 0 AS def_charcot,
       CASE c_custkey % 7 WHEN 0 THEN 'yes' WHEN 6 THEN '' ELSE 'no' END AS ulcer,
       CASE c_custkey % 13 WHEN 0 THEN 'yes' ELSE 'no' END AS amp,
       CASE WHEN c_custkey % 17 = 0 THEN 'yes' WHEN c_custkey % 19 = 0 THEN NULL ELSE 'no' END AS ckd,
       c_mktsegment AS nurse, c_acctbal AS age_like
FROM customer CROSS JOIN (SELECT 'L' AS side, 0 AS k UNION ALL SELECT 'R', 1) s""",
    ),
    "demographics": (
        "customer",
        """SELECT c_custkey AS subject, CASE WHEN c_custkey % 2 = 0 THEN 'F' ELSE 'M' END AS gender,
       CASE WHEN c_custkey % 23 = 0 THEN NULL ELSE CAST(20 + c_custkey % 60 AS DOUBLE) END AS age,
       CASE WHEN c_custkey % 29 = 0 THEN NULL ELSE c_nationkey / 4.0E0 END AS tci_l, c_acctbal / 1000.0E0 AS tci_r
FROM {customer}""",
        None,
    ),
    "case_events": (
        "events",
        """SELECT event_id, ts, concat('P', lpad(CAST(user_id AS STRING), 4, '0')) AS research_id,
       CASE event_type WHEN 'signup' THEN 'crf_save' WHEN 'view' THEN 'podoscope' WHEN 'click' THEN 'thermal'
                       WHEN 'purchase' THEN 'commit' ELSE 'crf_delete' END AS action,
       value, props
FROM {events}""",
        None,
    ),
    "boxes": (
        "part embeddings",
        """SELECT p_partkey AS box_id, p_partkey % (SELECT count(*) FROM {embeddings}) AS image_id, CASE WHEN p_partkey % 2 = 0 THEN 'L' ELSE 'R' END AS foot,
       p_size*3 AS x, (p_partkey*7) % 300 AS y, 20 + p_partkey % 41 AS w, 15 + p_partkey % 37 AS h,
       p_partkey % 23 AS x_min, p_partkey % 29 AS y_min, p_partkey % 11 AS pad_left, p_partkey % 13 AS pad_top,
       320 + p_partkey % 5 * 32 AS square_size, 640 AS orig_w, 480 AS orig_h
FROM {part}""",
        None,
    ),
    "features": (
        "embeddings",
        """SELECT vec_id AS id, CASE WHEN label >= 5 THEN 1 ELSE 0 END AS y, vec_id % 5 AS fold, i AS feature, CAST(e AS DOUBLE) AS x
FROM (SELECT vec_id, label, posexplode(embedding) AS (i, e) FROM {embeddings})""",
        """SELECT vec_id AS id, CASE WHEN label >= 5 THEN 1 ELSE 0 END AS y, vec_id % 5 AS fold, CAST(i AS INT) AS feature,
       CAST(embedding[i+1] AS DOUBLE) AS x FROM embeddings, (SELECT unnest(range(0,64)) AS i)""",
    ),
}


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    sources, text, _ = VIEWS[name]
    return spark.sql(text, **{source: read_table(spark, sf_dir, source) for source in sources.split()})


def check_text(name: str) -> str:
    sources, text, other = VIEWS[name]
    if other is not None:
        return other
    for source in sources.split():
        text = text.replace("{" + source + "}", source)
    return text
