"""A deterministic detection scene derived from the lineitem table, as SQL that Spark and DuckDB both run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_ORDER = "l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate"

BASE = f"""SELECT img * 1000 + rn AS rid, img, 1 + l_partkey % 4 AS cat,
 (l_partkey * 37 + l_linenumber * 11) % 560 AS x, (l_suppkey * 53 + l_linenumber * 29) % 400 AS y, 8 + ((img * 1000 + rn) * 13) % 120 AS w, 8 + ((img * 1000 + rn) * 17) % 100 AS h
 FROM (SELECT CAST(floor(l_orderkey / 5) AS BIGINT) AS img, CAST(l_partkey AS BIGINT) AS l_partkey, CAST(l_suppkey AS BIGINT) AS l_suppkey, CAST(l_linenumber AS BIGINT) AS l_linenumber,
 row_number() OVER (PARTITION BY floor(l_orderkey / 5) ORDER BY {_ORDER}) AS rn FROM lineitem) q"""

GT = """SELECT rid AS id, img AS image_id, cat AS category_id, CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y, CAST(w AS DOUBLE) AS w, CAST(h AS DOUBLE) AS h, CAST(w * h AS DOUBLE) AS area, rid % 29 = 0 AS iscrowd
 FROM scene_base WHERE rid % 3 <> 2
 UNION ALL SELECT rid + 700, img, cat, CAST(x + 3 AS DOUBLE), CAST(y + 2 AS DOUBLE), CAST(w AS DOUBLE), CAST(h AS DOUBLE), CAST(w * h AS DOUBLE), rid % 29 = 0 FROM scene_base WHERE rid % 3 <> 2 AND rid % 6 = 0"""

_DT = """SELECT {id} AS id, img AS image_id, CASE WHEN rid % 11 = 0 THEN 1 + cat % 4 ELSE cat END AS category_id, CAST(x + {s} * ((rid * 7) % 9 - 4) AS DOUBLE) AS x, CAST(y + {s} * ((rid * 5) % 7 - 3) AS DOUBLE) AS y,
 CAST(w + {s} * ((rid * 3) % 11 - 5) AS DOUBLE) AS w, CAST(h + {s} * ((rid * 11) % 9 - 4) AS DOUBLE) AS h, CAST((rid * {m}) % {d} AS DOUBLE) / CAST({d} AS DOUBLE) AS score FROM scene_base WHERE rid % 5 <> 0"""
DT = _DT.format(id="rid", s=1, m=7919, d=997) + "\n UNION ALL " + _DT.format(id="rid + 500", s=-1, m=6007, d=997) + " AND rid % 4 = 0"
#: A second model's detections: scores with many ties.
DT_B = _DT.format(id="rid", s=1, m=7919, d=7) + " AND rid % 7 <> 0"

#: CTEs that name the scene's tables.
CTES = f"scene_base AS ({BASE}), gt AS ({GT}), dt AS ({DT}), dt_b AS ({DT_B}), cats AS (SELECT CAST(i AS BIGINT) AS id, 'cat' || i AS name, CASE WHEN i % 2 = 0 THEN 'even' ELSE 'odd' END AS supercategory FROM (VALUES (1), (2), (3), (4)) t(i)), imgs AS (SELECT DISTINCT img AS id, 680 AS width, 500 AS height FROM scene_base)"


#: What a row's number stands for hangs on these alone: rows that agree in them give the same box.
_KEYS = "l_orderkey, l_partkey, l_suppkey, l_linenumber"
#: The two parts of GT and of DT as one pass over the rows, k being the part: the sort beneath is done once for both.
_GT = """SELECT rid + 700 * k AS id, img AS image_id, cat AS category_id, CAST(x + 3 * k AS DOUBLE) AS x, CAST(y + 2 * k AS DOUBLE) AS y, CAST(w AS DOUBLE) AS w, CAST(h AS DOUBLE) AS h, CAST(w * h AS DOUBLE) AS area, rid % 29 = 0 AS iscrowd
 FROM (SELECT *, explode(CASE WHEN rid % 6 = 0 THEN array(0L, 1L) ELSE array(0L) END) AS k FROM {base} WHERE rid % 3 <> 2) q"""
_BOTH = _DT.format(id="rid + 500 * k", s="(1 - 2 * k)", m="(7919 - 1912 * k)", d=997).replace("FROM scene_base WHERE rid % 5 <> 0", "FROM (SELECT *, explode(CASE WHEN rid % 4 = 0 THEN array(0L, 1L) ELSE array(0L) END) AS k FROM {base} WHERE rid % 5 <> 0) q")


#: Rows of lineitem for which there is a shuffle partition, so that what a task sorts doesn't grow with the input.
ROWS = 500_000


def spread(lineitem: DataFrame) -> None:
    """Raises the session's shuffle partitions to one for ROWS rows, and never lowers them; the count is read from the files' footers."""
    conf, name = lineitem.sparkSession.conf, "spark.sql.shuffle.partitions"
    need = -(-lineitem.count() // ROWS)
    if need > int(conf.get(name)):
        conf.set(name, need)


def scene(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The scene's gt, dt, dt_b, cats and imgs as DataFrames."""
    lineitem = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    spread(lineitem)
    base = spark.sql(BASE.replace("FROM lineitem", "FROM {lineitem}").replace(_ORDER, _KEYS), lineitem=lineitem)
    out = {k: spark.sql(v.replace("FROM scene_base", "FROM {base}"), base=base) for k, v in {"gt": _GT, "dt": _BOTH, "dt_b": DT_B}.items()}
    out["cats"] = spark.createDataFrame([(i, f"cat{i}", "even" if i % 2 == 0 else "odd") for i in range(1, 5)], "id bigint, name string, supercategory string")
    out["imgs"] = spark.sql("SELECT DISTINCT CAST(floor(l_orderkey / 5) AS BIGINT) AS id, 680 AS width, 500 AS height FROM {lineitem}", lineitem=lineitem)
    return out
