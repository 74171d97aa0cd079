"""Probing, format rules, scans, signatures and file-system records."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.scalars import glob
from ..sources.carriers import IMAGES, images, table
from .base import query

PROBES = """probes AS (SELECT o_custkey AS path, o_orderpriority AS plugin, CAST(substr(o_orderpriority, 1, 1) AS BIGINT) AS reg, CAST(max(floor(o_totalprice / 50000)) AS BIGINT) AS conf FROM orders GROUP BY 1, 2, 3)"""


def _probes(spark, sf):
    o = table(spark, sf, "orders")
    return o.groupBy(F.col("o_custkey").alias("path"), F.col("o_orderpriority").alias("plugin"), F.substring("o_orderpriority", 1, 1).cast("long").alias("reg")).agg(
        F.max(F.floor(F.col("o_totalprice") / 50000)).cast("long").alias("conf"))


@query("src01_ranked_probe", f"""WITH {PROBES}, r AS (SELECT *, row_number() OVER w AS k, lead(plugin) OVER w AS second, count(*) OVER (PARTITION BY path) AS claimants, max(conf) OVER (PARTITION BY path) AS top FROM probes WHERE conf > 0
  WINDOW w AS (PARTITION BY path ORDER BY conf DESC, reg)), t AS (SELECT path, count(*) FILTER (conf = top) AS tied FROM r GROUP BY path)
  SELECT r.path, plugin AS winner, conf, claimants, tied, second AS runner_up FROM r JOIN t USING (path) WHERE k = 1""")
def ranked_probe(spark, sf):
    rank = Window.partitionBy("path").orderBy(F.desc("conf"), "reg")
    every = Window.partitionBy("path")
    r = _probes(spark, sf).where("conf > 0").withColumns({"k": F.row_number().over(rank), "runner_up": F.lead("plugin").over(rank), "claimants": F.count("*").over(every), "top": F.max("conf").over(every)})
    r = r.withColumn("tied", F.count_if(F.col("conf") == F.col("top")).over(every))
    return r.where("k = 1").select("path", F.col("plugin").alias("winner"), "conf", "claimants", "tied", "runner_up")


@query("src03_winner_only", f"WITH {PROBES} SELECT path, arg_max(plugin, (conf, -reg)) AS winner FROM probes WHERE conf > 0 GROUP BY path")
def winner_only(spark, sf):
    return _probes(spark, sf).where("conf > 0").groupBy("path").agg(F.max_by("plugin", F.struct("conf", -F.col("reg"))).alias("winner"))


@query("src04_ambiguity", f"""WITH {PROBES}, t AS (SELECT path, max(conf) AS top FROM probes WHERE conf > 0 GROUP BY path)
  SELECT path, string_agg(plugin, ',' ORDER BY reg) AS alternatives, count(*) AS n FROM probes JOIN t USING (path) WHERE conf = top GROUP BY path HAVING count(*) > 1""")
def ambiguity(spark, sf):
    p = _probes(spark, sf).where("conf > 0").withColumn("top", F.max("conf").over(Window.partitionBy("path"))).where("conf = top")
    named = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("reg", "plugin"))), lambda s: s["plugin"]), ",")
    return p.groupBy("path").agg(named.alias("alternatives"), F.count("*").alias("n")).where("n > 1")


@query("src21_boot_record", """WITH b AS (SELECT image, data FROM images WHERE chunk = 0 AND length(data) >= 32) SELECT image, 
  CAST(('0x' || substr(data, 25, 2) || substr(data, 23, 2)) AS BIGINT) AS bytes_per_sector, CAST(('0x' || substr(data, 27, 2)) AS BIGINT) AS per_cluster, CAST(('0x' || substr(data, 31, 2) || substr(data, 29, 2)) AS BIGINT) AS reserved FROM b""".replace("WITH b", f"WITH {IMAGES}, b"))
def boot_record(spark, sf):
    b = images(spark, sf).where("chunk = 0 AND length(data) >= 32")
    le = lambda at, n: F.conv(F.concat(*[F.substring("data", 2 * (at + i) + 1, 2) for i in reversed(range(n))]), 16, 10).cast("long")
    return b.select("image", le(11, 2).alias("bytes_per_sector"), le(13, 1).alias("per_cluster"), le(14, 2).alias("reserved"))


@query("scan04_interleaved_order", """WITH t AS (SELECT DISTINCT user_id // 20 AS disk, user_id AS track FROM events) SELECT disk, track, row_number() OVER (PARTITION BY disk ORDER BY 1 - track % 2, track) - 1 AS step FROM t""")
def interleaved_order(spark, sf):
    """Odd tracks of each disk first, then even ones."""
    t = table(spark, sf, "events").select(F.expr("user_id div 20").alias("disk"), F.col("user_id").alias("track")).distinct()
    return t.select("disk", "track", (F.row_number().over(Window.partitionBy("disk").orderBy(1 - F.col("track") % 2, "track")) - 1).cast("long").alias("step"))


@query("scan08_metadata", """WITH m AS (SELECT event_id, event_type, ts FROM events), l AS (SELECT user_id, event_type, arg_max(value, event_id) AS v FROM events WHERE event_type <> 'error' GROUP BY 1, 2) SELECT user_id AS disk, event_type AS key, v AS value FROM l""")
def metadata(spark, sf):
    last = table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.max_by("value", "event_id").alias("v"))
    kept = last.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "v"))).alias("m"))  # a few keys a disk
    removed = F.map_filter("m", lambda k, v: k != "error")
    return kept.select(F.col("user_id").alias("disk"), F.explode(removed).alias("key", "value"))


@query("scan14_glob", "SELECT p_partkey AS id, p_name AS name FROM part WHERE p_name GLOB '*ll w?dget'")
def glob_filter(spark, sf):
    return table(spark, sf, "part").where(glob(F.col("p_name"), "*ll w?dget")).select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))


@query("prot15_duplicate_sectors", "SELECT l_orderkey AS track, CAST(l_linenumber AS BIGINT) AS sector, count(*) AS copies FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_sectors(spark, sf):
    return table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("track"), F.col("l_linenumber").cast("long").alias("sector")).agg(F.count("*").alias("copies")).where("copies > 1")


@query("fs07_name_hash", """SELECT p_partkey AS id, list_reduce(list_prepend(CAST(length(p_name) AS BIGINT), [CAST(ord(upper(c)) AS BIGINT) FOR c IN string_split(p_name, '')]), lambda h, c: (h * 13 + c) & 2147483647) % 72 AS slot FROM part""")
def name_hash(spark, sf):
    name = F.upper("p_name")
    h = F.aggregate(F.split(name, ""), F.length(name).cast("long"), lambda h, c: (h * 13 + F.ascii(c)).bitwiseAND(2147483647))
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), (h % 72).alias("slot"))
