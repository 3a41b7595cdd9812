"""Source and configuration files that Spark derives from the tables, for queries that scan files.

A supplier is an interface, a customer a class with a nested and a second type (one in ten
implements an interface that no file declares), an order a method of its customer; comments and strings hold brackets and declarations that are
none. A file's rows grow with the tables, and its lines are known, which sources_sql says
in SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PROJECT = "shop"


def _filled(template: str, **values: Column) -> Column:
    out = F.lit(template)
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), value)
    return out


_INTERFACE = """package supp;
/** S{k} { class Wrong { */
public interface S{k} extends {up}Runnable {
  void ship(int n);
  default String label() { return "//{"; }
}
"""
_CLASS = """package cust;

import supp.S{s};
// class Wrong { void no() {} }
public final class C{k} implements S{s} {
  private int total;
  public C{k}(int total) { this.total = total; }
  public int getTotal() { return total; }
  public void setTotal(int total) { this.total = total; }
  public void ship(int n) { String p = "/api/**"; log(p, n); }
  static void log(String text, int n) { /* } */ }
  static class Inner {
    void help() { log("a,b", size(1, 2)); }
  }
{orders}}
class Second{k} { C{k} make(java.util.Map<String, Integer> seen) { return new C{k}(7); } }
"""
_METHOD = '  void order{o}() { log("x", 1); getTotal(); }\n'


def java_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(projectName, file, source) of all suppliers and customers."""
    supp, cust, orders = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("supplier", "customer", "orders"))
    k = F.col("s_suppkey").cast("string")
    faces = supp.select(F.concat(F.lit("supp/S"), k, F.lit(".java")).alias("file"), _filled(_INTERFACE, k=k, up=F.when(F.col("s_suppkey") > 1, "S1, ").otherwise("")).alias("source"))
    own = orders.groupBy("o_custkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list("o_orderkey")), lambda o: _filled(_METHOD, o=o.cast("string"))), "").alias("orders"))
    c = cust.select("c_custkey").join(own, F.col("c_custkey") == F.col("o_custkey"), "left")
    k, s = F.col("c_custkey").cast("string"), (F.col("c_custkey") % 10 + 1).cast("string")
    classes = c.select(F.concat(F.lit("cust/C"), k, F.lit(".java")).alias("file"), _filled(_CLASS, k=k, s=s, orders=F.coalesce("orders", F.lit(""))).alias("source"))
    return faces.unionByName(classes).select(F.lit(PROJECT).alias("projectName"), "file", "source")


def config_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, pos, line) of one YAML file for each nation and one properties file for each region."""
    nation, region = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("nation", "region"))
    key = F.lower(F.translate("n_name", " ", "-"))
    text = F.concat(F.lit("# services\nservice:\n  "), key, F.lit(":\n    base-path: '/api/"), F.col("n_nationkey").cast("string"), F.lit("'  # where\n    empty:\n"))
    yaml = nation.select(F.concat(F.lit("/w/n"), F.col("n_nationkey").cast("string"), F.lit("/src/main/resources/application.yml")).alias("path"), text.alias("text"))
    r = F.col("r_regionkey").cast("string")
    props = region.select(F.concat(F.lit("/w/r"), r, F.lit("/src/main/resources/bootstrap.properties")).alias("path"), F.concat(F.lit("! topics\ntopic."), r, F.lit(" = region-"), r, F.lit("#x\n")).alias("text"))
    return yaml.unionByName(props).select("path", F.posexplode(F.split("text", "\n")).alias("pos", "line"))


def sources_sql() -> str:
    """WITH tables of what java_sources declares: ju units, jf functions, je edges."""
    return """
WITH o AS (SELECT o_custkey AS k, o_orderkey AS o, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i FROM orders),
c AS (SELECT c_custkey AS k, c_custkey % 10 + 1 AS s, 'cust/C' || c_custkey || '.java' AS file, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS n FROM customer),
s AS (SELECT s_suppkey AS k, 'supp/S' || s_suppkey || '.java' AS file FROM supplier),
ju AS (SELECT 'supp.S' || k AS qualified, 'supp' AS pkg, file, 'interface' AS unitType, 'public' AS modifiers, CAST(3 AS INT) AS startLine, CAST(6 AS INT) AS endLine FROM s
  UNION ALL SELECT 'cust.C' || k, 'cust', file, 'class', 'public final', 5, CAST(15 + n AS INT) FROM c
  UNION ALL SELECT 'cust.C' || k || '.Inner', 'cust', file, 'class', 'static', 12, 14 FROM c
  UNION ALL SELECT 'cust.Second' || k, 'cust', file, 'class', '', CAST(16 + n AS INT), CAST(16 + n AS INT) FROM c),
jf AS (SELECT 'supp.S' || k AS unit, 'supp.S' || k || '.ship(int)' AS "full", 'ship' AS name, file, '' AS modifiers, 'void' AS returnType, false AS isConstructor, CAST(4 AS INT) AS startLine, CAST(4 AS INT) AS endLine FROM s
  UNION ALL SELECT 'supp.S' || k, 'supp.S' || k || '.label()', 'label', file, 'default', 'String', false, 5, 5 FROM s
  UNION ALL SELECT 'cust.C' || k, 'cust.C' || k || '.C' || k || '(int)', 'C' || k, file, 'public', '', true, 7, 7 FROM c
  UNION ALL SELECT 'cust.C' || k, 'cust.C' || k || '.getTotal()', 'getTotal', file, 'public', 'int', false, 8, 8 FROM c
  UNION ALL SELECT 'cust.C' || k, 'cust.C' || k || '.setTotal(int)', 'setTotal', file, 'public', 'void', false, 9, 9 FROM c
  UNION ALL SELECT 'cust.C' || k, 'cust.C' || k || '.ship(int)', 'ship', file, 'public', 'void', false, 10, 10 FROM c
  UNION ALL SELECT 'cust.C' || k, 'cust.C' || k || '.log(String,int)', 'log', file, 'static', 'void', false, 11, 11 FROM c
  UNION ALL SELECT 'cust.C' || k || '.Inner', 'cust.C' || k || '.Inner.help()', 'help', file, '', 'void', false, 13, 13 FROM c
  UNION ALL SELECT 'cust.Second' || k, 'cust.Second' || k || '.make(java.util.Map)', 'make', file, '', 'C' || k, false, CAST(16 + n AS INT), CAST(16 + n AS INT) FROM c
  UNION ALL SELECT 'cust.C' || k, 'cust.C' || k || '.order' || o || '()', 'order' || o, file, '', 'void', false, CAST(14 + i AS INT), CAST(14 + i AS INT) FROM o JOIN c USING (k)),
ca AS (SELECT 'cust.C' || k || '.ship(int)' AS f, 'cust.C' || k || '.log(String,int)' AS t, 10 AS line FROM c
  UNION ALL SELECT 'cust.C' || k || '.Inner.help()', 'cust.C' || k || '.log(String,int)', 13 FROM c
  UNION ALL SELECT 'cust.Second' || k || '.make(java.util.Map)', 'cust.C' || k || '.C' || k || '(int)', 16 + n FROM c
  UNION ALL SELECT 'cust.C' || k || '.order' || o || '()', 'cust.C' || k || '.log(String,int)', 14 + i FROM o JOIN c USING (k)
  UNION ALL SELECT 'cust.C' || k || '.order' || o || '()', 'cust.C' || k || '.getTotal()', 14 + i FROM o JOIN c USING (k)),
je AS (SELECT 'pkg:' || pkg AS f, 'PACKAGE_TO_UNIT' AS ty, 'unit:' || qualified AS t, CAST(NULL AS INT) AS line FROM ju
  UNION ALL SELECT 'unit:' || unit, 'UNIT_TO_FUNCTION', 'fn:' || "full", CAST(NULL AS INT) FROM jf
  UNION ALL SELECT 'unit:supp.S' || k, 'JAVA_EXTENDS', 'unit:supp.S1', CAST(NULL AS INT) FROM s WHERE k > 1
  UNION ALL SELECT 'unit:cust.C' || k, 'JAVA_IMPLEMENTS', 'unit:supp.S' || s, CAST(NULL AS INT) FROM c WHERE s IN (SELECT k FROM s)
  UNION ALL SELECT 'fn:supp.S' || k || '.' || m, 'JAVA_OVERRIDES', 'fn:supp.S1.' || m, CAST(NULL AS INT) FROM s, (SELECT unnest(['ship(int)', 'label()']) AS m) WHERE k > 1
  UNION ALL SELECT DISTINCT 'fn:cust.C' || k || '.ship(int)', 'JAVA_OVERRIDES', 'fn:supp.S' || x || '.ship(int)', CAST(NULL AS INT) FROM (SELECT k, unnest(CASE WHEN s > 1 THEN [s, 1] ELSE [s] END) AS x FROM c WHERE s IN (SELECT k FROM s))
  UNION ALL SELECT 'fn:' || f, 'CALLS', 'fn:' || t, CAST(line AS INT) FROM ca)"""
