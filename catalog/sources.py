"""IO: scans, sinks, literals, metadata."""

from pyspark.sql import functions as F

from catalog.registry import query
from terrapanel.operators.geometry import parts_area, parts_from_wkb, wkb_from_parts
from terrapanel.operators.spatial import ring_area, ring_from_wkt, wkt_from_ring
from terrapanel.session import shared_folder
from terrapanel.sources import files
from terrapanel.session import spread


@query("io01_csv_clean_scan", """
SELECT s_suppkey AS supplier_key, s_name AS supplier_name, s_nationkey AS nation_key, s_acctbal AS acct_bal FROM supplier""",
       real="acct_bal")
def io01(t):
    out = shared_folder(t.spark, "io01")
    named = t.supplier.toDF("Supplier Key", " Supplier-Name", "Nation.Key", "Acct Bal ($)")
    named.write.option("header", True).csv(out)
    df = files.read_csv_clean(t.spark, out)
    return df.select(F.col("supplier_key").cast("bigint"), "supplier_name", F.col("nation_key").cast("bigint"),
                     F.col("acct_bal").cast("double"))


@query("io02_dated_files_scan", """
SELECT year(o_orderdate) AS file_year, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL""", ints="file_year n")
def io02(t):
    out = shared_folder(t.spark, "io02")
    src = t.orders.select("o_orderkey", "o_orderpriority", F.year("o_orderdate").alias("file_year"))
    # partition folders stand in for dated file names: the year is read from the path
    src.hint("rebalance", "file_year").write.option("header", True).partitionBy("file_year").csv(out)
    df = files.read_dated_files(t.spark, f"{out}/*/*.csv", r"file_year=(\d{4})", "o_orderkey bigint, o_orderpriority string",
                                {"file_year": 1})
    return df.groupBy("file_year", "o_orderpriority").agg(
        F.count(F.lit(1)).alias("n"))


@query("io03_delimited_code_table", "SELECT p_type AS code_type, p_brand AS code, count(*) AS n FROM part GROUP BY ALL")
def io03(t):
    out = shared_folder(t.spark, "io03")
    t.part.select("p_partkey", "p_type", "p_brand").write.option("header", True).option("sep", "|").csv(out)
    df = files.read_delim(t.spark, out, "|")
    return df.groupBy(F.col("p_type").alias("code_type"), F.col("p_brand").alias("code")).agg(F.count(F.lit(1)).alias("n"))


@query("io04_tolerant_aliases", """
SELECT CAST(p_partkey AS VARCHAR) AS parcel_id, p_type AS use_code, CAST(p_retailprice AS DOUBLE) AS just_value,
  p_size AS living_area, CAST(NULL AS VARCHAR) AS alt_key FROM part""", real="just_value", ints="living_area")
def io04(t):
    raw = t.part.select(F.col("p_partkey").cast("string").alias("PARCELNO"), F.concat(F.lit(" "), "p_type").alias("DOR_UC"),
                        F.concat(F.lit("$"), F.format_number("p_retailprice", 2)).alias("JV"),
                        F.col("p_size").cast("string").alias("TOT_LVG_AR"))
    return files.read_with_aliases(raw, {
        "parcel_id": ["parcel_id", "parcelno"], "use_code": ["use_code", "dor_uc"], "just_value": ["just_val", "jv"],
        "living_area": ["tot_lvg_ar", "living_sqft"], "alt_key": ["alt_key"]},
        {"just_value": "number", "living_area": "integer"})


@query("io05_split_by_level", """
SELECT 'region' AS geo_level, CAST(r_regionkey AS VARCHAR) AS geo_id, count(*) AS n FROM customer
  JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL
UNION ALL SELECT 'nation', CAST(c_nationkey AS VARCHAR), count(*) FROM customer GROUP BY ALL""")
def io05(t):
    j = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    master = j.select(F.lit("nation").alias("geo_level"), F.col("c_nationkey").cast("string").alias("geo_id")).unionByName(
        j.select(F.lit("region").alias("geo_level"), F.col("n_regionkey").cast("string").alias("geo_id")))
    out = shared_folder(t.spark, "io05")
    files.write_levels(master.groupBy("geo_level", "geo_id").agg(F.count(F.lit(1)).alias("n")), out, "bps")
    parts = files.split_by_level(files.table(t.spark, out, "bps"), "geo_level", {
        "nation": ["geo_level", "geo_id", "n"], "region": ["geo_level", "geo_id", "n"]})
    return parts["nation"].unionByName(parts["region"]).select("geo_level", F.col("geo_id").cast("string"), "n")


@query("io06_table_scan", "SELECT l_returnflag, count(*) AS n FROM lineitem WHERE l_quantity > 25 GROUP BY ALL")
def io06(t):
    return t.lineitem.filter("l_quantity > 25").groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"))


@query("io07_publish_overwrite", "SELECT n_nationkey AS nation_key, count(*) AS n FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY ALL",
       ints="nation_key")
def io07(t):
    out = shared_folder(t.spark, "io07")
    files.publish(t.supplier.limit(0).select(F.col("s_nationkey").alias("nation_key"), F.lit(0).cast("bigint").alias("n")), out, "gold.suppliers")
    fresh = t.supplier.groupBy(F.col("s_nationkey").alias("nation_key")).agg(F.count(F.lit(1)).alias("n"))
    files.publish(fresh, out, "gold.suppliers")
    return files.table(t.spark, out, "gold.suppliers")


@query("io08_replace_partition", """
SELECT o_orderstatus AS county_tag, CASE WHEN o_orderstatus = 'F' THEN 2 ELSE 1 END AS load_no, count(*) AS n FROM orders GROUP BY ALL""",
       ints="load_no")
def io08(t):
    out = shared_folder(t.spark, "io08")
    load = lambda df, k: df.select(F.col("o_orderstatus").alias("county_tag"), "o_orderkey", F.lit(k).alias("load_no"))
    files.publish(load(t.orders, 1), out, "parcel.raw", ["county_tag"])
    files.replace_partition(load(t.orders.filter("o_orderstatus = 'F'"), 2), out, "parcel.raw", "county_tag")
    return files.table(t.spark, out, "parcel.raw").groupBy("county_tag", "load_no").agg(F.count(F.lit(1)).alias("n"))


@query("io09_wkt_rings", """
SELECT c_custkey AS geo_id, 1.5 * (1 + c_custkey % 7) AS area, 5 AS vertices FROM customer""", real="area", ints="vertices")
def io09(t):
    x, w = (F.col("c_custkey") % 100).cast("double"), (1 + F.col("c_custkey") % 7).cast("double")
    pt = lambda px, py: F.struct(px.alias("x"), py.alias("y"))
    zero = F.lit(0.0)
    ring = F.array(pt(x, zero), pt(x + w, zero), pt(x + w, F.lit(1.5)), pt(x, F.lit(1.5)), pt(x, zero))
    wkt = t.customer.select(F.col("c_custkey").alias("geo_id"), wkt_from_ring(ring).alias("wkt"))
    back = wkt.withColumn("ring", ring_from_wkt("wkt"))
    return back.select("geo_id", ring_area("ring").alias("area"), F.size("ring").alias("vertices"))


@query("io09_wkb_parts", """
SELECT c_custkey AS geo_id, 1 + c_custkey % 2 AS parts, 2 + c_custkey % 2 AS rings, 4.0 * (1 + c_custkey % 7) - 0.25 + (c_custkey % 2) * (1 + c_custkey % 7) AS area FROM customer""",
       real="area", ints="parts rings")
def io09_wkb(t):
    """Polygons with a hole, every other one with a second part, written to binary and read back."""
    x, w = (F.col("c_custkey") % 100).cast("double"), (1 + F.col("c_custkey") % 7).cast("double")
    pt = lambda px, py: F.struct(px.alias("x"), py.alias("y"))
    box = lambda x0, y0, x1, y1: F.array(pt(x0, y0), pt(x1, y0), pt(x1, y1), pt(x0, y1), pt(x0, y0))
    first = F.array(box(x, F.lit(0.0), x + w, F.lit(4.0)), box(x + 0.25, F.lit(1.0), x + 0.5, F.lit(2.0)))
    second = F.array(box(x, F.lit(10.0), x + 1, w + 10))
    shapes = spread(t.customer.select("c_custkey"), "c_custkey").select(F.col("c_custkey").alias("geo_id"), F.when(F.col("c_custkey") % 2 == 1, F.array(first, second)).otherwise(F.array(first)).alias("parts"))
    back = shapes.select("geo_id", wkb_from_parts("parts").alias("wkb")).select("geo_id", parts_from_wkb("wkb").alias("p"))
    return back.select("geo_id", F.size("p").alias("parts"), F.size(F.flatten("p")).alias("rings"), parts_area("p").alias("area"))


@query("io10_inline_dimension", """
SELECT d.label, count(*) AS n FROM orders JOIN (VALUES ('1-URGENT', 'fast'), ('2-HIGH', 'fast'), ('3-MEDIUM', 'normal'),
  ('4-NOT SPECIFIED', 'normal'), ('5-LOW', 'slow')) AS d(code, label) ON o_orderpriority = d.code GROUP BY ALL""")
def io10(t):
    dim = files.dim_from_rows(t.spark, [("1-URGENT", "fast"), ("2-HIGH", "fast"), ("3-MEDIUM", "normal"),
                                        ("4-NOT SPECIFIED", "normal"), ("5-LOW", "slow")], "code string, label string")
    return t.orders.join(dim, F.col("o_orderpriority") == F.col("code")).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query("io11_parameterised_query", "SELECT o_orderpriority, count(*) AS n FROM orders WHERE year(o_orderdate) = 1998 GROUP BY ALL")
def io11(t):
    return t.spark.sql("SELECT o_orderpriority, count(*) AS n FROM {orders} WHERE year(o_orderdate) = :target_year GROUP BY o_orderpriority",
                       args={"target_year": 1998}, orders=t.orders)


@query("io12_build_metadata", """
SELECT r_regionkey AS region_key, count(*) AS n, 'supplier + nation' AS build_source, '2024-01-01T00:00:00Z' AS run_timestamp
FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL""", ints="region_key")
def io12(t):
    df = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).groupBy(F.col("n_regionkey").alias("region_key")).agg(
        F.count(F.lit(1)).alias("n"))
    return files.with_build_metadata(df, build_source="supplier + nation", run_timestamp="2024-01-01T00:00:00Z")
