"""Plain tables as a vault: notes, links and typed fields made from a star schema."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def star_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """files(path, title): a note per region, nation, supplier and customer."""
    kinds = (("region", "regions", "r_name"), ("nation", "nations", "n_name"), ("supplier", "suppliers", "s_name"), ("customer", "customers", "c_name"))
    parts = [table(spark, sf_dir, t).select(F.concat(F.lit(d + "/"), F.col(c), F.lit(".md")).alias("path"), F.col(c).alias("title")) for t, d, c in kinds]
    return reduce(DataFrame.unionByName, parts)


def star_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """triples(subject, relation, object, source_file): typed and bare links, links by path, literals and a link of a note to itself."""
    region, nation = table(spark, sf_dir, "region"), table(spark, sf_dir, "nation")
    supplier, customer = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "customer")
    nr = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    sn = supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    cn = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey"))

    def rows(df: DataFrame, subject: str, folder: str, relation: str, target) -> DataFrame:
        return df.select(F.col(subject).alias("subject"), F.lit(relation).alias("relation"), target.alias("object"), F.concat(F.lit(folder + "/"), F.col(subject), F.lit(".md")).alias("source_file"))

    return reduce(
        DataFrame.unionByName,
        (
            rows(nr, "n_name", "nations", "part_of", F.col("r_name")), rows(nr, "n_name", "nations", "links_to", F.col("r_name")), rows(sn, "s_name", "suppliers", "located_in", F.concat(F.lit("nations/"), F.col("n_name"))),
            rows(cn, "c_name", "customers", "lives_in", F.col("n_name")), rows(customer, "c_name", "customers", "segment", F.col("c_mktsegment")), rows(region, "r_name", "regions", "links_to", F.col("r_name")),
        ),
    )


#: The same two tables in SQL, as common table expressions.
STAR_SQL = """
files AS (
  SELECT 'regions/' || r_name || '.md' AS path, r_name AS title FROM region
  UNION ALL SELECT 'nations/' || n_name || '.md', n_name FROM nation
  UNION ALL SELECT 'suppliers/' || s_name || '.md', s_name FROM supplier
  UNION ALL SELECT 'customers/' || c_name || '.md', c_name FROM customer
), triples AS (
  SELECT n_name AS subject, 'part_of' AS relation, r_name AS object, 'nations/' || n_name || '.md' AS source_file FROM nation JOIN region ON n_regionkey = r_regionkey
  UNION ALL SELECT n_name, 'links_to', r_name, 'nations/' || n_name || '.md' FROM nation JOIN region ON n_regionkey = r_regionkey
  UNION ALL SELECT s_name, 'located_in', 'nations/' || n_name, 'suppliers/' || s_name || '.md' FROM supplier JOIN nation ON s_nationkey = n_nationkey
  UNION ALL SELECT c_name, 'lives_in', n_name, 'customers/' || c_name || '.md' FROM customer JOIN nation ON c_nationkey = n_nationkey
  UNION ALL SELECT c_name, 'segment', c_mktsegment, 'customers/' || c_name || '.md' FROM customer
  UNION ALL SELECT r_name, 'links_to', r_name, 'regions/' || r_name || '.md' FROM region
)"""
