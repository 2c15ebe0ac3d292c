"""The pipeline's inputs, derived from general tables.

Prose stands in for sequence, line items for homology hits, suppliers for isolates and the
region / nation / supplier hierarchy for a tree.  Every view reads its whole tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cladeflow.sources.tables import read_table

# Letters to bases, digits to the ambiguous base.
LETTERS = "abcdefghijklmnopqrstuvwxyz0123456789"
BASES = "ACGTACGTACGTACGTACGTACGTACNNNNNNNNNN"
# A line item is a hit of identity quantity / 50; these are the thresholds of a gene and of a replicon.
GENE_HIT = "l_quantity / 50 >= 0.90"
REPLICON_HIT = "l_quantity / 50 >= 0.96"
GENE = "concat_ws('|', p_brand, p_type, p_partkey)"


class Views:
    """Named inputs of one data folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        return read_table(self.spark, f"{self.folder}/{name}.parquet")

    def queries(self, table: str = "documents", key: str = "doc_id") -> DataFrame:
        return self.table(table).select(F.col(key).alias("query_id"), F.col("text").alias("seq"))

    def turns(self) -> DataFrame:
        key = F.concat_ws(":", "conv_id", "turn")
        return self.table("conversations").select(key.alias("query_id"), F.col("text").alias("seq"))

    def references(self) -> DataFrame:
        return self.table("benchmark").select(F.col("item_id").alias("ref_id"), F.col("text").alias("seq"))

    @staticmethod
    def nucleotides(rows: DataFrame) -> DataFrame:
        """Rows with their letters as bases."""
        return rows.withColumn("seq", F.translate(F.regexp_replace(F.lower("seq"), "[^a-z0-9]", ""), LETTERS, BASES))

    def contigs(self, strain: str = "concat_ws('|', source, lang)") -> DataFrame:
        """Nucleotide contigs: one per document, one strain per source (and language)."""
        letters = F.regexp_replace(F.lower("text"), "[^a-z0-9]", "")
        return self.table("documents").select(
            F.expr(strain).alias("strain"), F.col("doc_id").cast("string").alias("contig"),
            F.translate(letters, LETTERS, BASES).alias("seq"))

    def contig_hosts(self) -> DataFrame:
        return self.table("documents").select(
            F.concat_ws("|", "source", "lang").alias("strain"), F.col("lang").alias("host_group")).distinct()

    def tokens(self) -> DataFrame:
        """One row per word occurrence: ``(family, strain, doc_id)``."""
        words = F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))
        return self.table("documents").select(F.explode(words).alias("family"), F.col("source").alias("strain"), "doc_id")

    def event_genes(self) -> DataFrame:
        """Family = (k, hour), genome = event type."""
        k = F.get_json_object("props", "$.k")
        hour = F.hour("ts").cast("string")
        return self.table("events").select(F.concat_ws("|", k, hour).alias("family"), F.col("event_type").alias("strain"))

    def _lines(self, condition: str) -> DataFrame:
        part = self.table("part").select(F.col("p_partkey").alias("l_partkey"), "p_brand", "p_type", F.expr(GENE).alias("gene"))
        return self.table("lineitem").filter(condition).select("l_partkey", "l_suppkey").join(part, "l_partkey")

    @staticmethod
    def _strain(column: str = "l_suppkey"):
        return F.concat(F.lit("s"), F.col(column).cast("string"))

    def presence(self) -> DataFrame:
        """Distinct (gene, strain): parts an isolate carries a passing hit of."""
        return self._lines(GENE_HIT).select("gene", self._strain().alias("strain")).distinct()

    def replicons(self) -> DataFrame:
        return self._lines(REPLICON_HIT).select(self._strain().alias("strain"), F.col("p_type").alias("replicon")).distinct()

    def placed_suppliers(self) -> DataFrame:
        nation = self.table("nation").withColumnRenamed("n_nationkey", "s_nationkey")
        region = self.table("region").withColumnRenamed("r_regionkey", "n_regionkey")
        return self.table("supplier").join(nation, "s_nationkey").join(region, "n_regionkey")

    def hosts(self) -> DataFrame:
        return self.placed_suppliers().select(self._strain("s_suppkey").alias("strain"), F.col("r_name").alias("host_group"))

    def metadata(self) -> DataFrame:
        return self.placed_suppliers().select(
            self._strain("s_suppkey").alias("strain"), F.col("r_name").alias("host_group"),
            F.when(F.col("s_acctbal") > 0, F.col("n_name")).alias("serovar"), F.col("s_name").alias("country"))

    def tree_edges(self) -> DataFrame:
        """Root, regions, nations, suppliers; branches without a supplier are left out."""
        s = self.placed_suppliers().select(
            self._strain("s_suppkey").alias("s"), F.concat(F.lit("n"), F.col("s_nationkey").cast("string")).alias("n"),
            F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("r"))
        one = F.lit(1.0).alias("length")
        return (s.select(F.col("s").alias("node"), F.col("n").alias("parent"), one)
                .unionByName(s.select(F.col("n").alias("node"), F.col("r").alias("parent"), one).distinct())
                .unionByName(s.select(F.col("r").alias("node"), F.lit("root").alias("parent"), one).distinct())
                .unionByName(s.select(F.lit("root").alias("node"), F.lit(None).cast("string").alias("parent"),
                                      F.lit(0.0).alias("length")).distinct()))

    def alignment(self, taxon: str) -> DataFrame:
        """``(taxon, family, month, residue)``: smallest return flag per taxon, part and calendar month."""
        where = self.placed_suppliers().select(F.col("s_suppkey").alias("l_suppkey"), F.col(taxon).alias("taxon"))
        return (self.table("lineitem").select("l_suppkey", "l_partkey", "l_shipdate", "l_returnflag").join(where, "l_suppkey")
                .groupBy("taxon", F.col("l_partkey").alias("family"), F.month("l_shipdate").alias("month"))
                .agg(F.min("l_returnflag").alias("residue")))

    def sites(self, taxon: str = "n_name") -> DataFrame:
        return self.alignment(taxon).select(
            "taxon", (F.col("family") * 12 + F.col("month") - 1).alias("site"), "residue")

    def blocks(self, taxon: str = "r_name") -> DataFrame:
        """Family alignments of twelve columns: ``(family, strain, aligned)``."""
        by_month = F.map_from_entries(F.collect_list(F.struct("month", "residue")))
        text = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(12)), lambda m: F.coalesce(
            F.try_element_at(F.col("months"), m), F.lit("-"))), "")
        return (self.alignment(taxon).groupBy("family", F.col("taxon").alias("strain")).agg(by_month.alias("months"))
                .select("family", "strain", F.rtrim(text, F.lit("-")).alias("aligned")))

    def labelled(self, label: str = "toxic") -> tuple[DataFrame, DataFrame]:
        """Domains = words of labelled documents, families = the documents, class by label."""
        labels = self.table("labels").select(
            F.col("doc_id").alias("family"), F.when(F.col(label) == 1, "accessory").otherwise("core").alias("class"))
        words = self.tokens().select(F.col("family").alias("pfam"), F.col("doc_id").alias("family"))
        domains = words.distinct().join(labels.select("family"), "family", "left_semi").withColumn(
            "description", F.upper("pfam"))
        return domains, labels
