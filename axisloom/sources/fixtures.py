"""Interval views of the TPC-H-like tables, as SQL that Spark and DuckDB both read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_CONTIGS = "(select 0 as c union all select 1 union all select 2 union all select 3 union all select 4)"

VIEWS = {
    "fx_segments": """select l_returnflag as track, concat('chr', cast(l_suppkey % 5 as string)) as contig,
        l_orderkey*40 + l_linenumber*5 as s, l_orderkey*40 + l_linenumber*5 + cast(l_quantity as bigint) as e from lineitem""",
    "fx_annotations": """select o_orderpriority as track, concat('chr', cast(o_custkey % 5 as string)) as contig,
        o_orderkey*40 as s, o_orderkey*40 + 20 + cast(floor(o_totalprice) as bigint) % 100 as e from orders""",
    "fx_workspace": f"""select 'ws1' as track, concat('chr', cast(k.c as string)) as contig,
        p_partkey*300 as s, p_partkey*300 + 240 + p_size as e from part cross join {_CONTIGS} k""",
    "fx_workspace2": f"""select 'ws2' as track, concat('chr', cast(k.c as string)) as contig,
        p_partkey*300 + p_size as s, p_partkey*300 + 300 as e from part cross join {_CONTIGS} k where k.c < 4""",
    "fx_isochores": f"""select case when p_size <= 25 then 'low' else 'high' end as track, concat('chr', cast(k.c as string)) as contig,
        p_partkey*300 as s, p_partkey*300 + 300 as e from part cross join {_CONTIGS} k""",
    "fx_points": "select event_type as track, concat('chr', cast(user_id % 5 as string)) as contig, event_id*60 as pos from events",
    "fx_genes": """select concat('gene', cast(p_partkey as string)) as track, concat('chr', cast(p_partkey % 5 as string)) as contig,
        p_partkey*300 + 50 as s, p_partkey*300 + 150 as e from part""",
    "fx_gene_terms": """select concat('gene', cast(p_partkey as string)) as gene_id, p_brand as term from part
        union all select concat('gene', cast(p_partkey as string)), p_type from part""",
}


class Fixtures:
    """The views of one data directory, as canonical DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def view(self, name: str) -> DataFrame:
        table = VIEWS[name].split(" from ")[-1].split()[0] if name != "fx_gene_terms" else "part"
        table = "part" if "from part" in VIEWS[name] else table
        sql = VIEWS[name].replace(f"from {table}", "from {t}")
        df = self.spark.sql(sql, t=self.table(table))
        if "s" in df.columns:
            df = df.withColumnsRenamed({"s": "start", "e": "end"})
            df = df.withColumn("start", df["start"].cast("long")).withColumn("end", df["end"].cast("long"))
        elif "pos" in df.columns:
            df = df.withColumn("pos", df["pos"].cast("long"))
        return df

    @property
    def segments(self) -> DataFrame:
        return self.view("fx_segments")

    @property
    def annotations(self) -> DataFrame:
        return self.view("fx_annotations")

    @property
    def workspace(self) -> DataFrame:
        return self.view("fx_workspace")

    @property
    def workspaces(self) -> DataFrame:
        return self.view("fx_workspace").unionByName(self.view("fx_workspace2"))

    @property
    def isochores(self) -> DataFrame:
        return self.view("fx_isochores")

    @property
    def points(self) -> DataFrame:
        return self.view("fx_points")

    @property
    def genes(self) -> DataFrame:
        return self.view("fx_genes")

    @property
    def gene_terms(self) -> DataFrame:
        return self.view("fx_gene_terms")
