"""Measurement tables derived from the driver's test tables (FIXTURES.md §2).

The same views exist twice: as Spark DataFrames (what the library runs on) and as DuckDB
SQL text (the oracle side, put in front of each oracle query as CTEs). Nothing is rounded
and every integer-to-string cast is plain, so both engines see bit-identical inputs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema as S


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def npx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense sample x assay table (FIXTURES §2.1), from ``embeddings``.

    Written as SQL expressions (parsed once on the JVM side) -- the view has ~20 derived
    columns, and building them call by call from Python costs more than the job itself.
    """
    e = _table(spark, sf_dir, "embeddings").selectExpr("vec_id", "label", "posexplode(embedding) as (pos, v)")
    b = e.selectExpr(
        "vec_id",
        "label",
        "pos",
        "(1 + pos % 8) * cast(v as double) as x",
        "cast(vec_id % 4 as int) as p",
        "cast(floor(vec_id / 4.0) as bigint) as w",
        "cast(floor(pos / 8.0) as int) + 1 as blk",
    )
    q = b.selectExpr(
        "*",
        """case when pos % 32 = 11 then 'NA' when (vec_id * 31 + blk) % 97 = 0 then 'FAIL'
                when (vec_id * 31 + blk) % 89 = 0 then 'WARN' when (vec_id * 31 + blk) % 83 = 0 then null
                else 'PASS' end as sqc""",
    )
    return q.selectExpr(
        "concat('S', lpad(cast(vec_id as string), 6, '0')) as sample_id",
        """case w % 24 when 0 then 'PLATE_CONTROL' when 1 then 'NEGATIVE_CONTROL' when 2 then 'SAMPLE_CONTROL'
                else 'SAMPLE' end as sample_type""",
        """concat(substring('ABCDEFGH', cast(w % 8 as int) + 1, 1),
                  cast(cast(floor((w % 96) / 8.0) as int) + 1 as string)) as well_id""",
        "concat('PLATE_', cast(p + 1 as string)) as plate_id",
        "concat('D', cast(blk as string), '0007') as data_analysis_ref_id",
        "case when pos = 3 then 'BAD3' else concat('OID', cast(10000 + pos as string)) end as assay_id",
        """case when pos = 8 then null
                else concat('P', cast(case when pos = 5 and vec_id % 2 = 1 then 99999 else 10000 + pos end as string))
                end as uniprot""",
        "concat('GENE', cast(pos as string)) as assay",
        "case when pos % 8 = 7 then 'ext_ctrl' else 'assay' end as assay_type",
        "case when pos < 32 then 'Explore_HT' else 'Explore_HT_2' end as panel",
        "cast(blk as string) as block",
        "cast(floor(abs(x) * 1000) as bigint) + 1 as read_count",
        "x as ext_npx",
        "case when sqc in ('FAIL', 'NA') then null else x end as npx",
        "case when pos % 32 = 11 or pos % 8 = 7 then 'NA' when pos = 20 then 'WARN' else 'PASS' end as assay_qc",
        "sqc as sample_qc",
        "case when pos = 9 then null else (1 + pos % 8) * (-0.15D + cast(pos as double) * 0.003D) end as lod",
        "concat('SUB', cast(cast(floor(w / 2.0) as bigint) as string)) as subsample_id",
        "label",
    )


def npx_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sparse, larger table with duplicate (sample, assay) pairs (FIXTURES §2.2)."""
    li = _table(spark, sf_dir, "lineitem").select(
        "l_suppkey", "l_linenumber", "l_partkey", "l_returnflag", "l_quantity", "l_extendedprice"
    )
    part = _table(spark, sf_dir, "part").select("p_partkey", "p_type", "p_retailprice")
    return li.join(part, li.l_partkey == part.p_partkey).selectExpr(
        "concat('S', lpad(cast(l_suppkey % 60 as string), 6, '0')) as sample_id",
        "concat('PLATE_', cast(l_linenumber % 4 + 1 as string)) as plate_id",
        "concat('OID', lpad(cast(10000 + l_partkey as string), 5, '0')) as assay_id",
        "p_type as block",
        "'assay' as assay_type",
        "'SAMPLE' as sample_type",
        "concat('SUB', cast(l_suppkey % 6 as string)) as subsample_id",
        """case when l_returnflag = 'R' and l_quantity < 5 then null
                else ln(l_extendedprice / p_retailprice) / ln(2.0D) end as npx""",
    )


def manifest(npx_df: DataFrame) -> DataFrame:
    """Sample manifest of the biological samples (FIXTURES §2.3)."""
    return (
        npx_df.where(F.col(S.SAMPLE_TYPE) == S.SAMPLE)
        .selectExpr(
            "sample_id as olink_sample_id",
            "case when label < 7 then 'PRJ_A' else 'PRJ_B' end as project",
            "plate_id",
            "concat('SUBJ', cast(label as string)) as subj_id",
            "subsample_id",
        )
        .distinct()
    )


def subjects(npx_df: DataFrame) -> DataFrame:
    """Subject sheet; label 9 is left out so joins drop rows (FIXTURES §2.3)."""
    return (
        npx_df.where(F.col("label") != 9)
        .selectExpr(
            "concat('SUBJ', cast(label as string)) as subj_id",
            "case label % 3 when 0 then 'case' when 1 then 'control' else 'pool' end as subj_type",
            "case label % 2 when 0 then 'F' else 'M' end as sex",
            "'plasma' as tissue_type",
        )
        .distinct()
    )


def fixed_lod(npx_df: DataFrame) -> DataFrame:
    """Fixed LOD table keyed by (assay, data-analysis reference id)."""
    return (
        npx_df.where(F.col(S.LOD).isNotNull())
        .select(S.ASSAY_ID, S.DAR_ID, F.col(S.LOD).alias(S.PC_LOD))
        .distinct()
    )


def lot_factor(npx_df: DataFrame) -> DataFrame:
    """Plate-control lot factor per assay."""
    return npx_df.groupBy(S.ASSAY_ID).agg(
        (F.countDistinct(S.UNIPROT).cast("double") * F.lit(0.25)).alias("pc_lot_factor")
    )


def vendor_cv(npx_df: DataFrame) -> DataFrame:
    """Vendor intra-plate CV for the assays of blocks 1 and 2; two assays moved by +-0.5."""
    from ..functions.columns import lognormal_cv

    a = F.col(S.ASSAY_ID)
    return (
        npx_df.where((F.col(S.SAMPLE_TYPE) == S.SAMPLE_CONTROL) & F.col(S.BLOCK).isin("1", "2"))
        .groupBy(S.ASSAY_ID, S.PLATE_ID)
        .agg(
            (
                lognormal_cv(F.stddev_samp(S.NPX))
                + F.when(a == "OID10002", F.lit(-0.5)).when(a == "OID10004", F.lit(0.5)).otherwise(F.lit(0.0))
            ).alias(S.VENDOR_INTRA_CV)
        )
    )


def vendor_inter_cv(npx_df: DataFrame) -> DataFrame:
    """Vendor inter-plate CV for the assays of blocks 2 and 3."""
    from ..functions.columns import lognormal_cv

    plates = (
        npx_df.where((F.col(S.SAMPLE_TYPE) == S.SAMPLE_CONTROL) & F.col(S.BLOCK).isin("2", "3"))
        .groupBy(S.ASSAY_ID, S.PLATE_ID)
        .agg(F.avg(S.NPX).alias("_mean"))
    )
    return plates.groupBy(S.ASSAY_ID).agg(lognormal_cv(F.stddev_samp("_mean")).alias(S.VENDOR_INTER_CV))


# ---------------------------------------------------------------------------
# DuckDB text of the same views (oracle side).
# ---------------------------------------------------------------------------
DUCKDB_VIEWS = {
    "npx": """
with e as (select vec_id, label, unnest(range(len(embedding))) as pos, unnest(embedding) as v from embeddings),
b as (select vec_id, label, pos, (1+pos%8)*cast(v as double) as x, cast(vec_id % 4 as int) as p,
             cast(floor(vec_id/4.0) as bigint) as w, cast(floor(pos/8.0) as int)+1 as blk from e),
q as (select *, case when pos%32=11 then 'NA' when (vec_id*31+blk)%97=0 then 'FAIL'
                     when (vec_id*31+blk)%89=0 then 'WARN' when (vec_id*31+blk)%83=0 then null
                     else 'PASS' end as sqc from b)
select concat('S', lpad(cast(vec_id as varchar(9)),6,'0')) as sample_id,
  case w%24 when 0 then 'PLATE_CONTROL' when 1 then 'NEGATIVE_CONTROL' when 2 then 'SAMPLE_CONTROL' else 'SAMPLE' end as sample_type,
  concat(substring('ABCDEFGH', cast(w%8 as int)+1, 1), cast(cast(floor((w%96)/8.0) as int)+1 as varchar(9))) as well_id,
  concat('PLATE_', cast(p+1 as varchar(9))) as plate_id,
  concat('D', cast(blk as varchar(9)), '0007') as data_analysis_ref_id,
  case when pos=3 then 'BAD3' else concat('OID', cast(10000+pos as varchar(9))) end as assay_id,
  case when pos=8 then null else concat('P', cast(case when pos=5 and vec_id%2=1 then 99999 else 10000+pos end as varchar(9))) end as uniprot,
  concat('GENE', cast(pos as varchar(9))) as assay,
  case when pos%8=7 then 'ext_ctrl' else 'assay' end as assay_type,
  case when pos < 32 then 'Explore_HT' else 'Explore_HT_2' end as panel, cast(blk as varchar(9)) as block,
  cast(floor(abs(x)*1000) as bigint)+1 as read_count,
  x as ext_npx, case when sqc in ('FAIL','NA') then null else x end as npx,
  case when pos%32=11 or pos%8=7 then 'NA' when pos=20 then 'WARN' else 'PASS' end as assay_qc, sqc as sample_qc,
  case when pos=9 then null else (1+pos%8)*(-0.15+cast(pos as double)*0.003) end as lod,
  concat('SUB', cast(cast(floor(w/2.0) as bigint) as varchar(9))) as subsample_id, label
from q""",
    "npx_long": """
select concat('S', lpad(cast(l_suppkey % 60 as varchar(9)),6,'0')) as sample_id,
  concat('PLATE_', cast(l_linenumber % 4 + 1 as varchar(9))) as plate_id,
  concat('OID', lpad(cast(10000+l_partkey as varchar(9)),5,'0')) as assay_id,
  p_type as block, 'assay' as assay_type, 'SAMPLE' as sample_type,
  concat('SUB', cast(l_suppkey % 6 as varchar(9))) as subsample_id,
  case when l_returnflag='R' and l_quantity<5 then null else ln(l_extendedprice/p_retailprice)/ln(cast(2 as double)) end as npx
from lineitem join part on l_partkey=p_partkey""",
    "manifest": """
select distinct sample_id as olink_sample_id, case when label<7 then 'PRJ_A' else 'PRJ_B' end as project,
  plate_id, concat('SUBJ', cast(label as varchar(9))) as subj_id, subsample_id
from npx where sample_type='SAMPLE'""",
    "subjects": """
select distinct concat('SUBJ', cast(label as varchar(9))) as subj_id,
  case label%3 when 0 then 'case' when 1 then 'control' else 'pool' end as subj_type,
  case label%2 when 0 then 'F' else 'M' end as sex, 'plasma' as tissue_type
from npx where label<>9""",
    "fixed_lod": """
select distinct assay_id, data_analysis_ref_id, lod as pc_lod from npx where lod is not null""",
    "lot_factor": """
select assay_id, cast(count(distinct uniprot) as double)*0.25 as pc_lot_factor from npx group by assay_id""",
    "vendor_cv": """
select assay_id, plate_id,
  100*sqrt(exp(power(ln(cast(2 as double))*stddev_samp(npx),2))-1)
    + case when assay_id='OID10002' then -0.5 when assay_id='OID10004' then 0.5 else 0 end as vendor_intra_cv
from npx where sample_type='SAMPLE_CONTROL' and block in ('1','2') group by assay_id, plate_id""",
    "vendor_inter_cv": """
select assay_id, 100*sqrt(exp(power(ln(cast(2 as double))*stddev_samp(m),2))-1) as vendor_inter_cv
from (select assay_id, avg(npx) as m from npx where sample_type='SAMPLE_CONTROL' and block in ('2','3') group by assay_id, plate_id)
group by assay_id""",
}

# Views each view reads (so a query only carries the CTEs it needs, in a valid order).
_DEPENDS = {
    "npx": [],
    "npx_long": [],
    "manifest": ["npx"],
    "subjects": ["npx"],
    "fixed_lod": ["npx"],
    "lot_factor": ["npx"],
    "vendor_cv": ["npx"],
    "vendor_inter_cv": ["npx"],
}


def duckdb_with(*views: str) -> str:
    """``WITH`` clause defining the named fixture views (and what they read) for DuckDB."""
    order: list[str] = []

    def add(v: str) -> None:
        for d in _DEPENDS[v]:
            add(d)
        if v not in order:
            order.append(v)

    for v in views:
        add(v)
    return "with " + ",\n".join(f"{v} as ({DUCKDB_VIEWS[v]}\n)" for v in order) + "\n"
