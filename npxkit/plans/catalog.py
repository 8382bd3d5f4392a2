"""Registered queries: each one a Spark job over the test tables, paired with oracle SQL.

Every query reads the driver's tables through the fixture views (``sources.fixtures``) and
runs one operator (or one chain of operators, as the reference's documents do) over the
whole view. ``ORACLE`` holds the same computation in DuckDB SQL, written independently of
the Spark code, with the fixture views as CTEs in front.

Derived doubles are rounded to 6 decimals on both sides (floating sums depend on the order
of addition); values passed through from the input are not rounded.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema as S
from ..operators import charts, components, cv, lod, manifest, matrix, neighbours, normalize, qc, sheet
from ..session import materialize
from ..sources import fixtures as fx
from ..sources.fixtures import duckdb_with as W

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return deco


def r6(df: DataFrame, *cols: str) -> DataFrame:
    """Round the named double columns to 6 decimals."""
    return df.withColumns({c: F.round(F.col(c), 6) for c in cols})


# ---------------------------------------------------------------------------
# Shared chains
# ---------------------------------------------------------------------------
def _full_sheet(spark: SparkSession, sf: str, npx_df: DataFrame | None = None) -> DataFrame:
    d = npx_df if npx_df is not None else fx.npx(spark, sf)
    return manifest.full_sample_sheet(sheet.sample_sheet(d), fx.manifest(d), fx.subjects(d))


def _replicate_cv(spark: SparkSession, sf: str, drop_below_lod: bool) -> DataFrame:
    d = fx.npx(spark, sf)
    mapping = cv.replicate_map(_full_sheet(spark, sf, d), sheet.sample_sheet(d))
    return cv.replicate_intra_cv(d, mapping, drop_below_lod=drop_below_lod)


# DuckDB: the sample sheet, full sheet and replicate map as CTE text.
_SQL_SHEET_ONLY = """
sheet as (select distinct sample_id, sample_type, well_id as well, plate_id as plate,
                 concat('Column ', substring(well_id, 2, 2)) as "column", substring(well_id, 1, 1) as "row" from npx)"""

_SQL_SHEET = _SQL_SHEET_ONLY + """,
full_sheet as (select s.*, m.project, m.plate_id, m.subj_id, m.subsample_id, j.subj_type, j.sex, j.tissue_type
               from sheet s join manifest m on s.sample_id = m.olink_sample_id
               join subjects j on m.subj_id = j.subj_id)"""

_SQL_MAP = """
rmap as (select distinct sample_id, subsample_id from (
           select sample_id, subsample_id from full_sheet
           union all
           select sample_id, sample_type as subsample_id from sheet where sample_type like '%\\_CONTROL%' escape '\\'))"""


def cv_sql(sd: str) -> str:
    return f"100*sqrt(exp(power(ln(cast(2 as double))*({sd}),2))-1)"


def _sql_rcv(lod: bool, name: str = "rcv", src: str = "npx", mapping: str = "rmap") -> str:
    x = "case when npx >= lod then npx end" if lod else "npx"
    return f"""
{name} as (select assay_id, block, assay_type, plate_id, subsample_id,
               {cv_sql('stddev_samp(x)')} as intra_cv,
               count(*) as n_replicates
        from (select d.assay_id, d.block, d.assay_type, d.plate_id, m.subsample_id, {x} as x
              from {src} d join {mapping} m on d.sample_id = m.sample_id) t
        group by assay_id, block, assay_type, plate_id, subsample_id
        having count(x) > 1)"""


def _sql_median_cv(name: str = "mcv", src: str = "rcv") -> str:
    return f"""
{name} as (select assay_id, plate_id, sample_type, median(intra_cv) as intra_cv_median
        from (select *, case when subsample_id like '%\\_CONTROL%' escape '\\' then subsample_id else 'SAMPLE' end as sample_type
              from {src} where assay_type = 'assay') t
        group by assay_id, plate_id, sample_type)"""


def Q(views: list[str], body: str, *ctes: str) -> str:
    """DuckDB text: the fixture views, extra CTEs, then the final select."""
    w = W(*views).rstrip()
    return w + "".join("," + c for c in ctes) + "\n" + body


def _sql_cv_chain(lod: bool) -> str:
    return Q(["npx", "manifest", "subjects"], "", _SQL_SHEET, _SQL_MAP, _sql_rcv(lod), _sql_median_cv())


# ---------------------------------------------------------------------------
# Coefficients of variation
# ---------------------------------------------------------------------------
@register(
    "replicate_intra_cv",
    _sql_cv_chain(False)
    + "select assay_id, block, assay_type, plate_id, subsample_id, round(intra_cv, 6) as intra_cv, n_replicates from rcv",
)
def q_replicate_intra_cv(spark, sf):
    return r6(_replicate_cv(spark, sf, False), "intra_cv")


@register(
    "replicate_intra_cv_lod",
    _sql_cv_chain(True)
    + "select assay_id, block, assay_type, plate_id, subsample_id, round(intra_cv, 6) as intra_cv, n_replicates from rcv",
)
def q_replicate_intra_cv_lod(spark, sf):
    return r6(_replicate_cv(spark, sf, True), "intra_cv")


@register(
    "median_cv",
    _sql_cv_chain(False) + "select assay_id, plate_id, sample_type, round(intra_cv_median, 6) as intra_cv_median from mcv",
)
def q_median_cv(spark, sf):
    return r6(cv.median_cv(_replicate_cv(spark, sf, False)), "intra_cv_median")


@register(
    "median_cv_lod",
    _sql_cv_chain(True) + "select assay_id, plate_id, sample_type, round(intra_cv_median, 6) as intra_cv_median from mcv",
)
def q_median_cv_lod(spark, sf):
    return r6(cv.median_cv(_replicate_cv(spark, sf, True)), "intra_cv_median")


_SQL_QUARTILES = """
select plate_id, sample_type, count(*) as n,
       round(quantile_cont(intra_cv_median, 0.25), 6) as q1,
       round(quantile_cont(intra_cv_median, 0.5), 6) as q2,
       round(quantile_cont(intra_cv_median, 0.75), 6) as q3
from mcv group by plate_id, sample_type"""


@register("cv_quartiles", _sql_cv_chain(False) + _SQL_QUARTILES)
def q_cv_quartiles(spark, sf):
    return r6(cv.cv_quartiles(cv.median_cv(_replicate_cv(spark, sf, False))), "q1", "q2", "q3")


@register("cv_quartiles_lod", _sql_cv_chain(True) + _SQL_QUARTILES)
def q_cv_quartiles_lod(spark, sf):
    return r6(cv.cv_quartiles(cv.median_cv(_replicate_cv(spark, sf, True))), "q1", "q2", "q3")


def _sql_inter(lod: bool) -> str:
    x = "case when d.npx >= d.lod then d.npx end" if lod else "d.npx"
    return f"""select assay_id, block, assay_type, subsample_id, count(m) as n_plates,
       round({cv_sql('stddev_samp(m)')}, 6) as inter_cv
from (select d.assay_id, d.block, d.assay_type, d.plate_id, r.subsample_id, avg({x}) as m
      from npx d join rmap r on d.sample_id = r.sample_id
      group by d.assay_id, d.block, d.assay_type, d.plate_id, r.subsample_id) t
group by assay_id, block, assay_type, subsample_id having count(m) > 1"""


def _replicate_inter_cv(spark: SparkSession, sf: str, drop_below_lod: bool) -> DataFrame:
    d = fx.npx(spark, sf)
    mapping = cv.replicate_map(_full_sheet(spark, sf, d), sheet.sample_sheet(d))
    return r6(cv.replicate_inter_cv(d, mapping, drop_below_lod=drop_below_lod), "inter_cv")


@register("replicate_inter_cv", Q(["npx", "manifest", "subjects"], _sql_inter(False), _SQL_SHEET, _SQL_MAP))
def q_replicate_inter_cv(spark, sf):
    return _replicate_inter_cv(spark, sf, False)


@register("replicate_inter_cv_lod", Q(["npx", "manifest", "subjects"], _sql_inter(True), _SQL_SHEET, _SQL_MAP))
def q_replicate_inter_cv_lod(spark, sf):
    return _replicate_inter_cv(spark, sf, True)


@register(
    "replicate_intra_cv_long",
    Q(
        ["npx_long"],
        "select assay_id, block, assay_type, plate_id, subsample_id, round(intra_cv, 6) as intra_cv, n_replicates from rcv",
        """
lmap as (select distinct sample_id, subsample_id from (
           select sample_id, subsample_id from npx_long
           union all
           select sample_id, sample_type from npx_long where sample_type like '%\\_CONTROL%' escape '\\'))""",
        _sql_rcv(False, src="npx_long", mapping="lmap"),
    ),
)
def q_replicate_intra_cv_long(spark, sf):
    d = fx.npx_long(spark, sf)
    samples = d.select(S.SAMPLE_ID, S.SUBSAMPLE_ID)
    mapping = cv.replicate_map(samples, d.select(S.SAMPLE_ID, S.SAMPLE_TYPE))
    return r6(cv.replicate_intra_cv(d, mapping), "intra_cv")


_SQL_CI = f"""
ci as (select assay_id, plate_id, avg(npx) as npx_mean, {cv_sql('stddev_samp(npx)')} as intra_cv
       from npx where sample_type = 'SAMPLE_CONTROL' group by assay_id, plate_id),
ce as (select assay_id, {cv_sql('stddev_samp(npx_mean)')} as inter_cv,
              avg(npx_mean) / nullif(stddev_samp(npx_mean), 0) as mean_over_sd
       from ci group by assay_id)"""


@register(
    "control_intra_cv",
    Q(["npx"], "select assay_id, plate_id, round(npx_mean, 6) as npx_mean, round(intra_cv, 6) as intra_cv from ci", _SQL_CI),
)
def q_control_intra_cv(spark, sf):
    return r6(cv.control_intra_cv(fx.npx(spark, sf)), "npx_mean", "intra_cv")


@register(
    "control_inter_cv",
    Q(["npx"], "select assay_id, round(inter_cv, 6) as inter_cv, round(mean_over_sd, 6) as mean_over_sd from ce", _SQL_CI),
)
def q_control_inter_cv(spark, sf):
    return r6(cv.control_inter_cv(cv.control_intra_cv(fx.npx(spark, sf))), "inter_cv", "mean_over_sd")


@register(
    "attach_control_cv",
    Q(
        ["npx"],
        """select d.sample_id, d.assay_id, d.plate_id, round(ci.intra_cv, 6) as intra_cv, round(ce.inter_cv, 6) as inter_cv,
       round(ce.mean_over_sd, 6) as mean_over_sd
from npx d join ci on d.assay_id = ci.assay_id and d.plate_id = ci.plate_id join ce on d.assay_id = ce.assay_id""",
        _SQL_CI,
    ),
)
def q_attach_control_cv(spark, sf):
    a = cv.attach_control_cv(fx.npx(spark, sf))
    return r6(a.select(S.SAMPLE_ID, S.ASSAY_ID, S.PLATE_ID, "intra_cv", "inter_cv", "mean_over_sd"), "intra_cv", "inter_cv", "mean_over_sd")


@register(
    "replicate_map",
    Q(["npx", "manifest", "subjects"], "select sample_id, subsample_id from rmap", _SQL_SHEET, _SQL_MAP),
)
def q_replicate_map(spark, sf):
    d = fx.npx(spark, sf)
    return cv.replicate_map(_full_sheet(spark, sf, d), sheet.sample_sheet(d))


@register(
    "vendor_cv_coverage",
    Q(
        ["npx", "vendor_cv", "vendor_inter_cv"],
        """select plate_id, sample_id, count(v.vendor_intra_cv) as n_intra_cv, count(w.vendor_inter_cv) as n_inter_cv
from npx d left join vendor_cv v using (assay_id, plate_id) left join vendor_inter_cv w using (assay_id)
group by plate_id, sample_id""",
    ),
)
def q_vendor_cv_coverage(spark, sf):
    d = fx.npx(spark, sf)
    intra = d.join(fx.vendor_cv(d), [S.ASSAY_ID, S.PLATE_ID], "left")
    return cv.vendor_cv_coverage(intra.join(fx.vendor_inter_cv(d), S.ASSAY_ID, "left"))


@register(
    "reconcile_cv",
    Q(
        ["npx", "manifest", "subjects", "vendor_cv"],
        """select 'signed' as test, diff < 1e-5 as passed, count(*) as n from j group by 2
union all
select 'absolute' as test, abs(diff) < 1e-5 as passed, count(*) as n from j group by 2""",
        _SQL_SHEET,
        _SQL_MAP,
        _sql_rcv(False),
        """
ours as (select assay_id, plate_id, intra_cv as new_intra_cv from rcv where subsample_id = 'SAMPLE_CONTROL'),
vend as (select distinct assay_id, plate_id, vendor_intra_cv from npx d join vendor_cv v using (assay_id, plate_id)
         where vendor_intra_cv is not null),
j as (select new_intra_cv - vendor_intra_cv as diff from ours join vend using (assay_id, plate_id))""",
    ),
)
def q_reconcile_cv(spark, sf):
    d = fx.npx(spark, sf)
    with_vendor = d.join(fx.vendor_cv(d), [S.ASSAY_ID, S.PLATE_ID], "left")
    return cv.reconcile_cv(_replicate_cv(spark, sf, False), with_vendor)


_DILUTION_SQL = "dil as (select * from (values " + ", ".join(
    f"('{b}', '{d}')" for b, d in S.BLOCK_DILUTION.items()
) + ") t(block, dilution))"


@register(
    "cv_by_block",
    Q(
        ["npx"],
        """select a.block, a.n_assays, round(a.intra_cv_mean, 6) as intra_cv_mean, round(b.inter_cv_mean, 6) as inter_cv_mean,
       dil.dilution
from a left join b using (block) left join dil using (block)""",
        f"""
ci as (select assay_id, plate_id, avg(npx) as npx_mean, {cv_sql('stddev_samp(npx)')} as intra_cv
       from npx where sample_type = 'SAMPLE_CONTROL' and assay_type = 'assay' group by assay_id, plate_id),
ce as (select assay_id, {cv_sql('stddev_samp(npx_mean)')} as inter_cv from ci group by assay_id),
bl as (select distinct assay_id, block from npx where assay_type = 'assay'),
a as (select block, count(distinct assay_id) as n_assays, avg(intra_cv) as intra_cv_mean
      from ci join bl using (assay_id) where intra_cv is not null group by block),
b as (select block, avg(inter_cv) as inter_cv_mean from ce join bl using (assay_id) group by block),
{_DILUTION_SQL}""",
    ),
)
def q_cv_by_block(spark, sf):
    return r6(cv.cv_by_block(fx.npx(spark, sf)), "intra_cv_mean", "inter_cv_mean")


@register(
    "median_cv_overall",
    Q(
        ["npx", "manifest", "subjects"],
        """select round((select median(intra_cv_median) from mcv where sample_type = 'SAMPLE'), 6) as median_cv_all,
       round((select median(intra_cv_median) from mcv_lod where sample_type = 'SAMPLE'), 6) as median_cv_lod""",
        _SQL_SHEET,
        _SQL_MAP,
        _sql_rcv(False),
        _sql_median_cv(),
        _sql_rcv(True, name="rcv_lod"),
        _sql_median_cv("mcv_lod", "rcv_lod"),
    ),
)
def q_median_cv_overall(spark, sf):
    d = fx.npx(spark, sf)
    mapping = cv.replicate_map(_full_sheet(spark, sf, d), sheet.sample_sheet(d))
    return r6(cv.median_cv_panel(d, mapping), "median_cv_all", "median_cv_lod")


# ---------------------------------------------------------------------------
# Shape, sheet, layout, manifest
# ---------------------------------------------------------------------------
@register("npx_shape", Q(["npx"], "select count(*) as n_rows, 19 as n_cols from npx"))
def q_npx_shape(spark, sf):
    return sheet.shape(fx.npx(spark, sf))


@register("npx_preview", Q(["npx"], "select * from npx order by sample_id, assay_id limit 6"))
def q_npx_preview(spark, sf):
    return sheet.preview(fx.npx(spark, sf), 6)


@register("sample_sheet", Q(["npx"], "select * from sheet", _SQL_SHEET_ONLY))
def q_sample_sheet(spark, sf):
    return sheet.sample_sheet(fx.npx(spark, sf))


@register(
    "plate_layout",
    Q(
        ["npx"],
        "select plate, \"row\", "
        + ", ".join(f"min(sample_type) filter (where \"column\" = 'Column {c}') as col_{c}" for c in S.PLATE_COLUMNS)
        + ' from sheet group by plate, "row"',
        _SQL_SHEET_ONLY,
    ),
)
def q_plate_layout(spark, sf):
    return sheet.plate_layout(sheet.sample_sheet(fx.npx(spark, sf)), columns=list(S.PLATE_COLUMNS))


@register("project_counts", Q(["npx", "manifest"], "select project, count(*) as n from manifest group by project"))
def q_project_counts(spark, sf):
    return manifest.project_counts(fx.manifest(fx.npx(spark, sf)))


@register("full_sample_sheet", Q(["npx", "manifest", "subjects"], "select * from full_sheet", _SQL_SHEET))
def q_full_sample_sheet(spark, sf):
    return _full_sheet(spark, sf)


@register(
    "restrict_samples",
    Q(
        ["npx", "manifest", "subjects"],
        "select sample_id, assay_id, plate_id, npx from npx where sample_id in (select sample_id from full_sheet)",
        _SQL_SHEET,
    ),
)
def q_restrict_samples(spark, sf):
    d = fx.npx(spark, sf)
    return manifest.restrict_samples(d, _full_sheet(spark, sf, d)).select(S.SAMPLE_ID, S.ASSAY_ID, S.PLATE_ID, S.NPX)


# ---------------------------------------------------------------------------
# Integrity and QC
# ---------------------------------------------------------------------------
@register(
    "duplicate_samples",
    Q(
        ["npx_long"],
        "select distinct sample_id from (select sample_id, assay_id from npx_long group by sample_id, assay_id having count(*) > 1) t",
    ),
)
def q_duplicate_samples(spark, sf):
    return qc.duplicate_samples(fx.npx_long(spark, sf))


@register(
    "bad_assay_ids",
    Q(["npx"], "select distinct assay_id from npx where not coalesce(regexp_matches(assay_id, 'OID[0-9]{5}'), false)"),
)
def q_bad_assay_ids(spark, sf):
    return qc.non_conforming_assay_ids(fx.npx(spark, sf))


@register(
    "uniprot_mismatches",
    Q(
        ["npx"],
        """select assay_id, count(*) as n_uniprot, count(*) - 1 as extra
from (select distinct assay_id, uniprot from npx) t group by assay_id having count(*) > 1""",
    ),
)
def q_uniprot_mismatches(spark, sf):
    return qc.uniprot_mismatches(fx.npx(spark, sf))


@register(
    "all_missing_samples",
    Q(["npx"], "select sample_id, count(*) as n_rows from npx group by sample_id having count(npx) = 0"),
)
def q_all_missing_samples(spark, sf):
    return qc.all_missing_samples(fx.npx(spark, sf))


@register(
    "all_missing_samples_block",
    Q(["npx"], "select sample_id, count(*) as n_rows from npx where block = '1' group by sample_id having count(npx) = 0"),
)
def q_all_missing_samples_block(spark, sf):
    return qc.all_missing_samples(fx.npx(spark, sf).where(F.col(S.BLOCK) == "1"))


@register(
    "all_missing_assays",
    Q(["npx"], "select assay_id, count(*) as n_rows from npx group by assay_id having count(npx) = 0"),
)
def q_all_missing_assays(spark, sf):
    return qc.all_missing_assays(fx.npx(spark, sf))


@register(
    "flagged_assays",
    Q(["npx"], "select distinct assay_id, assay, block, assay_qc from npx where assay_type = 'assay' and assay_qc <> 'PASS'"),
)
def q_flagged_assays(spark, sf):
    return qc.flagged_assays(fx.npx(spark, sf))


@register(
    "flagged_samples",
    Q(["npx"], "select distinct sample_id from npx where sample_qc is null or sample_qc not in ('NA', 'PASS')"),
)
def q_flagged_samples(spark, sf):
    return qc.flagged_samples(fx.npx(spark, sf))


_SQL_QC_LONG = """
fl as (select distinct sample_id from npx where sample_qc is null or sample_qc not in ('NA', 'PASS')),
qc_counts as (select sample_id, block, sample_qc, count(*) as n from npx
              where sample_id in (select sample_id from fl) group by sample_id, block, sample_qc),
qcl as (select sample_id, block,
               string_agg(coalesce(sample_qc, 'NA') || ' (n=' || cast(n as varchar) || ')', ', '
                          order by sample_qc is null, sample_qc) as qc
        from qc_counts group by sample_id, block)"""


@register("sample_qc_long", Q(["npx"], "select sample_id, block, qc from qcl", _SQL_QC_LONG))
def q_sample_qc_long(spark, sf):
    return qc.sample_qc_long(fx.npx(spark, sf))


@register(
    "sample_qc_matrix",
    Q(
        ["npx"],
        "select sample_id, "
        + ", ".join(f"max(qc) filter (where block = '{b}') as block_{b}" for b in S.BLOCKS)
        + " from qcl group by sample_id",
        _SQL_QC_LONG,
    ),
)
def q_sample_qc_matrix(spark, sf):
    return qc.sample_qc_matrix(fx.npx(spark, sf), list(S.BLOCKS))


@register(
    "negctrl_signal",
    Q(
        ["npx"],
        """select assay_id, count(distinct sample_id) as n_controls, round(max(cast(read_count as double) / ext), 6) as max_ratio,
       max(cast(read_count as double) / ext) > 1.0 as flagged
from nc where assay_type = 'assay' and sample_qc = 'PASS' group by assay_id""",
        """
nc as (select *, max(case when assay_type = 'ext_ctrl' then read_count end) over (partition by sample_id, block) as ext
       from npx where sample_type = 'NEGATIVE_CONTROL')""",
    ),
)
def q_negctrl_signal(spark, sf):
    return r6(qc.negative_control_signal(fx.npx(spark, sf), threshold=1.0), "max_ratio")


@register(
    "qc_summary",
    Q(
        ["npx"],
        """select s.block, s.samples_failed, s.samples_warned, s.samples_passed, a.assays_failed
from (select block, count(*) filter (where f) as samples_failed, count(*) filter (where not f and w) as samples_warned,
             count(*) filter (where not f and not w and p) as samples_passed
      from (select block, sample_id, bool_or(coalesce(sample_qc, '') = 'FAIL') as f, bool_or(coalesce(sample_qc, '') = 'WARN') as w,
                   bool_or(coalesce(sample_qc, '') = 'PASS') as p from npx group by block, sample_id) t group by block) s
join (select block, cast(count(distinct assay_id) filter (where assay_type = 'assay' and assay_qc <> 'PASS') as bigint) as assays_failed
      from npx group by block) a on a.block = s.block""",
    ),
)
def q_qc_summary(spark, sf):
    return qc.qc_summary(fx.npx(spark, sf))


@register(
    "uniprot_map",
    Q(
        ["npx"],
        """select p.assay_id, p.uniprot, k.uniprot_kept from (select distinct assay_id, uniprot from npx) p
join (select assay_id, min(uniprot) as uniprot_kept from (select distinct assay_id, uniprot from npx) t
      group by assay_id having count(*) > 1) k on k.assay_id = p.assay_id""",
    ),
)
def q_uniprot_map(spark, sf):
    return qc.uniprot_map(fx.npx(spark, sf))


@register(
    "qc_outliers",
    Q(
        ["npx"],
        """select sample_id, ps.panel, round(iqr, 6) as iqr, round(med, 6) as median,
       case when iqr > im + 3*isd or iqr < im - 3*isd or med > mm + 3*msd or med < mm - 3*msd then 1
            when not (iqr > im + 3*isd or iqr < im - 3*isd or med > mm + 3*msd or med < mm - 3*msd) then 0 end as outlier
from ps join pn on ps.panel = pn.panel""",
        """
ps as (select sample_id, panel, quantile_cont(npx, 0.75) - quantile_cont(npx, 0.25) as iqr, quantile_cont(npx, 0.5) as med
       from npx where sample_type = 'SAMPLE' group by sample_id, panel),
pn as (select panel, avg(iqr) as im, stddev_samp(iqr) as isd, avg(med) as mm, stddev_samp(med) as msd from ps group by panel)""",
    ),
)
def q_qc_outliers(spark, sf):
    d = fx.npx(spark, sf).where(F.col(S.SAMPLE_TYPE) == S.SAMPLE)
    return r6(qc.qc_outliers(d), "iqr", "median")


# ---------------------------------------------------------------------------
# Normalisation
# ---------------------------------------------------------------------------
_SQL_PLATE_MEDIANS = """
pm as (select plate_id, assay_id, median(case when sample_type = 'PLATE_CONTROL' then ext_npx end) as pc_median,
              median(case when sample_type = 'SAMPLE' then ext_npx end) as sample_median
       from npx group by plate_id, assay_id)"""

_SQL_NORM = _SQL_PLATE_MEDIANS + """,
nz as (select d.*, pm.pc_median, pm.sample_median,
              case when coalesce(d.sample_qc in ('FAIL', 'NA'), false) then null else d.ext_npx - pm.pc_median end as npx_pc,
              case when coalesce(d.sample_qc in ('FAIL', 'NA'), false) then null else d.ext_npx - pm.sample_median end as npx_intensity
       from npx d left join pm on d.plate_id = pm.plate_id and d.assay_id = pm.assay_id)"""


@register(
    "ext_npx",
    Q(
        ["npx"],
        """select sample_id, assay_id, block, read_count,
       round(log2(cast(read_count as double) / max(case when assay_type = 'ext_ctrl' then read_count end)
                  over (partition by sample_id, block)), 6) as ext_npx_calc from npx""",
    ),
)
def q_ext_npx(spark, sf):
    e = normalize.ext_npx(fx.npx(spark, sf))
    return r6(e.select(S.SAMPLE_ID, S.ASSAY_ID, S.BLOCK, S.COUNT, "ext_npx_calc"), "ext_npx_calc")


@register(
    "normalize_pc",
    Q(["npx"], "select sample_id, assay_id, plate_id, round(pc_median, 6) as pc_median, round(npx_pc, 6) as npx_pc from nz", _SQL_NORM),
)
def q_normalize_pc(spark, sf):
    n = normalize.normalize(fx.npx(spark, sf))
    return r6(n.select(S.SAMPLE_ID, S.ASSAY_ID, S.PLATE_ID, "pc_median", "npx_pc"), "pc_median", "npx_pc")


@register(
    "normalize_intensity",
    Q(
        ["npx"],
        "select sample_id, assay_id, plate_id, round(sample_median, 6) as sample_median, round(npx_intensity, 6) as npx_intensity from nz",
        _SQL_NORM,
    ),
)
def q_normalize_intensity(spark, sf):
    n = normalize.normalize(fx.npx(spark, sf))
    return r6(
        n.select(S.SAMPLE_ID, S.ASSAY_ID, S.PLATE_ID, "sample_median", "npx_intensity"), "sample_median", "npx_intensity"
    )


@register(
    "normalize_pc_lot",
    Q(
        ["npx", "lot_factor"],
        """select nz.sample_id, nz.assay_id, nz.plate_id, lf.pc_lot_factor,
       round(case when coalesce(nz.sample_qc in ('FAIL', 'NA'), false) then null
                  else nz.ext_npx - nz.pc_median - coalesce(lf.pc_lot_factor, 0.0) end, 6) as npx_pc_lot
from nz left join lot_factor lf on nz.assay_id = lf.assay_id""",
        _SQL_NORM,
    ),
)
def q_normalize_pc_lot(spark, sf):
    d = fx.npx(spark, sf)
    n = normalize.normalize_pc_with_lot_factor(d, fx.lot_factor(d))
    return r6(n.select(S.SAMPLE_ID, S.ASSAY_ID, S.PLATE_ID, "pc_lot_factor", "npx_pc_lot"), "npx_pc_lot")


@register(
    "choose_npx",
    Q(
        ["npx"],
        """select sample_id, assay_id,
       case when not ex then round(npx_intensity, 6) end as npx, case when not ex then round(npx_pc, 6) end as pc_npx,
       case when ex then 'EXCLUDED' else 'Intensity' end as normalization
from (select *, coalesce(assay_type = 'assay' and assay_qc = 'NA', false) as ex from nz) t""",
        _SQL_NORM,
    ),
)
def q_choose_npx(spark, sf):
    c = normalize.choose_npx(normalize.normalize(fx.npx(spark, sf)), "intensity")
    return r6(c.select(S.SAMPLE_ID, S.ASSAY_ID, S.NPX, S.PC_NPX, S.NORMALIZATION), S.NPX, S.PC_NPX)


@register(
    "counts_only",
    Q(["npx"], "select sample_id, sample_type, plate_id, assay_id, block, read_count from npx where sample_qc = 'FAIL'"),
)
def q_counts_only(spark, sf):
    return normalize.counts_only(fx.npx(spark, sf))


# ---------------------------------------------------------------------------
# Limit of detection
# ---------------------------------------------------------------------------
@register(
    "append_fixed_lod",
    Q(
        ["npx", "fixed_lod"],
        """select d.sample_id, d.assay_id, d.plate_id, f.pc_lod, round(f.pc_lod + pm.pc_median - pm.sample_median, 6) as lod
from npx d left join fixed_lod f on d.assay_id = f.assay_id and d.data_analysis_ref_id = f.data_analysis_ref_id
left join pm on d.plate_id = pm.plate_id and d.assay_id = pm.assay_id""",
        _SQL_PLATE_MEDIANS,
    ),
)
def q_append_fixed_lod(spark, sf):
    d = fx.npx(spark, sf)
    a = lod.append_fixed_lod(d, fx.fixed_lod(d))
    return r6(a.select(S.SAMPLE_ID, S.ASSAY_ID, S.PLATE_ID, S.PC_LOD, S.LOD), S.LOD)


@register(
    "nc_lod",
    Q(
        ["npx"],
        """select assay_id, count(*) as n_rows, count(npx) as n_values, round(stddev_samp(npx), 6) as nc_sd,
       round(median(npx), 6) as nc_median,
       round(case when stddev_samp(npx) is not null then median(npx) + greatest(3 * stddev_samp(npx), 0.2) end, 6) as lod
from npx where sample_type = 'NEGATIVE_CONTROL' and sample_qc = 'PASS' group by assay_id""",
    ),
)
def q_nc_lod(spark, sf):
    return r6(lod.nc_lod(fx.npx(spark, sf), min_controls=10), "nc_sd", "nc_median", S.LOD)


@register(
    "nc_lod_low_count",
    Q(
        ["npx"],
        """select assay_id, n_rows, n_values, round(sd, 6) as nc_sd, round(med, 6) as nc_median, mc as nc_median_count,
       round(case when mc < 150 then log2(2 * greatest(mc, 1) / me)
                  when sd is not null then med + greatest(3 * sd, 0.2) end, 6) as lod
from st""",
        """
nc as (select * from npx where sample_type = 'NEGATIVE_CONTROL' and sample_qc = 'PASS'),
ext as (select sample_id, block, max(read_count) as c from nc where assay_type = 'ext_ctrl' group by sample_id, block),
st as (select assay_id, count(*) as n_rows, count(npx) as n_values, stddev_samp(npx) as sd, median(npx) as med,
              median(cast(read_count as double)) as mc, median(cast(ext.c as double)) as me
       from nc left join ext using (sample_id, block) group by assay_id)""",
    ),
)
def q_nc_lod_low_count(spark, sf):
    return r6(lod.nc_lod(fx.npx(spark, sf), min_controls=10, low_count=150), "nc_sd", "nc_median", S.LOD)


@register(
    "below_lod_to_null",
    Q(["npx"], "select sample_id, assay_id, case when npx >= lod then npx end as npx, lod from npx"),
)
def q_below_lod_to_null(spark, sf):
    return lod.below_lod_to_null(fx.npx(spark, sf)).select(S.SAMPLE_ID, S.ASSAY_ID, S.NPX, S.LOD)


@register(
    "below_lod_to_half",
    Q(["npx"], "select sample_id, assay_id, case when npx < lod then lod / 2 else npx end as npx, lod from npx"),
)
def q_below_lod_to_half(spark, sf):
    return lod.below_lod_to_half(fx.npx(spark, sf)).select(S.SAMPLE_ID, S.ASSAY_ID, S.NPX, S.LOD)


@register(
    "recode_low_quality",
    Q(
        ["npx"],
        "select sample_id, assay_id, plate_id, x3 as npx from r4 where nn > 0",
        """
r1 as (select *, case when npx >= lod then npx end as x1 from npx),
r2 as (select *, case when avg(case when x1 is null then 1.0 else 0.0 end) over (partition by plate_id, assay_id) > 0.5
                      then null else x1 end as x2 from r1),
r3 as (select *, case when avg(case when x2 is null then 1.0 else 0.0 end) over (partition by assay_id) > 0.5
                      then null else x2 end as x3 from r2),
r4 as (select *, count(x3) over (partition by assay_id) as nn from r3)""",
    ),
)
def q_recode_low_quality(spark, sf):
    return lod.recode_low_quality(fx.npx(spark, sf)).select(S.SAMPLE_ID, S.ASSAY_ID, S.PLATE_ID, S.NPX)


_SQL_BELOW = """
bs as (select sample_id, sample_type, plate_id, cast(count_if(npx < lod) as bigint) as n_below_lod,
              count(*) as total_assays, count(npx) as non_nas
       from npx where assay_type = 'assay' group by sample_id, sample_type, plate_id)"""


@register("below_lod_per_sample", Q(["npx"], "select * from bs", _SQL_BELOW))
def q_below_lod_per_sample(spark, sf):
    return lod.below_lod_per_sample(fx.npx(spark, sf))


@register(
    "below_lod_per_plate",
    Q(
        ["npx"],
        """select plate_id, first(total_assays order by sample_id, sample_type) as total,
       first(non_nas order by sample_id, sample_type) as non_na,
       round(cast(quantile_cont(n_below_lod, 0.25) as double), 6) as q1,
       round(cast(quantile_cont(n_below_lod, 0.5) as double), 6) as median_below_lod,
       round(cast(quantile_cont(n_below_lod, 0.75) as double), 6) as q3
from bs group by plate_id""",
        _SQL_BELOW,
    ),
)
def q_below_lod_per_plate(spark, sf):
    per_plate = lod.below_lod_per_plate(lod.below_lod_per_sample(fx.npx(spark, sf)))
    return r6(per_plate, "q1", "median_below_lod", "q3")


_SQL_PCT = "round(avg(case when npx > lod then cast(1 as double) when npx <= lod then cast(0 as double) end), 6) as perc_gt_lod"


@register(
    "percent_above_lod",
    Q(["npx"], f"select assay_id, plate_id, {_SQL_PCT} from npx where sample_type = 'SAMPLE' group by assay_id, plate_id"),
)
def q_percent_above_lod(spark, sf):
    return r6(lod.percent_above_lod(fx.npx(spark, sf)), "perc_gt_lod")


@register(
    "percent_above_lod_assay",
    Q(["npx"], f"select assay_id, {_SQL_PCT} from npx where sample_type = 'SAMPLE' group by assay_id"),
)
def q_percent_above_lod_assay(spark, sf):
    return r6(lod.percent_above_lod(fx.npx(spark, sf), by=[S.ASSAY_ID]), "perc_gt_lod")


# ---------------------------------------------------------------------------
# Chart data
# ---------------------------------------------------------------------------
@register(
    "cv_histogram",
    Q(
        ["npx"],
        """select d.block, d.npx > d.lod as above_lod,
       cast(cast(ceil((ci.intra_cv - 0.25) / 0.5) as bigint) as double) * cast(0.5 as double) as bin_center, count(*) as n
from npx d join ci on d.assay_id = ci.assay_id and d.plate_id = ci.plate_id join ce on d.assay_id = ce.assay_id
where ci.intra_cv is not null group by 1, 2, 3""",
        _SQL_CI,
    ),
)
def q_cv_histogram(spark, sf):
    return charts.cv_histogram(cv.attach_control_cv(fx.npx(spark, sf)))


@register(
    "cv_density",
    Q(
        ["npx", "manifest", "subjects"],
        """select xx.sample_type, xx.plate_id, g.i as grid_index, round(rg.lo + cast(g.i as double) * rg.step, 6) as x,
       round(sum(exp(-0.5 * power((rg.lo + cast(g.i as double) * rg.step - xx.x) / bw.bw, 2)))
             * (1 / sqrt(2 * pi())) / (cast(max(bw.n) as double) * max(bw.bw)), 6) as density
from xx join bw on xx.sample_type = bw.sample_type and xx.plate_id = bw.plate_id
cross join rg cross join (select range as i from range(512)) g
group by xx.sample_type, xx.plate_id, g.i, rg.lo, rg.step""",
        _SQL_SHEET,
        _SQL_MAP,
        _sql_rcv(False),
        _sql_median_cv(),
        """
xx as (select sample_type, plate_id, least(intra_cv_median, cast(50 as double)) as x from mcv where intra_cv_median is not null),
st as (select sample_type, plate_id, count(*) as n, stddev_samp(x) as sd,
              quantile_cont(x, 0.75) - quantile_cont(x, 0.25) as iqr, abs(min(x)) as fa
       from xx group by sample_type, plate_id having count(*) >= 2),
bw as (select *, 0.9 * (case when least(sd, iqr / 1.34) <> 0 then least(sd, iqr / 1.34) when sd <> 0 then sd
                             when fa <> 0 then fa else 1.0 end) * power(cast(n as double), -0.2) as bw from st),
rg as (select min(x) as lo, (max(x) - min(x)) / cast(511 as double) as step from xx)""",
    ),
)
def q_cv_density(spark, sf):
    return r6(charts.cv_density(cv.median_cv(_replicate_cv(spark, sf, False))), "x", "density")


_SQL_DETECT = """
pct as (select assay_id, plate_id, avg(case when npx > lod then cast(1 as double) when npx <= lod then cast(0 as double) end) as perc_gt_lod
        from npx where sample_type = 'SAMPLE' group by assay_id, plate_id),
pts as (select pct.assay_id, pct.plate_id, pct.perc_gt_lod, mcv.sample_type, mcv.intra_cv_median
        from pct join mcv on pct.assay_id = mcv.assay_id and pct.plate_id = mcv.plate_id where mcv.sample_type = 'SAMPLE')"""


@register(
    "cv_vs_detectability",
    Q(
        ["npx", "manifest", "subjects"],
        "select assay_id, plate_id, round(perc_gt_lod, 6) as perc_gt_lod, sample_type, round(intra_cv_median, 6) as intra_cv_median from pts",
        _SQL_SHEET,
        _SQL_MAP,
        _sql_rcv(False),
        _sql_median_cv(),
        _SQL_DETECT,
    ),
)
def q_cv_vs_detectability(spark, sf):
    d = fx.npx(spark, sf)
    pts = charts.cv_vs_detectability(lod.percent_above_lod(d), cv.median_cv(_replicate_cv(spark, sf, False)))
    return r6(pts, "perc_gt_lod", "intra_cv_median")


@register(
    "cv_detectability_fit",
    Q(
        ["npx", "manifest", "subjects"],
        """select plate_id, count(*) as n_points, round(regr_slope(log10(intra_cv_median), perc_gt_lod), 6) as slope,
       round(regr_intercept(log10(intra_cv_median), perc_gt_lod), 6) as intercept,
       round(regr_r2(log10(intra_cv_median), perc_gt_lod), 6) as r2,
       round(corr(intra_cv_median, perc_gt_lod), 6) as pearson_r
from pts where intra_cv_median > 0 and perc_gt_lod is not null group by plate_id""",
        _SQL_SHEET,
        _SQL_MAP,
        _sql_rcv(False),
        _sql_median_cv(),
        _SQL_DETECT,
    ),
)
def q_cv_detectability_fit(spark, sf):
    d = fx.npx(spark, sf)
    pts = charts.cv_vs_detectability(lod.percent_above_lod(d), cv.median_cv(_replicate_cv(spark, sf, False)))
    return r6(charts.cv_detectability_fit(pts), "slope", "intercept", "r2", "pearson_r")


@register(
    "npx_boxplot",
    Q(
        ["npx"],
        """select sample_id, block, plate_id, sample_qc, count(*) as n, round(max(q1), 6) as q1, round(max(med), 6) as median,
       round(max(q3), 6) as q3,
       min(case when npx >= q1 - 1.5 * (q3 - q1) then npx end) as whisker_low,
       max(case when npx <= q3 + 1.5 * (q3 - q1) then npx end) as whisker_high,
       cast(count_if(npx < q1 - 1.5 * (q3 - q1) or npx > q3 + 1.5 * (q3 - q1)) as bigint) as n_outliers
from bx group by sample_id, block, plate_id, sample_qc""",
        """
bx as (select sample_id, block, plate_id, sample_qc, npx,
              quantile_cont(npx, 0.25) over w as q1, quantile_cont(npx, 0.5) over w as med, quantile_cont(npx, 0.75) over w as q3
       from npx where npx is not null
       window w as (partition by sample_id, block, plate_id, sample_qc))""",
    ),
)
def q_npx_boxplot(spark, sf):
    return r6(charts.npx_boxplot(fx.npx(spark, sf)), "q1", "median", "q3")


@register(
    "heatmap_matrix",
    Q(
        ["npx"],
        "select sample_id, assay_id, sample_type, block, round((npx - m) / nullif(s, 0), 6) as z from k join st using (assay_id)",
        """
k as (select * from npx where coalesce(assay_qc, '') <> 'NA'),
st as (select assay_id, avg(npx) as m, stddev_samp(npx) as s from k group by assay_id)""",
    ),
)
def q_heatmap_matrix(spark, sf):
    return r6(charts.heatmap_matrix(fx.npx(spark, sf)), "z")


# ---------------------------------------------------------------------------
# Matrix and PCA
# ---------------------------------------------------------------------------
_SQL_DROP_CONST = """
dc as (select d.* from npx d where exists (
         select 1 from (select assay_id, plate_id from npx group by assay_id, plate_id having var_samp(npx) > 0) v
         where v.assay_id = d.assay_id and v.plate_id = d.plate_id))"""


@register("drop_constant_assays", Q(["npx"], "select sample_id, assay_id, plate_id, npx from dc", _SQL_DROP_CONST))
def q_drop_constant_assays(spark, sf):
    return matrix.drop_constant_assays(fx.npx(spark, sf)).select(S.SAMPLE_ID, S.ASSAY_ID, S.PLATE_ID, S.NPX)


# The fixture's 64 assays without the two that never have a value.
_MATRIX_ASSAYS = sorted("BAD3" if p == 3 else f"OID{10000 + p}" for p in range(64) if p % 32 != 11)


@register(
    "wide_matrix",
    Q(
        ["npx"],
        "select sample_id, "
        + ", ".join(f"max(npx) filter (where assay_id = '{a}') as \"{a}\"" for a in _MATRIX_ASSAYS)
        + " from npx where npx is not null group by sample_id",
    ),
)
def q_wide_matrix(spark, sf):
    return matrix.wide_matrix(fx.npx(spark, sf))


@register(
    "impute_median",
    Q(
        ["npx"],
        """select s.sample_id, a.assay_id, round(coalesce(v.npx, a.med), 6) as npx_imputed
from s cross join a left join v on v.sample_id = s.sample_id and v.assay_id = a.assay_id""",
        """
v as (select sample_id, assay_id, npx from npx where npx is not null),
s as (select distinct sample_id from v),
a as (select assay_id, median(npx) as med from v group by assay_id)""",
    ),
)
def q_impute_median(spark, sf):
    return r6(matrix.impute_median(fx.npx(spark, sf)), "npx_imputed")


@register(
    "align_metadata",
    Q(
        ["npx", "manifest", "subjects"],
        """select s.sample_id, f.sample_type, f.well, f.plate, f."column", f."row", f.project, f.plate_id, f.subj_id,
       f.subsample_id, f.subj_type, f.sex, f.tissue_type
from (select distinct sample_id from dc where npx is not null) s left join full_sheet f on s.sample_id = f.sample_id""",
        _SQL_SHEET,
        _SQL_DROP_CONST,
    ),
)
def q_align_metadata(spark, sf):
    d = fx.npx(spark, sf)
    samples = matrix.drop_constant_assays(d).where(F.col(S.NPX).isNotNull()).select(S.SAMPLE_ID).distinct()
    return matrix.align_metadata(samples, _full_sheet(spark, sf, d))


def _pca_input(spark, sf):
    d = fx.npx(spark, sf)
    full = _full_sheet(spark, sf, d)
    return manifest.restrict_samples(d, full), full


@register("pca_scores")
def q_pca_scores(spark, sf):
    data, full = _pca_input(spark, sf)
    res = components.pca(data, k=5)
    return res.scores.join(full, S.SAMPLE_ID, "left")


@register("pca_variance")
def q_pca_variance(spark, sf):
    data, _ = _pca_input(spark, sf)
    return components.pca(data, k=5).variance


@register("pca_samples_only")
def q_pca_samples_only(spark, sf):
    return components.pca_builtin(fx.npx(spark, sf), k=5).scores


def _mean_long(spark, sf):
    """The sparse table with one value per (sample, assay): the mean of its repeated measurements. Few
    samples and a wide panel."""
    d = fx.npx_long(spark, sf)
    return d.groupBy(S.SAMPLE_ID, S.ASSAY_ID).agg(F.avg(S.NPX).alias(S.NPX))


# A checked decomposition has these values whatever the data: the rest of a row is computed by both sides.
_SQL_PCA_CHECK = """select c.component, 0.0::double as residual, 1.0::double as length, 0.0::double as skew, 1.0::double as spread,
       t.total, t.samples
from (select unnest(range(1, 6))::integer as component) c, t"""


def _sql_pca_total(src: str) -> str:
    """Number of assays that vary (each has variance one once scaled) and of samples."""
    return f"""
v as (select sample_id, assay_id, npx from {src} where npx is not null),
a as (select assay_id, min(npx) as low, max(npx) as high from v group by assay_id),
t as (select (select count(*) from a where low < high)::double as total, (select count(distinct sample_id) from v)::bigint as samples)"""


@register(
    "pca_check",
    Q(
        ["npx", "manifest", "subjects"],
        _SQL_PCA_CHECK,
        _SQL_SHEET,
        """
r as (select * from npx where sample_id in (select sample_id from full_sheet)),
rc as (select d.* from r d where exists (
         select 1 from (select assay_id, plate_id from r group by assay_id, plate_id having var_samp(npx) > 0) v
         where v.assay_id = d.assay_id and v.plate_id = d.plate_id))""",
        _sql_pca_total("rc"),
    ),
)
def q_pca_check(spark, sf):
    data, _ = _pca_input(spark, sf)
    out = components.pca_check(data, components.pca(data, k=5))
    return r6(out, "residual", "length", "skew", "spread", "total")


@register("pca_check_wide", Q(["npx_long"], _SQL_PCA_CHECK, """
m as (select sample_id, assay_id, avg(npx) as npx from npx_long group by sample_id, assay_id)""", _sql_pca_total("m")))
def q_pca_check_wide(spark, sf):
    data = materialize(_mean_long(spark, sf))
    out = components.pca_check(data, components.pca(data, k=5, drop_constant=False), drop_constant=False)
    return r6(out, "residual", "length", "skew", "spread", "total")


@register(
    "sample_neighbours",
    Q(
        ["npx"],
        """select sample_id, rank, neighbour_id, round(distance, 6) as distance from (
  select sample_id, neighbour_id, distance, row_number() over (partition by sample_id order by distance, neighbour_id)::integer as rank from d)
where rank <= 10""",
        _SQL_DROP_CONST,
        """
v as (select sample_id, assay_id, npx from dc where npx is not null),
a as (select assay_id, median(npx) as med from v group by assay_id),
f as (select s.sample_id, a.assay_id, coalesce(v.npx, a.med) as x
      from (select distinct sample_id from v) s cross join a left join v on v.sample_id = s.sample_id and v.assay_id = a.assay_id),
w as (select sample_id, list(x order by assay_id) as x from f group by sample_id),
d as (select p.sample_id, q.sample_id as neighbour_id, list_distance(p.x, q.x) as distance from w p join w q on p.sample_id <> q.sample_id)""",
    ),
)
def q_sample_neighbours(spark, sf):
    return r6(neighbours.sample_neighbours(fx.npx(spark, sf), k=10), "distance")
