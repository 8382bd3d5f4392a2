"""Column names, the declared schema of the long measurement table, and fixed values.

One row of the measurement table is one sample x one assay. Vendor column names are
mapped to snake_case once, at ingest; every operator takes column names with these
defaults.
"""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Column names used throughout the library.
# ---------------------------------------------------------------------------
SAMPLE_ID = "sample_id"
SAMPLE_TYPE = "sample_type"
WELL_ID = "well_id"
PLATE_ID = "plate_id"
DAR_ID = "data_analysis_ref_id"
ASSAY_ID = "assay_id"
UNIPROT = "uniprot"
ASSAY = "assay"
ASSAY_TYPE = "assay_type"
PANEL = "panel"
BLOCK = "block"
COUNT = "read_count"
EXT_NPX = "ext_npx"
NPX = "npx"
NORMALIZATION = "normalization"
PC_NPX = "pc_npx"
ASSAY_QC = "assay_qc"
SAMPLE_QC = "sample_qc"
EXPLORE_VERSION = "explore_version"
VENDOR_INTRA_CV = "vendor_intra_cv"
VENDOR_INTER_CV = "vendor_inter_cv"
LOD = "lod"
PC_LOD = "pc_lod"
SUBSAMPLE_ID = "subsample_id"

# ---------------------------------------------------------------------------
# Fixed values (must equal the vendor export / the reference's analysis).
# ---------------------------------------------------------------------------
# Vendor export column -> our column.
VENDOR_COLUMNS = {
    "SampleID": SAMPLE_ID,
    "SampleType": SAMPLE_TYPE,
    "WellID": WELL_ID,
    "PlateID": PLATE_ID,
    "DataAnalysisRefID": DAR_ID,
    "OlinkID": ASSAY_ID,
    "UniProt": UNIPROT,
    "Assay": ASSAY,
    "AssayType": ASSAY_TYPE,
    "Panel": PANEL,
    "Block": BLOCK,
    "Count": COUNT,
    "ExtNPX": EXT_NPX,
    "NPX": NPX,
    "Normalization": NORMALIZATION,
    "PCNormalizedNPX": PC_NPX,
    "AssayQC": ASSAY_QC,
    "SampleQC": SAMPLE_QC,
    "ExploreVersion": EXPLORE_VERSION,
    "IntraCV": VENDOR_INTRA_CV,
    "InterCV": VENDOR_INTER_CV,
    "LOD": LOD,
    "PCNormalizedLOD": PC_LOD,
    "Quantified_value": "quantified_value",
}

# Sample types.
PLATE_CONTROL = "PLATE_CONTROL"
NEGATIVE_CONTROL = "NEGATIVE_CONTROL"
SAMPLE_CONTROL = "SAMPLE_CONTROL"
SAMPLE = "SAMPLE"
CONTROL_MARKER = "_CONTROL"

# Assay types.
ASSAY_TYPE_ASSAY = "assay"
EXT_CTRL = "ext_ctrl"

# QC states. "NA" is the string the vendor writes, not a missing value.
QC_PASS = "PASS"
QC_WARN = "WARN"
QC_FAIL = "FAIL"
QC_NA = "NA"

# Assay identifier pattern (unanchored, as in the integrity check).
ASSAY_ID_PATTERN = "OID[0-9]{5}"

# Blocks of the panel and their sample dilution.
BLOCKS = ["1", "2", "3", "4", "5", "6", "7", "8"]
BLOCK_DILUTION = {
    "1": "1:1",
    "2": "1:1",
    "3": "1:1",
    "4": "1:1",
    "5": "1:10",
    "6": "1:100",
    "7": "1:1000",
    "8": "1:100,000",
}

# Plate geometry: 96 wells, rows A-H, columns 1-12.
PLATE_ROWS = ["A", "B", "C", "D", "E", "F", "G", "H"]
PLATE_COLUMNS = [str(i) for i in range(1, 13)]

# Columns a measurement table must have for the operators that use them.
REQUIRED_COLUMNS = [SAMPLE_ID, ASSAY_ID]

NPX_SCHEMA = T.StructType(
    [
        T.StructField(SAMPLE_ID, T.StringType()),
        T.StructField(SAMPLE_TYPE, T.StringType()),
        T.StructField(WELL_ID, T.StringType()),
        T.StructField(PLATE_ID, T.StringType()),
        T.StructField(DAR_ID, T.StringType()),
        T.StructField(ASSAY_ID, T.StringType()),
        T.StructField(UNIPROT, T.StringType()),
        T.StructField(ASSAY, T.StringType()),
        T.StructField(ASSAY_TYPE, T.StringType()),
        T.StructField(PANEL, T.StringType()),
        T.StructField(BLOCK, T.StringType()),
        T.StructField(COUNT, T.LongType()),
        T.StructField(EXT_NPX, T.DoubleType()),
        T.StructField(NPX, T.DoubleType()),
        T.StructField(NORMALIZATION, T.StringType()),
        T.StructField(PC_NPX, T.DoubleType()),
        T.StructField(ASSAY_QC, T.StringType()),
        T.StructField(SAMPLE_QC, T.StringType()),
        T.StructField(EXPLORE_VERSION, T.StringType()),
        T.StructField(VENDOR_INTRA_CV, T.DoubleType()),
        T.StructField(VENDOR_INTER_CV, T.DoubleType()),
        T.StructField(LOD, T.DoubleType()),
        T.StructField(PC_LOD, T.DoubleType()),
    ]
)

NPX_TYPES = {f.name: f.dataType for f in NPX_SCHEMA.fields}
