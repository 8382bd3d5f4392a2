"""npxkit: quality control, normalisation, limit-of-detection and precision analytics for
long-form NPX proteomics measurements, as Spark DataFrame operators.

Modules: ``sources`` (readers, writers), ``operators`` (sheet, qc, normalize, lod, cv,
charts, matrix, manifest), ``functions`` (missing-value rules, exact quantiles),
``plans`` (report chains), ``session`` (session and checkpoint helpers).
"""

__version__ = "0.1.0"

from .operators import charts, cv, lod, manifest, matrix, normalize, qc, sheet  # noqa: F401
from .plans import reports  # noqa: F401
from .sources.readers import read_fixed_lod, read_manifest, read_npx, read_subjects, write_result  # noqa: F401
