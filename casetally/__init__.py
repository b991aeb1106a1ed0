"""casetally: population-surveillance analytics on Spark DataFrames.

Person-level case records are recoded, deduplicated, screened for data
quality, completed by reproducible multiple imputation, counted, pooled over
imputations and turned into rates per 1,000 and rate ratios. Every operator is
a plain ``DataFrame -> DataFrame`` (or ``Column``) function.

Where things are:

* ``casetally.sources``: explicit-type readers (yearly delimited files,
  fixed-width files, NA-coded CSV), partitioned Parquet hand-offs.
* ``casetally.functions``: recode ladders, three-valued and multi-slot flags,
  NULL-safe sums and rates, keyed hash draws.
* ``casetally.operators``: dedup, joins, aggregation, quality, reshaping,
  pooling, rates, panels, imputation (hot-deck, PMM, chained equations),
  materialisation helpers.
* ``casetally.plans.surveillance``: the result tables, generic over column
  roles; ``casetally.plans.casefiles``: the same on the original file formats.
"""

__version__ = "0.1.0"
