"""riskweave — lending-portfolio analytics as Spark DataFrame operators.

Every public operator takes DataFrames plus column-name arguments and
returns a lazy DataFrame; nothing is materialised on the driver except
parameter-sized rows (quantile edges, thresholds, class counts).

Subpackages
-----------
sources    reading/writing tables, driver-table adapters, run stamps
functions  Column -> Column scalar expressions and binning helpers
operators  validation, profiling, roll-ups, segments, decisions,
           evaluation, sampling, Spark ML training/scoring/explaining
plans      end-to-end jobs composed from operators + the query catalog
"""

__version__ = "0.1.0"
