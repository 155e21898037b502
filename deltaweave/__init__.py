"""An analytics engine over signed-multiplicity relations, built on DataFrames."""
