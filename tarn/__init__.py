"""Document corpora on PySpark: build, search and evaluate with lazily composed DataFrames."""
