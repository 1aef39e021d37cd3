"""Binary-artifact analytics on Spark: catalogues of legacy executables, images and their contents as DataFrames."""
