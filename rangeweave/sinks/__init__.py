"""Raw files out of DataFrames: lines, gzip, LAS, TIFF, imzML, row sets."""
