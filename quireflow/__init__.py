"""Document analytics on Spark: batch results, findings, forms, outlines, glyphs, words and texts as DataFrames."""
