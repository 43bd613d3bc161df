"""Genealogy and haplotype analytics on Spark DataFrames."""
