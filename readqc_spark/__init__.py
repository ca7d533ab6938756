"""Sequencing-error statistics of aligned reads, planned as Spark DataFrames."""
