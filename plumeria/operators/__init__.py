"""Operators over catalogs, tokenisers and routed layers as DataFrames."""
