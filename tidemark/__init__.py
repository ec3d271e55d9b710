"""Disclosure and market analytics on DataFrames."""
