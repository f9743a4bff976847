"""Normalisers, detections, correlations and merges, as functions from DataFrames to DataFrames.

Unless a function says otherwise: a line or row that doesn't have the form it reads is left out; a null field matches no
pattern and counts as empty text where text is joined; equal rows give equal rows, each its own, but where the function
counts or groups; an empty table gives an empty one; columns that aren't named are ignored.
"""
