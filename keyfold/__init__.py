"""Keyed collections (values, lists, sets, maps, ordered element trees) as DataFrames, and set-at-a-time operators on them."""
