"""Training-data operators: near-duplicates, packing, formatting, scoring, extraction.

Nothing else in the library imports this subpackage.  Every module holds one operator with a
general interface, and the thin ``opN_<name>`` query that applies it to its whole table.
"""
