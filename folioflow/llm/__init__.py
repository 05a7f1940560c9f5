"""Training-data operators: mixing, de-duplication, scoring, scanning, search and tokenising.

Nothing else in the library imports this subpackage.
"""
