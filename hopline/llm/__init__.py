"""Operators of a training-data pipeline: quality, tokens, secrets, dedup, search, mixing, language.

Nothing outside this subpackage imports it.  ``queries`` holds the registered
queries; every other module holds one operator with a general interface.
"""
