"""Operators for preparing language-model training data.

Nothing outside this folder imports it, so it can be removed without touching
the rest of the library.  Each module holds one operator; ``queries`` registers
the thin ``opN_<name>`` queries built on them.
"""
