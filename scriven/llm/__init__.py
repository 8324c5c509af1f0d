"""Operators for preparing training corpora (ten of them, one module each).

Nothing outside this subpackage imports it.
"""
