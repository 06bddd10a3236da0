"""Operators for preparing large text collections as training data.

Nothing outside this subpackage imports it; the entry module adds its queries only when it can be imported.
"""
