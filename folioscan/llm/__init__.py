"""Operators for preparing training corpora.

Nothing outside this subpackage imports it; delete it and the rest of the
library keeps working.
"""
