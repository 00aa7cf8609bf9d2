"""Scalar functions with one set of NULL, overflow and domain rules, as Column helpers.

All are compositions of built-in expressions, so they stay in the JVM and inside
whole-stage code generation wherever the built-ins do.
"""

from fathom.functions import conditional, dates, maths, regex, strings

__all__ = ["conditional", "dates", "maths", "regex", "strings"]
