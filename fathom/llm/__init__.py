"""Training-data operators: ten corpus-scale components and their queries.

Nothing outside this package imports it; the driver entry registers its
queries only when the package is present.
"""
