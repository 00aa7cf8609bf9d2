"""fathom: a file-first SQL and DataFrame analytics engine on PySpark."""
