"""The SQL dialect: lexing, and rewriting to what Spark SQL takes."""
