"""Sources and sinks: files by extension, table functions, COPY."""
