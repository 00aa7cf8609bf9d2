"""Tables as versioned Parquet directories, with constraints and transactions; views and live views."""
