"""Named analyses over the driver's tables (``catalog``), their DuckDB
oracle SQL (``oracle``) and the whole dashboard as one plan (``dashboard``)."""
