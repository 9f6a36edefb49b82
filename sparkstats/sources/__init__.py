"""Sources and sinks: the driver's parquet tables, CSV/Parquet IO, models."""
