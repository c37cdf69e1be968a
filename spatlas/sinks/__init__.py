"""Writers: local results as Parquet, small results as JSON, CSV and Markdown."""

from spatlas.sinks.writers import audit_report, read_local, write_csv, write_json, write_local_parquet

__all__ = ["audit_report", "read_local", "write_csv", "write_json", "write_local_parquet"]
