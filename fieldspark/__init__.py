"""PySpark operators for surveillance of production and telemetry panels."""
