"""Sources and sinks: domain schemas, driver-table adapters, readers, writers."""

from .tables import Tables, load_tables, read_domain_tables

__all__ = ["Tables", "load_tables", "read_domain_tables"]
