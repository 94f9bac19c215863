"""Readers, the ERP-shaped adapter over the driver tables, and history sinks."""
