"""Readers, writers, validation and the driver-table adapters."""
