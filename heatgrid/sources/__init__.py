"""Readers with explicit schemas, contracts, and partitioned sinks."""
