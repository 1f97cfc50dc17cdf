"""Sinks: upsert tables, rotated partitions, files and message queues."""
