"""Pipelines, configuration loading, supervision and turnkey workflows."""
