"""Pipelines from configuration."""
