"""Pipelines of several operators, with models as injected callables."""
