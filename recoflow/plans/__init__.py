"""Composite plans: the flagship query, the experiment, the metric suite, sweeps."""
