"""Runs that chain operators: learners, strategies, backtests, tuning and the production forecast."""
