"""Stages that arrive one by one, row counters, and plans over unbounded input."""
