"""Stages, and the DAGs made of them."""
