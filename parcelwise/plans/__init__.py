"""Queries, jobs and checks put together from the operators."""
