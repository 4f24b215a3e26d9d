"""Workflows built from the operators: tasks, impact evaluation, schema stress test."""
