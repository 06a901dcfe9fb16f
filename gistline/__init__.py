"""Distillation of command logs and source files as Spark DataFrame jobs."""
