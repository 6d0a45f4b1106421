"""Readers and writers of tables, rules, reports and models."""
