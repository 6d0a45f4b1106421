"""The operators, each a function from tables to tables or models."""
