"""Readers, cleaners and sinks for the tables the jobs start from."""
