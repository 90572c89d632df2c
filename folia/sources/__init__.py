"""Readers and writers for the tables the operators work on."""
