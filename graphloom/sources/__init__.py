"""Readers and writers of the benchmark's documents."""
