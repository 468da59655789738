"""Readers and writers of market data."""
