"""Operators over bars, trades and signals."""
