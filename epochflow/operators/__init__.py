"""Operators on recordings, windows, epochs, decisions and models."""
