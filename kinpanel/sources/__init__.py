"""Readers and writers for registers, dictionaries, panels and reports."""
