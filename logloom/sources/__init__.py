"""Readers that end in the silver event table or in chunk rows."""
