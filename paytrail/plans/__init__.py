"""Registered queries with their SQL checks, and the end-to-end scoring flow."""
