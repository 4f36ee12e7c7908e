"""Registered queries and the model tables that they run on."""
