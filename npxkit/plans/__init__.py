"""Chains of operators as the reference's documents run them, and the registered queries."""
