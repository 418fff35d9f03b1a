"""Compositions of operators: score cards, utility flows, generation chains, reports."""
