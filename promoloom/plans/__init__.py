"""Compositions of the operators: the five analysis stages, and the warehouse queries."""
