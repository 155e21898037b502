"""Recursive plans: the fixpoint loop, graph queries, and satisfiability."""
