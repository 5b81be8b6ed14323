"""Training-data operators: ten numbered operators, each a module of its own.

Nothing outside this folder imports it; ``queries`` holds the thin registered
queries and their SQL.
"""
