"""Operators of a training-data pipeline over the tables documents, embeddings, pages and benchmark.

Each module holds one operator; ``suite`` registers one query per operator, and nothing outside this
folder imports from it. Words are runs of characters other than space and the controls 9 to 13.
"""
