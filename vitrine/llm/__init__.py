"""Training-data operators: thirteen stand-alone operators over documents, pages and conversations.

Nothing else in the library imports this subpackage. ``queries.py`` registers one query per operator.
"""
