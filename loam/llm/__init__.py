"""Training-data operators: thirteen corpus operators, each a Spark job over whole tables.

Nothing else in the library imports this subpackage.
"""
