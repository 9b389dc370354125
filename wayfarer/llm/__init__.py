"""Operations that a training-data pipeline needs: one module per operator.

Nothing else in the library imports this subpackage.  Each module holds an
operator with a general interface and its own docstring on edge cases;
``queries`` holds the registered queries and their SQL.
"""
