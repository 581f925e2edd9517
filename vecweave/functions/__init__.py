"""Expressions as Spark SQL text.

Functions take and give SQL expressions, to be used with ``F.expr`` or ``selectExpr``. Long expressions are built
much faster this way than call by call, and they also work inside lambdas.
"""
