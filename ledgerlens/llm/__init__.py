"""Operations of a training-data pipeline, each a plan over DataFrames.

Nothing else in the library imports this package. ``queries.py`` registers
one query per operator; the operators keep their own general interfaces.
"""
