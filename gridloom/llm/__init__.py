"""Operations of a training-data pipeline: ten operators over document tables.

Nothing else in the package imports this subpackage.  Every operator is a
function from DataFrames to a DataFrame; ``queries`` binds each of them to the
tables it is meant for.
"""
