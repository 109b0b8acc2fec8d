from pyspark.sql import functions as F


def clashing(df, *names):
    """df with more columns of the names given."""
    return df.withColumns({n: F.lit("mine") for n in names})
