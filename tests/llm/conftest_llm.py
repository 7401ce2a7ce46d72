def empty_like(spark, df):
    return spark.createDataFrame([], df.schema)
