"""Writers."""


def csv(df, path, header=True, **options):
    df.write.mode("overwrite").option("header", header).option("escape", '"').options(**options).csv(path)


def parquet(df, path, partition_by=()):
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)
