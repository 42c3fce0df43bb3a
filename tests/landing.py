"""Small producers for tests: one file a step, one file a trigger, so that a single run has several batches."""

from opslake.streaming import jobs


def roll(df, folder):
    df.coalesce(1).write.mode("append").parquet(folder)


def watch(spark, schema, folder):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def land(df, parts):
    folder = jobs.new_folder(df.sparkSession, "landed")
    for part in parts:
        roll(df.where(part), folder)
    return watch(df.sparkSession, df.schema, folder)
