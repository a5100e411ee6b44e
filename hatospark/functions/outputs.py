"""Writing all outputs of a job once."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_outputs(outputs: dict[str, DataFrame], folder: str) -> dict[str, DataFrame]:
    """Write each output as Parquet under a new ``folder`` and return the written tables.

    Readers of the result share what was written, so nothing is decided twice. A job that is
    repeated takes another folder; a folder in use is refused.
    """
    written = {}
    for name, df in outputs.items():
        path = f"{folder}/{name}"
        df.write.parquet(path)
        written[name] = df.sparkSession.read.schema(df.schema).parquet(path)
    return written
