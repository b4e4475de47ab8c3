"""Document tables written as Parquet, since some operators read files."""

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def documents(spark, tmp_path):
    def write(rows, schema=SCHEMA, name="documents", **more):
        full = [(*r, *[None] * (len(schema.split(",")) - len(r))) for r in rows]
        spark.createDataFrame(full, schema).write.mode("overwrite").parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return write
