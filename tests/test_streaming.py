from codeloom.operators import parse
from codeloom.streaming.lines import stream_findings


def test_stream_equals_batch(spark, tmp_path):
    schema = "file_id string, relative_path string, language string, source string"
    batch = spark.createDataFrame([("a", "a.rs", "rust", "impl A {\n fn f() {}\n}\nfn g() {}\n"), ("b", "b.py", "python", "import x\nclass K:\n")], schema)
    batch.write.parquet(f"{tmp_path}/in")
    query = stream_findings(spark.readStream.schema(schema).parquet(f"{tmp_path}/in")).writeStream.format("memory").queryName("findings").outputMode("append").start()
    query.processAllAvailable()
    query.stop()
    assert sorted(map(tuple, spark.table("findings").collect())) == sorted(map(tuple, parse.findings(batch).collect()))
