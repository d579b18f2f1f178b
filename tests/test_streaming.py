from quillgraph.sources import config
from quillgraph.streaming.relint import page_findings, relint

RULES = 'index = ""\n[[directories]]\npath = "w"\n[[rules]]\ncheck = "required-sections"\nsections = ["Summary"]\n[[rules]]\ncheck = "required-frontmatter"\nfields = ["owner"]\n'


def test_relint(spark, tmp_path):
    c = config.parse(RULES)
    schema = "rel_path string, source string"
    spark.createDataFrame([("w/a.md", "# Summary\n"), ("w/b.md", "---\nowner: x\n---\n## Other\n"), ("x/c.md", "")], schema).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
    relint(stream, c, f"{tmp_path}/out", f"{tmp_path}/check", once=True).awaitTermination()
    spark.createDataFrame([("w/b.md", "---\nowner: x\n---\n## Summary\n"), ("w/d.md", "")], schema).write.mode("append").parquet(f"{tmp_path}/in")
    relint(stream, c, f"{tmp_path}/out", f"{tmp_path}/check", once=True).awaitTermination()
    got = sorted((r.batch, r.rel_path, r.code) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert got == [(0, "w/a.md", "no-frontmatter"), (0, "w/b.md", "missing-section"), (1, "w/d.md", "missing-section"), (1, "w/d.md", "no-frontmatter")]
    assert page_findings(spark.createDataFrame([("w/a.md", "")], schema), config.parse("")).count() == 0
