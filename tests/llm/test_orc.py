"""Operator 6: what is in the files, and what a lookup reads of them."""

import random

from pyspark.sql import functions as F

from quern.llm import orc_tokens


def rows_read(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().collectLeaves().apply(0).metrics().apply("numOutputRows").value()


def test_op6_footers_and_what_lookups_read(spark, tmp_path):
    rng = random.Random(6)
    ids = rng.sample(range(0, 12_000, 2), 6000)  # even ones, in no order: least and greatest of a row group tell nothing
    docs = spark.createDataFrame([(i, " ".join(rng.choice(("sun", "moon", "star")) for _ in range(40)), "x", 1) for i in ids], "doc_id long, text string, tokens string, n_tokens int").coalesce(1)
    orc_tokens.write(docs, path := str(tmp_path / "t"), stripe_bytes=1 << 14)
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    (file,) = (tmp_path / "t").glob("*.orc")
    reader = jvm.org.apache.orc.OrcFile.createReader(jvm.org.apache.hadoop.fs.Path(str(file)), jvm.org.apache.orc.OrcFile.readerOptions(conf))
    assert reader.getStripes().size() > 1 and reader.getRowIndexStride() == orc_tokens.STRIDE
    rows = reader.rows()
    footer = rows.readStripeFooter(reader.getStripes().get(0))
    streams = [(footer.getStreams(i).getKind().toString(), footer.getStreams(i).getColumn()) for i in range(footer.getStreamsCount())]
    assert [c for k, c in streams if k == "BLOOM_FILTER_UTF8"] == [1] and {c for k, c in streams if k == "ROW_INDEX"} >= {1, 2, 3, 4}
    assert {footer.getColumns(c).getKind().toString() for c in (1, 2, 3, 4)} == {"DIRECT_V2"}  # run-length encoding, version 2
    rows.close()
    assert rows_read(orc_tokens.read(spark, path).select("doc_id")) == 6000
    absent, there = orc_tokens.lookup(spark, path, [4001]), orc_tokens.lookup(spark, path, [ids[3000]])
    assert absent.count() == 0 and rows_read(absent) <= 1000  # the Bloom filters rule out all but what they mistake
    assert there.count() == 1 and 0 < rows_read(there) <= 2000
    assert there.where(F.size("tokens") == F.col("n_tokens")).count() == 1 and there.columns == ["doc_id", "n_tokens", "tokens"]


def test_op6_long_text(spark, tmp_path):
    text = " ".join(random.Random(1).choice(("alpha", "beta", "gamma")) for _ in range(250_000))
    orc_tokens.write(spark.createDataFrame([("a", text)], "doc_id string, text string"), path := str(tmp_path / "l"))
    row = orc_tokens.read(spark, path).first()
    assert orc_tokens.detokenize()(row["tokens"]) == text and row["n_tokens"] == len(row["tokens"]) >= 250_000
