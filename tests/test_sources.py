import random

from pyspark.sql import functions as F

from corpusmill.sources.corpus import (
    concat_splits, read_corpus, read_csv, read_dataset, read_lines, split_counts, write_csv, write_dataset,
    write_lines,
)

TEXTS = ["", None, "NA", 'say "hi", ok\nline2', "a\r\nb", "  blanks  ", "ends with \\", '"', "\\N-like", "a,b", "😀", '\\"']


def _rows(spark):
    return spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")


def test_csv_round_trip(spark, tmp_path):
    path = str(tmp_path / "csv")
    write_csv(_rows(spark), path)
    back = read_csv(spark, path, "doc_id long, text string").orderBy("doc_id").collect()
    assert [r.text for r in back] == TEXTS


def test_csv_ranges_equal_the_reader_of_whole_files(spark, tmp_path):
    """Records, quotes and line breaks that cross many byte ranges, a record longer than several, several files."""
    path = str(tmp_path / "csv")
    pick = random.Random(2)
    pieces = ["\n", "\r\n", '"', '""', ",", "a", "bc", " ", "\n\n", "é", "\\", "'"]
    texts = TEXTS + ["".join(pick.choice(pieces) for _ in range(pick.randrange(60))) for _ in range(400)]
    texts += ["\n" * 3000, 'x"\n' * 2000, "y" * 9000]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartitionByRange(2, "doc_id")
    write_csv(rows, path)
    whole = [tuple(r) for r in read_csv(spark, path, "doc_id long, text string").orderBy("doc_id").collect()]
    assert whole == list(enumerate(texts))
    for size in (300, 5000, 1 << 20):
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        try:
            back = read_csv(spark, path, "doc_id long, text string", ranges=True)
            assert sorted(map(tuple, back.collect())) == whole
            tasks = spark.read.text(path).rdd.getNumPartitions()
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
            spark.conf.unset("spark.sql.files.openCostInBytes")
        assert size > 300 or tasks > 50


def test_ranges_of_empty_files(spark, tmp_path):
    path = str(tmp_path / "csv")
    write_csv(_rows(spark).limit(0), path)
    assert read_csv(spark, path, "doc_id long, text string", ranges=True).collect() == []


def test_lines(spark, tmp_path):
    path = str(tmp_path / "lines")
    write_lines(_rows(spark), path)
    expected = sorted(line for t in TEXTS for line in ("nan" if t is None else t).split("\n"))
    assert sorted(r.text for r in read_lines(spark, path).collect()) == expected


def test_dataset_scan_reads_one_split_and_the_asked_columns(spark, tmp_path):
    path = str(tmp_path / "dataset")
    rows = [(i, [i, 2], 1, "validation" if i % 10 == 0 else "train") for i in range(50)]
    write_dataset(spark.createDataFrame(rows, "doc_id long, input_ids array<int>, n_tokens int, split string"), path)
    part = read_dataset(spark, path, "validation", ["input_ids"])
    assert sorted(r.input_ids[0] for r in part.collect()) == [0, 10, 20, 30, 40]
    plan = part._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(split" in plan
    assert "ReadSchema: struct<input_ids:array<int>>" in plan
    assert {(r.split, r.n_rows) for r in split_counts(read_dataset(spark, path)).collect()} == {
        ("train", 45), ("validation", 5),
    }


def test_corpus_scan_prunes_columns(spark, sf_dir):
    corpus = read_corpus(spark, f"{sf_dir}/documents.parquet", F.lit("train"))
    assert corpus.columns == ["split", "doc_id", "text"]
    plan = corpus._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan


def test_concat_keeps_duplicates_and_order(spark):
    a = spark.createDataFrame([("x",), ("x",)], "text string")
    b = spark.createDataFrame([("x",)], "text string")
    assert sorted(map(tuple, concat_splits(a, b).collect())) == [("x", 0), ("x", 0), ("x", 1)]
