"""Sources, sinks, models and the streaming append."""

import sys

from pyspark import cloudpickle
from pyspark.sql import functions as F

from pagewright.operators import similarity
from pagewright.operators.features import clean_features
from pagewright.sources import files
from pagewright.streaming.append import append_documents, stream_append


def test_tsv_without_quoting_and_extra_columns(spark, tmp_path):
    (tmp_path / "text_a.txt").write_text('File Name\tPage Number\tNote\nf"1\t2\t"x\nf2\tbad\ty\n')
    df = files.read_tsv(spark, str(tmp_path / "text_*.txt"), "file_name string, page_number int")
    assert df.columns == ["file_name", "page_number", "note"]
    assert sorted((r[0], r[1], r[2]) for r in df.collect()) == [('f"1', 2, '"x'), ("f2", None, "y")]


def test_wide_column(spark):
    df = spark.createDataFrame([("1,2", 5), ("3", 6), (None, 7)], "`a,b` string, k int")
    assert sorted(map(tuple, files.expand_wide(df, "a,b").select("k", "a", "b").collect())) == [(5, 1.0, 2.0), (6, 3.0, None), (7, None, None)]


def test_folder_by_names(spark, tmp_path):
    (tmp_path / "text_a.txt").write_text("file_name\tpage_number\tline_number\ttext\tx\ty\tx2\ty2\tw\th\tavg_h\nf\t1\t0\tt\t1\t2\t3\t4\t5.0\t6.0\t7.0\n")
    (tmp_path / "a_page_info.txt").write_text("file_name\tpage_number\nf\t1\n")
    (tmp_path / "a_doc.txt").write_text("file_name\tcompany_id\nf\tc\n")
    (tmp_path / "a_cia.txt").write_text("company_id\tcompany_name\nc\tn\n")
    got = files.read_folder(spark, str(tmp_path))
    assert set(got) == {"text", "page_info", "doc", "cia"} and got["text"].first()["w"] == 5.0
    assert set(files.read_folder(spark, str(tmp_path), pages_only=True)) == {"page_info"}


def test_discovery(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    for n in ("a.pdf", "sub/b.PNG", "c.txt", "d.jpeg"):
        (tmp_path / n).write_bytes(b"x")
    assert sorted(r["file_name"] for r in files.discover(spark, str(tmp_path)).collect()) == ["a", "b", "d"]


def test_model_round_trip(spark, tmp_path):
    a, c, f = spark.range(3), spark.range(2), spark.range(1)
    files.save_model(str(tmp_path / "m"), a, c, f, {"thr": 83})
    x, y, z, args = files.load_model(spark, str(tmp_path / "m"))
    assert (x.count(), y.count(), z.count(), args) == (3, 2, 1, {"thr": 83})
    files.append_json(a, str(tmp_path / "j"))
    files.append_json(a, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 6
    files.write_tsv(a, str(tmp_path / "t"))
    files.report(a, str(tmp_path / "r"))
    assert spark.read.option("header", True).csv(str(tmp_path / "r")).count() == 3


SCHEMA = "doc_id long, feature string, type string, level string, value double, frequency int"


def test_stream_equals_batch(spark, tmp_path):
    known = spark.createDataFrame([(1, f"title_{i}", "title", "cluster", None, 1) for i in range(8)], SCHEMA)
    clusters = similarity.contributions(clean_features(known).select("id", "feature", "weight"), spark.createDataFrame([(1, 4)], "id long, cluster_id long"))
    new = [(10, f"title_{i}", "title", "cluster", None, 1) for i in range(8)] + [(11, f"z{i}", "title", "cluster", None, 1) for i in range(8)] + [(12, "title_1", "title", "cluster", None, 1)]
    df = spark.createDataFrame(new, SCHEMA)
    want = sorted(map(tuple, append_documents(df, clusters).collect()))
    assert want == [(10, 4, 1.0), (11, -11, 1.0), (12, 0, 0.0)]
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream_append(spark, str(tmp_path / "in"), SCHEMA, clusters, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).select("id", "cluster_id", F.col("score"))
    assert sorted(map(tuple, got.collect())) == want


cloudpickle.register_pickle_by_value(sys.modules[__name__])


class FakeReader:
    """Pages are separated by form feeds, words by blanks; 'bad' can't be read."""

    def pages(self, content, password=None):
        if content == b"bad":
            raise ValueError("unreadable")
        return len(content.decode().split("\f")) if content else 0

    def read(self, content, first, last):
        for n, page in enumerate(content.decode().split("\f"), 1):
            if first <= n <= last:
                words = [{"page_number": n, "block_num": 1, "line_num": 0, "word_num": i, "text": w, "left_px": 10.4 * i, "top_px": 5.0, "width_px": 9.0, "height_px": 10.0, "level": 5, "conf": 90.0} for i, w in enumerate(page.split(" "))]
                yield {"page_number": n, "page_width": 600.0, "page_height": 800.0, "angle": 0, "language": "eng", "lang_confidence": 0.9, "encrypted": "N", "html": f"<p>{page}</p>"}, words


def test_reader_interface(spark):
    from pagewright.functions.layout import assemble_lines
    from pagewright.sources import reader

    files_df = spark.createDataFrame([("f", b"one two\fthree\ffour"), ("g", b"bad"), ("h", b"")], "file_name string, content binary")
    got = reader.read_files(files_df, FakeReader, window=2)
    assert sorted(r["file_name"] for r in got.where("kind = 'error'").collect()) == ["g", "h"]
    words = reader.tidy_words(got.where("kind = 'word'").select("word.*"))
    pages = got.where("kind = 'page'").select("page.*")
    assert sorted((r["page_number"], r["text"]) for r in assemble_lines(words).collect()) == [(1, "one two"), (2, "three"), (3, "four")]
    rec = reader.page_records(pages, words).orderBy("page_number").collect()
    assert [(r["orientation"], r["content_type"]) for r in rec] == [("P", "R")] * 3


def test_vocabulary_files(spark, tmp_path):
    from pagewright.sources import reader

    (tmp_path / "a.json").write_text('{"Maison<n>": 1, "chat": 2}')
    (tmp_path / "b.txt").write_text("house\n\ncat\ncat\n")
    assert sorted(r["token"] for r in reader.read_vocabulary(spark, str(tmp_path / "a.json"), "fra", json=True).collect()) == ["chat", "maison"]
    assert sorted(r["token"] for r in reader.read_vocabulary(spark, str(tmp_path / "b.txt"), "eng").collect()) == ["cat", "house"]
    assert set(reader.output_paths("/x/")) == {"text", "bbox", "format", "page_info", "doc_info"}


def test_labelled_evaluation(spark):
    from pagewright.operators.evaluate import labelled_evaluation

    a = spark.createDataFrame([(1, 1, 0), (2, 1, 1), (3, 2, 0)], "id long, cluster_id long, subcluster int")
    t = spark.createDataFrame([(1, 1, 0), (2, 1, 0), (3, 2, 0)], "id long, cluster long, subcluster int")
    assert labelled_evaluation(a, t).first()[0] == 1.0
    assert round(labelled_evaluation(a, t, True).first()[0], 6) == round((0.5 + 0.5 + 1) / 3, 6)
