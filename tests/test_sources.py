import pytest
from pyspark.sql import functions as F

from scorelens import session
from scorelens.sources import readers, writers
from scorelens.sources.tables import comments


def test_json_lines_with_missing_fields(spark, tmp_path):
    lines = [
        '{"id":"a","body":"hi","author":"ann","score":"3"}',
        '{"id":"b","body":null,"created_utc":"10","other":1}',
    ]
    (tmp_path / "c.json").write_text("\n".join(lines))
    rows = readers.read_json_comments(spark, str(tmp_path)).orderBy("id").collect()
    assert [row.asDict()["score"] for row in rows] == ["3", None]
    assert list(rows[0].asDict()) == list(readers.COMMENT_COLUMNS)


def test_csv_with_quoted_lines(spark, tmp_path):
    (tmp_path / "c.csv").write_text('id,body,score\n1,"two\nlines, ""quoted""",5\n2,plain,-1\n')
    rows = readers.read_csv_comments(spark, str(tmp_path / "c.csv")).orderBy("id").collect()
    assert [tuple(row) for row in rows] == [("1", 'two\nlines, "quoted"', "5"), ("2", "plain", "-1")]


def test_parquet_table_becomes_thirteen_text_columns(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.createDataFrame([(7, "x", 3.0)], "ID bigint, body string, score double").write.parquet(path)
    table = readers.read_table_comments(spark, path)
    assert table.columns == list(readers.COMMENT_COLUMNS)
    assert set(dict(table.dtypes).values()) == {"string"}
    row = table.first()
    assert (row["id"], row["score"], row["author"]) == ("7", "3.0", None)


def test_lexicon_lines(spark, tmp_path):
    lines = ["good\t2", "no valence", "odd\tx", "bad\t-3", "three\t1\t2", "does not work\t-1", "good\t4"]
    (tmp_path / "lex.txt").write_text("\n".join(lines))
    entries = readers.read_lexicon(spark, str(tmp_path / "lex.txt")).collect()
    assert {row["word"]: row["valence"] for row in entries} == {"good": 4, "bad": -3, "does not work": -1}


def test_community_tables_prune(spark, tmp_path):
    rows = [(i, "AskReddit" if i % 3 else "music", str(1441065600 + 86400 * i)) for i in range(60)]
    rows.append((99, "askreddit", "1441065600"))
    df = spark.createDataFrame(rows, "id int, subreddit string, created_utc string")
    path = str(tmp_path / "tables")
    writers.write_community_tables(df, path)
    stored = spark.read.parquet(path)
    assert stored.count() == 60
    music = stored.where(F.col("subreddit") == "music")
    assert music.count() == 20
    plan = music._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(subreddit" in plan
    months = {str(row[0])[:7] for row in stored.select("month").distinct().collect()}
    assert months == {"2015-09", "2015-10"}


def test_curve_lines(spark, tmp_path):
    path = str(tmp_path / "curve")
    curve = spark.createDataFrame([(0.5, 1.25, 2.5)], "reg_param double, train_rmse double, test_rmse double")
    writers.write_curve(curve, path)
    assert [row[0] for row in spark.read.text(path).collect()] == ["0.5,1.25,2.5"]


def test_comment_view(spark, sf):
    view = comments(spark, sf)
    assert view.columns == ["id", "body", "author", "subreddit", "created_utc", "score"]
    assert view.count() == 200


def test_a_document_without_an_event_counts_as_loaded(spark, sf, tmp_path):
    for name in ("documents", "events", "pages"):
        table = spark.read.parquet(f"{sf}/{name}.parquet")
        if name == "events":
            table = table.where("event_id <> 7")
        table.write.parquet(f"{tmp_path}/{name}.parquet")
    view = comments(spark, str(tmp_path))
    assert view.count() == 200 and view.where("author is null").count() == 1


class _Conf:
    def __init__(self, values):
        self.values = values

    def get(self, key, default=None):
        return self.values.get(key, default)


class _Session:
    def __init__(self, **values):
        self.conf = _Conf({key.replace("_", "."): value for key, value in values.items()})


def test_scratch_folder_is_the_one_the_cluster_names():
    named = _Session(spark_master="spark://host", spark_checkpoint_dir="hdfs://shared/tmp")
    assert session.shared_folder(named) == "hdfs://shared/tmp"
    for master in ("spark://host", "local-cluster[2,1,1024]", ""):
        with pytest.raises(ValueError):
            session.shared_folder(_Session(spark_master=master))
