import json
import os

from pyspark.sql import functions as F
from sqlquarry import pipeline, schemas, sinks, sources
from sqlquarry.extract.strings import corpus
from sqlquarry.functions import names
from sqlquarry.operators import catalogue, relational
from sqlquarry.streaming import incremental


def write(path, text, mode="w"):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, mode) as f:
        f.write(text)


def make_repo(folder):
    write(f"{folder}/a.sql", "CREATE TABLE users (id int primary key, user_name varchar(20), paid decimal(5,2));\nSELECT id, user_name FROM users WHERE id = 3;\nSELECT paid FROM users JOIN x ON users.id = x.uid;")
    write(f"{folder}/src/b.py", 'q = "select user_name from users order by paid"\nr = "select 1 from b"\n')
    write(f"{folder}/src/C.PY", "'select a from b'")
    write(f"{folder}/bad.js", b"var q = 'select x from \xff t';", "wb")
    write(f"{folder}/readme.md", "hello")
    write(f"{folder}/src/deep.md", "not in the root")
    write(f"{folder}/big.txt", "x" * (1 << 20))


def test_mining_to_catalogue(spark, tmp_path):
    repo, store = f"{tmp_path}/repo", f"{tmp_path}/corpus"
    make_repo(repo)
    files = sources.read_sources(spark, repo)
    assert {os.path.basename(r["file_path"]) for r in files.collect()} == {"a.sql", "b.py", "bad.js"}
    assert sources.read_sources(spark, repo, file_filter=F.contains("path", F.lit("/src/"))).count() == 1
    assert [tuple(r) for r in sources.read_metadata(spark, repo).collect()] == [("readme.md", "md", "hello")]
    assert sources.read_processed_urls(spark, store).count() == 0

    metadata = sources.read_metadata(spark, repo).agg(F.collect_list(F.struct("file_path", "file_type", "content")).alias("metadata_files"))
    mined = corpus(files, "https://github.com/me/shop").withColumn("k", F.lit(1)).join(metadata.withColumn("k", F.lit(1)), "k").drop("k")
    for _ in range(2):
        sinks.write_corpus(mined.select("repo_name", "repo_url", "file_results", "metadata_files"), store)
    assert sources.read_corpus(spark, store).count() == 1
    assert [r["repo_url"] for r in sources.read_processed_urls(spark, store).collect()] == ["https://github.com/me/shop"]
    assert os.path.isdir(f"{store}/repo_key=me_shop")

    repos = spark.createDataFrame([(1, "shop", "https://github.com/me/shop")], schemas.REPOS)
    queries = catalogue.load_queries(sources.read_corpus(spark, store), repos).cache()
    assert queries.columns == [f.name for f in schemas.QUERIES]
    assert sorted(r["id"] for r in queries.collect()) == list(range(5)) and queries.where("repo_id = 1").count() == 5
    assert catalogue.load_queries(sources.read_corpus(spark, store), repos, min_queries=1).count() == 6
    assert [tuple(r) for r in catalogue.type_counts(queries).collect()] == [("SELECT", 4), ("CREATE", 1)]

    tables, columns = spark.createDataFrame([], schemas.TABLES), spark.createDataFrame([], schemas.COLUMNS)
    new = catalogue.recover_tables(queries, repos, tables, columns)
    (table,) = new["tables"].collect()
    assert (table["id"], table["table_name"], table["table_name_clean"]) == (1, "users", "users")
    got = {r["column_name"]: r for r in new["columns"].collect()}
    assert got["id"]["is_primary_key"] and not got["id"]["is_unique"] and got["paid"]["column_base_type"] == "Float" and got["paid"]["semantic_type"] == "ID"
    swapped = {r["column_name"]: r for r in catalogue.recover_tables(queries, repos, tables, columns, parity=True)["columns"].collect()}
    assert swapped["id"]["is_unique"] and not swapped["id"]["is_primary_key"]
    assert catalogue.recover_tables(queries, repos, new["tables"], new["columns"])["tables"].count() == 0

    matched, missed = catalogue.usage_table(queries, new["tables"], new["columns"])
    ids = {r["id"]: n for n, r in got.items()}
    used = {(ids[r["column_id"]], r["operator_type"], r["expression"], r["other_operand"]) for r in matched.collect()}
    assert used == {("id", "SELECT", None, None), ("user_name", "SELECT", None, None), ("id", "WHERE", "=", "3"), ("paid", "SELECT", None, None), ("id", "JOIN", "=", "x . uid"), ("paid", "ORDER BY", None, None)} or used == {("id", "SELECT", None, None), ("user_name", "SELECT", None, None), ("id", "WHERE", "=", "3"), ("paid", "SELECT", None, None), ("id", "JOIN", "=", "x.uid"), ("paid", "ORDER BY", None, None)}
    assert {r["name"] for r in missed.collect()} == {"uid"}


def test_catalogue_json(spark, tmp_path):
    column = {"TYPE": "int", "UNIQUE": True}
    data = {
        "f1": {"INFO": {"URL": " https://github.com/a/b/blob/x.sql ", "LICENSE": "MIT", "PERMISSIVE": True}, "TABLES": {"s.t": {"COLUMNS": {"id": column, "Name": {}}}}},
        "f2": {"INFO": {"URL": "https://github.com/a/b/y.sql"}, "TABLES": {"s.t": {"COLUMNS": {"other": column}}, "u": {"COLUMNS": {"id": column, "ID": column}}}},
        "f3": {"INFO": {"URL": "http://elsewhere.org/a/b"}, "TABLES": {}},
    }
    write(f"{tmp_path}/c.json", json.dumps(data))
    made = catalogue.build(sources.read_catalogue(spark, f"{tmp_path}/c.json"))
    assert [tuple(r) for r in made["repos"].collect()] == [(1, "b", "https://github.com/a/b")]
    assert [tuple(r)[2:4] for r in made["tables"].orderBy("id").collect()] == [("s.t", "t"), ("u", "u")]
    got = [(r["column_name"], r["column_type"], r["is_unique"], r["is_nullable"]) for r in made["columns"].orderBy("id").collect()]
    assert got == [("id", "Int32", True, True), ("Name", "OTHER", False, True), ("id", "Int32", True, True), ("ID", "Int32", True, True)]
    listed = sources.read_catalogue_repos(spark, f"{tmp_path}/c.json")
    assert [tuple(r) for r in listed.collect()] == [("b", "https://github.com/a/b", "MIT", True)]
    sinks.write_repo_list(listed, f"{tmp_path}/list")
    assert relational.pending(sources.read_repo_list(spark, f"{tmp_path}/list"), spark.createDataFrame([(None,)], "repo_url string"), seed=1).count() == 1


def test_delimited(spark, tmp_path):
    write(f"{tmp_path}/data/me/t.v1.csv", "a;b;c\n1;x;2.5\n2;y\n3;z;1.5\n")
    write(f"{tmp_path}/data/me/u.csv", "k,v\n1,2\n")
    got = sources.import_delimited_tree(spark, f"{tmp_path}/data")
    assert set(got) == {("me", "t"), ("me", "u")}
    assert [tuple(r) for r in got["me", "t"].orderBy("a").collect()] == [(1, "x", 2.5), (2, "y", None), (3, "z", 1.5)]
    assert sources.sniff_delimiter(["a\tb", "c\td"]) == "\t"


def test_json_rows_and_scripts(spark, tmp_path):
    df = spark.createDataFrame([(1, "a")], "x int, y string")
    assert sinks.to_json(df).first()["json"] == '{"x":1,"y":"a"}'
    write(f"{tmp_path}/s/tpch/q1.sql", "select 1")
    write(f"{tmp_path}/s/other/q2.sql", "select 1")
    assert sources.read_benchmark_scripts(spark, f"{tmp_path}/s", ("tpch",)).count() == 1
    sinks.write_table(df, f"{tmp_path}/t")
    assert sources.read_all_parquet(spark, f"{tmp_path}/t").count() == 1


def test_positions_and_first(spark):
    rows = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v"))
    got = relational.with_positions(rows, ["v"], start=5).collect()
    assert {r["id"]: r["v"] for r in got} == {i + 5: i for i in range(1000)}
    assert relational.with_positions(rows.where("false"), ["v"]).count() == 0
    df = spark.createDataFrame([("a", 2, None), ("a", 1, "x"), (None, 3, "y")], "k string, o int, v string")
    assert sorted(map(str, relational.first_by(df, ["k"], ["o"]).collect())) == sorted(["Row(k='a', o=1, v='x')", "Row(k=None, o=3, v='y')"])


def test_stream_takes_each_file_once(spark, tmp_path):
    folder, target, state = f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/state"
    write(f"{folder}/a.sql", "select a from b; select c from d")
    incremental.mine(spark, folder, target, state).awaitTermination()
    write(f"{folder}/b.py", "'select e from f'")
    incremental.mine(spark, folder, target, state).awaitTermination()
    rows = spark.read.parquet(target).collect()
    assert sorted((r["sql"], r["language"]) for r in rows) == [("select a from b", "sql"), ("select c from d", "sql"), ("select e from f", "py")]
    assert names.extension  # the same naming as in batch


def test_whole_run(spark, tmp_path):
    make_repo(f"{tmp_path}/repo")
    pipeline.mine_repository(spark, f"{tmp_path}/repo", "https://github.com/me/shop", f"{tmp_path}/corpus")
    (row,) = sources.read_corpus(spark, f"{tmp_path}/corpus").collect()
    assert [m["file_path"] for m in row["metadata_files"]] == ["readme.md"]
    data = {"f": {"INFO": {"URL": "https://github.com/me/shop/x.sql"}, "TABLES": {"public.x": {"COLUMNS": {"uid": {"TYPE": "int"}}}}}}
    write(f"{tmp_path}/c.json", json.dumps(data))
    built = pipeline.build_catalogue(spark, f"{tmp_path}/corpus", f"{tmp_path}/c.json", f"{tmp_path}/db")
    assert {n: t.count() for n, t in built.items()} == {"repos": 1, "queries": 5, "tables": 2, "columns": 4, "column_usages": 7}
    assert sorted(r["id"] for r in built["columns"].collect()) == [1, 2, 3, 4]
    good, bad = pipeline.plan_queries(spark, built, f"{tmp_path}/db")
    assert (good.count(), [r["error_message"].split(":")[0] for r in bad.collect()]) == (2, ["TABLE_OR_VIEW_NOT_FOUND", "TABLE_OR_VIEW_NOT_FOUND"])
    assert tuple(pipeline.success_report(good, bad).first()) == (2, 2, 50.0)
    assert tuple(pipeline.success_report(good.limit(0), bad.limit(0)).first()) == (0, 0, 0.0)


def test_other_files_are_not_opened(spark, tmp_path):
    write(f"{tmp_path}/a.py", "x = 1")
    write(f"{tmp_path}/large.bin", "x" * 5000)
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", "1000")
    try:
        assert sources.read_sources(spark, str(tmp_path)).count() == 1
        assert [r["content"] for r in sources.read_sources(spark, str(tmp_path)).collect()] == ["x = 1"]
    finally:
        spark.conf.unset("spark.sql.sources.binaryFile.maxLength")


def test_import_counts_errors(spark, tmp_path):
    write(f"{tmp_path}/me/good.csv", "a,b\n1,2\n")
    write(f"{tmp_path}/me/torn.csv.gz", "not compressed")
    errors = {}
    got = sources.import_delimited_tree(spark, str(tmp_path), errors=errors)
    assert set(got) == {("me", "good")} and [os.path.basename(p) for p in errors] == ["torn.csv.gz"]
