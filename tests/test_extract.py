import pytest
from sqlquarry.extract.lexers import extract_strings
from sqlquarry.extract.strings import corpus, extract_sql

CASES = [
    ("python", 'q = """select *\nfrom t"""\nw = \'x\' # "no"\n', ["select *\nfrom t", "x"]),
    ("python", "p = r'a\\\\b'\nf'{x} y'\n", ["a\\\\b", "{x} y"]),
    ("python", "if a == 'kept':\n    pass\n", ["kept"]),
    ("js", "const a = `one\ntwo ${x}`; // 'no'\nlet b = \"three\";", ["one\ntwo ${x}", "three"]),
    ("js", "f('a' + b('lost') + 'c', 'd'); if (x === 'lost') y('e')", ["ac", "d", "e"]),
    ("java", 'class T { String a = """b\nc"""; char q = \'"\'; String d = "e"; }', ["b\nc", "e"]),
    ("java", 'String s = "select " + cols() + " from t " /* "no" */ + "where x";', ["select  from t where x"]),
    ("go", "var q = `select ` + \"a\" + ` from b`\nvar r = '\"'\nvar s = \"c\"", ["select a from b", "c"]),
    ("cpp", 'auto a = R"x(raw )" y)x"; auto b = "two " "parts"; auto c = "three";', ['raw )" y', "two parts", "three"]),
    ("csharp", 'var a = @"say ""hi"" \\"; var b = $"x {y}"; var c = "d" + "e";', ['say ""hi"" \\', "x {y}", "de"]),
    ("python", "x = ''\ny = \"\"\n", ["", ""]),
    ("python", "broken = 'no end\nz = 'ok'\n", ["ok"]),
]


@pytest.mark.parametrize("language, source, expected", CASES)
def test_strings(language, source, expected):
    got = [f["string"] for f in extract_strings(source, language)]
    assert got == expected
    twice = extract_strings(source + "\n" + source, language)
    assert len(twice) == 2 * len(expected)
    assert [f["string"] for f in extract_strings(source + "\n" + source, language, dedupe=True)] == list(dict.fromkeys(expected))


def test_places_and_context():
    source = "x = 1\n" + "# pad\n" * 100 + 'y = "select 1"\n'
    (found,) = extract_strings(source, "python")
    assert found["line_number"] == 102 and found["text_context_offset"] == 400
    assert found["node_content_length"] == len('"select 1"')
    assert found["text_context"].endswith('y = "select 1"\n') and len(found["text_context"]) <= 400 + 10 + 400


def test_first_fragment_and_unknown_language():
    assert [f["string"] for f in extract_strings(r'a = "x\ny"', "js", first_fragment=True)] == ["x"]
    assert extract_strings("'x'", "ruby") == [] and extract_strings(None, "js") == []


def test_long_literals_do_not_overflow():
    assert len(extract_strings('x = "' + "a\\n" * 500_000 + '"', "python")[0]["string"]) == 1_500_000


def test_extract_sql(spark):
    rows = [
        ("a.py", 'q = "SELECT a FROM t WHERE b > 1"\nr = "not sql"\ns = "delete from t"\nu = "WITH x AS (SELECT 1) SELECT * FROM x"'),
        ("b.sql", "-- it\nSELECT 1 FROM t;\n\nINSERT INTO t VALUES (';');"),
        ("c.rb", "'SELECT a FROM t'"),
        ("d.go", None),
    ]
    files = spark.createDataFrame(rows, "file_path string, content string")
    got = [tuple(r) for r in extract_sql(files).orderBy("file_path", "ordinal").select("file_path", "name", "type", "sql", "line").collect()]
    assert got == [
        ("a.py", "query_1", "SELECT", "select a from t where b > 1", 1),
        ("a.py", "query_2", "WITH", "with x as ( select 1 ) select * from x", 4),
        ("b.sql", "query_1", "SELECT", "select 1 from t", 1),
        ("b.sql", "query_2", "INSERT", "insert into t values ( ';' )", 4),
    ]
    assert extract_sql(files, tables=["T"], columns=["b"]).count() == 1
    assert extract_sql(files, select_only=True).count() == 2
    (repo,) = corpus(files, "https://github.com/me/it/tree/main").collect()
    assert (repo["repo_name"], repo["repo_url"]) == ("it", "https://github.com/me/it")
    by = {f["file_path"]: f for f in repo["file_results"]}
    assert [len(by[p]["queries"]) for p in ("a.py", "b.sql", "c.rb", "d.go")] == [2, 2, 0, 0]
    assert by["c.rb"]["header"] == "" and by["b.sql"]["header"].startswith("-- it") and by["a.py"]["language"] == "py"
